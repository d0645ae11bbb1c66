"""How the driver tables stand in for samples, verdicts, tasks and chats.

Each binding is SQL that Spark and DuckDB both run, over whole tables and whole
texts. ``chr(10)`` is a newline in either dialect.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

TABLES = ("documents", "events", "conversations", "customer", "nation")

SAMPLES = """
select doc_id,
       concat('func', cast(doc_id as varchar(20))) as func,
       case when doc_id % 2 = 0 then 'x86' else 'arm' end as arch,
       case when doc_id % 3 = 0 then '32' else '64' end as mode,
       concat('O', cast(doc_id % 4 as varchar(20))) as opts,
       source as folder,
       text as sourcecode,
       concat('push rbp', chr(10), 'mov eax, ', cast(n_chars as varchar(20)), chr(10), 'call ', source) as asm_ida_com,
       concat('{"param":["', source, '",', cast(n_chars as varchar(20)), '],".rodata":',
              case when doc_id % 7 = 0 then '{}' else concat('{"msg":"café ', lang, '"}') end,
              ',".data":', case when doc_id % 7 = 0 then '[]' else '[1.50,2e3]' end, ',".bss":null}') as data,
       concat('{"nodes":["b0","', source, '"],"edges":[[0,1]],"nodenum":', cast(doc_id % 6 as varchar(20)), '}')
           as assemgraph_com
from documents
"""

# Verdicts of generated programs: every event is one sample of a task at a level.
VERDICTS = """
select event_id,
       user_id as task_id,
       case event_type when 'click' then 'O0' when 'error' then 'O1' when 'purchase' then 'O2' else 'O3' end as opts,
       event_id as sample,
       concat('model', cast(user_id % 7 as varchar(20))) as model,
       case when event_id % 3 = 0 then '32' else '64' end as mode,
       case when value > 20 then 1 else 0 end as flag_compile,
       case when value > 60 then 1 else 0 end as flag_run,
       case when value > 20 then 1 else 0 end as bare_compile,
       case when event_id % 11 = 0 then 0 else 1 end as has_target,
       case when value > 10 then 1 else 0 end as deps_compile,
       case when value > 30 then 1 else 0 end as linked,
       case when event_id % 13 = 0 then 0 else 1 end as ran,
       case when value > 60 then 1 else 0 end as equal
from events
"""

# Generated results in file and line order; later lines of a key replace earlier ones.
RESULTS = """
select user_id as task_id,
       case event_type when 'click' then 'O0' when 'error' then 'O1' when 'purchase' then 'O2' else 'O3' end as opts,
       event_id % 20 as sample,
       concat('file', cast(event_id % 10 as varchar(20))) as file_name,
       event_id as line_no,
       concat('```c', chr(10), 'int gen', cast(event_id as varchar(20)), '(int x)', chr(10), '```') as gen
from events
"""

TASKS = """
select c_custkey as task_id, concat('O', cast(c_nationkey % 4 as varchar(20))) as opts, c_name as c_func
from customer
"""

# Programs and generated answers with fences, includes and calls around whole documents.
CODE = """
select doc_id,
       concat('fn', cast(doc_id as varchar(20))) as func,
       concat('O', cast(doc_id % 4 as varchar(20))) as opts,
       concat('#include <a.h>', chr(10), '#include <', source, '.h>', chr(10),
              'int fn', cast(doc_id as varchar(20)), '(int x) {', chr(10), text, chr(10), '}') as c_func,
       concat('#include <assert.h>', chr(10), 'int main() { return fn', cast(doc_id as varchar(20)), '(1); }',
              chr(10), '#include <', source, '.h>', chr(10), text) as c_test,
       case when doc_id % 5 = 0 then concat('  ', text, chr(10))
            else concat('Here it is:', chr(10), '```c', chr(10), '#include <a.h>', chr(10), '#include <z.h>', chr(10),
                        'int __fastcall fn', cast(doc_id as varchar(20)),
                        '(int x) { return g1 (x)+g2(x)+g3(x)+g4(x)+g5(x)+g6(x)+g7(x)+g8(x)+g9(x); }', chr(10),
                        text, chr(10), '```', chr(10), 'Or __cdecl :', chr(10), '```c', chr(10),
                        'int __cdecl other(void)', chr(10), '```', chr(10), 'done') end as gen,
       concat('extern "C" ', chr(10), '{', chr(10), '#include "', source, '.c"', chr(10), '}', chr(10), text) as wrapper,
       concat('# Analysis', chr(10), text, chr(10), '# Optimized Code ', chr(10),
              case when doc_id % 4 = 0 then 'nothing to do'
                   when doc_id % 4 = 1 then concat('```C', chr(10), 'none', chr(10), '```')
                   else concat('```c', chr(10), 'int fn(int x) { return x; }', chr(10), '```') end,
              chr(10), '# End') as answer
from documents
"""

LENGTHS = """
select doc_id as row_id,
       case when doc_id % 3 = 0 then 0 else doc_id % 4 end as part,
       cast(doc_id % 2 as int) as split,
       cast(1 + n_chars % 700 as int) as seq_length
from documents
"""

TURNS = """
select conv_id, turn, case when role = 'user' then 'human' else role end as role, text
from conversations
"""


def answers(dialect: str) -> str:
    """Turns as source and generated text, ASCII as byte and character distances then agree."""
    flag = ", 'g'" if dialect == "duckdb" else ""
    plain = f"regexp_replace(text, concat('[^ -~', chr(10), ']'), '?'{flag})"
    return f"""
select conv_id, turn,
       concat('O', cast(turn % 4 as varchar(20))) as opts,
       case when conv_id % 3 = 0 then '32' else '64' end as mode,
       {plain} as sourcecode,
       concat('Answer', chr(10), '```c', chr(10), 'void __fastcall f ', replace({plain}, 'e', 'a'), chr(10), '```') as gen
from conversations
"""


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bind(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` with its tables read from ``sf_dir``; no views are registered."""
    names = "|".join(TABLES)
    return spark.sql(re.sub(rf"\b(from|join)\s+({names})\b", rf"\1 parquet.`{sf_dir}/\2.parquet`", sql))
