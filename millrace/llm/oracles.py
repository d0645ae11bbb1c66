"""SQL for the operators whose results SQL can express, for checking on small tables."""

from __future__ import annotations

from string import ascii_lowercase, ascii_uppercase

from millrace.llm import fim, hashtree
from millrace.llm.collocations import FIRST_ROWS, LEAST, LONGEST
from millrace.llm.decontaminate import WINDOW
from millrace.llm.near_dedup import WORDS


def lowered(column: str) -> str:
    return f"translate(coalesce({column}, ''), '{ascii_uppercase}', '{ascii_lowercase}')"


def _windows(size: int) -> str:
    """Every window of ``size`` words of a document, by its first place."""
    return f"""select doc_id, pos, {size} as n, string_agg(word, ' ') over (
      partition by doc_id order by pos rows between current row and {size - 1} following) as words
    from placed where words_there >= {size} qualify pos + {size} <= words_there"""


_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
DECONTAMINATION = f"""
with lists as (select doc_id, regexp_extract_all({lowered("text")}, '{_WORD}') as ws from documents),
placed as (select doc_id, unnest(ws) as word, unnest(range(len(ws))) as pos, len(ws) as words_there from lists),
items as (select cast(item_id as varchar) as item, regexp_extract_all({lowered("text")}, '{_WORD}') as ws from benchmark),
asked as (select distinct item, n, array_to_string(ws[i:i + n - 1], ' ') as words from (
  select item, ws, least({WINDOW}, len(ws)) as n, unnest(range(1, len(ws) - least({WINDOW}, len(ws)) + 2)) as i
  from items where len(ws) > 0)),
windows as ({" union all ".join(f"({_windows(size)})" for size in range(1, WINDOW + 1))}),
found as (select w.doc_id, w.pos, w.n, a.item from windows w join asked a on a.n = w.n and a.words = w.words),
hits as (select doc_id, count(distinct place) as n_hit from (select doc_id, unnest(range(pos, pos + n)) as place from found)
  group by doc_id),
named as (select doc_id, list_sort(list(distinct item)) as names from found group by doc_id)
select l.doc_id, len(ws) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(len(names), 0) as n_items,
  sha256(coalesce(array_to_string(names, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from lists l left join hits using (doc_id) left join named using (doc_id)
"""

_BLANK = r"[^\x20\x09-\x0D]+"
NEAR_DEDUP = f"""
with recursive lists as (select doc_id, regexp_extract_all({lowered("text")}, '{_BLANK}') as ws from documents),
sizes as (select doc_id, ws, least({WORDS}, len(ws)) as n from lists where len(ws) > 0),
placed as (select doc_id, n, unnest(ws) as word, unnest(range(len(ws))) as pos, len(ws) as words_there from sizes),
shingles as (select distinct doc_id, words from (select doc_id, pos, n, words_there, string_agg(word, ' ') over (
  partition by doc_id order by pos rows between current row and {WORDS - 1} following) as words from placed)
  where pos + n <= words_there),
counted as (select doc_id, count(*) as size from shingles group by doc_id),
common as (select a.doc_id as a, b.doc_id as b, count(*) as together from shingles a join shingles b
  on a.words = b.words and a.doc_id < b.doc_id group by a.doc_id, b.doc_id),
links as (select a, b from common join counted s on s.doc_id = a join counted t on t.doc_id = b
  where 100 * together >= 85 * (s.size + t.size - together)),
sides as (select a, b from links union all select b, a from links),
reach as (select a, b from sides union select r.a, s.b from reach r join sides s on s.a = r.b),
least_id as (select a as doc_id, min(b) as low from reach group by a)
select l.doc_id, coalesce(size, 0) as n_shingles, least(l.doc_id, coalesce(low, l.doc_id)) as component_id,
  l.doc_id = least(l.doc_id, coalesce(low, l.doc_id)) as kept
from lists l left join counted using (doc_id) left join least_id using (doc_id)
"""

_PIECE, _PHRASE_WORD = r"[^.,;:!?\x0A-\x0D]+", r"[^\x20\x09]+"
COLLOCATIONS = f"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_extract_all({lowered("text")}, '{_PIECE}')) as piece
  from documents),
lists as (select lang, regexp_extract_all(piece, '{_PHRASE_WORD}') as ws from pieces),
totals as (select lang, sum(len(ws)) as n from lists group by lang),
sized as (select lang, ws, unnest(range(1, {LONGEST + 1})) as size from lists),
placed as (select lang, ws, size, unnest(range(1, len(ws) - size + 2)) as i from sized where size <= len(ws)),
counts as (select lang, array_to_string(ws[i:i + size - 1], ' ') as phrase, any_value(size) as size, count(*) as f
  from placed group by lang, phrase having count(*) >= {LEAST}),
listed as (select lang, phrase, size, f, string_split(phrase, ' ') as ws from counts where size > 1),
inside as (select lang, size, f, unnest(range(1, size)) as m, ws from listed),
parts as (select lang, f, array_to_string(ws[i:i + m - 1], ' ') as part
  from (select lang, f, ws, m, unnest(range(1, size - m + 2)) as i from inside where m > 1)),
longest as (select lang, part, max(f) as longer from parts group by lang, part),
kept as (select c.lang, c.phrase, c.size, c.f as a, c.ws from listed c left join longest p
  on p.lang = c.lang and p.part = c.phrase where coalesce(100 * longer >= 100 * c.f, false) = false),
cut as (select lang, phrase, a, k, array_to_string(ws[1:k], ' ') as first, array_to_string(ws[k + 1:], ' ') as rest
  from (select lang, phrase, a, ws, unnest(range(1, size)) as k from kept)),
priced as (select c.lang, c.phrase, c.a, c.k, x.f as l, y.f as r, t.n,
    (1000::hugeint * c.a::hugeint * t.n::hugeint) // (x.f::hugeint * y.f::hugeint) as score
  from cut c join counts x on x.lang = c.lang and x.phrase = c.first join counts y on y.lang = c.lang and y.phrase = c.rest
  join totals t on t.lang = c.lang),
best as (select * from priced qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase,
  a, l, r, n::bigint as n, score::bigint as score from best)
select * from ranked where rank <= {FIRST_ROWS}
"""

FILL_IN_MIDDLE = f"""
with units as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '[^\\n]*\\n|[^\\n]+') as us,
  sha256('{fim.SEED}:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
drawn as (select doc_id, text, us, len(us) as n, [('0x' || substr(h, 8 * i + 1, 8))::bigint for i in range(4)] as hs from units),
formed as (select *, least(hs[1] % (n + 1), hs[2] % (n + 1)) as low, greatest(hs[1] % (n + 1), hs[2] % (n + 1)) as high,
  case when text = '' or contains(text, '<P>') or contains(text, '<S>') or contains(text, '<M>') or hs[3] % 100 >= {fim.RATE}
    then 'plain' when hs[4] % 100 < {fim.SPM_RATE} then 'spm' else 'psm' end as form from drawn),
split as (select doc_id, text, n, form, array_to_string(us[1:low], '') as p, array_to_string(us[low + 1:high], '') as m,
  array_to_string(us[high + 1:], '') as s from formed)
select doc_id, n, form, case when form <> 'plain' then length(p) end as prefix_chars,
  case when form <> 'plain' then length(m) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || p || '<S>' || s || '<M>' || m
    else '<S>' || s || '<P>' || p || '<M>' || m end) as output_sha256,
  sha256(text) as restored_sha256
from split
"""

# CRC-32 by its defining rule: bytes in runs of 256, the first run shorter, and the effect of 256 zero bytes as a table.
_CRC = """
step(b, c, k) as (select range, range, 0 from range(256) union all
  select b, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from step where k < 8),
codes as (select list(c order by b) as t from step where k = 8),
jumps as (select list(v order by b) as j from (select range as b, list_reduce(list_prepend(
  (range % 256) << (8 * (range // 256)), list_transform(range(256), lambda i: 0::bigint)),
  lambda a, x: xor(a >> 8, t[(a & 255) + 1])) as v from range(1024), codes)),
numbered as materialized (select doc_id, coalesce(text, '') as text, row_number() over () as row from documents),
hexed as (select row, hex(encode(text)) as h from numbered),
runs as (select row, h, unnest(range(0, length(h) // 512 + 1)) as run from hexed),
cut as (select row, run, case when run = 0 then substr(h, 1, length(h) % 512)
  else substr(h, length(h) % 512 + 512 * (run - 1) + 1, 512) end as h from runs),
sums as (select row, run, list_reduce(list_prepend(case when run = 0 then 4294967295 else 0 end::bigint,
  list_transform(range(1, length(h) + 1, 2), lambda i: ('0x' || substr(h, i, 2))::bigint)),
  lambda a, b: xor(a >> 8, t[xor(a & 255, b) + 1])) as c from cut, codes),
crcs as (select row, xor(list_reduce(list(c order by run), lambda a, c: xor(c, xor(xor(j[(a & 255) + 1], j[((a >> 8) & 255) + 257]),
  xor(j[((a >> 16) & 255) + 513], j[(a >> 24) + 769])))), 4294967295) as crc from sums, jumps group by row, j)"""


def _descent(name: str, tree: hashtree.Tree) -> str:
    """``name``: row and node of the shard of each row, by one race a level."""
    levels = tree.children()
    nodes = [(at, parent, *child) for at, level in enumerate(levels) for parent, below in level.items() for child in below]
    values = ", ".join(f"({at}, '{parent}', '{node}', {weight!r}::double, {shard})" for at, parent, node, weight, shard in nodes)
    steps = [f"{name}_nodes(level, parent, node, weight, shard) as (values {values})"]
    above = "(select row, id, '' as node from keys)"
    for at in range(len(levels)):
        steps.append(
            f"{name}{at} as (select row, id, node, shard from (select k.row, k.id, c.node, c.shard, row_number() over ("
            f"partition by k.row order by -ln((('0x' || substr(md5(k.id || ':' || c.node), 1, {hashtree.BITS // 4}))::bigint::double + 0.5)"
            f" / {1 << hashtree.BITS}::double) / c.weight, c.node) as place from {above} k join {name}_nodes c"
            f" on c.level = {at} and c.parent = k.node) where place = 1)"
        )
        above = f"{name}{at}"
    return ",\n".join(steps)


_SHARDS = 40
HASH_TREE = f"""
with recursive {_CRC},
keys as (select *, coalesce(cast(doc_id as varchar), '') as id from numbered),
{_descent("now", hashtree.even_tree(_SHARDS))},
{_descent("then", hashtree.even_tree(_SHARDS + 1, built=_SHARDS))},
placed as (select k.doc_id, octet_length(encode(text)) + {hashtree.ROW_BYTES} as size, crc as text_crc32,
  string_split(n.node, '/') as path, n.shard as shard, t.shard as grown_shard
  from keys k join crcs using (row) join now2 n using (row) join then2 t using (row))
select doc_id, size, text_crc32, 'key' as law, path[1] as region, path[2] as rack, shard,
  row_number() over (partition by shard order by doc_id nulls first, text_crc32) - 1 as slot, grown_shard
from placed
"""
