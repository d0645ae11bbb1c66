"""Conversations: rendering, turn limits, training rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace.catalog.bindings import TURNS, bind
from millrace.catalog.corpus import array_digest, bytes_of, csv
from millrace.catalog.registry import query
from millrace.operators import conversations as chats

CHAT_LENGTH = 2048
SYSTEM = "'" + chats.SYSTEM.replace("'", "''") + "'"
SPOKEN = f"""
t as ({TURNS}),
mapped as (select *, case lower(role) when 'human' then 'Human' when 'assistant' then 'Assistant' end as speaker from t),
spoken as (select conv_id, turn, speaker, text, row_number() over (partition by conv_id order by turn) - 1 as pos,
  count(*) over (partition by conv_id) as turns from mapped where speaker is not null)
"""


def _turns(spark, sf_dir):
    """Turns with a supported role; the others are in ``chat_roles``."""
    good, _ = chats.split_roles(chats.map_roles(bind(spark, sf_dir, TURNS)))
    return good


@query(
    "chat_roles",
    f"""with t as ({TURNS}) select conv_id, turn,
    case lower(role) when 'human' then 'Human' when 'assistant' then 'Assistant' end as speaker,
    lower(role) not in ('human', 'assistant') as quarantined from t""",
)
def chat_roles(spark, sf_dir):
    good, unsupported = chats.split_roles(chats.map_roles(bind(spark, sf_dir, TURNS)))
    flagged = [part.withColumn("quarantined", F.lit(flag)) for part, flag in ((good, False), (unsupported, True))]
    return flagged[0].unionByName(flagged[1]).select("conv_id", "turn", "speaker", "quarantined")


@query(
    "conversations_of_known_roles",
    f"""with t as ({TURNS}) select conv_id, turn, conv_id in
    (select conv_id from t where lower(role) not in ('human', 'assistant')) as quarantined from t""",
)
def conversations_of_known_roles(spark, sf_dir):
    good, unsupported = chats.split_conversations(chats.map_roles(bind(spark, sf_dir, TURNS)))
    flagged = [part.withColumn("quarantined", F.lit(flag)) for part, flag in ((good, False), (unsupported, True))]
    return flagged[0].unionByName(flagged[1]).select("conv_id", "turn", "quarantined")


def _rendered(start: str, end: str, ended: str = "''") -> str:
    return f"""case when pos = 0 then {SYSTEM} else '' end || speaker || ': {start}' ||
      case when text <> '' then text || '{end}' || {ended} else '' end"""


@query(
    "chat_segments",
    f"with {SPOKEN} select conv_id, pos, {_rendered('<|begin_of_text|>', '<|eot_id|>')} as segment from spoken",
)
def chat_segments(spark, sf_dir):
    return chats.render_segments(_turns(spark, sf_dir))


@query(
    "chat_segments_saved",
    f"with {SPOKEN} select conv_id, pos, {_rendered('<s>', '</s>', 'chr(10)')} as segment from spoken",
)
def chat_segments_saved(spark, sf_dir):
    return chats.render_segments(_turns(spark, sf_dir), template="llama2", saved=True)


@query(
    "chat_prompt_of_two_turns",
    f"""with {SPOKEN}, said as (select conv_id, pos, {_rendered('<|begin_of_text|>', '<|eot_id|>')} as segment
      from spoken where pos < 2)
    select conv_id, string_agg(segment, '' order by pos) as prompt from said group by conv_id""",
)
def chat_prompt_of_two_turns(spark, sf_dir):
    """With a turn limit the segments of a conversation are few enough to join."""
    segments = chats.render_segments(_turns(spark, sf_dir), limit=2)
    ordered = F.sort_array(F.collect_list(F.struct("pos", "segment")))
    grouped = segments.groupBy("conv_id").agg(ordered.alias("parts"))
    return grouped.select("conv_id", F.array_join(F.transform("parts", lambda p: p["segment"]), "").alias("prompt"))


@query(
    "chat_inference_prompt",
    """select conv_id, turn, case role when 'system' then '<s>' || text || chr(10) || chr(10)
         else (case role when 'user' then 'Human' else 'Assistant' end) || ': <s>' || text || '</s>' end
       || 'Human: <s>' || trim(text, chr(10) || ' ') || '</s>' || 'Assistant: <s>' as prompt
    from conversations""",
)
def chat_inference_prompt(spark, sf_dir):
    turns = bind(spark, sf_dir, "select conv_id, turn, role, text from conversations")
    role = F.when(F.col("role") == "system", "").when(F.col("role") == "user", "Human").otherwise("Assistant")
    history = chats.append_message(chats.no_messages(), role, F.col("text"))
    padded = F.concat(F.lit("\n "), F.col("text"), F.lit(" \n"))
    return turns.select("conv_id", "turn", chats.chat_prompt(padded, history).alias("prompt"))


@query(
    "chat_messages_rendered",
    f"""with {SPOKEN} select conv_id, turn, {SYSTEM} || speaker || ': <|begin_of_text|>' ||
       case when text <> '' then text || '<|eot_id|>' else '' end || 'Assistant: <|begin_of_text|>' as prompt,
       2 as messages, 'Human,Assistant' as roles, 0 as offset
    from spoken""",
)
def chat_messages_rendered(spark, sf_dir):
    said = chats.append_message(chats.no_messages(), "speaker", "text")
    open_slot = chats.append_message(said, F.lit("Assistant"), F.lit(None).cast("string"))
    rows = _turns(spark, sf_dir).select("conv_id", "turn", open_slot.alias("messages"))
    record = rows.select("*", chats.render_messages("messages").alias("prompt"), chats.as_record("messages").alias("r"))
    return record.select(
        "conv_id",
        "turn",
        "prompt",
        F.size("r.messages").alias("messages"),
        F.array_join("r.roles", ",").alias("roles"),
        F.col("r.offset").alias("offset"),
    )


FITTING = f"""
{SPOKEN},
measured as (select *, sum(strlen(speaker) + 3 + case when text <> '' then strlen(text) + 1 else 0 end)
   over (partition by conv_id order by turn) + strlen({SYSTEM}) as total from spoken),
pairs as (select conv_id, count(*) // 2 as target_turns from measured
   where pos < turns - turns % 2 and total <= {CHAT_LENGTH} - 1 group by conv_id),
fitting as (select m.*, p.target_turns from measured m join pairs p using (conv_id) where m.pos < 2 * p.target_turns)
"""


@query(
    "chat_turn_limits",
    f"""with {FITTING} select e.conv_id, e.all_turns, coalesce(max(target_turns), 0) as target_turns,
       cast(max(total) as bigint) as prompt_tokens
    from (select conv_id, count(*) as all_turns from spoken group by conv_id) e left join fitting f using (conv_id)
    group by e.conv_id, e.all_turns""",
)
def chat_turn_limits(spark, sf_dir):
    return chats.turn_limits(_turns(spark, sf_dir), CHAT_LENGTH)


HEAD = f"case when pos = 0 then {SYSTEM} else '' end || speaker || ': '"


@query(
    "chat_training_rows",
    f"""with {FITTING}, opened as (select *, first(speaker) over (partition by conv_id order by pos) as opening from fitting),
    pieces as (select conv_id, pos, list_concat({bytes_of(HEAD)}, [256]) as head,
        list_concat({bytes_of("text")}, [257]) as body,
        (pos % 2 = 1) = (opening = 'Human') as kept,
        {HEAD} as head_text, text
      from opened),
    built as (select conv_id, '256,' || string_agg({csv("head")} || ',' || {csv("body")}, ',' order by pos) as input_ids,
        '-100,' || string_agg(
           {csv("list_transform(head, lambda t: case when t = 256 and kept then 256 else -100 end)")} || ',' ||
           {csv("list_transform(body, lambda t: case when kept then t else -100 end)")}, ',' order by pos) as labels,
        '<s>' || string_agg(head_text || '<s>' || text || '</s>', '' order by pos) as inputs_decode,
        '<unk>' || string_agg(case when kept then repeat('<unk>', len(head) - 1) || '<s>' || text || '</s>'
           else repeat('<unk>', len(head) + len(body)) end, '' order by pos) as labels_decode,
        1 + sum(len(head) + len(body)) as seq_length
      from pieces group by conv_id)
    select e.conv_id, md5(input_ids) as input_ids, md5(labels) as labels, md5(inputs_decode) as inputs_decode,
       md5(labels_decode) as labels_decode, cast(seq_length as int) as seq_length, case when input_ids is not null then 'None' end as seq_category
    from (select distinct conv_id from spoken) e left join built using (conv_id)""",
)
def chat_training_rows(spark, sf_dir):
    rows = chats.chat_training_rows(_turns(spark, sf_dir), CHAT_LENGTH)
    return rows.select(
        "conv_id",
        array_digest("input_ids"),
        array_digest("labels"),
        F.md5(F.col("inputs_decode").cast("binary")).alias("inputs_decode"),
        F.md5(F.col("labels_decode").cast("binary")).alias("labels_decode"),
        "seq_length",
        "seq_category",
    )
