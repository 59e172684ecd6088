"""Queries of problem 4."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvane.llm import conversations as C
from corvane.session import table


def p4_found(spark, d):
    return C.rejected_sessions(table(spark, d, "chat_sessions"), table(spark, d, "chat_messages"))


def p4_conversations(spark, d):
    return C.conversations(table(spark, d, "chat_sessions"), table(spark, d, "chat_messages"))


def p4_clocks(spark, d):
    """Pairs of clocks: their constraints, how many are broken as the times stand, and the seconds by which the replier's clock is moved."""
    m = C.messages_once(table(spark, d, "chat_messages"), False)
    c = C.reply_constraints(m)
    moved = C.differences(c, C.clock_pairs(c), 0.5).select("asker", "replier", F.round("d", 6).alias("moved"))
    return C.clock_pairs(c).select("asker", "replier", "n", "n_broken", F.round("lo", 6).alias("lo"), F.round("hi", 6).alias("hi")).join(moved, ["asker", "replier"])


_TURNS = """
 m as (select distinct id, session_id, created_at, content, case lower(trim(regexp_replace(coalesce(role, ''), '\\s', ' ', 'g'))) when 'user' then 'user' when 'human' then 'user' when 'assistant' then 'assistant'
   when 'ai' then 'assistant' when 'system' then 'none' when 'summary' then 'none' else 'unknown' end speaker from chat_messages where session_id is not null),
 t as (select *, lag(speaker) over w prev, row_number() over w turn_no from m where speaker <> 'none' window w as (partition by session_id order by created_at, case speaker when 'user' then 0 when 'unknown' then 1 else 2 end, id)),
 per as (select session_id, bool_or(length(regexp_replace(coalesce(content, ''), '[\\s\\p{Z}\\p{Cc}\\p{Cf}]', '', 'g')) > 0) said, bool_or(speaker = 'unknown' or speaker = 'assistant' and prev is distinct from 'user') broken,
   count(*) filter (where speaker = 'user') nu, count(*) filter (where speaker = 'assistant') na from t group by 1),
 found as (select * from (select s.id session_id, case when not coalesce(said, false) then 'empty' when broken then 'broken' when nu > na then 'missing_reply' end reason
   from (select distinct id from chat_sessions where id is not null) s left join per on per.session_id = s.id) where reason is not null)
"""

QUERIES = {"p4_found": p4_found, "p4_conversations": p4_conversations, "p4_clocks": p4_clocks}
SQL = {
    "p4_found": f"with {_TURNS} select session_id, reason from found",
    "p4_conversations": f"with {_TURNS} select session_id, turn_no, speaker, content, created_at at time zone 'UTC' as \"at\" from t where session_id in (select id from chat_sessions) and session_id not in (select session_id from found)",
    "p4_clocks": f"""with {_TURNS},
 u as (select *, row_number() over (partition by session_id, speaker order by created_at, id) k, epoch_us(created_at) / 1e6 s, count(*) filter (where speaker = 'user') over (partition by session_id) = count(*) filter (where speaker = 'assistant') over (partition by session_id) as even from m where speaker in ('user', 'assistant') and created_at is not null),
 c as (select q.s - r.s lo, n.s - r.s hi from u q join u r on r.session_id = q.session_id and r.k = q.k and r.speaker = 'assistant' left join u n on n.session_id = q.session_id and n.k = q.k + 1 and n.speaker = 'user' where q.speaker = 'user' and q.even)
 select 'user' asker, 'assistant' replier, count(*) n, count(*) filter (where lo > 0 or hi < 0) n_broken, round(max(lo), 6) lo, round(min(hi), 6) hi, 0.0::double moved from c having count(*) > 0""",
}
