"""Message rows to ordered conversations.

Turns of a session are ordered by time; a reply must lie after its question and before the next question. Each sender writes times
by a clock of its own. The k-th reply of a session belongs to its k-th question, as the order of one sender's rows can be trusted;
so each reply bounds the difference of two clocks from below and the next question from above. Differences of clocks are fitted to
the bounds by least squares, offsets of senders to the differences (least squares over the graph of senders), times are
corrected, turns merged in the corrected order, and sessions whose constraints do not hold then are rejected with a reason.

Only a pair of clocks that breaks most of its bounds is corrected: single sessions in the wrong order are faults of those sessions
and not of a clock, and must be reported, not repaired.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.operators.order import number_in_order, previous_in_order
from corvane.session import cut

#: White space, controls, zero-width and other format characters, blank fillers of Hangul and Braille.
INVISIBLE = r"[\s\p{Z}\p{Cc}\p{Cf}͏ᅟᅠ឴឵⠀ㅤﾠ︀-️]+"
#: Spellings of the speakers; fixed values.
SPEAKERS = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "system": "none", "summary": "none"}


def speaker(role: Column) -> Column:
    """user, assistant, none (system and summary rows) or unknown (any other or missing role)."""
    r = F.lower(F.regexp_replace(role, INVISIBLE, ""))
    out = F.lit("unknown")
    for k, v in SPEAKERS.items():
        out = F.when(r == k, v).otherwise(out)
    return F.coalesce(out, F.lit("unknown"))


def visible(content: Column) -> Column:
    return F.coalesce(F.length(F.regexp_replace(content, INVISIBLE, "")) > 0, F.lit(False))


def messages_once(messages: DataFrame, with_content: bool, sender: str | None = None) -> DataFrame:
    """(id, session_id, speaker, sender, visible, created_at[, content]) of rows with a session, repeated rows once. sender names the column of
    whose clock wrote the time; without one the two speakers have a clock each. A null sender is a sender of its own."""
    who = speaker(F.col("role"))
    clock = F.coalesce(F.col(sender).cast("string"), F.lit("")) if sender else who
    d = messages.where(F.col("session_id").isNotNull()).select("id", F.col("session_id").cast("string").alias("session_id"), who.alias("speaker"), clock.alias("sender"), visible(F.col("content")).alias("visible"), F.col("created_at").cast("timestamp").alias("created_at"), *(["content"] if with_content else []))
    return d.dropDuplicates(["id", "session_id", "speaker", "sender", "visible", "created_at"])


def reply_constraints(turns: DataFrame) -> DataFrame:
    """(asker, replier, lo, hi): seconds by which the replier's clock must be moved against the asker's, at least and at most, by each reply.

    Only sessions with as many replies as questions tell which reply belongs to which question; hi is null after the last question,
    and where the next question has another sender. Rows without a time are left out.
    """
    t = turns.where(F.col("speaker").isin("user", "assistant") & F.col("created_at").isNotNull()).select("id", "session_id", "speaker", "sender", "created_at", F.concat_ws("\x1f", "session_id", "speaker").alias("__key"))
    n = lambda who: F.count(F.when(F.col("speaker") == who, 1))
    even = t.groupBy(F.col("session_id").alias("__s")).agg(n("user").alias("nu"), n("assistant").alias("na")).where("nu = na").select("__s")
    k = number_in_order(t, "__key", "created_at", ["id"], "k").select("session_id", "speaker", "sender", "k", (F.unix_micros("created_at") / 1e6).alias("t"))
    k = k.join(even, F.col("session_id") == F.col("__s"), "left_semi")
    q, r = k.where("speaker = 'user'"), k.where("speaker = 'assistant'")
    nxt = q.select("session_id", (F.col("k") - 1).alias("k"), F.col("sender").alias("next_sender"), F.col("t").alias("tn"))
    j = q.select("session_id", "k", F.col("sender").alias("asker"), F.col("t").alias("tq")).join(r.select("session_id", "k", F.col("sender").alias("replier"), F.col("t").alias("tr")), ["session_id", "k"]).join(nxt, ["session_id", "k"], "left")
    return j.where("asker <> replier").select("asker", "replier", (F.col("tq") - F.col("tr")).alias("lo"), F.when(F.col("next_sender") == F.col("asker"), F.col("tn") - F.col("tr")).alias("hi"))


def clock_pairs(constraints: DataFrame) -> DataFrame:
    """Per asker and replier: constraints, how many the clocks as they are break, the tightest bounds, and the bounds that all but a twentieth keep."""
    bad = (F.col("lo") > 0) | (F.col("hi") < 0)
    return constraints.groupBy("asker", "replier").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(bad, 1)).alias("n_broken"), F.max("lo").alias("lo"), F.min("hi").alias("hi"), F.percentile_approx("lo", 0.95, 1000).alias("lo_most"), F.percentile_approx("hi", 0.05, 1000).alias("hi_most"))


def differences(constraints: DataFrame, pairs: DataFrame, share: float, rounds: int = 12) -> DataFrame:
    """(asker, replier, n, d): seconds by which the replier's clock is to be moved against the asker's.

    0 for pairs that break at most the given share of their constraints. Else, if one difference fulfils all, or all but the twentieth furthest
    off on either side, the one nearest to 0 and up to a second inside; if none does, the minimum of the squared violations: each round
    averages the bounds that are broken, Newton's method for that sum.
    """

    def inside(lo: str, hi: str) -> Column:
        room = F.least(F.lit(1.0), F.coalesce((F.col(hi) - F.col(lo)) / 2, F.lit(1.0)))
        return F.when(F.coalesce(F.col(hi) >= F.col(lo), F.lit(True)), F.when(F.col(lo) > 0, F.col(lo) + room).when(F.col(hi) < 0, F.col(hi) - room).otherwise(0.0))

    off = F.col("n_broken") > share * F.col("n")
    p = cut(pairs.withColumn("d", F.when(~off, 0.0).otherwise(F.coalesce(inside("lo", "hi"), inside("lo_most", "hi_most")))))
    hard = p.where("d is null").select("asker", "replier", "n", F.lit(0.0).alias("d"))
    if hard.isEmpty():
        return p.select("asker", "replier", "n", "d")
    c = cut(constraints.join(hard.select("asker", "replier"), ["asker", "replier"], "left_semi"))
    for _ in range(rounds):
        v = c.join(hard, ["asker", "replier"])
        both = F.array(F.when(F.col("lo") > F.col("d"), F.col("lo")), F.when(F.col("hi") < F.col("d"), F.col("hi")))
        m = v.select("asker", "replier", F.explode(both).alias("bound")).groupBy("asker", "replier").agg(F.avg("bound").alias("m"))
        hard = cut(hard.join(m, ["asker", "replier"], "left").select("asker", "replier", "n", F.coalesce("m", "d").alias("d")))
    return p.where("d is not null").select("asker", "replier", "n", "d").unionByName(hard)


def solve_offsets(edges: list[tuple[str, str, float, float]]) -> dict[str, float]:
    """Offsets of senders from (asker, replier, weight, difference): least squares by conjugate gradients; in each connected group the sender with most constraints (then the smallest name of an asker) has offset 0."""
    names = sorted({x for e in edges for x in e[:2]})
    at = {x: i for i, x in enumerate(names)}
    i, j = (np.array([at[e[c]] for e in edges], np.int64) for c in (0, 1))
    w, d = (np.array([e[c] for e in edges], float) for c in (2, 3))
    group = np.arange(len(names))
    while True:  # labels of connected groups
        low = np.minimum(group[i], group[j])
        new = group.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        if (new == group).all():
            break
        group = new[new]
    sums = lambda x: np.bincount(j, x, len(names)) - np.bincount(i, x, len(names))
    apply = lambda o: sums(w * (o[j] - o[i]))
    o, r = np.zeros(len(names)), sums(w * d)
    p, rr = r.copy(), r @ r
    for _ in range(4 * len(names) + 20):
        if rr < 1e-18 * (1 + (w * d) @ (w * d)):
            break
        a = apply(p)
        step = rr / (p @ a)
        o, r = o + step * p, r - step * a
        old, rr = rr, r @ r
        p = r + (rr / old) * p
    total, asks = np.bincount(i, w, len(names)) + np.bincount(j, w, len(names)), np.bincount(i, w, len(names))
    fixed: dict[int, int] = {}
    for x in sorted(range(len(names)), key=lambda x: (-total[x], -asks[x], names[x])):
        fixed.setdefault(int(group[x]), x)
    return {n: float(o[x] - o[fixed[int(group[x])]]) for n, x in at.items()}


def clock_offsets(turns: DataFrame, share: float = 0.5, most_pairs: int = 1_000_000) -> dict[str, float]:
    """Seconds to add to the times of senders; senders that are not named need none. {} where no pair of clocks breaks more than the given share of its constraints.

    Pairs of senders are the only thing that the driver sees; more than most_pairs of them (for example a clock for each person) are an
    error: then senders must be put together, by their kind of client say.
    """
    constraints = reply_constraints(turns)
    pairs = cut(clock_pairs(constraints))
    if pairs.where(F.col("n_broken") > share * F.col("n")).isEmpty():
        return {}
    d = differences(constraints, pairs, share)
    if d.count() > most_pairs:
        raise ValueError(f"more than {most_pairs} pairs of senders")
    solved = solve_offsets([(r["asker"], r["replier"], float(r["n"]), float(r["d"])) for r in d.collect()])
    return {k: v for k, v in solved.items() if abs(v) > 1e-6}


def in_order(turns: DataFrame, offsets: dict[str, float]) -> DataFrame:
    """Adds at (corrected time) and rank (a question before a reply at equal times)."""
    rank = F.when(F.col("speaker") == "user", 0).when(F.col("speaker") == "unknown", 1).otherwise(2)
    d = turns.withColumn("rank", rank)
    if not offsets:
        return d.withColumn("at", F.col("created_at"))
    moved = turns.sparkSession.createDataFrame([(k, round(v * 1e6)) for k, v in sorted(offsets.items())], "__sender string, __move long")
    d = d.join(moved, F.col("sender") == F.col("__sender"), "left")
    return d.withColumn("at", F.timestamp_micros(F.unix_micros("created_at") + F.coalesce("__move", F.lit(0)))).drop("__sender", "__move")


def with_previous(turns: DataFrame, carry: list[str], offsets: dict[str, float]) -> DataFrame:
    """Turns (system and summary rows left out) with prev_<c> of the turn before in the same session, and prev_exists."""
    return previous_in_order(in_order(turns.where(F.col("speaker") != "none"), offsets), "session_id", "at", ["rank", "id"], carry)


def rejected_sessions(sessions: DataFrame, messages: DataFrame, offsets: dict[str, float] | None = None, sender: str | None = None) -> DataFrame:
    """(session_id, reason) of sessions to drop: empty, broken or missing_reply, the first that applies.

    sessions needs id, messages id, session_id, role, content, created_at; other columns are ignored. Session ids count once,
    null ids never; messages of sessions that are not listed are ignored; no messages at all make every session empty. Rows without a time come last.
    Where every reply directly follows a question, a question lacks its reply exactly if there are more questions than replies.
    """
    m = cut(messages_once(messages, False, sender))  # read several times below; no contents
    o = clock_offsets(m) if offsets is None else offsets
    p = with_previous(m, ["speaker"], o)
    bad = (F.col("speaker") == "unknown") | ((F.col("speaker") == "assistant") & ~F.coalesce(F.col("prev_speaker") == "user", F.lit(False)))
    per = p.groupBy(F.col("session_id").alias("__s")).agg(F.max("visible").alias("said"), F.max(bad).alias("broken"), F.count(F.when(F.col("speaker") == "user", 1)).alias("nu"), F.count(F.when(F.col("speaker") == "assistant", 1)).alias("na"))
    ids = sessions.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("session_id")).distinct()
    j = ids.join(per, F.col("session_id") == F.col("__s"), "left")
    reason = F.when(~F.coalesce("said", F.lit(False)), "empty").when(F.col("broken"), "broken").when(F.col("nu") > F.col("na"), "missing_reply")
    return j.select("session_id", reason.alias("reason")).where(F.col("reason").isNotNull())


def conversations(sessions: DataFrame, messages: DataFrame, sender: str | None = None) -> DataFrame:
    """Turns of kept sessions: (session_id, turn_no from 1, speaker, content, at), ordered within a session by turn_no."""
    m = messages_once(messages, True, sender)
    o = clock_offsets(cut(messages_once(messages, False, sender)))
    drop = rejected_sessions(sessions, messages, o, sender).select(F.col("session_id").alias("__s"))
    ids = sessions.where(F.col("id").isNotNull()).select(F.col("id").cast("string").alias("__i")).distinct()
    keep = m.where(F.col("speaker") != "none").join(ids, F.col("session_id") == F.col("__i"), "left_semi").join(drop, F.col("session_id") == F.col("__s"), "left_anti")
    n = number_in_order(in_order(keep, o), "session_id", "at", ["rank", "id"], "turn_no")
    return n.select("session_id", "turn_no", "speaker", "content", "at")
