import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from corvane.llm import conversations as C

T = dt.datetime(2024, 1, 1)
MSG = "id string, session_id string, role string, content string, created_at timestamp, speaker string, rank int, at string, __s string"


def msgs(spark, items):
    """items: (id, session, role, content, seconds); with columns whose names the operator uses itself."""
    return spark.createDataFrame([(i, s, r, c, None if t is None else T + dt.timedelta(seconds=t), "x", 1, "y", "z") for i, s, r, c, t in items], MSG)


def sess(spark, *ids):
    return spark.createDataFrame([(i, "r") for i in ids], "id string, reason string")


def brute(ids, items):
    out = {}
    names = {"user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "system": None, "summary": None}
    for s in set(ids) - {None}:
        rows = {x for x in items if x[1] == s}
        turns = []
        for i, _, r, c, t in rows:
            who = names.get((r or "?").strip().lower(), "unknown") if r is not None else "unknown"
            if who:
                turns.append((10**9 if t is None else t, {"user": 0, "unknown": 1, "assistant": 2}[who], i or "", who, bool((c or "").replace("​", "").strip())))
        turns.sort()
        who = [x[3] for x in turns]
        if not any(x[4] for x in turns):
            out[s] = "empty"
        elif "unknown" in who or any(w == "assistant" and (k == 0 or who[k - 1] != "user") for k, w in enumerate(who)):
            out[s] = "broken"
        elif any(w == "user" and who[k + 1 : k + 2] != ["assistant"] for k, w in enumerate(who)):
            out[s] = "missing_reply"
    return out


def test_like_brute_force(spark):
    random.seed(5)
    roles = ["user", " User", "human", "assistant", "AI ", "assistant", "user", "system", "summary", None, "bot"]
    items = [(f"m{i}", f"s{random.randint(0, 60)}", random.choice(roles[: 9 if i % 3 else 11]), random.choice(["hi", "hi", " ​", None]), random.choice([None, *range(12)]) if i % 9 == 0 else random.randint(0, 12)) for i in range(260)]
    items += items[:30]
    ids = [f"s{i}" for i in range(64)] + [None, "s1"]
    got = {r["session_id"]: r["reason"] for r in C.rejected_sessions(sess(spark, *ids), msgs(spark, items)).collect()}
    assert got == brute(ids, items)


def test_hot_session_in_parts(spark):
    items = [(f"a{i:05d}", "hot", "user" if i % 2 == 0 else "assistant", "x", i // 2) for i in range(400)]
    m = C.messages_once(msgs(spark, items), True)
    from corvane.operators.order import previous_in_order

    p = previous_in_order(C.in_order(m, {}), "session_id", "at", ["rank", "id"], ["speaker"], rows_a_part=40)
    assert p.where("speaker = 'assistant' and prev_speaker <> 'user'").count() == 0
    assert C.rejected_sessions(sess(spark, "hot"), msgs(spark, items)).count() == 0
    out = C.conversations(sess(spark, "hot"), msgs(spark, items)).orderBy("turn_no").collect()
    assert [r["turn_no"] for r in out] == list(range(1, 401)) and {r["speaker"] for r in out[::2]} == {"user"}


def shifted_sessions(shift, sessions=12, turns=4):
    """Sessions of three senders: people on one of two clients and an assistant; each clock is off by its own seconds."""
    out = []
    for s in range(sessions):
        client = "phone" if s % 2 else "desk"
        for k in range(turns):
            out.append((f"q{s}-{k}", f"s{s}", "user", f"q{k}", 1000 * s + 100 * k + shift[client], client))
            out.append((f"a{s}-{k}", f"s{s}", "assistant", f"a{k}", 1000 * s + 100 * k + 7 + s % 5 + shift["server"], "server"))
    random.Random(1).shuffle(out)
    return out


def sent(spark, items):
    return spark.createDataFrame([(i, s, r, c, T + dt.timedelta(seconds=t), d) for i, s, r, c, t, d in items], "id string, session_id string, role string, content string, created_at timestamp, device string")


@pytest.mark.parametrize("shift", [{"phone": 0, "desk": 0, "server": 0}, {"phone": 400, "desk": -900, "server": 60}, {"phone": 0, "desk": 0, "server": -30}])
def test_three_shifted_clocks(spark, shift):
    items = shifted_sessions(shift)
    m = sent(spark, items)
    ids = sess(spark, *{x[1] for x in items})
    off = C.clock_offsets(C.messages_once(m, False, "device"))
    assert (off == {}) == (len(set(shift.values())) == 1)
    rows = C.conversations(ids, m, "device").collect()
    for s in {x[1] for x in items}:
        got = [r["content"] for r in sorted((r for r in rows if r["session_id"] == s), key=lambda r: r["turn_no"])]
        assert got == [f"{w}{k}" for k in range(4) for w in "qa"]


def test_faults_of_single_sessions_move_no_clock(spark):
    items = shifted_sessions({"phone": 400, "desk": 400, "server": 400})
    wrong = {"s3", "s4"}
    items = [(i, s, r, c, t - 50 if s in wrong and r == "assistant" else t, d) for i, s, r, c, t, d in items]
    m, ids = sent(spark, items), sess(spark, *{x[1] for x in items})
    assert C.clock_offsets(C.messages_once(m, False, "device")) == {}
    assert {r["session_id"] for r in C.rejected_sessions(ids, m, sender="device").collect()} == wrong


def test_infeasible_constraints_are_rejected_after_correction(spark):
    """All clocks of servers are off; one session breaks its constraints under every offset."""
    items = [(i, s, r, c, t + (40 if (s, c) in (("s2", "q1"), ("s2", "q2")) else 0), d) for i, s, r, c, t, d in shifted_sessions({"phone": 0, "desk": 0, "server": -300}, 60)]
    items = [(i, s, r, c, t - 200 if (s, c) == ("s2", "a2") else t, d) for i, s, r, c, t, d in items]
    m, ids = sent(spark, items), sess(spark, *{x[1] for x in items})
    off = C.clock_offsets(C.messages_once(m, False, "device"))
    assert all(280 < off.get("server", 0) - off.get(x, 0) < 320 for x in ("phone", "desk"))
    assert {r["session_id"] for r in C.rejected_sessions(ids, m, sender="device").collect()} == {"s2"}


def test_offsets_over_the_graph_of_senders():
    got = C.solve_offsets([("a", "s", 10, 5.0), ("b", "s", 10, -3.0), ("a", "t", 1, 1.0), ("b", "t", 1, -7.0), ("x", "y", 2, 4.0)])
    assert got["s"] == 0 and abs(got["a"] + 5) < 1e-6 and abs(got["b"] - 3) < 1e-6 and abs(got["t"] + 4) < 1e-6 and abs(abs(got["x"] - got["y"]) - 4) < 1e-6


def test_hot_session_with_rows_without_a_time(spark, monkeypatch):
    from corvane.operators import order

    items = [(f"a{i:05d}", "hot", "user" if i % 2 == 0 else "assistant", "x", i // 2) for i in range(600)] + [("z0", "hot", "user", "x", None), ("z1", "hot", "assistant", "x", None)]
    sizes = []
    real = order._in_parts

    def small(df, key, by, rows):
        out = real(df, key, by, 50)
        sizes.append(max(r["count"] for r in out[0].groupBy(key, "__part").count().collect()))
        return out

    monkeypatch.setattr(order, "_in_parts", small)
    assert C.rejected_sessions(sess(spark, "hot"), msgs(spark, items)).count() == 0
    assert [r["turn_no"] for r in C.conversations(sess(spark, "hot"), msgs(spark, items)).orderBy("turn_no").collect()] == list(range(1, 603))
    assert max(sizes) < 250


@pytest.mark.parametrize("which", ["messages", "sessions"])
def test_empty_tables(spark, which):
    m, s = msgs(spark, [("1", "a", "user", "x", 1)]), sess(spark, "a")
    if which == "messages":
        assert [tuple(r) for r in C.rejected_sessions(s, m.limit(0)).collect()] == [("a", "empty")]
    else:
        assert C.rejected_sessions(s.limit(0), m).count() == 0
        assert C.conversations(s.limit(0), m).count() == 0


def test_null_session_and_ids(spark):
    m = msgs(spark, [(None, "a", "user", "q", 1), (None, "a", "assistant", "r", 2), ("3", None, "user", "q", 1)])
    assert C.rejected_sessions(sess(spark, "a"), m).count() == 0
    assert C.conversations(sess(spark, "a"), m).agg(F.count("*")).first()[0] == 2
