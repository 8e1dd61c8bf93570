"""Decision logs against a sequential replay."""

import random

import pytest
from pyspark.sql import functions as F

from scholargraph.operators import decisions


def replay(rows, names):
    """What each decision holds, does and why not, one after the other."""
    held, locked, barred, out = {}, {}, set(), {}
    for seq, op, m, author, actor in sorted(rows):
        target = names[seq] if op in ("CREATE", "SPLIT") else None if op == "UNLINK" else author
        had, reason, moves = held.get(m), None, False
        if op == "LOCK" or op == "UNLOCK":
            locked[author] = op == "LOCK"
        elif op == "NOT_SAME":
            barred.add((m, author))
        elif op == "ACCEPT":
            if had != author:
                reason = "LOCKED" if locked.get(author) else "NOT_SAME" if (m, author) in barred and actor != "MANUAL" else "HELD_LOCKED" if had and locked.get(had) else None
                moves = reason is None
        elif op == "CREATE":
            moves = had is None
        else:
            reason = "NOTHING_HELD" if op == "SPLIT" and had is None else "HELD_LOCKED" if had and locked.get(had) else None
            moves = reason is None and had is not None
        if moves:
            held[m] = target
        out[seq] = (had, reason, moves)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_against_replay(spark, seed):
    """Few authors, many locks, long logs of one mention: chains of decisions that hang on each other."""
    rnd = random.Random(seed)
    ops = ["ACCEPT"] * 6 + ["LOCK"] * 3 + ["UNLOCK"] * 2 + ["SPLIT", "UNLINK", "CREATE", "NOT_SAME"]
    rows = [(i, rnd.choice(ops), rnd.choice([1, 1, 1, 2, 3]), str(rnd.randrange(4)), rnd.choice(["AUTO", "MANUAL"])) for i in range(600)]
    log = spark.createDataFrame(rows, "seq long, op string, mention long, author string, actor string")
    names = {r.seq: r.n for r in log.select("seq", decisions.new_author().alias("n")).collect()}
    want = replay(rows, names)
    got = {r.seq: (r.held, r.reason, r.moves) for r in decisions.judged_log(log).collect()}
    assert got == want
    assert sum(r == "HELD_LOCKED" for _, r, _ in want.values()) > 20


def test_named_case(spark):
    """A mention is not moved off a locked author by linking, splitting or unlinking; after unlocking it is."""
    ops = [("ACCEPT", "a"), ("LOCK", "a"), ("ACCEPT", "b"), ("SPLIT", None), ("UNLINK", None), ("ACCEPT", "a"), ("UNLOCK", "a"), ("UNLINK", None), ("UNLINK", None)]
    log = spark.createDataFrame([(i, op, 1, a, "AUTO") for i, (op, a) in enumerate(ops)], "seq long, op string, mention long, author string, actor string")
    got = decisions.judged_log(log).orderBy("seq").collect()
    assert [r.reason for r in got] == [None, None, "HELD_LOCKED", "HELD_LOCKED", "HELD_LOCKED", None, None, None, None]
    assert [r.moves for r in got] == [True, False, False, False, False, False, False, True, False]
    assert [(r.author, r.status, r.until) for r in decisions.memberships(log).collect()] == [("a", "SUPERSEDED", 7)]


def test_empty(spark):
    assert decisions.judged_log(spark.createDataFrame([], "seq long, op string, mention long, author string, actor string")).filter(F.col("moves")).count() == 0


def test_both_ways_agree_and_few_locks_take_one_pass(spark, monkeypatch):
    rnd = random.Random(5)
    ops = ["ACCEPT"] * 6 + ["LOCK"] * 3 + ["UNLOCK"] * 2 + ["SPLIT", "UNLINK", "CREATE", "NOT_SAME"]
    rows = [(i, rnd.choice(ops), rnd.choice([1, 1, 2]), rnd.choice(["x", "y", "z"]), rnd.choice(["AUTO", "MANUAL", None])) for i in range(300)]
    log = spark.createDataFrame(rows, "seq long, op string, mention long, author string, actor string")
    in_rounds = decisions._in_rounds
    monkeypatch.setattr(decisions, "_in_rounds", None)  # not taken
    one_pass = sorted(decisions.judged_log(log).collect(), key=lambda r: r.seq)
    monkeypatch.setattr(decisions, "_in_rounds", in_rounds)
    monkeypatch.setattr(decisions, "LOCKS", 3)
    assert sorted(decisions.judged_log(log).collect(), key=lambda r: r.seq) == one_pass
