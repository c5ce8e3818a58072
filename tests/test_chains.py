"""Replay by links against a plain replay, with a thread that has most of all operations."""

import datetime
import random

import pytest

from tokenfold.operators.ordered import dealt, running
from tokenfold.sources import chains
from tokenfold.sources.history import replay
from pyspark.sql import functions as F

SCHEMA = "thread_id string, seq long, op string, expected_version long, payloads array<string>, ts timestamp, place int"
START = datetime.datetime(2024, 1, 1)


def _plain(ops: list, flavour: str, ttl: int) -> dict:
    out = {}
    for thread in {o[0] for o in ops}:
        version, messages, written, clock, accepted, n, marks = 0, [], None, None, 0, 0, []
        for _, seq, op, expected, payloads, ts, _ in sorted((o for o in ops if o[0] == thread), key=lambda o: (o[1], o[2], o[3], o[4] or [])):
            payloads, n = payloads or [], n + 1
            clock = ts if clock is None else max(clock, ts)
            if ttl and written is not None and clock >= written + datetime.timedelta(seconds=ttl):
                version, messages, written = 0, [], None
            if op == "append" and not payloads:
                accepted += 1
                marks.append(seq)
            elif expected == version:
                messages = messages + payloads if op == "append" else payloads if op == "save" else []
                version = 0 if flavour == "reset" and not messages and op != "append" else version + 1
                written, accepted = clock, accepted + 1
                marks.append(seq)
        out[thread] = (version, messages, accepted, n, marks)
    return out


def _ops(count: int, seed: int, follow: float) -> list:
    """Operations of which a share ``follow`` expects the version at hand; thread ``hot`` has two thirds."""
    chance, at, rows, clock = random.Random(seed), {}, [], 0
    for seq in range(count):
        thread = "hot" if chance.random() < 0.66 else f"t{chance.randrange(6)}"
        op = chance.choice(["append", "append", "append", "save", "clear"])
        payloads = chance.choice([None, ["ignored"]]) if op == "clear" else [f"m{seq}.{k}" for k in range(chance.choice([0, 1, 1, 2]))]
        expected = at.get(thread, 0) if chance.random() < follow else chance.randrange(0, 6)
        if expected == at.get(thread, 0) and (op != "append" or payloads):
            at[thread] = at.get(thread, 0) + 1
        clock += chance.choice([0, 1, 3, 40])
        rows.append((thread, seq, op, expected, payloads, START + datetime.timedelta(seconds=clock + chance.choice([0, 0, -5])), 7))
    return rows


@pytest.mark.parametrize("flavour, ttl, follow, folded", [("monotonic", 0, 0.8, 0), ("monotonic", 0, 0.2, 50), ("reset", 0, 0.5, 0), ("monotonic", 100, 0.7, 0), ("reset", 60, 0.4, 0), ("reset", 60, 0.4, 1000)])
def test_links_equal_plain_replay(spark, flavour, ttl, follow, folded):
    ops = _ops(400, len(flavour) + ttl, follow)
    wanted = _plain(ops, flavour, ttl)
    judged = chains.outcomes(spark.createDataFrame(ops, SCHEMA).repartition(5), flavour, ttl, folded).cache()
    got = {r.thread_id: (r.version, r.n_accepted, r.n_ops, r.n_messages) for r in chains.heads(judged).collect()}
    assert got == {t: (v, a, n, len(m)) for t, (v, m, a, n, _) in wanted.items()}
    marks = {}
    for r in judged.filter("accepted").orderBy("place").collect():
        marks.setdefault(r.thread_id, []).append(r.seq)
    assert marks == {t: x[4] for t, x in wanted.items() if x[4]}
    held = {}
    for r in sorted(chains.histories(judged).collect()):
        assert r.version == wanted[r.thread_id][0] and r.pos == len(held.setdefault(r.thread_id, []))
        held[r.thread_id].append(r.payload)
    assert held == {t: x[1] for t, x in wanted.items() if x[1]}
    judged.unpersist()


def test_links_equal_the_fold_of_one_row_a_thread(spark):
    ops = [(*o[:5], None, 7) for o in _ops(300, 3, 0.6)]
    frame = spark.createDataFrame(ops, SCHEMA)
    rows = chains.heads(chains.outcomes(frame, folded=0)).collect()
    wanted = {r.thread_id: (r.version, len(r.messages), sum(o.accepted for o in r.outcomes)) for r in replay(frame).collect()}
    assert {r.thread_id: (r.version, r.n_messages, r.n_accepted) for r in rows} == wanted


def test_edges_of_replay(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert chains.outcomes(empty).count() == chains.histories(chains.outcomes(empty)).count() == 0
    one = [("t", 1, "append", 0, ["a"], None, 1)] * 3 + [(None, 1, "save", 0, None, None, 1)]
    for folded in (0, 1000):
        judged = chains.outcomes(spark.createDataFrame(one, SCHEMA), folded=folded)
        assert sorted(map(str, ((r.thread_id, r.version, r.n_messages, r.n_accepted) for r in chains.heads(judged).filter("thread_id IS NOT NULL").collect()))) == ["('t', 1, 1, 1)"]
    for bad in ({"flavour": "other"}, {"ttl_seconds": -1}):
        with pytest.raises(ValueError):
            chains.outcomes(empty, **bad)


def test_running_values_span_parts(spark):
    chance = random.Random(2)
    rows = [("hot" if chance.random() < 0.7 else f"g{chance.randrange(5)}", k, chance.choice([None, chance.randrange(50)])) for k in range(500)]
    held = dealt(spark.createDataFrame(rows, "g string, k long, v long"), ["g"], ["k"])
    assert held.filter("g = 'hot'").select("part").distinct().count() > 1
    made = held
    for kind in ("sum", "max", "last"):
        made = running(made, ["g"], kind, kind, F.col("v"))
        made = running(made, ["g"], f"{kind}_before", kind, F.col("v"), inclusive=False)
    for r in made.collect():
        upto = [v for g, k, v in sorted(rows, key=lambda x: x[1]) if g == r.g and k <= r.k and v is not None]
        before = [v for g, k, v in sorted(rows, key=lambda x: x[1]) if g == r.g and k < r.k and v is not None]
        assert (r.sum, r.max, r.last) == (sum(upto), max(upto, default=None), upto[-1] if upto else None)
        assert (r.sum_before, r.max_before, r.last_before) == (sum(before), max(before, default=None), before[-1] if before else None)
