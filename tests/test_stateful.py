"""Learners on streams: in batches, out of order, corrected and restarted, they end where the batch ends."""

import json
import math

import numpy as np
import pandas as pd
import pytest

from weftcast.operators.inference import Wealth
from weftcast.operators.sequential import Experts, Radii
from weftcast.streaming import stateful

SOURCES = ["a", "b", "c"]


def cases(seed, n=60):
    """(key, id, second at which the truth is known, value)."""
    rng, out = np.random.default_rng(seed), []
    for k in range(n):
        y = float(rng.normal())
        x = {s: None if rng.random() < 0.1 else y + float(rng.normal(0.2 * j, 1)) for j, s in enumerate(SOURCES)}
        out.append(("ab"[k % 2], f"c{k:03d}", 10 + k // 3, {"x": x, "y": y}))
    return out


KINDS = {
    "experts": (stateful.ExpertLearner(SOURCES), lambda v: v, lambda state: state["w"]),
    "radii": (stateful.RadiiLearner(), lambda v: abs(v["y"]), lambda state: state["now"]),
    "wealth": (stateful.WealthLearner(), lambda v: v["y"] + 0.3, lambda state: state["log"]),
}


def batch(kind, rows):
    """What the batch learns from all cases in order."""
    out = {}
    for key in "ab":
        own = [v for k, _, at, v in sorted(rows, key=lambda r: (r[2], r[1])) if k == key]
        values = [KINDS[kind][1](v) for v in own]
        if kind == "experts":
            group = Experts(3, 1, True)
            for v in values:
                group.see(np.array([math.nan if v["x"][s] is None else v["x"][s] for s in SOURCES]), v["y"])
            out[key] = group.w.tolist()
        elif kind == "radii":
            radii = Radii()
            for v in values:
                radii.see(v)
            out[key] = radii.now().tolist()
        else:
            bettor = Wealth()
            for v in values:
                bettor.see(v)
            out[key] = bettor.log
    return out


@pytest.fixture
def stream(spark, tmp_path):
    """Puts rows into a source, and runs a query over it that can be stopped and started again."""
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    stateful.uses_rocksdb(spark)
    source, held, told = tmp_path / "in", {"k": 0}, {}
    source.mkdir()

    def put(arrived, rows, of):
        frame = pd.DataFrame([(k, i, pd.Timestamp(at, unit="s"), json.dumps(of(v)), pd.Timestamp(arrived, unit="s")) for k, i, at, v in rows], columns=["key", "id", "at", "value", "arrived"])
        frame.to_parquet(source / f"{held['k']}.parquet", coerce_timestamps="us")
        held["k"] += 1

    def started(learner, identity="1"):
        df = spark.readStream.schema("key string, id string, at timestamp, value string, arrived timestamp").parquet(str(source))
        tell = lambda out, _: told.update({r["key"]: r for r in out.collect() if r["key"] in "ab"})
        return stateful.learned(df, learner, identity).writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "c")).foreachBatch(tell).start()

    yield put, started, told
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)


def clock(second):
    """A row of another key, whose arrival moves the watermark."""
    return [("clock", f"t{second}", second + 10_000, {"x": {s: 0.0 for s in SOURCES}, "y": 0.0})]


@pytest.mark.parametrize("kind", list(KINDS))
def test_two_batches_a_restart_and_corrections(stream, kind):
    put, started, told = stream
    learner, of, told_as = KINDS[kind]
    rows = cases(3)
    early, later = rows[:30], rows[30:]
    late = early.pop(7)  # a case that comes after others of its time have been learned
    query = started(learner)
    put(15, [*reversed(early), early[0]], of)
    query.processAllAvailable()
    put(25, clock(25), of)
    query.processAllAvailable()
    query.processAllAvailable()
    want = batch(kind, early)
    for key in "ab":
        assert told[key]["replays"] == 0 and told_as(json.loads(told[key]["state"])) == pytest.approx(want[key])
    query.stop()
    fixed = (*early[2][:3], {"x": {s: 0.5 for s in SOURCES}, "y": 2.0})
    put(26, [*later, late, fixed, early[4]], of)  # the last one as it was
    query = started(learner)
    query.processAllAvailable()
    put(60, clock(60), of)
    query.processAllAvailable()
    put(61, clock(61), of)
    query.processAllAvailable()
    query.stop()
    final = [fixed if r[1] == fixed[1] else r for r in rows]
    want = batch(kind, final)
    for key in "ab":
        assert told[key]["n"] == 30
        assert told_as(json.loads(told[key]["state"])) == pytest.approx(want[key])
    assert sum(r["replays"] for r in told.values()) >= 1


def test_truths_wait_for_their_time_and_another_identity_replays(stream):
    put, started, told = stream
    learner, of, told_as = KINDS["wealth"]
    rows = cases(4, 20)
    query = started(learner)
    put(9, rows, of)
    query.processAllAvailable()
    assert not told  # nothing is known yet
    put(13, clock(13), of)
    query.processAllAvailable()
    put(13, clock(14), of)
    query.processAllAvailable()
    assert sum(r["n"] for r in told.values()) == sum(1 for r in rows if r[2] <= 13) == 12
    query.stop()
    query = started(learner, "2")
    put(40, clock(40), of)
    query.processAllAvailable()
    put(41, clock(41), of)
    query.processAllAvailable()
    query.stop()
    assert {k: r["n"] for k, r in told.items()} == {"a": 10, "b": 10} and all(r["replays"] == 1 for r in told.values())
    assert {k: told_as(json.loads(r["state"])) for k, r in told.items()} == pytest.approx(batch("wealth", rows))
