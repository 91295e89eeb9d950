"""Experts, radii and bettors that learn from a stream and end where the batch ends.

A case is learned once its truth is known (``at``), in the order of ``at`` and ``id``. Until the watermark of arrivals has passed
that time it waits in a list, under a timer. What has been learned is kept by ``id``: a case that comes again as it was
changes nothing; one that comes late or corrected changes the history, whose digest is then another, so the key is
replayed from the start. A state of another ``identity`` (of configuration and code) is replayed too. The state is in
Spark's state store (RocksDB), so a query that is started again goes on where it was.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..operators.inference import Wealth
from ..operators.sequential import Experts, Radii

OUT = "key string, n long, replays long, state string"
_CASE = StructType([StructField("at", LongType()), StructField("id", StringType()), StructField("value", StringType())])


def uses_rocksdb(spark: SparkSession) -> None:
    """The state store that these processors need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ExpertLearner:
    """Weights of ``sources`` over cases {"x": {source: value}, "y": truth}, with a rate for each expert."""

    def __init__(self, sources: list[str]):
        self.sources = list(sources)

    def begun(self, state: dict | None):
        group = Experts(len(self.sources), 1, second_order=True)
        if state:
            group.resume(state)
        return group

    def see(self, group, value: dict) -> None:
        row = np.array([math.nan if value["x"].get(s) is None else float(value["x"][s]) for s in self.sources])
        group.see(row, math.nan if value["y"] is None else float(value["y"]))

    def state(self, group) -> dict:
        return group.state()


class RadiiLearner:
    """Interval radii over absolute errors."""

    def begun(self, state: dict | None):
        radii = Radii()
        if state:
            radii.radius, radii.missed, radii.n = np.array(state["radius"]), np.array(state["missed"]), state["n"]
            radii.recent.extend(state["recent"])
        return radii

    def see(self, radii, value: float) -> None:
        radii.see(float(value))

    def state(self, radii) -> dict:
        return {"radius": radii.radius.tolist(), "missed": radii.missed.tolist(), "n": radii.n, "recent": list(radii.recent), "now": radii.now().tolist()}


class WealthLearner:
    """The logarithm of a bettor's wealth over loss differences."""

    def begun(self, state: dict | None):
        return Wealth(state)

    def see(self, bettor, value: float) -> None:
        bettor.see(float(value))

    def state(self, bettor) -> dict:
        return bettor.state()


def chained(digest: str, at: int, id_: str, value: str) -> str:
    """The digest of a history and one more case."""
    return hashlib.sha256(json.dumps([digest, at, id_, value]).encode()).hexdigest()


class Learning(StatefulProcessor):
    """Columns of the input: key, id, at (microseconds), value (JSON), and the arrival time that has the watermark."""

    def __init__(self, learner, identity: str):
        self.learner, self.identity = learner, identity

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        text = lambda *names: StructType([StructField(n, StringType()) for n in names])
        self.known = handle.getValueState("known", text("identity", "digest", "cursor", "n", "replays", "state"))
        self.waiting = handle.getListState("waiting", _CASE)
        self.history = handle.getMapState("history", text("id"), StructType(_CASE.fields[0:1] + _CASE.fields[2:3]))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        cursor, changed, wait = self._cursor(), False, {}
        for pdf in rows:
            for id_, at, value in zip(pdf["id"], pdf["at"], pdf["value"]):
                id_, at, value = str(id_), int(at), str(value)
                if self.history.containsKey((id_,)):
                    old = self.history.getValue((id_,))
                    if (int(old[0]), old[1]) == (at, value):
                        continue
                    self.history.removeKey((id_,))
                    changed = True
                if (at, id_) <= cursor:
                    self.history.updateValue((id_,), (at, value))
                    changed = True
                else:
                    wait[id_] = (at, id_, value)
        if wait:
            kept = [tuple(c) for c in self.waiting.get() if c[1] not in wait]
            self.waiting.put([*kept, *wait.values()])
            for at, _, _ in wait.values():
                self.handle.registerTimer(-(-at // 1000))
        if changed or (self.known.exists() and self.known.get()[0] != self.identity):
            yield self._told(key, *self._replayed())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = expiredTimerInfo.getExpiryTimeInMs() * 1000
        every = [tuple(c) for c in self.waiting.get()]
        ready = sorted((int(at), id_, value) for at, id_, value in every if at <= now)
        if not ready:
            return
        rest = [c for c in every if c[0] > now]
        self.waiting.put(rest) if rest else self.waiting.clear()
        same = self.known.exists() and self.known.get()[0] == self.identity
        if self.known.exists() and not same:
            self._replayed()
        _, digest, _, n, replays, state = self.known.get() if self.known.exists() else (self.identity, "", "", "0", "0", "null")
        learned, n = self.learner.begun(json.loads(state)), int(n)
        for at, id_, value in ready:
            self.learner.see(learned, json.loads(value))
            self.history.updateValue((id_,), (at, value))
            digest, n = chained(digest, at, id_, value), n + 1
        yield self._told(key, learned, digest, ready[-1][:2], n, int(replays))

    def close(self) -> None:
        """Nothing is held outside the state store."""

    def _cursor(self) -> tuple[int, str]:
        if not self.known.exists():
            return -(1 << 62), ""
        at, _, id_ = self.known.get()[2].partition(" ")
        return int(at), id_

    def _replayed(self):
        """All of the history, in order, from the start; as the state now is."""
        learned, digest, n, last = self.learner.begun(None), "", 0, (-(1 << 62), "")
        for at, id_, value in sorted((int(v[0]), k[0], v[1]) for k, v in self.history.iterator()):
            self.learner.see(learned, json.loads(value))
            digest, n, last = chained(digest, at, id_, value), n + 1, (at, id_)
        replays = int(self.known.get()[4]) + 1 if self.known.exists() else 1
        self._keep(learned, digest, max(last, self._cursor()), n, replays)
        return learned, digest, max(last, self._cursor()), n, replays

    def _keep(self, learned, digest, cursor, n, replays) -> str:
        state = json.dumps(self.learner.state(learned))
        self.known.update((self.identity, digest, f"{cursor[0]} {cursor[1]}", str(n), str(replays), state))
        return state

    def _told(self, key, learned, digest, cursor, n, replays) -> pd.DataFrame:
        return pd.DataFrame({"key": [str(key[0])], "n": [n], "replays": [replays], "state": [self._keep(learned, digest, cursor, n, replays)]})


def learned(stream: DataFrame, learner, identity: str = "1", key: str = "key", arrived: str = "arrived", late: str = "0 seconds") -> DataFrame:
    """key, n (cases learned), replays and state (JSON) whenever a key's state changes. stream: ``key``, id, at (a timestamp), value (JSON text) and ``arrived``, a timestamp that never lies far behind what has arrived before."""
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col("id").cast("string").alias("id"), F.unix_micros("at").alias("at"), "value", F.col(arrived).alias("arrived"))
    return rows.withWatermark("arrived", late).groupBy("key").transformWithStateInPandas(Learning(learner, identity), OUT, "Update", "eventTime")
