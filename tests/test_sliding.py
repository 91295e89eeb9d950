"""Windows that slide over sorted rows, against plain ones."""

import random

import numpy as np
import pytest

from weftcast.operators import temporal
from weftcast.operators.sliding import Ordered


@pytest.mark.parametrize("load", [1, 3, 512])
def test_ordered_multiset(load):
    rnd, kept, plain = random.Random(load), Ordered(load), []
    for _ in range(4000):
        if plain and rnd.random() < 0.48:
            v = rnd.choice(plain)
            plain.remove(v)
            kept.remove(v)
        else:
            v = float(rnd.randint(-20, 20))
            plain.append(v)
            kept.add(v)
        if plain and rnd.random() < 0.2:
            order = sorted(plain)
            assert [kept[k] for k in (0, len(order) // 2, len(order) - 1)] == [order[k] for k in (0, len(order) // 2, len(order) - 1)]
            assert kept.quantile(0.3) == pytest.approx(np.quantile(order, 0.3))
    assert kept.size == len(plain) and Ordered().quantile(0.5) is None
    with pytest.raises(IndexError):
        Ordered()[0]


@pytest.mark.parametrize("batch", ["10000", "3"])
def test_medians_with_ties_nulls_and_extra_columns(spark, batch):
    """Rows of one time share a frame, however they are cut into batches; nulls and NaN count as rows alone."""
    rnd = random.Random(5)
    rows = [(k, rnd.choice("ab"), rnd.randint(0, 60), rnd.choice([None, float("nan"), *map(float, range(9))]), "x") for k in range(300)] + [(k, None, 5, 1.0, "y") for k in range(300, 303)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        df = spark.createDataFrame(rows, "id int, k string, t long, v double, __own2 string")
        got = {r["id"]: r for r in temporal.rolling_median(df, "v", ["k"], "t", 7, "med", "n", slices=2).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(got) == len(rows)
    for i, k, t, _, extra in rows:
        frame = [v for _, c, u, v, _ in rows if c == k and t - 7 < u <= t]
        some = [v for v in frame if v is not None and v == v]
        assert got[i]["n"] == len(frame) and got[i]["__own2"] == extra
        assert got[i]["med"] == (pytest.approx(np.median(some)) if some else None)


def test_no_row_carries_its_frame(spark):
    df = spark.createDataFrame([(1, 2, 3.0)], "k int, t long, v double")
    plan = temporal.rolling_median(df, "v", ["k"], "t", 7, "med", "n")._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan and "Window" not in plan
    assert temporal.rolling_median(df.limit(0), "v", ["k"], "t", 7, "med", "n").count() == 0
