"""Fits of all folds of a rolling-origin backtest, out of sums over steps.

A row is known to a fold, and to all later ones, from one origin on. So a fit that is made of sums is
aggregated once by that first fold and summed up over the folds: each row is read once, however
many folds there are. What isn't made of sums gets by on one pass too:

* absolute errors after a correction that differs by fold are summed by tasks that hold the few corrections;
* medians: rows are sorted over the cluster once, and a fold's median is found by counts of slices of that order;
* recency-weighted sums over slices of time meet by a rule that needs their sizes alone.

Tables of fits have a row a fold, source and bucket or so. They are checked to be small before they go to
tasks; larger ones are written and joined as tables.
"""

from __future__ import annotations

from functools import cached_property

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import trimmed_mean
from ..sources.scratch import dealt, settled
from .methods import CELL, PRIOR

#: Rows of a fit that may go to the driver and to all tasks.
SMALL = 500_000


def kept(df: DataFrame) -> DataFrame:
    """A table that is computed once: at most SMALL rows by the driver, more in a file."""
    got = df.limit(SMALL + 1).toArrow()
    return df.sparkSession.createDataFrame(got, df.schema) if got.num_rows <= SMALL else settled(df, "fits")


def small(df: DataFrame) -> pd.DataFrame:
    """A table for the tasks' use; over SMALL rows is an error."""
    got = df.limit(SMALL + 1).toPandas()
    if len(got) > SMALL:
        raise ValueError(f"a fit of over {SMALL} rows can't go to every task")
    return got


class Folds:
    """Rows (issue, valid, lead, bucket, source, x, y) split by equally spaced origins: fold k trains on rows valid ``delay`` before its origin at the latest, and tests those issued within a step behind it.

    ``train``: rows with ``since``, the first fold that knows them. ``test``: rows with ``fold``. Rows without a truth are in neither.
    """

    def __init__(self, rows: DataFrame, origins: list[int], step: int, delay: int = 2):
        self.count = len(origins)
        first = origins[0] if origins else 0
        self.rows = some = rows.where("y is not null") if origins else rows.limit(0)
        behind = lambda v, d: F.floor((F.col(v) + d - first + step - 1) / F.lit(step)).cast("int")
        self.train = some.withColumn("since", F.greatest(F.lit(0), behind("valid", delay))).where(F.col("since") < self.count)
        self.test = some.withColumn("fold", behind("issue", 0) - 1).where((F.col("fold") >= 0) & (F.col("fold") < self.count))

    @cached_property
    def shape(self) -> DataFrame:
        """The sources and buckets there are, with the means of x and y."""
        return kept(self.rows.groupBy("source", "bucket").agg(F.avg("x").alias("mx"), F.coalesce(F.avg("y"), F.lit(0.0)).alias("my")))

    @cached_property
    def buckets(self) -> list[str]:
        return sorted({r["bucket"] for r in self.shape.collect()})

    def summed(self, steps: DataFrame, by: list[str]) -> DataFrame:
        """``steps`` holds sums by ``by``, since and perhaps more; the sums of all rows that each fold knows, for folds that know any."""
        names = [c for c in steps.columns if c not in (*by, "since") and dict(steps.dtypes)[c] != "string"]
        one = steps.groupBy(*by, "since").agg(*[F.sum(c).alias(c) for c in names])
        order = Window.partitionBy(*by).orderBy("since")
        upto = [F.sum(c).over(order.rowsBetween(Window.unboundedPreceding, 0)).alias(c) for c in names]
        next_ = F.coalesce(F.lead("since").over(order), F.lit(self.count))
        cut = one.select(*by, "since", *upto, next_.alias("until"))
        return cut.select(*by, *names, F.explode(F.sequence("since", F.col("until") - 1)).alias("fold"))

    @cached_property
    def steps(self) -> DataFrame:
        """Sums by source, bucket and since; x and y less about the source's mean, so that spreads keep their digits."""
        means = self.shape.groupBy("source").agg(F.avg("mx").alias("mx"), F.avg("my").alias("my"))
        rows = self.train.join(means, "source").withColumn("u", F.col("x") - F.col("mx")).withColumn("v", F.col("y") - F.col("my"))
        e = F.col("x") - F.col("y")
        return kept(rows.groupBy("source", "bucket", "since").agg(F.count("*").alias("n"), F.sum(e).alias("e"), F.sum(F.abs(e)).alias("a"), F.sum(e * e).alias("ee"), F.sum("u").alias("u"), F.sum("v").alias("v"), F.sum(F.col("u") * F.col("v")).alias("uv"), F.sum(F.col("u") * F.col("u")).alias("uu"), F.sum("mx").alias("mx"), F.sum("my").alias("my")))

    @cached_property
    def levels(self) -> DataFrame:
        """The sums of every fold, source and bucket (null where the bucket has none there), and those of the source as g_*."""
        local = self.summed(self.steps, ["source", "bucket"])
        whole = self.summed(self.steps.drop("bucket"), ["source"])
        whole = whole.select("fold", "source", *[F.col(c).alias(f"g_{c}") for c in whole.columns if c not in ("fold", "source")])
        grid = whole.withColumn("bucket", F.explode(F.array(*[F.lit(b) for b in self.buckets])))
        return grid.join(local, ["fold", "source", "bucket"], "left")  # out of rows at hand

    @cached_property
    def fits(self) -> DataFrame:
        """bias, slope, intercept and mae of every fold, source and bucket; see the methods they belong to."""

        def line(g: str = "") -> tuple[Column, Column]:
            n, u, v, mx, my = (F.col(f"{g}{c}") for c in ("n", "u", "v", "mx", "my"))
            spread = F.col(f"{g}uu") - u * u / n
            slope = F.try_divide(F.col(f"{g}uv") - u * v / n, spread)
            ok = (spread >= 1e-9) & (F.abs(slope) <= 5)
            return F.when(n > 0, F.when(ok, slope).otherwise(1.0)), F.when(n > 0, F.when(ok, (v + my) / n - slope * (u + mx) / n).otherwise(0.0))

        share = F.coalesce(F.col("n") / (F.col("n") + PRIOR), F.lit(0.0))
        drawn = lambda own, all_: share * F.coalesce(own, all_) + (1 - share) * all_
        out = self.levels.withColumn("bias", drawn(-F.col("e") / F.col("n"), -F.col("g_e") / F.col("g_n")))
        (s, i), (gs, gi) = line(), line("g_")
        out = out.withColumn("slope", drawn(s, gs)).withColumn("intercept", drawn(i, gi))
        out = out.withColumn("mae", F.coalesce(F.when(F.col("n") >= 24, F.col("a") / F.col("n")), F.col("g_a") / F.col("g_n")))
        return kept(out.select("fold", "source", "bucket", "n", "e", "ee", "bias", "slope", "intercept", "mae"))

    @cached_property
    def mse_weights(self) -> DataFrame:
        """w of every fold, source and bucket: weights by squared errors after the bias."""
        losses = self.fits.withColumn("loss", F.col("ee") + 2 * F.col("bias") * F.col("e") + F.col("n") * F.col("bias") * F.col("bias"))
        return kept(self.weighted(losses, "loss", "w").select("fold", "source", "bucket", "w"))

    @cached_property
    def cells(self) -> DataFrame:
        """Of every fold and bucket: cells, the number of distinct cells, and cy, the sum of their truths."""
        one = self.train.select("issue", "valid", "bucket", "since", "y").distinct()
        return kept(self.summed(one.groupBy("bucket", "since").agg(F.count("*").alias("cells"), F.sum("y").alias("cy")), ["bucket"]))

    def weighted(self, losses: DataFrame, loss: str, name: str) -> DataFrame:
        """Adds 1 / mean loss of a source in a bucket, as a share of the largest, drawn to that over all buckets; ``loss`` is a sum over n rows. A source of fewer than 12 rows counts as the worst, and if all are thin all count alike."""

        def inverse(rows: DataFrame, by: list[str]) -> DataFrame:
            w = Window.partitionBy(*by)
            own = F.when(F.col("n") >= 12, F.col(loss) / F.col("n"))
            raw = 1 / F.greatest(F.coalesce(own, F.max(own).over(w), F.lit(1.0)), F.lit(1e-6))
            return rows.withColumn("raw", raw).withColumn("raw", F.col("raw") / F.max("raw").over(w))

        local = inverse(losses.where("n > 0"), ["fold", "bucket"]).select("fold", "source", "bucket", F.col("raw").alias("l"))
        whole = inverse(losses.groupBy("fold", "source").agg(F.sum("n").alias("n"), F.sum(loss).alias(loss)), ["fold"]).select("fold", "source", F.col("raw").alias("g"))
        share = F.coalesce(F.col("cells") / (F.col("cells") + PRIOR), F.lit(0.0))
        out = losses.join(whole, ["fold", "source"]).join(local, ["fold", "source", "bucket"], "left").join(self.cells, ["fold", "bucket"], "left")
        return out.withColumn(name, share * F.coalesce("l", "g") + (1 - share) * F.col("g")).drop("l", "g", "cells", "cy")

    def absolute(self, rows: DataFrame, keys: list[str], shifts: pd.DataFrame, by: list[str]) -> DataFrame:
        """Sums of |x + shift - y| over the rows that each fold knows, by ``by`` and fold. shifts: ``keys``, fold and shift; none is 0."""
        table = {k: g.set_index("fold")["shift"].reindex(range(self.count)).fillna(0.0).to_numpy() for k, g in shifts.groupby(keys)}
        count, at = self.count, [keys.index(b) for b in by]

        def run(batches):
            total: dict[tuple, np.ndarray] = {}
            for batch in batches:
                pdf = batch.to_pandas()
                for key, g in pdf.groupby(keys):
                    e, since = (g["x"] - g["y"]).to_numpy(), g["since"].to_numpy()
                    shift, out = table.get(key), total.setdefault(tuple(key[k] for k in at), np.zeros(count))
                    for a in range(0, len(e), 4096):
                        off = np.abs(e[a : a + 4096, None] + (0.0 if shift is None else shift[None, :]))
                        out += (np.broadcast_to(off, (off.shape[0], count)) * (since[a : a + 4096, None] <= np.arange(count))).sum(axis=0)
            if total:
                yield pa.RecordBatch.from_pandas(pd.DataFrame([(*k, v.tolist()) for k, v in total.items()], columns=[*by, "sums"]), preserve_index=False)

        kind = {c: t for c, t in rows.dtypes}
        parts = rows.select(*keys, "since", "x", "y").mapInArrow(run, ", ".join([*(f"{b} {kind[b]}" for b in by), "sums array<double>"]))
        return parts.select(*by, F.posexplode("sums").alias("fold", "off")).groupBy(*by, "fold").agg(F.sum("off").alias("off"))

    @cached_property
    def mae_weights(self) -> DataFrame:
        """w1 of every fold, source and bucket: weights by absolute errors after the bias."""
        fits = self.fits
        shifts = small(fits.select("fold", "source", "bucket", F.col("bias").alias("shift")))
        off = self.absolute(self.train, ["source", "bucket"], shifts, ["source", "bucket"])
        losses = fits.select("fold", "source", "bucket", "n").join(off, ["fold", "source", "bucket"], "left")
        return kept(self.weighted(losses, "off", "w1").select("fold", "source", "bucket", "w1"))

    @cached_property
    def medians(self) -> DataFrame:
        """median of every fold, source and bucket: of y - x in the bucket, drawn to that of the source."""
        parts = max(int(self.train.sparkSession.conf.get("spark.sql.shuffle.partitions")), 1)
        rows = self.train.select("source", "bucket", "since", (F.col("y") - F.col("x")).alias("d"))
        ordered = rows.repartitionByRange(parts, "source", "d", "bucket", "since").sortWithinPartitions("source", "d", "bucket", "since")
        # Written, as places count in it; sources come one after the other, and slices of the order keep theirs by their least value.
        table = settled(ordered.withColumn("slice", F.spark_partition_id()), "by-difference")
        counts = table.groupBy("slice", "source", "bucket", "since").agg(F.count("*").alias("n"))
        local = self.summed(counts, ["slice", "source", "bucket"])
        both = local.unionByName(local.groupBy("slice", "source", "fold").agg(F.sum("n").alias("n")).withColumn("bucket", F.lit(None).cast("string")))
        key = Window.partitionBy("source", "bucket", "fold")
        before = F.sum("n").over(key.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1))
        placed = both.withColumn("total", F.sum("n").over(key)).withColumn("before", F.coalesce(before, F.lit(0)))
        middle = placed.withColumn("k", F.explode(F.array(F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)))).withColumn("k", F.col("k") - F.col("before"))
        wanted = small(middle.where("k >= 0 and k < n").select("slice", "source", "bucket", "fold", "k"))
        by_slice = {s: g for s, g in wanted.groupby("slice")}

        def pick(pdf: pd.DataFrame) -> pd.DataFrame:
            own = by_slice.get(pdf["slice"].iloc[0])
            out = []
            for (source, bucket), g in [] if own is None else own.groupby(["source", "bucket"], dropna=False):
                mine = pdf[(pdf["source"] == source) & (True if pd.isna(bucket) else pdf["bucket"] == bucket)].sort_values("d")
                d, since = mine["d"].to_numpy(), mine["since"].to_numpy()
                out += [(source, None if pd.isna(bucket) else bucket, int(f), float(d[since <= f][k])) for f, k in zip(g["fold"], g["k"])]
            return pd.DataFrame(out, columns=["source", "bucket", "fold", "d"])

        found = dealt(table, "slice").groupBy("slice").applyInPandas(pick, "source string, bucket string, fold int, d double").groupBy("source", "bucket", "fold").agg(F.avg("d").alias("median"))
        whole = found.where("bucket is null").select("fold", "source", F.col("median").alias("g"))
        own = found.where("bucket is not null")
        share = F.coalesce(F.col("n") / (F.col("n") + PRIOR), F.lit(0.0))
        out = self.fits.select("fold", "source", "bucket", "n").join(whole, ["fold", "source"]).join(own, ["fold", "source", "bucket"], "left")
        return kept(out.select("fold", "source", "bucket", (share * F.coalesce("median", "g") + (1 - share) * F.col("g")).alias("median")))

    @staticmethod
    def binned(rows: DataFrame) -> DataFrame:
        return rows.withColumn("bin", F.floor(F.pmod("valid", F.lit(24)) / 3).cast("int"))

    def recency(self, rate: float = 0.05, prior: float = 10.0, width: int = 336) -> DataFrame:
        """shift of every fold, source, bucket and three-hour bin: less the running bias in issue order, drawn to none. Slices of ``width`` hours of issues are summed apart for every fold; a slice's sum shrinks by (1 - rate) for each row of later slices."""
        count = self.count

        def slices(key, pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["issue", "valid"])
            e, since, out = (pdf["x"] - pdf["y"]).to_numpy(), pdf["since"].to_numpy(), []
            for f in range(int(since.min()), count):
                own = e[since <= f]
                out.append((*key, f, own.size, float(rate * (1 - rate) ** np.arange(own.size - 1, -1, -1) @ own)))
            return pd.DataFrame(out, columns=["source", "bucket", "bin", "slice", "fold", "n", "b"])

        rows = self.binned(self.train).withColumn("slice", F.floor(F.col("issue") / width).cast("long"))
        parts = dealt(rows, "source", "bucket", "bin", "slice").groupBy("source", "bucket", "bin", "slice").applyInPandas(slices, "source string, bucket string, bin int, slice long, fold int, n long, b double")
        key = ["fold", "source", "bucket", "bin"]
        later = F.coalesce(F.sum("n").over(Window.partitionBy(*key).orderBy(F.col("slice").desc()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        whole = parts.withColumn("b", F.col("b") * F.pow(F.lit(1 - rate), later)).groupBy(*key).agg(F.sum("n").alias("n"), F.sum("b").alias("b"))
        return whole.select(*key, (-F.col("n") / (F.col("n") + prior) * F.col("b")).alias("shift"))

    @cached_property
    def running(self) -> DataFrame:
        return kept(self.recency())

    @cached_property
    def running_weights(self) -> DataFrame:
        """we of every fold and source: 1 / mean absolute error after the running bias, over all buckets."""
        off = self.absolute(self.binned(self.train), ["source", "bucket", "bin"], small(self.running), ["source"])
        n = self.levels.select("fold", "source", F.col("g_n").alias("n")).distinct()
        return kept(off.join(n, ["fold", "source"]).select("fold", "source", (1 / F.greatest(F.col("off") / F.col("n"), F.lit(1e-6))).alias("we")))

    @cached_property
    def hourly(self) -> DataFrame:
        """c of every fold and hour of the day: the mean truth of training rows."""
        steps = self.train.groupBy(F.pmod("valid", F.lit(24)).cast("int").alias("hod"), "since").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
        return kept(self.summed(steps, ["hod"]).select("fold", "hod", (F.col("s") / F.col("n")).alias("c")))

    @cached_property
    def damping(self) -> DataFrame:
        """share of every fold and bucket: of 0 to 1 in twentieths, what has the least error between the hourly mean and the grounded one, the largest among equals, drawn to 1."""
        count, grid = self.count, np.arange(21) / 20
        bias = {k: g.set_index("fold")["bias"].reindex(range(count)).fillna(0.0).to_numpy() for k, g in small(self.fits.select("fold", "source", "bucket", "bias")).groupby(["source", "bucket"])}
        mean = {h: g.set_index("fold")["c"].reindex(range(count)).fillna(0.0).to_numpy() for h, g in small(self.hourly).groupby("hod")}

        def run(batches):
            total: dict[str, np.ndarray] = {}
            for batch in batches:
                pdf = batch.to_pandas()
                for (bucket, sources), g in pdf.groupby(["bucket", pdf["sources"].map(tuple)]):
                    shift = np.mean([bias.get((s, bucket), np.zeros(count)) for s in sources], axis=0)
                    out = total.setdefault(bucket, np.zeros((grid.size, count)))
                    for a in range(0, len(g), 2048):
                        part = g.iloc[a : a + 2048]
                        known = part["since"].to_numpy()[:, None] <= np.arange(count)
                        c = np.stack([mean[h] for h in part["hod"]])
                        p, y = part["x"].to_numpy()[:, None] + shift, part["y"].to_numpy()[:, None]
                        for k, share in enumerate(grid):
                            out[k] += (np.abs(c + share * (p - c) - y) * known).sum(axis=0)
            if total:
                yield pa.RecordBatch.from_pandas(pd.DataFrame([(b, v.ravel().tolist()) for b, v in total.items()], columns=["bucket", "sums"]), preserve_index=False)

        cells = self.train.groupBy("issue", "valid", "bucket", "since").agg(F.first("y").alias("y"), F.avg("x").alias("x"), F.array_sort(F.collect_list("source")).alias("sources"))
        parts = cells.select("bucket", "since", F.pmod("valid", F.lit(24)).cast("int").alias("hod"), "y", "x", "sources").mapInArrow(run, "bucket string, sums array<double>")
        sums = parts.select("bucket", F.posexplode("sums").alias("at", "off")).groupBy("bucket", "at").agg(F.sum("off").alias("off"))
        by_fold = sums.select("bucket", (F.col("at") % count).alias("fold"), F.floor(F.col("at") / count).alias("k"), "off").join(self.cells, ["fold", "bucket"])
        best = by_fold.groupBy("fold", "bucket").agg(F.first("cells").alias("n"), F.min(F.struct(F.round(F.col("off") / F.col("cells"), 9).alias("m"), (-F.col("k")).alias("k"))).alias("b"))
        return kept(best.select("fold", "bucket", ((F.col("n") * -F.col("b.k") / 20 + PRIOR) / (F.col("n") + PRIOR)).alias("share")))

    #: What each method needs: tables joined to test rows, and the point out of a cell's rows.
    JOINS = {
        "fits": ["fold", "source", "bucket"],
        "mse_weights": ["fold", "source", "bucket"],
        "mae_weights": ["fold", "source", "bucket"],
        "medians": ["fold", "source", "bucket"],
        "running": ["fold", "source", "bucket", "bin"],
        "running_weights": ["fold", "source"],
    }

    @staticmethod
    def points() -> dict[str, tuple[tuple[str, ...], Column]]:
        x, none = F.col("x"), F.lit(0.0)
        grounded = x + F.coalesce("bias", none)
        running = x + F.coalesce("shift", none)
        weighted = lambda w, v: F.sum(F.coalesce(w, F.lit(1.0)) * v) / F.sum(F.coalesce(w, F.lit(1.0)))
        return {
            "equal_weight": ((), F.avg(x)),
            "grounded_equal_weight": (("fits",), F.avg(grounded)),
            "grounded_median_equal_weight": (("medians",), F.avg(x + F.coalesce("median", none))),
            "affine_equal_weight": (("fits",), F.avg(F.coalesce("intercept", none) + F.coalesce("slope", F.lit(1.0)) * x)),
            "best_provider": (("fits",), F.min_by("x", F.struct(F.coalesce("mae", F.lit(float("inf"))), "source"))),
            "inverse_mse": (("fits", "mse_weights"), weighted("w", grounded)),
            "inverse_mae": (("fits", "mae_weights"), weighted("w1", grounded)),
            "trimmed_mean": ((), trimmed_mean(F.collect_list(x))),
            "grounded_trimmed_mean": (("fits",), trimmed_mean(F.collect_list(grounded))),
            "ewma_grounded_equal_weight": (("running",), F.avg(running)),
            "ewma_inverse_mae": (("running", "running_weights"), weighted("we", running)),
            "damped_grounded_equal_weight": (("fits",), F.avg(grounded)),
            "sparse_shrink": (("fits",), F.avg(grounded)),
        }

    def predicted(self, names: list[str]) -> DataFrame:
        """fold, issue, valid, lead, bucket, y, method and p of every test cell, for all methods in one pass over the test rows."""
        points = self.points()
        rows = self.binned(self.test)
        for table in dict.fromkeys(t for n in names for t in points[n][0]):
            fit = getattr(self, table)
            rows = rows.join(fit.drop("n", "e", "ee"), self.JOINS[table], "left")
        out = rows.groupBy(*CELL).agg(F.first("y").alias("y"), *[points[n][1].alias(f"p_{k}") for k, n in enumerate(names)])
        for k, n in enumerate(names):
            if n == "damped_grounded_equal_weight":
                out = out.withColumn("hod", F.pmod("valid", F.lit(24)).cast("int")).join(self.hourly, ["fold", "hod"], "left").join(self.damping, ["fold", "bucket"], "left")
                out = out.withColumn(f"p_{k}", F.col("c") + F.coalesce("share", F.lit(1.0)) * (F.col(f"p_{k}") - F.col("c")))
            elif n == "sparse_shrink":
                out = out.join(self.cells, ["fold", "bucket"], "left")
                drawn = F.col("cells") / (F.col("cells") + 2) * F.col(f"p_{k}") + 2 / (F.col("cells") + 2) * F.col("cy") / F.col("cells")
                out = out.withColumn(f"p_{k}", F.coalesce(drawn, f"p_{k}"))
        methods = F.explode(F.array(*[F.struct(F.lit(n).alias("method"), F.col(f"p_{k}").alias("p")) for k, n in enumerate(names)]))
        return out.select(*CELL, "y", methods.alias("m")).select(*CELL, "y", "m.method", "m.p")
