"""Serving in one chain: what is known at a time, which method each slice gets, its points, their distributions and minutes, and the record of it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.scalars import anchor_weight, lead_bucket
from ..sources import observability
from ..sources.scratch import dealt, settled
from . import matrix as M
from . import release as R
from .foldsums import Folds

LEVELS = tuple(round(0.05 * k, 2) for k in range(1, 20))
REFERENCES = ["best_provider", "damped_grounded_equal_weight", "equal_weight"]
CANDIDATES = [*REFERENCES, "grounded_equal_weight", "inverse_mse", "inverse_mae"]
DOCUMENT = "issue long, product string, valid long, bucket string, method string, reason string, degraded boolean, release_id string, p double, q array<double>"


class Now(Folds):
    """One fold: all that is known, and a snapshot whose truth isn't."""

    def __init__(self, train: DataFrame, snapshot: DataFrame):
        self.count = 1
        self.train = train.withColumn("since", F.lit(0))
        self.test = snapshot.withColumn("fold", F.lit(0))
        self.rows = train.select("source", "bucket", "x", "y").unionByName(snapshot.select("source", "bucket", "x", "y"))


def known(truth: DataFrame, now: int, delay: int = 2) -> DataFrame:
    """The truth that its clock has passed."""
    return truth.where(F.col("valid") + delay <= now)


def evaluations(past: DataFrame, initial: int, step: int, methods: list[str]) -> DataFrame:
    """A log of evaluations out of what is known: a fold's scores are one, made when its last issue is."""
    rows = past.where("y is not null")
    folds = Folds(rows, M.fold_origins(rows, initial, step), step)
    cells = folds.predicted(methods)
    made = cells.groupBy("fold").agg(F.max("issue").alias("created"))
    return cells.join(made, "fold").withColumn("evaluation", F.format_string("fold-%04d", "fold"))


def dressed(points: DataFrame, log: DataFrame, levels=LEVELS, least: int = 24) -> DataFrame:
    """points (method, bucket, p, ...) with q: the point plus quantiles of the method's errors in its bucket, or over all buckets where the bucket has under ``least``; null without that many anywhere."""
    errors = log.where("p is not null and y is not null").withColumn("e", F.col("y") - F.col("p"))
    quantiles = F.percentile("e", F.array(*map(F.lit, levels)))
    own = errors.groupBy("method", "bucket").agg(F.count("*").alias("__n"), quantiles.alias("__q")).where(F.col("__n") >= least).drop("__n")
    whole = errors.groupBy("method").agg(F.count("*").alias("__n"), quantiles.alias("__g")).where(F.col("__n") >= least).drop("__n")
    out = points.join(own, ["method", "bucket"], "left").join(whole, "method", "left")
    return out.withColumn("q", F.array_sort(F.transform(F.coalesce("__q", "__g"), lambda e: F.col("p") + e))).drop("__q", "__g")


#: The constructions of minutes, by what they need besides the path: decay times in hours of the residual.
DECAYS = {"minutely_anchor_tau_0.25h": 0.25, "minutely_anchor_tau_0.5h": 0.5, "minutely_anchor_tau_1h": 1.0, "minutely_anchor_tau_3h": 3.0}
CONSTRUCTIONS = ("minutely_interp", "minutely_persistence", *DECAYS, "minutely_anchor_full")


def minute_value(name: str, path: Column, hour: Column, observed: Column, start: Column) -> Column:
    """A minute's value by a construction: the path alone, the observation alone, or the path and what the observation is off its start, in full or fading."""
    if name == "minutely_interp":
        return path
    if name == "minutely_persistence":
        return observed
    return path + (F.lit(1.0) if name == "minutely_anchor_full" else anchor_weight(hour, DECAYS[name])) * (observed - start)


def planned_minutes(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """rows (bucket, hour, path, observed, start) with construction and p: that of their bucket's plan (bucket, plan); without one the anchor that fades in an hour. A construction that needs an observation where there is none is the path alone, and says so."""
    wanted = F.coalesce("plan", F.lit("minutely_anchor_tau_1h"))
    said = F.when(F.col("observed").isNull(), "minutely_interp").otherwise(wanted)
    out = rows.join(plans.select("bucket", "plan"), "bucket", "left").withColumn("construction", said)
    value = F.col("path")
    for name in CONSTRUCTIONS[1:]:
        value = F.when(F.col("construction") == name, minute_value(name, F.col("path"), F.col("hour"), F.col("observed"), F.col("start"))).otherwise(value)
    return out.withColumn("p", value).drop("plan")


def best_constructions(scored: DataFrame) -> DataFrame:
    """bucket, plan, mae: of all constructions the one of least error on rows with y, in each bucket; by name among equals. All are sums of one pass."""
    some = scored.where("y is not null and observed is not null")
    mae = [F.round(F.avg(F.abs(minute_value(n, F.col("path"), F.col("hour"), F.col("observed"), F.col("start")) - F.col("y"))), 9).alias(f"m{k}") for k, n in enumerate(CONSTRUCTIONS)]
    tried = some.groupBy("bucket").agg(*mae)
    best = F.array_min(F.array(*[F.struct(F.col(f"m{k}").alias("m"), F.lit(n).alias("plan")) for k, n in enumerate(CONSTRUCTIONS)]))
    return tried.select("bucket", best["plan"].alias("plan"), best["m"].alias("mae"))


def next_minutes(points: DataFrame, observed: float | None, plans: DataFrame | None = None) -> DataFrame:
    """The next hour's minutes (valid: minutes since the epoch) on straight lines between the first hours' points, anchored once, by the plans of their buckets; the reason names the construction."""
    w = Window.partitionBy("issue").orderBy("lead")
    path = points.where("lead <= 3 and p is not null").withColumn("l1", F.lead("lead").over(w)).withColumn("p1", F.lead("p").over(w)).where("l1 is not null")
    slope = (F.col("p1") - F.col("p")) / (F.col("l1") - F.col("lead"))
    start = path.groupBy("issue").agg(F.min_by(F.struct(F.col("p"), F.col("lead"), slope.alias("s")), "lead").alias("f")).select("issue", (F.col("f.p") - F.col("f.s") * F.col("f.lead")).alias("start"))
    # The line of the first two points is carried on to the issue itself.
    first = F.col("lead") == F.min("lead").over(Window.partitionBy("issue"))
    low = F.when(first, 1).otherwise((F.col("lead") * 60).cast("int"))
    m = path.withColumn("low", low).withColumn("m", F.explode(F.sequence(F.col("low"), F.greatest(F.col("low"), (F.col("l1") * 60 - 1).cast("int"))))).where("m between 1 and 60")
    hour = F.col("m") / 60
    rows = m.join(start, "issue").select("issue", (F.col("issue") * 60 + F.col("m")).alias("valid"), "lead", lead_bucket(hour, "minutely").alias("bucket"), "method", "degraded", hour.alias("hour"), (F.col("p") + (hour - F.col("lead")) * slope).alias("path"), F.lit(None if observed is None else float(observed)).cast("double").alias("observed"), "start")
    plans = points.sparkSession.createDataFrame([], "bucket string, plan string") if plans is None else plans
    return planned_minutes(rows, plans).select("issue", "valid", "lead", "bucket", "method", F.col("construction").alias("reason"), "degraded", "p")


def predict(cycles: DataFrame, forecasts: DataFrame, truth: DataFrame, snapshots: DataFrame, now: int, cap: int, initial: int, step: int, rule: str = "mcs", pins: DataFrame | None = None, forced: str | None = None, minute_plans: DataFrame | None = None) -> DataFrame:
    """DOCUMENT for the issue ``now``, of nothing that wasn't known then: cycles fetched, and truths whose clock has passed. Nothing to serve is an error.

    The snapshot's rows get the method of their slice's release, decided on the evaluations of the past; its fit on all that is
    known; the quantiles of its past errors; and the first hour's minutes, anchored to the last full hour observed.
    """
    spark = cycles.sparkSession
    then = cycles.where(F.col("fetched") <= now)
    some = forecasts.where(F.col("fetched") <= now)
    seen = settled(known(truth, now), "known-truth")
    past = settled(dealt(M.matrix(M.as_of_selection(snapshots.where(F.col("issue") <= now), then, cap), some, seen), "issue"), "past")
    snapshot = M.matrix(M.as_of_selection(spark.createDataFrame([(now,)], "issue long"), then, cap), some, seen)
    snapshot = settled(snapshot, "snapshot")
    if not snapshot.limit(1).count():
        raise ValueError(f"no source is fresh enough at {now}")
    log = settled(evaluations(past, initial, step, CANDIDATES), "evaluations")
    release = settled(R.minted(R.decided(log, ["bucket"], REFERENCES, rule, pins=pins), ["bucket"], now), "release")
    points = settled(Now(past.where("y is not null"), snapshot).predicted(CANDIDATES), "points")
    able = spark.createDataFrame([(m,) for m in CANDIDATES], "method string")
    cells = snapshot.select("issue", "valid", "lead", "bucket").distinct()
    chosen = R.method_of(cells, release, ["bucket"], pins, able, forced)
    served = settled(chosen.join(points.select("issue", "valid", "method", "p"), ["issue", "valid", "method"]), "chosen")
    last = seen.where(F.col("valid") == F.lit(now - 2)).select("y").first()
    hourly = dressed(served, log).withColumn("product", F.lit("hourly"))
    minutely = next_minutes(served, None if last is None else last[0], minute_plans).withColumn("product", F.lit("minutely")).withColumn("q", F.lit(None).cast("array<double>"))
    name = release.agg(F.max("release_id").alias("release_id"))
    rows = hourly.select("issue", "product", "valid", "bucket", "method", "reason", "degraded", "p", "q").unionByName(minutely.select("issue", "product", "valid", "bucket", "method", "reason", "degraded", "p", "q"))
    return rows.crossJoin(F.broadcast(name)).select(*[c.split()[0] for c in DOCUMENT.split(", ")])  # one row


def served_at(spark: SparkSession, folder: str, now: int, make: Callable[[], DataFrame], trajectory: bool = False) -> DataFrame:
    """The document of issue ``now``: the archived one, as it was served, or else a new one, which is appended to the history with its metrics taken on the way."""
    path = f"{folder}/history/of={now}"
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        metrics = {"n": F.count("*"), "degraded": F.count_if("degraded"), "missing": F.count_if(F.col("p").isNull()), "mean": F.avg(F.when(F.col("product") == "hourly", F.col("p")))}
        observability.measured(make(), lambda out: out.write.mode("overwrite").parquet(path), metrics, {"method": "served", "product": "all", "variable": "value", "issue": now}, f"{folder}/seen", trajectory)
    return spark.read.schema(DOCUMENT).parquet(path)
