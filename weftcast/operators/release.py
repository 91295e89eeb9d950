"""Releases: what each slice serves, decided on a log of evaluations, and looked up as of a time.

A log has a row a scored case: ``evaluation``, ``created``, the slice's columns, method, valid, p, y. Decisions are
tables of a row a slice: method, reason, n, mae, evaluation, retained, pinned. A release is such a table with ``release_id``, made
of its content, and ``minted``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import inference as I

#: What is served where nothing better is known.
FALLBACK = "equal_weight"


def newest_complete(log: DataFrame, by: list[str], references: list[str], as_of=None) -> DataFrame:
    """The cases of each slice's newest evaluation that has every reference method there; of equal times the one of greater name. Evaluations made after ``as_of`` don't count. Slices without one have no cases."""
    some = log if as_of is None else log.where(F.col("created") <= as_of)
    refs = F.count_distinct(F.when(F.col("method").isin(references), F.col("method")))
    made = some.groupBy(*by, "evaluation").agg(F.max("created").alias("created"), refs.alias("refs")).where(F.col("refs") == len(references))
    newest = made.groupBy(*by).agg(F.max(F.struct("created", "evaluation"))["evaluation"].alias("evaluation"))
    return log.join(newest, [*by, "evaluation"], "left_semi")


def board(cases: DataFrame, by: list[str]) -> DataFrame:
    """Every method of every slice: n, valid times, coverage and mae; and the evaluation it is from."""
    e = F.abs(F.col("p") - F.col("y"))
    return cases.groupBy(*by, "method").agg(F.count("p").alias("n"), F.count_distinct(F.when(F.col("p").isNotNull(), F.col("valid"))).alias("times"), (F.count("p") / F.count("*")).alias("coverage"), F.avg(e).alias("mae"), F.max("evaluation").alias("evaluation"))


def may_lead(rows: DataFrame) -> DataFrame:
    return rows.where("coverage >= 0.8 and n >= 8 and times >= 8")


def retained(losses: DataFrame, challenged: DataFrame, by: list[str]) -> DataFrame:
    """The slices of ``challenged`` (winner, incumbent) whose incumbent stays: its mean loss over the winner's, on valid times that both have, is within one standard error from blocks resampled; without any spread it has to be no worse. Fewer than eight common times keep none. A slice is as many rows as it has times."""
    kinds = dict(challenged.dtypes)
    pair = losses.join(challenged, by).where((F.col("method") == F.col("winner")) | (F.col("method") == F.col("incumbent")))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        wide = pdf.pivot_table(index="valid", columns="method", values="loss").dropna().sort_index()
        winner, incumbent = pdf["winner"].iloc[0], pdf["incumbent"].iloc[0]
        if len(wide) < 8 or winner not in wide or incumbent not in wide:
            return pd.DataFrame(columns=range(len(by)))
        off = (wide[incumbent] - wide[winner]).to_numpy()
        error = I.mean_error(off)
        stays = off.mean() <= error if np.isfinite(error) and error > 0 else off.mean() <= 0
        return pd.DataFrame([list(key)] if stays else [], columns=range(len(by)))

    return pair.groupBy(*by).applyInPandas(run, ", ".join(f"{c} {kinds[c]}" for c in by))


def decided(log: DataFrame, by: list[str], references: list[str], rule: str = "mcs", incumbents: DataFrame | None = None, pins: DataFrame | None = None, live: DataFrame | None = None, factor: float = 1.5, least_live: int = 24) -> DataFrame:
    """What each slice serves. The gate's winner on the newest complete evaluation; the incumbent (incumbents: slice, incumbent) where it may lead itself and the winner isn't clearly better; what is pinned (pins: slice columns, or some of them, and pin); and the fallback for a method, not pinned, that live (slice, method, live_n, live_mae) shows ``factor`` times as bad as it had promised on ``least_live`` cases. Slices without a complete evaluation aren't decided."""
    cases = newest_complete(log, by, references)
    every = board(cases, by)
    losses = I.collapsed(cases.where("p is not null"), by)
    won = I.gated(losses, may_lead(every).select(*by, "method", "mae"), by, references, rule)
    out = won.select(*by, "winner", F.coalesce("gate", F.lit("lowest error past the gate")).alias("reason")).withColumn("retained", F.lit(False))
    if incumbents is not None:
        able = may_lead(every).select(*by, F.col("method").alias("incumbent"))
        challenged = out.join(incumbents.join(able, [*by, "incumbent"], "left_semi"), by).where("incumbent <> winner").select(*by, "winner", "incumbent")
        stay = retained(losses, challenged, by).join(incumbents, by)
        out = out.join(stay, by, "left").select(*by, F.coalesce("incumbent", "winner").alias("winner"), F.when(F.col("incumbent").isNotNull(), "incumbent retained within one standard error").otherwise(F.col("reason")).alias("reason"), F.col("incumbent").isNotNull().alias("retained"))
    figures = every.select(*by, F.col("method").alias("winner"), "n", "mae")
    evaluation = every.groupBy(*by).agg(F.max("evaluation").alias("evaluation"))
    out = out.join(figures, [*by, "winner"], "left").join(evaluation, by).withColumn("pinned", F.lit(False))
    if pins is not None:
        keys = [c for c in pins.columns if c != "pin"]
        held = F.col("pin").isNotNull()
        out = out.join(pins, keys, "left").select(*by, F.coalesce("pin", "winner").alias("winner"), F.when(held, "pinned").otherwise(F.col("reason")).alias("reason"), "retained", "n", "mae", "evaluation", held.alias("pinned"))
    if live is not None:
        seen = live.withColumnRenamed("method", "winner")
        second = every.where(F.col("method") == FALLBACK).select(*by, F.col("n").alias("f_n"), F.col("mae").alias("f_mae"))
        fails = ~F.col("pinned") & (F.col("winner") != FALLBACK) & (F.col("live_n") >= least_live) & (F.col("live_mae") > factor * F.col("mae")) & F.col("f_mae").isNotNull()
        fails = F.coalesce(fails, F.lit(False))
        say = F.concat(F.lit("demoted "), F.col("winner"), F.lit(": live "), F.format_number("live_mae", 3), F.lit(" against "), F.format_number("mae", 3))
        out = out.join(seen, [*by, "winner"], "left").join(second, by, "left").select(*by, F.when(fails, FALLBACK).otherwise(F.col("winner")).alias("winner"), F.when(fails, say).otherwise(F.col("reason")).alias("reason"), (F.col("retained") & ~fails).alias("retained"), F.when(fails, F.col("f_n")).otherwise(F.col("n")).alias("n"), F.when(fails, F.col("f_mae")).otherwise(F.col("mae")).alias("mae"), "evaluation", "pinned")
    return out.select(*by, F.col("winner").alias("method"), "reason", "n", "mae", "evaluation", "retained", "pinned")


def minted(decisions: DataFrame, by: list[str], at) -> DataFrame:
    """The decisions as a release: its name is made of what they say, so equal decisions are one release."""
    said = F.concat_ws("|", *[F.col(c).cast("string") for c in by], "method", "reason", "evaluation", F.col("n").cast("string"), F.round("mae", 9).cast("string"), F.col("retained").cast("string"))
    name = decisions.agg(F.substring(F.sha2(F.array_join(F.array_sort(F.collect_list(said)), ";"), 256), 1, 16).alias("release_id"))  # a slice a bucket
    return decisions.crossJoin(F.broadcast(name)).withColumn("minted", F.lit(at))  # one row


def release_as_of(releases: DataFrame, as_of) -> DataFrame:
    """The newest release that existed at ``as_of``; of equal times the one of greater name."""
    old = releases.where(F.col("minted") <= as_of)
    newest = old.agg(F.max(F.struct("minted", "release_id"))["release_id"].alias("release_id"))
    return old.join(F.broadcast(newest), "release_id", "left_semi")  # one row


def method_of(rows: DataFrame, release: DataFrame, by: list[str], pins: DataFrame | None = None, supported: DataFrame | None = None, forced: str | None = None) -> DataFrame:
    """rows with method, reason and degraded: what is forced, else pinned, else released for the row's slice, else the fallback.

    supported: method and slice columns (all or some) of what may serve where. A released or pinned method that may not serve the
    slice, or isn't known any more, is replaced by the fallback and the row is degraded; a forced one is an error.
    """
    chosen = rows.join(release.select(*by, F.col("method").alias("__released"), F.col("reason").alias("__why")), by, "left")
    method, why = F.coalesce("__released", F.lit(FALLBACK)), F.coalesce("__why", F.lit("no evidence for this slice"))
    if pins is not None:
        keys = [c for c in pins.columns if c != "pin"]
        chosen = chosen.join(pins.withColumnRenamed("pin", "__pin"), keys, "left")
        method, why = F.coalesce("__pin", method), F.when(F.col("__pin").isNotNull(), "pinned").otherwise(why)
    if forced is not None:
        method, why = F.lit(forced), F.lit("forced")
    chosen = chosen.withColumn("method", method).withColumn("reason", why).drop("__released", "__why", "__pin")
    if supported is None:
        return chosen.withColumn("degraded", F.lit(False))
    keys = [c for c in supported.columns if c != "method"]
    able = supported.distinct().withColumn("__able", F.lit(True))
    met = chosen.join(able, ["method", *keys], "left").join(supported.select("method").distinct().withColumn("__known", F.lit(True)), "method", "left")
    bad = F.col("__able").isNull() & (F.col("method") != FALLBACK)
    problem = F.concat(F.when(F.col("__known").isNull(), "unknown method ").otherwise("no support here for "), F.col("method"))
    if forced is not None:
        met = met.withColumn("method", F.when(bad, F.raise_error(problem)).otherwise(F.col("method")))
    names = [c for c in chosen.columns if c not in ("method", "reason")]
    degraded = F.lit(False) if forced is not None else bad
    return met.select(*names, F.when(degraded, FALLBACK).otherwise(F.col("method")).alias("method"), F.when(degraded, F.concat(F.lit("degraded: "), problem)).otherwise(F.col("reason")).alias("reason"), F.coalesce(degraded, F.lit(False)).alias("degraded"))


def pooled_live(history: DataFrame, by: list[str], now: Column, window: int = 336) -> DataFrame:
    """live_n and live_mae of each slice's methods as served over the last ``window`` hours, whatever the release."""
    recent = history.where((F.col("valid") > now - window) & F.col("p").isNotNull() & F.col("y").isNotNull())
    return recent.groupBy(*by, "method").agg(F.count("*").alias("live_n"), F.avg(F.abs(F.col("p") - F.col("y"))).alias("live_mae"))


def newest_of(rows: DataFrame, by: list[str], order: str) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*by).orderBy(F.col(order).desc()))).where("__n = 1").drop("__n")
