"""Operators on time: as-of joins, islands, range windows, fills and first or last rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .sliding import sliding_quantiles


def asof_join(left: DataFrame, right: DataFrame, left_on: str, right_on: str, by: list[str], tolerance: float | None = None, columns: list[str] | None = None, prefix: str = "", width: float | None = None) -> DataFrame:
    """Each left row with the newest right row at or before it, by key, at most ``tolerance`` older; without one the columns are null. Both sides meet in one window (a shuffle by key, a sort by time): a row travels as a struct, so that its nulls stay its own.

    Times are cut into slices of ``width`` (eight tolerances by default) that are part of the key, so a few keys don't mean a few tasks: a right row goes to every slice its tolerance reaches into, or, without a tolerance, the last one of a slice to the next slices up to the next one that has any."""
    columns = columns or [c for c in right.columns if c not in by]
    if width is None and tolerance is not None:
        width = 8 * max(tolerance, 1)
    slice_of = lambda t: F.lit(0).cast("long") if width is None else F.floor(t / F.lit(width)).cast("long")
    keys = [F.col(k) for k in by]
    row = F.struct(F.col(right_on).alias("__at"), *[F.col(c).alias(f"c_{c}") for c in columns])
    from_right = right.select(*keys, F.col(right_on).alias("__t"), F.lit(0).alias("__side"), row.alias("__row"))
    kind = dict(from_right.dtypes)["__row"]
    from_left = left.select(*keys, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), F.lit(None).cast(kind).alias("__row"), F.struct(*left.columns).alias("__left")).withColumn("__slice", slice_of(F.col("__t")))
    if width is not None and tolerance is not None:
        from_right = from_right.withColumn("__slice", F.explode(F.sequence(slice_of(F.col("__t")), slice_of(F.col("__t") + F.lit(tolerance)))))
    else:
        from_right = from_right.withColumn("__slice", slice_of(F.col("__t")))
        if width is not None:
            # One row a key and slice in which either side has rows: what a slice inherits is the last row of those before.
            last = from_right.groupBy(*by, "__slice").agg(F.max_by("__row", "__t").alias("__row"), F.lit(1).alias("__has"))
            spine = last.unionByName(from_left.select(*by, "__slice").distinct().withColumn("__row", F.lit(None).cast(kind)).withColumn("__has", F.lit(0)))
            merged = spine.groupBy(*by, "__slice").agg(F.max_by("__row", "__has").alias("__row"), F.max("__has").alias("__has"))
            earlier = Window.partitionBy(*by, F.lit(0)).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
            inherited = merged.withColumn("__old", F.last(F.when(F.col("__has") == 1, F.struct("__row")), ignorenulls=True).over(earlier)).where("__old is not null")
            start = (F.col("__slice") * F.lit(width)).cast(dict(from_right.dtypes)["__t"])
            from_right = from_right.unionByName(inherited.select(*by, start.alias("__t"), F.lit(-1).alias("__side"), F.col("__old.__row").alias("__row"), "__slice"))
    both = from_right.withColumn("__left", F.lit(None).cast(dict(from_left.dtypes)["__left"])).unionByName(from_left)
    before = Window.partitionBy(*by, "__slice").orderBy("__t", "__side").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("__row", F.last("__row", ignorenulls=True).over(before)).where("__side = 1")
    fresh = F.lit(True) if tolerance is None else F.col("__t") - F.col("__row.__at") <= tolerance
    return found.select("__left.*", *[F.when(fresh, F.col(f"__row.c_{c}")).alias(prefix + c) for c in columns])


def in_slices(df: DataFrame, time: str, width: int, back: int) -> DataFrame:
    """Rows with ``__slice``, a slice of their integer time, and ``__own``; a row within ``back`` of the end of its slice is in the next one too, not as its own. Windows over (t - back, t] may then have the slice in their key."""
    home = F.floor(F.col(time) / width).cast("long")
    near = (home + 1) * width - F.col(time) < back
    both = F.when(near, F.array(home, home + 1)).otherwise(F.array(home))
    return df.withColumn("__home", home).withColumn("__slice", F.explode(both)).withColumn("__own", F.col("__home") == F.col("__slice")).drop("__home")


def cumulative(df: DataFrame, part: str, order: list[str], value: Column, name: str) -> DataFrame:
    """A running sum over all rows in the order of ``part`` and ``order`` without a task that holds them all: the sum within each part, and what the parts before have, a row a part."""
    within = Window.partitionBy(part).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    totals = df.groupBy(part).agg(F.sum(value).alias("__total"))
    before = totals.select(part, F.coalesce(F.sum("__total").over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    return df.withColumn("__within", F.sum(value).over(within)).join(before, part).withColumn(name, F.col("__within") + F.col("__before")).drop("__within", "__before")


def numbered(df: DataFrame, time: str, width: int, name: str = "__number") -> DataFrame:
    """Rows numbered from 0 in the order of an integer time that doesn't repeat, slice by slice of it."""
    sliced = df.withColumn("__time_slice", F.floor(F.col(time) / width).cast("long"))
    return cumulative(sliced, "__time_slice", [time], F.lit(1), "__n").withColumn(name, (F.col("__n") - 1).cast("long")).drop("__n", "__time_slice")


def islands(df: DataFrame, by: list[str], order: list[str], breaks: Column, name: str = "run_id") -> DataFrame:
    """Numbers runs of rows; ``breaks`` is true where a new run begins."""
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn(name, F.sum(F.when(breaks, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def rolling_median(df: DataFrame, value: str, by: list[str], time: str, width: int, median: str, count: str, slices: int = 64) -> DataFrame:
    """The median (without nulls) and the number of rows over (t - width, t], of an integer time column, by key. Spark has no median over ordered frames: rows are sorted by key and slice, and a window slides over them. Time slices of ``slices`` widths are part of the key."""
    rows = in_slices(df, time, slices * width, width)
    return sliding_quantiles(rows, value, [*by, "__slice"], time, width, {median: 0.5}, count, "__own", ["__slice", "__own"])


def rolling_correlation(x: str, y: str, window: Window, least: int) -> Column:
    """Correlation over a frame; null for too few pairs or a constant series, where the built-in one would divide by zero."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    a, b = (F.when(both, F.col(c)) for c in (x, y))
    r = F.try_divide(F.covar_pop(a, b).over(window), F.sqrt(F.var_pop(a).over(window) * F.var_pop(b).over(window)))
    return F.when(F.count(a).over(window) >= least, r)


def safe_correlation(x: str | Column, y: str | Column) -> Column:
    return F.try_divide(F.covar_pop(x, y), F.sqrt(F.var_pop(x) * F.var_pop(y)))


def forward_filled(value: str, by: list[str], order: str) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0))


def one_each(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("__nth = 1").drop("__nth")
