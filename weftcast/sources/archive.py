"""Reading SQLite archives as Spark tables, and the scans made of them. Scans work on tables of any origin; those that take a path load them from a SQLite file.

A SQLite file is read by a Python data source: the driver learns the range of rowids, and
each partition reads its own range through a read-only connection, in which comparisons of
columns with constants (places, times, states) are part of the statement. As a stream the source tails a log by rowid: rows that
have been appended since the last batch are the next one. The file has to lie
where executors see it. What comes out are plain DataFrames; everything after is built of
joins and expressions.
"""

from __future__ import annotations

import contextlib
import os
import sqlite3
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, StringStartsWith
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

from ..functions.scalars import converted, haversine_km, source_slug

_TYPES = {"INT": LongType(), "REAL": DoubleType(), "FLOA": DoubleType(), "DOUB": DoubleType()}


def _connect(path: str) -> sqlite3.Connection:
    return sqlite3.connect(f"file:{path}?mode=ro", uri=True)


def _quoted(name: str) -> str:
    return '"' + name.replace('"', '""') + '"'


class _Range(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__((low, high))
        self.low, self.high = low, high


class SqliteSource(DataSource):
    """Options: path, table, partitions (8). A missing table is empty with the schema given by the reader."""

    @classmethod
    def name(cls) -> str:
        return "weftcast_sqlite"

    def schema(self) -> StructType:
        with _connect(self.options["path"]) as con:
            columns = con.execute(f"PRAGMA table_info({_quoted(self.options['table'])})").fetchall()
        return StructType([StructField(c[1], _TYPES.get(c[2].upper()[:4].rstrip(), _TYPES.get(c[2].upper()[:3], StringType()))) for c in columns])

    def reader(self, schema: StructType) -> DataSourceReader:
        return SqliteReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return SqliteTail(self.options, schema)


_OPERATORS = {EqualTo: "=", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<="}


class _Table:
    """What readers of a table share: ranges of rowids, and the rows of a range."""

    def __init__(self, options, schema: StructType):
        self.path, self.table, self.parts, self.schema = options["path"], options["table"], int(options.get("partitions", "8")), schema
        self.conditions: list[tuple[str, tuple]] = []

    def bounds(self) -> tuple[int, int] | None:
        """The least and the largest rowid; None of no rows or no table."""
        with _connect(self.path) as con:
            known = con.execute("SELECT count(*) FROM sqlite_master WHERE name = ?", (self.table,)).fetchone()[0]
            low, high = con.execute(f"SELECT min(rowid), max(rowid) FROM {_quoted(self.table)}").fetchone() if known else (None, None)
        return None if low is None else (low, high)

    def ranges(self, low: int, high: int) -> list[InputPartition]:
        step = max(-(-(high - low + 1) // self.parts), 1)
        return [_Range(a, min(a + step, high + 1)) for a in range(low, high + 1, step)] or [_Range(0, 0)]

    def rows(self, partition: _Range) -> Iterator[tuple]:
        if partition.high <= partition.low:
            return
        casts = [float if isinstance(f.dataType, DoubleType) else int if isinstance(f.dataType, LongType) else str for f in self.schema]
        with _connect(self.path) as con:
            have = {c[1] for c in con.execute(f"PRAGMA table_info({_quoted(self.table)})")}
            # The implicit rowid is no listed column, but can be asked for by name.
            names = ", ".join(_quoted(f.name) if f.name in have else "rowid" if f.name == "rowid" else "NULL" for f in self.schema)
            where = "".join(f" AND {c}" for c, _ in self.conditions)
            values = [v for _, some in self.conditions for v in some]
            for row in con.execute(f"SELECT {names} FROM {_quoted(self.table)} WHERE rowid >= ? AND rowid < ?{where}", (partition.low, partition.high, *values)):
                yield tuple(None if v is None else c(v) for v, c in zip(row, casts))


class SqliteReader(_Table, DataSourceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Comparisons that SQLite can make go into the statement. Spark makes them again on what is left, so they only have to keep every row that passes: a column whose stored values needn't be of its type here is cast first."""
        with _connect(self.path) as con:
            kinds = {c[1]: c[2].upper() for c in con.execute(f"PRAGMA table_info({_quoted(self.table)})")}
        types = {f.name: f.dataType for f in self.schema}
        for f in filters:
            if (made := self._condition(f, kinds, types)) is not None:
                self.conditions.append(made)
            yield f

    def _condition(self, f: Filter, kinds: dict[str, str], types: dict) -> tuple[str, tuple] | None:
        name = f.attribute[0] if getattr(f, "attribute", None) and len(f.attribute) == 1 else None
        if name == "rowid" and name not in kinds:
            column = "rowid"
        elif name not in kinds or name not in types:
            return None
        elif isinstance(types[name], StringType):
            column = _quoted(name) if "CHAR" in kinds[name] or "TEXT" in kinds[name] else f"CAST({_quoted(name)} AS TEXT)"
        else:
            numeric = any(k in kinds[name] for k in ("INT", "REAL", "FLOA", "DOUB"))
            column = _quoted(name) if numeric else f"CAST({_quoted(name)} AS {'INTEGER' if isinstance(types[name], LongType) else 'REAL'})"
        if isinstance(f, IsNotNull):
            return f"{column} IS NOT NULL", ()
        value = getattr(f, "value", None)
        if isinstance(f, In):
            some = tuple(v for v in value if isinstance(v, (int, float, str)) and not isinstance(v, bool))
            return (f"{column} IN ({', '.join('?' * len(some))})", some) if len(some) == len(value) <= 500 else None
        if not isinstance(value, (int, float, str)) or isinstance(value, bool) or isinstance(value, float) and value != value:
            return None
        if type(f) in _OPERATORS:
            return f"{column} {_OPERATORS[type(f)]} ?", (value,)
        if isinstance(f, StringStartsWith):
            return f"substr({column}, 1, ?) = ?", (len(value), value)
        return None

    def partitions(self) -> list[InputPartition]:
        found = self.bounds()
        return [_Range(0, 0)] if found is None else self.ranges(*found)

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from self.rows(partition)


class SqliteTail(_Table, DataSourceStreamReader):
    """A log that grows by larger rowids: an offset is the last rowid that has been read."""

    def initialOffset(self) -> dict:
        found = self.bounds()
        return {"rowid": found[0] - 1 if found else 0}

    def latestOffset(self) -> dict:
        found = self.bounds()
        return {"rowid": found[1] if found else self.initialOffset()["rowid"]}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return self.ranges(start["rowid"] + 1, end["rowid"])

    def read(self, partition: _Range) -> Iterator[tuple]:
        yield from self.rows(partition)

    def commit(self, end: dict) -> None:
        """Nothing is kept: rows stay in the log."""


def table(spark: SparkSession, path: str, name: str, schema: str | None = None, partitions: int = 8) -> DataFrame:
    """A table of a SQLite file. With a ``schema``, columns or a table that are missing read as null or empty. Filters on it reach SQLite."""
    spark.dataSource.register(SqliteSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    reader = spark.read.format("weftcast_sqlite").option("path", path).option("table", name).option("partitions", str(partitions))
    return (reader.schema(schema) if schema else reader).load()


def tail(spark: SparkSession, path: str, name: str, schema: str, partitions: int = 8) -> DataFrame:
    """The same table as a stream: what it holds, and then what is appended."""
    spark.dataSource.register(SqliteSource)
    return spark.readStream.format("weftcast_sqlite").option("path", path).option("table", name).option("partitions", str(partitions)).schema(schema).load()


def utc(text: str):
    """A timestamp from text with or without a fraction; null if it is neither."""
    return F.try_to_timestamp(F.col(text))


def frozen(path: str, folder: str) -> str:
    """A copy of a SQLite file as it stands at one moment, page by page, for reads of many tables in many tasks that have to agree. ``folder`` is one that driver and executors mount."""
    to = os.path.join(folder, f"snapshot-{uuid.uuid4().hex}.db")
    with contextlib.closing(_connect(path)) as source, contextlib.closing(sqlite3.connect(to)) as copy:
        source.backup(copy)
    return to


def station(spark: SparkSession, path: str, channels: dict[str, tuple[str, str]], name: str = "observations") -> DataFrame:
    """The observation log of a SQLite file, by ``observation_log``; columns that it lacks are null."""
    schema = "rowid long, ts string, " + ", ".join(f"`{c}` double" for c in dict.fromkeys(c for c, _ in channels.values()))
    return observation_log(table(spark, path, name, schema), channels)


def observation_log(raw: DataFrame, channels: dict[str, tuple[str, str]]) -> DataFrame:
    """ts and each channel (name to column and unit) in canonical units, out of rowid, ts as text and columns; rows without a time go, of equal times the row with the least rowid stays."""
    rows = raw.select("rowid", utc("ts").alias("ts"), *[converted(F.col(f"`{c}`"), unit).alias(channel) for channel, (c, unit) in channels.items()]).where("ts is not null")
    first = Window.partitionBy("ts").orderBy(F.col("rowid").asc_nulls_last())
    return rows.withColumn("__n", F.row_number().over(first)).where("__n = 1").drop("__n", "rowid")


POINTS = "source_forecast_id long, timestamp_unix long, temperature double, humidity double, dew_point double, wind_speed double, wind_gust double, pressure_sea double, precipitation double, precipitation_probability double"
DAILY_POINTS = "source_forecast_id long, forecast_date string, temperature_max double, temperature_min double, precipitation_sum double, precipitation_probability_max double"
MINUTELY_POINTS = "source_forecast_id long, timestamp_unix long, precipitation_intensity double, precipitation_probability double"


def at_place(rows: DataFrame, latitude: float, longitude: float, tolerance: float = 1e-4) -> DataFrame:
    out, wide = rows, tolerance * 1.001 + 1e-12
    for column, at in (("latitude", latitude), ("longitude", longitude)):
        # A source can do the comparisons with constants; the exact rule follows.
        out = out.where((F.col(column) >= at - wide) & (F.col(column) <= at + wide) & (F.abs(F.col(column) - at) <= tolerance))
    return out


def sourced(points: DataFrame, forecasts: DataFrame, results: DataFrame, runs: DataFrame, latitude: float, longitude: float, tolerance: float = 1e-4, allowed: list[str] | None = None) -> DataFrame:
    """Points with the source and fetch time of their forecast, of successful results at the place; a result without a fetch time gives none."""
    here = at_place(runs, latitude, longitude, tolerance).select(F.col("id").alias("run_id"))
    good = results.where("status = 'success'").join(here, "run_id").select(F.col("id").alias("provider_result_id"), "provider", F.to_timestamp("fetched_at").alias("fetched"))
    named = forecasts.join(good, "provider_result_id").where("fetched is not null").select(F.col("id").alias("source_forecast_id"), source_slug(F.col("provider"), F.col("model")).alias("source"), "fetched")
    if allowed is not None:
        named = named.where(F.col("source").isin(allowed))
    return points.join(named, "source_forecast_id")


def with_lead(rows: DataFrame) -> DataFrame:
    """The lead from the fetch time; what a provider says of its horizon isn't trusted."""
    return rows.withColumn("lead_hours", (F.unix_micros("valid") - F.unix_micros("fetched")) / 3.6e9)


def _rest(rows: DataFrame, *used: str) -> list[str]:
    return [c for c in rows.columns if c not in ("source", "fetched", "source_forecast_id", *used)]


def hourly_long(rows: DataFrame) -> DataFrame:
    """``sourced`` points as source, fetched, valid, the variables and lead_hours."""
    return with_lead(rows.select("source", "fetched", F.timestamp_seconds("timestamp_unix").alias("valid"), *_rest(rows, "timestamp_unix")))


def daily_long(rows: DataFrame) -> DataFrame:
    """``sourced`` days as source, fetched, valid_date and the variables; a date that can't be read drops its row."""
    return rows.select("source", "fetched", F.col("forecast_date").try_cast("date").alias("valid_date"), *_rest(rows, "forecast_date")).where("valid_date is not null")


def minutely_long(rows: DataFrame) -> DataFrame:
    """``sourced`` minutes: precipitation's intensity and chance alone."""
    return with_lead(rows.select("source", "fetched", F.timestamp_seconds("timestamp_unix").alias("valid"), "precipitation_intensity", "precipitation_probability"))


def _archived(spark: SparkSession, path: str, points: str, schema: str, latitude: float, longitude: float, tolerance: float, allowed: list[str] | None) -> DataFrame:
    p = table(spark, path, points, schema)
    s = table(spark, path, "source_forecasts", "id long, provider_result_id long, model string")
    r = table(spark, path, "provider_results", "id long, run_id long, provider string, status string, fetched_at string")
    runs = table(spark, path, "forecast_runs", "id long, latitude double, longitude double")
    return sourced(p, s, r, runs, latitude, longitude, tolerance, allowed)


def hourly_forecasts(spark: SparkSession, path: str, latitude: float, longitude: float, tolerance: float = 1e-4, allowed: list[str] | None = None, points: str = "hourly_points", schema: str = POINTS) -> DataFrame:
    return hourly_long(_archived(spark, path, points, schema, latitude, longitude, tolerance, allowed))


def daily_forecasts(spark: SparkSession, path: str, latitude: float, longitude: float, tolerance: float = 1e-4, allowed: list[str] | None = None) -> DataFrame:
    return daily_long(_archived(spark, path, "daily_points", DAILY_POINTS, latitude, longitude, tolerance, allowed))


def minutely_forecasts(spark: SparkSession, path: str, latitude: float, longitude: float, tolerance: float = 1e-4, allowed: list[str] | None = None) -> DataFrame:
    return minutely_long(_archived(spark, path, "minutely_points", MINUTELY_POINTS, latitude, longitude, tolerance, allowed))


def completed_at(runs: DataFrame, latitude: float, longitude: float, tolerance: float = 1e-4) -> DataFrame:
    """When the place's runs completed: the anchors of snapshots."""
    return at_place(runs, latitude, longitude, tolerance).select(F.to_timestamp("completed_at").alias("completed")).where("completed is not null")


def newest_place(runs: DataFrame) -> DataFrame:
    """Where the run with the largest id was made."""
    return runs.agg(F.max_by(F.struct("latitude", "longitude"), "id").alias("p")).select("p.*")


def completions(spark: SparkSession, path: str, latitude: float, longitude: float, tolerance: float = 1e-4) -> DataFrame:
    return completed_at(table(spark, path, "forecast_runs", "id long, latitude double, longitude double, completed_at string"), latitude, longitude, tolerance)


def latest_location(spark: SparkSession, path: str) -> DataFrame:
    return newest_place(table(spark, path, "forecast_runs", "id long, latitude double, longitude double"))


def date_chunks(start: Column, end: Column, days: int) -> Column:
    """The windows, both ends inclusive, in which a span of dates is asked for: an array of (first, last)."""
    firsts = F.sequence(start, end, F.make_dt_interval(F.lit(days)))
    return F.transform(firsts, lambda a: F.struct(a.alias("first"), F.least(F.date_add(a, days - 1), end).alias("last")))


def _vintages(payload: DataFrame, cells: list[tuple[str, int, dict[str, str]]]) -> DataFrame:
    """Rows of archived answers: for each (source, days back, name of an array by column) and each of hourly.time, the values that stand there; a place whose first column is null gives no row."""
    names = sorted({n for _, _, columns in cells for n in columns.values()})
    parsed = payload.select(F.from_json("json", f"hourly STRUCT<time ARRAY<STRING>, {', '.join(f'`{n}` ARRAY<DOUBLE>' for n in names)}>").alias("j"))
    rows = parsed.select(F.posexplode("j.hourly.time").alias("i", "time"), "j.hourly")
    parts = [F.struct(F.lit(source).alias("source"), F.lit(k).alias("k"), *[F.get(F.col(f"hourly.`{n}`"), F.col("i")).alias(c) for c, n in columns.items()]) for source, k, columns in cells]
    first = next(iter(cells[0][2]))
    long = rows.select(F.to_timestamp("time").alias("valid"), F.explode(F.array(*parts)).alias("p")).select("valid", "p.*").where(F.col(first).isNotNull())
    return long.select("source", (F.col("valid") - F.make_dt_interval(F.col("k"))).alias("fetched"), "valid", *cells[0][2], F.lit("synthetic").alias("source_kind"))


def previous_runs(payload: DataFrame, models: list[str], variable: str = "temperature_2m", days: int = 7) -> DataFrame:
    """Backfilled forecasts out of archived API answers (json string: hourly.time and, per model and day offset, hourly.<variable>_previous_day<k>_<model>): what was valid at a time was fetched k days before it."""
    return _vintages(payload, [(f"open_meteo_{m}", k, {"x": f"{variable}_previous_day{k}_{m}"}) for m in models for k in range(1, days + 1)])


def ensemble_mean_runs(payload: DataFrame, model: str, variable: str = "temperature_2m", days: int = 7) -> DataFrame:
    """Archived means and spreads of an ensemble as vintages; what the archive doesn't have, percentiles and the number of members, stays null."""
    rows = _vintages(payload, [(model, k, {"mean": f"{variable}_previous_day{k}", "sd": f"{variable}_spread_previous_day{k}"}) for k in range(1, days + 1)])
    return rows.select(F.col("source").alias("model"), "fetched", "valid", "mean", "sd", *[F.lit(None).cast("double").alias(f"p{q}") for q in (10, 25, 50, 75, 90)], F.lit(None).cast("long").alias("n_members"))


def ensemble_statistics(members: DataFrame, key: list[str], value: str = "value") -> DataFrame:
    """Mean, sample deviation (null for one member), percentiles and the number of members of each key."""
    levels = (10, 25, 50, 75, 90)
    q = F.percentile(value, F.array(*[F.lit(v / 100) for v in levels]))
    stats = members.where(F.col(value).isNotNull()).groupBy(*key).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"), q.alias("q"), F.count("*").alias("n_members"))
    return stats.select(*key, "mean", "sd", *[F.col("q")[k].alias(f"p{v}") for k, v in enumerate(levels)], "n_members")


def nearest_cell(cells: DataFrame, latitude: float, longitude: float) -> DataFrame:
    """The distinct grid cell nearest to a place on each axis; longitudes run from 0 to 360. One row."""
    east = longitude % 360.0
    axis = lambda c, at: F.min_by(c, F.struct(F.abs(F.col(c) - at), F.col(c))).alias(c)
    return cells.agg(axis("latitude", latitude), axis("longitude", east))


def cycle_long(cells: DataFrame, latitude: float, longitude: float, source: str, lag_hours: int = 6) -> DataFrame:
    """Whole cycles of a gridded archive (init, lead_hours, latitude, longitude, member, u, v, temperature, pressure_pa; NaN where missing) as forecasts of a place: the nearest cell, the mean over members, the wind's speed out of its components, hPa. A cycle counts as fetched ``lag_hours`` after its start, and nothing before that is a forecast."""
    plain = lambda c: F.when(~F.isnan(c), F.col(c))
    here = cells.join(F.broadcast(nearest_cell(cells, latitude, longitude)), ["latitude", "longitude"])  # one row
    mean = here.groupBy("init", "lead_hours").agg(*[F.avg(plain(c)).alias(c) for c in ("u", "v", "temperature", "pressure_pa")])
    rows = mean.select(F.lit(source).alias("source"), (F.col("init") + F.make_dt_interval(hours=F.lit(lag_hours))).alias("fetched"), (F.col("init") + F.make_dt_interval(hours=F.col("lead_hours"))).alias("valid"), "temperature", F.sqrt(F.col("u") * F.col("u") + F.col("v") * F.col("v")).alias("wind_speed"), (F.col("pressure_pa") / 100).alias("pressure_sea"))
    return with_lead(rows).where("lead_hours >= 0").withColumn("source_kind", F.lit("synthetic"))


def neighbours(stations: DataFrame, latitude: float, longitude: float, elevation: float, radius_km: float, band_m: float, most: int = 8) -> DataFrame:
    """The stations nearest to a site, ``most`` of them, within a radius and a band of elevation, with their distance in km. The cap is the feature: a report on the nearest eight. Of equally far ones those of least ``stid`` count; for that, coordinates are decimals (12 places, a tenth of a micrometre), as in doubles two that mirror each other about the site differ in their last bits."""
    at = [F.col(c).try_cast("decimal(15,12)") for c in ("latitude", "longitude")]
    km = haversine_km(*at, *[F.lit(v).cast("decimal(15,12)") for v in (latitude, longitude)])
    near = stations.withColumn("km", km).where((F.col("km") <= radius_km) & (F.abs(F.col("elevation") - elevation) <= band_m))
    return near.orderBy("km", "stid").limit(most)


def lapse_adjusted(observations: DataFrame, near: DataFrame, elevation: float, per_km: float = 6.5) -> DataFrame:
    """Temperatures of the near stations as they would be at the site's elevation."""
    rows = observations.join(F.broadcast(near.select("stid", "elevation", "km")), "stid")  # ``most`` rows
    return rows.withColumn("temperature", F.col("temperature") + per_km * (F.col("elevation") - elevation) / 1000)
