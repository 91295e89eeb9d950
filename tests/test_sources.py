"""Sources and sinks: what a crash, a second writer or an odd file may not do."""

import json
import sqlite3

import duckdb
import pytest
from pyspark.sql import functions as F

from weftcast.plans import registry
from weftcast.sources import archive, scratch, sinks


def log_file(path, rows):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE observations(ts TEXT, outTemp REAL)")
    con.executemany("INSERT INTO observations VALUES (?, ?)", rows)
    con.commit()
    con.close()


def test_the_first_of_equal_times_stays(spark, tmp_path):
    path = str(tmp_path / "log.db")
    log_file(path, [(f"2024-01-01 00:{k % 20:02d}:00", 32 + 1.8 * k) for k in range(600)])
    rows = archive.table(spark, path, "observations", "rowid long, ts string", partitions=7)
    assert sorted(r["rowid"] for r in rows.collect()) == list(range(1, 601))
    got = archive.station(spark, path, {"temp_c": ("outTemp", "degF")}).orderBy("ts").collect()
    assert [round(r["temp_c"], 6) for r in got] == list(range(20))


def test_a_frozen_copy_stays_as_it_was(spark, tmp_path):
    path = str(tmp_path / "log.db")
    log_file(path, [("2024-01-01 00:00:00", 50.0)])
    copy = archive.frozen(path, str(tmp_path))
    con = sqlite3.connect(path)
    con.execute("DELETE FROM observations")
    con.commit()
    con.close()
    assert archive.table(spark, copy, "observations").count() == 1 and archive.table(spark, path, "observations").count() == 0


def test_daily_and_minutely_points(spark, tmp_path):
    path = str(tmp_path / "a.db")
    con = sqlite3.connect(path)
    con.executescript("""CREATE TABLE forecast_runs(id INTEGER, latitude REAL, longitude REAL, completed_at TEXT); INSERT INTO forecast_runs VALUES (1, 34.0, -117.0, '2024-01-01T00:10:00+00:00');
        CREATE TABLE provider_results(id INTEGER, run_id INTEGER, provider TEXT, status TEXT, fetched_at TEXT); INSERT INTO provider_results VALUES (1, 1, 'p', 'success', '2024-01-01T00:00:00+00:00');
        CREATE TABLE source_forecasts(id INTEGER, provider_result_id INTEGER, model TEXT); INSERT INTO source_forecasts VALUES (1, 1, 'm');
        CREATE TABLE daily_points(source_forecast_id INTEGER, forecast_date TEXT, temperature_max REAL); INSERT INTO daily_points VALUES (1, '2024-01-02', 9), (1, 'soon', 8), (1, NULL, 7);
        CREATE TABLE minutely_points(source_forecast_id INTEGER, timestamp_unix INTEGER, precipitation_intensity REAL); INSERT INTO minutely_points VALUES (1, 1704067260, 0.5);""")
    con.commit()
    con.close()
    assert [(r["source"], str(r["valid_date"]), r["temperature_max"]) for r in archive.daily_forecasts(spark, path, 34.0, -117.0).collect()] == [("p_m", "2024-01-02", 9.0)]
    m = archive.minutely_forecasts(spark, path, 34.0, -117.0).collect()
    assert [(r["precipitation_intensity"], r["precipitation_probability"], round(r["lead_hours"] * 60, 6)) for r in m] == [(0.5, None, 1.0)]
    assert archive.daily_forecasts(spark, path, 34.0, -117.0, allowed=["q"]).count() == 0


def test_a_second_writer_is_told(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([(1,)], "k long")
    sinks.write_dataset({"t": rows}, path)
    base, manifest = sinks.newest_manifest(spark, path)
    sinks.write_dataset({"t": rows.union(rows)}, path)
    with pytest.raises(sinks.Conflict):
        sinks.write_dataset({"t": rows}, path, base)
    assert sinks.read_dataset(spark, path, "t").count() == 2
    assert manifest["tables"]["t"]["rows"] == 1


def test_a_writer_that_died_stops_nobody(spark, tmp_path):
    path = str(tmp_path / "d")
    rows = spark.createDataFrame([(1,)], "k long")
    sinks.write_dataset({"t": rows}, path)
    sinks._Files(spark, f"{path}/manifests").claim("000000002.claim")  # claimed, and then nothing
    assert sinks.read_dataset(spark, path, "t").count() == 1
    sinks.write_dataset({"t": rows.union(rows)}, path)
    assert sinks.read_dataset(spark, path, "t").count() == 2 and sinks.newest_manifest(spark, path)[0] == 3


def test_an_evaluation_is_written_once(spark, tmp_path):
    path = str(tmp_path / "scores")
    rows = spark.createDataFrame([(1.0,)], "p double")
    sinks.append_scores(rows, path, "e1")
    with pytest.raises(Exception, match="exists"):
        sinks.append_scores(rows, path, "e1")
    with pytest.raises(ValueError):
        sinks.append_scores(rows, path, "../e2")


def test_a_failed_run_ledger_stops_nobody(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5)], "k long, t long")
    assert sinks.append_run(rows, str(tmp_path / "runs"), ["k"], "t", 10, 90) == 1
    assert sinks.append_run(rows, str(tmp_path / "runs"), ["no such key"], "t", 10, 90) == -1


def test_a_run_ledger_is_bounded_by_what_is_asked_for(spark, tmp_path):
    rows = spark.createDataFrame([(1, 5), (1, 6), (2, 200), (3, 201), (3, 201), (None, 202), (None, 202)], "k long, t long")
    for keep, want in ((None, [2, 3, 3, None, None]), (3, [3, None, None])):
        path = str(tmp_path / f"runs-{keep}")
        assert sinks.append_run(rows, path, ["k"], "t", 202, 90, keep) == 7
        got = [r["k"] for r in sinks.read_dataset(spark, path, "ledger").collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert sinks.append_run(rows, path, ["k"], "t", 202, 90, None) == 3
    assert sinks.append_ledger(rows, str(tmp_path / "ledger"), ["k"], "t", 202, 90) == 7
    assert sinks.read_dataset(spark, str(tmp_path / "ledger"), "ledger").count() == 5


@pytest.mark.parametrize("many", [60_000, 0])
def test_the_run_ledger_query_keeps_every_run_of_its_days(spark, tmp_path, many):
    """As its SQL: more than 50,000 runs, runs that share a key or have none, and none without a time."""
    day = lambda c: F.expr(f"timestamp '2024-01-01' + make_dt_interval({c})")
    odd = spark.createDataFrame([(7, 0), (7, 0), (None, 1), (None, 1), (-1, -90), (-2, -91), (-3, None)], "o_orderkey long, n int")
    rows = spark.range(many).select(F.col("id").alias("o_orderkey"), (-(F.col("id") % 100)).cast("int").alias("n")).union(odd if many else odd.where("n is null"))
    rows.select("o_orderkey", day("n - 1").alias("o_orderdate")).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = [tuple(r) for r in registry.queries()["snk9_run_ledger"](spark, str(tmp_path)).select("k", "t").collect()]
    assert sorted(got, key=str) == sorted(con.execute(registry.oracle_sql()["snk9_run_ledger"]).fetchall(), key=str)
    assert len(got) > 50_000 or not many


def test_days_of_the_run_ledger_are_those_of_its_sql(spark, tmp_path):
    times = ["1970-01-01 12:00:00", "1969-12-31 12:00:00", "1970-01-01 23:59:59.4", "1970-01-01 23:59:59.5", "1970-01-02 23:59:59.500001", "1969-10-03 12:00:00", "1969-10-04 00:00:00", None]
    rows = spark.createDataFrame(list(enumerate(times)), "o_orderkey long, o_orderdate string")
    rows.withColumn("o_orderdate", F.col("o_orderdate").cast("timestamp_ntz")).write.parquet(str(tmp_path / "orders.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    got = registry.queries()["snk9_run_ledger"](spark, str(tmp_path)).select("k", "t").collect()
    assert sorted(map(tuple, got)) == sorted(con.execute(registry.oracle_sql()["snk9_run_ledger"]).fetchall())


def test_equally_far_neighbours_go_by_their_id(spark):
    """0.02 degrees east and west of the site, and a fifth of that: in doubles the sums below miss it by their last bits."""
    for west, east in ((-117 + 2 * 0.04, -117 + 3 * 0.04), (-116.9 - 0.004, -116.9 + 0.004)):
        for ids in ((1, 2, 3, 4), (4, 3, 2, 1), (1, 3, 2, 4)):
            rows = [(k, 34 + 4 * 0.05, lon, 1400.0) for k, lon in zip(ids, (west, west, east, east))] + [(0, float("nan"), west, 1400.0), (-1, 34.2, None, 1400.0)]
            stations = spark.createDataFrame(rows, "stid long, latitude double, longitude double, elevation double")
            got = archive.neighbours(stations, 34.2, -116.9, 1400.0, 40.0, 300.0, 2).collect()
            assert sorted(r["stid"] for r in got) == [1, 2] and len({r["km"] for r in got}) == 1


@pytest.mark.parametrize("users", [1_500, 6_000])
def test_the_neighbour_scan_chooses_the_stations_of_its_sql(spark, tmp_path, users):
    rows = spark.range(users * 3).select(F.col("id").alias("event_id"), (F.col("id") % users).alias("user_id"), F.expr("timestamp '1970-01-01' + make_dt_interval(0, 0, id % 180 - 90)").alias("ts"), (F.col("id") % 97 / 4).alias("value"))
    rows.write.parquet(str(tmp_path / "events.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    columns = ["stid", "hour", "temperature", "km"]
    got = sorted(tuple(r) for r in registry.queries()["src14_neighbour_scan"](spark, str(tmp_path)).select(columns).collect())
    want = sorted(con.execute(f"SELECT {', '.join(columns)} FROM ({registry.oracle_sql()['src14_neighbour_scan']})").fetchall())
    assert got == want and len({r[0] for r in got}) == 8


def test_documents_and_states(spark, tmp_path):
    text = json.dumps({"a": [1, 2.5, None]}) + "\n"
    sinks.archive_document(spark, str(tmp_path / "docs"), "2024-01-01", text)
    assert sinks.archived_document(spark, str(tmp_path / "docs"), "2024-01-01") == text
    with pytest.raises(sinks.Conflict):
        sinks.archive_document(spark, str(tmp_path / "docs"), "2024-01-01", "other")
    states = sinks.States(spark, str(tmp_path / "states"))
    assert states.load("m/x") is None
    assert [states.save("m/x", {"n": k}) for k in range(5)] == [1, 2, 3, 4, 5]
    assert states.load("m/x") == {"n": 4} and states.reclaim("m/x", 2) == 3 and states.load("m/x") == {"n": 4}
    with pytest.raises(ValueError):
        states.save("m/../../x", {})
    with pytest.raises(ValueError):
        states.save("m/x", {"n": float("nan")})


def test_a_lock_keeps_others_out(spark, tmp_path):
    folder = str(tmp_path / "l")
    with sinks.lock(spark, folder):
        with pytest.raises(sinks.Conflict):
            with sinks.lock(spark, folder):
                pass
    with sinks.lock(spark, folder):
        pass


def test_prunable_scores_by_age_of_release(spark):
    files = spark.createDataFrame([("g", f"e{k}", k) for k in range(6)], "group string, evaluation string, created long")
    released = spark.createDataFrame([("e0", 100), ("e1", 90)], "evaluation string, released long")
    assert {r["evaluation"] for r in sinks.removable_scores(files, released, now=101).collect()} == {"e1", "e2"}


def test_tables_go_to_the_shared_folder(spark):
    df = scratch.settled(spark.range(3).withColumn("x", F.col("id")), "numbers")
    assert df.count() == 3 and scratch.session_dir(spark).removeprefix("file:").lstrip("/") in df.inputFiles()[0]


def test_settings_fail_closed(tmp_path):
    from weftcast import config

    def of(text):
        path = tmp_path / "c.toml"
        path.write_text(text)
        return config.loaded(str(path))

    assert of("") == config.Settings()
    got = of('[station]\nlatitude = 50\ntimezone = "Europe/Berlin"\n[forecasts]\nlead_caps = {nbm = 36}\nexcluded = [["a", "wind"]]\n')
    assert got.latitude == 50.0 and got.timezone == "Europe/Berlin" and got.lead_caps == {"nbm": 36.0} and got.excluded == (("a", "wind"),)
    for bad in ("[station]\nlatitude = 91", "[station]\nlatitude = true", "[station]\nlat = 1", "[backtest]\nstep_days = 1.5", "[promotion]\nalpha = nan", '[station]\ntimezone = "Nowhere/There"', "latitude = 1", "[forecasts]\nexcluded = [1]"):
        with pytest.raises(Exception):
            of(bad)
