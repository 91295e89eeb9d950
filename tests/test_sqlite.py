"""What a SQLite source reads: filters in the statement, and logs that grow."""

import sqlite3

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, IsNotNull, LessThanOrEqual, Not, StringStartsWith

from weftcast.sources import archive


def archive_file(path, n=1000):
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE runs(id INTEGER, latitude REAL, longitude REAL, status TEXT, odd, at INTEGER)")
    con.executemany("INSERT INTO runs VALUES (?, ?, ?, ?, ?, ?)", [(k, 34.0 + k % 10, -117.0, None if k % 50 == 0 else "success" if k % 4 else "failed", str(k) if k % 2 else k, 1000 + k) for k in range(n)])
    con.commit()
    con.close()
    return path


SCHEMA = "id long, latitude double, longitude double, status string, odd long, at long, missing string"


def rows_read(df) -> int:
    """How many rows the scan has given to Spark."""
    df.collect()
    todo, found = [df._jdf.queryExecution().executedPlan()], 0
    while todo:
        node = todo.pop()
        if "AdaptiveSparkPlan" in node.nodeName():
            todo.append(node.finalPhysicalPlan())
        if "Scan" in node.nodeName():
            found += node.metrics().get("numOutputRows").get().value()
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return found


def test_filters_reach_sqlite(spark, tmp_path):
    df = archive.table(spark, archive_file(str(tmp_path / "a.db")), "runs", SCHEMA)
    plain = df.collect()
    cases = {
        "place": (archive.at_place(df, 37.0, -117.0), lambda r: r["latitude"] == 37.0),
        "status": (df.where("status = 'success'"), lambda r: r["status"] == "success"),
        "time": (df.where("at >= 1500 and at < 1510"), lambda r: 1500 <= r["at"] < 1510),
        "several": (df.where("id in (3, 5, 2000)"), lambda r: r["id"] in (3, 5)),
        "rowid": (archive.table(spark, str(tmp_path / "a.db"), "runs", "rowid long, id long").where("rowid <= 7"), lambda r: r["id"] < 7),
        "prefix": (df.where("status like 'fail%'"), lambda r: (r["status"] or "").startswith("fail")),
    }
    for name, (filtered, rule) in cases.items():
        want = sorted(r["id"] for r in plain if rule(r))
        assert sorted(r["id"] for r in filtered.collect()) == want, name
        assert rows_read(filtered) == len(want) < 1000, name
    assert rows_read(df) == 1000


def test_stored_types_dont_matter(spark, tmp_path):
    """A column without a type holds numbers and texts; both compare as what the schema says."""
    df = archive.table(spark, archive_file(str(tmp_path / "a.db"), 60), "runs", SCHEMA)
    assert sorted(r["odd"] for r in df.where("odd between 10 and 20").collect()) == list(range(10, 21))
    assert df.where("missing = 'x'").count() == 0 and df.where("missing is null").count() == 60
    assert df.where("status is null").count() == 2 and df.where("not status = 'success'").count() == sum(1 for k in range(60) if k % 50 and k % 4 == 0)
    assert df.where(F.col("status").isNotNull() & (F.length("status") > 6)).count() == df.where("status = 'success'").count()


def test_conditions(tmp_path):
    path = archive_file(str(tmp_path / "a.db"), 20)
    reader = archive.SqliteSource({"path": path, "table": "runs"}).reader(archive.SqliteSource({"path": path, "table": "runs"}).schema())
    filters = [EqualTo(("status",), "success"), GreaterThan(("id",), 3), LessThanOrEqual(("odd",), "9"), In(("id",), (4, 5)), IsNotNull(("status",)), StringStartsWith(("status",), "su"), Not(EqualTo(("id",), 4)), EqualTo(("gone",), 1), EqualTo(("id",), True)]
    assert list(reader.pushFilters(filters)) == filters  # Spark checks all of them again
    assert [c for c, _ in reader.conditions] == ['"status" = ?', '"id" > ?', 'CAST("odd" AS TEXT) <= ?', '"id" IN (?, ?)', '"status" IS NOT NULL', 'substr("status", 1, ?) = ?']
    assert [row[0] for p in reader.partitions() for row in reader.read(p)] == [5]


@pytest.mark.parametrize("partitions", [1, 3])
def test_a_log_is_tailed(spark, tmp_path, partitions):
    path = archive_file(str(tmp_path / "a.db"), 10)
    seen, checkpoint = [], str(tmp_path / "checkpoint")

    def started():
        stream = archive.tail(spark, path, "runs", "rowid long, id long, status string", partitions)
        return stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda df, k: seen.append(sorted(r["id"] for r in df.collect()))).start()

    def grown(*ids):
        con = sqlite3.connect(path)
        con.executemany("INSERT INTO runs VALUES (?, 1, 1, 'new', 0, 0)", [(k,) for k in ids])
        con.commit()
        con.close()

    query = started()
    query.processAllAvailable()
    grown(100, 101)
    query.processAllAvailable()
    query.stop()
    grown(102)
    query = started()  # goes on where it was
    query.processAllAvailable()
    query.stop()
    flat = [k for batch in seen for k in batch]
    assert sorted(flat) == [*range(10), 100, 101, 102] and seen[-1] == [102] or seen[-2] == [102]


def test_a_table_that_comes_later_is_tailed(spark, tmp_path):
    path = str(tmp_path / "b.db")
    sqlite3.connect(path).close()
    con = sqlite3.connect(path)
    con.execute("CREATE TABLE other(x INTEGER)")
    con.commit()
    tail = archive.SqliteTail({"path": path, "table": "runs"}, archive.SqliteSource({"path": path, "table": "other"}).schema())
    start = tail.initialOffset()
    assert start == tail.latestOffset() == {"rowid": 0}
    con.execute("CREATE TABLE runs(x INTEGER)")
    con.execute("INSERT INTO runs VALUES (7)")
    con.commit()
    con.close()
    end = tail.latestOffset()
    assert [row for p in tail.partitions(start, end) for row in tail.read(p)] == [(7,)]
