"""Batches and loads that fail, run twice or are sent again."""

import shutil

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.sql import functions as F

from tidemill.sources import external, files, history, loads
from tidemill.streaming import streams


def audit(spark, n, first=0, day="2024-01-01"):
    return spark.range(first, first + n).selectExpr("id", f"TIMESTAMP '{day}' + make_dt_interval(CAST(id AS INT)) AS occurred_at").repartition(3)


def ids(spark, folder):
    return sorted(r["id"] for r in files.read_history(spark, str(folder), "audit_log").collect())


def test_a_batch_lands_once(spark, tmp_path):
    assert history.append_once(audit(spark, 5), str(tmp_path), "audit_log", "q", 0)
    assert not history.append_once(audit(spark, 5), str(tmp_path), "audit_log", "q", 0)
    assert history.append_once(audit(spark, 5), str(tmp_path), "audit_log", "other", 0) and ids(spark, tmp_path) == sorted([*range(5)] * 2)
    assert files.read_history(spark, str(tmp_path), "audit_log").filter("date = DATE '2024-01-03'").count() == 2
    for k in range(1, 15):
        assert history.append_once(audit(spark, 1, 100 + k), str(tmp_path), "audit_log", "q", k)
    assert not history.append_once(audit(spark, 1), str(tmp_path), "audit_log", "q", 3)
    assert len(list((tmp_path / "audit_log" / "_batches" / "q").iterdir())) <= history.KEPT + 1
    assert history.append_once(audit(spark, 0), str(tmp_path), "audit_log", "empty", 0) and len(ids(spark, tmp_path)) == 24
    with pytest.raises(ValueError):
        history.append_once(audit(spark, 1), str(tmp_path), "audit_log", "../q", 0)


@pytest.mark.parametrize("broken", ["write", "move"])
@pytest.mark.parametrize("after", [0, 1, 2])
def test_a_batch_that_failed_is_completed(spark, tmp_path, monkeypatch, broken, after):
    """Whatever step fails, the batch sent again, at another time, leaves the same rows once."""
    calls, real = [], getattr(history._Folder, broken)

    def failing(self, *a):
        calls.append(a)
        if len(calls) == after + 1:
            raise OSError("lost")
        return real(self, *a)

    monkeypatch.setattr(history._Folder, broken, failing)
    if broken == "write" and after == 2:
        assert history.append_once(audit(spark, 6), str(tmp_path), "audit_log", "q", 0)
    else:
        with pytest.raises(OSError):
            history.append_once(audit(spark, 6), str(tmp_path), "audit_log", "q", 0)
    history.append_once(audit(spark, 6, day="2024-02-01"), str(tmp_path), "audit_log", "q", 0)
    assert ids(spark, tmp_path) == list(range(6))


def test_a_stream_replays_without_doubling(spark, tmp_path):
    audit(spark, 4).coalesce(1).write.parquet(f"{tmp_path}/in")
    rules = [{"name": "n", "sql": "SELECT count(*) FROM data", "expect_min": 1}]

    def run():
        stream = streams.table_stream(spark, f"{tmp_path}/in", per_trigger=1)
        history.history_stream(stream, f"{tmp_path}/h", "audit_log", f"{tmp_path}/c1").awaitTermination()
        streams.quality_stream(stream, rules, f"{tmp_path}/h", f"{tmp_path}/c2").awaitTermination()
        return len(ids(spark, f"{tmp_path}/h")), files.read_history(spark, f"{tmp_path}/h", "quality_results").count()

    assert run() == (4, 1)
    for c in ("c1", "c2"):
        shutil.rmtree(tmp_path / c / "commits")
    assert run() == (4, 1)
    audit(spark, 4, 10).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run() == (8, 2) == run()


@pytest.fixture
def db(tmp_path):
    return {"url": f"jdbc:derby:{tmp_path}/db;create=true", "driver": "org.apache.derby.jdbc.EmbeddedDriver"}


def read(spark, db, table="T"):
    return sorted(tuple(r) for r in external.jdbc_query(spark, db, f"SELECT ID, V FROM {table}").collect())


def tables(spark, db):
    return [r[0] for r in external.jdbc_query(spark, db, "SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'").collect()]


def test_one_bad_row_leaves_the_target(spark, db):
    loads.transaction(spark, db["url"], db, ["CREATE TABLE T (ID INT NOT NULL PRIMARY KEY, V VARCHAR(5) CHECK (V <> 'bad'))"])
    make = lambda *r: spark.createDataFrame(r, "id int, v string").repartition(4)
    assert external.jdbc_load(make((1, "a"), (2, "b")), db, "T") == 2
    for bad in ((3, "bad"), (1, "again"), (4, "much too long")):
        for mode in ("append", "truncate"):
            with pytest.raises((Py4JJavaError, Exception)):
                external.jdbc_load(make(*[(10 + k, "x") for k in range(50)], bad, *([bad] if bad[0] == 1 else [])), db, "T", mode)
            assert read(spark, db) == [(1, "a"), (2, "b")]
    broken = make(*[(k, "x") for k in range(20, 60)]).withColumn("id", F.expr("id + CAST(1 / (id - 50) AS INT)"))
    for mode in ("append", "overwrite", "truncate"):
        with pytest.raises(Exception, match="(?i)divi"):
            external.jdbc_load(broken, db, "T", mode)
    assert read(spark, db) == [(1, "a"), (2, "b")] and tables(spark, db) == ["T"]
    assert external.jdbc_load(make((7, "new")), db, "T", "truncate") == 1 and read(spark, db) == [(7, "new")]
    assert external.jdbc_load(spark.createDataFrame([(8, "in a new table")], "ID int, V string"), db, "T", "overwrite", createTableColumnTypes="V VARCHAR(30)") == 1 and read(spark, db) == [(8, "in a new table")]
    assert external.jdbc_load(make(), db, "T") == 0 and tables(spark, db) == ["T"]


def test_a_task_that_ran_twice_doubles_nothing(spark, db, monkeypatch):
    """Attempts of a task that sent all, of one cut off, and of one that came twice: the first complete one counts."""
    real = loads.tagged

    def twice(df):
        once = spark.createDataFrame(real(df).collect(), real(df).schema)
        again = once.withColumn(loads.ATTEMPT, F.col(loads.ATTEMPT) + 1000)
        cut_off = once.filter(F.col(loads.ROWS).isNull()).withColumn(loads.ATTEMPT, F.lit(-1).cast("long"))
        return once.unionByName(again).unionByName(cut_off)

    monkeypatch.setattr(loads, "tagged", twice)
    df = spark.createDataFrame([(k % 40, f"v{k}") for k in range(100)], "ID int, V string").repartition(5)
    assert external.jdbc_load(df, db, "T", "overwrite", createTableColumnTypes="V VARCHAR(9)", partitions=20) == 100
    assert external.jdbc_load(df.limit(30), db, "T") == 30
    assert read(spark, db) == sorted([*map(tuple, df.collect()), *map(tuple, df.limit(30).collect())])


def test_rows_are_never_lost_silently(spark, db, monkeypatch):
    df, real = spark.createDataFrame([(k, "v") for k in range(40)], "ID int, V string").repartition(8), loads.tagged
    assert external.jdbc_load(df, db, "T", "overwrite", partitions=3) == 40
    monkeypatch.setattr(loads, "tagged", lambda df: real(df).withColumn(loads.ROWS, F.lit(None).cast("long")))
    with pytest.raises(RuntimeError, match="complete"):
        external.jdbc_load(df, db, "T")
    assert len(read(spark, db)) == 40 and tables(spark, db) == ["T"]


def test_statements_of_other_databases():
    sql = loads.move_statements("jdbc:mysql://h/d", "`s`", "`t`", ["a`b"], ["a`b"], True, False, True, "`")
    assert sql[:2] == ["DROP TABLE `t`", "CREATE TABLE `t` AS SELECT `a``b` FROM `s` WHERE 1 = 0"] and sql[2].startswith("INSERT INTO `t` (`a``b`) SELECT s.`a``b` FROM `s` s JOIN (")
