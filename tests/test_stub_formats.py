"""Connectors that are not on the classpath: options, schemas and rows by stub formats."""

import json

import pytest
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, SimpleDataSourceStreamReader, WriterCommitMessage

from tidemill.sources import external, files
from tidemill.streaming import streams


class Warehouse(DataSource):
    """Reads rows that tell the options it was given; writes rows as JSON lines to the folder of option ``out``."""

    @classmethod
    def name(cls):
        return "stub_warehouse"

    def schema(self):
        return "name string, given string"

    def reader(self, schema):
        return Told(dict(self.options))

    def writer(self, schema, overwrite):
        return Lines(dict(self.options), overwrite)


class Told(DataSourceReader):
    def __init__(self, options):
        self.options = options

    def read(self, partition):
        for k in range(60):
            for name, given in sorted(self.options.items()):
                yield name.lower(), given


class Lines(DataSourceWriter):
    def __init__(self, options, overwrite):
        self.options, self.overwrite = options, overwrite

    def write(self, rows):
        from pyspark import TaskContext

        with open(f"{self.options['out']}/{TaskContext.get().taskAttemptId()}.json", "w") as f:
            for r in rows:
                f.write(json.dumps([self.options["table"], self.overwrite, *r]) + "\n")
        return WriterCommitMessage()


class Topic(DataSource):
    @classmethod
    def name(cls):
        return "stub_topic"

    def schema(self):
        return "key binary, value binary, topic string, partition int, offset long, timestamp timestamp"

    def simpleStreamReader(self, schema):
        return Messages(dict(self.options))


class Messages(SimpleDataSourceStreamReader):
    def __init__(self, options):
        self.options = {k.lower(): v for k, v in options.items()}

    def initialOffset(self):
        return {"at": 0}

    def read(self, start):
        return self.readBetweenOffsets(start, {"at": 5}), {"at": 5}

    def readBetweenOffsets(self, start, end):
        sent = {k: self.options[k] for k in ("subscribe", "startingoffsets", "kafka.bootstrap.servers")}
        return iter([(None, json.dumps({"k": k, **sent}).encode() if k != 3 else b"no json", "t", 0, k, None) for k in range(start["at"], end["at"])])


STUB = {"fmt": "stub_warehouse"}


@pytest.fixture(scope="module")
def own(spark):
    spark.dataSource.register(Warehouse)
    spark.dataSource.register(Topic)
    return spark


def test_warehouse_queries_are_limited(own):
    got = external.bq_query(own, "my-project", "SELECT 1", **STUB, materializationDataset="d")
    assert got.count() == 100 and external.bq_query(own, "p", "SELECT 1", None, **STUB).count() > 100
    told = {r["name"]: r["given"] for r in got.collect()}
    assert told["parentproject"] == "my-project" and told["query"] == "SELECT 1" and told["viewsenabled"].lower() == "true" and told["materializationdataset"] == "d"


def test_warehouse_loads_and_exports(own, tmp_path):
    (tmp_path / "out").mkdir()
    df = own.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    external.bq_load(df, "set.table", **STUB, out=f"{tmp_path}/out")
    external.bq_load(df.limit(1), "set.other", "overwrite", **STUB, out=f"{tmp_path}/out")
    rows = sorted((json.loads(line) for f in (tmp_path / "out").iterdir() for line in f.read_text().splitlines()), key=repr)
    assert [r for r in rows if r[0] == "set.table"] == [["set.table", False, 1, "a"], ["set.table", False, 2, None]] and [r[:2] for r in rows if r[0] == "set.other"] == [["set.other", True]]
    n = external.bq_export(own, "set.table", f"{tmp_path}/csv", **STUB, credentials="c")
    back = files.read_source(own, f"{tmp_path}/csv", "csv")
    assert n == back.count() and {(r["name"], r["given"]) for r in back.collect()} >= {("path", "set.table"), ("credentials", "c")}


def test_topics_are_read_from_the_earliest_message(own):
    stream = streams.kafka_stream(own, "h:9092", "orders", "k int, subscribe string, startingoffsets string", "stub_topic")
    got = sorted(map(tuple, streams.drain(stream.select("value.*", "offset", "partition")).collect()), key=lambda r: r[3])
    assert got == [(k, "orders", "earliest", k, 0) if k != 3 else (None, None, None, 3, 0) for k in range(5)]


def test_names_and_addresses_of_other_databases(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(external, "load_whole", lambda df, url, conn, options, name, stage_in, mode, mark, **given: seen.update(url=url, name=name, stage_in=stage_in, mode=mode, mark=mark, options=options, **given))
    mysql = {"dialect": "mysql", "host": "db", "database": "shop", "user": "u", "password": "p"}
    external.jdbc_load(spark.range(3), mysql, "odd schema.ta`ble", batch_size=500, partitions=3)
    assert seen["url"] == "jdbc:mysql://db:3306/shop" and seen["name"] == "`odd schema`.`ta``ble`" and seen["stage_in"] == "`odd schema`." and seen["mark"] == "`"
    assert seen["batchsize"] == 500 and seen["numPartitions"] == 3 and seen["options"] == {"url": "jdbc:mysql://db:3306/shop", "user": "u", "password": "p"}
    external.jdbc_load(spark.range(3), {"dialect": "postgres", "database": "d", "port": 1}, "t", "truncate", quote=False)
    assert seen["url"] == "jdbc:postgresql://localhost:1/d" and seen["name"] == "t" and seen["stage_in"] == "" and seen["mode"] == "truncate" and seen["mark"] == '"'
    with pytest.raises(Exception, match="(?i)driver|mysql"):
        external.jdbc_query(spark, mysql, "SELECT 1").collect()
