"""Many small files: written by tasks, read back one row each."""

import os

import pytest

from tidemill.operators import checks, definitions
from tidemill.plans import queries
from tidemill.sources import files, scratch


def found(folder):
    return {os.path.relpath(os.path.join(at, name), folder): open(os.path.join(at, name)).read() for at, _, names in os.walk(folder) for name in names}


@pytest.fixture
def made(monkeypatch):
    """Scratch folders of a query, by name."""
    folders, own = {}, scratch.scratch_dir
    monkeypatch.setattr(queries, "scratch_dir", lambda spark, name: folders.setdefault(name, own(spark, name)))
    return folders


def in_few_folders(folder, n):
    """A file for each of n suppliers in folders of a thousand, and nothing beside them."""
    assert len(found(folder)) == n and sum(len(names) for _, names, _ in os.walk(folder)) == 1


def test_a_file_per_row(spark, tmp_path):
    df = spark.createDataFrame([(f"a={k % 3}/f{k}.txt", f"é\n{k}") for k in range(50)] + [("deep/er/none.txt", None), ("empty", "")], "path string, content string")
    assert files.write_text_files(df, f"{tmp_path}/out") == 52
    want = {r["path"]: r["content"] or "" for r in df.collect()}
    assert found(f"{tmp_path}/out") == want
    assert files.write_text_files(df.limit(5).selectExpr("path", "'new' AS content"), f"file://{tmp_path}/out", 2) == 5
    assert found(f"{tmp_path}/out") == want | {f"a={k % 3}/f{k}.txt": "new" for k in range(5)}
    assert files.write_text_files(df.limit(0), f"{tmp_path}/out") == 0


def test_metric_definitions_need_no_folder_each(spark, sf, made):
    got = queries.QUERIES["m1_load_metrics"](spark, sf)
    in_few_folders(made["definitions"], got.count())


def test_whole_texts_need_no_folder_each(spark, sf, made):
    got = queries.QUERIES["s19_read_text_files"](spark, sf)
    in_few_folders(made["whole"], got.count())


def test_watched_files_change_in_place(spark, sf, made):
    got = queries.QUERIES["st1_file_changes"](spark, sf)
    in_few_folders(made["watched"], got.count())
    assert {r["fired"] for r in got.collect()} == {1, 2}


def test_pipeline_definitions_need_no_folder_each(spark, sf, made):
    got = queries.QUERIES["p1_pipeline_inventory"](spark, sf)
    in_few_folders(made["definitions"], got.count())


def test_definitions_are_decoded_once(spark, tmp_path):
    """A sort of two partitions or more samples its input before it sorts it."""
    for k in range(40):
        (tmp_path / f"{k:02}.yaml").write_text(f"metric_name: m{k}\nsql: SELECT 1")
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    loaded = checks.load_metrics(spark, str(tmp_path))
    got = checks.list_metrics(loaded.mapInArrow(counted, loaded.schema)).collect()
    assert [r["metric_name"] for r in got] == [f"m{k}" for k in range(40)] and seen.value == 40


def test_small_files_share_tasks_and_are_decoded_once(spark, tmp_path):
    """Of 640 files no more than a task a core, for pipelines as for metrics; what was found needs the files no more."""
    for k in range(640):
        (tmp_path / f"{k:03}.yaml").write_text(f"pipeline_name: p{k}\ntasks: [{{name: a}}]\nmetric_name: m{k}\nsql: SELECT 1")
    tracker, cores = spark.sparkContext.statusTracker(), spark.sparkContext.defaultParallelism
    setting = spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        for load, name in ((definitions.pipeline_inventory, "pipeline_name"), (checks.load_metrics, "metric_name")):
            spark.sparkContext.setJobGroup(name, name)
            loaded = load(spark, str(tmp_path))
            assert {r[name] for r in loaded.collect()} == {f"{name[0]}{k}" for k in range(640)}
            stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(name) for s in tracker.getJobInfo(j).stageIds]
            assert max(s.numTasks for s in stages if s) <= cores
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert spark.conf.get("spark.sql.files.openCostInBytes") == setting
    for f in tmp_path.iterdir():
        f.unlink()
    assert loaded.count() == 640
