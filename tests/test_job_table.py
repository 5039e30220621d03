"""Copy-on-write merges against a dictionary."""

import random

from fieldtrust.operators.job_table import JobTable

DDL = "job_id string, updated_ord long, status string"


def test_merges_equal_a_dictionary(spark, tmp_path):
    rng, stored, want = random.Random(1), JobTable(spark, str(tmp_path / "t"), buckets=4), {}
    batches = [[(f"j{rng.randrange(60)}", rng.randrange(1000), f"s{i}-{n}") for n in range(40)] for i in range(4)]
    for batch in (*batches, batches[3], batches[0]):  # repeated and late
        once = {}
        for job, order, status in batch:
            if order >= once.get(job, (-1,))[0]:
                once[job] = (order, status)
        rows = [(job, *state) for job, state in once.items()]
        for job, order, status in rows:
            if order > want.get(job, (-1,))[0]:
                want[job] = (order, status)
        stored.upsert(spark.createDataFrame(rows + [(None, 1, "x"), ("k", None, "x")], DDL).repartition(3))
        assert {r["job_id"]: (r["updated_ord"], r["status"]) for r in stored.read().collect()} == want


def test_only_touched_buckets_are_written(spark, tmp_path):
    stored = JobTable(spark, str(tmp_path / "t"), buckets=8)
    assert stored.read() is None and stored.vacuum() == []
    many = spark.createDataFrame([(f"j{i}", 1, "a") for i in range(200)], DDL)
    assert stored.upsert(many) == 8 and stored.upsert(many.limit(1)) == 1 and stored.upsert(many.filter("false")) == 0
    assert len(list((tmp_path / "t" / "data" / "v=2").glob("bucket=*"))) == 1
    stored.upsert(many)
    assert stored.vacuum(1) == [1, 2] and stored.read().count() == 200 and stored.vacuum(1) == []


def test_commits_without_manifest_are_not_seen(spark, tmp_path):
    stored = JobTable(spark, str(tmp_path / "t"), buckets=2)
    stored.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], DDL))
    lost = JobTable(spark, str(tmp_path / "t"), buckets=2)
    lost.upsert(spark.createDataFrame([("a", 2, "y"), ("b", 2, "y")], DDL))
    (tmp_path / "t" / "manifest" / "v=2" / "_SUCCESS").unlink()  # the writer died before its manifest was whole
    assert {r["status"] for r in stored.read().collect()} == {"x"}
    stored.upsert(spark.createDataFrame([("a", 3, "z")], DDL))
    assert {r["job_id"]: r["status"] for r in stored.read().collect()} == {"a": "z", "b": "x"}


def test_columns_may_come_later(spark, tmp_path):
    stored = JobTable(spark, str(tmp_path / "t"), buckets=2)
    stored.upsert(spark.createDataFrame([("a", 1, "x"), ("b", 1, "x")], DDL))
    stored.upsert(spark.createDataFrame([("a", 2, "y", 7)], DDL + ", extra int"))
    assert {r["job_id"]: r["extra"] for r in stored.read().collect()} == {"a": 7, "b": None}
