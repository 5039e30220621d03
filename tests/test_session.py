"""The shared folder and its scopes."""

import glob
import os
import time

from fieldtrust.session import fresh_path, materialised, scratch, shared_dir


def test_scratch_deletes_what_was_written_inside(spark):
    before = fresh_path(spark, "x")
    with scratch(spark) as folder:
        kept = materialised(spark.range(5).toDF("i"), "rows")
        assert kept.count() == 5
        assert fresh_path(spark, "y").startswith(folder)
        local = folder.removeprefix("file://")
        assert os.path.isdir(local)
    assert not os.path.exists(local)
    assert fresh_path(spark, "x").rsplit("/", 1)[0] == before.rsplit("/", 1)[0] == shared_dir(spark)


def test_nested_scopes(spark):
    with scratch(spark) as outer:
        rows = materialised(spark.range(3).toDF("i"), "rows")
        with scratch(spark) as inner:
            assert inner.startswith(outer)
            materialised(spark.range(4).toDF("i"), "rows")
        assert rows.count() == 3


def test_lean_tables_leave_no_shuffle_behind(spark):
    def shuffled():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
        return {files.apply(i).getName() for i in range(files.size())}

    conf = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    setting, before = spark.conf.get(conf), shuffled()
    with scratch(spark) as folder:
        rows = materialised(spark.range(2000).repartition("id").toDF("i"), "rows", lean=True)
        assert sorted(r["i"] for r in rows.collect()) == list(range(2000))
        files = glob.glob(f"{folder.removeprefix('file://')}/rows-*/part-*")
        assert files and all(".zstd." in f for f in files)
    until = time.time() + 20
    while (left := {f for f in shuffled() - before if f.startswith("shuffle_")}) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(conf) == setting
