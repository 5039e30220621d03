"""A stored table with one row per key, changed by copy-on-write of the buckets that changes touch.

Keys are dealt over a fixed number of buckets by hash. A commit reads the touched buckets, keeps of each key the row
that is last in order, writes them as a new version and then a manifest that names every bucket's version. A reader sees
the newest whole manifest, so it never meets half a commit, and reads one version of each bucket however many
commits there were. As the last row wins, commits may be repeated or come late without harm.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtrust.session import materialised


class JobTable:
    """The table below ``path``: ``data/v=<version>/bucket=<b>`` and ``manifest/v=<version>``. One writer at a time."""

    def __init__(self, spark: SparkSession, path: str, key: str = "job_id", order: str = "updated_ord", buckets: int = 64):
        self.spark, self.path, self.key, self.order, self.buckets = spark, path.rstrip("/"), key, order, buckets

    def _hadoop(self, name: str) -> tuple[object, object]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return path, path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf())

    def _versions(self, folder: str, mark: str = "") -> list[int]:
        """Versions below a folder, ascending; with ``mark`` those that hold such a file."""
        pattern, system = self._hadoop(f"{folder}/v=*{mark}")
        found = system.globStatus(pattern) or []
        return sorted(int(str(f.getPath()).removesuffix(mark).rsplit("v=", 1)[1]) for f in found)

    def _manifest(self, version: int) -> dict[int, int]:
        """Version of each bucket; a row per bucket."""
        rows = self.spark.read.schema("bucket int, version long").parquet(f"{self.path}/manifest/v={version}").collect()
        return {r["bucket"]: r["version"] for r in rows}

    def _current(self) -> tuple[int, dict[int, int]]:
        whole = self._versions("manifest", "/_SUCCESS")
        return (whole[-1], self._manifest(whole[-1])) if whole else (0, {})

    def _read(self, places: dict[int, int]) -> DataFrame | None:
        if not places:
            return None
        paths = [f"{self.path}/data/v={v}/bucket={b}" for b, v in sorted(places.items())]
        return self.spark.read.option("basePath", f"{self.path}/data").option("mergeSchema", "true").parquet(*paths).drop("v")

    def read(self) -> DataFrame | None:
        """The rows; None before the first commit."""
        rows = self._read(self._current()[1])
        return rows if rows is None else rows.drop("bucket")

    def upsert(self, changes: DataFrame) -> int:
        """Merges ``changes`` by key and order; the number of buckets written.

        Rows without a key or an order are left out. Of rows equal in both any one stays. Columns may be added later;
        they are NULL in rows written before.
        """
        keyed = changes.filter(F.col(self.key).isNotNull() & F.col(self.order).isNotNull())
        keyed = materialised(keyed.withColumn("bucket", F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")), "changes")
        touched = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]
        if not touched:
            return 0
        version, places = self._current()
        old = self._read({b: places[b] for b in touched if b in places})
        both = keyed if old is None else old.unionByName(keyed, allowMissingColumns=True)
        columns = [c for c in both.columns if c not in (self.key, "bucket")]
        newest = F.max_by(F.struct(*columns), self.order).alias("_row")
        # Grouping within a bucket needs no further shuffle, and a bucket is one file.
        merged = both.repartition("bucket").groupBy("bucket", self.key).agg(newest).select("bucket", self.key, "_row.*")
        version += 1
        merged.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/data/v={version}")
        places |= dict.fromkeys(touched, version)
        manifest = self.spark.createDataFrame(sorted(places.items()), "bucket int, version long")
        manifest.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/manifest/v={version}")
        return len(touched)

    def vacuum(self, keep: int = 2) -> list[int]:
        """Deletes versions that none of the last ``keep`` manifests names, and older manifests; the versions deleted."""
        whole = self._versions("manifest", "/_SUCCESS")
        kept = whole[-max(1, keep):]
        if not kept:
            return []
        named = {v for m in kept for v in self._manifest(m).values()}
        # What is newer than the last manifest belongs to a commit on its way.
        gone = [v for v in self._versions("data") if v not in named and v <= kept[-1]]
        for folder, versions in (("data", gone), ("manifest", [m for m in whole if m not in kept])):
            for v in versions:
                path, system = self._hadoop(f"{folder}/v={v}")
                system.delete(path, True)
        return gone
