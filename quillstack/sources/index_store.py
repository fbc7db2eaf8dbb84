"""The index on disk: Parquet partitioned by document bucket and chunk type; upserts and deletes rewrite touched buckets only."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quillstack.operators.incremental import CommitLog

BUCKETS = 64


class IndexStore:
    """Rows of the index below ``root``.

    Each write puts the buckets it touches into a new folder; a manifest names the folder of every bucket and is put in
    place by a rename that never overwrites. Readers keep the version they started with; a write that dies leaves the
    last version as it was, and of two writes at a time one raises. The manifest carries ``state`` of its writer, so
    what belongs to the index is published with it. A bucket holds 1/``buckets`` of the documents; choose them so that
    one bucket is a few files.
    """

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets
        self.log = CommitLog(spark, self.root)

    def _version(self) -> tuple[int, dict]:
        n, _ = self.log.last()
        return n, (self.log.manifest(n) if n else {"buckets": {}, "state": {}})

    def state(self) -> dict:
        return self._version()[1]["state"]

    def _bucket(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(self.buckets)).cast("int"))

    def _touched(self, *sides: DataFrame | None) -> list[int]:
        """Buckets of the documents of some tables: one row each, ``buckets`` at most."""
        found: set[int] = set()
        for df in sides:
            if df is not None:
                found |= {r["bucket"] for r in self._bucket(df.select("doc_id")).select("bucket").distinct().collect()}
        return sorted(found)

    def _read(self, manifest: dict, buckets: list[int] | None = None) -> DataFrame | None:
        chosen = [(int(b), f) for b, f in manifest["buckets"].items() if buckets is None or int(b) in buckets]
        if not chosen:
            return None
        paths = [f"{self.root}/data/{folder}/bucket={b}" for b, folder in sorted(chosen)]
        return self.spark.read.option("basePath", f"{self.root}/data").option("mergeSchema", "true").parquet(*paths).drop("version_folder")

    def _publish(self, n: int, manifest: dict, touched: list[int], rows: DataFrame | None, state: dict | None) -> None:
        """Write the new contents of the touched buckets and make them the next version."""
        folder = f"version_folder={uuid.uuid4().hex}"
        buckets = {b: f for b, f in manifest["buckets"].items() if int(b) not in touched}
        if rows is not None:
            self._bucket(rows.drop("bucket")).repartition("bucket", "chunk_type").write.partitionBy("bucket", "chunk_type").parquet(f"{self.root}/data/{folder}")
            fs, p = self.log._path(f"data/{folder}")
            names = [s.getPath().getName() for s in fs.listStatus(p)]
            buckets |= {name.split("=")[1]: folder for name in names if name.startswith("bucket=")}
        self.log.publish(n + 1, {"buckets": buckets, "state": manifest["state"] if state is None else state, "watermark": None, "output": folder})

    def read(self) -> DataFrame | None:
        return self._read(self._version()[1])

    def write(self, rows: DataFrame, state: dict | None = None) -> None:
        """A first or wholly new version."""
        n, manifest = self._version()
        self._publish(n, manifest | {"buckets": {}}, [], rows, state)

    def replace(self, rows: DataFrame | None, keys: DataFrame, state: dict | None = None) -> None:
        """Drop the documents in ``keys`` (doc_id) and add ``rows``; buckets of other documents are not read or written."""
        n, manifest = self._version()
        touched = self._touched(rows, keys)
        old = self._read(manifest, touched)
        kept = None if old is None else old.drop("bucket").join(keys.select("doc_id").distinct(), "doc_id", "left_anti")
        new = rows if kept is None else kept if rows is None else kept.unionByName(rows, allowMissingColumns=True)
        self._publish(n, manifest, touched, new, state)

    def upsert(self, rows: DataFrame, keys: list[str]) -> None:
        """Add ``rows``; of rows with equal ``keys`` the new one stands. ``keys`` must hold doc_id or rows of one key share their document."""
        n, manifest = self._version()
        touched = self._touched(rows)
        old = self._read(manifest, touched)
        self._publish(n, manifest, touched, rows if old is None else upserted(old.drop("bucket"), rows, keys), None)

    def delete(self, keys: DataFrame) -> None:
        self.replace(None, keys)

    def get(self, doc_id: str | None = None, chunk_types: list[str] | None = None, columns: list[str] | None = None, limit: int | None = None) -> DataFrame | None:
        """Rows of a document (or of all), of some types, some columns only, the first ``limit`` by chunk_id; only the document's bucket is read."""
        manifest = self._version()[1]
        bucket = None if doc_id is None else self._touched(self.spark.createDataFrame([(doc_id,)], "doc_id string"))
        rows = self._read(manifest, bucket)
        if rows is None:
            whole = self._read(manifest)
            return None if whole is None else whole.limit(0)
        if doc_id is not None:
            rows = rows.where(F.col("doc_id") == doc_id)
        if chunk_types:
            rows = rows.where(F.col("chunk_type").isin(*chunk_types))
        if limit is not None:
            rows = rows.orderBy("chunk_id").limit(limit)
        return rows.select(*columns) if columns else rows.drop("bucket")

    def doc_ids(self) -> DataFrame | None:
        rows = self.read()
        return None if rows is None else rows.select("doc_id").distinct()

    def remove_old(self, keep: int = 2) -> int:
        """Delete folders that none of the last ``keep`` versions names; returns their number. Not while older versions are still read."""
        n, _ = self._version()
        named = {f for v in range(max(1, n - keep + 1), n + 1) for f in self.log.manifest(v)["buckets"].values()}
        fs, p = self.log._path("data")
        gone = [s.getPath() for s in fs.listStatus(p) if s.getPath().getName() not in named] if fs.exists(p) else []
        for path in gone:
            fs.delete(path, True)
        return len(gone)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of both, of equal keys the new one."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    return both.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(F.desc("_new")))).where("_n = 1").drop("_n", "_new")
