"""Session-level helpers every operator shares: table access, lineage cuts, bounded broadcasts, skew-proof lookups."""

from __future__ import annotations

import atexit
import tempfile
import uuid

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Broadcast bound in rows. Sides that may grow are only broadcast after a count proves them below it.
BROADCAST_ROWS = 20_000
#: A key is hot if it holds more than 1/HOT_SHARE of the rows, so there can never be more than HOT_SHARE hot keys.
HOT_SHARE = 512


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet table ``name`` of a data directory."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors can reach, as the cluster names it in spark.checkpoint.dir.

    Where that is unset a session on one machine (as in tests) gets a temporary folder; on a cluster, whose executors
    could not read it, this raises.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillstack-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def cut_lineage(df: DataFrame) -> DataFrame:
    """Compute ``df`` once and keep it in the shared checkpoint folder, so lost executors lose nothing."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


_WRITTEN: list[tuple[SparkSession, str]] = []


def written(df: DataFrame, label: str = "stage") -> DataFrame:
    """Compute ``df`` once as a Parquet table in the shared folder (smaller than a checkpoint, columns can be pruned).

    The table stands until ``drop_written`` or the end of the program.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/quillstack-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if not _WRITTEN:
        atexit.register(drop_written)
    _WRITTEN.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def drop_written() -> None:
    """Remove all tables written so far. Only for when no result that reads them is still to be computed."""
    while _WRITTEN:
        _remove(*_WRITTEN.pop())


def by_group(left: DataFrame, right: DataFrame | None, keys: list[str], work, result: T.DataType) -> DataFrame:
    """keys, ``_rows`` (the left rows of each group) and ``_out``: what ``work(left rows, right rows)`` makes of the group.

    Groups are packed into arrays in the JVM and go to Python many to an Arrow batch, so many small groups (pages)
    cost little. ``work`` gets lists of dict-like rows; groups without left rows are left out.
    """
    pack = lambda df, name: df.groupBy(*keys).agg(F.collect_list(F.struct(*[c for c in df.columns if c not in keys])).alias(name))
    both = pack(left, "_rows")
    both = both.join(pack(right, "_others"), keys, "left") if right is not None else both.withColumn("_others", F.lit(None).cast("array<int>"))

    def run(rows: pd.Series, others: pd.Series) -> pd.Series:
        return pd.Series([work(list(a), [] if b is None else list(b)) for a, b in zip(rows, others)])

    return both.select(*keys, "_rows", F.pandas_udf(run, result)("_rows", "_others").alias("_out"))


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
    except Exception:  # the session has ended; the cluster empties its checkpoint folder itself
        pass


def is_small(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> bool:
    return df.limit(max_rows + 1).count() <= max_rows


def small_side(df: DataFrame, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` marked for broadcast if a bounded count proves it small; otherwise unmarked, so Spark shuffles it."""
    return F.broadcast(df) if is_small(df, max_rows) else df


def bounded_sample(df: DataFrame, n: int, *keys: str) -> DataFrame:
    """``n`` rows at most, the same ones every time: those with the lowest hashes of ``keys``.

    Each task passes on only rows below a hash that gives a quarter more than ``n``, so hardly more than ``n`` rows meet.
    """
    total = df.count()
    if total <= n:
        return df
    grain = 1 << 30
    place = F.pmod(F.xxhash64(*keys, F.lit(17)), F.lit(grain))
    return df.where(place < int(grain * min(1.0, 1.25 * n / total + 1e-6))).orderBy(place, *keys).limit(n)


def lookup_join(left: DataFrame, right: DataFrame, key: str, how: str = "left") -> DataFrame:
    """Equi-join of ``left`` to ``right`` (unique on ``key``) that stays balanced when one key holds much of ``left``.

    Keys above 1/HOT_SHARE of the rows (at most HOT_SHARE of them) are broadcast with their right-hand rows; all
    others take the ordinary shuffle join. ``left`` is read four times, so pass a written table or a plain scan. Null keys
    match nothing. ``how`` is 'left' or 'inner'.
    """
    total = left.count()
    hot = left.where(F.col(key).isNotNull()).groupBy(key).count().where(F.col("count") * HOT_SHARE > F.lit(total)).select(key)
    hot = cut_lineage(hot)
    if hot.isEmpty():
        return left.join(right, key, how)
    flagged = left.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), key, "left")
    hot_right = right.join(F.broadcast(hot), key, "left_semi")
    one = flagged.where(F.col("_hot").isNotNull()).drop("_hot").join(F.broadcast(hot_right), key, how)
    two = flagged.where(F.col("_hot").isNull()).drop("_hot").join(right, key, how)
    return one.unionByName(two)
