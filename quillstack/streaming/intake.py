"""Structured Streaming intake: new files of a folder become index rows, each file once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def new_documents(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    """A stream of Parquet document files."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def index_stream(documents: DataFrame, build: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Run ``build`` over every micro-batch and keep its rows under the batch's number.

    A batch that is run again after a failure overwrites its own folder, so no row is lost or doubled. Runs until all
    that is there is taken in.
    """

    def batch(df: DataFrame, number: int) -> None:
        build(df).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return documents.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_only(df: DataFrame, key: str, time: str) -> DataFrame:
    """The latest row of each key of a micro-batch."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), time).alias("r")).select(key, "r.*")
