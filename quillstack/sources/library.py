"""Sources: bibliographic SQLite databases, journal lists, cost logs, citation services."""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quillstack.functions.text import normalized_title

SQLITE_TYPES = {"INT": T.LongType(), "CHAR": T.StringType(), "CLOB": T.StringType(), "TEXT": T.StringType(), "REAL": T.DoubleType(), "FLOA": T.DoubleType(), "DOUB": T.DoubleType(), "BLOB": T.BinaryType()}


class RowRange(InputPartition):
    def __init__(self, low: int, high: int):
        super().__init__(low)
        self.low, self.high = low, high


class WholeTable(InputPartition):
    def __init__(self):
        super().__init__(0)


class SqliteReader(DataSourceReader):
    """Reads row-id ranges of one table; the file is opened read-only and as unchanging."""

    def __init__(self, schema: T.StructType, path: str, name: str, ranges: int):
        self.schema, self.path, self.name, self.ranges = schema, path, name, ranges

    def _open(self) -> sqlite3.Connection:
        return sqlite3.connect(f"file:{self.path}?mode=ro&immutable=1", uri=True)

    def partitions(self) -> list[InputPartition]:
        with self._open() as db:
            try:
                low, high = db.execute(f'SELECT min(rowid), max(rowid) FROM "{self.name}"').fetchone()
            except sqlite3.OperationalError:  # a table without row ids is read as a whole
                return [WholeTable()]
        if low is None:
            return [RowRange(0, 0)]
        step = max(1, -(-(high - low + 1) // self.ranges))
        return [RowRange(a, min(a + step, high + 1)) for a in range(low, high + 1, step)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        columns = ", ".join(f'"{f.name}"' for f in self.schema)
        part = ("", ()) if isinstance(partition, WholeTable) else (" WHERE rowid >= ? AND rowid < ?", (partition.low, partition.high))
        with self._open() as db:
            for row in db.execute(f'SELECT {columns} FROM "{self.name}"{part[0]}', part[1]):
                yield tuple(str(v) if v is not None and isinstance(f.dataType, T.StringType) else v for v, f in zip(row, self.schema))


class SqliteSource(DataSource):
    """spark.read.format('quillstack_sqlite').option('path', file).option('dbtable', table)."""

    @classmethod
    def name(cls) -> str:
        return "quillstack_sqlite"

    def schema(self) -> T.StructType:
        table_, path = self.options["dbtable"].replace('"', ""), self.options["path"]
        with sqlite3.connect(f"file:{path}?mode=ro&immutable=1", uri=True) as db:
            columns = db.execute(f'PRAGMA table_info("{table_}")').fetchall()
        kind = lambda declared: next((t for k, t in SQLITE_TYPES.items() if k in declared.upper()), T.StringType())
        return T.StructType([T.StructField(c[1], kind(c[2] or "TEXT")) for c in columns])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return SqliteReader(schema, self.options["path"], self.options["dbtable"].replace('"', ""), int(self.options.get("ranges", "8")))


def sqlite_table(spark: SparkSession, path: str, name: str, ranges: int = 8) -> DataFrame:
    """A table of an SQLite file, its column names in lower case."""
    spark.dataSource.register(SqliteSource)
    df = spark.read.format("quillstack_sqlite").option("path", path).option("dbtable", name).option("ranges", ranges).load()
    return df.toDF(*[c.lower() for c in df.columns])


def found(spark: SparkSession, path: str) -> tuple[bool, bool]:
    """Whether a path of any file system exists, and whether it is a file."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return (True, fs.getFileStatus(p).isFile()) if fs.exists(p) else (False, False)


def citation_keys(spark: SparkSession, path: str) -> DataFrame:
    """(item_key, citation_key); empty if the database is absent."""
    if not found(spark, path)[0]:
        return spark.createDataFrame([], "item_key string, citation_key string")
    return sqlite_table(spark, path, "citationkey").select(F.col("itemkey").alias("item_key"), F.col("citationkey").alias("citation_key"))


def journal_list(spark: SparkSession, path: str) -> DataFrame:
    """(title, quartile) of a CSV with the header title_normalized, quartile."""
    rows = spark.read.csv(path, header=True, schema="title_normalized string, quartile string")
    return rows.where("title_normalized is not null and quartile is not null").select(F.col("title_normalized").alias("title"), F.upper(F.trim("quartile")).alias("quartile"))


def journal_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(title, quartile) of a file without header; lines that start with # are comments; the first comma parts the two."""
    rows = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)") & F.contains("value", F.lit(",")))
    return rows.select(normalized_title(F.split("value", ",", 2)[0]).alias("title"), F.upper(F.trim(F.split("value", ",", 2)[1])).alias("quartile"))


COSTS = "timestamp string, session_id string, table_id string, agent_role string, model string, input_tokens long, output_tokens long, cache_write_tokens long, cache_read_tokens long, cost_usd double"


def cost_log(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a cost log: an array in one JSON file, or a folder of JSON lines."""
    there, is_file = found(spark, path)
    if not there:
        return spark.createDataFrame([], COSTS)
    return spark.read.schema(COSTS).json(path, multiLine=is_file)


def append_costs(entries: DataFrame, path: str) -> None:
    """Add entries to a folder of JSON lines; nothing that is there is read or rewritten."""
    entries.select(*[c.split()[0] for c in COSTS.split(", ")]).write.mode("append").json(path)


def works_from_json(spark: SparkSession, path: str) -> DataFrame:
    """Works of a citation service saved as JSON lines: work_id, title, authors, year, doi, cited_by_count, referenced."""
    schema = "work_id string, title string, authors array<string>, year int, doi string, cited_by_count long, referenced array<string>"
    return spark.read.schema(schema).json(path)


def cites_of(works: DataFrame) -> DataFrame:
    """(src, dst, position) of the references of works, in the order of the bibliography."""
    return works.select(F.col("work_id").alias("src"), F.posexplode("referenced").alias("position", "dst")).select("src", "dst", "position")


def binary_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, content, length) of files below a folder."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content", "length")

