"""Processing only new or changed records.

Progress is a high watermark on a monotonic commit sequence. A run fixes its upper limit when it starts, works on
records between the watermark and that limit, and publishes output and new watermark in one atomic step: the manifest
of a commit is put in place by a rename that never overwrites, and readers only see files that a manifest names. A run
that dies before its manifest leaves nothing visible, so its records are picked again, none twice; of two runs that
race for one commit the loser's output is never visible.
"""

from __future__ import annotations

import json
import os
import uuid
from urllib.parse import urlparse

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstack.runtime import small_side

SKIPPED_TYPES = (1, 14)
MOST_DELTAS = 8  # tables of a state before they are merged into one
DONE_OUTCOMES = ("indexed", "empty")


def utc_time(c: Column) -> Column:
    """A time in several notations as a UTC timestamp; one without an offset is UTC; unreadable or senseless ones are null."""
    t = F.regexp_replace(F.trim(c), r"^(\d{4}-\d\d-\d\d)$", "$1 00:00:00")
    t = F.when(t.rlike(r"^\d{4}-\d\d-\d\d[ T]\d\d?:\d\d(:\d\d(\.\d+)?)?$"), F.concat(t, F.lit("Z"))).otherwise(t)
    return F.when(t.rlike(r"^[12]\d{3}-\d\d-\d\d[ T].*(Z|[+-]\d\d:?\d\d|UTC|GMT)$"), F.regexp_replace(t, r"([+-]\d\d)(\d\d)$", "$1:$2").try_cast("timestamp"))


def committed_entries(index_log: DataFrame, index_runs: DataFrame) -> DataFrame:
    """(item_key, seen, sequence): log entries that count as success, with their place in the commit sequence.

    An entry is committed when its run has succeeded and the entry stands in the log, whichever is later: late entries
    of old runs, and old runs that finish late, come after what was committed before them. ``sequence`` is in
    microseconds, null where neither time is known. Failed, aborted and unfinished runs commit nothing.
    """
    runs = index_runs.where((F.col("status") == "succeeded") & F.col("run_id").isNotNull()).groupBy("run_id").agg(F.max("finished_at").alias("finished_at"))
    done = index_log.where(F.col("outcome").isin(*DONE_OUTCOMES) & F.col("item_key").isNotNull()).select("run_id", "item_key", "datemodified_seen", "logged_at")
    done = done.join(small_side(runs), "run_id")
    return done.select("item_key", utc_time(F.col("datemodified_seen")).alias("seen"), F.unix_micros(F.greatest("finished_at", "logged_at").cast("timestamp")).alias("sequence"))


def processed_state(entries: DataFrame) -> DataFrame:
    """(item_key, seen): newest time seen with success; null where a key has entries but none with a readable time. Repeated and late entries change nothing."""
    return entries.groupBy("item_key").agg(F.max("seen").alias("seen"))


def pending_keys(zotero_items: DataFrame, state: DataFrame) -> DataFrame:
    """Keys the next run must process: new, or modified after the newest time seen with success (``state``).

    Notes and attachments are left out, null keys too. Several rows of a key count with their newest readable time.
    A key without a readable time is pending only if no success is on record for it. Grouping happens map-side first,
    so a key with many rows stays small in the shuffle.
    """
    items = zotero_items.where(F.col("key").isNotNull() & ~F.coalesce(F.col("itemtypeid").isin(*SKIPPED_TYPES), F.lit(False)))
    newest = items.groupBy(F.col("key").alias("item_key")).agg(F.max(utc_time(F.col("datemodified"))).alias("modified"))
    both = newest.join(state.withColumn("known", F.lit(True)), "item_key", "left")
    changed = F.col("modified").isNotNull() & (F.col("seen").isNull() | (F.col("modified") > F.col("seen")))
    return both.where(F.col("known").isNull() | changed).select("item_key", "modified", "seen")


class CommitLog:
    """Commits of incremental runs in a folder of any Hadoop file system.

    ``commits/<n>.json`` names the output of commit n, the watermark it reached and what else the run keeps. The file is
    put there by a rename that fails if it exists, so of two runs that try for n one wins; the loser raises and its
    output is never visible.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()

    def _path(self, name: str):
        p = self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        fs = p.getFileSystem(self._conf)
        return fs, fs.makeQualified(p)

    def _commits(self) -> list[int]:
        fs, p = self._path("commits")
        if not fs.exists(p):
            return []
        return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(p) if s.getPath().getName().endswith(".json"))

    def manifest(self, n: int) -> dict:
        fs, p = self._path(f"commits/{n:010d}.json")
        stream = fs.open(p)
        try:
            return json.loads(bytes(bytearray(b & 255 for b in self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))).decode())
        finally:
            stream.close()

    def last(self) -> tuple[int, int | None]:
        """(commit number, watermark) of the last commit; (0, None) before the first."""
        n = self._commits()
        return (n[-1], self.manifest(n[-1])["watermark"]) if n else (0, None)

    def save(self, rows: DataFrame, n: int, what: str = "data") -> str:
        """Write a table of the commit to be; nothing points to it until the commit is published."""
        folder = f"{what}/{n:010d}-{uuid.uuid4().hex}"
        rows.write.parquet(f"{self.root}/{folder}")
        return folder

    def load(self, folders: list[str]) -> DataFrame:
        return self.spark.read.parquet(*[f"{self.root}/{f}" for f in folders])

    def run(self, source: DataFrame, sequence: str, work, fail_before_commit: bool = False) -> int:
        """One incremental run over rows of ``source`` above the watermark; returns the number of the commit, 0 if there was nothing.

        ``sequence`` is the monotonic long column. The upper limit is the highest value at the start: rows that arrive
        during the run wait for the next one. ``work`` maps the rows to the output.
        """
        n, low = self.last()
        top = source.agg(F.max(sequence)).first()[0]
        if top is None or (low is not None and top <= low):
            return 0
        rows = source.where(F.col(sequence) <= top)
        if low is not None:
            rows = rows.where(F.col(sequence) > low)
        out = self.save(work(rows), n + 1)
        if fail_before_commit:
            raise RuntimeError("run broken before its commit")
        self.publish(n + 1, {"output": out, "watermark": int(top)})
        return n + 1

    def publish(self, n: int, manifest: dict) -> None:
        """Write beside, then rename without overwriting: the manifest is either whole or absent, and never replaced."""
        fs, p = self._path(f"commits/{n:010d}.json")
        _, tmp = self._path(f"staging/{uuid.uuid4().hex}.json")
        stream = fs.create(tmp, False)
        stream.write(bytearray(json.dumps(manifest).encode()))
        stream.close()
        fs.mkdirs(p.getParent())
        place(self._jvm, self._conf, tmp, p, f"commit {n} was taken by another run")

    def read(self) -> DataFrame | None:
        """All committed output, or None before the first commit."""
        folders = [self.manifest(n)["output"] for n in self._commits()]
        return self.load(folders) if folders else None


def place(jvm, conf, tmp, path, taken: str) -> None:
    """Rename ``tmp`` to ``path`` unless that exists; raises with ``taken`` if it does. Atomic, also between two programs."""
    if path.toUri().getScheme() == "file":  # the local file system renames over what exists, a link doesn't
        try:
            os.link(urlparse(tmp.toString()).path, urlparse(path.toString()).path)
        except FileExistsError:
            raise RuntimeError(taken) from None
        path.getFileSystem(conf).delete(tmp, False)
        return
    options = jvm.java.lang.reflect.Array.newInstance(jvm.java.lang.Class.forName("org.apache.hadoop.fs.Options$Rename"), 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(tmp, path, options)
    except Exception as e:
        if path.getFileSystem(conf).exists(path):
            raise RuntimeError(taken) from e
        raise


class KeyRuns:
    """Incremental runs over keyed items by a log of what was processed.

    The processed state is kept with the watermark it is true for. A run reads only log entries from the watermark to
    its upper limit, adds them to the state, picks the keys to process and commits state, keys and watermark together.
    Items come as a whole each time, as an item may be pending without any new entry.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.log = CommitLog(spark, root)

    def run(self, zotero_items: DataFrame, index_log: DataFrame, index_runs: DataFrame, fail_before_commit: bool = False) -> DataFrame:
        """Commit one run and return its pending keys (item_key, modified, seen), read back from the commit.

        Entries at the watermark itself are read again, which changes nothing, so entries of one moment may arrive apart;
        so are entries whose time is unknown.
        """
        n, low = self.log.last()
        entries = committed_entries(index_log, index_runs)
        top = entries.agg(F.max("sequence")).first()[0]
        fresh = entries.where(F.col("sequence").isNull() | (F.col("sequence") <= F.lit(top)))
        if low is not None:
            fresh = fresh.where(F.col("sequence").isNull() | (F.col("sequence") >= low))
            top = max(low, top) if top is not None else low
        states = self.log.manifest(n).get("states", []) if n else []
        delta = processed_state(fresh)
        if len(states) >= MOST_DELTAS:
            delta, states = processed_state(self.log.load(states).unionByName(delta)), []
        states = [*states, self.log.save(delta, n + 1, "state")]
        state = self.log.load(states)
        pending = pending_keys(zotero_items, processed_state(state) if len(states) > 1 else state)
        output = self.log.save(pending, n + 1)
        if fail_before_commit:
            raise RuntimeError("run broken before its commit")
        self.log.publish(n + 1, {"output": output, "states": states, "watermark": top})
        return self.log.load([output])
