import datetime

import pytest

from quillstack.operators import incremental as inc


RUNS = [(1, "succeeded", 10), (2, "failed", 20), (3, "succeeded", 30), (4, "running", None)]
LOG = [(1, "A", "2024-01-02 00:00:00", "indexed", 5), (1, "A", "2024-01-02 00:00:00", "indexed", 5), (1, "B", "2024-01-02 00:00:00", "empty", 5), (3, "D", "2024-01-02 00:00:00", "indexed", 25), (1, "E", "2024-04-30T23:59:59Z", "indexed", 5), (2, "H", "2024-02-01 00:00:00", "indexed", 15), (3, "H", "2024-02-01 00:00:00", "failed", 25), (3, "GONE", "2024-02-01 00:00:00", "indexed", 25), (4, "H", "2024-02-01 00:00:00", "indexed", 35)]


def moment(n):
    return None if n is None else datetime.datetime(2024, 6, 1) + datetime.timedelta(minutes=n)


def state(spark, runs=RUNS, log=LOG):
    runs = spark.createDataFrame([(i, s, moment(t)) for i, s, t in runs], "run_id int, status string, finished_at timestamp")
    items = [("A", 7, "2024-01-02 00:00:00"), ("B", 7, "2024-01-02T02:00:00+02:00"), ("C", 7, None), ("D", 7, "unknown"), ("E", 7, "2024-05-01 00:00:00"), ("E", 7, "2024-01-01 00:00:00"), ("F", 14, "2024-01-01 00:00:00"), ("G", 1, None), ("H", 7, "2024-01-01 00:00:00"), ("I", None, "0000-00-00 00:00:00"), (None, 7, "2024-01-01 00:00:00")]
    items = spark.createDataFrame([(k, t, m, 0) for k, t, m in items], "key string, itemtypeid int, datemodified string, run_id int")
    log = spark.createDataFrame([(*r[:4], moment(r[4]), "x") for r in log], "run_id int, item_key string, datemodified_seen string, outcome string, logged_at timestamp, key string")
    return items, log, runs


def keys(df):
    rows = [r["item_key"] for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_pending(spark, tmp_path):
    assert keys(inc.KeyRuns(spark, str(tmp_path)).run(*state(spark))) == {"C", "E", "H", "I"}


def test_empty(spark, tmp_path):
    items, log, runs = state(spark)
    assert inc.KeyRuns(spark, str(tmp_path / "a")).run(items.limit(0), log, runs).count() == 0
    store = inc.KeyRuns(spark, str(tmp_path / "b"))
    assert keys(store.run(items, log.limit(0), runs.limit(0))) == set("ABCDEHI") and store.log.last() == (1, None)
    assert keys(store.run(items, log, runs)) == {"C", "E", "H", "I"}


def test_runs_continue(spark, tmp_path):
    """The state kept with the watermark gives what the whole log gives; late runs and late entries are not skipped."""
    store = inc.KeyRuns(spark, str(tmp_path))
    first = [r for r in LOG if r[0] == 1]
    assert keys(store.run(*state(spark, [r for r in RUNS if r[0] == 1], first))) == {"C", "D", "E", "H", "I"}
    mark = store.log.last()[1]
    with pytest.raises(RuntimeError, match="broken"):
        store.run(*state(spark), fail_before_commit=True)
    assert store.log.last() == (1, mark)
    assert keys(store.run(*state(spark))) == {"C", "E", "H", "I"} and store.log.last()[1] > mark
    # run 4 finishes, an entry of run 1 comes late, and old entries are read no more: the log need not hold them
    late = [(1, "C", None, "indexed", 45), (4, "H", "2024-02-01 00:00:00", "indexed", 35)]
    assert keys(store.run(*state(spark, [*RUNS[:3], (4, "succeeded", 40)], late))) == {"E", "I"}
    assert keys(store.run(*state(spark, [*RUNS[:3], (4, "succeeded", 40)], late))) == {"E", "I"}
    for _ in range(inc.MOST_DELTAS):
        assert keys(store.run(*state(spark, [*RUNS[:3], (4, "succeeded", 40)], late))) == {"E", "I"}
    assert len(store.log.manifest(store.log.last()[0])["states"]) < inc.MOST_DELTAS


def test_race(spark, tmp_path):
    """Two runs that work for the same commit leave one."""
    a, b = inc.KeyRuns(spark, str(tmp_path)), inc.KeyRuns(spark, str(tmp_path))
    publish = a.log.publish

    def other_first(n, manifest):
        b.run(*state(spark))
        publish(n, manifest)

    a.log.publish = other_first
    with pytest.raises(RuntimeError, match="taken"):
        a.run(*state(spark))
    assert a.log.last()[0] == 1 and keys(a.log.read()) == {"C", "E", "H", "I"}


def test_commit_log(spark, tmp_path):
    log = inc.CommitLog(spark, str(tmp_path / "log"))
    source = spark.range(10).withColumnRenamed("id", "seq")
    assert log.last() == (0, None) and log.read() is None
    with pytest.raises(RuntimeError):
        log.run(source, "seq", lambda df: df, fail_before_commit=True)
    assert log.read() is None
    assert log.run(source, "seq", lambda df: df) == 1
    assert log.run(source, "seq", lambda df: df) == 0
    more = spark.range(15).withColumnRenamed("id", "seq")
    assert log.run(more, "seq", lambda df: df) == 2
    assert sorted(r["seq"] for r in log.read().collect()) == list(range(15))
    with pytest.raises(RuntimeError):
        log.publish(2, {"output": "x", "watermark": 1})
    assert log.run(spark.range(0).withColumnRenamed("id", "seq"), "seq", lambda df: df) == 0
