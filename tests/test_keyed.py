import pytest
from pyspark.sql import functions as F

from therascape.sources.keyed import KeyedStore, fill
from therascape.streaming import increments

SCHEMA = "k string, day string, v int"


def store(spark, path, buckets=8, order=("day",)):
    return KeyedStore(spark, str(path), ["k"], SCHEMA, list(order), buckets)


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def content(s, version=None):
    return sorted(tuple(r) for r in s.read(version).collect())


def test_a_batch_writes_its_buckets_alone_and_once(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    assert content(s) == [] and s.manifest() == (-1, {})
    first = frame(spark, [(f"k{i}", "1", i) for i in range(40)] + [("k1", "0", 99), (None, "9", 1)])
    assert s.upsert(first) == list(range(8)) and len(content(s)) == 40
    assert s.upsert(first) == [] and s.manifest()[0] == 0  # the same batch again
    touched = s.upsert(frame(spark, [("k1", "2", 7), ("k2", "0", 8), ("new", None, 1)]))
    made, at = s.manifest()
    assert made == 1 and 1 <= len(touched) <= 2 and {b for b, v in at.items() if v == 1} == set(touched)
    got = dict((k, (d, v)) for k, d, v in content(s))
    assert got["k1"] == ("2", 7) and got["k2"] == ("1", 2) and got["new"] == (None, 1) and len(got) == 41
    assert len(content(s, 0)) == 40  # the copy before the change


def test_a_stop_between_data_and_manifest_changes_nothing(spark, tmp_path, monkeypatch):
    s = store(spark, tmp_path / "s")
    s.upsert(frame(spark, [("a", "1", 1), ("b", "1", 1)]))
    before = content(s)
    with monkeypatch.context() as m:
        m.setattr(KeyedStore, "_swap", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            s.upsert(frame(spark, [("a", "2", 2), ("c", "1", 3)]))
    assert content(s) == before
    s.upsert(frame(spark, [("c", "1", 3)]))  # another batch over what was left behind
    assert content(s) == [("a", "1", 1), ("b", "1", 1), ("c", "1", 3)]
    with pytest.raises(ValueError, match="buckets"):
        store(spark, tmp_path / "s", 4).read()


def test_order_of_batches_does_not_matter(spark, tmp_path):
    batches = [[("a", "1", 1), ("b", None, 5)], [("a", "1", 2)], [("a", "0", 3), ("b", "1", 6)]]
    ends = []
    for n, order in enumerate(([0, 1, 2], [2, 1, 0], [1, 1, 2, 0, 1])):
        s = store(spark, tmp_path / str(n))
        for k in order:
            s.upsert(frame(spark, batches[k]))
        ends.append(content(s))
    assert ends[0] == ends[1] == ends[2] and len(ends[0]) == 2


def test_what_is_left_to_do_goes_on_after_errors(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    todo = spark.createDataFrame([(f"k{i}",) for i in range(6)] + [(None,)], "k string")
    answer = lambda bad: lambda df: df.select("k", F.lit("1").alias("day"), F.lit(1).alias("v"), F.when(F.col("k") == bad, "no").alias("error"))
    fill(s, todo, answer("k1"), limit=3)
    assert [k for k, *_ in content(s)] == ["k0", "k2"]
    fill(s, todo, answer(None))
    assert len(content(s)) == 6 and s.todo(todo).count() == 0 and fill(s, todo, answer(None)) == []


def test_a_new_checkpoint_loses_nothing(spark, tmp_path):
    s = store(spark, tmp_path / "s")
    inbox = tmp_path / "in"
    for n in range(2):
        frame(spark, [(f"k{n}", str(n), n), ("both", str(n), n)]).coalesce(1).write.mode("append").parquet(str(inbox))
        stream = spark.readStream.schema(SCHEMA).parquet(str(inbox))
        increments.run_available(stream, str(tmp_path / f"check{n}"), lambda new, _: s.upsert(new)).awaitTermination()
    assert content(s) == [("both", "1", 1), ("k0", "0", 0), ("k1", "1", 1)]


def test_windows_keep_counting_and_leave_late_rows_out(spark, tmp_path):
    s = KeyedStore(spark, str(tmp_path / "s"), ["start", "event_type"], "start timestamp, event_type string, n long", ["n"], 4)
    inbox = str(tmp_path / "in")

    def land(rows):
        spark.createDataFrame(rows, "ts string, event_type string").select(F.col("ts").cast("timestamp").alias("ts"), "event_type").coalesce(1).write.mode("append").parquet(inbox)
        stream = spark.readStream.schema("ts timestamp, event_type string").parquet(inbox)
        increments.windows_to_store(stream, s, str(tmp_path / "check")).awaitTermination()
        return {(str(r.start)[:10], r.event_type): r.n for r in s.read().collect()}

    assert land([("2025-01-01 10:00", "a"), ("2025-01-01 11:00", "b")]) == {("2025-01-01", "a"): 1, ("2025-01-01", "b"): 1}
    assert land([("2025-01-01 23:00", "a"), ("2025-01-02 01:00", "a")])[("2025-01-01", "a")] == 2
    assert land([("2025-01-05 00:00", "a")])[("2025-01-05", "a")] == 1
    last = land([("2025-01-01 12:00", "a"), ("2025-01-05 03:00", "a")])  # the first one is four days late
    assert last == {("2025-01-01", "a"): 2, ("2025-01-01", "b"): 1, ("2025-01-02", "a"): 1, ("2025-01-05", "a"): 2}
