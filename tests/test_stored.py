import random

import pytest
from pyspark.sql import functions as F

from regspark.operators.stored import KeyedTable
from regspark.session import fresh_path
from regspark.streaming import streams as Q

SCHEMA = "k string, v int, w string"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def batches(seed, n=3):
    draw = random.Random(seed)
    return [[(draw.choice([None, *"abcdefgh"]), draw.choice([None, 1, 2, 3]), draw.choice([None, "x", "y"]), i)
             for i in range(20)] for _ in range(n)]


def expected(mode, given):
    table = {}
    for batch in given:
        for k, v, w, _ in batch:
            if mode == "replace" or k not in table:
                if mode != "ignore" or k not in table:
                    table[k] = (v, w)
            elif mode == "coalesce":
                old = table[k]
                table[k] = (old[0] if v is None else v, old[1] if w is None else w)
    return sorted(((k, *r) for k, r in table.items()), key=repr)


@pytest.mark.parametrize("mode", ["replace", "coalesce", "ignore"])
def test_merges_equal_row_by_row(spark, mode):
    table = KeyedTable(spark, fresh_path(spark, "table"), SCHEMA, "k", mode, buckets=5)
    assert table.read().count() == 0
    given = batches(7)
    for i, batch in enumerate(given):
        table.merge(spark.createDataFrame(batch, SCHEMA + ", seq int"), "seq", marks={"in": i})
        assert rows(table.read()) == expected(mode, given[:i + 1])
    assert rows(table.read(1)) == expected(mode, given[:1])


def test_untouched_buckets_keep_their_files_and_are_not_read(spark):
    table = KeyedTable(spark, fresh_path(spark, "table"), "k long, v long", "k", buckets=16)
    table.merge(spark.range(1000).select(F.col("id").alias("k"), F.lit(0).cast("long").alias("v"), F.lit(0).alias("s")), "s")
    before = table.manifest()["folders"]
    table.merge(spark.createDataFrame([(3, 9, 0)], "k long, v long, s int"), "s")
    after = table.manifest()["folders"]
    changed = [b for b in before if before[b] != after[b]]
    assert len(before) == 16 and len(changed) == 1
    assert rows(table.changes(1)) == [(3, 0, -1), (3, 9, 1)]
    # reading only what differs: a lost file of another bucket does not matter
    plan = table.changes(1).inputFiles()
    assert {p.split("_bucket=")[1].split("/")[0] for p in plan} == set(changed)


def by_comparison(table, since, until):
    before, after = rows(table.read(since)), rows(table.read(until))
    return sorted([(*r, -1) for r in before if r not in after] + [(*r, 1) for r in after if r not in before], key=repr)


@pytest.mark.parametrize("mode", ["replace", "coalesce", "ignore"])
def test_changes_of_one_merge_are_read_as_they_lie(spark, mode):
    table = KeyedTable(spark, fresh_path(spark, "table"), SCHEMA, "k", mode, buckets=3)
    for batch in batches(9):
        table.merge(spark.createDataFrame(batch[:12], SCHEMA + ", seq int"), "seq")
    table.resize(4)
    for since, until in ((0, 1), (1, 2), (2, 3), (0, 3), (1, 3), (3, 4), (2, 4)):
        told, keys = table.changes(since, until), table.key_changes(since, until)
        wanted = by_comparison(table, since, until)
        assert rows(told) == wanted
        whole = [r for r in wanted if sum(w[0] == r[0] for w in wanted) == 1]
        assert rows(keys) == sorted(((r[0], r[3]) for r in whole), key=repr)
        shuffled = "Exchange" in told._jdf.queryExecution().toString()
        assert shuffled == (since > 0 and until - since > 1)


def test_changes_of_sums_that_move_and_vanish(spark):
    table = KeyedTable(spark, fresh_path(spark, "table"), "k string, n long", "k", "add", buckets=2)
    table.merge(spark.createDataFrame([("a", 1), ("b", 2), ("c", 3), ("z", 0)], "k string, n long"))
    table.merge(spark.createDataFrame([("a", -1), ("b", 1), ("c", 0), ("d", 5), ("y", None)], "k string, n long"))
    assert rows(table.read()) == [("b", 3), ("c", 3), ("d", 5)]
    assert rows(table.changes(1)) == [("a", 1, -1), ("b", 2, -1), ("b", 3, 1), ("d", 5, 1)]
    assert rows(table.key_changes(1)) == [("a", -1), ("d", 1)]
    table.vacuum(keep=1)
    assert rows(table.read()) == [("b", 3), ("c", 3), ("d", 5)]


def test_a_repeated_batch_changes_nothing(spark):
    table = KeyedTable(spark, fresh_path(spark, "table"), "k string, n long", "k", "add", buckets=4)
    batch = spark.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "k string, n long")
    assert table.merge(batch, marks={"one": 0}) == 1
    assert table.merge(batch, marks={"one": 0}) == 1
    assert table.merge(batch, marks={"two": 0}) == 2
    assert rows(table.read()) == [("a", 8), ("b", 4)]
    table.merge(spark.createDataFrame([("b", -4)], "k string, n long"), marks={"one": 1})
    assert rows(table.read()) == [("a", 8)]
    table.merge(batch.limit(0), marks={"one": 2})
    assert rows(table.read()) == [("a", 8)] and table.manifest()["folded"] == {"one": 2, "two": 0}


def test_a_merge_that_dies_leaves_the_table(spark, monkeypatch):
    table = KeyedTable(spark, fresh_path(spark, "table"), SCHEMA, "k", buckets=4)
    first, second, _ = batches(3)
    frame = lambda b: spark.createDataFrame(b, SCHEMA + ", seq int")
    table.merge(frame(first), "seq", marks={"in": 0})
    with monkeypatch.context() as patched:
        patched.setattr(table, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            table.merge(frame(second), "seq", marks={"in": 1})
    assert rows(table.read()) == expected("replace", [first])
    table.merge(frame(second), "seq", marks={"in": 1})
    table.vacuum(keep=1)
    assert table.versions() == [2] and rows(table.read()) == expected("replace", [first, second])


def test_two_writers_of_one_version(spark):
    table = KeyedTable(spark, fresh_path(spark, "table"), "k string", "k", "ignore", buckets=2)
    table.merge(spark.createDataFrame([("a",)], "k string"))
    with pytest.raises(Exception, match="FileAlreadyExists"):
        table._commit(1, table.manifest(0))
    assert rows(table.read()) == [("a",)]


def test_resize_keeps_rows(spark):
    table = KeyedTable(spark, fresh_path(spark, "table"), SCHEMA, "k", buckets=2)
    given = batches(5)
    for batch in given[:2]:
        table.merge(spark.createDataFrame(batch, SCHEMA + ", seq int"), "seq")
    table.resize(7)
    assert rows(table.read()) == expected("replace", given[:2]) and rows(table.changes(2)) == []
    table.merge(spark.createDataFrame(given[2], SCHEMA + ", seq int"), "seq")
    assert rows(table.read()) == expected("replace", given)


def test_columns_the_batch_lacks_or_adds(spark):
    table = KeyedTable(spark, fresh_path(spark, "table"), SCHEMA, "k", "coalesce", buckets=2)
    table.merge(spark.createDataFrame([("a", 1, "x", 0)], SCHEMA + ", seq int"), "seq")
    table.merge(spark.createDataFrame([("a", 2, 0)], "k string, v int, seq int"), "seq")
    assert rows(table.read()) == [("a", 2, "x")]
    with pytest.raises(ValueError, match="no columns"):
        table.merge(spark.createDataFrame([("a", 2, 0)], "k string, z int, seq int"), "seq")


def test_stream_folds_every_batch_once(spark):
    root = fresh_path(spark, "stream")
    given = batches(11)
    table = KeyedTable(spark, f"{root}/table", SCHEMA, "k", "coalesce", buckets=4)
    for i, batch in enumerate(given):
        spark.createDataFrame(batch, SCHEMA + ", seq int").coalesce(1).write.parquet(f"{root}/in/{i}")
        source = spark.readStream.schema(SCHEMA + ", seq int").parquet(f"{root}/in/*")
        Q.stream_merge(source, table, "seq", f"{root}/cp").awaitTermination()
    assert rows(table.read()) == expected("coalesce", given)


def test_counts_of_a_stream_are_added_once(spark):
    root = fresh_path(spark, "counts")
    table = KeyedTable(spark, f"{root}/table", "key string, count long", "key", "add", buckets=2)
    for i, batch in enumerate([["a", "a", None], ["a", " ", "b"]]):
        spark.createDataFrame([(v,) for v in batch], "c string").coalesce(1).write.parquet(f"{root}/in/{i}")
        source = spark.readStream.schema("c string").parquet(f"{root}/in/*")
        Q.stream_counts(source, "c", table, f"{root}/cp").awaitTermination()
    assert rows(table.read()) == [("a", 3), ("b", 1), ("unknown", 2)]
    assert rows(table.read(1)) == [("a", 2), ("unknown", 1)]
