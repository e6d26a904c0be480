"""A store of findings over several runs, against scanning everything each time."""

import random

import pytest
from regspark.operators import scan as C
from regspark.operators.findings import FindingStore, rules_version

RULES = (C.Rule("key", "key=([a-z]+)", ("key",)), C.Rule("number", "#([0-9]+)"))


def files(spark, n, seed):
    rnd = random.Random(seed)
    lines = [f"key=abc{chr(97 + i % 26)} #{i}" if i % 4 == 0 else f"line {i}" for i in range(40)]
    return spark.createDataFrame([(f"l{i % 5}", f"d{seed}/f{i}.txt", "\n".join(rnd.choices(lines, k=rnd.randrange(1, 9))))
                                  for i in range(n)], "layer string, file string, text string")


def rows(df):
    return sorted(tuple(r) for r in df.select(
        "layer", "fragment_hash", "file", "file_type", "file_size", "origin", "secret", "start_line").collect())


@pytest.fixture
def store(spark, tmp_path):
    return FindingStore(spark, str(tmp_path / "store"))


def test_runs_scan_only_what_is_new_and_equal_a_full_scan(spark, store):
    first, second = C.fragments(files(spark, 30, 1)), C.fragments(files(spark, 30, 2))
    both = first.unionByName(second)
    assert rows(store.scan(first, RULES, "a")) == rows(C.scan_distinct(first, RULES))
    known = {r.digest for r in first.collect()}
    left = store.unseen(both, RULES)
    assert {r.digest for r in left.collect()} == {r.digest for r in second.collect()} - known
    assert rows(store.scan(both, RULES, "b")) == rows(C.scan_distinct(both, RULES))
    # Nothing is left for a third run: no fragment is read into the patterns, no row is kept.
    assert store.unseen(both, RULES).count() == 0
    assert rows(store.scan(both, RULES, "c")) == rows(C.scan_distinct(both, RULES))
    run = next(r for r in store.runs(RULES) if r.endswith("run=c"))
    assert spark.read.parquet(run).count() == 0
    assert store.scanned(RULES).count() == len({r.digest for r in both.collect()})


def test_changed_rules_scan_everything_again(spark, store):
    frags = C.fragments(files(spark, 20, 3))
    store.scan(frags, RULES, "a")
    more = (*RULES, C.Rule("line", "line ([0-9]+)"))
    assert store.unseen(frags, more).count() == frags.count() and store.unseen(frags, RULES).count() == 0
    assert rows(store.scan(frags, more, "a")) == rows(C.scan_distinct(frags, more))
    assert rules_version(RULES) == rules_version(RULES[::-1]) != rules_version(more)


def test_a_repeated_or_broken_run_changes_nothing(spark, store, tmp_path):
    frags = C.fragments(files(spark, 20, 4))
    expected = rows(C.scan_distinct(frags, RULES))
    broken = tmp_path / "store" / f"rules={rules_version(RULES)}" / "run=broken"
    broken.mkdir(parents=True)
    (broken / "part-0.parquet").write_bytes(b"half a file")
    assert rows(store.scan(frags, RULES, "a")) == expected
    before = store.scanned(RULES).count()
    assert rows(store.scan(frags, RULES, "a")) == expected and store.scanned(RULES).count() == before
    assert rows(store.scan(frags, RULES, "broken")) == expected and len(store.runs(RULES)) == 2


def test_chunks_with_different_ends_stay_apart_and_an_empty_table_works(spark, store):
    text = "\n".join(f"key=abc{'x' * (i % 3)}" for i in range(12))
    frame = spark.createDataFrame([("l", "f", text), ("l", "g", text[:70])], "layer string, file string, text string")
    frags = C.fragments(frame, unit="chunk", lines=4, overlap=1)
    for run in ("a", "b"):
        assert rows(store.scan(frags, RULES, run)) == rows(C.scan_distinct(frags, RULES))
    assert store.scan(frags.limit(0), RULES, "c").count() == 0
