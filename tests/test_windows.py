import datetime
import random

import pytest
from pyspark.sql import functions as F

from regspark.operators import windows as W

DAY = 24 * 3600 * 1_000_000


def thinned(rows, gap_days):
    kept = []
    for repo in {r[0] for r in rows}:
        last = None
        mine = sorted((r for r in rows if r[0] == repo and r[1] is not None), key=lambda r: (-r[1].timestamp(), r[2]))
        for r in mine:
            if last is None or last - r[1] >= datetime.timedelta(days=gap_days):
                kept.append(r[2])
                last = r[1]
    return sorted(kept)


@pytest.mark.parametrize("fold_limit", [10_000, 20, 1])
def test_gap_thinning(spark, fold_limit):
    rng = random.Random(3)
    start = datetime.datetime(2020, 1, 1)
    rows = [("hot" if i % 3 else f"r{rng.randrange(12)}",
             None if rng.random() < 0.05 else start + datetime.timedelta(hours=rng.randrange(24 * 200)), i)
            for i in range(600)]
    df = spark.createDataFrame(rows, "repo string, ts timestamp_ntz, id long")
    out = W.gap_thinning(df, "repo", "ts", "id", 7 * DAY, fold_limit)
    assert sorted(r.id for r in out.collect()) == thinned(rows, 7)


@pytest.mark.parametrize("fold_limit", [10_000, 1])
def test_gap_thinning_keeps_rows_with_null_tie_and_key(spark, fold_limit):
    day = lambda d: datetime.datetime(2024, 1, d)
    rows = [("r", day(20), None), ("r", day(18), 1), ("r", day(10), None), ("r", day(10), 4), (None, day(9), 7),
            (None, day(1), None), (None, day(3), 8), ("r", None, 9)]
    df = spark.createDataFrame(rows, "repo string, ts timestamp_ntz, id long")
    out = W.gap_thinning(df, "repo", "ts", "id", 7 * DAY, fold_limit).collect()
    want = [("r", day(20), None), ("r", day(10), 4), (None, day(9), 7), (None, day(1), None)]
    assert sorted(map(tuple, out), key=repr) == sorted(want, key=repr)


def test_pointers_across_chunks(spark):
    rng = random.Random(8)
    rows = sorted({("r", rng.randrange(10**6)) for _ in range(500)})
    df = spark.createDataFrame([(r, t, i) for i, (r, t) in enumerate(rows)], "repo string, _t long, id long")
    got = sorted(r["_t"] for r in W._thin_by_pointers(df, "repo", "id", 7000, task_rows=20).collect())
    want, last = [], None
    for _, t in reversed(rows):
        if last is None or last - t >= 7000:
            want.append(t)
            last = t
    assert got == sorted(want)


def test_gap_is_measured_from_the_last_kept(spark):
    days = [20, 15, 12, 5]
    rows = [("r", datetime.datetime(2024, 1, d), d) for d in days]
    df = spark.createDataFrame(rows, "repo string, ts timestamp_ntz, id long")
    assert sorted(r.id for r in W.gap_thinning(df, "repo", "ts", "id").collect()) == [5, 12, 20]


def test_sentinel_fill_rows_before_a_marker_stay_null(spark):
    rows = [(1, "x", None), (2, "#/#", "q1"), (3, "y", None), (4, "#/#", "q2"), (5, "#/#", "q3"), (6, "z", None)]
    df = spark.createDataFrame(rows, "seq long, name string, q string")
    out = W.sentinel_fill(df, F.col("name") == "#/#", F.col("q"), F.col("seq"))
    assert sorted((r["name"], r["query"]) for r in out.collect()) == [("x", None), ("y", "q1"), ("z", "q3")]


def test_joint_ccdf_covers_gaps_and_zero_tail(spark):
    rows = [(1, 9), (9, 1), (3, 3), (0, 4)]
    df = spark.createDataFrame(rows, "repo_count long, layer_count long")
    got = {r["x"]: r["ccdf"] for r in W.joint_ccdf(df).collect()}
    want = {x: sum(a >= x and b >= x for a, b in rows) / 4 for x in range(1, 10)}
    assert got == want


def test_cumulative_months_fills_gaps(spark):
    rows = [(1, "2024-01", True), (2, "2024-04", False)]
    df = spark.createDataFrame(rows, "repo_id long, month_key string, has_secret boolean")
    got = [tuple(r) for r in W.cumulative_months(df).orderBy("month_key").collect()]
    assert got == [("2024-01", 1, 1), ("2024-02", 1, 1), ("2024-03", 1, 1), ("2024-04", 2, 1)]


def test_cumulative_weighted_share(spark):
    rows = [("2024-01", 2.0, 1.0), ("2024-02", 0.0, 0.0), ("2024-03", None, None)]
    df = spark.createDataFrame(rows, "month_key string, total_repos_weighted double, repos_with_secret_weighted double")
    got = [tuple(r) for r in W.cumulative_weighted(df).orderBy("month_key").collect()]
    assert got == [("2024-01", 2.0, 1.0, 0.5), ("2024-02", 2.0, 1.0, 0.0), ("2024-03", 2.0, 1.0, 0.0)]


def test_ranks_and_labels(spark):
    df = spark.createDataFrame([("q", 10), ("q", 30), ("q", 20), ("p", 5)], "query string, seq long")
    ranked = W.rank_label(W.rank_in_query(df, ["query"], F.col("seq")), "query")
    assert sorted(map(tuple, ranked.collect())) == [
        ("p", 5, 1, 1), ("q", 10, 1, 3), ("q", 20, 2, 2), ("q", 30, 3, 1)]
    assert W.min_group_filter(df, "query", 2).count() == 3


def test_pointers_at_one_instant_are_split(spark, monkeypatch):
    """Half of all instants point at the same one; null is a group like any other."""
    times = [*range(0, 4000, 10), *range(20_000, 20_400), 40_000, 60_000]
    rows = [(g, t, i) for g in ("r", None) for i, t in enumerate(times)]
    df = spark.createDataFrame(rows, "repo string, _t long, id long")
    salts = []
    spread = W.spread_join

    def watched(left, right, on, by, **more):
        out = spread(left, right, on, by, **more)
        salts.append("_salts" in out._jdf.queryExecution().analyzed().toString())
        return out

    monkeypatch.setattr(W, "spread_join", watched)
    got = sorted(((r.repo, r["_t"]) for r in W._thin_by_pointers(df, "repo", "id", 15_000, task_rows=100).collect()), key=repr)
    assert got == sorted([(g, t) for g in ("r", None) for t in (60_000, 40_000, 20_399, 3990)], key=repr)
    assert salts[0]
