"""Running aggregates, quantiles and skewed joins against brute force, with
one group holding far more than its share."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspark.operators import joins as J
from regspark.operators import windows as W
from regspark.operators.running import (
    exact_quantiles,
    positions,
    running,
    running_count,
    running_last,
    running_max,
    running_sum,
)


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(5)
    rows = [("hot" if i % 3 else f"g{rng.randrange(40)}", i, rng.randrange(50), rng.choice([None, i]))
            for i in range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "g string, seq long, v long, m long")


@pytest.mark.parametrize("task_rows", [10, 100, 10_000])
def test_running_matches_brute_force(skewed, task_rows):
    rows, df = skewed
    out = running(df, ["g"], F.col("seq"), {
        "n": running_count(), "s": running_sum(F.col("v")), "before": running_sum(F.col("v"), inclusive=False),
        "top": running_max(F.col("v")), "fill": running_last(F.col("m"))}, task_rows=task_rows)
    got = {r["seq"]: (r["n"], r["s"], r["before"], r["top"], r["fill"]) for r in out.collect()}
    state, want = {}, {}
    for g, seq, v, m in sorted(rows, key=lambda r: r[1]):
        n, s, top, fill = state.get(g, (0, 0, -1, None))
        state[g] = (n + 1, s + v, max(top, v), fill if m is None else m)
        want[seq] = (state[g][0], state[g][1], s, state[g][2], state[g][3])
    assert got == want


@pytest.mark.parametrize("task_rows", [10, 10_000])
def test_running_without_groups(skewed, task_rows):
    rows, df = skewed
    out = running(df, [], F.col("seq"), {"s": running_sum(F.col("v"))}, task_rows=task_rows)
    got = {r["seq"]: r["s"] for r in out.collect()}
    total = 0
    for _, seq, v, _ in sorted(rows, key=lambda r: r[1]):
        total += v
        assert got[seq] == total


@pytest.mark.parametrize("task_rows", [10, 100, 10_000])
def test_positions_with_long_ties(skewed, task_rows):
    rows, df = skewed
    out = positions(df, ["g"], F.col("v") % 2, F.col("seq"), task_rows=task_rows)
    got = {r["seq"]: r["position"] for r in out.collect()}
    for g in {r[0] for r in rows}:
        ordered = sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] % 2, r[1]))
        assert [got[r[1]] for r in ordered] == list(range(1, len(ordered) + 1))


@pytest.mark.parametrize("task_rows", [1, 5, 10_000])
def test_positions_with_nulls(spark, task_rows):
    rng = random.Random(4)
    rows = [(rng.choice(["a", None]), rng.choice([None, 0.0, -0.0, 1.5, float("nan")]), rng.choice([None, i]), i)
            for i in range(120)]
    df = spark.createDataFrame(rows, "g string, o double, tie long, id long")
    out = positions(df, ["g"], F.col("o"), F.col("tie"), task_rows=task_rows).collect()
    assert sorted(r["id"] for r in out) == list(range(120))
    rank = lambda o: (0, 0) if o is None else (2, 0) if o != o else (1, o)
    for g in ("a", None):
        mine = sorted((r for r in out if r["g"] == g), key=lambda r: r["position"])
        assert [r["position"] for r in mine] == list(range(1, len(mine) + 1))
        keys = [(rank(r["o"]), -1 if r["tie"] is None else r["tie"]) for r in mine]
        assert keys == sorted(keys)


@pytest.mark.parametrize("task_rows", [5, 10_000])
def test_running_with_null_keys_and_order(spark, task_rows):
    rows = [(None if i % 2 else "a", None if i % 7 == 0 else i) for i in range(70)]
    df = spark.createDataFrame(rows, "g string, o long")
    out = running(df, ["g"], F.col("o"), {"n": running_count()}, task_rows=task_rows).collect()
    for g in ("a", None):
        mine = [r for r in out if r["g"] == g and r["o"] is not None]
        assert len(mine) == 30
        assert [r["n"] for r in sorted(mine, key=lambda r: r["o"])] == list(range(6, 36))


@pytest.mark.parametrize("values", [
    [1.0], [3.0, 1.0], [5.0] * 100 + [1.0, 9.0], [float(i * i % 101) for i in range(500)], [-1.5, None, 2.5, float("nan")]])
@pytest.mark.parametrize("task_rows", [3, 10_000])
def test_exact_quantiles_equal_numpy(spark, values, task_rows):
    df = spark.createDataFrame([(v,) for v in values], "v double")
    probs = [i / 20 for i in range(21)]
    got = [r["value"] for r in exact_quantiles(df, F.col("v"), probs, task_rows).orderBy("quantile").collect()]
    clean = [v for v in values if v is not None and v == v]
    assert got == pytest.approx(list(np.quantile(clean, probs)))


def test_sentinel_fill_of_a_large_stream(skewed):
    rows, df = skewed
    out = W.sentinel_fill(df, F.col("v") == 0, F.col("seq"), F.col("seq"), task_rows=10, out="q")
    got = {r["seq"]: r["q"] for r in out.collect()}
    last, want = None, {}
    for _, seq, v, _ in sorted(rows, key=lambda r: r[1]):
        if v == 0:
            last = seq
        else:
            want[seq] = last
    assert got == want


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_spread_join_equals_join(spark, skewed, how):
    _, df = skewed
    right = spark.createDataFrame([("hot", 1), ("hot", 2), ("g1", 3), ("none", 4)], "g string, w int")
    want = sorted(map(tuple, df.join(right, ["g"], how).select("*").collect()), key=repr)
    got = J.spread_join(df, right, ["g"], "seq", how, rows_per_task=50)
    assert sorted(map(tuple, got.collect()), key=repr) == want
