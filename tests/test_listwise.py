"""Listwise gradients against plain sums over pairs, and what the trees learn."""

import math
import random

import pytest
from pyspark.sql import functions as F
from regspark.operators import listwise as L
from regspark.operators import ranking as R
from regspark.plans.ranking import ranking_plan


def brute(rows, top, sigma):
    """{(query, rank): [gradient, weight]} of (query, rank, label, score) rows."""
    found = {r[:2]: [0.0, 0.0] for r in rows}
    for q in {r[0] for r in rows}:
        if q is None:
            continue
        group = [r for r in rows if r[0] == q]
        group.sort(key=lambda r: (r[3] is not None, -(r[3] or 0.0), r[1]))
        labels = sorted((r[2] or 0.0 for r in group), reverse=True)
        ideal = sum(x / math.log2(i + 2) for i, x in enumerate(labels))
        for i, a in enumerate(group):
            for j, b in enumerate(group):
                if i < j and i < top and None not in (a[2], b[2], a[3], b[3]) and a[2] != b[2] and ideal > 0:
                    high, low = (a, b) if a[2] > b[2] else (b, a)
                    rho = 1 / (1 + math.exp(sigma * (high[3] - low[3])))
                    change = abs(a[2] - b[2]) * abs(1 / math.log2(i + 2) - 1 / math.log2(j + 2)) / ideal
                    found[high[:2]][0] += sigma * rho * change
                    found[low[:2]][0] -= sigma * rho * change
                    for r in (a, b):
                        found[r[:2]][1] += sigma * sigma * rho * (1 - rho) * change
    return found


@pytest.mark.parametrize("task_rows", [1_000_000, 15])
@pytest.mark.parametrize("top", [3, 30])
def test_gradients_are_sums_over_pairs(spark, top, task_rows):
    rnd = random.Random(top)
    rows = [(q, r, float(rnd.randrange(4)), rnd.choice([0.0, 0.5, 1.0, rnd.random()]))
            for q, n in {"a": 1, "b": 2, "c": 12, "hot": 60, "d": 7}.items() for r in range(1, n + 1)]
    rows += [("even", r, 2.0, rnd.random()) for r in range(1, 5)] + [("zero", r, 0.0, 1.0) for r in range(1, 4)]
    df = spark.createDataFrame(rows, "query string, rank long, label double, score double").repartition(4)
    found = L.lambda_gradients(df, top=top, sigma=2.0, task_rows=task_rows).collect()
    expected = brute(rows, top, 2.0)
    assert len(found) == len(rows)
    for r in found:
        assert (r.gradient, r.weight) == pytest.approx(expected[r.query, r.rank], abs=1e-9)


def test_missing_values_form_no_pairs(spark):
    rows = [("a", 1, 3.0, 0.1), ("a", 2, 1.0, 0.4), ("a", 3, 2.0, None), (None, 1, 1.0, 0.5), (None, 2, 2.0, 0.1)]
    df = spark.createDataFrame(rows, "query string, rank long, label double, score double")
    found = {(r.query, r.rank): (r.gradient, r.weight) for r in L.lambda_gradients(df).collect()}
    expected = brute(rows, 30, 1.0)
    for key, values in expected.items():
        assert found[key] == pytest.approx(values, abs=1e-9)
    assert found["a", 1][0] > 0 and found["a", 3] == found[None, 1] == (0, 0)
    assert L.lambda_gradients(df.limit(0)).count() == 0


FEATURES = ["useful", "size", "kind"]


def planted(spark, queries=80, length=20):
    """Order inside a query follows ``useful`` and ``kind``; ``size`` differs between
    queries a thousandfold and moves the labels of whole lists, not their order."""
    rnd = random.Random(9)
    rows = []
    for q in range(queries):
        n = length + q % 15
        size = 1000.0 * rnd.random()
        group = [(rnd.random(), rnd.randrange(4)) for _ in range(n)]
        value = {i: u + (0.5, 0.0, 0.8, 0.2)[k] for i, (u, k) in enumerate(group)}
        for rank, i in enumerate(sorted(value, key=lambda i: -value[i]), 1):
            rows.append((f"q{q:03d}", rank, group[i][0], size + group[i][0] * 0.01, group[i][1]))
    return spark.createDataFrame(rows, "query string, rank long, useful double, size double, kind int")


def test_listwise_is_at_least_as_good_as_pointwise_on_held_out_queries(spark):
    rows = planted(spark)
    how = {"features": FEATURES, "min_rows": 5}
    listwise = ranking_plan(rows, categorical=("kind",), rounds=6, depth=4, rate=0.3, least_rows=5, **how)
    pointwise = ranking_plan(rows, fit=lambda df: R.fit_rank_model(df, FEATURES, trees=6, depth=4), **how)
    found, other = listwise["quality"].first(), pointwise["quality"].first()
    assert found.queries == other.queries > 5
    assert found.ndcg >= other.ndcg and found.ndcg > 0.97 and found.spearman > 0.85
    scored = listwise["scored"]
    assert scored.filter("is_train = 1").count() == 0 and scored.columns[-1] == "score"
    again = listwise["per_query"].agg(F.avg("ndcg")).first()[0]
    assert again == pytest.approx(found.ndcg)


def test_categories_are_split_as_such_and_new_ones_are_scored(spark):
    rows = planted(spark, 30).withColumn("label", 50 - F.col("rank"))
    model = L.fit_listwise(rows, features=FEATURES, categorical=("kind",), rounds=2, depth=3, least_rows=5)
    assert len(model.trees) == 2 and "in {" in model.trees[0].toDebugString
    new = rows.limit(5).withColumn("kind", F.lit(77))
    assert model.score(new).filter("score is null or isnan(score)").count() == 0


def test_short_lists_and_equal_labels_give_no_trees(spark):
    df = spark.createDataFrame([("a", i, 1.0, 2.0, 0, 1.0) for i in range(6)],
                               "query string, rank long, useful double, size double, kind int, label double")
    model = L.fit_listwise(df, features=FEATURES, categorical=("kind",), rounds=3)
    assert model.trees == () and {r.score for r in model.score(df).collect()} == {0.0}


def test_discounts_are_not_computed_again_for_every_pair(spark):
    from regspark.operators.listwise import lambda_gradients
    from regspark.operators.ranking import ideal_gain
    from regspark.session import cut_lineage

    df = spark.createDataFrame([("a", i, i, float(i % 3)) for i in range(9)], "query string, rank long, label long, score double")
    found = lambda_gradients(df, ideal=cut_lineage(ideal_gain(df, "query")))
    assert "LOG2" not in found._jdf.queryExecution().optimizedPlan().toString().upper()
