"""Ranking quality per query, in batch over all queries.

Ties and ranks come from counted values, so a query that owns a third of the
rows, or a score that most of its rows share, is still spread over tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions.textmatch import FEATURES
from regspark.operators.running import TASK_ROWS, null_safe_join, positions, running, running_sum
from regspark.operators.windows import min_group_filter
from regspark.session import cut_lineage


def average_ranks(df: DataFrame, by: str, value: str, out: str) -> DataFrame:
    """(by, value, rank) for the distinct values of each group, ties sharing
    the mean rank."""
    counts = df.groupBy(by, value).agg(F.count(F.lit(1)).alias("_n"))
    before = running(counts, [by], F.col(value), {"_b": running_sum(F.col("_n"), inclusive=False)})
    return before.select(by, value, (F.col("_b") + (F.col("_n") + 1) / 2.0).alias(out))


def spearman_per_group(df: DataFrame, by: str, rank: str = "rank", score: str = "score",
                       min_rows: int = 5) -> DataFrame:
    """Spearman correlation of rank and falling score; groups that are too
    small or have no defined correlation are left out. The three columns are
    stored once, since ranking each of two of them reads them again."""
    slim = df.select(by, F.col(rank).cast("double").alias("_x"), (-F.col(score).cast("double")).alias("_y"))
    rows = cut_lineage(min_group_filter(slim, by, min_rows))
    ranked = rows.join(average_ranks(rows, by, "_x", "_rx"), [by, "_x"]).join(
        average_ranks(rows, by, "_y", "_ry"), [by, "_y"])
    spread = F.stddev_pop("_rx") * F.stddev_pop("_ry")
    return ranked.groupBy(by).agg(
        (F.covar_pop("_rx", "_ry") / F.nullif(spread, F.lit(0.0))).alias("spearman")
    ).filter(F.col("spearman").isNotNull())


def _gain_blocks(df: DataFrame, by: str, gain: Column, order: Column, tie: str,
                 task_rows: int = TASK_ROWS) -> DataFrame:
    """DCG per group, tied rows sharing their mean gain. Positions inside a tie
    only serve to add up its discounts, so any order within it will do."""
    rows = df.select(by, gain.cast("double").alias("_g"), (-order.cast("double")).alias("_o"),
                     F.xxhash64(tie).alias("_tie"))
    placed = positions(rows, [by], F.col("_o"), F.col("_tie"), "_pos", task_rows)
    discount = F.lit(1.0) / F.log2(F.col("_pos") + 1.0)
    blocks = placed.groupBy(by, "_o").agg(F.sum(discount).alias("_d"), F.avg("_g").alias("_g"))
    return blocks.groupBy(by).agg(F.sum(F.col("_d") * F.col("_g")).alias("dcg"))


def ideal_gain(df: DataFrame, by: str, label: str = "label", tie: str = "rank",
               task_rows: int = TASK_ROWS) -> DataFrame:
    """(by, ideal): the gain of each query in the order of its labels."""
    return _gain_blocks(df, by, F.col(label), F.col(label), tie, task_rows).withColumnRenamed("dcg", "ideal")


def ndcg_per_group(df: DataFrame, by: str, label: str = "label", score: str = "score",
                   tie: str = "rank", task_rows: int = TASK_ROWS) -> DataFrame:
    """NDCG over the whole list with linear gain; equal scores share gain.
    ``tie`` is any column that differs between the rows of a group. Rows without
    score share the first places, as if they scored highest."""
    rows = cut_lineage(df.select(by, label, score, tie))
    got = _gain_blocks(rows, by, F.col(label), F.col(score), tie, task_rows)
    best = ideal_gain(rows, by, label, tie, task_rows)
    return null_safe_join(got, best, [by]).select(
        by, F.when(F.col("ideal") > 0, F.col("dcg") / F.nullif(F.col("ideal"), F.lit(0.0)))
        .otherwise(F.lit(0.0)).alias("ndcg"))


def same_score_share(df: DataFrame, by: str, score: str = "score",
                     features: Sequence[str] = FEATURES) -> DataFrame:
    """Neighbours of equal score but different features, over the group size.
    With ties laid out by features, a block of equal scores has as many such
    neighbours as it has distinct feature rows less one."""
    sizes = df.groupBy(by, score, *features).agg(F.count(F.lit(1)).alias("_n"))
    blocks = sizes.groupBy(by, score).agg((F.count(F.lit(1)) - 1).alias("_d"), F.sum("_n").alias("_n"))
    return blocks.groupBy(by).agg(
        (F.sum("_d") / F.sum("_n")).alias("same_score_share"), F.sum("_n").alias("group_size"))


def ranking_quality(df: DataFrame, by: str, rank: str = "rank", label: str = "label",
                    score: str = "score", features: Sequence[str] = FEATURES) -> DataFrame:
    """Means over the groups with a defined Spearman correlation. The ranked
    rows are stored once for the three measures."""
    rows = cut_lineage(df.select(by, rank, label, score, *features))
    per_group = cut_lineage(spearman_per_group(rows, by, rank, score))
    rest = rows.join(per_group.select(by), by, "left_semi")
    return per_group.join(ndcg_per_group(rest, by, label, score, rank), by).join(
        same_score_share(rest, by, score, features), by).agg(
        F.count(F.lit(1)).alias("queries"), F.avg("spearman").alias("spearman"),
        F.avg("ndcg").alias("ndcg"), F.avg("same_score_share").alias("same_score_share"))


def dummy_rank_rule(df: DataFrame, by: str, rank: str = "rank", score: str = "score",
                    dummy_score: str = "dummy_score", task_rows: int = TASK_ROWS) -> DataFrame:
    """Would a repository named exactly as the query already be inside the
    ranking? A dummy row joins each query at the end; with 0-based positions by
    falling score, the answer is ``dummy_position <= floor(rho * (n + 1))``,
    rho being the rank correlation of the n real rows, not below 0. ``rank`` is
    0-based; null for fewer than two rows. Equal scores keep rank order."""
    real = df.select(by, F.col(rank).cast("long").alias("_r"), F.col(score).cast("double").alias("_s"),
                     F.lit(0).alias("_dummy"))
    dummies = df.groupBy(by).agg(
        F.count(F.lit(1)).alias("_r"), F.max(dummy_score).cast("double").alias("_s")
    ).withColumn("_dummy", F.lit(1))
    placed = positions(cut_lineage(real.unionByName(dummies)), [by], -F.col("_s"), F.col("_r"), "_p", task_rows)
    at = F.col("_p") - 1
    gap = (F.col("_r") - at).cast("double")
    summed = placed.groupBy(by).agg(
        F.sum(F.when(F.col("_dummy") == 0, gap * gap)).alias("_d2"),
        F.count_if(F.col("_dummy") == 0).alias("n"),
        F.max(F.when(F.col("_dummy") == 1, at)).alias("dummy_position"))
    n = F.col("n").cast("double")
    rho = F.when(n >= 2, F.greatest(
        1 - F.try_divide(6 * F.col("_d2"), n * (n * n - 1)), F.lit(0.0)))
    return summed.withColumn("rho", rho).select(
        by, "n", "dummy_position", "rho",
        (F.col("dummy_position") <= F.floor(F.col("rho") * (F.col("n") + 1))).alias("inside"))


def fit_rank_model(df: DataFrame, features: Sequence[str] = FEATURES, label: str = "label",
                   trees: int = 20, depth: int = 5, seed: int = 42):
    """Pointwise gradient-boosted trees on the rank label. Feature order is
    fixed by the assembler that travels with the model."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assemble = VectorAssembler(inputCols=list(features), outputCol="features")
    boost = GBTRegressor(featuresCol="features", labelCol=label, predictionCol="score",
                         maxIter=trees, maxDepth=depth, seed=seed)
    return Pipeline(stages=[assemble, boost]).fit(df)


def score_rows(model, df: DataFrame) -> DataFrame:
    return model.transform(df).drop("features")
