"""Listwise learning to rank: boosted trees on gradients of whole lists.

Every round looks at the lists as they are ranked now. Two rows of a query that
are in the wrong order, or only just in the right one, push each other apart by
what swapping them would change of the query's NDCG. The pushes of a row, over
the curvature of their loss, are what the round's regression tree learns; its
leaves then hold Newton steps.

Pairs are those with at least one row among the first ``top`` of its list. The
first rows of a query are one short array, which meets every row of the query; so
pairs are never rows, and a query that holds most of the data is spread over
tasks like any other. What the first rows receive from all others is summed by
place, with partial sums where the rows are.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions.textmatch import FEATURES
from regspark.operators.joins import spread_join
from regspark.operators.ranking import ideal_gain
from regspark.operators.running import TASK_ROWS, null_safe_join, positions
from regspark.session import cut_lineage

CATEGORICAL = ("query_find",)


def _discount(place: Column) -> Column:
    return F.lit(1.0) / F.log2(place + 1.0)


def lambda_gradients(df: DataFrame, by: str = "query", label: str = "label", score: str = "score", tie: str = "rank",
                     top: int = 30, sigma: float = 1.0, ideal: DataFrame | None = None,
                     task_rows: int = TASK_ROWS) -> DataFrame:
    """The rows with ``gradient``, the push to a higher score, and ``weight``, its
    second derivative.

    A pair of labels a > b at places i and j has the change of NDCG
    ``(a - b) * |discount(i) - discount(j)| / ideal`` and pushes by
    ``sigma / (1 + exp(sigma * (score_a - score_b)))`` times that, up and down.
    Equal scores are placed by ``tie`` (numeric). Rows without query, label or
    score form no pairs (0, 0). ``ideal`` has the best gain of each query
    (``ideal_gain``), if it is known already.
    """
    if ideal is None:
        ideal = ideal_gain(df, by, label, tie, task_rows)
    place, mine, own = F.col("_place"), F.col("_s"), F.col("_l")
    rows = df.withColumns({"_s": F.col(score).cast("double"), "_l": F.col(label).cast("double")})
    placed = cut_lineage(positions(rows, [by], -mine, F.col(tie), "_place", task_rows).withColumn(
        "_discount", _discount(place)))  # stored, so that no pair computes it again
    first = placed.filter((place <= top) & F.col(by).isNotNull()).groupBy(by).agg(F.sort_array(F.collect_list(
        F.struct("_place", F.col("_l").alias("l"), F.col("_s").alias("s"), F.col("_discount").alias("d")))).alias("_first"))
    lists = first.join(ideal.select(by, F.col("ideal").alias("_ideal")), by)
    met = spread_join(placed, lists, [by], tie, "left", task_rows)

    def meet(h: Column) -> Column:
        ahead = F.when(h["l"] > own, h["s"] - mine).otherwise(mine - h["s"])
        rho = 1.0 / (1.0 + F.exp(sigma * ahead))
        change = F.abs(h["l"] - own) * F.abs(h["d"] - F.col("_discount")) / F.col("_ideal")
        pair = (h["_place"] < place) & (h["l"] != own) & h["s"].isNotNull() & mine.isNotNull() & (F.col("_ideal") > 0)
        return F.when(pair, F.struct((F.signum(h["l"] - own) * sigma).alias("way"), rho.alias("rho"), change.alias("change")))

    def push(p: Column) -> Column:
        return F.when(p.isNotNull(), F.struct((p["way"] * p["rho"] * p["change"]).alias("g"),
                                              (sigma * sigma * p["rho"] * (1.0 - p["rho"]) * p["change"]).alias("w"))).otherwise(
            F.struct(F.lit(0.0).alias("g"), F.lit(0.0).alias("w")))

    pairs = met.withColumn("_pairs", F.transform(F.transform("_first", meet), push))

    def total(field: str) -> Column:
        return F.coalesce(F.aggregate("_pairs", F.lit(0.0), lambda s, p: s + p[field]), F.lit(0.0))

    received = pairs.groupBy(by).agg(F.array(*(F.struct(
        F.sum(F.get("_pairs", F.lit(k))["g"]).alias("g"), F.sum(F.get("_pairs", F.lit(k))["w"]).alias("w"))
        for k in range(top))).alias("_sums"))
    sums = received.select(by, F.posexplode("_sums").alias("_k", "_sum")).select(
        by, (F.col("_k") + 1).cast("long").alias("_place"), F.col("_sum.g").alias("_g"), F.col("_sum.w").alias("_w"))
    gave = pairs.withColumns({"_own_g": -total("g"), "_own_w": total("w")}).drop("_pairs", "_first", "_ideal")
    return null_safe_join(gave, sums.filter(F.col(by).isNotNull() & F.col("_g").isNotNull()), [by, "_place"], "left").select(
        *df.columns, (F.col("_own_g") + F.coalesce("_g", F.lit(0.0))).alias("gradient"),
        (F.col("_own_w") + F.coalesce("_w", F.lit(0.0))).alias("weight"))


@dataclass(frozen=True)
class ListwiseModel:
    """What makes feature vectors, the trees, and the share each adds to a score."""

    prepare: object
    trees: tuple
    rate: float

    def score(self, df: DataFrame, out: str = "score") -> DataFrame:
        rows, columns = self.prepare.transform(df), df.columns
        for i, tree in enumerate(self.trees):
            rows = tree.copy({tree.predictionCol: f"_tree_{i}"}).transform(rows)
        total = F.lit(0.0)
        for i in range(len(self.trees)):
            total = total + self.rate * F.col(f"_tree_{i}")
        return rows.select(*(c for c in columns if c != out), total.alias(out))


def feature_pipeline(df: DataFrame, features: Sequence[str] = FEATURES, categorical: Sequence[str] = CATEGORICAL):
    """Features as one vector; categories as such, those not seen are one more."""
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import StringIndexer, VectorAssembler

    named = [c for c in features if c in categorical]
    index = [StringIndexer(inputCol=c, outputCol=f"_index_{c}", handleInvalid="keep") for c in named]
    assemble = VectorAssembler(inputCols=[f"_index_{c}" if c in named else c for c in features], outputCol="_features")
    return Pipeline(stages=[*index, assemble]).fit(df)


def fit_listwise(df: DataFrame, by: str = "query", features: Sequence[str] = FEATURES, label: str = "label",
                 tie: str = "rank", categorical: Sequence[str] = CATEGORICAL, rounds: int = 20, depth: int = 5,
                 rate: float = 0.07, top: int = 30, sigma: float = 1.0, least_rows: int = 30, seed: int = 42,
                 task_rows: int = TASK_ROWS) -> ListwiseModel:
    """Gradient boosting by ``lambda_gradients``: one tree a round, fitted by Spark
    on gradient over weight with that weight. Scores begin at 0."""
    from pyspark.ml.regression import DecisionTreeRegressor

    prepare = feature_pipeline(df, features, categorical)
    categories = max([len(s.labels) + 1 for s in prepare.stages[:-1]], default=0)
    rows = cut_lineage(prepare.transform(df).select(by, tie, label, "_features").withColumn("score", F.lit(0.0)))
    ideal = cut_lineage(ideal_gain(rows, by, label, tie, task_rows))
    trees = []
    for k in range(rounds):
        found = cut_lineage(lambda_gradients(rows, by, label, "score", tie, top, sigma, ideal, task_rows))
        pushed = found.filter(F.col("weight") > 0).withColumn("_target", F.col("gradient") / F.col("weight"))
        if pushed.isEmpty():
            break
        tree = DecisionTreeRegressor(
            featuresCol="_features", labelCol="_target", weightCol="weight", predictionCol="_step", maxDepth=depth,
            minInstancesPerNode=least_rows, maxBins=max(64, categories), seed=seed + k).fit(pushed)
        trees.append(tree)
        rows = tree.transform(found.drop("gradient", "weight")).withColumn(
            "score", F.col("score") + rate * F.col("_step")).drop("_step")
    return ListwiseModel(prepare, tuple(trees), rate)
