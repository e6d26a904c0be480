"""Learning to rank: from ranked rows with features to quality on held-out queries."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame

from regspark.functions.textmatch import FEATURES
from regspark.operators import ranking as R
from regspark.operators.listwise import fit_listwise
from regspark.operators.sampling import group_split
from regspark.operators.windows import min_group_filter, rank_label
from regspark.session import cut_lineage


def ranking_plan(rows: DataFrame, by: str = "query", rank: str = "rank", features: Sequence[str] = FEATURES,
                 min_rows: int = 5, train_share: float = 0.8, seed: str | int = 42,
                 fit: Callable[[DataFrame], object] | None = None, **settings) -> dict[str, DataFrame]:
    """Queries of at least ``min_rows`` rows, labels from ranks, a split by whole
    queries, a listwise model of the training queries, and what it is worth:

    ``scored``: held-out rows with label and score; ``per_query``: Spearman, NDCG and
    the share of neighbours of equal score of each; ``quality``: their means.
    ``fit`` gives another model (anything with ``score`` or ``transform``),
    ``settings`` go to ``fit_listwise``.
    """
    split = cut_lineage(group_split(rank_label(min_group_filter(rows, by, min_rows), by, rank), by, train_share, seed))
    train, held_out = split.filter("is_train = 1"), split.filter("is_train = 0")
    model = fit(train) if fit else fit_listwise(train, by, features, "label", rank, **settings)
    scored = cut_lineage(model.score(held_out) if hasattr(model, "score") else R.score_rows(model, held_out))
    per_query = R.spearman_per_group(scored, by, rank, "score", min_rows).join(
        R.ndcg_per_group(scored, by, "label", "score", rank), by).join(
        R.same_score_share(scored, by, "score", features), by)
    return {"scored": scored, "per_query": per_query,
            "quality": R.ranking_quality(scored, by, rank, "label", "score", features)}
