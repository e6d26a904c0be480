"""The empirical study: twelve result tables from the imported tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators import aggregates as A
from regspark.operators import stats as B
from regspark.operators import windows as W
from regspark.operators.joins import frag_weight_merge
from regspark.session import stored


def run_study(tables: dict[str, DataFrame], biases: dict[str, DataFrame] | None = None,
              unique_share: DataFrame | None = None, where: Column | None = None,
              seed: str | int = 42,
              keep: Callable[[DataFrame], DataFrame] = stored) -> dict[str, DataFrame]:
    """``tables``: repositories, tags, layers, repo_layers, secrets,
    occurrences. ``where`` selects the secrets that count (default all).
    ``keep`` stores what feeds several results: the distinct links and held pairs,
    the layers' uniqueness, the study frame and the counts per secret; all results
    are lazy."""
    t = tables
    chosen = t["secrets"] if where is None else t["secrets"].filter(where)
    links = keep(A.distinct_pairs(t["repo_layers"], "layer_id", "repo_id"))
    pairs = keep(A.held_pairs(t["occurrences"], chosen))
    unique = keep(A.layer_uniqueness(links))
    study = keep(B.repo_study_frame(t["repositories"], t["tags"], links, t["occurrences"],
                                    biases, seed))
    counts = keep(A.secret_repo_layer_counts(chosen, t["occurrences"], links, links=links, holds=pairs))
    per_secret = counts.select("fragment_hash", "repo_count")
    share = unique_share if unique_share is not None else t["layers"].sparkSession.range(1).select(
        F.lit(None).cast("double").alias("unique_share_sample"))
    weights = B.unique_bias_weights(share)
    out = {
        "repos_with_secret_per_month": A.repos_per_month(study).orderBy("month_key"),
        "secret_origin_counts": A.origin_counts(t["occurrences"], chosen),
        "top20_secret_origin": A.top_origins(t["occurrences"], chosen),
        "secret_repo_counts_per_secret": per_secret,
        "secret_repo_counts_distribution": A.count_distribution(per_secret),
        "secret_repo_layer_counts_weighted": frag_weight_merge(
            counts, pairs, unique, weights, is_stored=True),
        "metadata_association_metrics": B.association_metrics(study),
        "secrets_filetype_frequency": A.filetype_frequency(t["occurrences"]),
        "secrets_file_stats": A.file_size_stats(t["occurrences"]),
        "secrets_layer_stats": A.layer_stats(t["occurrences"], t["layers"]),
    }
    for cat in ("status_cat", "is_official_cat", "is_automated_cat"):
        out[f"contingency_{cat}"] = A.contingency(study, cat)
    return out


def plot_tables(results: dict[str, DataFrame], study: DataFrame) -> dict[str, DataFrame]:
    """The series behind the study's figures, from its result tables."""
    monthly = P.date_range_filter(results["repos_with_secret_per_month"], "month_key")
    return {
        "cumulative_weighted": W.cumulative_weighted(monthly),
        "cumulative_months": W.cumulative_months(study),
        "origin_categories": A.category_rollup(results["secret_origin_counts"]),
        "repo_count_ccdf": W.ccdf(results["secret_repo_counts_distribution"]),
        "repo_layer_joint_ccdf": W.joint_ccdf(results["secret_repo_layer_counts_weighted"]),
        "association_strengths": A.sort_abs(results["metadata_association_metrics"], "value"),
        "file_types": A.head_k(results["secrets_filetype_frequency"].withColumn(
            "_neg", -F.col("n")), "_neg", 19, "n").drop("_neg"),
    }
