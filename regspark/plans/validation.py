"""Sample against population: fifteen bias, distribution and quantile tables,
and the test statistics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators import aggregates as A
from regspark.operators import stats as B
from regspark.operators.running import value_counts
from regspark.session import cut_lineage
from regspark.sources.writers import distribution


def histograms(tags: DataFrame, repositories: DataFrame) -> dict[str, DataFrame]:
    return {
        "last_pushed_month": A.month_histogram(tags, "last_pushed"),
        "status": A.value_histogram(tags, "status"),
        "is_official": A.official_histogram(repositories),
    }


def series_counts(tags: DataFrame, repositories: DataFrame) -> dict[str, DataFrame]:
    """(value, n) of the three number series."""
    epochs = P.epoch_seconds(F.col("last_pushed"))
    return {
        "pull_count": value_counts(repositories, F.col("pull_count")),
        "size": value_counts(tags, F.col("size")),
        "last_pushed_epoch": value_counts(tags.filter(F.col("last_pushed").isNotNull()), epochs),
    }


def run_validation(full_tags: DataFrame, full_repos: DataFrame, sample_tags: DataFrame,
                   sample_repos: DataFrame, selection: DataFrame,
                   keep: Callable[[DataFrame], DataFrame] = cut_lineage) -> dict[str, DataFrame]:
    """All tables by name, plus ``ks_tests`` and ``chi2_tests``. Histograms and
    value counts are stored by ``keep``; every table is read from them."""
    def stored(frames: dict[str, DataFrame]) -> dict[str, DataFrame]:
        return {name: keep(df) for name, df in frames.items()}

    hf, hs = stored(histograms(full_tags, full_repos)), stored(histograms(sample_tags, sample_repos))
    nf, ns = stored(series_counts(full_tags, full_repos)), stored(series_counts(sample_tags, sample_repos))
    out: dict[str, DataFrame] = {}
    for name in hf:
        out[f"bias_{name}"] = B.bias_table(hf[name], hs[name]).orderBy("key")
        out[f"dist_full_{name}"] = distribution(hf[name])
        out[f"dist_sample_{name}"] = distribution(hs[name])
    for name in ("pull_count", "size"):
        out[f"bias_{name}_bins"] = B.bias_bins_of_counts(nf[name], ns[name])
    for name in nf:
        out[f"quantiles_{name}"] = A.union_all(
            B.quantile_series_of_counts(nf[name], f"full_{name}"),
            B.quantile_series_of_counts(ns[name], f"sample_{name}"))
    out["unique_layer_share"] = A.unique_layer_share(selection)
    out["ks_tests"] = A.union_all(*(
        B.ks_of_counts(nf[n], ns[n]).withColumn("variable", F.lit(n)) for n in nf))
    out["chi2_tests"] = A.union_all(*(
        B.chi2_gof(hf[n], hs[n]).withColumn("variable", F.lit(n)) for n in ("status", "is_official")))
    return out


def study_biases(validation: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """The weights the study takes from a validation run."""
    keyed = {"month": "bias_last_pushed_month", "status": "bias_status", "is_official": "bias_is_official"}
    out = {name: validation[table].select("key", "bias_full_over_sample") for name, table in keyed.items()}
    out["pull_count"] = validation["bias_pull_count_bins"]
    return out
