"""Counts, sums, exact medians, top-k and set operations of the study.

Rows are combined map-side before any shuffle. Facts joined to a repeated key
are counted per key first, so the join is one row to one row; exact medians
are read from value counts and never gather values in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators.joins import frag_weight_merge, lookup_join, spread_join
from regspark.operators.running import quantiles_of_counts, value_counts
from regspark.session import cut_lineage, stored


def value_histogram(df: DataFrame, c: str | Column, fill: bool = True) -> DataFrame:
    """Rows per value, null and blank counted as ``unknown``."""
    col = F.col(c) if isinstance(c, str) else c
    return df.groupBy((P.blank_to_unknown(col) if fill else col).alias("key")).agg(
        F.count(F.lit(1)).alias("count"))


def month_histogram(df: DataFrame, ts: str) -> DataFrame:
    """Rows per UTC month; rows without a date are not counted."""
    return df.filter(F.col(ts).isNotNull()).groupBy(P.month_key(F.col(ts)).alias("key")).agg(
        F.count(F.lit(1)).alias("count"))


def official_histogram(df: DataFrame, flag: str = "is_official") -> DataFrame:
    return df.groupBy(P.official_cat(F.col(flag)).alias("key")).agg(F.count(F.lit(1)).alias("count"))


def repos_per_month(study: DataFrame) -> DataFrame:
    """Repositories per month from the study frame (one row per repository)."""
    hit = F.col("has_secret")
    return study.groupBy("month_key").agg(
        F.count("repo_id").alias("total_repos"),
        F.sum("weight").alias("total_repos_weighted"),
        F.count_if(hit).alias("repos_with_secret"),
        F.sum(F.when(hit, F.col("weight")).otherwise(F.lit(0.0))).alias("repos_with_secret_weighted"),
    )


def top_k(df: DataFrame, by: str, k: int, tie: str) -> DataFrame:
    return df.orderBy(F.col(by).desc(), F.col(tie).asc()).limit(k)


def head_k(df: DataFrame, order: str, k: int, sort: str) -> DataFrame:
    """First k rows in source order, shown by ``sort`` descending."""
    return df.orderBy(order).limit(k).orderBy(F.col(sort).desc(), order)


def sort_abs(df: DataFrame, c: str) -> DataFrame:
    return df.withColumn("abs_value", F.abs(F.col(c))).orderBy(F.col("abs_value").desc_nulls_last())


def ordered_export(df: DataFrame, key: str) -> DataFrame:
    return df.orderBy(key)


def origin_counts(occ: DataFrame, secrets: DataFrame, drop_blank: bool = False) -> DataFrame:
    """Occurrences of every kind of secret; they are counted per secret first."""
    per_secret = occ.groupBy("secret_id").agg(F.count(F.lit(1)).alias("_n"))
    named = secrets
    if drop_blank:
        named = secrets.filter(F.col("origin").isNotNull() & (F.col("origin") != ""))
    origin = F.col("origin") if drop_blank else P.blank_to_unknown(F.col("origin"))
    return per_secret.join(named.select("secret_id", "origin"), "secret_id").groupBy(
        origin.alias("origin")).agg(F.sum("_n").alias("n"))


def top_origins(occ: DataFrame, secrets: DataFrame, k: int = 20, drop_blank: bool = False) -> DataFrame:
    """The ``k`` most frequent kinds of secret."""
    return top_k(origin_counts(occ, secrets, drop_blank), "n", k, "origin")


def distinct_pairs(df: DataFrame, a: str, b: str) -> DataFrame:
    return df.select(a, b).distinct()


def held_pairs(occ: DataFrame, secrets: DataFrame) -> DataFrame:
    """Distinct (fragment_hash, layer_id) of the secrets' occurrences."""
    held = occ.select("secret_id", "layer_id").distinct()
    return lookup_join(held, secrets.select("secret_id", "fragment_hash"), ["secret_id"], "layer_id").select(
        "fragment_hash", "layer_id").distinct()


def _reached_repos(occ: DataFrame, repo_layers: DataFrame, secrets: DataFrame,
                   links: DataFrame | None = None, holds: DataFrame | None = None) -> DataFrame:
    """(fragment_hash, repo_count, layer_count) over layers that some
    repository has. A secret in one layer only takes that layer's repository
    count; only secrets spread over several layers need their (secret, repo)
    pairs, and hot layers in that join are split by repository. Both pair sets
    are stored once, as three steps read them, unless they come stored already:
    ``links`` (``distinct_pairs``) and ``holds`` (``held_pairs``)."""
    links = stored(distinct_pairs(repo_layers, "layer_id", "repo_id")) if links is None else links
    per_layer = cut_lineage(links.groupBy("layer_id").agg(F.count(F.lit(1)).alias("_repos")))
    holds = stored(held_pairs(occ, secrets)) if holds is None else holds
    reachable = holds.join(per_layer, "layer_id")
    per_secret = reachable.groupBy("fragment_hash").agg(
        F.count(F.lit(1)).alias("layer_count"), F.max("_repos").alias("_repos"))
    many = per_secret.filter(F.col("layer_count") > 1).select("fragment_hash")
    scattered = holds.join(many, "fragment_hash", "left_semi")
    counted = spread_join(links, scattered, ["layer_id"], "repo_id",
                          counts=per_layer.withColumnRenamed("_repos", "_key_rows")).select(
        "fragment_hash", "repo_id").distinct().groupBy("fragment_hash").agg(
        F.count(F.lit(1)).alias("_counted"))
    return per_secret.join(counted, "fragment_hash", "left").select(
        "fragment_hash", F.coalesce("_counted", "_repos").alias("repo_count"), "layer_count")


def _filtered(secrets: DataFrame, where: Column | None) -> DataFrame:
    return secrets if where is None else secrets.filter(where)


def repos_per_secret(occ: DataFrame, repo_layers: DataFrame, secrets: DataFrame,
                     where: Column | None = None) -> DataFrame:
    return _reached_repos(occ, repo_layers, _filtered(secrets, where)).select(
        "fragment_hash", "repo_count")


def secret_repo_layer_counts(secrets: DataFrame, occ: DataFrame, repo_layers: DataFrame,
                             where: Column | None = None, links: DataFrame | None = None,
                             holds: DataFrame | None = None) -> DataFrame:
    """``links`` and ``holds`` are the distinct pairs of layers, if stored already."""
    return _reached_repos(occ, repo_layers, _filtered(secrets, where), links, holds)


def count_distribution(df: DataFrame, c: str = "repo_count", out: str = "secret_count") -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias(out))


def layer_uniqueness(repo_layers: DataFrame) -> DataFrame:
    """1 for layers of exactly one repository. Smallest and largest id being
    equal says so without a distinct count."""
    return repo_layers.groupBy("layer_id").agg(
        (F.min("repo_id") == F.max("repo_id")).cast("int").alias("is_unique"))


def weighted_layer_count(pairs: DataFrame, uniq: DataFrame, weights: DataFrame) -> DataFrame:
    counts = pairs.select("fragment_hash").distinct()
    return frag_weight_merge(counts, pairs, uniq, weights)


def filetype_frequency(occ: DataFrame) -> DataFrame:
    return occ.groupBy(P.blank_to_unknown(F.col("file_type")).alias("file_type")).agg(
        F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), "file_type")


def _mean(counts: DataFrame) -> Column:
    return counts.agg(F.sum(F.col("value") * F.col("n")) / F.sum("n")).scalar()


def _median(counts: DataFrame) -> Column:
    return quantiles_of_counts(counts, [0.5]).select("value").scalar()


def _one_row_frame(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1).select()


def file_size_stats(occ: DataFrame) -> DataFrame:
    """Mean and exact median of the known file sizes, both from one pass that
    counts the distinct sizes."""
    counts = cut_lineage(value_counts(occ, F.col("file_size")))
    return _one_row_frame(occ).select(
        _mean(counts).alias("avg_file_size"), _median(counts).alias("median_file_size"))


def layer_stats(occ: DataFrame, layers: DataFrame,
                columns: Sequence[str] = ("max_depth", "file_count", "uncompressed_size")) -> DataFrame:
    """Mean and exact median of layer facts, once per occurrence. Occurrences
    are counted per layer, and the counts act as weights."""
    weighted = cut_lineage(occ.groupBy("layer_id").agg(F.count(F.lit(1)).alias("_n")).join(
        layers.select("layer_id", *columns), "layer_id"))
    out = []
    for c in columns:
        counts = cut_lineage(weighted.filter(F.col(c).isNotNull()).groupBy(
            F.col(c).cast("double").alias("value")).agg(F.sum("_n").alias("n")))
        out += [_mean(counts).alias(f"avg_{c}"), _median(counts).alias(f"median_{c}")]
    return _one_row_frame(occ).select(*out)


# Fixed value: share of layers found in one repository only, full population.
FULL_UNIQUE_SHARE = 0.2820


def unique_layer_share(selection: DataFrame, full: float = FULL_UNIQUE_SHARE) -> DataFrame:
    """Layers in total and in one repository only, with the share and its
    distance from the population's."""
    count = F.col("repo_count") if "repo_count" in selection.columns else F.lit(None).cast("int")
    listed = F.coalesce(F.size("repos"), F.lit(0)) if "repos" in selection.columns else F.lit(0)
    held = F.coalesce(count, F.greatest(listed, F.lit(0)))
    counted = selection.agg(F.count(F.lit(1)).alias("total_layers"),
                            F.count_if(held == 1).alias("unique_layers"))
    share = F.try_divide(F.col("unique_layers"), F.col("total_layers"))
    return counted.select(
        "total_layers", "unique_layers", share.alias("unique_share_sample"),
        F.lit(full).alias("unique_share_full_reference"), (share - F.lit(full)).alias("bias_abs_diff"))


def layer_file_summary(files: DataFrame, hits: DataFrame | None = None) -> DataFrame:
    """Per layer: files with content, deepest path, bytes, and how many
    distinct secret fragments it holds (``hits``: layer, fragment_hash)."""
    full = files.filter(F.col("text").isNotNull() & (F.col("text") != ""))
    facts = full.groupBy("layer").agg(
        F.countDistinct("file").alias("file_count"),
        F.max(P.path_depth(F.col("file"))).alias("max_depth"),
        F.sum(F.octet_length("text")).alias("uncompressed_size"))
    if hits is None:
        return facts
    found = hits.select("layer", "fragment_hash").distinct().groupBy("layer").agg(
        F.count(F.lit(1)).alias("_s"))
    return facts.join(found, "layer", "left").select(
        *facts.columns, F.coalesce("_s", F.lit(0)).alias("secret_fragments"))


def collection_counters(df: DataFrame, file: str, is_marker: Column, key: str, order: str) -> DataFrame:
    """Per file: queries (markers), repository rows, and repositories first
    seen in that file over the whole input order."""
    per_file = df.groupBy(file).agg(
        F.count_if(is_marker).alias("total_queries"), F.count_if(~is_marker).alias("total_repos"))
    first = df.filter(~is_marker & F.col(key).isNotNull()).groupBy(key).agg(
        F.min_by(file, order).alias(file)).groupBy(file).agg(F.count(F.lit(1)).alias("_u"))
    return per_file.join(first, file, "left").select(
        *per_file.columns, F.coalesce("_u", F.lit(0)).alias("unique_repos"))


def category_rollup(df: DataFrame, origin: str = "origin", n: str = "n") -> DataFrame:
    """Counts per category; ``df`` has the counts of all kinds (``origin_counts``)."""
    return df.groupBy(P.origin_category(F.col(origin)).alias("category")).agg(
        F.sum(n).alias("n")).orderBy(F.col("n").desc(), "category")


def contingency(df: DataFrame, cat: str, flag: str = "has_secret", weight: str = "weight",
                *more: Column) -> DataFrame:
    """Weight per category with and without the flag; empty cells are 0.
    ``more`` aggregates are added."""
    def cell(value: bool) -> Column:
        return F.sum(F.when(F.col(flag) == F.lit(value), F.col(weight)).otherwise(F.lit(0.0)))

    return df.groupBy(cat).agg(
        cell(False).alias(f"{flag}=False"), cell(True).alias(f"{flag}=True"), *more)


def first_seen_curve(df: DataFrame, key: str, batch: str) -> DataFrame:
    """How many keys each batch showed for the first time."""
    return df.groupBy(key).agg(F.min(batch).alias(batch)).groupBy(batch).agg(
        F.count(F.lit(1)).alias("new_keys"))


def byte_total(df: DataFrame, key: str, size: str, order: str | None = None) -> DataFrame:
    """Bytes over distinct keys, each with the size of its first row."""
    one = F.min_by(size, order) if order else F.first(size, ignorenulls=True)
    return df.groupBy(key).agg(one.alias("_s")).agg(
        F.count(F.lit(1)).alias("unique_keys"), F.sum("_s").alias("total_bytes"))


def union_all(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for df in dfs[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def sort_unique(df: DataFrame, key: str) -> DataFrame:
    return df.dropDuplicates([key])


def unique_repos(df: DataFrame, seen: DataFrame, name: str = "repo_name") -> DataFrame:
    """Distinct repository names not seen before, marker rows left out."""
    fresh = P.drop_sentinel(df, name).filter(F.col(name).isNotNull()).select(name).distinct()
    return fresh.join(seen.select(name).distinct(), name, "left_anti")
