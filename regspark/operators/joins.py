"""Joins of the import and of the study.

A side is broadcast by hint only after its rows were counted; otherwise the
optimizer decides by its statistics, and adaptive execution splits skewed
shuffle partitions. Where both sides can repeat a key, ``spread_join`` counts
the keys and splits the hot ones itself.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators.running import BROADCAST_ROWS, TASK_ROWS, hot_keys, null_safe_join, one_row
from regspark.operators.sampling import one_per_group
from regspark.session import cut_lineage, stored


# A side of at most this many bytes may be broadcast.
BROADCAST_BYTES = 64 << 20


def spread_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: str,
                how: str = "inner", rows_per_task: int = TASK_ROWS, counts: DataFrame | None = None) -> DataFrame:
    """Equi-join that splits the hot keys of the left side.

    Rows per key are counted, unless ``counts`` has them (``hot_keys``). Without a key beyond ``rows_per_task`` this is a
    plain join. Otherwise each hot key gets as many salts as it fills tasks;
    its left rows are dealt out by ``spread``, which must vary within a key,
    and only its right rows are repeated, once per salt. Rows of a null key
    match nothing, but are dealt out like any other.
    """
    on = list(on)
    found = hot_keys(left, on, rows_per_task, counts)
    if found is None:
        return left.join(right, on, how)
    keys, bound = found
    hot = F.broadcast(keys.select(*on, F.ceil(F.col("_key_rows") / bound).cast("int").alias("_salts")))
    salts = F.coalesce("_salts", F.lit(1))
    dealt = null_safe_join(left, hot, on, "left").withColumn("_salt", F.pmod(F.xxhash64(spread), salts).cast("int"))
    copies = right.join(hot, on, "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), salts - 1)))
    return dealt.drop("_salts").join(copies.drop("_salts"), [*on, "_salt"], how).drop("_salt")


def is_short(df: DataFrame, rows: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> bool:
    """Whether a frame has at most ``rows`` rows and ``size`` bytes of values;
    stops reading once it has more rows."""
    def width(name: str, kind: str) -> Column:
        if kind in ("string", "binary"):
            return F.coalesce(F.octet_length(name), F.lit(0))
        if kind.startswith(("array", "map", "struct")):
            return F.octet_length(F.to_json(F.struct(name)))
        return F.lit(8)

    total = F.lit(0)
    for name, kind in df.dtypes:
        total = total + width(name, kind)
    count, held = df.limit(rows + 1).agg(F.count(F.lit(1)), F.sum(total)).first()
    return count <= rows and (held or 0) <= size


def lookup_join(left: DataFrame, right: DataFrame, on: Sequence[str], spread: str,
                how: str = "inner", counts: DataFrame | None = None, by_size: bool = True) -> DataFrame:
    """Join to a table of distinct keys: broadcast if it was found short, else
    shuffled with the hot keys of the left side split by ``spread``. Without
    ``by_size`` a longer table is not broadcast for its estimated size either, as
    that of stored names says little of their rows."""
    if is_short(right):
        return left.join(F.broadcast(right), list(on), how)
    return spread_join(left, right if by_size else right.hint("merge"), on, spread, how, counts=counts)


def selection_join(layers: DataFrame, selection: DataFrame, on: str = "digest") -> DataFrame:
    """Selected layers only, with the compressed size taken from the selection."""
    sizes = selection.select(on, F.col("size").alias("compressed_size"))
    return layers.drop("compressed_size").join(sizes, on, "inner")


def alias_keys(names: DataFrame, name: str) -> DataFrame:
    """Every normalised name that itself, or whose alias, is among the listed
    names and their aliases."""
    listed = names.select(F.explode(P.expand_aliases(F.col(name))).alias("_n")).distinct()
    return listed.select(F.explode(F.array_append(P.aliased_by(F.col("_n")), F.col("_n"))).alias("_n")).distinct()


def alias_semi(df: DataFrame, name: str, whitelist: DataFrame, listed: str, spread: str) -> DataFrame:
    """Rows whose name, or its official-image alias, is covered by the aliases
    of the listed names. The list is expanded, the rows are joined once;
    ``spread`` is a column that varies between the rows of one name."""
    keyed = df.withColumn("_n", P.norm_name(F.col(name)))
    return lookup_join(keyed, cut_lineage(alias_keys(whitelist, listed)), ["_n"], spread, "left_semi").select(
        *df.columns)


def alias_lookup(df: DataFrame, name: str, ids: DataFrame, id_name: str, id_col: str, spread: str,
                 out: str = "resolved_id") -> DataFrame:
    """Resolve an id by exact normalised name first, then by the alias. Where
    names repeat after normalisation, the largest id stands for all of them.
    The known names are expanded, the rows are joined once; ``spread`` is a
    column that varies between the rows of one name."""
    known = ids.select(P.norm_name(F.col(id_name)).alias("_n"), F.col(id_col).alias("_id"))
    entries = known.select("_n", "_id", F.lit(1).alias("_exact")).unionByName(known.select(
        F.explode(P.aliased_by(F.col("_n"))).alias("_n"), "_id", F.lit(0).alias("_exact")))
    best = cut_lineage(entries.groupBy("_n").agg(F.max_by("_id", F.struct("_exact", "_id")).alias(out)))
    keyed = df.withColumn("_n", P.norm_name(F.col(name)))
    return lookup_join(keyed, best, ["_n"], spread, "left").select(*df.columns, out)


def ensure_missing(target: DataFrame, required: DataFrame, key: str, once: bool = False) -> DataFrame:
    """Add a minimal row (the required columns only) for every absent key. With
    ``once`` the target is computed a single time, by an outer join: for targets
    that are joined by the key already and have few rows of one key."""
    if once:
        wanted = required.filter(F.col(key).isNotNull()).dropDuplicates([key]).select(
            key, *(F.col(c).alias(f"_new_{c}") for c in required.columns if c != key))
        both = target.withColumn("_held", F.lit(True)).join(wanted, key, "full_outer")

        def value(c: str) -> Column:
            new = F.col(f"_new_{c}") if c in required.columns else F.lit(None)
            return F.when(F.col("_held"), F.col(c) if c in target.columns else F.lit(None)).otherwise(new).alias(c)

        columns = [*target.columns, *(c for c in required.columns if c not in target.columns)]
        unnamed = required.filter(F.col(key).isNull()).limit(1)  # null equals no key
        return both.select(*(F.col(key) if c == key else value(c) for c in columns)).unionByName(
            unnamed, allowMissingColumns=True)
    wanted = required.dropDuplicates([key])
    absent = wanted.join(target.select(key), key, "left_anti")
    return target.unionByName(absent, allowMissingColumns=True)


def seen_anti(df: DataFrame, seen: DataFrame, key: str) -> DataFrame:
    return df.join(seen.select(key), key, "left_anti")


def link_pairs(selection: DataFrame, repos: DataFrame, layers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct (repo_id, layer_id) from ``selection(digest, repos)``, and the
    (digest, repo) pairs one side of which is unknown. ``repos`` has
    ``repo_id, repo_name``; ``layers`` has ``layer_id, digest``. A layer of very
    many repositories is split by repository."""
    pairs = cut_lineage(selection.select("digest", F.explode("repos").alias("repo")).select(
        "digest", F.trim("repo").alias("repo")).filter(F.col("repo") != "").distinct())
    with_layer = lookup_join(pairs, layers.select("digest", "layer_id"), ["digest"], "repo", "left")
    resolved = alias_lookup(with_layer, "repo", repos, "repo_name", "repo_id", "digest", "repo_id")
    complete = F.col("repo_id").isNotNull() & F.col("layer_id").isNotNull()
    links = resolved.filter(complete).select("repo_id", "layer_id").distinct()
    return links, resolved.filter(~complete).select("digest", "repo")


def fragment_layers(layers: DataFrame, selection: DataFrame | None = None) -> DataFrame:
    """Distinct (fragment_hash, layer_id) from the layers' fragment arrays."""
    chosen = layers if selection is None else layers.join(
        selection.select("digest"), "digest", "left_semi")
    return chosen.select(F.explode("secrets").alias("fragment_hash"), "layer_id").distinct()


def secret_occurrences(secrets: DataFrame, frag_layers: DataFrame, is_stored: bool = False) -> DataFrame:
    """Secret records times the layers holding their fragment. A fragment in
    very many layers is split over tasks by layer. ``is_stored`` says that the
    layers' fragments are stored already."""
    records = secrets.withColumn("fragment_hash", F.trim("fragment_hash")).filter(
        F.col("fragment_hash") != "")
    held = frag_layers if is_stored else cut_lineage(frag_layers)
    return spread_join(held, records, ["fragment_hash"], "layer_id")


def secret_repos(repo_layers: DataFrame, occ: DataFrame) -> DataFrame:
    """Distinct repositories reaching at least one secret through a layer."""
    leaking = cut_lineage(occ.select("layer_id").distinct())
    return lookup_join(repo_layers, leaking, ["layer_id"], "repo_id", "left_semi").select("repo_id").distinct()


def has_secret(repos: DataFrame, repo_layers: DataFrame, occ: DataFrame) -> DataFrame:
    flagged = secret_repos(repo_layers, occ).withColumn("_hit", F.lit(True))
    return repos.join(flagged, "repo_id", "left").select(
        *repos.columns, F.coalesce("_hit", F.lit(False)).alias("has_secret"))


def one_random_tag(repos: DataFrame, tags: DataFrame, seed: str | int = 42, key: str = "tag_id",
                   columns: Sequence[str] = ("last_pushed", "status")) -> DataFrame:
    """Each repository with one of its dated tags chosen by seeded hash, nulls
    if it has none. A partial aggregate keeps one candidate per repository."""
    dated = tags.filter(F.col("last_pushed").isNotNull()).select("repo_id", key, *columns)
    return repos.join(one_per_group(dated, "repo_id", key, seed).select("repo_id", *columns),
                      "repo_id", "left")


def bin_weight(df: DataFrame, c: str, bins: DataFrame, out: str = "weight") -> DataFrame:
    """Weight of the bin a value lies in: left closed, right open, the last bin
    closed; 1.0 for no bin, no finite value, or a weight that is not finite and
    positive. The bins (at most twenty or so) travel as one array value."""
    ordered = bins.agg(F.sort_array(F.collect_list(F.struct(
        "bin_left", "bin_right", F.col("bias_full_over_sample").alias("w")))).alias("b")).scalar()
    v = F.col("_v")
    last = F.col("_bins")[F.size("_bins") - 1]

    def inside(b: Column) -> Column:
        closed = (b["bin_left"] == last["bin_left"]) & (b["bin_right"] == last["bin_right"])
        return (v >= b["bin_left"]) & ((v < b["bin_right"]) | (closed & (v <= b["bin_right"])))

    valued = df.withColumn("_bins", ordered).withColumn("_v", F.col(c).cast("double"))
    hit = F.get(F.filter(F.col("_bins"), inside), F.lit(0))["w"]
    finite = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != F.lit(float("inf")))
    usable = (F.size("_bins") > 0) & finite
    return (
        valued.withColumn("_w", F.when(usable, hit))
        .withColumn(out, F.when((F.col("_w") > 0) & ~F.isnan("_w") & (F.col("_w") < F.lit(float("inf"))),
                                F.col("_w")).otherwise(F.lit(1.0)))
        .drop("_bins", "_v", "_w")
    )


def map_weight(df: DataFrame, c: str, map_df: DataFrame, default: float = 1.0,
               out: str = "weight") -> DataFrame:
    """Weight of a category from a (key, bias_full_over_sample) table, which
    is stored and broadcast if short. Beyond that, adaptive execution splits
    the rows of a hot category."""
    table = cut_lineage(map_df.select(F.col("key").alias(c), F.col("bias_full_over_sample").alias("_w")))
    return df.join(F.broadcast(table) if is_short(table) else table, c, "left").select(
        *df.columns, F.coalesce(F.nanvl("_w", F.lit(default)), F.lit(default)).alias(out))


def month_merge(df: DataFrame, month: str = "month_key", repo: str = "repo_id",
                flag: str = "has_secret", weight: str = "weight") -> DataFrame:
    """Per month: repositories and weights, in total and with a secret, as one
    conditional aggregation instead of four merged ones."""
    hit = F.col(flag)
    return df.groupBy(month).agg(
        F.countDistinct(repo).alias("total_repos"),
        F.sum(weight).alias("total_repos_weighted"),
        F.countDistinct(F.when(hit, F.col(repo))).alias("repos_with_secret"),
        F.sum(F.when(hit, F.col(weight)).otherwise(F.lit(0.0))).alias("repos_with_secret_weighted"),
    )


def secret_layer_join(secrets: DataFrame, occ: DataFrame, layers: DataFrame) -> DataFrame:
    """Occurrences with their secret and layer; a secret in very many layers,
    or a layer with very many secrets, is split over tasks."""
    return lookup_join(lookup_join(occ, secrets, ["secret_id"], "layer_id"), layers, ["layer_id"], "secret_id")


def key_union(full: DataFrame, sample: DataFrame, key: str = "key", count: str = "count") -> DataFrame:
    f = full.select(key, F.col(count).alias("count_full"))
    s = sample.select(key, F.col(count).alias("count_sample"))
    return f.join(s, key, "full_outer").select(
        key, F.coalesce("count_full", F.lit(0)).alias("count_full"),
        F.coalesce("count_sample", F.lit(0)).alias("count_sample"))


def frag_weight_merge(counts: DataFrame, pairs: DataFrame, uniq: DataFrame,
                      weights: DataFrame, is_stored: bool = False) -> DataFrame:
    """Sum the layer weights of each fragment's layers onto its counts.
    ``weights`` is one row ``w_unique, w_nonunique``; a layer without a
    uniqueness row counts as not unique. A layer of very many fragments is split
    by fragment. ``is_stored`` says that the pairs are distinct and stored already."""
    w = one_row(weights.select("w_unique", "w_nonunique"))
    held = pairs if is_stored else stored(pairs.select("fragment_hash", "layer_id").distinct())
    weighted = lookup_join(held, uniq, ["layer_id"], "fragment_hash", "left").groupBy("fragment_hash").agg(
        F.count_if(F.col("is_unique") == 1).alias("_u"), F.count(F.lit(1)).alias("_n"))
    return counts.join(weighted, "fragment_hash", "left").select(
        *counts.columns,
        (F.coalesce("_u", F.lit(0)) * w["w_unique"]
         + F.coalesce(F.col("_n") - F.col("_u"), F.lit(1)) * w["w_nonunique"]).alias("weighted_layer_count"))
