"""The import: selected layers, their repositories, tags and secrets, linked.

Natural keys (repository name, digest, fragment hash) replace serial ids, so
no id has to travel back from an insert before the next step can start; add
``merge.surrogate_ids`` where numbers are wanted. Inputs carry a ``seq``
column giving input order. Every result is a lazy DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators import joins as J
from regspark.operators import merge as U
from regspark.session import stored


_PACKED = "_packed_digest"


def _packed(df: DataFrame, column: str = "digest") -> DataFrame:
    """The frame with a text column as shorter bytes (``pack_digest``), for what is
    shuffled by it or with it; those the frame has already are taken."""
    if _PACKED in df.columns:
        return df.withColumn(column, F.col(_PACKED)).drop(_PACKED)
    return df.withColumn(column, P.pack_digest(F.col(column).cast("string")))


def _keyed(df: DataFrame) -> DataFrame:
    """Rows with a digest, packed, and known to the optimizer as never null."""
    return _packed(df.filter(F.col("digest").isNotNull())).withColumn("digest", F.coalesce("digest", F.lit(b"")))


def _unpacked(df: DataFrame, column: str = "digest") -> DataFrame:
    return df.withColumn(column, P.unpack_digest(F.col(column)))


def _both(df: DataFrame) -> DataFrame:
    """A frame of packed digests with their texts beside them."""
    return df.withColumnRenamed("digest", _PACKED).withColumn("digest", P.unpack_digest(F.col(_PACKED)))


def clean_selection(selection: DataFrame) -> DataFrame:
    """Trimmed digests with their sizes and distinct, non-blank repositories;
    a repeated digest keeps its last line."""
    return _unpacked(_clean(selection))


def _clean(selection: DataFrame) -> DataFrame:
    trimmed = selection.withColumn("digest", F.trim("digest")).filter(F.col("digest") != "")
    last = U.latest(_packed(trimmed.select("digest", "size", "repos", "seq")), "digest", "seq")
    named = F.filter(F.transform(F.coalesce("repos", F.array().cast("array<string>")), lambda r: F.trim(r)),
                     lambda r: r.isNotNull() & (r != ""))
    return last.select("digest", "size", F.array_distinct(named).alias("repos"))


def _no_rows(df: DataFrame) -> DataFrame:
    return df.drop("seq").limit(0)


def import_repositories(selected_names: DataFrame, repos: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Whitelisted repositories, last line per name, plus minimal rows for
    selected names that neither name nor alias resolves."""
    listed = J.alias_semi(repos.filter(F.col("repo_name") != ""), "repo_name", selected_names, "repo", "seq")
    merged = U.upsert_replace(_no_rows(repos) if old is None else old, listed, "repo_name", "seq")
    known = merged.select("repo_name")
    found = J.alias_lookup(selected_names, "repo", known, "repo_name", "repo_name", "repo", "resolved")
    absent = found.filter(F.col("resolved").isNull()).select(F.col("repo").alias("repo_name"))
    return merged.unionByName(absent.distinct(), allowMissingColumns=True)


def import_layers(selection: DataFrame, layers: DataFrame, old: DataFrame | None = None) -> DataFrame:
    """Facts of selected layers, last known value per column. Lines are merged
    by digest before the join, so a layer with very many lines stays cheap. The
    selection is dealt out by digest once for both of its joins."""
    lines = _keyed(layers.drop("secrets"))
    facts = U.upsert_coalesce(_no_rows(lines), lines, "digest", "seq")
    wanted = _packed(selection).select("digest", "size").repartition("digest")
    chosen = J.selection_join(facts, wanted)
    merged = chosen if old is None else U.upsert_coalesce(
        _packed(old), chosen.withColumn("seq", F.lit(0)), "digest", "seq")
    minimal = wanted.select("digest", F.col("size").alias("compressed_size"))
    return _unpacked(J.ensure_missing(merged, minimal, "digest", once=True))


def import_links(selection: DataFrame, repositories: DataFrame, names: DataFrame | None = None,
                 is_clean: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct (repo_name, digest) links, and selected pairs left unresolved
    (none once missing repositories were added). Names are resolved once each, and
    the pairs meet the resolved names. ``names`` are the selected names with their
    rows ``_key_rows``, where these are known. ``is_clean`` says that no digest comes
    twice (``clean_selection``); then a link can only repeat within a row two of
    whose names share an alias."""
    shared = F.flatten(F.transform("repos", P.expand_aliases))
    pairs = _packed(selection).select(
        "digest", F.explode("repos").alias("repo"),
        (F.size(shared) == F.size(F.array_distinct(shared))).alias("_alone"))
    if names is None:
        names = stored(pairs.groupBy("repo").agg(F.count(F.lit(1)).alias("_key_rows")))
    found = stored(J.alias_lookup(names, "repo", repositories, "repo_name", "repo_name", "repo", "repo_name"))
    counts, missing = found.select("repo", "_key_rows"), F.col("repo_name").isNull()
    resolved = J.lookup_join(pairs, found.filter(~missing).select("repo", "repo_name"), ["repo"], "digest",
                             counts=counts, by_size=False)
    links = resolved.select("repo_name", "digest")
    if is_clean:
        links = resolved.filter("_alone").select("repo_name", "digest").unionByName(
            resolved.filter(~F.col("_alone")).select("repo_name", "digest").distinct())
    else:
        links = links.distinct()
    absent = found.filter(missing & F.col("repo").isNotNull()).select("repo")
    unresolved = J.lookup_join(pairs, absent, ["repo"], "digest", "left_semi", counts, by_size=False).unionByName(
        pairs.filter(F.col("repo").isNull())).select("digest", "repo")
    return _unpacked(links), _unpacked(unresolved)


def import_tags(selected_names: DataFrame, tags: DataFrame, repositories: DataFrame,
                old: DataFrame | None = None) -> DataFrame:
    """Tags of whitelisted repositories with a valid digest, last line per
    digest, blank texts as null and times parsed. Names are selected and resolved
    once each, and the tags meet the resolved names."""
    valid = tags.filter(F.col("repo_name") != "").withColumn("digest", F.lower(F.trim("digest"))).filter(
        P.valid_digest(F.col("digest")))
    names = stored(valid.groupBy("repo_name").agg(F.count(F.lit(1)).alias("_key_rows")))
    listed = J.alias_semi(names, "repo_name", selected_names, "repo", "repo_name")
    known = repositories.select(F.col("repo_name").alias("_known"))
    resolved = stored(J.alias_lookup(listed, "repo_name", known, "_known", "_known", "repo_name", "_repo").filter(
        F.col("_repo").isNotNull()).select("repo_name", "_repo"))
    lines = _packed(valid).select(
        "digest", "repo_name",
        P.null_if_empty(F.col("architecture")).alias("architecture"),
        P.null_if_empty(F.col("os")).alias("os"), "size",
        P.null_if_empty(F.col("status")).alias("status"),
        P.parse_ts(F.col("last_pulled")).alias("last_pulled"),
        P.parse_ts(F.col("last_pushed")).alias("last_pushed"), "seq")
    rows = J.lookup_join(lines, resolved, ["repo_name"], "seq", counts=names, by_size=False).withColumn(
        "repo_name", F.col("_repo")).select(*lines.columns)
    return _unpacked(U.upsert_replace(_no_rows(rows) if old is None else _packed(old), rows, "digest", "seq"))


def import_secrets(selection: DataFrame, layers: DataFrame, records: DataFrame,
                   old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Secrets by fragment hash and their occurrences in selected layers.
    Records are made distinct before they meet the layers of their fragment."""
    held = layers.filter(F.size("secrets") > 0).select("digest", F.array_distinct("secrets").alias("secrets"), "seq")
    last = U.latest(_keyed(held), "digest", "seq").withColumn("layer_id", F.col("digest"))
    return _import_held(stored(J.fragment_layers(last, _packed(selection))), records, old)


def import_held(reach: DataFrame, records: DataFrame, old: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """As ``import_secrets``, where the layers' fragments are already rows
    (fragment_hash, layer_id)."""
    return _import_held(stored(_packed(reach, "layer_id")), records, old)


def _import_held(reach: DataFrame, records: DataFrame, old: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    flat = records.select(F.trim("fragment_hash").alias("fragment_hash"), "seq", *(
        P.strip_nul(F.col(f"secrets.{c}")).alias(c) for c in ("origin", "secret", "file", "file_type")),
        F.col("secrets.file_size").alias("file_size"), F.col("secrets.start_line").alias("start_line"))
    known = reach.select("fragment_hash").distinct()
    fresh = flat.groupBy("fragment_hash").agg(
        F.max_by("origin", "seq").alias("origin"), F.max_by("secret", "seq").alias("secret"),
        F.max("seq").alias("seq")).join(known, "fragment_hash", "left_semi")
    secrets = U.upsert_secret(_no_rows(fresh) if old is None else old, fresh)
    places = flat.drop("seq", "origin", "secret").distinct()
    occurrences = J.secret_occurrences(places, reach, is_stored=True).withColumnRenamed("layer_id", "digest")
    return secrets, _unpacked(occurrences)


def import_all(selection: DataFrame, repos: DataFrame, tags: DataFrame, layers: DataFrame,
               secrets: DataFrame,
               keep: Callable[[DataFrame], DataFrame] = stored) -> dict[str, DataFrame]:
    """All six tables in dependency order, and the unresolved links.

    The selection, its names and the repositories feed several later steps.
    ``keep`` stores these three, so that each is computed once: compressed columns
    in the shared folder by default, or a function that writes a table and reads it back.
    """
    chosen = _both(keep(_clean(selection)))
    counted = keep(chosen.select(F.explode("repos").alias("repo")).groupBy("repo").agg(
        F.count(F.lit(1)).alias("_key_rows")))
    names = counted.select("repo")
    repositories = keep(import_repositories(names, repos))
    links, unresolved = import_links(chosen, repositories, counted, is_clean=True)
    secret_rows, occurrences = import_secrets(chosen, layers, secrets)
    return {
        "repositories": repositories,
        "layers": import_layers(chosen, layers),
        "repo_layers": links,
        "tags": import_tags(names, tags, repositories),
        "secrets": secret_rows,
        "occurrences": occurrences,
        "unresolved": unresolved,
    }


def import_secrets_only(selection: DataFrame, layer_lines: DataFrame, known_layers: DataFrame,
                        secrets: DataFrame, old: DataFrame | None = None) -> dict[str, DataFrame]:
    """Secrets against layers already imported; nothing else is touched."""
    chosen = _clean(selection).join(_packed(known_layers.select("digest")), "digest", "left_semi")
    secret_rows, occurrences = import_secrets(_both(chosen), layer_lines, secrets, old)
    return {"secrets": secret_rows, "occurrences": occurrences}
