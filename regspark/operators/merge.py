"""Keyed merges: the import's insert-or-update rules as aggregations.

Each is one union and one hash aggregation on the key with map-side combine,
so a key that fills a third of the input costs no more than any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regspark.session import cut_lineage

_HEX_PREFIX = 4  # 65,536 ranges of the key hash


def _ranked(old: DataFrame, new: DataFrame, seq: str) -> DataFrame:
    """Union in which every new row outranks every old one."""
    before = old.drop(seq) if seq in old.columns else old
    kept = before.withColumn("_rank", F.struct(F.lit(0).alias("gen"), F.lit(None).cast(
        new.schema[seq].dataType).alias("seq")))
    added = new.withColumn("_rank", F.struct(F.lit(1).alias("gen"), F.col(seq).alias("seq"))).drop(seq)
    return kept.unionByName(added, allowMissingColumns=True)


def upsert_replace(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """On conflict overwrite every column; the last input row wins."""
    rows = _ranked(old, new, seq)
    columns = [c for c in rows.columns if c != "_rank"]
    return rows.groupBy(key).agg(
        F.max_by(F.struct(*(c for c in columns if c != key)), F.col("_rank")).alias("_r")
    ).select(key, *(F.col(f"_r.{c}").alias(c) for c in columns if c != key)).select(*columns)


def upsert_coalesce(old: DataFrame, new: DataFrame, key: str, seq: str) -> DataFrame:
    """On conflict keep, per column, the last value that is not null."""
    rows = _ranked(old, new, seq)
    columns = [c for c in rows.columns if c not in ("_rank", key)]
    return rows.groupBy(key).agg(*(
        F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_rank"))).alias(c) for c in columns))


def insert_ignore(old: DataFrame, new: DataFrame, key: Sequence[str]) -> DataFrame:
    """On conflict do nothing: old rows stay, new keys come in once."""
    keys = list(key)
    fresh = new.dropDuplicates(keys).join(old.select(*keys), keys, "left_anti")
    return old.unionByName(fresh)


def upsert_secret(old: DataFrame, new: DataFrame, seq: str = "seq") -> DataFrame:
    """Secrets by fragment hash; the last record in input order wins, whatever
    the batch size."""
    return upsert_coalesce(old, new, "fragment_hash", seq)


def surrogate_ids(df: DataFrame, key: str, out: str = "id") -> DataFrame:
    """Stable ids for distinct keys: dense numbers along the key's md5. They come
    from counts per hash range, so numbering is spread over the ranges instead
    of one sorted task."""
    keyed = df.select(key).distinct() if df.columns != [key] else df.distinct()
    hashed = cut_lineage(keyed).withColumn("_h", F.md5(F.col(key).cast("string"))).withColumn(
        "_p", F.left(F.col("_h"), F.lit(_HEX_PREFIX)))
    ranges = hashed.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1))
    offsets = ranges.select("_p", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(W.partitionBy("_p").orderBy("_h", key))
    return hashed.join(offsets, "_p").select(key, (F.col("_before") + inside).cast("long").alias(out))


def latest(df: DataFrame, key: str, seq: str | Column) -> DataFrame:
    """Last row per key in input order. A column the rows are ordered by is its own
    maximum, so they do not carry it a second time."""
    order = F.col(seq) if isinstance(seq, str) else seq
    rest = [c for c in df.columns if c not in (key, seq if isinstance(seq, str) else None)]
    found = df.groupBy(key).agg(*([F.max_by(F.struct(*rest), order).alias("_r")] if rest else []), F.max(order).alias("_seq"))
    return found.select(*(F.col(c) if c == key else F.col("_seq").alias(c) if c not in rest else F.col(f"_r.{c}").alias(c)
                          for c in (key, *(c for c in df.columns if c != key))))
