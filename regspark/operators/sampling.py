"""Reproducible sampling by seeded hash.

A row's md5 under a seed replaces the random draw: the same rows are taken on
every engine, after every retry, at any parallelism. Hash prefixes split even
one huge group evenly, so no sampler sorts a group in one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.session import cut_lineage

# Fixed value: bytes a layer sample aims at.
TARGET_BYTES = 150 * 1_000_000_000_000


def reservoir(df: DataFrame, c: str, k: int, seed: str | int, key: str, prefix: int = 4) -> DataFrame:
    """At most k uniform rows among those with a value that is not null and not
    negative: the k smallest hashes. Counts per hash range tell which ranges
    are taken whole; rows are ordered only in the one range where k is reached."""
    rows = df.filter(F.col(c) >= 0).withColumn("_h", P.hash_hex(seed, F.col(key))).withColumn(
        "_p", F.left(F.col("_h"), F.lit(prefix)))
    cells = cut_lineage(rows.groupBy("_p").agg(F.count(F.lit(1)).alias("_n")))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    reached = cells.withColumn("_b", before).filter(F.col("_b") < k).agg(
        F.max(F.struct("_p", F.col("_b").alias("b"))).alias("edge")).scalar()
    edged = rows.withColumn("_e", reached)
    whole = edged.filter(F.col("_p") < F.col("_e._p"))
    rank = F.row_number().over(W.partitionBy("_p").orderBy("_h", key))
    cut = edged.filter(F.col("_p") == F.col("_e._p")).withColumn("_rank", rank).filter(
        F.col("_rank") <= F.lit(k) - F.col("_e.b"))
    return whole.select(*df.columns).unionByName(cut.select(*df.columns))


def stratified_bytes(df: DataFrame, size: str, key: str, target: int = TARGET_BYTES,
                     seed: str | int = 42, bounds=P.SIZE_BOUNDS) -> DataFrame:
    """Sample of about ``target`` bytes with every size class holding its share.

    Within a class, rows in hash order are kept while the bytes before them are
    below the class quota. Bytes per (class, hash range) are summed first: whole
    ranges below the quota are kept, whole ranges above it dropped, and only the
    one range per class that crosses it is ordered row by row.
    """
    rows = (
        df.filter(F.col(size) > 0).filter(F.col(key).isNotNull() & (F.col(key).cast("string") != ""))
        .withColumn("_bucket", P.log_bucket(F.col(size), bounds))
        .withColumn("_h", P.hash_hex(seed, F.col(key)))
        .withColumn("_p", F.left(F.col("_h"), F.lit(3)))
    )
    cells = cut_lineage(rows.groupBy("_bucket", "_p").agg(F.sum(size).alias("_bytes")))
    total = cells.agg(F.sum("_bytes")).scalar()
    in_class = W.partitionBy("_bucket").orderBy("_p")
    planned = cells.select(
        "_bucket", "_p", "_bytes",
        F.coalesce(F.sum("_bytes").over(in_class.rowsBetween(W.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_bytes").over(W.partitionBy("_bucket")).alias("_class"),
    ).withColumn(
        "_quota", F.col("_class").cast("double") * F.least(F.lit(target), total).cast("double")
        / total.cast("double")
    ).filter(F.col("_before") < F.col("_quota")).withColumn(
        "_whole", F.col("_before") + F.col("_bytes") <= F.col("_quota"))
    # At most ten classes times 4,096 hash ranges, whatever the input size.
    taken = rows.join(F.broadcast(planned), ["_bucket", "_p"])
    inside = W.partitionBy("_bucket", "_p").orderBy("_h", key).rowsBetween(W.unboundedPreceding, -1)
    crossing = taken.filter(~F.col("_whole")).withColumn(
        "_mine", F.col("_before") + F.coalesce(F.sum(size).over(inside), F.lit(0))
    ).filter(F.col("_mine") < F.col("_quota"))
    kept = [*df.columns, F.col("_bucket").alias("bucket")]
    return taken.filter("_whole").select(*kept).unionByName(crossing.select(*kept))


def sample_report(full: DataFrame, sample: DataFrame, size: str, target: int = TARGET_BYTES) -> DataFrame:
    """Input, target and sampled bytes, with a warning beyond 2 % deviation."""
    total = full.filter(F.col(size) > 0).agg(F.sum(size)).scalar()
    aim = F.least(F.lit(target), F.col("input_bytes"))
    return sample.agg(F.coalesce(F.sum(size), F.lit(0)).alias("final_bytes"),
                      F.count(F.lit(1)).alias("items")).withColumn("input_bytes", total).withColumn(
        "target_bytes", aim).withColumn(
        "deviation", F.try_divide(F.abs(F.col("final_bytes") - F.col("target_bytes")), F.col("target_bytes"))
    ).withColumn("warn", F.coalesce(F.col("deviation") > 0.02, F.lit(False))).select(
        "input_bytes", "target_bytes", "final_bytes", "items", "deviation", "warn")


def one_per_group(df: DataFrame, by: str, key: str, seed: str | int = 42) -> DataFrame:
    """One row per group, chosen by the smallest seeded hash of its key."""
    rest = [c for c in df.columns if c != by]
    pick = F.struct(P.hash_hex(seed, F.col(key)), F.col(key))
    return df.groupBy(by).agg(F.min_by(F.struct(*rest), pick).alias("_r")).select(
        by, *(F.col(f"_r.{c}").alias(c) for c in rest))


def group_split(df: DataFrame, by: str, frac: float = 0.8, seed: str | int = 42,
                out: str = "is_train") -> DataFrame:
    """Mark about ``frac`` of the groups for training, whole groups together."""
    draw = F.conv(F.left(P.hash_hex(seed, F.col(by)), F.lit(8)), 16, 10).cast("long")
    return df.withColumn(out, (draw < F.lit(int(frac * 2**32))).cast("int"))
