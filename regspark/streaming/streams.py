"""Resumable ingestion: dedup, running counts and upserts from streams.

State is keyed and partitioned; on a cluster choose the RocksDB state store
(``spark.sql.streaming.stateStore.providerClass``). The state of ``stream_dedup``
never expires, so it grows with the keys; ``stream_dedup_stored`` has none.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from regspark.functions import scalars as P
from regspark.operators.joins import is_short
from regspark.operators.merge import latest, upsert_coalesce, upsert_replace
from regspark.operators.running import null_safe_join
from regspark.operators.stored import KeyedTable
from regspark.session import cut_lineage


def stream_dedup(sdf: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Append each key once to parquet; the checkpoint carries the seen keys
    over a restart. Its state never expires."""
    return (
        sdf.dropDuplicates([key]).writeStream.format("parquet").outputMode("append")
        .option("checkpointLocation", checkpoint).option("path", path)
        .trigger(availableNow=True).start()
    )


def _complete_batches(spark: SparkSession, path: str, before: int) -> list[str]:
    """Folders of the batches before ``before`` whose write was completed."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    folder = new(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    found = [(s.getPath().getName(), s.getPath()) for s in files.listStatus(folder)]
    return [p.toString() for name, p in found if name.startswith("batch=")
            and int(name.removeprefix("batch=")) < before and files.exists(new(p, "_SUCCESS"))]


def admit_new(batch: DataFrame, batch_id: int, key: str, path: str) -> None:
    """Writes the batch's rows of keys that no earlier batch has written, one a key
    (the least by its columns in order), to a folder named by the batch id.

    What was written is the set of seen keys. Only keys the batch holds are kept of
    it: found by telling every task the batch's keys where they are few, so that the
    seen ones are read but never shuffled. Null is a key. A repeated batch looks at
    the same earlier ones and replaces its own folder.
    """
    spark = batch.sparkSession
    others = [c for c in batch.columns if c != key]
    first = batch.groupBy(key).agg(F.min(F.struct(*others)).alias("_row")).select(
        key, *(F.col("_row").getField(c).alias(c) for c in others)) if others else batch.distinct()
    earlier = _complete_batches(spark, path, batch_id)
    if earlier:
        first = cut_lineage(first)
        keys = first.select(key)
        seen = spark.read.schema(keys.schema).parquet(*earlier)
        met = null_safe_join(seen, F.broadcast(keys), [key], "left_semi") if is_short(keys) else seen
        first = null_safe_join(first, met, [key], "left_anti")
    first.select(*batch.columns).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def stream_dedup_stored(sdf: DataFrame, key: str, path: str, checkpoint: str) -> StreamingQuery:
    """Each key once, as ``stream_dedup``, without keyed state: the rows written
    so far tell which keys were seen (``admit_new``), so nothing is held between
    batches and any number of keys costs memory only while it is compared."""
    return sdf.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, batch_id: admit_new(batch, batch_id, key, path)).start()


def read_stored(spark: SparkSession, path: str) -> DataFrame:
    """All rows a deduplicated stream has written so far."""
    return spark.read.option("basePath", path).parquet(path).drop("batch")


def _counted(rows: DataFrame, c: str, month: bool) -> DataFrame:
    """(key, count) of a column's values, or of a timestamp's months."""
    if month:
        key, rows = P.month_key(F.col(c)), rows.filter(F.col(c).isNotNull())
    else:
        key = P.blank_to_unknown(F.col(c))
    return rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("count"))


def stream_histogram(sdf: DataFrame, c: str, path: str, checkpoint: str, month: bool = False) -> StreamingQuery:
    """Counts per value (or per month of a timestamp), kept current at
    ``path``; every batch replaces the small result."""
    counts = _counted(sdf, c, month)

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(path)

    return counts.writeStream.outputMode("complete").option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(replace).start()


def stream_upsert(sdf: DataFrame, path: str, key: str, seq: str, checkpoint: str) -> StreamingQuery:
    """Write each batch as one delta folder named by its batch id. A repeated
    batch overwrites its own folder, so a retry changes nothing, and no batch
    rewrites the table; ``read_upserted`` merges, ``compact`` folds."""
    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return sdf.writeStream.option("checkpointLocation", checkpoint).trigger(
        availableNow=True).foreachBatch(append).start()


def read_upserted(spark: SparkSession, path: str, key: str, seq: str, mode: str = "replace") -> DataFrame:
    """Current rows: per key the last in (batch, seq) order, by whole row
    (``replace``) or per column over values that are not null (``coalesce``)."""
    deltas = spark.read.option("basePath", path).parquet(path)
    ordered = deltas.withColumn("_seq", F.struct("batch", seq))
    if mode == "replace":
        return latest(ordered, key, "_seq").drop("batch", "_seq")
    columns = [c for c in deltas.columns if c not in (key, "batch")]
    return deltas.groupBy(key).agg(*(
        F.max_by(c, F.when(F.col(c).isNotNull(), F.struct("batch", seq))).alias(c) for c in columns))


def compact(base: DataFrame, spark: SparkSession, path: str, key: str, seq: str,
            mode: str = "replace") -> DataFrame:
    """A base table with all deltas merged into it, to be written elsewhere."""
    deltas = spark.read.option("basePath", path).parquet(path).withColumn(
        "_seq", F.struct("batch", seq)).drop("batch")
    merge = upsert_replace if mode == "replace" else upsert_coalesce
    return merge(base, deltas, key, "_seq")


def stream_merge(sdf: DataFrame, table: KeyedTable, seq: str | None, checkpoint: str,
                 source: str = "stream") -> StreamingQuery:
    """Folds every batch into a table as it comes, by the table's mode. Only buckets the
    batch has keys in are rewritten, and a batch repeated after a restart is not folded
    twice, so nothing is left to compact."""
    return sdf.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, batch_id: table.merge(batch, seq, {source: batch_id}) and None).start()


def stream_counts(sdf: DataFrame, c: str, table: KeyedTable, checkpoint: str, month: bool = False,
                  source: str = "stream") -> StreamingQuery:
    """Counts as ``stream_histogram``, added batch by batch to a table of mode ``add``
    with the columns ``key`` and ``count``. The stream holds no counts itself, and a
    reader of the table sees all of a batch or nothing of it."""
    return sdf.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(
        lambda batch, batch_id: table.merge(_counted(batch, c, month), marks={source: batch_id}) and None).start()
