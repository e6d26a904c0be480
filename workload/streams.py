"""Streams over the event table, run to their end and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.operators.stored import KeyedTable
from regspark.session import fresh_path
from regspark.streaming import streams as Q
from workload import views as V
from workload.registry import query


def _source(spark, d, name: str):
    """The braces make the path a pattern, which a file source needs where the
    table is a single file rather than a folder."""
    schema = V.table(spark, d, name).schema
    return spark.readStream.schema(schema).parquet(f"{d.rstrip('/')}/{{{name}}}.parquet")


@query("stream_dedup", "SELECT DISTINCT user_id FROM events")
def stream_dedup(spark, d):
    root = fresh_path(spark, "dedup")
    users = _source(spark, d, "events").select("user_id")
    Q.stream_dedup(users, "user_id", f"{root}/out", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("stream_dedup_stored", """
    SELECT user_id, min(event_type) AS event_type FROM events GROUP BY user_id""")
def stream_dedup_stored(spark, d):
    root = fresh_path(spark, "dedup-stored")
    users = _source(spark, d, "events").select("user_id", "event_type")
    Q.stream_dedup_stored(users, "user_id", f"{root}/out", f"{root}/cp").awaitTermination()
    return Q.read_stored(spark, f"{root}/out")


@query("stream_histogram", "SELECT event_type AS key, count(*) AS count FROM events GROUP BY event_type")
def stream_histogram(spark, d):
    root = fresh_path(spark, "histogram")
    Q.stream_histogram(_source(spark, d, "events"), "event_type", f"{root}/out", f"{root}/cp").awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("stream_month_histogram", "SELECT strftime(ts, '%Y-%m') AS key, count(*) AS count FROM events GROUP BY 1")
def stream_month_histogram(spark, d):
    root = fresh_path(spark, "months")
    events = _source(spark, d, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    Q.stream_histogram(events, "ts", f"{root}/out", f"{root}/cp", month=True).awaitTermination()
    return spark.read.parquet(f"{root}/out")


@query("stream_upsert", """
    SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type,
           max_by(value, event_id) AS value FROM events GROUP BY user_id""")
def stream_upsert(spark, d):
    root = fresh_path(spark, "upsert")
    rows = _source(spark, d, "events").select("user_id", "event_id", "event_type", "value")
    Q.stream_upsert(rows, f"{root}/out", "user_id", "event_id", f"{root}/cp").awaitTermination()
    return Q.read_upserted(spark, f"{root}/out", "user_id", "event_id")


@query("stream_upsert_coalesce", """
    SELECT user_id, max(event_id) AS event_id,
           max_by(value, event_id) FILTER (WHERE event_type = 'view') AS viewed FROM events GROUP BY user_id""")
def stream_upsert_coalesce(spark, d):
    root = fresh_path(spark, "coalesce")
    rows = _source(spark, d, "events").select(
        "user_id", "event_id", F.when(F.col("event_type") == "view", F.col("value")).alias("viewed"))
    Q.stream_upsert(rows, f"{root}/out", "user_id", "event_id", f"{root}/cp").awaitTermination()
    return Q.read_upserted(spark, f"{root}/out", "user_id", "event_id", mode="coalesce")


@query("stream_counts", "SELECT event_type AS key, count(*) AS count FROM events GROUP BY event_type")
def stream_counts(spark, d):
    root = fresh_path(spark, "counts")
    table = KeyedTable(spark, f"{root}/table", "key string, count long", "key", "add", buckets=4)
    Q.stream_counts(_source(spark, d, "events"), "event_type", table, f"{root}/cp").awaitTermination()
    return table.read()


@query("stream_merge", """
    SELECT user_id, max(event_id) AS event_id, max_by(event_type, event_id) AS event_type FROM events GROUP BY user_id""")
def stream_merge(spark, d):
    root = fresh_path(spark, "merged")
    rows = _source(spark, d, "events").select("user_id", "event_id", "event_type").withColumn("seq", F.col("event_id"))
    table = KeyedTable(spark, f"{root}/table", rows.drop("seq").schema, "user_id", buckets=8)
    Q.stream_merge(rows, table, "seq", f"{root}/cp").awaitTermination()
    return table.read()
