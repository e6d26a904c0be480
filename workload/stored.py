"""Keyed tables on disk and the study tables that follow them, in three batches of changes."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.operators.stored import KeyedTable
from regspark.plans.live import LiveStudy
from regspark.session import fresh_path
from workload import views as V
from workload.registry import query

BATCHES = 3


def _merged(spark, d, mode: str, viewed: bool = False):
    """Events of three batches, merged by user."""
    value = F.when(F.col("event_type") == "view", F.col("value")) if viewed else F.col("value")
    events = V.table(spark, d, "events").select("user_id", "event_id", "event_type", value.alias("value"))
    kinds = dict(events.dtypes)
    columns = ["user_id", "event_id", "event_type", "value"]
    table = KeyedTable(spark, fresh_path(spark, "keyed"), ", ".join(f"{c} {kinds[c]}" for c in columns),
                       "user_id", mode, buckets=8)
    for i in range(BATCHES):
        batch = events.filter(F.col("event_id") % BATCHES == i).withColumn("seq", F.col("event_id"))
        table.merge(batch, "seq", {"events": i})
    return table.read()


@query("merge_replace", """
    SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3 DESC, event_id DESC) = 1""")
def merge_replace(spark, d):
    return _merged(spark, d, "replace")


@query("merge_ignore", """
    SELECT user_id, event_id, event_type, value FROM events
    QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id % 3, event_id) = 1""")
def merge_ignore(spark, d):
    return _merged(spark, d, "ignore")


@query("merge_coalesce", """
    SELECT user_id, max_by(event_id, n) AS event_id, max_by(event_type, n) AS event_type,
           max_by(value, n) FILTER (WHERE event_type = 'view' AND value IS NOT NULL) AS value
    FROM (SELECT *, row_number() OVER (ORDER BY event_id % 3, event_id) AS n FROM events) GROUP BY user_id""")
def merge_coalesce(spark, d):
    return _merged(spark, d, "coalesce", viewed=True)


@query("live_study", """
    WITH occ AS (
        SELECT l_partkey AS layer_id, left(md5(s_name), 16) AS fragment_hash,
               CASE WHEN l_linestatus = 'O' THEN 'unknown' ELSE '.' || lower(l_linestatus) END AS file_type
        FROM lineitem JOIN supplier ON s_suppkey = l_suppkey WHERE l_returnflag = 'R'
        QUALIFY row_number() OVER (PARTITION BY l_partkey, l_linenumber, l_linestatus
                                   ORDER BY l_orderkey % 3 DESC, l_orderkey DESC, l_suppkey DESC) = 1),
    tag AS (
        SELECT strftime(o_orderdate, '%Y-%m') AS month,
               CASE WHEN o_orderstatus = 'P' THEN 'unknown' ELSE o_orderstatus END AS status
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey % 3 DESC, o_orderkey DESC) = 1),
    counts AS (
        SELECT fragment_hash, count(DISTINCT repo_id) AS repo_count, count(DISTINCT layer_id) AS layer_count
        FROM occ JOIN repo_layers USING (layer_id) GROUP BY fragment_hash)
    SELECT 'month_histogram' AS "table", month AS key, 'count' AS measure, count(*) AS value FROM tag GROUP BY month
    UNION ALL SELECT 'status_histogram', status, 'count', count(*) FROM tag GROUP BY status
    UNION ALL SELECT 'filetype_frequency', file_type, 'n', count(*) FROM occ GROUP BY file_type
    UNION ALL SELECT 'layer_uniqueness', CAST(layer_id AS VARCHAR), 'is_unique',
                     CAST(count(DISTINCT repo_id) = 1 AS INTEGER) FROM repo_layers GROUP BY layer_id
    UNION ALL SELECT 'repos_per_secret', fragment_hash, 'repo_count', repo_count FROM counts
    UNION ALL SELECT 'repos_per_secret', fragment_hash, 'layer_count', layer_count FROM counts
    UNION ALL SELECT 'secret_count_distribution', CAST(repo_count AS VARCHAR), 'secret_count', count(*)
              FROM counts GROUP BY repo_count""")
def live_study(spark, d):
    study = LiveStudy(spark, fresh_path(spark, "live"), buckets=8)
    order = V.table(spark, d, "lineitem").select(
        "l_orderkey", F.col("l_partkey").alias("layer_id"), F.col("l_suppkey").alias("secret_id"),
        F.lower("l_linestatus").alias("_s"), F.col("l_linenumber").alias("start_line"),
        F.struct("l_orderkey", "l_suppkey").alias("seq")).filter(F.col("l_returnflag") == "R")
    occurrences = order.join(V.secrets(spark, d).select("secret_id", "fragment_hash"), "secret_id").select(
        "l_orderkey", "layer_id", F.concat(F.lit("etc/f"), F.col("start_line").cast("string"), F.lit("."), "_s").alias("file"),
        F.col("start_line").cast("int").alias("start_line"), "fragment_hash",
        F.when(F.col("_s") == "o", F.lit(" ")).otherwise(F.concat(F.lit("."), "_s")).alias("file_type"), "seq")
    tags = V.table(spark, d, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("tag_id"), F.col("o_custkey").alias("repo_id"),
        F.col("o_orderdate").cast("timestamp").alias("last_pushed"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.col("o_orderkey").alias("seq"))
    links = V.repo_layers(spark, d).withColumn("seq", F.lit(0))
    for i in range(BATCHES):
        study.apply(i, "seq",
                    tags=tags.filter(F.col("o_orderkey") % BATCHES == i).drop("o_orderkey"),
                    repo_layers=links.filter((F.col("repo_id") + F.col("layer_id")) % BATCHES == i),
                    occurrences=occurrences.filter(F.col("l_orderkey") % BATCHES == i).drop("l_orderkey"))
    return study.shown()
