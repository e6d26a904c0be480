"""Sources and sinks: each query writes its table to the shared folder in the
crawler's format and reads it back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark import schemas
from regspark.functions import scalars as P
from regspark.operators import aggregates as A
from regspark.operators import stats as B
from regspark.operators import windows as W
from regspark.session import fresh_path
from regspark.sources import lists, readers, writers
from workload import keyed as K
from workload import views as V
from workload.registry import query


def _write_lines(df, path: str) -> str:
    df.select("value").write.text(path)
    return path


@query("jsonl_scan", """
    SELECT o_orderkey::VARCHAR AS digest, CAST(floor(o_totalprice) AS BIGINT) AS size,
           CASE WHEN o_orderpriority <> '2-HIGH' THEN o_custkey END AS repo_count
    FROM orders WHERE o_orderpriority NOT IN ('1-URGENT', '5-LOW') OR o_orderstatus = 'F'""")
def jsonl_scan(spark, d):
    """Good lines, and broken, mistyped, blank and key-less ones between them."""
    record = F.struct(
        F.when((F.col("o_orderpriority") != "5-LOW") | (F.col("o_orderstatus") == "F"),
               F.col("o_orderkey").cast("string")).alias("digest"),
        F.floor("o_totalprice").cast("long").alias("size"),
        F.when(F.col("o_orderpriority") != "2-HIGH", F.col("o_custkey")).alias("repo_count"))
    good = F.to_json(record)
    bad = (F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(
        F.concat(F.lit('{"digest": "x'), F.col("o_orderkey").cast("string"), F.lit('", "size": "big"}'))))
    line = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_orderstatus") != "F"), bad).otherwise(good)
    path = _write_lines(V.table(spark, d, "orders").select(line.alias("value")), fresh_path(spark, "jsonl"))
    return readers.read_jsonl(spark, path, schemas.DIGEST_ANALYSIS, "digest").select("digest", "size", "repo_count")


@query("chunk_scan", """
    SELECT o_orderpriority[1:1]::INTEGER AS chunk_no, o_orderkey::VARCHAR AS digest,
           CAST(floor(o_totalprice) AS BIGINT) AS size FROM orders""")
def chunk_scan(spark, d):
    """One numbered chunk per priority, read through one pattern."""
    root = fresh_path(spark, "chunks")
    rows = V.table(spark, d, "orders").select(
        "o_orderpriority", F.col("o_orderkey").cast("string").alias("digest"),
        F.floor("o_totalprice").cast("long").alias("size"))
    for n in range(1, 6):
        chunk = rows.filter(F.startswith(F.col("o_orderpriority"), F.lit(str(n)))).drop("o_orderpriority")
        writers.write_jsonl(chunk, f"{root}/tags__{n}.jsonl")
    return readers.read_chunks(spark, f"{root}/tags__*.jsonl", schemas.DIGEST_ANALYSIS, "digest").select(
        "chunk_no", "digest", "size")


@query("wrapped_list_scan", "SELECT c_name AS repo FROM customer")
def wrapped_list_scan(spark, d):
    path = fresh_path(spark, "lists")
    writers.write_list(V.table(spark, d, "customer"), "c_name", path, "repos")
    return readers.read_list(spark, path, "repos", "repo")


@query("long_list_scan", "SELECT p_name AS repo FROM part WHERE p_name <> ''")
def long_list_scan(spark, d):
    path = fresh_path(spark, "lists")
    writers.write_list(V.table(spark, d, "part"), "p_name", path, "repos")
    return lists.read_long_list(spark, path, "repos", "repo")


@query("array_line_scan", """
    SELECT s_suppkey AS fragment, i AS start_line FROM supplier, (SELECT unnest([1, 2]) AS i)
    WHERE s_nationkey >= 5""")
def array_line_scan(spark, d):
    def item(i):
        return F.struct(F.col("s_suppkey").cast("string").alias("fragment_hash"),
                        F.struct(F.lit("etc/x").alias("file"), F.lit(i).alias("start_line")).alias("secrets"))

    line = F.when(F.col("s_nationkey") < 3, F.lit("null")).when(F.col("s_nationkey") < 5, F.lit("[]")).otherwise(
        F.to_json(F.array(item(1), item(2))))
    path = _write_lines(V.table(spark, d, "supplier").select(line.alias("value")), fresh_path(spark, "arrays"))
    return readers.read_array_lines(spark, path, schemas.SECRET_RECORD).select(
        F.col("fragment_hash").cast("long").alias("fragment"), "secrets.start_line")


@query("search_stream_scan", """
    SELECT query, count(*) AS repos, sum(pull_count) AS pulls FROM search_rows GROUP BY query""")
def search_stream_scan(spark, d):
    """Search results as the crawler writes them: a marker row naming the
    query, then its repositories, without the query on them."""
    rows = V.search_rows(spark, d)
    path = fresh_path(spark, "stream")
    body = rows.select("query", F.lit(1).alias("part"), "seq", F.to_json(F.struct(
        "repo_name", "star_count", "pull_count")).alias("value"))
    marks = rows.groupBy("query").agg(F.lit(0).alias("part"), F.lit(0).cast("long").alias("seq")).withColumn(
        "value", F.to_json(F.struct(F.lit("#/#").alias("repo_name"), F.col("query").alias("query"))))
    marks.select("query", "part", "seq", "value").unionByName(body).repartitionByRange("query").sortWithinPartitions(
        "query", "part", "seq").select("value").write.text(path)
    back = readers.read_jsonl(spark, path, schemas.SEARCH_ROW, "repo_name", order=True)
    filled = W.sentinel_fill(back.withColumnRenamed("query", "_q"), F.col("repo_name") == "#/#",
                             F.col("_q"), F.col("_offset"), ["_file"], ["_row"])
    return filled.groupBy("query").agg(F.count(F.lit(1)).alias("repos"), F.sum("pull_count").alias("pulls"))


@query("jsonl_sink", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def jsonl_sink(spark, d):
    path = fresh_path(spark, "gzip")
    writers.write_jsonl(V.table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, 5000)
    schema = T.StructType([T.StructField("o_orderkey", T.LongType()), T.StructField("o_custkey", T.LongType()),
                           T.StructField("o_orderstatus", T.StringType())])
    return readers.read_jsonl(spark, path, schema)


@query("histogram_csv", "SELECT strftime(last_pushed, '%Y-%m') AS key, count(*) AS count FROM tags GROUP BY 1")
def histogram_csv(spark, d):
    path = fresh_path(spark, "hist")
    writers.write_hist(A.month_histogram(V.tags(spark, d), "last_pushed"), path)
    return readers.read_hist(spark, path)


@query("series_csv", "SELECT size::DOUBLE AS value FROM tags")
def series_csv(spark, d):
    path = fresh_path(spark, "series")
    writers.write_series(V.tags(spark, d), "size", path)
    return readers.read_series(spark, path)


@query("bias_csv_scan", "SELECT key, round(bias, 6) AS bias_full_over_sample FROM bias_month")
def bias_csv_scan(spark, d):
    """Written without the ratio, which reading rebuilds from the shares."""
    path = fresh_path(spark, "bias")
    table = B.bias_table(A.month_histogram(V.tags(spark, d), "last_pushed"),
                         A.month_histogram(V.sample_tags(spark, d), "last_pushed"))
    writers.write_results({"month": table.drop("bias_full_over_sample")}, path)
    back = readers.read_bias(spark, f"{path}/month", from_shares=True)
    return back.select("key", F.round("bias_full_over_sample", 6).alias("bias_full_over_sample"))


@query("bias_bins_scan", K.bias_bins_sql("pull_count", "repositories", "sample_repos") + """
    SELECT round(bin_left, 6) AS bin_left, round(bin_right, 6) AS bin_right, round(bias, 6) AS bias_full_over_sample
    FROM bias_bins""")
def bias_bins_scan(spark, d):
    path = fresh_path(spark, "bins")
    bins = B.bias_bins(V.repositories(spark, d), V.sample_repos(spark, d), "pull_count")
    writers.write_results({"bins": bins}, path)
    back = readers.read_bias_bins(spark, f"{path}/bins")
    return back.select(*(F.round(c, 6).alias(c) for c in back.columns))


@query("distribution_csv", """
    SELECT key, n AS count, round(n / sum(n) OVER (), 6) AS proportion FROM (
        SELECT coalesce(nullif(trim(status), ''), 'unknown') AS key, count(*) AS n FROM tags GROUP BY 1)""")
def distribution_csv(spark, d):
    path = fresh_path(spark, "distribution")
    writers.write_distribution(A.value_histogram(V.tags(spark, d), "status"), path)
    back = spark.read.schema("key string, count long, proportion double").option("header", True).csv(path)
    return back.withColumn("proportion", F.round("proportion", 6))


@query("table_scan", """
    SELECT o_orderkey, l_partkey FROM orders JOIN lineitem ON o_orderkey = l_orderkey
    WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND l_returnflag = 'R'""")
def table_scan(spark, d):
    t = readers.load_tables(spark, d, ("orders", "lineitem"))
    orders = t["orders"].filter(F.col("o_orderdate") >= F.lit("1998-01-01").cast("timestamp_ntz"))
    lines = t["lineitem"].filter(F.col("l_returnflag") == "R")
    return lines.join(orders, F.col("o_orderkey") == F.col("l_orderkey")).select("o_orderkey", "l_partkey")


@query("result_sink", """
    SELECT 'months' AS name, strftime(last_pushed, '%Y-%m') AS key, count(*) AS count FROM tags GROUP BY 2
    UNION ALL SELECT 'status', coalesce(nullif(trim(status), ''), 'unknown'), count(*) FROM tags GROUP BY 2""")
def result_sink(spark, d):
    path = fresh_path(spark, "results")
    tags = V.tags(spark, d)
    writers.write_results({"months": A.month_histogram(tags, "last_pushed"),
                           "status": A.value_histogram(tags, "status")}, path)
    return A.union_all(*(readers.read_hist(spark, f"{path}/{n}").select(F.lit(n).alias("name"), "key", "count")
                         for n in ("months", "status")))


@query("tsv_unique_bytes", """
    SELECT count(*) AS layers, sum(size) AS total_bytes FROM (
        SELECT l_partkey, min({'repo': 'r' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0'),
                               'size': CAST(floor(l_extendedprice) AS BIGINT)}).size AS size
        FROM lineitem GROUP BY l_partkey)""")
def tsv_unique_bytes(spark, d):
    """Tab-separated layers, unique by the first column, to JSON lines."""
    path = fresh_path(spark, "tsv")
    V.table(spark, d, "lineitem").select(
        F.col("l_partkey").cast("string"), F.concat(F.lit("r"), F.lpad(F.col("l_suppkey").cast("string"), 9, "0")),
        F.floor("l_extendedprice").cast("long")).write.option("sep", "\t").csv(path)
    writers.write_jsonl(readers.tsv_unique(spark, path), f"{path}-json")
    layers = readers.read_jsonl(spark, f"{path}-json", schemas.LAYER_TSV, "layer")
    return layers.withColumn("size", P.positive_size(F.col("size").cast("string"))).agg(
        F.count(F.lit(1)).alias("layers"), F.sum("size").alias("total_bytes"))
