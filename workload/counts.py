"""Aggregations, top-k and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators import aggregates as A
from regspark.operators import joins as J
from regspark.operators import stats as B
from regspark.operators import windows as W
from workload import keyed as K
from workload import views as V
from workload.columns import CATEGORY_SQL
from workload.registry import query


def r6(c):
    return F.round(c, 6)


@query("month_histogram", "SELECT strftime(last_pushed, '%Y-%m') AS key, count(*) AS count FROM tags GROUP BY 1")
def month_histogram(spark, d):
    return A.month_histogram(V.tags(spark, d), "last_pushed")


@query("status_histogram", """
    SELECT coalesce(nullif(trim(status), ''), 'unknown') AS key, count(*) AS count FROM tags GROUP BY 1""")
def status_histogram(spark, d):
    return A.value_histogram(V.tags(spark, d), "status")


@query("official_histogram", """
    SELECT CASE WHEN is_official THEN 'official' ELSE 'unofficial' END AS key, count(*) AS count
    FROM repositories GROUP BY 1""")
def official_histogram(spark, d):
    return A.official_histogram(V.repositories(spark, d))


@query("repos_per_month", K.MONTHS_SQL)
def repos_per_month(spark, d):
    return K.months_rounded(A.repos_per_month(K.study(spark, d)))


TOP_SQL = """
    SELECT {origin} AS origin, count(*) AS n FROM occurrences o JOIN secrets s ON o.secret_id = s.secret_id
    {where} GROUP BY 1 ORDER BY n DESC, origin {limit}"""
UNKNOWN = "coalesce(nullif(trim(s.origin), ''), 'unknown')"


@query("top_origins", TOP_SQL.format(origin=UNKNOWN, where="", limit="LIMIT 20"))
def top_origins(spark, d):
    return A.top_origins(V.occurrences(spark, d), V.secrets(spark, d))


@query("top_origins_named", TOP_SQL.format(
    origin="s.origin", where="WHERE s.origin IS NOT NULL AND s.origin <> ''", limit="LIMIT 20"))
def top_origins_named(spark, d):
    return A.top_origins(V.occurrences(spark, d), V.secrets(spark, d), drop_blank=True)


@query("repos_per_secret", f"SELECT fragment_hash, repo_count FROM ({K.COUNTS_SQL})")
def repos_per_secret(spark, d):
    return A.repos_per_secret(V.occurrences(spark, d), V.repo_layers(spark, d), V.secrets(spark, d))


@query("secret_count_distribution", f"""
    SELECT repo_count, count(*) AS secret_count FROM ({K.COUNTS_SQL}) GROUP BY repo_count""")
def secret_count_distribution(spark, d):
    return A.count_distribution(repos_per_secret(spark, d))


@query("layer_uniqueness", K.UNIQ_SQL)
def layer_uniqueness(spark, d):
    return A.layer_uniqueness(V.repo_layers(spark, d))


@query("secret_repo_layer_counts", K.COUNTS_SQL.replace(
    "GROUP BY", "WHERE s.origin LIKE 'github%' OR s.origin LIKE 'private%' GROUP BY"))
def secret_repo_layer_counts(spark, d):
    where = F.startswith(F.col("origin"), F.lit("github")) | F.startswith(F.col("origin"), F.lit("private"))
    return A.secret_repo_layer_counts(V.secrets(spark, d), V.occurrences(spark, d), V.repo_layers(spark, d), where)


@query("weighted_layer_count", f"""
    WITH w AS ({K.WEIGHTS_SQL}), u AS ({K.UNIQ_SQL}), p AS ({K.PAIRS_SQL})
    SELECT p.fragment_hash, round(sum(CASE WHEN u.is_unique = 1 THEN w.w_unique ELSE w.w_nonunique END), 6)
           AS weighted_layer_count
    FROM w, p LEFT JOIN u ON p.layer_id = u.layer_id GROUP BY p.fragment_hash""")
def weighted_layer_count(spark, d):
    out = A.weighted_layer_count(K.fragment_pairs(spark, d), A.layer_uniqueness(V.repo_layers(spark, d)),
                                 K.weights(spark, d))
    return out.withColumn("weighted_layer_count", r6(F.col("weighted_layer_count")))


@query("filetype_frequency", """
    SELECT coalesce(nullif(trim(file_type), ''), 'unknown') AS file_type, count(*) AS n
    FROM occurrences GROUP BY 1""")
def filetype_frequency(spark, d):
    return A.filetype_frequency(V.occurrences(spark, d))


@query("file_size_stats", """
    SELECT round(avg(file_size), 6) AS avg_file_size,
           round(quantile_cont(file_size::DOUBLE, 0.5), 6) AS median_file_size
    FROM occurrences WHERE file_size IS NOT NULL""")
def file_size_stats(spark, d):
    out = A.file_size_stats(V.occurrences(spark, d))
    return out.select(*(r6(F.col(c)).alias(c) for c in out.columns))


_STATS = ("max_depth", "file_count", "uncompressed_size")


@query("layer_stats", "SELECT " + ", ".join(
    f"round(avg(l.{c}), 6) AS avg_{c}, round(quantile_cont(l.{c}::DOUBLE, 0.5), 6) AS median_{c}" for c in _STATS)
    + " FROM occurrences o JOIN layers l ON o.layer_id = l.layer_id")
def layer_stats(spark, d):
    out = A.layer_stats(V.occurrences(spark, d), V.layers(spark, d), _STATS)
    return out.select(*(r6(F.col(c)).alias(c) for c in out.columns))


@query("unique_layer_share", """
    SELECT n AS total_layers, u AS unique_layers, round(u / n, 6) AS unique_share_sample,
           0.2820::DOUBLE AS unique_share_full_reference, round(u / n - 0.2820, 6) AS bias_abs_diff
    FROM (SELECT count(*) AS n, count(*) FILTER (WHERE coalesce(repo_count, len(repos)) = 1) AS u FROM selection)""")
def unique_layer_share(spark, d):
    out = A.unique_layer_share(V.selection(spark, d))
    reals = ("unique_share_sample", "bias_abs_diff")
    return out.select(*(r6(F.col(c)).alias(c) if c in reals else F.col(c) for c in out.columns))


@query("layer_file_summary", r"""
    SELECT f.layer, count(*) AS file_count,
           max(length(file) - length(replace(file, '/', '')) + 1) AS max_depth,
           sum(strlen(text)) AS uncompressed_size, coalesce(any_value(h.n), 0) AS secret_fragments
    FROM files f LEFT JOIN (
        SELECT layer, count(DISTINCT line) AS n FROM (SELECT layer, unnest(string_split(text, chr(10))) AS line FROM files)
        WHERE regexp_matches(line, 'token = "[0-9a-f]{40}"') GROUP BY layer) h ON f.layer = h.layer
    WHERE text <> '' GROUP BY f.layer""")
def layer_file_summary(spark, d):
    from regspark.operators import scan as C
    from workload.scanning import RULES

    files = V.files(spark, d)
    frags = C.fragments(files)
    hits = C.layer_secret_list(C.scan_distinct(frags, RULES[:1]))
    return A.layer_file_summary(files, hits)


@query("collection_counters", """
    WITH e AS (SELECT event_id, user_id, event_type, event_type = 'signup' AS m,
                      CAST(json_extract(props, '$.k') AS VARCHAR) AS name FROM events),
    f AS (SELECT name, min_by(user_id, event_id) AS user_id FROM e WHERE NOT m GROUP BY name)
    SELECT e.user_id, count(*) FILTER (WHERE m) AS total_queries, count(*) FILTER (WHERE NOT m) AS total_repos,
           coalesce(any_value(u.n), 0) AS unique_repos
    FROM e LEFT JOIN (SELECT user_id, count(*) AS n FROM f GROUP BY user_id) u ON e.user_id = u.user_id
    GROUP BY e.user_id""")
def collection_counters(spark, d):
    e = V.table(spark, d, "events").select(
        "event_id", "user_id", "event_type", F.get_json_object("props", "$.k").alias("name"))
    return A.collection_counters(e, "user_id", F.col("event_type") == "signup", "name", "event_id")


@query("category_rollup", f"""
    SELECT {CATEGORY_SQL.format(c='origin')} AS category, sum(n) AS n
    FROM ({TOP_SQL.format(origin=UNKNOWN, where='', limit='')}) GROUP BY 1""")
def category_rollup(spark, d):
    return A.category_rollup(A.origin_counts(V.occurrences(spark, d), V.secrets(spark, d)))


@query("contingency", """
    SELECT status_cat, round(sum(CASE WHEN has_secret THEN 0.0 ELSE weight END), 6) AS "has_secret=False",
           round(sum(CASE WHEN has_secret THEN weight ELSE 0.0 END), 6) AS "has_secret=True"
    FROM study GROUP BY status_cat""")
def contingency(spark, d):
    out = A.contingency(K.study(spark, d), "status_cat")
    return out.select("status_cat", *(r6(F.col(f"`has_secret={v}`")).alias(f"has_secret={v}") for v in (False, True)))


@query("first_seen_curve", """
    SELECT month, count(*) AS new_keys FROM (
        SELECT o_custkey, min(strftime(o_orderdate, '%Y-%m')) AS month FROM orders GROUP BY o_custkey) GROUP BY month""")
def first_seen_curve(spark, d):
    rows = V.table(spark, d, "orders").select("o_custkey", P.month_key(F.col("o_orderdate")).alias("month"))
    return A.first_seen_curve(rows, "o_custkey", "month")


@query("byte_total", """
    SELECT count(*) AS unique_keys, sum(s) AS total_bytes FROM (
        SELECT l_partkey, min(CAST(floor(l_extendedprice) AS BIGINT)) AS s FROM lineitem GROUP BY l_partkey)""")
def byte_total(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_partkey", F.floor("l_extendedprice").cast("long").alias("size"))
    return A.byte_total(rows, "l_partkey", "size", "size")


@query("top_k", """
    SELECT o_custkey, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 20""")
def top_k(spark, d):
    rows = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))
    return A.top_k(rows, "n", 20, "o_custkey")


@query("head_k", """
    SELECT * FROM (SELECT l_suppkey, count(*) AS n, min(l_partkey) AS first FROM lineitem GROUP BY l_suppkey
                   ORDER BY l_suppkey LIMIT 19)""")
def head_k(spark, d):
    rows = V.table(spark, d, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), F.min("l_partkey").alias("first"))
    return A.head_k(rows, "l_suppkey", 19, "n")


@query("sort_abs", """
    SELECT c_custkey, c_acctbal, abs(c_acctbal) AS abs_value FROM customer""")
def sort_abs(spark, d):
    return A.sort_abs(V.table(spark, d, "customer").select("c_custkey", "c_acctbal"), "c_acctbal")


@query("sort_missing", """
    SELECT layer_id, digest FROM layers WHERE layer_id NOT IN (SELECT layer_id FROM repo_layers)""")
def sort_missing(spark, d):
    missing = J.seen_anti(V.layers(spark, d).select("layer_id", "digest"), V.repo_layers(spark, d), "layer_id")
    return A.ordered_export(missing, "digest")


@query("distinct_first", """
    SELECT digest, min_by(file_count, seq) AS file_count, min_by(l_partkey, seq) AS l_partkey
    FROM layer_lines GROUP BY digest""")
def distinct_first(spark, d):
    rows = V.layer_lines(spark, d).select("digest", "seq", "file_count", "l_partkey")
    return W.distinct_first(rows, "digest", "seq").drop("seq")


@query("distinct_pairs", "SELECT DISTINCT layer_id, secret_id FROM occurrences")
def distinct_pairs(spark, d):
    return A.distinct_pairs(V.occurrences(spark, d), "layer_id", "secret_id")


@query("union_all", """
    SELECT strftime(last_pushed, '%Y-%m') AS month, size FROM tags
    UNION ALL SELECT strftime(last_pushed, '%Y-%m'), size FROM sample_tags""")
def union_all(spark, d):
    month = P.month_key(F.col("last_pushed")).alias("month")
    return A.union_all(V.tags(spark, d).select(month, "size"), V.sample_tags(spark, d).select(month, "size"))


@query("sort_unique", "SELECT DISTINCT o_custkey FROM orders")
def sort_unique(spark, d):
    return A.sort_unique(V.table(spark, d, "orders"), "o_custkey").select("o_custkey")


@query("unique_repos", """
    SELECT DISTINCT 'Customer#' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS repo_name FROM lineitem
    WHERE 'Customer#' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') NOT IN (SELECT c_name FROM customer)""")
def unique_repos(spark, d):
    rows = V.table(spark, d, "lineitem").select(V.customer_name(F.col("l_partkey")).alias("repo_name"))
    return A.unique_repos(rows, V.repositories(spark, d))
