"""Order-dependent operators and sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators import aggregates as A
from regspark.operators import sampling as M
from regspark.operators import windows as W
from workload import keyed as K
from workload import views as V
from workload.registry import query


def r6(c):
    return F.round(c, 6)


def _event_stream(spark, d):
    return V.table(spark, d, "events").select("event_id", "user_id", "event_type", "value")


@query("sentinel_fill", """
    SELECT event_id, user_id, event_type, filled FROM (
        SELECT event_id, user_id, event_type,
               last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS)
                   OVER (PARTITION BY user_id ORDER BY event_id) AS filled FROM events)
    WHERE event_type <> 'signup'""")
def sentinel_fill(spark, d):
    rows = _event_stream(spark, d).drop("value")
    return W.sentinel_fill(rows, F.col("event_type") == "signup", F.col("event_id"), F.col("event_id"),
                           ["user_id"], out="filled")


@query("sentinel_fill_stream", """
    SELECT event_id, filled FROM (
        SELECT event_id, event_type, last_value(CASE WHEN event_type = 'signup' THEN value END IGNORE NULLS)
               OVER (ORDER BY event_id) AS filled FROM events)
    WHERE event_type <> 'signup'""")
def sentinel_fill_stream(spark, d):
    """One stream without groups, as in a single crawl file."""
    out = W.sentinel_fill(_event_stream(spark, d), F.col("event_type") == "signup", F.col("value"),
                          F.col("event_id"), out="filled")
    return out.select("event_id", "filled")


GAP_SQL = """
    WITH RECURSIVE t AS (SELECT repo_id, tag_id, last_pushed,
               row_number() OVER (PARTITION BY repo_id ORDER BY last_pushed DESC, tag_id) AS rn FROM tags),
    w AS (SELECT repo_id, rn, last_pushed AS anchor, tag_id AS kept FROM t WHERE rn = 1
          UNION ALL
          SELECT t.repo_id, t.rn,
                 CASE WHEN w.anchor - t.last_pushed >= INTERVAL {days} DAY THEN t.last_pushed ELSE w.anchor END,
                 CASE WHEN w.anchor - t.last_pushed >= INTERVAL {days} DAY THEN t.tag_id END
          FROM w JOIN t ON t.repo_id = w.repo_id AND t.rn = w.rn + 1)
    SELECT kept AS tag_id FROM w WHERE kept IS NOT NULL"""
DAY_MICROS = 24 * 3600 * 1_000_000


@query("gap_thinning", GAP_SQL.format(days=90))
def gap_thinning(spark, d):
    return W.gap_thinning(V.tags(spark, d), "repo_id", "last_pushed", "tag_id", 90 * DAY_MICROS).select("tag_id")


_NULL_GAP_SQL = """
    WITH RECURSIVE t AS (SELECT repo_id, last_pushed, min(tie) AS tie,
               row_number() OVER (PARTITION BY repo_id ORDER BY last_pushed DESC) AS rn
               FROM (SELECT CASE WHEN repo_id % 40 > 0 THEN repo_id END AS repo_id, last_pushed,
                            CASE WHEN tag_id % 3 > 0 THEN tag_id END AS tie FROM tags)
               WHERE last_pushed IS NOT NULL GROUP BY 1, 2),
    w AS (SELECT repo_id, rn, last_pushed AS anchor, true AS kept, tie FROM t WHERE rn = 1
          UNION ALL
          SELECT t.repo_id, t.rn,
                 CASE WHEN w.anchor - t.last_pushed >= INTERVAL 90 DAY THEN t.last_pushed ELSE w.anchor END,
                 w.anchor - t.last_pushed >= INTERVAL 90 DAY, t.tie
          FROM w JOIN t ON t.repo_id IS NOT DISTINCT FROM w.repo_id AND t.rn = w.rn + 1)
    SELECT repo_id, strftime(anchor, '%Y-%m-%d %H:%M:%S') AS pushed, tie FROM w WHERE kept"""


def _null_ties(spark, d, fold_limit):
    rows = V.tags(spark, d).select(
        F.when(F.col("repo_id") % 40 > 0, F.col("repo_id")).alias("repo_id"), "last_pushed",
        F.when(F.col("tag_id") % 3 > 0, F.col("tag_id")).alias("tie"))
    return W.gap_thinning(rows, "repo_id", "last_pushed", "tie", 90 * DAY_MICROS, fold_limit).select(
        "repo_id", F.date_format("last_pushed", "yyyy-MM-dd HH:mm:ss").alias("pushed"), "tie").distinct()


@query("gap_thinning_null_tie", _NULL_GAP_SQL)
def gap_thinning_null_tie(spark, d):
    """Null ties and null keys, in groups folded as one array."""
    return _null_ties(spark, d, W.FOLD_LIMIT)


@query("gap_thinning_null_tie_large_groups", _NULL_GAP_SQL)
def gap_thinning_null_tie_large_groups(spark, d):
    return _null_ties(spark, d, 3)


@query("gap_thinning_large_groups", GAP_SQL.format(days=400))
def gap_thinning_large_groups(spark, d):
    """The path for groups beyond the fold limit, taken here from 12 rows on."""
    return W.gap_thinning(V.tags(spark, d), "repo_id", "last_pushed", "tag_id", 400 * DAY_MICROS,
                          fold_limit=12).select("tag_id")


@query("cumulative_months", """
    WITH m AS (SELECT month_key, count(*) AS t, count(*) FILTER (WHERE has_secret) AS s FROM study GROUP BY 1),
    axis AS (SELECT strftime(unnest(generate_series(
                 (SELECT min(month_key || '-01')::TIMESTAMP FROM m), (SELECT max(month_key || '-01')::TIMESTAMP FROM m),
                 INTERVAL 1 MONTH)), '%Y-%m') AS month_key)
    SELECT a.month_key, coalesce(sum(m.t) OVER (ORDER BY a.month_key), 0) AS total_cum,
           coalesce(sum(m.s) OVER (ORDER BY a.month_key), 0) AS secret_cum
    FROM axis a LEFT JOIN m ON a.month_key = m.month_key""")
def cumulative_months(spark, d):
    return W.cumulative_months(K.study(spark, d))


@query("cumulative_weighted", """
    WITH m AS (SELECT month_key, sum(weight) AS t, sum(CASE WHEN has_secret THEN weight ELSE 0.0 END) AS s
               FROM study GROUP BY 1)
    SELECT month_key, round(sum(t) OVER (ORDER BY month_key), 6) AS cum_total_w,
           round(sum(s) OVER (ORDER BY month_key), 6) AS cum_secret_w,
           round(CASE WHEN t = 0 THEN 0.0 ELSE s / t END, 6) AS share_w FROM m""")
def cumulative_weighted(spark, d):
    out = W.cumulative_weighted(A.repos_per_month(K.study(spark, d)))
    return out.select("month_key", *(r6(F.col(c)).alias(c) for c in out.columns[1:]))


_DIST_SQL = "SELECT n AS x, count(*) AS items FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n"


@query("ccdf", f"""
    SELECT x, sum(items) OVER (ORDER BY x DESC) AS cum_ge,
           round(sum(items) OVER (ORDER BY x DESC) / sum(items) OVER (), 6) AS ccdf FROM ({_DIST_SQL})""")
def ccdf(spark, d):
    per = V.table(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("x"))
    out = W.ccdf(A.count_distribution(per, "x", "items"), "x", "items")
    return out.select("x", "cum_ge", r6(F.col("ccdf")).alias("ccdf"))


@query("joint_ccdf", f"""
    WITH c AS ({K.COUNTS_SQL}),
    x AS (SELECT unnest(generate_series(1, (SELECT least(max(repo_count), max(layer_count)) FROM c))) AS x)
    SELECT x, round(count(*) FILTER (WHERE repo_count >= x AND layer_count >= x) / count(*), 6) AS ccdf
    FROM x, c GROUP BY x""")
def joint_ccdf(spark, d):
    counts = A.secret_repo_layer_counts(V.secrets(spark, d), V.occurrences(spark, d), V.repo_layers(spark, d))
    out = W.joint_ccdf(counts)
    return out.select("x", r6(F.col("ccdf")).alias("ccdf"))


@query("first_seen_rank", """
    SELECT o_custkey, o_orderkey, o_orderpriority FROM (
        SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS rn FROM orders)
    WHERE rn = 1""")
def first_seen_rank(spark, d):
    rows = V.table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderpriority", "o_orderdate")
    return W.first_seen(rows, "o_custkey", ["o_orderdate", "o_orderkey"]).drop("o_orderdate")


@query("rank_in_query", """
    SELECT query, seq, row_number() OVER (PARTITION BY query ORDER BY seq) AS rank FROM search_rows""")
def rank_in_query(spark, d):
    return W.rank_in_query(V.search_rows(spark, d).select("query", "seq"), ["query"], F.col("seq"))


@query("rank_label", "SELECT query, p_partkey, rank, label FROM ranking")
def rank_label(spark, d):
    return V.ranking(spark, d).select("query", "p_partkey", "rank", "label")


@query("min_group_filter", """
    SELECT o_custkey, o_orderkey FROM orders WHERE o_custkey IN (
        SELECT o_custkey FROM orders GROUP BY o_custkey HAVING count(*) >= 12)""")
def min_group_filter(spark, d):
    return W.min_group_filter(V.table(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", 12)


# --- sampling -------------------------------------------------------------


@query("reservoir", """
    SELECT repo_id, pull_count FROM (
        SELECT repo_id, pull_count, row_number() OVER (
            ORDER BY md5(concat_ws('|', '7', CAST(repo_id AS VARCHAR))), repo_id) AS rn
        FROM repositories WHERE pull_count >= 0) WHERE rn <= 500""")
def reservoir(spark, d):
    rows = V.repositories(spark, d).select("repo_id", "pull_count")
    return M.reservoir(rows, "pull_count", 500, 7, "repo_id")


_TARGET = 500_000_000
STRATIFIED_SQL = f"""
    WITH b AS (SELECT tag_id, size, {{bucket}} AS bucket,
                      md5(concat_ws('|', '42', CAST(tag_id AS VARCHAR))) AS h FROM tags WHERE size > 0),
    q AS (SELECT *, coalesce(sum(size) OVER (PARTITION BY bucket ORDER BY h, tag_id
                        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
                 sum(size) OVER (PARTITION BY bucket) AS class, sum(size) OVER () AS total FROM b)
    SELECT tag_id, size, bucket FROM q
    WHERE before < class::DOUBLE * least({_TARGET}, total)::DOUBLE / total::DOUBLE"""
_BUCKETS = "CASE " + " ".join(f"WHEN size <= {b} THEN {i}" for i, b in enumerate(P.SIZE_BOUNDS)) + " END"


@query("stratified_bytes", STRATIFIED_SQL.format(bucket=_BUCKETS))
def stratified_bytes(spark, d):
    return M.stratified_bytes(V.tags(spark, d).select("tag_id", "size"), "size", "tag_id", _TARGET, V.SEED)


@query("sample_report", f"""
    WITH full_set AS (SELECT sum(size) AS n FROM tags WHERE size > 0),
    kept AS ({STRATIFIED_SQL.format(bucket=_BUCKETS)})
    SELECT any_value(f.n) AS input_bytes, least({_TARGET}, any_value(f.n)) AS target_bytes,
           sum(k.size) AS final_bytes, count(*) AS items,
           round(abs(sum(k.size) - least({_TARGET}, any_value(f.n))) / least({_TARGET}, any_value(f.n)), 6)
               AS deviation,
           (abs(sum(k.size) - least({_TARGET}, any_value(f.n))) / least({_TARGET}, any_value(f.n)) > 0.02)::INTEGER
               AS warn
    FROM kept k, full_set f""")
def sample_report(spark, d):
    tags = V.tags(spark, d).select("tag_id", "size")
    out = M.sample_report(tags, M.stratified_bytes(tags, "size", "tag_id", _TARGET, V.SEED), "size", _TARGET)
    return out.withColumn("deviation", r6(F.col("deviation"))).withColumn("warn", F.col("warn").cast("int"))


@query("group_split", """
    SELECT o_orderkey, o_custkey,
           (('0x' || substr(md5(concat_ws('|', '42', CAST(o_custkey AS VARCHAR))), 1, 8))::BIGINT
            < CAST(floor(0.8 * 4294967296) AS BIGINT))::INTEGER AS is_train FROM orders""")
def group_split(spark, d):
    return M.group_split(V.table(spark, d, "orders").select("o_orderkey", "o_custkey"), "o_custkey")
