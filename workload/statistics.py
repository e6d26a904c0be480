"""Sample against population, associations, and ranking quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators import aggregates as A
from regspark.operators import listwise as L
from regspark.operators import ranking as R
from regspark.operators import stats as B
from regspark.plans import study as S
from regspark.plans import validation as D
from workload import keyed as K
from workload import views as V
from workload.registry import query


def r6(c):
    return F.round(c, 6)


def rounded(df, *keys):
    return df.select(*(F.col(c) if c in keys else r6(F.col(c)).alias(c) for c in df.columns))


_BIAS = """
    SELECT key, CAST(count_full AS BIGINT) AS count_full, CAST(count_sample AS BIGINT) AS count_sample,
           round(p_full, 6) AS p_full, round(p_sample, 6) AS p_sample, round(bias, 6) AS bias_full_over_sample
    FROM {}"""


@query("bias_table", _BIAS.format("bias_month"))
def bias_table(spark, d):
    out = B.bias_table(A.month_histogram(V.tags(spark, d), "last_pushed"),
                       A.month_histogram(V.sample_tags(spark, d), "last_pushed"))
    return rounded(out, "key", "count_full", "count_sample")


@query("bias_bins", K.bias_bins_sql("size", "tags", "sample_tags") + """
    SELECT round(bin_left, 6) AS bin_left, round(bin_right, 6) AS bin_right, count_full, count_sample,
           round(p_full, 6) AS p_full, round(p_sample, 6) AS p_sample, round(bias, 6) AS bias_full_over_sample
    FROM bias_bins""")
def bias_bins(spark, d):
    out = B.bias_bins(V.tags(spark, d), V.sample_tags(spark, d), "size")
    return rounded(out, "count_full", "count_sample")


@query("quantile_series", f"""
    SELECT unnest([{K.PROBS}]) AS quantile,
           round(unnest(quantile_cont(pull_count::DOUBLE, [{K.PROBS}])), 6) AS value, 'full_pull_count' AS series
    FROM repositories""")
def quantile_series(spark, d):
    out = B.quantile_series(V.repositories(spark, d), "pull_count", "full_pull_count")
    return out.select("quantile", r6(F.col("value")).alias("value"), "series")


@query("unique_bias_weights", f"""
    SELECT round(w_unique, 6) AS w_unique, round(w_nonunique, 6) AS w_nonunique, round(f_unique, 6) AS f_unique,
           round(s_unique, 6) AS s_unique FROM ({K.WEIGHTS_SQL})""")
def unique_bias_weights(spark, d):
    return rounded(K.weights(spark, d))


def ks_sql(a: str, b: str) -> str:
    return f"""
    WITH u AS (SELECT v, sum(na) AS na, sum(nb) AS nb FROM (
                   SELECT {a}::DOUBLE AS v, 1 AS na, 0 AS nb FROM tags
                   UNION ALL SELECT {b}::DOUBLE, 0, 1 FROM sample_tags) GROUP BY v),
    r AS (SELECT sum(na) OVER (ORDER BY v) AS ca, sum(nb) OVER (ORDER BY v) AS cb,
                 sum(na) OVER () AS ta, sum(nb) OVER () AS tb FROM u),
    g AS (SELECT max(abs(ca::DOUBLE / ta::DOUBLE - cb::DOUBLE / tb::DOUBLE)) AS s, max(ta) AS n, max(tb) AS m FROM r)
    SELECT round(s, 6) AS statistic, n AS n_full, m AS n_sample,
           round(CASE WHEN sqrt(n::DOUBLE * m / (n + m)) * s < 0.2 THEN 1.0 ELSE least(greatest(
               (SELECT sum(2 * (CASE WHEN k % 2 = 1 THEN 1 ELSE -1 END)
                    * exp(-2.0 * k * k * (n::DOUBLE * m / (n + m)) * s * s))
                FROM (SELECT unnest(generate_series(1, 60)) AS k)), 0.0), 1.0) END, 6) AS pvalue
    FROM g"""


@query("ks_2samp", ks_sql("epoch(last_pushed)", "epoch(last_pushed)"))
def ks_2samp(spark, d):
    def epochs(df):
        return df.select(P.epoch_seconds(F.col("last_pushed")).alias("e"))

    return rounded(B.ks_2samp(epochs(V.tags(spark, d)), epochs(V.sample_tags(spark, d)), "e"), "n_full", "n_sample")


@query("ks_2samp_exact", """
    WITH RECURSIVE v AS (SELECT s_acctbal AS x, s_nationkey < 12 AS first FROM supplier),
    g AS (SELECT x, sum(sum(first::INT)) OVER (ORDER BY x) AS ca, sum(sum((NOT first)::INT)) OVER (ORDER BY x) AS cb
          FROM v GROUP BY x),
    t AS (SELECT count(*) FILTER (WHERE first) AS n, count(*) FILTER (WHERE NOT first) AS m FROM v),
    d AS (SELECT max(abs(ca / n - cb / m)) AS d, any_value(n)::BIGINT AS n, any_value(m)::BIGINT AS m FROM g, t),
    paths AS (SELECT 0::BIGINT AS k, n, m, round(d * n * m)::BIGINT AS h, list_transform(range(0, n + 1), lambda i: 0.0::DOUBLE) AS q
              FROM d
        UNION ALL SELECT k + 1, n, m, h, list_transform(range(0, n + 1), lambda i:
            CASE WHEN k + 1 - i < 0 OR k + 1 - i > m THEN 0.0 WHEN abs(i * m - (k + 1 - i) * n) >= h THEN 1.0
                 ELSE (i * coalesce(q[i], 0.0) + (k + 1 - i) * q[i + 1]) / (k + 1) END::DOUBLE)
        FROM paths WHERE k < n + m)
    SELECT round(d, 6) AS statistic, d.n AS n_full, d.m AS n_sample, round(q[d.n + 1], 6) AS pvalue
    FROM d, paths WHERE k = d.n + d.m""")
def ks_2samp_exact(spark, d):
    """Balances of the suppliers of some nations against those of the others."""
    rows, first = V.table(spark, d, "supplier"), F.col("s_nationkey") < 12
    return rounded(B.ks_2samp(rows.filter(first), rows.filter(~first), "s_acctbal", method="auto"), "n_full", "n_sample")


@query("chi2_gof", """
    WITH e AS (SELECT count_sample AS o, count_full / sum(count_full) OVER () * sum(count_sample) OVER () AS e
               FROM bias_status),
    x AS (SELECT sum(CASE WHEN e > 0 THEN (o - e) * (o - e) / e WHEN o > 0 THEN 'inf'::DOUBLE ELSE 0.0 END) AS s,
                 count(*) - 1 AS dof FROM e)
    SELECT round(s, 4) AS statistic, dof, round(exp(-s / 2), 6) AS pvalue FROM x""")
def chi2_gof(spark, d):
    """Three status values leave two degrees of freedom, where p = exp(-x/2)."""
    out = B.chi2_gof(A.value_histogram(V.tags(spark, d), "status"), A.value_histogram(V.sample_tags(spark, d), "status"))
    return out.select(F.round("statistic", 4).alias("statistic"), "dof", r6(F.col("pvalue")).alias("pvalue"))


def _corr_sql(x: str) -> str:
    return f"""
    (SELECT sum(weight * (x - mx) * (y - my)) / sqrt(sum(weight * (x - mx) * (x - mx)) * sum(weight * (y - my) * (y - my)))
     FROM (SELECT x, y, weight, sum(weight * x) OVER () / sum(weight) OVER () AS mx,
                  sum(weight * y) OVER () / sum(weight) OVER () AS my
           FROM (SELECT {x}::DOUBLE AS x, has_secret::INTEGER::DOUBLE AS y, weight FROM study WHERE weight > 0)))"""


def _cramers_sql(cat: str) -> str:
    return f"""
    (SELECT sqrt(sum((o - e) * (o - e) / e) / (any_value(n) * (least(any_value(r), any_value(c)) - 1))) FROM (
        SELECT coalesce(x.o, 0.0) AS o, a.w * b.w / t.n AS e, t.n, t.r, t.c
        FROM (SELECT {cat} AS k, sum(weight) AS w FROM study GROUP BY 1) a,
             (SELECT has_secret AS f, sum(weight) AS w FROM study GROUP BY 1) b
        LEFT JOIN (SELECT {cat} AS k, has_secret AS f, sum(weight) AS o FROM study GROUP BY 1, 2) x
               ON x.k = a.k AND x.f = b.f,
             (SELECT sum(weight) AS n, count(DISTINCT {cat}) AS r, count(DISTINCT has_secret) AS c FROM study) t)
     WHERE e <> 0)"""


@query("weighted_corr", f"SELECT round({_corr_sql('pull_count')}, 6) AS value")
def weighted_corr(spark, d):
    return rounded(B.weighted_corr(K.study(spark, d), "pull_count", F.col("has_secret").cast("double"), "weight"))


@query("weighted_cramers_v", f"SELECT round({_cramers_sql('status_cat')}, 6) AS value")
def weighted_cramers_v(spark, d):
    return rounded(B.weighted_cramers_v(K.study(spark, d), "status_cat"))


ASSOCIATION_SQL = " UNION ALL ".join(
    [f"SELECT '{n}' AS variable, 'numeric_corr_weighted' AS type, round({_corr_sql(x)}, 6) AS value"
     for n, x in (("pull_count", "pull_count"), ("star_count", "star_count"),
                  ("last_pushed_epoch", "epoch_us(last_pushed) / 1000000.0"))]
    + [f"SELECT '{c}', 'categorical_cramers_v_weighted', round({_cramers_sql(c)}, 6)"
       for c in ("status_cat", "is_official_cat", "is_automated_cat")])


@query("association_metrics", ASSOCIATION_SQL)
def association_metrics(spark, d):
    from regspark.session import cut_lineage

    return rounded(B.association_metrics(cut_lineage(K.study(spark, d))), "variable", "type")


@query("repo_study_frame", """
    SELECT repo_id, month_key, status_cat, is_official_cat, is_automated_cat, has_secret::INTEGER AS has_secret,
           round(weight, 6) AS weight FROM study""")
def repo_study_frame(spark, d):
    return K.study(spark, d).select("repo_id", "month_key", "status_cat", "is_official_cat", "is_automated_cat",
                                    F.col("has_secret").cast("int").alias("has_secret"),
                                    r6(F.col("weight")).alias("weight"))


# --- ranking quality ------------------------------------------------------

_SPEARMAN = """
    spearman AS (SELECT query, corr(rx, ry) AS spearman FROM (
        SELECT query, rank() OVER (PARTITION BY query ORDER BY rank)
                      + (count(*) OVER (PARTITION BY query, rank) - 1) / 2.0 AS rx,
               rank() OVER (PARTITION BY query ORDER BY -score)
                      + (count(*) OVER (PARTITION BY query, score) - 1) / 2.0 AS ry,
               count(*) OVER (PARTITION BY query) AS n
        FROM ranking) WHERE n >= 5 GROUP BY query)"""


def _dcg(order: str) -> str:
    return f"""
        SELECT query, sum(disc * gain) AS dcg FROM (
            SELECT query, o, sum(1.0 / log2(pos + 1)) AS disc, avg(label) AS gain FROM (
                SELECT query, {order} AS o, label,
                       row_number() OVER (PARTITION BY query ORDER BY {order} DESC, rank) AS pos FROM ranking)
            GROUP BY query, o) GROUP BY query"""


_NDCG = f"ndcg AS (SELECT a.query, a.dcg / b.dcg AS ndcg FROM ({_dcg('score')}) a JOIN ({_dcg('label')}) b ON a.query = b.query)"
_SAME = """
    same AS (SELECT query, sum(k - 1)::DOUBLE / sum(n) AS same_score_share, sum(n) AS group_size FROM (
        SELECT query, score, count(DISTINCT (f1, f2)) AS k, count(*) AS n FROM ranking GROUP BY query, score)
        GROUP BY query)"""
_FEATURES = ("f1", "f2")


@query("spearman_per_group", f"WITH {_SPEARMAN} SELECT query, round(spearman, 6) AS spearman FROM spearman")
def spearman_per_group(spark, d):
    return rounded(R.spearman_per_group(V.ranking(spark, d), "query"), "query")


@query("ndcg_per_group", f"WITH {_NDCG} SELECT query, round(ndcg, 6) AS ndcg FROM ndcg")
def ndcg_per_group(spark, d):
    return rounded(R.ndcg_per_group(V.ranking(spark, d), "query"), "query")


@query("same_score_share", f"""
    WITH {_SAME} SELECT query, round(same_score_share, 6) AS same_score_share, group_size FROM same""")
def same_score_share(spark, d):
    return rounded(R.same_score_share(V.ranking(spark, d), "query", features=_FEATURES), "query", "group_size")


@query("ranking_quality", f"""
    WITH {_SPEARMAN}, {_NDCG}, {_SAME}
    SELECT count(*) AS queries, round(avg(spearman), 6) AS spearman, round(avg(ndcg), 6) AS ndcg,
           round(avg(same_score_share), 6) AS same_score_share
    FROM spearman s JOIN ndcg n ON s.query = n.query JOIN same m ON s.query = m.query""")
def ranking_quality(spark, d):
    return rounded(R.ranking_quality(V.ranking(spark, d), "query", features=_FEATURES), "queries")


@query("dummy_rank_rule", """
    WITH a AS (SELECT query, rank - 1 AS r, score AS s, 0 AS dummy FROM ranking
               UNION ALL SELECT query, count(*), 48.0, 1 FROM ranking GROUP BY query),
    p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY s DESC, r) - 1 AS pos FROM a),
    x AS (SELECT query, sum(CASE WHEN dummy = 0 THEN (r - pos)::DOUBLE * (r - pos) END) AS d2,
                 count(*) FILTER (WHERE dummy = 0) AS n, max(CASE WHEN dummy = 1 THEN pos END) AS dummy_position
          FROM p GROUP BY query),
    y AS (SELECT *, greatest(1 - 6 * d2 / (n::DOUBLE * (n::DOUBLE * n - 1)), 0.0) AS rho FROM x)
    SELECT query, n, dummy_position, round(rho, 6) AS rho,
           (dummy_position <= floor(rho * (n + 1)))::INTEGER AS inside FROM y""")
def dummy_rank_rule(spark, d):
    rows = V.ranking(spark, d).select("query", (F.col("rank") - 1).alias("rank"), "score",
                                      F.lit(48.0).alias("dummy_score"))
    out = R.dummy_rank_rule(rows, "query")
    return out.select("query", "n", "dummy_position", r6(F.col("rho")).alias("rho"),
                      F.col("inside").cast("int").alias("inside"))


@query("rank_model", """
    WITH r AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY seq) AS rank FROM match_rows)
    SELECT query, rank, max(rank) OVER (PARTITION BY query) - rank + 1 AS label,
           (('0x' || substr(md5(concat_ws('|', '42', query)), 1, 8))::BIGINT
            < CAST(floor(0.8 * 4294967296) AS BIGINT))::INTEGER AS is_train,
           1 AS has_score, 1 AS same_for_equal_features FROM r""")
def rank_model(spark, d):
    """Trees fitted on 80 % of the queries, all rows scored. What does not
    depend on the trees is checked: every row has a finite score, and rows of
    equal features have the same."""
    from pyspark.sql import Window

    from regspark.functions import textmatch as T
    from regspark.operators import sampling as M
    from regspark.operators import windows as W

    ranked = W.rank_in_query(V.match_rows(spark, d), ["query"], F.col("seq"))
    rows = W.rank_label(T.feature_rows(ranked), "query")
    split = M.group_split(rows, "query")
    model = R.fit_rank_model(split.filter("is_train = 1"), trees=3, depth=3)
    alike = Window.partitionBy(*T.FEATURES)
    score = F.col("score")
    return R.score_rows(model, split).select(
        "query", "rank", "label", "is_train",
        (score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))).cast("int").alias("has_score"),
        (F.max(score).over(alike) == F.min(score).over(alike)).cast("int").alias("same_for_equal_features"))


_LAMBDA_SQL = """
    WITH l AS (SELECT query, rank, label::DOUBLE AS l, score::DOUBLE AS s,
                      row_number() OVER (PARTITION BY query ORDER BY score DESC, rank) AS p FROM ranking),
    i AS (SELECT query, sum(l / log2(best + 1)) AS ideal FROM (
              SELECT query, l, row_number() OVER (PARTITION BY query ORDER BY l DESC) AS best FROM l) GROUP BY query),
    pairs AS (SELECT a.query, a.rank AS up, b.rank AS down, 1 / (1 + exp(0.05 * (a.s - b.s))) AS rho,
                     (a.l - b.l) * abs(1 / log2(a.p + 1) - 1 / log2(b.p + 1)) / ideal AS change
              FROM l a JOIN l b ON a.query = b.query AND a.l > b.l AND least(a.p, b.p) <= 30 JOIN i ON i.query = a.query),
    sums AS (SELECT query, rank, sum(g) AS g, sum(w) AS w FROM (
        SELECT query, up AS rank, 0.05 * rho * change AS g, 0.05 * 0.05 * rho * (1 - rho) * change AS w FROM pairs
        UNION ALL SELECT query, down, -0.05 * rho * change, 0.05 * 0.05 * rho * (1 - rho) * change FROM pairs)
        GROUP BY query, rank)
    SELECT query, rank, round(coalesce(g, 0), 8) AS gradient, round(coalesce(w, 0), 8) AS weight
    FROM ranking LEFT JOIN sums USING (query, rank)"""


def _gradients(spark, d, **how):
    found = L.lambda_gradients(V.ranking(spark, d), sigma=0.05, **how)
    return found.select("query", "rank", F.round("gradient", 8).alias("gradient"), F.round("weight", 8).alias("weight"))


@query("lambda_gradients", _LAMBDA_SQL)
def lambda_gradients(spark, d):
    return _gradients(spark, d)


@query("lambda_gradients_large_groups", _LAMBDA_SQL)
def lambda_gradients_large_groups(spark, d):
    """As ``lambda_gradients``, each query too large for one task."""
    return _gradients(spark, d, task_rows=20)


@query("ranking_plan", """
    WITH r AS (SELECT query, count(*) AS n FROM match_rows GROUP BY query),
    t AS (SELECT query, n FROM r WHERE n >= 5 AND ('0x' || substr(md5(concat_ws('|', '42', query)), 1, 8))::BIGINT
          >= CAST(floor(0.8 * 4294967296) AS BIGINT))
    SELECT count(*) AS held_out_queries, sum(n)::BIGINT AS held_out_rows, 1 AS scores_finite, 1 AS better_than_reversed FROM t""")
def ranking_plan(spark, d):
    """The whole plan. What does not depend on the trees is checked: the held-out
    queries and rows, finite scores, and a mean gain above that of the worst order."""
    from regspark.functions import textmatch as T
    from regspark.operators import windows as W
    from regspark.plans.ranking import ranking_plan as plan

    ranked = W.rank_in_query(V.match_rows(spark, d), ["query"], F.col("seq"))
    found = plan(T.feature_rows(ranked), rounds=3, depth=4)
    scored = found["scored"]
    worst = R.ndcg_per_group(scored.withColumn("score", -F.col("label").cast("double")), "query").agg(F.avg("ndcg"))
    score = F.col("score")
    return scored.agg(
        F.count_distinct("query").alias("held_out_queries"), F.count(F.lit(1)).alias("held_out_rows"),
        F.min((score.isNotNull() & ~F.isnan(score) & (F.abs(score) < float("inf"))).cast("int")).alias("scores_finite"),
    ).crossJoin(found["per_query"].agg((F.avg("ndcg") > worst.scalar()).cast("int").alias("better_than_reversed")))


_NULL_NDCG_SQL = """
    WITH r AS (SELECT p_brand AS query, p_size AS label, p_partkey,
                      CASE WHEN p_partkey % 5 > 0 THEN CAST(p_partkey % 7 AS DOUBLE) END AS score FROM part),
    p AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC NULLS FIRST) AS pos,
                 row_number() OVER (PARTITION BY query ORDER BY label DESC) AS best FROM r),
    b AS (SELECT query, sum(1 / log2(pos + 1)) * avg(label) AS g FROM p GROUP BY query, score),
    i AS (SELECT query, sum(label / log2(best + 1)) AS ideal FROM p GROUP BY query)
    SELECT query, round(sum(g) / any_value(ideal), 6) AS ndcg FROM b JOIN i USING (query) GROUP BY query"""


def _null_scores(spark, d):
    return V.table(spark, d, "part").select(
        F.col("p_brand").alias("query"), F.col("p_size").alias("label"), F.col("p_partkey").alias("rank"),
        F.when(F.col("p_partkey") % 5 > 0, (F.col("p_partkey") % 7).cast("double")).alias("score"))


@query("ndcg_null_scores", _NULL_NDCG_SQL)
def ndcg_null_scores(spark, d):
    return R.ndcg_per_group(_null_scores(spark, d), "query").select("query", r6(F.col("ndcg")).alias("ndcg"))


@query("ndcg_null_scores_large_groups", _NULL_NDCG_SQL)
def ndcg_null_scores_large_groups(spark, d):
    """As ``ndcg_null_scores``, each group too large for one task."""
    return R.ndcg_per_group(_null_scores(spark, d), "query", task_rows=3).select(
        "query", r6(F.col("ndcg")).alias("ndcg"))


# --- whole plans ----------------------------------------------------------


def _long(tables: dict, skip=()):
    """All results as (name, rows) so that one frame shows each was computed."""
    return A.union_all(*(df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
                         for name, df in sorted(tables.items()) if name not in skip))


@query("run_study", f"""
    SELECT 'repos_with_secret_per_month' AS name, (SELECT count(DISTINCT month_key) FROM study) AS n
    UNION ALL SELECT 'top20_secret_origin', (SELECT least(20, count(DISTINCT coalesce(nullif(trim(origin), ''), '?')))
        FROM secrets WHERE secret_id IN (SELECT secret_id FROM occurrences))
    UNION ALL SELECT 'secret_origin_counts', (SELECT count(DISTINCT coalesce(nullif(trim(origin), ''), '?'))
        FROM secrets WHERE secret_id IN (SELECT secret_id FROM occurrences))
    UNION ALL SELECT 'secret_repo_counts_per_secret', (SELECT count(*) FROM ({K.COUNTS_SQL}))
    UNION ALL SELECT 'secret_repo_counts_distribution', (SELECT count(DISTINCT repo_count) FROM ({K.COUNTS_SQL}))
    UNION ALL SELECT 'secret_repo_layer_counts_weighted', (SELECT count(*) FROM ({K.COUNTS_SQL}))
    UNION ALL SELECT 'metadata_association_metrics', 6
    UNION ALL SELECT 'secrets_filetype_frequency', (SELECT count(DISTINCT file_type) FROM occurrences)
    UNION ALL SELECT 'secrets_file_stats', 1 UNION ALL SELECT 'secrets_layer_stats', 1
    UNION ALL SELECT 'contingency_status_cat', (SELECT count(DISTINCT status_cat) FROM study)
    UNION ALL SELECT 'contingency_is_official_cat', (SELECT count(DISTINCT is_official_cat) FROM study)
    UNION ALL SELECT 'contingency_is_automated_cat', (SELECT count(DISTINCT is_automated_cat) FROM study)""")
def run_study(spark, d):
    """Row counts of the thirteen study tables."""
    tables = {
        "repositories": V.repositories(spark, d), "tags": V.tags(spark, d), "layers": V.layers(spark, d),
        "repo_layers": V.repo_layers(spark, d), "secrets": V.secrets(spark, d),
        "occurrences": V.occurrences(spark, d)}
    return _long(S.run_study(tables, K.biases(spark, d), A.unique_layer_share(V.selection(spark, d))))


def _bins_count(c: str, full: str) -> str:
    return f"(SELECT count(*) FROM ({K.BINS_SQL.format(c=c + '::DOUBLE', probs=K.PROBS, full=full)}))"


def _keys(view: str, side: str = "") -> str:
    return f"(SELECT count(*) FROM {view}{f' WHERE {side} > 0' if side else ''})"


VALIDATION_SQL = " UNION ALL ".join(
    [f"SELECT 'bias_{n}' AS name, {_keys(v)} AS n UNION ALL SELECT 'dist_full_{n}', {_keys(v, 'count_full')}"
     f" UNION ALL SELECT 'dist_sample_{n}', {_keys(v, 'count_sample')}"
     for n, v in (("last_pushed_month", "bias_month"), ("status", "bias_status"), ("is_official", "bias_official"))]
    + [f"SELECT 'bias_pull_count_bins', {_bins_count('pull_count', 'repositories')}",
       f"SELECT 'bias_size_bins', {_bins_count('size', 'tags')}"]
    + [f"SELECT 'quantiles_{n}', 42" for n in ("pull_count", "size", "last_pushed_epoch")]
    + ["SELECT 'unique_layer_share', 1", "SELECT 'ks_tests', 3", "SELECT 'chi2_tests', 2"])


@query("run_validation", VALIDATION_SQL)
def run_validation(spark, d):
    """Row counts of the validation tables and tests."""
    return _long(D.run_validation(V.tags(spark, d), V.repositories(spark, d), V.sample_tags(spark, d),
                                  V.sample_repos(spark, d), V.selection(spark, d)))
