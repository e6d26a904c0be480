"""Joins and keyed merges."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators import aggregates as A
from regspark.operators import joins as J
from regspark.operators import merge as U
from regspark.operators import sampling as M
from regspark.operators import stats as B
from regspark.plans import importer as I
from workload import views as V
from workload.registry import query


def r6(c):
    return F.round(c, 6)


@query("selection_join", """
    SELECT l.seq, l.digest, l.file_count, s.size AS compressed_size
    FROM layer_lines l JOIN selection s ON l.digest = s.digest""")
def selection_join(spark, d):
    lines = V.layer_lines(spark, d).select("seq", "digest", "file_count")
    return J.selection_join(lines, V.selection(spark, d))


@query("alias_semi", """
    WITH w AS (SELECT DISTINCT lower(c_name) AS a FROM customer WHERE c_mktsegment = 'BUILDING')
    SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'library/' ELSE '' END
           || 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS name
    FROM orders WHERE 'customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') IN (SELECT a FROM w)""")
def alias_semi(spark, d):
    listed = V.table(spark, d, "customer").filter(F.col("c_mktsegment") == "BUILDING").select("c_name")
    name = F.concat(F.when(F.col("o_orderstatus") == "F", F.lit("library/")).otherwise(F.lit("")),
                    V.customer_name(F.col("o_custkey")))
    rows = V.table(spark, d, "orders").select("o_orderkey", name.alias("name"))
    return J.alias_semi(rows, "name", listed, "c_name", "o_orderkey")


@query("alias_lookup", """
    SELECT s.digest, trim(x.name) AS name, r.repo_id AS resolved_id FROM selection s,
           (SELECT seq, unnest(repos) AS name FROM selection) x
    LEFT JOIN repositories r ON lower(r.repo_name) = replace(lower(trim(x.name)), 'library/', '')
    WHERE s.seq = x.seq""")
def alias_lookup(spark, d):
    names = V.selection(spark, d).select("digest", F.explode("repos").alias("name"))
    names = names.withColumn("name", F.trim("name"))
    return J.alias_lookup(names, "name", V.repositories(spark, d), "repo_name", "repo_id", "digest")


@query("ensure_missing", """
    SELECT repo_id, repo_name, pull_count FROM repositories
    UNION ALL SELECT NULL, name, NULL FROM (
        SELECT DISTINCT 'Customer#' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS name FROM lineitem)
    WHERE name NOT IN (SELECT repo_name FROM repositories)""")
def ensure_missing(spark, d):
    target = V.repositories(spark, d).select("repo_id", "repo_name", "pull_count")
    wanted = V.table(spark, d, "lineitem").select(V.customer_name(F.col("l_partkey")).alias("repo_name"))
    return J.ensure_missing(target, wanted, "repo_name")


@query("seen_anti", """
    SELECT layer_id, file_count FROM layers WHERE layer_id NOT IN (SELECT layer_id FROM repo_layers)""")
def seen_anti(spark, d):
    return J.seen_anti(V.layers(spark, d).select("layer_id", "file_count"), V.repo_layers(spark, d), "layer_id")


_LINK_SQL = """
    SELECT DISTINCT s.digest, trim(x.name) AS repo, r.repo_id, l.layer_id
    FROM selection s JOIN (SELECT seq, unnest(repos) AS name FROM selection) x ON s.seq = x.seq
    LEFT JOIN order_layers l ON l.digest = s.digest
    LEFT JOIN repositories r ON lower(r.repo_name) = replace(lower(trim(x.name)), 'library/', '')
    WHERE trim(x.name) <> ''"""


@query("link_pairs", f"""
    WITH p AS ({_LINK_SQL})
    SELECT DISTINCT repo_id, layer_id FROM p WHERE repo_id IS NOT NULL AND layer_id IS NOT NULL""")
def link_pairs(spark, d):
    return J.link_pairs(V.selection(spark, d), V.repositories(spark, d), V.order_layers(spark, d))[0]


@query("link_pairs_unresolved", f"""
    WITH p AS ({_LINK_SQL})
    SELECT digest, repo FROM p WHERE repo_id IS NULL OR layer_id IS NULL""")
def link_pairs_unresolved(spark, d):
    return J.link_pairs(V.selection(spark, d), V.repositories(spark, d), V.order_layers(spark, d))[1]


@query("fragment_layers", """
    SELECT DISTINCT fragment AS fragment_hash, digest AS layer_id FROM layer_lines WHERE fragment IS NOT NULL""")
def fragment_layers(spark, d):
    lines = V.layer_lines(spark, d).withColumn("layer_id", F.col("digest"))
    return J.fragment_layers(lines, V.selection(spark, d))


@query("secret_occurrences", """
    SELECT DISTINCT l.digest AS layer_id, s.fragment_hash, s.file, s.start_line
    FROM layer_lines l JOIN secret_lines s ON l.fragment = s.fragment_hash""")
def secret_occurrences(spark, d):
    lines = V.layer_lines(spark, d).withColumn("layer_id", F.col("digest"))
    flat = V.secret_lines(spark, d).select("fragment_hash", "secrets.file", "secrets.start_line")
    return J.secret_occurrences(flat, J.fragment_layers(lines)).select(
        "layer_id", "fragment_hash", "file", "start_line")


@query("has_secret_exists", """
    SELECT r.repo_id, (r.repo_id IN (SELECT repo_id FROM leaky))::INTEGER AS has_secret FROM repositories r""")
def has_secret_exists(spark, d):
    repos = V.repositories(spark, d).select("repo_id")
    out = J.has_secret(repos, V.repo_layers(spark, d), V.occurrences(spark, d))
    return out.select("repo_id", F.col("has_secret").cast("int").alias("has_secret"))


@query("random_tag_lateral", """
    SELECT r.repo_id, strftime(p.last_pushed, '%Y-%m-%d') AS last_pushed, p.status
    FROM repositories r LEFT JOIN picked p ON r.repo_id = p.repo_id""")
def random_tag_lateral(spark, d):
    out = J.one_random_tag(V.repositories(spark, d).select("repo_id"), V.tags(spark, d))
    return out.select("repo_id", F.date_format("last_pushed", "yyyy-MM-dd").alias("last_pushed"), "status")


BINS_SQL = """
    SELECT b.lo AS bin_left, b.hi AS bin_right, b.lo = max(b.lo) OVER () AS is_last
    FROM (SELECT e AS lo, lead(e) OVER (ORDER BY e) AS hi FROM (
        SELECT DISTINCT unnest(quantile_cont({c}, [{probs}])) AS e FROM {full})) b WHERE b.hi IS NOT NULL"""
PROBS = ", ".join(repr(i / 20) for i in range(21))


def bias_bins_sql(c: str, full: str, sample: str) -> str:
    inside = "{t}.v >= b.bin_left AND ({t}.v < b.bin_right OR (b.is_last AND {t}.v <= b.bin_right))"
    def hist(t: str, source: str) -> str:
        return (f"(SELECT b.bin_left, count(*) AS n FROM (SELECT {c}::DOUBLE AS v FROM {source}"
                f" WHERE {c} IS NOT NULL) {t} JOIN bins b ON {inside.format(t=t)} GROUP BY 1)")
    return f"""
        WITH bins AS ({BINS_SQL.format(c=c + '::DOUBLE', probs=PROBS, full=full)}),
        counted AS (SELECT b.bin_left, b.bin_right, b.is_last, coalesce(f.n, 0) AS count_full,
                           coalesce(s.n, 0) AS count_sample
                    FROM bins b LEFT JOIN {hist('x', full)} f ON f.bin_left = b.bin_left
                    LEFT JOIN {hist('y', sample)} s ON s.bin_left = b.bin_left),
        shares AS (SELECT *, count_full::DOUBLE / sum(count_full) OVER () AS p_full,
                          count_sample::DOUBLE / sum(count_sample) OVER () AS p_sample FROM counted),
        bias_bins AS (SELECT *, CASE WHEN p_sample > 0 THEN p_full / p_sample
                             WHEN p_full > 0 THEN 'inf'::DOUBLE ELSE 1.0 END AS bias FROM shares)"""


@query("bin_range_join", bias_bins_sql("pull_count", "repositories", "sample_repos") + """
    SELECT t.tag_id, round(coalesce(CASE WHEN b.bias > 0 AND b.bias < 'inf'::DOUBLE THEN b.bias END, 1.0), 6)
           AS weight
    FROM (SELECT tag_id, size / 50 AS v FROM tags) t LEFT JOIN bias_bins b
      ON t.v >= b.bin_left AND (t.v < b.bin_right OR (b.is_last AND t.v <= b.bin_right))""")
def bin_range_join(spark, d):
    bins = B.bias_bins(V.repositories(spark, d), V.sample_repos(spark, d), "pull_count")
    rows = V.tags(spark, d).select("tag_id", (F.col("size") / 50).alias("v"))
    return J.bin_weight(rows, "v", bins).select("tag_id", r6(F.col("weight")).alias("weight"))


def biases(spark, d) -> dict:
    """Category weights of the order tags against the line-item tags."""
    tags, sample = V.tags(spark, d), V.sample_tags(spark, d)
    pairs = {
        "month": (A.month_histogram(tags, "last_pushed"), A.month_histogram(sample, "last_pushed")),
        "status": (A.value_histogram(tags, "status"), A.value_histogram(sample, "status")),
        "is_official": (A.official_histogram(V.repositories(spark, d)),
                        A.official_histogram(V.sample_repos(spark, d))),
    }
    return {name: B.bias_table(*hists).select("key", "bias_full_over_sample") for name, hists in pairs.items()}


@query("map_weight", """
    SELECT t.tag_id, round(coalesce(b.bias, 1.0), 6) AS weight
    FROM tags t LEFT JOIN bias_month b ON b.key = strftime(t.last_pushed, '%Y-%m')""")
def map_weight(spark, d):
    rows = V.tags(spark, d).select("tag_id", P.month_key(F.col("last_pushed")).alias("month_key"))
    out = J.map_weight(rows, "month_key", biases(spark, d)["month"])
    return out.select("tag_id", r6(F.col("weight")).alias("weight"))


def study(spark, d):
    return B.repo_study_frame(V.repositories(spark, d), V.tags(spark, d), V.repo_layers(spark, d),
                              V.occurrences(spark, d), biases(spark, d), V.SEED)


MONTHS_SQL = """
    SELECT month_key, count(DISTINCT repo_id) AS total_repos, round(sum(weight), 6) AS total_repos_weighted,
           count(DISTINCT CASE WHEN has_secret THEN repo_id END) AS repos_with_secret,
           round(sum(CASE WHEN has_secret THEN weight ELSE 0.0 END), 6) AS repos_with_secret_weighted
    FROM study GROUP BY month_key"""


def months_rounded(df):
    return df.select("month_key", "total_repos", r6(F.col("total_repos_weighted")).alias("total_repos_weighted"),
                     "repos_with_secret",
                     r6(F.col("repos_with_secret_weighted")).alias("repos_with_secret_weighted"))


@query("month_merge", MONTHS_SQL)
def month_merge(spark, d):
    return months_rounded(J.month_merge(study(spark, d)))


@query("three_way", """
    SELECT o.layer_id, o.secret_id, o.file, o.start_line, s.fragment_hash, l.file_count
    FROM occurrences o JOIN secrets s ON o.secret_id = s.secret_id JOIN layers l ON o.layer_id = l.layer_id""")
def three_way(spark, d):
    out = J.secret_layer_join(V.secrets(spark, d), V.occurrences(spark, d), V.layers(spark, d))
    return out.select("layer_id", "secret_id", "file", "start_line", "fragment_hash", "file_count")


@query("key_union_join", """
    SELECT key, CAST(count_full AS BIGINT) AS count_full, CAST(count_sample AS BIGINT) AS count_sample
    FROM bias_month""")
def key_union_join(spark, d):
    return J.key_union(A.month_histogram(V.tags(spark, d), "last_pushed"),
                       A.month_histogram(V.sample_tags(spark, d), "last_pushed"))


UNIQ_SQL = """
    SELECT layer_id, CASE WHEN count(DISTINCT repo_id) = 1 THEN 1 ELSE 0 END AS is_unique
    FROM repo_layers GROUP BY layer_id"""
PAIRS_SQL = """
    SELECT DISTINCT s.fragment_hash, o.layer_id FROM occurrences o JOIN secrets s ON o.secret_id = s.secret_id"""
COUNTS_SQL = """
    SELECT s.fragment_hash, count(DISTINCT rl.repo_id) AS repo_count, count(DISTINCT o.layer_id) AS layer_count
    FROM secrets s JOIN occurrences o ON o.secret_id = s.secret_id
    JOIN repo_layers rl ON rl.layer_id = o.layer_id GROUP BY s.fragment_hash"""


def fragment_pairs(spark, d):
    return V.occurrences(spark, d).join(V.secrets(spark, d), "secret_id").select(
        "fragment_hash", "layer_id").distinct()


def weights(spark, d):
    return B.unique_bias_weights(A.unique_layer_share(V.selection(spark, d)))


WEIGHTS_SQL = """
    SELECT CASE WHEN s > 0 AND s < 1 THEN 0.2820 / s ELSE 1.0 END AS w_unique,
           CASE WHEN s > 0 AND s < 1 THEN (1 - 0.2820) / (1 - s) ELSE 1.0 END AS w_nonunique,
           0.2820::DOUBLE AS f_unique, CASE WHEN s > 0 AND s < 1 THEN s END AS s_unique
    FROM (SELECT count(*) FILTER (WHERE coalesce(repo_count, len(repos)) = 1)::DOUBLE / count(*) AS s
          FROM selection)"""


@query("frag_weight_merge", f"""
    WITH w AS ({WEIGHTS_SQL}), u AS ({UNIQ_SQL}), p AS ({PAIRS_SQL}), c AS ({COUNTS_SQL})
    SELECT c.fragment_hash, c.repo_count, c.layer_count, round(x.s, 6) AS weighted_layer_count
    FROM c JOIN (SELECT p.fragment_hash, sum(CASE WHEN u.is_unique = 1 THEN w.w_unique ELSE w.w_nonunique END) AS s
                 FROM w, p LEFT JOIN u ON p.layer_id = u.layer_id GROUP BY p.fragment_hash) x
      ON c.fragment_hash = x.fragment_hash""")
def frag_weight_merge(spark, d):
    rl = V.repo_layers(spark, d)
    counts = A.secret_repo_layer_counts(V.secrets(spark, d), V.occurrences(spark, d), rl)
    out = J.frag_weight_merge(counts, fragment_pairs(spark, d), A.layer_uniqueness(rl), weights(spark, d))
    return out.withColumn("weighted_layer_count", r6(F.col("weighted_layer_count")))


# --- keyed merges ---------------------------------------------------------


@query("upsert_replace", """
    SELECT r.repo_id, coalesce(n.pull_count, r.pull_count) AS pull_count,
           CASE WHEN n.repo_id IS NULL THEN r.repo_owner ELSE n.repo_owner END AS repo_owner
    FROM repositories r LEFT JOIN (
        SELECT o_custkey AS repo_id, CAST(floor(max_by(o_totalprice, o_orderkey)) AS BIGINT) AS pull_count,
               max_by(o_orderpriority, o_orderkey) AS repo_owner
        FROM orders GROUP BY o_custkey) n ON r.repo_id = n.repo_id""")
def upsert_replace(spark, d):
    old = V.repositories(spark, d).select("repo_id", "pull_count", "repo_owner")
    new = V.table(spark, d, "orders").select(
        F.col("o_custkey").alias("repo_id"), F.floor("o_totalprice").cast("long").alias("pull_count"),
        F.col("o_orderpriority").alias("repo_owner"), F.col("o_orderkey").alias("seq"))
    return U.upsert_replace(old, new, "repo_id", "seq")


UPSERT_COALESCE_SQL = """
    SELECT digest, max_by(file_count, seq) FILTER (WHERE file_count IS NOT NULL) AS file_count,
           max_by(max_depth, seq) FILTER (WHERE max_depth IS NOT NULL) AS max_depth,
           max_by(uncompressed_size, seq) FILTER (WHERE uncompressed_size IS NOT NULL) AS uncompressed_size
    FROM (SELECT seq, digest, file_count, max_depth, uncompressed_size FROM layer_lines
          UNION ALL SELECT '', digest, -1, -1, size FROM selection) GROUP BY digest"""


@query("upsert_coalesce", UPSERT_COALESCE_SQL)
def upsert_coalesce(spark, d):
    old = V.selection(spark, d).select("digest", F.lit(-1).alias("file_count"), F.lit(-1).alias("max_depth"),
                                       F.col("size").alias("uncompressed_size"))
    new = V.layer_lines(spark, d).select("seq", "digest", "file_count", "max_depth", "uncompressed_size")
    return U.upsert_coalesce(old, new, "digest", "seq")


@query("insert_ignore", """
    SELECT repo_id, layer_id FROM repo_layers UNION
    SELECT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey""")
def insert_ignore(spark, d):
    new = V.table(spark, d, "lineitem").join(
        V.table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(
        F.col("o_custkey").alias("repo_id"), F.col("l_partkey").alias("layer_id"))
    return U.insert_ignore(V.repo_layers(spark, d), new, ["repo_id", "layer_id"])


@query("upsert_secret", """
    SELECT fragment_hash, max_by(origin, seq) AS origin, max_by(secret, seq) AS secret FROM (
        SELECT '' AS seq, fragment_hash, origin, secret FROM secrets
        UNION ALL SELECT seq, fragment, 'f' || CAST(file_count AS VARCHAR), 's' || CAST(l_partkey AS VARCHAR)
        FROM layer_lines WHERE fragment IS NOT NULL) GROUP BY fragment_hash""")
def upsert_secret(spark, d):
    old = V.secrets(spark, d).select("fragment_hash", "origin", "secret")
    new = V.layer_lines(spark, d).filter(F.col("secrets").isNotNull()).select(
        "seq", F.col("secrets")[0].alias("fragment_hash"),
        F.concat(F.lit("f"), F.col("file_count").cast("string")).alias("origin"),
        F.concat(F.lit("s"), F.col("l_partkey").cast("string")).alias("secret"))
    return U.upsert_secret(old, new)


@query("surrogate_ids", """
    SELECT digest, row_number() OVER (ORDER BY md5(digest), digest) AS id
    FROM (SELECT DISTINCT digest FROM layer_lines)""")
def surrogate_ids(spark, d):
    return U.surrogate_ids(V.layer_lines(spark, d), "digest")


def _import(spark, d):
    repos = V.repositories(spark, d).select(
        "repo_name", "repo_owner", F.lit("").alias("short_description"), "is_automated", "is_official",
        "pull_count", "star_count", F.col("repo_id").alias("seq"))
    return (V.selection(spark, d), repos, V.tag_lines(spark, d), V.layer_lines(spark, d).select(
        "seq", "digest", "file_count", "max_depth", "uncompressed_size", "secrets"), V.secret_lines(spark, d))


_NAMES_SQL = "SELECT DISTINCT trim(n) AS repo FROM (SELECT unnest(repos) AS n FROM selection) WHERE trim(n) <> ''"


def _long_form(tables: dict):
    shapes = {
        "repositories": ("repo_name", "pull_count"), "layers": ("digest", "compressed_size"),
        "repo_layers": ("repo_name", "digest"), "tags": ("digest", "status"),
        "secrets": ("fragment_hash", "secret"), "occurrences": ("digest", "file"),
        "unresolved": ("digest", "repo"),
    }
    return A.union_all(*(
        tables[t].select(F.lit(t).alias("entity"), F.col(a).cast("string").alias("a"),
                         F.col(b).cast("string").alias("b"))
        for t, (a, b) in shapes.items() if t in tables))


_SECRET_ROWS_SQL = """
    SELECT DISTINCT 'secrets' AS entity, s.fragment_hash AS a, s.secret AS b
    FROM secret_lines s JOIN last_layers l ON l.fragment = s.fragment_hash
    UNION ALL SELECT DISTINCT 'occurrences', l.digest, s.file
    FROM secret_lines s JOIN last_layers l ON l.fragment = s.fragment_hash"""
_LAST_LAYERS_SQL = """
    SELECT digest, max_by(fragment, seq) AS fragment FROM layer_lines WHERE fragment IS NOT NULL GROUP BY digest"""


@query("import_all", f"""
    WITH names AS ({_NAMES_SQL}), last_layers AS ({_LAST_LAYERS_SQL}),
    absent AS (SELECT repo FROM names WHERE replace(lower(repo), 'library/', '') NOT IN
                   (SELECT lower(repo_name) FROM repositories)),
    allrepos AS (SELECT repo_name, pull_count FROM repositories
                  WHERE lower(repo_name) IN (SELECT replace(lower(repo), 'library/', '') FROM names)
                 UNION ALL SELECT repo, NULL FROM absent)
    SELECT 'repositories' AS entity, repo_name AS a, CAST(pull_count AS VARCHAR) AS b FROM allrepos
    UNION ALL SELECT 'layers', digest, CAST(size AS VARCHAR) FROM selection
    UNION ALL SELECT DISTINCT 'repo_layers', r.repo_name, s.digest
        FROM (SELECT digest, trim(unnest(repos)) AS n FROM selection) s
        JOIN allrepos r ON replace(lower(r.repo_name), 'library/', '') = replace(lower(s.n), 'library/', '')
        WHERE s.n <> ''
    UNION ALL SELECT 'tags', digest, CASE WHEN o_orderstatus <> 'P' THEN o_orderstatus END
        FROM orders JOIN order_layers ON o_orderkey = layer_id
        WHERE o_orderpriority <> '1-URGENT'
    UNION ALL {_SECRET_ROWS_SQL}""")
def import_all(spark, d):
    return _long_form(I.import_all(*_import(spark, d)))


@query("import_secrets_only", f"""
    WITH last_layers AS ({_LAST_LAYERS_SQL}) {_SECRET_ROWS_SQL}""")
def import_secrets_only(spark, d):
    selection, _, _, lines, records = _import(spark, d)
    return _long_form(I.import_secrets_only(selection, lines, V.order_layers(spark, d), records))


@query("one_per_group", """
    SELECT l_orderkey, l_partkey FROM (
        SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey
               ORDER BY md5(concat_ws('|', '42', CAST(l_partkey AS VARCHAR))), l_partkey) AS rn
        FROM lineitem) WHERE rn = 1""")
def one_per_group(spark, d):
    rows = V.table(spark, d, "lineitem").select("l_orderkey", "l_partkey")
    return M.one_per_group(rows, "l_orderkey", "l_partkey", V.SEED)
