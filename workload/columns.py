"""Scalar and text-match functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.functions import textmatch as T
from workload import views as V
from workload.registry import query


def r6(c):
    return F.round(c, 6)


@query("norm_name", """
    SELECT c_custkey, lower(trim('  ' || c_name || ' ')) AS norm FROM customer""")
def norm_name(spark, d):
    c = V.table(spark, d, "customer")
    return c.select("c_custkey", P.norm_name(F.concat(F.lit("  "), "c_name", F.lit(" "))).alias("norm"))


def _named(spark, d):
    c = V.table(spark, d, "customer")
    name = (F.when(F.col("c_mktsegment") == "BUILDING", F.concat(F.lit("library/"), "c_name"))
            .when(F.col("c_mktsegment") == "MACHINERY", F.concat(F.lit("own/"), "c_name"))
            .otherwise(F.col("c_name")))
    return c.select("c_custkey", name.alias("name"))


_NAMED_SQL = """
    SELECT c_custkey, CASE c_mktsegment WHEN 'BUILDING' THEN 'library/' || c_name
        WHEN 'MACHINERY' THEN 'own/' || c_name ELSE c_name END AS name FROM customer"""


@query("expand_aliases", f"""
    SELECT c_custkey, unnest(CASE WHEN starts_with(n, 'library/') THEN [n, substr(n, 9)]
        WHEN NOT contains(n, '/') THEN [n, 'library/' || n] ELSE [n] END) AS alias
    FROM (SELECT c_custkey, lower(trim(name)) AS n FROM ({_NAMED_SQL}))""")
def expand_aliases(spark, d):
    return _named(spark, d).select("c_custkey", F.explode(P.expand_aliases(F.col("name"))).alias("alias"))


@query("null_if_empty", """
    SELECT tag_id, nullif(trim(status), '') AS status FROM tags""")
def null_if_empty(spark, d):
    return V.tags(spark, d).select("tag_id", P.null_if_empty(F.trim("status")).alias("status"))


@query("blank_to_unknown", """
    SELECT tag_id, coalesce(nullif(trim(status), ''), 'unknown') AS status,
           coalesce(nullif(status, ''), 'unknown') AS status_untrimmed FROM tags""")
def blank_to_unknown(spark, d):
    s = F.col("status")
    return V.tags(spark, d).select("tag_id", P.blank_to_unknown(s).alias("status"),
                                   P.blank_to_unknown(s, trim=False).alias("status_untrimmed"))


@query("strip_nul", """
    SELECT c_custkey, c_name || c_mktsegment AS cleaned FROM customer""")
def strip_nul(spark, d):
    dirty = F.concat("c_name", F.lit("\x00"), "c_mktsegment", F.lit("\x00"))
    return V.table(spark, d, "customer").select("c_custkey", P.strip_nul(dirty).alias("cleaned"))


_TS_SHAPES = {
    "1-URGENT": "yyyy-MM-dd'T'HH:mm:ss'.123456789Z'", "2-HIGH": "yyyy-MM-dd'T'HH:mm:ss'+02:00'",
    "3-MEDIUM": "yyyy-MM-dd HH:mm:ss'Z'", "4-NOT SPECIFIED": "yyyy-MM-dd",
}


@query("parse_ts", """
    SELECT o_orderkey, strftime(CASE o_orderpriority
        WHEN '1-URGENT' THEN o_orderdate + INTERVAL 123456 MICROSECOND
        WHEN '2-HIGH' THEN o_orderdate - INTERVAL 2 HOUR
        WHEN '3-MEDIUM' THEN o_orderdate END, '%Y-%m-%d %H:%M:%S.%f') AS parsed
    FROM orders""")
def parse_ts(spark, d):
    o = V.table(spark, d, "orders")
    text = F
    for value, shape in _TS_SHAPES.items():
        text = text.when(F.col("o_orderpriority") == value, F.date_format("o_orderdate", shape))
    text = text.otherwise(F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return o.select("o_orderkey", F.date_format(P.parse_ts(text), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("parsed"))


@query("month_key", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month_key FROM orders")
def month_key(spark, d):
    return V.table(spark, d, "orders").select("o_orderkey", P.month_key(F.col("o_orderdate")).alias("month_key"))


@query("epoch_seconds", """
    SELECT event_id, CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS whole,
           round(epoch_us(ts) / 1000000.0, 6) AS fractional FROM events""")
def epoch_seconds(spark, d):
    ts = F.col("ts")
    return V.table(spark, d, "events").select(
        "event_id", P.epoch_seconds(ts).alias("whole"), r6(P.epoch_seconds(ts, whole=False)).alias("fractional"))


@query("valid_digest", """
    SELECT layer_id, CAST(regexp_matches(lower(trim(
        CASE WHEN file_count < 10 THEN substr(digest, 1, 60) WHEN file_count < 30 THEN ' ' || upper(digest)
             ELSE digest END)), '^sha256:[0-9a-f]{64}$') AS INTEGER) AS ok FROM layers""")
def valid_digest(spark, d):
    dg = F.col("digest")
    shown = (F.when(F.col("file_count") < 10, F.left(dg, F.lit(60)))
             .when(F.col("file_count") < 30, F.concat(F.lit(" "), F.upper(dg))).otherwise(dg))
    return V.layers(spark, d).select("layer_id", P.valid_digest(shown).cast("int").alias("ok"))


@query("platform_filter", """
    SELECT l_orderkey AS page, l_linenumber AS size FROM lineitem
    WHERE l_returnflag = 'A' AND l_linestatus = 'F'""")
def platform_filter(spark, d):
    arch = F.when(F.col("l_returnflag") == "A", F.lit("amd64")).otherwise(F.lit("arm64"))
    system = F.when(F.col("l_linestatus") == "F", F.lit("linux")).otherwise(F.lit("windows"))
    pages = V.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("page"),
        F.array(F.struct(arch.alias("architecture"), system.alias("os"), F.col("l_linenumber").alias("size")))
        .alias("images"))
    return P.platform_filter(pages, "images").select("page", "size")


@query("positive_size", """
    SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN CAST(floor(c_acctbal + 0.5) AS BIGINT) END AS real_size,
           CASE WHEN floor(c_acctbal) > 0 THEN CAST(floor(c_acctbal) AS BIGINT) END AS whole_size
    FROM customer""")
def positive_size(spark, d):
    c = V.table(spark, d, "customer")
    whole = F.floor("c_acctbal").cast("long").cast("string")
    return c.select("c_custkey", P.positive_size(F.col("c_acctbal").cast("string")).alias("real_size"),
                    P.positive_size(whole).alias("whole_size"))


_BUCKET_SQL = "CASE " + " ".join(
    f"WHEN {{c}} <= {b} THEN {i}" for i, b in enumerate(P.SIZE_BOUNDS)) + " END"


@query("log_bucket", f"""
    SELECT tag_id, {_BUCKET_SQL.format(c='size')} AS bucket FROM tags""")
def log_bucket(spark, d):
    return V.tags(spark, d).select("tag_id", P.log_bucket(F.col("size")).alias("bucket"))


@query("path_depth", """
    SELECT file, length(file) - length(replace(file, '/', '')) + 1 AS depth FROM files""")
def path_depth(spark, d):
    return V.files(spark, d).select("file", P.path_depth(F.col("file")).alias("depth"))


@query("file_ext", r"""
    SELECT url, regexp_extract(url, '([.][^./]*)$', 1) AS ext FROM pages""")
def file_ext(spark, d):
    return V.table(spark, d, "pages").select("url", P.file_ext(F.col("url")).alias("ext"))


@query("official_cat", """
    SELECT repo_id, CASE WHEN is_official THEN 'official' ELSE 'unofficial' END AS official,
           CASE WHEN is_automated THEN 'automated' ELSE 'manual' END AS automated FROM repositories""")
def official_cat(spark, d):
    return V.repositories(spark, d).select(
        "repo_id", P.official_cat(F.col("is_official")).alias("official"),
        P.official_cat(F.col("is_automated"), "automated", "manual").alias("automated"))


CATEGORY_SQL = "CASE " + " ".join(
    f"WHEN regexp_matches(lower({{c}}), '{'|'.join(words)}') THEN '{label}'"
    for label, words in P.ORIGIN_RULES) + " ELSE 'Other' END"


@query("origin_category", f"""
    SELECT secret_id, {CATEGORY_SQL.format(c='origin')} AS category FROM secrets""")
def origin_category(spark, d):
    return V.secrets(spark, d).select("secret_id", P.origin_category(F.col("origin")).alias("category"))


@query("combined_weight", """
    SELECT c_custkey, round(CASE WHEN w = 'inf'::DOUBLE OR w = '-inf'::DOUBLE OR isnan(w) THEN 1.0
        ELSE least(greatest(w, 0.0), 100.0) END, 6) + 0.0 AS weight
    FROM (SELECT c_custkey, c_acctbal / 1000.0 * c_nationkey *
            CASE WHEN c_nationkey = 3 THEN 'inf'::DOUBLE WHEN c_nationkey = 4 THEN 'nan'::DOUBLE ELSE 1.5 END AS w
          FROM customer)""")
def combined_weight(spark, d):
    nk = F.col("c_nationkey")
    odd = (F.when(nk == 3, F.lit(float("inf"))).when(nk == 4, F.lit(float("nan"))).otherwise(F.lit(1.5)))
    return V.table(spark, d, "customer").select("c_custkey", (r6(P.combined_weight(
        F.col("c_acctbal") / 1000.0, nk.cast("double"), odd)) + 0.0).alias("weight"))


@query("split_owner_name", f"""
    SELECT c_custkey, split_part(lower(name), '/', 1) AS owner, split_part(lower(name), '/', 2) AS name
    FROM ({_NAMED_SQL})""")
def split_owner_name(spark, d):
    on = P.split_owner_name(F.col("name"))
    return _named(spark, d).select("c_custkey", on["owner"].alias("owner"), on["name"].alias("name"))


@query("log1p_scale", """
    SELECT repo_id, round(ln(1 + star_count), 6) AS stars FROM repositories""")
def log1p_scale(spark, d):
    return V.repositories(spark, d).select("repo_id", r6(P.log1p_scale(F.col("star_count"))).alias("stars"))


@query("repo_digest_project", "SELECT repo_name AS repo, CAST(repo_id AS VARCHAR) AS digest FROM repositories")
def repo_digest_project(spark, d):
    rows = V.repositories(spark, d).withColumn("digest", F.col("repo_id").cast("string"))
    return P.repo_digest_project(rows)


@query("drop_sentinel", """
    SELECT event_id, event_type AS repo_name FROM events WHERE event_type <> 'signup'""")
def drop_sentinel(spark, d):
    name = F.when(F.col("event_type") == "signup", F.lit("#/#")).otherwise(F.col("event_type"))
    return P.drop_sentinel(V.table(spark, d, "events").select("event_id", name.alias("repo_name")))


@query("date_range_filter", """
    SELECT tag_id, strftime(last_pushed, '%Y-%m') AS month_key FROM tags
    WHERE last_pushed >= TIMESTAMP '1996-03-01' AND last_pushed < TIMESTAMP '2000-07-01'""")
def date_range_filter(spark, d):
    rows = V.tags(spark, d).select("tag_id", P.month_key(F.col("last_pushed")).alias("month_key"))
    return P.date_range_filter(rows, "month_key", "1996-03-01", "2000-07-01")


# --- text match -----------------------------------------------------------

_FIELDS = ("name", "owner", "descr")


def _each(template: str) -> str:
    return ", ".join(template.format(c=c) for c in _FIELDS)


_LEV = ("CASE WHEN contains({c}, q) THEN 1 - levenshtein(q, {c})::DOUBLE"
        " / greatest(length(q), length({c})) END")
_POS = ("CASE WHEN instr({c}, q) > 0 AND length({c}) > 0"
        " THEN 1 - (instr({c}, q) - 1)::DOUBLE / length({c}) ELSE 0.0 END")
_JAC = ("len(list_intersect(list_distinct(string_split(q, '')), list_distinct(string_split({c}, ''))))::DOUBLE"
        " / len(list_distinct(list_concat(string_split(q, ''), string_split({c}, ''))))")
_SHARE = "CASE WHEN contains({c}, q) THEN length(q)::DOUBLE / length({c}) END"
LEV_SQL = f"coalesce(greatest({_each(_LEV)}), 0.0)"
POS_SQL = f"greatest({_each(_POS)})"
JAC_SQL = f"greatest({_each(_JAC)})"
SHARE_SQL = f"coalesce(greatest({_each(_SHARE)}), 0.0)"
FIND_SQL = ("CASE WHEN contains(name, q) THEN 1 ELSE 0 END + CASE WHEN contains(owner, q) THEN 2 ELSE 0 END"
            " + CASE WHEN contains(descr, q) THEN 4 ELSE 0 END")
ALONE_SQL = "CASE WHEN q = name OR q = owner OR q = descr THEN 1 ELSE 0 END"


def _highlight(c: str) -> str:
    before = f"CASE WHEN instr({c}, q) > 1 THEN substr({c}, instr({c}, q) - 1, 1) ELSE '' END"
    after = f"substr({c}, instr({c}, q) + length(q), 1)"
    return (
        f"(instr({c}, q) > 0 AND CASE"
        f" WHEN regexp_full_match(q, '[0-9]*') THEN NOT regexp_matches({before}, '[0-9]')"
        f" AND NOT regexp_matches({after}, '[0-9]')"
        f" WHEN regexp_full_match(q, '[a-z]+') THEN NOT regexp_matches({before}, '[a-z]')"
        f" AND NOT regexp_matches({after}, '[a-z]') ELSE false END)")


NAME_CAT_SQL = (f"CASE WHEN q = name THEN 1.0 WHEN contains(name, '-' || q || '-')"
                f" OR contains(name, '_' || q || '_') THEN 0.75 WHEN {_highlight('name')} THEN 0.5"
                f" WHEN contains(name, q) THEN 0.25 ELSE 0.0 END")
OWNER_CAT_SQL = (f"CASE WHEN q = owner THEN 1.0 WHEN {_highlight('owner')} THEN 0.66"
                 f" WHEN contains(owner, q) THEN 0.33 ELSE 0.0 END")
_SPECIAL_LIST = [f"\\{c}" for c in T.SPECIALS]
_BOTH = " OR ".join(f"regexp_matches(descr, '{c}\\s*' || q || '\\s*{c}')" for c in _SPECIAL_LIST)
_ONE_SIDE = " OR ".join(f"regexp_matches(descr, '{c}\\s*' || q) OR regexp_matches(descr, q || '\\s*{c}')"
                        for c in _SPECIAL_LIST)
DESCR_CAT_SQL = (f"CASE WHEN q = descr THEN 1.0 WHEN contains(' ' || descr || ' ', ' ' || q || ' ') THEN 0.833"
                 f" WHEN {_BOTH} THEN 0.66 WHEN {_ONE_SIDE} THEN 0.5 WHEN {_highlight('descr')} THEN 0.333"
                 f" WHEN contains(descr, q) THEN 0.166 ELSE 0.0 END")


def _feature(name: str, expression: str, function, fields=_FIELDS):
    @query(name, f"SELECT seq, q, round({expression}, 6) AS value FROM match_fields")
    def run(spark, d):
        f = V.match_fields(spark, d)
        return f.select("seq", "q", r6(function(F.col("q"), *(F.col(c) for c in fields)).cast("double")).alias("value"))


_feature("levenshtein_sim", LEV_SQL, T.levenshtein_sim)
_feature("position_sim", POS_SQL, T.position_sim)
_feature("jaccard_chars", JAC_SQL, T.jaccard_chars)
_feature("text_share", SHARE_SQL, T.text_share)
_feature("query_find", f"({FIND_SQL})::DOUBLE", T.query_find)
_feature("is_standalone", f"({ALONE_SQL})::DOUBLE", T.is_standalone)
_feature("name_category", f"({NAME_CAT_SQL})::DOUBLE", T.name_category, ("name",))
_feature("owner_category", f"({OWNER_CAT_SQL})::DOUBLE", T.owner_category, ("owner",))
_feature("description_category", f"({DESCR_CAT_SQL})::DOUBLE", T.description_category, ("descr",))
_feature("is_highlighted", f"{_highlight('descr')}::INTEGER::DOUBLE", T.is_highlighted, ("descr",))
_feature("significant_category",
         f"greatest(({NAME_CAT_SQL})::DOUBLE, ({OWNER_CAT_SQL})::DOUBLE, ({DESCR_CAT_SQL})::DOUBLE)",
         T.significant_category)


@query("char_set_ops", """
    SELECT seq, q, len(list_intersect(list_distinct(string_split(q, '')),
                   list_distinct(string_split(name, '')))) AS common,
           len(list_distinct(list_concat(string_split(q, ''), string_split(name, '')))) AS either
    FROM match_fields""")
def char_set_ops(spark, d):
    sets = T.char_set_ops(F.col("q"), F.col("name"))
    return V.match_fields(spark, d).select("seq", "q", sets["common"].alias("common"), sets["either"].alias("either"))


@query("feature_row", f"""
    WITH m AS (SELECT r.*, f.q, f.name, f.owner, f.descr
               FROM match_rows r JOIN (SELECT DISTINCT * FROM match_fields) f
               ON r.seq = f.seq AND lower(r.query) = f.q)
    SELECT query, seq AS rank, name AS repo_name, owner AS repo_owner, descr AS short_description,
           round(ln(1 + star_count), 6) AS star_count, round(ln(1 + pull_count), 6) AS pull_count,
           is_official::INTEGER AS is_official, is_automated::INTEGER AS is_automated,
           round({LEV_SQL}, 6) AS significant_levenshtein, round({POS_SQL}, 6) AS significant_position,
           round(greatest(({NAME_CAT_SQL})::DOUBLE, ({OWNER_CAT_SQL})::DOUBLE, ({DESCR_CAT_SQL})::DOUBLE), 6)
               AS significant_category,
           round({JAC_SQL}, 6) AS significant_jaccard, {ALONE_SQL} AS is_standalone, {FIND_SQL} AS query_find
    FROM m""")
def feature_row(spark, d):
    rows = T.feature_rows(V.match_rows(spark, d), "query", "seq")
    reals = ("star_count", "pull_count", "significant_levenshtein", "significant_position",
             "significant_category", "significant_jaccard")
    return rows.select(*(r6(F.col(c)).alias(c) if c in reals else F.col(c) for c in rows.columns))


def prefix_rows(spark, d):
    """Search rows filed under every prefix of their query word; short prefixes
    miss the repositories with many stars."""
    rows = V.search_rows(spark, d)
    n = F.length("query")
    return rows.select(
        F.explode(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(F.col("query"), F.lit(1), i))).alias("prefix"),
        "repo_name", "short_description", "star_count").filter(
        F.length("prefix") >= F.least(F.lit(3), F.col("star_count") / 5 + 1)).select(
        F.col("prefix").alias("query"), "repo_name", "short_description")


@query("prefix_refine_label", f"""
    WITH p AS (SELECT substr(query, 1, i) AS query, repo_name, short_description FROM (
                 SELECT *, unnest(generate_series(1, length(query))) AS i FROM search_rows)
               WHERE i >= least(3, star_count / 5.0 + 1)),
    f AS (SELECT query, repo_name, lower(query) AS q, split_part(lower(repo_name), '/', 2) AS name,
                 split_part(lower(repo_name), '/', 1) AS owner, lower(short_description) AS descr FROM p),
    novel AS (SELECT DISTINCT c.parent FROM (
                SELECT substr(query, 1, length(query) - 1) AS parent, repo_name FROM p
                WHERE regexp_matches(right(query, 1), '[a-z0-9]')) c
              WHERE NOT EXISTS (SELECT 1 FROM p WHERE p.query = c.parent AND p.repo_name = c.repo_name))
    SELECT query, max(CASE WHEN query IN (SELECT parent FROM novel) THEN 1 ELSE 0 END) AS label,
           count(*) AS entries, round(avg({LEV_SQL}), 6) AS avg_levenshtein,
           round(avg({SHARE_SQL}), 6) AS avg_text_share
    FROM f GROUP BY query""")
def prefix_refine_label(spark, d):
    out = T.prefix_refine_label(prefix_rows(spark, d))
    return out.select("query", "label", "entries", r6(F.col("avg_levenshtein")).alias("avg_levenshtein"),
                      r6(F.col("avg_text_share")).alias("avg_text_share"))
