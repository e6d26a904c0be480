"""Registry entities as views over the driver tables, for Spark and for SQL.

Each entity is written once as a DataFrame and once as an SQL common table
expression; ``sql`` puts the expressions a statement names in front of it.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEED = "42"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _long(c) -> F.Column:
    return F.floor(c).cast("long")


def repositories(spark, d) -> DataFrame:
    return table(spark, d, "customer").select(
        F.col("c_custkey").alias("repo_id"), F.col("c_name").alias("repo_name"),
        F.col("c_mktsegment").alias("repo_owner"),
        _long(F.col("c_acctbal")).alias("pull_count"), _long(F.abs("c_acctbal")).alias("star_count"),
        (F.col("c_mktsegment") == "BUILDING").alias("is_official"),
        (F.col("c_mktsegment") == "MACHINERY").alias("is_automated"))


def tags(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("tag_id"), F.col("o_custkey").alias("repo_id"),
        F.col("o_orderdate").alias("last_pushed"),
        F.when(F.col("o_orderstatus") == "P", F.lit(" ")).otherwise(F.col("o_orderstatus")).alias("status"),
        _long(F.col("o_totalprice")).alias("size"))


def layers(spark, d) -> DataFrame:
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("layer_id"),
        F.concat(F.lit("sha256:"), F.md5(F.col("p_partkey").cast("string")), F.md5("p_name")).alias("digest"),
        F.col("p_size").cast("long").alias("compressed_size"), F.col("p_size").alias("file_count"),
        (F.col("p_size") % 7 + 1).alias("max_depth"),
        _long(F.col("p_retailprice")).alias("uncompressed_size"))


def repo_layers(spark, d) -> DataFrame:
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_shipdate")
    orders = table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    soon = (F.col("l_shipdate") >= F.col("o_orderdate")) & (
        F.col("l_shipdate") < F.col("o_orderdate") + F.expr("interval 60 days"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).filter(soon).select(
        F.col("o_custkey").alias("repo_id"), F.col("l_partkey").alias("layer_id")).distinct()


def secrets(spark, d) -> DataFrame:
    nation = table(spark, d, "nation")
    n = F.col("n_nationkey")
    origin = (
        F.when(n % 5 == 0, F.concat(F.lit("github-token-"), n.cast("string")))
        .when(n % 5 == 1, F.concat(F.lit("private-key-"), n.cast("string")))
        .when(n % 5 == 2, F.concat(F.lit("aws-access-"), n.cast("string")))
        .when(n % 5 == 3, F.lit(" ")).otherwise(F.col("n_name"))
    )
    return table(spark, d, "supplier").join(nation, F.col("s_nationkey") == n).select(
        F.col("s_suppkey").alias("secret_id"), F.left(F.md5("s_name"), F.lit(16)).alias("fragment_hash"),
        origin.alias("origin"), F.col("s_name").alias("secret"))


def occurrences(spark, d) -> DataFrame:
    status = F.lower("l_linestatus")
    return table(spark, d, "lineitem").filter(F.col("l_returnflag") == "R").select(
        F.col("l_partkey").alias("layer_id"), F.col("l_suppkey").alias("secret_id"),
        F.concat(F.lit("etc/f"), F.col("l_linenumber").cast("string"), F.lit("."), status).alias("file"),
        F.when(F.col("l_linestatus") == "O", F.lit(" ")).otherwise(F.concat(F.lit("."), status)).alias("file_type"),
        F.when(F.col("l_linenumber") < 7, _long(F.col("l_extendedprice"))).alias("file_size"),
        F.col("l_linenumber").alias("start_line"))


def sample_tags(spark, d) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_shipdate").alias("last_pushed"), F.col("l_linestatus").alias("status"),
        _long(F.col("l_extendedprice")).alias("size"))


def sample_repos(spark, d) -> DataFrame:
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("repo_id"), _long(F.col("s_acctbal")).alias("pull_count"),
        (F.col("s_nationkey") < 5).alias("is_official"))


def search_rows(spark, d) -> DataFrame:
    words = F.split("p_name", " ")
    return table(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), words[0].alias("query"),
        F.concat(F.lower(F.replace(F.col("p_brand"), F.lit("#"), F.lit("-"))), F.lit("/"),
                 F.replace(F.col("p_name"), F.lit(" "), F.lit("-")), F.lit("-"),
                 F.col("p_partkey").cast("string")).alias("repo_name"),
        F.concat(F.col("p_type"), F.lit(": "), F.col("p_name"), F.lit(" #"), words[1], F.lit(" # v"),
                 F.col("p_size").cast("string")).alias("short_description"),
        F.col("p_size").alias("star_count"), _long(F.col("p_retailprice")).alias("pull_count"),
        (F.col("p_brand") == "Brand#2").alias("is_official"), (F.col("p_size") % 2 == 0).alias("is_automated"))


def match_rows(spark, d) -> DataFrame:
    """Search rows under four queries each: both words, a prefix, a number."""
    parts = table(spark, d, "part").select(
        F.col("p_partkey").alias("seq"), F.split("p_name", " ").alias("w"), "p_size")
    queries = parts.select("seq", F.explode(F.array(
        F.col("w")[0], F.col("w")[1], F.left(F.col("w")[0], F.lit(3)),
        F.col("p_size").cast("string"))).alias("query"))
    return queries.join(search_rows(spark, d).drop("query"), "seq")


def match_fields(spark, d) -> DataFrame:
    """Match rows with the lower-cased fields the features compare."""
    from regspark.functions.scalars import split_owner_name

    rows = match_rows(spark, d)
    on = split_owner_name(F.col("repo_name"))
    return rows.select("seq", F.lower("query").alias("q"), on["name"].alias("name"),
                       on["owner"].alias("owner"), F.lower("short_description").alias("descr"))


def ranking(spark, d) -> DataFrame:
    """Scored rows per brand; scores tie on purpose."""
    from regspark.operators.windows import rank_in_query, rank_label

    rows = table(spark, d, "part").select(
        F.col("p_brand").alias("query"), "p_partkey",
        (_long(F.col("p_retailprice")) % 97).cast("double").alias("score"),
        F.col("p_size").alias("f1"), F.col("p_type").alias("f2"))
    return rank_label(rank_in_query(rows, ["query"], F.col("p_partkey")), "query")


def files(spark, d) -> DataFrame:
    return table(spark, d, "documents").select(
        F.col("source").alias("layer"),
        F.concat(F.lit("srv/"), F.col("lang"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("file"),
        "text")


def _digest(key) -> F.Column:
    h = F.md5(key.cast("string"))
    return F.concat(F.lit("sha256:"), h, h)


def customer_name(key) -> F.Column:
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


def selection(spark, d) -> DataFrame:
    """Orders as selected layers: a padded name, an alias of a neighbour that
    may not exist, and a blank."""
    k = F.col("o_custkey")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), _digest(F.col("o_orderkey")).alias("digest"),
        _long(F.col("o_totalprice")).alias("size"),
        F.array(F.concat(F.lit(" "), customer_name(k)),
                F.concat(F.lit("library/"), F.lower(customer_name(k + 1))), F.lit(" ")).alias("repos"),
        F.when(F.col("o_orderpriority") != "5-LOW",
               F.when(F.col("o_orderstatus") == "F", F.lit(1)).otherwise(F.lit(2))).alias("repo_count"))


def order_layers(spark, d) -> DataFrame:
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("layer_id"), _digest(F.col("o_orderkey")).alias("digest"))


def layer_lines(spark, d) -> DataFrame:
    """Line items as repeated facts about layers, with nulls and fragments."""
    seq = F.md5(F.concat_ws("|", *(F.col(c).cast("string") for c in (
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")),
        F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
        F.col("l_quantity").cast("long").cast("string"), F.col("l_returnflag"), F.col("l_linestatus")))
    return table(spark, d, "lineitem").select(
        seq.alias("seq"), _digest(F.col("l_orderkey")).alias("digest"),
        F.col("l_linenumber").alias("file_count"),
        F.when(F.col("l_linestatus") == "F", F.col("l_quantity").cast("int")).alias("max_depth"),
        F.when(F.col("l_returnflag") != "A", _long(F.col("l_extendedprice"))).alias("uncompressed_size"),
        F.when(F.col("l_returnflag") == "R", F.array(_fragment(F.col("l_suppkey")), _fragment(F.col("l_suppkey"))))
        .alias("secrets"),
        F.col("l_suppkey"), F.col("l_partkey"))


def _fragment(key) -> F.Column:
    return F.left(F.md5(F.concat(F.lit("Supplier#"), F.lpad(key.cast("string"), 9, "0"))), F.lit(16))


def secret_lines(spark, d) -> DataFrame:
    """Suppliers as secret records; some hashes padded, texts with NUL."""
    pad = F.when(F.col("s_nationkey") < 5, F.lit(" ")).otherwise(F.lit(""))
    return table(spark, d, "supplier").select(
        F.col("s_suppkey").alias("seq"),
        F.concat(pad, _fragment(F.col("s_suppkey")), pad).alias("fragment_hash"),
        F.struct(F.concat(F.lit("etc/"), F.col("s_nationkey").cast("string"), F.lit(".env")).alias("file"),
                 F.lit(".env").alias("file_type"), _long(F.col("s_acctbal")).alias("file_size"),
                 F.concat(F.lit("rule-"), F.col("s_nationkey").cast("string")).alias("origin"),
                 F.concat("s_name", F.lit("\x00")).alias("secret"),
                 (F.col("s_nationkey") + 1).alias("start_line")).alias("secrets"))


def tag_lines(spark, d) -> DataFrame:
    """Orders as tag lines: digests in mixed case, some cut short."""
    dg = _digest(F.col("o_orderkey"))
    shown = (F.when(F.col("o_orderpriority") == "1-URGENT", F.left(dg, F.lit(40)))
             .when(F.col("o_orderpriority") == "2-HIGH", F.concat(F.lit(" "), F.upper(dg))).otherwise(dg))
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("seq"), F.lower(customer_name(F.col("o_custkey"))).alias("repo_name"),
        shown.alias("digest"), F.lit("amd64").alias("architecture"), F.lit("").alias("os"),
        _long(F.col("o_totalprice")).alias("size"),
        F.when(F.col("o_orderstatus") == "P", F.lit("")).otherwise(F.col("o_orderstatus")).alias("status"),
        F.lit("").alias("last_pulled"),
        F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("last_pushed"))


SQL: dict[str, str] = {
    "selection": """
        SELECT o_orderkey AS seq,
               'sha256:' || md5(CAST(o_orderkey AS VARCHAR)) || md5(CAST(o_orderkey AS VARCHAR)) AS digest,
               CAST(floor(o_totalprice) AS BIGINT) AS size,
               [' Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0'),
                'library/customer#' || lpad(CAST(o_custkey + 1 AS VARCHAR), 9, '0'), ' '] AS repos,
               CASE WHEN o_orderpriority <> '5-LOW' THEN
                    CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 2 END END AS repo_count
        FROM orders""",
    "order_layers": """
        SELECT o_orderkey AS layer_id,
               'sha256:' || md5(CAST(o_orderkey AS VARCHAR)) || md5(CAST(o_orderkey AS VARCHAR)) AS digest
        FROM orders""",
    "layer_lines": """
        SELECT md5(concat_ws('|', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR),
                   CAST(l_suppkey AS VARCHAR), CAST(l_linenumber AS VARCHAR),
                   CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS VARCHAR),
                   CAST(CAST(l_quantity AS BIGINT) AS VARCHAR), l_returnflag, l_linestatus)) AS seq,
               'sha256:' || md5(CAST(l_orderkey AS VARCHAR)) || md5(CAST(l_orderkey AS VARCHAR)) AS digest,
               l_linenumber AS file_count,
               CASE WHEN l_linestatus = 'F' THEN CAST(l_quantity AS INTEGER) END AS max_depth,
               CASE WHEN l_returnflag <> 'A' THEN CAST(floor(l_extendedprice) AS BIGINT) END AS uncompressed_size,
               CASE WHEN l_returnflag = 'R' THEN
                    substr(md5('Supplier#' || lpad(CAST(l_suppkey AS VARCHAR), 9, '0')), 1, 16) END AS fragment,
               l_suppkey, l_partkey
        FROM lineitem""",
    "secret_lines": """
        SELECT s_suppkey AS seq,
               substr(md5('Supplier#' || lpad(CAST(s_suppkey AS VARCHAR), 9, '0')), 1, 16) AS fragment_hash,
               'etc/' || CAST(s_nationkey AS VARCHAR) || '.env' AS file, '.env' AS file_type,
               CAST(floor(s_acctbal) AS BIGINT) AS file_size,
               'rule-' || CAST(s_nationkey AS VARCHAR) AS origin, s_name AS secret,
               s_nationkey + 1 AS start_line
        FROM supplier""",

    "repositories": """
        SELECT c_custkey AS repo_id, c_name AS repo_name, c_mktsegment AS repo_owner,
               CAST(floor(c_acctbal) AS BIGINT) AS pull_count,
               CAST(floor(abs(c_acctbal)) AS BIGINT) AS star_count,
               c_mktsegment = 'BUILDING' AS is_official, c_mktsegment = 'MACHINERY' AS is_automated
        FROM customer""",
    "tags": """
        SELECT o_orderkey AS tag_id, o_custkey AS repo_id, o_orderdate AS last_pushed,
               CASE WHEN o_orderstatus = 'P' THEN ' ' ELSE o_orderstatus END AS status,
               CAST(floor(o_totalprice) AS BIGINT) AS size
        FROM orders""",
    "layers": """
        SELECT p_partkey AS layer_id,
               'sha256:' || md5(CAST(p_partkey AS VARCHAR)) || md5(p_name) AS digest,
               CAST(p_size AS BIGINT) AS compressed_size, p_size AS file_count,
               p_size % 7 + 1 AS max_depth, CAST(floor(p_retailprice) AS BIGINT) AS uncompressed_size
        FROM part""",
    "repo_layers": """
        SELECT DISTINCT o_custkey AS repo_id, l_partkey AS layer_id
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey
        WHERE l_shipdate >= o_orderdate AND l_shipdate < o_orderdate + INTERVAL 60 DAY""",
    "secrets": """
        SELECT s_suppkey AS secret_id, substr(md5(s_name), 1, 16) AS fragment_hash,
               CASE n_nationkey % 5
                    WHEN 0 THEN 'github-token-' || CAST(n_nationkey AS VARCHAR)
                    WHEN 1 THEN 'private-key-' || CAST(n_nationkey AS VARCHAR)
                    WHEN 2 THEN 'aws-access-' || CAST(n_nationkey AS VARCHAR)
                    WHEN 3 THEN ' ' ELSE n_name END AS origin,
               s_name AS secret
        FROM supplier JOIN nation ON s_nationkey = n_nationkey""",
    "occurrences": """
        SELECT l_partkey AS layer_id, l_suppkey AS secret_id,
               'etc/f' || CAST(l_linenumber AS VARCHAR) || '.' || lower(l_linestatus) AS file,
               CASE WHEN l_linestatus = 'O' THEN ' ' ELSE '.' || lower(l_linestatus) END AS file_type,
               CASE WHEN l_linenumber < 7 THEN CAST(floor(l_extendedprice) AS BIGINT) END AS file_size,
               l_linenumber AS start_line
        FROM lineitem WHERE l_returnflag = 'R'""",
    "sample_tags": """
        SELECT l_shipdate AS last_pushed, l_linestatus AS status,
               CAST(floor(l_extendedprice) AS BIGINT) AS size
        FROM lineitem""",
    "sample_repos": """
        SELECT s_suppkey AS repo_id, CAST(floor(s_acctbal) AS BIGINT) AS pull_count,
               s_nationkey < 5 AS is_official
        FROM supplier""",
    "search_rows": """
        SELECT p_partkey AS seq, split_part(p_name, ' ', 1) AS query,
               lower(replace(p_brand, '#', '-')) || '/' || replace(p_name, ' ', '-') || '-'
                   || CAST(p_partkey AS VARCHAR) AS repo_name,
               p_type || ': ' || p_name || ' #' || split_part(p_name, ' ', 2) || ' # v'
                   || CAST(p_size AS VARCHAR) AS short_description,
               p_size AS star_count, CAST(floor(p_retailprice) AS BIGINT) AS pull_count,
               p_brand = 'Brand#2' AS is_official, p_size % 2 = 0 AS is_automated
        FROM part""",
    "match_rows": """
        SELECT s.seq, k.query, s.repo_name, s.short_description, s.star_count, s.pull_count,
               s.is_official, s.is_automated
        FROM search_rows s JOIN (
            SELECT p_partkey AS seq, unnest([split_part(p_name, ' ', 1), split_part(p_name, ' ', 2),
                   substr(p_name, 1, 3), CAST(p_size AS VARCHAR)]) AS query FROM part) k ON s.seq = k.seq""",
    "match_fields": """
        SELECT seq, lower(query) AS q, split_part(lower(repo_name), '/', 2) AS name,
               split_part(lower(repo_name), '/', 1) AS owner, lower(short_description) AS descr
        FROM match_rows""",
    "ranking": """
        SELECT *, max(rank) OVER (PARTITION BY query) - rank + 1 AS label FROM (
            SELECT p_brand AS query, p_partkey,
                   CAST(CAST(floor(p_retailprice) AS BIGINT) % 97 AS DOUBLE) AS score,
                   p_size AS f1, p_type AS f2,
                   row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS rank
            FROM part)""",
    "files": """
        SELECT source AS layer, 'srv/' || lang || '/' || CAST(doc_id AS VARCHAR) || '.txt' AS file, text
        FROM documents""",
    "picked": """
        SELECT repo_id, last_pushed, status FROM (
            SELECT *, row_number() OVER (PARTITION BY repo_id
                   ORDER BY md5(concat_ws('|', '42', CAST(tag_id AS VARCHAR))), tag_id) AS rn
            FROM tags WHERE last_pushed IS NOT NULL) WHERE rn = 1""",
    "leaky": """
        SELECT DISTINCT repo_id FROM repo_layers
        WHERE layer_id IN (SELECT layer_id FROM occurrences)""",
    "study": """
        SELECT r.repo_id, r.pull_count, r.star_count, p.last_pushed,
               strftime(p.last_pushed, '%Y-%m') AS month_key,
               coalesce(nullif(trim(p.status), ''), 'unknown') AS status_cat,
               CASE WHEN r.is_official THEN 'official' ELSE 'unofficial' END AS is_official_cat,
               CASE WHEN r.is_automated THEN 'automated' ELSE 'manual' END AS is_automated_cat,
               l.repo_id IS NOT NULL AS has_secret,
               coalesce(bm.bias, 1.0) AS w_month, coalesce(bs.bias, 1.0) AS w_status,
               coalesce(bo.bias, 1.0) AS w_isoff,
               CASE WHEN coalesce(bm.bias, 1.0) * coalesce(bs.bias, 1.0) * coalesce(bo.bias, 1.0)
                         = 'inf'::DOUBLE THEN 1.0
                    ELSE least(greatest(coalesce(bm.bias, 1.0) * coalesce(bs.bias, 1.0)
                         * coalesce(bo.bias, 1.0), 0.0), 100.0) END AS weight
        FROM repositories r JOIN picked p ON r.repo_id = p.repo_id
        LEFT JOIN leaky l ON r.repo_id = l.repo_id
        LEFT JOIN bias_month bm ON bm.key = strftime(p.last_pushed, '%Y-%m')
        LEFT JOIN bias_status bs ON bs.key = coalesce(nullif(trim(p.status), ''), 'unknown')
        LEFT JOIN bias_official bo
               ON bo.key = CASE WHEN r.is_official THEN 'official' ELSE 'unofficial' END""",
}


def _bias_sql(full: str, sample: str) -> str:
    return f"""
        SELECT key, cf AS count_full, cs AS count_sample, pf AS p_full, ps AS p_sample,
               CASE WHEN ps > 0 THEN pf / ps WHEN pf > 0 THEN 'inf'::DOUBLE ELSE 1.0 END AS bias
        FROM (SELECT key, cf, cs, cf / sum(cf) OVER () AS pf, cs / sum(cs) OVER () AS ps FROM (
                SELECT coalesce(f.key, s.key) AS key, CAST(coalesce(f.n, 0) AS DOUBLE) AS cf,
                       CAST(coalesce(s.n, 0) AS DOUBLE) AS cs
                FROM (SELECT key, count(*) AS n FROM ({full}) GROUP BY key) f
                FULL JOIN (SELECT key, count(*) AS n FROM ({sample}) GROUP BY key) s ON f.key = s.key))"""


_MONTH = "SELECT strftime(last_pushed, '%Y-%m') AS key FROM {} WHERE last_pushed IS NOT NULL"
_STATUS = "SELECT coalesce(nullif(trim(status), ''), 'unknown') AS key FROM {}"
_OFFICIAL = "SELECT CASE WHEN is_official THEN 'official' ELSE 'unofficial' END AS key FROM {}"
SQL["bias_month"] = _bias_sql(_MONTH.format("tags"), _MONTH.format("sample_tags"))
SQL["bias_status"] = _bias_sql(_STATUS.format("tags"), _STATUS.format("sample_tags"))
SQL["bias_official"] = _bias_sql(_OFFICIAL.format("repositories"), _OFFICIAL.format("sample_repos"))


def sql(statement: str) -> str:
    """The statement with the views it needs as leading table expressions."""
    needed: list[str] = []

    def visit_body(name: str) -> None:
        if name in needed:
            return
        body = SQL[name]
        for other in SQL:
            if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", body):
                visit_body(other)
        if name not in needed:
            needed.append(name)

    for name in SQL:
        if re.search(rf"\b(FROM|JOIN)\s+{name}\b", statement):
            visit_body(name)
    if not needed:
        return statement.strip()
    ctes = ",\n".join(f"{name} AS ({SQL[name]})" for name in needed)
    lead = statement.strip()
    if lead.upper().startswith("WITH RECURSIVE "):
        return f"WITH RECURSIVE {ctes},\n{lead[len('WITH RECURSIVE '):]}"
    if lead.upper().startswith("WITH "):
        return f"WITH {ctes},\n{lead[len('WITH '):]}"
    return f"WITH {ctes}\n{lead}"
