"""Secret scanning over the document texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from regspark.operators import scan as C
from regspark.operators.findings import FindingStore
from regspark.plans import importer as I
from regspark.plans.scan_import import scan_to_import
from regspark.session import fresh_path
from workload import views as V
from workload.registry import query

RULES = (
    C.Rule("token-hex40", r'token = "([0-9a-f]{40})"', ("token",), 2.5),
    C.Rule("ipv4", r"\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b"),
)

LINES_SQL = """
    SELECT layer, file, i - 1 AS fragment_no, l[i] AS raw, substr(md5(l[i]), 1, 16) AS fragment_hash, i AS start_line,
           size AS file_size
    FROM (SELECT layer, file, strlen(text) AS size, string_split(text, chr(10)) AS l,
                 unnest(generate_series(1, len(string_split(text, chr(10))))) AS i FROM files WHERE text <> '')
    WHERE l[i] <> ''"""
_FIRST_SQL = f"""
    SELECT fragment_hash, raw, file, file_size, start_line FROM (
        SELECT *, row_number() OVER (PARTITION BY fragment_hash ORDER BY layer, file, fragment_no) AS rn
        FROM lines) WHERE rn = 1"""
# (?:^|[^0-9A-Za-z_]) stands for the word boundary before a group.
FOUND_SQL = f"""
    first AS ({_FIRST_SQL}),
    found AS (
        SELECT fragment_hash, file, regexp_extract(file, '([.][^./]*)$', 1) AS file_type, file_size, start_line,
               'token-hex40' AS origin,
               unnest(regexp_extract_all(raw, 'token = "([0-9a-f]{{40}})"', 1)) AS secret FROM first
        UNION ALL
        SELECT fragment_hash, file, regexp_extract(file, '([.][^./]*)$', 1), file_size, start_line, 'ipv4',
               unnest(regexp_extract_all(raw, '\\b([0-9]{{1,3}}(?:\\.[0-9]{{1,3}}){{3}})\\b', 1)) FROM first)"""


def frags(spark, d):
    return C.fragments(V.files(spark, d))


@query("fragments", f"SELECT layer, file, fragment_no, fragment_hash, start_line, file_size FROM ({LINES_SQL})")
def fragments(spark, d):
    return frags(spark, d).select("layer", "file", "fragment_no", "fragment_hash", "start_line", "file_size")


@query("fragment_hash", "SELECT doc_id, substr(md5(text), 1, 16) AS hash FROM documents")
def fragment_hash(spark, d):
    return V.table(spark, d, "documents").select("doc_id", C.fragment_hash(F.col("text")).alias("hash"))


@query("secret_findings", f"WITH lines AS ({LINES_SQL}), {FOUND_SQL} SELECT * FROM found")
def secret_findings(spark, d):
    return C.secret_findings(frags(spark, d), RULES)


CHUNKED = (*RULES, C.Rule("two-lines", r"([a-z]{4}[.])\n(?=[A-Z][a-z]{3})"))


@query("secret_findings_chunked", r"""
    WITH f AS (SELECT DISTINCT ON (text) text, file FROM files WHERE text <> '' ORDER BY text, layer, file),
    l AS (SELECT file, text, string_split(text, chr(10)) AS l FROM f),
    n AS (SELECT file, i, l[i] AS raw FROM l, unnest(range(1, len(l) + 1)) AS t(i))
    SELECT file, i AS start_line, 'token-hex40' AS origin,
           unnest(regexp_extract_all(raw, 'token = "([0-9a-f]{40})"', 1)) AS secret FROM n
    UNION ALL
    SELECT file, i, 'ipv4', unnest(regexp_extract_all(raw, '\b([0-9]{1,3}(?:\.[0-9]{1,3}){3})\b', 1)) FROM n
    UNION ALL
    SELECT file, i, 'two-lines', regexp_extract(l[i], '([a-z]{4}[.])$', 1)
    FROM l, unnest(range(1, len(l))) AS t(i)
    WHERE regexp_matches(l[i], '[a-z]{4}[.]$') AND regexp_matches(l[i + 1], '^[A-Z][a-z]{3}')""")
def secret_findings_chunked(spark, d):
    """Matches within and across lines, each once and on its line, in distinct files cut into chunks."""
    files = V.files(spark, d).groupBy("text").agg(F.min_by("file", F.struct("layer", "file")).alias("file"))
    cut = C.fragments(files.withColumn("layer", F.col("file")), unit="chunk", lines=7, overlap=2)
    named = cut.withColumn("digest", F.concat_ws("|", "digest", "file", F.col("fragment_no").cast("string")))
    return C.secret_findings(named, CHUNKED).select("file", "start_line", "origin", "secret")


@query("scan_distinct", f"""
    WITH lines AS ({LINES_SQL}), {FOUND_SQL}
    SELECT p.layer, f.fragment_hash, f.origin, f.secret, f.start_line FROM found f
    JOIN (SELECT DISTINCT layer, fragment_hash FROM lines) p ON p.fragment_hash = f.fragment_hash""")
def scan_distinct(spark, d):
    return C.scan_distinct(frags(spark, d), RULES).select("layer", "fragment_hash", "origin", "secret", "start_line")


@query("scan_across_runs", f"""
    WITH lines AS ({LINES_SQL}), {FOUND_SQL}
    SELECT p.layer, f.fragment_hash, f.origin, f.secret, f.start_line FROM found f
    JOIN (SELECT DISTINCT layer, fragment_hash FROM lines) p ON p.fragment_hash = f.fragment_hash""")
def scan_across_runs(spark, d):
    """The findings of all files, after the English ones came in an earlier run."""
    store = FindingStore(spark, fresh_path(spark, "findings"))
    every = V.files(spark, d)
    store.scan(C.fragments(every.filter(F.col("file").startswith("srv/en/"))), RULES, "first")
    return store.scan(C.fragments(every), RULES, "second").select(
        "layer", "fragment_hash", "origin", "secret", "start_line")


@query("finding_line", """
    SELECT doc_id, len(string_split(substr(text, 1, instr(text, word) - 1), chr(10))) AS line
    FROM (SELECT doc_id, text, string_split(text, ' ')[-1] AS word FROM documents)""")
def finding_line(spark, d):
    """The line on which each document's last word first occurs."""
    word = F.element_at(F.split("text", " "), -1)
    return V.table(spark, d, "documents").select("doc_id", C.finding_line(F.col("text"), word).alias("line"))


@query("finding_entropy", """
    SELECT c, round(-sum(n / t * log2(n / t)), 6) AS entropy FROM (
        SELECT c_custkey AS c, ch, count(*)::DOUBLE AS n, any_value(t)::DOUBLE AS t FROM (
            SELECT c_custkey, unnest(string_split(md5(c_name), '')) AS ch, length(md5(c_name)) AS t FROM customer)
        GROUP BY c_custkey, ch) GROUP BY c""")
def finding_entropy(spark, d):
    return V.table(spark, d, "customer").select(
        F.col("c_custkey").alias("c"), F.round(C.finding_entropy(F.md5("c_name")), 6).alias("entropy"))


@query("layer_secret_list", f"""
    WITH lines AS ({LINES_SQL}), {FOUND_SQL}
    SELECT DISTINCT l.layer, l.fragment_hash FROM lines l
    WHERE l.fragment_hash IN (SELECT fragment_hash FROM found)""")
def layer_secret_list(spark, d):
    return C.layer_secret_list(C.scan_distinct(frags(spark, d), RULES))


@query("decode_pass", """
    WITH src AS (SELECT c_custkey, 'key: ' || to_base64(encode('token for ' || c_name)) AS once,
                        to_base64(encode('wrap ' || to_base64(encode('token of ' || c_mktsegment || c_name)))) AS twice
                 FROM customer)
    SELECT c_custkey, 0 AS round, once || ' ' || twice AS raw FROM src
    UNION ALL SELECT c_custkey, 1, 'token for ' || c_name || chr(10) || 'wrap '
              || to_base64(encode('token of ' || c_mktsegment || c_name)) FROM customer
    UNION ALL SELECT c_custkey, 2, 'token of ' || c_mktsegment || c_name FROM customer""")
def decode_pass(spark, d):
    def b64(c):
        return F.base64(c.cast("binary"))

    name, segment = F.col("c_name"), F.col("c_mktsegment")
    once = F.concat(F.lit("key: "), b64(F.concat(F.lit("token for "), name)))
    twice = b64(F.concat(F.lit("wrap "), b64(F.concat(F.lit("token of "), segment, name))))
    rows = V.table(spark, d, "customer").select("c_custkey", F.concat(once, F.lit(" "), twice).alias("raw"))
    return C.decode_pass(rows).select("c_custkey", "round", "raw")


# Customers, each a file of one line and one of two, with a secret as it is, encoded, and encoded twice.
_NESTED_SQL = """
    src AS (SELECT c_custkey, md5(c_name) AS plain, md5(c_name || 'b') AS once, md5(c_name || 'c') AS twice FROM customer),
    e AS (SELECT *, to_base64(encode('key=' || once || ' end')) AS b1,
                 to_base64(encode('wrap ' || to_base64(encode('key=' || twice)))) AS b2 FROM src)"""


def nested(spark, d):
    """Files that hold a plain, an encoded and a twice encoded secret, the last two on a line of their own
    for every third customer."""
    def b64(*parts):
        return F.base64(F.concat(*parts).cast("binary"))

    def key(c):
        return F.concat(F.lit("key="), F.md5(F.concat("c_name", F.lit(c))))

    once, twice = b64(key("b"), F.lit(" end")), b64(F.lit("wrap "), b64(key("c")))
    between = F.when(F.col("c_custkey") % 3 == 0, F.lit("\n")).otherwise(F.lit(" "))
    return V.table(spark, d, "customer").select(
        F.col("c_mktsegment").alias("layer"), F.concat(F.lit("c/"), F.col("c_custkey").cast("string"), F.lit(".cfg")).alias("file"),
        F.concat(key(""), between, once, F.lit(" "), twice).alias("text"))


KEYS = (C.Rule("key-hex32", r"key=([0-9a-f]{32})", ("key=",)),)


@query("decoded_findings", f"""
    WITH {_NESTED_SQL},
    f AS (SELECT *, 'c/' || c_custkey || '.cfg' AS file, 36 AS p, CASE WHEN c_custkey % 3 = 0 THEN 2 ELSE 1 END AS line FROM e)
    SELECT file, '.cfg' AS file_type, 'key-hex32' AS origin, plain AS secret, 1 AS start_line, 0 AS round, '' AS spans FROM f
    UNION ALL SELECT file, '.cfg', 'key-hex32', once, line, 1, (p + 1) || '-' || (p + 1 + length(b1)) FROM f
    UNION ALL SELECT file, '.cfg', 'key-hex32', twice, line, 2,
        (p + 2 + length(b1)) || '-' || (p + 2 + length(b1) + length(b2)) || ',5-'
        || (5 + length(to_base64(encode('key=' || twice)))) FROM f""")
def decoded_findings(spark, d):
    """Every secret once, under its file and line, however deep it was encoded."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["start"], s["end"])), ",")
    return C.decoded_findings(C.fragments(nested(spark, d), unit="file"), KEYS).select(
        "file", "file_type", "origin", "secret", "start_line", "round", spans.alias("spans"))


def many_rules(n: int = 200) -> list[C.Rule]:
    """A rule for each of ``n`` pairs of syllables that begin a word."""
    words = [a + b + c + d for a in "bdfghlmnrst" for b in "aei" for c in "dlnrst" for d in "aei"][:n]
    return [C.Rule(f"word-{w}", rf"(?:^| )({w}[a-z]{{1,8}})\b", (w,)) for w in words]


@query("secret_findings_many_rules", f"""
    WITH lines AS ({LINES_SQL}), first AS ({_FIRST_SQL}),
    rules AS (SELECT a || b || c || d AS w FROM (SELECT unnest(string_split('bdfghlmnrst', '')) AS a),
        (SELECT unnest(string_split('aei', '')) AS b), (SELECT unnest(string_split('dlnrst', '')) AS c),
        (SELECT unnest(string_split('aei', '')) AS d) ORDER BY a, b, c, d LIMIT 200),
    words AS (SELECT fragment_hash, file, start_line, unnest(string_split(raw, ' ')) AS word FROM first)
    SELECT fragment_hash, file, start_line, 'word-' || w AS origin, regexp_extract(word, '^[a-z]{{5,12}}') AS secret
    FROM words JOIN rules ON left(word, 4) = w WHERE regexp_matches(word, '^[a-z]{{5,12}}($|[^a-zA-Z0-9_\\x{{80}}-\\x{{10FFFF}}])')""")
def secret_findings_many_rules(spark, d):
    """Two hundred rules: only those whose keyword a fragment holds are tried on it."""
    return C.secret_findings(frags(spark, d), many_rules()).select(
        "fragment_hash", "file", "start_line", "origin", "secret")


@query("scan_to_import", f"""
    WITH lines AS ({LINES_SQL}), {FOUND_SQL},
    kept AS (SELECT fragment_hash, origin, secret FROM found QUALIFY row_number() OVER (
             PARTITION BY fragment_hash ORDER BY start_line DESC, origin DESC, secret DESC) = 1),
    places AS (SELECT DISTINCT fragment_hash, file, file_type, start_line FROM found)
    SELECT DISTINCT CAST(l.layer AS VARCHAR) AS digest, p.fragment_hash, p.file, p.file_type, p.start_line, k.origin, k.secret
    FROM lines l JOIN places p ON l.fragment_hash = p.fragment_hash JOIN kept k ON k.fragment_hash = p.fragment_hash""")
def imported_secrets(spark, d):
    _, held, records = scan_to_import(V.files(spark, d), RULES)
    secrets, occurrences = I.import_held(held, records)
    return occurrences.join(secrets.select("fragment_hash", "origin", "secret"), "fragment_hash").select(
        "digest", "fragment_hash", "file", "file_type", "start_line", "origin", "secret")


@query("scan_to_import_layers", """
    SELECT CAST(layer AS VARCHAR) AS digest, count(*) AS file_count,
           max(len(string_split(file, '/'))) AS max_depth, sum(strlen(text)) AS uncompressed_size
    FROM files GROUP BY 1""")
def imported_layers(spark, d):
    files = V.files(spark, d)
    selection = files.select(
        F.col("layer").alias("digest"), F.lit(1).cast("long").alias("size"), F.array(F.lit("app")).alias("repos"),
        F.lit(0).cast("long").alias("seq")).distinct()
    counts, _, _ = scan_to_import(files, RULES)
    return I.import_layers(I.clean_selection(selection), counts).select(
        "digest", "file_count", "max_depth", "uncompressed_size")
