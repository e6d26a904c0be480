"""Secret scanning over extracted layer files, one finding per distinct fragment.

Rules are a list the caller supplies, of any length if they have keywords: the
text is searched for all keywords at once, and only the rules whose keyword it
holds are tried. However many layers, files or
copies hold a fragment, its findings are reported once and return to the
layers through the fragment hash.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators.joins import spread_join
from regspark.session import cut_lineage


@dataclass(frozen=True)
class Rule:
    """A pattern with one group for the secret. Keywords, if any, must occur in
    the text (lower-cased) before the pattern is tried. ``most_lines`` is the
    greatest number of lines a match can span (None: without bound)."""

    rule_id: str
    regex: str
    keywords: Sequence[str] = field(default_factory=tuple)
    min_entropy: float | None = None
    most_lines: int | None = None


def fragment_hash(c: Column) -> Column:
    """First 16 hex digits of the content's md5, as shown in results. Fragments
    are told apart by the whole digest."""
    return F.left(F.md5(c), F.lit(16))


def fragments(df: DataFrame, layer: str = "layer", file: str = "file", text: str = "text",
              size: str | None = None, unit: str = "line", lines: int = 200, overlap: int | None = None,
              rules: Sequence[Rule] = ()) -> DataFrame:
    """Files to fragments in order; empty ones are skipped.

    One per line, one per file (``unit="file"``), or chunks of ``lines`` lines
    (``unit="chunk"``), each running ``overlap`` lines into the next, so that a
    match of at most that many lines is whole in the chunk it begins in. Without
    ``overlap``, it is the most lines a match of ``rules`` can span, and chunks
    are at least twice as long; if a rule has no bound, or no rules are given,
    files stay whole, so that no match is lost.
    ``own_lines`` is the number of lines a chunk answers for (null: all).
    """
    if unit == "chunk" and overlap is None:
        spans = [r.most_lines for r in rules]
        if spans and None not in spans:
            overlap = max(spans)
            lines = max(lines, 2 * overlap)
        else:
            unit = "file"
    length = F.col(size) if size else F.octet_length(text)
    split = F.split(F.col(text), "\n")
    step = lines - (overlap or 0)
    if unit == "line":
        body = split
    elif unit == "file":
        body = F.array(F.col(text))
    elif step > 0:
        last = F.greatest(F.ceil((F.size(split) - overlap) / F.lit(step)) - 1, F.lit(0)).cast("int")
        body = F.transform(F.sequence(F.lit(0), last), lambda k: F.array_join(
            F.slice(split, k * step + 1, F.lit(lines)), "\n"))
    else:
        raise ValueError("a chunk needs more lines than the overlap")
    cut = df.filter(F.col(text).isNotNull() & (F.col(text) != "")).select(
        F.col(layer).alias("layer"), F.col(file).alias("file"), length.cast("long").alias("file_size"),
        F.size(body).alias("_n"), F.posexplode(body).alias("fragment_no", "raw"))
    first = {"line": F.col("fragment_no") + 1, "file": F.lit(1), "chunk": F.col("fragment_no") * step + 1}[unit]
    own = F.when(F.col("fragment_no") < F.col("_n") - 1, step) if unit == "chunk" else F.lit(None)
    return cut.filter(F.col("raw") != "").withColumns({
        "start_line": first, "own_lines": own.cast("int"), "digest": F.md5("raw"),
        "fragment_hash": fragment_hash(F.col("raw"))}).drop("_n")


def finding_line(text: Column, secret: Column) -> Column:
    """1-based line of the first place the secret stands in the text."""
    at = F.position(secret, text)
    before = F.substr(text, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1)


def finding_entropy(c: Column) -> Column:
    """Shannon entropy of a text in bits per character."""
    chars = F.split(c, "")
    n = F.length(c)

    def part(ch: Column) -> Column:
        share = F.size(F.filter(chars, lambda x: x == ch)) / n
        return -share * F.log2(share)

    bits = F.aggregate(F.array_distinct(chars), F.lit(0.0), lambda acc, ch: acc + part(ch))
    return F.when(n > 0, bits).when(n == 0, F.lit(0.0))


def _breaks(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


#: Matches of a fragment: rule, secret, and the line of the fragment it is on.
HITS = "array<struct<origin:string,secret:string,line:int>>"

# Put before each match to count the matches of a line by its added length.
_MARK = "\ue000"


def _match_lines(text: Column, pattern: Column) -> Column:
    """1-based line each match begins on, in order, in one pass over the lines."""
    marked = F.split(F.regexp_replace(text, pattern, F.lit(_MARK + "$0")), "\n", -1)
    counts = F.zip_with(marked, F.split(text, "\n", -1), lambda m, t: F.length(m) - F.length(t))
    return F.flatten(F.transform(counts, lambda n, i: F.array_repeat(i + 1, n)))


def _rule_hits(text: Column, rule: Column) -> Column:
    """Matches of a rule, given as a struct, with the line the secret begins on.

    The arrays of matches, secrets and lines are made once each and walked
    together, so the cost grows with the text and not with text times matches.
    """
    pattern = rule["regex"]
    secrets = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(0)), F.regexp_extract_all(text, pattern, F.lit(1)),
        lambda whole, secret: F.struct(secret.alias("secret"), _breaks(F.substr(
            whole, F.lit(1), F.greatest(F.position(secret, whole) - 1, F.lit(0)))).alias("lead")))
    found = F.zip_with(secrets, _match_lines(text, pattern), lambda m, line: F.struct(
        rule["rule_id"].alias("origin"), m["secret"].alias("secret"), (line + m["lead"]).alias("line")))
    least = rule["min_entropy"]
    strong = F.filter(found, lambda h: least.isNull() | (finding_entropy(h["secret"]) >= least))
    return F.when(F.regexp_like(text, pattern), strong).otherwise(F.array().cast(HITS))


def _as_struct(rule: Rule) -> Column:
    return F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.regex).alias("regex"),
                    F.lit(rule.min_entropy).cast("double").alias("min_entropy"))


def _quoted(c: str) -> str:
    return c if c.isalnum() or not c.isascii() else "\\" + c


def _prefix_pattern(words: Sequence[str]) -> str:
    """A pattern for the longest of ``words`` at a place, branching letter by
    letter, so that its cost does not grow with their number."""
    if list(words) == [""]:
        return ""
    branches: dict[str, list[str]] = {}
    for w in words:
        if w:
            branches.setdefault(w[0], []).append(w[1:])
    parts = [_quoted(c) + _prefix_pattern(rest)
             for c, rest in sorted(branches.items())]
    return f"(?:{'|'.join(parts)}){'?' if '' in words else ''}"


def keyword_rules(text: Column, rules: Sequence[Rule]) -> Column:
    """Numbers of the rules, ascending, of which a keyword stands in the text.

    One pattern finds the longest keyword at every place; keywords it begins with
    stand there too, and keywords inside it are found at places of their own.
    """
    owners: dict[str, set[int]] = {}
    for number, rule in enumerate(rules):
        for word in rule.keywords:
            owners.setdefault(word.lower(), set()).add(number)
    index = F.create_map(*(x for word in owners for x in (
        F.lit(word), F.array(*(F.lit(n) for n in sorted(set().union(
            *(held for begin, held in owners.items() if word.startswith(begin)))))))))
    # Most places fail on the letters that keywords begin with, before any branch.
    begins = "".join(f"[{''.join(_quoted(c) for c in sorted(set(letters)))}]"
                     for letters in list(zip(*owners, strict=False))[:4])
    places = F.lit(f"(?={begins})(?=({_prefix_pattern(sorted(owners))}))")
    words = F.array_distinct(F.regexp_extract_all(F.lower(text), places, F.lit(1)))
    return F.array_sort(F.array_distinct(F.flatten(F.transform(words, lambda w: F.element_at(index, w)))))


def candidates(frags: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(layer, file, fragment_no, rule_id) of every pattern a scan tries."""
    keyed, always = [r for r in rules if r.keywords], [r.rule_id for r in rules if not r.keywords]
    names = F.array(*map(F.lit, always)).cast("array<string>")
    if keyed:
        table = F.array(*(F.lit(r.rule_id) for r in keyed))
        names = F.concat(names, F.transform(keyword_rules(F.col("raw"), keyed), lambda k: F.get(table, k)))
    return frags.select("layer", "file", "fragment_no", F.explode(names).alias("rule_id"))


def _hits(text: Column, rules: Sequence[Rule]) -> Column:
    """Matches of all rules. Rules with keywords are looked up by those that stand
    in the text, so however many there are, only theirs are tried."""
    found = [_rule_hits(text, _as_struct(r)) for r in rules if not r.keywords]
    keyed = [r for r in rules if r.keywords]
    if keyed:
        table = F.array(*map(_as_struct, keyed))
        chosen = F.transform(keyword_rules(text, keyed), lambda k: F.get(table, k))
        found.append(F.flatten(F.transform(chosen, lambda rule: _rule_hits(text, rule))))
    return F.concat(*found) if found else F.array().cast(HITS)


def own_hits(rules: Sequence[Rule]) -> Column:
    """Matches of a fragment. A chunk's matches in lines it does not answer for
    are the next chunk's."""
    own = F.coalesce("own_lines", F.lit(2**31 - 1))
    return F.filter(_hits(F.col("raw"), rules), lambda h: h["line"] <= own)


def _matched(frags: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Fragments with a match; chunks of equal text but different ends stay apart."""
    # Computed by a generator, since a filter would be moved below and compute the matches again.
    once = F.explode(F.array(own_hits(rules)))
    return frags.select("*", once.alias("_hits")).filter(F.size("_hits") > 0).withColumn(
        "digest", F.concat_ws("-", "digest", F.col("own_lines").cast("string")))


def _described(matched: DataFrame) -> DataFrame:
    """Findings of each distinct fragment, at its first place by (layer, file,
    number)."""
    place = F.struct("layer", "file", "fragment_no")
    first = matched.groupBy("digest").agg(
        F.min_by(F.struct("fragment_hash", "file", "file_size", "start_line", "_hits"), place).alias("_f")
    ).select("digest", "_f.*")
    return first.select("*", F.explode("_hits").alias("_h")).select(
        "digest", "fragment_hash", "file", P.file_ext(F.col("file")).alias("file_type"), "file_size",
        F.col("_h.origin").alias("origin"), F.col("_h.secret").alias("secret"),
        (F.col("start_line") + F.col("_h.line") - 1).alias("start_line"))


def secret_findings(frags: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """One row per rule match in each distinct fragment, described at the
    place the fragment was first seen.

    Rules run where the text is read, and only fragments with a match are
    shuffled to be made distinct: moving every fragment to find the copies
    first would cost far more than matching a copy again.
    """
    return _described(_matched(frags, rules)).drop("digest")


def scan_distinct(frags: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """Findings for every layer holding the fragment. Every copy of a matching
    fragment matches, so its layers are known without joining all fragments;
    a fragment held by very many layers is split by layer."""
    return per_layer(_matched(frags, rules))


def per_layer(found: DataFrame) -> DataFrame:
    """Findings of matched fragments for every layer holding them."""
    matched = cut_lineage(found)
    places = cut_lineage(matched.select("digest", "layer").distinct())
    return spread_join(places, _described(matched), ["digest"], "layer").drop("digest")


def layer_secret_list(found: DataFrame) -> DataFrame:
    """Distinct (layer, fragment_hash) of fragments with a finding, from the
    result of ``scan_distinct``, in rows rather than one array per layer, which
    could grow without bound."""
    return found.select("layer", "fragment_hash").distinct()


# Decoded text counts only if it is readable.
_PRINTABLE = r"^[\t\n\r -~]+$"

_LETTER = "[A-Za-z0-9+/]"
_SPANS = "array<struct<start:int,end:int>>"


def decode_spans(frags: DataFrame, rounds: int = 3, least_token: int = 16, readable: str = _PRINTABLE) -> DataFrame:
    """Fragments, and one row for every base64 token in them and in what tokens
    decode to, up to ``rounds`` levels deep.

    ``raw`` is the text or what the token decodes to, ``round`` its depth. The
    columns of the fragment stay those of the original, ``spans`` are the token's
    (start, end) in its parent, from the original inwards (code points, end
    exclusive), and ``line`` is the original's line that the outermost token is
    on. Tokens shorter than ``least_token`` are not decoded; decoded text that does
    not match ``readable`` is dropped.
    """
    token = F.lit(f"{_LETTER}{{{least_token},}}={{0,2}}")
    # The first letter of each token is masked, so its place is where texts differ.
    first = F.lit(f"(?<!{_LETTER}){_LETTER}(?={_LETTER}{{{least_token - 1},}})")

    def tokens(text: Column) -> Column:
        masked = F.split(F.regexp_replace(text, first, F.lit(_MARK)), "")
        differs = F.zip_with(masked, F.split(text, ""), lambda m, t: m != t)
        starts = F.filter(F.transform(differs, lambda d, i: F.when(d, i)), lambda i: i.isNotNull())
        lines = F.flatten(F.transform(F.split(text, "\n", -1), lambda t, i: F.array_repeat(
            i + 1, F.size(F.regexp_extract_all(t, token, F.lit(0))))))
        placed = F.zip_with(starts, lines, lambda at, line: F.struct(at.alias("start"), line.alias("line")))
        whole = F.zip_with(placed, F.regexp_extract_all(text, token, F.lit(0)), lambda p, t: F.struct(
            F.struct(p["start"].alias("start"), (p["start"] + F.length(t)).alias("end")).alias("span"),
            p["line"].alias("line"), F.try_to_binary(t, F.lit("base64")).cast("string").alias("raw")))
        return F.when(F.regexp_like(text, token), F.filter(
            whole, lambda t: t["raw"].isNotNull() & t["raw"].rlike(readable)))

    kept = [c for c in frags.columns if c not in ("raw", "round", "spans", "line")]
    level = frags.select(*kept, "raw", F.lit(0).alias("round"), F.array().cast(_SPANS).alias("spans"),
                         F.lit(None).cast("int").alias("line"))
    out = level
    for r in range(1, rounds + 1):
        level = level.select(*kept, "spans", "line", F.explode(tokens(F.col("raw"))).alias("_t")).select(
            *kept, F.col("_t.raw").alias("raw"), F.lit(r).alias("round"),
            F.concat("spans", F.array("_t.span")).alias("spans"), F.coalesce("line", "_t.line").alias("line"))
        out = out.unionByName(level)
    return out


def decoded_findings(frags: DataFrame, rules: Sequence[Rule], rounds: int = 3, least_token: int = 16,
                     readable: str = _PRINTABLE) -> DataFrame:
    """Rule matches in each distinct fragment and in all that its tokens decode to.

    Every match is reported once, under the original fragment and the line its
    outermost token is on, with the ``round`` it was found in and the ``spans``
    that lead to it. Copies of a fragment have the same matches; they are described
    at the first place by (layer, file, number).
    """
    own = F.coalesce("own_lines", F.lit(2**31 - 1))
    hits = decode_spans(frags, rounds, least_token, readable).select(
        "digest", "own_lines", "round", "spans", "line",
        F.struct("layer", "file", "fragment_no", "fragment_hash", "file_size", "start_line").alias("place"),
        F.posexplode(_hits(F.col("raw"), rules)).alias("number", "hit"))
    # A span in the original is found with the line it is on; deeper lines are not the original's.
    placed = hits.withColumn("line", F.coalesce("line", "hit.line")).where(F.col("line") <= own)
    once = placed.groupBy("digest", "own_lines", "round", "spans", "number", "line", "hit.origin", "hit.secret").agg(
        F.min("place").alias("place"))
    return once.select(
        "place.fragment_hash", "place.file", P.file_ext(F.col("place.file")).alias("file_type"), "place.file_size",
        "origin", "secret", (F.col("place.start_line") + F.col("line") - 1).alias("start_line"), "round", "spans")


def decode_pass(frags: DataFrame, rounds: int = 3, least_token: int = 16, readable: str = _PRINTABLE) -> DataFrame:
    """Fragments plus what their tokens decode to, up to ``rounds`` levels deep;
    ``round`` 0 is the fragment itself. The decoded tokens of one fragment form
    one new fragment, a token per line, with a digest of its own and the
    ``parent`` digest it came from. ``decoded_findings`` leads findings back to
    the original instead."""
    token = f"({_LETTER}{{{least_token},}}={{0,2}})"

    def decoded(text: Column) -> Column:
        tokens = F.regexp_extract_all(text, F.lit(token), F.lit(1))
        plain = F.transform(tokens, lambda t: F.try_to_binary(t, F.lit("base64")).cast("string"))
        return F.concat_ws("\n", F.filter(plain, lambda t: t.isNotNull() & t.rlike(readable)))

    level = frags.withColumns({"digest": F.md5("raw"), "fragment_hash": fragment_hash(F.col("raw")),
                               "round": F.lit(0), "parent": F.lit(None).cast("string")})
    out = level
    for r in range(1, rounds + 1):
        level = level.withColumns({"raw": decoded(F.col("raw")), "parent": F.col("digest")}).filter(
            F.col("raw") != "").withColumns({
                "digest": F.md5("raw"), "fragment_hash": fragment_hash(F.col("raw")), "round": F.lit(r)})
        out = out.unionByName(level)
    return out
