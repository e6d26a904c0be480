"""How well a search query matches a repository's name, owner and description.

Field lengths and positions count bytes; the edit distance counts characters.
Every feature is a native expression, evaluated row by row without a UDF.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import scalars as P

# Characters that can set a query apart inside a description.
SPECIALS = ("-", "_", ".", "/", ":", ";", "|", "&", "*", "#", "@", "!")

_SPACES = r"[\t\n\f\r ]*"
_SPECIAL_CLASS = "[" + "".join("\\" + c for c in SPECIALS) + "]"


def _size(c: Column) -> Column:
    return F.octet_length(c)


def _levenshtein_one(q: Column, c: Column) -> Column:
    longest = F.greatest(_size(q), _size(c))
    return F.when(F.contains(c, q), 1 - F.try_divide(F.levenshtein(q, c), longest))


def levenshtein_sim(q: Column, name: Column, owner: Column, descr: Column) -> Column:
    best = F.greatest(*(_levenshtein_one(q, c) for c in (name, owner, descr)))
    both_empty = (_size(q) == 0) & (_size(name) == 0)
    return F.when(both_empty, F.lit(1.0)).otherwise(F.coalesce(best, F.lit(0.0)))


def _position_one(q: Column, c: Column) -> Column:
    at = F.position(q, c)
    before = _size(F.substr(c, F.lit(1), at - 1))
    return F.when((at > 0) & (_size(c) > 0), 1 - F.try_divide(before, _size(c))).otherwise(F.lit(0.0))


def position_sim(q: Column, name: Column, owner: Column, descr: Column) -> Column:
    return F.greatest(*(_position_one(q, c) for c in (name, owner, descr)))


def char_set(c: Column) -> Column:
    """Distinct characters of a text as an array."""
    return F.when(F.length(c) == 0, F.array().cast("array<string>")).otherwise(
        F.array_distinct(F.split(c, "")))


def char_set_ops(a: Column, b: Column) -> Column:
    """Sizes of the intersection and the union of two character sets. ``a``,
    the shorter text, is looked up in ``b`` character by character."""
    left = char_set(a)
    common = F.when(b.isNotNull(), F.size(F.filter(left, lambda ch: F.contains(b, ch))))
    return F.struct(
        common.alias("common"),
        (F.size(left) + F.size(char_set(b)) - common).alias("either"),
    )


def _jaccard_one(q: Column, c: Column) -> Column:
    sets = char_set_ops(q, c)
    return F.coalesce(F.try_divide(sets["common"], sets["either"]), F.lit(0.0))


def jaccard_chars(q: Column, name: Column, owner: Column, descr: Column) -> Column:
    return F.greatest(*(_jaccard_one(q, c) for c in (name, owner, descr)))


def _share_one(q: Column, c: Column) -> Column:
    return F.when(F.contains(c, q), F.try_divide(_size(q), _size(c)))


def text_share(q: Column, name: Column, owner: Column, descr: Column) -> Column:
    return F.coalesce(F.greatest(*(_share_one(q, c) for c in (name, owner, descr))), F.lit(0.0))


def query_find(q: Column, name: Column, owner: Column, descr: Column) -> Column:
    def bit(c: Column, value: int) -> Column:
        return F.when(F.contains(c, q), F.lit(value)).otherwise(F.lit(0))

    return bit(name, 1) + bit(owner, 2) + bit(descr, 4)


def is_standalone(q: Column, name: Column, owner: Column, descr: Column) -> Column:
    return F.when((q == name) | (q == owner) | (q == descr), F.lit(1)).otherwise(F.lit(0))


def is_highlighted(q: Column, c: Column) -> Column:
    """First hit of an all-digit or all-letter query that does not touch a
    character of its own class."""
    numeric = q.rlike(r"^\p{Nd}*$")
    letters = q.rlike(r"^\p{L}+$")
    at = F.position(q, c)
    before = F.when(at > 1, F.substr(c, at - 1, F.lit(1))).otherwise(F.lit(""))
    after = F.substr(c, at + F.length(q), F.lit(1))

    def clear_of(pattern: str) -> Column:
        return ~before.rlike(pattern) & ~after.rlike(pattern)

    return (at > 0) & F.when(numeric, clear_of(r"\p{N}")).when(letters, clear_of(r"\p{L}")).otherwise(
        F.lit(False))


def name_category(q: Column, c: Column) -> Column:
    def fenced(mark: str) -> Column:
        return F.contains(c, F.concat(F.lit(mark), q, F.lit(mark)))

    return (
        F.when(q == c, F.lit(1.0))
        .when(fenced("-") | fenced("_"), F.lit(0.75))
        .when(is_highlighted(q, c), F.lit(0.5))
        .when(F.contains(c, q), F.lit(0.25))
        .otherwise(F.lit(0.0))
    )


def owner_category(q: Column, c: Column) -> Column:
    return (
        F.when(q == c, F.lit(1.0))
        .when(is_highlighted(q, c), F.lit(0.66))
        .when(F.contains(c, q), F.lit(0.33))
        .otherwise(F.lit(0.0))
    )


def _quoted(q: Column) -> Column:
    return F.regexp_replace(q, r"([^\p{L}\p{N}\s])", r"\\$1")


def description_category(q: Column, c: Column) -> Column:
    quoted = _quoted(q)
    usable = (q != "") & F.contains(c, q)
    same_both = F.concat(F.lit("(" + _SPECIAL_CLASS + ")" + _SPACES), quoted, F.lit(_SPACES + r"\1"))
    one_side = F.concat(
        F.lit(_SPECIAL_CLASS + _SPACES), quoted, F.lit("|"),
        quoted, F.lit(_SPACES + _SPECIAL_CLASS),
    )
    blank = F.lit(" ")
    return (
        F.when(q == c, F.lit(1.0))
        .when(F.contains(F.concat(blank, c, blank), F.concat(blank, q, blank)), F.lit(0.833))
        .when(usable & F.regexp_like(c, same_both), F.lit(0.66))
        .when(usable & F.regexp_like(c, one_side), F.lit(0.5))
        .when(is_highlighted(q, c), F.lit(0.333))
        .when(F.contains(c, q), F.lit(0.166))
        .otherwise(F.lit(0.0))
    )


def significant_category(q: Column, name: Column, owner: Column, descr: Column) -> Column:
    return F.greatest(name_category(q, name), owner_category(q, owner), description_category(q, descr))


FEATURES = (
    "star_count", "pull_count", "is_official", "is_automated",
    "significant_levenshtein", "significant_position", "significant_category",
    "significant_jaccard", "is_standalone", "query_find",
)


def feature_rows(df: DataFrame, q: str = "query", rank: str = "rank") -> DataFrame:
    """One feature row per (query, rank). Needs the repository columns
    ``repo_name, short_description, star_count, pull_count, is_official,
    is_automated``; owner and name come from the full repository name."""
    parts = df.select(
        F.col(q).alias("query"), F.col(rank).alias("rank"),
        F.lower(F.col(q)).alias("_q"),
        P.split_owner_name(F.col("repo_name")).alias("_on"),
        F.lower(F.coalesce(F.col("short_description"), F.lit(""))).alias("_descr"),
        "star_count", "pull_count", "is_official", "is_automated",
    )
    f = (F.col("_q"), F.col("_on.name"), F.col("_on.owner"), F.col("_descr"))
    return parts.select(
        "query", "rank",
        F.col("_on.name").alias("repo_name"),
        F.col("_on.owner").alias("repo_owner"),
        F.col("_descr").alias("short_description"),
        P.log1p_scale(F.col("star_count")).alias("star_count"),
        P.log1p_scale(F.col("pull_count")).alias("pull_count"),
        F.col("is_official").cast("int").alias("is_official"),
        F.col("is_automated").cast("int").alias("is_automated"),
        levenshtein_sim(*f).alias("significant_levenshtein"),
        position_sim(*f).alias("significant_position"),
        significant_category(*f).alias("significant_category"),
        jaccard_chars(*f).alias("significant_jaccard"),
        is_standalone(*f).alias("is_standalone"),
        query_find(*f).alias("query_find"),
    )


# Characters a search query is extended by.
QUERY_ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789"


def prefix_refine_label(df: DataFrame, query: str = "query", repo: str = "repo_name",
                        alphabet: str = QUERY_ALPHABET) -> DataFrame:
    """Per query: 1 if a one-character extension of it returned a repository
    that the query itself did not, with the mean edit and text-share features.

    An extension is matched to its parent by cutting its last character, so
    both joins are equi-joins; no pair of repositories is ever formed.
    """
    q, r = F.col(query), F.col(repo)
    on = P.split_owner_name(r)
    descr = F.lower(F.coalesce(F.col("short_description"), F.lit("")))
    f = (F.lower(q), on["name"], on["owner"], descr)
    parents = df.groupBy(q.alias("query")).agg(
        F.count(F.lit(1)).alias("entries"),
        F.avg(levenshtein_sim(*f)).alias("avg_levenshtein"),
        F.avg(text_share(*f)).alias("avg_text_share"),
    )
    held = df.select(q.alias("query"), r.alias("repo")).distinct()
    grown = held.filter(
        (F.length("query") > 0) & F.contains(F.lit(alphabet), F.right(F.col("query"), F.lit(1)))
    ).select(
        F.substr(F.col("query"), F.lit(1), F.length("query") - 1).alias("query"), "repo"
    ).distinct()
    novel = grown.join(held, ["query", "repo"], "left_anti").select("query").distinct()
    return parents.join(novel.withColumn("_novel", F.lit(1)), "query", "left").select(
        "query", F.coalesce("_novel", F.lit(0)).alias("label"), "entries",
        "avg_levenshtein", "avg_text_share",
    )
