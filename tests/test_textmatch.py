import pytest
from pyspark.sql import functions as F

from regspark.functions import textmatch as T

COLUMNS = ("q", "name", "owner", "descr")


def value(spark, function, *texts):
    rows = spark.createDataFrame([texts], ", ".join(f"{c} string" for c in COLUMNS[: len(texts)]))
    return rows.select(function(*(F.col(c) for c in COLUMNS[: len(texts)]))).first()[0]


@pytest.mark.parametrize("texts, want", [
    (("abc", "abc", "x", "y"), 1.0), (("abc", "xabcx", "", ""), 1 - 2 / 5), (("zzz", "abc", "d", "e"), 0.0),
    (("", "", "", ""), 1.0), (("", "ab", "", "x"), 0.0),
])
def test_levenshtein(spark, texts, want):
    assert value(spark, T.levenshtein_sim, *texts) == pytest.approx(want)


def test_lengths_are_bytes(spark):
    assert value(spark, T.position_sim, "b", "éb", "", "") == pytest.approx(1 - 2 / 3)
    assert value(spark, T.text_share, "é", "éa", "", "") == pytest.approx(2 / 3)


def test_jaccard(spark):
    assert value(spark, T.jaccard_chars, "ab", "bc", "", "") == pytest.approx(1 / 3)
    assert value(spark, T.jaccard_chars, "", "", "", "") == 0.0


def test_query_find_and_standalone(spark):
    assert value(spark, T.query_find, "ab", "xab", "zz", "ab c") == 5
    assert value(spark, T.is_standalone, "ab", "x", "ab", "y") == 1


@pytest.mark.parametrize("q, c, want", [
    ("abc", "1abc2", True), ("abc", "xabc", False), ("abc", "abcx", False), ("12", "a12b", True),
    ("12", "312", False), ("a1", "a1", False), ("abc", "zz", False), ("abc", "-abc", True), ("", "1a", False), ("", "a1", True),
])
def test_highlighted(spark, q, c, want):
    assert value(spark, T.is_highlighted, q, c) is want


@pytest.mark.parametrize("q, c, want", [
    ("q", "q", 1.0), ("q", "a-q-b", 0.75), ("q", "a_q_b", 0.75), ("q", "1q2", 0.5), ("q", "aqb", 0.25), ("q", "z", 0.0),
])
def test_name_category(spark, q, c, want):
    assert value(spark, T.name_category, q, c) == want


@pytest.mark.parametrize("q, c, want", [
    ("app", "app", 1.0), ("app", "my app here", 0.833), ("app", "x- app -y", 0.833), ("app", "x#app#y", 0.66),
    ("app", "x#  app  #y", 0.833), ("app", "x#app:y", 0.5), ("app", "x,app,y", 0.333), ("app", "xappy", 0.166),
    ("app", "none", 0.0), ("a.p", "x!a.p!y", 0.66), ("a.p", "x!abp!y", 0.0), ("", "text", 0.166), ("", "1x", 0.166),
])
def test_description_category(spark, q, c, want):
    got = value(spark, T.description_category, q, c)
    if q == "":
        assert got in (0.833, 0.333, 0.166)
    else:
        assert got == want


def test_feature_rows_lower_case_the_description(spark):
    rows = spark.createDataFrame(
        [("App", 1, "Own/APP", "The App", 0, 9, True, False)],
        "query string, rank int, repo_name string, short_description string, star_count long, pull_count long,"
        " is_official boolean, is_automated boolean")
    r = T.feature_rows(rows).first()
    assert (r.repo_owner, r.repo_name, r.short_description) == ("own", "app", "the app")
    assert (r.significant_category, r.query_find, r.is_standalone, r.is_official) == (1.0, 5, 1, 1)


def test_prefix_refine_label(spark):
    rows = spark.createDataFrame(
        [("a", "r1"), ("a", "r2"), ("ab", "r1"), ("b", "r3"), ("bc", "r3"), ("bc", "r4"), ("b-", "r9")],
        "query string, repo_name string").withColumn("short_description", F.lit(""))
    got = {r["query"]: (r["label"], r["entries"]) for r in T.prefix_refine_label(rows).collect()}
    assert got == {"a": (0, 2), "ab": (0, 1), "b": (1, 1), "bc": (0, 2), "b-": (0, 1)}
