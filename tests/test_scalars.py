import math

import pytest
from pyspark.sql import functions as F

from regspark.functions import scalars as P


def column(spark, values, kind, expression):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(expression(F.col("v"))).collect()]


def test_aliases(spark):
    got = column(spark, [" Library/Nginx ", "nginx", "a/b", "library/a/b"], "string", P.expand_aliases)
    assert got == [["library/nginx", "nginx"], ["nginx", "library/nginx"], ["a/b"], ["library/a/b", "a/b"]]


def test_packed_digests_are_shorter_and_lose_nothing(spark):
    sha = "sha256:" + "0123456789abcdef" * 4
    odd = ["", "sha256:", "0", "00", "000", "0a", "0A", "sha256:0A", "sha256:0a", "sha256:0", "sha256:0a\n", "0a\n", "x", "é",
           "\x00", "\x01", "\x02", "\x010a", "sha256:sha256:0a", " 0a", "0g", "SHA256:0a", sha, sha[:-1], sha + "0", sha + "\n",
           sha.upper(), sha[:70] + "F", sha[:70] + "g", sha[:69] + "é", " " + sha, sha[7:], None]
    assert column(spark, odd, "string", lambda c: P.unpack_digest(P.pack_digest(c))) == odd
    packed = [v if v is None else bytes(v) for v in column(spark, odd, "string", P.pack_digest)]
    assert len(set(packed)) == len(odd) and len(packed[odd.index(sha)]) == 33


def test_reverse_aliases_agree_with_aliases(spark):
    names = ["nginx", "library/nginx", "a/b", "library/a/b", "library/library/x", "library/x"]
    forward = dict(zip(names, column(spark, names, "string", P.expand_aliases)))
    reverse = dict(zip(names, column(spark, names, "string", P.aliased_by)))
    for n in names:
        for r in names:
            if n != r:
                assert (r in forward[n]) == (n in reverse[r]), (n, r)


@pytest.mark.parametrize("text, micros", [
    ("2024-02-03T04:05:06Z", 1706933106000000),
    (" 2024-02-03T04:05:06.123456789Z ", 1706933106123456),
    ("2024-02-03T04:05:06+02:00", 1706925906000000),
    ("2024-02-03 04:05:06-01:30", 1706938506000000),
    ("2024-02-03T04:05:06", None), ("2024-02-03", None), ("2024-02-30T00:00:00Z", None), ("", None), ("x", None),
])
def test_parse_ts(spark, text, micros):
    assert column(spark, [text], "string", lambda c: F.unix_micros(P.parse_ts(c))) == [micros]


def test_epoch_floors_before_1970(spark):
    got = column(spark, [-1_500_000], "bigint", lambda c: P.epoch_seconds(F.timestamp_micros(c)))
    assert got == [-2]


def test_positive_size(spark):
    got = column(spark, ["0", "-1", "2.5", "0.3", "1", "1e3", "9223372036854775807", "x", None], "string", P.positive_size)
    assert got == [None, None, 3, 0, 1, 1000, 9223372036854775807, None, None]


def test_log_bucket(spark):
    sizes = [0, 1, 2, 17, 18, 10**10, 10**10 + 1, 2**63 - 1]
    assert column(spark, sizes, "bigint", P.log_bucket) == [0, 0, 1, 1, 2, 8, 9, 9]


def test_digest_name_and_text_cleaning(spark):
    good = "a" * 64
    assert column(spark, [f" SHA256:{good.upper()} ", "sha256:12", None], "string", P.valid_digest) == [True, False, False]
    assert column(spark, ["a\x00b\x00"], "string", P.strip_nul) == ["ab"]
    assert column(spark, [None, "", "  ", " x "], "string", P.blank_to_unknown) == ["unknown", "unknown", "unknown", "x"]
    assert column(spark, ["", "  "], "string", lambda c: P.blank_to_unknown(c, trim=False)) == ["unknown", "  "]


def test_paths(spark):
    names = ["a/b/c.tar.gz", "noext", ".env", "a.b/c"]
    assert column(spark, names, "string", P.file_ext) == [".gz", "", ".env", ""]
    assert column(spark, names, "string", P.path_depth) == [3, 1, 1, 2]


def test_origin_category_first_rule_wins(spark):
    names = ["SSH token", "github-pat", "stripe", "db_password", "thing", None]
    assert column(spark, names, "string", P.origin_category) == [
        "Private Keys", "Tokens", "Cloud/API Keys", "Credentials", "Other", "Other"]


def test_combined_weight(spark):
    values = [2.0, math.inf, -math.inf, math.nan, -3.0, 1000.0, None]
    got = column(spark, values, "double", lambda c: P.combined_weight(c, F.lit(1.0)))
    assert got == [2.0, 1.0, 1.0, 1.0, 0.0, 100.0, 1.0]


def test_owner_and_name(spark):
    got = column(spark, ["Own/Repo", "Single", "a/b/c"], "string", P.split_owner_name)
    assert [tuple(r) for r in got] == [("own", "repo"), ("single", ""), ("a", "b")]


def test_date_range(spark):
    rows = spark.createDataFrame([("2015-12",), ("2016-01",), ("2025-12",), ("2026-01",), ("bad",), (None,)], "m string")
    assert sorted(r.m for r in P.date_range_filter(rows, "m").collect()) == ["2016-01", "2025-12"]


def test_platform_filter(spark):
    rows = spark.createDataFrame(
        [("a", [("amd64", "linux", 1), ("arm64", "linux", 2)]), ("b", [("arm64", "linux", 3)])],
        "repo string, images array<struct<architecture string, os string, size int>>")
    assert [tuple(r) for r in P.platform_filter(rows, "images").select("repo", "size").collect()] == [("a", 1)]
