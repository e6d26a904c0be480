from functools import partial

import pytest
from pyspark.sql import functions as F

from regspark.operators import aggregates as A
from regspark.operators import joins as J
from regspark.operators import merge as U
from regspark.plans import importer as I
from regspark.session import stored


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_upsert_replace_last_input_wins(spark):
    old = spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int")
    new = spark.createDataFrame([("a", 5, 1), ("a", None, 2), ("c", 7, 3)], "k string, v int, seq int")
    assert rows(U.upsert_replace(old, new, "k", "seq")) == rows(
        spark.createDataFrame([("a", None), ("b", 2), ("c", 7)], "k string, v int"))


def test_upsert_coalesce_keeps_known_values(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, 2)], "k string, v int, w int")
    new = spark.createDataFrame([("a", None, 4, 1), ("a", 9, None, 2), ("b", None, None, 3)],
                                "k string, v int, w int, seq int")
    assert rows(U.upsert_coalesce(old, new, "k", "seq")) == [("a", 9, 4), ("b", 2, 2)]


def test_insert_ignore(spark):
    old = spark.createDataFrame([(1, 1, "old")], "a int, b int, c string")
    new = spark.createDataFrame([(1, 1, "new"), (1, 2, "new"), (1, 2, "new")], "a int, b int, c string")
    assert rows(U.insert_ignore(old, new, ["a", "b"])) == [(1, 1, "old"), (1, 2, "new")]


def test_surrogate_ids_are_dense_and_stable(spark):
    df = spark.createDataFrame([(f"k{i % 50}",) for i in range(200)], "k string")
    first, again = rows(U.surrogate_ids(df, "k")), rows(U.surrogate_ids(df.repartition(7), "k"))
    assert first == again and sorted(i for _, i in first) == list(range(1, 51))


def test_ensure_missing_adds_minimal_rows(spark):
    target = spark.createDataFrame([("a", 1)], "k string, v int")
    wanted = spark.createDataFrame([("a",), ("b",), ("b",)], "k string")
    assert rows(J.ensure_missing(target, wanted, "k")) == rows(
        spark.createDataFrame([("a", 1), ("b", None)], "k string, v int"))


def test_alias_lookup_prefers_the_exact_name(spark):
    ids = spark.createDataFrame([("nginx", 1), ("library/nginx", 2), ("Redis", 3), ("o/x", 4)], "name string, id int")
    df = spark.createDataFrame([("NGINX ",), ("library/nginx",), ("library/redis",), ("x",), ("library/o/x",)], "n string")
    assert rows(J.alias_lookup(df, "n", ids, "name", "id", "n")) == rows(spark.createDataFrame(
        [("NGINX ", 1), ("library/nginx", 2), ("library/redis", 3), ("x", None), ("library/o/x", 4)], "n string, i int"))


def test_alias_semi(spark):
    listed = spark.createDataFrame([("Library/nginx",), ("o/x",)], "n string")
    df = spark.createDataFrame([("nginx",), ("library/nginx",), ("x",), ("library/o/x",), ("z",)], "n string")
    assert rows(J.alias_semi(df, "n", listed, "n", "n")) == [("library/nginx",), ("library/o/x",), ("nginx",)]


@pytest.mark.parametrize("rows_per_task", [2, 1000])
def test_alias_joins_of_long_lists(spark, monkeypatch, rows_per_task):
    """The lists are too long to broadcast; with two rows a task, names are split as well."""
    monkeypatch.setattr(J, "is_short", lambda df: False)
    monkeypatch.setattr(J, "spread_join", partial(J.spread_join, rows_per_task=rows_per_task))
    names = [("d1", " nginx"), ("d2", "NGINX"), ("d3", "library/nginx"), ("d4", "nginx "), ("d5", "x"), ("d6", None)]
    df = spark.createDataFrame(names, "d string, n string")
    ids = spark.createDataFrame([("Nginx", 1), ("o/x", 2)], "name string, id int")
    assert rows(J.alias_lookup(df, "n", ids, "name", "id", "d")) == [
        ("d1", " nginx", 1), ("d2", "NGINX", 1), ("d3", "library/nginx", 1), ("d4", "nginx ", 1),
        ("d5", "x", None), ("d6", None, None)]
    assert rows(J.alias_semi(df, "n", ids, "name", "d")) == names[:4]
    sel = df.groupBy("d").agg(F.collect_list("n").alias("repos")).withColumnRenamed("d", "digest")
    layers = spark.createDataFrame([(f"d{i}", i) for i in range(1, 5)], "digest string, layer_id int")
    found, missing = J.link_pairs(sel, ids.select(F.col("id").alias("repo_id"), F.col("name").alias("repo_name")), layers)
    assert rows(found) == [(1, 1), (1, 2), (1, 3), (1, 4)] and rows(missing) == [("d5", "x")]


def test_bin_weight_edges(spark):
    inf, nan = float("inf"), float("nan")
    bins = spark.createDataFrame([(0.0, 1.0, 2.0), (1.0, 2.0, inf), (2.0, 3.0, 0.5)],
                                 "bin_left double, bin_right double, bias_full_over_sample double")
    df = spark.createDataFrame([(v,) for v in (0.0, 1.0, 1.5, 2.0, 3.0, 3.1, -1.0, None, nan, inf)], "v double")
    got = [r.weight for r in J.bin_weight(df, "v", bins).collect()]
    assert got == [2.0, 1.0, 1.0, 0.5, 0.5, 1.0, 1.0, 1.0, 1.0, 1.0]
    empty = J.bin_weight(df, "v", bins.limit(0)).collect()
    assert {r.weight for r in empty} == {1.0}


def test_map_weight_defaults(spark):
    table = spark.createDataFrame([("a", 2.0), ("b", float("nan"))], "key string, bias_full_over_sample double")
    df = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "c string")
    got = {r.c: r.weight for r in J.map_weight(df, "c", table).collect()}
    assert got == {"a": 2.0, "b": 1.0, "c": 1.0, None: 1.0}


def _inputs(spark):
    good, other = "sha256:" + "a" * 64, "sha256:" + "b" * 64
    selection = spark.createDataFrame(
        [("L1", 10, ["nginx", " Own/App ", ""], 1), ("L1", 11, ["library/nginx", "Own/App"], 2), (" L2 ", 20, ["ghost"], 3)],
        "digest string, size long, repos array<string>, seq long")
    repos = spark.createDataFrame(
        [("nginx", "lib", "d1", False, True, 5, 1, 1), ("nginx", "lib", "d2", False, True, 6, 1, 2),
         ("own/app", "own", "", True, False, 7, 1, 3), ("else/where", "e", "", False, False, 1, 1, 4)],
        "repo_name string, repo_owner string, short_description string, is_automated boolean, is_official boolean,"
        " pull_count long, star_count long, seq long")
    tags = spark.createDataFrame(
        [("library/nginx", good.upper(), "amd64", "", 1, "", "", "2024-01-01T00:00:00Z", 1),
         ("nginx", good, "amd64", "linux", 2, "active", "bad", "2024-01-02T00:00:00Z", 2),
         ("nginx", "sha256:short", "amd64", "linux", 2, "active", "", "", 3),
         ("else/where", other, "amd64", "linux", 2, "active", "", "", 4)],
        "repo_name string, digest string, architecture string, os string, size long, status string,"
        " last_pulled string, last_pushed string, seq long")
    layers = spark.createDataFrame(
        [("L1", 3, None, 100, ["h1", "h1", "h2"], 1), ("L1", None, 4, None, None, 2), ("LX", 1, 1, 1, ["h1"], 3)],
        "digest string, file_count int, max_depth int, uncompressed_size long, secrets array<string>, seq long")
    secrets = spark.createDataFrame(
        [(" h1 ", ("etc/a", ".a", None, "rule\x00", "s\x00one", 1), 1), ("h1", ("etc/b", ".b", 5, "rule2", "two", 2), 2),
         ("h9", ("etc/c", ".c", 5, "r", "x", 2), 3), ("", ("etc/d", ".d", 5, "r", "x", 2), 4)],
        "fragment_hash string, secrets struct<file string, file_type string, file_size long, origin string,"
        " secret string, start_line int>, seq long")
    return selection, repos, tags, layers, secrets


def test_import_all(spark):
    out = I.import_all(*_inputs(spark))
    repos = {r.repo_name: r for r in out["repositories"].collect()}
    assert set(repos) == {"nginx", "own/app", "ghost"}
    assert repos["nginx"].short_description == "d2" and repos["ghost"].pull_count is None
    layers = {r.digest: r.asDict() for r in out["layers"].collect()}
    assert layers["L1"] == {"digest": "L1", "file_count": 3, "max_depth": 4, "uncompressed_size": 100,
                            "compressed_size": 11}
    assert layers["L2"]["compressed_size"] == 20 and layers["L2"]["file_count"] is None and "LX" not in layers
    assert rows(out["repo_layers"]) == [("ghost", "L2"), ("nginx", "L1"), ("own/app", "L1")]
    assert out["unresolved"].count() == 0
    [tag] = out["tags"].collect()
    assert (tag.repo_name, tag.os, tag.status, tag.size, tag.last_pulled) == ("nginx", "linux", "active", 2, None)
    assert rows(out["secrets"].select("fragment_hash", "origin", "secret")) == [("h1", "rule2", "two")]
    assert rows(out["occurrences"].select("digest", "fragment_hash", "file")) == [
        ("L1", "h1", "etc/a"), ("L1", "h1", "etc/b")]


def test_import_secrets_only_needs_known_layers(spark):
    selection, _, _, layers, secrets = _inputs(spark)
    known = spark.createDataFrame([("L2",)], "digest string")
    out = I.import_secrets_only(selection, layers, known, secrets)
    assert out["occurrences"].count() == 0
    both = I.import_secrets_only(selection, layers, known.unionByName(selection.select("digest")), secrets)
    assert both["occurrences"].count() == 2


def test_links_repeat_only_within_a_row(spark):
    """Two names of a row may stand for one repository; names known to none are told, null ones too."""
    selection = spark.createDataFrame(
        [("sha256:" + "a" * 64, ["nginx", "library/nginx", "Own/App"]), ("d2", ["own/app", " OWN/APP", "nginx"]),
         ("d3", ["gone", "own/app"]), ("d4", []), ("d5", ["library/nginx"])], "digest string, repos array<string>")
    repos = spark.createDataFrame([("nginx",), ("own/app",)], "repo_name string")
    want = [("nginx", "d2"), ("nginx", "d5"), ("nginx", "sha256:" + "a" * 64), ("own/app", "d2"), ("own/app", "d3"),
            ("own/app", "sha256:" + "a" * 64)]
    links, unresolved = I.import_links(selection, repos, is_clean=True)
    assert rows(links) == want and rows(unresolved) == [("d3", "gone")]
    twice = selection.unionByName(selection).unionByName(
        spark.createDataFrame([("d6", [None, "gone"])], selection.schema))
    links, unresolved = I.import_links(twice, repos)
    assert rows(links) == want
    assert rows(unresolved) == [("d3", "gone"), ("d3", "gone"), ("d6", "gone"), ("d6", None)]


@pytest.mark.parametrize("rows_per_task", [1, 1000])
def test_import_of_long_lists(spark, monkeypatch, rows_per_task):
    """No list is short enough to broadcast; with one row a task, every name is split as well."""
    want = {name: rows(df) for name, df in I.import_all(*_inputs(spark)).items()}
    monkeypatch.setattr(J, "is_short", lambda df: False)
    monkeypatch.setattr(J, "spread_join", partial(J.spread_join, rows_per_task=rows_per_task))
    assert {name: rows(df) for name, df in I.import_all(*_inputs(spark)).items()} == want


def test_missing_rows_of_a_target_computed_once(spark):
    target = spark.createDataFrame([("a", 1), ("a", None), (None, 3)], "k string, v int")
    wanted = spark.createDataFrame([("a", 7, "x"), ("b", 8, "y"), ("b", 8, "y"), (None, 9, "z"), (None, 9, "z")],
                                   "k string, v int, w string")
    once = J.ensure_missing(target, wanted, "k", once=True)
    assert rows(once) == rows(J.ensure_missing(target, wanted, "k"))
    assert sorted(once.columns) == ["k", "v", "w"] and once.count() == 5


def test_last_row_keeps_its_order(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, "x"), ("b", None, "y"), (None, 3, "z")],
                               "k string, seq int, v string")
    assert rows(U.latest(df, "k", "seq")) == sorted([("a", 2, "x"), ("b", None, None), (None, 3, "z")], key=repr)
    assert U.latest(df, "k", "seq").columns == ["k", "seq", "v"]


def _shuffled(spark) -> int:
    blocks = spark.sparkContext._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
    return sum(f.length() for f in (blocks.apply(i) for i in range(blocks.size())) if f.getName().startswith("shuffle_"))


def test_stored_frames_give_back_what_they_shuffled(spark):
    before = _shuffled(spark)
    kept = stored(spark.range(20000).withColumn("h", F.md5(F.col("id").cast("string"))).repartition(4, "h"))
    assert _shuffled(spark) <= before and kept.count() == 20000


def test_import_shuffles_few_bytes_a_layer(spark):
    """Digests are shuffled as bytes, and neither the lines of layers nor the pairs of names and digests twice."""
    n, sha = 20000, lambda c: F.concat(F.lit("sha256:"), F.sha2(c.cast("string"), 256))
    ids = spark.range(n).select(F.col("id"), sha(F.col("id")).alias("digest"), F.col("id").alias("seq"))
    name = F.concat(F.lit("owner/app"), (F.col("id") % 5000).cast("string"))
    selection = ids.select("digest", F.lit(1).cast("long").alias("size"), F.array(name).alias("repos"), "seq")
    repos = spark.range(5000).select(
        name.alias("repo_name"), F.lit("o").alias("repo_owner"), F.lit("").alias("short_description"),
        F.lit(False).alias("is_automated"), F.lit(False).alias("is_official"), F.lit(1).alias("pull_count"),
        F.lit(1).alias("star_count"), F.col("id").alias("seq"))
    tags = ids.select(name.alias("repo_name"), "digest", F.lit("").alias("architecture"), F.lit("").alias("os"),
                      F.lit(1).alias("size"), F.lit("").alias("status"), F.lit("").alias("last_pulled"),
                      F.lit("").alias("last_pushed"), "seq")
    fragment = F.substr(F.md5((F.col("id") % 100).cast("string")), F.lit(1), F.lit(16))
    lines = ids.select("digest", F.lit(1).alias("file_count"), F.lit(1).alias("max_depth"),
                       F.lit(1).cast("long").alias("uncompressed_size"), F.array(fragment).alias("secrets"), "seq")
    records = spark.range(100).select(
        fragment.alias("fragment_hash"), F.struct(
            F.lit("f").alias("file"), F.lit("").alias("file_type"), F.lit(1).cast("long").alias("file_size"),
            F.lit("o").alias("origin"), F.lit("s").alias("secret"), F.lit(1).alias("start_line")).alias("secrets"),
        F.col("id").alias("seq"))
    before = _shuffled(spark)
    tables = I.import_all(selection, repos, tags, lines, records)
    whole = A.union_all(*(df.select(F.lit(t).alias("t"), F.xxhash64(*df.columns).alias("h")) for t, df in tables.items()))
    counts = {r.t: r["count"] for r in whole.groupBy("t").count().collect()}
    assert counts == {"repositories": 5000, "layers": n, "repo_layers": n, "tags": n, "secrets": 100, "occurrences": n}
    assert (_shuffled(spark) - before) / n < 220


def test_secret_occurrences_joins_every_layer(spark):
    reach = spark.createDataFrame([("h", i) for i in range(30)] + [("g", 1)], "fragment_hash string, layer_id int")
    records = spark.createDataFrame([(" h", "a"), ("h ", "b"), ("x", "c"), ("", "d")], "fragment_hash string, file string")
    assert J.secret_occurrences(records, reach).count() == 60


def test_has_secret_and_links(spark):
    repos = spark.createDataFrame([(1, "a"), (2, "b")], "repo_id long, repo_name string")
    links = spark.createDataFrame([(1, 10), (2, 20)], "repo_id long, layer_id long")
    occ = spark.createDataFrame([(10,), (10,)], "layer_id long")
    assert rows(J.has_secret(repos, links, occ).select("repo_id", "has_secret")) == [(1, True), (2, False)]
    sel = spark.createDataFrame([("d1", ["a", "A", "nope"]), ("d9", ["b"])], "digest string, repos array<string>")
    layers = spark.createDataFrame([("d1", 7)], "digest string, layer_id long")
    found, missing = J.link_pairs(sel, repos, layers)
    assert rows(found) == [(1, 7)] and rows(missing) == [("d1", "nope"), ("d9", "b")]
