import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from regspark.operators import aggregates as A
from regspark.operators import ranking as R
from regspark.operators import sampling as M
from regspark.operators import stats as B


def test_bias_table_one_sided_keys(spark):
    full = spark.createDataFrame([("a", 3), ("b", 1)], "key string, count long")
    sample = spark.createDataFrame([("a", 1), ("c", 1)], "key string, count long")
    got = {r.key: (r.p_full, r.p_sample, r.bias_full_over_sample) for r in B.bias_table(full, sample).collect()}
    assert got == {"a": (0.75, 0.5, 1.5), "b": (0.25, 0.0, math.inf), "c": (0.0, 0.5, 0.0)}
    none = B.bias_table(full.limit(0), sample).collect()
    assert {r.bias_full_over_sample for r in none} == {0.0}


def numpy_bins(full, sample, nbins=20):
    edges = np.unique(np.quantile(full, np.linspace(0, 1, nbins + 1)))
    if len(edges) < 3:
        edges = np.linspace(min(full), max(full), nbins + 1)
    return edges, np.histogram(full, edges)[0], np.histogram(sample, edges)[0]


@pytest.mark.parametrize("full, sample", [
    ([float(i * i % 97) for i in range(400)], [5.0, 96.0, 200.0, -1.0, 40.0]),
    ([1.0] * 50 + [2.0], [1.0, 1.5, 2.0]),
    ([float(i) for i in range(7)], [3.0]),
])
def test_bias_bins_equal_numpy(spark, full, sample):
    frames = [spark.createDataFrame([(v,) for v in values], "v double") for values in (full, sample)]
    got = B.bias_bins(*frames, "v").orderBy("bin_left").collect()
    edges, cf, cs = numpy_bins(full, sample)
    assert [r.bin_left for r in got] == pytest.approx(list(edges[:-1]))
    assert [r.count_full for r in got] == list(cf) and [r.count_sample for r in got] == list(cs)


def test_bias_bins_empty_sample(spark):
    df = spark.createDataFrame([(1.0,), (2.0,)], "v double")
    assert B.bias_bins(df, df.limit(0), "v").count() == 0
    assert B.bias_bins(df.limit(0), df, "v").count() == 0


def test_ks_equals_brute_force(spark):
    rng = random.Random(1)
    a, b = [rng.gauss(0, 1) for _ in range(300)], [rng.gauss(0.3, 1) for _ in range(200)] + [0.0] * 80
    frames = [spark.createDataFrame([(v,) for v in values], "v double") for values in (a, b)]
    got = B.ks_2samp(*frames, "v").first()
    points = np.array(sorted(set(a) | set(b)))
    gap = np.abs(np.searchsorted(np.sort(a), points, side="right") / len(a)
                 - np.searchsorted(np.sort(b), points, side="right") / len(b)).max()
    assert got.statistic == pytest.approx(gap)
    scale = math.sqrt(len(a) * len(b) / (len(a) + len(b))) * gap
    assert got.pvalue == pytest.approx(2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * scale**2) for k in range(1, 50)))


@pytest.mark.parametrize("stat, dof, p", [
    (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (7.814727903251179, 3, 0.05),
    (18.307038053275146, 10, 0.05), (19.675137572682495, 11, 0.05), (0.0, 4, 1.0)])
def test_chi2_tail(spark, stat, dof, p):
    df = spark.createDataFrame([(stat, dof)], "s double, d long")
    assert df.select(B.chi2_sf(F.col("s"), F.col("d"))).first()[0] == pytest.approx(p, abs=1e-9)


def test_chi2_edge_cells(spark):
    def hist(*rows):
        return spark.createDataFrame(list(rows), "key string, count long")

    got = B.chi2_gof(hist(("a", 2), ("b", 2)), hist(("a", 3), ("b", 1))).first()
    assert (got.statistic, got.dof) == (1.0, 1)
    alone = B.chi2_gof(hist(("a", 2)), hist(("a", 3), ("c", 1))).first()
    assert alone.statistic == math.inf and alone.pvalue == 0.0
    assert B.chi2_gof(hist(("a", 0)), hist(("a", 3))).first().statistic is None


def test_weighted_corr(spark):
    rng = random.Random(2)
    rows = [(1.7e9 + rng.random() * 1e6, float(rng.random() < 0.4), rng.random()) for _ in range(200)]
    df = spark.createDataFrame(rows + [(math.inf, 1.0, 1.0), (None, 0.0, 1.0), (5.0, 1.0, 0.0)], "x double, y double, w double")
    x, y, w = map(np.array, zip(*rows))
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    want = np.average((x - mx) * (y - my), weights=w) / math.sqrt(
        np.average((x - mx) ** 2, weights=w) * np.average((y - my) ** 2, weights=w))
    assert B.weighted_corr(df, "x", "y", "w").first().value == pytest.approx(want, rel=1e-7)
    assert B.weighted_corr(df.withColumn("x", F.lit(1.0)), "x", "y", "w").first().value is None
    assert B.weighted_corr(df.limit(0), "x", "y", "w").first().value is None


def test_cramers_v(spark):
    rows = [("a", True, 2.0), ("a", False, 1.0), ("b", False, 4.0), ("c", True, 0.5)]
    df = spark.createDataFrame(rows, "c string, has_secret boolean, weight double")
    t = np.array([[1.0, 2.0], [4.0, 0.0], [0.0, 0.5]])
    e = t.sum(1, keepdims=True) * t.sum(0, keepdims=True) / t.sum()
    want = math.sqrt(((t - e) ** 2 / e).sum() / t.sum())
    assert B.weighted_cramers_v(df, "c").first().value == pytest.approx(want)
    assert B.weighted_cramers_v(df.filter("has_secret"), "c").first().value is None


def test_unique_layer_share_and_weights(spark):
    df = spark.createDataFrame([(["a"], None), (["a", "b"], None), (["a", "b"], 1), ([], None)],
                               "repos array<string>, repo_count int")
    share = A.unique_layer_share(df)
    assert (share.first().total_layers, share.first().unique_layers) == (4, 2)
    w = B.unique_bias_weights(share).first()
    assert (w.w_unique, w.w_nonunique) == (pytest.approx(0.282 / 0.5), pytest.approx(0.718 / 0.5))
    empty = A.unique_layer_share(df.limit(0))
    assert empty.first().unique_share_sample is None and B.unique_bias_weights(empty).first().w_unique == 1.0


def test_repo_counts_over_shared_layers(spark):
    links = spark.createDataFrame([(r, "base") for r in range(40)] + [(r, "top") for r in range(30, 50)] + [(1, "one")],
                                  "repo_id long, layer_id string")
    secrets = spark.createDataFrame([(1, "s1"), (2, "s2"), (3, "s3")], "secret_id long, fragment_hash string")
    occ = spark.createDataFrame([("base", 1), ("top", 1), ("base", 1), ("one", 2), ("lost", 3)], "layer_id string, secret_id long")
    got = sorted(map(tuple, A.secret_repo_layer_counts(secrets, occ, links).collect()))
    assert got == [("s1", 50, 2), ("s2", 1, 1)]
    named = A.repos_per_secret(occ, links, secrets, F.col("fragment_hash") == "s2").collect()
    assert [tuple(r) for r in named] == [("s2", 1)]


# --- ranking --------------------------------------------------------------


def ndcg(labels, scores):
    def dcg(order):
        total, i = 0.0, 0
        for s in sorted(set(order), reverse=True):
            gains = [lab for lab, o in zip(labels, order) if o == s]
            total += sum(1 / math.log2(i + j + 2) for j in range(len(gains))) * sum(gains) / len(gains)
            i += len(gains)
        return total

    return dcg(scores) / dcg(labels)


def ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


@pytest.fixture(scope="module")
def ranked(spark):
    rng = random.Random(9)
    groups = {"hot": 120, "mid": 9, "flat": 6, "tiny": 4}
    rows = [(q, i + 1, n - i, 1.0 if q == "flat" else float(rng.randrange(6)), rng.randrange(3))
            for q, n in groups.items() for i in range(n)]
    return rows, spark.createDataFrame(rows, "query string, rank long, label long, score double, f int")


def test_spearman(ranked):
    rows, df = ranked
    got = {r["query"]: r.spearman for r in R.spearman_per_group(df, "query").collect()}
    assert set(got) == {"hot", "mid"}
    for q, value in got.items():
        mine = [r for r in rows if r[0] == q]
        assert value == pytest.approx(np.corrcoef(ranks([r[1] for r in mine]), ranks([-r[3] for r in mine]))[0, 1])


def test_ndcg(ranked):
    rows, df = ranked
    got = {r["query"]: r.ndcg for r in R.ndcg_per_group(df, "query").collect()}
    for q, value in got.items():
        mine = [r for r in rows if r[0] == q]
        assert value == pytest.approx(ndcg([r[2] for r in mine], [r[3] for r in mine]))


def test_same_score_share(ranked):
    rows, df = ranked
    got = {r["query"]: r.same_score_share for r in R.same_score_share(df, "query", features=["f"]).collect()}
    for q, value in got.items():
        mine = sorted((-r[3], r[4]) for r in rows if r[0] == q)
        near = sum(a[0] == b[0] and a[1] != b[1] for a, b in zip(mine, mine[1:]))
        assert value == pytest.approx(near / len(mine))


def test_dummy_rank_rule(ranked, spark):
    rows, df = ranked
    base = df.withColumn("rank", F.col("rank") - 1).withColumn("dummy_score", F.lit(2.5))
    got = {r["query"]: r for r in R.dummy_rank_rule(base, "query").collect()}
    for q, r in got.items():
        mine = [(row[1] - 1, row[3], 0) for row in rows if row[0] == q]
        n = len(mine)
        order = sorted(mine + [(n, 2.5, 1)], key=lambda x: (-x[1], x[0]))
        d2 = sum((x[0] - i) ** 2 for i, x in enumerate(order) if not x[2])
        rho = max(0.0, 1 - 6 * d2 / (n * (n * n - 1)))
        at = next(i for i, x in enumerate(order) if x[2])
        assert (r.n, r.dummy_position, r.inside) == (n, at, at <= math.floor(rho * (n + 1)))
        assert r.rho == pytest.approx(rho)
    single = spark.createDataFrame([("s", 0, 1.0, 0.0)], "query string, rank long, score double, dummy_score double")
    assert R.dummy_rank_rule(single, "query").first().inside is None


# --- sampling -------------------------------------------------------------


def test_reservoir_is_bounded_and_reproducible(spark):
    df = spark.createDataFrame([(i, None if i % 7 == 0 else i - 20) for i in range(500)], "id long, v long")
    first = {r.id for r in M.reservoir(df, "v", 60, 1, "id").collect()}
    assert len(first) == 60 and first == {r.id for r in M.reservoir(df.repartition(9), "v", 60, 1, "id").collect()}
    assert first != {r.id for r in M.reservoir(df, "v", 60, 2, "id").collect()}
    everything = M.reservoir(df, "v", 10_000, 1, "id").collect()
    assert {r.v for r in everything} == {r.v for r in df.filter("v >= 0").collect()}


def test_stratified_bytes_meets_every_quota(spark):
    rng = random.Random(4)
    rows = [(f"k{i}", 10 ** rng.randrange(6) + rng.randrange(9)) for i in range(3000)] + [("", 5), (None, 5), ("z", 0)]
    df = spark.createDataFrame(rows, "key string, size long")
    target = sum(s for k, s in rows if k) // 5
    out = M.stratified_bytes(df, "size", "key", target)
    kept, total = {}, {}
    for r in out.collect():
        kept.setdefault(r.bucket, []).append(r.size)
    classes = {r.size: r.b for r in df.filter("key <> ''").select("size", M.P.log_bucket(F.col("size")).alias("b")).collect()}
    for k, s in rows:
        if k and s > 0:
            total[classes[s]] = total.get(classes[s], 0) + s
    scale = target / sum(total.values())
    for b, sizes in kept.items():
        quota = total[b] * scale
        assert quota <= sum(sizes) < quota + max(sizes)
    report = M.sample_report(df.filter("key <> ''"), out, "size", target).first()
    assert report.final_bytes == sum(map(sum, kept.values())) and report.target_bytes == target


def test_group_split_keeps_groups_whole(spark):
    df = spark.createDataFrame([(f"q{i % 400}", i) for i in range(2000)], "q string, i int")
    marks = M.group_split(df, "q").groupBy("q").agg(F.countDistinct("is_train").alias("n"), F.max("is_train").alias("t"))
    got = marks.collect()
    assert {r.n for r in got} == {1} and 0.7 < sum(r.t for r in got) / len(got) < 0.9


def test_exact_two_sample_p_equals_enumeration(spark):
    from itertools import combinations

    def gap(first, size):
        n, m, most = len(first), size - len(first), 0.0
        for x in range(size):
            i = sum(f <= x for f in first)
            most = max(most, abs(i / n - (x + 1 - i) / m))
        return most

    for n, m in ((1, 1), (1, 4), (3, 3), (2, 5), (4, 6), (6, 4)):
        gaps = [gap(c, n + m) for c in combinations(range(n + m), n)]
        rows = spark.createDataFrame([(g, n, m) for g in sorted(set(gaps))] + [(0.0, n, m)], "d double, n long, m long")
        for r in rows.select("d", B.ks_exact_p(F.col("d"), F.col("n"), F.col("m")).alias("p")).collect():
            assert r.p == pytest.approx(sum(g >= r.d - 1e-9 for g in gaps) / len(gaps))


def test_two_sample_method_is_chosen_by_size(spark):
    a = spark.createDataFrame([(float(i * 3 % 17),) for i in range(17)], "v double")
    b = spark.createDataFrame([(float(i) + 0.5,) for i in range(5)], "v double")
    exact, plain = (B.ks_2samp(a, b, "v", method=m).first().pvalue for m in ("exact", "asymptotic"))
    assert exact != plain and B.ks_2samp(a, b, "v", method="auto").first().pvalue == exact
    assert B.ks_2samp(a, b, "v", method="auto", most_exact=10).first().pvalue == plain
    assert B.ks_2samp(a.limit(0), b, "v", method="exact").first().pvalue is None
    with pytest.raises(ValueError):
        B.ks_2samp(a, b, "v", method="other")


def test_study_reads_links_and_held_pairs_once(spark):
    """What several results need is stored: only the storing reads the links."""
    from regspark.plans.study import run_study
    from regspark.session import fresh_path

    def table(rows, schema):
        path = fresh_path(spark, "study")
        spark.createDataFrame(rows, schema).write.parquet(path)
        return spark.read.parquet(path)

    links = table([(1, 10), (1, 10), (2, 10), (2, 20), (None, 20), (3, 30)], "repo_id long, layer_id long")
    tables = {
        "repositories": table([(i, i, i, True, False) for i in (1, 2, 3)],
                              "repo_id long, pull_count long, star_count long, is_official boolean, is_automated boolean"),
        "tags": table([(i, i, "2024-01-05 00:00:00", "x") for i in (1, 2, 3)],
                      "tag_id long, repo_id long, last_pushed string, status string"),
        "layers": table([(i, 1, 1, 1) for i in (10, 20, 30)],
                        "layer_id long, max_depth long, file_count long, uncompressed_size long"),
        "repo_layers": links,
        "secrets": table([(1, "a", "t"), (2, "b", "t"), (3, "a", "t")], "secret_id long, fragment_hash string, origin string"),
        "occurrences": table([(10, 1, "f", 1), (10, 3, "f", 1), (20, 1, "f", 1), (20, 2, "f", 1), (99, 2, "f", 1)],
                             "layer_id long, secret_id long, file_type string, file_size long")}
    tables["tags"] = tables["tags"].withColumn("last_pushed", F.col("last_pushed").cast("timestamp"))
    out = run_study(tables)
    sources = set(links.inputFiles())
    assert not any(sources & set(df.inputFiles()) for df in out.values())
    got = sorted((r.fragment_hash, r.repo_count, r.layer_count) for r in out["secret_repo_layer_counts_weighted"].collect())
    assert got == sorted(tuple(r) for r in A.secret_repo_layer_counts(
        tables["secrets"], tables["occurrences"], links).select("fragment_hash", "repo_count", "layer_count").collect())
    assert [r.weighted_layer_count for r in out["secret_repo_layer_counts_weighted"].orderBy("fragment_hash").collect()] == [2.0, 2.0]
