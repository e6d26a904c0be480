"""Sample against population: bias tables, distribution tests, correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators.aggregates import FULL_UNIQUE_SHARE, contingency, union_all
from regspark.operators.joins import bin_weight, has_secret, key_union, map_weight, one_random_tag
from regspark.operators.running import (
    bin_index,
    one_row,
    quantiles_of_counts,
    running,
    running_sum,
    value_counts,
)
from regspark.session import cut_lineage

INF = float("inf")


def _ratio(p_full: Column, p_sample: Column) -> Column:
    return (
        F.when(p_sample > 0, F.try_divide(p_full, p_sample))
        .when(p_full > 0, F.lit(INF)).otherwise(F.lit(1.0))
    )


def _with_shares(counts: DataFrame) -> DataFrame:
    n = one_row(counts.agg(F.sum("count_full").alias("full"), F.sum("count_sample").alias("sample")))
    shares = counts.select(
        "*",
        F.coalesce(F.try_divide("count_full", n["full"]), F.lit(0.0)).alias("p_full"),
        F.coalesce(F.try_divide("count_sample", n["sample"]), F.lit(0.0)).alias("p_sample"))
    return shares.withColumn("bias_full_over_sample", _ratio(F.col("p_full"), F.col("p_sample")))


def bias_table(full: DataFrame, sample: DataFrame, key: str = "key") -> DataFrame:
    """Per key: counts and shares in population and sample, and their ratio.
    The joined counts are stored, so that the totals do not count again."""
    return _with_shares(cut_lineage(key_union(full, sample, key)))


def bias_bins_of_counts(full: DataFrame, sample: DataFrame, nbins: int = 20) -> DataFrame:
    """``bias_bins`` from stored (value, n) histograms."""
    probs = [i / nbins for i in range(nbins + 1)]
    q = quantiles_of_counts(full, probs).agg(F.array_sort(F.collect_set("value")).alias("q"))
    lo, hi = F.get("q", F.lit(0)), F.try_element_at("q", F.lit(-1))
    even = F.transform(F.sequence(F.lit(0), F.lit(nbins)), lambda i: lo + (hi - lo) * i / F.lit(float(nbins)))
    edges = cut_lineage(q.filter(F.size("q") > 0).select(
        F.when(F.size("q") >= 3, F.col("q")).otherwise(even).alias("e")))
    zero = F.lit(0).cast("long")
    both = union_all(full.select("value", F.col("n").alias("f"), zero.alias("s")),
                     sample.select("value", zero.alias("f"), F.col("n").alias("s")))
    last = F.size("e") - 1
    placed = both.withColumn("e", edges.scalar()).filter(
        (F.col("value") >= F.col("e")[0]) & (F.col("value") <= F.col("e")[last])
    ).withColumn("_i", F.least(bin_index(F.col("value"), F.col("e"), nbins + 1), last) - 1)
    binned = placed.groupBy("_i").agg(F.sum("f").alias("count_full"), F.sum("s").alias("count_sample"))
    frame = edges.select(F.posexplode(F.arrays_zip(
        F.slice("e", F.lit(1), F.size("e") - 1).alias("l"),
        F.slice("e", F.lit(2), F.size("e") - 1).alias("r"))).alias("_i", "b")).select(
        "_i", F.col("b.l").alias("bin_left"), F.col("b.r").alias("bin_right"))
    counted = cut_lineage(frame.join(binned, "_i", "left").select(
        "bin_left", "bin_right", F.coalesce("count_full", F.lit(0)).alias("count_full"),
        F.coalesce("count_sample", F.lit(0)).alias("count_sample")))
    some = sample.agg(F.count(F.lit(1))).scalar()
    return _with_shares(counted.filter(some > 0))


def bias_bins(full: DataFrame, sample: DataFrame, c: str, nbins: int = 20) -> DataFrame:
    """Bias over bins between exact quantiles of the population (equal-width
    bins where fewer than three edges differ). Sample values outside the edges
    are left out, also from the shares."""
    return bias_bins_of_counts(cut_lineage(value_counts(full, F.col(c))),
                               cut_lineage(value_counts(sample, F.col(c))), nbins)


def quantile_series_of_counts(counts: DataFrame, name: str, n: int = 21) -> DataFrame:
    probs = [i / (n - 1) for i in range(n)]
    return quantiles_of_counts(counts, probs).select("quantile", "value", F.lit(name).alias("series"))


def quantile_series(df: DataFrame, c: str, name: str, n: int = 21) -> DataFrame:
    return quantile_series_of_counts(cut_lineage(value_counts(df, F.col(c))), name, n)


def unique_bias_weights(share: DataFrame, full: float = FULL_UNIQUE_SHARE) -> DataFrame:
    """Weights of unique and shared layers from a one-row share frame."""
    s = F.col("unique_share_sample")
    f = F.coalesce("unique_share_full_reference", F.lit(full)) \
        if "unique_share_full_reference" in share.columns else F.lit(full)
    proper = (s > 0) & (s < 1)
    return share.select(
        F.when(proper, f / s).otherwise(F.lit(1.0)).alias("w_unique"),
        F.when(proper, (1 - f) / (1 - s)).otherwise(F.lit(1.0)).alias("w_nonunique"),
        f.alias("f_unique"), F.when(proper, s).alias("s_unique"))


def kolmogorov_sf(x: Column, terms: int = 60) -> Column:
    """Upper tail of the Kolmogorov distribution; 1 near zero, where the
    alternating series does not settle."""
    series = F.lit(0.0)
    for k in range(1, terms + 1):
        series = series + F.lit(2.0 * (-1) ** (k - 1)) * F.exp(F.lit(-2.0 * k * k) * x * x)
    return F.when(x < 0.2, F.lit(1.0)).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_exact_p(statistic: Column, n: Column, m: Column) -> Column:
    """Probability that two samples of sizes ``n`` and ``m`` from one distribution
    without ties differ by at least ``statistic``.

    Merging the samples is a walk over a lattice. ``touched[i]`` is the probability
    that a walk to (i, k - i) has met a point as far off the diagonal as the
    statistic; a step comes from the first sample with probability i / k. Values
    stay between 0 and 1, so small tails keep their digits. Takes n * m steps.
    """
    a, b = F.least(n, m).cast("long"), F.greatest(n, m).cast("long")
    bound = F.round(statistic * a * b).cast("long")

    def at(i: Column, j: Column, inside: Column) -> Column:
        return F.when((j < 0) | (j > b), F.lit(0.0)).when(F.abs(i * b - j * a) >= bound, F.lit(1.0)).otherwise(inside)

    places = F.sequence(F.lit(0).cast("long"), a)
    start = F.transform(places, lambda i: F.when((i == 0) & (bound <= 0), F.lit(1.0)).otherwise(F.lit(0.0)))
    last = F.aggregate(F.sequence(F.lit(1).cast("long"), a + b), start, lambda touched, k: F.transform(
        places, lambda i: at(i, k - i, (i * F.coalesce(F.get(touched, i - 1), F.lit(0.0))
                                        + (k - i) * F.get(touched, i)) / k)))
    return F.get(last, a)


def ks_of_counts(a: DataFrame, b: DataFrame, method: str = "asymptotic", most_exact: int = 10_000) -> DataFrame:
    """``ks_2samp`` from (value, n) histograms."""
    if method not in ("asymptotic", "exact", "auto"):
        raise ValueError("method must be asymptotic, exact or auto")
    zero = F.lit(0).cast("long")
    counts = cut_lineage(union_all(
        a.select("value", F.col("n").alias("na"), zero.alias("nb")),
        b.select("value", zero.alias("na"), F.col("n").alias("nb")),
    ).groupBy("value").agg(F.sum("na").alias("na"), F.sum("nb").alias("nb")))
    totals = one_row(counts.agg(F.sum("na").alias("a"), F.sum("nb").alias("b")))
    run = running(counts, [], F.col("value"),
                  {"ca": running_sum(F.col("na")), "cb": running_sum(F.col("nb"))})
    gaps = run.withColumn("t", totals).filter((F.col("t.a") > 0) & (F.col("t.b") > 0))
    found = gaps.agg(
        F.max(F.abs(F.col("ca") / F.col("t.a") - F.col("cb") / F.col("t.b"))).alias("statistic"),
        F.max("t.a").alias("n_full"), F.max("t.b").alias("n_sample"))
    scale = F.sqrt(F.col("n_full").cast("double") * F.col("n_sample") / (F.col("n_full") + F.col("n_sample")))
    p = kolmogorov_sf(scale * F.col("statistic"))
    if method != "asymptotic":
        exact = ks_exact_p(F.col("statistic"), F.col("n_full"), F.col("n_sample"))
        small = F.lit(True) if method == "exact" else F.greatest("n_full", "n_sample") <= most_exact
        p = F.when(F.col("statistic").isNull(), F.lit(None)).when(small, exact).otherwise(p)
    return found.withColumn("pvalue", p)


def ks_2samp(a: DataFrame, b: DataFrame, c: str, c_b: str | None = None, method: str = "asymptotic",
             most_exact: int = 10_000) -> DataFrame:
    """Two-sample Kolmogorov-Smirnov statistic with its p-value: the asymptotic
    one, the ``exact`` one, or (``auto``) the exact one where no sample has more than
    ``most_exact`` values. Values are counted first; only distinct values are
    ordered, in chunks."""
    return ks_of_counts(value_counts(a, F.col(c)), value_counts(b, F.col(c_b or c)), method, most_exact)


def _erfc(z: Column, terms: int = 150) -> Column:
    """Complementary error function from the all-positive series of erf."""
    def step(acc: Column, n: Column) -> Column:
        term = acc["term"] * 2.0 * z * z / (2.0 * n + 1.0)
        return F.struct(term.alias("term"), (acc["total"] + term).alias("total"))

    total = F.aggregate(F.sequence(F.lit(1), F.lit(terms)),
                        F.struct(z.alias("term"), z.alias("total")), step, lambda acc: acc["total"])
    erf = F.lit(2.0 / math.sqrt(math.pi)) * F.exp(-z * z) * total
    return F.when(z > 6, F.lit(0.0)).otherwise(F.greatest(1.0 - erf, F.lit(0.0)))


def chi2_sf(stat: Column, dof: Column) -> Column:
    """Upper tail of the chi-squared distribution for whole degrees of freedom,
    by its finite sum, added up from logarithms."""
    h = stat / 2.0
    m = F.floor(dof / 2).cast("int")
    odd = F.pmod(dof.cast("int"), F.lit(2)) == 1

    def tail(first: Column, shift: float, count: Column) -> Column:
        def step(acc: Column, i: Column) -> Column:
            log_term = acc["log"] + F.ln(h) - F.ln(i - F.lit(shift))
            return F.struct(log_term.alias("log"), (acc["total"] + F.exp(log_term)).alias("total"))

        more = F.when(count > 1, F.sequence(F.lit(1) + F.lit(1 if shift else 0), count - 1 + F.lit(1 if shift else 0)))
        start = F.struct(first.alias("log"), F.exp(first).alias("total"))
        return F.when(count < 1, F.lit(0.0)).otherwise(F.aggregate(
            F.coalesce(more, F.array().cast("array<int>")), start, step, lambda acc: acc["total"]))

    even_tail = tail(-h, 0.0, m)
    odd_tail = _erfc(F.sqrt(h)) + tail(-h + 0.5 * F.ln(h) - F.lit(math.lgamma(1.5)), 0.5, m)
    value = F.when(odd, odd_tail).otherwise(even_tail)
    return (
        F.when(stat.isNull() | F.isnan(stat) | (dof < 1), F.lit(None).cast("double"))
        .when(stat <= 0, F.lit(1.0)).when(stat == F.lit(INF), F.lit(0.0))
        .otherwise(F.least(value, F.lit(1.0)))
    )


def chi2_statistic(full: DataFrame, sample: DataFrame, key: str = "key") -> DataFrame:
    """Goodness of fit of the sample counts to the population's shares, over
    the union of keys. Keys empty on both sides add nothing; a key seen only in
    the sample makes the statistic infinite; null without any expectation."""
    cells = cut_lineage(key_union(full, sample, key))
    n = one_row(cells.agg(F.sum("count_full").alias("full"), F.sum("count_sample").alias("sample")))
    expected = F.try_divide(F.col("count_full").cast("double"), n["full"]) * n["sample"]
    o = F.col("count_sample").cast("double")
    part = (
        F.when(F.col("e") > 0, (o - F.col("e")) * (o - F.col("e")) / F.nullif(F.col("e"), F.lit(0.0)))
        .when(o > 0, F.lit(INF)).otherwise(F.lit(0.0))
    )
    summed = cells.withColumn("e", expected).agg(
        F.sum(part).alias("_s"), F.sum("e").alias("_e"), (F.count(F.lit(1)) - 1).alias("dof"))
    return summed.select(F.when(F.col("_e") > 0, F.col("_s")).alias("statistic"), "dof")


def chi2_gof(full: DataFrame, sample: DataFrame, key: str = "key") -> DataFrame:
    found = chi2_statistic(full, sample, key)
    return found.withColumn("pvalue", chi2_sf(F.col("statistic"), F.col("dof")))


def _finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def weighted_corrs(df: DataFrame, xs: dict[str, Column], y: Column, w: Column) -> DataFrame:
    """Weighted Pearson correlation of several columns with ``y`` as rows
    (variable, value), null where undefined. All weighted means come from one
    pass and the squares around them from a second one."""
    names = list(xs)
    rows = df.select(*(xs[n].cast("double").alias(f"x_{n}") for n in names),
                     y.cast("double").alias("y"), w.cast("double").alias("w"))
    usable = _finite(F.col("y")) & _finite(F.col("w")) & (F.col("w") > 0)
    rows = rows.filter(usable)

    def weight(n: str) -> Column:
        return F.when(_finite(F.col(f"x_{n}")), F.col("w"))

    means = one_row(rows.agg(*(part for n in names for part in (
        F.try_divide(F.sum(weight(n) * F.col(f"x_{n}")), F.sum(weight(n))).alias(f"mx_{n}"),
        F.try_divide(F.sum(weight(n) * F.col("y")), F.sum(weight(n))).alias(f"my_{n}")))))
    centred = rows.withColumn("m", means)

    def sums(n: str) -> list[Column]:
        dx, dy = F.col(f"x_{n}") - F.col(f"m.mx_{n}"), F.col("y") - F.col(f"m.my_{n}")
        return [F.count(weight(n)).alias(f"n_{n}"), F.sum(weight(n) * dx * dx).alias(f"vx_{n}"),
                F.sum(weight(n) * dy * dy).alias(f"vy_{n}"), F.sum(weight(n) * dx * dy).alias(f"c_{n}")]

    def value(n: str) -> Column:
        defined = (F.col(f"n_{n}") > 1) & (F.col(f"vx_{n}") > 0) & (F.col(f"vy_{n}") > 0)
        return F.when(defined, F.col(f"c_{n}") / F.sqrt(F.when(defined, F.col(f"vx_{n}") * F.col(f"vy_{n}"))))

    summed = centred.agg(*(c for n in names for c in sums(n)))
    return summed.select(F.inline(F.array(*(
        F.struct(F.lit(n).alias("variable"), value(n).alias("value")) for n in names))))


def weighted_corr(df: DataFrame, x: str | Column, y: str | Column, w: str | Column) -> DataFrame:
    """Weighted Pearson correlation in one row, null where undefined."""
    x, y, w = (F.col(c) if isinstance(c, str) else c for c in (x, y, w))
    return weighted_corrs(df, {"x": x}, y, w).select("value")


def weighted_cramers_v(df: DataFrame, cat: str, flag: str = "has_secret", w: str = "weight") -> DataFrame:
    """Cramer's V of a weighted category-by-flag table in one row. The flag has
    two columns, so empty cells are explicit and no marginals are crossed. The
    table, one row per category, is stored."""
    held = F.col(flag)
    table = cut_lineage(contingency(df, cat, flag, w, F.count_if(~held).alias("n0"), F.count_if(held).alias("n1"))
                        .withColumnsRenamed({f"{flag}=False": "w0", f"{flag}=True": "w1"}))
    totals = one_row(table.agg(F.sum("w0").alias("c0"), F.sum("w1").alias("c1")))

    def part(cell: str, column: str) -> Column:
        all_weight = F.nullif(F.col("t.c0") + F.col("t.c1"), F.lit(0.0))
        e = (F.col("w0") + F.col("w1")) * F.col(f"t.{column}") / all_weight
        gap = F.col(cell) - e
        return F.when(e != 0, gap * gap / F.nullif(e, F.lit(0.0))).otherwise(F.lit(0.0))

    chi2 = table.withColumn("t", totals).agg(
        F.sum(part("w0", "c0") + part("w1", "c1")).alias("chi2"), F.count(F.lit(1)).alias("r"),
        F.max(F.col("t.c0") + F.col("t.c1")).alias("n"),
        ((F.sum("n0") > 0).cast("int") + (F.sum("n1") > 0).cast("int")).alias("c"))
    denom = F.col("n") * (F.least(F.col("r"), F.col("c")) - 1)
    return chi2.select(F.when(denom > 0, F.sqrt(F.col("chi2") / F.nullif(denom, F.lit(0.0)))).alias("value"))


def repo_study_frame(repositories: DataFrame, tags: DataFrame, repo_layers: DataFrame,
                     occurrences: DataFrame, biases: dict[str, DataFrame] | None = None,
                     seed: str | int = 42) -> DataFrame:
    """One row per repository with a dated tag: its random tag, month,
    categories, has_secret, and the capped product of its bias weights.

    ``biases`` may hold ``month``, ``status``, ``is_official`` (key tables) and
    ``pull_count`` (bins); a missing one weighs 1.
    """
    biases = biases or {}
    picked = one_random_tag(repositories, tags, seed).filter(F.col("last_pushed").isNotNull())
    flagged = has_secret(picked, repo_layers, occurrences).select(
        "*", P.month_key(F.col("last_pushed")).alias("month_key"),
        P.blank_to_unknown(F.col("status")).alias("status_cat"),
        P.official_cat(F.col("is_official")).alias("is_official_cat"),
        P.official_cat(F.col("is_automated"), "automated", "manual").alias("is_automated_cat"))
    weighted = flagged
    for bias, column, out in (("month", "month_key", "w_month"), ("status", "status_cat", "w_status"),
                              ("is_official", "is_official_cat", "w_isoff")):
        weighted = (map_weight(weighted, column, biases[bias], out=out) if bias in biases
                    else weighted.withColumn(out, F.lit(1.0)))
    weighted = (bin_weight(weighted, "pull_count", biases["pull_count"], out="w_pull")
                if "pull_count" in biases else weighted.withColumn("w_pull", F.lit(1.0)))
    return weighted.withColumn("weight", P.combined_weight(
        F.col("w_month"), F.col("w_status"), F.col("w_isoff"), F.col("w_pull")))


def association_metrics(study: DataFrame) -> DataFrame:
    """Weighted correlation of three numbers and Cramer's V of three categories
    with having a secret. ``study`` is read five times; store it first."""
    numbers = {
        "pull_count": F.col("pull_count"), "star_count": F.col("star_count"),
        "last_pushed_epoch": P.epoch_seconds(F.col("last_pushed"), whole=False),
    }
    correlations = weighted_corrs(study, numbers, F.col("has_secret").cast("double"), F.col("weight")).select(
        "variable", F.lit("numeric_corr_weighted").alias("type"), "value")
    return union_all(correlations, *(
        weighted_cramers_v(study, cat).select(
            F.lit(cat).alias("variable"), F.lit("categorical_cramers_v_weighted").alias("type"), "value")
        for cat in ("status_cat", "is_official_cat", "is_automated_cat")))
