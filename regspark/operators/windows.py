"""Order-dependent operators: thinning, fill-forward, ranks, running totals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regspark.operators.joins import spread_join
from regspark.operators.running import (
    TASK_ROWS,
    null_safe_join,
    running,
    running_count,
    running_last,
    running_max,
    running_sum,
)
from regspark.session import cut_lineage

# Fixed value: seven days, in microseconds.
WEEK_MICROS = 7 * 24 * 3600 * 1_000_000

# Groups up to this many distinct instants are thinned inside one row.
FOLD_LIMIT = 10_000


def sentinel_fill(df: DataFrame, is_marker: Column, value: Column, order: Column,
                  by: Sequence[str] = (), tie: Sequence[str] = (), out: str = "query",
                  task_rows: int = TASK_ROWS) -> DataFrame:
    """Give every row the value of the last marker row before it, then remove
    the marker rows. ``order`` is numeric and increases along the stream."""
    marked = df.withColumn("_m", is_marker)
    filled = running(marked, by, order, {out: running_last(F.when(F.col("_m"), value))}, tie, task_rows)
    return filled.filter(~F.col("_m")).drop("_m")


def first_seen(df: DataFrame, key: str, order: Sequence[str] | str) -> DataFrame:
    """First row per key in input order."""
    orders = [order] if isinstance(order, str) else list(order)
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), F.struct(*orders)).alias("_r")).select(
        key, *(F.col(f"_r.{c}").alias(c) for c in rest)).select(*df.columns)


distinct_first = first_seen


def rank_in_query(df: DataFrame, by: Sequence[str], order: Column, tie: Sequence[str] = (),
                  out: str = "rank") -> DataFrame:
    """1-based position within the query."""
    ranked = running(df, by, order, {out: running_count()}, tie)
    return ranked.withColumn(out, F.col(out).cast("long"))


def rank_label(df: DataFrame, by: str, rank: str = "rank", out: str = "label") -> DataFrame:
    """Relevance: the last rank of the query gets 1, the first the most."""
    longest = df.groupBy(by).agg(F.max(rank).alias("_max"))
    return null_safe_join(df, longest, [by]).select(*df.columns, (F.col("_max") - F.col(rank) + 1).alias(out))


def min_group_filter(df: DataFrame, by: str, n: int = 5) -> DataFrame:
    large = df.groupBy(by).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") >= n).select(by)
    return df.join(large, by, "left_semi")


def cumulative_months(study: DataFrame) -> DataFrame:
    """Running counts of repositories, total and with a secret, over a month
    axis without gaps. Everything after the first aggregation is one row per
    calendar month, so the final window is as long as the calendar."""
    month = F.to_date(F.concat("month_key", F.lit("-01")))
    monthly = study.groupBy(month.alias("month")).agg(
        F.count("repo_id").alias("_t"), F.count_if("has_secret").alias("_s"))
    span = monthly.agg(F.min("month").alias("lo"), F.max("month").alias("hi")).filter(
        F.col("lo").isNotNull())
    axis = span.select(F.explode(F.sequence("lo", "hi", F.expr("interval 1 month"))).alias("month"))
    upto = W.orderBy("month").rowsBetween(W.unboundedPreceding, 0)
    return axis.join(monthly, "month", "left").select(
        F.date_format("month", "yyyy-MM").alias("month_key"),
        F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("total_cum"),
        F.coalesce(F.sum("_s").over(upto), F.lit(0)).alias("secret_cum"))


def cumulative_weighted(monthly: DataFrame) -> DataFrame:
    """Running weighted sums and the monthly weighted share, on one row per
    month (see ``date_range_filter`` for the study's period)."""
    upto = W.orderBy("month_key").rowsBetween(W.unboundedPreceding, 0)
    total = F.coalesce("total_repos_weighted", F.lit(0.0))
    secret = F.coalesce("repos_with_secret_weighted", F.lit(0.0))
    share = F.try_divide("repos_with_secret_weighted", "total_repos_weighted")
    sane = share.isNotNull() & ~F.isnan(share) & (F.abs(share) != F.lit(float("inf")))
    return monthly.select(
        "month_key", F.sum(total).over(upto).alias("cum_total_w"),
        F.sum(secret).over(upto).alias("cum_secret_w"),
        F.when(sane, share).otherwise(F.lit(0.0)).alias("share_w"))


def ccdf(dist: DataFrame, x: str = "repo_count", n: str = "secret_count") -> DataFrame:
    """Share of items with at least x, from an (x, n) distribution."""
    dist = cut_lineage(dist.select(x, n))
    total = dist.agg(F.sum(n)).scalar()
    run = running(dist, [], F.col(x), {"_lower": running_sum(F.col(n), inclusive=False)})
    return run.withColumn("_total", total).select(
        x, (F.col("_total") - F.col("_lower")).alias("cum_ge"),
        ((F.col("_total") - F.col("_lower")) / F.col("_total")).alias("ccdf"))


def joint_ccdf(df: DataFrame, a: str = "repo_count", b: str = "layer_count") -> DataFrame:
    """For x = 1 .. min(max a, max b): share of rows with a >= x and b >= x.

    Both hold exactly when the smaller of the two is at least x, so one
    histogram of the smaller value answers every x; each histogram step emits
    the x values it covers.
    """
    av, bv = F.coalesce(F.col(a), F.lit(0)).cast("long"), F.coalesce(F.col(b), F.lit(0)).cast("long")
    hist = cut_lineage(df.groupBy(F.least(av, bv).alias("v")).agg(
        F.count(F.lit(1)).alias("n"), F.max(av).alias("a"), F.max(bv).alias("b")))
    facts = hist.agg(F.least(F.max("a"), F.max("b")).alias("top"), F.sum("n").alias("rows"))
    below = hist.agg(F.sum(F.when(F.col("v") < 1, F.col("n")).otherwise(F.lit(0))).alias("below"))
    # A closing step of zero rows covers x beyond the largest smaller value.
    steps = hist.select("v", "n").filter(F.col("v") >= 1).unionByName(
        facts.filter(F.col("top") >= 1).select(F.col("top").alias("v"), F.lit(0).cast("long").alias("n"))
    ).groupBy("v").agg(F.sum("n").alias("n"))
    run = running(steps, [], F.col("v"), {
        "_less": running_sum(F.col("n"), inclusive=False),
        "_prev": running_max(F.col("v"), inclusive=False)})
    sized = run.withColumn("_rows", facts.select("rows").scalar()).withColumn("_below", below.scalar())
    return sized.select(
        F.explode(F.sequence(F.coalesce("_prev", F.lit(0).cast("long")) + 1, F.col("v"))).alias("x"),
        ((F.col("_rows") - F.col("_below") - F.col("_less")) / F.col("_rows")).alias("ccdf"))


def gap_thinning(df: DataFrame, by: str, ts: str, tie: str, min_gap_micros: int = WEEK_MICROS,
                 fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Newest first per group, keep a row only if it is at least the gap older
    than the last kept one.

    Rows without a time are left out; null keys form a group. Of the rows of one
    instant the least tie is kept (null only if all are), with the rows that
    repeat it. Only one row per instant can be kept, so instants are reduced first. Groups
    of ordinary size are folded as one sorted array. Larger groups, whatever
    their size, follow next-kept pointers: each instant points at the newest
    instant at least one gap older, and pointers are doubled until the chain
    from the newest instant is complete.
    """
    micros = F.unix_micros(F.col(ts).cast("timestamp"))
    instants = cut_lineage(df.filter(F.col(ts).isNotNull()).groupBy(by, micros.alias("_t")).agg(
        F.min(tie).alias(tie)))
    sizes = instants.groupBy(by).agg(F.count(F.lit(1)).alias("_n"))
    large = sizes.filter(F.col("_n") > fold_limit).select(by)
    if large.isEmpty():
        kept = _thin_by_fold(instants, by, tie, min_gap_micros)
    else:
        kept = _thin_by_fold(null_safe_join(instants, large, [by], "left_anti"), by, tie, min_gap_micros).unionByName(
            _thin_by_pointers(null_safe_join(instants, large, [by], "left_semi"), by, tie, min_gap_micros))
    return null_safe_join(df.withColumn("_t", micros), kept, [by, "_t", tie], "left_semi").drop("_t")


def _thin_by_fold(instants: DataFrame, by: str, tie: str, gap: int) -> DataFrame:
    item = F.struct("_t", tie)
    newest_first = F.reverse(F.array_sort(F.collect_list(item)))
    grouped = instants.groupBy(by).agg(newest_first.alias("_a"))
    start = F.struct(F.slice("_a", 1, 1).alias("kept"), F.col("_a")[0]["_t"].alias("last"))

    def step(acc: Column, x: Column) -> Column:
        return F.when(
            acc["last"] - x["_t"] >= F.lit(gap),
            F.struct(F.concat(acc["kept"], F.array(x)).alias("kept"), x["_t"].alias("last")),
        ).otherwise(acc)

    folded = F.aggregate("_a", start, step, lambda acc: acc["kept"])
    return grouped.select(by, F.explode(folded).alias("_k")).select(by, "_k._t", f"_k.{tie}")


def _thin_by_pointers(instants: DataFrame, by: str, tie: str, gap: int,
                      task_rows: int = TASK_ROWS) -> DataFrame:
    data = instants.select(by, F.col("_t").alias("_at"), F.col("_t").alias("_data"),
                           F.lit(None).cast("long").alias("_from"), F.lit(0).alias("_probe"))
    probes = instants.select(by, (F.col("_t") - gap).alias("_at"), F.lit(None).cast("long").alias("_data"),
                             F.col("_t").alias("_from"), F.lit(1).alias("_probe"))
    looked_up = running(data.unionByName(probes), [by], F.col("_at"),
                        {"_next": running_max(F.col("_data"))}, tie=["_probe"], task_rows=task_rows)
    jump = cut_lineage(looked_up.filter((F.col("_probe") == 1) & F.col("_next").isNotNull()).select(
        by, F.col("_from").alias("_t"), "_next"))
    reached = instants.groupBy(by).agg(F.max("_t").alias("_t"))
    while not jump.isEmpty():
        onward = null_safe_join(reached, jump, [by, "_t"]).select(by, F.col("_next").alias("_t"))
        reached = cut_lineage(reached.unionByName(onward).distinct())
        # All instants of one gap may point at the same one: such a key is split by instant.
        key = F.struct(by).alias("_by")
        second = jump.select(key, F.col("_t").alias("_next"), F.col("_next").alias("_next2"))
        jump = cut_lineage(spread_join(jump.select("*", key), second, ["_by", "_next"], "_t", rows_per_task=task_rows)
                           .select(by, "_t", F.col("_next2").alias("_next")))
    return null_safe_join(reached, instants, [by, "_t"]).select(by, "_t", tie)
