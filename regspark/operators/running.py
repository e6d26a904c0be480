"""Running aggregates and exact quantiles that never hold a large group in one
task.

A plain window puts each of its groups into a single task, and a window
without groups puts the whole table there. Rows per group are therefore counted
first. Groups up to ``TASK_ROWS`` get the plain window. The rows of larger ones
are cut into chunks of about equal size along the order column (edges from one
approximate percentile pass); the few totals per (group, chunk) are turned into
carried-in values, and the row-level window runs inside (group, chunk) only, so
even a group holding most of the rows is spread over as many tasks as there are
chunks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from regspark.session import cut_lineage

# percentile_approx with its default accuracy resolves 1/10000 of the rows.
MAX_CHUNKS = 2048

# Rows of one group (or of an ungrouped frame) a single task may order.
TASK_ROWS = 1_000_000

# A side of at most this many short rows may be broadcast.
BROADCAST_ROWS = 100_000


def hot_keys(df: DataFrame, on: Sequence[str], rows: int,
             counts: DataFrame | None = None) -> tuple[DataFrame, int] | None:
    """The keys with more than ``rows`` rows, with their counts ``_key_rows`` and the
    bound actually used, or None if there are none. At most BROADCAST_ROWS keys
    can exceed total / BROADCAST_ROWS rows, so the bound is raised to that and
    the result is always short enough to broadcast. ``counts`` are the keys with their
    ``_key_rows``, where they are known already."""
    if counts is None:
        counts = df.groupBy(*on).agg(F.count(F.lit(1)).alias("_key_rows"))
    most, total = counts.agg(F.max("_key_rows"), F.sum("_key_rows")).first()
    bound = max(rows, (total or 0) // BROADCAST_ROWS)
    if (most or 0) <= bound:
        return None
    return cut_lineage(counts.filter(F.col("_key_rows") > bound)), bound


def null_safe_join(left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on columns of equal name, null matching null; the left side's are kept."""
    on = list(on)
    if not on:
        return left.crossJoin(right) if how == "inner" else left.join(right, F.lit(True), how)
    other = right.select(*(F.col(c).alias(f"_on_{c}") for c in on), *(c for c in right.columns if c not in on))
    same = F.lit(True)
    for c in on:
        same = same & F.col(c).eqNullSafe(F.col(f"_on_{c}"))
    return left.join(other, same, how).drop(*(f"_on_{c}" for c in on))


def one_row(df: DataFrame) -> Column:
    """A one-row frame as a struct value, computed once however many of its
    fields are used."""
    return df.select(F.struct(*df.columns).alias("row")).scalar()


def chunk_count(spark: SparkSession) -> int:
    """As many chunks as shuffle partitions: one fair share of rows each."""
    return max(2, min(MAX_CHUNKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))


def bin_index(x: Column, edges: Column, most: int = MAX_CHUNKS) -> Column:
    """Number of edges at or below ``x`` in a sorted array of at most ``most``
    edges, by binary search."""
    steps = [1 << k for k in range(most.bit_length() - 1, -1, -1)]
    return F.aggregate(
        F.array(*(F.lit(s) for s in steps)),
        F.lit(0),
        lambda pos, step: F.when(
            (pos + step <= F.size(edges)) & (F.get(edges, pos + step - 1) <= x), pos + step
        ).otherwise(pos),
    )


def with_chunk(df: DataFrame, order: str, out: str) -> DataFrame:
    """Add each row's chunk number along a numeric column; null goes to the
    first chunk. The edges,
    one number per chunk, come to the driver and go into the plan as one
    literal, so that no row carries them."""
    n = chunk_count(df.sparkSession)
    probs = [i / n for i in range(1, n)]
    edges = df.agg(F.percentile_approx(order, probs)).first()[0] or []
    kind = df.schema[order].dataType
    literal = F.array(*(F.lit(e).cast(kind) for e in edges)) if edges else F.array().cast(
        f"array<{kind.simpleString()}>")
    return df.withColumn(out, bin_index(F.col(order), literal, n))


_BEFORE = (W.unboundedPreceding, -1)
_UP_TO = (W.unboundedPreceding, 0)


class Running:
    """One running aggregate: what to compute in a chunk and how to carry it."""

    def __init__(self, kind: str, value: Column | None = None, inclusive: bool = True):
        self.kind, self.value, self.inclusive = kind, value, inclusive

    def total(self, order: Column) -> Column:
        if self.kind == "sum":
            return F.sum(self.value)
        if self.kind == "max":
            return F.max(self.value)
        return F.max_by(self.value, F.when(self.value.isNotNull(), order))

    def over(self, value: Column, window) -> Column:
        if self.kind == "sum":
            return F.coalesce(F.sum(value).over(window), F.lit(0))
        if self.kind == "max":
            return F.max(value).over(window)
        return F.last(value, ignorenulls=True).over(window)

    def merge(self, carried: Column, own: Column) -> Column:
        if self.kind == "sum":
            return F.coalesce(carried, F.lit(0)) + own
        if self.kind == "max":
            return F.greatest(carried, own)
        return F.coalesce(own, carried)


def running_sum(value: Column, inclusive: bool = True) -> Running:
    return Running("sum", value, inclusive)


def running_count(inclusive: bool = True) -> Running:
    return Running("sum", F.lit(1), inclusive)


def running_max(value: Column, inclusive: bool = True) -> Running:
    return Running("max", value, inclusive)


def running_last(value: Column, inclusive: bool = True) -> Running:
    """Last non-null value so far (fill-forward)."""
    return Running("last", value, inclusive)


def running(df: DataFrame, by: Sequence[str], order: Column,
            aggs: dict[str, Running], tie: Sequence[str] = (), task_rows: int = TASK_ROWS) -> DataFrame:
    """Append running aggregates along ``order`` (then ``tie``) within ``by``.

    ``order`` is numeric; null comes first, and null keys form a group. Chunks of a large group are balanced as
    long as no single order value holds a large share of its rows: aggregate to
    distinct values first, or use ``positions``. The input is read up to four
    times (sizes, edges, totals, rows); store it first (``cut_lineage``) where
    it is more than a scan.
    """
    by = list(by)
    base = df.withColumn("_order", order)
    small, large = _by_size(base, by, task_rows)
    parts = ([_plain(small, by, aggs, tie)] if small is not None else []) + (
        [_chunked(large, by, aggs, tie)] if large is not None else [])
    out = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    return out.select(*df.columns, *aggs)


def _by_size(df: DataFrame, by: list[str], rows: int) -> tuple[DataFrame | None, DataFrame | None]:
    """The rows of groups one task can order, and the rows of larger groups."""
    if not by:
        return (df, None) if df.limit(rows + 1).count() <= rows else (None, df)
    found = hot_keys(df, by, rows)
    if found is None:
        return df, None
    hot = F.broadcast(found[0].select(*by))
    return null_safe_join(df, hot, by, "left_anti"), null_safe_join(df, hot, by, "left_semi")


def _frame(window, agg: Running):
    return window.rowsBetween(*(_UP_TO if agg.inclusive else _BEFORE))


def _plain(df: DataFrame, by: list[str], aggs: dict[str, Running], tie: Sequence[str]) -> DataFrame:
    window = W.partitionBy(*by).orderBy("_order", *tie)
    return df.select("*", *(a.over(a.value, _frame(window, a)).alias(name) for name, a in aggs.items()))


def _chunked(df: DataFrame, by: list[str], aggs: dict[str, Running], tie: Sequence[str]) -> DataFrame:
    numbered = with_chunk(df, "_order", "_chunk")
    o = F.col("_order")
    totals = numbered.groupBy(*by, "_chunk").agg(
        *(a.total(F.struct(o, *tie)).alias(f"_t_{name}") for name, a in aggs.items()))
    across = W.partitionBy(*by).orderBy("_chunk").rowsBetween(*_BEFORE)
    carried = totals.select(*by, "_chunk", *(
        a.over(F.col(f"_t_{name}"), across).alias(f"_c_{name}") for name, a in aggs.items()))
    within = W.partitionBy(*by, "_chunk").orderBy(o, *tie)
    joined = null_safe_join(numbered, carried, [*by, "_chunk"])
    return joined.select(*df.columns, *(
        a.merge(F.col(f"_c_{name}"), a.over(a.value, _frame(within, a))).alias(name)
        for name, a in aggs.items()))


def positions(df: DataFrame, by: Sequence[str], order: Column, tie: Column,
              out: str = "position", task_rows: int = TASK_ROWS) -> DataFrame:
    """1-based position along (``order``, ``tie``) within ``by``, nulls first in
    either and null keys as a group, whatever the group's size. In groups too
    large for one task, a long run of equal ``order`` is cut into cells along
    ``tie`` (numeric); the cells are counted and carried, and rows are numbered
    inside a cell."""
    by = list(by)
    base = df.withColumn("_order2", order).withColumn("_tie2", tie)
    small, large = _by_size(base, by, task_rows)
    number = F.row_number()
    parts = []
    if small is not None:
        window = W.partitionBy(*by).orderBy("_order2", "_tie2")
        parts.append(small.select(*df.columns, number.over(window).cast("long").alias(out)))
    if large is not None:
        cut = with_chunk(large, "_tie2", "_cell")
        keys = [*by, "_order2", "_cell"]
        cells = cut_lineage(cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")))
        before = running(cells, by, F.col("_order2"), {"_before": running_sum(F.col("_n"), False)},
                         tie=["_cell"], task_rows=task_rows).drop("_n")
        inside = W.partitionBy(*keys).orderBy("_tie2")
        parts.append(null_safe_join(cut, before, keys).select(
            *df.columns, (F.col("_before") + number.over(inside)).cast("long").alias(out)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def value_counts(df: DataFrame, value: Column) -> DataFrame:
    return df.select(value.cast("double").alias("value")).filter(
        F.col("value").isNotNull() & ~F.isnan("value")).groupBy("value").agg(
        F.count(F.lit(1)).alias("n"))


def quantiles_of_counts(counts: DataFrame, probs: Sequence[float], value: str = "value",
                        n: str = "n", task_rows: int = TASK_ROWS) -> DataFrame:
    """Exact linearly interpolated quantiles of a (value, n) histogram as
    ``(quantile, value)`` rows. Only distinct values are ordered. The histogram
    is read several times, so callers pass a stored one."""
    v, c = F.col(value), F.col(n)
    total = counts.agg(F.sum(c)).scalar()
    run = running(counts.select(v.alias("_v"), c.alias("_n")), [], F.col("_v"),
                  {"_upto": running_sum(F.col("_n"))}, task_rows=task_rows)

    run = run.withColumn("_total", total)

    def spot(p: Column) -> Column:
        return p * (F.col("_total") - 1)

    first, last = F.col("_upto") - F.col("_n"), F.col("_upto") - 1

    def holds(p: Column, index: Column) -> Column:
        return (index >= first) & (index <= last)

    wanted = F.array(*(F.lit(float(p)) for p in probs))
    hits = run.select(
        "_v", "_n", "_upto", "_total",
        F.explode(F.filter(wanted, lambda p: holds(p, F.floor(spot(p))) | holds(p, F.ceil(spot(p)))))
        .alias("quantile"),
    )
    p = F.col("quantile")
    low = F.max(F.when(holds(p, F.floor(spot(p))), F.col("_v")))
    high = F.max(F.when(holds(p, F.ceil(spot(p))), F.col("_v")))
    return hits.groupBy("quantile", "_total").agg(low.alias("_low"), high.alias("_high")).select(
        "quantile",
        (F.col("_low") + (F.col("_high") - F.col("_low")) * (spot(p) - F.floor(spot(p)))).alias("value"),
    )


def exact_quantiles(df: DataFrame, value: Column, probs: Sequence[float],
                    task_rows: int = TASK_ROWS) -> DataFrame:
    return quantiles_of_counts(cut_lineage(value_counts(df, value)), probs, task_rows=task_rows)
