"""Lists of texts wrapped in one JSON document of any size, read by many tasks.

A JSON reader takes a document as one row. Here the file is read as lines that end at
quotes, which Spark splits by byte ranges, so no row is longer than one text. What a
piece between two quotes is follows from what stands before it, carried over the
splits by running aggregates: an even number of unescaped quotes puts it outside of
texts, and brackets outside of texts give its depth.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regspark.operators.running import TASK_ROWS, running, running_last, running_max, running_sum
from regspark.session import cut_lineage

_PLACE = ("_file", "_block", "_row")


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """What stands between quotes, in order; ``_ends`` is 0 where the quote after it is escaped."""
    text = spark.read.option("lineSep", '"').text(path)
    slashes = F.length(F.regexp_extract("value", r"(\\*)$", 1))
    return text.select(
        F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_row"), "value",
        F.when(slashes % 2 == 0, 1).otherwise(0).alias("_ends"))


def _count(chars: str) -> Column:
    return F.length("value") - F.length(F.translate("value", chars, ""))


def read_long_list(spark: SparkSession, path: str, field: str, out: str,
                   task_rows: int = TASK_ROWS) -> DataFrame:
    """The texts of the list ``field`` of each document at ``path``, as rows; one file is
    one document.

    Equal to ``read_list`` for lists of texts. Empty texts are left out, as are elements
    that are no texts, and texts in lists or objects inside the list. A document without
    the field, or an empty file, gives no rows. The name of the field must stand in the
    document as ``json.dumps`` writes it, with or without ``ensure_ascii``. Of a broken
    document the texts that can be told are given. A split's pieces are ordered in one
    task where a file has more than ``task_rows`` of them; smaller files are ordered whole.
    """
    def ordered(df: DataFrame, **aggs) -> DataFrame:
        return cut_lineage(running(df, ["_file"], F.col("_block"), aggs, tie=["_row"], task_rows=task_rows))

    names = [F.lit(json.dumps(field, ensure_ascii=ascii)[1:-1]) for ascii in (True, False)]
    parts = ordered(cut_lineage(_pieces(spark, path)), _quotes=running_sum(F.col("_ends"), inclusive=False),
                    _fresh=running_last(F.col("_ends"), inclusive=False))
    inside = F.col("_quotes") % 2 == 1
    fresh = F.coalesce("_fresh", F.lit(1)) == 1  # not the rest of a text after an escaped quote
    parts = parts.select(*_PLACE, "value", "_quotes", inside.alias("_inside"), (fresh & (F.col("_ends") == 1)).alias("_whole"),
                         F.when(~inside, _count("[{") - _count("]}")).otherwise(0).alias("_turn"))
    is_name = F.when(F.col("_inside"), F.col("_whole") & F.col("value").isin(*names))
    nested = ordered(parts, _depth=running_sum(F.col("_turn"), inclusive=False),
                     _named=running_last(is_name, inclusive=False))
    opens = ~F.col("_inside") & (F.col("_depth") == 1) & (F.col("_turn") > 0)
    wanted = F.coalesce("_named", F.lit(False)) & F.col("value").rlike(r"^\s*:\s*\[")
    marked = running(nested, ["_file"], F.col("_block"), {
        "_list": running_max(F.when(opens, F.col("_quotes") * 2 + wanted.cast("int")))},
        tie=["_row"], task_rows=task_rows)
    texts = cut_lineage(marked.filter(F.col("_inside") & (F.col("_depth") == 2) & (F.col("_list") % 2 == 1)).select(
        *_PLACE, "value", "_quotes", "_whole"))
    in_order = F.array_sort(F.collect_list(F.struct("_block", "_row", "value")))
    joined = texts.filter(~F.col("_whole")).groupBy("_file", "_quotes").agg(
        F.array_join(F.transform(in_order, lambda p: p["value"]), '"').alias("value"))
    found = texts.filter("_whole").select("value").unionByName(joined.select("value"))
    text = F.from_json(F.concat(F.lit('["'), F.col("value"), F.lit('"]')), "array<string>")[0]
    return found.select(text.alias(out)).filter(F.col(out) != "")
