"""Reading crawled files and tables. Schemas are given, never inferred."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.schemas import LAYER_TSV

_ZERO = {
    T.StringType(): "", T.LongType(): 0, T.IntegerType(): 0, T.DoubleType(): 0.0,
    T.BooleanType(): False,
}

ORDER_COLUMNS = ("_file", "_offset", "_row")


def _zero_filled(c: Column, field: T.StructField) -> Column:
    if field.nullable or field.dataType not in _ZERO:
        return c
    return F.coalesce(c, F.lit(_ZERO[field.dataType]).cast(field.dataType))


def _typed(df: DataFrame, schema: T.StructType, key: str | None, extra: Sequence[str]) -> DataFrame:
    """Drop rows without key, fill what the schema marks as not nullable. The
    hash test is always true; it makes every field be read, so that a type
    error in any of them drops the row even if the query needs only one."""
    rows = df.filter(F.xxhash64(*(f.name for f in schema.fields)) >= F.lit(-(2**63)))
    if key is not None:
        rows = rows.filter(F.col(key).isNotNull() & (F.col(key) != ""))
    return rows.select(*(_zero_filled(F.col(f.name), f).alias(f.name) for f in schema.fields), *extra)


def read_jsonl(spark: SparkSession, path: str | list[str], schema: T.StructType,
               key: str | None = None, order: bool = False) -> DataFrame:
    """One JSON object per line. Blank, broken and mistyped lines are left out,
    as are rows without ``key``. ``order`` adds the columns ``_file, _offset,
    _row``, whose order is the input order within a file."""
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)
    if order:
        raw = raw.select(
            "*", F.col("_metadata.file_path").alias("_file"),
            F.col("_metadata.file_block_start").alias("_offset"),
            F.monotonically_increasing_id().alias("_row"))
    return _typed(raw, schema, key, ORDER_COLUMNS if order else ())


def read_chunks(spark: SparkSession, glob: str, schema: T.StructType, key: str | None = None) -> DataFrame:
    """Numbered chunks ``<prefix>_<n>.jsonl`` (files, or folders of them) as one
    stream, with the number in ``chunk_no``."""
    raw = spark.read.schema(schema).option("mode", "DROPMALFORMED").json(glob)
    number = F.regexp_extract(F.col("_metadata.file_path"), r"_([0-9]+)[.]jsonl", 1)
    return _typed(raw.select("*", number.try_cast("int").alias("chunk_no")), schema, key, ("chunk_no",))


def read_list(spark: SparkSession, path: str, field: str, out: str) -> DataFrame:
    """A JSON document wrapping a list of texts, as rows."""
    schema = T.StructType([T.StructField(field, T.ArrayType(T.StringType()))])
    doc = spark.read.schema(schema).option("multiLine", True).json(path)
    return doc.select(F.explode(field).alias(out)).filter(F.col(out) != "")


def read_array_lines(spark: SparkSession, path: str, element: T.StructType) -> DataFrame:
    """Lines holding an array of objects, or ``null``, flattened to rows."""
    text = spark.read.text(path)
    items = F.from_json("value", T.ArrayType(element))
    return text.select(F.explode(items).alias("item")).filter(F.col("item").isNotNull()).select("item.*")


def _csv_with(spark: SparkSession, path: str, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns of a CSV with header; no rows if one is missing or
    there is no file."""
    empty = spark.createDataFrame([], T.StructType(
        [T.StructField(c, T.StringType()) for c in wanted]))
    try:
        found = spark.read.option("header", True).csv(path)
    except AnalysisException:
        found = empty
    if not set(wanted) <= set(found.columns):
        found = empty
    return found.select(*(F.col(c).try_cast(kind).alias(c) for c, kind in wanted.items()))


def read_hist(spark: SparkSession, path: str) -> DataFrame:
    return _csv_with(spark, path, {"key": "string", "count": "bigint"})


def read_series(spark: SparkSession, path: str) -> DataFrame:
    return _csv_with(spark, path, {"value": "double"})


def read_bias(spark: SparkSession, path: str, from_shares: bool = False) -> DataFrame:
    """Category weights (key, bias_full_over_sample). With ``from_shares`` a
    file without the ratio but with both shares gives it."""
    plain = _csv_with(spark, path, {"key": "string", "bias_full_over_sample": "double"})
    if not from_shares:
        return plain
    try:
        columns = set(spark.read.option("header", True).csv(path).columns)
    except AnalysisException:
        return plain
    if "bias_full_over_sample" in columns:
        return plain
    shares = _csv_with(spark, path, {"key": "string", "p_full": "double", "p_sample": "double"})
    return shares.select("key", F.when(F.col("p_sample") > 0, F.try_divide("p_full", "p_sample"))
                         .when(F.col("p_full") > 0, F.lit(float("inf"))).otherwise(F.lit(1.0))
                         .alias("bias_full_over_sample"))


def read_bias_bins(spark: SparkSession, path: str) -> DataFrame:
    return _csv_with(spark, path, {"bin_left": "double", "bin_right": "double",
                                   "bias_full_over_sample": "double"}).orderBy("bin_left", "bin_right")


def load_tables(spark: SparkSession, folder: str, names: Iterable[str]) -> dict[str, DataFrame]:
    """Parquet tables ``<folder>/<name>.parquet``, filters left to the scan."""
    return {n: spark.read.parquet(f"{folder.rstrip('/')}/{n}.parquet") for n in names}


def load_jdbc(spark: SparkSession, url: str, table: str, column: str, lower: int, upper: int,
              partitions: int, **options: str) -> DataFrame:
    """A database table read in parallel key ranges."""
    return spark.read.format("jdbc").options(
        url=url, dbtable=table, partitionColumn=column, lowerBound=str(lower), upperBound=str(upper),
        numPartitions=str(partitions), **options).load()


def read_layer_tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LAYER_TSV).option("sep", "\t").csv(path)


def tsv_unique(spark: SparkSession, path: str) -> DataFrame:
    """Layers of a tab-separated list, unique by the first column."""
    rows = read_layer_tsv(spark, path)
    return rows.groupBy("layer").agg(F.min(F.struct("repo", "size")).alias("_r")).select(
        "layer", "_r.repo", "_r.size")
