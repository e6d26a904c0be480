"""From the files of layers to what the import reads: counts, fragments and secret records."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from regspark.functions import scalars as P
from regspark.operators import scan as C
from regspark.operators.findings import FindingStore
from regspark.session import cut_lineage


def layer_counts(files: DataFrame) -> DataFrame:
    """Counts of each layer of ``files`` (layer, file, text), as ``import_layers`` reads
    them. A null text has no bytes."""
    return files.groupBy(F.col("layer").cast("string").alias("digest")).agg(
        F.count(F.lit(1)).cast("int").alias("file_count"), F.max(P.path_depth(F.col("file"))).cast("int").alias("max_depth"),
        F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).cast("long").alias("uncompressed_size"),
        F.lit(0).cast("long").alias("seq"))


def secret_records(found: DataFrame) -> DataFrame:
    """One record per finding of a distinct fragment. The last of a fragment by line,
    rule and secret is the one the import keeps."""
    once = found.select("fragment_hash", "file", "file_type", "file_size", "origin", "secret", "start_line").distinct()
    return once.select("fragment_hash", F.struct(
        "file", "file_type", "file_size", "origin", "secret", "start_line").alias("secrets"),
        F.struct("start_line", "origin", "secret").alias("seq"))


def scan_to_import(files: DataFrame, rules: Sequence[C.Rule], unit: str = "line",
                   store: FindingStore | None = None, run: str = "") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(layer counts, fragments of layers, secret records) of ``files`` (layer, file,
    text), for ``import_layers`` and ``import_held``. The fragments a layer holds are rows
    (fragment_hash, layer_id), not one array a layer. With a ``store`` only fragments
    that no earlier run has scanned are matched. Texts are read once for the findings and
    once for the counts."""
    frags = C.fragments(files, unit=unit, rules=rules)
    found = cut_lineage(C.scan_distinct(frags, rules) if store is None else store.scan(frags, rules, run))
    held = C.layer_secret_list(found).select("fragment_hash", F.col("layer").cast("string").alias("layer_id"))
    return layer_counts(files), held, secret_records(found)
