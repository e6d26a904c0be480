"""Document fingerprints: threshold-scaled sketches of shingle hashes.

A sketch keeps every shingle hash below a fixed fraction of the hash range, so
its size follows the document, sketches of parts merge by union, and both the
likeness and the containment of two documents can be estimated, however unequal
their sizes. The least hash is always kept too (it merges by minimum), so short
texts have a sketch as well. Shingles are ``WIDTH`` consecutive UTF-8 bytes; a
shorter text is one shingle, an empty one has none.

``edited`` compares each document with an altered copy and with the next one by
id. Rows are dealt to id ranges once; the first document of a range goes to the
range before it too, so neighbours always meet in one task.

Null text is empty. Two empty sketches are alike (1), an empty and a filled one
are not (0). Null ids come first; rows of equal id follow each other by text.
Other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm import arrays

WIDTH = 16
FRACTION = 32  # one of so many hashes is kept
HASH_BITS = 40
_LEAST_KEPT = 1 << (HASH_BITS - FRACTION.bit_length() + 1)


def _hashes(raw: np.ndarray) -> np.ndarray:
    """Hash of each run of WIDTH bytes, or of a shorter text as a whole."""
    if len(raw) < WIDTH:
        raw = np.concatenate([raw, np.zeros(WIDTH - len(raw), np.uint8)])
    x = raw.astype(np.uint64)
    for size in (1, 2, 4):
        x = (x[:-size] << np.uint64(8 * size)) | x[size:]
    return arrays.mix(x[:-8] * np.uint64(0x9E3779B97F4A7C15) + arrays.mix(x[8:])) >> np.uint64(64 - HASH_BITS)


def sketch(text: str) -> np.ndarray:
    """Sorted distinct hashes of the sketch of ``text``."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    if not len(raw):
        return np.empty(0, np.uint64)
    h = _hashes(raw)
    kept = h[h < _LEAST_KEPT]
    return np.unique(kept) if len(kept) else h.min()[None]


def merge(*sketches: np.ndarray) -> np.ndarray:
    """Sketch of texts put together, but for the shingles across their ends."""
    every = np.unique(np.concatenate(sketches)) if sketches else np.empty(0, np.uint64)
    below = every[every < _LEAST_KEPT]
    return below if len(below) else every[:1]


def written(kept: np.ndarray) -> str:
    """The sketch as text: hex digits, a fixed number for each hash."""
    return kept.astype(">u8").tobytes().hex() if HASH_BITS == 64 else "".join(
        f"{v:0{HASH_BITS // 4}x}" for v in kept.tolist())


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated Jaccard similarity of the shingle sets."""
    both = len(np.intersect1d(a, b, True))
    return both / (len(a) + len(b) - both) if len(a) or len(b) else 1.0


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the first text's shingles that the second has."""
    return len(np.intersect1d(a, b, True)) / len(a) if len(a) else 1.0


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, code points and fingerprint of every text."""
    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()),
                 pa.array([written(sketch(t)) for t in texts], pa.string())],
                ["doc_id", "n_chars", "fingerprint"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([
        rows.schema[0], T.StructField("n_chars", T.LongType()), T.StructField("fingerprint", T.StringType())]))


def followed(docs: DataFrame, *, id_col: str, text_col: str, parts: int | None = None) -> DataFrame:
    """Rows in id order within ranges, each range ending with a guest: what follows it.

    The last range ends with the first document of all. One shuffle of the rows.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    parts = parts or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    place = rows.select(F.col("doc_id").cast("double").alias("place"))
    cuts = [i / parts for i in range(1, parts)]
    cuts = sorted(set(place.approxQuantile("place", cuts, 0.2 / parts))) if cuts else []
    buckets = Bucketizer(splits=[-np.inf, *cuts, np.inf], inputCol="place", outputCol="range", handleInvalid="keep") \
        if cuts else None

    def ranged(frame):
        if buckets is None:
            return frame.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(0))
        frame = buckets.transform(frame.withColumn("place", F.col("doc_id").cast("double")))
        return frame.withColumn("range", F.when(F.col("doc_id").isNull(), -1).otherwise(
            F.col("range").cast("int"))).drop("place")

    firsts = ranged(rows.select("doc_id")).groupBy("range").agg(F.min("doc_id").alias("first")).collect()
    firsts = sorted((r["range"], r["first"]) for r in firsts)
    before = [(r, first, firsts[i - 1][0]) for i, (r, first) in enumerate(firsts)]
    edges = spark.createDataFrame(before, "range int, first long, before int")
    rows = ranged(rows).join(F.broadcast(edges), "range")
    guest = F.explode(F.when(F.col("doc_id").eqNullSafe(F.col("first")), F.array(F.lit(0), F.lit(1)))
                      .otherwise(F.array(F.lit(0)))).alias("guest")
    return rows.select("doc_id", "text", "range", "before", guest) \
        .select("doc_id", "text", "guest", F.when(F.col("guest") == 1, F.col("before"))
                .otherwise(F.col("range")).alias("range")) \
        .repartition(max(1, parts // 4), "range") \
        .sortWithinPartitions("range", "guest", F.asc_nulls_first("doc_id"), "text")


NAMES = ("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next",
         "kept_in_edited", "kept_in_next")
SCHEMA = ("doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double, kept_in_edited double, kept_in_next double")


def edited(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", share: int = 4,
           parts: int | None = None) -> DataFrame:
    """Each document's sketch against those of an edited copy and of the next document.

    The copy has the last ``1/share`` of the code points replaced by as many
    from the start of the next document, or by all it has.
    """
    def run(batches):
        kinds = [pa.int64()] * 2 + [pa.string()] * 3 + [pa.float64()] * 4
        held = None
        for batch in batches:
            out = [[] for _ in NAMES]
            for name, text, guest, place in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                text = text or ""
                own = sketch(text)
                if held is not None and held[3] == place:
                    doc, was, kept, _ = held
                    n = len(was) // share
                    copy = was[:len(was) - n] + text[:n]
                    other = sketch(copy)
                    for column, value in zip(out, (
                            doc, len(was), hashlib.sha256(copy.encode("utf-8", "surrogatepass")).hexdigest(),
                            written(kept), written(other), likeness(kept, other), likeness(kept, own),
                            containment(kept, other), containment(kept, own)), strict=True):
                        column.append(value)
                held = None if guest else (name, text, own, place)
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)], list(NAMES))

    return followed(docs, id_col=id_col, text_col=text_col, parts=parts).mapInArrow(run, SCHEMA)
