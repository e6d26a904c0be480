"""Toxicity by a factorization machine over hashed terms.

A document is the set of its hashed terms. The score is a logistic function of a
bias, one weight per term, and one dot product per pair of terms, so a pair can
count for more, or less, than its two terms: an insult next to the mention of a
group. The pairwise sum over all terms costs one pass, as half the square of the
summed factors less the sum of their squares.

The model is fitted in one task on a bounded sample of labelled rows, up to
``per_class`` for either label, drawn by hash. Scoring reads every whole text
once, without a shuffle.

Null and empty texts, and texts without terms, get the score of the bias. A
document that occurs more than once in the labels is toxic if any row says so;
null labels are ignored, and without labels every score is 0. Repeated documents
are scored as they come. Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm import arrays
from regspark.llm.fitting import fit

BUCKETS = 1 << 20
#: Bytes of the word beginnings that count as terms.
BEGINNINGS = (3, 4, 5, 6, 7, 8)


def term_rows(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashed terms of each row, as often as they occur: (row, bucket).

    Terms are words, and the beginnings of longer words, which many inflected or
    compound words share.
    """
    starts, ends, rows = arrays.words(data, off, arrays.ALNUM)
    row = np.repeat(np.arange(len(off) - 1), np.diff(rows))
    found = [(row, arrays.word_hashes(data, starts, ends))]
    for size in BEGINNINGS:
        long, hashes = arrays.prefix_hashes(data, starts, ends, size)
        found.append((row[long], hashes))
    row, hashes = (np.concatenate(x) for x in zip(*found, strict=True))
    return row, (hashes >> np.uint64(44)).astype(np.int64)


def term_sets(row: np.ndarray, bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each pair once, sorted."""
    pairs = np.unique(row * BUCKETS + bucket)
    return pairs // BUCKETS, pairs % BUCKETS


@dataclass
class Machine:
    """Bias, weights and factors of the chosen buckets, in rising order."""

    bias: float
    buckets: np.ndarray
    weights: np.ndarray
    factors: np.ndarray

    def __post_init__(self):
        self.known = np.zeros(BUCKETS, bool)
        self.known[self.buckets] = True

    def scores(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        """Scores of ``n`` rows from their terms, which may repeat."""
        known = self.known[bucket]
        row, bucket = term_sets(row[known], bucket[known])
        at = np.searchsorted(self.buckets, bucket)
        return 1 / (1 + np.exp(-np.clip(self.margin(row, at, n)[0], -30, 30)))

    def margin(self, row, at, n):
        linear = np.bincount(row, self.weights[at], n) if len(row) else np.zeros(n)
        v = self.factors[at]
        summed = np.stack([np.bincount(row, v[:, f], n) for f in range(v.shape[1])], 1)
        squares = np.bincount(row, (v * v).sum(1), n) if len(row) else np.zeros(n)
        return self.bias + linear + 0.5 * ((summed * summed).sum(1) - squares), summed


def learn(row, bucket, toxic, share: float, *, terms: int = 4096, least_chi: float = 25.0, rank: int = 4,
          epochs: int = 300, rate: float = 0.05, decay: float = 3e-4, keep: tuple[float, ...] = (1.0, 0.5, 0.2, 0.1),
          seed: int = 11) -> Machine:
    """Fits the machine by Adam on all rows at once.

    Only the ``terms`` buckets that tell the classes apart best (chi-squared, at
    least ``least_chi``) have weights. Rows are weighted so that toxic ones make up ``share``. In turn
    a step sees all terms or a part of them (``keep``), so a text with a single
    telling term is recognised as one with many is.
    """
    n = len(toxic)
    y = toxic.astype(float)
    n1, n0 = max(1.0, y.sum()), max(1.0, n - y.sum())
    pos = np.bincount(bucket, y[row], BUCKETS)
    both = np.bincount(bucket, minlength=BUCKETS)
    expected = both * n1 / (n1 + n0)
    chi = np.where(both > 0, (pos - expected) ** 2 / np.maximum(expected * (1 - n1 / (n1 + n0)), 1e-9), 0)
    chosen = np.sort(np.argsort(-chi, kind="stable")[:terms])
    chosen = chosen[chi[chosen] > least_chi]
    at = np.full(BUCKETS, -1)
    at[chosen] = np.arange(len(chosen))
    col = at[bucket]
    row, col = row[col >= 0], col[col >= 0]
    weight = np.where(y > 0, share / n1, (1 - share) / n0)

    rng = np.random.default_rng(seed)
    machine = Machine(float(np.log(share / (1 - share))), chosen, np.zeros(len(chosen)),
                      rng.normal(0, 0.01, (len(chosen), rank)))
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (np.zeros(1), machine.weights, machine.factors)]
    for step in range(1, epochs + 1):
        seen = rng.random(len(row)) < keep[step % len(keep)]
        r, c = row[seen], col[seen]
        margin, summed = machine.margin(r, c, n)
        slope = weight * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        each = slope[r]
        g_weights = np.bincount(c, each, len(chosen)) + decay * machine.weights
        v = machine.factors
        g_factors = np.stack([np.bincount(c, each * (summed[r, f] - v[c, f]), len(chosen))
                              for f in range(rank)], 1) + decay * v
        new = []
        for p, g, s in zip((np.array([machine.bias]), machine.weights, v),
                           (np.array([slope.sum()]), g_weights, g_factors), state, strict=True):
            s[0] = 0.9 * s[0] + 0.1 * g
            s[1] = 0.999 * s[1] + 0.001 * g * g
            new.append(p - rate * s[0] / (1 - 0.9 ** step) / (np.sqrt(s[1] / (1 - 0.999 ** step)) + 1e-8))
        machine.bias, machine.weights, machine.factors = float(new[0][0]), new[1], new[2]
    return machine


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
          label_col: str = "toxic", usable: Column | None = None, per_class: int = 3000, share: float = 0.1, **how) -> Machine | None:
    """The machine learned from the labelled documents for which ``usable`` holds.

    ``usable`` is a condition over the label's ``id``. At most ``per_class``
    rows of either label are drawn, those of the smallest hash of their id;
    ``share`` is the weight of toxic rows among them.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")) \
        .where(F.col("id").isNotNull() & F.col("toxic").isNotNull())
    known = known.groupBy("id").agg((F.max("toxic") > 0).alias("toxic"))
    if usable is not None:
        known = known.where(usable)
    counts = dict(known.groupBy("toxic").count().collect())
    if len(counts) < 2:
        return None
    drawn = [known.where(F.col("toxic") == t).orderBy(F.xxhash64("id"), "id").limit(per_class)
             for t in (True, False)]
    sample = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")) \
        .join(F.broadcast(drawn[0].unionAll(drawn[1])), "id")

    def features(batches):
        for batch in batches:
            column, out = batch.column(2), []
            for _, data, off in arrays.blocks(batch.column(1)):
                row, bucket = term_sets(*term_rows(data, off))
                out += np.split(bucket.astype(np.int32), np.searchsorted(row, np.arange(1, len(off) - 1)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(out, pa.list_(pa.int32())), column], ["id", "terms", "toxic"])

    def from_rows(batches):
        terms, toxic = [], []
        for batch in batches:
            terms += [np.asarray(t.values) for t in batch.column(1)]
            toxic += batch.column(2).to_pylist()
        if len(set(toxic)) < 2:
            return None
        row = np.repeat(np.arange(len(terms), dtype=np.int32), [len(t) for t in terms])
        return learn(row, np.concatenate(terms), np.array(toxic), share, **how)

    return fit(sample.mapInArrow(features, sample.select("id", F.array(F.lit(0)).alias("terms"), "toxic").schema),
               from_rows)


def score(docs: DataFrame, machine: Machine | None, *, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.7, carry: bool = False) -> DataFrame:
    """Score and prediction of every document.

    With ``carry`` the column ``row`` holds the document's input columns.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([F.struct(*docs.columns).alias("row")] if carry else []))
    kept = [f for f in rows.schema if f.name != "text"]

    def run(batches):
        for batch in batches:
            found = [np.zeros(0)]
            for _, data, off in arrays.blocks(batch.column(1)):
                n = len(off) - 1
                found.append(machine.scores(*term_rows(data, off), n) if machine else np.zeros(n))
            score = np.concatenate(found)
            yield pa.RecordBatch.from_arrays(
                [c for i, c in enumerate(batch.columns) if i != 1]
                + [pa.array(score), pa.array((score >= threshold).astype(np.int32))],
                [f.name for f in kept] + ["score", "predicted"])

    return rows.mapInArrow(run, T.StructType([
        *kept, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
