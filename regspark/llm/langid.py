"""Language identification by error-correcting output codes.

Every language has a codeword of bits. One binary logistic classifier per bit,
over relative frequencies of hashed byte 1- to 4-grams of the letters, predicts
it. A text gets the language whose codeword has the least total loss over the
bits, so a few wrong bits are outvoted; a close runner-up marks it ambiguous.

The classifiers are fitted in one task on a bounded sample: about ``per_lang``
documents of each language, drawn by hash. Prediction reads every whole text
once, without a shuffle.

Null texts and texts without a letter are ``und`` with score 0; so is every text
when there is nothing to learn from. Null languages are not learned. Repeated
rows are taken as they come, other columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm import arrays
from regspark.llm.fitting import fit

BITS = 15
BUCKETS = 1 << BITS
GRAMS = (1, 2, 3, 4)
_LETTER = (arrays._BYTES >= 0x80) | ((arrays._BYTES | 32 >= 0x61) & (arrays._BYTES | 32 <= 0x7A))
_FOLD = np.where(_LETTER, arrays.LOWER, 0x20).astype(np.uint8)


def codewords(n: int, seed: int = 5) -> np.ndarray:
    """A row of -1 and 1 per class: all splits for few classes, else spread codes.

    Up to six classes get the exhaustive code; more get the best of 200 random
    codes by the least distance between two rows.
    """
    if n <= 1:
        return np.ones((n, 1), int)
    if n <= 6:
        columns = [(1, *rest) for rest in product((1, -1), repeat=n - 1) if -1 in rest]
        return np.array(columns).T
    rng, best, least = np.random.default_rng(seed), None, -1
    length = math.ceil(15 * math.log2(n))
    for _ in range(200):
        code = rng.choice((-1, 1), (n, length))
        alike = code @ code.T - 2 * length * np.eye(n, dtype=int)
        if (length - alike.max()) / 2 > least and (abs(code.sum(0)) < n).all():
            best, least = code, (length - alike.max()) / 2
    return best


def frequencies(data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Relative frequency of every hashed gram, by row; grams of blanks alone don't count."""
    n = len(off) - 1
    folded = _FOLD[data].astype(np.uint64)
    row = np.repeat(np.arange(n), np.diff(off))
    counts = np.zeros(n * BUCKETS)
    gram = np.zeros(len(folded), np.uint64)
    for k in range(max(GRAMS)):
        m = len(folded) - k
        if m <= 0:
            break
        gram = (gram[:m] << np.uint64(8)) | folded[k:]
        if k + 1 in GRAMS:
            inside = (row[:m] == row[k:]) & (gram != np.uint64(int.from_bytes(b" " * (k + 1), "big")))
            bucket = (arrays.mix(gram[inside] + np.uint64((k + 1) << 40)) >> np.uint64(64 - BITS)).astype(np.int64)
            counts += np.bincount(row[:m][inside] * BUCKETS + bucket, minlength=n * BUCKETS)
    counts = counts.reshape(n, BUCKETS)
    return (counts / np.maximum(counts.sum(1, keepdims=True), 1)).astype(np.float32)


@dataclass
class Codes:
    """Languages, their codewords, and the classifiers of the bits."""

    langs: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray

    def decode(self, x: np.ndarray):
        """Best language, runner-up, score of the best and of the runner-up."""
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]).sum(2)
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        order = np.argsort(-p, axis=1, kind="stable")
        at = np.arange(len(p))
        second = order[:, 1] if p.shape[1] > 1 else order[:, 0]
        return order[:, 0], second, p[at, order[:, 0]], p[at, second] if p.shape[1] > 1 else np.zeros(len(p))


def learn(langs, rows, bucket, share, *, epochs: int = 40, batch: int = 128, rate: float = 1.0,
          seed: int = 3) -> Codes:
    """Fits all bit classifiers by Adam; ``rows[i]:rows[i+1]`` are the grams of text i."""
    names = sorted(set(langs))
    code = codewords(len(names))
    y = code[[names.index(x) for x in langs]]
    weights, bias = np.zeros((BUCKETS, code.shape[1]), np.float32), np.zeros(code.shape[1], np.float32)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (weights, bias)]
    rng, step = np.random.default_rng(seed), 0
    for _ in range(epochs):
        order = rng.permutation(len(langs))
        for some in np.array_split(order, max(1, len(order) // batch)):
            x = np.zeros((len(some), BUCKETS), np.float32)
            for i, r in enumerate(some):
                x[i, bucket[rows[r]:rows[r + 1]]] = share[rows[r]:rows[r + 1]]
            margin = y[some] * (x @ weights + bias)
            slope = -y[some] / (1 + np.exp(np.clip(margin, -30, 30))) / len(some)
            step += 1
            for p, g, s in zip((weights, bias), (x.T @ slope, slope.sum(0)), state, strict=True):
                s[0] += 0.1 * (g - s[0])
                s[1] += 0.01 * (g * g - s[1])
                p -= rate * s[0] / (1 - 0.9 ** step) / (np.sqrt(s[1] / (1 - 0.99 ** step)) + 1e-8)
    return Codes(names, code, weights, bias)


def train(docs: DataFrame, *, text_col: str = "text", lang_col: str = "lang", usable: Column | None = None,
          order: Column | None = None, per_lang: int = 300, **how) -> Codes | None:
    """Codes learned from texts with a language, those for which ``usable`` holds.

    About ``per_lang`` of each language are drawn, by the hash of ``order``.
    """
    known = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    if usable is not None:
        known = known.where(usable)
    place = F.pmod(F.xxhash64(order if order is not None else F.col(text_col)), F.lit(1 << 32))
    known = known.select(place.alias("place"), F.col(lang_col).cast("string").alias("lang"),
                         F.col(text_col).cast("string").alias("text"))
    counts = known.groupBy("lang").count().collect()
    if not counts:
        return None
    limit = F.create_map(*[F.lit(x) for lang, n in counts for x in (lang, int((1 << 32) * min(1, per_lang / n)))])
    sample = known.where(F.col("place") < limit[F.col("lang")])

    def features(batches):
        for batch in batches:
            buckets, shares = [], []
            for _, data, off in arrays.blocks(batch.column(2), 1 << 18):
                for lo in range(0, len(off) - 1, 64):
                    part = off[lo:lo + 65]
                    for x in frequencies(data[part[0]:part[-1]], part - part[0]):
                        at = np.flatnonzero(x)
                        buckets.append(at.astype(np.int32))
                        shares.append(x[at])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(buckets, pa.list_(pa.int32())),
                 pa.array(shares, pa.list_(pa.float32()))], ["place", "lang", "bucket", "share"])

    def from_rows(batches):
        langs, buckets, shares = [], [], []
        for batch in batches:
            langs += batch.column(1).to_pylist()
            buckets += [np.asarray(b.values) for b in batch.column(2)]
            shares += [np.asarray(b.values) for b in batch.column(3)]
        rows = np.concatenate([[0], np.cumsum([len(b) for b in buckets])]).astype(int)
        return learn(langs, rows, np.concatenate(buckets), np.concatenate(shares), **how) if langs else None

    return fit(sample.mapInArrow(features, "place long, lang string, bucket array<int>, share array<float>"),
               from_rows)


def has_letter(data: np.ndarray) -> bool:
    """Whether UTF-8 bytes hold a letter of any script."""
    return bool((_LETTER & (arrays._BYTES < 0x80))[data].any()) or any(
        map(str.isalpha, data[data >= 0x80].tobytes().decode("utf-8", "ignore")))


def predict(docs: DataFrame, codes: Codes | None, *, id_col: str = "doc_id", text_col: str = "text",
            close: float = 0.5) -> DataFrame:
    """Language, score, runner-up and ambiguity of every text.

    A text is ambiguous when the runner-up has at least ``close`` of the best
    score.
    """
    def run(batches):
        for batch in batches:
            langs, scores, others, unsure = [], [], [], []
            for _, data, off in arrays.blocks(batch.column(1), 1 << 18):
                for lo in range(0, len(off) - 1, 64):
                    part = off[lo:lo + 65]
                    own, at = data[part[0]:part[-1]], part - part[0]
                    letters = [codes is not None and has_letter(own[a:b])
                               for a, b in zip(at[:-1], at[1:], strict=True)]
                    if not any(letters):
                        best = [(0, 0, 0.0, 0.0)] * len(letters)
                    else:
                        best = zip(*codes.decode(frequencies(own, at)), strict=True)
                    for known, (first, second, p, q) in zip(letters, best, strict=True):
                        langs.append(codes.langs[first] if known else "und")
                        scores.append(float(p) if known else 0.0)
                        others.append(codes.langs[second] if known and second != first else None)
                        unsure.append(bool(not known or q >= close * p))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64()),
                 pa.array(others, pa.string()), pa.array(unsure, pa.bool_())],
                ["doc_id", "lang_pred", "score", "runner_up", "ambiguous"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, T.StructType([
        rows.schema[0], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
        T.StructField("runner_up", T.StringType()), T.StructField("ambiguous", T.BooleanType())]))
