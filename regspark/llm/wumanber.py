"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The symbols are words. Patterns are windows of consecutive words of the
benchmark items. A table of two-word blocks tells how far the search may jump:
a block that no pattern contains skips almost a whole window. Where the shift is
zero the block's hash selects the patterns that end so, and their words are
compared one by one with those of the document.

Documents are scanned where they are read, without a shuffle; the cursors of all
documents of a block advance together, long documents from several starts.

Null or empty text has no words and no hits. Items without words have no
windows; an item without id is listed as ``null``. Repeated items and documents
are taken as they come, other columns are ignored, empty tables give no hits or
no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm import arrays

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}

RESULT = [("n_words", "long"), ("n_hit", "long"), ("n_items", "long"), ("items_sha256", "string"),
          ("contaminated", "boolean")]


def item_windows(items, size: int) -> dict[int, dict[bytes, set[str]]]:
    """Windows by their number of words: joined words to the ids of their items."""
    found: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = [w.encode() for w in WORD.findall((text or "").translate(LOWER))]
        length = min(size, len(words))
        for i in range(len(words) - length + 1 if words else 0):
            found[length][b" ".join(words[i:i + length])].add("null" if item is None else str(item))
    return {n: dict(w) for n, w in found.items()}


def _hashes(words: list[bytes]) -> np.ndarray:
    data = np.frombuffer(b" ".join(words), np.uint8)
    lengths = np.array([len(w) for w in words])
    ends = np.cumsum(lengths + 1) - 1
    return arrays.word_hashes(data, ends - lengths, ends)


class Search:
    """The tables for patterns of ``length`` words each."""

    #: Words per cursor; a longer document is searched from several starts.
    STRIDE = 512

    def __init__(self, length: int, patterns: dict[bytes, set[str]]):
        self.length, self.items = length, list(patterns.values())
        self.block = min(2, length)
        self.texts = list(patterns)
        per_word = _hashes([w for t in self.texts for w in t.split(b" ")]).reshape(len(self.texts), length)
        blocks = self._blocks(per_word)
        bits = max(12, int(blocks.size * 8).bit_length())
        self.mask = np.uint64((1 << bits) - 1)
        longest = length - self.block + 1
        self.shift = np.full(1 << bits, longest, np.int32)
        for j in range(blocks.shape[1]):
            np.minimum.at(self.shift, (blocks[:, j] & self.mask).astype(np.int64), blocks.shape[1] - 1 - j)
        self.bucket = defaultdict(list)
        for i, suffix in enumerate(blocks[:, -1].tolist()):
            self.bucket[suffix].append(i)

    def _blocks(self, hashes: np.ndarray) -> np.ndarray:
        if self.block == 1:
            return hashes
        return arrays.mix(hashes[..., :-1] * np.uint64(3) + hashes[..., 1:] * np.uint64(5))

    def occurrences(self, data, starts, ends, hashes, rows):
        """Yields (index of the last word, pattern) for all occurrences.

        ``rows`` has the index of each document's first word, and the total.
        """
        first, limit = rows[:-1] + self.length - 1, rows[1:]
        counts = np.maximum(0, -(-(limit - first) // self.STRIDE))
        turn = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        at = np.repeat(first, counts) + turn * self.STRIDE
        stop = np.minimum(at + self.STRIDE, np.repeat(limit, counts))
        while len(at):
            block = hashes[at] if self.block == 1 else arrays.mix(
                hashes[at - 1] * np.uint64(3) + hashes[at] * np.uint64(5))
            jump = self.shift[(block & self.mask).astype(np.int64)]
            for word, suffix in zip(at[jump == 0].tolist(), block[jump == 0].tolist(), strict=True):
                candidates = self.bucket.get(suffix)
                if candidates:
                    lo = word - self.length + 1
                    text = b" ".join(arrays.LOWER[data[a:b]].tobytes()
                                     for a, b in zip(starts[lo:word + 1], ends[lo:word + 1], strict=True))
                    for i in candidates:
                        if self.texts[i] == text:
                            yield word, i
            at = at + np.maximum(jump, 1)
            stays = at < stop
            at, stop = at[stays], stop[stays]


def scan(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
         item_col: str = "item_id", item_text_col: str = "text", window: int = 13, share: int = 20,
         part_bytes: int = 1 << 26, carry: bool = False) -> DataFrame:
    """Words of each document that lie inside a window of a benchmark item.

    A document is contaminated when ``share * n_hit >= n_words`` and any word is
    hit. With ``carry`` the column ``row`` holds the document's input columns.
    Tasks get the benchmark in parts of about ``part_bytes`` of text, whatever
    its size; each part is one pass over the words, in the same stage.
    """
    texts = benchmark.select(F.col(item_col).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(1, -(-size // part_bytes))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"),
                       *([F.struct(*docs.columns).alias("row")] if carry else []))
    for part in range(parts):
        mine = texts.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == part) if parts > 1 else texts
        rows = _pass(rows, item_windows(mine.collect(), window), share, part == 0, part == parts - 1)
    return rows


def _pass(rows: DataFrame, windows, share: int, first: bool, last: bool) -> DataFrame:
    """Adds the hits of one part of the benchmark; the last part makes the result."""
    kept = [f for f in rows.schema if f.name not in ("text", "hit", "items") or not last and f.name == "text"]
    extra = [T.StructField(n, T._parse_datatype_string(t)) for n, t in RESULT] if last else [
        T.StructField("hit", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))]
    names = [f.name for f in kept]

    def run(batches):
        searches = [Search(n, patterns) for n, patterns in windows.items()]
        for batch in batches:
            at = {n: i for i, n in enumerate(batch.schema.names)}
            column = batch.column(at["text"])
            out = [[] for _ in extra]
            for row, data, off in arrays.blocks(column):
                starts, ends, rows_at = arrays.words(data, off, arrays.ALNUM)
                hashes = arrays.word_hashes(data, starts, ends)
                cover = np.zeros(len(starts) + 1, np.int64)
                items = defaultdict(set)
                for s in searches:
                    for word, i in s.occurrences(data, starts, ends, hashes, rows_at):
                        cover[word - s.length + 1] += 1
                        cover[word + 1] -= 1
                        items[int(np.searchsorted(rows_at, word, "right")) - 1] |= s.items[i]
                hit = np.cumsum(cover[:-1]) > 0
                if not first:
                    for k in range(len(off) - 1):
                        hit[rows_at[k] + np.array(batch.column(at["hit"])[row + k].as_py(), np.int64)] = True
                        items[k] |= set(batch.column(at["items"])[row + k].as_py())
                total = np.concatenate([[0], np.cumsum(hit)])
                for k in range(len(off) - 1):
                    a, b = int(rows_at[k]), int(rows_at[k + 1])
                    if last:
                        n = int(total[b] - total[a])
                        listed = ",".join(sorted(items[k])) if k in items else ""
                        values = (b - a, n, len(items[k]) if k in items else 0,
                                  hashlib.sha256(listed.encode()).hexdigest(), n > 0 and share * n >= b - a)
                    else:
                        values = (np.flatnonzero(hit[a:b]).tolist(), sorted(items[k]) if k in items else [])
                    for c, v in zip(out, values, strict=True):
                        c.append(v)
            kinds = [pa.int64()] * 3 + [pa.string(), pa.bool_()] if last else [
                pa.list_(pa.int32()), pa.list_(pa.string())]
            yield pa.RecordBatch.from_arrays(
                [batch.column(at[n]) for n in names] + [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                names + [f.name for f in extra])

    return rows.mapInArrow(run, T.StructType(kept + extra))
