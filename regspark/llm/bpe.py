"""Byte-pair encoding by a segment tree over adjacent pair ranks, and decoding.

A text is cut into pieces by the tokenizer's pattern. A piece starts as its
bytes; the leaves of a segment tree hold the merge rank of each adjacent pair,
every inner node the lower of its two children, and the root therefore names the
leftmost pair of lowest rank. Merging it changes the pairs on its two sides and
removes one, which are point updates along the path to the root. This goes on
until the root says that no pair can be merged, so a piece of n bytes costs
n log n, however long it is. Short pieces not met before are worked out together,
each with a tree of its own in a row of one array.

Strings the tokenizer file adds to its vocabulary are found first and have ids
of their own. Pieces met before are looked up; what a task remembers is bounded.

Null text is empty and has no ids. Ids that stand for nothing decode to nothing,
bytes that are no UTF-8 to the replacement character. Null and repeated ids of
rows pass through, other columns are ignored by ``encode`` and kept by
``decode``, an empty table gives no rows. Texts are encoded whole; memory is an
Arrow batch of texts and, for the longest piece, some 40 bytes a byte.
"""

from __future__ import annotations

import json
import unicodedata
from array import array
from collections.abc import Iterable, Sequence
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SCHEMA = "doc_id long, n_tokens long, ids binary"

#: Output bytes after which a task sends its rows on.
BLOCK_BYTES = 1 << 23

#: Pieces a worker remembers (beside those of one block), and the longest in bytes.
REMEMBERED, LONGEST = 1 << 19, 64

#: Characters of text whose pieces are worked out together.
BLOCK_CHARS = 1 << 20

#: A pair that cannot be merged: after every rank.
NEVER = 1 << 62
_PLACE = 36  # bits of a leaf that hold the place of its pair
_PLACES = (1 << _PLACE) - 1


def _integers(values: Iterable[int], n: int):
    """A list of ``n`` integers, or eight bytes for each where they are many."""
    return list(values) if n < 4096 else array("q", values)


class PairTree:
    """Segment tree of minima over ``rank << 36 | place``, so ties go left."""

    def __init__(self, leaves: Iterable[int], n: int):
        self.size = size = 1 << max(0, n - 1).bit_length()
        nodes = _integers([NEVER], n) * size
        nodes.extend(leaves)
        nodes.extend([NEVER] * (2 * size - len(nodes)))
        for k in range(size - 1, 0, -1):
            left, right = nodes[2 * k], nodes[2 * k + 1]
            nodes[k] = left if left < right else right
        self.nodes = nodes

    def put(self, place: int, value: int) -> None:
        """Changes a leaf, and its ancestors up to the first that stays as it is."""
        nodes, k = self.nodes, place + self.size
        if nodes[k] == value:
            return
        nodes[k] = value
        while k > 1:
            other = nodes[k ^ 1]
            if other < value:
                value = other
            k >>= 1
            if nodes[k] == value:
                return
            nodes[k] = value


def merge_all(ids: list[int], ranks: dict[tuple[int, int], int], made: list[int]) -> list[int]:
    """``ids`` after all merges: always the leftmost of the pairs of lowest rank.

    ``ranks`` has the rank of each pair that merges, shifted by ``_PLACE`` bits;
    ``made`` has the id that a rank makes.
    """
    n = len(ids)
    if n < 2:
        return ids
    get = ranks.get
    ids = _integers(ids, n)
    tree = PairTree((get((ids[i], ids[i + 1]), NEVER) | i for i in range(n - 1)), n - 1)
    nodes, put = tree.nodes, tree.put
    after, before = _integers(range(1, n + 1), n), _integers(range(-1, n), n)
    while (least := nodes[1]) < NEVER:
        i = least & _PLACES
        gone = after[i]
        follows = after[gone]
        ids[i] = new = made[least >> _PLACE]
        ids[gone] = -1
        after[i] = follows
        before[follows] = i
        if follows < n:
            put(gone, NEVER | gone)
            put(i, get((new, ids[follows]), NEVER) | i)
        else:
            put(i, NEVER | i)
        h = before[i]
        if h >= 0:
            put(h, get((ids[h], new), NEVER) | h)
    return [x for x in ids if x >= 0]


class Forest:
    """Merges of many short pieces at once: one tree a row, one merge a row a step."""

    def __init__(self, ranks: dict[tuple[int, int], int], made: list[int]):
        self.base = 1 + max(chain((0,), made, *ranks))  # above every id
        keys = np.array([a * self.base + b for a, b in ranks], np.int64)
        order = np.argsort(keys)
        # A last key that no pair has keeps every search inside the array.
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.ranks = np.append(np.array(list(ranks.values()), np.int64)[order], NEVER)
        self.made = np.array(made, np.int64)

    def _leaf(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        key = np.where((left < 0) | (right < 0), -1, left * self.base + right)
        at = np.searchsorted(self.keys, key)
        return np.where(self.keys[at] == key, self.ranks[at], NEVER) | place

    def merge(self, pieces: Sequence[Sequence[int]]) -> list[bytes]:
        """Encoded ids of pieces, each given as its first ids."""
        lengths = np.array([len(p) for p in pieces])
        size = 1 << max(1, int(lengths.max()) - 1).bit_length()
        rows, width = len(pieces), size + 2  # two columns stay -1: beyond either end
        ids = np.full((rows, width), -1, np.int64)
        ids[np.arange(width) < lengths[:, None]] = np.concatenate([np.asarray(p, np.int64) for p in pieces])
        places = np.arange(size)
        nodes = np.full((rows, 2 * size), NEVER, np.int64)
        nodes[:, size:] = self._leaf(ids[:, :size], ids[:, 1:size + 1], places)
        level = size
        while level > 1:
            level //= 2
            nodes[:, level:2 * level] = np.minimum(nodes[:, 2 * level:4 * level:2], nodes[:, 2 * level + 1:4 * level:2])
        after = np.tile(np.minimum(np.arange(1, width + 1), size), (rows, 1))
        before = np.tile(np.arange(-1, width - 1), (rows, 1))
        flat = nodes.reshape(-1)
        while len(row := np.flatnonzero(nodes[:, 1] < NEVER)):
            least = nodes[row, 1]
            i, new = least & _PLACES, self.made[least >> _PLACE]
            gone = after[row, i]
            follows, h = after[row, gone], before[row, i]
            ids[row, i], ids[row, gone] = new, -1
            after[row, i], before[row, follows] = follows, i
            here = self._leaf(new, ids[row, follows], i)
            there = np.where(h < 0, here, self._leaf(ids[row, h], new, h & _PLACES))
            tree = np.tile(row * (2 * size), 3)
            k = np.concatenate([gone, i, np.where(h < 0, i, h)]) + size
            flat[tree + k] = np.concatenate([NEVER | gone, here, there])
            while k[0] > 1:
                k >>= 1
                child = tree + 2 * k
                flat[tree + k] = np.minimum(flat[child], flat[child + 1])
        kept = ids >= 0
        raw, ends = ids[kept].astype("<u4").tobytes(), 4 * np.cumsum(kept.sum(1))
        return [raw[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]


def byte_characters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary.

    Bytes that print stand for themselves, the others for the characters from
    U+0100 on, in order.
    """
    shown = {*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)}
    other = iter(range(256, 512))
    return [chr(b if b in shown else next(other)) for b in range(256)]


@lru_cache(maxsize=1 << 16)
def _unassigned(c: str) -> bool:
    return unicodedata.category(c) == "Cn"


class _Pieces(dict):
    """Encoded ids, as bytes, of pieces met before; works others out."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        return self.encode(piece)


class BytePairs:
    """Encoder and decoder of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self._check(spec)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
        self.ranks = {(vocab[a], vocab[b]): rank << _PLACE for rank, (a, b) in enumerate(pairs)}
        self.made = [vocab[a + b] for a, b in pairs]
        letters = byte_characters()
        self.bytes = [vocab[c] for c in letters]
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        value = {c: bytes([b]) for b, c in enumerate(letters)}
        self.tokens = {
            i: b"".join(value[c] for c in token) if all(c in value for c in token) else token.encode()
            for token, i in (vocab | added).items()}
        self.added = {token: i.to_bytes(4, "little") for token, i in added.items()}
        self.split_added = regex.compile("(" + "|".join(
            regex.escape(t) for t in sorted(added, key=len, reverse=True)) + ")") if added else None
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.pieces = _Pieces(self._piece)
        self.forest = Forest(self.ranks, self.made)
        self.path = path
        self.own = None

    @staticmethod
    def _check(spec) -> None:
        before, model = spec["pre_tokenizer"], spec["model"]
        if spec["normalizer"] or model["type"] != "BPE" or model["dropout"] or model.get("ignore_merges") \
                or before["type"] != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("not a plain byte-level BPE file")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that depend on what surrounds them")

    def _piece(self, piece: str) -> bytes:
        ids = merge_all([self.bytes[b] for b in piece.encode("utf-8", "surrogatepass")], self.ranks, self.made)
        return array("I", ids).tobytes()

    def _split(self, text: str) -> list[str]:
        """Pieces of a text, as the tokenizer's own pattern cuts it.

        Which characters are letters or digits depends on the Unicode version. Texts
        with characters that Python's does not know are cut by the library itself.
        """
        if text.isascii() or not any(map(_unassigned, set(text))):
            return self.pattern.findall(text)
        if self.own is None:
            from tokenizers import Tokenizer

            self.own = Tokenizer.from_file(self.path).pre_tokenizer
        return [text[start:end] for _, (start, end) in self.own.pre_tokenize_str(text)]

    def _learn(self, pieces: Iterable[str]) -> None:
        """Remembers the ids of pieces not met before, those of like length together."""
        if len(self.pieces) >= REMEMBERED:
            self.pieces.clear()
        classes: dict[int, list[tuple[str, list[int]]]] = {}
        for piece in {p for p in pieces if p not in self.pieces}:
            raw = piece.encode("utf-8", "surrogatepass")
            if len(raw) <= LONGEST:
                classes.setdefault((len(raw) - 1).bit_length(), []).append((piece, [self.bytes[b] for b in raw]))
        for members in classes.values():
            names, ids = zip(*members, strict=True)
            self.pieces.update(zip(names, self.forest.merge(ids), strict=True))

    def encode_all(self, texts: Sequence[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = []  # of each text: runs of pieces, and ids of added tokens between them
        for text in texts:
            if self.split_added is None or not self.split_added.search(text):
                parts.append([self._split(text)])
            else:
                parts.append([self.added[part] if i % 2 else self._split(part)
                              for i, part in enumerate(self.split_added.split(text))])
        self._learn(chain.from_iterable(run for part in parts for run in part if isinstance(run, list)))
        known = self.pieces.__getitem__
        return [b"".join([b"".join(map(known, run)) if isinstance(run, list) else run for run in part])
                for part in parts]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, ids: bytes) -> str:
        token = self.tokens.get
        return b"".join([token(i, b"") for i in memoryview(ids).cast("I")]).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def byte_pairs(path: str) -> BytePairs:
    """The tokenizer at ``path``, read once per worker."""
    return BytePairs(path)


def encode(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> DataFrame:
    """Token ids of every text: their number, and themselves as binary
    (little-endian unsigned 32-bit). ``path`` is a byte-level BPE file of the
    ``tokenizers`` library; without one, ``byte_bpe_50k.json`` is used."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")

    def run(batches):
        tokenizer = byte_pairs(path)

        def sent(names, texts):
            ids = tokenizer.encode_all(texts)
            return pa.RecordBatch.from_arrays(
                [pa.array(names, pa.int64()), pa.array([len(i) // 4 for i in ids], pa.int64()),
                 pa.array(ids, pa.binary())], ["doc_id", "n_tokens", "ids"])

        names, texts, chars = [], [], 0
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                names.append(name)
                texts.append(text.as_py() or "")
                chars += len(texts[-1])
                if chars >= BLOCK_CHARS:
                    yield sent(names, texts)
                    names, texts, chars = [], [], 0
        yield sent(names, texts)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, SCHEMA)


def decode(frame: DataFrame, *, ids_col: str = "ids", into: str = "decoded", path: str | None = None) -> DataFrame:
    """The rows of ``frame`` with the text of their ids in ``into``, which is
    replaced where it exists. Null ids give a null text."""
    path = path or public_tokenizers.path("byte_bpe_50k.json")
    kept = frame.drop(into)
    at = kept.columns.index(ids_col)

    def run(batches):
        tokenizer = byte_pairs(path)
        for batch in batches:
            first, held = 0, 0
            texts = []
            for i, ids in enumerate(batch.column(at)):
                raw = ids.as_py()
                texts.append(None if raw is None else tokenizer.decode(raw))
                held += len(raw or b"")
                if held >= BLOCK_BYTES or i == batch.num_rows - 1:
                    part = batch.slice(first, i + 1 - first)
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())],
                                                     [*part.schema.names, into])
                    first, held, texts = i + 1, 0, []

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField(into, T.StringType())]))
