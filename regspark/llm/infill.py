"""Fill-in-the-middle examples: two cuts of a text, found in a set of its boundaries.

The places (byte offsets) at which a unit of a text may begin or end form a set
of integers, kept in containers of 2^16 places: sorted arrays where few places
are set, bitmaps where many are, and runs where they follow each other, whichever
is smallest. A unit number is turned into a place by ``select``: a binary search
over the cumulative cardinalities finds the container, and a local select in it
the place. So both cuts cost logarithmic time, and a text of plain ASCII, however
long, is a run per container.

Where to cut, and which form an example takes, follows from a hash of the row's
id, so every run and every retry gives the same examples.

Null or empty text stays as it is (form ``plain``), and so does a text that
holds one of the marks, which therefore never are ambiguous. A null id hashes as
no digits. Repeated rows give repeated examples, other columns are ignored, and
an empty table gives no rows. Memory: one Arrow batch of texts and, per text,
its boundary set.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Places a container covers; the upper bits of a place name its container.
SPAN = 1 << 16
BITMAP_BYTES = SPAN // 8

MARKS = ("<P>", "<S>", "<M>")

#: Output bytes after which a task sends its rows on.
BLOCK_BYTES = 1 << 23

SCHEMA = "doc_id long, n long, form string, prefix_units long, middle_units long, output string"


class ArrayContainer:
    """Few places: their lower 16 bits, in order."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)
        self.bytes = self.low.nbytes

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """Many scattered places: a bit each, with the ones before every 64-bit word."""

    def __init__(self, member: np.ndarray):
        bits = np.zeros(SPAN, bool)
        bits[:len(member)] = member
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        counts = np.bitwise_count(self.words)
        self.before = np.cumsum(counts, dtype=np.int64) - counts
        self.bytes = BITMAP_BYTES

    def select(self, k: int) -> int:
        word = int(np.searchsorted(self.before, k, "right")) - 1
        bits = np.unpackbits(self.words[word:word + 1].view(np.uint8), bitorder="little")
        return 64 * word + int(np.flatnonzero(bits)[k - int(self.before[word])])


class RunContainer:
    """Consecutive places: the first of each run, with the places before the run."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.starts = starts
        lengths = ends - starts
        self.before = np.cumsum(lengths) - lengths
        self.bytes = 2 + 4 * len(starts)

    def select(self, k: int) -> int:
        run = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[run]) + k - int(self.before[run])


def container(member: np.ndarray):
    """The smallest container of the places at which ``member`` is true."""
    edge = np.flatnonzero(member[1:] != member[:-1]) + 1
    if member[0]:
        edge = np.concatenate([[0], edge])
    if member[-1]:
        edge = np.concatenate([edge, [len(member)]])
    n = int(np.count_nonzero(member))
    runs = 2 + 4 * (len(edge) // 2)
    if runs <= min(2 * n, BITMAP_BYTES):
        return RunContainer(edge[::2], edge[1::2])
    return ArrayContainer(np.flatnonzero(member)) if 2 * n <= BITMAP_BYTES else BitmapContainer(member)


class BoundarySet:
    """A set of places, from a mask over them; answers which is the k-th."""

    def __init__(self, mask: np.ndarray):
        self.keys, self.containers, self.before = [], [], []
        self.size = 0
        for first in range(0, len(mask), SPAN):
            member = mask[first:first + SPAN]
            n = int(np.count_nonzero(member))
            if n:
                self.keys.append(first)
                self.containers.append(container(member))
                self.before.append(self.size)
                self.size += n

    def __len__(self) -> int:
        return self.size

    def select(self, k: int) -> int:
        """The place that ``k`` places precede."""
        if not 0 <= k < self.size:
            raise IndexError(k)
        at = bisect_right(self.before, k) - 1
        return self.keys[at] + self.containers[at].select(k - self.before[at])


def _chars(data: np.ndarray) -> np.ndarray:
    return (data & 0xC0) != 0x80


def _words(data: np.ndarray) -> np.ndarray:
    blank = (data == 0x20) | ((data >= 0x09) & (data <= 0x0D))
    starts = ~blank
    starts[1:] &= blank[:-1]
    starts[:1] = True
    return starts


def _lines(data: np.ndarray) -> np.ndarray:
    return np.concatenate([np.ones(min(1, len(data)), bool), data[:-1] == 0x0A])


#: Bytes of a UTF-8 text to a mask of the places where a unit begins. A word
#: begins after a blank and keeps the blanks that follow it; a line keeps its end.
UNITS: dict[str, Callable[[np.ndarray], np.ndarray]] = {"char": _chars, "word": _words, "line": _lines}


def boundaries(raw: bytes, unit: str = "char") -> BoundarySet:
    """Places of ``raw`` at which a unit begins, and its end: one more than units."""
    return BoundarySet(np.append(UNITS[unit](np.frombuffer(raw, np.uint8)), True))


def draws(key: str) -> list[int]:
    """Eight 32-bit numbers from the sha256 of ``key``, by its hex digits in order."""
    digest = hashlib.sha256(key.encode()).digest()
    return [int.from_bytes(digest[i:i + 4], "big") for i in range(0, 32, 4)]


def example(raw: bytes, key: str, unit: str = "char", plain_from: int = 90, spm_below: int = 20,
            marks: tuple[bytes, ...] = tuple(m.encode() for m in MARKS)):
    """(units, form, prefix units, middle units, output) of one text.

    ``key`` decides the cuts, and the form in percent: ``plain`` from
    ``plain_from`` on, else ``spm`` below ``spm_below``, else ``psm``.
    """
    cuts = boundaries(raw, unit)
    n = len(cuts) - 1
    h = draws(key)
    if not raw or h[2] % 100 >= plain_from or any(m in raw for m in marks):
        return n, "plain", None, None, raw
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    first, second = cuts.select(low), cuts.select(high)
    prefix, middle, suffix = raw[:first], raw[first:second], raw[second:]
    p, s, m = marks
    if h[3] % 100 < spm_below:
        return n, "spm", low, high - low, b"".join((s, suffix, p, prefix, m, middle))
    return n, "psm", low, high - low, b"".join((p, prefix, s, suffix, m, middle))


def transform(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", seed: str = "1",
              unit: str = "char", plain_from: int = 90, spm_below: int = 20,
              marks: tuple[str, str, str] = MARKS) -> DataFrame:
    """Every text as an example: units, form, units of prefix and middle, output.

    ``seed`` goes before the id into the hash, so other seeds cut elsewhere.
    ``unit`` is one of ``UNITS``. ``marks`` stand before prefix, suffix, middle.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {sorted(UNITS)}")
    _check(marks)
    signs = tuple(m.encode() for m in marks)

    def run(batches):
        rows, held = [], 0

        def sent():
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                              [c.split()[0] for c in SCHEMA.split(", ")])

        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.large_binary()), strict=True):
                made = example(text.as_py() or b"", f"{seed}:{'' if name is None else name}", unit,
                               plain_from, spm_below, signs)
                rows.append((name, *made))
                held += len(made[-1])
                if held >= BLOCK_BYTES:
                    yield sent()
                    rows, held = [], 0
        yield sent()

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, SCHEMA)


def _check(marks) -> None:
    if len(set(marks)) != 3 or not all(re.fullmatch("<[^<>]+>", m) for m in marks):
        raise ValueError("marks must be three different names in angle brackets")


def restored(output: Column, form: Column, marks: tuple[str, str, str] = MARKS) -> Column:
    """The text an example was made of. Marks occur once each, so they split it."""
    _check(marks)
    parts = F.split(output, "|".join(re.escape(m) for m in marks), -1)
    return F.when(form == "plain", output).when(
        form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))
