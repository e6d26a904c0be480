"""Hierarchical multi-length packing of tokenised documents.

Documents go to context-size tiers by their token count. Whole windows of long
documents stand alone; what remains of every document is routed to the smallest
tier that holds it. The longest tier is packed best-fit, its gaps are filled
from the shorter tiers, and each shorter tier is then cut exactly into windows
of its own size. Finished windows are dealt to step groups of equal tokens and
nearly equal attention cost.

Each task packs the rows it reads, block by block, and carries open pieces into
the next block, so there is no shuffle, a hot source costs what its rows cost,
and a lost task repeats only itself. Memory: one block of token ids.

A text of any length, runs of one character included, has the ids it has in the
tokenizer. Null or empty text is a document of the end id alone. Repeated rows and repeated
or null ids are packed as they come; other columns are ignored. An empty table
gives no rows.
"""

from __future__ import annotations

import base64
import json
import zlib
from bisect import bisect_right, insort
from collections import defaultdict
from heapq import heappop, heappush
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TIERS = (256, 512, 1024, 2048)

SCHEMA = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
          "offset long, tier int, sequence_tokens int, step_group long")


def added_tokens(path: str) -> dict[str, int]:
    """Ids of the tokens that the tokenizer file at ``path`` adds to its vocabulary."""
    with open(path, encoding="utf-8") as file:
        added = json.load(file)["added_tokens"]
    if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
        raise ValueError("added tokens that depend on what surrounds them")
    return {t["content"]: t["id"] for t in added}


def byte_pair_encoding(path: str, added: dict[str, int]):
    """The byte-pair vocabulary at ``path`` (ranks), and strings that have ids of their own."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens=added)


def token_ids(encoding, added: dict[str, int], text: str) -> list[int]:
    """Ids of a text. One with a run of blanks too long for the encoder's own
    pattern matcher is cut by the same pattern here and encoded piece by piece."""
    try:
        return encoding.encode(text, allowed_special=set(added), disallowed_special=())
    except ValueError:
        import regex

        parts = regex.split("(" + "|".join(map(regex.escape, added)) + ")", text) if added else [text]
        pieces = regex.compile(public_tokenizers.PATTERN).findall
        return [i for k, part in enumerate(parts) for i in (
            [added[part]] if k % 2 else chain.from_iterable(map(encoding._encode_single_piece, pieces(part))))]


class _Packer:
    """Packs the pieces of one task; ``done`` gets (tier, [pieces]) per window."""

    def __init__(self, tiers, least_cut):
        self.tiers, self.window, self.least_cut = tiers, tiers[-1], least_cut
        self.waiting = {t: [] for t in tiers}  # pieces, by tier, in order of arrival
        self.tokens = 0

    def add(self, doc, ids, done):
        whole = len(ids) // self.window * self.window
        for start in range(0, whole, self.window):
            done.append((self.window, [(doc, start, ids[start:start + self.window])]))
        if whole < len(ids):
            self._route(doc, whole, ids[whole:])

    def _route(self, doc, start, ids):
        tier = next(t for t in self.tiers if len(ids) <= t)
        self.waiting[tier].append((doc, start, ids))
        self.tokens += len(ids)

    def pack(self, done):
        """Closes every window that can be filled; the rest stays waiting."""
        pieces, self.tokens = self.waiting, 0
        self.waiting = {t: [] for t in self.tiers}
        # Shorter pieces by length, to find the longest that fits a gap.
        shorter = sorted(((len(p[2]), i, p) for i, p in enumerate(
            p for t in self.tiers[:-1] for p in pieces[t])), key=lambda x: x[:2])
        for piece in sorted(pieces[self.window], key=lambda p: -len(p[2])):
            row, gap = [piece], self.window - len(piece[2])
            while gap:
                at = bisect_right(shorter, gap, key=lambda x: x[0])
                if at:
                    size, _, fits = shorter.pop(at - 1)
                elif gap >= self.least_cut and shorter:
                    _, order, (doc, start, ids) = shorter.pop(0)
                    fits, size = (doc, start, ids[:gap]), gap
                    insort(shorter, (len(ids) - gap, order, (doc, start + gap, ids[gap:])), key=lambda x: x[:2])
                else:
                    break
                row.append(fits)
                gap -= size
            if gap < self.least_cut:
                done.append((self.window, row))
            else:
                for p in row:
                    self._route(*p)
        rest = defaultdict(list)
        for size, _, piece in shorter:
            rest[next(t for t in self.tiers if size <= t)].append(piece)
        for tier, left in rest.items():
            for p in self._cut(left, tier, done):
                self._route(*p)

    def _cut(self, pieces, size, done):
        """Cuts the run of ``pieces`` into windows of ``size``; returns what is left."""
        row, room = [], size
        for doc, start, ids in pieces:
            while len(ids):
                row.append((doc, start, ids[:room]))
                took = len(row[-1][2])
                start, ids, room = start + took, ids[took:], room - took
                if not room:
                    done.append((size, row))
                    row, room = [], size
        return row

    def close(self, done):
        """Packs what waits: full windows, then powers of two, so nothing is padded."""
        self.pack(done)
        left = [p for t in reversed(self.tiers) for p in self.waiting[t]]
        size = self.window
        while left:
            while size > sum(len(p[2]) for p in left):
                size //= 2
            left = self._cut(left, size, done) if size == self.window else self._cut_once(left, size, done)

    def _cut_once(self, pieces, size, done):
        row, rest, room = [], [], size
        for doc, start, ids in pieces:
            if room:
                row.append((doc, start, ids[:room]))
            if len(ids) > room:
                rest.append((doc, start + room, ids[room:]))
            room = max(0, room - len(ids))
        done.append((size, row))
        return rest


def step_groups(sequences, tokens: int):
    """Group number of each (tier, pieces): equal tokens, attention cost dealt evenly.

    Within a tier, the windows of highest cost (the sum of squared piece lengths)
    go first, each to the group of least cost that has room.
    """
    group, first = [0] * len(sequences), 0
    by_tier = defaultdict(list)
    for i, (tier, pieces) in enumerate(sequences):
        by_tier[tier].append((-sum(len(p[2]) ** 2 for p in pieces), i))
    for tier, members in sorted(by_tier.items()):
        n = -(-len(members) * tier // tokens)
        room = -(-len(members) // n)
        open_groups = [(0, k, 0) for k in range(n)]
        for cost, i in sorted(members):
            total, k, held = heappop(open_groups)
            group[i] = first + k
            if held + 1 < room:
                heappush(open_groups, (total - cost, k, held + 1))
        first += n
    return group, first


def pack(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", ranks: str | None = None,
         added: dict[str, int] | None = None, end_id: int = 1, tiers: tuple[int, ...] = TIERS, least_cut: int = 16,
         step_tokens: int = 1 << 16, block_tokens: int = 1 << 20) -> DataFrame:
    """One row per piece of a document in a packed sequence.

    Strings of ``added`` in a text are encoded as the id given there: those of
    ``byte_bpe_50k.json``, unless others are given; with ``{}`` they are plain text.
    ``tiers`` are window sizes, powers of two in rising order. A gap of under
    ``least_cut`` tokens in a longest window is padded; all other windows are
    full. ``block_tokens`` bounds the ids a task holds, ``step_tokens`` is the
    size of a step group. ``sequence_id`` and ``step_group`` number windows
    within the task's partition, whose number is in the upper bits.
    """
    if not tiers or list(tiers) != sorted(set(tiers)) or any(t & (t - 1) or t < 1 for t in tiers):
        raise ValueError("tiers must be rising powers of two")
    ranks = ranks or public_tokenizers.path("byte_bpe_50k.tiktoken")
    added = added_tokens(public_tokenizers.path("byte_bpe_50k.json")) if added is None else added

    def run(batches):
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 33
        encoding = byte_pair_encoding(ranks, added)
        packer, names, sizes = _Packer(tiers, least_cut), {}, {}
        made = groups = doc = held = 0

        def rows(done):
            nonlocal made, groups
            number, more = step_groups(done, step_tokens)
            columns = [[] for _ in range(10)]
            for (tier, pieces), group in zip(done, number, strict=True):
                offset, total = 0, sum(len(p[2]) for p in pieces)
                for d, start, ids in pieces:
                    for column, value in zip(columns, (
                            names[d], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), sizes[d],
                            base + made, offset, tier, total, base + groups + group), strict=True):
                        column.append(value)
                    offset += len(ids)
                made += 1
            groups += more
            waiting = {p[0] for held in packer.waiting.values() for p in held}
            for d in [d for d in names if d not in waiting]:
                del names[d], sizes[d]
            kinds = [pa.int64()] * 7 + [pa.int32()] * 2 + [pa.int64()]
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                [c.split()[0] for c in SCHEMA.split(", ")])

        done = []
        for batch in batches:
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = np.array([*token_ids(encoding, added, text.as_py() or ""), end_id], np.uint32)
                names[doc], sizes[doc] = name, len(ids)
                packer.add(doc, ids, done)
                doc, held = doc + 1, held + len(ids)
                if held >= block_tokens:
                    packer.pack(done)
                    yield rows(done)
                    done, held = [], packer.tokens
        packer.close(done)
        yield rows(done)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")) \
        .mapInArrow(run, SCHEMA)
