"""License scan: Aho-Corasick for tags and notices, shunting-yard for expressions.

One automaton finds all notice phrases and identifier tags in a single pass over
the words of a text. What follows a tag is read as a license expression, turned
into postfix order with a stack of operators, and evaluated to its alternatives:
``or`` joins alternatives, ``and`` combines them, ``with`` adds an exception to
the license before it. An expression ends with its line, unless a parenthesis is
open. All its licenses give labels, however many alternatives it has.

Texts are scanned where they are read, without a shuffle. Null or empty text has
no words and no labels. Repeated rows are taken as they come; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regspark.llm import arrays

# Phrases that must be found, and their labels.
BASE = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Further notices; they add labels and never replace the ones above.
NOTICES = {
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "mozilla public license": "mpl",
    "eclipse public license": "epl",
    "bsd license": "bsd",
    "isc license": "isc",
    "boost software license": "bsl",
    "creative commons zero": "cc0",
    "cc by sa": "cc-by-sa",
    "cc by nc": "cc-by-nc",
    "cc by nd": "cc-by-nd",
    "creative commons attribution": "cc-by",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "redistribution and use in source and binary forms": "bsd",
}
TAGS = ("spdx license identifier",)

_TOKEN = re.compile(r"[ \t]*(?:([()])|([A-Za-z0-9][A-Za-z0-9.+-]*))")
#: The way to the next token in a parenthesis: line breaks, each with a mark of a comment or none.
_BREAK = re.compile(r"(?:[ \t\r]*\n[ \t]*(?:(?:/{2,}|\*+|#+|;+|-{2,}|%+|!+)(?!/))?)+")
#: Alternatives up to which an expression is written as such; a longer one is written in factored form.
MOST_ALTERNATIVES = 64
BINDS = {"or": 1, "and": 2, "with": 3}


def tokens(text: str, at: int = 0) -> list[str]:
    """The longest run of identifiers, operators and parentheses from ``at``.

    It ends with the line, unless a parenthesis is open there.
    """
    found, operand, depth = [], True, 0
    while True:
        m = _TOKEN.match(text, at)
        if m is None and depth and (line := _BREAK.match(text, at)):
            m = _TOKEN.match(text, line.end())
        if m is None:
            break
        token = m[1] or m[2].lower()
        if token in BINDS or token == ")":
            if operand or token == ")" and not depth:
                break
            operand = token != ")"
        elif not operand:
            break
        else:
            operand = token == "("
        depth += {"(": 1, ")": -1}.get(token, 0)
        found.append(token)
        at = m.end()
    return found


def postfix(found: list[str]) -> list[str] | None:
    """Shunting-yard order of ``found``; None if it is no whole expression."""
    out, stack = [], []
    for token in found:
        if token in BINDS:
            while stack and stack[-1] != "(" and BINDS[stack[-1]] >= BINDS[token]:
                out.append(stack.pop())
            stack.append(token)
        elif token == "(":
            stack.append(token)
        elif token == ")":
            while stack and stack[-1] != "(":
                out.append(stack.pop())
            if not stack:
                return None
            stack.pop()
        else:
            out.append(token)
    if "(" in stack:
        return None
    return out + stack[::-1]


class Choice:
    """What a part of an expression lets one choose from.

    ``kind`` is the operator that joins ``parts``, the written operands (none: a
    single license). ``names`` are all its licenses, ``sets`` the alternatives,
    None if they are too many.
    """

    def __init__(self, kind: str, parts: set[str], names: set[str], sets: list[frozenset[str]] | None):
        self.kind, self.parts, self.names, self.sets = kind, parts, names, sets

    @classmethod
    def of(cls, name: str) -> Choice:
        return cls("", {name}, {name}, [frozenset([name])])

    def operands(self, kind: str) -> set[str]:
        if self.kind in (kind, ""):
            return self.parts
        return {self.written() if kind == "or" else f"({self.written()})"}

    def written(self) -> str:
        """The factored form: ``or`` as ``|``, ``and`` as ``&``, an ``or`` within an ``and`` in parentheses."""
        return (" & " if self.kind == "and" else " | ").join(sorted(self.parts))

    def joined(self, kind: str, right: Choice, most: float) -> Choice:
        sets = None
        if self.sets is not None and right.sets is not None:
            sets = list(dict.fromkeys(self.sets + right.sets if kind == "or" else [
                a | b for a in self.sets for b in right.sets]))
        sets = sets if sets is not None and len(sets) <= most else None
        few, many = sorted((self.operands(kind), right.operands(kind)), key=len)
        less, names = sorted((self.names, right.names), key=len)
        names |= less
        if len(many) == 1 and few == many:
            return Choice(self.kind, self.parts, names, sets)
        many |= few
        return Choice(kind, many, names, sets)


def evaluated(found: list[str], most: float = MOST_ALTERNATIVES) -> Choice | None:
    """The choice of a whole expression; None if malformed."""
    order, stack = postfix(found), []
    for token in order or ():
        if token not in BINDS:
            stack.append(Choice.of(token))
            continue
        if len(stack) < 2:
            return None
        right, left = stack.pop(), stack.pop()
        if token != "with":
            stack.append(left.joined(token, right, most))
        elif left.kind == right.kind == "":
            stack.append(Choice.of(f"{min(left.parts)} with {min(right.parts)}"))
        else:
            return None
    return stack[0] if len(stack) == 1 else None


def read(text: str, at: int = 0, most: float = MOST_ALTERNATIVES) -> Choice | None:
    """The choice of the longest well-formed expression from ``at``."""
    found, ends, depth = tokens(text, at), [], 0
    for i, token in enumerate(found):
        depth += {"(": 1, ")": -1}.get(token, 0)
        if depth == 0 and token not in BINDS:
            ends.append(i + 1)
    # Only a ``with`` between groups makes a whole run malformed, and all longer ones.
    if ends and (whole := evaluated(found[:ends[-1]], most)) is None:
        fits = bisect_left(ends, True, key=lambda end: evaluated(found[:end], most) is None)
        whole = evaluated(found[:ends[fits - 1]], most) if fits else None
    return whole if ends else None


def read_expression(text: str) -> list[frozenset[str]] | None:
    """All alternatives of the longest well-formed expression at the start of ``text``.

    They can be very many; ``scan`` writes those of a long expression factored.
    """
    whole = read(text, most=float("inf"))
    return whole and whole.sets


def family(identifier: str) -> str:
    """Label of a license identifier: the name without version and suffixes."""
    name = identifier.split(" with ")[0].removesuffix("-only").removesuffix("-or-later").rstrip("+")
    return re.sub(r"-v?\d+(\.\d+)*(-clause)?.*$", "", name) or name


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for phrase in (*BASE, *NOTICES, *TAGS):
        found.add_word(f" {phrase} ", phrase)
    found.make_automaton()
    return found


def scan_text(text: str, finder: ahocorasick.Automaton) -> tuple:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, expressions."""
    raw = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = arrays.words(raw, np.array([0, len(raw)]), arrays.ALNUM)
    if not len(starts):
        return 0, 0, None, None, "", "", 0.0, []
    # The words joined by single spaces, as one byte string read as Latin-1.
    keep = arrays.ALNUM[raw]
    keep[ends[:-1]] = True
    joined = np.where(arrays.ALNUM, arrays.LOWER, 0x20).astype(np.uint8)[raw[keep]]
    line = b" " + joined.tobytes() + b" "
    at = np.cumsum(np.concatenate([[0], ends - starts + 1]))
    base, base_labels, labels, expressions, tags, plain = [], set(), set(), [], 0, None
    for end, phrase in finder.iter(line.decode("latin-1")):
        begin = end - len(phrase) - 1
        word = int(np.searchsorted(at, begin))
        if phrase in BASE:
            base.append(word)
            base_labels.add(BASE[phrase])
        elif phrase in NOTICES:
            labels.add(NOTICES[phrase])
        else:
            last = word + phrase.count(" ")
            plain = raw.tobytes().decode("latin-1") if plain is None else plain
            after = int(ends[last])
            if choice := read(plain, after + plain.startswith(":", after)):
                tags += 1
                labels |= {family(x) for x in choice.names}
                expressions.append(choice.written() if choice.sets is None else
                                   " | ".join(sorted(" & ".join(sorted(s)) for s in choice.sets)))
    labels |= base_labels
    places = len(base) + 2 * tags + len(labels - base_labels)
    return (len(starts), len(base), min(base, default=None), max(base, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), 1 - 0.5 ** places, expressions)


FIELDS = [("n_words", "long", pa.int64()), ("n_base", "long", pa.int64()), ("first_word", "long", pa.int64()),
          ("last_word", "long", pa.int64()), ("base_labels", "string", pa.string()),
          ("labels", "string", pa.string()), ("score", "double", pa.float64()),
          ("expressions", "array<string>", pa.list_(pa.string()))]


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Places and labels of license notices, and the expressions after tags.

    An expression reads as alternatives joined by ``|``, each a set of licenses
    joined by ``&``; one of more than MOST_ALTERNATIVES alternatives keeps its
    ``or`` in parentheses instead of being multiplied out. The score is 1 less one half for each place, added label
    and, twice, each expression.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches):
        finder = automaton()
        for batch in batches:
            out = [scan_text(t.as_py() or "", finder) for t in batch.column(1)]
            columns = list(zip(*out, strict=True)) if out else [[] for _ in FIELDS]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)] + [pa.array(c, k) for c, (_, _, k) in zip(columns, FIELDS, strict=True)],
                ["doc_id"] + [n for n, _, _ in FIELDS])

    return rows.mapInArrow(run, T.StructType([rows.schema[0]] + [
        T.StructField(n, T._parse_datatype_string(t)) for n, t, _ in FIELDS]))
