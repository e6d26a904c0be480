"""Personal data: patterns propose spans, checksums confirm, context adjusts.

Every kind has a pattern that proposes spans, a validator that confirms them
(Luhn for cards, mod 97 for bank account numbers, ranges and digit counts for
the rest), and words that raise or lower a span's score when they stand close
before it. Kinds marked as base are reported whatever their score; the others
need ``least_score``.

Native throughout: a text is cut by a pattern into the stretches between its
matches, so the running sum of lengths gives the place of every match in code
points. There is no shuffle; a text without a kind's telltale character is never
searched for it.

The patterns are written so that no text, however long its runs, makes them
backtrack: a run is taken whole (possessive) and entered at its start only.

Null text is empty and has no spans. Repeated rows are taken as they come, other
columns are ignored, an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Kind:
    """What is searched for. ``hint`` is a pattern-free test that a text may hold one."""

    name: str
    pattern: str
    hint: object
    valid: object
    base: bool
    score: float
    near: tuple[str, ...]


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _ip(s: Column) -> Column:
    return F.forall(F.split(s, r"\."), lambda p: F.length(F.ltrim(p, F.lit("0"))) <= 3) & F.forall(
        F.split(s, r"\."), lambda p: F.coalesce(F.substring(F.ltrim(p, F.lit("0")), 1, 3).try_cast("int"), F.lit(0)) <= 255)


def luhn(s: Column) -> Column:
    """Whether the digits of ``s`` pass the Luhn check."""
    digits = F.reverse(F.split(_digits(s), ""))
    doubled = F.transform(F.filter(digits, lambda d: d != ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise(
        d.cast("int") * 2 - F.when(d.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(doubled, F.lit(0), lambda a, d: a + d) % 10 == 0


def mod_97(s: Column) -> Column:
    """Whether ``s`` is an account number whose rearranged value leaves 1 modulo 97."""
    plain = F.replace(s, F.lit(" "), F.lit(""))
    turned = F.concat(F.substr(plain, F.lit(5)), F.substring(plain, 1, 4))
    parts = F.filter(F.split(turned, ""), lambda c: c != "")
    return F.aggregate(parts, F.lit(0), lambda a, c: F.when(
        c.between("0", "9"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)) == 1


def _between(low: int, high: int):
    return lambda s: F.length(_digits(s)).between(low, high)


# The patterns that must be found are, in plain form,
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
#   ip    [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+
#   phone \+[0-9][\x20().0-9-]+[0-9]
# and are stated here in forms that match the same spans in linear time.
KINDS = (
    Kind("email", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         lambda t: F.contains(t, F.lit("@")), lambda s: F.lit(True), True, 0.9, ("mail", "contact", "write")),
    Kind("ip", r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
         lambda t: F.contains(t, F.lit(".")), _ip, True, 0.6, ("ip", "address", "host", "server")),
    Kind("card", r"[0-9]++(?:[\x20-][0-9]++)*+",
         lambda t: F.lit(True), lambda s: _between(13, 19)(s) & luhn(s), True, 0.8, ("card", "visa", "credit", "pay")),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda t: F.contains(t, F.lit("+")), _between(9, 15), True, 0.7, ("phone", "call", "tel", "mobile", "fax")),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
         lambda t: F.lit(True), mod_97, False, 0.8, ("iban", "account", "bank", "konto")),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         lambda t: F.contains(t, F.lit("-")), lambda s: F.lit(True), False, 0.4, ("ssn", "social", "security")),
)
#: Words before a span that make it less likely to be personal.
AGAINST = ("version", "example", "order", "isbn", "serial", "invoice")


def candidates(text: Column, pattern: str) -> Column:
    """Array of (start, end, span) of all matches, leftmost first, in code points."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)
    pairs = F.transform(found, lambda m, i: F.struct(F.length(F.get(gaps, i)).alias("gap"), m.alias("span")))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<start:int,end:int,span:string>>)").alias("out"))

    def step(state, pair):
        begin = state["at"] + pair["gap"]
        end = begin + F.length(pair["span"])
        return F.struct(end.alias("at"), F.concat(state["out"], F.array(
            F.struct(begin.alias("start"), end.alias("end"), pair["span"].alias("span")))).alias("out"))

    return F.aggregate(pairs, start, step)["out"]


def _scored(text: Column, kind: Kind, reach: int) -> Column:
    """Valid spans of ``kind`` with kind and score."""
    def one(x):
        before = F.lower(F.substring(text, F.greatest(F.lit(1), x["start"] - reach + 1),
                                     F.least(F.lit(reach), x["start"])))
        near = lambda words: F.coalesce(F.greatest(*[F.contains(before, F.lit(w)) for w in words]), F.lit(False))
        score = F.lit(kind.score) + F.when(near(kind.near), 0.2).otherwise(0) - F.when(near(AGAINST), 0.3).otherwise(0)
        return F.struct(F.lit(kind.name).alias("kind"), x["start"].alias("start"), x["end"].alias("end"),
                        F.greatest(F.lit(0.0), F.least(F.lit(1.0), score)).alias("score"))

    spans = F.filter(candidates(text, kind.pattern), lambda x: kind.valid(x["span"]))
    nothing = F.expr("cast(array() as array<struct<kind:string,start:int,end:int,score:double>>)")
    return F.when(kind.hint(text), F.transform(spans, one)).otherwise(nothing)


def find(docs: DataFrame, *, text_col: str = "text", kinds: tuple[Kind, ...] = KINDS, least_score: float = 0.5,
         reach: int = 40, into: str = "pii") -> DataFrame:
    """Adds ``into``: array of (kind, start, end, score), by kind as listed, then start.

    Context is the ``reach`` code points before a span.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    parts = [_scored(text, k, reach) if k.base else
             F.filter(_scored(text, k, reach), lambda x: x["score"] >= least_score) for k in kinds]
    return docs.withColumn(into, F.concat(*parts))


def of_kind(spans: Column, *names: str) -> Column:
    return F.filter(spans, lambda x: x["kind"].isin(*names))


def masked(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets.

    Of spans that overlap, the one that starts first stands, then the longest;
    ``merged`` spans don't overlap, so no part of any stays.
    """
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))
    start = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<string>)").alias("out"))
    done = F.aggregate(ordered, start, lambda state, x: F.when(
        x["start"] >= state["at"], F.struct((-x["end"]).alias("at"), F.concat(state["out"], F.array(
            F.substr(text, state["at"] + 1, x["start"] - state["at"]),
            F.concat(F.lit("["), F.upper(x["kind"]), F.lit("]")))).alias("out"))).otherwise(state))
    return F.when(F.size(spans) > 0, F.concat(
        F.array_join(done["out"], ""), F.substr(text, done["at"] + 1))).otherwise(text)


def merged(spans: Column) -> Column:
    """Spans in order of start; those that overlap as one, of the kind of the first, then the longest."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))))

    def step(out, x):
        last = F.get(out, F.size(out) - 1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], -x["end"]).alias("end"),
                         last["kind"].alias("kind"))
        own = F.struct(x["start"].alias("start"), (-x["end"]).alias("end"), x["kind"].alias("kind"))
        return F.when(x["start"] < last["end"], F.concat(F.slice(out, F.lit(1), F.size(out) - 1), F.array(wider))) \
            .otherwise(F.concat(out, F.array(own)))

    return F.aggregate(ordered, F.expr("cast(array() as array<struct<start:int,end:int,kind:string>>)"), step)


def written(spans: Column) -> Column:
    """kind:start:end of all spans, joined by commas."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(
        ":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
