import random
import re

import corpus_pipeline
from pyspark.sql import functions as F
from regspark.llm import pii

from tests.llm.conftest import ODD

# The patterns in their plain form.
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    return sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(p) < 256 for p in m[0].split(".")) if kind == "ip" else True,
                    "card": 13 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((kind, m.start(), m.end()))
    return out


def texts(n):
    rng = random.Random(1)
    bits = ["a@b.c", "x.y+z@q-r.co.uk", "@", ".", "+", "-", " ", "1", "22", "255", "256", "0", "+1 (098) 555-0174", "4111 1111 1111 1111",
            "4111-1111-1111-1112", "192.168.0.1", "é", "\U0001f600", "\n", "(", ")", "00001.2.3.4", "_", "%", "mail"]
    return [(100 + i, "".join(rng.choices(bits, k=rng.randint(1, 40)))) for i in range(n)]


def test_base_spans_against_plain_patterns(documents):
    docs = texts(700) + ODD + [(50, "1 2-" * 20_000), (51, "a." * 50_000), (52, "+1 " * 30_000), (53, "a@b.c " * 3000), (54, "1." * 30_000)]
    rows = pii.find(documents(docs), into="found").select("doc_id", "text", "found").collect()
    assert len(rows) == len(docs)
    base = [k.name for k in pii.KINDS if k.base]
    for r in rows:
        assert [(x.kind, x.start, x.end) for x in r.found if x.kind in base] == brute(r.text), r.text[:200]
        assert all(0 <= x.score <= 1 for x in r.found)


def test_checksums_confirm(spark):
    rows = spark.createDataFrame([("GB82 WEST 1234 5698 7654 32",), ("GB82WEST12345698765432",), ("GB83WEST12345698765432",)], "s string")
    assert [r[0] for r in rows.select(pii.mod_97(F.col("s"))).collect()] == [True, True, False]
    rows = spark.createDataFrame([("79927398713",), ("79927398710",), ("4111 1111-1111 1111",)], "s string")
    assert [r[0] for r in rows.select(pii.luhn(F.col("s"))).collect()] == [True, False, True]


def test_context_changes_the_score(documents):
    docs = [(1, "call me: +1 098 555 0174"), (2, "version +1 098 555 0174"), (3, "xx +1 098 555 0174"),
            (4, "social security 123-45-6789"), (5, "123-45-6789"), (6, "IBAN GB82 WEST 1234 5698 7654 32.")]
    got = {r.doc_id: r.found for r in pii.find(documents(docs), into="found").select("doc_id", "found").collect()}
    assert got[1][0].score > got[3][0].score > got[2][0].score
    assert [x.kind for x in got[4]] == ["ssn"] and got[5] == []
    assert [(x.kind, x.start, x.end) for x in got[6] if x.kind == "iban"] == [("iban", 5, 32)]


def test_masking_covers_every_span(documents):
    docs = texts(300) + [d for d in ODD if d[0] != 8]
    rows = pii.find(documents(docs), into="found").withColumn("masked", pii.masked(F.col("text"), F.col("found"))).collect()
    for r in rows:
        text, at, out = r.text, 0, []
        for x in sorted(r.found, key=lambda x: (x.start, -x.end)):
            if x.start >= at:
                out += [text[at:x.start], f"[{x.kind.upper()}]"]
                at = x.end
        assert r.masked == (None if text is None else "".join(out) + text[at:])


def test_empty_table(documents):
    assert pii.find(documents(ODD).limit(0), into="found").count() == 0


def test_overlapping_spans_are_masked_whole(spark, documents):
    docs = [(1, "at +1 (555) 123-4567.jane@corp.com now"), (2, "x 4111 1111 1111 1111@corp.com, +1 098 555 0174"), (3, None)]
    masked = corpus_pipeline.mask_personal(spark, documents(docs), "")
    assert {r.doc_id: r.text for r in masked.collect()} == {1: "at [PHONE] now", 2: "x [CARD], [PHONE]", 3: None}
