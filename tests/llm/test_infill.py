import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from regspark.llm import infill

from tests.llm.conftest import ODD


def places(raw, unit):
    """Boundaries by their meaning, one place at a time."""
    if unit == "char":
        found, at = [0], 0
        for c in raw.decode():
            at += len(c.encode())
            found.append(at)
        return found
    if unit == "line":
        parts = raw.splitlines(keepends=True) if b"\r" not in raw else None
        return [0, *np.cumsum([len(p) for p in parts]).tolist()] if raw else [0]
    blank = b" \t\n\v\f\r"
    found = [i for i in range(len(raw)) if i == 0 or raw[i - 1] in blank and raw[i] not in blank]
    return [*found, len(raw)]


TEXTS = ["", "a", "é", "plain words\n in  lines\n\n", "日本語" * 30_000, "é" * 40_000 + "x" * 90_000,
         "\U0001f600" * 20_000, "ab\n" * 60_000, "x" * 65_535 + "é" * 3, "aé" * 70_000 + "z", "日" * 500 + "a" * 200_000]


@pytest.mark.parametrize("unit", sorted(infill.UNITS))
def test_select_names_every_boundary(unit):
    for text in TEXTS:
        raw = text.encode()
        found, expected = infill.boundaries(raw, unit), places(raw, unit)
        assert len(found) == len(expected)
        step = max(1, len(expected) // 3000)
        for k in [*range(0, len(expected), step), len(expected) - 1]:
            assert found.select(k) == expected[k]


def test_every_kind_of_container_is_used_where_it_is_smallest():
    def kinds(text):
        return [type(c).__name__ for c in infill.boundaries(text.encode()).containers]

    assert kinds("x" * 200_000) == ["RunContainer"] * 4
    assert kinds("日" * 25_000) == ["BitmapContainer", "ArrayContainer"]
    assert kinds("日" * 300) == ["ArrayContainer"]
    for text in TEXTS:
        for c in infill.boundaries(text.encode()).containers:
            assert c.bytes <= infill.BITMAP_BYTES
    with pytest.raises(IndexError):
        infill.boundaries(b"abc").select(4)


def brute(name, text):
    text = text or ""
    n = len(text)
    h = hashlib.sha256(f"1:{'' if name is None else name}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[i:i + 8], 16) for i in range(0, 32, 8))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in infill.MARKS) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", a, b - a, f"<P>{prefix}<S>{suffix}<M>{middle}"


MORE = [(100 + i, t) for i, t in enumerate(TEXTS[:6])] + [
    (200, "text with <P> in it"), (201, "<S>"), (202, "x<M"), (203, "<P"), (204, "a < b > c <p>")] + [
    (1000 + i, "one <two> thr日e\nfour" * (i % 7)) for i in range(120)]


def test_examples_equal_brute_force_and_give_their_texts_back(documents):
    docs = ODD + MORE
    made = infill.transform(documents(docs))
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"))).collect()
    expected = sorted((brute(n, t) + (n is None, n or 0, t or "") for n, t in docs), key=str)
    found = sorted((tuple(r)[1:6] + (r.doc_id is None, r.doc_id or 0, r.back) for r in rows), key=str)
    assert found == expected
    assert {r.form for r in rows} == {"plain", "psm", "spm"}


def test_other_units_and_marks(documents):
    docs = [(i, f"line {i}\n" * (i % 5) + "the end") for i in range(60)]
    marks = ("<pre>", "<suf>", "<mid>")
    made = infill.transform(documents(docs), unit="line", plain_from=100, spm_below=50, marks=marks, seed="s")
    rows = made.withColumn("back", infill.restored(F.col("output"), F.col("form"), marks)).collect()
    assert {(r.doc_id, r.back) for r in rows} == set(docs)
    for r in rows:
        middle = r.output.split("<mid>")[1]
        assert r.n == r.doc_id % 5 + 1 and len(middle.splitlines()) == r.middle_units
    assert {r.form for r in rows} == {"psm", "spm"}


def test_a_long_text_and_an_empty_table(documents):
    long = "words of two bytes: é and three: 日\n" * 100_000
    row = infill.transform(documents([(7, long)])).first()
    assert (row.n, row.form, row.prefix_units, row.middle_units, row.output) == brute(7, long)
    assert infill.transform(documents(ODD).limit(0)).count() == 0
    with pytest.raises(ValueError):
        infill.transform(documents(ODD), unit="page")
    with pytest.raises(ValueError):
        infill.transform(documents(ODD), marks=("<P>", "<P>", "M"))
