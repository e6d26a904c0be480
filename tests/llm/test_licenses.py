import random
import re

from regspark.llm import licenses

from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    found = []
    for phrase, label in licenses.BASE.items():
        p = phrase.split()
        found += [(i, label) for i in range(len(w) - len(p) + 1) if w[i:i + len(p)] == p]
    at = [i for i, _ in found]
    return len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))


def test_base_places_against_brute_force(documents):
    rng = random.Random(2)
    parts = ["GNU General\nPublic License", "apache-license", "CC BY", "cc/by", "MIT License", "mit", "license", "gnu",
             "general", "é", "word,", "cc by cc by", "12"]
    docs = [*ODD, *[(100 + i, rng.choice([" ", "  ", ";"]).join(rng.choices(parts, k=rng.randint(0, 40)))) for i in range(60)]]
    rows = licenses.scan(documents(docs)).collect()
    got = sorted(((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in rows), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in docs), key=repr)
    for r in rows:
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1


def test_expressions():
    read = lambda s: sorted(" & ".join(sorted(x)) for x in licenses.read_expression(s) or [])
    assert read("MIT OR Apache-2.0") == ["apache-2.0", "mit"]
    assert read("MIT AND (BSD-3-Clause OR GPL-2.0-only WITH Classpath-exception-2.0)") == [
        "bsd-3-clause & mit", "gpl-2.0-only with classpath-exception-2.0 & mit"]
    assert read("a or b and c") == ["a", "b & c"]
    assert read("(a or b) and c") == ["a & c", "b & c"]
    assert read("MIT and so forth") in (["mit & so"], ["mit"])
    assert read("a or") == ["a"] and read("(a") == [] and read(") b") == [] and read("") == []
    assert licenses.postfix("a or b and c".split()) == ["a", "b", "c", "and", "or"]


def test_tags_add_labels(documents):
    text = "// SPDX-License-Identifier: (MIT OR GPL-3.0-or-later)\nUnder the Apache License. CC BY-SA text"
    r = licenses.scan(documents([(1, text)])).first()
    assert r.labels == "apache,cc-by,cc-by-sa,gpl,mit" and r.base_labels == "apache,cc-by"
    assert r.expressions == ["gpl-3.0-or-later | mit"]
    assert licenses.scan(documents([(1, text)]).limit(0)).count() == 0


def test_long_expressions_stay_whole(documents):
    tag = "SPDX-License-Identifier: "
    names = [f"n{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(70)]
    two = " AND ".join(f"({a} OR {b})" for a, b in zip(names[:14:2], names[1:14:2], strict=True))
    docs = [(1, tag + two), (2, tag + " OR ".join(names)), (3, f"{tag}({' AND '.join(names)}) or x with y"),
            (4, f"// {tag}(MIT OR\n//   (ISC\n// AND Zlib))\n// AND Apache-2.0"), (5, f"{tag}(MIT OR\n\n"),
            (6, f"{tag}MIT OR\nISC"), (7, f"/* {tag}(MIT\n */ OR ISC)"), (8, f"{tag}({two}) and ({two}) or {two} and q"),
            (9, f"{tag}a or (b or c) with d and e")]
    got = {r.doc_id: r for r in licenses.scan(documents(docs)).collect()}
    assert set(got[1].labels.split(",")) == set(names[:14])
    assert got[1].expressions == [" & ".join(f"({a} | {b})" for a, b in zip(names[:14:2], names[1:14:2], strict=True))]
    assert set(got[2].labels.split(",")) == set(names) and got[2].expressions == [" | ".join(names)]
    assert set(got[3].labels.split(",")) == {*names, "x"} and got[3].expressions == [" & ".join(names) + " | x with y"]
    assert got[4].labels == "isc,mit,zlib" and got[4].expressions == ["isc & zlib | mit"]
    assert got[5].expressions == [] and got[6].expressions == ["mit"] and got[7].expressions == []
    factored = got[1].expressions[0]
    assert got[8].expressions == [f"{factored} | {factored} & q"]
    assert got[9].expressions == ["a | b | c"]
    assert len(licenses.read_expression(two)) == 128
