import hashlib
import random
import re

from regspark.llm import wumanber

from tests.llm.conftest import ODD

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def brute(docs, items):
    """All windows against all places, word by word."""
    patterns = {}
    for item, text in items:
        w = WORD.findall((text or "").translate(LOWER))
        k = min(13, len(w))
        for i in range(len(w) - k + 1 if w else 0):
            patterns.setdefault(tuple(w[i:i + k]), set()).add("null" if item is None else str(item))
    sizes = {len(p) for p in patterns}
    out = []
    for name, text in docs:
        w, hit, found = WORD.findall((text or "").translate(LOWER)), set(), set()
        for i in range(len(w)):
            for k in sizes:
                items_of = patterns.get(tuple(w[i:i + k])) if i + k <= len(w) else None
                if items_of:
                    hit |= set(range(i, i + k))
                    found |= items_of
        out.append((name, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(),
                    bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def fixture(seed=4):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(30)] + ["É", "Ab", "x9"]
    items = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 2, 5, 12, 13, 14, 40])))) for i in range(25)]
    items += [(3, items[4][1]), (None, "a null id item of some words"), (30, None)]
    docs = [*ODD, (40, "A NULL id, item; of some-words")]
    for i in range(60):
        text = rng.choices(words, k=rng.choice([1, 20, 600, 3000]))
        for _ in range(rng.randint(0, 3)):
            text[rng.randrange(len(text))] = rng.choice(items)[1] or ""
        docs.append((100 + i, "".join(w + rng.choice([" ", ", ", "\n", "--"]) for w in text)))
    return docs, items


def test_against_brute_force(spark, documents):
    docs, items = fixture()
    bench = spark.createDataFrame(items, "item_id long, text string")
    expected = brute(docs, items)
    for part_bytes in (1 << 26, 400):
        rows = wumanber.scan(documents(docs), bench, part_bytes=part_bytes).collect()
        assert sorted((tuple(r) for r in rows), key=repr) == expected


def test_empty_tables(spark, documents):
    bench = spark.createDataFrame([], "item_id long, text string")
    rows = wumanber.scan(documents(ODD), bench).collect()
    assert len(rows) == len(ODD) and not any(r.n_hit or r.contaminated for r in rows)
    assert wumanber.scan(documents(ODD).limit(0), bench).count() == 0
    carried = wumanber.scan(documents(ODD), bench, carry=True).select("row.*")
    assert carried.columns == documents(ODD).columns and carried.count() == len(ODD)


def test_shift_table_skips(monkeypatch):
    import numpy as np
    from regspark.llm import arrays

    search = wumanber.Search(13, {b" ".join(b"p%d" % i for i in range(13)): {"1"}})
    data = np.frombuffer(" ".join(f"d{i}" for i in range(5000)).encode(), np.uint8)
    off = np.array([0, len(data)])
    starts, ends, rows = arrays.words(data, off, arrays.ALNUM)
    looked = 0
    mix = arrays.mix

    def counted(h):
        nonlocal looked
        looked += len(h)
        return mix(h)

    hashes = arrays.word_hashes(data, starts, ends)
    monkeypatch.setattr(arrays, "mix", counted)
    assert list(search.occurrences(data, starts, ends, hashes, rows)) == []
    assert looked < 5000 / 8
