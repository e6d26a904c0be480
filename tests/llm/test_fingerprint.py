import hashlib
import random

import numpy as np
from regspark.llm import fingerprint as fp

from tests.llm.conftest import ODD


def brute(docs):
    """Neighbours by a plain sort, hashes one shingle at a time."""
    docs = sorted(docs, key=lambda d: (d[0] is not None, d[0] or 0, d[1] is not None, (d[1] or "").encode()))
    out = []
    for i, (name, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        n = len(text) // 4
        copy = text[:len(text) - n] + after[:n]
        a, b, c = map(plain_sketch, (text, copy, after))
        like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
        written = lambda s: "".join(f"{v:010x}" for v in sorted(s))
        out.append((name, len(text), hashlib.sha256(copy.encode()).hexdigest(), written(a), written(b), like(a, b), like(a, c)))
    return sorted(out, key=repr)


def plain_sketch(text):
    raw = text.encode()
    if not raw:
        return set()
    if len(raw) < fp.WIDTH:
        raw += bytes(fp.WIDTH - len(raw))
    found = {int(fp._hashes(np.frombuffer(raw[i:i + fp.WIDTH], np.uint8))[0]) for i in range(len(raw) - fp.WIDTH + 1)}
    return {h for h in found if h < 1 << 35} or {min(found)}


def texts(n, seed=3):
    rng = random.Random(seed)
    return [(i * 7 % 1000, "".join(rng.choices("abcdefg é", k=rng.choice([0, 1, 3, 15, 16, 17, 60, 900])))) for i in range(n)]


def test_against_brute_force(documents):
    docs = texts(120) + [d for d in ODD if len(d[1] or "") < 1000]
    for parts in (1, 5, 40):
        got = fp.edited(documents(docs), parts=parts).collect()
        assert sorted((tuple(r)[:7] for r in got), key=repr) == brute(docs)


def test_one_document_and_none(documents):
    r = fp.edited(documents([(1, "abcdefgh" * 9)])).collect()
    assert len(r) == 1 and r[0].near_next == 1.0
    assert fp.edited(documents(ODD).limit(0)).count() == 0
    assert fp.fingerprints(documents(ODD).limit(0)).count() == 0


def test_long_texts_and_estimates(documents):
    rng = random.Random(8)
    text = "".join(rng.choices("abcdefghij ", k=200_000))
    part = text[:20_000]
    a, b = fp.sketch(text), fp.sketch(part)
    assert abs(len(a) / len(text) - 1 / fp.FRACTION) < 0.003
    assert fp.containment(b, a) > 0.99 and abs(fp.likeness(a, b) - 0.1) < 0.02
    rows = fp.fingerprints(documents([(1, text), (2, text)])).collect()
    assert rows[0].fingerprint == rows[1].fingerprint == fp.written(a)


def test_sketches_merge():
    rng = random.Random(9)
    x, y = ("".join(rng.choices("abcdefgh", k=5000)) for _ in range(2))
    whole, merged = set(fp.sketch(x + y).tolist()), set(fp.merge(fp.sketch(x), fp.sketch(y)).tolist())
    assert merged <= whole and len(whole - merged) <= 3
    assert fp.merge(fp.sketch("tiny"), fp.sketch(""))[0] == fp.sketch("tiny")[0]
