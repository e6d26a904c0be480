import random
import time

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from regspark.llm import bpe

from tests.llm.conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def pairs():
    return bpe.BytePairs(PATH)


def naive(ids, ranks, made):
    """Merges the leftmost of the pairs of lowest rank, looking at all each time."""
    ids = list(ids)
    while True:
        found = [(ranks[p], i) for i, p in enumerate(zip(ids, ids[1:], strict=False)) if p in ranks]
        if not found:
            return ids
        rank, i = min(found)
        ids[i:i + 2] = [made[rank >> bpe._PLACE]]


def test_merges_equal_the_naive_ones(pairs):
    rnd = random.Random(5)
    for n in [0, 1, 2, 3, 5, 17, 64, 65, 300]:
        for letters in ("ab", "aeiourstln ", "".join(map(chr, range(256)))):
            ids = [pairs.bytes[b] for b in "".join(rnd.choice(letters) for _ in range(n)).encode("latin-1")]
            expected = naive(ids, pairs.ranks, pairs.made)
            assert list(bpe.merge_all(list(ids), pairs.ranks, pairs.made)) == expected
            if n:
                assert pairs.forest.merge([ids, ids[:1], ids[:n // 2 + 1]])[0] == np.array(expected, "<u4").tobytes()


def test_many_trees_at_once_equal_one_each(pairs):
    rnd = random.Random(8)
    pieces = [[pairs.bytes[rnd.choice(b" etaoinshr'.19")] for _ in range(rnd.randrange(1, 40))] for _ in range(2000)]
    expected = [np.array(bpe.merge_all(list(p), pairs.ranks, pairs.made), "<u4").tobytes() for p in pieces]
    assert pairs.forest.merge(pieces) == expected


def test_tree_names_the_leftmost_least():
    rnd = random.Random(6)
    for n in (1, 2, 7, 64, 5000):
        values = [rnd.randrange(5) << bpe._PLACE | i for i in range(n)]
        tree = bpe.PairTree(values, n)
        for _ in range(200):
            assert tree.nodes[1] == min(values)
            i = rnd.randrange(n)
            values[i] = rnd.choice([bpe.NEVER, rnd.randrange(5) << bpe._PLACE]) | i
            tree.put(i, values[i])


def texts():
    rnd = random.Random(1)
    yield from ("end <|endoftext|> next", "<|endoftext|><|endoftext|>", "\n <|endoftext|>\n  b <|endoftext", "it's we'LL I'd",
                "a" * 500, " \n\t  x\r\n\r\n  ", "\x1c\x1d a\x85b\xa0c　d", "՘a1ՠ", "日本語 \U0001f600é", "�\x00")
    for _ in range(400):
        yield "".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0xD800), rnd.randrange(0x10000, 0x20000)]))
                      for _ in range(rnd.randrange(1, 120)))
    # Every kind of character between others: the pattern's classes must agree.
    for first in [*range(0, 0xD800, 64), *range(0xE000, 0x32000, 64)]:
        yield "".join(f"a{chr(c)}1{chr(c)}{chr(c)} " for c in range(first, first + 64))


def test_ids_and_texts_are_those_of_the_library(pairs, library):
    for text in texts():
        ids = library.encode(text, add_special_tokens=False).ids
        mine = pairs.encode(text)
        assert np.frombuffer(mine, "<u4").tolist() == ids
        assert pairs.decode(mine) == library.decode(ids, skip_special_tokens=False) == text


def test_ids_that_are_no_text_decode_as_the_library_does(pairs, library):
    rnd = random.Random(2)
    for _ in range(200):
        ids = [rnd.randrange(50_257) for _ in range(20)]
        raw = np.array(ids, "<u4").tobytes()
        assert pairs.decode(raw) == library.decode(ids, skip_special_tokens=False)
    assert pairs.decode(np.array([60_000], "<u4").tobytes()) == ""


@pytest.mark.parametrize("text", [" " * 300_000 + "a", "x" * 300_000, "\n\t" * 150_000], ids=["blanks", "letters", "mixed"])
def test_a_piece_of_any_length_costs_n_log_n(pairs, library, text):
    start = time.time()
    found = pairs.encode(text)
    assert time.time() - start < 30
    assert np.frombuffer(found, "<u4").tolist() == library.encode(text, add_special_tokens=False).ids


def test_what_is_remembered_is_bounded(pairs, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 50)
    fresh = bpe.BytePairs(PATH)
    for i in range(500):
        assert fresh.encode(f"word{i} and {i}") == pairs.encode(f"word{i} and {i}")
        assert len(fresh.pieces) <= 50 + 6


def test_odd_rows_and_clashing_columns(documents, library):
    frame = documents(ODD)
    rows = bpe.decode(bpe.encode(frame)).collect()
    expected = [(n, len(library.encode(t or "", add_special_tokens=False).ids), t or "") for n, t in ODD]
    assert sorted(((r.doc_id, r.n_tokens, r.decoded) for r in rows), key=str) == sorted(expected, key=str)
    kept = bpe.decode(frame.withColumn("ids", F.lit(None).cast("binary")), into="text").collect()
    assert len(kept) == len(ODD) and all(r.text is None and r.n_words == 7 for r in kept)
    assert bpe.decode(bpe.encode(frame.limit(0))).count() == 0
