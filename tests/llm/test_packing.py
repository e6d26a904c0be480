import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from regspark.llm import packing

from tests.llm.conftest import ODD


def ids_of(text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def checked(rows, docs):
    """Every id in one piece, pieces gapless in sequences, lengths as promised."""
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for name, text in docs:
        ids = np.array(ids_of(text), "<u4")
        mine = sorted(pieces[name], key=lambda r: r.start)
        copies = sum(n == name for n, _ in docs)
        assert sum(r.length for r in mine) == copies * len(ids)
        for r in mine:
            assert r.doc_tokens == len(ids)
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
        if copies == 1:
            assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
    padding = 0
    for members in sequences.values():
        members.sort(key=lambda r: r.offset)
        lengths = [r.length for r in members]
        assert [r.offset for r in members] == [0, *np.cumsum(lengths)[:-1]]
        total = sum(lengths)
        assert total == members[0].sequence_tokens <= members[0].tier
        padding += 0 if total & (total - 1) == 0 else 2048 - total
    return padding


def test_odd_texts_are_packed_whole(documents):
    rows = packing.pack(documents(ODD)).collect()
    assert checked(rows, ODD) < 0.02 * sum(r.length for r in rows)


def test_many_lengths_leave_little_padding(documents):
    docs = [(i, "word " * (i * 37 % 3000)) for i in range(150)]
    rows = packing.pack(documents(docs, 2), block_tokens=30_000).collect()
    assert checked(rows, docs) < 0.01 * sum(r.length for r in rows)
    assert {r.tier for r in rows} >= {256, 512, 1024, 2048}


def test_step_groups_hold_equal_tokens_and_even_cost():
    rng = np.random.default_rng(1)
    sequences = [(2048, [(0, 0, np.zeros(n)) for n in rng.multinomial(2048, [1 / k] * k)])
                 for k in rng.integers(1, 9, 64)]
    group, n = packing.step_groups(sequences, 1 << 14)
    assert n == 8 and sorted(np.bincount(group)) == [8] * 8
    cost = np.bincount(group, [sum(len(p[2]) ** 2 for p in s[1]) for s in sequences])
    assert cost.max() < 1.25 * cost.min()


def test_empty_table_and_bad_tiers(documents):
    assert packing.pack(documents(ODD).limit(0)).count() == 0
    with pytest.raises(ValueError):
        packing.pack(documents(ODD), tiers=(300, 2048))


def test_added_tokens_in_texts_are_those_of_the_tokenizer(documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    docs = [(1, "end of one <|endoftext|> next"), (2, "<|endoftext|>"), (3, "a\n <|endoftext|><|endoftext|>\n  b <|endoftext"),
            (4, "none"), (5, None)]
    rows = packing.pack(documents(docs)).collect()
    for name, text in docs:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        mine = [r for r in rows if r.doc_id == name]
        assert sum(r.length for r in mine) == len(ids) and {r.doc_tokens for r in mine} == {len(ids)}
        for r in mine:
            assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
    plain = {r.doc_id: r.doc_tokens for r in packing.pack(documents(docs), added={}).collect()}
    assert plain[1] == len(ids_of(docs[0][1])) == 12


@pytest.mark.parametrize("text", [
    " " * 1_000_000 + "a", "\n" * 2_000_000 + "end", "a" + "\t " * 600_000 + "<|endoftext|>" + " " * 1_200_000 + "b", " " * 1_500_000],
    ids=["blanks", "lines", "mixed", "only"])
def test_runs_of_blanks_of_any_length_have_the_ids_of_the_tokenizer(documents, text):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 1], "<u4")
    rows = packing.pack(documents([(1, text), (2, "next")])).where("doc_id = 1").orderBy("start").collect()
    assert sum(r.length for r in rows) == len(ids) == rows[0].doc_tokens
    for r in rows:
        assert zlib.crc32(ids[r.start:r.start + r.length].tobytes()) == r.ids_crc32
