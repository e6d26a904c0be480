"""The scanner on adversarial texts, held against plain Python."""

import base64
import random
import re
import time
from bisect import bisect_left

import pytest
from pyspark.sql import functions as F
from regspark.operators import scan as C


def files(spark, rows):
    return spark.createDataFrame(rows, "layer string, file string, text string")


def lines_of(text, pattern):
    """(secret, line the first place of the secret in its match is on) of every match."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    return [(m.group(1), bisect_left(breaks, m.start() + max(m.group(0).find(m.group(1)), 0)) + 1)
            for m in re.finditer(pattern, text)]


def test_many_matches_cost_what_the_text_does(spark):
    rnd = random.Random(1)
    text = "".join(f"k={rnd.randrange(10**6)}{rnd.choice([' ', chr(10), ' x '])}" for _ in range(100_000))
    rules = (C.Rule("number", "k=([0-9]+)"), C.Rule("two", "([0-9])\n(?=k)"), C.Rule("keyed", "=(9[0-9]*)", ("K=",)))
    frags = C.fragments(files(spark, [("a", "f.txt", text)]), unit="file")
    start = time.time()
    found = C.secret_findings(frags, rules).collect()
    assert time.time() - start < 30
    for rule in rules:
        assert sorted((r.secret, r.start_line) for r in found if r.origin == rule.rule_id) == sorted(
            lines_of(text, rule.regex))


def test_marks_in_the_text_change_nothing(spark):
    text = "\nk=1 k=2\n\nk=3"
    frags = C.fragments(files(spark, [("a", "f", text)]), unit="file")
    rows = C.secret_findings(frags, (C.Rule("n", "(?:)?k=([0-9])"),)).collect()
    assert sorted((r.secret, r.start_line) for r in rows) == [("1", 2), ("2", 2), ("3", 4)]


@pytest.mark.parametrize("words", [["a", "ab", "abc", "b", "bc"], ["key", "apikey", "api", "k.y", "[x]", "é"], ["z"]])
def test_keywords_inside_and_before_others_are_found(spark, words):
    rnd = random.Random(4)
    rules = [C.Rule(f"r{i}", "x", tuple({w, rnd.choice(words)})) for i, w in enumerate(words)]
    texts = ["".join(rnd.choice("abcke.yapi[x]éZ ") for _ in range(rnd.randrange(12))) for _ in range(200)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", C.keyword_rules(F.col("t"), rules).alias("k")).collect()
    for r in rows:
        expected = [i for i, rule in enumerate(rules) if any(w in r.t.lower() for w in rule.keywords)]
        assert (r.k or []) == expected


def test_only_rules_whose_keyword_stands_are_tried(spark):
    rules = [C.Rule(f"r{i}", f"word{i:03d}=([a-z]+)", (f"word{i:03d}",)) for i in range(300)]
    rows = [("l", f"f{i}", f"word{i % 300:03d}=abc and WORD{(i + 7) % 300:03d}" if i % 10 == 0 else "nothing here") for i in range(500)]
    frags = C.fragments(files(spark, rows))
    tried = C.candidates(frags, rules)
    assert tried.count() == 100 and C.candidates(frags, [*rules, C.Rule("all", "(x)")]).count() == 600
    found = C.secret_findings(frags, rules).collect()
    # The texts of f300 and on are copies.
    assert len(found) == 30 and {r.origin for r in found} == {f"r{i % 300}" for i in range(0, 500, 10)}
    assert C.secret_findings(frags, rules[:0]).count() == 0


def b64(text):
    return base64.b64encode(text.encode()).decode()


def test_decoded_findings_lead_back_to_the_original(spark):
    deep = b64("a " + b64("b " + b64("key=deepdeepdeep")))
    line = f"key=plainplain {b64('key=onceonceonce ')} {b64('wrap ' + b64('key=twicetwice'))} key=plainplain"
    text = f"first\n\n{line}\nnone {'A' * 40} {b64('é' * 20)}\n{deep}\n"
    rule = C.Rule("key", "key=([a-z]+)", ("key",))
    rows = [("l2", "z/copy.env", text), ("l1", "a/file.env", text), ("l1", "b/other", line)]
    found = C.decoded_findings(C.fragments(files(spark, rows), unit="file"), [rule]).collect()
    main = sorted((r.secret, r.start_line, r.round) for r in found if r.file == "a/file.env")
    assert main == [("deepdeepdeep", 5, 3), ("onceonceonce", 3, 1), ("plainplain", 3, 0), ("plainplain", 3, 0),
                    ("twicetwice", 3, 2)]
    assert {r.file for r in found} == {"a/file.env", "b/other"} and len(found) == 9
    for r in found:
        inner = text if r.file == "a/file.env" else line
        for s in r.spans:
            inner = base64.b64decode(inner[s.start:s.end]).decode()
        assert r.round == len(r.spans) and f"key={r.secret}" in inner
    # Line by line, every fragment has its own line.
    by_line = C.decoded_findings(C.fragments(files(spark, rows[:2])), [rule]).collect()
    assert sorted((r.secret, r.start_line, r.round) for r in by_line) == main
    shallow = C.decoded_findings(C.fragments(files(spark, rows[:2]), unit="file"), [rule], rounds=1).collect()
    assert {r.round for r in shallow} == {0, 1}


def test_decoding_one_long_text_is_linear(spark):
    text = "".join(f"{b64(f'key=value{i:08d} ')}{' ' if i % 3 else chr(10)}" for i in range(30_000))
    start = time.time()
    rows = C.decoded_findings(C.fragments(files(spark, [("a", "f", text)]), unit="file"),
                              [C.Rule("k", "key=(value[0-9]+)")]).select("secret", "start_line").collect()
    assert time.time() - start < 30
    assert {r.secret for r in rows} == {f"value{i:08d}" for i in range(30_000)}
    assert sorted((r.secret, r.start_line) for r in rows)[:8] == [
        (f"value{i:08d}", -(-i // 3) + 1) for i in range(8)]


def test_decode_pass_keeps_the_findings_of_every_level(spark):
    line = f"key=plain {b64('key=encodedvalue')}"
    passed = C.decode_pass(C.fragments(files(spark, [("l", "f", line)])))
    found = C.secret_findings(passed, [C.Rule("key", "key=([a-z]+)")]).collect()
    assert {r.secret for r in found} == {"plain", "encodedvalue"}
