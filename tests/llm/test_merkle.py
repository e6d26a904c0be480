import hashlib
import random
import zlib

from pyspark.sql import functions as F
from regspark.llm import merkle

COLUMNS = "doc_id long, source string, lang string, n_chars long, text string, row string, group int, total int, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return sha(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i:i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def path(levels, at):
    """(slot, run) of every level from the node at ``at`` up."""
    found = []
    for level in levels[:-1]:
        first = at // 16 * 16
        found.append((at - first, level[first:first + 16]))
        at //= 16
    return found


def lowered(text):
    return text and text.translate({c: c + 32 for c in range(65, 91)})


def brute(rows):
    """Rows of the manifest from (doc_id, source, lang, n_chars, text)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append(r)
    trees = {}
    for source, members in groups.items():
        members.sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[source] = climb([leaf(r) for r in members])
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    top = climb([trees[s][-1][0] for s in order])
    root, found = top[-1][0], []
    for at_source, source in enumerate(order):
        for at, r in enumerate(groups[source]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0
            folded = leaf((*r[:4], lowered(r[4]))) if changed else leaf(r)
            steps = path(trees[source], at) + path(top, at_source)
            siblings = [d for slot, run in steps for i, d in enumerate(run) if i != slot]
            for slot, run in steps:
                folded = sha(*run[:slot], folded, *run[slot + 1:])
            found.append((r[0], leaf(r), trees[source][-1][0], root, sha(*siblings), folded, folded == root, siblings))
    return found


def manifest(spark, rows, proofs=True, partitions=5):
    docs = spark.createDataFrame([(*r, "x", 1, 2, "p") for r in rows], COLUMNS).repartition(partitions)
    return merkle.manifest(docs, proofs=proofs, where=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0,
                           tampered={"text": F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ",
                                                         "abcdefghijklmnopqrstuvwxyz")})


def same(spark, rows, **how):
    found = sorted((tuple(r) for r in manifest(spark, rows, **how).collect()), key=str)
    expected = sorted(brute(rows), key=str)
    assert found == (expected if how.get("proofs", True) else [e[:-1] for e in expected])
    return found


def test_groups_of_all_sizes_equal_brute_force(spark):
    rnd = random.Random(3)
    sizes = {None: 17, "": 1, "a": 2, "é": 16, "b": 33, "hot": 5000, "c": 256, "d": 257, "Z": 300}
    rows, name = [], 0
    for source, n in sizes.items():
        for _ in range(n):
            name += rnd.randint(1, 3)
            rows.append((name, source, rnd.choice(["en", None, ""]), rnd.choice([None, 3]),
                         rnd.choice(["Some Text", "lower", "É", "", None, "Ä B 日"])))
    rnd.shuffle(rows)
    found = same(spark, rows)
    assert any(not r[6] for r in found) and sum(r[6] for r in found) > len(found) / 2


def test_many_groups_need_levels_above_the_sources(spark):
    same(spark, [(i, f"s{i % 400}", "en", i, f"Text {i}") for i in range(900)], proofs=False)


def test_null_ids_ties_and_repeated_rows(spark):
    rows = [(None, "a", "en", 1, "X")] * 20 + [(None, "a", "en", 1, "y")] * 3 + [(5, "a", None, None, None)] * 40 + [
        (5, "a", None, None, ""), (25, "b", "en", 5, "CAPS")]
    same(spark, rows)


def test_one_row_long_text_and_empty_table(spark):
    changed = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 5 == 0)
    found = same(spark, [(changed, None, None, None, "LONG " * 400_000)])
    assert found[0][1] == found[0][2] == found[0][3] and found[0][4] == sha() and not found[0][6]
    assert manifest(spark, []).count() == 0


def test_folding_takes_the_state_before_the_slot():
    children = [sha(str(i)).encode() for i in range(16)]
    parent = merkle.Parent(children)
    new = sha("new").encode()
    for slot in range(16):
        changed = children[:slot] + [new] + children[slot + 1:]
        assert parent.folded(slot, new) == hashlib.sha256(b"".join(changed)).hexdigest().encode()
        assert parent.siblings(slot) == b"".join(children[:slot] + children[slot + 1:])
    assert parent.digest == parent.folded(3, children[3])


def test_hot_group_is_dealt_in_blocks(spark):
    leaves = spark.range(20_000).select(
        F.lit("hot").alias("group"), "id", F.unhex(F.sha2(F.col("id").cast("string"), 256)).alias("digest"))
    numbered = merkle._numbered(leaves.repartition(7), ["id"]).cache()
    assert numbered.where("place <> id or total <> 20000").count() == 0
    sizes = merkle._blocked(numbered).select(F.size("members").alias("n")).collect()
    assert len(sizes) == -(-20_000 // merkle.SPAN) and max(r.n for r in sizes) == merkle.SPAN
