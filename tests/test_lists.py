import json
import random

import pytest

from regspark.session import fresh_path
from regspark.sources import readers, writers
from regspark.sources.lists import read_long_list

TEXTS = ["a", "", 'q"uote', "back\\", 'end\\"', "é漢😀", "re[po{s", "repos", "]", "a,b", "tab\tnew\nline", " ", '"', "x" * 300]


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k, v in zip(before, ("700", "1")):
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def document(draw, n):
    listed = [draw.choice(TEXTS) for _ in range(n)]
    around = {"before": ["x", {"repos": ["no"]}], "name": "repos", 'a"repos': ["no"], "n": {"repos": ["no", "no"]}}
    after = {"later": ["y", "repos"], "z": 'e"nd', "num": 3}
    return {**around, "repos": listed, **after}, listed


@pytest.mark.parametrize("indent, ascii", [(None, True), (2, False)])
def test_splits_equal_the_parsed_documents(spark, tmp_path, small_splits, indent, ascii):
    draw, want = random.Random(1), []
    for i, n in enumerate((400, 150, 0)):
        doc, listed = document(draw, n)
        (tmp_path / f"{i}.json").write_text(json.dumps(doc, indent=indent, ensure_ascii=ascii), encoding="utf-8")
        want += [t for t in listed if t]
    (tmp_path / "3.json").write_text("")
    (tmp_path / "4.json").write_text('{"other": ["a"]}')
    assert spark.read.option("lineSep", '"').text(str(tmp_path)).rdd.getNumPartitions() > 8
    for rows in (1_000_000, 50):  # files ordered whole, and by splits
        got = read_long_list(spark, str(tmp_path), "repos", "repo", task_rows=rows)
        assert sorted(r.repo for r in got.collect()) == sorted(want)


def test_only_texts_of_the_list_itself(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"repos" : [ "a", null, 3, ["in"], {"k": "v"}, "b"], "x": ["c"]}')
    assert sorted(r.t for r in read_long_list(spark, str(tmp_path), "repos", "t").collect()) == ["a", "b"]
    assert [r.t for r in read_long_list(spark, str(tmp_path), "x", "t").collect()] == ["c"]
    assert read_long_list(spark, str(tmp_path), "absent", "t").count() == 0


def test_equal_to_the_plain_reader(spark, tmp_path):
    names = spark.createDataFrame([(t,) for t in TEXTS] + [(None,)], "n string").repartition(3)
    path = str(tmp_path / "out")
    writers.write_list(names, "n", path, "repos")
    rows = lambda df: sorted(r.repo for r in df.collect())
    assert rows(read_long_list(spark, path, "repos", "repo")) == rows(readers.read_list(spark, path, "repos", "repo"))
