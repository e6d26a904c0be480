import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from tests.llm import test_ngramjoin, test_wumanber
from tests.llm.conftest import DOCUMENT

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def staged(spark, tmp_path_factory):
    """Each stage's input and output over the smallest tables."""
    docs, out = spark.read.parquet(f"{FOLDER}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        stage(spark, docs, FOLDER).write.parquet(path)
        out.append((name, docs, spark.read.parquet(path)))
        docs = out[-1][2]
    return out


def test_all_but_the_last_return_documents(staged):
    assert [n for n, _, _ in staged] == ["toxicity", "ngram_jaccard_join", "decontamination", "personal_data", "packing"]
    for _, docs, out in staged[:-1]:
        assert out.dtypes == docs.dtypes


def test_one_stays_of_each_group(staged):
    docs = [(r.doc_id, r.text) for r in staged[1][1].collect()]
    expected = sorted({c for _, _, c in test_ngramjoin.brute(docs)})
    assert sorted(r.doc_id for r in staged[1][2].collect()) == expected


def test_contaminated_go(spark, staged):
    docs = [(r.doc_id, r.text) for r in staged[2][1].collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    expected = sorted(r[0] for r in test_wumanber.brute(docs, items) if not r[5])
    assert sorted(r.doc_id for r in staged[2][2].collect()) == expected


def test_personal_data_is_masked_and_nothing_else_changes(staged):
    from tests.llm import test_pii

    before = {r.doc_id: r for r in staged[3][1].collect()}
    after = staged[3][2].collect()
    assert len(after) == len(before)
    for r in after:
        if not test_pii.brute(before[r.doc_id].text) and "[" not in r.text:
            assert r == before[r.doc_id]
        assert r.n_chars == len(r.text)


def test_packed_whole(spark, staged):
    from tests.llm import test_packing

    docs = [(r.doc_id, r.text) for r in staged[4][1].collect()]
    test_packing.checked(staged[4][2].collect(), docs)


def test_odd_tables_pass(spark):
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "text without id", None, "s", 15),
            (3, "five words are in this text", "en", "s", 27), (4, "five words are in this text", "en", "s", 27)]
    for docs in (spark.createDataFrame(rows, DOCUMENT).withColumn("score", F.lit("clash")),
                 spark.createDataFrame([], DOCUMENT)):
        n = docs.count()
        for name, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, FOLDER)
            if name == "ngram_jaccard_join":
                assert docs.count() == (4 if n else 0)
        assert docs.select("doc_id").distinct().count() == (4 if n else 0)


def test_masking_keeps_a_column_named_like_its_own(spark):
    docs = spark.createDataFrame([(1, "write to a.b@example.com now", "mine")], "doc_id long, text string, _spans string")
    row = corpus_pipeline.mask_personal(spark, docs, "").first()
    assert row["_spans"] == "mine" and "example" not in row.text
