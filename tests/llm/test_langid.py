import numpy as np
from pyspark.sql import functions as F
from regspark.llm import langid

from tests.llm.conftest import ODD


def test_codewords_differ_in_many_bits():
    for n in (2, 3, 4, 6, 7, 20):
        code = langid.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert code.shape[0] == n and min(apart) >= (1 if n == 2 else code.shape[1] / 4)


def texts(n):
    rng = np.random.default_rng(3)
    letters = {"aa": "abcde", "bb": "fghij", "cc": "klmno", "dd": "afkpé"}
    return [(i * 4 + j, " ".join("".join(rng.choice(list(s), 5)) for _ in range(20)), lang)
            for i in range(n) for j, (lang, s) in enumerate(letters.items())]


def test_held_out_accuracy(spark):
    docs = spark.createDataFrame(texts(40), "doc_id long, text string, lang string")
    codes = langid.train(docs, usable=F.col("doc_id") % 3 != 0, order=F.col("doc_id"), epochs=10)
    found = {r.doc_id: r for r in langid.predict(docs, codes).collect()}
    wrong = [i for i, _, lang in texts(40) if found[i].lang_pred != lang]
    assert len(wrong) <= 2
    assert all(0 <= r.score <= 1 for r in found.values())


def test_odd_texts(spark, documents):
    docs = spark.createDataFrame(texts(10), "doc_id long, text string, lang string")
    codes = langid.train(docs, order=F.col("doc_id"), epochs=3)
    rows = langid.predict(documents([*ODD, (20, "12 34 ...")]), codes).collect()
    assert len(rows) == len(ODD) + 1
    unknown = {r.doc_id for r in rows if r.lang_pred == "und"}
    assert unknown == {1, 2, 3, 20}
    assert all(r.score == 0 for r in rows if r.doc_id in unknown)


def test_nothing_to_learn_from(spark, documents):
    docs = documents(ODD).withColumn("lang", F.lit(None).cast("string"))
    codes = langid.train(docs)
    assert codes is None
    assert {r.lang_pred for r in langid.predict(docs, codes).collect()} == {"und"}
    assert langid.predict(docs.limit(0), codes).count() == 0


def test_mixed_texts_are_ambiguous(spark):
    docs = spark.createDataFrame(texts(40), "doc_id long, text string, lang string")
    codes = langid.train(docs, order=F.col("doc_id"), epochs=10)
    clear, mixed = "abcde " * 30, "abcde fghij " * 30
    rows = langid.predict(spark.createDataFrame([(1, clear), (2, mixed)], "doc_id long, text string"), codes).collect()
    assert rows[0].score > rows[1].score
