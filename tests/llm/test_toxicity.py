import numpy as np
import pytest
from pyspark.sql import functions as F
from regspark.llm import toxicity

from tests.llm.conftest import ODD


def texts(n, seed=1):
    """Toxic: an insult and a group together; either alone is not."""
    rng = np.random.default_rng(seed)
    words = [f"w{i}" for i in range(60)]
    out = []
    for i in range(n):
        insult, group = rng.random(2) < 0.5
        text = list(rng.choice(words, 15)) + ["fooled"] * int(insult) + ["tribe"] * int(group)
        out.append((i, " ".join(rng.permutation(text)), int(insult and group)))
    return out


def test_pairs_of_terms_count(spark):
    """No weights alone can tell these apart: both terms are as frequent in either class."""
    rng = np.random.default_rng(2)
    rows, buckets, y = [], [], []
    for i in range(1200):
        a, b = rng.random(2) < 0.5
        y.append(int(a == b))
        for on, at in ((a, 5), (b, 6)):
            rows.append(i)
            buckets.append(at if on else at + 10)
    order = np.lexsort((buckets, rows))
    rows, buckets = np.array(rows)[order], np.array(buckets)[order]
    machine = toxicity.learn(rows, buckets, np.array(y), 0.5, least_chi=-1, keep=(1.0,), decay=1e-6, epochs=600)
    got = machine.scores(rows, buckets, len(y)) > 0.5
    assert (got == np.array(y)).mean() > 0.95


def test_held_out(spark):
    docs = texts(600)
    frame = spark.createDataFrame([(i, t) for i, t, _ in docs], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in docs], "doc_id long, toxic int")
    machine = toxicity.train(frame, labels, usable=F.col("id") % 3 != 0, share=0.25, keep=(1.0,))
    got = {r.doc_id: r for r in toxicity.score(frame, machine, threshold=0.5).collect()}
    held = [(i, y) for i, _, y in docs if i % 3 == 0]
    assert np.mean([got[i].predicted == y for i, y in held]) > 0.9


def test_odd_texts_and_labels(spark, documents):
    docs = documents([*ODD, *[(100 + i, t) for i, t, _ in texts(100)]])
    labels = spark.createDataFrame([(100 + i, y) for i, _, y in texts(100)] + [(1, None), (None, 1), (100, 0)],
                                   "doc_id long, toxic int").withColumn("text", F.lit("x"))
    machine = toxicity.train(docs, labels)
    rows = toxicity.score(docs, machine).collect()
    assert len(rows) == len(ODD) + 100 and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (1, 2, 3)}
    assert len(empty) == 1 and empty.pop() == pytest.approx(1 / (1 + np.exp(-machine.bias)))
    carried = toxicity.score(docs, machine, carry=True).select("row.*")
    assert carried.columns == docs.columns


def test_nothing_to_learn_from(spark, documents):
    labels = spark.createDataFrame([(4, 0)], "doc_id long, toxic int")
    assert toxicity.train(documents(ODD), labels) is None
    assert {r.score for r in toxicity.score(documents(ODD), None).collect()} == {0.0}
    assert toxicity.score(documents(ODD).limit(0), None).count() == 0


def test_scores_are_the_sum_over_all_pairs_of_terms():
    rng = np.random.default_rng(8)
    buckets = np.sort(rng.choice(toxicity.BUCKETS, 50, replace=False))
    machine = toxicity.Machine(-0.3, buckets, rng.normal(0, 0.5, 50), rng.normal(0, 0.4, (50, 4)))
    at = {b: i for i, b in enumerate(buckets.tolist())}
    unknown = next(b for b in range(toxicity.BUCKETS) if b not in at)
    texts = [rng.choice(buckets, k).tolist() + [unknown] * (k % 2) for k in (0, 1, 2, 7, 20)]
    row = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    scores = machine.scores(row, np.array([b for t in texts for b in t], np.int64), len(texts))
    for terms, score in zip(texts, scores, strict=True):
        own = sorted({at[b] for b in terms if b in at})
        total = machine.bias + sum(machine.weights[i] for i in own) + sum(
            machine.factors[i] @ machine.factors[j] for n, i in enumerate(own) for j in own[n + 1:])
        assert abs(score - 1 / (1 + np.exp(-total))) < 1e-9
