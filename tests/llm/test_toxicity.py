import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from seqlens.llm import toxicity as T

DOC = "doc_id long, text string"
LAB = "doc_id long, quality int, toxic int"


def corpus(n=1500):
    rnd = random.Random(2)
    vocab = ["".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(3, 7))) for _ in range(500)]
    docs, labels = [], []
    for i in range(n):
        words = [rnd.choice(vocab) for _ in range(rnd.randint(1, 120))]
        toxic = rnd.random() < .2
        if toxic:  # a listed word, or an unlisted stem with a free ending
            bad = ["idiot"] if rnd.random() < .5 else ["zzqrt" + rnd.choice("abcdefg") * rnd.randint(1, 3)]
            for b in bad * rnd.randint(1, 3):
                words.insert(rnd.randint(0, len(words)), b)
        docs.append((i, " ".join(words)))
        if rnd.random() < .7:
            labels.append((i, 1, int(toxic ^ (rnd.random() < .01))))
    return docs, labels, {i for i, t in docs if "idiot" in t or "zzqrt" in t}


def test_held_out_accuracy_and_fold(spark):
    docs, labels, bad = corpus()
    d = spark.createDataFrame(docs + [(9001, None), (9002, ""), (None, "idiot idiot")], DOC).withColumn("score", F.lit("clash"))
    lab = spark.createDataFrame(labels + [(1, 1, None), (None, 1, 1), labels[0]], LAB)
    rows = T.score_toxicity(d, lab).collect()
    assert len(rows) == len(docs) + 3 and all(0 <= r.score <= 1 for r in rows)
    for r in rows:
        if r.doc_id is not None:
            assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    out = [r for r in rows if r.held_out and r.doc_id < 9000]
    tp = sum(r.predicted for r in out if r.doc_id in bad)
    assert tp >= .95 * sum(r.doc_id in bad for r in out)
    assert sum(r.predicted for r in out if r.doc_id not in bad) == 0
    assert all(r.predicted == 0 for r in rows if r.doc_id in (9001, 9002))
    left = {r.doc_id for r in T.drop_toxic(d, lab).collect()}
    assert 9001 in left and not (left & {r.doc_id for r in rows if r.predicted})


def test_held_out_labels_are_not_read(spark):
    docs, labels, _ = corpus(400)
    d = spark.createDataFrame(docs, DOC)
    flip = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 3 == 1 else t) for i, q, t in labels]
    a = T.train(d, spark.createDataFrame(labels, LAB))
    b = T.train(d, spark.createDataFrame(flip, LAB))
    assert a.weights == b.weights and a.intercept == b.intercept


def test_sample_bound_and_degenerate_labels(spark):
    docs, labels, _ = corpus(200)
    d = spark.createDataFrame(docs, DOC)
    assert T.train(d, spark.createDataFrame([], LAB)).weights == {}
    one = spark.createDataFrame([(0, 1, 1)], LAB)
    assert {r.predicted for r in T.score_toxicity(d, one).collect()} in ({0}, {1})
    assert T.score_toxicity(spark.createDataFrame([], DOC), spark.createDataFrame(labels, LAB)).collect() == []


def test_label_model_finds_accuracy_and_copies(monkeypatch):
    rng = np.random.default_rng(0)
    y = rng.random(6000) < .3
    say = lambda a, b: np.where(y, rng.random(6000) < a, rng.random(6000) < b)
    good, noise = say(.9, .05), rng.random(6000) < .3
    votes = np.stack([good, good, good, say(.9, .1), say(.85, .1), say(.9, .05), noise], 1)
    labels = np.where(rng.random(6000) < .95, y, ~y).astype(int)
    monkeypatch.setattr(T, "ANNOTATOR", .95)
    q, found = T.fit_label_model(votes, labels)
    assert found["rate_toxic"][0] > .85 and found["rate_clean"][0] < .1
    assert found["correlation"][0, 1] > .99 and abs(found["correlation"][0, 6]) < .1
    assert found["share"][0] < .4 and found["share"][6] > .9  # copies share one voter's weight
    assert ((q > .5) == y).mean() > .98 > (labels == y).mean()


def test_linear_fits_soft_targets():
    rows = [np.array([0]), np.array([1]), np.array([0, 1]), np.zeros(0, int)] * 50
    w, b = T.fit_linear(rows, np.array([.9, .2, .8, .1] * 50), 2)
    assert w[0] > 2 and b < -1 and w[0] > w[1]
