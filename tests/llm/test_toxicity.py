import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagos.llm import toxicity
from pelagos.llm.lookup import Lookup


def corpus(n=500):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(3, 8))) for _ in range(400)]
    bad = ["zorkon", "xyzzy"]
    docs, labels = [], []
    for i in range(n):
        w = rng.choices(vocab, k=rng.randint(5, 60))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = rng.choice(bad) + rng.choice(["", "ish", ",", "!"])
        docs.append((i, " ".join(w), 0.5))
        labels.append((i, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy_and_edges(spark):
    docs, labels = corpus()
    odd = [(900, None, 0.1), (901, "", 0.1), (None, "zorkon xyzzy", 0.1), (4, docs[4][1], 0.2), (902, "zorkon " * 30_000, 0.0)]
    d = spark.createDataFrame(docs + odd, "doc_id long, text string, score double").repartition(3)
    lab = spark.createDataFrame([*labels, (4, 0, 0), (None, 1, 1), (7, None, None)], "doc_id long, quality int, toxic int")
    learn = toxicity.remainder(F.col("doc_id"), 3) != 1
    rows = toxicity.toxicity(d, lab, learn).withColumn("held", ~learn).collect()
    assert len(rows) == len(docs) + len(odd) and all(0 <= r["score"] <= 1 for r in rows)
    held = [r for r in rows if r["held"] and r["doc_id"] is not None and r["doc_id"] < 900]
    right = sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held)
    assert len(held) > 100 and right >= 0.95 * len(held)
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], set()).add(round(r["score"], 9))
    assert len(by[4]) == 1 and by[900] == by[901] and max(by[902]) > 0.7
    assert toxicity.toxicity(d.limit(0), lab, learn).collect() == []


def test_no_labels(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    lab = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["score"] for r in toxicity.toxicity(d, lab, F.lit(True)).collect()] == [0.5, 0.5]


def test_features_do_not_depend_on_the_block():
    texts = [b"You Zorkon, you!", b"", b"a b c d a b", "é è ê".encode()]
    keys, docs = toxicity.features(texts)
    for i, t in enumerate(texts):
        assert sorted(toxicity.features([t])[0].tolist()) == sorted(keys[docs == i].tolist())
    weights = Lookup(np.unique(keys), np.ones(len(np.unique(keys))))
    assert toxicity.score_texts(texts, weights, -1.0)[1] == pytest.approx(1 / (1 + np.e))


def test_learner_against_plain_ftrl():
    """The published update, one coordinate after the other in dictionaries; features of a single text take part."""
    docs, labels = corpus(60)
    texts, y = [t.encode() for _, t, _ in docs], np.array([t for _, _, t in labels], dtype=np.int8)
    z, n = {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= (0 if k is None else toxicity.L1) else -(z[k] - (0 if k is None else np.sign(z[k]) * toxicity.L1)) / ((toxicity.BETA + n[k] ** 0.5) / toxicity.ALPHA + toxicity.L2)
    sets = [[*set(toxicity.features([t])[0].tolist()), None] for t in texts]
    for epoch in range(3):
        for i in np.random.default_rng(epoch).permutation(len(y)):
            w = {k: weight(k) for k in sets[i]}
            g = 1 / (1 + np.exp(-sum(w.values()))) - y[i]
            for k in sets[i]:
                sigma = ((n.get(k, 0.0) + g * g) ** 0.5 - n.get(k, 0.0) ** 0.5) / toxicity.ALPHA
                z[k] = z.get(k, 0.0) + g - sigma * w[k]
                n[k] = n.get(k, 0.0) + g * g
    keys, w, intercept = toxicity.learn_texts(texts, y, 3)
    want = {k: weight(k) for k in z if k is not None and weight(k)}
    assert dict(zip(keys.tolist(), w.tolist())) == pytest.approx(want) and len(want) > 5
    assert intercept == pytest.approx(weight(None))


def test_sampling_share_is_exact(spark):
    """A share of less than a millionth still takes its part of the texts."""
    docs, labels = corpus(400)
    d = spark.createDataFrame(docs, "doc_id long, text string, score double")
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    some = toxicity.toxicity(d, lab, F.lit(True), fit_bytes=30_000).collect()
    assert len({round(r["score"], 6) for r in some}) > 5
