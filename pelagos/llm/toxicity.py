"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesvec import IS_SPACE, Words, binary_column, in_blocks
from .lookup import Lookup, pair_key
from .storage import stored, table

#: About so many bytes of labelled text are fitted on at most, drawn by a hash of the id.
FIT_BYTES = 24_000_000
EPOCHS = 6
ALPHA, BETA, L1, L2 = 1.0, 1.0, 2.5, 0.1
#: Words are also taken by their first so many bytes, so that inflected forms of a word share a feature.
STEMS = (4, 5, 6, 7)
THRESHOLD = 0.7
BLOCK_BYTES = 1 << 20

#: Words are parted by white space and by ASCII characters that are neither letters nor digits.
BREAKS = IS_SPACE | np.array([b < 128 and not chr(b).isalnum() for b in range(256)])
_PAIR, _SKIP = np.array([3], dtype=np.uint64), np.array([5], dtype=np.uint64)


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words, pairs of neighbours, pairs with one word between and stems in a block, and the text of each."""
    w = Words(texts, breaks=BREAKS)
    keys, docs = [w.hash], [w.doc]
    for gap, kind in ((1, _PAIR), (2, _SKIP)):
        same = w.doc[gap:] == w.doc[:-gap]
        keys.append(pair_key(kind, w.hash[:-gap][same], w.hash[gap:][same]))
        docs.append(w.doc[gap:][same])
    for n in STEMS:
        h, which = w.prefix(n)
        keys.append(pair_key(np.array([100 + n], dtype=np.uint64), h))
        docs.append(w.doc[which])
    return np.concatenate(keys), np.concatenate(docs)


def ftrl(x: list[np.ndarray], y: np.ndarray, size: int, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights of features 0 to ``size`` - 1 and the intercept, by FTRL-proximal over texts with features ``x`` and labels ``y``.

    Every coordinate has a rate of its own, and its state lasts over all epochs; L1 alone decides which weights are
    zero. The intercept is free of L1. Texts come in another order each epoch.
    """
    z, n = np.zeros(size + 1), np.zeros(size + 1)  # the intercept is last

    def weights(zs: np.ndarray, root: np.ndarray) -> np.ndarray:
        l1 = np.full(len(zs), L1)
        l1[-1] = 0.0
        return -np.sign(zs) * np.maximum(np.abs(zs) - l1, 0) / ((BETA + root) / ALPHA + L2)

    for epoch in range(epochs):
        for i in np.random.default_rng(epoch).permutation(len(y)):
            at = np.append(x[i], size)
            zs, root = z[at], np.sqrt(n[at])
            w = weights(zs, root)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -30, 30))) - y[i]
            grown = n[at] + g * g
            z[at] = zs + g - (np.sqrt(grown) - root) / ALPHA * w
            n[at] = grown
    w = weights(z, np.sqrt(n))
    return w[:-1], float(w[-1])


def learn_texts(texts: list[bytes], y: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray, float]:
    """The features with a weight, their weights, and the intercept. All features of all texts take part."""
    x = [np.unique(features([t])[0]) for t in texts]
    keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *x]))
    w, intercept = ftrl([np.searchsorted(keys, a).astype(np.int32) for a in x], y, len(keys), epochs)
    kept = w != 0
    return keys[kept], w[kept], intercept


def fit(labelled: DataFrame) -> tuple[Lookup, float]:
    """Weights and intercept from ``labelled`` (``doc_id``, ``text``, ``y``), a sample of bounded size.

    FTRL-proximal goes from text to text, so one task learns from the sample; what it returns are the weights that
    L1 leaves.
    """
    order = F.xxhash64(F.col("doc_id").cast("string"), F.lit(11))
    rows = labelled.select(F.lit(0).alias("learner"), order.alias("order"), F.col("y").cast("int").alias("y"), F.col("text").cast("binary").alias("text"))

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "text"])
        keys, w, intercept = learn_texts([bytes(t or b"") for t in rows["text"]], rows["y"].to_numpy(np.int8))
        return pd.DataFrame({"k": np.append(keys.view(np.int64), 0), "w": np.append(w, intercept), "intercept": np.append(np.zeros(len(w), bool), True)})

    got = stored(rows.groupBy("learner").applyInPandas(run, "k long, w double, intercept boolean"), "tox-weights").toArrow()
    first = got.column("intercept").to_numpy()
    k, w = got.column("k").to_numpy().view(np.uint64), got.column("w").to_numpy()
    return Lookup(k[~first], w[~first]), float(w[first].sum())


def score_texts(texts: list[bytes], weights: Lookup, intercept: float) -> np.ndarray:
    """The probability that each text is toxic: every feature counts once a text, however often it occurs."""
    sums = np.full(len(texts), intercept)
    for i, j in in_blocks(texts, BLOCK_BYTES):
        keys, docs = features(texts[i:j])
        at = weights.find(keys)
        hit = at >= 0
        if hit.any():
            pairs = np.unique(np.stack([docs[hit], at[hit]]), axis=1)
            sums[i:j] += np.bincount(pairs[0], weights=weights.values[pairs[1]], minlength=j - i)
    return 1 / (1 + np.exp(-np.clip(sums, -500, 500)))


def remainder(key: Column, by: int) -> Column:
    """crc32 of the key as text modulo ``by``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % by


def toxicity(docs: DataFrame, labels: DataFrame, learn: Column, threshold: float = THRESHOLD, fit_bytes: int = FIT_BYTES) -> DataFrame:
    """``doc_id``, ``score``, ``predicted`` per row of ``docs``, learned from the labelled rows where ``learn`` holds.

    Null texts count as empty and get the intercept's score; a document labelled both ways counts as toxic;
    without labels every score is 0.5; repeated rows get the same score.
    """
    known = labels.where("toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("y"))
    # the texts of labelled rows alone are needed, and of those a bounded share: keys are joined first
    share = docs.where(learn).select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).alias("n"))
    keys = stored(share.join(known, "doc_id"), "labelled")
    total = keys.agg(F.sum("n")).first()[0] or 0
    share = min(1.0, fit_bytes / max(total, 1))
    order = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit(7)), F.lit(1 << 52))
    picked = stored(keys.where(order < share * (1 << 52)).groupBy("doc_id").agg(F.max("y").alias("y")), "picked")
    labelled = docs.where(learn).select("doc_id", "text").join(picked, "doc_id")
    weights, intercept = fit(labelled)
    held = docs.sparkSession.sparkContext.broadcast((weights, intercept))
    plain = docs.select("doc_id", F.col("text").cast("binary").alias("_t"))

    def run(batches):
        for b in batches:
            got = score_texts(binary_column(b, "_t"), *held.value)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got)], names=["doc_id", "score"])

    scored = plain.mapInArrow(run, plain.select("doc_id").schema.add("score", "double"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's toxicity; rows whose crc32 modulo 3 is 1 are held out."""
    held_out = remainder(F.col("doc_id"), 3) == 1
    out = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "score", "predicted")
