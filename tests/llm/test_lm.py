import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from pelagos.llm import ctw, lm_scoring


def canon(t):
    return b" ".join((t or "").encode().lower().split()) + b"\n"


def plain_tree(texts, depth):
    """Context-tree weighting as defined, node by node in dictionaries."""
    n = defaultdict(lambda: [0, 0])
    for t in texts:
        data = b"\n" * depth + t
        for i in range(depth, len(data)):
            for d in range(depth + 1):
                z = 1
                for j in range(7, -1, -1):
                    bit = data[i] >> j & 1
                    n[data[i - d : i], z][bit] += 1
                    z = z * 2 + bit
    kt = lambda a, b: math.lgamma(a + 0.5) + math.lgamma(b + 0.5) - math.lgamma(a + b + 1) - math.log(math.pi)
    weighted, own = {}, {}
    children = defaultdict(float)
    for (c, z), (a, b) in sorted(n.items(), key=lambda x: -len(x[0][0])):
        own[c, z] = kt(a, b)
        if len(c) == depth:
            weighted[c, z] = own[c, z]
        else:
            weighted[c, z] = np.logaddexp(own[c, z], children[c, z]) - math.log(2)
        if c:
            children[c[1:], z] += weighted[c, z]

    def log10(context, byte):
        total, z = 0.0, 1
        for j in range(7, -1, -1):
            bit = byte >> j & 1
            p, left = None, 1.0
            for d in range(depth + 1):
                c = context[len(context) - d :]
                if (c, z) not in n:
                    break
                a, b = n[c, z]
                here = ((a, b)[bit] + 0.5) / (a + b + 1)
                deeper = d < depth and (context[len(context) - d - 1 :], z) in n
                w = 1.0 if not deeper else math.exp(own[c, z] - math.log(2) - weighted[c, z])
                p = (p or 0.0) + left * w * here
                left *= 1 - w
            total += math.log10(p if p is not None else 0.5)
            z = z * 2 + bit
        return total

    return lambda t: sum(log10((b"\n" * depth + t)[i : i + depth], t[i]) for i in range(len(t)))


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcé", k=rng.randint(1, 5))) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.randint(0, 25)))) for i in range(n)]
    return rows + [(900, None), (901, ""), (902, " \t"), (903, "ZZ Top"), (None, "abc"), (5, rows[5][1]), (904, "Abc\x0b " * 50)]


@pytest.mark.parametrize("shards", [(10**6, 10**6, 10**6), (50, 200, 8)])
def test_against_plain_definitions(spark, shards):
    rows = corpus()
    docs = spark.createDataFrame([(k, t, 0.0) for k, t in rows], "doc_id long, text string, score double").repartition(3)
    learn = F.coalesce(F.col("doc_id") % 7 != 2, F.lit(True))
    got = lm_scoring.scores(docs, learn, 3, *shards).collect()
    assert len(got) == len(rows)
    taught = [t for k, t in rows if k is None or k % 7 != 2]
    tree = plain_tree([canon(t) for t in taught], 3)
    c = Counter()
    for t in taught:
        c.update([*canon(t).split(), b"\n"])
    n, v = sum(c.values()), len(c)
    want = defaultdict(list)
    for k, t in rows:
        toks = [*canon(t).split(), b"\n"]
        want[k].append((len(toks), sum(c[x] > 0 for x in toks), sum(math.log10((c[x] + 1) / (n + v + 1)) for x in toks), tree(canon(t)), len(canon(t))))
    for r in got:
        w = want[r["doc_id"]].pop()
        assert (r["n_tokens"], r["n_known"], r["n_bytes"], r["train_tokens"]) == (w[0], w[1], w[4], n)
        assert r["base_score"] == pytest.approx(w[2], abs=1e-6)
        assert r["score"] == pytest.approx(w[3], rel=1e-4, abs=1e-3)


def test_probabilities_of_all_bytes_sum_to_one():
    w = lm_scoring.Words([canon(t)[:-1] for _, t in corpus(2)])
    keys = lm_scoring.grams(w, len(corpus(2)), 3)[0]
    k, c = np.unique(keys, return_counts=True)
    of = ctw.levels(k, c.astype(np.int64), 3, 0)
    _, own, parents = ctw.weigh_up(of)
    p, _ = ctw.mix_down(of, own, parents)
    tree = ctw.Tree([(lv.keys, ctw.code_lengths(lv, x)) for lv, x in zip(reversed(of), p, strict=True)])
    for context in [int(k[0]) >> 8, int(k[-1]) >> 8, 0x616263, 0xFFFFFF, (int(k[5]) >> 8) ^ 1]:
        all_bytes = (np.uint64(context) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert (10 ** tree.log10(all_bytes)).sum() == pytest.approx(1, abs=1e-4)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in lm_scoring.scores(docs, F.lit(False)).collect()}
    assert got[1]["bits_per_byte"] == pytest.approx(8) and got[1]["base_score"] == 0 and got[1]["n_known"] == 0
    assert lm_scoring.scores(docs.limit(0), F.lit(True)).collect() == []


def test_crc_remainder(spark):
    r = spark.createDataFrame([(1234,), (None,)], "doc_id long").select(lm_scoring.remainder(F.col("doc_id"), 7).alias("r")).collect()
    assert [x["r"] for x in r] == [zlib.crc32(b"1234") % 7, 0]


def test_driver_holds_one_small_shard_at_a_time(spark, monkeypatch):
    """Shards are sent one by one, several are scored in one pass, and none stays on the driver after its pass."""
    sent, gone = [], []
    kind = type(spark.sparkContext.broadcast(0))
    plain, destroy = type(spark.sparkContext).broadcast, kind.destroy
    monkeypatch.setattr(type(spark.sparkContext), "broadcast", lambda self, v: (sent.append(plain(self, v)), sent[-1])[1])
    monkeypatch.setattr(kind, "destroy", lambda self, *a: (gone.append(self), destroy(self, *a))[1])
    docs = spark.createDataFrame(corpus(4), "doc_id long, text string")
    passes = []
    keep = lm_scoring.stored
    monkeypatch.setattr(lm_scoring, "stored", lambda df, name: (passes.append(name), keep(df, name))[1])
    lm_scoring.scores(docs, F.lit(True), 3, 20, 20).collect()
    shards = len(sent) - 1  # the first is what stands above the parts
    assert shards > 4 and passes.count("lm-scores") == -(-shards // lm_scoring.SHARDS_AT_ONCE) and len(gone) == shards
    assert lm_scoring.SHARD_GRAMS * 48 * 4 < 50e6
