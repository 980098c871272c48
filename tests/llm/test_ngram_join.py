import random
from collections import defaultdict

import numpy as np
import pytest

from pelagos.llm import ngram_join
from pelagos.llm.ngram_join import Order, Scheme

SF = "/root/testdata/sf0.001"


def shingles(text, n=4):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in lower.replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if len(words) < n:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def brute(docs, n=4, percent=85):
    """Every pair of different sets, and union-find."""
    sets = [shingles(t, n) for _, t in docs]
    distinct = list(dict.fromkeys(s for s in sets if s))
    root = list(range(len(distinct)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    at = defaultdict(list)
    for i, s in enumerate(distinct):
        for x in s:
            at[x].append(i)
    for i, s in enumerate(distinct):
        shared = defaultdict(int)
        for x in s:
            for j in at[x]:
                shared[j] += j < i
        for j, c in shared.items():
            if j < i and 100 * c >= percent * (len(s) + len(distinct[j]) - c):
                root[find(i)] = find(j)
    place = {s: find(i) for i, s in enumerate(distinct)}
    least = {}
    for (d, _), s in zip(docs, sets, strict=True):
        if s and d is not None:
            least[place[s]] = min(least.get(place[s], d), d)
    return sorted((-1 if d is None else d, len(s), (-1 if (c := least.get(place[s]) if s else d) is None else c)) for (d, _), s in zip(docs, sets, strict=True))


def found(df):
    return sorted((-1 if r["doc_id"] is None else r["doc_id"], r["n_shingles"], -1 if r["component_id"] is None else r["component_id"]) for r in df.collect())


def families(seed, shared=None):
    """Texts, near copies at all distances about the bound, families in which few pairs are alike, and odd rows."""
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 5))) for _ in range(300)]
    say = lambda n: rng.choices(vocab, k=n)

    def edited(words, k):
        words = list(words)
        for _ in range(k):
            words[rng.randrange(len(words))] = "x" + rng.choice(vocab)
        return words

    docs = [say(rng.choice([1, 2, 3, 4, 5, 9, 40, 120])) for _ in range(150)]
    for size in (5, 12, 30, 60, 100, 250):
        base = say(size)
        docs += [edited(base, rng.randint(0, max(1, size // 25))) for _ in range(45)]
    notice = shared or say(90)
    docs += [notice + say(rng.randint(2, 25)) for _ in range(60)]
    chain = say(160)
    docs += [chain[i : i + 100] for i in range(0, 60, 3)]
    rows = [(i, " ".join(w)) for i, w in enumerate(docs)]
    rows += [(1000 + i, rows[200][1]) for i in range(40)] + [(5, rows[5][1].upper()), (5, rows[5][1]), (None, rows[210][1]), (None, " ".join(say(50)))]
    rows += [(2000, None), (2001, ""), (2002, " \n\t"), (2003, "Ä b"), (2004, "ä b"), (2005, "ONE  two"), (2006, "one\ttwo")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,frequent,limit,each", [(1, 3, 2, 0), (2, 64, 16, 50)])
def test_against_all_pairs(spark, monkeypatch, seed, frequent, limit, each):
    monkeypatch.setattr(ngram_join, "FREQUENT", frequent)
    docs = families(seed)
    df = spark.createDataFrame([(*r, 1, "k") for r in docs], "doc_id long, text string, node int, key string").repartition(3)
    got = found(ngram_join.ngram_classes(df, block_limit=limit, pairs_each=each))
    assert got == brute(docs)
    assert len({c for _, _, c in got}) > 150


def test_whole_table(spark):
    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    df = ngram_join.op12_ngram_join(spark, SF)
    assert df.columns == ["doc_id", "n_shingles", "component_id"]
    assert found(df) == brute([tuple(r) for r in table])


def test_nothing(spark):
    schema = "doc_id long, text string"
    assert ngram_join.ngram_classes(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, None), (1, None), (2, ""), (None, "  ")]
    assert found(ngram_join.ngram_classes(spark.createDataFrame(rows, schema))) == brute(rows)


@pytest.mark.parametrize("level", [0, 1, 2])
@pytest.mark.parametrize("percent", [50, 85, 95])
def test_alike_sets_share_a_key(level, percent):
    """Sets of any size over tokens of all classes: a pair that is alike meets where the shorter has its index prefix."""
    rng = np.random.default_rng(level * 100 + percent)
    scheme = Scheme(percent, level)
    universe = rng.integers(1, 1 << 63, 4000, dtype=np.uint64)
    counts = np.sort(rng.choice([0, 70, 100, 2000], 4000))
    order = Order(np.sort(universe[counts > 0]), counts[counts > 0])
    alike = 0
    for _ in range(400):
        n = int(rng.choice([1, 2, 3, 4, 6, 9, 14, 25, 60, 200]))
        a = rng.choice(universe[rng.integers(0, 3000):], n, replace=False)
        lose, gain = rng.integers(0, n * (100 - percent) // 100 + 1), rng.integers(0, n * (100 - percent) // 100 + 2)
        b = np.unique(np.concatenate([a[lose:], rng.choice(universe, gain)]))
        a = np.unique(a)
        shared = len(np.intersect1d(a, b))
        if 100 * shared < percent * (len(a) + len(b) - shared):
            continue
        alike += 1
        short, long = sorted((a, b), key=len)
        x, y = scheme.keys(*order(short)), scheme.keys(*order(long))
        own, other = dict(zip(x[0].tolist(), zip(x[1], x[2], strict=True), strict=True)), dict(zip(y[0].tolist(), y[1], strict=True))
        met = [k for k, (_, index) in own.items() if index and k in other]
        needed = percent * (len(a) + len(b))
        assert any(min(len(short) - own[k][0], len(long) - other[k]) * (100 + percent) >= needed for k in met)
    assert alike > 100


def test_long_text(spark):
    rng = random.Random(4)
    words = [str(rng.randrange(10**6)) for _ in range(200_000)]
    docs = [(1, " ".join(words)), (2, " ".join(words[5000:])), (3, " ".join(words[60_000:])), (4, "a b c d e")]
    assert [c for _, _, c in found(ngram_join.ngram_classes(spark.createDataFrame(docs, "doc_id long, text string")))] == [1, 1, 3, 4]
