import math
import random
import re
from collections import Counter

import duckdb
import pytest

from pelagos.llm import ranked_search

SF = "/root/testdata/sf0.001"
TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return TERM.findall(lower)


def plain(docs, items, k=20):
    """Every document scored for every item."""
    counts = [(d, Counter(terms(t))) for d, t in docs]
    held = [c for _, c in counts if c]
    n, total = len(held), sum(map(Counter.total, held))
    df = Counter(t for c in held for t in c)
    out = []
    for item, text in dict.fromkeys(items):
        scores = []
        for d, c in counts:
            m = 75 + 25 * c.total() * n // max(total, 1)
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if s > 0:
                scores.append((-s, d is None, d or 0, d))
        out += [(item, i + 1, x[3], -x[0]) for i, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return out


def made(spark, docs, items):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")


def key(r):
    return tuple((x is None, x or 0) for x in r)


def test_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = con.execute(ranked_search.OP11_SQL).fetchall()
    df = ranked_search.op11_ranked_search(spark, SF)
    assert df.columns == ["item_id", "rank", "doc_id", "score"]
    assert sorted(map(tuple, df.collect())) == sorted(want) and len(want) > 100


@pytest.mark.parametrize("block,passes", [(1, 10), (3, 100_000), (32, 7)])
def test_against_brute_force(spark, block, passes):
    rng = random.Random(block)
    vocab = ["".join(rng.choices("abcdeé9", k=rng.randint(1, 4))) for _ in range(60)]
    say = lambda n: "".join(rng.choice(vocab).upper() + rng.choice([" ", "-", "\n", "_", "!"]) for _ in range(n))
    docs = [(i, say(rng.choice([1, 5, 30, 200]))) for i in range(400)]
    docs += [(500 + i, docs[3][1]) for i in range(60)] + [(7, docs[7][1]), (7, docs[7][1]), (None, docs[3][1]), (901, None), (902, ""), (903, "!? --")]
    items = [(i, say(rng.choice([1, 3, 12]))) for i in range(12)] + [(50, docs[3][1]), (51, None), (52, ""), (53, "zzz"), (54, "a a a b"), (54, "a a a b"), (None, say(4))]
    rng.shuffle(docs)
    d, i = made(spark, docs, items)
    got = ranked_search.ranked(d.repartition(5), i, block=block, pass_terms=passes).collect()
    assert sorted(map(tuple, got), key=key) == sorted(plain(docs, items), key=key)


def test_nothing(spark):
    d, i = made(spark, [], [(1, "a")])
    assert ranked_search.ranked(d, i).collect() == []
    d, i = made(spark, [(1, "a"), (2, None)], [])
    assert ranked_search.ranked(d, i).collect() == []
    d, i = made(spark, [(1, None)], [(1, "a")])
    assert ranked_search.ranked(d, i).collect() == []


def test_long_text_and_clashing_names(spark):
    docs = [("x", "word " * 300_000 + "tail", 1, 2), ("y", "tail", 3, 4), ("z", "head", 0, 0)]
    d = spark.createDataFrame(docs, "doc_id string, text string, q int, score int")
    i = spark.createDataFrame([("i", "tail", 5)], "item_id string, text string, rank int")
    got = ranked_search.ranked(d, i).orderBy("rank").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in got] == [("i", 1, "y"), ("i", 2, "x")]
