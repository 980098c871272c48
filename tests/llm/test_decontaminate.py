import random
import re
from collections import Counter

import pytest

from pelagos.llm import decontaminate as dc


def toks(t):
    return [w for w in re.split(r"[\x20\x09-\x0d]+", (t or "").lower()) if w]


def bag(w, k):
    return Counter(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def brute(docs, items):
    """The best window of every document and item over all places."""
    out = {}
    for k, t in docs:
        w = toks(t)
        for item, text in items:
            v = toks(text)
            if not v:
                continue
            n = min(5, len(v))
            want = bag(v, n)
            for s in range(max(1, len(w) - len(v) + 1)):
                have = bag(w[s : s + len(v)], n)
                both = sum((want & have).values())
                union = sum(want.values()) + sum(have.values()) - both
                if union and both / union >= 0.8 and both / union > out.get((k, item), (0, 0))[0]:
                    out[k, item] = (both / union, s)
    return out


def test_against_brute_force(spark):
    rng = random.Random(4)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(300)]
    say = lambda n: " ".join(rng.choices(vocab, k=n))
    items = [(i, say(rng.randint(14, 60))) for i in range(25)] + [(50, "one two three"), (51, ""), (52, None), (53, "solo"), (54, "a b " * 20), (None, say(20))]
    docs = []
    for i in range(60):
        text = say(rng.randint(0, 120))
        if i % 2:
            w = items[rng.randrange(25)][1].split()
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(w))
                what = rng.choice(["swap", "drop", "add"])
                w[at : at + (what != "add")] = [] if what == "drop" else [rng.choice(vocab)]
            text = f"{text}\n{' '.join(w).upper() if i % 3 else ' '.join(w)}\t{say(rng.randint(0, 90))}"
        docs.append((i, text))
    docs += [(100, None), (101, ""), (102, "One two\nthree"), (103, "only solo here"), (104, "a b " * 60), (None, items[3][1]), (7, docs[7][1]), (105, " ".join(items[0][1].split()[:-1]))]
    d = spark.createDataFrame([(k, t, 1) for k, t in docs], "doc_id long, text string, size int").repartition(3)
    b = spark.createDataFrame([*items, items[0]], "item_id long, text string")
    got = dc.contaminations(d, b).collect()
    want = brute(docs, items)
    assert Counter((r["doc_id"], r["item_id"]) for r in got) == Counter((k, i) for k, t in docs for (x, i) in want if x == k)
    for r in got:
        assert (r["similarity"], r["start_word"]) == pytest.approx(want[r["doc_id"], r["item_id"]])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    some = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert dc.contaminations(none, items).collect() == [] and dc.contaminations(some, items).collect() == []
    assert dc.contaminations(none, spark.createDataFrame([(1, "a b c")], "item_id long, text string")).collect() == []


def test_windows_within_the_radius_against_all_pairs(spark):
    """Every window that shares a shingle with an item of its size has its fingerprint, and the blocks find all pairs within the radius."""
    import xxhash
    from pyspark.sql import functions as F

    rng = random.Random(9)
    vocab = ["".join(rng.choices("abcdefgh", k=3)) for _ in range(60)]
    words = rng.choices(vocab, k=400)
    size, k = 24, 5
    rows = spark.createDataFrame([(1, 2, size, k, len(words), 0, len(words) - size, " ".join(words))], "_a long, _b long, size int, k int, n int, begin int, to int, t string")
    rows = rows.withColumn("_w", F.split("t", " ")).select("_a", "_b", "size", "k", "n", "begin", "to", F.posexplode(dc._shingles("_w", k)).alias("q", "h"))
    hashes = {r["q"]: r["h"] & (1 << 64) - 1 for r in rows.collect()}

    def print_of(hs):
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))

    got = {r["q"]: r["fp"] & (1 << 64) - 1 for r in dc.window_fingerprints(rows).collect()}
    assert got == {s: print_of([hashes[i] for i in range(s, s + size - k + 1)]) for s in range(len(words) - size + 1)}
    radius, blocks = 20, 7
    targets = list(got.values())[::15] + [print_of([xxhash.xxh64_intdigest(str(i).encode()) for i in range(9)])]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    a = spark.createDataFrame([(q, signed(x)) for q, x in got.items()], "q int, fp long").select("q", F.explode(dc._block_values("fp", blocks)).alias("v")).select("q", "v.*")
    b = spark.createDataFrame([(i, signed(x)) for i, x in enumerate(targets)], "item int, fp long").select("item", F.explode(dc._near_values("fp", radius, blocks)).alias("v")).select("item", "v.*")
    met = {(r["q"], r["item"]) for r in a.join(b, ["block", "value"]).select("q", "item").distinct().collect()}
    assert {(q, i) for q, x in got.items() for i, y in enumerate(targets) if (x ^ y).bit_count() <= radius} <= met


def test_long_items_and_texts(spark):
    rng = random.Random(12)
    item = [f"w{rng.randrange(5000)}" for _ in range(900)]
    changed = list(item)
    for i in range(0, 900, 60):
        changed[i] = "x"
    docs = [(1, " ".join([f"v{i}" for i in range(3000)] + changed + ["v"] * 50)), (2, " ".join(item[:400]))]
    got = dc.contaminations(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(item))], "item_id long, text string")).collect()
    assert [(r["doc_id"], r["item_id"], r["start_word"], r["n_words"]) for r in got] == [(1, 7, 3000, 900)]
