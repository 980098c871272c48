import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline
from pelagos.llm import quality, simhash
from pelagos.llm.storage import stored

SF = "/root/testdata/sf0.001"


def tiny(spark, tmp_path):
    rng = random.Random(8)
    vocab = ["".join(rng.choices("abcdefghijk", k=rng.randint(2, 6))) for _ in range(200)]
    say = lambda n: " ".join(rng.choices(vocab[: 30 + n], k=n))
    passage, item = say(70), say(30)
    docs = [(i, say(rng.randint(30, 150)), "en", "s", 1) for i in range(90)]
    junk = [(100 + i, " ".join("".join(rng.choices("QXZ$%&*", k=7)) for _ in range(60)), "en", "s", 1) for i in range(8)]
    copies = [(200 + i, docs[5][1], "en", "s", 1) for i in range(6)]
    sharing = [(300 + i, f"{say(60)} {passage} {say(60)}", "en", "s", 1) for i in range(5)]
    leaks = [(400 + i, f"{say(60)} {item} {say(60)}", "en", "s", 1) for i in range(3)]
    odd = [(500, None, None, None, None), (501, "", "xx", "s", 0), (None, say(40), None, "s", 1), (7, docs[7][1], "en", "s", 1)]
    rows = docs + junk + copies + sharing + leaks + odd
    spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, perplexity double").repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(90)] + [(100, 0, 0), (None, 1, 0), (3, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path), passage, item


def test_each_stage_takes_effect(spark, tmp_path):
    sf, passage, item = tiny(spark, tmp_path)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf), "stage")
        if name != "best-fit packing":
            assert docs.columns == columns
        seen.append(docs)
    good, single, cut, clean, packed = (d.collect() for d in seen)
    ids = lambda rows: Counter(r["doc_id"] for r in rows)
    assert not set(range(100, 108)) & set(ids(good)) and len(set(ids(good)) & set(range(90))) >= 87
    assert not set(range(200, 206)) & set(ids(single)) and ids(single)[5] == 1 and ids(single)[7] == 1
    assert sum(passage in (r["text"] or "") for r in cut) == 1
    assert {r["doc_id"] for r in cut} - {r["doc_id"] for r in clean} == {400} or not any(item in (r["text"] or "") for r in clean)
    assert not any(item in (r["text"] or "") for r in clean)
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in clean}
    places = defaultdict(list)
    for r in packed:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for p in places.values():
        assert sum(n for _, n in p) <= 1024 and [a for a, _ in sorted(p)][0] == 0


def test_classifier_without_labels(spark):
    docs = spark.createDataFrame([(1, "a b", "en"), (2, None, None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out, names = quality.classify(docs, labels)
    assert [r[names[-1]] for r in out.collect()] == [True, True]
    assert quality.classify(docs.limit(0), labels)[0].collect() == []


def test_sample_is_shared_by_languages(spark):
    """What small languages leave of the bound goes to the others."""
    texts = [(i, "w" * 100, "big") for i in range(900)] + [(1000 + i, "w" * 100, "also") for i in range(900)] + [(2000 + i, "w" * 100, f"rare{i}") for i in range(20)] + [(3000, "w" * 100, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    labels = docs.selectExpr("doc_id", "1 quality", "0 toxic")
    fitted, held = quality.split_trusted(docs, labels, 60_000)
    by = Counter(r["lang"] for r in fitted.collect())
    assert 10_000 < 100 * sum(n for k, n in by.items() if (k or "rare").startswith("rare")) + 9_000 and 20_000 < 100 * by["big"] < 36_000 and 20_000 < 100 * by["also"] < 36_000
    assert not {r["doc_id"] for r in fitted.collect()} & {r["doc_id"] for r in held.collect()}
    assert quality.split_trusted(docs, labels, 10**9)[0].count() == fitted.sparkSession.createDataFrame(texts, docs.schema).count() - held.count()


def brute_kn(texts, docs):
    """Interpolated modified Kneser-Ney as defined, in dictionaries."""
    import math

    c3 = Counter()
    for t in texts:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        c3.update(zip(w, w[1:], w[2:]))
    c2 = Counter()
    for (u, v, w), c in c3.items():
        c2[v, w] += c if v == "<s>" else 1
    c1 = Counter(w for _, w in c2)

    def discounts(c):
        n = Counter(c.values())
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
        raw = [k - (k + 1) * y * n[k + 1] / n[k] if n[k] else 0.5 * k for k in (1, 2, 3)]
        return [min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw)]

    d3, d2, d1 = discounts(c3), discounts(c2), discounts(c1)
    cut = lambda d, c: d[min(c, 3) - 1] if c else 0
    total1 = sum(c1.values())
    left1 = sum(cut(d1, c) for c in c1.values()) / total1
    p1 = lambda w: (c1[w] - cut(d1, c1[w])) / total1 + left1 / (len(c1) + 1)
    t2, l2, t3, l3 = Counter(), Counter(), Counter(), Counter()
    for (v, w), c in c2.items():
        t2[v] += c
        l2[v] += cut(d2, c)
    for (u, v, w), c in c3.items():
        t3[u, v] += c
        l3[u, v] += cut(d3, c)

    def p2(v, w):
        return (c2[v, w] - cut(d2, c2[v, w])) / t2[v] + l2[v] / t2[v] * p1(w) if t2[v] else p1(w)

    def p3(u, v, w):
        return (c3[u, v, w] - cut(d3, c3[u, v, w])) / t3[u, v] + l3[u, v] / t3[u, v] * p2(v, w) if t3[u, v] else p2(v, w)

    out = []
    for t in docs:
        w = ["<s>", "<s>", *t.split(), "</s>"]
        out.append(sum(math.log10(p3(*g)) for g in zip(w, w[1:], w[2:])))
    return out


@pytest.mark.parametrize("shard_rows", [10**6, 40])
def test_perplexities_against_plain_definitions(spark, shard_rows):
    rng = random.Random(3)
    vocab = ["w%d" % i for i in range(25)]
    texts = [" ".join(rng.choices(vocab[:20], k=rng.randint(0, 12))) for _ in range(40)]
    other = [" ".join(rng.choices(vocab, k=rng.randint(0, 12))) for _ in range(20)]
    model, unknown = quality.fit(spark.createDataFrame([(t,) for t in texts], "text string"))
    docs = spark.createDataFrame(list(enumerate(texts + other)), "doc_id long, text string")
    got = quality.with_log_probability(docs, model, unknown, ("n", "p"), shard_rows).orderBy("doc_id").collect()
    assert [r["p"] for r in got] == pytest.approx(brute_kn(texts, texts + other), rel=1e-4)


def brute_components(fps, radius):
    ids = sorted(fps, key=lambda x: (x is None, x))
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in ids:
        for b in ids:
            if (fps[a] ^ fps[b]).bit_count() <= radius:
                x, y = sorted((top(a), top(b)))
                root[y] = x
    return {i: top(i) for i in ids}


@pytest.mark.parametrize("radius,segments,limit", [(2, 5, 32), (2, 5, 1), (3, 5, 32), (3, 5, 1), (1, 4, 2)])
def test_links_against_all_pairs(spark, radius, segments, limit):
    from pelagos.llm.components import connected_components

    rng = random.Random(radius * 7 + limit)
    fps = [rng.getrandbits(64) for _ in range(12)]
    for _ in range(120):
        x = rng.choice(fps)
        for _ in range(rng.randint(1, 4)):
            x ^= 1 << rng.randrange(64)
        fps.append(x)
    fps = list(dict.fromkeys(fps))
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.close_pairs(spark.createDataFrame([(x,) for x in signed], "fp long"), radius, segments, limit)
    root = {r["node"]: r["root"] for r in connected_components(links).collect()}
    want = brute_components({s: f for s, f in zip(signed, fps)}, radius)
    assert {s: root.get(s, s) for s in signed} == want


def test_fingerprints_and_components(spark):
    import xxhash

    texts = [None, "", " \n", "A b", "a B", "x y z", "one two three four five", "ONE two three four five", "é è"]
    docs = spark.createDataFrame([(i, t, "f") for i, t in enumerate(texts)] + [(None, "a b", "f"), (3, "A b", "f")], "doc_id long, text string, fingerprint string")
    got = {r["doc_id"]: r for r in simhash.near_duplicates(docs).collect()}
    for i, t in enumerate(texts):
        w = (t or "").encode().lower().split()
        sh = [b" ".join(w[k : k + 3]) for k in range(max(1, len(w) - 2))] if w else []
        hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
        fp = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))
        assert got[i]["fingerprint"] == f"{fp:016x}"
    assert [got[i]["component_id"] for i in (0, 1, 2, 3, 4, 6, 7, None)] == [0, 0, 0, 3, 3, 6, 6, 3]
    assert simhash.near_duplicates(docs.limit(0)).collect() == []


@pytest.mark.parametrize("limit", [64, 2])
def test_similar_texts_against_all_pairs(spark, limit):
    rng = random.Random(limit)
    vocab = ["v%d" % i for i in range(400)]
    docs = [(i, " ".join(rng.choices(vocab, k=rng.randint(3, 120)))) for i in range(30)]
    for i in range(60):
        w = rng.choice(docs)[1].split()
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(vocab)
        docs.append((100 + i, " ".join(w)))
    docs += [(300, None), (301, ""), (302, " \n"), (None, docs[0][1]), (5, docs[5][1])]
    rng.shuffle(docs)
    sets = [frozenset(simhash.shingle_hashes((t or "").encode(), 5)) for _, t in docs]
    top = list(range(len(docs)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                top[root(a)] = root(b)
    want = {}
    for i, (k, _) in enumerate(docs):
        group = [docs[j][0] for j in range(len(docs)) if root(j) == root(i) and docs[j][0] is not None]
        want.setdefault(k, set()).add(min(group) if group else None)
    d = spark.createDataFrame([(k, t, "x") for k, t in docs], "doc_id long, text string, first string").repartition(3)
    got = {}
    for r in simhash.similar_texts(d, block_limit=limit).collect():
        got.setdefault(r["doc_id"], set()).add(r["component_id"])
    assert got == want
    assert simhash.similar_texts(d.limit(0)).collect() == []


def similar_components(texts):
    """Components of all pairs of texts at 0.8 or more, by brute force: the smallest index of each text's group."""
    sets = [frozenset(simhash.shingle_hashes(t.encode(), 5)) for t in texts]
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in range(len(texts)):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    return {i: root(i) for i in range(len(texts))}


@pytest.mark.parametrize("limit,work,shared,own", [(64, 0, 90, 60), (2, 0, 90, 60), (2, 50, 90, 60), (2, 50, 240, 60), (16, 0, 250, 45)])
def test_crowded_blocks_lose_no_pair(spark, monkeypatch, limit, work, shared, own):
    # 100 texts share a notice that makes up 60 to 85 % of them; pairs of them are near copies of each other only
    monkeypatch.setattr(simhash, "HUB_WORK", work)
    rng = random.Random(limit + work + shared)
    say = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    notice, texts = say(shared), []
    for _ in range(50):
        mine = say(own)
        texts += [" ".join(notice + mine), " ".join(notice + mine[:-2] + say(2))]
    want = similar_components(texts)
    assert len(set(want.values())) == 50
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs, block_limit=limit).collect()} == want


def test_repeated_lines_and_late_keys(spark):
    rng = random.Random(4)
    say = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    jaccard = lambda a, b: len(a & b) / len(a | b)
    hashes = lambda w: simhash.shingle_hashes(" ".join(w).encode(), 5)
    texts = []
    # a line repeated many times: alike as sets, but over 22 bits apart where repeats are counted
    while len(texts) < 8:
        w = say(300)
        v = w + w[-10:] * 100
        a, b = hashes(w), hashes(v)
        if (simhash.majority(a) ^ simhash.majority(b)).bit_count() > 22:
            assert jaccard(set(a), set(b)) > 0.9
            texts += [" ".join(w), " ".join(v)]
    # at 0.8 or more, but none of the four smallest hashes is shared
    while len(texts) < 12:
        w = say(120)
        v = list(w)
        for i in (20, 60):
            v[i] = "x" + v[i]
        a, b = hashes(w), hashes(v)
        if jaccard(set(a), set(b)) >= 0.8 and not set(sorted(a)[:4]) & set(sorted(b)[:4]):
            texts += [" ".join(w), " ".join(v)]
    want = similar_components(texts)
    assert len(set(want.values())) == 6
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"]: r["component_id"] for r in simhash.similar_texts(docs).collect()} == want


@pytest.mark.parametrize("n", [65_535, 65_536, 65_537, 140_000])
def test_fingerprints_of_very_long_texts(n):
    rng = random.Random(n)
    few = [rng.getrandbits(64) for _ in range(7)]
    hashes = [few[i % 7] for i in range(n)]
    want = sum(1 << b for b in range(64) if 2 * sum((h >> b & 1) * (n // 7 + (i < n % 7)) for i, h in enumerate(few)) > n)
    assert simhash.majority(hashes) == want
    words = " ".join(f"w{i % 5000}" for i in range(n)).encode()
    assert len(simhash.shingle_hashes(words, 5)) == n - 4


def test_digests_that_collide_drop_no_text(spark, monkeypatch):
    """Texts whose sets share one 64-bit name but not the whole digest are not merged."""
    import xxhash

    real = xxhash.xxh3_128_intdigest
    monkeypatch.setattr(simhash.xxhash, "xxh3_128_intdigest", lambda b: (real(b) >> 64 << 64) | 7)
    rng = random.Random(1)
    docs = spark.createDataFrame([(i, " ".join(f"v{rng.randrange(10**6)}" for _ in range(40))) for i in range(5)], "doc_id long, text string")
    assert simhash.near_duplicate_stage(spark, docs.coalesce(1), "").count() == 5


def test_stage_keeps_one_text_of_close_fingerprints(spark):
    """Texts whose fingerprints are within two bits are copies in the stage, also where their shingle sets are less alike than 0.8."""
    rng = random.Random(11)
    say = lambda n: [f"v{rng.randrange(10**6)}" for _ in range(n)]
    texts = []
    for _ in range(3):
        line = say(31)  # an odd number of shingles, repeated so often that they decide every bit
        texts += [" ".join(line * 40 + say(25)) for _ in "ab"]
        a, b = (simhash.fingerprint_of(t.encode(), 3) for t in texts[-2:])
        assert (a ^ b).bit_count() <= 2
    alone = [" ".join(say(80)) for _ in range(4)]
    assert set(similar_components(texts + alone).values()) == set(range(10))
    docs = spark.createDataFrame(list(enumerate(texts + alone)), "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.near_duplicate_stage(spark, docs, "").collect()} == {0, 2, 4, 6, 7, 8, 9}


def test_all_trusted_text_counts(spark):
    """Beyond the former bound of 5 MB each trusted document is fitted on or held out for the thresholds."""
    docs = spark.range(80).selectExpr("id doc_id", "repeat(concat('w', id, ' '), 30000) text", "'en' lang")
    labels = docs.selectExpr("doc_id", "1 quality", "0 toxic")
    fitted, held = (rows.selectExpr("doc_id", "octet_length(text) n").collect() for rows in quality.split_trusted(docs, labels))
    assert sum(r["n"] for r in fitted) > 5_500_000
    assert sorted(r["doc_id"] for r in fitted + held) == list(range(80))


def test_joined_scores_of_repeated_and_empty_texts(spark):
    """A model of any size gives what one that is sent to the tasks gives, also for copies and texts without words."""
    rows = [(1, "a b c"), (2, "a b c"), (1, "a b c"), (3, None), (4, ""), (5, "x a a b"), (None, " ")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model, unknown = quality.fit(spark.createDataFrame([("a b c",), ("a b d",), ("",)], "text string"))
    got = [Counter((r["doc_id"], r["text"], r["n"], round(r["p"], 4)) for r in quality.with_log_probability(docs, model, unknown, ("n", "p"), size).collect()) for size in (10**6, 1)]
    assert got[0] == got[1] and sum(got[0].values()) == 7 and {r[0]: r[2] for r in got[0]} == {1: 4, 2: 4, 3: 1, 4: 1, 5: 5, None: 1}


def test_work_in_parts_leaves_only_the_results_on_disk(spark, monkeypatch):
    """a model in parts and texts in slices give the plain definitions' values; what was shuffled, the counts and the model are gone."""
    rng = random.Random(11)
    vocab = ["w%d" % i for i in range(30)]
    texts = [" ".join(rng.choices(vocab, k=rng.randint(0, 15))) for _ in range(50)]
    monkeypatch.setattr(quality, "PART_BYTES", 500)
    docs = stored(spark.createDataFrame([(i, t, "en") for i, t in enumerate(texts)], "doc_id long, text string, lang string"), "docs")
    labels = stored(docs.selectExpr("doc_id", "1 quality", "0 toxic"), "labels")
    fitted = [r["text"] for r in quality.split_trusted(docs, labels)[0].collect()]

    def shuffled():
        files = spark._jsc.sc().env().blockManager().diskBlockManager().getAllFiles()
        return sum(files.apply(i).length() for i in range(files.size()) if files.apply(i).getName().startswith("shuffle"))

    spark._jvm.System.gc()
    before, tables = shuffled(), {t.name for t in spark.catalog.listTables()}
    model, unknown = quality.fit(docs.where(docs["text"].isin(fitted)))
    assert shuffled() <= before + 4096  # totals of some bytes only; the trigrams alone take more
    got = quality.with_log_probability(docs, model, unknown, ("n", "p"), 10).orderBy("doc_id").collect()
    assert [r["p"] for r in got] == pytest.approx(brute_kn([t for t in texts if t in fitted], texts), rel=1e-4)
    out, _ = quality.classify(docs, labels, shard_rows=10)
    quality.drop_bucketed(model)
    assert out.count() == 50 and {t.name for t in spark.catalog.listTables()} == tables
