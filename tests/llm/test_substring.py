import random

from pelagos.llm import substring
from pelagos.llm.bytesvec import Words


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def brute(rows, least=substring.LEAST_WORDS):
    """Chunk by chunk in Python: what is removed from each text."""
    cut = {}
    for k, t in rows:
        c = substring.Chunks([(t or "").encode()])
        cut[k, t] = [(int(d), int(a), int(z), int(n)) for d, a, z, n in zip(c.digest, c.start, c.end, c.words)]
    first = {}
    key = lambda k: (1 << 63) - 1 if k is None else k
    for (k, _), chunks in cut.items():
        for d, *_ in chunks:
            first[d] = min(first.get(d, key(None)), key(k))
    out = {}
    for (k, t), chunks in cut.items():
        spans, seen, run = [], set(), []
        for d, a, z, n in [*chunks, (None, 0, 0, 0)]:
            if d is not None and (d in seen or first[d] != key(k)):
                run.append((a, z, n))
            else:
                if sum(r[2] for r in run) >= least:
                    spans.append((run[0][0], run[-1][1]))
                run = []
            seen.add(d)
        out[k, t] = spans
    return out


def test_against_brute_force(spark):
    rng = random.Random(5)
    passage = [words(rng, 60) for _ in range(5)]
    rows = [(i, words(rng, rng.randint(0, 150)) + " " + rng.choice(passage) + "\n" + words(rng, 80)) for i in range(40)]
    rows += [(100 + i, words(rng, 120)) for i in range(20)]
    rows += [(200, None), (201, ""), (202, "  \n "), (None, rows[3][1]), (3, rows[3][1]), (203, "w " * 5000), (204, rows[7][1])]
    docs = spark.createDataFrame([(k, t, 7) for k, t in rows], "doc_id long, text string, spans int").repartition(4)
    out, names = substring.deduplicated(docs)
    want = brute(rows)
    got = out.collect()
    assert len(got) == len(rows)
    by_id = {}
    for r in got:
        by_id.setdefault(r["doc_id"], []).append(r)
    for k, t in rows:
        spans = want[k, t]
        for r in by_id[k]:
            assert [(s["start"], s["end"]) for s in r[names[2]]] == spans
            assert r[names[1]] == sum(z - a for a, z in spans)
            if not spans:
                assert r["text"] == t
    # every passage is left in one document, and clean documents are as they were
    for p in passage:
        assert sum(p in (r["text"] or "") for r in got if r["doc_id"] not in (3, None)) <= 1
    assert all(by_id[100 + i][0]["text"] == rows[40 + i][1] for i in range(20))


def test_chunks_do_not_depend_on_the_block():
    rng = random.Random(2)
    texts = [words(rng, rng.randint(0, 200)).encode() for _ in range(20)] + [b"", b"a"]
    together = substring.Chunks(texts)
    for i, t in enumerate(texts):
        alone = substring.Chunks([t])
        mine = together.doc == i
        assert alone.digest.tolist() == together.digest[mine].tolist()
        assert alone.start.tolist() == together.start[mine].tolist() and alone.end.tolist() == together.end[mine].tolist()
        assert alone.words.sum() == len(t.split())


def test_insertions_shift_few_chunks():
    rng = random.Random(3)
    text = words(rng, 2000)
    moved = "one more word " + text
    a, b = substring.Chunks([text.encode()]), substring.Chunks([moved.encode()])
    assert len(set(a.digest.tolist()) & set(b.digest.tolist())) > 0.98 * len(a.digest)


def test_empty_table(spark):
    assert substring.deduplicated(spark.createDataFrame([], "doc_id long, text string"))[0].collect() == []


def test_words_of_a_block():
    w = Words([b"A b\tc", b"", b" dd "], gap=3)
    assert w.count.tolist() == [3, 0, 1] and w.doc.tolist() == [0, 0, 0, 2] and w.size.tolist() == [1, 1, 1, 2]
    assert w.prefix(2)[1].tolist() == [3]


def test_known_chunks_of_several_texts_are_no_run(spark):
    rng = random.Random(9)
    passage = words(rng, 60)
    c = substring.Chunks([passage.encode()])
    parts = [passage.encode()[a:z].decode() for a, z in zip(c.start.tolist(), c.end.tolist())]
    # each chunk is known from a text of its own, where the 16 bytes before it are the same
    rows = [(i, f"{parts[i - 1] if i else ''}{parts[i]}" + words(rng, 40)) for i in range(len(parts)) if c.words[i] + (c.words[i - 1] if i else 0) < 12]
    rows = [(k, t) for k, t in rows if len(t) > 40]
    mixed = (1000, passage)
    docs = spark.createDataFrame([*rows, mixed], "doc_id long, text string").repartition(3)
    out, names = substring.deduplicated(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    loose = brute([*rows, mixed])[mixed]
    assert loose, "chunk by chunk the passage is known"
    shared = [s for s in got[1000][names[2]]]
    assert not shared and got[1000]["text"] == passage


def plain_runs(rows, least=substring.LEAST_WORDS):
    """Which words of each text go, by comparing the words of all runs of chunks."""
    runs = {}
    for k, t in rows:
        c = substring.Chunks([t.encode()])
        parts = [t.encode()[a:z].decode().split() for a, z in zip(c.start.tolist(), c.end.tolist())]
        a, z, *_ = c.runs(least)
        runs[k, t] = [(i, j, tuple(map(tuple, parts[i : j + 1]))) for i, j in zip(a.tolist(), z.tolist())]
    first = {}
    for (k, t), rs in runs.items():
        for *_, w in rs:
            first[w] = min(first.get(w, (k, t)), (k, t))
    return {kt: sum(1 for *_, w in rs if first[w] != kt) for kt, rs in runs.items()}


def test_text_ids_collisions_and_hot_runs(spark, monkeypatch):
    rng = random.Random(21)
    shared = words(rng, 40)
    rows = [(f"id{i:03d}", f"{words(rng, 30)} {shared} {words(rng, 30)}") for i in range(30)] + [("id500", words(rng, 100)), ("id001", words(rng, 50))]
    docs = spark.createDataFrame([*rows, (None, rows[2][1])], "doc_id string, text string").repartition(3)
    want = plain_runs(rows)
    assert substring.known_runs.__defaults__ == (substring.HOT_ROWS,)

    def known(hot, base=None):
        keyed = docs.where("doc_id is not null").selectExpr("doc_id key", "xxhash64(text) th", "text")
        found = substring.known_runs(substring.run_rows(keyed, "key", "th", substring.LEAST_WORDS), hot)
        texts = {r["th"]: r["text"] for r in keyed.collect()}
        return {(r["key"], texts[r["th"]]): len(r["held"]) for r in found.collect()}

    assert known(100_000) == known(5) == {k: n for k, n in want.items() if n}
    out, names = substring.deduplicated(docs)
    got = {(r["doc_id"], r["text"]): r[names[1]] for r in out.collect()}
    assert sum(shared in t for _, t in got) == 1 and (None, "") in {(k, t.strip()) for k, t in got}


def test_forced_collisions_of_one_half(spark, monkeypatch):
    """Runs whose first 64 bits agree are still told apart by the others."""
    rng = random.Random(22)
    docs = spark.createDataFrame([(i, words(rng, 60)) for i in range(10)], "doc_id long, text string")
    keyed = docs.selectExpr("doc_id key", "xxhash64(text) th", "text")
    rows = substring.run_rows(keyed, "key", "th", 12).selectExpr("key", "th", "7L digest", "check")
    assert substring.known_runs(rows).count() == 0
    assert substring.known_runs(rows.selectExpr("key", "th", "digest", "8L check")).count() == 9


def test_rows_of_one_id_with_different_texts(spark):
    rng = random.Random(23)
    shared = words(rng, 40)
    docs = spark.createDataFrame([(1, f"{words(rng, 20)} {shared}"), (1, f"{shared} {words(rng, 20)}"), (1, words(rng, 30))], "doc_id long, text string")
    out, names = substring.deduplicated(docs)
    assert sorted(r[names[1]] > 0 for r in out.collect()) == [False, False, True]
