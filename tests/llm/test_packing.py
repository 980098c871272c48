import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from pelagos.llm import packing


def check(rows, sequence):
    used = defaultdict(list)
    for r in rows:
        used[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in used.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= sequence
    return len(used)


def test_documents(spark):
    rng = np.random.default_rng(1)
    texts = [None, "", "a", "<|endoftext|> x", "naïve ½ 日本 \n\n tab\t", "word " * 3000] + ["tok " * int(n) for n in rng.integers(1, 900, 60)]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)] + [(3, "a", 1), (3, "a", 1), (None, "b", 1)], "doc_id long, text string, piece int")
    rows = packing.pack(docs.repartition(3)).collect()
    whole = Tokenizer.from_file(packing.default_tokenizer())
    got = defaultdict(list)
    for r in rows:
        got[r["doc_id"]].append(r)
    for i, t in enumerate(texts):
        if i == 3:
            continue
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 2], dtype="<u4")
        at = 0
        for k, r in enumerate(sorted(got[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at)
            assert r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            assert r["length"] == 1024 or k == 0
            at += r["length"]
        assert at == len(ids)
    n = check(rows, 1024)
    assert len(got[3]) == 3 and len(got[None]) == 1
    assert n <= packing.least_sequences(np.bincount([r["length"] for r in rows], minlength=1025)) + 1


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).collect() == []


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 60), min_size=1, max_size=80), st.integers(0, 5))
def test_solutions_hold_every_piece_once(lengths, seed):
    counts = np.bincount(lengths, minlength=61).astype(np.int64)
    best = packing.evolve(counts, [], seed, 60)
    held = Counter()
    for p, n in best.items():
        assert sum(p) <= 60
        for k in p:
            held[k] += n
    assert held == Counter(lengths)
    assert packing.sequences(best) >= packing.least_sequences(counts, 60)


@pytest.mark.parametrize("seed", range(3))
def test_crossover_improves_on_plain_best_fit(seed):
    counts = np.bincount(np.random.default_rng(seed).integers(200, 700, 400), minlength=1025).astype(np.int64)
    best = packing.evolve(counts, [], seed)
    assert packing.quality(best) <= packing.quality(packing.fill(counts))


def test_ids_are_those_of_the_tokenizer_file():
    """All texts of a table, both tokenizers."""
    import pyarrow.parquet as pq

    texts = pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()
    mine = packing.ByteTokenizer(packing.default_tokenizer())
    whole = Tokenizer.from_file(packing.default_tokenizer()).encode_batch([t or "" for t in texts], add_special_tokens=False)
    assert all(mine.ids(t or "") == e.ids for t, e in zip(texts, whole, strict=True))


def best_of_all(lengths, size):
    """The fewest sequences, by trying all."""
    best = len(lengths)

    def place(i, gaps):
        nonlocal best
        if len(gaps) >= best:
            return
        if i == len(lengths):
            best = len(gaps)
            return
        for k in {g: k for k, g in enumerate(gaps) if g >= lengths[i]}.values():
            place(i + 1, [g - lengths[i] * (j == k) for j, g in enumerate(gaps)])
        place(i + 1, [*gaps, size - lengths[i]])

    place(0, [])
    return best


def test_small_packings_are_the_best_there_are():
    rng = np.random.default_rng(4)
    worse = 0
    for _ in range(30):
        lengths = sorted(rng.integers(1, 20, 9).tolist(), reverse=True)
        counts = np.bincount(lengths, minlength=21)
        worse += packing.sequences(packing.evolve(counts, [], 1, 20)) - best_of_all(lengths, 20)
    assert worse == 0
