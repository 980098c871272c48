"""Packing of tokenised documents into sequences by a grouping genetic algorithm."""

from __future__ import annotations

import json
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import stored, table

SEQUENCE = 1024
SEPARATOR = 2
ISLANDS, POPULATION, GENERATIONS, MIGRATIONS = 6, 6, 8, 3

#: A solution: how often each pattern is used; a pattern is the lengths in one sequence, the longest first.
Solution = dict[tuple[int, ...], int]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class ByteTokenizer:
    """Token ids under a byte-level BPE file of ``tokenizers``, through the faster merge loop of ``tiktoken``.

    Both apply the same merges to the same parts of a text. A text that spells one of the file's special tokens
    goes through ``tokenizers`` itself.
    """

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer, pre_tokenizers

        self._whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self._special = [t["content"] for t in spec.get("added_tokens", [])]
        # the printable stand-ins of bytes: those that are printable stand for themselves, the others follow from 256 on
        plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in plain}
        byte_of |= {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in byte_of.values())}
        assert set(byte_of) == set(pre_tokenizers.ByteLevel.alphabet())
        ranks = {bytes(byte_of[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self._special}
        self._parts = tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if any(s in text for s in self._special):
            return self._whole.encode(text, add_special_tokens=False).ids
        return self._parts.encode_ordinary(text)


_loaded: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    if path not in _loaded:
        _loaded[path] = ByteTokenizer(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, sequence: int = SEQUENCE) -> DataFrame:
    """``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32`` of every piece, with ``part`` and ``nth``: its place among those of its length that one task made."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("_t"))

    def run(batches):
        tok, part, seen = tokenizer(path), TaskContext.get().partitionId(), Counter()
        for b in batches:
            rows, known = [], {}
            for row, text in enumerate(b.column(1).to_pylist()):
                if text not in known:
                    ids = np.array([*tok.ids(text), SEPARATOR], dtype="<u4")
                    first = (len(ids) - 1) % sequence + 1
                    cuts = [0, *range(first, len(ids) + 1, sequence)]
                    known[text] = [(a, z - a, zlib.crc32(ids[a:z].tobytes())) for a, z in zip(cuts, cuts[1:], strict=False)]
                for k, (start, length, crc) in enumerate(known[text]):
                    rows.append((row, k, start, length, crc, part, seen[length]))
                    seen[length] += 1
            cols = list(zip(*rows, strict=True)) or [()] * 7
            yield pa.RecordBatch.from_arrays(
                [b.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "nth"],
            )

    schema = plain.select("doc_id").schema.add("piece", "integer")
    for n in ("start", "length", "ids_crc32", "part", "nth"):
        schema = schema.add(n, "long")
    return plain.mapInArrow(run, schema)


def fill(need: np.ndarray, rng: np.random.Generator | None = None, size: int = SEQUENCE) -> Solution:
    """Sequences for ``need`` (how many pieces of each length): each starts with the longest piece left and takes the best fit.

    The last gap is closed by one piece or two that fit exactly, where there are such. A pattern is used as often
    as pieces last, so the steps follow the number of lengths, not of pieces. ``rng`` now and then takes the second-best.
    """
    need = need.copy()
    out: Solution = {}
    while True:
        have = np.flatnonzero(need)
        if not len(have):
            return out
        left = need.copy()
        pattern = [int(have[-1])]
        left[pattern[0]] -= 1
        space = size - pattern[0]
        while space:
            fits = np.flatnonzero(left[: space + 1])
            if not len(fits):
                break
            take = int(fits[-1])
            if take < space:
                # two pieces that close the gap: lengths a and space - a, both left
                low = fits[fits <= space // 2]
                pair = low[(left[space - low] > (low * 2 == space))]
                if len(pair):
                    take = space - int(pair[-1])
                elif rng is not None and len(fits) > 1 and rng.random() < 0.3:
                    take = int(fits[-2])
            pattern.append(take)
            left[take] -= 1
            space -= take
        used = Counter(pattern)
        times = min(int(need[k]) // c for k, c in used.items())
        for k, c in used.items():
            need[k] -= c * times
        key = tuple(sorted(pattern, reverse=True))
        out[key] = out.get(key, 0) + times


def sequences(solution: Solution) -> int:
    return sum(solution.values())


def quality(solution: Solution, size: int = SEQUENCE) -> tuple[int, float]:
    """Fewer sequences are better, then fuller ones beside emptier ones."""
    return sequences(solution), -sum((sum(p) / size) ** 2 * n for p, n in solution.items())


def _complete(kept: Solution, need: np.ndarray, rng: np.random.Generator, size: int) -> Solution:
    """``kept`` with the displaced pieces ``need``: best fit into the gaps of its sequences, then new sequences."""
    out: Solution = {}
    for p, n in sorted(kept.items(), key=lambda x: sum(x[0])):
        gap = size - sum(p)
        while n and gap:
            fits = np.flatnonzero(need[: gap + 1])
            if not len(fits):
                break
            take = int(fits[-1])
            times = min(n, int(need[take]))
            need[take] -= times
            q = tuple(sorted((*p, take), reverse=True))
            out[q] = out.get(q, 0) + times
            n -= times
        if n:
            out[p] = out.get(p, 0) + n
    for p, n in fill(need, rng, size).items():
        out[p] = out.get(p, 0) + n
    return out


def _take(pool: list[tuple[tuple[int, ...], int]], need: np.ndarray, kept: Solution) -> None:
    for p, n in pool:
        used = Counter(p)
        times = min(n, *(int(need[k]) // c for k, c in used.items()))
        if times:
            for k, c in used.items():
                need[k] -= c * times
            kept[p] = kept.get(p, 0) + times


def crossover(a: Solution, b: Solution, counts: np.ndarray, rng: np.random.Generator, size: int = SEQUENCE) -> Solution:
    """Injects whole well-filled sequences of ``b`` into ``a``; those of ``a`` that hold the same pieces go, and what they displace is best-fitted."""
    need, kept = counts.copy(), {}
    best = sorted(b.items(), key=lambda x: (-sum(x[0]), rng.random()))
    best = [x for x in best if sum(x[0]) >= 0.98 * size] or best[:1]
    _take([x for x in best if rng.random() < 0.5], need, kept)
    _take(sorted(a.items(), key=lambda x: (-sum(x[0]), rng.random())), need, kept)
    return _complete(kept, need, rng, size)


def mutation(a: Solution, counts: np.ndarray, rng: np.random.Generator, size: int = SEQUENCE) -> Solution:
    """Dissolves the emptiest sequences and a few others."""
    need, kept = counts.copy(), {}
    by = sorted(a.items(), key=lambda x: -sum(x[0]))
    full = [x for x in by if sum(x[0]) == size or rng.random() < 0.3]
    _take([x for x in full if rng.random() < 0.85], need, kept)
    return _complete(kept, need, rng, size)


def least_sequences(counts: np.ndarray, size: int = SEQUENCE) -> int:
    """No packing has fewer: all ids together, and each piece of over half a sequence in one of its own."""
    total = int((counts * np.arange(len(counts))).sum())
    return max(math.ceil(total / size), int(counts[size // 2 + 1 :].sum()))


def evolve(counts: np.ndarray, elites: list[Solution], seed: int, size: int = SEQUENCE) -> Solution:
    """One island's generations; its first generation holds what migrated to it."""
    rng = np.random.default_rng(seed)
    people = [*elites, *(fill(counts, rng if i else None, size) for i in range(max(1, POPULATION - len(elites))))]
    goal = least_sequences(counts, size)
    for _ in range(GENERATIONS):
        people.sort(key=lambda s: quality(s, size))
        if sequences(people[0]) <= goal:
            break
        parents = people[: max(2, POPULATION // 2)]
        people = parents[:2]
        while len(people) < POPULATION:
            a, b = rng.choice(len(parents), 2)
            people.append(crossover(parents[a], parents[b], counts, rng, size))
            people.append(mutation(parents[a], counts, rng, size))
    return min(people, key=lambda s: quality(s, size))


def solve(spark: SparkSession, counts: np.ndarray, size: int = SEQUENCE) -> Solution:
    """The best solution of several islands, which are tasks; elites move to the next island after each round.

    All that moves is counts by length and solutions by pattern: their size follows the lengths, not the documents.
    """
    if not counts.any():
        return {}
    elites: list[Solution] = []
    goal = least_sequences(counts, size)
    for round_ in range(MIGRATIONS):
        held = spark.sparkContext.broadcast((counts, elites))

        def run(batches, held=held, round_=round_):
            for b in batches:
                for i in b.column(0).to_pylist():
                    counts, elites = held.value
                    guests = [elites[i], elites[i - 1]] if elites else []
                    best = evolve(counts, guests, 1000 * round_ + i, size)
                    text = json.dumps([[list(p), n] for p, n in best.items()])
                    yield pa.RecordBatch.from_arrays([pa.array([i], pa.int64()), pa.array([text])], names=["island", "solution"])

        found = spark.range(0, ISLANDS, 1, ISLANDS).mapInArrow(run, "island long, solution string").collect()
        elites = [{tuple(p): n for p, n in json.loads(r["solution"])} for r in sorted(found)]
        best = min(elites, key=lambda s: quality(s, size))
        if sequences(best) <= goal:
            break
    return best


def _places(solution: Solution) -> tuple[np.ndarray, ...]:
    """For the pieces of each length in order: from which on they go to which sequences, how many to each, and where in them."""
    done: Counter = Counter()
    rows, base = [], 0
    for p, n in sorted(solution.items()):
        offset = 0
        for length, c in sorted(Counter(p).items(), reverse=True):
            rows.append(((length << 44) + done[length], base, c, offset, length))
            done[length] += c * n
            offset += c * length
        base += n
    rows.sort()
    return tuple(np.array(c, dtype=np.int64) for c in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 5


def pack(docs: DataFrame, path: str | None = None, sequence: int = SEQUENCE) -> DataFrame:
    """Per piece: ``doc_id``, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    A document is its ids and the separator; one of more than ``sequence`` ids is cut into pieces of that length,
    the first maybe shorter. Null and empty texts are one separator; repeated rows each have their pieces; an
    empty table packs into none.
    """
    spark = docs.sparkSession
    made = stored(pieces(docs, path or default_tokenizer(), sequence), "pieces")
    sizes = stored(made.groupBy("length", "part").agg(F.count("*").alias("n")), "piece-counts")
    counts = np.zeros(sequence + 1, dtype=np.int64)
    for r in sizes.groupBy("length").agg(F.sum("n").alias("n")).collect():  # a row for each length
        counts[r["length"]] = r["n"]
    held = spark.sparkContext.broadcast(_places(solve(spark, counts, sequence)))
    before = sizes.selectExpr(
        "length", "part", "coalesce(sum(n) over (partition by length order by part rows between unbounded preceding and 1 preceding), 0) before"
    )
    ranked = made.join(before, ["length", "part"]).withColumn("_rank", F.col("before") + F.col("nth")).drop("before", "part", "nth")
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "_rank"]
    ranked = ranked.select(*names)

    def run(batches):
        at, base, each, offset, _ = held.value
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(5).to_numpy()
            key = (length << 44) + rank
            i = np.searchsorted(at, key, side="right") - 1
            nth = key - at[i]
            got = [pa.array(base[i] + nth // each[i]), pa.array(offset[i] + nth % each[i] * length)]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], *got], names=[*names[:5], "sequence_id", "offset"])

    return ranked.mapInArrow(run, ranked.drop("_rank").schema.add("sequence_id", "long").add("offset", "long"))


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces and the sequences that hold them."""
    return pack(table(spark, sf_dir, "documents"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents in their sequences."""
    return pack(docs)
