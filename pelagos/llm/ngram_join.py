"""Jaccard self-join of documents on word n-grams through token-combination prefixes."""

from __future__ import annotations

from functools import cache
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .bytesvec import Words, binary_column, in_blocks, mix
from .components import connected_components
from .lookup import pair_key
from .storage import discard, small, stored, table

SHINGLE, PERCENT = 4, 85
#: Cells in which all shingles of all texts are counted, by hash; a task holds 4 bytes for each.
CELLS = 1 << 20
#: A shingle is frequent from so many texts on, or from so many times the mean of the cells; very frequent from so many times more.
FREQUENT, OVER_MEAN, VERY = 64, 4, 16
#: Combined tokens of a set are dealt into groups of about so many.
GROUP = 4
#: Combinations of a group that is filled as usual, at most; else shorter combinations are taken.
CHOICES = 500
#: Bits of a set's parity sketch.
PARITY = 512
#: Bits of the sketch by which pairs of larger sets are told apart before the sets are sent.
WIDE = 8192
#: Nodes of a block that are paired off at once; hubs that the members of larger ones meet in a round.
BLOCK_LIMIT, HUBS = 16, 4
#: Pairs for each member of a block that are paired off, and how often combinations grow before what is left is.
PAIRS_EACH, LEVELS = 1000, 2
TEXT_BYTES = 1 << 20
#: Sets of one bucket, in bytes, and the least number of buckets: two of them meet in one task.
BUCKET_BYTES, LEAST_BUCKETS = 16_000_000, 8
_ALL = (1 << 64) - 1


def sets_of(texts: list[bytes], shingle: int) -> list[np.ndarray]:
    """The distinct shingles of each text as sorted 64-bit hashes; a shorter text is one shingle, one without words has none."""
    out = []
    for a, b in in_blocks(texts, TEXT_BYTES):
        words = Words(texts[a:b])
        ends = np.cumsum(words.count)
        h = words.hash
        full = pair_key(*(h[i : len(h) - shingle + 1 + i] for i in range(shingle))) if len(h) >= shingle else h[:0]
        for start, stop in zip((ends - words.count).tolist(), ends.tolist(), strict=True):
            n = stop - start
            if n >= shingle:
                out.append(np.unique(full[start : stop - shingle + 1]))
            elif n:
                out.append(pair_key(mix(np.array([n], dtype=np.uint64)), *(h[start + i : start + i + 1] for i in range(n))))
            else:
                out.append(h[:0])
    return out


def _parity(held: np.ndarray, bits: int) -> np.ndarray:
    """Packed parities of how many hashes lie in each of ``bits`` parts."""
    return np.packbits(np.bincount((held & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1)


class Scheme:
    """Which tokens or combinations of tokens a set is indexed under.

    Tokens stand in one order, rare ones first, in classes by frequency: 0 rare, 1 frequent, 2 very frequent. A
    class is met by combinations of k of its tokens, k from 1 on, each with its own. For this the tokens of a class
    are dealt into groups by hash. A prefix in which a group has p tokens loses all of the group's combinations
    only where p - k + 1 of its tokens are missing on the other side. So a prefix is extended until these numbers
    add up to more than the tokens that two alike sets may lack, and two alike sets share a combination: the one
    whose prefix ends first lacks too few of it, and the other's prefix holds what they share of it. A set meets
    shorter or equal ones by their index prefix (as many tokens as a partner of its size may lack) and longer ones
    by its own longer prefix. How tokens are dealt depends on the band of the shorter set's size.
    """

    def __init__(self, percent: int, level: int = 0):
        self.percent, self.edges, self.level = percent, [1], level

    def band(self, n: int) -> int:
        """Partners are in the same band or the next: a band ends before its first size over the similarity."""
        while self.edges[-1] <= n:
            self.edges.append(100 * self.edges[-1] // self.percent + 1)
        return int(np.searchsorted(self.edges, n, side="right")) - 1

    def lacking(self, n: int) -> tuple[int, int]:
        """How many of n tokens a partner of no smaller size may lack, and how many any partner may."""
        return n - -(-2 * self.percent * n // (100 + self.percent)), n - -(-self.percent * n // 100)

    @cache  # noqa: B019
    def dealt(self, band: int) -> tuple[int, tuple[int, int, int]]:
        """Groups of a class, and k of each class: the larger k, the more tokens a prefix needs, and the smallest set of the band must have them."""
        size = self.edges[band]
        room = -(-self.percent * size // 100) - 1
        for k in range(self.level, -3, -1):
            ks = max(1, k + 1), max(1, k + 2), max(1, k + 3)
            lost, lack = sum(ks) - 3, self.lacking(size)[1]
            groups = min(max(1, lack // GROUP), room // lost) if lost else 1
            if groups and (not lost or comb(lack // groups + ks[2], ks[2]) <= CHOICES):
                return groups, ks
        raise AssertionError("single tokens always do")

    def keys(self, tokens: np.ndarray, classes: np.ndarray) -> tuple[np.ndarray, ...]:
        """``tokens``: hashes in order. Keys; the token's place for rare single tokens, else 0; if in the index prefix; if it may be crowded."""
        n, out = len(tokens), []
        own = self.band(n)
        index_lack, probe_lack = self.lacking(n)
        single, single_index = 0, 0
        plain = np.zeros(0, bool)
        for band in range(max(0, own - 1), own + 1):
            groups, ks = self.dealt(band)
            most = min(n, probe_lack + 1 + groups * (sum(ks) - 3))
            head, cls = tokens[:most], classes[:most]
            k = np.array(ks)[cls]
            group = cls * groups + (head % np.uint64(groups)).astype(np.int64)
            order = np.argsort(group, kind="stable")
            ranked = group[order]
            rank = np.empty(most, np.int64)
            rank[order] = np.arange(most) - np.searchsorted(ranked, ranked)
            gain = np.cumsum(rank >= k - 1)
            cut = int(np.searchsorted(gain, probe_lack + 1)) + 1
            index_cut = int(np.searchsorted(gain, index_lack + 1)) + 1 if band == own else 0
            ones = np.flatnonzero(k[:cut] == 1)
            if len(ones) > single:
                single, plain = len(ones), ones
            single_index = max(single_index, int(np.searchsorted(ones, index_cut)))
            for g in np.unique(group[:cut][k[:cut] > 1]).tolist():
                at = np.flatnonzero(group[:cut] == g)
                size = ks[g // groups]
                if len(at) < size:
                    continue
                chosen = at[_choices(len(at), size)]
                seed = mix(np.array([(band << 20) + (size << 8) + g // groups], dtype=np.uint64))
                key = pair_key(np.repeat(seed, len(chosen)), *(head[chosen[:, i]] for i in range(size)))
                out.append((key, np.zeros(len(key), np.int32), chosen[:, -1] < index_cut, np.ones(len(key), bool)))
        rare = classes[plain] == 0
        out.append((mix(tokens[plain]), np.where(rare, plain, 0).astype(np.int32), np.arange(len(plain)) < single_index, ~rare))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))


@cache
def _choices(n: int, k: int) -> np.ndarray:
    return np.array(list(combinations(range(n), k)), dtype=np.int64)


def _signed(x) -> pa.Array:
    return pa.array(np.asarray(x, dtype=np.uint64).view(np.int64))


def _rows(docs: DataFrame, shingle: int) -> DataFrame:
    """``doc_id``, ``_th``, and of the text's set ``node`` and ``check`` (halves of its digest), ``n`` (its size), ``bits`` (parities of its hashes).

    Each task adds rows with ``part`` and ``cells``: in how many of its texts there are shingles of each cell.
    """
    plain = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("t"))
    parts = 64

    def run(batches):
        cells, kind = np.zeros(CELLS, np.uint32), None
        for b in batches:
            kind = b.column(0).type
            sets = sets_of(binary_column(b, "t"), shingle)
            digests = [xxhash.xxh3_128_intdigest(s.tobytes()) for s in sets]
            bits = [_parity(s, PARITY).view(np.int64) for s in sets]
            flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
            cells += np.bincount((flat >> np.uint64(44)).astype(np.int64), minlength=CELLS).astype(np.uint32)
            nothing = pa.nulls(b.num_rows)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0), b.column(1), _signed([d & _ALL for d in digests]), _signed([d >> 64 for d in digests]), pa.array([len(s) for s in sets], pa.int32()),
                    pa.array(bits, pa.list_(pa.int64())), nothing.cast(pa.int32()), nothing.cast(pa.binary()),
                ],
                names=names,
            )
        if kind is not None:
            none = pa.nulls(parts)
            held = [x.tobytes() for x in cells.reshape(parts, -1)]
            yield pa.RecordBatch.from_arrays(
                [none.cast(kind), *(none.cast(pa.int64()) for _ in range(3)), none.cast(pa.int32()), none.cast(pa.list_(pa.int64())), pa.array(range(parts), pa.int32()), pa.array(held)], names=names
            )

    names = ["doc_id", "_th", "node", "check", "n", "bits", "part", "cells"]
    kind = docs.schema["doc_id"].dataType.simpleString()
    return stored(plain.mapInArrow(run, f"doc_id {kind}, _th long, node long, check long, n int, bits array<bigint>, part int, cells binary"), "rows")


def _cells(rows: DataFrame) -> np.ndarray:
    """The tasks' cells added up."""

    def run(batches):
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for part, cells in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(cells, np.uint32).astype(np.int64)
        for part, cells in held.items():
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "cells": pa.array([cells.tobytes()])})

    total = np.zeros(CELLS, np.int64)
    for r in rows.where("part is not null").select("part", "cells").repartition("part").mapInArrow(run, "part int, cells binary").collect():
        cells = np.frombuffer(bytes(r["cells"]), np.int64)
        total[r["part"] * len(cells) : (r["part"] + 1) * len(cells)] = cells
    return total


def _frequent(docs: DataFrame, rows: DataFrame, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all frequent shingles, sorted, and in how many documents each is.

    Cells over the bound tell which shingles to count one by one. As frequent ones are in ``OVER_MEAN`` times as
    many texts as a cell has shingles in the mean, there are at most ``CELLS / OVER_MEAN`` of them.
    """
    cells = _cells(rows)
    least = max(FREQUENT, -(-OVER_MEAN * int(cells.sum()) // CELLS))
    full = cells >= least
    if not full.any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def run(batches):
        for b in batches:
            flat = np.concatenate([*sets_of(binary_column(b, "t"), shingle), np.zeros(0, np.uint64)])
            h, n = np.unique(flat[full[(flat >> np.uint64(44)).astype(np.int64)]], return_counts=True)
            yield pa.RecordBatch.from_arrays([_signed(h), pa.array(n)], names=["h", "n"])

    counts = docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))
    t = counts.where(F.col("n") >= least).toArrow()
    h, n = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy()
    order = np.argsort(h)
    return h[order], n[order]


class Order:
    """The one order of tokens, rare ones first, and their classes."""

    def __init__(self, hashes: np.ndarray, counts: np.ndarray):
        self.hashes, self.counts = hashes, counts
        self.very = VERY * int(counts.min()) if len(counts) else 0

    def __call__(self, held: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if not len(self.hashes):
            return held, np.zeros(len(held), np.int64)
        at = np.minimum(np.searchsorted(self.hashes, held), len(self.hashes) - 1)
        count = np.where(self.hashes[at] == held, self.counts[at], 0)
        order = np.argsort(count, kind="stable")
        count = count[order]
        return held[order], (count > 0).astype(np.int64) + (count >= max(self.very, 1))


def _keyed_batch(nodes: list[int], sets: list[np.ndarray], scheme: Scheme, order: Order) -> pa.RecordBatch:
    found = [scheme.keys(*order(s)) for s in sets]
    sizes = [len(x[0]) for x in found]
    key, place, index, hot = (np.concatenate([*(x[i] for x in found), np.zeros(0, t)]) for i, t in enumerate((np.uint64, np.int32, bool, bool)))
    return pa.RecordBatch.from_arrays(
        [_signed(key), _signed(np.repeat(np.array(nodes, np.uint64), sizes)), pa.array(np.repeat(np.array([len(s) for s in sets], np.int32), sizes)), pa.array(place), pa.array(index), pa.array(hot)],
        names=["key", "node", "n", "p", "index", "hot"],
    )


_KEYED = "key long, node long, n int, p int, index boolean, hot boolean"


def _keyed_texts(docs: DataFrame, shingle: int, scheme: Scheme, order: Order) -> DataFrame:
    """The keys of each text's set; a task gives those of equal sets once."""

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            nodes, sets = [], []
            for s in sets_of(binary_column(b, "t"), shingle):
                node = xxhash.xxh3_128_intdigest(s.tobytes()) & _ALL
                if len(s) and node not in seen:
                    seen.add(node)
                    nodes.append(node)
                    sets.append(s)
            yield _keyed_batch(nodes, sets, scheme, order)

    return docs.select(F.col("text").cast("binary").alias("t")).mapInArrow(run, _KEYED)


def _keyed_sets(sets: DataFrame, scheme: Scheme, order: Order) -> DataFrame:
    def run(batches):
        for b in batches:
            held = [np.frombuffer(x, np.uint64) for x in b.column(1).to_pylist()]
            yield _keyed_batch(b.column(0).to_numpy().view(np.uint64).tolist(), held, scheme, order)

    return sets.select("node", "hashes").mapInArrow(run, _KEYED)


def _blocks(keyed: DataFrame) -> DataFrame:
    """``key``, ``node``, ``n``, ``p``, ``index`` and the block's number of nodes ``m``, of keys where two nodes can meet.

    Keys of rare tokens have a bounded number of nodes and are read in one go; those that may be crowded are counted first.
    Size, place and prefix travel as one number.
    """
    told = F.shiftleft(F.col("n").cast("long"), 32).bitwiseOR(F.shiftleft(F.col("p").cast("long"), 1)).bitwiseOR(F.col("index").cast("long"))
    index = F.col("told").bitwiseAND(1) == 1
    of_key = Window.partitionBy("key")
    rare = keyed.where("not hot").select("key", "node", told.alias("told")).repartition("key")
    rare = rare.withColumns({"lo": F.min("node").over(of_key), "hi": F.max("node").over(of_key), "any": F.max(index).over(of_key)}).where("lo < hi and any").select("key", "node", "told").distinct()
    rare = rare.withColumn("m", F.count("*").over(of_key))
    hot = keyed.where("hot").select("key", "node", told.alias("told")).distinct()
    sizes = hot.groupBy("key").agg(F.count("*").alias("m"), F.max(index).alias("any")).where("m > 1 and any").select("key", "m")
    both = rare.unionByName(hot.join(sizes, "key"))
    n, p = F.shiftright("told", 32).cast("int"), F.shiftright("told", 1).bitwiseAND((1 << 31) - 1).cast("int")
    return stored(both.select("key", "node", n.alias("n"), p.alias("p"), index.alias("index"), "m"), "blocks")


def _alike(a: Column, b: Column, percent: int) -> Column:
    """Of set sizes: whether their similarity can reach the bound."""
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _parities(x: Column, y: Column, n: Column, m: Column, percent: int) -> Column:
    """Whether sets can be alike by their parities: each that differs stands for a shingle that is not shared."""
    apart = sum((F.bit_count(x[i].bitwiseXOR(y[i])) for i in range(PARITY // 64)), F.lit(0))
    return apart * (100 + percent) <= (n + m) * (100 - percent)


def _pairs_of(blocks: DataFrame, percent: int, *, apart: bool = False) -> DataFrame:
    """Pairs ``a`` < ``b`` of a block: a node in the index prefix with a longer one or one as long.

    ``apart``: of different components only, one not of the major one, each where its first common key is.
    """
    l, r = (lambda c: F.col(f"l.{c}")), (lambda c: F.col(f"r.{c}"))
    on = (l("key") == r("key")) & l("index") & (l("n") <= r("n")) & (l("node") != r("node")) & _alike(l("n"), r("n"), percent)
    if apart:
        on = on & (l("root") != r("root")) & (l("other") | r("other")) & _parities(l("bits"), r("bits"), l("n"), r("n"), percent)
        on = on & (l("key") == F.array_min(F.array_intersect(l("index_keys"), r("keys"))))
    else:
        on = on & (F.least(l("n") - l("p"), r("n") - r("p")) * (100 + percent) >= (l("n") + r("n")) * percent)
    pairs = blocks.alias("l").join(blocks.alias("r"), on)
    return pairs.select(F.least(l("node"), r("node")).alias("a"), F.greatest(l("node"), r("node")).alias("b")).distinct()


def _to_hubs(members: DataFrame, hubs: DataFrame, percent: int, seed: int) -> DataFrame:
    """Pairs of the members of each block with a few of ``hubs``, of the same block, picked by hash."""
    picked = [F.min(F.struct(F.xxhash64("node", F.lit(seed + i)).alias("h"), "node", "n")).alias(f"hub{i}") for i in range(HUBS)]
    found = hubs.groupBy("key").agg(*picked).select("key", F.explode(F.array(*(F.col(f"hub{i}") for i in range(HUBS)))).alias("hub"))
    near = members.join(found, "key").where(F.col("node") != F.col("hub.node")).where(_alike(F.col("n"), F.col("hub.n"), percent))
    return near.select(F.least("node", "hub.node").alias("a"), F.greatest("node", "hub.node").alias("b")).distinct()


class Sets:
    """The sets of nodes that have been candidates, each read once from its first text."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, shingle: int, percent: int):
        self.docs, self.nodes, self.shingle, self.percent, self.held = docs, nodes, shingle, percent, None

    def read(self, wanted: DataFrame) -> DataFrame:
        """``node``, ``hashes`` (sorted, as bytes) of each node in ``wanted``."""
        nodes = wanted.select("node").distinct()
        missing = nodes if self.held is None else nodes.join(self.held.select("node"), "node", "left_anti")
        rows = stored(missing.join(self.nodes.select("node", F.col("row.doc_id").alias("_first"), F.col("row._th").alias("_text")), "node"), "wanted")
        plain = self.docs.select(F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), F.col("text").cast("binary").alias("t"))
        texts = plain.join(small(rows), (F.col("_t") == F.col("_text")) & F.col("_d").eqNullSafe(F.col("_first"))).select("node", "t")
        shingle = self.shingle

        def run(batches):
            seen: set[int] = set()
            for b in batches:
                names = b.column(0).to_pylist()
                new = [i for i, node in enumerate(names) if node not in seen and not seen.add(node)]
                sets = sets_of([b.column(1)[i].as_py() for i in new], shingle)
                cols = [pa.array([s.tobytes() for s in sets], pa.binary()), pa.array([_parity(s, WIDE).tobytes() for s in sets], pa.binary())]
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(new, pa.int64())), *cols], names=["node", "hashes", "wide"])

        if not rows.isEmpty():
            found = stored(texts.mapInArrow(run, "node long, hashes binary, wide binary"), "sets")
            n, different = found.agg(F.count("node"), F.count_distinct("node")).first()
            if n > different:  # a row of the table that several tasks have read
                found = stored(found.dropDuplicates(["node"]), "sets")
            self.held = found if self.held is None else self.held.union(found)
        return self.held.join(small(stored(nodes, "asked")), "node", "left_semi")

    def possible(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` whose sets do not differ in too many parities."""
        held = self.nodes.select("node", "n", "bits")
        both = pairs.join(held.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("bits").alias("ba")), "a")
        both = both.join(held.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("bits").alias("bb")), "b")
        return stored(both.where(_parities(F.col("ba"), F.col("bb"), F.col("na"), F.col("nb"), self.percent)).select("a", "b"), "pairs")

    def _near(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """``pairs`` without those of sets larger than a short sketch tells apart that a wide one does."""
        sized = self.nodes.select("node", "n")
        both = pairs.join(sized.select(F.col("node").alias("a"), F.col("n").alias("na")), "a").join(sized.select(F.col("node").alias("b"), F.col("n").alias("nb")), "b")
        both = stored(both, "sized")
        large = both.where(F.col("na") + F.col("nb") > PARITY)
        x, y = (sets.select(F.col("node").alias(c), F.col("wide").alias("w" + c)) for c in "ab")
        percent = self.percent

        def run(batches):
            for b in batches:
                u, v = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (4, 5))
                apart = np.bitwise_count(u ^ v).sum(axis=1, dtype=np.int64)
                keep = pa.array(apart * (100 + percent) <= (b.column(2).to_numpy() + b.column(3).to_numpy()) * (100 - percent))
                yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

        told = x.join(small(large), "a").join(y, "b").select("a", "b", "na", "nb", "wa", "wb").mapInArrow(run, "a long, b long")
        return stored(both.where(F.col("na") + F.col("nb") <= PARITY).select("a", "b").union(told), "near")

    def links(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` that have the similarity, decided on whole sets.

        Nodes are dealt into buckets of about ``BUCKET_BYTES`` of sets; pairs of two buckets meet in one group, which gets each of its sets once.
        """
        if pairs.isEmpty():
            return pairs
        sets = self.read(pairs.select(F.col("a").alias("node")).union(pairs.select("b")))
        pairs = self._near(pairs, sets)
        size = sets.select("node").join(self.nodes.select("node", "n"), "node").agg(F.sum("n")).first()[0] or 0
        buckets = max(LEAST_BUCKETS, -(-8 * size // BUCKET_BYTES))
        of = lambda c: F.pmod(F.xxhash64(c), F.lit(buckets))
        dealt = pairs.withColumn("cell", of("a") * buckets + of("b"))
        places = small(stored(dealt.select("cell", F.col("a").alias("node")).union(dealt.select("cell", "b")).distinct(), "places"))
        percent = self.percent

        def decide(some: pa.Table, held: pa.Table) -> pa.Table:
            at = {node: np.frombuffer(x, np.uint64) for node, x in zip(held.column("node").to_pylist(), held.column("hashes").to_pylist(), strict=True)}
            keep = []
            for a, b in zip(some.column("a").to_pylist(), some.column("b").to_pylist(), strict=True):
                x, y = at[a], at[b]
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            return some.select([1, 2]).filter(pa.array(keep, pa.bool_()))

        sent = sets.join(places, "node").select("cell", "node", "hashes")
        met = dealt.select(F.col("cell").alias("met"), "a", "b")
        return stored(met.groupBy("met").cogroup(sent.groupBy("cell")).applyInArrow(decide, "a long, b long"), "links")


def ngram_classes(docs: DataFrame, shingle: int = SHINGLE, percent: int = PERCENT, block_limit: int = BLOCK_LIMIT, pairs_each: int = PAIRS_EACH) -> DataFrame:
    """``doc_id``, ``_th`` (hash of the text), ``n_shingles``, ``component_id`` per row of ``docs``.

    Two texts link where 100 times the shingles they share are at least ``percent`` times those that either has;
    a component is what links reach, named by its smallest doc_id. Equal sets are one node. Nodes meet through
    token-combination prefixes (see ``Scheme``): single tokens where they are rare, combinations of two or three
    where they are frequent, as counted over all texts. Candidates pass by sizes, places and parities, and are
    decided on their whole sets.

    A block of more than ``block_limit`` nodes is not paired off, as it is a family of copies as a rule: its members
    meet a few hubs first. Members of one component need not meet any more. What is left apart in crowded blocks
    meets further hubs while that settles half of it, then is indexed anew under combinations of one token more,
    which part what has only the shorter ones in common. It is paired off where that is at most ``pairs_each``
    pairs a member, or the combinations have grown ``LEVELS`` times. No pair of different components is left out.

    Null and empty texts and texts without words have no shingles and a component of their own. Repeated rows share
    one; a row without doc_id links like any other but names no component, unless none of its component has an id.
    """
    rows = _rows(docs, shingle)
    texts = rows.where("part is null").drop("part", "cells")
    whose = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")
    nodes = stored(
        texts.where("n > 0").groupBy("node").agg(F.min(whose).alias("row"), F.min("doc_id").alias("first"), F.min("check").alias("check"), F.first("n").alias("n"), F.first("bits").alias("bits")), "nodes"
    )
    order = Order(*_frequent(docs, rows, shingle))
    held = Sets(docs, nodes, shingle, percent)
    keyed = stored(_keyed_texts(docs, shingle, Scheme(percent), order), "keyed")
    links = roots = None
    for level in range(LEVELS + 1):
        blocks = _blocks(keyed)
        discard(keyed)
        crowded = blocks.where(F.col("m") > block_limit)
        first = _pairs_of(blocks.where(F.col("m") <= block_limit), percent).union(_to_hubs(crowded, crowded, percent, 0)).distinct()
        pairs = held.possible(first)
        found = held.links(pairs)
        links = found if links is None else links.union(found)
        members, before, seed = crowded.count(), None, 0
        while True:
            roots = stored(connected_components(links), "roots")
            if not members:
                work = 0
                break
            at = crowded.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").drop("_n")
            at = at.withColumn("root", F.coalesce("root", "node"))
            major = at.groupBy("key", "root").agg(F.count("*").alias("c")).groupBy("key").agg(F.max(F.struct("c", "root")).alias("major"), F.count("*").alias("roots"))
            at = stored(at.join(major.where("roots > 1"), "key").withColumn("other", F.col("root") != F.col("major.root")).drop("major", "roots"), "apart")
            work = at.where("other").agg(F.sum("m")).first()[0] or 0
            if not work or work <= pairs_each * members or (before is not None and 2 * work > before):
                break
            before, seed = work, seed + HUBS
            more = held.possible(_to_hubs(at, at.where("other"), percent, seed))
            links = stored(links.union(held.links(more)), "links")
        if not work:
            break
        if work <= pairs_each * members or level == LEVELS:
            of_node = at.groupBy("node").agg(F.collect_set("key").alias("keys"), F.collect_set(F.when(F.col("index"), F.col("key"))).alias("index_keys"))
            at = stored(at.join(of_node, "node").join(nodes.select("node", "bits"), "node"), "apart")
            more = stored(_pairs_of(at, percent, apart=True), "pairs")
            roots = stored(connected_components(stored(links.union(held.links(more)), "links")), "roots")
            break
        keyed = stored(_keyed_sets(held.read(at), Scheme(percent, level + 1), order), "keyed")
    rooted = nodes.join(roots.withColumnRenamed("node", "_n"), F.col("node") == F.col("_n"), "left").select("node", "check", "first", F.coalesce("root", "node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("node", F.col("check").alias("_check"), "component_id")
    own = F.when((F.col("n") > 0) & (F.col("check") == F.col("_check")), F.col("component_id")).otherwise(F.col("doc_id"))
    joined = texts.select("doc_id", "_th", "node", "check", "n").join(named, "node", "left")
    return joined.select("doc_id", "_th", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"))


def op12_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of four-word shingles and its component at a Jaccard similarity of 0.85 or more."""
    return ngram_classes(table(spark, sf_dir, "documents")).drop("_th")
