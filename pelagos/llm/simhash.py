"""SimHash fingerprints, linked through pigeonring filtering."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesvec import binary_column
from .components import connected_components
from .storage import small, stored, table

BITS = 64
_ALL = (1 << 64) - 1
#: Words of a fingerprint's shingle and the bits in which linked fingerprints differ at most.
SHINGLE, RADIUS = 3, 2
#: The pipeline's stage, beyond fingerprints: words of a shingle, similarity of the shingle sets.
STAGE_SHINGLE, STAGE_SIMILARITY = 5, 0.8
#: One text in so many is sampled for common shingles, those in so many of its texts count as common, and so many are kept.
SAMPLE, SAMPLE_COMMON, MOST_COMMON = 16, 8, 200_000
#: Rounds of hubs end when the members of crowded blocks that are still apart have so many pairs for each member of any block.
HUB_WORK = 100
#: Members of a crowded block first meet so many others, picked by hashes: one each is alike to most of a family.
HUBS = 4
#: A set's hashes are counted in so many parts of their range.
PARTS = 512


def shingle_hashes(text: bytes, shingle: int) -> list[int]:
    """XXH64 (seed 42) of each word shingle in order, repeats included; a shorter text is one shingle, one without words has none."""
    words = text.lower().split()  # bytes.lower changes A-Z only; bytes.split takes space and 9 to 13
    if not words:
        return []
    line = b" ".join(words)
    if len(words) <= shingle:
        return [xxhash.xxh64_intdigest(line, 42)]
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = [0, *(ends[: len(words) - shingle]).tolist()]
    of = xxhash.xxh64_intdigest
    return [of(line[a:b], 42) for a, b in zip(starts, (ends[shingle - 1 :] - 1).tolist(), strict=True)]


def majority(hashes: list[int]) -> int:
    """The bits set in over half of the hashes."""
    counts = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = np.array(hashes[i : i + 65_536], dtype=">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > len(hashes)).tobytes(), "big") if hashes else 0


def fingerprint_of(text: bytes, shingle: int) -> int:
    """Unsigned fingerprint of a text: the majority of every bit over its shingles."""
    return majority(shingle_hashes(text, shingle))


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """Adds ``_fp`` (long) to ``doc_id`` and ``_th``, a hash of the text. A null text counts as empty; its fingerprint is 0."""
    kind = docs.schema["doc_id"].dataType
    plain = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_t"))

    def run(batches):
        for b in batches:
            known: dict[bytes, int] = {}
            out = []
            for t in binary_column(b, "_t"):
                if t not in known:
                    known[t] = fingerprint_of(t, shingle)
                out.append(known[t])
            fp = pa.array(np.array(out, dtype=np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp], names=["doc_id", "_th", "_fp"])

    schema = plain.drop("_t").schema.add("_fp", "long")
    schema["doc_id"].dataType = kind
    return plain.mapInArrow(run, schema)


def _masks(segments: int) -> list[int]:
    edges = [BITS * i // segments for i in range(segments + 1)]
    return [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]


def _signed(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >> 63 else x).cast("long")


def _balls(fp: Column, radius: int) -> Column:
    """Keys that two fingerprints share exactly when they differ in at most ``radius`` (1, 2 or 3) bits.

    One flipped bit each way meets in the middle for 2; leaving one bit out of the key adds one more.
    """
    near = [fp, *(fp.bitwiseXOR(_signed(1 << i)) for i in range(BITS))] if radius >= 2 else [fp]
    if radius % 2 == 0:
        return F.array(*(F.struct(F.lit(-1).alias("hole"), x.alias("key")) for x in near))
    keep = (1 << BITS) - 1
    holes = F.array(*(F.lit(i) for i in range(BITS)))
    masks = F.array(*(_signed(keep ^ (1 << i)) for i in range(BITS)))
    return F.flatten(F.transform(F.array(*near), lambda x: F.transform(
        holes, lambda i: F.struct(i.alias("hole"), x.bitwiseAND(F.element_at(masks, i + 1)).alias("key")))))


def close_pairs(fps: DataFrame, radius: int = RADIUS, segments: int = 5, block_limit: int = 32) -> DataFrame:
    """Links ``a``, ``b`` that connect all fingerprints (column ``fp``, distinct) within ``radius`` bits, and no others.

    Pigeonring: cut into ``segments`` parts on a ring, two fingerprints within the radius have a part from which
    every chain of k consecutive parts differs in at most ``k * radius / segments`` bits. The chain's first parts
    have a budget below one bit, so they are equal and form the key of a block; the longer chains prune the
    block's pairs before the full Hamming check. A block of more than ``block_limit`` fingerprints is never
    paired off: its members are linked through shared keys (see ``_balls``), which finds the same components
    with a number of rows in proportion to the block.
    """
    if not 1 <= radius <= 3:
        raise ValueError("radius is 1, 2 or 3")
    masks = _masks(segments)
    equal = max(1, (segments - 1) // radius)
    keys = []
    for i in range(segments):
        m = 0
        for j in range(equal):
            m |= masks[(i + j) % segments]
        keys.append(F.struct(F.lit(i).alias("ring"), F.col("fp").bitwiseAND(_signed(m)).alias("key")))
    rows = fps.select("fp", F.explode(F.array(*keys)).alias("k")).select("fp", "k.ring", "k.key")
    sizes = rows.groupBy("ring", "key").agg(F.count("*").alias("n")).where("n > 1")
    blocks = stored(rows.join(sizes, ["ring", "key"]), "blocks")
    small = blocks.where(F.col("n") <= block_limit)
    x = F.col("l.fp").bitwiseXOR(F.col("r.fp"))
    diffs = F.array(*(F.bit_count(x.bitwiseAND(_signed(m))) for m in masks))
    paired = (
        small.alias("l")
        .join(small.alias("r"), (F.col("l.ring") == F.col("r.ring")) & (F.col("l.key") == F.col("r.key")) & (F.col("l.fp") < F.col("r.fp")))
        .select(F.col("l.fp").alias("a"), F.col("r.fp").alias("b"), F.col("l.ring").alias("ring"), diffs.alias("d"))
    )
    chain = F.lit(True)
    for length in range(equal + 1, segments + 1):
        total = sum((F.element_at("d", (F.col("ring") + j) % segments + 1) for j in range(length)), F.lit(0))
        chain = chain & (total <= length * radius // segments)
    paired = paired.where(chain).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).select("a", "b")
    crowded = blocks.where(F.col("n") > block_limit).select("fp").distinct()
    shared = crowded.select("fp", F.explode(_balls(F.col("fp"), radius)).alias("k")).select("fp", "k.hole", "k.key")
    hubs = shared.groupBy("hole", "key").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1")
    starred = shared.join(hubs, ["hole", "key"]).select(F.col("fp").alias("a"), F.col("hub").alias("b")).where("a <> b")
    return paired.union(starred).distinct()


def _rooted(nodes: DataFrame, radius: int, segments: int = 5) -> DataFrame:
    """``nodes`` (``_fp``, distinct) with ``root``, the smallest fingerprint reachable over links."""
    links = close_pairs(nodes.select(F.col("_fp").alias("fp")), radius, segments)
    joined = nodes.join(connected_components(links), F.col("_fp") == F.col("node"), "left")
    return joined.withColumn("root", F.coalesce("root", "_fp")).drop("node")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS, segments: int = 5) -> DataFrame:
    """``doc_id``, ``_th``, ``fingerprint``, ``component_id`` (the smallest doc_id reachable over links) per row of ``docs``.

    Fingerprints within ``radius`` bits link; equal ones are one node. Null text counts as empty, empty texts
    (fingerprint 0) link like any other, repeated rows share a component, a null doc_id is never the smallest.
    """
    fps = stored(fingerprints(docs, shingle), "fingerprints")
    nodes = stored(fps.groupBy("_fp").agg(F.min("doc_id").alias("first")), "nodes")
    rooted = _rooted(nodes, radius, segments)
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    named = rooted.join(least, "root").select("_fp", "component_id")
    return fps.join(named, "_fp").select(
        "doc_id", "_th", F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's fingerprint of three-word shingles and its component at two differing bits or fewer."""
    return near_duplicates(table(spark, sf_dir, "documents")).drop("_th")


def _common(docs: DataFrame, shingle: int) -> np.ndarray:
    """Hashes (first row) of shingles that many texts share and in how many texts of a sample (second row), ordered by hash.

    They only order a text's shingles, so that prefixes hold rare ones: any order finds the same pairs.
    """
    th = F.xxhash64("text")
    plain = docs.select(th.alias("_th"), F.col("text").cast("binary").alias("_t")).where(F.pmod("_th", F.lit(SAMPLE)) == 0)

    def run(batches):
        for b in batches:
            sets = [np.unique(np.array(shingle_hashes(t, shingle), dtype=np.uint64)) for t in dict.fromkeys(binary_column(b, "_t"))]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([*sets, np.zeros(0, np.uint64)]).view(np.int64))], names=["h"])

    counts = plain.mapInArrow(run, "h long").groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= SAMPLE_COMMON)
    t = counts.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toArrow()
    h, n = t.column(0).to_numpy().view(np.uint64), t.column(1).to_numpy().astype(np.uint64)
    order = np.argsort(h)
    return np.stack([h[order], n[order]])


def _prefix(held: np.ndarray, common: np.ndarray, similarity: float) -> np.ndarray:
    """So many of a set's hashes, the rarest first, that two sets of the similarity share one of them."""
    if not len(held):
        return np.zeros(1, np.uint64)
    rank = np.zeros(len(held), np.uint64)
    if common.shape[1]:
        at = np.minimum(np.searchsorted(common[0], held), common.shape[1] - 1)
        rank = np.where(common[0][at] == held, common[1][at], np.uint64(0))
    size = len(held) - int(np.ceil(similarity * len(held) - 1e-6)) + 1
    return held[np.lexsort((held, rank))[:size]]


def _sketches(docs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """``doc_id``, ``_th``, ``_fp`` (the fingerprint of the text, as in ``fingerprints``), and of the text's set of shingles ``_node`` and ``_check`` (halves of its digest), ``_n`` (its size) and, null but for the first row of a task that has the set, ``_keys`` (its prefix), ``_parts`` (how many hashes lie in each part of their range, a byte each; null where one has more) and ``_bits`` (in which of 512 parts of another order any lies)."""
    plain = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_t"))
    common = docs.sparkSession.sparkContext.broadcast(_common(docs, shingle))

    def run(batches):
        seen: set[int] = set()
        for b in batches:
            known: dict[bytes, tuple[int, int, int, int]] = {}
            out, keys, parts, bits = [], [], [], []
            for t in binary_column(b, "_t"):
                prefix = part = bit = None
                if t not in known:
                    held = np.unique(np.array(shingle_hashes(t, shingle), dtype=np.uint64))
                    digest = xxhash.xxh3_128_intdigest(held.tobytes())
                    known[t] = digest & _ALL, digest >> 64, len(held), fingerprint_of(t, SHINGLE)
                    if known[t][0] not in seen and len(held):
                        seen.add(known[t][0])
                        prefix = _prefix(held, common.value, similarity).view(np.int64)
                        counts = np.bincount((held >> np.uint64(32)).astype(np.int64) * PARTS >> 32, minlength=PARTS)
                        part = counts.astype(np.uint8).tobytes() if counts.max() < 256 else None
                        bit = np.packbits(np.bincount((held & np.uint64(PARTS - 1)).astype(np.int64), minlength=PARTS) > 0).view(np.int64)
                out.append(known[t])
                keys.append(prefix)
                parts.append(part)
                bits.append(bit)
            node, check, fp = (pa.array(np.array([x[i] for x in out], dtype=np.uint64).view(np.int64)) for i in (0, 1, 3))
            cols = [pa.array([x[2] for x in out], pa.int32()), pa.array(keys, pa.list_(pa.int64())), pa.array(parts, pa.binary()), pa.array(bits, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), fp, node, check, *cols], names=["doc_id", "_th", "_fp", "_node", "_check", "_n", "_keys", "_parts", "_bits"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return plain.mapInArrow(run, f"doc_id {kind}, _th long, _fp long, _node long, _check long, _n int, _keys array<bigint>, _parts binary, _bits array<bigint>")


def _needed(a: Column, b: Column, similarity: float) -> Column:
    """How many members two sets of these sizes share at least if they have the similarity."""
    return F.ceil((a + b) * (similarity / (1 + similarity)) - 1e-6)


def _possible(pairs: DataFrame, parts: DataFrame, similarity: float) -> DataFrame:
    """``pairs`` without those whose sets cannot share enough, by what they have in each part of the range."""
    held = parts.join(stored(pairs.select(F.col("a").alias("_node")).union(pairs.select("b")).distinct(), "met"), "_node")
    held = stored(held.dropDuplicates(["_node"]), "parts")
    both = pairs.join(held.select(F.col("_node").alias("a"), F.col("_parts").alias("pa")), "a").join(held.select(F.col("_node").alias("b"), F.col("_parts").alias("pb")), "b")

    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                if x is None or y is None:
                    keep.append(True)
                    continue
                x, y = np.frombuffer(x, np.uint8), np.frombuffer(y, np.uint8)
                most = int(np.minimum(x, y).sum(dtype=np.int64))
                keep.append(most >= similarity * (int(x.sum(dtype=np.int64)) + int(y.sum(dtype=np.int64)) - most) - 1e-9)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return stored(both.select("a", "b", "pa", "pb").mapInArrow(run, "a long, b long"), "possible")


def _alike(docs: DataFrame, nodes: DataFrame, parts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Of ``pairs`` (``a``, ``b``: nodes) those whose shingle sets have the similarity. A node's text is read from its first row."""
    pairs = _possible(pairs, parts, similarity)
    wanted = pairs.select(F.col("a").alias("_node")).union(pairs.select("b")).distinct().join(nodes, "_node")
    wanted = stored(wanted.select("_node", F.col("row.doc_id").alias("_first"), F.col("row._th").alias("_text_hash")), "wanted")
    keyed = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_t"))
    same = (F.col("_th") == F.col("_text_hash")) & F.col("doc_id").eqNullSafe(F.col("_first"))
    texts = stored(keyed.join(small(wanted), same).select("_node", "_t").dropDuplicates(["_node"]), "texts")
    both = pairs.join(texts.select(F.col("_node").alias("a"), F.col("_t").alias("ta")), "a").join(texts.select(F.col("_node").alias("b"), F.col("_t").alias("tb")), "b")

    def decide(batches):
        for b in batches:
            sets: dict[int, np.ndarray] = {}

            def held(node: int, text: bytes) -> np.ndarray:
                if node not in sets:
                    sets[node] = np.unique(np.array(shingle_hashes(text or b"", shingle), dtype=np.uint64))
                return sets[node]

            keep = []
            for a, c, ta, tb in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                x, y = held(a, ta), held(c, tb)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(shared >= similarity * (len(x) + len(y) - shared) - 1e-9)
            keep = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], names=["a", "b"])

    return stored(both.select("a", "b", "ta", "tb").mapInArrow(decide, "a long, b long"), "links")


def _fingerprint_links(rows: DataFrame, radius: int) -> DataFrame:
    """Links ``a``, ``b`` of the ``_node`` of ``rows`` that connect those whose fingerprints are connected within ``radius`` bits."""
    held = stored(rows.select("_node", "_fp").distinct(), "fingerprints")
    grouped = held.join(_rooted(held.select("_fp").distinct(), radius), "_fp").select("_node", "root")
    first = grouped.groupBy("root").agg(F.min("_node").alias("b"))
    return grouped.join(first, "root").where("_node <> b").select(F.col("_node").alias("a"), "b").distinct()


def similar_texts(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = STAGE_SIMILARITY, block_limit: int = 16, radius: int = 0) -> DataFrame:
    """``doc_id``, ``_th``, ``component_id`` per row: texts whose shingle sets have a Jaccard similarity of ``similarity`` link.

    With a ``radius`` texts also link where their fingerprints (``fingerprints``) differ in so many bits at most,
    through the ring's segments as in ``near_duplicates``; what those join need not meet again in crowded blocks.

    Texts alike as sets differ in ten of 64 bits on average, which no short list of fingerprint segments can promise to
    find. So pairs meet through prefixes: of a set x in one order of all shingles, rare ones first, the first
    |x| - ceil(0.8 |x|) + 1, of which two sets that are alike share one. A pair is left out where what follows the
    key that it shares cannot be enough, which loses none: at the first key shared it is. The others are decided on
    the sets themselves. Texts with equal sets are one node, whatever their rows; should two different sets have
    one 64-bit name, the rows of one of them stay out of all groups.

    A block of more than ``block_limit`` nodes is not paired off at once, as in a family of copies nearly all pairs
    are alike: its members meet a few hubs, which joins most of them. Two members of one component need not meet any
    more, so only members outside their block's largest component then meet all the others: no pair of different
    components is left out, and the components are those of all pairs.
    """
    rows = stored(_sketches(docs, shingle, similarity), "sketches")
    whose = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_th")
    nodes = stored(rows.groupBy("_node").agg(F.min(whose).alias("row"), F.min("_check").alias("check")), "nodes")
    keyed = rows.where("_keys is not null").select("_node", "_n", F.posexplode("_keys").alias("pos", "key"))
    member = F.struct(F.col("_node").alias("t"), F.col("_n").alias("n"), F.col("pos").alias("p"))
    of_key = Window.partitionBy("key")
    ends = keyed.repartition("key").select("key", member.alias("x"), F.min("_node").over(of_key).alias("lo"), F.max("_node").over(of_key).alias("hi"))
    met = ends.where("lo < hi").select("key", "x").distinct()
    met = stored(met.withColumn("n", F.count("*").over(of_key)), "blocks")
    parts = rows.where("_keys is not null").select("_node", "_parts")

    def may(a: Column, b: Column) -> Column:
        # at the first shingle that both have, no more than it and what follows can be shared
        return F.least(a["n"] - a["p"], b["n"] - b["p"]) >= _needed(a["n"], b["n"], similarity)

    def still(a: Column, b: Column) -> Column:
        # every part that one set has and the other has not holds a hash that they do not share
        apart = lambda x, y: sum((F.bit_count(x["bits"][i].bitwiseAND(F.bitwise_not(y["bits"][i]))) for i in range(PARTS // 64)), F.lit(0))
        return F.least(a["x"]["n"] - apart(a, b), b["x"]["n"] - apart(b, a)) >= _needed(a["x"]["n"], b["x"]["n"], similarity)

    def ordered(pairs: DataFrame) -> DataFrame:
        return pairs.where("a.t <> b.t").where(may(F.col("a"), F.col("b"))).select(F.least("a.t", "b.t").alias("a"), F.greatest("a.t", "b.t").alias("b"))

    few = met.where(F.col("n") <= block_limit).select("key", "x")
    meeting = (F.col("l.key") == F.col("r.key")) & (F.col("l.x.t") < F.col("r.x.t")) & may(F.col("l.x"), F.col("r.x"))
    pairs = few.alias("l").join(few.alias("r"), meeting).select(F.col("l.x.t").alias("a"), F.col("r.x.t").alias("b"))
    large = met.where(F.col("n") > block_limit)

    def hubs_of(members: DataFrame, seed: int, *also: str) -> DataFrame:
        picked = [F.min(F.struct(F.xxhash64("x.t", F.lit(seed + i)).alias("h"), "x", *also)).alias(f"hub{i}") for i in range(HUBS)]
        found = members.groupBy("key").agg(*picked)
        return found.select("key", F.explode(F.array_distinct(F.array(*(F.struct(f"hub{i}.x", *(f"hub{i}.{c}" for c in also)) for i in range(HUBS))))).alias("hub"))

    starred = ordered(large.join(hubs_of(large, 0), "key").select(F.col("hub.x").alias("a"), F.col("x").alias("b")))
    links = _alike(docs, nodes, parts, stored(pairs.union(starred).distinct(), "pairs"), shingle, similarity)
    if radius:
        links = stored(links.union(_fingerprint_links(rows, radius)), "links")
    room, before = HUB_WORK * met.count(), None
    bits = stored(rows.where("_keys is not null").select("_node", F.col("_bits").alias("bits")).dropDuplicates(["_node"]), "bits")
    while True:
        roots = stored(connected_components(links), "roots")
        named = bits.join(roots, F.col("_node") == F.col("node"), "left").select("_node", "bits", F.coalesce("root", "_node").alias("root"))
        at = large.join(named, F.col("x.t") == F.col("_node")).select("key", "x", "n", "root", "bits")
        major = at.groupBy("key", "root").agg(F.count("*").alias("m")).groupBy("key").agg(F.max(F.struct("m", "root")).alias("major"))
        others = stored(at.join(major, "key").where(F.col("root") != F.col("major.root")).drop("major"), "others")
        work = others.agg(F.sum("n")).first()[0]
        if not work:
            break
        last = work <= room or (before is not None and 2 * work > before)
        if last:
            l, r = ({"x": F.col(f"{c}.x"), "bits": F.col(f"{c}.bits")} for c in "lr")
            rest = others.alias("l").join(at.alias("r"), (F.col("l.key") == F.col("r.key")) & (F.col("l.root") != F.col("r.root")) & may(l["x"], r["x"]) & still(l, r))
            rest = rest.select(F.col("l.x").alias("a"), F.col("r.x").alias("b"))
        else:
            rest = at.join(hubs_of(others, work, "root"), "key").where(F.col("root") != F.col("hub.root")).select(F.col("hub.x").alias("a"), F.col("x").alias("b"))
        links = stored(links.union(_alike(docs, nodes, parts, stored(ordered(rest).distinct(), "more-pairs"), shingle, similarity)), "links")
        before = work
        if last:
            roots = stored(connected_components(links), "roots")
            break
    rooted = nodes.join(roots, F.col("_node") == F.col("node"), "left").select("_node", "check", F.col("row.doc_id").alias("first"), F.coalesce("root", "_node").alias("root"))
    least = rooted.groupBy("root").agg(F.min("first").alias("component_id"))
    grouped = rooted.join(least, "root").select("_node", "check", "component_id")
    own = F.when(F.col("_check") == F.col("check"), F.col("component_id")).otherwise(F.col("doc_id"))
    return rows.select("doc_id", "_th", "_node", "_check").join(grouped, "_node").select("doc_id", "_th", own.alias("component_id"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id, once where its row is repeated.

    Copies are texts whose SimHash fingerprints differ in two bits or fewer, as in ``near_duplicates``, those of a
    similarity of 0.8 or more on five-word shingles, which fingerprints so close cannot all find, and what they
    reach. Rows without a doc_id stay where their group has no doc_id at all.
    """
    groups = stored(similar_texts(docs, radius=RADIUS), "groups")
    keys = groups.groupBy("doc_id", "_th").agg(F.count("*").alias("n"), F.min("component_id").alias("component_id"))
    lost = keys.where("not (doc_id <=> component_id)")
    twice = keys.where("doc_id <=> component_id and n > 1")
    odd = stored(lost.union(twice).select("doc_id", "_th", "n", (~F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("lost")), "odd")
    key = "_th"
    while key in {c.lower() for c in docs.columns}:
        key = "_" + key
    keyed = docs.withColumn(key, F.xxhash64("text"))
    same = keyed["doc_id"].eqNullSafe(odd["doc_id"]) & (keyed[key] == odd["_th"])
    alone = keyed.join(small(odd), same, "left_anti")
    again = keyed.join(small(odd.where("not lost")), same, "left_semi").dropDuplicates(["doc_id", key])
    return alone.union(again).select(*docs.columns)
