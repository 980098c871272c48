"""Language-model scoring: code lengths under context-tree weighting, beside a word base line."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .bytesvec import Words, binary_column, in_blocks
from .ctw import DEPTH, Level, Tree, code_lengths, find_nodes, levels, mix_down, parent_ids, summed, weigh_up
from .lookup import Lookup
from .storage import stored, table
from .toxicity import remainder

#: Grams of one shard of the tree (which passes through the driver), shards that a task holds at once, and words whose counts all tasks hold: these bound what is sent to a task.
SHARD_GRAMS, SHARDS_AT_ONCE, FREQUENT_WORDS = 200_000, 4, 1_000_000
#: Grams of one part of the tree as it is built.
PART_GRAMS = 200_000
BLOCK_BYTES = 1 << 20
FLUSH = 2_000_000
_END_BYTE = 10
END = np.uint64(0x38B34AE5A1E38B93)


def grams(w: Words, texts: int, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """Every byte of the texts with the ``depth`` bytes before it, nearest first, as one number; and its text.

    A text is its lower-cased words with one space between and an end byte; before it stand end bytes.
    """
    data = w.data
    n = len(w.start)
    # the bytes of the words and one separator behind each
    lengths = w.size + 1
    offsets = np.cumsum(lengths) - lengths
    inner = np.repeat(w.start - offsets, lengths) + np.arange(int(lengths.sum())) if n else np.zeros(0, np.int64)
    flat = data[inner].copy() if n else np.zeros(0, np.uint8)
    last = np.append(w.doc[1:] != w.doc[:-1], True) if n else np.zeros(0, bool)
    flat[offsets + w.size] = np.where(last, _END_BYTE, 0x20)
    sizes = np.bincount(w.doc, weights=lengths, minlength=texts).astype(np.int64) if n else np.zeros(texts, np.int64)
    full = np.maximum(sizes, 1)  # a text without words is its end byte
    begin = np.cumsum(full + depth) - (full + depth)
    out = np.full(int((full + depth).sum()), _END_BYTE, dtype=np.uint8)
    doc = np.repeat(np.arange(texts), sizes)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + begin[doc] + depth
    out[at] = flat
    keep = np.ones(len(out), dtype=bool)
    keep[(begin[:, None] + np.arange(depth)).ravel()] = False
    places = np.flatnonzero(keep)
    key = out[places].astype(np.uint64)
    for d in range(1, depth + 1):
        key |= out[places - d].astype(np.uint64) << np.uint64(8 * (depth - d + 1))
    return key, np.repeat(np.arange(texts), full)


def corpus_counts(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``kind`` (0 a word's hash, 1 a gram), ``k``, ``c``: counts over all texts, ends among the words."""
    plain = docs.select(F.col("text").cast("binary").alias("_t"))

    def batch(kind: int, keys: np.ndarray, counts: np.ndarray):
        return pa.RecordBatch.from_arrays(
            [pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys.view(np.int64)), pa.array(counts)], names=["kind", "k", "c"]
        )

    def run(batches):
        held = {0: [], 1: []}
        size = {0: 0, 1: 0}

        def merged(kind):
            parts = held[kind]
            k, c = summed(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))
            held[kind], size[kind] = [(k, c)], len(k)

        for b in batches:
            texts = binary_column(b, "_t")
            for i, j in in_blocks(texts, BLOCK_BYTES):
                w = Words(texts[i:j])
                words = np.append(w.hash, np.full(j - i, END))
                for kind, keys in ((0, words), (1, grams(w, j - i, depth)[0])):
                    keys = np.sort(keys)
                    at = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
                    held[kind].append((keys[at], np.diff(np.append(at, len(keys))).astype(np.int64)))
                    size[kind] += len(at)
                    if size[kind] > 2 * FLUSH:
                        merged(kind)
                        if size[kind] > FLUSH:
                            yield batch(kind, *held[kind][0])
                            held[kind], size[kind] = [], 0
        for kind in (0, 1):
            if held[kind]:
                merged(kind)
                yield batch(kind, *held[kind][0])

    return plain.mapInArrow(run, "kind int, k long, c long").groupBy("kind", "k").agg(F.sum("c").alias("c"))


def _arrays(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    k = rows["k"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(k)
    return k[order], rows["c"].to_numpy(np.int64)[order]


def _unit(keys: np.ndarray, depth: int) -> np.ndarray:
    """The nearest two context bytes of grams."""
    return (keys >> np.uint64(8 * (depth - 1))).astype(np.int64)


def context_tree(counts: DataFrame, depth: int = DEPTH, part_grams: int = PART_GRAMS, shard_grams: int = SHARD_GRAMS):
    """The weighted tree of the grams ``k`` with counts ``c``, in shards: yields shard number, how many, and the rows' Tree.

    Below two bytes of context the subtrees are independent: they are built in parts of about ``part_grams`` by
    tasks, first upwards (what each part's subtrees contribute above), then downwards. The two depths above are
    sums over all parts, 65,536 nodes at most, and are weighed on the driver.
    """
    spark = counts.sparkSession
    total = counts.count()
    parts = max(1, -(-total // part_grams))
    unit = F.shiftrightunsigned("k", 8 * (depth - 1))
    dealt = stored(counts.select("k", "c", F.pmod(F.xxhash64(unit), F.lit(parts)).cast("int").alias("part")), "grams")

    def up(rows: pd.DataFrame) -> pd.DataFrame:
        of = levels(*_arrays(rows), depth, 2)
        weighted, _, _ = weigh_up(of)
        names, where = np.unique(parent_ids(of[-1].ids), return_inverse=True)
        sums = np.bincount(where, weights=weighted[-1], minlength=len(names))
        k1, c1 = of[-1].shorter()
        return pd.DataFrame({
            "kind": np.repeat([0, 1], [len(names), len(k1)]), "k": np.concatenate([names, k1]).view(np.int64),
            "s": np.concatenate([sums, c1.astype(np.float64)]),
        })

    above = dealt.groupBy("part").applyInPandas(up, "kind long, k long, s double").groupBy("kind", "k").agg(F.sum("s").alias("s")).toPandas()
    one, below = above[above["kind"] == 1], above[above["kind"] == 0]
    first = Level(*_arrays(pd.DataFrame({"k": one["k"], "c": one["s"].round().astype(np.int64)})))
    of = [first, Level(*first.shorter())]
    children = np.zeros(len(first.ids))
    if len(below):
        children[find_nodes(first.ids, below["k"].to_numpy(np.int64).view(np.uint64))] = below["s"].to_numpy()
    _, own, parents = weigh_up(of, children)
    p_one, rest = mix_down(of, own, parents)
    top = [(lv.keys, code_lengths(lv, p)) for lv, p in zip(reversed(of), p_one, strict=True)]
    held = spark.sparkContext.broadcast((first.ids, *rest))

    def down(rows: pd.DataFrame) -> pd.DataFrame:
        ids, given, left = held.value
        of = levels(*_arrays(rows), depth, 2)
        _, own, parents = weigh_up(of)
        at = find_nodes(ids, parent_ids(of[-1].ids))
        p_one, _ = mix_down(of, own, parents, (given[at], left[at]))
        made = [(lv.keys.tobytes(), code_lengths(lv, p).tobytes()) for lv, p in zip(reversed(of), p_one, strict=True)]
        return pd.DataFrame({"part": rows["part"].iloc[0], "depth": range(2, depth + 1), "keys": [m[0] for m in made], "lengths": [m[1] for m in made]})

    built = stored(dealt.groupBy("part").applyInPandas(down, "part int, depth int, keys binary, lengths binary"), "tree")
    shards = max(1, -(-total // shard_grams))
    part_of = spark.range(1 << 16).select("id", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("p")).orderBy("id").toArrow().column("p").to_numpy()
    for s in range(shards):
        tables = list(top)
        mine = built.where(F.col("part").isin(list(range(s, parts, shards)))).select("depth", "keys", "lengths").toArrow()
        rows = list(zip(mine.column("depth").to_pylist(), mine.column("keys"), mine.column("lengths"), strict=True))
        for d in range(2, depth + 1):
            keys = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x.as_buffer(), np.uint64) for at, x, _ in rows if at == d)])
            lengths = np.concatenate([np.zeros((0, 8), np.float32), *(np.frombuffer(x.as_buffer(), np.float32).reshape(-1, 8) for at, _, x in rows if at == d)])
            order = np.argsort(keys)
            tables.append((keys[order], lengths[order]))
            del keys, lengths, order
        del mine, rows
        yield s, shards, Tree(tables), (part_of % shards if shards > 1 else None)


def scores(docs: DataFrame, learn: Column, depth: int = DEPTH, part_grams: int = PART_GRAMS, shard_grams: int = SHARD_GRAMS, frequent: int = FREQUENT_WORDS) -> DataFrame:
    """Per row of ``docs``: ``doc_id``, ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score``, ``score``, ``n_bytes``, ``bits_per_byte``.

    Both models learn from all rows where ``learn`` holds. Null texts count as empty: one end. Repeated rows each
    get the same result. Without any row to learn from all bytes have eight bits.

    Counts of the ``frequent`` most frequent words (by powers of two) go to all tasks, those of the others are
    joined to their occurrences, so no word is left out at any size. The tree is gone through shard by shard.
    """
    spark = docs.sparkSession
    counts = stored(corpus_counts(docs.where(learn), depth), "lm-counts")
    words, tree = counts.where("kind = 0").select("k", "c"), counts.where("kind = 1").select("k", "c")
    by_size = {r["b"]: r for r in words.groupBy(F.floor(F.log2("c")).cast("int").alias("b")).agg(F.count("*").alias("v"), F.sum("c").alias("n")).collect()}
    v, n = sum(r["v"] for r in by_size.values()), sum(r["n"] for r in by_size.values())
    least, room = (max(by_size) + 1 if by_size else 0), frequent
    while least > 0 and room - (by_size[least - 1]["v"] if least - 1 in by_size else 0) >= 0:
        least -= 1
        room -= by_size[least]["v"] if least in by_size else 0
    least = 1 << least
    is_end = F.col("k") == int(np.array([END]).view(np.int64)[0])
    got = words.where((F.col("c") >= least) | is_end).toArrow()
    common = Lookup(got.column("k").to_numpy().view(np.uint64), got.column("c").to_numpy().astype(np.float64))
    del got
    plain = docs.select("doc_id", F.xxhash64("text").alias("_th"), F.col("text").cast("binary").alias("_t"))
    fields = ["doc_id", "_th", "n_tokens", "n_known", "base", "n_bytes", "score", "rare"]
    parts, held, passes = None, [], 0
    for shard, shards, rows, part_of in context_tree(tree, depth, part_grams, shard_grams):
        held.append((shard, spark.sparkContext.broadcast((rows, part_of, common if shard == 0 else None))))
        del rows
        if len(held) < SHARDS_AT_ONCE and shard + 1 < shards:
            continue

        def run(batches, held=tuple(held)):
            sent = [(shard, *x.value) for shard, x in held]
            first, common = sent[0][0] == 0, sent[0][3]
            for b in batches:
                texts = binary_column(b, "_t")
                out = {c: np.zeros(len(texts), dtype=np.int64) for c in ("n_tokens", "n_known", "n_bytes")} | {c: np.zeros(len(texts)) for c in ("base", "score")}
                rare, sizes = [np.zeros(0, np.int64)], np.zeros(len(texts), dtype=np.int64)
                for i, j in in_blocks(texts, BLOCK_BYTES):
                    w = Words(texts[i:j])
                    key, doc = grams(w, j - i, depth)
                    if first:
                        out["n_tokens"][i:j] = w.count + 1
                        out["n_bytes"][i:j] = np.bincount(doc, minlength=j - i)
                        at = common.find(np.append(w.hash, np.full(j - i, END)))
                        of = np.append(w.doc, np.arange(j - i))
                        hit = at >= 0
                        out["n_known"][i:j] = np.bincount(of[hit], minlength=j - i)
                        if hit.any():
                            out["base"][i:j] = np.bincount(of[hit], weights=np.log10(common.values[at[hit]] + 1.0), minlength=j - i)
                        # words come text by text; the end is always among the common ones
                        few = ~hit[: len(w.hash)] if least > 1 else np.zeros(0, bool)
                        if few.any():
                            rare.append(w.hash[few].view(np.int64))
                            sizes[i:j] = np.bincount(w.doc[few], minlength=j - i)
                    place = None if sent[0][2] is None else sent[0][2][_unit(key, depth)]
                    for shard, rows, _, _ in sent:
                        mine = slice(None) if place is None else place == shard
                        out["score"][i:j] += np.bincount(doc[mine], weights=rows.log10(key[mine]), minlength=j - i)
                cols = [pa.array(out[c]) for c in ("n_tokens", "n_known", "base", "n_bytes", "score")]
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(rare)))
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols, lists], names=fields)

        ddl = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _th long, n_tokens long, n_known long, base double, n_bytes long, score double, rare array<bigint>"
        part = stored(plain.mapInArrow(run, ddl), "lm-scores")
        parts, passes = part if parts is None else parts.union(part), passes + 1
        for _, x in held:
            x.destroy()
        held = []
    each = parts.groupBy("doc_id", "_th").agg(
        F.count("*").alias("_n"), *(F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base", "n_bytes", "score"))
    )
    each = each.withColumn("_copies", (F.col("_n") / passes).cast("long"))
    if least > 1:
        few = words.where((F.col("c") < least) & ~is_end)
        tail = parts.select("doc_id", "_th", F.explode("rare").alias("k")).join(few, "k")
        tail = tail.groupBy(F.col("doc_id").alias("_d"), F.col("_th").alias("_h")).agg(F.count("*").alias("_k"), F.sum(F.log10(F.col("c") + 1.0)).alias("_b"))
        each = each.join(tail, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_th") == F.col("_h")), "left")
        each = each.withColumns({"n_known": F.col("n_known") + F.coalesce("_k", F.lit(0)), "base": F.col("base") + F.coalesce("_b", F.lit(0.0))})
    one = {c: (F.col(c) / F.col("_copies")) for c in ("n_tokens", "n_known", "base", "n_bytes", "score")}
    one |= {c: one[c].cast("long") for c in ("n_tokens", "n_known", "n_bytes")}
    each = each.withColumns(one).withColumn("_row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_copies"))))
    return each.select(
        "doc_id", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") - F.col("n_tokens") * float(np.log10(n + v + 1))).alias("base_score"), "score", "n_bytes",
        (-F.col("score") / F.col("n_bytes") / float(np.log10(2))).alias("bits_per_byte"),
    )


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's code length under the tree and its word base line; rows whose crc32 modulo 7 is 2 are held out."""
    held_out = remainder(F.col("doc_id"), 7) == 2
    out = scores(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), *out.columns[1:])
