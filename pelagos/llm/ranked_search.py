"""Ranked lexical search over a forward index of document blocks, pruned by the maxima of each block."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .bytesvec import Words, binary_column, in_blocks
from .storage import stored, table

#: ASCII that is neither a letter nor a digit parts terms.
PARTS_TERMS = np.array([b < 0x80 and not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A) for b in range(256)])
#: Documents of one block.
BLOCK = 32
#: Different terms of the items that are looked for at once; more items are dealt into passes.
PASS_TERMS = 100_000
#: Cells of the matrix of block maxima that a task holds at once, and bytes of text cut into terms at once.
CELLS, TEXT_BYTES = 8_000_000, 1 << 22
RANKS = 20


def _queries(items: DataFrame, id: str, text: str) -> DataFrame:
    """``item``, ``q`` (a number for each distinct item), ``h`` (hash of a term), ``n`` (its occurrences)."""
    plain = items.select(F.col(id).alias("item"), F.col(text).cast("binary").alias("t")).distinct().withColumn("q", F.monotonically_increasing_id())

    def run(batches):
        for b in batches:
            words = Words(binary_column(b, "t"), breaks=PARTS_TERMS)
            of = np.stack([words.doc.astype(np.uint64), words.hash])
            (doc, h), n = np.unique(of, axis=1, return_counts=True)
            at = pa.array(doc.astype(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0).take(at), b.column(2).take(at), pa.array(h.view(np.int64)), pa.array(n)], names=["item", "q", "h", "n"])

    return stored(plain.mapInArrow(run, f"item {items.schema[id].dataType.simpleString()}, q long, h long, n long"), "items")


def _lists(flat: np.ndarray, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(flat, kind))


def _forward(docs: DataFrame, id: str, text: str, vocabulary: np.ndarray, block: int) -> DataFrame:
    """Blocks of documents: ``docs``, ``sizes``, ``ends`` of those that hold a looked-for term, their postings in ``terms`` and ``tfs``.

    ``n_docs`` and ``n_terms`` count all documents of the block that have a term, and all their terms.
    """
    plain = docs.select(F.col(id).alias("d"), F.col(text).cast("binary").alias("t"))

    def postings(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(vocabulary, words.hash), len(vocabulary) - 1)
        hit = vocabulary[at] == words.hash
        pair, tf = np.unique(words.doc[hit] * len(vocabulary) + at[hit], return_counts=True)
        return pair // len(vocabulary), pair % len(vocabulary), tf

    def run(batches):
        for b in batches:
            texts = binary_column(b, "t")
            doc, term, tf, sizes = [], [], [], []
            for start, stop in in_blocks(texts, TEXT_BYTES):
                words = Words(texts[start:stop], breaks=PARTS_TERMS)
                found = postings(words)
                doc.append(found[0] + start)
                term.append(found[1])
                tf.append(found[2])
                sizes.append(words.count)
            if not sizes:
                continue
            doc, term, tf, sizes = map(np.concatenate, (doc, term, tf, sizes))
            held, counts = np.unique(doc, return_counts=True)
            ends = np.cumsum(counts)
            edges = np.arange(0, len(texts), block)
            last = np.searchsorted(held, np.append(edges[1:], len(texts)))  # documents with postings before each block's end
            posted = np.concatenate([[0], ends])[last]
            first = np.concatenate([[0], last[:-1]])
            local = ends - np.repeat(np.concatenate([[0], posted[:-1]]), last - first)
            names = b.column(0).take(pa.array(held))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], last]).astype(np.int32)), names),
                    _lists(sizes[held], last, pa.int64()),
                    _lists(local, last, pa.int32()),
                    _lists(term, posted, pa.int32()),
                    _lists(tf, posted, pa.int64()),
                    pa.array(np.add.reduceat((sizes > 0).astype(np.int64), edges)),
                    pa.array(np.add.reduceat(sizes.astype(np.int64), edges)),
                ],
                names=["docs", "sizes", "ends", "terms", "tfs", "n_docs", "n_terms"],
            )

    kind = docs.schema[id].dataType.simpleString()
    return stored(plain.mapInArrow(run, f"docs array<{kind}>, sizes array<bigint>, ends array<int>, terms array<int>, tfs array<bigint>, n_docs long, n_terms long"), "forward")


def _numpy(row: pa.ListScalar) -> np.ndarray:
    return row.values.to_numpy(zero_copy_only=False) if row.values is not None else np.zeros(0, np.int64)


def _index(forward: DataFrame, n: int, total: int) -> DataFrame:
    """Blocks with each posting's ``impacts`` in place of its count, and the largest impact of each term: ``top_terms``, ``tops``."""

    def run(batches):
        for b in batches:
            cols = [[], [], []]
            for i in range(b.num_rows):
                sizes, ends, terms, tf = (_numpy(b.column(c)[i]) for c in (1, 2, 3, 4))
                m = 75 + 25 * np.repeat(sizes, np.diff(ends, prepend=0)) * n // total
                impact = 1_000_000_000 * tf // (1000 * tf + 12 * m)
                order = np.lexsort((impact, terms))
                last = np.flatnonzero(np.diff(terms[order], append=-1))
                for held, x in zip(cols, (impact, terms[order][last], impact[order][last]), strict=True):
                    held.append(x)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(2), b.column(3), *(pa.array(x, pa.list_(pa.int32())) for x in cols)], names=["docs", "ends", "terms", "impacts", "top_terms", "tops"]
            )

    schema = f"docs {forward.schema['docs'].dataType.simpleString()}, ends array<int>, terms array<int>, impacts array<int>, top_terms array<int>, tops array<int>"
    return stored(forward.where(F.size("docs") > 0).mapInArrow(run, schema), "blocks")


class Blocks:
    """Some blocks in memory: their bounds for a query, and the scores of one block's documents."""

    def __init__(self, batch: pa.RecordBatch, start: int, stop: int, vocabulary: int):
        self.batch, self.start, self.held = batch, start, {}
        self.top = np.zeros((stop - start, vocabulary), dtype=np.int32)
        for i in range(start, stop):
            self.top[i - start, _numpy(batch.column(4)[i])] = _numpy(batch.column(5)[i])

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        return self.top[:, terms].astype(np.int64) @ weights

    def scores(self, i: int, weight_of: np.ndarray) -> np.ndarray:
        if i not in self.held:
            ends, terms, impacts = (_numpy(self.batch.column(c)[self.start + i]) for c in (1, 2, 3))
            self.held[i] = np.concatenate([[0], ends[:-1]]), terms, impacts.astype(np.int64)
        starts, terms, impacts = self.held[i]
        return np.add.reduceat(weight_of[terms] * impacts, starts)

    def docs(self, i: int) -> list:
        return self.batch.column(0)[self.start + i].as_py()


def _in_memory(batch: pa.RecordBatch, vocabulary: int) -> Iterator[Blocks]:
    step = max(1, CELLS // vocabulary)
    for i in range(0, batch.num_rows, step):
        yield Blocks(batch, i, min(i + step, batch.num_rows), vocabulary)


def _order(found: tuple[int, object]) -> tuple:
    score, doc = found
    return -score, doc is None, doc if doc is not None else 0


def _best(found: list[tuple[int, object]], k: int) -> list[tuple[int, object]]:
    return sorted(found, key=_order)[:k]


def _first_thresholds(blocks: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], vocabulary: int, k: int) -> dict[int, int]:
    """Of each query a score that ``k`` documents reach: those of the best-bounded blocks of each task."""

    def run(batches):
        best: dict[int, list[int]] = {}
        for b in batches:
            for held in _in_memory(b, vocabulary):
                for q, terms, weights in asked:
                    bounds = held.bounds(terms, weights)
                    i = int(bounds.argmax())
                    if bounds[i] > 0:
                        weight_of = np.zeros(vocabulary, dtype=np.int64)
                        weight_of[terms] = weights
                        scores = held.scores(i, weight_of)
                        best[q] = sorted([*best.get(q, []), *scores[scores > 0].tolist()], reverse=True)[:k]
        rows = [(q, s) for q, found in best.items() for s in found]
        yield pa.RecordBatch.from_pydict({"q": pa.array([r[0] for r in rows], pa.int64()), "score": pa.array([r[1] for r in rows], pa.int64())})

    top = blocks.mapInArrow(run, "q long, score long").withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"))))
    return {r["q"]: r["score"] for r in top.where(F.col("rank") == k).select("q", "score").collect()}


def _search(blocks: DataFrame, asked: list[tuple[int, np.ndarray, np.ndarray]], least: dict[int, int], vocabulary: int, k: int) -> DataFrame:
    """``q``, ``doc``, ``score``: each task's best documents. Blocks come by falling bound and end where the bound is below the threshold."""
    of_docs = blocks.schema["docs"].dataType.elementType
    kind = to_arrow_type(of_docs)

    def run(batches):
        best: dict[int, list] = {}
        for b in batches:
            for held in _in_memory(b, vocabulary):
                weight_of = np.zeros(vocabulary, dtype=np.int64)
                for q, terms, weights in asked:
                    found = best.get(q, [])
                    threshold = max(1, least.get(q, 1), found[k - 1][0] if len(found) >= k else 1)
                    bounds = held.bounds(terms, weights)
                    some = np.flatnonzero(bounds >= threshold)
                    if not len(some):
                        continue
                    weight_of[terms] = weights
                    for i in some[np.argsort(-bounds[some], kind="stable")].tolist():
                        if bounds[i] < threshold:
                            break
                        scores = held.scores(i, weight_of)
                        good = np.flatnonzero(scores >= threshold)
                        if len(good):
                            docs = held.docs(i)
                            found = _best(found + [(int(scores[j]), docs[j]) for j in good], k)
                            threshold = max(threshold, found[k - 1][0] if len(found) >= k else 1)
                    weight_of[terms] = 0
                    best[q] = found
        rows = [(q, *r) for q, found in best.items() for r in found]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[2] for r in rows], kind), pa.array([r[1] for r in rows], pa.int64())], names=["q", "doc", "score"])

    return blocks.mapInArrow(run, f"q long, doc {of_docs.simpleString()}, score long")


def ranked(docs: DataFrame, items: DataFrame, k: int = RANKS, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", block: int = BLOCK, pass_terms: int = PASS_TERMS) -> DataFrame:
    """The ``k`` best documents of each item: ``item_id``, ``rank`` from 1, ``doc_id``, ``score`` over 0; ties by ascending id, without one last.

    One pass over the texts counts all terms and writes the forward index: blocks of ``block`` documents with
    their postings of looked-for terms. With the document counts known, each block gets its postings' impacts and
    the largest of each term. The weighted sum of the largest is a bound on all of its documents. The best-bounded
    blocks of each task give every query a first threshold; then tasks take their blocks by falling bound
    and score documents until the bound is below the threshold, so no document of the first ``k`` is missed. The
    driver holds the items' terms, ``pass_terms`` at a time: further items take further passes.

    Null and empty texts have no terms and count in no statistic; an item without terms has no rows. Repeated
    document rows rank one by one. Rows of ``items`` equal in both columns are one item; different texts under one
    item_id are ranked each by itself. Terms are told apart by 64-bit hashes. Other columns are not read.
    """
    queries = _queries(items, item_id, item_text)
    passes = max(1, -(-queries.count() // pass_terms))
    parts = []
    for p in range(passes):
        rows = queries.where(F.pmod(F.xxhash64("q"), F.lit(passes)) == p).select("q", "h", "n").toPandas()
        if not len(rows):
            continue
        vocabulary = np.unique(rows["h"].to_numpy().view(np.uint64))
        forward = _forward(docs, id, text, vocabulary, block)
        n, total = forward.agg(F.sum("n_docs"), F.sum("n_terms")).first()
        if not total:
            continue
        df = np.zeros(len(vocabulary), dtype=np.int64)
        for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().collect():
            df[r["t"]] = r["count"]
        weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(x) + 1))) for x in df], dtype=np.int64)
        blocks = _index(forward, n, total)
        rows = rows.assign(at=np.searchsorted(vocabulary, rows["h"].to_numpy().view(np.uint64)))
        rows = rows[df[rows["at"]] > 0]
        asked = [(int(q), g["at"].to_numpy(), g["n"].to_numpy() * weight[g["at"]]) for q, g in rows.groupby("q")]
        least = _first_thresholds(blocks, asked, len(vocabulary), k)
        parts.append(stored(_search(blocks, asked, least, len(vocabulary), k), "found"))
    kinds = docs.schema[id].dataType.simpleString()
    found = parts[0] if parts else docs.sparkSession.createDataFrame([], f"q long, doc {kinds}, score long")
    for more in parts[1:]:
        found = found.union(more)
    best = Window.partitionBy("q").orderBy(F.desc("score"), F.col("doc").asc_nulls_last())
    top = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    names = queries.select("q", F.col("item").alias(item_id)).distinct()
    return top.join(names, "q").select(item_id, "rank", F.col("doc").alias(id), "score")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 best documents for each benchmark item."""
    return ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP11_SQL = r"""
WITH terms AS (
  SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM (SELECT *, row_number() OVER () AS r FROM documents)),
sizes AS (SELECT r, count(*) AS n FROM terms GROUP BY r),
totals AS (SELECT count(*) AS all_docs, sum(n)::BIGINT AS all_terms FROM sizes),
tfs AS (SELECT r, doc_id, term, count(*) AS tf FROM terms GROUP BY r, doc_id, term),
weights AS (
  SELECT term, floor(1000 * ln((2 * all_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w
  FROM tfs, totals GROUP BY term, all_docs),
asked AS (
  SELECT item_id, term, count(*) AS times
  FROM (SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY item_id, term),
scores AS (
  SELECT item_id, doc_id, r, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * all_docs) // all_terms))))::BIGINT AS score
  FROM asked JOIN weights USING (term) JOIN tfs USING (term) JOIN sizes USING (r), totals
  GROUP BY item_id, doc_id, r),
ranks AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM scores WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM ranks WHERE rank <= 20
"""
