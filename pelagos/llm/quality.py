"""Quality classifier: perplexity under an n-gram model of trusted text."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bytesvec import Words, binary_column, in_blocks
from .lookup import SHARD_ROWS, Lookup, pair_key
from .storage import Bucketed, discard, drop_bucketed, small, stored, table

#: A language's threshold is this quantile of the perplexities of its trusted documents.
QUANTILE = 0.97
#: What a short text's perplexity may exceed it by: 10 to the power MARGIN / sqrt(tokens), from the spread of one token.
MARGIN = 1.5
BLOCK_BYTES = 1 << 19
#: The counts are made for so many parts of the words, the model for PARTS (by a trigram's middle word), and texts are scored in SLICES, or in
#: fewer where a part would have less text than PART_BYTES. Each deletes what it shuffled, so that disk holds the model and one part of the work at a time.
COUNT_PARTS, PARTS, SLICES = 2, 12, 20
PART_BYTES = 16 << 20
#: Trusted text per bucket of the model at most, about a tenth as many rows.
BUCKET_BYTES = 32 << 20

START, END = np.uint64(0x1B873593CC9E2D51), np.uint64(0x38B34AE5A1E38B93)


def _signed(x: np.uint64) -> int:
    return int(np.array([x], dtype=np.uint64).view(np.int64)[0])


def padded(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The word hashes of a block with two starts before and an end behind each text; the text of each; the number of words."""
    w = Words(texts, lower=False)
    n = len(texts)
    sizes = w.count + 3
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    seq = np.empty(int(sizes.sum()), dtype=np.uint64)
    seq[first] = seq[first + 1] = START
    seq[last] = END
    inner = np.ones(len(seq), dtype=bool)
    inner[first] = inner[first + 1] = inner[last] = False
    seq[inner] = w.hash
    return seq, np.repeat(np.arange(n), sizes), w.count


def _trigrams(texts: list[bytes]):
    seq, doc, _ = padded(texts)
    whole = doc[2:] == doc[:-2]
    return seq[:-2][whole], seq[1:-1][whole], seq[2:][whole]


def _discounts(found: dict[int, int]) -> list[float]:
    """The modified discounts for counts 1, 2 and 3 or more, from the numbers of n-grams with counts 1 to 4."""
    n1, n2, n3, n4 = (found.get(k, 0) for k in (1, 2, 3, 4))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = [k - (k + 1) * y * b / a if a else 0.5 * k for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return [min(max(d, 0.05 * k), 0.95 * k) for k, d in zip((1, 2, 3), raw, strict=True)]


def _bytes(docs: DataFrame) -> int:
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def _pieces(size: int, most: int) -> int:
    return min(most, max(1, -(-size // PART_BYTES)))


def _dealt(bucket: np.ndarray, cols: list[np.ndarray]) -> tuple[np.ndarray, list[pa.Array]]:
    """The buckets that occur and, for each column, one binary value with the bucket's part of it."""
    if not len(bucket):
        return bucket.astype(np.int32), [pa.array([], pa.binary()) for _ in cols]
    bucket = bucket.astype(np.uint16) if bucket.max() < 1 << 16 else bucket
    order = np.argsort(bucket, kind="stable")
    counts = np.bincount(bucket)
    used = np.flatnonzero(counts)
    ends = np.concatenate([[0], np.cumsum(counts[used])])
    out = []
    for c in cols:
        data = np.ascontiguousarray(c[order])
        offsets = pa.py_buffer((ends * data.itemsize).astype(np.int32))
        out.append(pa.Array.from_buffers(pa.binary(), len(used), [None, offsets, pa.py_buffer(data.view(np.uint8))]))
    return used.astype(np.int32), out


def _bucket(key: np.ndarray, buckets: int) -> np.ndarray:
    return (key % np.uint64(buckets)).astype(np.int64)


def _part(v: np.ndarray, parts: int) -> np.ndarray:
    return ((v >> np.uint64(32)) % np.uint64(parts)).astype(np.int64)


def _column(t: pa.Table, name: str, kind=np.uint64) -> np.ndarray:
    return np.frombuffer(b"".join(x for x in t.column(name).to_pylist() if x), dtype=kind)


def _dealt_trigrams(trusted: DataFrame, buckets: int, part: int, parts: int, by_end: bool) -> DataFrame:
    """The trigrams whose middle word is of a part, in packed rows of the bucket of their last two words (``by_end``) or their first two."""

    def run(batches):
        for b in batches:
            texts = binary_column(b, "_t")
            found = []
            for i, j in in_blocks(texts, BLOCK_BYTES):
                rows = _trigrams(texts[i:j])
                mine = np.flatnonzero(_part(rows[1], parts) == part)
                found.append([x[mine] for x in rows])
            if found:
                u, v, w = (np.concatenate(x) for x in zip(*found, strict=True))
                used, cols = _dealt(_bucket(pair_key(v, w) if by_end else pair_key(u, v), buckets), [u, v, w])
                yield pa.RecordBatch.from_arrays([pa.array(used), *cols], names=["bucket", "u", "v", "w"])

    rows = trusted.select(F.col("text").cast("binary").alias("_t")).mapInArrow(run, "bucket int, u binary, v binary, w binary")
    return rows.groupBy("bucket")


def _distinct(t: pa.Table) -> tuple[np.ndarray, ...]:
    u, v, w = (_column(t, x) for x in "uvw")
    key, at, c = np.unique(pair_key(u, v, w), return_index=True, return_counts=True)
    return u[at], v[at], w[at], key, c


def _counted(trusted: DataFrame, buckets: int, parts: int, passes: int) -> list[DataFrame]:
    """What the n-grams tell of each word, by bucket and part of the bigrams it is in, and how many n-grams have counts 1 to 4.

    Of a ``word`` (``kind`` 1): ``uses`` (words it follows), as context ``total`` (sum of its bigrams' counts) and ``n1``, ``n2``,
    ``n3`` (those with counts 1, 2, 3 or more). Of ``kind`` 2 and 3, bigrams and trigrams: ``uses`` have the count ``word``.
    """

    def count(t: pa.Table) -> pa.Table:
        bucket = t.column("bucket")[0].as_py()
        u, v, w, _, c3 = _distinct(t)
        _, at, of = np.unique(pair_key(v, w), return_index=True, return_inverse=True)
        c2 = np.bincount(of, weights=np.where(v == START, c3, 1)).astype(np.int64)
        v, w = v[at], w[at]
        rows = []
        for part in range(parts):
            mine = np.flatnonzero(_part(v, parts) == part)
            words, inv = np.unique(np.concatenate([v[mine], w[mine]]), return_inverse=True)
            a, b, c, n = inv[: len(mine)], inv[len(mine) :], c2[mine], len(words)
            sums = [np.bincount(b, minlength=n), np.bincount(a, weights=c, minlength=n).astype(np.int64)]
            sums += [np.bincount(a[x], minlength=n) for x in (c == 1, c == 2, c > 2)]
            rows.append([np.full(n, 1), np.full(n, part), words.view(np.int64), *sums])
        for kind, c in ((2, c2), (3, c3)):
            n = np.bincount(np.minimum(c, 5), minlength=6)[1:5]
            rows.append([np.full(4, kind), np.zeros(4, np.int64), np.arange(1, 5), n, *[np.zeros(4, np.int64)] * 4])
        cols = [np.concatenate(x) for x in zip(*rows, strict=True)]
        return pa.table([pa.array(np.full(len(cols[0]), bucket, np.int32)), *[pa.array(x.astype(np.int64)) for x in cols]], names=names)

    names = ["bucket", "kind", "part", "word", "uses", "total", "n1", "n2", "n3"]
    schema = "bucket int, " + ", ".join(f"{x} long" for x in names[1:])
    return [
        stored(_dealt_trigrams(trusted, buckets, i, passes, True).applyInArrow(count, schema), "counts", lean=True, by=["kind", "part"])
        for i in range(passes)
    ]


def _cut_of(c: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(c, 3)]


def _planes(x: np.ndarray) -> bytes:
    """The first bytes of all values, then the second ones and so on: those that are alike lie together and compress."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def _unplanes(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).reshape(-1).view(kind)


def _packed_rows(bucket: int, keys: np.ndarray, values: np.ndarray) -> pa.Table:
    """A row of the model: sorted keys as their differences, and their values."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order].astype(np.float32)
    k = np.diff(keys, prepend=np.uint64(0))
    return pa.table({"bucket": pa.array([bucket], pa.int32()), "n": pa.array([len(keys)], pa.int64()), "k": pa.array([_planes(k)], pa.binary()), "w": pa.array([_planes(values)], pa.binary())})


def _unpacked(t: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Keys, each once, and the sums of their values."""
    if not t.num_rows:
        return np.empty(0, np.uint64), np.empty(0)
    keys = np.concatenate([np.cumsum(_unplanes(x, np.uint64), dtype=np.uint64) for x in t.column("k").to_pylist()])
    values = np.concatenate([_unplanes(x, np.float32) for x in t.column("w").to_pylist()])
    order = np.argsort(keys, kind="stable")  # runs are sorted already
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(values.astype(np.float64), first)


MODEL_SCHEMA = "bucket int, n long, k binary, w binary"


def fit(trusted: DataFrame) -> tuple[DataFrame, float]:
    """The interpolated modified Kneser-Ney trigram model of the texts as packed keys and values by bucket, and the log10 probability of an unknown word.

    The log10 probability of a text is the sum of the model's values over its one-, two- and three-word keys:
    each key holds what it adds to the estimate of the next lower order, plus its own back-off weight. A first pass over the
    texts counts, a second one makes the model in PARTS, by the middle word of a trigram: its context and its bigram are then of one part.
    Trigrams go to the bucket of their first two words for the context's weight, then to that of their last two for the bigram's estimate.
    """
    spark = trusted.sparkSession
    size = _bytes(trusted)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // BUCKET_BYTES))
    parts = _pieces(size, PARTS)
    written = _counted(trusted, buckets, parts, _pieces(size, COUNT_PARTS))
    counted = reduce(DataFrame.union, written)
    found = {(r["kind"], r["word"]): r["n"] for r in counted.where("kind > 1").groupBy("kind", "word").agg(F.sum("uses").alias("n")).collect()}
    d3, d2 = (_discounts({k: found.get((kind, k), 0) for k in (1, 2, 3, 4)}) for kind in (3, 2))
    sums = counted.where("kind = 1").groupBy("word").agg(*[F.sum(x).alias(x) for x in ("uses", "total", "n1", "n2", "n3")])
    words = stored(sums, "words", lean=True)
    d1 = _discounts({r["uses"]: r["n"] for r in words.where("uses between 1 and 4").groupBy("uses").agg(F.count("*").alias("n")).collect()})
    cut1 = F.when(F.col("uses") == 1, d1[0]).when(F.col("uses") == 2, d1[1]).otherwise(d1[2])
    whole = words.where("uses > 0").agg(F.sum("uses").cast("double"), F.sum(cut1), F.count("*")).first()
    total, left, known = whole[0] or 1.0, whole[1] or 1.0, whole[2]
    unknown = left / total / (known + 1)
    facts = words.select(
        "word", F.when(F.col("uses") > 0, (F.col("uses") - cut1) / total + unknown).alias("p1"), F.col("total").cast("double").alias("total"),
        (F.col("n1") * d2[0] + F.col("n2") * d2[1] + F.col("n3") * d2[2]).alias("left"),
    )
    model = Bucketed(spark, "model", "bucket", buckets)

    def add(rows: DataFrame) -> None:
        model.add(rows.withColumn("buckets", F.lit(buckets)))

    def single(batches):
        for b in batches:
            k, w = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            used, cols = _dealt(_bucket(k, buckets), [k, w])
            yield pa.RecordBatch.from_arrays([pa.array(used), *cols], names=["bucket", "k", "w"])

    def pack(t: pa.Table) -> pa.Table:
        return _packed_rows(t.column("bucket")[0].as_py(), _column(t, "k"), _column(t, "w", np.float64))

    value = F.coalesce(F.log10("p1"), F.lit(0.0)) + F.when(F.col("total") > 0, F.log10(F.col("left") / F.col("total"))).otherwise(0.0)
    add(facts.select("word", value.alias("w")).mapInArrow(single, "bucket int, k binary, w binary").groupBy("bucket").applyInArrow(pack, MODEL_SCHEMA))

    def weigh(t: pa.Table) -> pa.Table:
        u, v, w, key, c = _distinct(t)
        pairs, of = np.unique(pair_key(u, v), return_inverse=True)
        cut = _cut_of(c, d3)
        total, left = np.bincount(of, weights=c), np.bincount(of, weights=cut)
        used, cols = _dealt(_bucket(pair_key(v, w), buckets), [key, (c - cut) / left[of], v, w, np.minimum(c, 1 << 31).astype(np.uint32)])
        apart = (total > 1) | (pairs == pair_key(np.array([START]), np.array([START]))[0])  # what a context seen once weighs is known where its bigram is
        pairs, left, total = pairs[apart], left[apart], total[apart]
        at, contexts = _dealt(_bucket(pairs, buckets), [pairs, np.log10(left / total)])
        none = pa.nulls(len(at), pa.binary())
        return pa.table([pa.array(np.concatenate([used, at])), *[pa.concat_arrays([a, b]) for a, b in zip(cols, [*contexts, none, none, none], strict=True)]], names=["bucket", "k", "x", "v", "w", "c"])

    def join(t: pa.Table, known: pa.Table) -> pa.Table:
        if not t.num_rows:
            return pa.table({"bucket": pa.array([], pa.int32()), "n": pa.array([], pa.int64()), "k": pa.array([], pa.binary()), "w": pa.array([], pa.binary())})
        context = pc.is_null(t.column("v"))
        tri, ctx = t.filter(pc.invert(context)), t.filter(context)
        key, x, v, w, c = _column(tri, "k"), _column(tri, "x", np.float64), _column(tri, "v"), _column(tri, "w"), _column(tri, "c", np.uint32)
        pairs, at, of = np.unique(pair_key(v, w), return_index=True, return_inverse=True)
        c2 = np.bincount(of, weights=np.where(v == START, c, 1), minlength=len(pairs)).astype(np.int64)
        once = (np.bincount(of, weights=c, minlength=len(pairs)) == 1) & (w[at] != END)
        word = known.column("word").to_numpy().view(np.uint64)
        order = np.argsort(word)
        p1, left, total = (known.column(n).to_numpy()[order] for n in ("p1", "left", "total"))
        a, b = (np.searchsorted(word[order], y[at]) for y in (v, w))
        low = left[a] / total[a] * p1[b]
        p2 = (c2 - _cut_of(c2, d2)) / total[a] + low
        keys = np.concatenate([pairs, key, _column(ctx, "k")])
        values = np.concatenate([np.log10(p2 / low) + np.where(once, np.log10(d3[0]), 0.0), np.log10(x / p2[of] + 1), _column(ctx, "x", np.float64)])
        return _packed_rows(t.column("bucket")[0].as_py(), keys, values)

    for part in range(parts):
        trigrams = _dealt_trigrams(trusted, buckets, part, parts, False).applyInArrow(weigh, "bucket int, k binary, x binary, v binary, w binary, c binary")
        known = counted.where((F.col("kind") == 1) & (F.col("part") == part)).select("bucket", "word").join(facts, "word")
        add(trigrams.groupBy("bucket").cogroup(known.groupBy("bucket")).applyInArrow(join, MODEL_SCHEMA))
        for counts in written:
            discard(counts, f"/kind=1/part={part}")
    for counts in (*written, words):
        discard(counts)
    return model.read(), float(np.log10(unknown))


def _text_key(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"], F.lit("")))


def _looked_up(model: DataFrame, unknown: float, names: tuple[str, str]) -> Callable[[DataFrame], DataFrame]:
    """``scorer`` for a model small enough to be sent to all tasks."""
    keys, values = _unpacked(model.select("k", "w").toArrow())
    sent = model.sparkSession.sparkContext.broadcast(Lookup(keys, values.astype(np.float32)))

    def score(docs: DataFrame) -> DataFrame:
        at = docs.columns.index("text")
        schema = docs.withColumns({names[0]: F.lit(0).cast("long"), names[1]: F.lit(0).cast("double")}).schema

        def run(batches):
            known = sent.value
            for b in batches:
                texts = [x or b"" for x in b.column(at).cast(pa.binary()).to_pylist()]
                sums, sizes = np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
                for i, j in in_blocks(texts, BLOCK_BYTES):
                    for keys, _, of, one in _occurrences(texts[i:j]):
                        sums[i:j] += np.bincount(of, weights=_values(known, keys, one, unknown), minlength=j - i)
                        if one:
                            sizes[i:j] = np.bincount(of[keys != START], minlength=j - i)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(sizes), pa.array(sums)], schema=pa.schema([*b.schema, (names[0], pa.int64()), (names[1], pa.float64())]))

        return docs.mapInArrow(run, schema)

    return score


def _values(known: Lookup, keys: np.ndarray, one: bool, unknown: float) -> np.ndarray:
    if not one:
        return known.get(keys, 0.0)
    # a start is never predicted, so it is never an unknown word
    return np.where(keys == START, known.get(keys, 0.0), known.get(keys, unknown))


def _occurrences(texts: list[bytes]):
    """One-, two- and three-word keys of a block of texts: the keys, those whose bucket they are in, the text of each, and whether they are single words."""
    seq, doc, _ = padded(texts)
    two, three = doc[1:] == doc[:-1], doc[2:] == doc[:-2]
    one, pairs = seq[1:][two], pair_key(seq[:-1], seq[1:])
    yield one, one, doc[1:][two], True  # the first start is a context of pairs only
    yield pairs[two], pairs[two], doc[1:][two], False
    yield pair_key(seq[:-2], seq[1:-1], seq[2:])[three], pairs[1:][three], doc[2:][three], False


def _dealt_keys(rows: DataFrame, buckets: int) -> DataFrame:
    """The keys of texts in packed rows: for a bucket the keys of its texts in turn, the texts' names and how many keys each has."""

    def run(batches):
        for b in batches:
            texts, names = binary_column(b, "_t"), b.column(0).to_numpy()
            if len(texts) == 0:
                continue
            found = {True: [], False: []}
            for i, j in in_blocks(texts, BLOCK_BYTES):
                for keys, at, of, one in _occurrences(texts[i:j]):
                    found[one].append((keys, at, (of + i).astype(np.uint16 if len(texts) < 1 << 16 else np.int64)))
            for one, parts in found.items():
                keys, at, of = (np.concatenate(x) for x in zip(*parts, strict=True))
                bucket = _bucket(at, buckets).astype(np.uint16 if buckets < 1 << 16 else np.int64)
                order = np.argsort(of, kind="stable")
                order = order[np.argsort(bucket[order], kind="stable")]
                keys, of, bucket = keys[order], of[order], bucket[order]
                first = np.flatnonzero(np.concatenate([[True], (of[1:] != of[:-1]) | (bucket[1:] != bucket[:-1])]))
                used, cols = _dealt(bucket, [keys])
                cols += _dealt(bucket[first], [names[of[first]], np.diff(first, append=len(of)).astype(np.uint32)])[1]
                yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(np.full(len(used), one)), *cols], names=["bucket", "one", "keys", "names", "sizes"])

    return rows.mapInArrow(run, "bucket int, one boolean, keys binary, names binary, sizes binary")


def _met(docs: DataFrame, model: DataFrame, unknown: float, names: tuple[str, str]) -> Callable[[DataFrame], DataFrame]:
    """``scorer`` for a model of any size: the keys of all texts go to the model's buckets, one slice of the texts after the other.

    A bucket's sums by text travel in packed rows, as a text has keys in most buckets. Equal texts are summed together and share the sums: each has one end.
    """
    buckets = model.select("buckets").first()[0]

    def look_up(t: pa.Table, part: pa.Table) -> pa.Table:
        known = Lookup(*_unpacked(part))
        found = []
        for one in (True, False):
            rows = t.filter(pc.equal(t.column("one"), one))
            keys, sizes = _column(rows, "keys"), _column(rows, "sizes", np.uint32).astype(np.int64)
            if not len(keys):
                continue
            at = np.cumsum(sizes) - sizes
            ends, n = ((np.add.reduceat(x.astype(np.int64), at) if one else np.zeros(len(at), np.int64)) for x in (keys == END, keys != START))
            found.append((_column(rows, "names", np.int64), ends, n, np.add.reduceat(_values(known, keys, one, unknown), at)))
        found = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.empty(0, np.int64)] * 4
        text, sums = added(*found)
        used, cols = _dealt(_bucket(text.view(np.uint64), buckets), [text, *sums])
        return pa.table([pa.array(used), *cols], names=["of", "text", "ends", "n", "p"])

    def added(text: np.ndarray, *parts: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        text, of = np.unique(text, return_inverse=True)
        return text, [np.bincount(of, weights=x, minlength=len(text)) for x in parts]

    def add_up(t: pa.Table) -> pa.Table:
        text, (ends, n, p) = added(_column(t, "text", np.int64), *(_column(t, x, np.float64) for x in ("ends", "n", "p")))
        return pa.table([pa.array(text), pa.array((n / ends).round().astype(np.int64)), pa.array(p / ends)], names=[key, *names])

    plain = docs.select(_text_key(docs).alias("_th"), F.col("text").cast("binary").alias("_t"))
    key = _fresh(docs, "text_key")[0]
    parts = []
    slices = _pieces(_bytes(docs), SLICES)
    for i in range(slices):
        dealt = _dealt_keys(plain.where(F.pmod("_th", F.lit(slices)) == i), buckets)
        met = dealt.groupBy("bucket").cogroup(model.groupBy("bucket")).applyInArrow(look_up, "of int, text binary, ends binary, n binary, p binary")
        sums = met.groupBy("of").applyInArrow(add_up, f"`{key}` long, `{names[0]}` long, `{names[1]}` double")
        parts.append(stored(sums, "log-probabilities", lean=True))
    sums = reduce(DataFrame.union, parts)
    return lambda rows: rows.withColumn(key, _text_key(rows)).join(sums, key, "left").select(*rows.columns, *names)


def scorer(docs: DataFrame, model: DataFrame, unknown: float, names: tuple[str, str], shard_rows: int = SHARD_ROWS) -> Callable[[DataFrame], DataFrame]:
    """What adds two columns to rows of ``docs``: the tokens (words and one end) of ``text`` and its log10 probability.

    A model of at most ``shard_rows`` rows is sent to all tasks. A larger one meets the texts' keys bucket by bucket, so
    that nothing of it passes through the driver and the work grows with the texts.
    """
    if (model.agg(F.sum("n")).first()[0] or 0) <= shard_rows:
        return _looked_up(model, unknown, names)
    return _met(docs, model, unknown, names)


def with_log_probability(docs: DataFrame, model: DataFrame, unknown: float, names: tuple[str, str], shard_rows: int = SHARD_ROWS) -> DataFrame:
    """``docs`` with the columns of ``scorer``."""
    return scorer(docs, model, unknown, names, shard_rows)(docs)


def split_trusted(docs: DataFrame, labels: DataFrame, fit_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Of the documents that ``labels`` calls good: those to fit on, and those held out for the thresholds.

    By a hash of the id two in three are fitted on and one in three is held out: each serves for the counts or for
    the thresholds, none is left out. With ``fit_bytes`` only as large a share of each language's two in three is
    fitted on as makes its part of it, which is even but for languages that have less; what those leave goes to the others. Texts are not shuffled for it: the keys are joined, then the chosen ones looked up.
    """
    good = labels.where("quality = 1").select("doc_id").distinct()
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(3_000_000))
    keys = docs.where("text is not null").select("doc_id", "lang", F.octet_length("text").alias("n"), draw.alias("draw"))
    keys = stored(keys.join(good, "doc_id", "left_semi"), "trusted")
    held = docs.join(stored(keys.where("draw < 1000000").select("doc_id").distinct(), "held"), "doc_id", "left_semi")
    if fit_bytes is None:
        return docs.join(stored(keys.where("draw >= 1000000").select("doc_id").distinct(), "fit"), "doc_id", "left_semi"), held
    sizes = keys.where("draw >= 1000000").groupBy("lang").agg(F.sum("n").alias("n"))
    # languages with less than an even part leave the rest to the others: a level up to which each is filled
    order = Window.orderBy("n", "lang")
    so_far = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.row_number().over(order)
    level = (F.lit(float(fit_bytes)) - so_far) / (F.count("*").over(Window.partitionBy()) - place + 1)
    level = sizes.select("n", place.alias("place"), level.alias("level")).where("level <= n").agg(F.min_by("level", "place")).first()[0]
    share = sizes.select("lang", (F.lit(1.0) if level is None else F.least(F.lit(1.0), F.lit(level) / F.col("n"))).alias("share"))
    langs = sizes.count()
    drawn = keys.alias("k").join(F.broadcast(share).alias("s") if langs <= 1000 else share.alias("s"), F.col("k.lang").eqNullSafe(F.col("s.lang")))
    drawn = drawn.where((F.col("draw") >= 1_000_000) & (F.col("draw") - 1_000_000 < F.col("share") * 2_000_000)).select("doc_id")
    picked = stored(drawn.distinct(), "fit")
    return docs.join(picked, "doc_id", "left_semi"), held


def _fresh(docs: DataFrame, *names: str) -> list[str]:
    taken = {c.lower() for c in docs.columns}
    out = []
    for n in names:
        while n in taken:
            n = "_" + n
        taken.add(n)
        out.append(n)
    return out


def classify(docs: DataFrame, labels: DataFrame, fit_bytes: int | None = None, quantile: float = QUANTILE, margin: float = MARGIN, shard_rows: int = SHARD_ROWS) -> tuple[DataFrame, list[str]]:
    """``docs`` with five more columns, and their names: tokens, log10 probability, perplexity, threshold, keep.

    A language's threshold is the ``quantile`` of the perplexities of its held-out trusted documents, or of all
    of them for a language that has none. A document is kept if its perplexity is at most the threshold times
    10 to the power margin / sqrt(tokens), as the mean over few tokens varies; without any trusted document all
    are kept. Null and empty texts consist of their end alone. A null language is one of its own. Repeated rows
    each get the same result.
    """
    to_fit, held = split_trusted(docs, labels, fit_bytes)
    model, unknown = fit(to_fit)
    names = _fresh(docs, "n_tokens", "log10_prob", "perplexity", "threshold", "keep", "cut_lang")
    size, prob, perplexity, threshold, keep, key = names

    score = scorer(docs, model, unknown, (size, prob), shard_rows)
    drop_bucketed(model)

    def scored(rows: DataFrame) -> DataFrame:
        return score(rows).withColumn(perplexity, F.pow(F.lit(10.0), -F.col(prob) / F.col(size)))

    trusted = stored(scored(held.select("lang", "text")).select("lang", perplexity), "trusted-scores")
    of_lang = trusted.groupBy(F.col("lang").alias(key)).agg(F.percentile_approx(perplexity, quantile, 10_000).alias(threshold))
    overall = trusted.agg(F.percentile_approx(perplexity, quantile, 10_000)).first()[0]
    out = scored(docs).join(of_lang, F.col("lang").eqNullSafe(F.col(key)), "left").drop(key)
    out = out.withColumn(threshold, F.coalesce(threshold, F.lit(overall).cast("double")))
    limit = F.col(threshold) * F.pow(F.lit(10.0), margin / F.sqrt(size))
    return out.withColumn(keep, F.coalesce(F.col(perplexity) <= limit, F.lit(True))), names[:5]


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity, its language's threshold and whether it is kept."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    return classify(docs, table(spark, sf_dir, "labels"))[0].drop("text")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the classifier keeps."""
    key = _fresh(docs, "text_key")[0]
    out, names = classify(docs.select("doc_id", "lang", "text", _text_key(docs).alias("_th")), table(spark, sf_dir, "labels"))
    lost = out.where(~F.col(names[-1])).select("doc_id", "lang", "_th").distinct()
    lost = stored(lost, "lost")
    keyed = docs.withColumn(key, _text_key(docs))
    same = keyed["doc_id"].eqNullSafe(lost["doc_id"]) & keyed["lang"].eqNullSafe(lost["lang"]) & (keyed[key] == lost["_th"])
    return keyed.join(small(lost), same, "left_anti").select(*docs.columns)
