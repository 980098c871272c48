"""Substring dedup: content-defined chunks by a gear rolling hash, deduplicated by digest."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesvec import Words, binary_column, in_blocks, mix
from .storage import small, stored, table

#: A word starts a chunk where the gear hash of the 16 bytes before it is in the lowest fifth, and after 20 words at the latest.
WORDS_PER_CHUNK, MOST_WORDS = 5, 20
#: Runs of chunks of so many words are removed where they are known as runs.
LEAST_WORDS = 12
BLOCK_BYTES = 1 << 20
_WINDOW = 16
_GEAR = (mix(np.arange(1, 257, dtype=np.uint64)) >> np.uint64(48)).astype(np.uint16)
_BASES = (0xD1342543DE82EF95, 0xAF251AF3B0F025B5)
#: A run known from more rows than this is dealt out to several tasks.
HOT_ROWS = 100_000


def gear(data: np.ndarray) -> np.ndarray:
    """The rolling hash at every byte: 16 bits, each byte shifted out after 16 more."""
    h = _GEAR[data]
    for step in (1, 2, 4, 8):
        older = np.zeros_like(h)
        older[step:] = h[:-step] << step
        h = h + older
    return h


class Sums:
    """Polynomial hashes of any range of a sequence of 64-bit values."""

    def __init__(self, values: np.ndarray, base: int):
        n = len(values)
        up, down = np.full(n + 1, base, dtype=np.uint64), np.full(n + 1, pow(base, -1, 1 << 64), dtype=np.uint64)
        up[0] = down[0] = 1
        self._down = np.multiply.accumulate(down)
        self._sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * np.multiply.accumulate(up)[:n])])

    def between(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._sums[end] - self._sums[begin]) * self._down[begin] + (end - begin).astype(np.uint64))


class Chunks:
    """The chunks of a block of texts: ``doc``, ``start`` and ``end`` (bytes of the text), ``words``, ``digest`` and ``check``, which make 128 bits."""

    def __init__(self, texts: list[bytes]):
        w = Words(texts, lower=False, gap=_WINDOW)
        n = len(w.hash)
        first = np.concatenate([[True], w.doc[1:] != w.doc[:-1]]) if n else np.zeros(0, bool)
        cut = first | (gear(w.data)[w.start - 1] < 65536 // WORDS_PER_CHUNK)
        at = np.arange(n)
        since = at - np.maximum.accumulate(np.where(cut, at, 0)) if n else at
        heads = np.flatnonzero(cut | (since % MOST_WORDS == 0)) if n else at
        tails = np.append(heads[1:], n) if n else at
        self.doc, self.words = w.doc[heads], tails - heads
        self.digest = Sums(w.hash, _BASES[0]).between(heads, tails)
        self.check = Sums(mix(w.hash), _BASES[1]).between(heads, tails)
        self.start = w.start[heads] - w.text_at[self.doc]
        lengths = np.array([len(t) for t in texts], dtype=np.int64)
        nxt = np.append(self.start[1:], 0)
        last = np.append(self.doc[1:] != self.doc[:-1], True) if len(heads) else np.zeros(0, bool)
        self.end = np.where(last, lengths[self.doc], nxt[: len(heads)])

    def runs(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """First chunk, last chunk, digest and check of the shortest runs of ``least`` words from and up to each chunk of a text.

        Any longer run is covered by those within it.
        """
        n = len(self.doc)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        total = np.concatenate([[0], np.cumsum(self.words)])
        at = np.arange(n)
        a = np.concatenate([at, np.searchsorted(total, total[1:] - least, "right") - 1])
        z = np.concatenate([np.searchsorted(total, total[:-1] + least) - 1, at])
        whole = (a >= 0) & (z < n)
        a, z = a[whole], z[whole]
        code = np.unique((a * n + z)[self.doc[a] == self.doc[z]])
        a, z = code // n, code % n
        return a, z, Sums(self.digest, _BASES[0]).between(a, z + 1), Sums(self.check, _BASES[1]).between(a, z + 1)


def run_rows(keyed: DataFrame, key: str, text_hash: str, least: int) -> DataFrame:
    """``key``, ``th``, ``digest``, ``check``: the different runs of chunks (see ``Chunks.runs``) of each row."""
    plain = keyed.select(F.col(key).alias("key"), F.col(text_hash).alias("th"), F.col("text").cast("binary").alias("_t"))

    def run(batches):
        for b in batches:
            texts = binary_column(b, "_t")
            for i, j in in_blocks(texts, BLOCK_BYTES):
                c = Chunks(texts[i:j])
                a, _, digest, check = c.runs(least)
                order = np.lexsort((check, digest, c.doc[a]))
                doc, digest, check = c.doc[a][order], digest[order], check[order]
                new = np.ones(len(doc), dtype=bool)
                new[1:] = (doc[1:] != doc[:-1]) | (digest[1:] != digest[:-1]) | (check[1:] != check[:-1])
                row = pa.array(doc[new] + i)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(row), b.column(1).take(row), pa.array(digest[new].view(np.int64)), pa.array(check[new].view(np.int64))],
                    names=["key", "th", "digest", "check"],
                )

    return plain.mapInArrow(run, plain.drop("_t").schema.add("digest", "long").add("check", "long"))


def known_runs(rows: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """``key``, ``th`` and ``held``: the digests of each row's runs that another row keeps, as it has the smaller key.

    Of rows with one key and different texts one keeps a run. Runs are told apart by 128 bits. A run of many rows
    is pre-aggregated; its rows then meet their keeper in several tasks.
    """
    run = ["digest", "check"]
    keeper = rows.groupBy(*run).agg(
        F.min("key").alias("first"), F.min_by("th", "key").alias("first_th"), F.max("key").alias("last"),
        F.min("th").alias("low"), F.max("th").alias("high"), F.count("*").alias("n"),
    )
    keeper = stored(keeper.where("first < last or low < high").select(*run, "first", "first_th", "n"), "keepers")
    parts = F.ceil(F.col("n") / hot_rows).cast("int")
    hot = stored(keeper.where(F.col("n") > hot_rows).select(*run, parts.alias("parts")), "hot-runs")
    if hot.isEmpty():
        met = rows.join(keeper, run)
    else:
        spread = F.coalesce(F.pmod(F.xxhash64("key", "th"), F.col("parts")), F.lit(0)).cast("int")
        dealt = rows.join(small(hot), run, "left").withColumn("part", spread).drop("parts")
        met = dealt.join(keeper.withColumn("part", F.explode(F.sequence(F.lit(0), parts - 1))), [*run, "part"])
    again = met.where("key <> first or th <> first_th")
    return again.groupBy("key", "th").agg(F.collect_set("digest").alias("held"))


def _spans(c: Chunks, runs: tuple[np.ndarray, ...], mine: slice, known: np.ndarray) -> list[tuple[int, int]]:
    """The byte ranges of one text to remove: its runs known as a whole from elsewhere or from before."""
    first, last, digest, _ = runs
    mine_runs = slice(*np.searchsorted(first, [mine.start, mine.stop]))
    first, last, digest = first[mine_runs] - mine.start, last[mine_runs] - mine.start, digest[mine_runs]
    if not len(digest):
        return []
    _, firsts = np.unique(digest, return_index=True)
    again = np.ones(len(digest), dtype=bool)
    again[firsts] = False
    if len(known):
        again |= np.isin(digest, known)
    size = mine.stop - mine.start
    depth = np.cumsum(np.bincount(first[again], minlength=size + 1) - np.bincount(last[again] + 1, minlength=size + 1))[:size]
    edges = np.flatnonzero(np.diff(np.concatenate([[0], (depth > 0).view(np.int8), [0]])))
    return [(int(c.start[mine][a]), int(c.end[mine][z - 1])) for a, z in edges.reshape(-1, 2).tolist()]


def deduplicated(docs: DataFrame, least: int = LEAST_WORDS) -> tuple[DataFrame, list[str]]:
    """``docs`` with ``text`` rid of repeated passages, and three more columns whose names it returns too.

    They are the ``chunks`` of the text before, how many ``removed_bytes`` it lost and which byte ``spans`` of it.
    A run of chunks of ``least`` words stays in the document with the smallest doc_id that has it, at its first
    place there; chunks known one by one from several places are no run. Of rows with one doc_id and different texts
    one keeps a run; rows equal in both stay alike. A null doc_id comes last; ids that are no whole numbers are
    ordered as text. Null and empty texts stay as they are.
    """
    taken = {c.lower() for c in docs.columns}

    def free(name: str) -> str:
        while name in taken:
            name = "_" + name
        taken.add(name)
        return name

    key, th, held, chunks, removed, spans = (free(n) for n in ("row_key", "row_hash", "runs_held", "chunks", "removed_bytes", "spans"))
    whole = isinstance(docs.schema["doc_id"].dataType, T.IntegralType)
    order = F.coalesce(F.col("doc_id").cast("long"), F.lit((1 << 63) - 1)) if whole else F.coalesce(F.col("doc_id").cast("string"), F.lit("\U0010ffff"))
    keyed = docs.withColumns({key: order, th: F.xxhash64("text")})
    known = stored(known_runs(run_rows(keyed, key, th, least)), "known")
    known = known.select(F.col("key").alias(key), F.col("th").alias(th), F.col("held").alias(held))
    joined = keyed.join(known, [key, th], "left").drop(key, th)
    names = [c for c in joined.columns if c != held]
    at, text_at = joined.columns.index(held), joined.columns.index("text")
    places = [joined.columns.index(c) for c in names]
    span = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))
    schema = T.StructType([*(joined.schema[n] for n in names), T.StructField(chunks, T.LongType()), T.StructField(removed, T.LongType()), T.StructField(spans, span)])

    def run(batches):
        for b in batches:
            raw = b.column(text_at).cast(pa.binary()).to_pylist()
            texts = [t or b"" for t in raw]
            lists = b.column(at)
            out, sizes, gone, cuts = list(raw), [], [], []
            for i, j in in_blocks(texts, BLOCK_BYTES):
                c = Chunks(texts[i:j])
                runs = c.runs(least)
                bounds = np.searchsorted(c.doc, np.arange(j - i + 1))
                for k in range(i, j):
                    mine = slice(bounds[k - i], bounds[k - i + 1])
                    got = lists[k]
                    found = np.asarray(got.values, dtype=np.int64).view(np.uint64) if got.is_valid else np.zeros(0, np.uint64)
                    s = _spans(c, runs, mine, found)
                    if s:
                        kept, last = [], 0
                        for a, z in s:
                            kept.append(texts[k][last:a])
                            last = z
                        out[k] = b"".join([*kept, texts[k][last:]])
                    sizes.append(mine.stop - mine.start)
                    gone.append(sum(z - a for a, z in s))
                    cuts.append([{"start": a, "end": z} for a, z in s])
            cols = [pa.array(out, pa.binary()).cast(b.column(text_at).type) if p == text_at else b.column(p) for p in places]
            kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(cuts, kind)], names=schema.names)

    return joined.mapInArrow(run, schema), [chunks, removed, spans]


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages that an earlier one has: ``doc_id``, ``text``, ``chunks``, ``removed_bytes``, ``spans``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs)[0]


def substring_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with repeated passages removed and ``n_chars`` brought up to date; those that had nothing else go."""
    out, names = deduplicated(docs)
    out = out.where(~((F.col(names[1]) > 0) & (F.trim("text") == "")))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(names[1]) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType))
        out = out.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return out.select(*docs.columns)
