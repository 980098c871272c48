"""Benchmark decontamination in DataFrame operations: SimHash windows, Hamming blocks, weighted shingles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import small, stored, table

SHINGLE, SIMILARITY = 5, 0.8
#: Windows as similar as that differ from their item in ten bits on average, three more or fewer as a rule.
RADIUS, BLOCKS = 20, 7
BITS = 64
#: Counters of two bits share a long: bit j and bit 32 + j. A text has fewer words than a counter can hold.
_HALF = 32
_LANES = 1 << _HALF | 1


def _words(text: str = "text") -> Column:
    return F.array_remove(F.split(F.lower(text), r"[\x20\x09-\x0D]+"), "")


def _shingles(words: str, k: int) -> Column:
    return F.expr(f"CASE WHEN size({words}) >= {k} THEN transform(sequence(1, size({words}) - {k} + 1), i -> xxhash64(slice({words}, i, {k}))) END")


def _text_key(text: str = "text") -> list[Column]:
    """128 bits that stand for a text."""
    return [F.xxhash64(text).alias("_a"), F.xxhash64(F.lit(1), F.col(text)).alias("_b")]


def _shingles_of(words: str, most: int) -> Column:
    """Shingles of column ``k`` words each."""
    return F.coalesce(*(F.when(F.col("k") == k, _shingles(words, k)) for k in range(1, most + 1)))


def benchmark_items(benchmark: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``item_id``, ``size`` (words), ``k`` (words of a shingle: all of them for shorter items), ``sh`` (hashes in order). Items without words are left out."""
    items = benchmark.select("item_id", _words().alias("_w")).where("size(_w) > 0").withColumn("k", F.least(F.size("_w"), F.lit(shingle)))
    return items.select("item_id", F.size("_w").alias("size"), "k", _shingles_of("_w", shingle).alias("sh")).distinct()


def _lanes(h: str) -> list[Column]:
    return [F.shiftrightunsigned(h, j).bitwiseAND(F.lit(_LANES)) for j in range(_HALF)]


def _majority(sums: list[Column], n: Column) -> Column:
    """The fingerprint: a bit is 1 if it is set in over half of ``n`` hashes."""
    fp = F.lit(0).cast("long")
    for b in range(BITS):
        ones = F.shiftrightunsigned(sums[b % _HALF], _HALF * (b // _HALF)).bitwiseAND(F.lit((1 << _HALF) - 1))
        fp = fp.bitwiseOR(F.when(ones * 2 > n, F.lit((1 << b) - (1 << 64 if b == 63 else 0)).cast("long")).otherwise(F.lit(0).cast("long")))
    return fp


def item_fingerprints(places: DataFrame) -> DataFrame:
    """``item``, ``size``, ``w`` (shingles), ``item_fp``: SimHash of an item's shingles ``h``, repeats included."""
    counted = places.groupBy("item", "size").agg(F.count("*").alias("w"), *(F.sum(c).alias(f"s{j}") for j, c in enumerate(_lanes("h"))))
    return counted.select("item", "size", "w", _majority([F.col(f"s{j}") for j in range(_HALF)], F.col("w")).alias("item_fp"))


_REGION = ["_a", "_b", "size", "k", "n", "begin"]


def window_fingerprints(rows: DataFrame) -> DataFrame:
    """SimHash of all windows of regions: ``rows`` has the shingles ``h`` of a region at ``q`` = 0, 1, ..., its window size and its last start ``to``.

    Running sums count the bits up to every place, so a window's counts are what its end has more than its
    start: the shingle that enters and the one that leaves. Adds ``e``, the last shingle of the window at ``q``.
    """
    so_far = Window.partitionBy(*_REGION).orderBy("q").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = stored(rows.select(*_REGION, "to", "q", "h", *(F.sum(c).over(so_far).alias(f"s{j}") for j, c in enumerate(_lanes("h")))), "running-sums")
    last = F.least(F.col("q") + F.col("size") - F.col("k"), F.col("n") - F.col("k") - F.col("begin"))
    before = [(F.col(f"s{j}") - c).alias(f"x{j}") for j, c in enumerate(_lanes("h"))]
    starts = sums.where(F.col("begin") + F.col("q") <= F.col("to")).select(*_REGION, "q", last.alias("e"), *before)
    ends = sums.select(*_REGION, F.col("q").alias("e"), *(f"s{j}" for j in range(_HALF)))
    both = starts.join(ends, [*_REGION, "e"])
    fp = _majority([F.col(f"s{j}") - F.col(f"x{j}") for j in range(_HALF)], F.col("e") - F.col("q") + 1)
    return both.select(*_REGION, "q", "e", fp.alias("fp"))


def _edges(blocks: int) -> list[tuple[int, int]]:
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def _block_values(fp: str, blocks: int) -> Column:
    return F.array(*(
        F.struct(F.lit(i).alias("block"), F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1).cast("long")).alias("value"))
        for i, (a, z) in enumerate(_edges(blocks))
    ))


def _flipped(block: int, value: Column):
    return lambda m: F.struct(F.lit(block).alias("block"), value.bitwiseXOR(m).alias("value"))


def _near_values(fp: str, radius: int, blocks: int) -> Column:
    """All block values within the bits that the radius leaves to one block: of the blocks of two fingerprints within it, one is that close."""
    near = radius // blocks
    parts = []
    for i, (a, z) in enumerate(_edges(blocks)):
        masks = [0]
        for flips in range(1, near + 1):
            masks += [m for m in range(1 << (z - a)) if m.bit_count() == flips]
        value = F.shiftrightunsigned(fp, a).bitwiseAND(F.lit((1 << (z - a)) - 1).cast("long"))
        parts.append(F.transform(F.array(*(F.lit(m).cast("long") for m in masks)), _flipped(i, value)))
    return F.flatten(F.array(*parts))


def _regions(marks: DataFrame) -> DataFrame:
    """Ranges of window starts ``begin`` to ``to`` by text and window size: all whose windows hold a shingle of ``marks`` at least."""
    first = F.greatest(F.col("p") - (F.col("size") - F.col("k")), F.lit(0))
    last = F.least(F.col("p"), F.greatest(F.col("n") - F.col("size"), F.lit(0)))
    text = ["_a", "_b", "size", "k", "n"]
    starts = marks.select(*text, "p", first.alias("first"), last.alias("last")).where("first <= last")
    order = Window.partitionBy(*text).orderBy("p")
    apart = F.coalesce(F.col("first") > F.lag("last").over(order) + 1, F.lit(True)).cast("int")
    numbered = starts.withColumn("apart", apart).withColumn("region", F.sum("apart").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*text, "region").agg(F.min("first").alias("begin"), F.max("last").alias("to")).drop("region")


def contaminated_texts(docs: DataFrame, benchmark: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """Texts (``_a``, ``_b``) with a window like a benchmark item: ``item_id``, ``start_word``, ``n_words``, ``hamming``, ``similarity`` of the best.

    Windows have an item's number of words, at every place of the text (the whole text where it is shorter). All
    are fingerprinted but those that share no shingle with any item of their size, whose similarity is zero.
    Fingerprints meet those of the items of that size through Hamming blocks, which find all within ``radius``
    bits, and weighted Jaccard similarity of the shingles (repeats count) decides.
    """
    items = stored(benchmark_items(benchmark, shingle).withColumn("item", F.monotonically_increasing_id()), "items")
    places = items.select("item", "size", "k", F.posexplode("sh").alias("q", "h"))
    weights = stored(places.groupBy("item", "size", "k", "h").agg(F.count("*").alias("c")), "item-shingles")
    wanted = stored(weights.select("k", "h").distinct(), "wanted")
    texts = docs.where("text is not null").select(*_text_key(), _words().alias("_w"))
    hits = None
    for (k,) in items.select("k").distinct().collect():  # 5 rows at most
        at = texts.select("_a", "_b", F.size("_w").alias("n"), F.posexplode(_shingles("_w", k)).alias("p", "h"))
        found = at.join(wanted.where(F.col("k") == k), "h", "left_semi").withColumn("k", F.lit(k))
        hits = found if hits is None else hits.union(found)
    if hits is None:
        hits = texts.select("_a", "_b", F.lit(0).alias("n"), F.lit(0).alias("p"), F.lit(0).cast("long").alias("h"), F.lit(0).alias("k")).where("false")
    hits = stored(hits.select("_a", "_b", "n", "p", "h", "k").distinct(), "hits")
    marks = hits.join(weights.select("k", "h", "size").distinct(), ["k", "h"]).select("_a", "_b", "n", "k", "size", "p").distinct()
    regions = stored(_regions(marks), "regions")
    some = stored(regions.select("_a", "_b").distinct(), "texts-with-regions")
    whole = stored(texts.join(small(some), ["_a", "_b"], "left_semi").dropDuplicates(["_a", "_b"]), "region-texts")
    cut = whole.join(regions, ["_a", "_b"]).select(*_REGION, "to", F.expr("slice(_w, begin + 1, to - begin + size)").alias("_v"))
    rows = stored(cut.select(*_REGION, "to", F.posexplode(_shingles_of("_v", shingle)).alias("q", "h")), "region-shingles")
    left = window_fingerprints(rows).select(*_REGION, "q", "e", "fp", F.explode(_block_values("fp", blocks)).alias("v")).select(*_REGION, "q", "e", "fp", "v.*")
    right = stored(item_fingerprints(places), "item-prints").select("item", "size", "w", "item_fp", F.explode(_near_values("item_fp", radius, blocks)).alias("v")).select("item", "size", "w", "item_fp", "v.*")
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp")))
    close = left.join(right, ["size", "block", "value"]).withColumn("hamming", distance).where(F.col("hamming") <= radius)
    close = stored(close.select(*_REGION, "q", "e", "item", "w", "hamming").distinct(), "close")
    # a window and its shingles meet in stretches of the window's size, of which it touches two at most
    stretch = F.floor(F.col("q") / F.col("size")).cast("int")
    held = rows.join(weights, ["size", "k", "h"]).select(*_REGION, "item", "h", "c", F.col("q").alias("at"), stretch.alias("stretch"))
    touched = F.explode(F.sequence(stretch, F.floor(F.col("e") / F.col("size")).cast("int"))).alias("stretch")
    met = close.select("*", touched).join(held, [*_REGION, "item", "stretch"]).where("at between q and e")
    window = [*_REGION, "q", "e", "item", "w", "hamming"]
    same = met.groupBy(*window, "h", "c").agg(F.count("*").alias("m")).groupBy(*window).agg(F.sum(F.least("m", "c")).alias("both"))
    same = same.withColumn("similarity", F.col("both") / (F.col("e") - F.col("q") + 1 + F.col("w") - F.col("both"))).where(F.col("similarity") >= similarity)
    same = same.join(items.select("item", "item_id"), "item").withColumn("s", F.col("begin") + F.col("q"))
    best = F.max_by(F.struct("s", "size", "hamming", "similarity"), F.struct("similarity", (-F.col("s")).alias("s")))
    out = same.groupBy("_a", "_b", "item_id").agg(best.alias("x"))
    return out.select("_a", "_b", "item_id", F.col("x.s").alias("start_word"), F.col("x.size").alias("n_words"), F.col("x.hamming").alias("hamming"), F.col("x.similarity").alias("similarity"))


def contaminations(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """``doc_id``, ``item_id``, ``start_word``, ``n_words``, ``hamming``, ``similarity``: every document's items with their best window.

    Null and empty texts and items have none. Repeated rows of ``docs`` each have their rows; repeated items count once.
    """
    found = stored(contaminated_texts(docs, benchmark, **options), "contaminated")
    keyed = docs.where("text is not null").select("doc_id", *_text_key())
    return keyed.join(found, ["_a", "_b"]).drop("_a", "_b")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that hold benchmark items, with the place and the similarity."""
    return contaminations(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without any benchmark item."""
    found = stored(contaminated_texts(docs, table(spark, sf_dir, "benchmark")).select("_a", "_b").distinct(), "contaminated")
    a, b = _text_key()
    names = [f"_{i}{c}" for i, c in enumerate(("a", "b"))]
    while set(names) & {c.lower() for c in docs.columns}:
        names = ["_" + n for n in names]
    keyed = docs.withColumns({names[0]: a, names[1]: b})
    match = (keyed[names[0]] == found["_a"]) & (keyed[names[1]] == found["_b"])
    return keyed.join(small(found), match, "left_anti").select(*docs.columns)

