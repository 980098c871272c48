"""WARC archives: written as text files, read back by verifying the chain of record boundaries."""

from __future__ import annotations

import re

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import shared_path, stored, table

MAGIC = "WARC/1.0\r\n"
#: Payloads of fewer bytes are stored again rather than referred to.
LEAST_REVISIT = 100
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_LENGTH = re.compile(rb"(?:^|\r\n)Content-Length:[ \t]*(\d{1,18})[ \t]*(?:\r\n|$)", re.I)


def _urn(column: str):
    return F.concat(F.lit("<urn:page:"), F.coalesce(F.col(column).cast("string"), F.lit("")), F.lit(">"))


def write_archives(pages: DataFrame, path: str, least: int = LEAST_REVISIT) -> None:
    """One record per row of ``pages`` (``page_id``, ``url``, ``html``), in files under ``path``.

    Of the rows whose payloads are equal and have ``least`` bytes or more, those with the smallest page_id are
    responses, the others revisits without a payload that refer to it. A null html is an empty payload; a null
    page_id is never the smallest, and rows without any other are responses. Payloads are not shuffled unless
    the table of repeated digests is too large to send to all tasks.
    """
    rows = pages.select("page_id", F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20").alias("url"), F.coalesce("html", F.lit("")).alias("body"))
    rows = rows.withColumn("digest", F.sha2(F.col("body").cast("binary"), 256))
    keys = rows.where(F.octet_length("body") >= least).groupBy("digest")
    first = stored(keys.agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"), "repeats")
    rows = rows.join(first, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    block = F.concat(F.lit(_HTTP), F.when(revisit, "").otherwise(F.col("body")))
    record = F.concat(
        F.lit(MAGIC + "WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), _urn("page_id"),
        F.when(F.col("url").isNull(), "").otherwise(F.concat(F.lit("\r\nWARC-Target-URI: "), "url")),
        F.lit("\r\nWARC-Payload-Digest: sha256:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.0/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _urn("first")
        )).otherwise(""),
        F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "), F.octet_length(block).cast("string"),
        F.lit("\r\n\r\n"), block,
    )
    rows.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").text(path)


def _segments(spark: SparkSession, path: str) -> DataFrame:
    """What stands between one magic and the next: ``path``, ``block`` (of the split), ``value`` (bytes)."""
    lines = spark.read.option("lineSep", MAGIC).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"), F.col("value").cast("binary").alias("value")
    )


def _needed(value: bytes) -> int | None:
    """Bytes from behind the magic to behind the record, as its header says; None if that is no header."""
    end = value.find(b"\r\n\r\n")
    if end < 0:
        return None
    m = _LENGTH.search(value[: end + 2])
    return end + 4 + int(m[1]) + 4 if m else None


def _placed(batches):
    """Per batch of segments its rows ``(path, block, at, value)``; ``at`` counts bytes from the split's first segment."""
    here, at = None, 0
    for b in batches:
        rows = []
        for path, block, value in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if here != (path, block):
                here, at = (path, block), 0
            rows.append((path, block, at, value))
            at += len(value) + len(MAGIC)
        yield rows


def _batch(rows: list[tuple], kinds: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) if rows else [()] * len(kinds)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, kinds, strict=True)], names=[n for n, _ in kinds])


_PLACE = [("path", pa.string()), ("block", pa.int64()), ("at", pa.int64())]


def _candidates(segments: DataFrame) -> DataFrame:
    """``path``, ``block``, ``at``, ``size``, ``needed`` of each segment: where a record may start and where it would end."""

    def run(batches):
        for rows in _placed(batches):
            out = [(p, k, at, len(v), _needed(v)) for p, k, at, v in rows]
            yield _batch(out, [*_PLACE, ("size", pa.int64()), ("needed", pa.int64())])

    return segments.mapInArrow(run, "path string, block long, at long, size long, needed long")


def _exits(rows: pd.DataFrame) -> pd.DataFrame:
    """Where the chain from each candidate of a split first leaves the split; no row for a chain that breaks."""
    rows = rows.sort_values("off")
    off, nxt = rows["off"].tolist(), rows["next"].tolist()
    end = rows["split_end"].iloc[0] if len(rows) else 0
    out: dict[int, int] = {}
    for o, n in zip(reversed(off), reversed(nxt), strict=True):
        if n != n:
            continue
        if n >= end:
            out[o] = int(n)
        elif n in out:
            out[o] = out[n]
    keys = list(out)
    return pd.DataFrame({"path": rows["path"].iloc[0] if len(rows) else "", "off": pd.Series(keys, dtype="int64"), "nxt": pd.Series([out[k] for k in keys], dtype="int64")})


def _marks(rows: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a split that lie on the chain from its entry."""
    rows = rows.sort_values("off").reset_index(drop=True)
    nxt = dict(zip(rows["off"].tolist(), rows["next"].tolist(), strict=True))
    reached = set()
    for o in rows.loc[rows["entry"], "off"].tolist():
        while o in nxt and o not in reached:
            reached.add(o)
            o = nxt[o]
    rows["reached"] = rows["off"].isin(reached)
    rows["owner"] = rows["off"].where(rows["reached"]).ffill()
    return rows[["path", "block", "at", "off", "size", "next", "reached", "owner"]]


def record_marks(candidates: DataFrame) -> DataFrame:
    """``candidates`` with their offset in the file, whether the file's chain of records reaches them, and the record they lie in.

    A chain starts at the file's first byte and steps from a record to the one that its length names. Tasks
    follow it within splits; pointers from split to split are then doubled until no more entries are reached.
    """
    sums = candidates.groupBy("path", "block").agg(F.sum(F.col("size") + len(MAGIC)).alias("bytes"))
    splits = stored(sums.selectExpr(
        "path", "block", "bytes", "coalesce(sum(bytes) over (partition by path order by block rows between unbounded preceding and 1 preceding), 0) base"
    ), "splits")
    off = F.col("base") + F.col("at") - len(MAGIC)
    # the text before a file's first magic is no candidate; it has the offset minus ten
    placed = candidates.join(splits, ["path", "block"]).select(
        "path", "block", "at", "size", off.alias("off"), (off + len(MAGIC) + F.col("needed")).cast("double").alias("next"),
        (F.col("base") + F.col("bytes") - len(MAGIC)).alias("split_end"),
    )
    placed = stored(placed, "candidates")
    hops = placed.where("off >= 0").groupBy("path", "block").applyInPandas(_exits, "path string, off long, nxt long")
    hops = stored(hops, "hops")
    starts = placed.where("off = 0").select("path", "off")
    # only a file's start and what some chain enters a split by can matter
    entered = hops.select("path", F.col("nxt").alias("off")).union(starts).distinct()
    jumps = stored(hops.join(entered, ["path", "off"], "left_semi"), "jumps")
    reached = stored(starts.distinct(), "reached")
    known = -1
    while (now := reached.count()) != known:
        known = now
        onward = reached.join(jumps, ["path", "off"]).select("path", F.col("nxt").alias("off"))
        reached = stored(reached.union(onward).distinct(), "reached")
        further = jumps.withColumnRenamed("off", "first").withColumnRenamed("nxt", "off").join(jumps, ["path", "off"])
        jumps = stored(further.select("path", F.col("first").alias("off"), "nxt"), "jumps")
    entries = reached.withColumn("entry", F.lit(True))
    flagged = placed.join(entries, ["path", "off"], "left").withColumn("entry", F.coalesce("entry", F.lit(False)))
    marks = flagged.groupBy("path", "block").applyInPandas(
        _marks, "path string, block long, at long, off long, size long, next double, reached boolean, owner double"
    )
    marks = stored(marks, "marks")
    # a record that runs on into later splits owns the segments that stand there before the first record
    last = marks.groupBy("path", "block").agg(F.max("owner").alias("last"))
    carried = last.selectExpr("path", "block", "max(last) over (partition by path order by block rows between unbounded preceding and 1 preceding) carried")
    marks = marks.join(carried, ["path", "block"]).withColumn("owner", F.coalesce("owner", "carried")).drop("carried")
    ends = marks.where("reached").select("path", F.col("off").cast("double").alias("owner"), F.col("next").alias("owner_end"))
    return marks.join(ends, ["path", "owner"], "left")


_HEADERS = [("page_id", pa.string()), ("record_type", pa.string()), ("refers_to", pa.string()), ("declared_digest", pa.string()), ("url", pa.string())]
_HEADER_SCHEMA = ", ".join(f"{n} string" for n, _ in _HEADERS)
_BODY = [("body_at", pa.int64()), ("body_size", pa.int64()), ("value", pa.binary())]
_URN = re.compile(r"<urn:page:(.*)>")


def parse_record(value: bytes) -> tuple:
    """The header fields of a record without its magic, where its payload starts (from 1), its size and ``value``; no size where it is cut off."""
    needed = _needed(value)
    if needed is None or len(value) < needed - 4:
        return (None,) * 7 + (value,)
    end = value.find(b"\r\n\r\n")
    fields = {}
    for line in value[:end].decode("utf-8", "replace").split("\r\n"):
        name, _, text = line.partition(":")
        fields[name.strip().lower()] = text.strip()
    urn = lambda x: (m[1] or None) if (m := _URN.fullmatch(fields.get(x, ""))) else None
    http = value.find(b"\r\n\r\n", end + 4, needed - 4)
    body = http + 4 if http >= 0 else needed - 4
    return (
        urn("warc-record-id"), fields.get("warc-type"), urn("warc-refers-to"), fields.get("warc-payload-digest", "").removeprefix("sha256:"),
        fields.get("warc-target-uri"), body + 1, needed - 4 - body, value,
    )


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of all archives under ``path``: ``page_id``, ``record_type``, ``refers_to``, ``declared_digest`` (all text), ``url``, ``payload`` (bytes).

    Only records on their file's chain of boundaries count; a magic inside a payload is part of the payload,
    also where a split of the file ends inside it. Records behind a damaged one are not returned.
    """
    marks = stored(record_marks(_candidates(_segments(spark, path))), "record-marks")
    odd = marks.where("not reached or next is null or size < next - off - 10 or off < 0")
    odd = odd.where("off >= 0").select("path", "block", "at", "off", "owner", "owner_end").union(
        marks.where("off < 0").select("path", "block", "at", "off", F.lit(None).cast("double"), F.lit(None).cast("double"))
    )

    def place(batches):
        for rows in _placed(batches):
            yield _batch([(p, k, at, *parse_record(v)) for p, k, at, v in rows], [*_PLACE, *_HEADERS, *_BODY])

    body = f"{_HEADER_SCHEMA}, body_at long, body_size long, value binary"
    pieces = _segments(spark, path).mapInArrow(place, f"path string, block long, at long, {body}")
    pieces = pieces.join(stored(odd, "odd").withColumn("odd", F.lit(True)), ["path", "block", "at"], "left")
    # parts of one record: those of its segments that start before its end, in order
    parts = pieces.where("odd and off < owner_end").groupBy("path", "owner").agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("p"))
    joined = parts.select(F.expr(f"reduce(transform(p, x -> x.value), cast(null as binary), (a, b) -> if(a is null, b, concat(a, X'{MAGIC.encode().hex()}', b)))").alias("value"))

    def parse(batches):
        for b in batches:
            yield _batch([parse_record(v) for v in b.column(0).to_pylist()], [*_HEADERS, *_BODY])

    names = [n for n, _ in _HEADERS + _BODY]
    whole = pieces.where("odd is null").select(*names).union(joined.mapInArrow(parse, body)).where("body_size is not null")
    return whole.select(*names[:5], F.expr("substring(value, cast(body_at as int), cast(body_size as int))").alias("payload"))


def archived_pages(spark: SparkSession, path: str) -> DataFrame:
    """Per record its full payload's size and digest: a revisit's are those of the response it refers to."""
    records = read_archives(spark, path).select(
        "page_id", "record_type", "refers_to", "declared_digest",
        F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha"),
    )
    records = stored(records, "records")
    responses = records.where("record_type = 'response'").select(
        F.col("page_id").alias("refers_to"), F.col("sha").alias("declared_digest"), F.col("n").alias("full")
    ).distinct()
    wanted = records.where("record_type = 'revisit'").select("refers_to", "declared_digest").distinct()
    referred = responses.join(wanted, ["refers_to", "declared_digest"], "left_semi")
    out = records.join(referred, ["refers_to", "declared_digest"], "left")
    return out.select(
        "page_id", F.when(F.col("record_type") == "revisit", F.col("full")).otherwise(F.col("n")).alias("payload_bytes"),
        F.when(F.col("record_type") == "revisit", F.col("declared_digest")).otherwise(F.col("sha")).alias("payload_digest"), "record_type", "refers_to",
    )


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to an archive and read back."""
    pages = table(spark, sf_dir, "pages")
    path = shared_path(spark, "archives")
    write_archives(pages, path)
    kind = pages.schema["page_id"].dataType.simpleString()
    out = archived_pages(spark, path)
    return out.withColumns({c: F.col(c).cast(kind) for c in ("page_id", "refers_to")})


OP4_SQL = f"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS body FROM pages),
d AS (SELECT page_id, octet_length(body) AS n, sha256(body) AS digest FROM p),
f AS (SELECT digest, min(page_id) AS first_id FROM d WHERE n >= {LEAST_REVISIT} GROUP BY digest)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.digest AS payload_digest,
  CASE WHEN f.first_id IS NULL OR d.page_id = f.first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f.first_id IS NULL OR d.page_id = f.first_id THEN NULL ELSE f.first_id END AS refers_to
FROM d LEFT JOIN f USING (digest)
"""
