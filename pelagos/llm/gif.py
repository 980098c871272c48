"""GIF media columns: LZW code streams, palettes, transparency and disposal, timed frames with colour histograms."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bytesvec import binary_column
from .storage import table

WIDTH, FRAME_ROWS, DELAY_CS, BINS = 64, 64, 10, 16
#: The sample that is not shown: the space.
TRANSPARENT = 32
_CLEAR, _END = 256, 257
#: Rows of an interlaced image come in these passes: first row, step.
_PASSES = ((0, 8), (4, 8), (2, 4), (1, 2))


@dataclass
class Frame:
    left: int
    top: int
    width: int
    height: int
    delay_cs: int
    disposal: int
    transparent: int  # -1: none
    palette: np.ndarray  # colours by red, green and blue
    indices: np.ndarray  # height by width


def _widths(least: int, count: int) -> np.ndarray:
    """How many bits each of the first ``count`` codes behind a clear has: the table grows by one entry a code from the second on."""
    entries = np.minimum((1 << least) + 2 + np.maximum(np.arange(count) - 1, 0), 4096)
    return least + 1 + sum((entries >= 1 << w).astype(np.int64) for w in range(least + 1, 12))


_WIDTHS_8 = _widths(8, 4096)


def lzw_codes(samples: bytes) -> list[int]:
    """The codes of 8-bit samples: each the longest entry that the table has, a clear first and where the table is full."""
    table: dict[int, int] = {}
    entry, size, full = table.setdefault, (_END + 1) << 8, 4096 << 8
    out = [_CLEAR << 8]
    put = out.append
    current, at, end = samples[0] << 8, 1, len(samples)  # codes are kept eight bits up, so that a sample goes below
    while at < end:
        room = (full - size) >> 8
        if not room:
            put(current)
            put(_CLEAR << 8)
            table.clear()
            current, size = samples[at] << 8, (_END + 1) << 8
            at += 1
            continue
        for b in samples[at : at + room]:  # each makes one entry at most
            longer = entry(current | b, size)
            if longer != size:
                current = longer
            else:
                put(current)
                current = b << 8
                size += 256
        at += room
    put(current)
    put(_END << 8)
    return [c >> 8 for c in out]


def pack_codes(codes: list[int]) -> bytes:
    """Codes of 9 to 12 bits end to end, the lowest bits first."""
    c = np.array(codes, dtype=np.int64)
    at = np.arange(len(c))
    clears = np.flatnonzero(c == _CLEAR)
    # a clear itself still has the width of the table that it ends
    since = at - clears[np.searchsorted(clears, at, side="left") - 1] - 1
    since[0] = 0
    width = _WIDTHS_8[np.minimum(since, len(_WIDTHS_8) - 1)]
    ends = np.cumsum(width)
    begin = ends - width
    bits, byte = c << (begin & 7), begin >> 3
    size = int(ends[-1] + 7) // 8
    # no two codes share a bit, so sums put them together
    out = sum(np.bincount(byte + i, weights=(bits >> 8 * i) & 255, minlength=size + 3) for i in range(3))
    return out[:size].astype(np.uint8).tobytes()


def _in_blocks(data: bytes) -> bytes:
    """Sub-blocks of at most 255 bytes, each behind its length, and the empty one that ends them."""
    full = len(data) // 255
    head = np.full((full, 256), 255, dtype=np.uint8)
    head[:, 1:] = np.frombuffer(data, np.uint8, full * 255).reshape(full, 255)
    rest = data[full * 255 :]
    return head.tobytes() + (bytes([len(rest)]) + rest if rest else b"") + b"\0"


_RAMP = np.arange(256, dtype=np.uint8)
#: The common palette has greys; every other frame has one of its own.
_GREYS = np.repeat(_RAMP, 3).tobytes()
_COLOURS = np.stack([_RAMP, 255 - _RAMP, _RAMP * np.uint8(7)], axis=1).tobytes()


def encode(payload: bytes, width: int = WIDTH, frame_rows: int = FRAME_ROWS) -> bytes:
    """A GIF whose frames' samples are the bytes, one frame after the other; their number is a multiple of ``width``.

    Frames take turns in palette (greys, colours) and disposal (left, cleared, taken back), spaces are transparent,
    and a last frame of fewer rows lies at the foot of the canvas.
    """
    rows = len(payload) // width
    height = min(rows, frame_rows)
    out = [b"GIF89a", struct.pack("<HHBBB", width, height, 0xF7, 0, 0), _GREYS]
    for k, top in enumerate(range(0, rows, frame_rows)):
        part = min(frame_rows, rows - top)
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", (1 + k % 3) << 2 | 1, DELAY_CS * (1 + k % 2), TRANSPARENT, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, height - part, width, part, 0x87 if k % 2 else 0) + (_COLOURS if k % 2 else b"") + b"\x08")
        out.append(_in_blocks(pack_codes(lzw_codes(payload[top * width : (top + part) * width]))))
    out.append(b"\x3b")
    return b"".join(out)


def _read_blocks(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while size := data[at]:
        parts.append(data[at + 1 : at + 1 + size])
        at += 1 + size
    return b"".join(parts), at + 1


def _expanded(codes: np.ndarray, clear: int) -> np.ndarray:
    """The samples of the codes between two clears.

    The entry that a code adds is its own samples and the next one, which stand together in the output. So a
    later code copies from there: lengths and then sources are followed back to single samples by doubling.
    """
    at = np.arange(len(codes))
    single = codes < clear
    entry = np.where(single, at, codes - clear - 2)
    if len(codes) and (entry >= at + single).any() or (codes[~single] < clear + 2).any():
        raise ValueError("a code without an entry")
    length, back = (~single).astype(np.int64), entry
    while not single[back].all():
        length += length[back]
        back = back[back]
    length += 1
    begin = np.cumsum(length) - length
    source = np.repeat(begin[entry] - begin, length) + np.arange(int(length.sum()))
    while True:
        older = source[source]
        if np.array_equal(older, source):
            break
        source = older
    samples = np.zeros(len(source), dtype=np.uint8)
    samples[begin[single]] = codes[single]
    return samples[source]


def lzw(stream: bytes, least: int, count: int) -> np.ndarray:
    """The first ``count`` samples of a code stream with codes of ``least`` + 1 to 12 bits."""
    if not 2 <= least <= 8:
        raise ValueError("codes of that size are not allowed")
    clear = 1 << least
    data = np.concatenate([np.frombuffer(stream, np.uint8), np.zeros(3, np.uint8)]).astype(np.int64)
    widths = _WIDTHS_8 if least == 8 else _widths(least, 4096)
    out, held = [np.zeros(0, np.uint8)], [np.zeros(0, np.int64)]
    at = since = size = 0  # the next bit, codes since the last clear, samples of finished tables
    more = True
    while more and size < count:
        width = widths[np.minimum(np.arange(since, since + 1024), len(widths) - 1)]
        begin = at + np.cumsum(width) - width
        whole = int(np.searchsorted(begin + width, len(stream) * 8, side="right"))
        begin, width = begin[:whole], width[:whole]
        byte = begin >> 3
        codes = (data[byte] | data[byte + 1] << 8 | data[byte + 2] << 16) >> (begin & 7) & ((1 << width) - 1)
        marks = np.flatnonzero((codes == clear) | (codes == clear + 1))
        held.append(codes[: marks[0]] if len(marks) else codes)
        cleared = len(marks) > 0 and codes[marks[0]] == clear
        more = cleared or not len(marks) and whole == 1024
        if more:
            last = marks[0] if cleared else whole - 1
            at, since = int(begin[last] + width[last]), 0 if cleared else since + whole
        if cleared or not more:
            out.append(_expanded(np.concatenate(held), clear))
            size += len(out[-1])
            held = [np.zeros(0, np.int64)]
    return np.concatenate(out)[:count]


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray, int]:
    size = 3 << ((flags & 7) + 1)
    return np.frombuffer(data, np.uint8, size, at).reshape(-1, 3), at + size


def decode(data: bytes) -> tuple[int, int, list[Frame]]:
    """Width and height of the canvas, and the frames as stored. A damaged file raises ValueError."""
    try:
        return _decode(data)
    except (IndexError, struct.error) as e:
        raise ValueError("not a whole GIF") from e


def _decode(data: bytes) -> tuple[int, int, list[Frame]]:
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags = struct.unpack_from("<HHB", data, 6)
    at, common = 13, np.zeros((0, 3), np.uint8)
    if flags & 0x80:
        common, at = _palette(data, at, flags)
    frames: list[Frame] = []
    delay, disposal, transparent = 0, 0, -1
    while data[at] != 0x3B:
        if data[at] == 0x21:
            if data[at + 1] == 0xF9:
                packed, delay, index = struct.unpack_from("<BHB", data, at + 3)
                disposal, transparent = packed >> 2 & 7, index if packed & 1 else -1
            _, at = _read_blocks(data, at + 2)
        elif data[at] == 0x2C:
            left, top, w, h, flags = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = common
            if flags & 0x80:
                palette, at = _palette(data, at, flags)
            stream, after = _read_blocks(data, at + 1)
            flat = lzw(stream, data[at], w * h)
            at = after
            if len(flat) < w * h:
                raise ValueError("a frame is cut off")
            image = flat.reshape(h, w)
            if flags & 0x40:
                order = np.concatenate([np.arange(a, h, b) for a, b in _PASSES])
                image = image[np.argsort(order, kind="stable")]
            frames.append(Frame(left, top, w, h, delay, disposal, transparent, palette, image))
            delay, disposal, transparent = 0, 0, -1
        else:
            raise ValueError("an unknown block")
    return width, height, frames


def composed(width: int, height: int, frames: list[Frame]):
    """The canvas as shown at each frame: height by width by red, green, blue and opacity."""
    canvas = np.zeros((height, width), dtype="<u4")  # a pixel's four bytes as one number
    for f in frames:
        h, w = max(0, min(f.height, height - f.top)), max(0, min(f.width, width - f.left))
        place = canvas[f.top : f.top + h, f.left : f.left + w]
        before = place.copy() if f.disposal == 3 else None
        colours = np.full((256, 4), 255, dtype=np.uint8)
        colours[:, :3] = 0
        if len(f.palette):
            colours[: len(f.palette), :3] = f.palette
            colours[len(f.palette) :, :3] = f.palette[-1]
        index = f.indices[:h, :w]
        pixels = colours.view("<u4").ravel()[index]
        if f.transparent >= 0:
            np.copyto(place, pixels, where=index != f.transparent)
        else:
            place[...] = pixels
        yield canvas.view(np.uint8).reshape(height, width, 4)
        if f.disposal == 2:
            place[...] = 0
        elif f.disposal == 3:
            place[...] = before


def histograms(canvas: np.ndarray) -> list[list[int]]:
    """Per channel how many opaque pixels fall into each of 16 equal ranges."""
    pixels = np.ascontiguousarray(canvas).view("<u4").ravel()
    pixels = pixels[pixels > 0xFFFFFF].astype(np.int64)
    return [np.bincount((pixels >> (8 * c + 4)) & 15, minlength=BINS).tolist() for c in range(3)]


def payloads(docs: DataFrame, unit: int = WIDTH) -> DataFrame:
    """``doc_id``, ``n_bytes`` and ``payload``: the text's bytes and zeros up to a positive multiple of ``unit``."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    n = F.octet_length(body)
    missing = F.greatest(F.ceil(n / unit) * unit, F.lit(unit)).cast("int") - n
    return docs.select("doc_id", n.cast("long").alias("n_bytes"), F.concat(body, F.expr(f"unhex(repeat('00', {unit}))").substr(F.lit(1), missing)).alias("payload"))


def with_media(rows: DataFrame, payload: str = "payload") -> DataFrame:
    """``rows`` with ``media``, the GIF that holds the payload, in its place. Several frames for long payloads."""
    at = rows.columns.index(payload)
    schema = rows.drop(payload).schema.add("media", "binary")

    def run(batches):
        for b in batches:
            media = pa.array([encode(x) for x in b.column(at).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([c for i, c in enumerate(b.columns) if i != at] + [media], names=schema.names)

    return rows.mapInArrow(run, schema)


_FRAME_FIELDS = (
    ("start_ms", "long"), ("delay_ms", "long"), ("left", "integer"), ("top", "integer"), ("width", "integer"), ("height", "integer"),
    ("disposal", "integer"), ("transparent", "integer"),
)
_FRAMES_TYPE = T.ArrayType(T.StructType(
    [T.StructField(n, T.LongType() if k == "long" else T.IntegerType()) for n, k in _FRAME_FIELDS]
    + [T.StructField(n, T.ArrayType(T.LongType())) for n in ("red", "green", "blue")]
))


def with_frames(rows: DataFrame, media: str = "media") -> DataFrame:
    """``rows`` with ``frames`` (timed, with histograms of the canvas as shown) and ``samples`` (all frames' indices).

    A null, empty or damaged GIF gets null in both. Histograms are taken after transparency and disposal.
    """
    at = rows.columns.index(media)
    schema = T.StructType([*rows.schema, T.StructField("samples", T.BinaryType()), T.StructField("frames", _FRAMES_TYPE)])
    kind = pa.list_(pa.struct([(n, pa.int64()) for n in ("start_ms", "delay_ms")] + [(n, pa.int32()) for n in ("left", "top", "width", "height", "disposal", "transparent")] + [(n, pa.list_(pa.int64())) for n in ("red", "green", "blue")]))

    def one(data: bytes | None):
        try:
            width, height, frames = decode(data or b"")
        except ValueError:
            return None, None
        out, start = [], 0
        for f, canvas in zip(frames, composed(width, height, frames), strict=True):
            red, green, blue = histograms(canvas)
            out.append({"start_ms": start, "delay_ms": f.delay_cs * 10, "left": f.left, "top": f.top, "width": f.width, "height": f.height, "disposal": f.disposal, "transparent": f.transparent, "red": red, "green": green, "blue": blue})
            start += f.delay_cs * 10
        return b"".join(f.indices.tobytes() for f in frames), out

    def run(batches):
        for b in batches:
            got = [one(x) for x in b.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([g[0] for g in got], pa.binary()), pa.array([g[1] for g in got], kind)], names=schema.names)

    return rows.mapInArrow(run, schema)


def op6_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's bytes stored as a GIF and read back: digests, and the frames with times and colour histograms.

    ``feature`` sums the histograms of what the frames show, by channel.
    """
    rows = with_frames(with_media(payloads(table(spark, sf_dir, "documents"))))
    sums = [F.expr(f"array_join(transform(sequence(1, {BINS}), i -> reduce(frames, 0L, (a, f) -> a + element_at(f.{c}, i))), ',')") for c in ("red", "green", "blue")]
    return rows.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(samples, -64)")).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"), F.concat_ws(";", *sums).alias("feature"), "frames",
    )
