import hashlib
import zlib

import numpy as np
import pytest

from pelagos.llm import gif


def lzw_encode(samples, least):
    """Plain LZW as the format describes it, to test the reader."""
    clear = 1 << least
    codes, table, width, bits, n = [], {bytes([i]): i for i in range(clear)}, least + 1, 0, 0

    def put(c):
        nonlocal bits, n
        bits |= c << n
        n += width

    put(clear)
    nxt, before = clear + 2, b""
    for s in samples:
        now = before + bytes([s])
        if now in table:
            before = now
            continue
        put(table[before])
        if nxt < 4096:
            table[now] = nxt
            if nxt == 1 << width and width < 12:
                width += 1
            nxt += 1
        else:
            put(clear)
            table, width, nxt = {bytes([i]): i for i in range(clear)}, least + 1, clear + 2
        before = bytes([s])
    if before:
        put(table[before])
    put(clear + 1)
    return bits.to_bytes(-(-n // 8), "little")


@pytest.mark.parametrize("least,n", [(2, 50), (4, 3000), (8, 20_000), (8, 1), (8, 0)])
def test_lzw_streams(least, n):
    rng = np.random.default_rng(n)
    samples = (rng.integers(0, 1 << least, n) * (rng.random(n) < 0.3)).astype(np.uint8)
    assert gif.lzw(lzw_encode(samples.tolist(), least), least, n).tobytes() == samples.tobytes()


def plain_lzw(stream, least):
    """The reader as the format describes it: one code after the other."""
    bits = sum(b << 8 * i for i, b in enumerate(stream))
    clear, out, width, before, table = 1 << least, b"", least + 1, b"", []
    while True:
        code = bits & (1 << width) - 1
        bits >>= width
        if code == clear:
            table, width, before = [bytes([i]) for i in range(clear)] + [b"", b""], least + 1, b""
            continue
        if code == clear + 1:
            return out
        text = table[code] if code < len(table) else before + before[:1]
        if before and len(table) < 4096:
            table.append(before + text[:1])
        if len(table) == 1 << width and width < 12:
            width += 1
        out, before = out + text, text


@pytest.mark.parametrize("n,kinds", [(1, 256), (2, 1), (600, 256), (5000, 3), (9000, 256), (9000, 1)])
def test_written_streams(n, kinds):
    samples = np.random.default_rng(n).integers(0, kinds, n).astype(np.uint8).tobytes()
    codes = gif.lzw_codes(samples)
    stream = gif.pack_codes(codes)
    assert plain_lzw(stream, 8) == samples and gif.lzw(stream, 8, n).tobytes() == samples
    if kinds < 256 and n > 9:
        assert max(codes) > 257 and len(stream) < n / 2  # entries of the table are used
    if n == 9000 and kinds == 256:
        assert codes.count(256) > 1  # a full table is cleared


def test_written_frames_have_effect():
    """Palettes, transparency and disposal of the written frames, against what they are meant to show."""
    rng = np.random.default_rng(1)
    payload = rng.choice(np.array([32, 65, 200], np.uint8), 64 * 150).tobytes()
    width, height, frames = gif.decode(gif.encode(payload))
    assert (width, height, len(frames)) == (64, 64, 3) and b"".join(f.indices.tobytes() for f in frames) == payload
    assert [f.disposal for f in frames] == [1, 2, 3] and {f.transparent for f in frames} == {32} and [f.top for f in frames] == [0, 0, 42]
    colour = [lambda v: (v, v, v), lambda v: (v, 255 - v, v * 7 % 256), lambda v: (v, v, v)]
    canvas = [[(0, 0, 0, 0)] * 64 for _ in range(64)]
    for f, shown, paint in zip(frames, gif.composed(width, height, frames), colour):
        for y in range(f.height):
            for x in range(64):
                v = int(f.indices[y, x])
                if v != 32:
                    canvas[f.top + y][x] = (*paint(v), 255)
        assert [[tuple(map(int, p)) for p in row] for row in shown] == canvas
        if f.disposal == 2:
            canvas = [[(0, 0, 0, 0)] * 64 for _ in range(64)]


def frame(left, top, w, h, samples, disposal=0, transparent=None, delay=3, interlaced=False):
    flags = disposal << 2 | (transparent is not None)
    return (
        b"\x21\xf9\x04" + bytes([flags]) + delay.to_bytes(2, "little") + bytes([transparent or 0, 0]) + b"\x2c"
        + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0x40 if interlaced else 0]) + b"\x02"
        + gif._in_blocks(lzw_encode(samples, 2))
    )


def test_disposal_transparency_and_interlace():
    palette = bytes([0, 0, 0, 255, 0, 0, 0, 255, 0, 0, 0, 255])
    head = b"GIF89a" + (2).to_bytes(2, "little") * 2 + bytes([0x81, 0, 0]) + palette
    data = head + frame(0, 0, 2, 2, [1, 1, 1, 1], 1) + frame(0, 0, 2, 1, [2, 3], 3, transparent=3) + frame(1, 1, 1, 1, [2], 2) + frame(0, 0, 1, 1, [3], 0) + b"\x3b"
    w, h, frames = gif.decode(data)
    shown = [c[..., :].copy() for c in gif.composed(w, h, frames)]
    red, green, blue, none = (255, 0, 0, 255), (0, 255, 0, 255), (0, 0, 255, 255), (0, 0, 0, 0)
    assert [[tuple(map(int, p)) for p in c.reshape(-1, 4)] for c in shown] == [
        [red] * 4, [green, red, red, red], [red, red, red, green], [blue, red, red, none],
    ]
    rows = [v for v in range(4) for _ in range(1)]
    order = [0, 2, 1, 3]
    tall = b"GIF89a" + (1).to_bytes(2, "little") + (4).to_bytes(2, "little") + bytes([0x81, 0, 0]) + palette
    image = gif.decode(tall + frame(0, 0, 1, 4, [rows[i] for i in order], interlaced=True) + b"\x3b")[2][0].indices
    assert image[:, 0].tolist() == rows


def test_documents(spark, tmp_path):
    texts = {1: "hello", 2: None, 3: "", 4: "é" * 400_000, 5: "x" * 64, 6: "hello", None: "z"}
    rows = [(k, t, 1.0) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, media double").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["doc_id"]: r for r in gif.op6_gif_media(spark, str(tmp_path)).collect()}
    assert set(got) == set(texts)
    for k, t in texts.items():
        body = (t or "").encode()
        full = body + b"\0" * (max(64, -(-len(body) // 64) * 64) - len(body))
        r = got[k]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(body), len(full))
        assert r["payload_sha256"] == hashlib.sha256(full).hexdigest()
        assert r["tail_crc32"] == zlib.crc32(full[-64:])
        bins = [np.zeros(16, np.int64) for _ in range(3)]
        w, h, frames = gif.decode(gif.encode(full))
        for shown in gif.composed(w, h, frames):
            for c in range(3):
                for v in shown[..., c][shown[..., 3] > 0].ravel() if len(full) < 1000 else ():
                    bins[c][v >> 4] += 1
        if len(full) < 1000:
            assert r["feature"] == ";".join(",".join(map(str, b)) for b in bins)
        assert [f["start_ms"] for f in r["frames"]] == np.cumsum([0, *(f.delay_cs * 10 for f in frames)])[:-1].tolist()
    assert len(got[4]["frames"]) == -(-got[4]["payload_bytes"] // 4096) and got[1]["media_sha256"] == got[6]["media_sha256"]
    assert got[4]["media_bytes"] < got[4]["payload_bytes"]


def test_damaged_media(spark):
    rows = spark.createDataFrame([(1, b"GIF89a"), (2, None), (3, gif.encode(b"\0" * 64)[:-30])], "doc_id long, media binary")
    assert [(r["samples"], r["frames"]) for r in gif.with_frames(rows).collect()] == [(None, None)] * 3
