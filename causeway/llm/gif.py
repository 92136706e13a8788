"""Operator 8, media columns: GIF.

``decode`` reads any GIF87a or GIF89a file: LZW code streams, global and local palettes,
interlacing, transparency and the disposal rules.  Code widths follow from the number of
codes since the last clear code, so the codes of a segment are cut out at once, and the
strings they stand for are copies of earlier output that numpy resolves by pointer jumping.
``encode`` writes 8-bit samples losslessly as the palette indices of an animation, by longest matches.

``with_frames`` stores timed frames with their colour histograms, one row each; the query
stores texts as samples, and takes its digests, timed frames and histograms from the stored
bytes alone.

Null and empty texts are one row of spaces; a text of any length is cut into frames of ROWS
rows, of which one is decoded at a time; equal texts give equal rows; an empty table gives
none; other columns aren't read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from causeway.llm.common import table
from causeway.llm.tokens import byte_chunks

WIDTH, ROWS = 192, 192
DELAY_MS = 100
_FULL = 4096
#: The encoder's palette: three bits of red, three of green and two of blue.
_COLOURS = bytes(v for i in range(256) for v in ((i >> 5) * 255 // 7, (i >> 2 & 7) * 255 // 7, (i & 3) * 85))


def _widths(n: int, low: int) -> np.ndarray:
    """Bits of each of the first ``n`` codes after a clear code, for ``low`` bits a sample."""
    entries = (1 << low) + 2 + np.maximum(0, np.arange(n) - 1)
    return np.minimum(12, np.maximum(low + 1, np.floor(np.log2(entries)).astype(np.int64) + 1))


_STEPS = {low: np.concatenate(([0], np.cumsum(_widths(2 * _FULL, low)))) for low in range(1, 9)}

_BYTE_WIDTHS = np.diff(_STEPS[8])


def lzw_encode(data: bytes) -> bytes:
    """The code stream of 8-bit samples, after one clear code: always the longest string of the table, which starts anew when it is full."""
    # A key is the code of a string and the sample behind it, the value the longer string's code.
    longer: dict[int, int] = {}
    find, codes, starts, following = longer.get, [256], [1], 258
    add = codes.append
    samples = iter(data)
    now = next(samples)
    for sample in samples:
        key = now << 8 | sample
        code = find(key)
        if code is None:
            add(now)
            now = sample
            if following < _FULL:
                longer[key] = following
                following += 1
            else:
                add(256)
                starts.append(len(codes))
                longer.clear()
                following = 258
        else:
            now = code
    codes += [now, 257]
    ends = [*starts[1:], len(codes)]
    width = np.concatenate([_BYTE_WIDTHS[:1], *(_BYTE_WIDTHS[: b - a] for a, b in zip(starts, ends, strict=True))])
    bits = np.unpackbits(np.array(codes, "<u2").view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < width[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, low: int, n: int) -> np.ndarray:
    """The first ``n`` samples of a code stream; fewer if it ends early."""
    clear, end, first = 1 << low, (1 << low) + 1, (1 << low) + 2
    raw = np.frombuffer(stream + b"\0\0\0\0", dtype=np.uint8).astype(np.int32)
    raw = raw[:-2] | raw[1:-1] << 8 | raw[2:] << 16  # the 24 bits from each byte on
    total_bits, pos, out, have = 8 * len(stream), 0, [], 0
    while have < n:
        # All codes up to the next clear or end code.
        span = 2 * _FULL
        while True:
            steps = _STEPS[low] if span == 2 * _FULL else np.concatenate((_STEPS[low], _STEPS[low][-1] + 12 * np.arange(1, span - 2 * _FULL + 1)))
            fit = int(np.searchsorted(steps, total_bits - pos, "right")) - 1
            at, w = pos + steps[:fit], np.diff(steps[: fit + 1])
            c = raw[at >> 3] >> (at & 7) & ((1 << w) - 1)
            stop = np.flatnonzero((c == clear) | (c == end))
            if len(stop) or fit < span:
                break
            span *= 2
        m = int(stop[0]) if len(stop) else fit
        codes = c[:m]
        if m:
            part = _strings(codes, first)
            out.append(part)
            have += len(part)
        if not len(stop) or c[m] == end:
            break
        pos = int(at[m] + w[m])
    return np.concatenate(out)[:n] if out else np.zeros(0, np.uint8)


def _strings(codes: np.ndarray, first: int) -> np.ndarray:
    """The samples of one segment's codes: entry ``first + j`` is the string of code j and one sample more."""
    k = np.arange(len(codes))
    entry = codes >= first
    at = np.where(entry, codes - first, k)
    if (at[entry] >= k[entry]).any() or len(codes) and entry[0]:
        raise ValueError("a GIF code before its entry")
    hops, to = entry.astype(np.int64), at
    while True:
        more = hops[to]
        if not more.any():
            break
        hops, to = hops + more, to[to]
    length = hops + 1
    place = np.cumsum(length) - length
    total = int(place[-1] + length[-1])
    source = np.arange(total) + np.repeat(place[at] - place, length)
    while True:
        further = source[source]
        if (further == source).all():
            break
        source = further
    value = np.zeros(total, np.uint8)
    value[place[~entry]] = codes[~entry]
    return value[source]


def encode(samples: bytes, width: int = WIDTH, rows: int = ROWS, delay_ms: int = DELAY_MS) -> bytes:
    """A GIF whose palette indices are 8-bit samples, a positive multiple of ``width``; frames of at most ``rows`` rows."""
    if not samples or len(samples) % width:
        raise ValueError("the samples must fill whole rows")
    high = min(rows, len(samples) // width)
    out = [b"GIF89a", width.to_bytes(2, "little"), high.to_bytes(2, "little"), b"\xf7\0\0", _COLOURS]
    for a in range(0, len(samples), rows * width):
        part = samples[a : a + rows * width]
        out += [b"\x21\xf9\x04\x04", (delay_ms // 10).to_bytes(2, "little"), b"\0\0", b"\x2c\0\0\0\0", width.to_bytes(2, "little"), (len(part) // width).to_bytes(2, "little"), b"\0\x08"]
        stream = lzw_encode(part)
        for x in range(0, len(stream), 255):
            block = stream[x : x + 255]
            out += [bytes([len(block)]), block]
        out.append(b"\0")
    return b"".join([*out, b"\x3b"])


@dataclass
class Frame:
    index: int
    left: int
    top: int
    delay_ms: int
    disposal: int
    transparent: int | None
    samples: np.ndarray  # the frame's own palette indices, height x width
    canvas: np.ndarray  # RGBA of the whole picture while the frame shows

    def histogram(self) -> np.ndarray:
        """Pixels of the shown picture in 4 x 4 x 4 bins of red, green and blue; transparent ones don't count."""
        v = self.canvas.reshape(-1, 4).view("<u4").ravel()
        seen = v >> 24 > 0
        v = v if seen.all() else v[seen]
        return np.bincount(v >> 2 & 0x30 | v >> 12 & 0xC | v >> 22 & 3, minlength=64)


def decode(data: bytes) -> Iterator[Frame]:
    """The timed frames of a GIF file, each drawn over what the one before left."""
    if data[:6] not in (b"GIF87a", b"GIF89a") or len(data) < 13:
        raise ValueError("not a GIF file")
    u16 = lambda p: int.from_bytes(data[p : p + 2], "little")
    wide, high, packed = u16(6), u16(8), data[10]
    pos, base = 13, None

    def palette(n: int) -> np.ndarray:
        rgb = np.frombuffer(data[pos : pos + 3 * n].ljust(3 * n, b"\0"), np.uint8).reshape(-1, 3)
        return np.column_stack([rgb, np.full(n, 255, np.uint8)])

    def blocks() -> bytes:
        nonlocal pos
        parts = []
        while pos < len(data) and (n := data[pos]):
            parts.append(data[pos + 1 : pos + 1 + n])
            pos += 1 + n
        pos += 1
        return b"".join(parts)

    if packed & 0x80:
        base = palette(2 << (packed & 7))
        pos += 3 * len(base)
    canvas = np.zeros((high, wide), "<u4")  # a pixel's four bytes as one number
    delay, disposal, clear_index, k = 0, 0, None, 0
    while pos < len(data) and data[pos] != 0x3B:
        kind = data[pos]
        pos += 1
        if kind == 0x21:
            label = data[pos]
            pos += 1
            body = blocks()
            if label == 0xF9 and len(body) >= 4:
                disposal, delay = body[0] >> 2 & 7, 10 * int.from_bytes(body[1:3], "little")
                clear_index = body[3] if body[0] & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown GIF block")
        left, top, w, h, flags = u16(pos), u16(pos + 2), u16(pos + 4), u16(pos + 6), data[pos + 8]
        pos += 9
        colours = base
        if flags & 0x80:
            colours = palette(2 << (flags & 7))
            pos += 3 * len(colours)
        if colours is None:
            raise ValueError("a GIF frame without a palette")
        low = data[pos]
        pos += 1
        found = lzw_decode(blocks(), low, w * h)
        samples = np.zeros(w * h, np.uint8)
        samples[: len(found)] = found
        samples = samples.reshape(h, w)
        if flags & 0x40:
            order = np.concatenate([np.arange(a, h, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])
            plain = np.empty_like(samples)
            plain[order] = samples
            samples = plain
        before = canvas.copy() if disposal == 3 else None
        full = np.zeros(256, "<u4")
        full[: len(colours)] = colours.view("<u4").ravel()
        area = canvas[top : top + h, left : left + w]
        shown = samples[: area.shape[0], : area.shape[1]]
        area[...] = full[shown] if clear_index is None else np.where(shown == clear_index, area, full[shown])
        yield Frame(k, left, top, delay, disposal, clear_index, samples, canvas.copy().view(np.uint8).reshape(high, wide, 4))
        if disposal == 2:
            area[...] = 0
        elif disposal == 3:
            canvas = before
        delay, disposal, clear_index, k = 0, 0, None, k + 1


_FRAME = "frame int, left int, top int, width int, height int, delay_ms int, start_ms long, disposal int, transparent int, rgba binary, histogram array<long>, error string"


def with_frames(df: DataFrame, media: str = "media", key: str = "doc_id") -> DataFrame:
    """A row per frame: key, place, time, disposal, the shown RGBA picture and its histogram.

    Null media has no rows; media that isn't a readable GIF has one row with an error.
    """
    names = [key, *(x.split()[0] for x in _FRAME.split(", "))]

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if not data.is_valid:
                    continue
                at = 0
                try:
                    for f in decode(data.as_py()):
                        h, w = f.samples.shape
                        row = (k, f.index, f.left, f.top, w, h, f.delay_ms, at, f.disposal, f.transparent, f.canvas.tobytes(), f.histogram().tolist(), None)
                        at += f.delay_ms
                        yield _batch(row, batch.schema.field(0).type)
                except (ValueError, IndexError) as e:
                    yield _batch((k, *[None] * 11, str(e)), batch.schema.field(0).type)

    def _batch(row: tuple, kind: pa.DataType) -> pa.RecordBatch:
        kinds = [kind, *[pa.int32()] * 6, pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, kinds, strict=True)], names)

    return df.select(key, media).mapInArrow(frames, f"{key} {dict(df.dtypes)[key]}, {_FRAME}")


def _text_media(texts: pa.Array) -> pa.Array:
    """Texts (null: empty) as UTF-8, filled with spaces to a positive multiple of WIDTH, in a GIF each."""
    out = []
    for _, _, data, offsets in byte_chunks(texts):
        whole = data.tobytes()
        for a, b in zip(offsets.tolist(), offsets[1:].tolist(), strict=False):
            rows = max(1, -(-(b - a) // WIDTH))
            out.append(encode(whole[a:b].ljust(rows * WIDTH, b" ")))
    return pa.array(out, pa.binary())


_DIGEST = "payload_bytes long, payload_sha256 string, tail_crc32 long, feature string, frames array<struct<frame int, start_ms long, delay_ms int, width int, height int, histogram array<int>>>"


def _media_digest(media: pa.Array) -> pa.Array:
    """What stored media holds: digests of its samples, its timed frames with their histograms, and all colours."""
    rows = []
    for m in media:
        sha, size, tail, total, frames, ms = hashlib.sha256(), 0, b"", np.zeros(64, np.int64), [], 0
        for f in decode(m.as_py()) if m.is_valid else ():
            part = f.samples.tobytes()
            sha.update(part)
            seen = f.histogram()
            frames.append((f.index, ms, f.delay_ms, f.samples.shape[1], f.samples.shape[0], seen.astype(np.int32)))
            size, tail, ms, total = size + len(part), (tail + part)[-16:], ms + f.delay_ms, total + seen
        feature = f"frames={len(frames)};ms={ms};rgb=" + ",".join(f"{i}:{v}" for i, v in enumerate(total.tolist()) if v)
        rows.append((size, sha.hexdigest(), zlib.crc32(tail), feature, frames))
    columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
    flat = list(zip(*(f for frames in columns[4] for f in frames), strict=True)) or [[]] * 6
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.int32()))
    frames = pa.StructArray.from_arrays([pa.array(c, t) for c, t in zip(flat, kinds, strict=True)], ["frame", "start_ms", "delay_ms", "width", "height", "histogram"])
    ends = np.cumsum([0, *map(len, columns[4])])
    parts = [pa.array(c, t) for c, t in zip(columns[:4], (pa.int64(), pa.string(), pa.int64(), pa.string()), strict=True)]
    return pa.StructArray.from_arrays([*parts, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), frames)], ["payload_bytes", "payload_sha256", "tail_crc32", "feature", "frames"])


def text_media(text: Column) -> Column:
    """A GIF of each text; null and empty texts are one row of spaces."""
    return F.arrow_udf(_text_media, "binary")(text)


def media_digest(media: Column) -> Column:
    """Struct of payload digests, feature and timed frames with histograms; null media has no frame and no sample."""
    return F.arrow_udf(_media_digest, _DIGEST)(media)


def op8_gif_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stores every text of ``documents`` as the samples of a GIF, and reads the stored bytes back."""
    docs = table(spark, sf_dir, "documents")
    stored = docs.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), text_media(F.col("text")).alias("media"))
    read = stored.select("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), media_digest(F.col("media")).alias("d"))
    return read.select("doc_id", "n_bytes", "d.payload_bytes", "d.payload_sha256", "d.tail_crc32", "media_bytes", "media_sha256", "d.feature", "d.frames")
