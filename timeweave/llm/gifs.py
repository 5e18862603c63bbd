"""Media columns, GIF: LZW code streams, palettes, transparency and disposal into timed frames with colour histograms."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from timeweave.llm.common import small_batches

#: Bins of a channel's histogram; pixels of a canvas beyond which a picture is reported instead of decoded.
BINS, MAX_PIXELS = 8, 1 << 26


class Frame(NamedTuple):
    """The canvas (height, width, RGBA) as shown from start_ms for delay_ms."""

    start_ms: int
    delay_ms: int
    disposal: int
    canvas: np.ndarray


class Broken(ValueError):
    """The stream isn't a GIF, or ends early."""


def lzw_decode(data: bytes, size: int, pixels: int) -> bytes:
    """`pixels` indices from a code stream whose least code size is `size`. Codes beyond them are ignored.

    A stream that ends early, or has an impossible code, gives what came before it.
    """
    clear, end = 1 << size, (1 << size) + 1
    table: list[bytes] = [bytes((i,)) for i in range(clear)] + [b"", b""]
    start = list(table)
    width, limit = size + 1, 1 << (size + 1)
    out: list[bytes] = []
    done, last = 0, b""
    held = bits = 0
    for byte in data:
        held |= byte << bits
        bits += 8
        while bits >= width:
            code = held & (limit - 1)
            held >>= width
            bits -= width
            if code == clear:
                table = list(start)
                width, limit, last = size + 1, 1 << (size + 1), b""
                continue
            if code == end:
                return b"".join(out)[:pixels]
            if not last:
                if code >= clear:
                    return b"".join(out)[:pixels]
                entry = table[code]
            elif code < len(table):
                entry = table[code]
                if len(table) < 4096:
                    table.append(last + entry[:1])
            elif code == len(table) and code < 4096:
                entry = last + last[:1]
                table.append(entry)
            else:
                return b"".join(out)[:pixels]
            out.append(entry)
            last = entry
            done += len(entry)
            if done >= pixels:
                return b"".join(out)[:pixels]
            if len(table) == limit and width < 12:
                width += 1
                limit <<= 1
    return b"".join(out)[:pixels]


def lzw_encode(indices: bytes, size: int) -> bytes:
    """The code stream of indices below 2**size: cleared at the start and whenever the table is full."""
    clear, end = 1 << size, (1 << size) + 1
    out = bytearray()
    held = bits = 0
    width = size + 1
    table: dict[bytes, int] = {bytes((i,)): i for i in range(clear)}
    free = end + 1

    def put(code: int) -> None:
        nonlocal held, bits
        held |= code << bits
        bits += width
        while bits >= 8:
            out.append(held & 255)
            held >>= 8
            bits -= 8

    put(clear)
    run = b""
    for i in indices:
        longer = run + bytes((i,))
        if longer in table:
            run = longer
            continue
        put(table[run])
        if free < 4096:
            table[longer] = free
            if free == 1 << width and width < 12:
                width += 1
            free += 1
        else:
            put(clear)
            width, free = size + 1, end + 1
            table = {bytes((k,)): k for k in range(clear)}
        run = bytes((i,))
    if run:
        put(table[run])
        if free == 1 << width and width < 12:  # the decoder has added an entry by now
            width += 1
    put(end)
    if bits:
        out.append(held & 255)
    return bytes(out)


def _blocks(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of sub-blocks from `at` on, and where they end. A missing end is as one at the end of the data."""
    parts = []
    while at < len(data) and data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def _palette(data: bytes, at: int, flags: int) -> tuple[np.ndarray | None, int]:
    if not flags & 0x80:
        return None, at
    n = 2 << (flags & 7)
    if at + 3 * n > len(data):
        raise Broken("a palette is cut off")
    return np.frombuffer(data, np.uint8, 3 * n, at).reshape(n, 3), at + 3 * n


def interlaced(height: int) -> np.ndarray:
    """The row that each transmitted row belongs to."""
    return np.concatenate([np.arange(a, height, b) for a, b in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(data: bytes, max_pixels: int = MAX_PIXELS) -> Iterator[Frame]:
    """The frames of a GIF in order, each composed onto what the ones before it left.

    Outside of frames, and where an area is restored to the background, the canvas is transparent. Disposal 0, 1 and those
    not defined leave a frame, 2 clears its area, 3 restores what was there before. Pixels that a stream lacks stay
    as they were, as do transparent ones. An index beyond the palette is black; without any palette all are.
    """
    if len(data) < 13 or data[:6] not in (b"GIF87a", b"GIF89a"):
        raise Broken("not a GIF")
    width, height = int.from_bytes(data[6:8], "little"), int.from_bytes(data[8:10], "little")
    if width * height > max_pixels:
        raise Broken(f"the canvas has more than {max_pixels} pixels")
    shared, at = _palette(data, 13, data[10])
    canvas = np.zeros((height, width, 4), np.uint8)
    delay = disposal = clock = 0
    transparent = -1
    while at < len(data):
        kind = data[at]
        if kind == 0x3B:
            return
        if kind == 0x21:
            label = data[at + 1] if at + 1 < len(data) else 0
            content, at = _blocks(data, at + 2)
            if label == 0xF9 and len(content) >= 4:
                disposal, delay = content[0] >> 2 & 7, 10 * int.from_bytes(content[1:3], "little")
                transparent = content[3] if content[0] & 1 else -1
            continue
        if kind != 0x2C:
            raise Broken(f"a block of unknown kind {kind}")
        if at + 10 > len(data):
            raise Broken("an image descriptor is cut off")
        x, y, w, h = (int.from_bytes(data[at + k : at + k + 2], "little") for k in (1, 3, 5, 7))
        flags = data[at + 9]
        if w * h > max_pixels:
            raise Broken(f"a frame has more than {max_pixels} pixels")
        own, at = _palette(data, at + 10, flags)
        if at >= len(data):
            raise Broken("an image has no code stream")
        size = data[at]
        if not 1 <= size <= 11:
            raise Broken(f"impossible code size {size}")
        stream, at = _blocks(data, at + 1)
        colours = np.zeros((256, 3), np.uint8)
        table = own if own is not None else shared
        if table is not None:
            colours[: len(table)] = table
        got = np.frombuffer(_indices(stream, size, w * h), np.uint8)
        index, known = np.zeros(w * h, np.uint8), np.zeros(w * h, bool)
        index[: len(got)], known[: len(got)] = got, got != transparent
        index, known = index.reshape(h, w), known.reshape(h, w)
        if flags & 0x40 and h:
            rows = interlaced(h)
            straight, seen = np.empty_like(index), np.empty_like(known)
            straight[rows], seen[rows] = index, known
            index, known = straight, seen
        area = canvas[y : y + h, x : x + w]
        index, known = index[: area.shape[0], : area.shape[1]], known[: area.shape[0], : area.shape[1]]
        before = area.copy() if disposal == 3 else None
        area[known, :3] = colours[index[known]]
        area[known, 3] = 255
        yield Frame(clock, delay, disposal, canvas.copy())
        clock += delay
        if disposal == 2:
            area[:] = 0
        elif before is not None:
            area[:] = before
        delay = disposal = 0
        transparent = -1


def _indices(stream: bytes, size: int, pixels: int) -> bytes:
    if size <= 8:
        return lzw_decode(stream, size, pixels)
    raise Broken(f"impossible code size {size}")


def encode(width: int, height: int, palette: np.ndarray, frames: list[dict]) -> bytes:
    """A GIF89a. frames: index (2-D), and, where not usual, x, y, delay (hundredths), disposal, transparent, interlace, palette."""
    depth = max(1, (len(palette) - 1).bit_length())
    out = [b"GIF89a", width.to_bytes(2, "little"), height.to_bytes(2, "little"), bytes((0x80 | depth - 1, 0, 0)), _table(palette, depth)]
    for f in frames:
        index = np.asarray(f["index"], np.uint8)
        clear = f.get("transparent", -1)
        out += [b"\x21\xf9\x04", bytes((f.get("disposal", 0) << 2 | (clear >= 0),)), f.get("delay", 0).to_bytes(2, "little"), bytes((max(clear, 0), 0))]
        own = f.get("palette")
        bits = max(1, (len(own) - 1).bit_length()) if own is not None else depth
        flags = (0x80 | bits - 1 if own is not None else 0) | (0x40 if f.get("interlace") else 0)
        out += [b"\x2c", *(int(v).to_bytes(2, "little") for v in (f.get("x", 0), f.get("y", 0), index.shape[1], index.shape[0])), bytes((flags,))]
        if own is not None:
            out.append(_table(own, bits))
        if f.get("interlace"):
            index = index[interlaced(len(index))]
        size = max(2, bits)
        stream = lzw_encode(index.tobytes(), size)
        out.append(bytes((size,)))
        out += [bytes((len(stream[k : k + 255]),)) + stream[k : k + 255] for k in range(0, len(stream), 255)]
        out.append(b"\x00")
    return b"".join([*out, b"\x3b"])


def _table(palette: np.ndarray, depth: int) -> bytes:
    full = np.zeros((1 << depth, 3), np.uint8)
    full[: len(palette)] = palette
    return full.tobytes()


def histograms(canvas: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Counts of red, green and blue in `bins` equal ranges, over the pixels that aren't transparent."""
    shown = canvas[canvas[:, :, 3] > 0][:, :3].astype(np.int64) * bins >> 8
    return np.stack([np.bincount(shown[:, c], minlength=bins) for c in range(3)]) if len(shown) else np.zeros((3, bins), np.int64)


SCHEMA = "media_id long, frame int, start_ms long, delay_ms long, width int, height int, opaque long, red array<long>, green array<long>, blue array<long>, rgba binary, error string"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]
KINDS = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary(), pa.string()]
#: Bytes of frames in a batch of results.
BATCH = 1 << 24


def frames(media: DataFrame, bins: int = BINS, max_pixels: int = MAX_PIXELS) -> DataFrame:
    """One row per frame: media_id, frame (from 0), start_ms, delay_ms, width and height of the canvas, opaque (pixels),
    red, green and blue (histograms over these), rgba (the composed canvas, row by row), and error.

    media: needs media_id and media (binary). What can't be decoded, or no further, has a last row with the error and no
    frame; so have null and empty values, and those without a frame. Null ids stay null; equal rows are decoded each.
    Other columns aren't read. An empty table gives an empty one. Frames are sent on as they come, about 16 MB at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for k in range(batch.num_rows):
                id_, data = batch.column(0)[k].as_py(), batch.column(1)[k].as_py()
                n, error = 0, None
                try:
                    for f in decode(data or b"", max_pixels):
                        h = histograms(f.canvas, bins)
                        rows.append((id_, n, f.start_ms, f.delay_ms, f.canvas.shape[1], f.canvas.shape[0], int(h[0].sum()), *h.tolist(), f.canvas.tobytes(), None))
                        n += 1
                        held += f.canvas.nbytes
                        if held > BATCH:
                            yield _batch(rows)
                            rows, held = [], 0
                    if not n:
                        error = "no frame"
                except Broken as broken:
                    error = str(broken)
                if error:
                    rows.append((id_, *[None] * 10, error))
            yield _batch(rows)

    return small_batches(media).select(F.col("media_id").cast("long").alias("media_id"), F.col("media").cast("binary").alias("media")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(NAMES)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, KINDS)], NAMES)


def picture(vector: np.ndarray) -> bytes:
    """An animation of a vector: its values as grey squares, then a changed corner with transparency, then the negative of its
    lower half, interlaced, over the restored background. Values are scaled to the vector's range; NaN is as its least."""
    side = max(1, int(np.ceil(np.sqrt(len(vector)))))
    v = np.zeros(side * side)
    v[: len(vector)] = np.nan_to_num(vector, nan=np.nanmin(vector) if np.isfinite(vector).any() else 0.0)
    low, high = v.min(), v.max()
    index = np.floor((v - low) / max(high - low, 1e-12) * 63).astype(np.uint8).reshape(side, side)
    level = (np.arange(64) * 4).astype(np.uint8)
    grey, heat = np.stack([level, level, level], axis=1), np.stack([level, 255 - level, np.full(64, 128, np.uint8)], axis=1)
    half = side // 2 or 1
    return encode(side, side, grey, [
        {"index": index, "delay": 10, "disposal": 1},
        {"index": index[:half, :half], "x": side - half, "delay": 20, "disposal": 3, "transparent": int(index[0, 0]), "palette": heat},
        {"index": 63 - index[half:] if side > 1 else index, "y": side - len(index[half:]) if side > 1 else 0, "delay": 5, "disposal": 2, "interlace": True},
    ])


def pictures(embeddings: DataFrame) -> DataFrame:
    """media_id and media, a GIF of each vector: the tables that come with this repository hold no pictures of their own.

    A null or empty vector has a null picture; null elements count as NaN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [picture(np.array([np.nan if x is None else x for x in v], float)) if v else None for v in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], ["media_id", "media"])

    return embeddings.select(F.col("vec_id").cast("long").alias("media_id"), F.col("embedding").cast("array<double>").alias("v")).mapInArrow(run, "media_id long, media binary")


def query(spark, sf_dir: str) -> DataFrame:
    return frames(pictures(spark.read.parquet(f"{sf_dir}/embeddings.parquet")))
