"""Media columns: GIF files written, stored as binary columns, and read back as timed frames.

A document's payload is its text as UTF-8, filled up with spaces to a positive multiple of ``ROW`` bytes. It is stored as
8-bit samples, ``ROW`` of them a line and up to ``LINES`` lines a frame. The palette gives each sample a colour of its own and deals the samples' bits out to the
channels in turn, so that like samples fall into few bins of the histogram and all of them into 64.

Defined results: a null or empty text is one line of spaces; an empty table gives no rows; a null file has no frames and no row; a
damaged one, or one with more than ``LARGEST`` pixels a frame, has one row with what is wrong in ``error`` and null elsewhere; a null doc_id stays null; repeated rows
have rows of their own; equal texts have equal files; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from weftmine.llm.arrow import slices

ROW, LINES, DELAY = 192, 256, 10
TABLE = 4096
#: Pixels of a frame that is read.
LARGEST = 1 << 26


def _widths(first: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the k-th code after a clear: its width in bits, and the bits before it."""
    entries = first + np.maximum(np.arange(TABLE + 2) - 1, 0)
    width = np.minimum(np.frexp(entries)[1], 12)
    return width, np.concatenate([[0], np.cumsum(width)])


def lzw_encode(samples: bytes) -> bytes:
    """The code stream of 8-bit samples. The table is cleared as soon as it is full."""
    clear, end = 256, 257
    codes, table, free = [clear], {}, 258
    emit, find = codes.append, table.get
    rest = iter(samples)
    run = next(rest)
    for sample in rest:
        key = run << 8 | sample
        longer = find(key)
        if longer is not None:
            run = longer
            continue
        emit(run)
        run = sample
        if free < TABLE:
            table[key] = free
            free += 1
        else:
            emit(clear)
            table, free = {}, 258
            find = table.get
    codes += (run, end)
    stream = np.array(codes, "<u2")
    at = np.arange(len(stream))
    cleared = np.maximum.accumulate(np.where(np.concatenate([[False], stream[:-1] == clear]), at, 0))
    width = _widths(258)[0][at - cleared]
    bits = np.unpackbits(stream.view(np.uint8).reshape(-1, 2), axis=1, bitorder="little")
    return np.packbits(bits[np.arange(16) < width[:, None]], bitorder="little").tobytes()


def lzw_decode(stream: bytes, depth: int, size: int) -> bytes:
    """The first ``size`` samples of a code stream whose samples have ``depth`` bits."""
    if not 1 <= depth <= 8:
        raise ValueError("samples of no known size")
    clear, end = 1 << depth, (1 << depth) + 1
    width, before = _widths(end + 1)
    data = np.frombuffer(stream + b"\0\0\0\0", np.uint8).astype(np.uint32)
    bits, at, out, got = 8 * len(stream), 0, [], 0
    roots = [bytes([i]) for i in range(clear)] + [b"", b""]
    table, last, k = roots.copy(), b"", 0
    while at < bits and got < size:
        n = min(TABLE - k, TABLE) if k < TABLE else 1024
        w = width[k : k + n] if k < TABLE else np.full(n, 12)
        where = at + (before[k : k + n] - before[k] if k < TABLE else 12 * np.arange(n))
        fits = where + w <= bits
        where, w = where[fits], w[fits]
        if not len(where):
            break
        b = where >> 3
        codes = (data[b] | data[b + 1] << 8 | data[b + 2] << 16) >> (where & 7).astype(np.uint32) & ((1 << w) - 1).astype(np.uint32)
        stops = np.flatnonzero((codes == clear) | (codes == end))
        stop = int(stops[0]) if len(stops) else len(codes)
        at = int(where[min(stop, len(codes) - 1)] + w[min(stop, len(codes) - 1)])
        run = codes[:stop].tolist()
        if k == 0 and run:
            last = table[run[0]]
            out.append(last)
            got += len(last)
            run = run[1:]
            k = 1
        free, have = len(table), len(out)
        for code in run:
            if code < free:
                entry = table[code]
            elif code == free:
                entry = last + last[:1]
            else:
                raise ValueError("a code beyond the table")
            if free < TABLE:
                table.append(last + entry[:1])
                free += 1
            out.append(entry)
            last = entry
        k += len(run)
        got += sum(map(len, out[have:]))
        if stop < len(codes):
            if codes[stop] == end:
                break
            table, last, k = roots.copy(), b"", 0
    samples = b"".join(out)
    if len(samples) < size:
        raise ValueError("the code stream ends early")
    return samples[:size]


def palette() -> np.ndarray:
    """Colours of the 256 samples: from the highest on, their bits go to red, green and blue in turn, and fill the channels from their highest bits on."""
    sample = np.arange(256)
    colours = np.zeros((256, 3), np.uint8)
    for k in range(8):
        colours[:, k % 3] |= ((sample >> (7 - k) & 1) << (7 - k // 3)).astype(np.uint8)
    return colours


def encode(payload: bytes, delay: int = DELAY) -> bytes:
    """A GIF of the payload's samples; each frame covers the lines of the one before it, which stay."""
    step = ROW * LINES
    frames = [payload[i : i + step] for i in range(0, len(payload), step)]
    out = [b"GIF89a", struct.pack("<HHBBB", ROW, len(frames[0]) // ROW, 0xF7, 0, 0), palette().tobytes()]
    for frame in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", 1 << 2, delay, 0, 0))
        out.append(b"\x2c" + struct.pack("<HHHHB", 0, 0, ROW, len(frame) // ROW, 0) + b"\x08")
        stream = lzw_encode(frame)
        out += [bytes([len(stream[i : i + 255])]) + stream[i : i + 255] for i in range(0, len(stream), 255)]
        out.append(b"\0")
    out.append(b"\x3b")
    return b"".join(out)


class Frame(NamedTuple):
    start: int  # hundredths of a second
    delay: int
    samples: bytes  # the frame's own samples, line by line
    canvas: np.ndarray  # what is seen: lines x width x RGB and opacity


def _blocks(media: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while n := media[at]:
        parts.append(media[at + 1 : at + 1 + n])
        at += 1 + n
    return b"".join(parts), at + 1


def _lines(height: int) -> np.ndarray:
    """Where each stored line of an interlaced frame belongs."""
    return np.concatenate([np.arange(a, height, step) for a, step in ((0, 8), (4, 8), (2, 4), (1, 2))])


def decode(media: bytes) -> list[Frame]:
    """All frames as seen in turn, by their palettes, transparency and disposal."""
    try:
        return _decode(media)
    except (IndexError, OverflowError, struct.error) as e:
        raise ValueError("the file ends early") from e


def _decode(media: bytes) -> list[Frame]:
    if media[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack("<HHBBB", media[6:13])
    at = 13

    def colour_table(flags: int) -> np.ndarray:
        nonlocal at
        n = 3 << ((flags & 7) + 1)
        at += n
        colours = np.zeros((256, 4), np.uint8)
        colours[:, 3] = 255
        if at > len(media):
            raise ValueError("the file ends early")
        table = np.frombuffer(media[at - n : at], np.uint8).reshape(-1, 3)
        colours[: len(table), :3] = table
        return colours

    shared = colour_table(flags) if flags & 0x80 else np.zeros((256, 4), np.uint8)
    if width * height > LARGEST:
        raise ValueError("too large a screen")
    canvas = np.zeros((height, width, 4), np.uint8)
    frames: list[Frame] = []
    disposal, delay, clear_index, time = 0, 0, None, 0
    while media[at] != 0x3B:
        kind = media[at]
        at += 1
        if kind == 0x21:
            label = media[at]
            block, at = _blocks(media, at + 1)
            if label == 0xF9:
                packed, delay, index = struct.unpack("<BHB", block[:4])
                disposal, clear_index = packed >> 2 & 7, index if packed & 1 else None
            continue
        if kind != 0x2C:
            raise ValueError("an unknown block")
        left, upper, w, h, flags = struct.unpack("<HHHHB", media[at : at + 9])
        at += 9
        if upper + h > height or left + w > width:
            raise ValueError("a frame beyond the screen")
        colours = colour_table(flags) if flags & 0x80 else shared
        depth = media[at]
        stream, at = _blocks(media, at + 1)
        samples = np.frombuffer(lzw_decode(stream, depth, w * h), np.uint8).reshape(h, w)
        if flags & 0x40:
            samples = samples[np.argsort(_lines(h), kind="stable")]
        kept = canvas.copy() if disposal == 3 else None
        place = canvas[upper : upper + h, left : left + w]
        if clear_index is None:
            np.take(colours, samples, axis=0, out=place)
        else:
            seen = samples != clear_index
            place[seen] = colours[samples[seen]]
        frames.append(Frame(time, delay, samples.tobytes(), canvas.copy()))
        time += delay
        if disposal == 2:
            place[:] = 0
        elif kept is not None:
            canvas = kept
        disposal, delay, clear_index = 0, 0, None
    return frames


def histogram(canvas: np.ndarray) -> np.ndarray:
    """Counts of the visible pixels by colour, four steps a channel."""
    q = canvas >> 6
    bins = q[..., 0].astype(np.uint8) << 4 | q[..., 1] << 2 | q[..., 2]
    return np.bincount(bins[canvas[..., 3] > 0], minlength=64)


def payload(text: bytes) -> bytes:
    return text.ljust(max(1, -(-len(text) // ROW)) * ROW, b" ")


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each document's text as a GIF."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            texts = [(t or "").encode() for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([*map(len, texts)], pa.int64()), pa.array([encode(payload(t)) for t in texts], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(rows, "doc_id long, n_bytes long, media binary")


def frames(media: DataFrame) -> DataFrame:
    """doc_id, frame, start_cs, delay_cs, height, width, samples, histogram, error: the stored files' timed frames, and what is wrong with damaged files."""
    schema = pa.schema([("doc_id", pa.int64()), ("frame", pa.int32()), ("start_cs", pa.int64()), ("delay_cs", pa.int32()), ("height", pa.int32()), ("width", pa.int32()), ("samples", pa.binary()), ("histogram", pa.list_(pa.int64())), ("error", pa.string())])

    def seen(doc_id: int | None, file: bytes) -> list[tuple]:
        try:
            return [(doc_id, i, f.start, f.delay, *f.canvas.shape[:2], f.samples, histogram(f.canvas).tolist(), None) for i, f in enumerate(decode(file))]
        except ValueError as e:
            return [(doc_id, *[None] * 7, str(e))]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            out = [row for doc_id, file in zip(*(c.to_pylist() for c in batch.columns), strict=True) if file is not None for row in seen(doc_id, file)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return media.select("doc_id", "media").mapInArrow(rows, "doc_id long, frame int, start_cs long, delay_cs int, height int, width int, samples binary, histogram array<long>, error string")


def digests(media: DataFrame) -> DataFrame:
    """Of each stored file (doc_id, n_bytes, media): lengths and digests of what is stored and of what is read back, and the frames' colours; of a damaged one what is stored and what is wrong."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])

    def row(doc_id: int | None, n: int | None, file: bytes | None) -> tuple:
        sha = lambda x: hashlib.sha256(x).hexdigest()
        try:
            seen = decode(file or b"")
        except ValueError as e:
            return doc_id, n, None, None, None, *((None, None) if file is None else (len(file), sha(file))), None if file is None else f"error={e}"
        samples = b"".join(f.samples for f in seen)
        colours = sum((histogram(f.canvas) for f in seen), np.zeros(64, np.int64))
        feature = f"frames={len(seen)};cs={sum(f.delay for f in seen)};colours=" + ",".join(f"{i}:{colours[i]}" for i in np.flatnonzero(colours))
        return doc_id, n, len(samples), sha(samples), zlib.crc32(samples[-16:]), len(file), sha(file), feature

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            out = [row(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True) if out else [[]] * len(schema), schema, strict=True)], schema=schema)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(rows, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
