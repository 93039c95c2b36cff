import hashlib
import random
import struct
import zlib

import pytest

from llm.cases import documents, empty, texts
from weftmine.llm import gif


@pytest.mark.parametrize("n", [1, 2, 191, 192, 5000, 200_000])
def test_code_streams_hold_what_was_written(n):
    r = random.Random(n)
    for samples in (bytes(r.randrange(256) for _ in range(n)), b"a" * n, bytes(r.choice(b"abc ") for _ in range(n))):
        assert gif.lzw_decode(gif.lzw_encode(samples), 8, n) == samples


def test_a_published_file_is_read():
    # 10 x 10 pixels of four colours, minimum code size 2: the well-known sample of GIF tutorials.
    stream = bytes.fromhex("8c2d99872a1cdc33a00275ec95faa8de608c04914c01")
    out = gif.lzw_decode(stream, 2, 100)
    assert out[:10] == bytes([1, 1, 1, 1, 1, 2, 2, 2, 2, 2]) and out[33:37] == bytes([0, 0, 0, 0])
    assert out[-10:] == bytes([2, 2, 2, 2, 2, 1, 1, 1, 1, 1])


def _file(frames, size=(2, 1), palette=bytes([10, 20, 30, 250, 0, 0] + [0] * 762)):
    out = [b"GIF89a", struct.pack("<HHBBB", *size, 0xF7, 0, 0), palette]
    for disposal, clear, place, samples in frames:
        out.append(b"\x21\xf9\x04" + struct.pack("<BHBB", disposal << 2 | (clear is not None), 5, clear or 0, 0))
        stream = gif.lzw_encode(samples)
        out.append(b"\x2c" + struct.pack("<HHHHB", *place, 0) + b"\x08" + bytes([len(stream)]) + stream + b"\0")
    return b"".join([*out, b"\x3b"])


def test_transparency_and_disposal():
    file = _file([(1, None, (0, 0, 2, 1), b"\0\0"), (2, 0, (0, 0, 2, 1), b"\0\1"), (3, None, (1, 0, 1, 1), b"\0"), (0, None, (0, 0, 1, 1), b"\1")])
    seen = [f.canvas.tolist()[0] for f in gif.decode(file)]
    first, second = [10, 20, 30, 255], [250, 0, 0, 255]
    assert seen == [[first, first], [first, second], [[0] * 4, first], [second, [0] * 4]]
    assert [f.start for f in gif.decode(file)] == [0, 5, 10, 15]


def test_interlaced_lines_go_where_they_belong():
    assert gif._lines(10).tolist() == [0, 8, 4, 2, 6, 1, 3, 5, 7, 9]


def test_damaged_files_raise():
    with pytest.raises(ValueError):
        gif.decode(gif.encode(gif.payload(b"abc"))[:-20])


def test_damage_anywhere_is_a_value_error():
    r = random.Random(5)
    whole = gif.encode(gif.payload(b"some words and others " * 40))
    for i in range(0, len(whole), 2):
        file = bytearray(whole)
        file[i] = r.randrange(256)
        for damaged in (bytes(file), whole[:i], bytes(file[:i]) + bytes(file[i + 1 :])):
            try:
                gif.decode(damaged)
            except ValueError:
                pass


def test_no_more_is_expanded_than_asked_for():
    """A stream of long entries stops soon after the samples that the frame has."""
    stream = gif.lzw_encode(b"a" * 5_000_000)
    assert gif.lzw_decode(stream, 8, 100) == b"a" * 100
    with pytest.raises(ValueError, match="too large"):
        gif.decode(b"GIF89a" + struct.pack("<HHBBB", 65535, 65535, 0, 0, 0) + b"\x3b")


def test_a_damaged_file_is_a_row(spark):
    good = gif.encode(gif.payload(b"abc"))
    files = [(1, 3, good), (2, 3, good[:-20]), (3, 0, None), (None, 3, good), (4, 9, b"GIF89a"), (5, 1, b""), (1, 3, good)]
    media = spark.createDataFrame([(*f, "x") for f in files], "doc_id long, n_bytes long, media binary, error string")
    rows = gif.frames(media).collect()
    assert sorted((r.doc_id or 0, r.frame, bool(r.error)) for r in rows if r.error is None) == [(0, 0, False), (1, 0, False), (1, 0, False)]
    assert sorted(r.doc_id for r in rows if r.error) == [2, 4, 5] and all(r.samples is None for r in rows if r.error)
    got = sorted(((r.doc_id or 0, r.payload_bytes, r.media_bytes) for r in gif.digests(media).collect()), key=str)
    assert got == sorted([(1, 192, len(good)), (1, 192, len(good)), (2, None, len(good) - 20), (3, None, None), (0, 192, len(good)), (4, None, 6), (5, None, 0)], key=str)


def test_samples_have_colours_of_their_own_in_all_bins():
    import numpy as np

    colours = gif.palette()
    assert len({tuple(c) for c in colours.tolist()}) == 256
    canvas = np.concatenate([colours, np.full((256, 1), 255, np.uint8)], 1)[None]
    assert gif.histogram(canvas).tolist() == [4] * 64


def test_digests_are_of_what_is_stored_and_read_back(spark):
    rows = gif.digests(gif.store(documents(spark))).collect()
    assert len(rows) == len(texts())
    for r in rows:
        text = (texts()[r.doc_id] or "").encode()
        payload = text + b" " * (-len(text) % 192 if text else 192)
        assert (r.n_bytes, r.payload_bytes) == (len(text), len(payload))
        assert r.payload_sha256 == hashlib.sha256(payload).hexdigest() and r.tail_crc32 == zlib.crc32(payload[-16:])
        file = gif.encode(payload)
        assert (r.media_bytes, r.media_sha256) == (len(file), hashlib.sha256(file).hexdigest())
        assert len(file) < 2 * len(payload) + 1000


def test_frames_of_stored_files(spark):
    rows = gif.frames(gif.store(documents(spark))).collect()
    long = [r for r in rows if r.doc_id == len(texts()) - 1]
    assert b"".join(r.samples for r in sorted(long, key=lambda r: r.frame)).rstrip() == texts()[-1].encode()
    assert len(long) > 1 and [r.start_cs for r in sorted(long, key=lambda r: r.frame)] == [10 * i for i in range(len(long))]
    assert all(sum(r.histogram) == r.height * r.width for r in rows if r.frame == 0)


def test_empty_table(spark):
    assert gif.digests(gif.store(empty(spark))).collect() == [] and gif.frames(gif.store(empty(spark))).collect() == []
