"""Media columns: bytes kept losslessly as the DCT coefficients of motion-JPEG frames in AVI files, and their shots.

Each 8 x 8 block holds 64 bytes of payload, one to a coefficient. A byte's eight bits are the amplitude bits of a
category-8 coefficient (128..255 for itself, -255..-128 for 0..127), quantised by 1, with one-bit Huffman codes and a
restart after each block; so no coefficient is zero and any baseline decoder reads the frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, small_batches

WIDTH, HEIGHT = 64, 32
BLOCKS = WIDTH * HEIGHT // 64
FRAME_BYTES = BLOCKS * 64
FPS = 25
BINS = 16
#: A shot starts where a frame's histogram difference is over RISE times the mean of the last SPAN differences plus FLOOR pixels.
RISE, SPAN, FLOOR = 2, 8, 64


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _jpeg_head() -> bytes:
    one_code = bytes([1] + [0] * 15 + [8])
    return (
        b"\xff\xd8"
        + _segment(0xDB, bytes([0] + [1] * 64))
        + _segment(0xC0, struct.pack(">BHHBBBB", 8, HEIGHT, WIDTH, 1, 1, 0x11, 0))
        + _segment(0xC4, bytes([0x00]) + one_code)
        + _segment(0xC4, bytes([0x10]) + one_code)
        + _segment(0xDD, struct.pack(">H", 1))
        + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


HEAD = _jpeg_head()


def _frames(payload: np.ndarray) -> list[bytes]:
    n = -(-len(payload) // FRAME_BYTES)
    whole = np.zeros(n * FRAME_BYTES, np.uint8)
    whole[: len(payload)] = payload
    bits = np.zeros((len(whole), 9), np.uint8)
    bits[:, 1:] = np.unpackbits(whole).reshape(-1, 8)
    blocks = np.empty((n * BLOCKS, 74), np.uint8)
    blocks[:, :72] = np.packbits(bits.reshape(-1)).reshape(-1, 72)
    blocks[:, 72] = 0xFF
    at = np.arange(n * BLOCKS) % BLOCKS
    blocks[:, 73] = np.where(at == BLOCKS - 1, 0xD9, 0xD0 + at % 8)
    more = np.zeros(blocks.shape, np.int64)
    more[:, :72] = blocks[:, :72] == 0xFF
    ends = np.cumsum(more.reshape(-1) + 1)
    out = np.zeros(ends[-1], np.uint8)
    out[ends - 1 - more.reshape(-1)] = blocks.reshape(-1)
    cuts = [0, *ends[BLOCKS * 74 - 1 :: BLOCKS * 74].tolist()]
    raw = out.tobytes()
    return [HEAD + raw[a:b] for a, b in zip(cuts, cuts[1:])]


def _chunk(tag: bytes, body: bytes) -> bytes:
    return tag + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def encode(payload: bytes) -> bytes:
    """An AVI file whose motion-JPEG frames hold the payload, a positive multiple of 64 bytes."""
    frames = _frames(np.frombuffer(payload, np.uint8))
    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(frames), 0, 1, most, WIDTH, HEIGHT, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiI4H", 0, 0, 0, 0, 1, FPS, 0, len(frames), most, -1, 0, 0, 0, WIDTH, HEIGHT)
    strf = struct.pack("<IiiHH4sIiiII", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", WIDTH * HEIGHT * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    info = _chunk(b"LIST", b"INFO" + _chunk(b"ICMT", b"payload=%d\0" % len(payload)))
    body, index, at = [], [], 4
    for f in frames:
        c = _chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        body.append(c)
        at += len(c)
    return _chunk(b"RIFF", b"AVI " + hdrl + info + _chunk(b"LIST", b"movi" + b"".join(body)) + _chunk(b"idx1", b"".join(index)))


def _walk(data: bytes, start: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while start + 8 <= end:
        tag, size = data[start : start + 4], struct.unpack_from("<I", data, start + 4)[0]
        yield tag, start + 8, start + 8 + size
        start += 8 + size + size % 2


def parse(avi: bytes) -> tuple[list[bytes], int, int]:
    """The frames that the RIFF index names, frames a second, and the payload's length."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    movi = index = None
    length, fps = -1, 0
    for tag, a, b in _walk(avi, 12, 8 + struct.unpack_from("<I", avi, 4)[0]):
        kind = avi[a : a + 4]
        if tag == b"LIST" and kind == b"movi":
            movi = a
        elif tag == b"LIST" and kind == b"INFO":
            length = next(int(avi[x:y].rstrip(b"\0").partition(b"=")[2]) for t, x, y in _walk(avi, a + 4, b) if t == b"ICMT")
        elif tag == b"LIST" and kind == b"hdrl":
            fps = next(1_000_000 // struct.unpack_from("<I", avi, x)[0] for t, x, _ in _walk(avi, a + 4, b) if t == b"avih")
        elif tag == b"idx1":
            index = np.frombuffer(avi[a:b], np.dtype([("tag", "S4"), ("flags", "<u4"), ("at", "<u4"), ("size", "<u4")]))
    return [avi[movi + int(e["at"]) + 8 : movi + int(e["at"]) + 8 + int(e["size"])] for e in index if e["tag"] == b"00dc"], fps, length


def _scan(frame: bytes) -> bytes:
    """The entropy-coded bytes of a frame, between its start of scan and end of image."""
    at = 2
    while frame[at + 1] != 0xDA:
        at += 2 + struct.unpack_from(">H", frame, at + 2)[0]
    return frame[at + 2 + struct.unpack_from(">H", frame, at + 2)[0] : -2]


def decode(avi: bytes) -> tuple[bytes, np.ndarray, int]:
    """The payload, the coefficients' amplitude bits of all blocks (n, 64), and frames a second."""
    frames, fps, length = parse(avi)
    raw = np.frombuffer(b"".join(map(_scan, frames)), np.uint8)
    ff = raw == 0xFF
    gone = np.zeros(len(raw), bool)
    gone[1:] = ff[:-1]  # a stuffed zero or a restart's number
    gone[:-1] |= ff[:-1] & (raw[1:] >= 0xD0) & (raw[1:] <= 0xD7)
    bits = np.unpackbits(raw[~gone]).reshape(-1, 9)
    if bits[:, 0].any():
        raise ValueError("a code that the tables do not have")
    values = np.packbits(bits[:, 1:].reshape(-1)).reshape(-1, 64)
    return values.reshape(-1)[:length].tobytes(), values, fps


def _zigzag() -> np.ndarray:
    """For each zigzag place the place in row order."""
    cells = sorted(((r, c) for r in range(8) for c in range(8)), key=lambda x: (x[0] + x[1], x[0] if (x[0] + x[1]) % 2 else x[1]))
    return np.array([r * 8 + c for r, c in cells])


ZIGZAG = _zigzag()
_k = np.arange(8)
#: The cosine transform's matrix times 4096, rounded: all sums below are whole numbers that doubles hold exactly.
COSINE = np.rint(4096 * np.where(_k[:, None] == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16))


def luma(values: np.ndarray) -> np.ndarray:
    """Pixels 0..255 of each block (n, 64) from the amplitude bits."""
    v = values.astype(np.float64)
    rows = np.empty_like(v)
    rows[:, ZIGZAG] = np.where(v >= 128, v, v - 255)
    x = rows.reshape(-1, 8, 8)
    p = np.matmul(np.matmul(COSINE.T, x), COSINE) / (1 << 24)
    return np.clip(np.floor(p + 128.5), 0, 255).astype(np.int64).reshape(-1, 64)


def shots(values: np.ndarray, fps: int) -> tuple[list[tuple[float, float]], np.ndarray]:
    """Start and end in seconds of each shot, and the histogram of the whole clip."""
    n = len(values) // BLOCKS
    frame = np.repeat(np.arange(n) * BINS, FRAME_BYTES)
    h = np.bincount(frame + luma(values).reshape(-1) // (256 // BINS), minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(h, axis=0)).sum(1)
    c = np.concatenate([[0], np.cumsum(d)])
    at = np.arange(len(d))
    low = np.maximum(at - SPAN, 0)
    cut = (at > 0) & (d * (at - low) > RISE * (c[at] - c[low]) + FLOOR * (at - low))
    edges = [0, *(np.flatnonzero(cut) + 1).tolist(), n]
    return [(a / fps, b / fps) for a, b in zip(edges, edges[1:])], h.sum(0)


def payload_of(text: bytes) -> bytes:
    return text + b"\0" * (max(64, -(-len(text) // 64) * 64) - len(text))


def digest(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature for every row of docs (doc_id, text).

    Null text counts as empty; the payload is padded with zero bytes to a positive multiple of 64. Everything but
    n_bytes comes from the stored file read back. feature: frames, shots, their times in seconds, the summed histogram.
    Equal texts give equal values; repeated rows are rows each; an empty table gives no rows.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    names = ["n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def one(text: bytes) -> tuple:
        media = encode(payload_of(text))
        payload, values, fps = decode(media)
        clips, histogram = shots(values, fps)
        feature = f"frames={len(values) // BLOCKS};shots={len(clips)};clips={','.join(f'{a:.2f}-{b:.2f}' for a, b in clips)};histogram={','.join(map(str, histogram))}"
        return len(text), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, data, offs in chunks(batches, "text"):
            raw = data.tobytes()
            got = [one(raw[a:b]) for a, b in zip(offs[:-1], offs[1:])]
            yield pa.RecordBatch.from_arrays([rows.column(0), *[pa.array(x) for x in zip(*got)]], names=["doc_id", *names])

    small_batches(docs.sparkSession)
    return docs.select("doc_id", "text").mapInArrow(work, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def clips(media: DataFrame) -> DataFrame:
    """media_id, clip, start_s, end_s: a row for each shot of each row's AVI file in media (media_id, media). Null media give none."""
    kind = media.schema["media_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(i, k, *t) for i, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) if m is not None for k, t in enumerate(shots(*decode(m)[1:])[0])]
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], b.schema.field(0).type), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.float64()), pa.array(cols[3], pa.float64())], names=["media_id", "clip", "start_s", "end_s"])

    return media.select("media_id", "media").mapInArrow(work, f"media_id {kind}, clip int, start_s double, end_s double")
