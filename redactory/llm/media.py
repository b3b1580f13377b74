"""AVI motion-JPEG columns: bytes stored as frames, frames read back, shots found.

A clip is a RIFF/AVI file of one 24 x 24 grey motion-JPEG stream at 25 frames a
second. A frame's nine blocks hold 576 quantised coefficients, JPEG's lossless
unit: coefficient magnitude class 8 has 256 values, so each byte is one
coefficient and an entropy code of one bit serves all. Restart markers after each
block keep every value absolute. Any baseline decoder reads such frames.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from redactory.llm.common import per_batch, texts_of

SIDE, UNIT, BLOCKS, FPS = 24, 576, 9, 25
BINS = 16
#: Shots: a cut is a histogram change above mean + SPREAD deviations of the WINDOW changes before it, and above FLOOR.
WINDOW, SPREAD, FLOOR, LEAST = 12, 2.5, 0.08, 4

# Fixed values of the JPEG format: coefficient order in a block.
ZIGZAG = np.array([r * 8 + s - r for s in range(15) for r in (range(min(s, 7), max(0, s - 7) - 1, -1) if s % 2 == 0 else range(max(0, s - 7), min(s, 7) + 1))])
_K = np.arange(8)
IDCT = (np.cos((2 * _K[:, None] + 1) * _K[None, :] * np.pi / 16) * np.where(_K == 0, np.sqrt(0.125), 0.5)).astype(np.float32)  # [sample, frequency]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


#: Start of every frame written here: unit quantisation, 24 x 24 grey, one code for class 8, a restart after each block.
FRAME_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0")
    + _segment(0xC4, b"\x00" + b"\1" + b"\0" * 15 + b"\x08" + b"\x10" + b"\1" + b"\0" * 15 + b"\x08")
    + _segment(0xDD, b"\0\1")
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)
MARKS = np.array([[0xFF, 0xD0 + b] for b in range(8)] + [[0xFF, 0xD9]], np.uint8)


def pad(data: bytes) -> bytes:
    """Bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * (-len(data) % UNIT or (0 if data else UNIT))


def write_avi(payload: bytes) -> bytes:
    """A clip whose frames hold the payload, a multiple of 576 bytes."""
    values = np.frombuffer(payload, np.uint8).reshape(-1, BLOCKS, 64)
    n = len(values)
    bits = np.zeros((n * BLOCKS, 64, 9), np.uint8)
    bits[:, :, 1:] = np.unpackbits(values.reshape(-1, 64, 1), axis=2)
    head = np.frombuffer(b"00dc\0\0\0\0" + FRAME_HEAD, np.uint8)
    rows = np.empty((n, len(head) + BLOCKS * 74), np.uint8)
    rows[:, : len(head)] = head
    body = rows[:, len(head) :].reshape(n, BLOCKS, 74)
    body[:, :, :72] = np.packbits(bits.reshape(n * BLOCKS, 576), axis=1).reshape(n, BLOCKS, 72)
    body[:, :, 72:] = MARKS
    stuff = np.zeros(rows.shape, bool)
    stuff[:, len(head) :].reshape(n, BLOCKS, 74)[:, :, :72] = body[:, :, :72] == 255
    sizes = rows.shape[1] - 8 + stuff.sum(1)
    rows[:, 4:8] = sizes.astype("<u4").view(np.uint8).reshape(n, 4)
    after = np.flatnonzero(stuff.ravel()) + 1
    odd = (np.flatnonzero(sizes % 2) + 1) * rows.shape[1]
    movi = np.insert(rows.ravel(), np.sort(np.concatenate([after, odd])), 0).tobytes()
    spans = 8 + sizes + sizes % 2
    at = 4 + np.concatenate([[0], np.cumsum(spans)[:-1]])
    index = np.empty((n, 4), "<u4")
    index[:] = np.array([np.frombuffer(b"00dc", "<u4")[0], 0x10, 0, 0])
    index[:, 2], index[:, 3] = at, sizes

    def chunk(kind: bytes, data: bytes) -> bytes:
        return kind + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)

    top = int(sizes.max())
    avih = struct.pack("<14I", 1_000_000 // FPS, top * FPS, 0, 0x10, n, 0, 1, top, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, n, top, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    return chunk(b"RIFF", b"AVI " + hdrl + chunk(b"LIST", b"movi" + movi) + chunk(b"idx1", index.tobytes()))


def read_index(media: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Frames a second, and place and size of every video frame, from a RIFF file's header and index."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    fps, movi, index, at, ends = float(FPS), 0, None, 12, 8 + struct.unpack_from("<I", media, 4)[0]
    while at + 8 <= ends:
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"LIST" and media[at + 8 : at + 12] == b"hdrl":
            fps = 1e6 / max(1, struct.unpack_from("<I", media, media.index(b"avih", at) + 8)[0])
        elif kind == b"LIST" and media[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif kind == b"idx1":
            index = np.frombuffer(media, "<u4", size // 4, at + 8).reshape(-1, 4)
        at += 8 + size + size % 2
    if index is None:
        raise ValueError("no index")
    video = index[(index[:, 0] & 0xFFFF0000) == (np.frombuffer(b"00dc", "<u4")[0] & 0xFFFF0000)]
    return fps, [(movi + int(a) + 8, int(n)) for a, n in video[:, 2:]]


def read_tables(frame: bytes) -> dict:
    """Quantisation, size, codes and the scan's start of a grey baseline JPEG."""
    out: dict = {"restart": 0, "codes": {}}
    at = 2
    while True:
        marker, size = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body = frame[at + 4 : at + 2 + size]
        if marker == 0xDB:
            out["quant"] = np.frombuffer(body[1:65], np.uint8).astype(np.int32)
        elif marker == 0xC0:
            out["high"], out["wide"], parts = struct.unpack_from(">HHB", body, 1)
            if parts != 1:
                raise ValueError("grey frames only")
        elif marker == 0xC4:
            while body:
                counts, symbols, code, k = body[1:17], body[17:], 0, 0
                table = {}
                for n, count in enumerate(counts, 1):
                    for _ in range(count):
                        table[n, code] = symbols[k]
                        code, k = code + 1, k + 1
                    code <<= 1
                out["codes"][body[0] >> 4] = table
                body = body[17 + k :]
        elif marker == 0xDD:
            out["restart"] = struct.unpack(">H", body)[0]
        at += 2 + size
        if marker == 0xDA:
            return out | {"data": at}


ONE_CODE = {0: {(1, 0): 8}, 1: {(1, 0): 8}}


def decode_scan(data: bytes, tables: dict) -> np.ndarray:
    """Coefficients of any grey baseline scan, code by code: (blocks, 64) in zigzag order."""
    n_blocks = -(-tables["high"] // 8) * -(-tables["wide"] // 8)
    out, parts, start, at = np.zeros((n_blocks, 64), np.int32), [], 0, 0
    while at < len(data) - 1:  # cut at restart markers
        if data[at] == 0xFF and data[at + 1] != 0:
            parts.append(data[start:at])
            start = at + 2
            if data[at + 1] == 0xD9:
                break
            at += 1
        at += 1
    done = 0
    for part in parts:
        bits = np.unpackbits(np.frombuffer(part.replace(b"\xff\x00", b"\xff"), np.uint8)).tolist()
        pos = before = 0

        def symbol(kind: int) -> int:
            nonlocal pos
            code = 0
            for n in range(1, 17):
                code = code << 1 | bits[pos]
                pos += 1
                if (found := tables["codes"][kind].get((n, code))) is not None:
                    return found
            raise ValueError("bad code")

        def value(size: int) -> int:
            nonlocal pos
            v = int("".join(map(str, bits[pos : pos + size])) or "0", 2)
            pos += size
            return v if not size or v >> (size - 1) else v - (1 << size) + 1

        for _ in range(min(tables["restart"] or n_blocks, n_blocks - done)):
            before += value(symbol(0))
            out[done, 0] = before
            k = 1
            while k < 64:
                run, size = divmod(symbol(1), 16)
                if not size and run != 15:
                    break
                k += run
                if size:
                    out[done, k] = value(size)
                k += 1
            done += 1
    return out


def read_avi(media: bytes) -> tuple[float, np.ndarray, np.ndarray]:
    """Frames a second, coefficients (frames, blocks, 64) and samples (frames, pixels by block) of a clip."""
    fps, places = read_index(media)
    heads: dict[bytes, dict] = {}
    frames, same, tables = [], True, None
    for at, size in places:
        frame = media[at : at + size]
        if not (heads and frame.startswith(next(iter(heads)))):
            tables = read_tables(frame)
            heads[frame[: tables["data"]]] = tables
            same &= len(heads) == 1
        frames.append(frame[tables["data"] :])
    if same and tables["codes"] == ONE_CODE and tables["restart"] == 1:
        n = -(-tables["high"] // 8) * -(-tables["wide"] // 8)
        body = np.frombuffer(b"".join(x.replace(b"\xff\x00", b"\xff") for x in frames), np.uint8).reshape(len(frames), n, 74)
        bits = np.unpackbits(np.ascontiguousarray(body[:, :, :72]).reshape(-1, 72), axis=1).reshape(-1, 64, 9)
        if bits[:, :, 0].any():
            raise ValueError("bad code")
        raw = np.packbits(bits[:, :, 1:], axis=2).reshape(len(frames), n, 64).astype(np.int32)
        coefficients = np.where(raw >= 128, raw, raw - 255)
    else:
        coefficients = np.stack([decode_scan(x, t) for x, t in zip(frames, [tables] * len(frames) if same else map(read_tables, (media[a : a + s] for a, s in places)), strict=True)])
    blocks = np.zeros((*coefficients.shape[:2], 64), np.float32)
    blocks[:, :, ZIGZAG] = coefficients * tables["quant"]
    samples = IDCT @ blocks.reshape(-1, 8, 8) @ IDCT.T
    return fps, coefficients, np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8).reshape(len(frames), -1)


def payload_of(coefficients: np.ndarray) -> bytes:
    return np.where(coefficients > 0, coefficients, coefficients + 255).astype(np.uint8).tobytes()


def shots(samples: np.ndarray) -> list[tuple[int, int]]:
    """Shots as frame ranges, from changes of the grey histogram against a moving threshold."""
    n = len(samples)
    flat = (samples >> 4).astype(np.int64) + np.arange(n)[:, None] * BINS
    histogram = np.bincount(flat.ravel(), minlength=n * BINS).reshape(n, BINS) / samples.shape[1]
    change = np.abs(np.diff(histogram, axis=0)).sum(1) / 2
    one, two = np.concatenate([[0], np.cumsum(change)]), np.concatenate([[0], np.cumsum(change**2)])
    ends = np.arange(len(change))
    starts = np.maximum(ends - WINDOW, 0)
    count = np.maximum(ends - starts, 1)
    mean = (one[ends] - one[starts]) / count
    spread = np.sqrt(np.maximum((two[ends] - two[starts]) / count - mean**2, 0))
    cuts = np.flatnonzero((ends - starts >= LEAST) & (change > np.maximum(mean + SPREAD * spread, FLOOR))) + 1
    borders = [0, *cuts.tolist(), n]
    return list(zip(borders[:-1], borders[1:], strict=True))


def encode_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text (null: empty) as an AVI clip."""

    def setup():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            data = [t.encode() for t in texts_of(batch)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(d) for d in data], pa.int64()), pa.array([write_avi(pad(d)) for d in data], pa.binary())], ["doc_id", "n_bytes", "media"])

        return step

    return per_batch(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), setup, "doc_id long, n_bytes long, media binary")


def decode_media(media: DataFrame) -> DataFrame:
    """Payload digests and timed clips of each stored clip.

    clips: array of (start_ms, end_ms, frames). Rows whose media is null give null
    digests and no clips; repeated rows give repeated rows.
    """

    def setup():
        def step(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for blob in batch.column("media"):
                if (m := blob.as_py()) is None:
                    rows.append((None,) * 5 + ([], None))
                    continue
                fps, coefficients, samples = read_avi(m)
                payload = payload_of(coefficients)
                clips = [{"start_ms": round(a * 1000 / fps), "end_ms": round(b * 1000 / fps), "frames": b - a} for a, b in shots(samples)]
                feature = f"{SIDE}x{SIDE}@{fps:g} frames={len(samples)} shots=" + ",".join(f"{c['start_ms']}-{c['end_ms']}" for c in clips)
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(m), hashlib.sha256(m).hexdigest(), clips, feature))
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start_ms", pa.int64()), ("end_ms", pa.int64()), ("frames", pa.int64())])), pa.string()]
            columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("n_bytes"), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips", "feature"])

        return step

    return per_batch(media.select("doc_id", "n_bytes", "media"), setup, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<start_ms:long,end_ms:long,frames:long>>, feature string")


def clip_rows(decoded: DataFrame) -> DataFrame:
    """One row per shot: doc_id, clip, start_ms, end_ms, frames."""
    return decoded.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")
