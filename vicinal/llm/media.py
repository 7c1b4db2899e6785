"""Media columns: bytes stored as PNG, read back with checks, and hashed by their low frequencies.

The writer and reader are ours: chunks with CRC-32, zlib streams (Adler-32 is tested by inflation), the five row filters undone with
numpy. The hash keeps the signs of the lowest 8 x 8 cosine coefficients of a 32 x 32 reduction against their median.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vicinal.llm.common import parts, ship

#: Fixed values of the format.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}
WIDTH, DEPTH = 64, 3
ROW = WIDTH * DEPTH
GRID, LOW = 32, 8
_COS = np.cos(np.pi * (2 * np.arange(GRID)[None, :] + 1) * np.arange(LOW)[:, None] / (2 * GRID))


class MediaError(ValueError):
    """A stream that is not a whole, sound PNG of 8-bit samples."""


def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(data, zlib.crc32(kind)))


def pad(data: bytes, row: int = ROW) -> bytes:
    """``data`` with spaces up to a positive multiple of ``row``."""
    return data.ljust(max(1, -(-len(data) // row)) * row, b" ")


def encode(payload: bytes, level: int = 1) -> bytes:
    """An RGB PNG of width 64 whose samples are ``payload``; each row has the filter (none, sub, up) of least absolute sum."""
    if not payload or len(payload) % ROW:
        raise MediaError("payload is no positive multiple of a row")
    rows = np.frombuffer(payload, np.uint8).reshape(-1, ROW)
    sub, up = rows.copy(), rows.copy()
    sub[:, DEPTH:] -= rows[:, :-DEPTH]
    up[1:] -= rows[:-1]
    forms = np.stack([rows, sub, up])
    best = np.abs(forms.view(np.int8).astype(np.int16)).sum(axis=2).argmin(axis=0)
    raw = np.empty((len(rows), ROW + 1), np.uint8)
    raw[:, 0] = best
    raw[:, 1:] = forms[best, np.arange(len(rows))]
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 2, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), level)) + _chunk(b"IEND", b"")


def _unfilter(raw: np.ndarray, bpp: int) -> np.ndarray:
    kinds, x = raw[:, 0], raw[:, 1:].copy()
    if kinds.max(initial=0) > 4:
        raise MediaError("unknown filter")
    at = 0
    while at < len(x):
        end = at + 1
        while end < len(x) and kinds[end] == kinds[at]:
            end += 1
        k, part = kinds[at], x[at:end]
        above = x[at - 1] if at else np.zeros(x.shape[1], np.uint8)
        if k == 1:
            x[at:end] = np.cumsum(part.reshape(len(part), -1, bpp), axis=1, dtype=np.uint8).reshape(part.shape)
        elif k == 2:
            part[0] += above
            x[at:end] = np.cumsum(part, axis=0, dtype=np.uint8)
        elif k > 2:
            for row in part:
                a, up = np.zeros(bpp, np.int16), above.astype(np.int16).reshape(-1, bpp)
                corner = np.zeros(bpp, np.int16)
                for i, pixel in enumerate(row.reshape(-1, bpp)):
                    b = up[i]
                    if k == 3:
                        guess = (a + b) >> 1
                    else:
                        p = a + b - corner
                        pa_, pb, pc = np.abs(p - a), np.abs(p - b), np.abs(p - corner)
                        guess = np.where((pa_ <= pb) & (pa_ <= pc), a, np.where(pb <= pc, b, corner))
                    pixel += guess.astype(np.uint8)
                    a, corner = pixel.astype(np.int16), b
                above = row
        at = end
    return x


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(kind, contents) up to the end chunk, with checksums tested."""
    if data[:8] != SIGNATURE:
        raise MediaError("no PNG signature")
    at = 8
    while at + 12 <= len(data):
        n, kind = struct.unpack_from(">I4s", data, at)
        part, crc = data[at + 8 : at + 8 + n], data[at + 8 + n : at + 12 + n]
        if len(crc) < 4 or zlib.crc32(part, zlib.crc32(kind)) != int.from_bytes(crc, "big"):
            raise MediaError(f"bad checksum in {kind!r}")
        yield kind, part
        if kind == b"IEND":
            return
        at += 12 + n
    raise MediaError("no end chunk")


def decode_image(data: bytes) -> tuple[np.ndarray, int]:
    """The samples, height x (width * channels), and the channels of a PNG of 8-bit samples; MediaError whatever else it is.

    No more is inflated than the header says, and nothing where that is more than a stream of this length can hold.
    """
    head, body = None, []
    for i, (kind, part) in enumerate(_chunks(data)):
        if (kind == b"IHDR") != (i == 0):
            raise MediaError("the header is not the first chunk, alone")
        if kind == b"IHDR":
            if len(part) != 13:
                raise MediaError("a header of another length")
            head = struct.unpack(">IIBBBBB", part)
        elif kind == b"IDAT":
            body.append(part)
    if head is None or head[2] != 8 or head[3] not in CHANNELS or any(head[4:]) or not head[0] or not head[1]:
        raise MediaError("incomplete or unsupported")
    width, height, bpp, packed = head[0], head[1], CHANNELS[head[3]], b"".join(body)
    size = height * (width * bpp + 1)
    if size > 1100 * len(packed):  # deflate makes less than that of a byte
        raise MediaError("wrong length")
    inflate = zlib.decompressobj()
    try:
        raw = inflate.decompress(packed, size + 1)
    except zlib.error as e:
        raise MediaError(str(e)) from e
    if len(raw) != size or not inflate.eof:
        raise MediaError("wrong length")
    return _unfilter(np.frombuffer(raw, np.uint8).reshape(height, -1), bpp), bpp


def decode(data: bytes) -> np.ndarray:
    return decode_image(data)[0]


def low_hash(samples: np.ndarray, channels: int = DEPTH) -> bytes:
    """Eight bytes: which of the lowest 8 x 8 cosine coefficients are above their median."""
    grey = samples.reshape(len(samples), -1, channels).sum(axis=2, dtype=np.int32)

    def reduce(x: np.ndarray) -> np.ndarray:
        n = len(x)
        starts = np.arange(GRID) * n // GRID
        if n < GRID:
            return x[starts].astype(np.float64)
        return np.add.reduceat(x, starts, axis=0) / np.diff(starts, append=n)[:, None]

    small = reduce(reduce(grey).T).T
    c = np.rint(_COS @ small @ _COS.T * 1e3).ravel()
    return np.packbits(c > np.median(c[1:])).tobytes()


def _encoded(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[pa.RecordBatch]:
    for part in parts(batches):
        data = [(x or "").encode() for x in part.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, data), pa.int64()), pa.array([encode(pad(x), level) for x in data], pa.binary())], names=["doc_id", "n_bytes", "media"])


def to_media(docs: DataFrame, level: int = 1) -> DataFrame:
    """(doc_id, n_bytes, media) from (doc_id, text): each whole text, null as empty, in a binary PNG column. Other columns are left out."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _encoded(it, level), "doc_id long, n_bytes long, media binary")


_OUT = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, low_hash binary, error string"


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, text=2):
        rows = []
        for media in batch.column(2).to_pylist():
            try:
                samples, channels = decode_image(media or b"")
            except MediaError as e:
                rows.append((None, None, None, len(media or b""), hashlib.sha256(media or b"").hexdigest(), None, str(e)))
                continue
            payload = samples.tobytes()
            rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), low_hash(samples, channels), None))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.string()]
        cols = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *cols], names=[c.split()[0] for c in _OUT.split(", ")])


def media_features(media: DataFrame) -> DataFrame:
    """Digests and the cosine hash of what ``to_media`` stored, from the stored bytes. A stream that is not sound has an error, and nulls for what is within it."""
    return media.select("doc_id", "n_bytes", "media").mapInArrow(_features, _OUT)


ship(__name__)
