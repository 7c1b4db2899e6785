import hashlib
import random
import struct
import tracemalloc
import zlib

import numpy as np
import pytest

from tests.llm.data import SCHEMA, rows
from vicinal.llm.media import ROW, SIGNATURE, MediaError, decode, encode, low_hash, media_features, pad, to_media


def chunk(kind, data):
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))


def plain(width, height, colour, raw, parts=3):
    body = zlib.compress(raw)
    cut = [body[i * len(body) // parts : (i + 1) * len(body) // parts] for i in range(parts)]
    return SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)) + chunk(b"tEXt", b"a\0b") + b"".join(chunk(b"IDAT", c) for c in cut) + chunk(b"IEND", b"")


def filtered(rows, bpp, kinds):
    """Rows under the given filters, byte by byte."""
    out, above = bytearray(), [0] * len(rows[0])
    for row, k in zip(rows, kinds):
        out.append(k)
        for i, x in enumerate(row):
            a, b, c = (row[i - bpp] if i >= bpp else 0), above[i], (above[i - bpp] if i >= bpp else 0)
            p = a + b - c
            paeth = min(((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - c), 2, c)))[2]
            out.append((x - [0, a, b, (a + b) // 2, paeth][k]) % 256)
        above = row
    return bytes(out)


@pytest.mark.parametrize("colour,bpp", [(0, 1), (2, 3), (4, 2), (6, 4)])
def test_all_filters_are_undone(colour, bpp):
    rng = np.random.default_rng(1)
    rows_ = rng.integers(0, 256, (40, 7 * bpp)).tolist()
    kinds = rng.integers(0, 5, 40).tolist()
    assert decode(plain(7, 40, colour, filtered(rows_, bpp, kinds))).tolist() == rows_


def test_round_trip():
    rng = np.random.default_rng(2)
    for n in (0, 1, 191, 192, 193, 5000):
        data = pad(rng.integers(0, 256, n, dtype=np.uint8).tobytes())
        assert len(data) % ROW == 0 and decode(encode(data)).tobytes() == data


def test_damage_is_found():
    good = encode(pad(b"some text " * 100))
    for at in range(8, len(good), 7):
        with pytest.raises(MediaError):
            decode(good[:at] + bytes([good[at] ^ 1]) + good[at + 1 :])
    for cut in (0, 5, 30, len(good) - 1):
        with pytest.raises(MediaError):
            decode(good[:cut])


def test_hash_is_of_low_frequencies():
    y = sum(a * np.outer(np.cos(np.pi * (np.arange(64) + 0.5) * i / 64), np.cos(np.pi * (np.arange(64) + 0.5) * j / 64)) for i in range(8) for j in range(8) for a in [3 * (-1) ** (i * j + i)])
    x = (128 + y).clip(0, 255).astype(np.uint8).repeat(3, axis=1)
    noisy = (x.astype(int) + np.random.default_rng(3).integers(-2, 3, x.shape)).clip(0, 255).astype(np.uint8)
    bits = lambda a: np.unpackbits(np.frombuffer(low_hash(a), np.uint8))
    assert (bits(x) != bits(noisy)).sum() <= 8
    assert len(low_hash(x[:1])) == 8


def test_documents(spark):
    data = [(*r, "m") for r in rows()]
    d = spark.createDataFrame(data + data[:1], SCHEMA + ", media string")
    out = media_features(to_media(d)).collect()
    assert len(out) == len(data) + 1
    texts = {r[0]: pad((r[1] or "").encode()) for r in data}
    for r in out:
        p = texts[r["doc_id"]]
        assert r["payload_bytes"] == len(p) and r["payload_sha256"] == hashlib.sha256(p).hexdigest() and r["tail_crc32"] == zlib.crc32(p[-16:])
    by = {}
    for r in out:
        by.setdefault(texts[r["doc_id"]], set()).add((r["media_sha256"], bytes(r["low_hash"])))
    assert all(len(v) == 1 for v in by.values())
    assert media_features(to_media(spark.createDataFrame([], SCHEMA))).count() == 0


def mutated(rng, data):
    """The same chunks with some bytes changed, some cut, doubled or dropped, and right checksums."""
    parts, at = [], 8
    while at + 12 <= len(data):
        n = int.from_bytes(data[at : at + 4], "big")
        parts.append((data[at + 4 : at + 8], bytearray(data[at + 8 : at + 8 + n])))
        at += 12 + n
    for _ in range(rng.randint(1, 3)):
        k = rng.randrange(len(parts))
        kind, part = parts[k]
        how = rng.randrange(5)
        if how == 0 and part:
            part[rng.randrange(len(part))] = rng.choice([0, 1, 2, 4, 16, 255, rng.randrange(256)])
        elif how == 1:
            del part[rng.randrange(len(part) + 1) :]
        elif how == 2:
            parts.insert(k, parts[rng.randrange(len(parts))])
        elif how == 3 and len(parts) > 1:
            parts.pop(k)
        else:
            part += bytes(rng.randrange(20))
    return SIGNATURE + b"".join(chunk(k, bytes(p)) for k, p in parts)


def test_malformed_streams_with_right_checksums():
    rng = random.Random(9)
    seeds = [encode(pad(b"some text " * 50)), plain(7, 3, 0, filtered([[1, 2, 3, 4, 5, 6, 7]] * 3, 1, [0, 3, 4])), plain(1, 1, 6, b"\x00abcd")]
    sound = 0
    for _ in range(3000):
        try:
            decode(mutated(rng, rng.choice(seeds)))
            sound += 1
        except MediaError:
            pass
    assert sound < 1500
    for head in (b"a" * 12, struct.pack(">IIBBBBB", 64, 0, 8, 2, 0, 0, 0), struct.pack(">IIBBBBB", 0, 64, 8, 2, 0, 0, 0), struct.pack(">IIBBBBB", 1 << 31, 1 << 31, 8, 2, 0, 0, 0)):
        with pytest.raises(MediaError):
            decode(SIGNATURE + chunk(b"IHDR", head) + chunk(b"IDAT", zlib.compress(b"")) + chunk(b"IEND", b""))


def test_inflation_stops_at_the_header():
    bomb = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 900, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(1 << 26), 9)) + chunk(b"IEND", b"")
    tracemalloc.start()
    with pytest.raises(MediaError):
        decode(bomb)
    assert tracemalloc.get_traced_memory()[1] < 1 << 21
    tracemalloc.stop()


def test_unsound_streams_have_an_error(spark):
    grey = plain(7, 3, 0, filtered([[1, 2, 3, 4, 5, 6, 7]] * 3, 1, [0, 1, 2]))
    zero = SIGNATURE + chunk(b"IHDR", struct.pack(">IIBBBBB", 64, 0, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"")) + chunk(b"IEND", b"")
    short = SIGNATURE + chunk(b"IHDR", b"a" * 12) + chunk(b"IEND", b"")
    d = spark.createDataFrame([(1, 5, encode(pad(b"hello"))), (2, 21, grey), (3, 0, zero), (4, 0, short), (5, 0, None), (6, 0, b"")], "doc_id long, n_bytes long, media binary")
    out = {r["doc_id"]: r for r in media_features(d).collect()}
    assert [out[i]["error"] is None for i in range(1, 7)] == [True, True, False, False, False, False]
    assert out[2]["payload_bytes"] == 21 and len(out[2]["low_hash"]) == 8
    for i in (3, 4, 5, 6):
        assert out[i]["payload_sha256"] is None and out[i]["low_hash"] is None and out[i]["media_sha256"] is not None
