"""Registered queries whose results SQL can't say, on the smallest tables, against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

from vicinal.llm.queries import QUERIES, tokenizer_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_op2(spark, texts):
    rows = QUERIES["op2_identify_language"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    labels = {r["lang"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} - {None}
    for r in rows:
        letters = any(c.isalpha() for c in texts[r["doc_id"]] or "")
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2)
        assert r["lang_pred"] in labels if letters else (r["lang_pred"], r["score"]) == ("und", 0.0)
        assert 0 <= r["score"] <= 1


def base(text):
    w = words(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n = Counter(windows)
    repeated = {k for i, x in enumerate(windows) if n[x] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(repeated)


def test_op3(spark, texts):
    rows = QUERIES["op3_quality_rules"](spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        want = base(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (want[0] < 20 or 100 * want[4] > 30 * want[0])
        assert not (r["base_failed"] and r["kept"])
    assert 0.7 < sum(r["kept"] for r in rows) / sum(not r["base_failed"] for r in rows) <= 1


def test_op4(spark, texts):
    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in QUERIES["op4_pack"](spark, SF).collect():
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert set(pieces) == set(ids)
    for i, ps in pieces.items():
        at = 0
        for p in sorted(ps, key=lambda p: p["start"]):
            part = ids[i][at : at + p["length"]]
            assert p["start"] == at and p["length"] == len(part) > 0 and p["doc_tokens"] == len(ids[i])
            assert p["ids_crc32"] == zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part))
            at += len(part)
        assert at == len(ids[i])
    padding = total = 0
    for s in sequences.values():
        end = 0
        for offset, length in sorted(s):
            assert offset == end
            end += length
        assert end <= 4096
        total += end
        padding += 0 if end & (end - 1) == 0 else 4096 - end
    assert padding < 0.05 * total


def test_op7(spark, texts):
    seen = {}
    for r in QUERIES["op7_media_columns"](spark, SF).collect():
        raw = (texts[r["doc_id"]] or "").encode()
        payload = raw.ljust(max(1, -(-len(raw) // 192)) * 192, b" ")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]))
        assert re.fullmatch("[0-9a-f]{16}", r["feature"]) and re.fullmatch("[0-9a-f]{64}", r["media_sha256"]) and r["media_bytes"] > 57
        assert seen.setdefault(payload, (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    assert len(seen) > 100
