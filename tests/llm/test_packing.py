import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tests.llm.data import SCHEMA, rows
from vicinal.llm.packing import WordIds, _inverse, pack, slots, solve

PATH = public_tokenizers.path("word_bpe_49k.json")


def test_ids_equal_the_tokenizer():
    rng = random.Random(1)
    marks = "aAbBzé́İKß'\"s.,!?<|>*$  \n\t09²Ⅷ中　\xa0\x85\x1cσςΣ"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["a<|endoftext|>b", "A <|ENDOFTEXT|> x", "it's we'LL I'm. don't, 's", "x" * 3000, "", None, *[r[1] for r in rows()]]
    plain = Tokenizer.from_file(PATH)
    for text, got in zip(texts, WordIds(PATH, most=500)(texts)):
        assert np.frombuffer(got, "<u4").tolist() == [*plain.encode(text or "", add_special_tokens=False).ids, 2], repr(text)


def test_ids_do_not_depend_on_the_texts_beside():
    rng = random.Random(2)
    marks = "abzEZé́K9'\".,!?<|>*$-  \n"
    texts = ["".join(rng.choice(marks) for _ in range(rng.randint(0, 40))) for _ in range(3000)] + ["end.", "a.b.", "é..", "x' y'.", ".", "", "  "] + [r[1] for r in rows() if r[1] is not None]
    plain, ids = Tokenizer.from_file(PATH), WordIds(PATH, most=2000)
    for at in range(0, len(texts), 7):
        for text, got in zip(texts[at : at + 7], ids(texts[at : at + 7]), strict=True):
            assert np.frombuffer(got, "<u4").tolist() == [*plain.encode(text, add_special_tokens=False).ids, 2], repr(text)
    assert ids([]) == []


def brute_bins(demand, capacity):
    """The fewest bins, by trying all ways: small cases only."""
    items = sorted((c for c, n in demand.items() for _ in range(n)), reverse=True)
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] >= items[i] and bins[j] not in bins[:j]:
                place(i + 1, [*bins[:j], bins[j] - items[i], *bins[j + 1 :]])
        place(i + 1, [*bins, capacity - items[i]])

    place(0, [])
    return best[0]


def test_inverse():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 9, (60, 60)) + np.diag(rng.integers(1, 9, 60)) * 1.0
    a[0, 0] = 0
    assert np.allclose(_inverse(a) @ a, np.eye(60), atol=1e-8)


@pytest.mark.parametrize("seed", range(12))
def test_patterns_hold_the_demand_in_few_sequences(seed):
    rng = random.Random(seed)
    demand = {rng.randint(1, 20): rng.randint(1, 3) for _ in range(5)}
    patterns = solve(demand, 20)
    held = defaultdict(int)
    for p, n in patterns:
        assert sum(c * k for c, k in p.items()) <= 20
        for c, k in p.items():
            held[c] += k * n
    assert held == demand
    assert sum(n for _, n in patterns) <= brute_bins(demand, 20) + 1
    ranks = defaultdict(set)
    for c, a, z, _, _ in slots(patterns):
        assert not ranks[c] & set(range(a, z))
        ranks[c] |= set(range(a, z))
    assert {c: len(r) for c, r in ranks.items()} == demand


def check(spark, data, length=4096):
    ids = {}
    plain = Tokenizer.from_file(PATH)
    for i, t, *_ in data:
        ids[i] = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
    out = pack(spark.createDataFrame(data, SCHEMA), PATH, with_ids=True, length=length, grain=length // 256).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        raw = np.array(part, "<u4").tobytes()
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and bytes(r["ids"]) == raw and r["ids_crc32"] == zlib.crc32(raw)
        by_doc[r["doc_id"]].append((r["start"], r["length"]))
        by_seq[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in (*by_seq.values(),):
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= length
    return ids, by_doc, by_seq


def test_each_id_is_in_one_piece(spark):
    data = rows(n=60)
    ids, by_doc, _ = check(spark, data, 512)
    for i, spans in by_doc.items():
        at = 0
        for s, n in sorted(spans):
            assert s == at
            at += n
        assert at == len(ids[i])
    assert set(by_doc) == {r[0] for r in data}


def test_little_padding(spark):
    data = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    ids, _, by_seq = check(spark, data)
    assert sum(map(len, ids.values())) / (4096 * len(by_seq)) > 0.96


def test_repeats_and_empty_table(spark):
    d = spark.createDataFrame([(1, "one two", "x", "y", 1)] * 3 + [(None, None, None, None, None)], SCHEMA)
    out = pack(d, PATH).collect()
    assert len(out) == 4 and len({(r["sequence_id"], r["offset"]) for r in out}) == 4
    assert pack(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_pricing_that_is_cut_short_says_so():
    demand = {c: 7 + c % 5 for c in range(100, 1500, 13)}
    with pytest.warns(UserWarning, match="pricing ended after 2 columns"):
        cut = solve(demand, 4096, most=2)
    for c, n in demand.items():
        assert sum(p.get(c, 0) * k for p, k in cut) == n
