import hashlib
import hmac
import itertools
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.data import SCHEMA, rows
from vicinal.llm.pii import feistel, permute_digits, pseudonymize
from vicinal.llm.queries import QUERIES


def luhn(s):
    t = 0
    for i, c in enumerate(reversed(s)):
        d = int(c) * (1 + i % 2)
        t += d - 9 * (d > 9)
    return t % 10 == 0


def changed(spark, texts, key="k"):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [(r["text"], [(p["kind"], p["text"]) for p in r["pii"]]) for r in pseudonymize(d, key).orderBy("doc_id").collect()]


def test_feistel_is_a_permutation(spark):
    for a, b in ((17, 43), (10, 100), (7, 7)):
        d = spark.createDataFrame(list(itertools.product(range(a), range(b))), "a long, b long").select(feistel(F.col("a"), F.col("b"), a, b, "key", "t").alias("p"))
        assert {(r[0]["a"], r[0]["b"]) for r in d.collect()} == set(itertools.product(range(a), range(b)))


def test_digit_strings_are_permuted(spark):
    for n in (2, 3):
        all_ = [(f"{i:0{n}}",) for i in range(10**n)]
        got = [r[0] for r in spark.createDataFrame(all_, "d string").select(permute_digits(F.col("d"), "key", "t")).collect()]
        assert sorted(got) == [x for (x,) in all_]


def test_kinds_keep_their_format(spark):
    texts = ["Card 4111 1111 1111 1111, and 4111111111111111.", "ip 97.51.17.173 x 300.1.1.1", "call +1 (017) 555-7713 now", "a.b+c@mail7.example.com!", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" end', "born 1984-02-29 or 29/02/1984, not 1985-02-29", "ssn 123-45-6789 no 666-45-6789 000-12-1234", "IBAN GB82 WEST 1234 5698 7654 32 or GB82WEST12345698765433"]
    out = changed(spark, texts)
    cards = [p for k, p in out[0][1]]
    assert [k for k, _ in out[0][1]] == ["card", "card"] and cards[0].replace(" ", "") == cards[1] and luhn(cards[1]) and re.fullmatch(r"(\d{4} ){3}\d{4}", cards[0]) and cards[1] != "4111111111111111"
    assert [k for k, _ in out[1][1]] == ["ip"] and all(int(x) < 256 for x in out[1][1][0][1].split(".")) and out[1][0].endswith(" x 300.1.1.1")
    assert re.fullmatch(r"call \+1 \(\d{3}\) \d{3}-\d{4} now", out[2][0]) and "555-7713" not in out[2][0]
    assert re.fullmatch(r"u[0-9a-f]{16}@example\.invalid!", out[3][0])
    assert re.fullmatch(r'token = "[0-9a-f]{40}" end', out[4][0]) and "04dbebab" not in out[4][0]
    assert [k for k, _ in out[5][1]] == ["date", "date"] and out[5][0].endswith("not 1985-02-29")
    y, m, d = out[5][1][0][1].split("-")
    assert out[5][1][1][1] == f"{d}/{m}/{y}"
    assert [k for k, _ in out[6][1]] == ["ssn"] and out[6][0].endswith("no 666-45-6789 000-12-1234")
    iban = out[7][1][0][1].replace(" ", "")
    assert len(out[7][1]) == 1 and out[7][0].endswith("GB82WEST12345698765433")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1 and iban[:2] == "GB" and "WEST" in iban


def test_equal_values_are_linked_and_keys_matter(spark):
    a = changed(spark, ["x 4111111111111111 y", "4111111111111111", "97.51.17.173", "97.51.17.174"])
    assert a[0][1] == a[1][1] and a[2][1] != a[3][1]
    assert changed(spark, ["4111111111111111"], "other")[0] != a[1]


def test_clean_texts_stay(spark):
    texts = ["version 2.0 of 1234567812345678 in 2024", "1.2.3.4.5", "12345-123-45-6789", "no 4111111111111112", "$1 \\1 100%", *[r[1] for r in rows()]]
    assert [t for t, _ in changed(spark, texts)] == texts


def test_nulls_repeats_long_texts_and_clashing_columns(spark):
    long = "x" * 60000 + " a@b.example.com " + "1" * 60000
    d = spark.createDataFrame([(1, None, "p", "m"), (2, "", "p", "m"), (3, long, "p", "m"), (3, long, "p", "m")], "doc_id long, text string, pii string, _x string")
    out = sorted(((r["doc_id"], r["text"], len(r["pii"])) for r in pseudonymize(d, "k").collect()), key=str)
    assert out[:2] == [(1, None, 0), (2, "", 0)] and out[2] == out[3] and out[2][2] == 1 and "a@b" not in out[2][1] and out[2][1].startswith("x" * 60000)
    assert pseudonymize(spark.createDataFrame([], SCHEMA), "k").count() == 0


def test_a_phone_is_linked_however_it_is_written(spark):
    texts = ["+14155552671", "+1 415 555 2671", "+1 (415) 555-2671", "+1-415-555-2671", "+1.415.555.2671", "+442079460958", "+44 20 7946 0958", "+353861234567", "+353 86 123 4567", "(415) 555-2671", "415-555-2671", "+14155552672"]
    out = [re.sub("[^0-9]", "", t) for t, _ in changed(spark, texts)]
    assert len(set(out[:5])) == 1 and out[5] == out[6] and out[7] == out[8] and out[9] == out[10] == out[0][1:] and out[11] != out[0]
    assert out[0][0] == "1" and out[5][:2] == "44" and out[7][:3] == "353" and out[0] != "14155552671"
    assert [len(x) for x in out] == [len(re.sub("[^0-9]", "", t)) for t in texts]


def test_versions_are_no_addresses(spark):
    texts = ["version 1.2.3.4", "Version: 1.2.3.4", "v1.2.3.4", "ver. 10.2.3.4", "release 1.2.3.4", "v 1.2.3.4"]
    assert [t for t, _ in changed(spark, texts)] == texts
    assert changed(spark, ["host 1.2.3.4"])[0][1][0][0] == "ip"


def test_no_key_is_an_error_and_none_stands_in_the_plan(spark, capsys):
    d = spark.createDataFrame([(1, "415-555-2671")], "doc_id long, text string")
    for key in ("", None):
        with pytest.raises(ValueError):
            pseudonymize(d, key)
    out = pseudonymize(d, "very-secret")
    out.explain("extended")
    plan = capsys.readouterr().out
    assert "Project" in plan and "very-secret" not in plan and hmac.new(b"very-secret", b"vicinal pseudonyms", hashlib.sha256).hexdigest() not in plan


class Plain:
    """The numbers' permutations once more, in plain Python."""

    def __init__(self, key):
        self.key = hmac.new(key.encode(), b"vicinal pseudonyms", hashlib.sha256).hexdigest()

    def pair(self, a, b, sizes, tweak):
        for i in range(10):
            f = int(hashlib.sha256(f"{self.key}|{tweak}|{i}|{b}".encode()).hexdigest()[:15], 16)
            a, b = b, (a + f) % sizes[i % 2]
        return a, b

    def digits(self, d, tweak):
        u = len(d) // 2
        a, b = self.pair(int(d[:u]), int(d[u:]), (10**u, 10 ** (len(d) - u)), tweak)
        return f"{a:0{u}}{b:0{len(d) - u}}"


def test_registered_query_against_the_plain_version(spark):
    """Cards, phones, addresses, numbers and dates of the given documents, and these alone, are what plain Python makes of them."""
    sf = "/root/testdata/sf0.001"
    spark.conf.set("spark.vicinal.pii.key", "test")
    try:
        out = {r["doc_id"]: r for r in QUERIES["op8_pseudonymize"](spark, sf).collect()}
    finally:
        spark.conf.unset("spark.vicinal.pii.key")
    p, seen = Plain("test"), {"ip": 0, "phone": 0, "email": 0, "card": 0}
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        text, got = r["text"] or "", out[r["doc_id"]]
        if got["n_pii"] == 0:
            assert got["text"] == r["text"]
            continue
        for m in re.findall(r"(?<![0-9.])\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}(?!\.?[0-9])", text):
            o = [int(x) for x in m.split(".")]
            if max(o) < 256 and not re.search(r"(?i:version|release|firmware|build|ver\.?|v\.?)[ :=]?" + re.escape(m), text):
                a, b = p.pair(o[0] * 256 + o[1], o[2] * 256 + o[3], (1 << 16, 1 << 16), "ip")
                assert f"{a // 256}.{a % 256}.{b // 256}.{b % 256}" in got["text"]
                seen["ip"] += 1
        for m in re.findall(r"\+1 \(\d{3}\) \d{3}-\d{4}", text):
            d = p.digits(re.sub("[^0-9]", "", m)[1:], "phone")
            assert f"+1 ({d[:3]}) {d[3:6]}-{d[6:]}" in got["text"] and m not in got["text"]
            seen["phone"] += 1
        for m in re.findall(r"[A-Za-z0-9._%+-]+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}", text):
            assert f"u{hashlib.sha256(f'{p.key}|email|{m.lower()}'.encode()).hexdigest()[:16]}@example.invalid" in got["text"] and m not in got["text"]
            seen["email"] += 1
        for m in re.findall(r"(?<![0-9A-Za-z-])(?:\d{4} ){3}\d{4}(?![0-9-])", text):
            if luhn(m.replace(" ", "")) and m[0] == "4":
                d = p.digits(m.replace(" ", "")[1:-1], "card")
                new = "4" + d + next(c for c in "0123456789" if luhn("4" + d + c))
                assert re.sub("(.{4})(?=.)", r"\1 ", new) in got["text"]
                seen["card"] += 1
    print(seen)
    assert sum(seen.values()) > 5
