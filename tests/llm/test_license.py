import random
import re
from math import ceil

from tests.llm.data import SCHEMA, rows
from vicinal.llm.license import PHRASES, TEMPLATES, THRESHOLD, scan_licenses


def toks(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(text):
    w = toks(text)
    places, base, labels, best = [], set(), set(), 0.0
    for p, label in PHRASES.items():
        p = p.split()
        at = [i for i in range(len(w)) if w[i : i + len(p)] == p]
        places += at
        base |= {label} if at else set()
    for t, label in TEMPLATES.items():
        s, n = set(t.split()), ceil(len(t.split()) / THRESHOLD - 1e-9)
        if len(s.intersection(w)) < THRESHOLD * len(s) - 1e-9:
            continue
        for i in range(len(w)):
            shared = len(s.intersection(w[i : i + n]))
            if shared >= ceil(THRESHOLD * len(s) - 1e-9):
                labels.add(label)
                best = max(best, shared / len(s))
    return len(w), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), 1.0 if places else best


def texts():
    rng = random.Random(8)
    out = [r[1] for r in rows()]
    pool = sorted({x for t in TEMPLATES for x in t.split()}) + ["lorem", "Kelvin", "Kelvin", "mİt"]
    for t in TEMPLATES:
        w = t.split()
        for k in range(6):
            v = [x for x in w if rng.random() > 0.08 * k] + [rng.choice(pool) for _ in range(k)]
            rng.shuffle(v) if k % 2 else None
            out.append(f"Before.\n{' '.join(v).title()}, after\nend under the mit license")
    out += ["Under the MIT-license under\nthe mit license", "cc by nc cc by nc by nc", "apache license version 2 apache license version 2.0", "under the mıt license", "UNDER THE MİT LICENSE", "mit " * 5000]
    return out


def test_equals_brute_force(spark):
    data = list(enumerate(texts()))
    cols = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    d = spark.createDataFrame([(*x, "s", "l") for x in data], "doc_id long, text string, spans string, labels string")
    got = {r["doc_id"]: tuple(r[c] for c in cols) for r in scan_licenses(d).collect()}
    for i, t in data:
        want = brute(t)
        assert got[i][:6] == want[:6] and abs(got[i][6] - want[6]) < 1e-12, t


def test_wrapped_notices_are_found_and_scattered_words_are_not(spark):
    notice = "# This work is licensed under a Creative\n#   Commons Attribution 4.0\n# International License."
    words = "this work is licensed under a creative commons attribution 4 0 international license".split()
    scattered = " ".join(f"{x} {' '.join(['lorem'] * 9)}" for x in words)
    got = {r["doc_id"]: r for r in scan_licenses(spark.createDataFrame([(1, "x y\n" + notice), (2, scattered)], "doc_id long, text string")).collect()}
    assert "cc-by" in got[1]["labels"].split(",") and got[1]["score"] == 1.0 and got[2]["labels"] == "" and got[2]["spans"] == []
    assert [(s["word"], s["containment"]) for s in got[1]["spans"] if s["label"] == "cc-by"] == [(2, 1.0)]


def test_repeats_and_empty_table(spark):
    d = spark.createDataFrame([(1, "under the mit license")] * 2 + [(None, None)], "doc_id long, text string")
    assert sorted(str((r["doc_id"], r["labels"])) for r in scan_licenses(d).collect()) == ["(1, 'mit')", "(1, 'mit')", "(None, '')"]
    assert scan_licenses(spark.createDataFrame([], SCHEMA)).count() == 0
