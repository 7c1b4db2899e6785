import random
import re
from collections import Counter

import numpy as np

from vicinal.llm import phrases
from vicinal.llm.phrases import Automaton, collocations

SCHEMA = "lang string, text string"


def plain(rows, least=10, first=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        c = f.setdefault(lang or "und", Counter())
        text = "".join(x.lower() if "A" <= x <= "Z" else x for x in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            c.update(tuple(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for p, a in c.items():
            longer = [b for q, b in c.items() if len(q) > len(p) and b >= least and any(q[i : i + len(p)] == p for i in range(2))] if len(p) == 2 and a >= least else []
            if len(p) > 1 and a >= least and not any(100 * b >= 50 * a for b in longer):
                score, _, left, right = min((1000000 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), left, right))
        out += [(lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:first])]
    return sorted(out)


def pieces(seed, n, vocabulary):
    rng = random.Random(seed)
    return [[rng.randrange(vocabulary) for _ in range(rng.randint(1, 9))] for _ in range(n)]


def test_automaton_against_all_places():
    for seed, vocabulary in ((1, 2), (2, 4), (3, 30)):
        some = pieces(seed, 60, vocabulary)
        word = np.array([x for p in some for x in p])
        place = np.array([i for p in some for i in range(len(p))])
        ends = {}
        for e in range(len(word)):
            for k in range(1, min(3, place[e] + 1) + 1):
                ends.setdefault(tuple(word[e - k + 1 : e + 1]), []).append(e)
        a = Automaton(word, np.zeros(len(word), np.int64), place, 3)
        spelled = {}
        for size in (1, 2, 3):
            for e, n in zip(*a.phrases(size), strict=True):
                p = tuple(word[e - size + 1 : e + 1])
                assert p not in spelled
                spelled[p] = n
        assert spelled == {p: len(x) for p, x in ends.items()}
        classes = {}
        for p, x in ends.items():
            classes.setdefault(tuple(x), []).append(p)
        assert len(a.count) == len(classes)  # phrases with the same ends are one state
        for i, link in enumerate(a.link):
            longest = tuple(word[a.end[i] - a.longest[i] + 1 : a.end[i] + 1])
            assert len(classes[tuple(ends[longest])]) == a.longest[i] - a.shortest[i] + 1
            if link < 0:
                assert a.shortest[i] == 1
            else:  # the longest shorter ending that has more places
                assert a.longest[link] == a.shortest[i] - 1 and a.count[link] > a.count[i]
                assert longest[-a.longest[link] :] == tuple(word[a.end[link] - a.longest[link] + 1 : a.end[link] + 1])


def texts(seed=4, n=2500):
    rng = random.Random(seed)
    names = ["New", "york", "CITY", "of", "the", "É", "é", "big apple", "a\x00b", "x" * 300, "'", "日本"]
    join = [" ", "  ", "\t", ". ", ".", ",", "\n", "\r\n", "\x0b", " "]
    out = [(rng.choice(["en", "fr", None, "und"]), "".join(rng.choice(names) + rng.choice(join) for _ in range(rng.randint(0, 30)))) for _ in range(n)]
    return [*out, *[("en", "new york city, new york city")] * 20, ("fr", None), (None, ""), ("de", " . "), ("fr", "of the " * 5000)]


def test_collocations_equal_the_plain_version(spark):
    rows = texts()
    want = plain(rows)
    assert len(want) > 60 and len({x[0] for x in want}) == 3
    d = spark.createDataFrame(rows, SCHEMA)
    assert sorted(map(tuple, collocations(d).collect())) == want
    odd = d.repartition(7).selectExpr("*", "1 as phrase", "2 as f", "3 as size", "'x' as l", "5 as n")  # names that clash, and shards of a few words
    assert sorted(map(tuple, collocations(odd, shard=50).collect())) == want
    assert sorted(map(tuple, collocations(d, least=20, first=3).collect())) == plain(rows, 20, 3)


def test_a_full_filter_changes_nothing(spark, monkeypatch):
    monkeypatch.setattr(phrases, "bloom_filter", lambda pairs: np.full(phrases.BITS >> 3, 255, np.uint8))
    assert sorted(map(tuple, collocations(spark.createDataFrame(texts(), SCHEMA)).collect())) == plain(texts())


def test_scores_beyond_64_bits(spark):
    a, r = 3 * 10**12 + 1, 7 * 10**12 + 3
    d = spark.createDataFrame([(a, a + 5, r)], "a long, l long, r long")
    assert d.select(phrases._score("a", "l", "r")).first()[0] == 1000000 * a * a // ((a + 5) * r)


def test_no_phrases(spark):
    assert collocations(spark.createDataFrame([], SCHEMA)).collect() == []
    assert collocations(spark.createDataFrame([("en", None), (None, "one two")], SCHEMA)).collect() == []
