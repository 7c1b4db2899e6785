import itertools
import re

from tests.llm.data import SCHEMA, rows
from vicinal.llm.neardup import components, near_duplicates


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def result(spark, docs):
    out = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out}


def test_equals_brute_force(spark):
    docs = [(r[0], r[1]) for r in rows()]
    assert result(spark, docs) == brute(docs)


def test_driver_documents_equal_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    assert result(spark, docs) == brute(docs)


def test_chain_of_neighbours(spark):
    """Each text is near the next one only; the whole chain is one component."""
    words = [f"w{i}" for i in range(400)]
    docs = [(100 - k, " ".join(words[k * 10 : k * 10 + 120])) for k in range(20)]
    assert result(spark, docs) == brute(docs)


def test_large_group_of_near_copies_and_near_misses(spark):
    """Variants of one text, some of which are linked to others of the bucket but not to its smallest document."""
    base = [f"v{i}" for i in range(100)]
    docs = []
    for k in range(150):
        w = list(base)
        for j in range(k % 7):
            w[(k * 13 + j * 29) % 100] = f"k{k}-{j}"
        docs.append((k, " ".join(w)))
    assert result(spark, docs) == brute(docs)


def test_nulls_repeats_and_clashing_columns(spark):
    docs = [(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "A b C d e F"), (3, None), (4, "")]
    d = spark.createDataFrame([(*x, "s", "k") for x in docs], "doc_id long, text string, sig string, key string")
    out = sorted(map(tuple, near_duplicates(d).collect()), key=str)
    assert out == sorted([(1, 2, 1, True), (1, 2, 1, True), (None, 2, None, True), (2, 2, 1, False), (3, 0, 3, True), (4, 0, 4, True)], key=str)


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 30)] + [(40, 50), (50, 45), (7, 7)]
    out = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert out == {**{i: 1 for i in range(2, 31)}, 50: 40, 45: 40}
