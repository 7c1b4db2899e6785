import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.test_engine import brute, query_of, refs_of
from vicinal.operators import knn, tree
from vicinal.sources import generators, store
from vicinal.sources.interim import written

Q = knn.Q


def found(d):
    got = {}
    for r in d.orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["ref_id"], r["label"], r["d2"]))
    return got


@pytest.mark.parametrize("n,q,clustered", [(200, 2000, True), (4000, 4000, False), (6000, 6000, True)])
def test_search_equals_brute_force(spark, tmp_path, n, q, clustered):
    refs = generators.points(spark, n, clustered=clustered).cache()
    queries = generators.queries(refs, q).cache()
    store.save_tree(tree.grow(refs, leaf=64), str(tmp_path / "tree"))
    leaves = store.load_tree(spark, str(tmp_path / "tree"))
    assert found(tree.search(leaves, queries)) == brute(refs.collect(), queries.collect())


def check(leaves, refs, leaf):
    """Leaves part the references, and their boxes are theirs."""
    rows = {r["leaf"]: r for r in leaves.collect()}
    cols = ["ref_id", "label", "part_key", *Q]
    own = tree.references(leaves)
    assert sorted(map(tuple, own.select(cols).collect())) == sorted(map(tuple, refs.select(cols).collect()))
    for name, part in own.toPandas().groupby("leaf"):
        r, x = rows[name], part[Q].to_numpy()
        assert r["n"] == len(part) <= leaf and set(part["part_key"]) == {r["part_key"]}
        assert list(x.min(axis=0)) == r["low"] and list(x.max(axis=0)) == r["high"]
        assert list(zip(r["labels"], r["ids"], strict=True)) == sorted(zip(r["labels"], r["ids"], strict=True))
    return rows


def test_nodes_split_by_spark_and_by_tasks(spark):
    from vicinal.functions.features import part_key

    refs = generators.points(spark, 3000, clustered=True).withColumn("part_key", part_key()).cache()
    rows = check(written(tree.grow(refs, leaf=10, local=30, fan=2), "leaves"), refs, 10)
    assert max(name.count("/") for name in rows) >= 2  # several rounds
    queries = generators.queries(refs, 500)
    leaves = written(tree.grow(refs, leaf=10, local=30, fan=2), "leaves")
    want = brute(refs.collect(), queries.collect())
    for rounds in ((), (1,), (1, 1, 2), (3, 50)):
        assert found(tree.search(leaves, queries, rounds=rounds)) == want


def test_copies_and_values_that_many_have(spark):
    from vicinal.functions.features import part_key

    refs = refs_of(spark, [({0: 100, 1: 7}, i % 2) for i in range(300)] + [({0: 100 + (i % 3 == 0) * i}, 0) for i in range(300)] + [({0: 50 - (i % 5 == 0) * i}, 1) for i in range(200)]).withColumn("part_key", part_key()).cache()
    leaves = written(tree.grow(refs, leaf=16, local=40, fan=4), "leaves")
    check(leaves, refs, 16)
    queries = query_of(spark, {0: 100, 1: 7}, {0: 100}, {0: 50}, {12: 9000}, {0: 101, 3: 4})
    assert found(tree.search(leaves, queries)) == brute(refs.collect(), queries.collect())


def test_rounds_compare_fewer_pairs(spark):
    refs = generators.points(spark, 6000, clustered=True).cache()
    queries = generators.queries(refs, 2000)
    leaves = written(tree.grow(refs, leaf=64), "leaves")
    by_rounds, at_once = [], []
    assert found(tree.search(leaves, queries, rounds=(1, 4, 8), tally=by_rounds)) == found(tree.search(leaves, queries, rounds=(1,), tally=at_once))
    assert sum(by_rounds) < sum(at_once) < 0.7 * 6000 * 2000
    assert len(by_rounds) == 4 and len(at_once) == 2


def test_boxes_in_blocks_and_many_queries_of_a_leaf(spark, monkeypatch):
    monkeypatch.setattr(tree, "BOXES", 10)
    monkeypatch.setattr(tree, "GROUP", 7)
    refs = generators.points(spark, 1500, clustered=True).cache()
    queries = generators.queries(refs, 300)
    leaves = written(tree.grow(refs, leaf=30), "leaves")
    assert leaves.count() > 40
    assert found(tree.search(leaves, queries)) == brute(refs.collect(), queries.collect())


def test_few_and_none(spark, tmp_path):
    few = written(tree.grow(refs_of(spark, [({0: 10 * i}, 1) for i in range(3)])), "leaves")
    assert [len(x) for x in found(tree.search(few, query_of(spark, {}))).values()] == [3]
    none = written(tree.grow(refs_of(spark, []).withColumn("part_key", F.lit(0))), "leaves")
    assert none.count() == 0 and tree.search(none, query_of(spark, {})).count() == 0
    assert tree.classify(none, query_of(spark, {})).first()["frauds"] == 0
    store.save_tree(few, str(tmp_path / "tree"))
    with pytest.raises(ValueError):
        store.load_knn(spark, str(tmp_path / "tree"))


def test_bounds():
    rng = np.random.default_rng(1)
    low = rng.integers(-9000, 9000, (20, 14)).astype(float)
    high = low + rng.integers(0, 900, (20, 14))
    q = rng.integers(-10000, 10000, (30, 14)).astype(float)
    want = [[sum(max(lo - x, x - hi, 0) ** 2 for x, lo, hi in zip(a, b, c, strict=True)) for b, c in zip(low, high, strict=True)] for a in q]
    assert (tree._bounds(q, low, high) == np.array(want)).all()


def test_validation_of_files(spark, tmp_path):
    import json
    import random

    from tests.test_engine import payload, plain_quantize, plain_vector
    from vicinal.sources import build, validate

    rng = random.Random(5)
    rows = [{"vector": [round(max(0.0, min(1.0, x + rng.gauss(0, 0.05))), 4) for x in plain_vector(dict(payload(rng, i), last_transaction=None))[:5]] + [-1, -1] + [round(rng.random(), 4) for _ in range(7)], "label": rng.choice(["fraud", "legit"])} for i in range(300)]
    (tmp_path / "r.json").write_text(json.dumps(rows))
    assert build.main(["--in", f"file://{tmp_path}/r.json", "--out", f"{tmp_path}/tree", "--tree", "--range-bytes", "4000"]) == 300
    assert build.main(["--in", f"{tmp_path}/r.json", "--out", f"{tmp_path}/flat"]) == 300
    asked = [payload(rng, i % 40) for i in range(60)]  # ids repeat
    want = [rng.random() < 0.5 for _ in asked]
    (tmp_path / "p.json").write_text(json.dumps({"entries": [{"request": p, "expected_approved": w} for p, w in zip(asked, want, strict=True)]}))
    refs = [([plain_quantize(x) for x in r["vector"]], int(r["label"] == "fraud"), i) for i, r in enumerate(rows)]
    got = []
    for p in asked:
        q = [plain_quantize(x) for x in plain_vector(p)]
        near = sorted((sum((a - b) ** 2 for a, b in zip(q, v, strict=True)), label, i) for v, label, i in refs)[:5]
        got.append(sum(x[1] for x in near) < 3)
    fp, fn = sum(w and not g for g, w in zip(got, want, strict=True)), sum(g and not w for g, w in zip(got, want, strict=True))
    for index, mode in (("tree", "tree"), ("flat", "exact")):
        out = validate.main(["--index", f"{tmp_path}/{index}", "--payloads", f"{tmp_path}/p.json", "--mode", mode])
        assert (out["fp"], out["fn"], out["tp"] + out["tn"], out["weighted"]) == (fp, fn, 60 - fp - fn, fp + 3 * fn)
    (tmp_path / "bad.json").write_text(json.dumps({"entries": [{"request": {"id": "x"}, "expected_approved": True}]}))
    with pytest.raises(ValueError, match="payload x: transaction.amount"):
        validate.main(["--index", f"{tmp_path}/tree", "--payloads", f"{tmp_path}/bad.json"])


def test_boxes_of_boxes_reach_the_same_leaves(spark):
    """A query compares itself with a part of the boxes only, and finds what all boxes give."""
    rng = np.random.default_rng(3)
    low = (rng.integers(-9000, 9000, (30, 14))[np.arange(3000) % 30] + rng.integers(-300, 300, (3000, 14))).astype(float)
    high = low + rng.integers(0, 900, (3000, 14))
    boxes = tree.Boxes(["n"] * 3000, np.arange(3000, dtype=np.int32), np.arange(3000) % 3, low, high)
    q = low[:40] + rng.integers(-500, 500, (40, 14))
    bound = tree._bounds(q, low, high)
    limits = np.sort(bound, axis=1)[:, 9]
    compared = []
    count = boxes._pairs
    boxes._pairs = lambda level, points, who, box: compared.append(len(who)) or count(level, points, who, box)
    who, leaf, _ = boxes.within(q.T, limits)
    assert sorted(zip(who.tolist(), leaf.tolist(), strict=True)) == sorted(zip(*(x.tolist() for x in np.nonzero(bound <= limits[:, None])), strict=True))
    assert sum(compared) < 40 * 3000
    assert (boxes.one(q.T) >= bound.min(axis=1)).all() and (boxes.one(q.T)[:, None] == bound).any(axis=1).all()


def test_many_queries_grow_a_tree(spark, monkeypatch):
    refs = generators.points(spark, 1500, clustered=True).cache()
    queries = generators.queries(refs, 300)
    few = {m: sorted(map(tuple, knn.classify(refs, queries, m).collect())) for m in ("exact", "fast")}
    monkeypatch.setattr(knn, "FEW_BYTES", 100)
    monkeypatch.setattr(knn, "neighbours_partitioned", None)
    monkeypatch.setattr(tree, "VISITS", 50)
    fast, exact = knn.fast_and_exact(refs, queries)
    assert {m: sorted(map(tuple, d.collect())) for m, d in (("exact", exact), ("fast", fast))} == few
    assert sorted(map(tuple, knn.classify(refs, queries, "pruned").collect())) == few["exact"]


def test_rounds_visit_each_leaf_once_and_the_first_one_is_found_by_few_boxes():
    rng = np.random.default_rng(5)
    low = rng.integers(-9000, 9000, (3000, 14)).astype(float)
    high = low + rng.integers(0, 5000, (3000, 14))
    boxes = tree.Boxes(["n"] * 3000, np.arange(3000, dtype=np.int32), np.arange(3000) % 3, low, high)
    q = rng.integers(-9000, 9000, (40, 14))
    limits = np.sort(tree._bounds(q, low, high), axis=1)[:, 99].astype(np.int64)
    compared = []
    count = boxes._pairs
    boxes._pairs = lambda level, points, who, box: compared.append(len(who)) or count(level, points, who, box)

    def visited(limits, seen, more):
        b = pa.RecordBatch.from_arrays([pa.array(np.arange(40)), pa.array(limits), *[pa.array(q[:, i]) for i in range(14)]], names=["query_id", "limit", *tree.Q])
        return [(i, x) for v in tree._visits(iter([b]), boxes, seen, more, some_first=True) for i, n in zip(v["query_id"].to_pylist(), v["leaves"].to_pylist(), strict=True) for x in n]

    one = visited(np.full(40, tree.FAR), 0, 1)
    assert [i for i, _ in one] == list(range(40)) and sum(compared) < 40 * 150
    every = one + visited(limits, 1, 4) + visited(limits, 5, None)
    assert len(every) == len(set(every))
    within = set(zip(*(x.tolist() for x in np.nonzero(tree._bounds(q, low, high) <= limits[:, None])), strict=True))
    assert within <= set(every) <= within | set(one)


def test_what_is_made_of_payloads_is_built_by_small_methods(spark, monkeypatch):
    from vicinal.plans import transactions as tx

    name, seen = "spark.sql.codegen.hugeMethodLimit", []
    monkeypatch.setattr(tx, "written", lambda df, n: seen.append(spark.conf.get(name)) or df)
    before = spark.conf.get(name)
    refs, _ = tx.search_sets(spark, "/root/testdata/sf0.001")
    assert seen == ["8000"] and spark.conf.get(name) == before and "part_key" in refs.columns


def test_validation_asks_for_every_payload(spark):
    from vicinal.plans import catalog, transactions as tx

    r = catalog.QUERIES["validation_run"](spark, "/root/testdata/sf0.001").first()
    assert sum(r[c] for c in ("tp", "tn", "fp", "fn")) == tx.payloads(spark, "/root/testdata/sf0.001").count()
