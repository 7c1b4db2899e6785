import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vicinal.llm import hardneg
from vicinal.llm.hardneg import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, anchors):
    rows = [(i, [math.floor(256 * float(np.float32(x))) for x in v], label) for i, v, label in rows if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = max((len(v) for _, v, _ in rows), default=0)
    rows = [(i, v + [0] * (width - len(v)), label) for i, v, label in rows]
    least = {}
    for i, v, label in rows:
        if anchors(i) and (i not in least or (label, v) < (least[i][1], least[i][0])):
            least[i] = (v, label)
    out = []
    place = lambda i: -math.inf if i is None else i
    for a, (v, label) in least.items():
        scored = sorted(((-sum(x * y for x, y in zip(v, w, strict=True)), place(i), i, other) for i, w, other in rows if i != a), key=lambda x: x[:2])
        for k, (s, _, p, _) in enumerate([x for x in scored if x[3] == label][:5]):
            hard = [x for x in scored if x[3] != label and -80 * s <= -100 * x[0] <= -100 * s][:5]
            out += [(a, k + 1, p, r + 1, x[2], -s, -x[0]) for r, x in enumerate(hard)]
    return sorted(out, key=str)


def rows(seed, n=400, dim=9):
    rng = random.Random(seed)
    hot = [rng.choice([-0.5, 0.25, 0.75]) for _ in range(dim)]
    out = [(i, hot if i % 3 == 0 else [rng.gauss(0.1, 0.3) for _ in range(dim)], rng.randrange(4)) for i in range(n)]
    return [*out, (7, None, 1), (8, out[8][1], None), (10, [*out[1][1][:-1], None], 2), (20, [*out[1][1][:-1], float("nan")], 2), (30, [*out[1][1][:-1], float("-inf")], 2), (1001, hot[:4], 1), (1002, [], 2)]


def got(spark, rows, schema=SCHEMA):
    d = hard_negatives(spark.createDataFrame(rows, schema).repartition(3), F.col("vec_id") % 10 == 0)
    return sorted(map(tuple, d.collect()), key=str)


def test_against_all_pairs(spark):
    for seed in (1, 2):
        some = rows(seed)
        want = plain(some, lambda i: i % 10 == 0)
        assert len(want) > 300 and got(spark, some) == want


def test_cells_do_not_matter(spark):
    some = rows(3, 200)
    d = spark.createDataFrame(some, SCHEMA)
    want = plain(some, lambda i: i % 10 == 0)
    for cells in (2, 5, 200):
        assert sorted(map(tuple, hard_negatives(d, F.col("vec_id") % 10 == 0, cells=cells).collect()), key=str) == want


def test_blocks_of_a_few(spark, monkeypatch):
    monkeypatch.setattr(hardneg, "BLOCK", 10)
    some = rows(4, 150)
    assert got(spark, some) == plain(some, lambda i: i % 10 == 0)


def test_bounds_hold_every_score():
    rng = np.random.default_rng(5)
    x = rng.integers(-300, 300, (500, 6))
    x[:, 2] = 7
    edges = np.sort(rng.integers(-200, 200, (6, 15)), axis=1)
    low = np.concatenate([x.min(axis=0)[:, None], np.clip(edges, x.min(axis=0)[:, None], x.max(axis=0)[:, None])], axis=1)
    high = np.concatenate([low[:, 1:] - 1, x.max(axis=0)[:, None]], axis=1)
    import pyarrow as pa

    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(500)), pa.array(np.zeros(500, np.int32)), pa.array(x.tolist(), pa.list_(pa.int64()))], names=["vec_id", "label", "vec"])
    block = hardneg._Rows(pa.Table.from_batches(list(hardneg._approximate([batch], low))), 6, 16)
    for a in x[:20]:
        least, most = block.bounds(a, low, high, slice(None))
        assert (least <= block.points @ a).all() and (block.points @ a <= most).all() and (block.points == x).all()


def test_repeated_rows_and_ids(spark):
    some = rows(6, 120)
    some += [some[0], some[3], some[3], (20, [0.5] * 9, 0), (None, some[1][1], some[1][2]), (None, some[3][1], 2)]
    assert got(spark, some) == plain(some, lambda i: i is not None and i % 10 == 0)


def test_clashing_columns_and_doubles(spark):
    some = rows(7, 90)
    d = spark.createDataFrame(some, SCHEMA).selectExpr("*", "1 as place", "2 as point", "3 as cells", "4 as anchor_id", "'x' as positives")
    assert sorted(map(tuple, hard_negatives(d, F.col("vec_id") % 10 == 0).collect()), key=str) == plain(some, lambda i: i % 10 == 0)


def test_none(spark):
    assert got(spark, []) == []
    assert got(spark, [(0, None, 1), (10, [1.0], None)]) == []
    assert got(spark, [(1, [1.0], 1), (2, [1.0], 2)]) == []  # no anchor
    with pytest.raises(Exception, match="beyond"):
        got(spark, [(0, [1e30], 1), (1, [1.0], 1)])
