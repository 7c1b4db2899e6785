import random

import pyarrow as pa
from pyspark.sql import functions as F

from vicinal.llm.common import n_words, parts, prefix_sums, spool, unspool


def test_parts_are_bounded_and_whole():
    rng = random.Random(1)
    texts = [None if rng.random() < 0.1 else "é" * rng.randrange(300) for _ in range(5000)] + ["x" * 9000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["id", "text"])
    got = list(parts(iter([batch, batch.slice(0, 0)]), most=2000))
    assert [t for p in got for t in p.column(1).to_pylist()] == texts
    assert all(p.num_rows == 1 or sum(len((t or "").encode()) for t in p.column(1).to_pylist()) <= 2000 for p in got)


def test_prefix_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), rng.randrange(4), i, rng.randrange(9)) for i in range(500)]
    d = spark.createDataFrame(rows, "k string, b int, i long, m long")
    got = {r["i"]: r["s"] for r in prefix_sums(d, ["k"], ["b"], [F.col("i")], F.col("m"), "s").collect()}
    at = {"a": 0, "b": 0}
    for k, _, i, m in sorted(rows):
        assert got[i] == at[k]
        at[k] += m


def test_spool_and_unspool(spark, tmp_path):
    d = spool(spark.range(10), "numbers")
    assert d.count() == 10
    before = spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled")
    unspool(d)
    assert before == "false" and spool(spark.range(0), "none").count() == 0


def test_words(spark):
    d = spark.createDataFrame([(" a\tb\n",), ("",), (None,), ("  \x1f",)], "t string")
    assert [r[0] for r in d.select(n_words(F.col("t"))).collect()] == [2, 0, 0, 2]
