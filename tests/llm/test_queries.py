"""The queries against their SQL, and the pipeline against its stages."""

import uuid

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tests.llm.data import SCHEMA, rows
from vicinal.llm.common import work_dir
from vicinal.llm.neardup import near_duplicates
from vicinal.llm.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql_says_the_same(spark, name):
    c = duckdb.connect()
    for t in ("documents", "conversations", "embeddings", "pages"):
        c.sql(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = c.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    cols = sorted(got.columns)
    tidy = lambda rows_: sorted((tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in rows_), key=str)
    assert tidy(map(tuple, got.select(*cols).collect())) == tidy(want.select(*cols).fetchall())


def test_all_thirteen_and_the_pipeline_are_there():
    assert {q.split("_")[0] for q in QUERIES} == {*[f"op{i}" for i in range(1, 14)], "pipeline"}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]


def staged(spark, docs):
    out = [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        d = stage(spark, out[-1], SF)
        path = f"{work_dir(spark)}/stage-{i}-{uuid.uuid4().hex}"
        d.write.parquet(path)
        out.append(spark.read.parquet(path))
    return out


def test_stages(spark):
    docs = spark.createDataFrame([(*r[:2], r[2] or "en", *r[3:]) for r in rows(n=60)], SCHEMA)
    start, lang, lines, near, mixed, packed = staged(spark, docs)
    for d in (lang, lines, near, mixed):
        assert d.columns == list(corpus_pipeline.COLUMNS)
    texts = {r["doc_id"]: r["text"] for r in start.collect()}
    ids = lambda d: {r["doc_id"] for r in d.select("doc_id").collect()}
    assert ids(start) - ids(lang) == {i for i, t in texts.items() if not any(c.isalpha() for c in t or "")}
    assert ids(lang) - ids(lines) <= {i for i, t in texts.items() if list(texts.values()).count(t) > 1}
    assert {r["doc_id"] for r in near_duplicates(lines).filter("kept").collect()} == ids(near)
    assert near_duplicates(near).filter("not kept").count() == 0
    assert ids(mixed) <= ids(near)
    assert packed.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("t")).join(mixed.groupBy("doc_id").count(), "doc_id").filter("n != t * count").count() == 0
    assert ids(packed) == ids(mixed)


def test_run_equals_the_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    packed = staged(spark, docs)[-1]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, packed.collect()))


def test_empty_table(spark):
    assert staged(spark, spark.createDataFrame([], SCHEMA))[-1].count() == 0
