import json
import random
import time

import pytest

from tests.test_engine import payload
from vicinal.sources import generators
from vicinal.streaming.scoring import stream_scores
from vicinal.streaming.sink import BatchSink, Counts


def test_a_batch_handed_over_twice_is_there_once(spark, tmp_path):
    sink = BatchSink(spark, f"file://{tmp_path}/out")
    assert sink.read() is None
    rows = lambda a, b: spark.range(a, b)
    sink(rows(0, 5), 0)
    sink(rows(0, 5), 0)
    sink(rows(5, 9), 1)
    BatchSink(spark, f"file://{tmp_path}/out")(rows(0, 5), 0)  # after a restart
    assert sorted(r["id"] for r in sink.read().collect()) == list(range(9))
    assert sorted((r["number"], r["rows"]) for r in sink.commits().collect()) == [(0, 5), (1, 4)]


def test_half_a_batch_is_not_read(spark, tmp_path):
    sink = BatchSink(spark, f"file://{tmp_path}/out")
    sink(spark.range(3), 0)
    with pytest.raises(Exception, match="broken"):
        sink(spark.range(10).selectExpr("if(id = 9, raise_error('broken'), id) as id"), 1)
    spark.range(100).write.parquet(f"{tmp_path}/out/data/2-left-over")
    assert sink.read().count() == 3
    sink(spark.range(3, 10), 1)
    assert sorted(r["id"] for r in sink.read().collect()) == list(range(10))


def test_stream_that_starts_again(spark, tmp_path):
    rng = random.Random(11)
    payloads = [payload(rng, i) for i in range(40)]
    refs = generators.points(spark, 300).cache()
    (tmp_path / "in").mkdir()
    sink, counts = BatchSink(spark, f"file://{tmp_path}/out"), Counts()
    spark.streams.addListener(counts)
    try:
        failed = []

        def once_broken(votes, k):
            sink(votes, k)
            if not failed:  # the sink has the batch, the stream's log has not
                failed.append(k)
                raise RuntimeError("lost after the write")

        for part in range(2):
            (tmp_path / "in" / f"{part}.json").write_text("\n".join(json.dumps(p) for p in payloads[part * 20 : part * 20 + 20]) + '\n{"id": "broken"}\n')
            for _ in range(2):
                try:
                    stream_scores(spark, str(tmp_path / "in"), refs, once_broken, str(tmp_path / "log"), once=True).awaitTermination()
                except Exception as e:
                    assert "lost after the write" in str(e)
        assert failed and sink.read().count() == 40 and sink.read().distinct().count() == 40
        for _ in range(50):
            if counts.totals.get("payloads", {}).get("rows") == 42:
                break
            time.sleep(0.2)
        assert counts.totals["payloads"] == {"rows": 42, "bad": 2}
    finally:
        spark.streams.removeListener(counts)
