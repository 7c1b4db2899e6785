import gzip
import json
import random

import pyarrow as pa
import pytest

from vicinal.sources import arrays
from vicinal.sources.readers import read_references

SCHEMA = "id long, s string, v array<double>, o struct<x: string, y: struct<z: long>>"


def records(seed=1, n=200):
    rng = random.Random(seed)
    odd = ['"', "\\", '\\"', "{", "}", "]", "[", ",", '},{"id": 7, "s": "', "é", "日", "\n", "\\\\", "a", " "]
    text = lambda: "".join(rng.choice(odd) for _ in range(rng.randint(0, 12)))
    return [{"id": i, "s": text(), "v": [rng.random() for _ in range(rng.randint(0, 3))], "o": {"x": text(), "y": {"z": i}}} for i in range(n)]


def written(rows, seed=2):
    rng = random.Random(seed)
    sep = lambda: rng.choice([",", ", ", ",\n", " ,, ,\t", "  ,\r\n"])
    out = "".join(json.dumps(r, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 2])) + sep() for r in rows)
    return (" \n[ ," + out + " ] and ]}{ what comes after").encode()


def got(spark, path, size):
    d = arrays.read_json_array(spark, f"file://{path}", SCHEMA, size)
    return sorted((r["place"], r["id"], r["s"], r["v"], r["o"].asDict(True)) for r in d.collect())


@pytest.mark.parametrize("size", [37, 256, 5000, 1 << 20])
def test_ranges_of_any_size_give_the_same_records(spark, tmp_path, size):
    rows = records()
    (tmp_path / "a.json").write_bytes(written(rows))
    want = [(i, r["id"], r["s"], r["v"], r["o"]) for i, r in enumerate(rows)]
    assert got(spark, tmp_path / "a.json", size) == want
    strict = json.dumps(rows)
    (tmp_path / "b.json").write_text(strict)
    assert got(spark, tmp_path / "b.json", size) == want
    one = spark.read.schema(SCHEMA).option("multiLine", True).json(str(tmp_path / "b.json"))
    assert sorted(r["id"] for r in one.collect()) == [w[1] for w in want]


def test_every_border(spark, tmp_path):
    """Each place of a small file as the border of two ranges, without Spark."""
    rows = records(5, 6)
    raw = written(rows)
    (tmp_path / "a.json").write_bytes(raw)
    path = f"file://{tmp_path}/a.json"
    import pyarrow as pa

    names = [c.split(" ")[0] for c in arrays.RANGES.split(", ")]
    for border in range(1, len(raw)):
        table = pa.Table.from_pylist([dict(zip(names, [*x[:8], [list(m.items()) for m in x[8]], [list(m.items()) for m in x[9]]], strict=True)) for x in (arrays._summary(path, 0, 0, border), arrays._summary(path, 0, border, len(raw)))])
        found = [x for s in arrays._starts(table).to_pylist() for x in arrays._records(**s)]
        assert [json.loads(x[2]) for x in found] == rows and [x[0] for x in found] == list(range(6)), border
        assert all(raw[o : o + len(t)] == t for _, o, t in found)


def test_pieces_of_a_few_bytes(spark, tmp_path, monkeypatch):
    rows = records(7, 30)
    raw = written(rows)
    (tmp_path / "a.json").write_bytes(raw)
    for piece in (1, 7, 64):
        monkeypatch.setattr(arrays, "PIECE", piece)
        assert [json.loads(x[2]) for x in arrays._records(f"file://{tmp_path}/a.json", 0, raw.index(b"[") + 1, len(raw), False, 0, 0, raw.rindex(b" ] and ") + 1)] == rows


def test_many_tasks_read_one_file(spark, tmp_path):
    rows = records(3, 500)
    (tmp_path / "a.json").write_text(json.dumps(rows))
    d = arrays.read_array_texts(spark, f"file://{tmp_path}/a.json", 4096)
    from pyspark.sql import functions as F

    assert d.select(F.spark_partition_id()).distinct().count() >= 4 and d.count() == 500


def test_folders_and_gzip(spark, tmp_path):
    rows = records(4, 40)
    for i in range(4):
        (tmp_path / f"{i}.json").write_text(json.dumps(rows[i * 10 : i * 10 + 10]))
    (tmp_path / "_SUCCESS").write_text("")
    assert sorted(x[1] for x in got(spark, tmp_path, 100)) == list(range(40))
    (tmp_path / "z").mkdir()
    (tmp_path / "z" / "a.json.gz").write_bytes(gzip.compress(written(rows)))
    assert [x[1] for x in got(spark, tmp_path / "z" / "a.json.gz", 100)] == list(range(40))


@pytest.mark.parametrize("text,what", [("", "closing bracket"), ("  ", "closing bracket"), ('{"id": 1}', "no array"), ('[{"id": 1}', "closing bracket"), ('[{"id": 1}, x]', "unexpected 'x'"), ('[{"id": 1', "closing bracket"), ('[1, 2]', "unexpected '1'"), ('[{"id": "x"}]', "MALFORMED|Malformed|malformed")])
def test_what_is_no_array(spark, tmp_path, text, what):
    (tmp_path / "a.json").write_text(text)
    with pytest.raises(Exception, match=what):
        arrays.read_json_array(spark, f"file://{tmp_path}/a.json", SCHEMA, 8).collect()


def test_empty_arrays(spark, tmp_path):
    (tmp_path / "a.json").write_text(" [ , ] ")
    assert got(spark, tmp_path / "a.json", 3) == []


def test_written_arrays_come_back(spark, tmp_path):
    d = spark.createDataFrame([(i, 'x"{' * (i % 3)) for i in range(100)], "id long, s string").repartition(3)
    files = arrays.write_json_arrays(d, f"file://{tmp_path}")
    assert files.agg({"records": "sum"}).first()[0] == 100
    back = arrays.read_json_array(spark, f"file://{tmp_path}", "id long, s string", 200)
    assert sorted((r["id"], r["s"]) for r in back.collect()) == [(i, 'x"{' * (i % 3)) for i in range(100)]


def test_references_by_ranges(spark, tmp_path):
    rng = random.Random(1)
    rows = [{"vector": [round(rng.random(), 4) for _ in range(14)], "label": rng.choice(["fraud", "legit"])} for _ in range(60)]
    (tmp_path / "r.json").write_text(json.dumps(rows, indent=1))
    whole = read_references(spark, str(tmp_path / "r.json"))
    parts = read_references(spark, f"file://{tmp_path}/r.json", range_bytes=500)
    key = lambda d: sorted((r["ref_id"], r["vector"], r["label"]) for r in d.collect())
    assert key(parts) == key(whole)


def test_small_ranges_read_no_more_than_the_file(spark, tmp_path, monkeypatch):
    """What ranges read, and the tasks they are dealt to, grow with the file and not with the number of ranges."""
    rows = [{"id": i, "s": "a" * (i % 90)} for i in range(20000)]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    path, size = f"file://{tmp_path}/a.json", (tmp_path / "a.json").stat().st_size
    starts = range(0, size, 1 << 16)
    pieces, got = arrays._Bytes.pieces, []

    def counted(self, *where):
        for b in pieces(self, *where):
            got.append(len(b))
            yield b

    monkeypatch.setattr(arrays._Bytes, "pieces", counted)
    ranges = [arrays._summary(path, 0, s, min(size, s + (1 << 16))) for s in starts]
    assert sum(got) < 1.2 * size
    got.clear()
    names = [c.split(" ")[0] for c in arrays.RANGES.split(", ")]
    table = pa.Table.from_pylist([dict(zip(names, [*x[:8], [list(m.items()) for m in x[8]], [list(m.items()) for m in x[9]]], strict=True)) for x in ranges])
    assert [json.loads(x[2]) for s in arrays._starts(table).to_pylist() for x in arrays._records(**s)] == rows and sum(got) < 1.2 * size
    monkeypatch.undo()
    d = arrays.read_array_texts(spark, path, 4096)
    assert d.rdd.getNumPartitions() == spark.sparkContext.defaultParallelism < size / 4096 / 16
    assert len(arrays._RangeReader({"path": path, "rangebytes": 4096, "tasks": 4}).partitions()) <= 4
    assert d.count() == len(rows)


def test_runs_hold_every_range_once(tmp_path, monkeypatch):
    monkeypatch.setattr(arrays, "RANGE", 1000)
    for i, n in enumerate([0, 999, 1, 12345, 0, 500]):
        (tmp_path / f"{i}.json").write_bytes(b" " * n)
    (tmp_path / "2.json.gz").write_bytes(b" " * 700)
    for tasks, size in ((1, 64), (3, 64), (100, 64), (3, 5000)):
        runs = arrays._runs(f"file://{tmp_path}", size, tasks)
        ranges = [r for run in runs for r in run]
        assert sum((700 if z is None else z) - a for _, _, a, z in ranges) == 999 + 1 + 12345 + 500 + 700
        assert len({(f, a) for _, f, a, _ in ranges}) == len(ranges) and {f for _, f, _, _ in ranges} == set(range(7))
        assert all(sum((700 if z is None else z) - a for _, _, a, z in run) < 1000 + size for run in runs)


def test_records_longer_than_ranges_and_steps(spark, tmp_path):
    rows = [{"id": i, "s": 'é"{' * n, "v": [], "o": {"x": "", "y": {"z": i}}} for i, n in enumerate([0, 20000, 1, 3000, 50000, 2])]
    (tmp_path / "a.json").write_text(json.dumps(rows))
    for size in (300, 5000):
        assert [(x[0], x[2]) for x in got(spark, tmp_path / "a.json", size)] == [(i, r["s"]) for i, r in enumerate(rows)]
