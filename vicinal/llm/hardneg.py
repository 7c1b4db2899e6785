"""Hard negatives by a vector-approximation file.

Each dimension is cut into cells at quantiles of its components; a row's approximation is one byte a dimension. For an anchor, a table
has the least and largest product of its component with each cell, so that looking up a row's cells and adding gives bounds of the row's
score. Only rows that the bounds don't rule out are scored exactly. Rows and anchors meet in blocks of a bounded size, and
each block gives a few rows for an anchor.

Bounds and scores are integers. The cells' edges change what is scored, never what is found.
"""

from __future__ import annotations

from math import ceil, inf

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import ship, spool, unspool

SCALE = 256
#: Components beyond this are an error: sums of 512 products stay within 64 bits.
LARGEST = 1 << 27
CELLS = 64
#: Most rows, and most anchors, of a block.
BLOCK = 32_768
#: Stands for a null vec_id within blocks.
_NO_ID = -(1 << 63)
_ROW = "vec_id long, label int, point binary, cells binary"
_NEAR = "anchor_id long, other_id long, score long"
_HARD = "anchor_id long, place int, positive_id long, positive_score long, negative_id long, negative_score long"


def _schema(ddl: str) -> pa.Schema:
    kinds = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (c.split() for c in ddl.split(", "))])


def usable(vec: Column, label: Column) -> Column:
    """Whether a row takes part: a label, a vector, and no null, infinite or NaN component."""
    return label.isNotNull() & vec.isNotNull() & ~F.coalesce(F.exists(vec, lambda x: F.coalesce(~(F.abs(x.cast("double")) < F.lit(inf)), F.lit(True))), F.lit(True))


def integer_rows(d: DataFrame) -> DataFrame:
    """(vec_id, label, vec of long) of the rows that take part, from (vec_id, label, embedding): components are floor(256 * x), x as double."""
    big = F.raise_error(F.concat(F.lit("a component is beyond "), F.lit(LARGEST // SCALE))).cast("long")
    whole = lambda x: F.when(F.abs(x.cast("double")) < float(LARGEST // SCALE), F.floor(x.cast("double") * float(SCALE)).cast("long")).otherwise(big)
    return d.filter(usable(F.col("embedding"), F.col("label"))).select(F.coalesce(F.col("vec_id").cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.col("label").cast("int").alias("label"), F.transform("embedding", whole).alias("vec"))


def cell_bounds(rows: DataFrame, dim: int, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """(low, high), each dim x cells: the least and largest component of each cell. Cells that quantiles leave without values hold none."""
    x = lambda i: F.coalesce(F.get("vec", F.lit(i)), F.lit(0).cast("long"))  # noqa: E731  a shorter vector ends in zeros
    cuts = [k / cells for k in range(1, cells)]
    r = rows.agg(*[f for i in range(dim) for f in (F.min(x(i)), F.max(x(i)), F.percentile_approx(x(i), cuts, 2000))]).first()
    low, high = np.zeros((dim, cells), np.int64), np.zeros((dim, cells), np.int64)
    for i in range(dim):
        least, most, at = r[3 * i : 3 * i + 3]
        low[i] = np.concatenate([[least], np.clip(at, least, most)])
        high[i] = np.concatenate([low[i, 1:] - 1, [most]])
    return low, high


def _approximate(batches, low: np.ndarray):
    """Rows with their components as 32-bit integers and the number of each one's cell."""
    dim = len(low)
    for b in batches:
        vec = b.column(2)
        n, at = len(vec), vec.offsets.to_numpy()
        size = np.diff(at)
        x = np.zeros((n, dim), np.int64)
        row = np.repeat(np.arange(n), size)
        x[row, np.arange(len(row)) - np.repeat(at[:-1] - at[0], size)] = vec.flatten().to_numpy()
        cells = np.column_stack([np.searchsorted(low[i, 1:], x[:, i], side="right") for i in range(dim)]).astype(np.uint8) if dim else np.zeros((n, 0), np.uint8)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([p.tobytes() for p in x.astype("<i4")], pa.binary()), pa.array([c.tobytes() for c in cells], pa.binary())], schema=_schema(_ROW))


class _Rows:
    """A block of rows in the order of their labels."""

    def __init__(self, t: pa.Table, dim: int, cells: int):
        ids, labels = t["vec_id"].to_numpy(), t["label"].to_numpy()
        order = np.lexsort((ids, labels))
        self.ids, self.labels = ids[order], labels[order]
        self.points = np.frombuffer(b"".join(t["point"].to_pylist()), "<i4").reshape(len(ids), dim)[order].astype(np.int64)
        codes = np.frombuffer(b"".join(t["cells"].to_pylist()), np.uint8).reshape(len(ids), dim)[order]
        self.at = np.ascontiguousarray((codes.astype(np.int32) + np.arange(dim, dtype=np.int32) * cells).T)  # where each row looks up in a table

    def of_label(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def bounds(self, point: np.ndarray, low: np.ndarray, high: np.ndarray, rows: slice) -> tuple[np.ndarray, np.ndarray]:
        """The least and largest score that each row can have, by table lookup."""
        p, q = low * point[:, None], high * point[:, None]
        at = self.at[:, rows]
        return np.minimum(p, q).ravel()[at].sum(axis=0), np.maximum(p, q).ravel()[at].sum(axis=0)


def _best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k first by score descending, then id."""
    if len(scores) > 4 * k:
        some = np.flatnonzero(scores >= np.partition(scores, -k)[-k])
        return some[np.lexsort((ids[some], -scores[some]))[:k]]
    return np.lexsort((ids, -scores))[:k]


def _sure(low: np.ndarray, k: int) -> float:
    """What k rows reach for certain."""
    return np.partition(low, -k)[-k] if len(low) >= k else -inf


def _positives(low: np.ndarray, high: np.ndarray, k: int):
    dim, cells = low.shape

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[], [], []]
        if rows.num_rows:
            block = _Rows(rows, dim, cells)
            for anchor, label, point in zip(anchors["vec_id"].to_pylist(), anchors["label"].to_pylist(), anchors["point"].to_pylist(), strict=True):
                own, point = block.of_label(label), np.frombuffer(point, "<i4").astype(np.int64)
                least, most = block.bounds(point, low, high, own)
                other = block.ids[own] != anchor
                some = own.start + np.flatnonzero(other & (most >= _sure(least[other], k)))
                scores = block.points[some] @ point
                best = _best(scores, block.ids[some], k)
                for o, v in zip(out, (np.full(len(best), anchor), block.ids[some][best], scores[best]), strict=True):
                    o.append(v)
        return pa.Table.from_arrays([pa.array(np.concatenate(o) if o else [], pa.int64()) for o in out], schema=_schema(_NEAR))

    return meet


def _negatives(low: np.ndarray, high: np.ndarray, k: int):
    dim, cells = low.shape

    def meet(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        out = [[] for _ in range(6)]
        if rows.num_rows:
            block = _Rows(rows, dim, cells)
            for anchor, label, point, positives in zip(*(anchors[c].to_pylist() for c in ("vec_id", "label", "point", "positives")), strict=True):
                own, point = block.of_label(label), np.frombuffer(point, "<i4").astype(np.int64)
                least, most = block.bounds(point, low, high, slice(None))
                windows = [(p, -((-4 * p["score"]) // 5), p["score"]) for p in positives]  # 80 p <= 100 n, in whole numbers
                wanted = np.zeros(len(least), bool)
                for _, floor, top in windows:
                    able = (most >= floor) & (least <= top)
                    able[own] = False
                    sure = able & (least >= floor) & (most <= top)
                    wanted |= able & (most >= _sure(least[sure], k))
                some = np.flatnonzero(wanted)
                scores, ids = block.points[some] @ point, block.ids[some]
                for p, floor, top in windows:
                    within = np.flatnonzero((scores >= floor) & (scores <= top))
                    best = within[_best(scores[within], ids[within], k)]
                    n = len(best)
                    for o, v in zip(out, (np.full(n, anchor), np.full(n, p["place"]), np.full(n, p["other_id"]), np.full(n, top), ids[best], scores[best]), strict=True):
                        o.append(v)
        schema = _schema(_HARD)
        return pa.Table.from_arrays([pa.array(np.concatenate(o) if o else [], f.type) for o, f in zip(out, schema, strict=True)], schema=schema)

    return meet


def _meet(rows: DataFrame, n: int, anchors: DataFrame, m: int, meet, schema: str) -> DataFrame:
    """Blocks of rows and blocks of anchors, each pair of them once; ``n`` and ``m`` are the numbers of blocks."""
    deal = lambda blocks: F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    every = lambda blocks: F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
    r = rows.withColumn("_i", deal(n)).withColumn("_j", every(m))
    a = anchors.withColumn("_j", deal(m)).withColumn("_i", every(n))
    tasks = max(n * m, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))  # by number: few bytes, but much work in each block
    at = ["_i", "_j"]
    return r.repartition(tasks, *at).groupBy(*at).cogroup(a.repartition(tasks, *at).groupBy(*at)).applyInArrow(meet, schema)


def _top(d: DataFrame, by: list[str], score: str, other: str, k: int, rank: str) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(F.desc(score), other)
    return d.withColumn(rank, F.row_number().over(w)).filter(F.col(rank) <= k)


def hard_negatives(embeddings: DataFrame, anchor: Column, positives: int = 5, negatives: int = 5, cells: int = CELLS) -> DataFrame:
    """(anchor_id, place, positive_id, rank, negative_id, positive_score, negative_score) from (vec_id, embedding, label).

    Anchors are the rows where ``anchor`` holds; higher scores come first, ties by smaller vec_id. An anchor's positives are its first
    other rows of the same label, ``place`` 1 and on. Its negatives for a positive are the first rows of another label whose score is from
    0.8 of the positive's up to the positive's.

    Rows without label or vector, or with a component that is null or not finite, take no part, as anchor or other. Vectors shorter than the
    longest end in zeros. Repeated rows count as often as they are there; of anchors with the same vec_id the least (label, vector) is taken, and rows with
    an anchor's vec_id are not other rows. A null vec_id can be a positive or negative, and comes first among ties; it is no anchor. An empty table gives none.
    """
    spark = embeddings.sparkSession
    whole = integer_rows(embeddings)
    n, dim = whole.agg(F.count("*"), F.max(F.size("vec"))).first()
    low, high = cell_bounds(whole, dim, cells) if n else (np.zeros((0, cells), np.int64),) * 2
    file = spool(whole.mapInArrow(lambda it: _approximate(it, low), _ROW), "approximations")
    asked = file.filter(anchor & (F.col("vec_id") != _NO_ID)).groupBy("vec_id").agg(F.min(F.struct("label", "point")).alias("_a")).select("vec_id", "_a.label", "_a.point")
    asked = spool(asked, "anchors")
    rows = max(ceil(n / BLOCK), 2 * spark.sparkContext.defaultParallelism)
    groups = max(1, ceil(asked.count() / BLOCK))
    near = _top(_meet(file, rows, asked, groups, _positives(low, high, positives), _NEAR), ["anchor_id"], "score", "other_id", positives, "place")
    near = near.groupBy(F.col("anchor_id").alias("vec_id")).agg(F.array_sort(F.collect_list(F.struct("place", "other_id", "score"))).alias("positives"))  # a few for each
    near = spool(asked.join(near, "vec_id"), "positives")
    unspool(asked)
    hard = _meet(file, rows, near, groups, _negatives(low, high, negatives), _HARD)
    out = _top(hard, ["anchor_id", "place"], "negative_score", "negative_id", negatives, "rank")
    known = lambda c: F.when(F.col(c) != _NO_ID, F.col(c)).alias(c)
    return out.select("anchor_id", "place", known("positive_id"), "rank", known("negative_id"), "positive_score", "negative_score")


ship(__name__)
