"""Near duplicates: MinHash with banding, signature and set verification, components by alternating large-star and small-star.

Documents with one shingle set are one node from the start, so copies never meet in pairs. Nodes that share a band meet in two
steps. First each is compared with its bucket's smallest node, which joins the members of true groups at the price of one
comparison each. Then, in buckets whose members are still in different components, those outside the bucket's largest component
are compared with all, dealt out in blocks; a block's overlaps are one matrix product, and only links come out of it. So no bucket
is capped, and no link between nodes of one bucket is lost. Links hold on the whole sets.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import parts, ship, spool, unspool

WIDTH = 5
PERCENT = 75
BANDS, ROWS = 32, 4  # a pair of similarity 0.75 shares no band with probability 5e-6
SEED = 20240229
#: Signatures agreeing in fewer places than this belong to pairs under the threshold: 6 standard deviations below it.
SLACK = 6
#: Shingles, and documents, in a block that is compared with another block at once.
BLOCK, BLOCK_DOCS = 60_000, 2_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _hashers(seed: int = SEED) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    u64 = lambda n: rng.integers(0, 1 << 64, n, dtype=np.uint64)
    return {"byte": u64(256), "place": u64(WIDTH) | np.uint64(1), "length": u64(WIDTH + 1), "a": u64(BANDS * ROWS) | np.uint64(1), "b": u64(BANDS * ROWS)}


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """64-bit hashes of the 5-word shingles of many texts at once, all in numpy."""

    def __init__(self, seed: int = SEED) -> None:
        self.k = _hashers(seed)
        self.power = self.inverse = np.ones(1, np.uint64)
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True

    def _powers(self, n: int) -> None:
        if len(self.power) < n:
            with np.errstate(over="ignore"):
                self.power = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, _ODD)]))
                inv = np.uint64(pow(int(_ODD), -1, 1 << 64))
                self.inverse = np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full(n, inv)]))

    def sets(self, texts: list[str | None]) -> list[np.ndarray]:
        """For each text the sorted distinct shingle hashes; empty without words. A-Z count as a-z; other letters as they are."""
        data = [(t or "").encode().lower() for t in texts]
        raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        self._powers(len(raw))
        ends = np.cumsum([len(d) + 1 for d in data])
        gap = self.space[raw]
        edge = np.flatnonzero(np.diff(gap, prepend=True))
        first, last = edge[::2], edge[1::2]
        with np.errstate(over="ignore"):
            sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.k["byte"][raw] * self.power[: len(raw)], dtype=np.uint64)])
            word = _mixed((sums[last] - sums[first]) * self.inverse[first])
            n = len(word)
            bounds = np.searchsorted(first, np.concatenate([[0], ends]))
            full = np.zeros(max(0, n - WIDTH + 1), np.uint64)
            for j in range(WIDTH):
                full += word[j : n - WIDTH + 1 + j] * self.k["place"][j] if n >= WIDTH else full
            full = _mixed(full + self.k["length"][WIDTH])
            out = []
            for a, z in zip(bounds[:-1], bounds[1:], strict=True):
                m = z - a
                if m >= WIDTH:
                    out.append(np.unique(full[a : z - WIDTH + 1]))
                elif m:
                    out.append(_mixed(np.sum(word[a:z] * self.k["place"][:m], dtype=np.uint64, keepdims=True) + self.k["length"][m]))
                else:
                    out.append(np.empty(0, np.uint64))
        return out

    def signatures(self, sets: list[np.ndarray]) -> np.ndarray:
        """uint32 minima of universal hashes, a row for each set; sets must not be empty."""
        sig = np.empty((len(sets), BANDS * ROWS), np.uint32)
        at = 0
        with np.errstate(over="ignore"):
            while at < len(sets):
                end, size = at + 1, len(sets[at])
                while end < len(sets) and size + len(sets[end]) <= 1 << 15:
                    size += len(sets[end])
                    end += 1
                x = np.concatenate(sets[at:end])
                starts = np.concatenate([[0], np.cumsum([len(s) for s in sets[at : end - 1]], dtype=np.int64)]).astype(np.int64)
                buf = np.empty_like(x)
                for i, (a, b) in enumerate(zip(self.k["a"], self.k["b"], strict=True)):
                    np.multiply(x, a, out=buf)
                    buf += b
                    sig[at:end, i] = np.minimum.reduceat(buf, starts) >> np.uint64(32)
                at = end
        return sig


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.empty(0, rows[0].dtype if rows else np.int64)]), kind))


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = Shingler()
    none = np.empty(0, np.int32)
    for part in parts(batches):
        sets = s.sets(part.column(1).to_pylist())
        some = [i for i, x in enumerate(sets) if len(x)]
        row = dict(zip(some, s.signatures([sets[i] for i in some]).view(np.int32), strict=True))
        key = [hashlib.blake2b(x.tobytes(), digest_size=16).digest() if len(x) else None for x in sets]
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in sets], pa.int64()), pa.array(key, pa.binary()), _lists([row.get(i, none) for i in range(len(sets))], pa.int32())], names=["doc_id", "n_shingles", "key", "sig"])


def _set_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    s = Shingler()
    for part in parts(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), _lists([x.view(np.int64) for x in s.sets(part.column(1).to_pylist())], pa.int64())], names=["id", "set"])


def _across(table: pa.Table, percent: int) -> pa.Table:
    """Links between the two sides of a block, between different components so far, by whole sets.

    Overlaps are products of incidence matrices over the shingles that both sides have.
    """
    order = np.argsort(table["side"].to_numpy(), kind="stable")
    table = table.take(pa.array(order))
    ids, roots = table["id"].to_numpy(), table["root"].to_numpy()
    cut = int((table["side"].to_numpy() == 0).sum())
    lists = table["set"].combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    values, row = lists.flatten().to_numpy(), np.repeat(np.arange(len(ids)), sizes)
    shared = np.intersect1d(values[row < cut], values[row >= cut])
    at = np.searchsorted(shared, values)
    at[at == len(shared)] = 0
    on = shared[at] == values if len(shared) else np.zeros(len(values), bool)
    row, at = row[on], at[on]
    both = np.zeros((cut, len(ids) - cut), np.float32)
    for first in range(0, len(shared), 2048):
        some = (at >= first) & (at < first + 2048)
        m = np.zeros((len(ids), 2048), np.float32)
        m[row[some], at[some] - first] = 1
        both += m[:cut] @ m[cut:].T
    union = sizes[:cut, None] + sizes[None, cut:] - both
    a, b = np.nonzero((both * 100 >= union * percent) & (roots[:cut, None] != roots[None, cut:]))
    a, b = ids[a], ids[cut + b]
    return pa.table({"u": np.minimum(a, b), "v": np.maximum(a, b)})


def components(edges: DataFrame) -> DataFrame:
    """(node, root), root the smallest node of the component, for the nodes of ``edges`` (u, v) of longs.

    Alternating large-star and small-star; every round's edges are written to the shared folder. Nodes without an edge to another
    node have no row. Hubs are joined, not collected.
    """
    state = lambda e: e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
    e = spool(edges.filter("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = state(e)
    while before[0]:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        last, e = e, spool(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), "edges")
        unspool(last)
        after = state(e)
        if after == before:
            break
        before = after
    return e.select(F.col("u").alias("node"), F.col("v").alias("root"))


def _linked(pairs: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Those of the distinct ``pairs`` (u, v) whose signatures, then whole sets, are similar enough."""
    n = BANDS * ROWS
    j = percent / 100
    least = n * j - SLACK * (n * j * (1 - j)) ** 0.5
    side = lambda d, x: d.select(*[F.col(c).alias(x if c == "id" else f"{c}_{x}") for c in d.columns])
    p = pairs.join(side(nodes, "u"), "u").join(side(nodes, "v"), "v")
    p = p.filter((F.least("n_u", "n_v") * 100 >= F.greatest("n_u", "n_v") * percent) & (F.size(F.filter(F.zip_with("sig_u", "sig_v", lambda a, b: a == b), lambda x: x)) >= least)).select("u", "v")
    p = p.join(side(sets, "u"), "u").join(side(sets, "v"), "v")
    both = F.size(F.array_intersect("set_u", "set_v"))
    p = p.withColumn("_both", both).filter(F.col("_both") * 100 >= (F.size("set_u") + F.size("set_v") - F.col("_both")) * percent)
    return p.select("u", "v").distinct()


def near_duplicates(docs: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), a row for each row of ``docs`` (doc_id, text).

    Null and empty texts have no shingles and stand alone. Rows of one doc_id and one set are one document; where a doc_id has several sets
    and is the smallest of their classes, these classes are one. A row without doc_id is kept
    and in no component. Other columns are left out. Links between candidates are exact; a pair at the threshold
    is a candidate with probability 1 - 5e-6.
    """
    docs = docs.select("doc_id", "text")
    signed = spool(docs.mapInArrow(_signed, "doc_id long, n_shingles long, key binary, sig array<int>"), "signatures")
    classes = signed.filter("n_shingles > 0 and doc_id is not null").groupBy("key").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    nodes = spool(classes, "nodes")
    bands = nodes.select("id", "n", F.explode(F.array(*[F.xxhash64(F.lit(k), *[F.get("sig", F.lit(k * ROWS + i)) for i in range(ROWS)]) for k in range(BANDS)])).alias("band"))
    buckets = bands.groupBy("band").agg(F.min("id").alias("lead"), F.max("id").alias("_last")).filter("lead < _last").drop("_last")
    members = spool(bands.join(buckets, "band"), "buckets")
    ids = members.select("id").distinct()
    near = spool(nodes.select("id", "n", "sig").join(ids, "id", "left_semi"), "candidates")
    sets = spool(docs.join(ids, docs["doc_id"] == ids["id"], "left_semi").mapInArrow(_set_rows, "id long, set array<long>"), "sets")

    stars = spool(_linked(members.filter("id != lead").select(F.col("lead").alias("u"), F.col("id").alias("v")).distinct(), near, sets, percent), "links")
    roots = components(stars)

    placed = members.join(roots, members["id"] == roots["node"], "left").select("band", "id", "n", F.coalesce("root", "id").alias("root"))
    parts = placed.groupBy("band", "root").agg(F.count("*").alias("c"), F.sum("n").alias("n"))
    torn = parts.groupBy("band").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("n").alias("all"), F.sum("c").alias("all_docs"), F.count("*").alias("_parts"), (F.sum("n") - F.max_by("n", F.struct("c", "root"))).alias("rest"), (F.sum("c") - F.max("c")).alias("rest_docs")).filter("_parts > 1")
    left = placed.join(torn, "band").join(sets, "id")
    blocks = lambda c: F.greatest(F.ceil(F.col(c) / BLOCK), F.ceil(F.col(f"{c}_docs") / BLOCK_DOCS)).cast("int")
    own = lambda c: F.pmod(F.xxhash64("id"), blocks(c)).cast("int")
    every = lambda c: F.sequence(F.lit(0), blocks(c) - 1)
    met = F.concat(F.transform(every("rest"), lambda j: F.struct(F.lit(0).alias("side"), own("all").alias("i"), j.alias("j"))), F.when(F.col("root") != F.col("main"), F.transform(every("all"), lambda i: F.struct(F.lit(1).alias("side"), i.alias("i"), own("rest").alias("j")))).otherwise(F.array().cast("array<struct<side:int,i:int,j:int>>")))
    left = left.select("band", "id", "root", "set", F.explode(met).alias("m")).select("band", "m.*", "id", "root", "set")
    across = spool(left.groupBy("band", "i", "j").applyInArrow(lambda t: _across(t, percent), "u long, v long").distinct(), "links")
    roots = components(stars.unionByName(across)) if across.take(1) else roots
    for table in (members, near, sets, stars, across):
        unspool(table)

    groups = nodes.select("key", "id").join(roots, nodes["id"] == roots["node"], "left").select("key", F.coalesce("root", "id").alias("component"))
    out = signed.select("doc_id", "n_shingles", "key").join(groups, "key", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


ship(__name__)
