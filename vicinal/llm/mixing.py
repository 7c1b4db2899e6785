"""Mixing sources to target weights by systematic sampling.

Within a source the documents' expected copies are prefix-summed in fixed point, one random offset per source is added, and a document is emitted
once for each integer that its interval crosses. A document with more than a 64th of its source's words has a whole number of expected copies, target
over source size rounded up or down: the largest comes first, and each is rounded so that the words so far come nearest to their share of the target.
All others share what is left evenly, with the same expected copies each. So none has more or less than that ratio rounded, and the few
large ones never miss the target by their size. The others are ordered by narrow size classes, one half of them up and the other half down again, so
that the sample has each class's share, and what another offset adds on the way up it takes off on the way down: the words taken come
near the target whatever the offset is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import n_words, spool, unspool

#: Expected copies are held as multiples of 2**-24: prefix sums are exact for 1e11 documents of one source.
UNIT = 24
WEIGHTS = (5, 2, 1)
#: Sizes with the same first bits, so many, are of one class: they differ by less than one in 16.
CLASS_BITS = 5
#: A document with more than this part of its source's words is set on its own; there are fewer than so many in a source.
LARGE = 64
_BLOCK = ("_source", "_class", "_part")


def _key(source: Column) -> Column:
    return F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))


def source_targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, share: float = 1.0) -> DataFrame:
    """Columns (_source, source_size, target) from (_source, source_size), a row for each source.

    ``weights`` are dealt to sources by code point, null last, repeating. Targets sum to ``share`` of all sizes; none is above
    ``cap`` times its source's size, what is cut off being shared again by weight. It is a catalogue of sources,
    not of documents, that is ordered here.
    """
    every = Window.orderBy(F.col("_source") == "", "_source")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(every) - 1) % len(weights) + 1).cast("double")
    s = sizes.select("_source", "source_size", w.alias("w"), (F.col("source_size") * float(cap)).alias("cap"), (F.sum("source_size").over(Window.partitionBy()) * float(share)).alias("all"))
    by = Window.orderBy(F.col("cap") / F.col("w"), "_source")
    s = s.withColumn("rest", F.col("all") - F.coalesce(F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    s = s.withColumn("open", F.sum("w").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("full", F.col("rest") * F.col("w") > F.col("cap") * F.col("open"))
    total = lambda c: F.coalesce(F.sum(c).over(Window.partitionBy()), F.lit(0.0))
    left, open_ = F.col("all") - total(F.when(F.col("full"), F.col("cap"))), total(F.when(~F.col("full"), F.col("w")))
    return s.select("_source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(left * F.col("w") / open_).alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    """``docs`` with size and the columns that order a source's documents."""
    digest = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    bits = F.bin("size")
    up = F.length(bits) * 100_000 + F.rpad(F.substring(bits, 1, CLASS_BITS), CLASS_BITS, "0").cast("int")
    order = F.when(F.substring(F.col("_digest"), 32, 1) < "8", up).otherwise(10_000_000 - up)
    return docs.withColumns({"size": n_words(F.col("text")), "_digest": digest}).withColumns({"_source": _key(F.col("source")), "_class": order, "_part": F.substring("_digest", 1, 2)})


def _least() -> Column:
    """Copies that every document of a source has; none has two more."""
    return F.floor(F.col("target") / F.col("source_size")).cast("long")


def _most() -> Column:
    return F.ceil(F.col("target") / F.col("source_size")).cast("long")


def _is_large() -> Column:
    return F.col("size") * LARGE > F.col("source_size")


def _large_copies(large: DataFrame) -> DataFrame:
    """(_source, _set, _words, _taken) from the large rows of each source, fewer than ``LARGE``: by _class, _part and place within, the copies; words of them all, and words taken."""
    within = Window.partitionBy(*_BLOCK).orderBy("_digest", "doc_id", "size")
    row = F.struct((-F.col("size")).alias("less"), "_digest", "doc_id", "_class", "_part", F.col("_k"), "size")
    rows = large.withColumn("_k", F.row_number().over(within)).groupBy("_source").agg(F.array_sort(F.collect_list(row)).alias("_rows"), F.first("target").alias("target"), F.first("source_size").alias("source_size"))

    def step(acc: Column, x: Column) -> Column:
        so_far = acc["words"] + x["size"]
        short = F.floor(F.col("target") / F.col("source_size") * so_far).cast("long") - acc["taken"]  # of their share, before this one
        n = F.greatest(_least(), F.least(_most(), F.floor((short * 2 + x["size"]) / (x["size"] * 2)).cast("long")))
        mine = F.struct(x["_class"].alias("_class"), x["_part"].alias("_part"), x["_k"].alias("_k"), n.alias("copies"))
        return F.struct(so_far.alias("words"), (acc["taken"] + n * x["size"]).alias("taken"), F.concat(acc["set"], F.array(mine)).alias("set"))

    none = F.expr("cast(array() as array<struct<_class:int,_part:string,_k:int,copies:bigint>>)")
    start = F.struct(F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("taken"), none.alias("set"))
    return rows.withColumn("_a", F.aggregate("_rows", start, step)).select("_source", F.col("_a.set").alias("_set"), F.col("_a.words").alias("_words"), F.col("_a.taken").alias("_taken"))


def _copies(sized: DataFrame, narrow: DataFrame, weights: Sequence[int], cap: int, share: float, seed: int) -> DataFrame:
    """``sized`` with source_size, target and copies; ``narrow`` has the same rows and is read for the totals."""
    targets = spool(source_targets(narrow.groupBy("_source").agg(F.sum("size").alias("source_size")), weights, cap, share), "targets")
    n = narrow.join(targets, "_source")
    large = _large_copies(n.filter(_is_large()))
    left, rest = F.col("target") - F.coalesce("_taken", F.lit(0)), F.col("source_size") - F.coalesce("_words", F.lit(0))
    units = lambda c: c * F.lit(1 << UNIT).cast("long")
    rate = F.when(rest > 0, F.least(units(_most()), F.greatest(units(_least()), F.floor(left / rest * float(1 << UNIT)).cast("long")))).otherwise(0).cast("long")
    offset = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), "_source")), 1, UNIT // 4), 16, 10).cast("long")
    sources = targets.join(large, "_source", "left").select("_source", "source_size", "target", rate.alias("_rate"), offset.alias("_offset"), "_set")
    before = Window.partitionBy("_source").orderBy("_class", "_part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = n.groupBy(*_BLOCK).agg(F.count_if(~_is_large()).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    here = F.filter("_set", lambda x: (x["_class"] == F.col("_class")) & (x["_part"] == F.col("_part")))
    own = F.map_from_entries(F.transform(here, lambda x: F.struct(x["_k"], x["copies"])))
    blocks = spool(blocks.join(sources, "_source").withColumn("_set", own), "blocks")
    unspool(targets)
    within = F.row_number().over(Window.partitionBy(*_BLOCK, "_large").orderBy("_digest", "doc_id", "size"))
    upto = lambda k: F.shiftright(F.col("_rate") * k + F.col("_offset"), UNIT)
    rank = F.col("_before") + F.col("_k")
    d = sized.join(blocks, list(_BLOCK)).withColumn("_large", _is_large()).withColumn("_k", within)
    return d.withColumn("copies", F.when(F.col("_large"), F.element_at("_set", F.col("_k"))).otherwise(upto(rank) - upto(rank - 1)))


def plan_sizes(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, share: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, size, source_size, target, copies): the plan without the documents; texts are read once."""
    narrow = spool(_sized(docs.select("doc_id", "text", "source")).select("doc_id", "size", *_BLOCK, "_digest"), "sizes")
    return _copies(narrow, narrow, weights, cap, share, seed).select("doc_id", "size", "source_size", "target", "copies")


def plan_mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, share: float = 1.0, seed: int = 0) -> DataFrame:
    """``docs`` (doc_id, text, source, ...) with size, source_size, target and copies (long).

    Null text has size 0; a null source is a source of its own, the last one; a null doc_id counts as an empty one; repeated rows are each
    sampled. The order within a source depends on size and doc_id alone, so reruns agree. Columns of ``docs`` named size, source_size,
    target or copies are replaced.
    """
    docs = docs.drop("size", "source_size", "target", "copies")
    sized = _sized(docs)
    narrow = spool(sized.select("doc_id", "size", *_BLOCK, "_digest"), "sizes")
    out = _copies(sized, narrow, weights, cap, share, seed)
    unspool(narrow)  # only the blocks' totals were read from it, and these are a table by now
    return out.select(*docs.columns, "size", "source_size", "target", "copies")


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, cap: int = 3, share: float = 1.0, seed: int = 0) -> DataFrame:
    """The mixed corpus: rows of ``docs``, each as often as ``plan_mix`` says."""
    d = plan_mix(docs, weights, cap, share, seed).filter("copies > 0")
    return d.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*docs.columns)
