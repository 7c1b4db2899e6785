"""Phrases of words that stand together more often than apart.

A task cuts its texts into shards of a bounded number of words and builds each one's generalised suffix automaton up to a depth: phrases that end at
the same places are one state, which has their number of places; its link is the longest shorter ending that has more.
The automaton is built from its tree of links, which is the trie of the pieces read backwards, level by level, with numpy. States enumerate their
phrases with counts; counts of equal phrases are added up over all shards.

A phrase is no more frequent than its parts, and few pairs are frequent. So pairs are counted first by 64-bit hashes, and a Bloom filter of fixed size
holds the hashes that are frequent. Then words are counted, pairs that the filter lets through and longer phrases of such pairs, all spelled out: what the filter
lets through wrongly is dropped by its count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import parts, ship, spool, unspool

#: Words of a shard: a task holds some 200 bytes for each.
SHARD = 250_000
#: Bits of the Bloom filter; it is broadcast, 16 MB.
_LOG = 27
BITS = 1 << _LOG
_COUNT = pa.schema([("lang", pa.string()), ("size", pa.int32()), ("phrase", pa.string()), ("f", pa.int64())])
_COUNTS = "lang string, size int, phrase string, f long"
BREAKS, SPACES = r"[.,;:!?\x0A-\x0D]", r"[\x20\x09]+"
UNKNOWN = "und"


class Automaton:
    """The generalised suffix automaton, up to ``depth`` words, of pieces of texts.

    ``word`` has all words' numbers, ``group`` their language's and ``place`` a word's place within its piece; phrases lie within a piece and are
    counted by group. Each state has the places where its phrases end (``count``), one of these (``end``), the lengths of its phrases (``shortest`` to
    ``longest``) and its ``link``, -1 for the root.
    """

    def __init__(self, word: np.ndarray, group: np.ndarray, place: np.ndarray, depth: int):
        n_words = int(word.max(initial=0)) + 1
        node = group.astype(np.int64)  # of each end, the node of the trie of backward readings
        ends, offset = np.arange(len(word), dtype=np.int32), 0
        of_end = np.full(len(word), -1, np.int32)
        levels = []
        for k in range(depth):
            longer = place[ends] >= k
            ends, node = ends[longer], node[longer]
            node, keys = pd.factorize(node * n_words + word[ends - k])
            some = np.zeros(len(keys), np.int32)
            some[node] = ends
            levels.append((np.bincount(node, minlength=len(keys)).astype(np.int32), some, of_end[some]))
            of_end[ends] = node + offset
            offset += len(keys)
        count, end, parent = (np.concatenate([level[i] for level in levels]) if levels else np.zeros(0, np.int32) for i in range(3))
        length = np.repeat(np.arange(1, depth + 1, dtype=np.int8), [len(level[0]) for level in levels])
        # a node with the count of its parent is of the parent's state, as the parent's phrase always has the same word before it
        joined = (parent >= 0) & (count == count[parent])
        has = np.zeros(len(count), bool)
        has[parent[joined]] = True
        state_of = np.arange(len(count), dtype=np.int32)
        for k in range(depth - 1, 0, -1):  # a node's state is named by its longest phrase
            at = np.flatnonzero(joined & (length == k + 1))
            state_of[parent[at]] = state_of[at]
        names = np.flatnonzero(~has)
        number = np.full(len(count), -1, np.int32)
        number[names] = np.arange(len(names), dtype=np.int32)
        tops = np.flatnonzero(~joined)  # a state's shortest phrase
        self.count, self.end, self.longest = count[names], end[names], length[names]
        self.shortest, self.link = np.zeros(len(names), np.int8), np.full(len(names), -1, np.int32)
        own = number[state_of[tops]]
        self.shortest[own] = length[tops]
        self.link[own] = np.where(parent[tops] >= 0, number[state_of[parent[tops]]], -1)

    def phrases(self, size: int) -> tuple[np.ndarray, np.ndarray]:
        """(end, count) of each phrase of ``size`` words, once."""
        some = np.flatnonzero((self.shortest <= size) & (size <= self.longest))
        return self.end[some], self.count[some]


def _cut(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, pa.Array]]:
    """(words, groups, places, languages) of shards of about ``most`` words, from (lang, text)."""
    words, groups, places, langs, n = [], [], [], {}, 0
    for b in parts(batches):
        lang = np.array([langs.setdefault(x, len(langs)) for x in b.column(0).to_pylist()], np.int64)
        split = pc.split_pattern_regex(pc.ascii_lower(b.column(1)), BREAKS)
        of_text, piece = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
        split = pc.split_pattern_regex(piece, SPACES)
        of_piece, word = pc.list_parent_indices(split).to_numpy(), pc.list_flatten(split)
        real = pc.not_equal(word, "").to_numpy(zero_copy_only=False)
        of_piece, word = of_piece[real], word.filter(pa.array(real))
        if not len(word):
            continue
        at = np.arange(len(word))
        starts = np.flatnonzero(np.concatenate([[True], of_piece[1:] != of_piece[:-1]]))
        words.append(word)
        groups.append(lang[of_text[of_piece]])
        places.append(at - np.repeat(starts, np.diff(np.append(starts, len(word)))))
        n += len(word)
        if n >= most:
            yield pa.concat_arrays(words), np.concatenate(groups), np.concatenate(places), pa.array(list(langs), pa.string())
            words, groups, places, langs, n = [], [], [], {}, 0
            pa.default_memory_pool().release_unused()
    if n:
        yield pa.concat_arrays(words), np.concatenate(groups), np.concatenate(places), pa.array(list(langs), pa.string())


def _spelled(words: pa.Array, ends: np.ndarray, size: int) -> pa.Array:
    return pc.binary_join_element_wise(*[words.take(pa.array(ends - k)) for k in range(size - 1, -1, -1)], " ")


def _rows(langs: pa.Array, group: np.ndarray, size: int, phrase: pa.Array, count: np.ndarray) -> Iterator[pa.RecordBatch]:
    t = pa.Table.from_arrays([langs.take(pa.array(group)), pa.array(np.full(len(count), size, np.int32)), phrase, pa.array(count.astype(np.int64))], schema=_COUNT)
    yield from t.to_batches(max_chunksize=50_000)


def _hashes(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False)


def _pair_hashes(lang: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Hashes of pairs from those of their language and words."""
    with np.errstate(over="ignore"):
        h = (lang * np.uint64(0x9E3779B97F4A7C15) + left) * np.uint64(0xC2B2AE3D27D4EB4F) + right
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        return h ^ (h >> np.uint64(32))


def _coded(words: pa.Array, langs: pa.Array, group: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words' numbers, their hashes and their languages'."""
    coded = words.dictionary_encode()
    number = coded.indices.to_numpy()
    return number, _hashes(coded.dictionary.to_numpy(zero_copy_only=False))[number], _hashes(langs.to_numpy(zero_copy_only=False))[group]


def pair_counts(batches: Iterator[pa.RecordBatch], shard: int = SHARD) -> Iterator[pa.RecordBatch]:
    """(h, f): counts of pairs by shard, under their hashes."""
    for words, group, place, langs in _cut(batches, shard):
        number, own, lang = _coded(words, langs, group)
        ends, count = Automaton(number, group, place, 2).phrases(2)
        t = pa.Table.from_arrays([pa.array(_pair_hashes(lang[ends], own[ends - 1], own[ends]).view(np.int64)), pa.array(count.astype(np.int64))], names=["h", "f"])
        yield from t.to_batches(max_chunksize=100_000)


def phrase_counts(batches: Iterator[pa.RecordBatch], bloom: np.ndarray, shard: int = SHARD) -> Iterator[pa.RecordBatch]:
    """Counts by shard of words, of pairs that may be frequent and of three words whose pairs may; a phrase of size 0 has all words of a language."""
    for words, group, place, langs in _cut(batches, shard):
        yield from _rows(langs, np.arange(len(langs)), 0, pa.array([""] * len(langs), pa.string()), np.bincount(group, minlength=len(langs)))
        number, own, lang = _coded(words, langs, group)
        # pieces are cut between words that are no frequent pair: no frequent phrase spans that
        at = np.arange(len(number))
        joined = np.flatnonzero(place > 0)
        joined = joined[_may(bloom, _pair_hashes(lang[joined], own[joined - 1], own[joined]))]
        alone = np.ones(len(number), bool)
        alone[joined] = False
        del own, lang
        a = Automaton(number, group, at - np.maximum.accumulate(np.where(alone, at, 0)), 3)
        for size in (1, 2, 3):
            ends, count = a.phrases(size)
            yield from _rows(langs, group[ends], size, _spelled(words, ends, size), count)


def _may(bloom: np.ndarray, h: np.ndarray) -> np.ndarray:
    out = np.ones(len(h), bool)
    for bit in (h & np.uint64(BITS - 1), h >> np.uint64(64 - _LOG)):
        out &= (bloom[bit >> np.uint64(3)] >> (bit & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
    return out


def bloom_filter(hashes: DataFrame) -> np.ndarray:
    """``BITS`` bits in bytes, two of them set for each ``h``. The words of 64 bits that are not zero, 2 million at most, come to the driver."""
    bit = F.explode(F.array(F.col("h").bitwiseAND(F.lit(BITS - 1)), F.shiftrightunsigned("h", 64 - _LOG)))
    bits = hashes.select(bit.alias("bit")).select(F.shiftright("bit", 6).alias("at"), F.expr("shiftleft(1L, cast(bit & 63 as int))").alias("bits"))
    found = bits.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(BITS >> 6, np.int64)
    out[found["at"].to_numpy()] = found["bits"].to_numpy()
    return out.view(np.uint8)


def _score(a: str, left: str, right: str) -> Column:
    """floor(1000000 a a / (l r)), exact: counts up to 10**15 make numerators of 36 digits."""
    return F.expr(f"(cast({a} as decimal(15,0)) * cast({a} as decimal(15,0)) * cast(1000000 as decimal(7,0))) div (cast({left} as decimal(15,0)) * cast({right} as decimal(15,0)))").cast("long")


def collocations(docs: DataFrame, least: int = 10, first: int = 2000, shard: int = SHARD) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's ``first`` phrases of two or three words that occur ``least`` times.

    From (lang, text): A-Z are lower-cased, texts are cut at breaks and those pieces into words. a, l and r are occurrences of the phrase and of its two
    parts at the cut that scores lowest, n all words of the language. A phrase goes if a longer one around it has at least half its occurrences.
    A null lang is ``und``, together with that name itself; null texts are empty; repeated rows count as often as they are there; words may be of any
    length. Without phrases there are no rows.
    """
    spark = docs.sparkSession
    d = docs.select(F.coalesce("lang", F.lit(UNKNOWN)).alias("lang"), "text").filter("text is not null")
    frequent = spool(d.mapInArrow(lambda it: pair_counts(it, shard), "h long, f long").groupBy("h").agg(F.sum("f").alias("f")).filter(F.col("f") >= least).select("h"), "pair-hashes")
    bloom = spark.sparkContext.broadcast(bloom_filter(frequent))
    unspool(frequent)
    counts = d.mapInArrow(lambda it: phrase_counts(it, bloom.value, shard), _COUNTS).groupBy("lang", "size", "phrase").agg(F.sum("f").alias("f"))
    counts = spool(counts.filter((F.col("f") >= least) | (F.col("size") == 0)), "phrases")
    bloom.destroy()
    words, pairs, long = (counts.filter(F.col("size") == k) for k in (1, 2, 3))
    # links: a phrase without its first word, and without its last
    some = lambda n: F.substring_index("phrase", " ", n)  # noqa: E731  so many words from the left, or from the right
    links = long.select("lang", "f", F.explode(F.array_distinct(F.array(some(2), some(-2)))).alias("phrase")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = pairs.join(links, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer") * 100 < F.col("f") * 50))
    one = lambda c, name: words.select("lang", F.col("phrase").alias(c), F.col("f").alias(name))
    two = lambda c, name: pairs.select("lang", F.col("phrase").alias(c), F.col("f").alias(name))
    split = kept.select("lang", "phrase", F.col("f").alias("a"), some(1).alias("w1"), some(-1).alias("w2"))
    split = split.join(one("w1", "l"), ["lang", "w1"]).join(one("w2", "r"), ["lang", "w2"]).select("lang", "phrase", "a", "l", "r", _score("a", "l", "r").alias("score"))
    three = long.select("lang", "phrase", F.col("f").alias("a"), some(1).alias("w1"), some(-1).alias("w3"), some(2).alias("w12"), some(-2).alias("w23"))
    three = three.join(one("w1", "f1"), ["lang", "w1"]).join(one("w3", "f3"), ["lang", "w3"]).join(two("w12", "f12"), ["lang", "w12"]).join(two("w23", "f23"), ["lang", "w23"])
    cut = lambda k, left, right: F.struct(_score("a", left, right).alias("score"), F.lit(k).alias("k"), F.col(left).alias("l"), F.col(right).alias("r"))
    three = three.withColumn("_c", F.least(cut(1, "f1", "f23"), cut(2, "f12", "f3"))).select("lang", "phrase", "a", "_c.l", "_c.r", "_c.score")
    n = counts.filter("size = 0").select("lang", F.col("f").alias("n"))
    w = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = split.unionByName(three).withColumn("rank", F.row_number().over(w).cast("long")).filter(F.col("rank") <= first)
    return ranked.join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


ship(__name__)
