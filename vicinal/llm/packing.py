"""Packing token sequences by cutting-stock column generation.

A document's tokens are cut into full sequences and a rest. Rests are counted by length class, and a linear program over patterns of
classes that fit a sequence is solved by the revised simplex method; each new column is the best pattern under the current prices, by
knapsack dynamic programming. Pattern counts are rounded down, what is left is packed first-fit by decreasing length. Rests
are ranked within their class, and a rank determines the pattern, its instance and the slot: no search over sequences. The program sees a
histogram of a few hundred classes, whatever the size of the corpus.
"""

from __future__ import annotations

import os
import re
import warnings
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vicinal.llm.common import parts, prefix_sums, ship, spool

LENGTH, GRAIN = 4096, 16
END_ID = 2
#: A worker forgets its words' ids when it has so many; it then looks them up anew.
MOST_WORDS = 750_000
#: Bytes of text that a worker numbers at once: more have fewer different words in proportion.
PART = 2 << 20
#: Pricing ends after so many columns at the latest, with a warning that says how far from the least number of sequences it may be; none has needed them.
MOST_COLUMNS = 4000
_SPOT = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class WordIds:
    """Token ids of texts whose tokenizer lowers letters and never joins across white space: words are numbered by Arrow, ids are looked up once for each different word of a part.

    Signs between a letter and white space are a word of their own for such a tokenizer; setting them apart leaves fewer different words.
    """

    #: ASCII signs, which are neither letters, digits nor white space.
    SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
    #: Small letters up to U+00FF: nothing in them to normalize or to part.
    PLAIN = re.compile("[a-z\u00df-\u00f6\u00f8-\u00ff]+")

    def __init__(self, path: str, end_id: int = END_ID, most: int = MOST_WORDS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a worker for each core: no threads within them
        from tokenizers import Tokenizer, pre_tokenizers

        bytewise = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str
        self.as_text = {ord(b): a for x in map(chr, range(0xDF, 0x100)) for a, b in zip(bytewise(x)[0][0], x.encode().decode("latin-1"), strict=True)}
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.end, self.most = end_id, most
        self.special = sorted({t.content.lower() for t in self.tokenizer.get_added_tokens_decoder().values()})
        self._forget()

    def _forget(self) -> None:
        """Word w has the ids pool[starts[i] : starts[i + 1]], i = known[w]."""
        self.known: dict[str, int] = {}
        self.pool, self.starts = array("I"), array("q", [0])

    def _learn(self, words: list[str]) -> None:
        tokenize, plain = self.model.tokenize, self.PLAIN.fullmatch
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            simple, rest = [], []
            for w in part:
                (simple if plain(w) else rest).append(w)
            told = [tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(self.as_text)) for w in simple]  # to such words only the merges apply
            others = [e.ids for e in self.tokenizer.encode_batch_fast(rest, add_special_tokens=False)]
            self.pool.extend([t.id for ts in told for t in ts])
            self.pool.extend([i for ids in others for i in ids])
            sizes = np.array([*map(len, told), *map(len, others)], np.int64)
            first = len(self.starts) - 1
            self.known.update(zip(simple + rest, range(first, first + len(sizes)), strict=True))
            self.starts.frombytes((self.starts[-1] + np.cumsum(sizes)).tobytes())

    def _words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Words, some of them empty, one after the other, and where each text's begin."""
        low = pc.ascii_lower(texts)
        if any(pc.any(pc.match_substring(low, x)).as_py() for x in self.special):  # special tokens are told by their letters' case
            split = pc.ascii_split_whitespace(texts)
            return split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        split = pc.ascii_split_whitespace(low)
        words = split.flatten()
        # each word becomes two that lie one behind the other in memory: what is before its last signs, and these
        first = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1]
        data = words.buffers()[2]
        cut = first[:-1] + pc.binary_length(pc.ascii_rtrim(words, characters=self.SIGNS)).to_numpy(zero_copy_only=False)
        before = np.frombuffer(data, np.uint8)[np.maximum(cut - 1, 0)] if data is not None and len(data) else np.zeros(len(words), np.uint8)
        cut = np.where((cut > first[:-1]) & (before >= 97) & (before <= 122), cut, first[1:])
        both = np.empty(2 * len(words) + 1, np.int32)
        both[::2], both[1::2] = first, cut
        halves = pa.StringArray.from_buffers(2 * len(words), pa.py_buffer(both), data or pa.py_buffer(b""))
        return halves, 2 * (split.offsets.to_numpy() - split.offsets[0].as_py())

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit numbers, then the end's."""
        ids, bounds = self.of(pa.array(texts, pa.string()))
        return [ids[a:z].astype("<u4").tobytes() for a, z in zip(bounds[:-1], bounds[1:], strict=True)]

    def of(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): the texts' ids one after the other, each text's ending with the end's, and where each text's begin."""
        if len(self.known) > self.most:
            self._forget()
        words, edges = self._words(pc.fill_null(texts, "").cast(pa.string()))
        coded = words.dictionary_encode()
        different, code = coded.dictionary.to_numpy(zero_copy_only=False).tolist(), coded.indices.to_numpy()
        numbers = list(map(self.known.get, different))
        new = [i for i, x in enumerate(numbers) if x is None]
        if new:
            self._learn([different[i] for i in new])
            for i in new:
                numbers[i] = self.known[different[i]]
        starts, pool = np.frombuffer(self.starts, np.int64), np.frombuffer(self.pool, np.uint32) if self.pool else np.empty(0, np.uint32)
        at = np.array(numbers, np.int64)
        begin, size = starts[at], starts[at + 1] - starts[at]
        sizes = size[code]
        upto = np.concatenate([np.zeros(1, np.int64), np.cumsum(sizes)])
        ids = pool[np.repeat(begin[code] - upto[:-1], sizes) + np.arange(upto[-1])]
        ends = upto[edges]
        return np.insert(ids, ends[1:], self.end), ends + np.arange(len(ends))


def _cut(batches: Iterator[pa.RecordBatch], path: str, end_id: int, length: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    ids_of = WordIds(path, end_id)
    names = [c.split()[0] for c in _SPOT.split(", ")]
    for some in parts(batches, most=PART):
        ids, bounds = ids_of.of(some.column(1))
        totals = np.diff(bounds)
        pieces_of = -(-totals // length)
        row = np.repeat(np.arange(len(totals)), pieces_of)
        start = (np.arange(len(row)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of)) * length
        size = np.minimum(length, totals[row] - start)
        begin = bounds[row] + start
        raw = memoryview(np.ascontiguousarray(ids, "<u4")).cast("B")
        spans = list(zip((4 * begin).tolist(), (4 * (begin + size)).tolist(), strict=True))
        crc = [zlib.crc32(raw[a:z]) for a, z in spans]
        arrays = [some.column(0).take(pa.array(row)), pa.array(start), pa.array(size), pa.array(crc, pa.int64()), pa.array(totals[row])]
        arrays += [pa.array([bytes(raw[a:z]) for a, z in spans], pa.binary())] * with_ids
        yield pa.RecordBatch.from_arrays(arrays, names=names + ["ids"] * with_ids)


def pieces(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): full sequences and the rest of each document (doc_id, text); null text is empty."""
    return docs.select("doc_id", "text").mapInArrow(lambda it: _cut(it, path, end_id, length, with_ids), _SPOT + ", ids binary" * with_ids)


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most value: how often each size."""
    best, choice = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        n = np.searchsorted(sizes, room, side="right")
        best[room] = best[room - 1]
        if n:
            value = best[room - sizes[:n]] + prices[:n]
            k = int(value.argmax())
            if value[k] > best[room] + 1e-12:
                best[room], choice[room] = value[k], k
    pattern, room = np.zeros(len(sizes)), capacity
    while room > 0:
        k = choice[room]
        if k < 0:
            room -= 1
        else:
            pattern[k] += 1
            room -= sizes[k]
    return best[capacity], pattern


def _inverse(a: np.ndarray) -> np.ndarray:
    """By Gauss and Jordan with row exchanges. The library's routine has been seen to wait forever for its threads beside a busy JVM."""
    n = len(a)
    m = np.concatenate([a, np.eye(n)], axis=1)
    for i in range(n):
        p = i + int(np.abs(m[i:, i]).argmax())
        if p != i:
            m[[i, p]] = m[[p, i]]
        m[i] /= m[i, i]
        factor = m[:, i].copy()
        factor[i] = 0
        m -= factor[:, None] * m[i][None, :]
    return m[:, n:]


def _times(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """a @ x without the library's threads."""
    return (a * x[None, :]).sum(axis=1)


def solve(demand: dict[int, int], capacity: int, most: int = MOST_COLUMNS) -> list[tuple[dict[int, int], int]]:
    """Patterns ({class: times}, count) that hold each class exactly as often as demanded, in nearly the fewest sequences."""
    sizes = np.array(sorted(c for c, n in demand.items() if n > 0), np.int64)
    if not len(sizes):
        return []
    d = np.array([demand[int(c)] for c in sizes], np.float64)
    fit = capacity // sizes
    columns = np.diag(fit.astype(np.float64))
    inverse, x = np.diag(1.0 / fit), d / fit
    for step in range(most):
        value, column = _knapsack(sizes, inverse.sum(axis=0), capacity)
        if value <= 1 + 1e-7:
            break
        u = _times(inverse, column)
        ratio = np.where(u > 1e-9, np.maximum(x, 0) / np.where(u > 1e-9, u, 1), np.inf)
        out = int(ratio.argmin())
        pivot = inverse[out] / u[out]
        inverse -= np.outer(u, pivot)
        inverse[out] = pivot
        x -= u * ratio[out]
        x[out] = ratio[out]
        columns[:, out] = column
        if step % 200 == 199:  # errors of many pivots
            inverse = _inverse(columns)
            x = _times(inverse, d)
    else:
        value = _knapsack(sizes, inverse.sum(axis=0), capacity)[0]
        if value > 1 + 1e-7:
            warnings.warn(f"pricing ended after {most} columns: at most {1 - 1 / value:.2%} of the sequences could be spared", stacklevel=2)
    counts = np.floor(np.maximum(x, 0) + 1e-7)
    while ((left := d - _times(columns, counts)) < -0.5).any():  # a count that rounding raised
        counts[int(np.argmax(counts * (columns[int(np.argmin(left))] > 0)))] -= 1
    out_ = [({int(c): int(a) for c, a in zip(sizes, columns[:, p], strict=True) if a}, int(n)) for p, n in enumerate(counts) if n > 0]
    bins: list[tuple[list[int], int]] = []
    for c, n in sorted(zip(sizes.tolist(), np.rint(left).astype(int).tolist(), strict=True), reverse=True):
        for _ in range(n):
            for i, (held, room) in enumerate(bins):
                if room >= c:
                    bins[i] = ([*held, c], room - c)
                    break
            else:
                bins.append(([c], capacity - c))
    return out_ + [({c: held.count(c) for c in set(held)}, 1) for held, _ in bins]


def slots(patterns: list[tuple[dict[int, int], int]]) -> list[tuple[int, int, int, int, int]]:
    """(class, first rank, end rank, times in the pattern, first sequence): which ranks of a class go where."""
    out, filled, sequence = [], {}, 0
    for pattern, n in patterns:
        for c, times in sorted(pattern.items()):
            at = filled.get(c, 0)
            out.append((c, at, at + n * times, times, sequence))
            filled[c] = at + n * times
        sequence += n
    return out


def assign(spark: SparkSession, cut: DataFrame, length: int = LENGTH, grain: int = GRAIN) -> DataFrame:
    """The pieces ``cut`` with sequence_id and offset. ``cut`` is read twice, so it should be a table."""
    p = cut.withColumns({"_class": F.ceil(F.col("length") / grain).cast("int"), "_hash": F.xxhash64("doc_id", "start", "ids_crc32")})
    demand = {r["_class"]: r["n"] for r in p.groupBy("_class").agg(F.count("*").alias("n")).collect()}  # length / grain rows at most
    table = spark.createDataFrame(slots(solve(demand, length // grain)) or [(0, 0, 0, 1, 0)], "_class int, _from long, _to long, _times int, _first long")
    p = prefix_sums(p.withColumn("_part", F.pmod("_hash", F.lit(1024)).cast("int")), ["_class"], ["_part"], [F.col("_hash"), F.col("doc_id"), F.col("start")], F.lit(1), "_rank")
    # patterns times classes in each: bounded by length / grain, not by the corpus
    p = p.join(F.broadcast(table), "_class").filter("_rank >= _from and _rank < _to")
    p = p.withColumn("sequence_id", F.col("_first") + F.floor((F.col("_rank") - F.col("_from")) / F.col("_times")))
    within = Window.partitionBy("sequence_id").orderBy(F.col("_class").desc(), "_rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return p.withColumn("offset", F.sum("length").over(within) - F.col("length")).select(*cut.columns, "sequence_id", "offset")


def pack(docs: DataFrame, path: str, end_id: int = END_ID, length: int = LENGTH, grain: int = GRAIN, with_ids: bool = False) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids], sequence_id, offset): each id of each document (doc_id, text) in exactly one piece.

    Null and empty texts have the end's id alone. Rows that repeat are each packed. Other columns are left out.
    """
    return assign(docs.sparkSession, spool(pieces(docs, path, end_id, length, with_ids), "pieces"), length, grain)


ship(__name__)
