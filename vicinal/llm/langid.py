"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into windows of bytes that cover them wholly. In each, a forward and a backward network read the bytes; from their two
states every position gets the languages' probabilities, and a document's are the mean over all its positions. The network is
trained here, in numpy, by backpropagation through time on a bounded sample of labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import parts, ship

SPAN, HIDDEN = 64, 8
#: The bounds of the training sample: rows for each language and excerpts of each row. Every label of the sample is learned.
SAMPLE, EXCERPTS = 500, 3
#: Rows of the sample in all, and the most frequent labels whose rows are thinned out before they are ranked.
MOST_ROWS, MOST_SHARES = 100_000, 1024
EPOCHS, BATCH, RATE, SEED = 8, 128, 0.02, 7
UNKNOWN = "und"
_BLOCK = 1024


@dataclass
class Model:
    """Weights of both directions, stacked: by byte, by state, and from states to languages."""

    languages: list[str]
    table: np.ndarray  # 2, 3 hidden, 256
    state: np.ndarray  # 2, 3 hidden, hidden
    bias: np.ndarray  # 2, hidden: of the candidate's state part
    out: np.ndarray  # languages, 2 hidden
    out_bias: np.ndarray  # languages, 1

    def weights(self) -> list[np.ndarray]:
        return [self.table, self.state, self.bias, self.out, self.out_bias]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x += 1
    x *= 0.5
    return x


def _softmax(x: np.ndarray) -> np.ndarray:
    x = x - x.max(axis=0)
    np.exp(x, out=x)
    x /= x.sum(axis=0)
    return x


def _states(m: Model, codes: np.ndarray, keep: list | None = None) -> np.ndarray:
    """States of both directions, (2, hidden, span, windows), for codes (span, windows). ``keep`` gets what backpropagation needs."""
    span, n = codes.shape
    h = m.state.shape[2]
    s = np.zeros((2, h, n), np.float32)
    states = np.empty((2, h, span, n), np.float32)
    g, a = np.empty((2, 3 * h, n), np.float32), np.empty((2, 3 * h, n), np.float32)
    bias = m.bias[:, :, None]
    for t in range(span):
        np.take(m.table[0], codes[t], axis=1, out=g[0], mode="clip")
        np.take(m.table[1], codes[span - 1 - t], axis=1, out=g[1], mode="clip")
        np.matmul(m.state, s, out=a)
        gates = g[:, : 2 * h] + a[:, : 2 * h]
        _sigmoid(gates)
        z, r = gates[:, :h], gates[:, h:]
        inner = a[:, 2 * h :] + bias
        c = inner * r
        c += g[:, 2 * h :]
        np.tanh(c, out=c)
        if keep is not None:
            keep.append((s, z.copy(), r.copy(), inner, c))
        s = c + z * (s - c)
        states[0, :, t], states[1, :, span - 1 - t] = s[0], s[1]
    return states


def _probabilities(m: Model, states: np.ndarray) -> np.ndarray:
    """(languages, span, windows)."""
    _, h, span, n = states.shape
    x = m.out @ states.reshape(2 * h, span * n)
    x += m.out_bias
    return _softmax(x).reshape(-1, span, n)


def _gradients(m: Model, codes: np.ndarray, target: np.ndarray, real: np.ndarray) -> list[np.ndarray]:
    """Of the mean cross-entropy over the ``real`` positions (span, windows), by backpropagation through time."""
    keep: list = []
    states = _states(m, codes, keep)
    _, h, span, n = states.shape
    d = _probabilities(m, states)
    d[target, np.arange(span)[:, None], np.arange(n)] -= 1
    d *= real / real.sum()
    flat, wide = d.reshape(len(d), -1), states.reshape(2 * h, -1)
    g_out, g_bias = flat @ wide.T, flat.sum(axis=1, keepdims=True)
    d_states = (m.out.T @ flat).reshape(2, h, span, n)
    g_table, g_state, g_inner = np.zeros_like(m.table), np.zeros_like(m.state), np.zeros_like(m.bias)
    ds = np.zeros((2, h, n), np.float32)
    for t in range(span - 1, -1, -1):
        s, z, r, inner, c = keep[t]
        ds = ds + np.stack([d_states[0, :, t], d_states[1, :, span - 1 - t]])
        dc = ds * (1 - z) * (1 - c * c)
        da = np.concatenate([ds * (s - c) * z * (1 - z), dc * inner * r * (1 - r), dc * r], axis=1)
        dg = np.concatenate([da[:, : 2 * h], dc], axis=1)
        g_state += da @ s.transpose(0, 2, 1)
        g_inner += da[:, 2 * h :].sum(axis=2)
        for k, at in ((0, t), (1, span - 1 - t)):
            np.add.at(g_table[k].T, codes[at], dg[k].T)
        ds = ds * z + m.state.transpose(0, 2, 1) @ da
    return [g_table, g_state, g_inner, g_out, g_bias]


def windows(data: list[bytes], span: int = SPAN) -> tuple[np.ndarray, np.ndarray]:
    """Codes (windows, span) that cover each text of one byte or more, zero-filled, and how many windows each text has."""
    counts = np.array([-(-len(x) // span) for x in data], np.int64)
    raw = b"".join(x.ljust(int(n) * span, b"\0") for x, n in zip(data, counts, strict=True))
    return np.frombuffer(raw, np.uint8).reshape(-1, span), counts


def train(rows: list[tuple[str, str]], hidden: int = HIDDEN, epochs: int = EPOCHS, seed: int = SEED) -> Model:
    """A model from (language, excerpt)."""
    rng = np.random.default_rng(seed)
    languages = sorted({lang for lang, _ in rows})
    data = [x.encode()[:SPAN] for _, x in rows]
    codes, _ = windows([x or b"\0" for x in data])
    real = np.arange(SPAN)[None, :] < np.array([len(x) for x in data])[:, None]
    target = np.array([languages.index(lang) for lang, _ in rows])
    scale = lambda *shape: rng.normal(0, 0.3, shape).astype(np.float32)
    m = Model(languages, scale(2, 3 * hidden, 256), scale(2, 3 * hidden, hidden), np.zeros((2, hidden), np.float32), scale(len(languages), 2 * hidden), np.zeros((len(languages), 1), np.float32))
    first = [np.zeros_like(w) for w in m.weights()]
    second = [np.zeros_like(w) for w in m.weights()]
    steps = epochs * -(-len(rows) // BATCH)
    k = 0
    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), BATCH):
            some = order[at : at + BATCH]
            k += 1
            rate = RATE * (1 - 0.95 * k / steps)
            grads = _gradients(m, np.ascontiguousarray(codes[some].T).astype(np.intp), target[some][None, :], np.ascontiguousarray(real[some].T).astype(np.float32))
            norm = float(np.sqrt(sum(float((g * g).sum()) for g in grads)))
            for w, g, a, b in zip(m.weights(), grads, first, second, strict=True):
                g *= min(1.0, 1.0 / max(norm, 1e-9))
                a += 0.1 * (g - a)
                b += 0.01 * (g * g - b)
                w -= rate * (a / (1 - 0.9**k)) / (np.sqrt(b / (1 - 0.99**k)) + 1e-7)
    return m


def pooled(m: Model, data: list[bytes]) -> np.ndarray:
    """Mean probabilities, (texts, languages), over all positions of each text of one byte or more."""
    codes, counts = windows(data)
    lengths = np.array([len(x) for x in data])
    ends = np.cumsum(counts)
    real = np.full(len(codes), SPAN)
    real[ends - 1] = lengths - (counts - 1) * SPAN
    sums = np.empty((len(codes), len(m.languages)), np.float64)
    for at in range(0, len(codes), _BLOCK):
        part = codes[at : at + _BLOCK]
        n = len(part)
        block = np.zeros((SPAN, _BLOCK), np.intp)  # always as wide, so that a text's numbers don't depend on its neighbours
        block[:, :n] = part.T
        p = _probabilities(m, _states(m, block))
        p *= np.arange(SPAN)[:, None] < np.concatenate([real[at : at + n], np.zeros(_BLOCK - n, np.int64)])
        sums[at : at + n] = p.sum(axis=1, dtype=np.float64).T[:n]
    return np.add.reduceat(sums, np.concatenate([[0], ends[:-1]]), axis=0) / lengths[:, None]


def _predicted(batches: Iterator[pa.RecordBatch], m: Model, keep: Sequence[str]) -> Iterator[pa.RecordBatch]:
    """A text without a letter gets no language, and 0."""
    for part in parts(batches):
        has = part.column(2).to_pylist()
        p = pooled(m, [(t if h else "-").encode() for t, h in zip(part.column(1).to_pylist(), has, strict=True)])
        best = p.argmax(axis=1)
        score = np.where(has, np.clip(np.round(p[np.arange(len(best)), best], 4), 0, 1), 0.0)
        names = [m.languages[i] if h else UNKNOWN for i, h in zip(best, has, strict=True)]
        kept = [part.column("_read" if c == "text" else c) for c in keep]  # the text goes to Python once
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(names, pa.string()), pa.array(score, pa.float64()), *kept], names=["doc_id", "lang_pred", "score", *keep])


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from learning, by a checksum of its id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def sample(docs: DataFrame, rows: int = SAMPLE, excerpts: int = EXCERPTS) -> list[tuple[str, str]]:
    """(language, excerpt) of at most so many rows for each language, drawn by a hash of doc_id from all labelled rows that aren't held out.

    The hash is cut at a share of each frequent language's rows first, so few rows are ranked; excerpts have at most 64 characters. Of a label column with very
    many values ``MOST_ROWS`` rows are taken in all, the first of each label before the second ones.
    """
    mark = F.xxhash64(F.col("doc_id"), F.lit("language"))
    d = docs.filter(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    counts = d.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_SHARES).collect()  # rarer labels need no share
    if not counts:
        return []
    share = F.create_map(*[F.lit(x) for r in sorted(counts) for x in (r["lang"], min(1.0, 3.0 * rows / r["n"]))])
    d = d.filter((F.pmod(mark, F.lit(1 << 20)) / float(1 << 20) < F.coalesce(share[F.col("lang")], F.lit(1.0))) & F.col("text").rlike(r"\p{L}"))
    at = lambda k: F.pmod(F.xxhash64(F.col("doc_id"), F.lit(k)), F.greatest(F.length("text") - SPAN, F.lit(1))).cast("int") + 1
    d = d.select("lang", mark.alias("_mark"), F.array(*[F.substring(F.col("text"), at(k), SPAN) for k in range(excerpts)]).alias("x"))
    d = d.withColumn("_rank", F.row_number().over(Window.partitionBy("lang").orderBy("_mark", "x"))).filter(F.col("_rank") <= rows)
    d = d.orderBy("_rank", "_mark", "lang").limit(MOST_ROWS)
    got = sorted((r["lang"], r["_rank"], list(r["x"])) for r in d.collect())
    return [(lang, x) for lang, _, xs in got for x in xs if x]


def identify(docs: DataFrame, model: Model | None, keep: Sequence[str] = ()) -> DataFrame:
    """(doc_id, lang_pred, score) from (doc_id, text), for each row over its whole text; ``und`` and 0 without a letter or a model.

    Only the text goes into a prediction. The columns ``keep`` are passed through, others are left out.
    """
    if model is None:
        return docs.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), *keep)
    has = F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))
    types = dict(docs.dtypes)
    schema = ", ".join(["doc_id long, lang_pred string, score double", *[f"`{c}` {types[c]}" for c in keep]])
    d = docs.select("doc_id", F.col("text").alias("_read"), has.alias("_has"), *[c for c in keep if c != "text"])
    return d.mapInArrow(lambda it: _predicted(it, model, keep), schema).select("doc_id", "lang_pred", "score", *keep)


def fit(docs: DataFrame, rows: int = SAMPLE, excerpts: int = EXCERPTS) -> Model | None:
    """The model learned from ``sample``; None without labelled rows."""
    got = sample(docs, rows, excerpts)
    return train(got) if got else None


ship(__name__)
