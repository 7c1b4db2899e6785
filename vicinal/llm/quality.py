"""Quality rules: base statistics of whole texts, then robust multivariate outliers per language and source.

Each group's location and scatter are minimum-covariance-determinant estimates: from several starts at quantiles, concentration steps keep
the share of documents with the least Mahalanobis distances until the determinant stops falling, and the start that ends with the least
determinant is taken. Estimates of a language and source lean on those of the language, and these on those of all, by so many documents
as ``SHRINK`` says: so small groups have a verdict too. Statistics are fixed-point integers, quantiles come from histograms, and
documents meet their group's few numbers in a join salted by document; so the result does not depend on the order of rows,
and a group may hold any share of them.
"""

from __future__ import annotations

import warnings

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import let, spool, unspool, words

WINDOW = 8
LEAST_WORDS, REPEAT_PERCENT = 20, 30
#: Share of a group that the estimates rest on, and the squared distance beyond which a document is rejected: chi2(4) at 0.99999.
SHARE, CUTOFF = 0.75, 28.5
#: Starts: the quantiles whose middle is the location and whose distance, over this many standard deviations, is the scale; one scale for all statistics or each its own.
STARTS = ((0.5, 0.5, 0.25, 0.75, 1.349, False), (0.1, 0.9, 0.1, 0.9, 2.563, False), (0.5, 0.5, 0.25, 0.75, 1.349, True))
#: Concentration ends when no logarithm of a determinant falls by more than this, or after so many steps, with a warning; none has needed them.
FALL, MOST_STEPS = 1e-3, 50
#: Expected squared-distance factor for four dimensions at that share: 0.75 / P(chi2(6) <= chi2(4).quantile(0.75)).
CONSISTENCY = 1.486
#: Added standard deviations, by statistic: no group is taken to vary less than this. Clean prose has almost no symbols, so theirs is small.
FLOORS = (0.05, 0.05, 0.12, 0.08)
#: An estimate leans on the wider group's as if it had so many documents of it.
SHRINK = 20
PRIOR = 50
UNIT, SALTS = 1 << 16, 32
_DIM = len(FLOORS)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i + 1)]


def _repeats(w: Column) -> Column:
    """How many words stand in 8-word windows that the text has twice or more."""

    def covered(places: Column) -> Column:
        gap = F.transform(places, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(places, i + 1) - x, F.lit(WINDOW))))
        return F.aggregate(gap, F.lit(0), lambda a, x: a + x)

    def twice(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        places = let(ordered, lambda s: F.filter(F.transform(s, lambda x, j: F.when((F.get(s, j - 1)["h"] == x["h"]) | (F.get(s, j + 1)["h"] == x["h"]), x["i"])), lambda i: i.isNotNull()))
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(F.sort_array(places), covered))

    hashes = F.transform(F.sequence(F.lit(1), F.size(w) - WINDOW + 1), lambda i: F.xxhash64(F.slice(w, i, WINDOW)))
    return F.when(F.size(w) <= WINDOW, F.lit(0)).otherwise(let(hashes, twice))


def base_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed) of whole texts; null text has no words."""
    t = F.coalesce(F.col("text"), F.lit(""))
    full = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    s = let(words(t), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), _repeats(w).cast("long").alias("n_repeat_words")))
    dup = let(full, lambda ls: (F.size(ls) - F.size(F.array_distinct(ls))).cast("long"))
    symbols = F.length(t) - F.length(F.regexp_replace(t, r"[#*$%&|<>]", ""))
    d = docs.select("doc_id", "lang", "source", s.alias("s"), symbols.cast("long").alias("n_symbols"), dup.alias("n_dup_lines"))
    d = d.select("doc_id", "lang", "source", "s.n_words", "s.word_chars", "n_symbols", "n_dup_lines", "s.n_repeat_words")
    return d.withColumn("base_failed", (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT))


def _vector() -> list[Column]:
    """Word length as a logarithm, the others as square roots, each shrunk towards the usual by a prior of so many words."""
    n = F.col("n_words") + PRIOR
    v = [F.log((F.col("word_chars") + 5 * PRIOR) / n), F.sqrt(F.col("n_symbols") / n), F.sqrt(F.col("n_repeat_words") / n), F.sqrt(F.col("n_dup_lines") / n)]
    return [F.round(x * UNIT).cast("long") for x in v]


def _factor(cov: dict[tuple[int, int], Column]) -> dict[str, Column]:
    """Cholesky factor of a covariance, entry by entry, each from those before it."""
    out: dict[str, Column] = {}
    for i in range(_DIM):
        for j in range(i + 1):
            rest = cov[i, j]
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            out[f"l{i}{j}"] = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
    return out


def _distance() -> Column:
    """Squared Mahalanobis distance of v0.. from m0.. under the factor l.. ."""
    y: list[Column] = []
    for i in range(_DIM):
        rest = F.col(f"v{i}") / UNIT - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    total = y[0] * y[0]
    for x in y[1:]:
        total = total + x * x
    return total


_M, _C = [f"m{i}" for i in range(_DIM)], [f"c{i}{j}" for i, j in _PAIRS]
_V = [f"v{i}" for i in range(_DIM)]


def _factored(params: DataFrame) -> DataFrame:
    """``params`` (.., c..) with the factor l.. and logdet."""
    for name, value in _factor({(i, j): F.col(f"c{i}{j}") for i, j in _PAIRS}).items():
        params = params.withColumn(name, value)
    return params.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(1, _DIM)), F.log("l00")) * 2.0)


def _with(stats: DataFrame, params: DataFrame) -> DataFrame:
    """Documents with their group's numbers."""
    salted = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return stats.join(salted, ["g", "_salt"])


def _starts(stats: DataFrame) -> DataFrame:
    """(g, start, m.., c..) from quantiles of histograms."""
    long = stats.select("g", F.posexplode(F.array(*_V)).alias("dim", "v"))
    hist = long.groupBy("g", "dim", F.floor(F.col("v") / 256).alias("bin")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("g", "dim")
    hist = hist.withColumns({"_upto": F.sum("n").over(w.orderBy("bin")), "_all": F.sum("n").over(w)})
    at = sorted({q for x in STARTS for q in x[:4]})
    value = lambda q: (F.min(F.when(F.col("_upto") >= F.col("_all") * q, F.col("bin"))) + 0.5) * 256 / UNIT
    quantiles = hist.groupBy("g", "dim").agg(*[value(q).alias(f"q{int(q * 100)}") for q in at])
    q = lambda x: F.col(f"q{int(x * 100)}")
    out = None
    for k, (m1, m2, lo, hi, width, one) in enumerate(STARTS):
        d = quantiles.select("g", "dim", ((q(m1) + q(m2)) / 2).alias("m"), ((q(hi) - q(lo)) / width).alias("s"))
        of = lambda c, i: F.max(F.when(F.col("dim") == i, F.col(c)))
        scale = lambda i: F.max("s") if one else of("s", i)  # noqa: B023, E731
        d = d.groupBy("g").agg(*[of("m", i).alias(f"m{i}") for i in range(_DIM)], *[scale(i).alias(f"s{i}") for i in range(_DIM)])
        cov = [(F.col(f"s{i}") * F.col(f"s{i}") + FLOORS[i] ** 2 if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
        d = d.select("g", F.lit(k).alias("start"), *_M, *cov)
        out = d if out is None else out.unionByName(d)
    return out


def _concentrated(stats: DataFrame, params: DataFrame, share: float) -> DataFrame:
    """(g, start, m.., c..) of the share of each group that is nearest under ``params``, in one pass over ``stats``: sums are kept by bins of distance."""
    placed = _with(stats, params).select("g", "start", "_salt", *_V, F.floor(F.log2(F.lit(1.0) + _distance()) * 64).alias("bin"))
    names = [f"t{i}" for i in range(_DIM)] + [f"t{i}{j}" for i, j in _PAIRS]
    terms = [F.col(v) for v in _V] + [F.col(f"v{i}") * F.col(f"v{j}") for i, j in _PAIRS]
    # longs within a salt's bin, decimals over them: exact in any order
    sums = placed.groupBy("g", "start", "bin", "_salt").agg(F.count("*").alias("n"), *[F.sum(t).alias(x) for t, x in zip(terms, names, strict=True)])
    sums = sums.groupBy("g", "start", "bin").agg(F.sum("n").alias("n"), *[F.sum(F.col(x).cast("decimal(20,0)")).alias(x) for x in names])
    w = Window.partitionBy("g", "start")
    before = F.coalesce(F.sum("n").over(w.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    core = sums.withColumns({"_before": before, "_all": F.sum("n").over(w)}).filter(F.col("_before") < F.col("_all") * share)
    core = core.groupBy("g", "start").agg(F.sum("n").alias("n"), *[F.sum(x).cast("double").alias(x) for x in names])
    n = F.col("n")
    core = core.select("g", "start", "n", *[(F.col(f"t{i}") / n / UNIT).alias(f"m{i}") for i in range(_DIM)], *[F.col(f"t{i}{j}") for i, j in _PAIRS])
    cov = [((F.col(f"t{i}{j}") / n / float(UNIT) ** 2 - F.col(f"m{i}") * F.col(f"m{j}")) * CONSISTENCY + (FLOORS[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    return core.select("g", "start", *_M, *cov)


def estimates(stats: DataFrame, share: float = SHARE) -> DataFrame:
    """(g, m.., c..): location and scatter of least determinant for each group of ``stats`` (g, _salt, v0.. in units)."""
    found = spool(_factored(_starts(stats)).withColumn("falls", F.lit(True)), "estimates")
    new = [*_M, *_C, *[f"l{i}{j}" for i, j in _PAIRS], "logdet"]
    for step in range(MOST_STEPS):
        last, falling = found, found.filter("falls")
        if not falling.take(1):
            break
        nearer = _factored(_concentrated(stats, falling.drop("falls", "logdet", *_C), share)).select("g", "start", *[F.col(c).alias(f"_{c}") for c in new])
        # the starts themselves are no estimates: the first step always counts
        better = F.coalesce(F.col("_logdet").isNotNull() if step == 0 else F.col("_logdet") < F.col("logdet"), F.lit(False))
        falls = F.coalesce(F.lit(True) if step == 0 else F.col("_logdet") < F.col("logdet") - FALL, F.lit(False))
        found = found.join(nearer, ["g", "start"], "left").select("g", "start", *[F.when(better, F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in new], falls.alias("falls"))
        found = spool(found, "estimates")
        unspool(last)
    else:
        if MOST_STEPS and found.filter("falls").take(1):
            warnings.warn(f"determinants still fall after {MOST_STEPS} steps", stacklevel=2)
    return found.groupBy("g").agg(F.min_by(F.struct(*_M, *_C), F.struct("logdet", "start")).alias("p")).select("g", "p.*")


def _leaning(own: DataFrame, wide: DataFrame) -> DataFrame:
    """``own`` (g, up, n, m.., c..) with the estimates of ``wide`` (g as up) mixed in, as ``SHRINK`` documents of these."""
    w = wide.select(F.col("g").alias("up"), *[F.col(c).alias(f"_{c}") for c in [*_M, *_C]])
    n, k = F.col("n").cast("double"), float(SHRINK)
    mean = [((n * F.col(m) + F.col(f"_{m}") * k) / (n + k)).alias(m) for m in _M]
    cov = [((n * F.col(c) + F.col(f"_{c}") * k) / (n + k)).alias(c) for c in _C]
    return own.join(w, "up").select("g", *mean, *cov)


def quality_rules(docs: DataFrame, share: float = SHARE, cutoff: float = CUTOFF) -> DataFrame:
    """``base_statistics`` without lang and source, with distance2 (double) and kept, a row for each row of ``docs`` (doc_id, text, lang, source).

    A document that fails a base rule takes no part in the estimates and isn't kept; its distance is null. Null languages and sources are
    groups too. Columns of ``docs`` beyond these four are left out.
    """
    keyed = base_statistics(docs.select("doc_id", "text", "lang", "source")).withColumns(dict(zip(_V, _vector(), strict=True)))
    name = lambda c: F.when(F.col(c).isNull(), F.lit("")).otherwise(F.concat(F.lit("="), F.col(c)))
    levels = [F.to_json(F.array(name("lang"), name("source"))), F.to_json(F.array(name("lang"))), F.lit("[]")]
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int")
    keyed = spool(keyed.withColumns({"g": levels[0], "_lang": levels[1], "_salt": salt}).drop("lang", "source"), "statistics")
    good = keyed.filter("not base_failed")
    stats = good.select(F.explode(F.array("g", "_lang", levels[2])).alias("g"), "_salt", *_V)
    found = spool(estimates(stats, share), "found")
    sizes = good.groupBy("g", "_lang").agg(F.count("*").alias("n"))
    by_lang = sizes.groupBy("_lang").agg(F.sum("n").alias("n")).select(F.col("_lang").alias("g"), F.lit("[]").alias("up"), "n")
    langs = _leaning(by_lang.join(found, "g"), found)
    params = _leaning(sizes.select("g", F.col("_lang").alias("up"), "n").join(found, "g"), langs)
    params = spool(_factored(params).drop("logdet", *_C), "parameters")
    unspool(found)
    salted = params.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    out = keyed.join(salted, ["g", "_salt"], "left").withColumn("distance2", F.when(~F.col("base_failed"), _distance()))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance2") <= cutoff, F.lit(True))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "distance2")
