"""License scans: phrases that stand word for word, and text blocks near a license notice by an exact set-similarity join.

A block is a window of consecutive tokens, wherever lines break: for a template t of n words, any n / threshold of them, so that as many
foreign words may stand between as words may be missing. A block contains t if it has ``need = ceil(threshold * |t|)`` of its distinct
tokens. Tokens are ordered by how many documents of the corpus have them, rarest first. A block that contains t has one of t's
first ``|t| - need + 1`` tokens, its prefix; so places of prefix tokens are joined with the templates by token, and each brings the tokens
around it. Where fewer than ``need`` tokens of t stand there from that token's position in the order on, or there are fewer tokens at
all, the pair goes; the rest is verified window by window, so nothing is missed and nothing is approximate.
"""

from __future__ import annotations

from collections.abc import Mapping
from math import ceil

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BREAK = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: The phrases to find word for word, and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices to find by their words, and their labels.
TEMPLATES = {
    "released under the mit license": "mit",
    "licensed under the apache license version 2 0": "apache-2",
    "licensed under cc by nc 4 0": "cc-by-nc",
    "this work is licensed under the gnu general public license version 3": "gpl-3",
    "this work is licensed under the gnu lesser general public license version 3": "lgpl-3",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa",
    "redistribution and use in source and binary forms with or without modification are permitted": "bsd",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl-2",
    "permission is hereby granted free of charge to any person obtaining a copy of this software": "mit",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
THRESHOLD = 0.75
#: Rows of templates' prefixes up to which they are broadcast.
MOST_BROADCAST = 10_000


def tokens(text: Column) -> Column:
    """Words of a text with A-Z in lower case. ``lower`` maps two characters beyond ASCII into ASCII; these go first, as letters that stay."""
    low = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "[İK]", "å"))
    return F.array_remove(F.split(low, BREAK), "")


def _places(w: Column, phrase: list[str]) -> Column:
    """Where the phrase starts in ``w``, ascending; the scan runs only where all its words occur."""
    hit = lambda i: [F.get(w, i + k) == x for k, x in enumerate(phrase)]

    def all_of(i: Column) -> Column:
        out = hit(i)[0]
        for x in hit(i)[1:]:
            out = out & x
        return out

    none = F.array().cast("array<int>")
    some = F.size(w) >= len(phrase)
    for x in set(phrase):
        some = some & F.array_contains(w, x)
    return F.when(some, F.filter(F.sequence(F.lit(0), F.size(w) - 1), all_of)).otherwise(none)


def _counts(d: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(token, n): in how many rows of ``d`` (_w) each token of the vocabulary stands; 0 if in none."""
    vocab = F.array(*map(F.lit, vocabulary))
    seen = d.select(F.explode(F.array_intersect("_w", vocab)).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    every = d.sparkSession.range(1).select(F.explode(vocab).alias("token"))
    return every.join(seen, "token", "left").select("token", F.coalesce("n", F.lit(0)).alias("n"))


def _templates(spark: SparkSession, templates: Mapping[str, str], rank: Mapping[str, int], threshold: float) -> DataFrame:
    """(token, label, tokens, later, need, width, n): a row for each prefix token of each template; ``later`` are the template's tokens from it on, in the global order."""
    out = []
    for t, label in sorted(templates.items()):
        ordered = sorted(set(t.split()), key=rank.__getitem__)
        need = ceil(threshold * len(ordered) - 1e-9)
        row = lambda i: F.struct(F.lit(ordered[i]).alias("token"), F.lit(label).alias("label"), F.array(*map(F.lit, ordered)).alias("tokens"), F.array(*map(F.lit, ordered[i:])).alias("later"), F.lit(need).alias("need"), F.lit(width(t, threshold)).alias("width"), F.lit(len(ordered)).alias("n"))  # noqa: B023, E731
        out += [row(i) for i in range(len(ordered) - need + 1)]
    table = spark.range(1).select(F.inline(F.array(*out)))
    return F.broadcast(table) if len(out) <= MOST_BROADCAST else table


def width(template: str, threshold: float) -> int:
    """Tokens in a block to be held against a template."""
    return ceil(len(template.split()) / threshold - 1e-9)


def near_notices(d: DataFrame, templates: Mapping[str, str], threshold: float) -> DataFrame:
    """(_k, _t, spans) for those rows of ``d`` (_k, _t, _w: tokens) with a block that contains a template: (first token's place, label, containment), the best of each label."""
    spark = d.sparkSession
    vocab = sorted({x for t in templates for x in t.split()})
    count = {r["token"]: r["n"] for r in _counts(d, vocab).collect()}  # as many rows as the templates have words
    rank = {x: i for i, x in enumerate(sorted(vocab, key=lambda x: (count[x], x)))}
    table = _templates(spark, templates, rank, threshold)
    widest = max((width(t, threshold) for t in templates), default=1)
    least = {t: ceil(threshold * len(set(t.split())) - 1e-9) for t in templates}
    rare = F.array(*map(F.lit, sorted({x for t in templates for x in sorted(set(t.split()), key=rank.__getitem__)[: len(set(t.split())) - least[t] + 1]})))
    places = lambda w: F.filter(F.transform(w, lambda x, i: F.when(F.array_contains(rare, x), i)), lambda i: i.isNotNull())
    around = lambda i: F.struct(i.alias("at"), F.get("_w", i).alias("token"), F.greatest(i - (widest - 1), F.lit(0)).alias("first"), F.slice("_w", F.greatest(i - (widest - 1), F.lit(0)) + 1, F.lit(2 * widest - 1)).alias("w"))
    found = d.filter(F.arrays_overlap("_w", rare)).select("_k", "_t", F.explode(F.transform(places(F.col("_w")), around)).alias("p")).select("_k", "_t", "p.*")
    found = found.join(table, "token").filter((F.size("w") >= F.col("need")) & (F.size(F.array_intersect("later", "w")) >= F.col("need")))
    own = F.col("at") - F.col("first")  # the prefix token's place among those around it
    starts = F.filter(F.sequence(F.greatest(own - F.col("width") + 1, F.lit(0)), own), lambda s: F.array_contains(F.col("tokens"), F.get("w", s)))
    blocks = F.transform(starts, lambda s: F.struct(F.size(F.array_intersect(F.slice("w", s + 1, F.col("width")), F.col("tokens"))).alias("c"), (-s).alias("s")))
    found = found.withColumn("_b", F.array_max(blocks)).filter(F.col("_b.c") >= F.col("need"))
    best = F.max(F.struct((F.col("_b.c") / F.col("n")).alias("containment"), (F.col("_b.s") - F.col("first")).alias("before")))
    found = found.groupBy("_k", "_t", "label").agg(best.alias("x"))
    return found.groupBy("_k", "_t").agg(F.array_sort(F.collect_list(F.struct((-F.col("x.before")).cast("int").alias("word"), "label", F.col("x.containment").alias("containment")))).alias("spans"))


def scan_licenses(docs: DataFrame, phrases: Mapping[str, str] = PHRASES, templates: Mapping[str, str] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans), a row for each row of ``docs``.

    ``spans`` are the blocks near a notice: (place of the first word, label, containment), the best for each label. Null or empty text has no
    words and no label; rows that repeat a doc_id and its text have the same; other columns are left out. The templates are a
    parameter: their vocabulary, whose counts over all documents are gathered, is bounded by it.
    """
    d = docs.select("doc_id", tokens(F.col("text")).alias("_w"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_k"), F.coalesce(F.xxhash64("text"), F.lit(0)).alias("_t"))
    near = near_notices(d, templates, threshold)
    for i, p in enumerate(phrases):
        d = d.withColumn(f"_p{i}", _places(F.col("_w"), p.split()))
    at = F.array_sort(F.concat(*[F.col(f"_p{i}") for i in range(len(phrases))]))
    base = F.array_sort(F.array_distinct(F.filter(F.array(*[F.when(F.size(f"_p{i}") > 0, F.lit(x)) for i, x in enumerate(phrases.values())]), lambda x: x.isNotNull())))
    d = d.select("doc_id", "_k", "_t", F.size("_w").cast("long").alias("n_words"), at.alias("_at"), base.alias("_base"))
    none = F.array().cast("array<struct<word:int,label:string,containment:double>>")
    d = d.join(near, ["_k", "_t"], "left").withColumn("spans", F.coalesce("spans", none))
    return d.select(
        "doc_id", "n_words", F.size("_at").cast("long").alias("n_base"), F.get("_at", F.lit(0)).cast("long").alias("first_word"), F.get("_at", F.size("_at") - 1).cast("long").alias("last_word"),
        F.array_join("_base", ",").alias("base_labels"), F.array_join(F.array_sort(F.array_union("_base", F.transform("spans", lambda s: s["label"]))), ",").alias("labels"),
        F.when(F.size("_at") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["containment"])), F.lit(0.0))).alias("score"), "spans",
    )
