import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.data import SCHEMA
from vicinal.llm import langid
from vicinal.llm.langid import _gradients, _probabilities, _states, fit, held_out, identify, pooled, sample, train

ROWS = [("en", "the and with that this from which have thing"), ("de", "und der die das nicht mit einer sich auch"), ("fr", "le la les des une est dans pour qui que")]


def test_gradients_equal_differences():
    m = train([(lang, x) for lang, x in ROWS], hidden=3, epochs=1)
    for name in ("table", "state", "bias", "out", "out_bias"):
        setattr(m, name, getattr(m, name).astype(np.float64))
    rng = np.random.default_rng(0)
    codes, real = rng.integers(97, 103, (6, 4)), np.ones((6, 4))
    real[4:, 1] = 0
    target = np.array([[0, 1, 2, 0]])

    def loss():
        p = _probabilities(m, _states(m, codes))
        picked = np.take_along_axis(p, np.broadcast_to(target[None], (1, 6, 4)), axis=0)[0]
        return -(np.log(picked) * real).sum() / real.sum()

    original = langid.np.empty
    langid.np.empty = lambda shape, dtype=None: original(shape, np.float64 if dtype == np.float32 else dtype)
    zeros = langid.np.zeros
    langid.np.zeros = lambda shape, dtype=None: zeros(shape, np.float64 if dtype in (np.float32, None) else dtype)
    try:
        for w, g in zip(m.weights(), _gradients(m, codes, target, real)):
            for at in [np.unravel_index(int(np.abs(g).argmax()), g.shape), tuple(0 for _ in g.shape)]:
                keep = w[at]
                w[at] = keep + 1e-5
                up = loss()
                w[at] = keep - 1e-5
                down = loss()
                w[at] = keep
                assert abs((up - down) / 2e-5 - g[at]) < 1e-5 * max(1, abs(g[at]))
    finally:
        langid.np.empty, langid.np.zeros = original, zeros


def test_pooling_is_the_mean_over_all_positions_and_does_not_depend_on_neighbours():
    m = train([(lang, x) for lang, x in ROWS], epochs=3)
    texts = [b"the and", b"und der die das " * 40, b"x" * 64, b"le la les" * 300]
    together = pooled(m, texts)
    for i, t in enumerate(texts):
        assert np.allclose(pooled(m, [t])[0], together[i], atol=1e-6)
        sums = np.zeros(3)
        for at in range(0, len(t), langid.SPAN):
            part = t[at : at + langid.SPAN]
            codes = np.zeros((langid.SPAN, 1), np.intp)
            codes[: len(part), 0] = list(part)
            sums += _probabilities(m, _states(m, codes))[:, : len(part), 0].sum(axis=1)
        assert np.allclose(sums / len(t), together[i], atol=1e-5)
    assert np.allclose(together.sum(axis=1), 1, atol=1e-5)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = fit(d)
    got = identify(d.drop("lang", "source"), m).join(d.select("doc_id", "lang"), "doc_id").filter(held_out(F.col("doc_id")))
    n = got.count()
    assert n > 200 and got.filter("lang = lang_pred").count() / n > 0.98
    assert got.filter("score < 0 or score > 1").count() == 0


def test_the_sample_is_bounded_and_leaves_out_what_is_held_out(spark):
    d = spark.createDataFrame([(i, f"text number {'abcdefghij'[i % 10]}{'held' if zlib.crc32(str(i).encode()) % 4 == 2 else 'free'}", ["en", "de", None][i % 3], "s", 1) for i in range(900)], SCHEMA)
    got = sample(d, rows=50, excerpts=1)
    assert len(got) <= 100 and {lang for lang, _ in got} == {"en", "de"} and not any("held" in x for _, x in got)
    assert sorted(got) == sorted(sample(d.repartition(5), rows=50, excerpts=1))


def test_texts_without_letters_nulls_repeats_and_clashing_columns(spark):
    m = train([(lang, x) for lang, x in ROWS] * 20, epochs=30)
    d = spark.createDataFrame([(1, None), (2, ""), (3, "12 !? 3"), (4, "é"), (5, "the and " * 20000), (5, "the and " * 20000), (None, "und")], "doc_id long, text string").withColumn("score", F.lit("x"))
    out = {r["doc_id"]: (r["lang_pred"], r["score"]) for r in identify(d, m).collect()}
    assert all(out[i] == ("und", 0.0) for i in (1, 2, 3)) and out[4][0] in m.languages and out[5][0] == "en" and None in out
    assert identify(d, m).count() == 7


def test_no_labels_and_empty_table(spark):
    d = spark.createDataFrame([(1, "a b", None, "s", 1)], SCHEMA)
    assert fit(d) is None and [tuple(r) for r in identify(d, None).collect()] == [(1, "und", 0.0)]
    e = spark.createDataFrame([], SCHEMA)
    assert fit(e) is None and identify(e, None).count() == 0


def test_the_sample_of_many_labels_is_bounded(spark, monkeypatch):
    from vicinal.llm import langid

    monkeypatch.setattr(langid, "MOST_ROWS", 50)
    monkeypatch.setattr(langid, "MOST_SHARES", 3)
    d = spark.range(3000).selectExpr("id as doc_id", "concat('text of number ', id) as text", "concat('l', if(id < 1000, 0, id % 40)) as lang")
    got = langid.sample(d, rows=20, excerpts=1)
    labels = [x for x, _ in got]
    assert len(got) == 50 and len(set(labels)) == 40  # each label's first row before the second ones
    assert got == langid.sample(d.repartition(7), rows=20, excerpts=1)
