import random
from collections import defaultdict

from pyspark.sql import functions as F

from vicinal.llm.chat import escape, format_chat, loss_text, read_back, unescape

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["[INST]", "[/INST]", "</s>", "<s>", "[TURN]", "\\", "[", "<", "s>", "INST]", "[ROLE]", "[/SYS]", "hello ", "é\n", "", "$1", "[\\INST]", "<\\\\/s>"]


def made(spark, data):
    f = format_chat(spark.createDataFrame(data, SCHEMA))
    return {r["conv_id"]: r for r in f.select("*", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}


def test_escape_is_reversible_and_leaves_no_control_string(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randint(0, 9))) for _ in range(3000)]
    d = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", escape(F.col("t"))).withColumn("b", unescape(F.col("e")))
    assert d.filter("b != t").count() == 0
    assert d.filter(F.col("e").rlike(r"</?s>|\[/?INST\]|\[TURN\]|\[/?ROLE\]|\[/?SYS\]")).count() == 0


def test_turns_and_loss_come_back(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", "tool", "", "[INST]"]
    data = [(c, t, rng.choice(roles), "".join(rng.choice(BITS) for _ in range(rng.randint(0, 6)))) for c in range(60) for t in range(rng.randint(1, 12))]
    want = defaultdict(list)
    for c, _, role, text in sorted(data):
        want[c].append((role, text))
    got = made(spark, data)
    for c, turns in want.items():
        assert [tuple(t) for t in got[c]["turns"]] == turns
        assert got[c]["loss"] == "".join(t for r, t in turns if r == "assistant")
        assert sum(s["length"] for s in got[c]["loss_spans"]) >= len(got[c]["loss"])


def test_adjacent_turns_of_a_role_are_one_block(spark):
    got = made(spark, [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c")])
    assert got[1]["formatted"] == "[INST]a[TURN]b[/INST]<s>c</s>"


def test_nulls_ties_repeats_and_clashing_columns(spark):
    data = [(1, None, None, None), (1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (None, 0, "assistant", "x")]
    d = spark.createDataFrame([(*r, "z") for r in data], SCHEMA + ", formatted string")
    got = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in format_chat(d).select("conv_id", read_back(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("", ""), ("user", "a"), ("user", "a"), ("user", "b")], None: [("assistant", "x")]}


def test_long_text_and_empty_table(spark):
    assert made(spark, [(1, 0, "assistant", "[INST]" * 20000)])[1]["loss"] == "[INST]" * 20000
    assert format_chat(spark.createDataFrame([], SCHEMA)).count() == 0
