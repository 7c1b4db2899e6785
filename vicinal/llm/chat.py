"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role are merged into one block by an array
aggregation, their texts kept apart by a mark; blocks are concatenated. Control strings inside texts are escaped reversibly: each
begins with a start character that appears nowhere else in any control string, and the escape puts one more backslash after it.
So no control string in the output comes from a text, and the output can be read back without loss.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vicinal.llm.common import let

#: What opens and closes a block of each role, and what parts merged turns.
OPEN = {"user": "[INST]", "assistant": "<s>", "system": "[SYS]"}
CLOSE = {"user": "[/INST]", "assistant": "</s>", "system": "[/SYS]"}
OTHER_OPEN, OTHER_CLOSE, NEXT = "[ROLE]", "[/ROLE]", "[TURN]"
_REST = r"(/?s>|/?INST\]|/?SYS\]|/?ROLE\]|TURN\])"
ESCAPE, UNESCAPE = rf"([\[<])(\\*){_REST}", rf"([\[<])(\\*)\\{_REST}"
_ENDS = r"(?<=</s>|\[/INST\]|\[/SYS\]|\[/ROLE\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, ESCAPE, r"$1$2\\$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, UNESCAPE, "$1$2$3")


def _mark(role: Column, marks: dict[str, str], other: str) -> Column:
    out = F.lit(other)
    for name, mark in marks.items():
        out = F.when(role == name, F.lit(mark)).otherwise(out)
    return out


def format_chat(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) from (conv_id, turn, role, text).

    ``loss_spans`` are (start, length) in code points of ``formatted``: the assistants' texts as escaped there. Null text or role
    is empty; a null turn comes first; turns with one number are ordered by role and text; a null conv_id is a conversation.
    Other columns are left out. A conversation becomes one string, so it has to fit in a row.
    """
    none = F.lit("")
    t = turns.select("conv_id", F.struct("turn", F.coalesce("role", none).alias("role"), F.coalesce("text", none).alias("text")).alias("t"))
    t = t.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    piece = "struct<role:string,text:string>"

    def merged(blocks: Column, x: Column) -> Column:
        """Append to the last block if it has the role, else begin one. Spans are kept as code points."""
        same = (F.size(blocks["roles"]) > 0) & (F.element_at(blocks["roles"], -1) == x["role"])
        head = F.when(same, F.lit(NEXT)).otherwise(F.concat(
            F.when(F.size(blocks["roles"]) > 0, _close(F.element_at(blocks["roles"], -1))).otherwise(F.lit("")), _open(x["role"])))
        return let(head, lambda h: let(escape(x["text"]), lambda e: F.struct(
            F.when(same, blocks["roles"]).otherwise(F.array(x["role"])).alias("roles"),
            F.concat(blocks["parts"], F.array(h, e)).alias("parts"),
            (blocks["n"] + F.length(h) + F.length(e)).cast("long").alias("n"),
            F.when(x["role"] == "assistant", F.concat(blocks["spans"], F.array(F.struct((blocks["n"] + F.length(h) + 1).cast("long").alias("start"), F.length(e).cast("long").alias("length"))))).otherwise(blocks["spans"]).alias("spans"),
        )))

    def _open(role: Column) -> Column:
        return F.when(role.isin(*OPEN), _mark(role, OPEN, "")).otherwise(F.concat(F.lit(OTHER_OPEN), escape(role), F.lit(NEXT)))

    def _close(role: Column) -> Column:
        return _mark(role, CLOSE, OTHER_CLOSE)

    state = "struct<roles:array<string>,parts:array<string>,n:bigint,spans:array<struct<start:bigint,length:bigint>>>"
    start = F.struct(F.array().cast("array<string>").alias("roles"), F.array().cast("array<string>").alias("parts"), F.lit(0).cast("long").alias("n"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")).cast(state)
    done = F.aggregate("turns", start, lambda b, x: merged(b, F.struct(x["role"], x["text"]).cast(piece)).cast(state))
    t = t.select("conv_id", done.alias("b"))
    return t.select("conv_id", F.concat(F.array_join("b.parts", ""), _close(F.element_at("b.roles", -1))).alias("formatted"), F.col("b.spans").alias("loss_spans"))


def _named(name: Column, texts: Column) -> Column:
    return let(name, lambda n: F.transform(texts, lambda x: F.struct(n.alias("role"), unescape(x).alias("text"))))


def read_back(formatted: Column) -> Column:
    """The turns, as array of (role, text), that ``format_chat`` wrote."""
    blocks = F.filter(F.split(formatted, _ENDS), lambda b: b != "")

    def turns(b: Column) -> Column:
        out = None
        for role in [*OPEN, None]:
            a, z = (OPEN[role], CLOSE[role]) if role else (OTHER_OPEN, OTHER_CLOSE)
            inner = F.split(b.substr(F.lit(len(a) + 1), F.length(b) - len(a) - len(z)), r"\[TURN\]")
            texts = inner if role else F.slice(inner, F.lit(2), F.greatest(F.size(inner) - 1, F.lit(0)))
            name = F.lit(role) if role else unescape(F.element_at(inner, 1))
            these = _named(name, texts)
            out = F.when(b.startswith(a), these) if out is None else out.when(b.startswith(a), these)
        return out

    return F.flatten(F.transform(blocks, turns))


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescape(formatted.substr(s["start"].cast("int"), s["length"].cast("int")))), "")
