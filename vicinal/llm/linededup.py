"""Line dedup by content-defined chunks.

A text is cut into lines of a few words: at line breaks, after punctuation and other signs, and after words of one, two or five characters, in any
script with spaces; and after the full-width marks where most characters take three bytes. Repeated passages start and end in the middle of
clauses, so lines must be much shorter than these. A rolling hash over two lines is taken at each line that is not very short, and a chunk of
two lines begins where it is a local minimum: the choice depends on a few lines only, so an insertion before a passage doesn't shift the chunks within
it. Chunks whose hash stands twice or more in the corpus are compared byte for byte with the first occurrence, by doc_id and
place; equal ones are removed, and with them the lines next to them that equal the lines next to the first occurrence: the rest of the
passage, between chunks and at its edges. The first occurrence always stays, so no content is lost.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vicinal.llm.common import let, spool, unspool

#: A line ends at a space after a sign or an ASCII control, or after a word of one, two or five characters: in most languages about every third word.
#: A space is put after each line feed, and after each of these marks in texts of wide characters.
WIDE = "\u3001\u3002\uff01\uff0c\uff1b\uff1f"
_LETTERS = r"a-zA-Z0-9\x80-\x{10FFFF}"
_UNMARKED = r"a-zA-Z0-9\x80-\u3000\u3003-\uff00\uff02-\uff0b\uff0d-\uff1a\uff1c-\uff1e\uff20-\x{10FFFF}"
CUT, CUT_WIDE = (rf" (?:(?<![^ \n][^ \n][{x}] )|(?<=[ \n][^ \n]{{4}}[{x}] ))" for x in (_LETTERS, _UNMARKED))
#: Lines of a chunk. It begins with a line of so many bytes at least: among shorter ones no minimum is looked for.
LINES, LEAST_START = 2, 14
#: Chunks of fewer bytes are left alone: a few common short words in a row are no passage. With 0 every repeated chunk is compared.
LEAST_BYTES = 24
#: What is removed in one place has so many words at least, by the spaces between them (twice as many characters in texts of wide ones): a repeated title or notice is no passage. With 0 every repeated chunk goes.
LEAST_WORDS = 30
#: At most so many lines on either side of a chunk are compared with those beside the first occurrence, and none beyond the next repeated chunk.
#: Chunks begin at every fourth line in the mean, so a passage's edge has fewer. With 0 all lines up to the next repeated chunk are compared.
BESIDE = 24
_SPANS = "array<struct<first:int,last:int>>"


def _wide(text: Column) -> Column:
    """Whether most characters take three bytes or more: scripts without spaces."""
    return F.octet_length(text) > F.length(text) * 2


def _joined(ls: Column, wide: Column) -> Column:
    """The text of which these are the lines."""
    t = F.replace(F.array_join(ls, " "), F.lit("\n "), F.lit("\n"))
    marked = t
    for mark in WIDE:
        marked = F.replace(marked, F.lit(f"{mark} "), F.lit(mark))
    return F.when(wide, marked).otherwise(t)


def _cut(text: Column) -> Column:
    """The lines without the space that each but the last ends with."""
    t = F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit("\n "))
    marked = t
    for mark in WIDE:
        marked = F.replace(marked, F.lit(mark), F.lit(f"{mark} "))
    return F.when(_wide(text), F.split(marked, CUT_WIDE)).otherwise(F.split(t, CUT))


def lines(text: Column) -> Column:
    """The lines with their separators: joined, they are the text."""
    tail = lambda x, n, i: F.when(i < n - 1, F.concat(x, F.lit(" "))).otherwise(x)
    return let(_cut(text), lambda ls: F.transform(ls, lambda x, i: _joined(F.array(tail(x, F.size(ls), i)), _wide(text))))


def chunks(text: Column, least_bytes: int = LEAST_BYTES, least_start: int = LEAST_START) -> Column:
    """Array of (first, last, hash), lines counted from 0: chunks of two lines at local minima of the rolling hash. A text's first and last lines begin none."""
    least_start = min(least_start, least_bytes)
    size = lambda ls, i: sum((F.octet_length(F.get(ls, i + k)) for k in range(1, LINES)), F.octet_length(F.get(ls, i))) + LINES - 1
    minimum = lambda r, x, i: (x < F.lit(2**63 - 1)) & (x < F.get(r, i - 1)) & (x <= F.get(r, i + 1))  # noqa: E731  never the last, which has no line after it
    rolling = lambda ls: F.transform(ls, lambda x, i: F.when(F.octet_length(x) >= least_start, F.xxhash64(x, *[F.get(ls, i + k) for k in range(1, LINES)])).otherwise(F.lit(2**63 - 1)))
    chosen = lambda ls, r: F.transform(r, lambda x, i: F.when(minimum(r, x, i) & (size(ls, i) >= least_bytes), F.struct(i.alias("first"), (i + LINES - 1).alias("last"), x.alias("hash"))))
    found = lambda ls: let(rolling(ls), lambda r: F.filter(chosen(ls, r), lambda c: c.isNotNull()))
    return let(_cut(text), found)


def _run(x: Column, y: Column) -> Column:
    """How many first elements of two arrays are equal."""
    differ = F.zip_with(x, y, lambda a, b: ~a.eqNullSafe(b))
    return F.coalesce(F.array_position(differ, F.lit(True)).cast("int"), F.lit(0)) - 1 + F.when(F.array_contains(differ, True), 0).otherwise(F.size(differ) + 1)


def dedup_lines(docs: DataFrame, least_bytes: int = LEAST_BYTES, least_words: int = LEAST_WORDS, beside_lines: int = BESIDE) -> DataFrame:
    """``docs`` (doc_id, text, ...) with text cleaned, and removed_lines (long), removed (array of (first, last)).

    Null text stays null, and a text of which nothing repeats stays as it is. Rows that repeat a doc_id and its text
    are one document and are changed alike; rows of one doc_id with different texts keep what only they share. A row without doc_id goes by
    its text's hash. Columns of ``docs`` with the added names are replaced. With ``least_bytes`` and ``least_words`` 0 every repeated chunk goes, and
    with ``beside_lines`` 0 the lines beside it however many they are.
    """
    docs = docs.drop("removed_lines", "removed")
    keyed = docs.withColumns({"_k": F.coalesce(F.col("doc_id").cast("long"), F.xxhash64("text")), "_t": F.xxhash64("text")})
    found = spool(keyed.select("_k", "_t", F.explode(chunks(F.col("text"), least_bytes)).alias("c")).select("_k", "_t", "c.first", "c.hash"), "chunks")
    # longs only: summed up before the shuffle and without a sort
    repeated = found.groupBy("hash").agg(F.count("*").alias("_n"), F.min("_k").alias("_one")).filter("_n > 1").drop("_n")
    own = (F.col("_k") == F.col("_one")).alias("own")
    marks = found.join(repeated.hint("shuffle_hash"), "hash").groupBy("_k", "_t").agg(F.collect_set(F.struct("hash", "first", own)).alias("m"))
    # of a document's own equal chunks only the first is the first occurrence
    one = lambda s: F.transform(s, lambda m, i: F.struct(m["first"].alias("first"), m["hash"].alias("hash"), (m["own"] & ~F.coalesce(F.get(s, i - 1)["hash"] == m["hash"], F.lit(False))).alias("is_one")))
    marks = spool(marks.select("_k", "_t", F.array_sort(let(F.array_sort("m"), one)).alias("marks")), "marks")
    unspool(found)

    def passage(ls: Column, m: Column, i: Column, wide: Column) -> Column:
        """A chunk's lines, and those beside it up to the next repeated chunk, or to its end where that is not to be compared too."""
        first, after = m["first"], m["first"] + LINES

        def beside(j: Column) -> Column:
            other = F.get("marks", j)
            gap = F.greatest(F.abs(other["first"] - first) - LINES, F.lit(0)) + F.when(m["is_one"] | other["is_one"], LINES).otherwise(0)
            most = F.lit(beside_lines) if beside_lines else F.size(ls)
            return F.when(other.isNull(), most).otherwise(F.least(most, gap))

        before = lambda n: F.reverse(F.slice(ls, first - n + 1, n))
        return F.struct(wide.alias("wide"), first.alias("first"), (after - 1).alias("last"), m["hash"].alias("hash"), m["is_one"].alias("is_one"), F.array_join(F.slice(ls, first + 1, F.lit(LINES)), " ").alias("body"), let(F.least(first, beside(i - 1)), before).alias("before"), F.slice(ls, after + 1, beside(i + 1)).alias("after"))

    texts = keyed.select("_k", "_t", "text").join(marks.hint("shuffle_hash"), ["_k", "_t"])
    texts = texts.select("_k", "_t", F.explode(let(_wide(F.col("text")), lambda wide: let(_cut(F.col("text")), lambda ls: F.transform("marks", lambda m, i: passage(ls, m, i, wide))))).alias("m"))
    texts = spool(texts.select("_k", "_t", "m.*"), "passages")
    ones = texts.filter("is_one").groupBy("hash").agg(*[F.min(c).alias(f"{c}1") for c in ("body", "before", "after")])
    same = texts.filter("not is_one").join(ones.hint("shuffle_hash"), "hash").filter("body = body1")
    equal = lambda c: F.coalesce(_run(F.col(c), F.col(f"{c}1")), F.lit(0))
    same = same.select("_k", "_t", "wide", "first", "last", "body", "before", "after", equal("before").alias("up"), equal("after").alias("down"))
    gone = F.array_join(F.concat(F.slice("before", F.lit(1), F.col("up")), F.array("body"), F.slice("after", F.lit(1), F.col("down"))), " ")
    size = let(gone, lambda x: F.when(F.col("wide"), F.length(x)).otherwise(F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))))) + 1
    spans = same.select("_k", "_t", "wide", (F.col("first") - F.col("up")).alias("first"), (F.col("last") + F.col("down")).alias("last"), size.alias("size"))
    # those that touch are one
    by = Window.partitionBy("_k", "_t").orderBy("first", "last")
    upto = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = spans.withColumn("_new", F.coalesce(F.col("first") > upto + 1, F.lit(True)).cast("int")).withColumn("_g", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = spans.groupBy("_k", "_t", "wide", "_g").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.sum("size").alias("size"))
    # lines that overlap are counted twice here: what is too short even so needs no second cut
    spans = spans.filter(F.col("size") >= F.when(F.col("wide"), 2 * least_words + 1).otherwise(least_words))
    spans = spool(spans.groupBy("_k", "_t").agg(F.array_sort(F.collect_list(F.struct("first", "last"))).alias("removed")), "cuts")
    for table in (marks, texts):
        unspool(table)

    out = keyed.join(spans.hint("shuffle_hash"), ["_k", "_t"], "left")
    part = lambda ls, s: F.slice(ls, s["first"] + 1, s["last"] - s["first"] + 1)
    wide = _wide(F.col("text"))

    def long(s: Column, ls: Column) -> Column:
        """A span's lines have a word and a space each at least, so many of them need no count."""
        x = F.array_join(part(ls, s), " ")
        return (s["last"] - s["first"] > least_words) | F.when(wide, F.length(x) >= 2 * least_words).otherwise(F.octet_length(x) - F.octet_length(F.replace(x, F.lit(" "), F.lit(""))) >= least_words - 1)

    def rest(ls: Column, s: Column) -> Column:
        """The lines between the spans."""
        after = lambda i: F.coalesce(F.get(s, i - 1)["last"], F.lit(-1)) + 1
        return F.flatten(F.transform(F.sequence(F.lit(0), F.size(s)), lambda i: F.slice(ls, after(i) + 1, F.coalesce(F.get(s, i)["first"], F.size(ls)) - after(i))))

    runs = lambda ls: F.filter("removed", lambda s: long(s, ls))
    made = lambda ls: let(runs(ls), lambda s: let(rest(ls, s), lambda kept: F.struct(s.alias("spans"), _joined(kept, wide).alias("text"), (F.size(ls) - F.size(kept)).cast("long").alias("n"))))
    # generated, so that a filter on what comes out doesn't repeat it
    out = out.withColumn("_c", F.explode(F.array(F.when(F.col("removed").isNotNull(), let(_cut(F.col("text")), made)))))
    text = F.when(F.coalesce("_c.n", F.lit(0)) == 0, F.col("text")).otherwise(F.col("_c.text"))
    return out.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns], F.coalesce("_c.n", F.lit(0)).alias("removed_lines"), F.coalesce("_c.spans", F.array().cast(_SPANS)).alias("removed"))
