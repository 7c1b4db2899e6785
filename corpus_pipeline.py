"""A training corpus from ``documents``: language ID, line dedup, near-duplicate removal, mixing to target weights, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it kept, and returns a DataFrame; ``run`` writes each
stage's rows to the shared folder and reads them again as the next one's docs. All but the last return the columns of documents.
Null and empty texts: language ID rejects them, since they have no letter. Empty tables give empty tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vicinal.llm import langid, linededup, mixing, neardup, packing
from vicinal.llm.common import spool, unspool
from vicinal.llm.queries import tokenizer_path

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: A document goes if no language is seen in it with this much confidence.
LEAST_SCORE = 0.35


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is seen; those without a letter and those in no learned language go. A null label becomes the prediction. Without any label every document with a letter stays."""
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs)
    if model is None:  # nothing to learn from: only what has no letter is sure to be in no language
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    d = langid.identify(docs, model, keep=COLUMNS[1:])
    kept = d.filter((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return kept.select("doc_id", "text", F.coalesce("lang", "lang_pred").alias("lang"), "source", "n_chars")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that earlier ones have; n_chars is counted anew. A document of which no word is left goes."""
    d = linededup.dedup_lines(docs.select(*COLUMNS))
    emptied = (F.col("removed_lines") > 0) & ~F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    n_chars = F.when(F.col("removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return d.filter(~emptied).select("doc_id", "text", "lang", "source", n_chars.alias("n_chars"))


def dedup_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group of near duplicates. Rows without doc_id and texts without words stay."""
    gone = neardup.near_duplicates(docs).filter("not kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents, repeated or left out so that each source has its share of the words. A null source is a source; null texts have no words and count as documents."""
    return mixing.mix(docs.select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' token ids with their sequence and offset. A document that the mix repeats is packed as often."""
    return packing.pack(docs, tokenizer_path())


STAGES = [("language_id", identify_language), ("line_dedup", dedup_lines), ("near_dedup", dedup_documents), ("mixing", mix_sources), ("packing", pack_sequences)]

#: Neither a recurrent network nor column generation can be said in SQL; the tests hold run() against its stages' brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    last = None
    for name, stage in STAGES[:-1]:
        docs = spool(stage(spark, docs, sf_dir), name)
        if last is not None:
            unspool(last)
        last = docs
    return STAGES[-1][1](spark, docs, sf_dir)
