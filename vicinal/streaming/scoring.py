"""Payloads as a stream: each micro-batch is scored by the batch code."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vicinal.functions.features import payload_error, quantized, vectorize
from vicinal.operators import knn
from vicinal.sources.interim import written
from vicinal.sources.readers import parse_payloads, payload_texts, split_valid
from vicinal.streaming.sink import observed


def score_payloads(payloads: DataFrame, refs: DataFrame, mode: str = "exact") -> DataFrame:
    """(query_id, frauds, approved, fraud_score) for payloads that are whole, by id.

    Ids are texts and may repeat; the search is by numbers, so payloads are numbered here.
    """
    good, _ = split_valid(payloads)
    asked = written(quantized(vectorize(good)).withColumn("query_id", F.monotonically_increasing_id()), "asked")
    votes = knn.classify(refs, asked.drop("id"), mode)
    return votes.join(asked.select("query_id", "id"), "query_id").select(F.col("id").alias("query_id"), "frauds", "approved", "fraud_score")


def stream_scores(spark: SparkSession, source: str, refs: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "exact", once: bool = False, rejected: Callable[[DataFrame, int], None] | None = None) -> StreamingQuery:
    """Score JSON lines that arrive in the folder ``source``; ``sink`` gets each batch's votes, ``rejected`` its unusable payloads with their error.

    Ranking isn't possible on a stream itself, so it is done in ``foreachBatch``. A batch is handed over at least once, with the same number; ``sink.BatchSink``
    keeps it once. ``sink.Counts`` hears how many payloads went by.
    """
    incoming = observed(parse_payloads(payload_texts(spark.readStream.text(source))), payload_error())

    def handle(batch: DataFrame, k: int) -> None:
        batch.persist()  # read more than once, and what is observed is observed each time
        try:
            sink(score_payloads(batch, refs, mode), k)
            if rejected is not None:
                rejected(split_valid(batch)[1], k)
        finally:
            batch.unpersist()

    writer = incoming.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
