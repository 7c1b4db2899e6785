"""A sink for micro-batches that stands replay, and counts of what went by.

A batch's rows go to a fresh folder; one small file, put in place by a rename, then says that the batch of this number is these rows. A batch that is handed over again is
recognised by its number; what a batch that failed half-way has written is in no such file, so nobody reads it.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


class BatchSink:
    """``sink(rows, number)`` for ``foreachBatch``; rows as Parquet below ``path``, in a store whose renames are atomic."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._at = lambda name: spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{name}")
        self._fs = self._at("commits").getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._at("commits"))

    def __call__(self, rows: DataFrame, number: int) -> None:
        if self._fs.exists(self._at(f"commits/{number}")):
            return
        data, seen = f"data/{number}-{uuid.uuid4().hex}", Observation()
        rows.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(f"{self.path}/{data}")
        aside = self._at(f".{number}-{uuid.uuid4().hex}")
        out = self._fs.create(aside)
        out.write(bytearray(json.dumps({"number": number, "data": data, "rows": seen.get["rows"]}).encode()))
        out.close()
        if not self._fs.exists(self._at(f"commits/{number}")):
            self._fs.rename(aside, self._at(f"commits/{number}"))

    def commits(self) -> DataFrame:
        """(number, data, rows) of the batches that are there."""
        return self.spark.read.schema("number long, data string, rows long").json(f"{self.path}/commits")

    def read(self) -> DataFrame | None:
        """The rows of all batches that are there; None before the first one. Their folders' names, one for each batch, come to the driver."""
        folders = [f"{self.path}/{r['data']}" for r in self.commits().select("data").collect()]
        return self.spark.read.parquet(*folders) if folders else None


class Counts(StreamingQueryListener):
    """Adds up, by name, what streams observe; see ``observed``. Register it with ``spark.streams.addListener``."""

    def __init__(self):
        self.totals: dict[str, dict[str, int]] = {}
        self._seen: set[tuple[str, int, str]] = set()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        for name, row in event.progress.observedMetrics.items():
            batch = (str(event.progress.id), event.progress.batchId, name)
            if batch not in self._seen:  # a batch that is done again counts once
                self._seen.add(batch)
                total = self.totals.setdefault(name, {})
                for k, v in row.asDict().items():
                    total[k] = total.get(k, 0) + (v or 0)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        pass


def observed(payloads: DataFrame, error) -> DataFrame:
    """A stream whose batches tell ``Counts`` under "payloads" how many rows they have, and how many that can't be used."""
    return payloads.observe("payloads", F.count(F.lit(1)).alias("rows"), F.count_if(error.isNotNull()).alias("bad"))
