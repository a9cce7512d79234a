"""Streaming forms: a versioned key-value view, and idempotent requests with one state per client."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.log import snapshot_plus_suffix


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class VersionedView:
    """State as one Parquet folder per micro-batch; writing a batch twice gives the same folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _versions(self) -> list[int]:
        root = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        done = [s.getPath() for s in fs.listStatus(root) if fs.exists(self.spark._jvm.org.apache.hadoop.fs.Path(s.getPath(), "_SUCCESS"))]
        return sorted(int(p.getName()) for p in done)

    def latest(self, before: int | None = None) -> DataFrame | None:
        found = [v for v in self._versions() if before is None or v < before]
        return self.spark.read.parquet(f"{self.path}/{found[-1]}") if found else None

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """State before this batch, and the batch; deletes drop out, which is right as batches come in log order."""
        old = self.latest(batch_id)
        if old is None:
            old = batch.limit(0).select("k", "v", F.col("log_index").alias("last_index"))
        snapshot_plus_suffix(old, batch).write.mode("overwrite").parquet(f"{self.path}/{batch_id}")


def stream_kv_view(log: DataFrame, view: VersionedView, checkpoint: str) -> StreamingQuery:
    """Maintain ``view`` from a streaming log (log_index, op, k, v)."""
    return log.writeStream.foreachBatch(view.apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class _Requests(StatefulProcessor):
    """Largest request id seen of each client."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.top = handle.getValueState("top", "request_id string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("log_index")
        top = Decimal(self.top.get()[0]) if self.top.exists() else Decimal(0)
        status = []
        for r in frame["request_id"]:
            r = Decimal(int(r))
            status.append("applied" if r > top else "replay" if r == top else "stale")
            top = max(top, r)
        self.top.update((str(top),))
        yield pd.DataFrame({"log_index": frame["log_index"], "client_id": key[0], "request_id": frame["request_id"], "status": status})

    def close(self) -> None:
        pass


def stream_idemp(log: DataFrame) -> DataFrame:
    """Streaming log (log_index, client_id, request_id) with the status of each request; micro-batches come in log order.

    Sets the session's state store to RocksDB.
    """
    # the operator needs a store with column families; Spark reads this when the query starts
    log.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    grouped = log.select("log_index", "client_id", "request_id").groupBy("client_id")
    return grouped.transformWithStateInPandas(_Requests(), "log_index long, client_id string, request_id long, status string", "Append", "None")


def proposals_without_answer(proposals: DataFrame, answers: DataFrame, delay: str = "10 seconds") -> DataFrame:
    """Stream join of proposals (id, at) and answers (id, answered_at) inside ``delay``; unanswered ones come with null after the watermark."""
    left = proposals.withWatermark("at", delay)
    right = answers.withColumnRenamed("id", "answer_id").withWatermark("answered_at", delay)
    return left.join(right, F.expr(f"id = answer_id AND answered_at >= at AND answered_at <= at + interval {delay}"), "leftOuter")
