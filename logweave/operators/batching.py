"""Micro-batches by count, bytes and age.

Greedy byte-capped batches are sequential inside one stream; streams (connections, partitions) run in parallel, and a
stream is read in order without being held in memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

MAX_ENTRIES = 128
MAX_BYTES = 1 << 20


def by_count(rows: DataFrame, stream: str, order: str, size: int = MAX_ENTRIES) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(stream).orderBy(order)) - 1
    return rows.withColumn("batch", F.floor(place / size).cast("long"))


def greedy(rows: DataFrame, stream: str, order: str, n_bytes: str, max_entries: int = MAX_ENTRIES, max_bytes: int = MAX_BYTES) -> DataFrame:
    """``rows`` with ``batch``: a new one starts where the entry would pass either limit; an entry beyond max_bytes stands alone."""
    fields = rows.schema.fields
    schema = T.StructType([*fields, T.StructField("batch", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, batch, entries, size = object(), 0, 0, 0
        for part in batches:
            out = []
            for s, n in zip(part.column(stream).to_pylist(), part.column(n_bytes).to_pylist(), strict=True):
                if s != current:
                    current, batch, entries, size = s, 0, 0, 0
                elif entries >= max_entries or size + n > max_bytes:
                    batch, entries, size = batch + 1, 0, 0
                entries, size = entries + 1, size + n
                out.append(batch)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.int64())], names=schema.names)

    return rows.repartition(stream).sortWithinPartitions(stream, order).mapInArrow(run, schema)


def flush_plans(requests: DataFrame, stream: str, order: str) -> DataFrame:
    """``requests`` (entries, n_bytes, elapsed boolean, consumed boolean) with action and token of the flush scheduler.

    A full or overdue queue flushes at once, a partial one once after a delay; while a flush is pending further
    requests plan nothing, except that a full queue overtakes a delayed flush.  ``consumed`` says that the pending
    flush ran before the request came.
    """
    fields = requests.schema.fields
    schema = T.StructType([*fields, T.StructField("action", T.StringType()), T.StructField("token", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, pending, token = object(), "None", 0
        for part in batches:
            actions, tokens = [], []
            for s, entries, size, elapsed, consumed in zip(*(part.column(c).to_pylist() for c in (stream, "entries", "n_bytes", "elapsed", "consumed")), strict=True):
                if s != current:
                    current, pending, token = s, "None", 0
                pending = "None" if consumed else pending
                full = entries >= MAX_ENTRIES or size >= MAX_BYTES or elapsed
                wanted = "Immediate" if full else "Delayed"
                idle = entries == 0 or pending == "Immediate" or pending == wanted
                if not idle:
                    pending, token = wanted, token + 1
                actions.append("None" if idle else wanted)
                tokens.append(0 if idle else token)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(actions), pa.array(tokens, pa.int64())], names=schema.names)

    return requests.repartition(stream).sortWithinPartitions(stream, order).mapInArrow(run, schema)


def per_turn(rows: DataFrame, stream: str, order: str, limit: int = 128) -> DataFrame:
    """First in, first out: the turn in which each row is served, ``limit`` rows of a stream a turn."""
    return by_count(rows, stream, order, limit).withColumnRenamed("batch", "turn")


def reconnect_delays(closed: DataFrame, peer: str = "peer", order: str = "seq", lived: str = "lived_ms", long_ms: int = 10_000, base: int = 500, most: int = 2000) -> DataFrame:
    """Delay before the next attempt, for every connection that closed: doubles up to ``most``; one that lived ``long_ms`` starts anew at ``base``."""
    w = Window.partitionBy(peer).orderBy(order)
    rows = closed.withColumn("_island", F.sum((F.col(lived) >= long_ms).cast("int")).over(w))
    n = F.row_number().over(Window.partitionBy(peer, "_island").orderBy(order)) - 1
    doubled = F.least(F.lit(float(most)), base * F.pow(F.lit(2.0), n)).cast("long")
    return rows.withColumn("delay_ms", doubled).drop("_island")


def expired(proposals: DataFrame, now_ms: Column, commit_index: Column, timeout_ms: int = 1000) -> DataFrame:
    """Proposals (log_index, proposed_ms) that time out: beyond the commit index and at least so old.  Their entries stay in the log."""
    return proposals.filter((F.col("log_index") > commit_index) & (now_ms - F.col("proposed_ms") >= timeout_ms))


def oldest_expired(proposals: DataFrame, now_ms: Column, commit_index: Column, timeout_ms: int = 1000) -> DataFrame:
    """(n, oldest_index) of the proposals that time out."""
    return expired(proposals, now_ms, commit_index, timeout_ms).agg(F.count(F.lit(1)).alias("n"), F.min("log_index").alias("oldest_index"))


def pages(rows: DataFrame, order: str, size: int = 64, block: int = 1 << 16) -> DataFrame:
    """``rows`` with ``page``: ``size`` rows of ``order`` (a whole number, unique) each; numbered in blocks of ``order``, not in one task."""
    b = F.floor(F.col(order) / block)
    per = rows.groupBy(b.alias("_b")).agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    offsets = per.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_o"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(order)) - 1
    return rows.withColumn("_b", b).withColumn("_i", inside).join(offsets, "_b").withColumn("page", F.floor((F.col("_o") + F.col("_i")) / size).cast("long")).drop("_b", "_i", "_o")
