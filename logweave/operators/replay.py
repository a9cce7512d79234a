"""Folding a command log into key-value state, replies and client sessions.

A log has one row per command: log_index, op (SET, DEL, NOOP), k, v, and for idempotent commands client_id and
request_id.  Nothing sorts the whole log: state needs order inside a key, sessions inside a client.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WRITES = ["SET", "DEL"]


def kv_state(log: DataFrame) -> DataFrame:
    """Last write of every key that is not deleted: k, v, last_index.  ``max_by`` combines before the shuffle."""
    last = log.filter(F.col("op").isin(*WRITES)).groupBy("k").agg(F.max_by(F.struct("op", "v"), "log_index").alias("w"), F.max("log_index").alias("last_index"))
    return last.filter("w.op = 'SET'").select("k", F.col("w.v").alias("v"), "last_index")


def state_asof(log: DataFrame, index: int) -> DataFrame:
    return kv_state(log.filter(F.col("log_index") <= index))


def last_applied(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.max("log_index"), F.lit(0)).alias("last_applied"))


def multi_get(keys: DataFrame, state: DataFrame) -> DataFrame:
    """Every requested key with its value, null where it is missing."""
    return keys.join(state.select("k", "v"), "k", "left")


def replies(log: DataFrame) -> DataFrame:
    """Reply of every command: +OK, and for DEL :1 if the key existed just before."""
    before = Window.partitionBy("k").orderBy("log_index")
    writes = log.filter(F.col("op").isin(*WRITES)).withColumn("existed", F.lag("op").over(before).eqNullSafe("SET"))
    out = writes.select("log_index", "op", "k", F.when(F.col("op") == "SET", "+OK").when(F.col("existed"), ":1").otherwise(":0").alias("reply"))
    noops = log.filter(~F.col("op").isin(*WRITES)).select("log_index", "op", "k", F.lit("+OK").alias("reply"))
    return out.unionByName(noops)


def idemp_status(log: DataFrame) -> DataFrame:
    """``log`` with status: applied if the request id passes all of its client's earlier ones, replay if it equals their largest, else stale."""
    earlier = Window.partitionBy("client_id").orderBy("log_index").rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max("request_id").over(earlier), F.lit(0))
    return log.withColumn("status", F.when(F.col("request_id") > top, "applied").when(F.col("request_id") == top, "replay").otherwise("stale"))


def effective(log: DataFrame) -> DataFrame:
    """The log as the state machine sees it: replayed and stale commands are no-ops."""
    return idemp_status(log).withColumn("op", F.when(F.col("status") == "applied", F.col("op")).otherwise("NOOP"))


def idemp_replies(log: DataFrame) -> DataFrame:
    """Reply of every idempotent command; a replay gets the reply of the command that was applied, a stale one an error."""
    eff = effective(log)
    first = replies(eff).select("log_index", "reply")
    own = Window.partitionBy("client_id", "request_id").orderBy("log_index")
    joined = eff.join(first, "log_index")
    applied = F.first(F.when(F.col("status") == "applied", F.col("reply")), ignorenulls=True).over(own.rowsBetween(Window.unboundedPreceding, 0))
    return joined.select("log_index", "client_id", "request_id", "status", F.when(F.col("status") == "stale", "-ERR stale request id").otherwise(applied).alias("reply"))


def sessions(log: DataFrame) -> DataFrame:
    """Latest session of every client; sessions never expire."""
    done = idemp_replies(log).filter("status = 'applied'")
    return done.groupBy("client_id").agg(F.max("request_id").alias("request_id"), F.max_by("reply", "request_id").alias("reply"))


def session_namespace(commands: DataFrame) -> DataFrame:
    """``commands(conn, seq, verb, a1)`` with the namespace that holds when each runs: set by the connection's last SELECT."""
    upto = Window.partitionBy("conn").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    chosen = F.when(F.col("verb") == "SELECT", F.col("a1"))
    return commands.withColumn("namespace", F.coalesce(F.last(chosen, ignorenulls=True).over(upto), F.lit("default")))


def resolve(results: DataFrame, pending: DataFrame) -> DataFrame:
    """Applied results with the callbacks that wait for their log index."""
    return results.join(pending, "log_index")


def read_barrier(reads: DataFrame, progress: DataFrame, width: int = 1024) -> DataFrame:
    """For each read the first time at which last_applied reached read_index.

    Applied indexes only rise in time, so the answer lies at the smallest applied index not below; looked for
    with a running minimum over both tables in order of the index, inside blocks of ``width`` indexes.
    """
    block = lambda c: F.floor(F.col(c) / width)
    rows = progress.select(block("last_applied").alias("b"), F.col("last_applied").alias("i"), "applied_at", F.lit(None).cast("long").alias("read_id"))
    asks = reads.select(block("read_index").alias("b"), F.col("read_index").alias("i"), F.lit(None).cast(dict(progress.dtypes)["applied_at"]).alias("applied_at"), F.col("read_id").cast("long"))
    later = rows.groupBy("b").agg(F.min("applied_at").alias("t"))
    after = Window.orderBy("b").rowsBetween(1, Window.unboundedFollowing)
    # one row per block of indexes
    fallback = asks.select("b").distinct().join(later, "b", "full").withColumn("next", F.min("t").over(after)).select("b", "next")
    inside = Window.partitionBy("b").orderBy(F.col("i"), F.col("read_id").isNull()).rowsBetween(0, Window.unboundedFollowing)
    both = rows.unionByName(asks).withColumn("t", F.min("applied_at").over(inside)).filter("read_id is not null")
    return both.join(fallback, "b", "left").select("read_id", F.col("i").alias("read_index"), F.coalesce("t", "next").alias("ready_at"))
