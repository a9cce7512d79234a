"""Log algebra: contiguity, conflicts, truncation, compaction, snapshots."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .replay import kv_state


def gaps(log: DataFrame, block: int = 1 << 20) -> DataFrame:
    """Rows that break the log: their index does not follow, or their term falls.  ``problem`` says which.

    Neighbours are compared inside blocks of indexes; each block also gets the last row of the block before it.
    """
    b = F.floor(F.col("log_index") / block)
    rows = log.select("log_index", "term", b.alias("b"), F.lit(True).alias("own"))
    lasts = rows.groupBy("b").agg(F.max(F.struct("log_index", "term")).alias("x"))
    before = Window.orderBy("b")
    carried = lasts.withColumn("to", F.lead("b").over(before)).filter("to is not null").select(F.col("x.log_index").alias("log_index"), F.col("x.term").alias("term"), F.col("to").alias("b"), F.lit(False).alias("own"))
    order = Window.partitionBy("b").orderBy("log_index")
    seen = rows.unionByName(carried).withColumn("pi", F.lag("log_index").over(order)).withColumn("pt", F.lag("term").over(order))
    problem = F.when(F.col("log_index") != F.col("pi") + 1, "gap").when(F.col("term") < F.col("pt"), "term")
    return seen.filter("own").withColumn("problem", problem).filter("problem is not null").select("log_index", "term", "problem")


def term_at(log: DataFrame, index: int, snapshot_index: int = 0, snapshot_term: int = 0) -> DataFrame:
    """Term at an index: 0 at 0, the snapshot's at its index, -1 where there is none."""
    stored = log.filter(F.col("log_index") == index).agg(F.max("term").alias("t"))
    return stored.select(F.when(F.lit(index == 0), 0).when(F.lit(index == snapshot_index), snapshot_term).otherwise(F.coalesce("t", F.lit(-1))).alias("term"))


def conflict_index(log: DataFrame, snapshot_index: int = 0, snapshot_term: int = 0) -> DataFrame:
    """First index of every term: where a leader that conflicts in that term continues.

    If the first stored term is the snapshot's and goes on from it, the snapshot's index stands for it.
    """
    runs = log.groupBy("term").agg(F.min("log_index").alias("first_index"), F.max("log_index").alias("last_index"))
    goes_on = (F.col("first_index") == snapshot_index + 1) & (F.col("term") == snapshot_term) & F.lit(snapshot_index > 0)
    return runs.withColumn("first_index", F.when(goes_on, F.lit(snapshot_index)).otherwise(F.col("first_index")))


def change_points(rows: DataFrame, order: str, value: str, partition: list[str]) -> DataFrame:
    """Rows at which ``value`` differs from the row before, by partition."""
    w = Window.partitionBy(*partition).orderBy(order)
    return rows.withColumn("previous", F.lag(value).over(w)).filter(F.col("previous").isNotNull() & (F.col("previous") != F.col(value)))


def truncate_suffix(log: DataFrame, start: int, snapshot_index: int = 0) -> DataFrame:
    """The log without [start, oo); entries that a snapshot covers stay."""
    return log.filter(F.col("log_index") < max(start, snapshot_index + 1))


def merge_entries(log: DataFrame, incoming: DataFrame) -> DataFrame:
    """The log after an append: from the first incoming entry whose term differs (or that is new) incoming entries replace the suffix."""
    own = log.select("log_index", F.col("term").alias("own_term"))
    first = incoming.join(own, "log_index", "left").filter(F.col("own_term").isNull() | (F.col("own_term") != F.col("term"))).agg(F.min("log_index").alias("cut"))
    kept = log.join(F.broadcast(first)).filter(F.col("cut").isNull() | (F.col("log_index") < F.col("cut"))).drop("cut")
    new = incoming.join(F.broadcast(first)).filter(F.col("log_index") >= F.col("cut")).drop("cut")
    return kept.unionByName(new)


def compact_prefix(log: DataFrame, index: int) -> tuple[DataFrame, DataFrame]:
    """(snapshot state at index, remaining log)."""
    return kv_state(log.filter(F.col("log_index") <= index)), log.filter(F.col("log_index") > index)


def install_snapshot(log: DataFrame, index: int, term: int) -> DataFrame:
    """What stays of the log under a snapshot: the suffix if the log has (index, term), else nothing."""
    match = log.filter((F.col("log_index") == index) & (F.col("term") == term)).limit(1).select(F.lit(True).alias("_match"))
    return log.filter(F.col("log_index") > index).join(F.broadcast(match)).drop("_match")


def snapshot_plus_suffix(snapshot: DataFrame, suffix: DataFrame) -> DataFrame:
    """State of a snapshot (k, v, last_index) and the log after it."""
    base = snapshot.select(F.col("last_index").alias("log_index"), F.lit("SET").alias("op"), "k", "v")
    return kv_state(base.unionByName(suffix.select("log_index", "op", "k", "v")))


def replication_range(log: DataFrame, next_index: int, max_entries: int = 128, max_bytes: int = 2 << 20) -> DataFrame:
    """Entries for one append: from next_index, up to both limits, one entry at least."""
    near = log.filter(F.col("log_index").between(next_index, next_index + max_entries - 1))
    run = F.sum("n_bytes").over(Window.orderBy("log_index"))  # max_entries rows at most
    return near.withColumn("_run", run).filter((F.col("_run") <= max_bytes) | (F.col("log_index") == next_index)).drop("_run")


def assign_indexes(proposals: DataFrame, last_index: int, order: str) -> DataFrame:
    """Log indexes of one batch of proposals (128 at most)."""
    return proposals.withColumn("log_index", F.lit(last_index) + F.row_number().over(Window.orderBy(order)))


def same_inventory(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """Keys whose digests differ or that only one side has."""
    x, y = a.select(key, F.col(digest).alias("left_digest")), b.select(key, F.col(digest).alias("right_digest"))
    return x.join(y, key, "full").filter(~F.col("left_digest").eqNullSafe(F.col("right_digest")))


def duplicated(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def strictly_increasing(rows: DataFrame, partition: str, value: str, order: str) -> DataFrame:
    w = Window.partitionBy(partition).orderBy(order)
    ok = F.coalesce(F.col(value) > F.lag(value).over(w), F.lit(True))
    return rows.withColumn("_ok", ok).groupBy(partition).agg(F.bool_and("_ok").alias("increasing"))


def chunks_of(column: Column, size: int) -> Column:
    """Array of (offset, data, done) pieces of a binary value."""
    n = F.greatest(F.lit(1), F.ceil(F.octet_length(column) / size)).cast("int")
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * size).alias("offset"), F.substring(column, i * size + 1, F.lit(size)).alias("data"), (i == n - 1).alias("done")))


def matches_prefix(requests: DataFrame, log: DataFrame, snapshot_index: int = 0, snapshot_term: int = 0) -> DataFrame:
    """``requests(prev_log_index, prev_log_term, ...)`` with ``matched``: the log has that term at that index (0 at 0)."""
    own = log.select(F.col("log_index").alias("prev_log_index"), F.col("term").alias("own_term"))
    have = F.when(F.col("prev_log_index") == 0, 0).when(F.col("prev_log_index") == snapshot_index, snapshot_term).otherwise(F.col("own_term"))
    return requests.join(own, "prev_log_index", "left").withColumn("matched", F.coalesce(have == F.col("prev_log_term"), F.lit(False))).drop("own_term")


def append_batch(batch: DataFrame, path: str, last_index: int) -> int:
    """Append ``batch(log_index, term, ...)`` to the log below ``path`` and return its last index.

    Refuses, before anything is written, a batch that does not follow ``last_index`` without a gap or has a term below 1; the
    write is one Spark commit.
    """
    seen = batch.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("log_index").alias("d"), F.min("log_index").alias("lo"), F.max("log_index").alias("hi"), F.min("term").alias("term")).first()
    if not seen["n"]:
        return last_index
    if seen["lo"] != last_index + 1 or seen["hi"] != last_index + seen["n"] or seen["d"] != seen["n"] or seen["term"] < 1:
        raise ValueError("invalid index or term in an append")
    batch.write.mode("append").parquet(path)
    return seen["hi"]


def replace_all(new: DataFrame, path: str) -> None:
    """Replace the table below ``path``: the new rows are staged beside it, and an intent says so before the old ones go.

    ``finish_replace`` brings a replacement that died half way to its end, or drops one whose rows were not complete.
    """
    new.write.mode("overwrite").parquet(f"{path}.staged")
    finish_replace(new.sparkSession, path)


def finish_replace(spark, path: str) -> bool:
    """Redo a staged replacement, if there is a complete one.  Running it twice, or after a crash at any point, ends alike."""
    jvm = spark._jvm
    at = lambda p: jvm.org.apache.hadoop.fs.Path(p)
    fs = at(path).getFileSystem(spark._jsc.hadoopConfiguration())
    staged = at(f"{path}.staged")
    if not fs.exists(at(f"{path}.staged/_SUCCESS")):
        fs.delete(staged, True)
        return False
    fs.delete(at(path), True)
    if not fs.rename(staged, at(path)):
        raise RuntimeError("could not rename the staged table")
    return True


def reassemble(chunks: DataFrame) -> DataFrame:
    """Snapshots from ``chunks(stream, seq, last_index, last_term, offset, data binary, done)``: one row (stream, seq, last_index, last_term,
    payload) per snapshot that becomes complete, with the seq of its last chunk.

    Offset 0 starts anew; a chunk whose snapshot or offset is not the one that is due drops what came before.
    """
    order = Window.partitionBy("stream").orderBy("seq")
    # rows from one offset 0 up to the next are a try
    tries = chunks.withColumn("_try", F.sum((F.col("offset") == 0).cast("int")).over(order)).filter("_try > 0")
    inside = Window.partitionBy("stream", "_try").orderBy("seq")
    size = F.sum(F.octet_length("data")).over(inside.rowsBetween(Window.unboundedPreceding, -1))
    first = F.first(F.struct("last_index", "last_term")).over(inside)
    # after the first done nothing is due but a new start
    over = F.coalesce(F.max(F.col("done").cast("int")).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) == 1
    fits = (F.col("offset") == F.coalesce(size, F.lit(0))) & (F.struct("last_index", "last_term") == first) & ~over
    good = tries.withColumn("_fits", F.min(fits.cast("int")).over(inside)).filter("_fits = 1")
    whole = good.groupBy("stream", "_try").agg(F.max("done").alias("done"), F.max("seq").alias("seq"), F.max("last_index").alias("last_index"), F.max("last_term").alias("last_term"), F.array_sort(F.collect_list(F.struct("seq", "data"))).alias("parts"))
    # concatenation of binaries through their hexadecimal form
    payload = F.unhex(F.array_join(F.transform("parts", lambda p: F.hex(p["data"])), ""))
    return whole.filter("done").select("stream", "seq", "last_index", "last_term", payload.alias("payload"))


def snapshot_attempts(applied: DataFrame, threshold: int = 1024, max_bytes: int = 32 << 20) -> DataFrame:
    """Snapshots of every ``threshold`` applied entries from ``applied(log_index, state_bytes)``: (log_index, skipped).

    A state beyond ``max_bytes`` is skipped, the log stays, and the next try comes after another ``threshold``; so tries come
    at whole multiples either way.
    """
    return applied.filter(F.col("log_index") % threshold == 0).select("log_index", (F.col("state_bytes") > max_bytes).alias("skipped"))


def frozen(samples: DataFrame, by: str, order: str, fields: list[str]) -> DataFrame:
    """Per group whether ``fields`` never differ from the group's first sample."""
    start = samples.groupBy(by).agg(F.min_by(F.struct(*fields), order).alias("_start"))
    same = F.struct(*fields).eqNullSafe(F.col("_start"))
    return samples.join(start, by).groupBy(by).agg(F.bool_and(same).alias("frozen"))


def is_subset(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """One row: whether every key of a is one of b."""
    return a.select(*keys).distinct().join(b.select(*keys).distinct(), keys, "left_anti").agg((F.count(F.lit(1)) == 0).alias("subset"))


def dirty_edges(previous: DataFrame, targets: DataFrame) -> DataFrame:
    """Edges of which a direction was dropped and no longer is: (src, dst)."""
    return previous.join(targets, ["src", "dst", "direction"], "left_anti").select("src", "dst").distinct()


def exact_cover(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """One row: whether ``groups(g, node)`` hold every node of ``nodes`` exactly once and no other."""
    a, b = groups.groupBy("node").agg(F.count(F.lit(1)).alias("n")), nodes.select("node").distinct().withColumn("known", F.lit(True))
    return a.join(b, "node", "full").agg(F.coalesce(F.bool_and(F.coalesce((F.col("n") == 1) & F.col("known"), F.lit(False))), F.lit(True)).alias("exact"))


def manifest(files: DataFrame) -> DataFrame:
    """(path, bytes, sha256) of ``files(path, content binary)`` in order of the path."""
    return files.select("path", F.octet_length("content").cast("long").alias("bytes"), F.sha2("content", 256).alias("sha256")).orderBy("path")


def zipped(batches: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Rows of two arrays by place: keys, pos, ``a``, ``b``; the query fails where lengths differ."""
    checked = F.when(F.size(a) == F.size(b), F.arrays_zip(F.col(a).alias("a"), F.col(b).alias("b"))).otherwise(F.raise_error(F.lit("as many replies as requests are due")).cast("array<struct<a:string,b:string>>"))
    return batches.select(*keys, F.posexplode(checked).alias("pos", "x")).select(*keys, "pos", F.col("x.a").alias(a), F.col("x.b").alias(b))


def live_only(writes: DataFrame, sessions: DataFrame, key: str = "session") -> DataFrame:
    """Writes whose session is still there."""
    return writes.join(sessions.select(key).distinct(), key, "left_semi")


def from_peers(messages: DataFrame, members: DataFrame, own_id: int, sender: str = "sender") -> DataFrame:
    """Messages whose sender is another member."""
    ids = members.filter(F.col("id") != own_id).select(F.col("id").alias(sender)).distinct()
    return messages.join(ids, sender, "left_semi")


def progress_answers(answers: DataFrame, flights: DataFrame) -> DataFrame:
    """Answers (peer, rpc_id, acked_index) of the request that is in flight, each once; late, repeated and unknown ones are dropped.

    ``flights(peer, rpc_id)`` has the last request of each peer; of several answers to it the first (by ``at``) counts.
    """
    known = answers.join(flights, ["peer", "rpc_id"], "left_semi")
    return known.groupBy("peer", "rpc_id").agg(F.min_by("acked_index", "at").alias("acked_index"), F.min("at").alias("at"))


def contact_gaps(contacts: DataFrame, by: str, at: str, gap_ms: int = 300) -> DataFrame:
    """Contacts that came later than ``gap_ms`` after the one before: (by, started, ended), where an election would have begun."""
    before = F.lag(at).over(Window.partitionBy(by).orderBy(at))
    return contacts.select(by, before.alias("started"), F.col(at).alias("ended")).filter(F.col("ended") - F.col("started") > gap_ms)
