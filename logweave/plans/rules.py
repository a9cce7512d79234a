"""Queries of protocol rules, wire streams, transfers and checks over the driver's tables.

Their SQL is written from the protocol's rules, not from the operators.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bytes as b
from ..functions import commands as c
from ..operators import batching, log, quorum, replay, reports, telemetry
from ..sources import wire
from ..streaming import views
from .catalogue import LOG_SQL, ORACLE_SQL, derived_log, info_samples, query

def eid():
    return F.col("event_id")


def uid():
    return F.col("user_id")


def events(spark, d):
    return spark.read.parquet(f"{d}/events.parquet")


def halves(rows, conn, order, data):
    """Chunks of a byte stream: every message is cut in two."""
    half = F.floor(F.octet_length(data) / 2).cast("int")
    both = F.array(F.struct(F.struct(order, F.lit(0)).alias("seq"), F.substring(data, F.lit(1), half).alias("bytes")), F.struct(F.struct(order, F.lit(1)).alias("seq"), F.substring(data, half + 1, F.octet_length(data)).alias("bytes")))
    return rows.select(conn.cast("string").alias("conn"), F.explode(both).alias("x")).select("conn", "x.seq", "x.bytes")


@query("reply_decode", "WITH e AS (SELECT user_id, event_id, event_id % 5 AS m, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n FROM events) SELECT user_id::VARCHAR AS conn, n, '' AS path, ['simple','error','integer','bulk','array'][m + 1] AS kind, CASE m WHEN 0 THEN 'OK' WHEN 1 THEN 'ERR ' || event_id WHEN 3 THEN 'v' || event_id END AS data, CASE m WHEN 2 THEN event_id WHEN 4 THEN 2 END AS number FROM e UNION ALL SELECT user_id::VARCHAR, n, '/0', 'integer', NULL, user_id FROM e WHERE m = 4 UNION ALL SELECT user_id::VARCHAR, n, '/1', 'null', NULL, NULL FROM e WHERE m = 4")
def reply_decode(spark, d):
    i = eid().cast("string")
    wire_text = F.when(eid() % 5 == 0, "+OK\r\n").when(eid() % 5 == 1, F.concat(F.lit("-ERR "), i, F.lit("\r\n"))).when(eid() % 5 == 2, F.concat(F.lit(":"), i, F.lit("\r\n"))).when(eid() % 5 == 3, b.bulk(F.concat(F.lit("v"), i))).otherwise(F.concat(F.lit("*2\r\n:"), uid().cast("string"), F.lit("\r\n$-1\r\n")))
    got = wire.decode_replies(halves(events(spark, d).withColumn("w", wire_text.cast("binary")), uid(), "event_id", "w"))
    return got.filter(F.col("error").isNull() | F.raise_error(F.col("error")).isNotNull()).select("conn", "n", "path", "kind", F.col("data").cast("string").alias("data"), "number")


@query("frame_decode", "SELECT user_id::VARCHAR AS conn, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS n, CAST(event_id % 6 AS INT) AS type, CAST(user_id AS INT) AS sender, props AS payload FROM events")
def frame_decode(spark, d):
    body = F.col("props").cast("binary")
    frame = F.concat(b.to_be(F.octet_length(body) + 5, 4), b.to_be(eid() % 6, 1), b.to_be(uid(), 4), body)
    got = wire.decode_frames(halves(events(spark, d).withColumn("w", frame), uid(), "event_id", "w"))
    return got.select("conn", "n", "type", "sender", F.col("payload").cast("string").alias("payload"))


@query("snapshot_transfer", "SELECT doc_id AS stream, sha256(coalesce(text, '')) AS digest, octet_length(encode(coalesce(text, '')))::BIGINT AS n_bytes FROM documents")
def snapshot_transfer(spark, d):
    """Every text sent in chunks of 1,000 bytes, for every other one after a try that broke off; put together again."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("stream"), F.coalesce("text", F.lit("")).cast("binary").alias("t"))
    sent = docs.select("stream", F.posexplode(log.chunks_of(F.col("t"), 1000)).alias("seq", "x")).select("stream", (F.col("seq") + 1).alias("seq"), F.lit(7).alias("last_index"), F.lit(2).alias("last_term"), "x.offset", "x.data", "x.done")
    broken = docs.filter("stream % 2 = 0").select("stream", F.lit(0).alias("seq"), F.lit(7).alias("last_index"), F.lit(2).alias("last_term"), F.lit(0).cast("long").alias("offset"), F.lit("broken off").cast("binary").alias("data"), F.lit(False).alias("done"))
    whole = log.reassemble(sent.withColumn("offset", F.col("offset").cast("long")).unionByName(broken))
    return whole.select("stream", F.sha2("payload", 256).alias("digest"), F.octet_length("payload").cast("long").alias("n_bytes"))


@query("vote_request_valid", "SELECT event_id, user_id % 5 <> 4 AND user_id % 3 = event_id % 3 AND event_id % 4 > 0 AND event_id % 7 - 1 >= 0 AND event_id % 5 - 1 >= 0 AND event_id % 5 - 1 <= event_id % 4 AS valid FROM events")
def vote_request_valid(spark, d):
    return events(spark, d).select("event_id", c.vote_request_valid(uid() % 3, eid() % 3, eid() % 4, eid() % 7 - 1, eid() % 5 - 1, uid() % 5 != 4).alias("valid"))


APPEND_SQL = "SELECT event_id, user_id % 5 <> 4 AND user_id % 3 = event_id % 3 AND event_id % 4 > 0 AND event_id % 6 <> 0 AND event_id % 7 - 1 >= 0 AND event_id % 3 <= event_id % 4 AND user_id % 11 - 1 >= 0 AND (event_id % 7 - 1 = 0) = (event_id % 3 = 0) AS valid, greatest(event_id % 9, least(user_id % 11, event_id % 13)) AS commit_index FROM events"


@query("append_request_valid", APPEND_SQL)
def append_request_valid(spark, d):
    valid = c.append_request_valid(uid() % 3, eid() % 3, eid() % 4, eid() % 6, eid() % 7 - 1, eid() % 3, uid() % 11 - 1, uid() % 5 != 4)
    return events(spark, d).select("event_id", valid.alias("valid"), c.follower_commit(eid() % 9, uid() % 11, eid() % 13).alias("commit_index"))


@query("entries_valid", LOG_SQL + "SELECT client_id, count(*) AS n, min(log_index) > 0 AND max(log_index) - min(log_index) + 1 = count(*) AS contiguous FROM log GROUP BY client_id, log_index // 3 HAVING client_id IS NOT NULL")
def entries_valid(spark, d):
    entries = derived_log(spark, d).groupBy("client_id", F.floor(F.col("log_index") / 3).alias("p")).agg(F.array_sort(F.collect_list(F.struct("log_index", "term"))).alias("e"))
    ok = c.valid_entries(F.col("e"), F.get("e", F.lit(0))["log_index"] - 1, F.get("e", F.lit(0))["term"], F.get("e", F.size("e") - 1)["term"])
    return entries.select("client_id", F.size("e").cast("long").alias("n"), ok.alias("contiguous"))


@query("prefix_match", LOG_SQL + "SELECT e.event_id, CASE WHEN e.event_id % 50 = 0 THEN TRUE ELSE coalesce(l.term = e.user_id % 30, FALSE) END AS matched FROM events e LEFT JOIN log l ON l.log_index = e.event_id % 50 * 11")
def prefix_match(spark, d):
    asked = events(spark, d).select("event_id", (eid() % 50 * 11).alias("prev_log_index"), F.when(eid() % 50 == 0, 0).otherwise(uid() % 30).cast("long").alias("prev_log_term"))
    return log.matches_prefix(asked, derived_log(spark, d)).select("event_id", "matched")


@query("proposals_expired", "SELECT event_id AS log_index FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) AND 1500 - event_id % 1000 >= 1000")
def proposals_expired(spark, d):
    p = events(spark, d).select(eid().alias("log_index"), (eid() % 1000).alias("proposed_ms"))
    half = p.agg(F.floor(F.max("log_index") / 2)).first()[0]
    return batching.expired(p, F.lit(1500), F.lit(half)).select("log_index")


@query("proposals_oldest_expired", "SELECT count(*) AS n, min(event_id) AS oldest_index FROM events WHERE event_id > (SELECT max(event_id) // 2 FROM events) AND 1500 - event_id % 1000 >= 1000")
def proposals_oldest_expired(spark, d):
    p = events(spark, d).select(eid().alias("log_index"), (eid() % 1000).alias("proposed_ms"))
    half = p.agg(F.floor(F.max("log_index") / 2)).first()[0]
    return batching.oldest_expired(p, F.lit(1500), F.lit(half))


@query("read_timeouts", "SELECT event_id, CASE WHEN event_id % 3 = 0 AND user_id * 17 % 300 >= 150 THEN 'read index timeout' WHEN event_id % 3 = 1 AND event_id % 2001 > 1000 THEN 'read index timeout' WHEN event_id % 3 = 2 AND event_id % 2001 > 1000 THEN 'apply timeout' END AS reason FROM events")
def read_timeouts(spark, d):
    stage = F.element_at(F.array(*map(F.lit, ["round", "unsent", "pending"])), (eid() % 3 + 1).cast("int"))
    age = F.when(eid() % 3 == 0, uid() * 17 % 300).otherwise(eid() % 2001)
    return events(spark, d).select("event_id", c.read_timeout(age, stage).alias("reason"))


@query("frozen_progress", LOG_SQL + "SELECT k, count(DISTINCT op) = 1 AND count(DISTINCT term) = 1 AS frozen FROM log GROUP BY k")
def frozen_progress(spark, d):
    return log.frozen(derived_log(spark, d), "k", "log_index", ["op", "term"])


@query("safe_reads", "SELECT event_id, event_id % 2 = 0 AND user_id % 7 <> 6 AS safe, event_id % 2 = 0 AND user_id % 7 = 1 AS transient FROM events")
def safe_reads(spark, d):
    texts = ["ERR read index timeout", "ERR MOVED 2", "ERR leadership lost", "ERR server stopped", "ERR no leader", "ERR not leader", "ERR unknown command"]
    text = F.element_at(F.array(*map(F.lit, texts)), (uid() % 7 + 1).cast("int"))
    return events(spark, d).select("event_id", c.safe_read(eid() % 2 == 0, text).alias("safe"), c.transient_reply(eid() % 2 == 0, text).alias("transient"))


@query("node_bounds", "SELECT event_id, event_id % 40 <= 32 AND user_id * 11 <= 1024 AS within, event_id % 40 = 1 AND user_id = 0 AS drained, event_id - user_id AS apply_lag, user_id % 2 = 0 AND event_type <> 'error' AS up FROM events")
def node_bounds(spark, d):
    names = sorted({*c.BOUNDS, *c.DRAINED} - {"connected_clients", "queued_writes"})
    rows = events(spark, d).withColumns({"connected_clients": eid() % 40, "queued_writes": uid() * 11, **{n: F.lit(0) for n in names}})
    return rows.select("event_id", c.within_bounds().alias("within"), c.drained().alias("drained"), c.apply_lag(eid(), uid()).alias("apply_lag"), c.is_up(uid() % 2 == 0, F.when(F.col("event_type") == "error", "stopped").otherwise("leader")).alias("up"))


STAGE_SQL = "WITH s AS (SELECT user_id AS node_id, min(event_id) AS c0, max(event_id) AS c1, min(event_id) * 90 AS t0, max(event_id) * 100 AS t1, min(event_id) * 2 AS e0, max(event_id) * 3 AS e1 FROM events GROUP BY user_id) SELECT node_id, 'apply' AS stage, c1 - c0 AS count, CASE WHEN c1 > c0 THEN (t1 - t0)::DOUBLE / (c1 - c0) END AS mean_us, CASE WHEN c1 > c0 THEN (e1 - e0)::DOUBLE / (c1 - c0) END AS mean_entries FROM s UNION ALL SELECT node_id, 'read', 0, NULL, NULL FROM s"


@query("stage_summary", STAGE_SQL)
def stage_summary(spark, d):
    e = events(spark, d).groupBy(uid().alias("node_id")).agg(F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))
    shape = lambda at, us, n: e.select("node_id", F.lit(3).alias("term"), F.lit("leader").alias("state"), F.col(at).alias("apply_count"), (F.col(at) * us).alias("apply_total_us"), (F.col(at) * n).alias("apply_entries"), F.lit(4).alias("read_count"), F.lit(9).alias("read_total_us"))
    return reports.stage_summary(shape("lo", 90, 2), shape("hi", 100, 3), ["apply", "read"])


@query("process_shares", "SELECT event_type AS process, max(value) - min(value) AS cpu_seconds, 100 * (max(value) - min(value)) / 20 AS percent_of_one_core FROM events GROUP BY event_type")
def process_shares(spark, d):
    e = events(spark, d).groupBy(F.col("event_type").alias("process")).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    return reports.process_shares(e.select("process", F.lit(10.0).alias("at"), F.col("lo").alias("cpu_seconds")), e.select("process", F.lit(30.0).alias("at"), F.col("hi").alias("cpu_seconds")))


@query("write_admission", "SELECT event_id, CASE WHEN event_id * 7919 % 2000000 > 1048576 THEN 'ERR command too large' WHEN user_id % 4 = 0 THEN 'ERR MOVED ' || user_id % 3 WHEN event_id % 1300 >= 1024 OR event_id * 31 % 20000000 + event_id * 7919 % 2000000 > 16777216 THEN 'ERR BUSY write queue full' END AS error, event_id % 1300 >= 1000 OR user_id * 100000 >= 4194304 AS queue_full FROM events")
def write_admission(spark, d):
    error = c.write_admission(eid() * 7919 % 2_000_000, uid() % 4 != 0, uid() % 3, eid() % 1300, eid() * 31 % 20_000_000)
    return events(spark, d).select("event_id", error.alias("error"), c.queue_full(eid() % 1300, uid() * 100_000).alias("queue_full"))


@query("proposal_admission", "SELECT event_id, CASE WHEN user_id % 5 = 0 THEN -1 WHEN user_id % 7 = 0 THEN -3 WHEN event_id % 131 = 0 OR event_id % 131 > 128 OR event_id % 131 + event_id % 1100 > 1024 OR event_id * 7919 % 1200000 > 1048576 OR event_id * 7919 % 1200000 * 2 > 2097152 - 128 - event_id % 131 * 64 OR event_id * 7919 % 1200000 * 2 + event_id * 613 % 17000000 > 16777216 THEN -2 ELSE 0 END AS verdict FROM events")
def proposal_admission(spark, d):
    largest = eid() * 7919 % 1_200_000
    return events(spark, d).select("event_id", c.proposal_admission(uid() % 5 != 0, uid() % 7 != 0, eid() % 131, largest * 2, largest, eid() % 1100, eid() * 613 % 17_000_000).alias("verdict"))


@query("scalar_rules", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 4 ELSE 1 END AS key_at, CASE WHEN event_id % 2 = 0 AND user_id % 2 = 0 THEN 'Serve' WHEN event_id % 2 = 1 AND user_id % 2 = 0 AND event_id % 5 <> 0 THEN 'Fail' ELSE 'Redirect' END AS decision, greatest(user_id, 3 + length(CAST(event_id AS VARCHAR))) AS accounted, event_id % 3 <> 0 AS namespace_ok, CASE WHEN event_id % 2 = 0 THEN '+PONG' || chr(13) || chr(10) END AS pong, event_id % 4 = 0 AS invalid_reply, event_id % 4 = 1 AS deliver, CASE WHEN user_id % 3 = event_id % 3 THEN NULL ELSE least(user_id % 3, event_id % 3) || '>' || greatest(user_id % 3, event_id % 3) || CASE WHEN user_id % 3 < event_id % 3 THEN ' request' ELSE ' reply' END END AS relay FROM events")
def scalar_rules(spark, d):
    verb = F.when(eid() % 3 == 0, "IDEMP").otherwise("SET")
    error = F.when(eid() % 5 == 0, "no leader").otherwise("disk")
    relay = c.flow_relay(uid() % 3, eid() % 3)
    name = F.when(eid() % 3 == 0, "with space").when(eid() % 3 == 1, "a_b-C9").otherwise(F.repeat(F.lit("x"), F.lit(63)))
    return events(spark, d).select(
        "event_id", c.key_position(F.array(verb)).alias("key_at"), c.get_decision(eid() % 2 == 0, uid() % 2 == 0, error).alias("decision"), c.accounted_bytes(F.array(F.lit("SET"), eid().cast("string")), uid()).alias("accounted"), c.valid_namespace(name).alias("namespace_ok"),
        c.ping_reply(F.when(eid() % 2 == 0, "PING").otherwise("GET")).alias("pong"), c.replies_to_invalid_frame(eid() % 2 == 1, eid() % 4 == 2, F.lit(True)).alias("invalid_reply"), c.can_deliver(eid() % 2 == 1, eid() % 4 == 3).alias("deliver"), F.concat(relay["src"].cast("string"), F.lit(">"), relay["dst"].cast("string"), F.lit(" "), relay["direction"]).alias("relay"),
    )


@query("message_handlers", "SELECT ['RequestVote','RequestVoteResponse','AppendEntries','AppendEntriesResponse','InstallSnapshot','InstallSnapshotResponse'][event_id % 6 + 1] AS handler, count(*) AS n FROM events WHERE user_id % 8 <> 7 GROUP BY 1")
def message_handlers(spark, d):
    """Messages of members other than node 0... of eight senders the last one is no member."""
    members = wire.valid_peers(wire.peers(spark, ",".join(f"{i}:h{i}:{7000 + i}" for i in range(7)) + ",100:own:7100"), 100)
    sent = events(spark, d).select((uid() % 8).cast("int").alias("sender"), (eid() % 6).alias("kind"))
    return log.from_peers(sent, members, 100).groupBy(c.handler(F.col("kind")).alias("handler")).agg(F.count(F.lit(1)).alias("n"))


@query("work_split", "SELECT user_id AS worker, count(*) // 7 + CASE WHEN user_id < count(*) % 7 THEN 1 ELSE 0 END AS requests, 'soak-' || user_id || '-' || count(*) % 64 AS key FROM events GROUP BY user_id")
def work_split(spark, d):
    e = events(spark, d).groupBy(uid().alias("worker")).agg(F.count(F.lit(1)).alias("n"))
    return e.select("worker", c.work_share(F.col("n"), 7, F.col("worker")).alias("requests"), c.soak_key(F.col("worker"), F.col("n")).alias("key"))


@query("zipped_replies", "SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS pos, 'GET ' || event_id AS request, event_type AS reply FROM events WHERE event_id % 4 = 0")
def zipped_replies(spark, d):
    each = F.array_sort(F.collect_list(F.struct("event_id", "event_type")))
    rows = events(spark, d).filter("event_id % 4 = 0").groupBy("user_id").agg(each.alias("x")).select("user_id", F.transform("x", lambda x: F.concat(F.lit("GET "), x["event_id"].cast("string"))).alias("request"), F.transform("x", lambda x: x["event_type"]).alias("reply"))
    return log.zipped(rows, ["user_id"], "request", "reply").select("user_id", F.col("pos").cast("long").alias("pos"), "request", "reply")


@query("live_writes", "SELECT event_id FROM events e WHERE EXISTS (SELECT 1 FROM events s WHERE s.user_id = e.user_id AND s.event_type = 'signup')")
def live_writes(spark, d):
    e = events(spark, d).withColumnRenamed("user_id", "session")
    return log.live_only(e, e.filter("event_type = 'signup'")).select("event_id")


@query("event_counters", "SELECT user_id, count_if(event_type = 'error') AS errors, count_if(value > 100) AS large FROM events GROUP BY user_id")
def event_counters(spark, d):
    return telemetry.event_counters(events(spark, d), ["user_id"], {"errors": F.col("event_type") == "error", "large": F.col("value") > 100})


@query("key_subset", "SELECT NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey NOT IN (SELECT c_custkey FROM customer)) AS subset")
def key_subset(spark, d):
    o, cu = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("orders", "customer"))
    return log.is_subset(o.select(F.col("o_custkey").alias("k")), cu.select(F.col("c_custkey").alias("k")), ["k"])


@query("dirty_edges", "SELECT DISTINCT src, dst FROM (SELECT DISTINCT user_id % 9 AS src, event_id % 9 AS dst, event_type AS direction FROM events WHERE value > 50 EXCEPT SELECT DISTINCT user_id % 9, event_id % 9, event_type FROM events WHERE value < 40)")
def dirty_edges(spark, d):
    e = events(spark, d).select((uid() % 9).alias("src"), (eid() % 9).alias("dst"), F.col("event_type").alias("direction"), "value")
    return log.dirty_edges(e.filter("value > 50").select("src", "dst", "direction").distinct(), e.filter("value < 40").select("src", "dst", "direction").distinct())


@query("exact_cover", "SELECT (SELECT count(*) FROM nation) = (SELECT count(DISTINCT n_nationkey) FROM nation) AND NOT EXISTS (SELECT n_nationkey FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region)) AS exact")
def exact_cover(spark, d):
    n, r = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("nation", "region"))
    groups = n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_regionkey").alias("g"), F.col("n_nationkey").alias("node"))
    return log.exact_cover(groups, n.select(F.col("n_nationkey").alias("node")))


@query("manifest", "SELECT 'doc/' || doc_id AS path, octet_length(encode(coalesce(text, '')))::BIGINT AS bytes, sha256(coalesce(text, '')) AS sha256 FROM documents")
def manifest(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet")
    return log.manifest(docs.select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("content")))


@query("read_pages", "SELECT event_id, (row_number() OVER (ORDER BY event_id) - 1) // 64 AS page FROM events WHERE event_type <> 'error'")
def read_pages(spark, d):
    return batching.pages(events(spark, d).filter("event_type <> 'error'").select("event_id"), "event_id", 64, block=4096)


@query("turns", LOG_SQL + "SELECT client_id, log_index, (row_number() OVER (PARTITION BY client_id ORDER BY log_index) - 1) // 128 AS turn FROM log")
def turns(spark, d):
    return batching.per_turn(derived_log(spark, d), "client_id", "log_index").select("client_id", "log_index", "turn")


@query("contact_gaps", "SELECT user_id, started, ended FROM (SELECT user_id, event_id * 37 AS ended, lag(event_id * 37) OVER (PARTITION BY user_id ORDER BY event_id) AS started FROM events) WHERE ended - started > 300")
def contact_gaps(spark, d):
    return log.contact_gaps(events(spark, d).select("user_id", (eid() * 37).alias("at")), "user_id", "at")


@query("progress_answers", "SELECT peer, rpc_id, arg_min(acked, at_) AS acked_index, min(at_) AS \"at\" FROM (SELECT user_id % 5 AS peer, event_id // 40 AS rpc_id, event_id % 97 AS acked, event_id AS at_ FROM events) a JOIN (SELECT user_id % 5 AS peer, max(event_id // 40) AS rpc_id FROM events WHERE event_type = 'view' GROUP BY 1) f USING (peer, rpc_id) GROUP BY peer, rpc_id")
def progress_answers(spark, d):
    e = events(spark, d).select((uid() % 5).alias("peer"), F.floor(eid() / 40).cast("long").alias("rpc_id"), (eid() % 97).alias("acked_index"), eid().alias("at"), "event_type")
    flights = e.filter("event_type = 'view'").groupBy("peer").agg(F.max("rpc_id").alias("rpc_id"))
    return log.progress_answers(e.drop("event_type"), flights)


@query("snapshot_attempts", LOG_SQL + "SELECT log_index, log_index * 65536 > 33554432 AS skipped FROM log WHERE log_index % 100 = 0")
def snapshot_attempts(spark, d):
    return log.snapshot_attempts(derived_log(spark, d).select("log_index", (F.col("log_index") * 65536).alias("state_bytes")), 100)


@query("applied_callbacks", LOG_SQL + "SELECT l.log_index, r.reply, 'w' || l.log_index AS callback FROM log l JOIN (SELECT log_index, CASE WHEN op <> 'DEL' THEN '+OK' WHEN before = 'SET' THEN ':1' ELSE ':0' END AS reply FROM (SELECT log_index, op, CASE WHEN op = 'NOOP' THEN NULL ELSE lag(op) OVER (PARTITION BY k, op = 'NOOP' ORDER BY log_index) END AS before FROM log)) r USING (log_index) WHERE l.log_index % 3 = 0")
def applied_callbacks(spark, d):
    lg = derived_log(spark, d)
    waiting = lg.filter("log_index % 3 = 0").select("log_index", F.concat(F.lit("w"), F.col("log_index").cast("string")).alias("callback"))
    return replay.resolve(replay.replies(lg).select("log_index", "reply"), waiting)


@query("commit_of_term", LOG_SQL + ", c AS (SELECT user_id % 7 AS group_id, max(event_id) AS commit_index FROM events GROUP BY 1) SELECT group_id, commit_index, term FROM c JOIN log ON log_index = commit_index WHERE commit_index > 10 AND term = (SELECT max(term) FROM log)")
def commit_of_term(spark, d):
    found = events(spark, d).groupBy((uid() % 7).alias("group_id")).agg(F.max("event_id").alias("commit_index"))
    lg = derived_log(spark, d)
    return quorum.advance_commit(found, lg, F.lit(10), F.lit(lg.agg(F.max("term")).first()[0])).select("group_id", "commit_index", "term")


@query("convergence", "SELECT user_id % 10 AS group_id, min(event_id) = max(event_id) AND min(event_id) >= 5 AS converged FROM events WHERE event_id > 20 GROUP BY 1")
def convergence(spark, d):
    s = events(spark, d).filter("event_id > 20").select((uid() % 10).alias("group_id"), eid().alias("commit_index"), eid().alias("last_applied"))
    return quorum.convergence(s, 5)


@query("assigned_indexes", "SELECT n_nationkey, 40 + row_number() OVER (ORDER BY n_name) AS log_index FROM nation")
def assigned_indexes(spark, d):
    return log.assign_indexes(spark.read.parquet(f"{d}/nation.parquet").select("n_nationkey", "n_name"), 40, "n_name").select("n_nationkey", "log_index")


@query("running_bytes", "SELECT user_id, event_id, CAST(sum(CASE WHEN event_type = 'view' THEN -1 ELSE 1 END * (event_id % 100)) OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS held FROM events")
def running_bytes(spark, d):
    rows = events(spark, d).select("user_id", "event_id", (F.when(F.col("event_type") == "view", -1).otherwise(1) * (eid() % 100)).alias("delta"))
    return telemetry.running_bytes(rows, "user_id", "event_id").select("user_id", "event_id", "held")


@query("crossing_edges", "SELECT DISTINCT a.n_nationkey AS src, b.n_nationkey AS dst, a.n_regionkey <> b.n_regionkey AS crossing FROM nation a JOIN nation b ON b.n_nationkey = (a.n_nationkey * 7 + 1) % 25")
def crossing_edges(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    edges = n.select(F.col("n_nationkey").alias("src"), ((F.col("n_nationkey") * 7 + 1) % 25).alias("dst"))
    return reports.crossing_edges(edges, n.select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("g")))


@query("alternating_plan", "SELECT r_regionkey AS pipeline, r AS repeat, s AS slot, (r % 2 = 0) = (s = 1) AS async_apply FROM region, range(3) x(r), range(2) y(s)")
def alternating_plan(spark, d):
    return reports.alternating_plan(spark.read.parquet(f"{d}/region.parquet").select(F.col("r_regionkey").alias("pipeline")), 3)


@query("refusals", "SELECT CAST(sum(user_id) AS BIGINT) AS refused, sum(user_id) <= 1000000 AS within FROM events")
def refusals(spark, d):
    return reports.refusals(events(spark, d).select(uid().alias("refused")), 1_000_000)


@query("change_pct", "SELECT event_id, CASE WHEN user_id <> 0 THEN 100 * (value / user_id - 1) END AS pct FROM events")
def change_pct(spark, d):
    return events(spark, d).select("event_id", reports.change_pct(uid(), F.col("value")).alias("pct"))


@query("vmstat", "SELECT count(*) AS samples, round(avg(CAST(event_id % 100 AS INT)), 2) AS mean_idle, count_if(event_id % 100 < 10) AS busy, count_if(user_id % 4 > 0) AS swapping FROM events")
def vmstat(spark, d):
    fields = [uid() % 4 if i == 6 else eid() % 100 if i == 14 else F.lit(0) for i in range(17)]
    lines = events(spark, d).select(F.concat_ws("  ", *[x.cast("string") for x in fields]).alias("value"))
    return reports.vmstat_summary(lines.unionByName(spark.createDataFrame([("procs ---memory---",)], "value string")))


@query("process_status", "SELECT event_id, event_id * 1024 AS rss_bytes, CAST(user_id AS INT) AS threads FROM events")
def process_status(spark, d):
    text = F.concat(F.lit("Name:\tx\nVmRSS:\t   "), eid().cast("string"), F.lit(" kB\nThreads:\t"), uid().cast("string"), F.lit("\n"))
    return events(spark, d).select("event_id", reports.process_status(text).alias("x")).select("event_id", "x.rss_bytes", "x.threads")


@query("health_answers", "SELECT event_id, CASE WHEN user_id % 2 = 0 THEN 'HTTP/1.1 200 OK' ELSE 'HTTP/1.1 503 Service Unavailable' END AS status, user_id % 2 = 0 AS up, event_id % 3 AS leader_id, user_id AS term FROM events")
def health_answers(spark, d):
    up = uid() % 2 == 0
    body = telemetry.health_text(F.lit("1"), F.lit("leader"), uid().cast("string"), (eid() % 3).cast("string"), up, up)
    kind = telemetry.scrape_request(F.lit("GET /health HTTP/1.1\r\n\r\n"))
    answer = telemetry.scrape_response(kind, F.lit(""), body, up)
    fields = telemetry.health_fields(F.substring_index(answer, "\r\n\r\n", -1))
    return events(spark, d).select("event_id", F.substring_index(answer, "\r\n", 1).alias("status"), fields["up"].alias("up"), fields["leader_id"].alias("leader_id"), fields["term"].alias("term"))


@query("role_one_hot", "SELECT user_id AS node, string_agg('node_role{role=\"' || r || '\"} ' || CASE WHEN r = CASE WHEN user_id % 2 = 0 THEN 'leader' ELSE 'follower' END THEN '1' ELSE '0' END || chr(10), '' ORDER BY i) AS text FROM (SELECT DISTINCT user_id FROM events), (VALUES (1,'leader'),(2,'follower'),(3,'candidate'),(4,'pre-candidate'),(5,'stopped')) t(i, r) GROUP BY user_id")
def role_one_hot(spark, d):
    rows = events(spark, d).select(uid().alias("node")).distinct()
    text = telemetry.info_text({"state": F.when(F.col("node") % 2 == 0, "leader").otherwise("follower")})
    lines = telemetry.prometheus(telemetry.info_lines(rows.select("node", text.alias("info")), "info", ["node"]), ["node"], "node_")
    return lines.select("node", F.regexp_replace("text", "(?m)^#.*\n", "").alias("text"))


def _as_stream(spark, d, name):
    """The derived log as a stream of one micro-batch, in a table of its own below the shared folder."""
    import tempfile
    import uuid

    base = spark.conf.get("spark.checkpoint.dir", None) or "file://" + tempfile.mkdtemp(prefix="logweave-")
    path = f"{base.rstrip('/')}/streams/{name}-{uuid.uuid4().hex}"
    lg = derived_log(spark, d).select("log_index", "client_id", "request_id", "op", "k", "v")
    # micro-batches come in log order: all files are one here, and inside a batch order does not matter
    lg.write.parquet(f"{path}/log")
    return spark.readStream.schema(lg.schema).parquet(f"{path}/log"), path


@query("stream_kv_state", ORACLE_SQL["kv_state"])
def stream_kv_state(spark, d):
    stream, path = _as_stream(spark, d, "kv")
    view = views.VersionedView(spark, f"{path}/view")
    views.stream_kv_view(stream, view, f"{path}/checkpoint").awaitTermination()
    return view.latest()


@query("stream_idemp", ORACLE_SQL["kv_idemp_status"])
def stream_idemp(spark, d):
    key, before = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    try:
        stream, path = _as_stream(spark, d, "idemp")
        out = views.stream_idemp(stream).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
        out.awaitTermination()
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)
    return spark.read.parquet(f"{path}/out")
