"""Queries over the driver's tables, each with the SQL that must give the same rows.

``events`` stands in for live traffic: the derived command log below turns every event into one command.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import bytes as b
from ..functions import commands as c
from ..operators import batching, log, quorum, replay, reports, telemetry
from ..sources import wire

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

LOG_SQL = """
WITH log AS (
  SELECT event_id + 1 AS log_index, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) + 1 AS term, 'c' || user_id AS client_id, user_id, ts, value,
    'ns' || (user_id % 4) || ':' || json_extract_string(props, '$.k') AS k,
    CASE WHEN event_type = 'error' THEN 'DEL' WHEN event_type = 'view' THEN 'NOOP' ELSE 'SET' END AS op,
    CAST(round(value * 100) AS BIGINT) AS v,
    1 + (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) // 3 + CAST(json_extract_string(props, '$.k') AS INT) % 2 AS request_id
  FROM events),
state AS (
  SELECT k, arg_max(v, log_index) AS v, arg_max(op, log_index) AS op, max(log_index) AS last_index FROM log WHERE op <> 'NOOP' GROUP BY k),
idemp AS (
  SELECT *, CASE WHEN request_id > top THEN 'applied' WHEN request_id = top THEN 'replay' ELSE 'stale' END AS status FROM (
    SELECT *, coalesce(max(request_id) OVER (PARTITION BY client_id ORDER BY log_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM log)),
eff AS (SELECT * REPLACE (CASE WHEN status = 'applied' THEN op ELSE 'NOOP' END AS op) FROM idemp)
"""


def derived_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The command log: log_index, term, client_id, k, op, v, ts, request_id (and user_id, value)."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    key = F.get_json_object("props", "$.k")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    return e.select(
        (F.col("event_id") + 1).alias("log_index"),
        (F.datediff("ts", F.lit("2024-01-01").cast("date")) + 1).cast("long").alias("term"),
        F.concat(F.lit("c"), "user_id").alias("client_id"),
        F.concat(F.lit("ns"), (F.col("user_id") % 4).cast("string"), F.lit(":"), key).alias("k"),
        F.when(F.col("event_type") == "error", "DEL").when(F.col("event_type") == "view", "NOOP").otherwise("SET").alias("op"),
        F.round(F.col("value") * 100).cast("long").alias("v"),
        "ts", "user_id", "value",
        (1 + F.floor(place / 3) + key.cast("int") % 2).cast("long").alias("request_id"),
    )


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return add


@query("kv_state", LOG_SQL + "SELECT k, v, last_index FROM state WHERE op = 'SET'")
def kv_state(spark, d):
    return replay.kv_state(derived_log(spark, d))


@query("kv_state_asof", LOG_SQL + ", s AS (SELECT k, arg_max(v, log_index) AS v, arg_max(op, log_index) AS op, max(log_index) AS last_index FROM log WHERE op <> 'NOOP' AND log_index <= (SELECT max(log_index) // 2 FROM log) GROUP BY k) SELECT k, v, last_index FROM s WHERE op = 'SET'")
def kv_state_asof(spark, d):
    lg = derived_log(spark, d)
    return replay.state_asof(lg, replay.last_applied(lg).first()[0] // 2)


@query("kv_last_applied", LOG_SQL + "SELECT max(log_index) AS last_applied FROM log")
def kv_last_applied(spark, d):
    return replay.last_applied(derived_log(spark, d))


@query("kv_mget", LOG_SQL + ", keys AS (SELECT DISTINCT 'ns' || (n_nationkey % 5) || ':' || n_nationkey AS k FROM nation) SELECT keys.k, s.v FROM keys LEFT JOIN (SELECT k, v FROM state WHERE op = 'SET') s USING (k)")
def kv_mget(spark, d):
    n = spark.read.parquet(f"{d}/nation.parquet")
    keys = n.select(F.concat(F.lit("ns"), (F.col("n_nationkey") % 5).cast("string"), F.lit(":"), F.col("n_nationkey").cast("string")).alias("k")).distinct()
    return replay.multi_get(keys, replay.kv_state(derived_log(spark, d)))


@query("kv_get_reply", LOG_SQL + ", keys AS (SELECT DISTINCT k FROM log) SELECT keys.k, CASE WHEN s.v IS NULL THEN '$-1' || chr(13) || chr(10) ELSE '$' || length(CAST(s.v AS VARCHAR)) || chr(13) || chr(10) || s.v || chr(13) || chr(10) END AS reply FROM keys LEFT JOIN (SELECT k, v FROM state WHERE op = 'SET') s USING (k)")
def kv_get_reply(spark, d):
    lg = derived_log(spark, d)
    return replay.multi_get(lg.select("k").distinct(), replay.kv_state(lg)).select("k", b.bulk(F.col("v").cast("string")).alias("reply"))


@query("kv_replies", LOG_SQL + "SELECT log_index, op, k, CASE WHEN op <> 'DEL' THEN '+OK' WHEN existed = 'SET' THEN ':1' ELSE ':0' END AS reply FROM (SELECT log_index, op, k, CASE WHEN op = 'NOOP' THEN NULL ELSE lag(op) OVER (PARTITION BY k, op = 'NOOP' ORDER BY log_index) END AS existed FROM log)")
def kv_replies(spark, d):
    return replay.replies(derived_log(spark, d))


@query("kv_del_existed", LOG_SQL + "SELECT log_index, k, coalesce(before = 'SET', FALSE) AS existed FROM (SELECT *, lag(op) OVER (PARTITION BY k ORDER BY log_index) AS before FROM log WHERE op <> 'NOOP') WHERE op = 'DEL'")
def kv_del_existed(spark, d):
    return replay.replies(derived_log(spark, d)).filter("op = 'DEL'").select("log_index", "k", (F.col("reply") == ":1").alias("existed"))


@query("kv_idemp_status", LOG_SQL + "SELECT log_index, client_id, request_id, status FROM idemp")
def kv_idemp_status(spark, d):
    return replay.idemp_status(derived_log(spark, d)).select("log_index", "client_id", "request_id", "status")


@query("kv_idemp_state", LOG_SQL + ", s AS (SELECT k, arg_max(v, log_index) AS v, arg_max(op, log_index) AS op, max(log_index) AS last_index FROM eff WHERE op <> 'NOOP' GROUP BY k) SELECT k, v, last_index FROM s WHERE op = 'SET'")
def kv_idemp_state(spark, d):
    return replay.kv_state(replay.effective(derived_log(spark, d)))


IDEMP_REPLY_SQL = LOG_SQL + """, r AS (
  SELECT *, CASE WHEN op <> 'DEL' THEN '+OK' WHEN before = 'SET' THEN ':1' ELSE ':0' END AS own FROM (
    SELECT *, CASE WHEN op = 'NOOP' THEN NULL ELSE lag(op) OVER (PARTITION BY k, op = 'NOOP' ORDER BY log_index) END AS before FROM eff)),
q AS (SELECT *, first_value(CASE WHEN status = 'applied' THEN own END IGNORE NULLS) OVER (PARTITION BY client_id, request_id ORDER BY log_index) AS first_reply FROM r)
"""


@query("kv_idemp_reply", IDEMP_REPLY_SQL + "SELECT log_index, client_id, request_id, status, CASE WHEN status = 'stale' THEN '-ERR stale request id' ELSE first_reply END AS reply FROM q")
def kv_idemp_reply(spark, d):
    return replay.idemp_replies(derived_log(spark, d))


@query("kv_sessions", IDEMP_REPLY_SQL + "SELECT client_id, max(request_id) AS request_id, arg_max(first_reply, request_id) AS reply FROM q WHERE status = 'applied' GROUP BY client_id")
def kv_sessions(spark, d):
    return replay.sessions(derived_log(spark, d))


@query("kv_namespace_counts", LOG_SQL + "SELECT split_part(k, ':', 1) AS namespace, count(*) AS keys, CAST(sum(v) AS BIGINT) AS total FROM state WHERE op = 'SET' GROUP BY 1")
def kv_namespace_counts(spark, d):
    ns, _ = c.split_key(F.col("k"))
    return replay.kv_state(derived_log(spark, d)).groupBy(ns.alias("namespace")).agg(F.count(F.lit(1)).alias("keys"), F.sum("v").alias("total"))


@query("kv_session_namespace", LOG_SQL + "SELECT client_id AS conn, log_index AS seq, coalesce(last_value(CASE WHEN op = 'NOOP' THEN split_part(k, ':', 1) || '-' || split_part(k, ':', 2) END IGNORE NULLS) OVER (PARTITION BY client_id ORDER BY log_index ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'default') AS namespace FROM log")
def kv_session_namespace(spark, d):
    lg = derived_log(spark, d).select(F.col("client_id").alias("conn"), F.col("log_index").alias("seq"), F.when(F.col("op") == "NOOP", "SELECT").otherwise("SET").alias("verb"), F.replace("k", F.lit(":"), F.lit("-")).alias("a1"))
    return replay.session_namespace(lg).select("conn", "seq", "namespace")


@query("kv_read_barrier", LOG_SQL + "SELECT u.i AS read_id, u.i * 7 AS read_index, (SELECT min(log_index * 10) FROM log WHERE log_index >= u.i * 7) AS ready_at FROM (SELECT DISTINCT user_id AS i FROM events) u WHERE u.i * 7 > 0")
def kv_read_barrier(spark, d):
    lg = derived_log(spark, d)
    progress = lg.select(F.col("log_index").alias("last_applied"), (F.col("log_index") * 10).alias("applied_at"))
    reads = lg.select(F.col("user_id").alias("read_id"), (F.col("user_id") * 7).alias("read_index")).distinct().filter("read_index > 0")
    return replay.read_barrier(reads, progress)


@query("kv_snapshot_plus_suffix", ORACLE_SQL["kv_state"])
def kv_snapshot_plus_suffix(spark, d):
    snapshot, suffix = log.compact_prefix(derived_log(spark, d), 400)
    return log.snapshot_plus_suffix(snapshot, suffix)


@query("log_gap_check", LOG_SQL + "SELECT log_index, term, problem FROM (SELECT log_index, term, CASE WHEN log_index <> pi + 1 THEN 'gap' WHEN term < pt THEN 'term' END AS problem FROM (SELECT log_index, term, lag(log_index) OVER (ORDER BY log_index) AS pi, lag(term) OVER (ORDER BY log_index) AS pt FROM log WHERE log_index % 10 <> 3)) WHERE problem IS NOT NULL")
def log_gap_check(spark, d):
    return log.gaps(derived_log(spark, d).filter("log_index % 10 <> 3"), block=256)


@query("log_conflict_index", LOG_SQL + "SELECT term, min(log_index) AS first_index, max(log_index) AS last_index FROM log GROUP BY term")
def log_conflict_index(spark, d):
    return log.conflict_index(derived_log(spark, d))


@query("log_term_at", LOG_SQL + "SELECT term FROM log WHERE log_index = 77")
def log_term_at(spark, d):
    return log.term_at(derived_log(spark, d), 77)


@query("log_truncate_tail", LOG_SQL + "SELECT max(log_index) AS last_index, count(*) AS n FROM log WHERE log_index < (SELECT max(log_index) * 3 // 5 FROM log)")
def log_truncate_tail(spark, d):
    lg = derived_log(spark, d)
    return log.truncate_suffix(lg, replay.last_applied(lg).first()[0] * 3 // 5).agg(F.max("log_index").alias("last_index"), F.count(F.lit(1)).alias("n"))


@query("log_merge_entries", LOG_SQL + ", inc AS (SELECT log_index, CASE WHEN log_index >= 700 THEN term + 1000 ELSE term END AS term FROM log WHERE log_index BETWEEN 650 AND 720) SELECT log_index, term FROM log WHERE log_index < 700 UNION ALL SELECT log_index, term FROM inc WHERE log_index >= 700")
def log_merge_entries(spark, d):
    lg = derived_log(spark, d).select("log_index", "term")
    incoming = lg.filter("log_index between 650 and 720").withColumn("term", F.when(F.col("log_index") >= 700, F.col("term") + 1000).otherwise(F.col("term")))
    return log.merge_entries(lg, incoming)


@query("log_install_snapshot", LOG_SQL + "SELECT log_index, term FROM log WHERE log_index > 300 AND EXISTS (SELECT 1 FROM log WHERE log_index = 300 AND term = 1)")
def log_install_snapshot(spark, d):
    return log.install_snapshot(derived_log(spark, d).select("log_index", "term"), 300, 1)


@query("log_replication_range", "SELECT doc_id AS log_index, CAST(octet_length(encode(text)) AS INT) AS n_bytes FROM (SELECT *, sum(octet_length(encode(text))) OVER (ORDER BY doc_id) AS run FROM documents WHERE doc_id BETWEEN 10 AND 137) WHERE run <= 100000 OR doc_id = 10")
def log_replication_range(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select(F.col("doc_id").alias("log_index"), F.octet_length("text").alias("n_bytes"))
    return log.replication_range(docs, 10, max_bytes=100_000)


@query("log_term_changes", LOG_SQL + "SELECT client_id, log_index, term, previous FROM (SELECT client_id, log_index, term, lag(term) OVER (PARTITION BY client_id ORDER BY log_index) AS previous FROM log) WHERE previous <> term")
def log_term_changes(spark, d):
    return log.change_points(derived_log(spark, d), "log_index", "term", ["client_id"]).select("client_id", "log_index", "term", "previous")


@query("log_time_order", LOG_SQL + "SELECT client_id, bool_and(ok) AS increasing FROM (SELECT client_id, coalesce(ts > lag(ts) OVER (PARTITION BY client_id ORDER BY log_index), TRUE) AS ok FROM log) GROUP BY client_id")
def log_time_order(spark, d):
    return log.strictly_increasing(derived_log(spark, d), "client_id", "ts", "log_index")


@query("set_inventory_diff", "SELECT a.p_partkey, a.h AS left_digest, b.h AS right_digest FROM (SELECT p_partkey, sha256(p_name) AS h FROM part WHERE p_partkey % 7 <> 0) a FULL JOIN (SELECT p_partkey, sha256(CASE WHEN p_partkey % 11 = 0 THEN p_name || 'x' ELSE p_name END) AS h FROM part WHERE p_partkey % 5 <> 0) b ON a.p_partkey = b.p_partkey WHERE a.h IS DISTINCT FROM b.h AND a.p_partkey IS NOT NULL UNION ALL SELECT p_partkey, NULL, sha256(CASE WHEN p_partkey % 11 = 0 THEN p_name || 'x' ELSE p_name END) FROM part WHERE p_partkey % 7 = 0 AND p_partkey % 5 <> 0")
def set_inventory_diff(spark, d):
    p = spark.read.parquet(f"{d}/part.parquet")
    name = F.when(F.col("p_partkey") % 11 == 0, F.concat("p_name", F.lit("x"))).otherwise(F.col("p_name"))
    left = p.filter("p_partkey % 7 <> 0").select("p_partkey", F.sha2("p_name", 256).alias("h"))
    right = p.filter("p_partkey % 5 <> 0").select("p_partkey", F.sha2(name, 256).alias("h"))
    return log.same_inventory(left, right, "p_partkey", "h")


@query("set_duplicates", "SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def set_duplicates(spark, d):
    return log.duplicated(spark.read.parquet(f"{d}/lineitem.parquet"), ["l_orderkey", "l_suppkey"])


PROGRESS_SQL = "WITH p AS (SELECT user_id % 7 AS group_id, user_id AS peer, max(event_id) AS match_index FROM events GROUP BY ALL) "


def progress(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy((F.col("user_id") % 7).alias("group_id"), F.col("user_id").alias("peer")).agg(F.max("event_id").alias("match_index"))


@query("quorum_commit_index", PROGRESS_SQL + "SELECT group_id, list_sort(list(match_index), 'DESC')[count(*) // 2 + 1] AS commit_index, CAST(count(*) AS INT) AS n FROM p GROUP BY group_id")
def quorum_commit_index(spark, d):
    return quorum.commit_index(progress(spark, d))


VOTES_SQL = "SELECT user_id % 50 AS election, event_type = 'view' AS prevote, user_id % 9 AS voter, value > 30 AS granted FROM events"


@query("quorum_vote_tally", f"SELECT election, prevote, count(DISTINCT CASE WHEN granted THEN voter END) AS grants, count(DISTINCT CASE WHEN granted THEN voter END) >= 5 AS won FROM ({VOTES_SQL}) GROUP BY election, prevote")
def quorum_vote_tally(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    votes = e.select((F.col("user_id") % 50).alias("election"), (F.col("event_type") == "view").alias("prevote"), (F.col("user_id") % 9).alias("voter"), (F.col("value") > 30).alias("granted"))
    return quorum.tally(votes, 9)


# the leader's own contact counts; a third of the members of every other group never answered
GROUPS_SQL = PROGRESS_SQL + ", g AS (SELECT group_id, min(peer) AS leader, count(*) + group_id % 2 * 5 AS members, 600 + group_id * 50 AS since FROM p GROUP BY group_id), f AS (SELECT g.group_id, members, since, 1 + count_if(p.peer <> g.leader AND 900 - p.match_index % 1000 < 150)::BIGINT AS fresh FROM g JOIN p USING (group_id) GROUP BY ALL) "


def leaderships(p):
    return p.groupBy("group_id").agg(F.min("peer").alias("leader"), (F.count(F.lit(1)) + F.col("group_id") % 2 * 5).alias("members"), (600 + F.col("group_id") * 50).alias("leader_since_ms"))


@query("quorum_freshness", GROUPS_SQL + "SELECT group_id, members, fresh, members // 2 + 1 <= 1 OR 900 - since < 150 OR fresh >= members // 2 + 1 AS stays FROM f")
def quorum_freshness(spark, d):
    p = progress(spark, d)
    return quorum.check_quorum(leaderships(p), p.withColumn("last_contact_ms", F.col("match_index") % 1000), F.lit(900))


@query("quorum_lease", GROUPS_SQL + "SELECT group_id, members, fresh, 900 - since >= 300 AND (members // 2 + 1 <= 1 OR fresh >= members // 2 + 1) AS lease FROM f")
def quorum_lease(spark, d):
    p = progress(spark, d)
    return quorum.lease_valid(leaderships(p), p.withColumn("sent_ms", F.col("match_index") % 1000), F.lit(900))


@query("quorum_match_acks", "SELECT a.peer, a.rpc_id, a.acked_ms, f.sent_ms FROM (SELECT user_id % 5 AS peer, event_id // 5 AS rpc_id, event_id * 2 + user_id AS acked_ms FROM events WHERE event_type <> 'error') a JOIN (SELECT user_id % 5 AS peer, event_id // 5 AS rpc_id, event_id * 2 AS sent_ms FROM events WHERE event_type = 'view') f USING (peer, rpc_id) WHERE a.acked_ms - f.sent_ms < 150")
def quorum_match_acks(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", (F.col("user_id") % 5).alias("peer"), F.floor(F.col("event_id") / 5).cast("long").alias("rpc_id"), (F.col("event_id") * 2).alias("sent_ms"), (F.col("event_id") * 2 + F.col("user_id")).alias("acked_ms"))
    return quorum.match_acks(e.filter("event_type <> 'error'").select("peer", "rpc_id", "acked_ms"), e.filter("event_type = 'view'").select("peer", "rpc_id", "sent_ms")).select("peer", "rpc_id", "acked_ms", "sent_ms")


@query("quorum_vote_rule", "SELECT event_id, CASE WHEN pre AND st = 'LEADER' THEN FALSE WHEN st = 'FOLLOWER' AND lead <> -1 AND lead <> cand AND heard THEN FALSE WHEN pre THEN term > cur AND ok ELSE term >= cur AND (term > cur OR voted = -1 OR voted = cand) AND ok END AS granted FROM (SELECT event_id, event_type = 'view' AS pre, CASE WHEN user_id % 3 = 0 THEN 'LEADER' ELSE 'FOLLOWER' END AS st, event_id % 4 - 1 AS lead, user_id % 3 AS cand, event_id % 5 = 0 AS heard, event_id % 6 AS term, event_id % 7 AS cur, event_id % 3 - 1 AS voted, (event_id % 11, user_id % 13) >= (event_id % 2 * 5, user_id % 8) AS ok FROM events)")
def quorum_vote_rule(spark, d):
    e, i, u = spark.read.parquet(f"{d}/events.parquet"), F.col("event_id"), F.col("user_id")
    req = F.struct((F.col("event_type") == "view").alias("prevote"), (u % 3).alias("candidate"), (i % 6).alias("term"), (i % 11).alias("last_log_term"), (u % 13).alias("last_log_index"))
    own = F.struct(F.when(u % 3 == 0, "LEADER").otherwise("FOLLOWER").alias("state"), (i % 4 - 1).alias("leader_id"), (i % 5 == 0).alias("heard_recently"), (i % 7).alias("current_term"), (i % 3 - 1).alias("voted_for"), (i % 2 * 5).alias("last_term"), (u % 8).alias("last_index"))
    return e.select("event_id", req.alias("req"), own.alias("own")).select("event_id", quorum.grant_vote().alias("granted"))


@query("quorum_follow_up", "SELECT event_id, CASE WHEN ok THEN greatest(m, a) ELSE m END AS match_index, CASE WHEN ok THEN greatest(m, a) + 1 ELSE greatest(m + 1, least(n - 1, h + 1)) END AS next_index FROM (SELECT event_id, event_type <> 'error' AS ok, event_id % 10 AS m, user_id % 20 AS a, event_id % 10 + 8 AS n, user_id % 15 AS h FROM events)")
def quorum_follow_up(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    x = quorum.follow_up(i % 10, i % 10 + 8, F.col("event_type") != "error", u % 20, u % 15)
    return spark.read.parquet(f"{d}/events.parquet").select("event_id", x.alias("x")).select("event_id", "x.match_index", "x.next_index")


@query("replica_agreement", LOG_SQL + ", r AS (SELECT log_index % 3 AS replica, k, arg_max(v, log_index) AS v FROM log GROUP BY ALL) SELECT k, count(DISTINCT v) AS values, count(DISTINCT replica) AS replicas FROM r GROUP BY k HAVING count(DISTINCT v) <> 1 OR count(DISTINCT replica) <> 3")
def replica_agreement(spark, d):
    states = derived_log(spark, d).groupBy((F.col("log_index") % 3).alias("replica"), "k").agg(F.max_by("v", "log_index").alias("v"))
    return quorum.replica_agreement(states, 3)


@query("batch_by_count", LOG_SQL + "SELECT client_id, log_index, (row_number() OVER (PARTITION BY client_id ORDER BY log_index) - 1) // 4 AS batch FROM log")
def batch_by_count(spark, d):
    return batching.by_count(derived_log(spark, d), "client_id", "log_index", 4).select("client_id", "log_index", "batch")


@query("batch_by_bytes", "WITH RECURSIVE a AS (SELECT doc_id, source, CAST(octet_length(encode(text)) AS BIGINT) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents), g AS (SELECT source, doc_id, n AS n_bytes, r, CAST(0 AS BIGINT) AS batch, 1 AS entries, n AS size FROM a WHERE r = 1 UNION ALL SELECT a.source, a.doc_id, a.n, a.r, CASE WHEN g.entries >= 16 OR g.size + a.n > 20000 THEN g.batch + 1 ELSE g.batch END, CASE WHEN g.entries >= 16 OR g.size + a.n > 20000 THEN 1 ELSE g.entries + 1 END, CASE WHEN g.entries >= 16 OR g.size + a.n > 20000 THEN a.n ELSE g.size + a.n END FROM g JOIN a ON a.source = g.source AND a.r = g.r + 1) SELECT source, doc_id, n_bytes, batch FROM g")
def batch_by_bytes(spark, d):
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "source", F.octet_length("text").cast("long").alias("n_bytes"))
    return batching.greedy(docs, "source", "doc_id", "n_bytes", max_entries=16, max_bytes=20_000)


@query("batch_flush_plans")
def batch_flush_plans(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    rows = e.select("user_id", "event_id", (F.col("event_id") % 200).alias("entries"), (F.col("event_id") * 997 % 1_500_000).alias("n_bytes"), (F.col("event_type") == "error").alias("elapsed"), (F.col("event_id") % 3 == 0).alias("consumed"))
    return batching.flush_plans(rows, "user_id", "event_id")


@query("reconnect_delays", "WITH RECURSIVE a AS (SELECT user_id % 20 AS peer, event_id AS seq, event_id * 3701 % 15000 AS lived, row_number() OVER (PARTITION BY user_id % 20 ORDER BY event_id) AS r FROM events), s AS (SELECT peer, seq, r, 500 AS delay_ms FROM a WHERE r = 1 UNION ALL SELECT a.peer, a.seq, a.r, CASE WHEN a.lived >= 10000 THEN 500 ELSE least(2000, s.delay_ms * 2) END FROM s JOIN a ON a.peer = s.peer AND a.r = s.r + 1) SELECT peer, seq, CAST(delay_ms AS BIGINT) AS delay_ms FROM s")
def reconnect_delays(spark, d):
    a = spark.read.parquet(f"{d}/events.parquet").select((F.col("user_id") % 20).alias("peer"), F.col("event_id").alias("seq"), (F.col("event_id") * 3701 % 15000).alias("lived_ms"))
    return batching.reconnect_delays(a).select("peer", "seq", "delay_ms")


@query("lat_stats", "SELECT event_type, count(*) AS count, CAST(sum(us) AS BIGINT) AS total_us, max(us) AS max_us, CAST(sum(us) // count(*) AS BIGINT) AS avg_us, CAST(sum(entries) AS BIGINT) AS entries, CAST(sum(entries) // count(*) AS BIGINT) AS avg_entries FROM (SELECT event_type, CAST(round(value * 100) AS BIGINT) AS us, user_id % 128 AS entries FROM events) GROUP BY event_type")
def lat_stats(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("event_type", F.round(F.col("value") * 100).cast("long").alias("us"), (F.col("user_id") % 128).alias("entries"))
    return telemetry.latency_stats(e, ["event_type"], extra=["entries"])


@query("lat_percentiles", "SELECT event_type, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type")
def lat_percentiles(spark, d):
    return reports.percentiles(spark.read.parquet(f"{d}/events.parquet"), ["event_type"], "value", [50, 95, 99])


@query("op_mix", "SELECT kind, count(*) AS n FROM (SELECT CASE WHEN floor((event_id + 1) * 0.3::DOUBLE) > floor(event_id * 0.3::DOUBLE) THEN 'SET' ELSE 'GET' END AS kind FROM events) GROUP BY kind")
def op_mix(spark, d):
    return spark.read.parquet(f"{d}/events.parquet").groupBy(c.op_kind(F.col("event_id"), 0.3).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


REPLY_SQL = "CASE event_id % 5 WHEN 0 THEN 'ERR MOVED ' || user_id % 3 WHEN 1 THEN 'ERR busy now' WHEN 2 THEN 'OK' WHEN 3 THEN 'ERR timeout, outcome unknown' END"


def with_replies(spark, d):
    i = F.col("event_id") % 5
    reply = F.when(i == 0, F.concat(F.lit("ERR MOVED "), (F.col("user_id") % 3).cast("string"))).when(i == 1, "ERR busy now").when(i == 2, "OK").when(i == 3, "ERR timeout, outcome unknown")
    return spark.read.parquet(f"{d}/events.parquet").withColumn("reply", reply)


@query("reply_category", f"SELECT category, event_type, count(*) AS n FROM (SELECT event_type, CASE WHEN upper(r) LIKE '%MOVED %' THEN 'moved' WHEN upper(r) LIKE '%PROPOSAL LIMIT%' OR upper(r) LIKE '%OVERLOAD%' OR upper(r) LIKE '%BUSY%' THEN 'overload' ELSE 'other' END AS category FROM (SELECT event_type, {REPLY_SQL} AS r FROM events)) GROUP BY ALL")
def reply_category(spark, d):
    return with_replies(spark, d).groupBy(c.reply_category(F.col("reply")).alias("category"), "event_type").agg(F.count(F.lit(1)).alias("n"))


@query("write_outcome", f"SELECT outcome, count(*) AS n FROM (SELECT CASE WHEN r IS NULL THEN CASE WHEN user_id % 2 = 0 THEN 'unknown' ELSE 'not_sent' END WHEN r = 'OK' THEN 'acknowledged' WHEN r LIKE '%outcome unknown' THEN 'unknown' WHEN r LIKE 'ERR MOVED %' OR r LIKE 'ERR BUSY %' THEN 'rejected' ELSE 'unexpected' END AS outcome FROM (SELECT user_id, {REPLY_SQL} AS r FROM events)) GROUP BY outcome")
def write_outcome(spark, d):
    return with_replies(spark, d).groupBy(c.write_outcome(F.col("reply"), F.col("user_id") % 2 == 0).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("classify_commands", "SELECT kind, error, count(*) AS n FROM (SELECT CASE WHEN error IS NOT NULL THEN 'ERROR' WHEN verb IN ('SET','DEL') THEN 'WRITE' ELSE 'READ' END AS kind, error FROM (SELECT verb, CASE WHEN a IS NULL THEN 'ERR unknown command ''' || verb || '''' WHEN a <> n THEN 'ERR wrong number of arguments for ''' || verb || ''' command' END AS error FROM (SELECT verb, n, CASE verb WHEN 'PING' THEN 1 WHEN 'INFO' THEN 1 WHEN 'SELECT' THEN 2 WHEN 'GET' THEN 2 WHEN 'DEL' THEN 2 WHEN 'SET' THEN 3 END AS a FROM (SELECT ['PING','INFO','SELECT','GET','DEL','SET','BOGUS'][event_id % 7 + 1] AS verb, user_id % 3 + 1 AS n FROM events)))) GROUP BY ALL")
def classify_commands(spark, d):
    verb = F.element_at(F.array(*map(F.lit, ["PING", "INFO", "SELECT", "GET", "DEL", "SET", "BOGUS"])), (F.col("event_id") % 7 + 1).cast("int"))
    args = F.slice(F.array(verb, F.lit("k"), F.lit("v")), F.lit(1), (F.col("user_id") % 3 + 1).cast("int"))
    x = c.classify(args)
    return spark.read.parquet(f"{d}/events.parquet").groupBy(x["kind"].alias("kind"), x["error"].alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("phase_counts", "WITH m AS (SELECT (max(event_id) + 1) // 25 AS w FROM events) SELECT phase, count(*) AS n FROM (SELECT n_nationkey AS phase, n_nationkey * w AS lo, n_nationkey * w + w * 3 // 4 AS hi FROM nation, m) x JOIN events e ON e.event_id >= lo AND e.event_id < hi GROUP BY phase")
def phase_counts(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet")
    width = (e.agg(F.max("event_id")).first()[0] + 1) // 25
    w = spark.read.parquet(f"{d}/nation.parquet").select(F.col("n_nationkey").alias("phase"), (F.col("n_nationkey") * width).alias("start"), (F.col("n_nationkey") * width + width * 3 // 4).alias("stop"))
    return reports.in_windows(e, w, "event_id").groupBy("phase").agg(F.count(F.lit(1)).alias("n"))


@query("head_tail_median", "WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS a, row_number() OVER (PARTITION BY event_type ORDER BY event_id DESC) AS z FROM events) SELECT event_type, count(*) AS samples, quantile_cont(value, 0.5) FILTER (WHERE a <= 10) AS head, quantile_cont(value, 0.5) FILTER (WHERE z <= 10) AS tail, max(value) AS peak, CASE WHEN count(*) >= 30 THEN quantile_cont(value, 0.5) FILTER (WHERE z <= 10) - quantile_cont(value, 0.5) FILTER (WHERE a <= 10) END AS growth FROM r GROUP BY event_type")
def head_tail_median(spark, d):
    return reports.head_tail_growth(spark.read.parquet(f"{d}/events.parquet"), "event_type", "event_id", "value")


@query("counter_delta", "SELECT user_id, event_id, CASE WHEN d >= 0 THEN d END AS d_c FROM (SELECT user_id, event_id, c - lag(c) OVER (PARTITION BY user_id ORDER BY event_id) AS d FROM (SELECT user_id, event_id, event_id * 7 % 10007 AS c FROM events))")
def counter_delta(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").select("user_id", "event_id", (F.col("event_id") * 7 % 10007).alias("c"))
    return reports.counter_deltas(e, ["user_id"], "event_id", ["c"]).select("user_id", "event_id", "d_c")


@query("pooled_ratio", "SELECT o_orderpriority AS mode, CAST(sum(s) AS BIGINT) AS success, sum(s) / sum(e) AS goodput, sum(u) * 1e6 / sum(s) AS cpu_us_per_op FROM (SELECT o_orderpriority, o_orderkey % 1000 + 1 AS s, (o_custkey % 50 + 1)::DOUBLE AS e, (o_custkey % 9 + 1)::DOUBLE AS u FROM orders) GROUP BY 1")
def pooled_ratio(spark, d):
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderpriority").alias("mode"), (F.col("o_orderkey") % 1000 + 1).alias("success"), (F.col("o_custkey") % 50 + 1).cast("double").alias("elapsed_seconds"), (F.col("o_custkey") % 9 + 1).cast("double").alias("cpu_seconds"))
    return reports.pooled(o)


@query("cpu_shares", "SELECT g, event_type, delta, CASE WHEN min(delta) OVER (PARTITION BY g) >= 0 THEN 100.0::DOUBLE * delta / sum(delta) OVER (PARTITION BY g) END AS share_pct FROM (SELECT g, event_type, CAST(n - CASE WHEN g = 3 AND event_type = 'view' THEN 100000 ELSE 0 END AS BIGINT) AS delta FROM (SELECT user_id % 10 AS g, event_type, count(*) AS n FROM events GROUP BY ALL))")
def cpu_shares(spark, d):
    e = spark.read.parquet(f"{d}/events.parquet").groupBy((F.col("user_id") % 10).alias("g"), "event_type").agg(F.count(F.lit(1)).alias("n"))
    rows = e.withColumn("delta", F.col("n") - F.when((F.col("g") == 3) & (F.col("event_type") == "view"), 100000).otherwise(0))
    return reports.cpu_shares(rows, "g", "event_type", "delta")


INFO_SQL = "s AS (SELECT user_id % 5 AS run, event_id // 3 AS at_, event_id % 3 AS node, CASE WHEN event_id % 3 = (event_id // 3) % 4 THEN 'leader' WHEN event_id % 17 = 0 THEN 'candidate' ELSE 'follower' END AS state, CASE WHEN event_id % 11 = 0 THEN -1 ELSE (event_id // 3) % 4 END AS leader_id, event_id // 100 + CASE WHEN event_id % 37 = 0 THEN 1 ELSE 0 END AS term, event_id % 50 AS lag FROM events)"


def info_samples(spark, d):
    i, u = F.col("event_id"), F.col("user_id")
    third = F.floor(i / 3).cast("long")
    state = F.when(i % 3 == third % 4, "leader").when(i % 17 == 0, "candidate").otherwise("follower")
    return spark.read.parquet(f"{d}/events.parquet").select((u % 5).alias("run"), third.alias("at"), (i % 3).alias("node"), state.alias("state"), F.when(i % 11 == 0, -1).otherwise(third % 4).alias("leader_id"), (F.floor(i / 100).cast("long") + F.when(i % 37 == 0, 1).otherwise(0)).alias("term"), (i % 50).alias("lag"))


@query("info_summary", "WITH " + INFO_SQL + ", e AS (SELECT run, at_, count_if(state = 'leader') AS leaders, count(DISTINCT leader_id) AS ids, count(DISTINCT term) AS terms, max(CASE WHEN state = 'leader' THEN term END) AS term, max(CASE WHEN state = 'leader' THEN lag END) AS lag FROM s GROUP BY run, at_), k AS (SELECT * FROM e WHERE leaders = 1 AND ids = 1 AND terms = 1), w AS (SELECT *, lag(term) OVER (PARTITION BY run ORDER BY at_) AS before FROM k) SELECT t.run, t.samples, w.max_lag, t.samples - coalesce(w.n, 0) AS disagreements, coalesce(w.c, 0) AS term_increases FROM (SELECT run, count(*) AS samples FROM e GROUP BY run) t LEFT JOIN (SELECT run, max(lag) AS max_lag, count(*) AS n, count_if(term <> before)::BIGINT AS c FROM w GROUP BY run) w USING (run)")
def info_summary(spark, d):
    return reports.info_summary(info_samples(spark, d))


@query("leadership_agreement", "WITH " + INFO_SQL + ", l AS (SELECT at_ AS sample, count_if(state = 'leader')::BIGINT AS leaders, max(CASE WHEN state = 'leader' THEN node END) AS node, max(CASE WHEN state = 'leader' THEN term END) AS term FROM s GROUP BY at_) SELECT sample, leaders, CASE WHEN leaders = 1 AND bool_and(s.leader_id = l.node AND s.term = l.term AND s.state = CASE WHEN s.node = l.node THEN 'leader' ELSE 'follower' END) THEN max(l.node) END AS leader FROM l JOIN s ON s.at_ = l.sample GROUP BY sample, leaders")
def leadership_agreement(spark, d):
    s = info_samples(spark, d)
    return quorum.leadership_agreement(s.withColumnRenamed("node", "node_id").withColumnRenamed("at", "sample"))


@query("hot_keys", LOG_SQL + "SELECT k, count(*) AS n FROM log GROUP BY k ORDER BY n DESC, k LIMIT 10")
def hot_keys(spark, d):
    return derived_log(spark, d).groupBy("k").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "k").limit(10)


@query("longest_mount", "WITH p AS (SELECT DISTINCT '/' || replace(k, ':', '/') AS path FROM (SELECT 'ns' || (user_id % 4) || ':' || json_extract_string(props, '$.k') AS k FROM events)), m(mount, fs) AS (VALUES ('/', 'ext4'), ('/ns1', 'xfs'), ('/ns2/7', 'tmpfs')) SELECT path, mount, fs FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY length(mount) DESC) AS r FROM p JOIN m ON path = mount OR starts_with(path, rtrim(mount, '/') || '/')) WHERE r = 1")
def longest_mount(spark, d):
    paths = derived_log(spark, d).select(F.concat(F.lit("/"), F.replace("k", F.lit(":"), F.lit("/"))).alias("path")).distinct()
    return reports.longest_mount(paths, spark.createDataFrame([("/", "ext4"), ("/ns1", "xfs"), ("/ns2/7", "tmpfs")], "mount string, fs string"))


@query("resp_encode", "SELECT doc_id, sha256('*3' || chr(13) || chr(10) || '$3' || chr(13) || chr(10) || 'SET' || chr(13) || chr(10) || '$' || length(CAST(doc_id AS VARCHAR)) || chr(13) || chr(10) || doc_id || chr(13) || chr(10) || '$' || octet_length(encode(text)) || chr(13) || chr(10) || text || chr(13) || chr(10)) AS digest FROM documents")
def resp_encode(spark, d):
    args = F.array(F.lit("SET"), F.col("doc_id").cast("string"), F.col("text"))
    return spark.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2(b.resp_array(args).cast("binary"), 256).alias("digest"))


@query("resp_decode", "SELECT source AS conn, count(*) AS n, CAST(sum(octet_length(encode(text))) AS BIGINT) AS n_bytes FROM documents GROUP BY source")
def resp_decode(spark, d):
    """Documents as SET commands of one connection per source, cut into chunks at every half, decoded again.

    A document without text is a DEL, which is counted and has no bytes.  An invalid command fails the query.
    """
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    args = F.when(F.col("text").isNull(), F.array(F.lit("DEL"), key)).otherwise(F.array(F.lit("SET"), key, F.col("text")))
    # ids may be null or repeat, so chunks are ordered by row as well
    docs = spark.read.parquet(f"{d}/documents.parquet").select("source", "doc_id", F.monotonically_increasing_id().alias("row"), b.resp_array(args).cast("binary").alias("wire"))
    half = F.floor(F.octet_length("wire") / 2).cast("int")
    seq = lambda part: F.struct("doc_id", "row", F.lit(part).alias("part")).alias("seq")
    both = F.array(F.struct(seq(0), F.substring("wire", F.lit(1), half).alias("bytes")), F.struct(seq(1), F.substring("wire", half + 1, F.octet_length("wire")).alias("bytes")))
    chunks = docs.select(F.col("source").alias("conn"), F.explode(both).alias("x")).select("conn", "x.seq", "x.bytes")
    done = wire.count_commands(wire.decode_commands(chunks, wire.ANY_COMMAND), 2)
    whole = F.when(F.col("n_errors") > 0, F.raise_error(F.lit("invalid command")).cast("long")).otherwise(F.col("n"))
    return done.select("conn", whole.alias("n"), "n_bytes")


@query("snapshot_roundtrip", LOG_SQL + "SELECT k, CAST(v AS VARCHAR) AS v FROM state WHERE op = 'SET'")
def snapshot_roundtrip(spark, d):
    state = replay.kv_state(derived_log(spark, d)).select(F.col("k").cast("binary").alias("k"), F.col("v").cast("string").cast("binary").alias("v"))
    return wire.read_payloads(wire.snapshot_payloads(state, 1000)).select(F.col("k").cast("string").alias("k"), F.col("v").cast("string").alias("v"))


@query("info_roundtrip", "SELECT node, key, value FROM (SELECT user_id AS node, unnest(['term', 'commit_index', 'state']) AS key, unnest([CAST(max(event_id) AS VARCHAR), CAST(count(*) AS VARCHAR), CASE WHEN user_id % 2 = 0 THEN 'leader' ELSE 'follower' END]) AS value FROM events GROUP BY user_id)")
def info_roundtrip(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("node")).agg(F.max("event_id").alias("t"), F.count(F.lit(1)).alias("n"))
    text = telemetry.info_text({"term": F.col("t"), "commit_index": F.col("n"), "state": F.when(F.col("node") % 2 == 0, "leader").otherwise("follower")})
    return telemetry.info_lines(rows.select("node", text.alias("info")), "info", ["node"]).select("node", "key", "value")


@query("prometheus_text", "SELECT user_id AS node, '# HELP node_term Current Raft term.' || chr(10) || '# TYPE node_term gauge' || chr(10) || 'node_term ' || max(event_id) || chr(10) || '# HELP node_apply_count Successful stage samples since process start.' || chr(10) || '# TYPE node_apply_count counter' || chr(10) || 'node_apply_count ' || count(*) || chr(10) AS text FROM events GROUP BY user_id")
def prometheus_text(spark, d):
    rows = spark.read.parquet(f"{d}/events.parquet").groupBy(F.col("user_id").alias("node")).agg(F.max("event_id").alias("t"), F.count(F.lit(1)).alias("n"))
    text = telemetry.info_text({"term": F.col("t"), "apply_count": F.col("n"), "namespace": F.lit("default"), "odd-name": F.lit(3)})
    lines = telemetry.prometheus(telemetry.info_lines(rows.select("node", text.alias("info")), "info", ["node"]), ["node"], "node_")
    return lines.groupBy("node").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "text"))), lambda x: x["text"]), "").alias("text"))


@query("reservoir", "SELECT event_id, value, count(*) OVER () AS seen FROM events ORDER BY md5('0:' || event_id), event_id LIMIT 100")
def reservoir(spark, d):
    return reports.reservoir(spark.read.parquet(f"{d}/events.parquet").select("event_id", "value"), "event_id", 100)


from . import rules  # noqa: E402, F401  (registers its queries)
