"""Counters, INFO text, Prometheus exposition, scrape requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Roles, counter names and help texts of the exposition format.
ROLES = ["leader", "follower", "candidate", "pre-candidate", "stopped"]
GAUGES_IN_SPITE_OF_SUFFIX = ["queued_write_bytes", "pending_proposal_bytes", "client_input_bytes", "client_output_reserved_bytes"]
COUNTER_SUFFIXES = ["_count", "_total_us", "_entries", "_bytes"]
COUNTERS = ["replication_retry_attempts", "proposal_timeouts", "read_index_total", "read_index_succeeded", "read_index_timeout", "read_index_not_leader", "read_index_overload", "read_index_lease", "overload_rejections", "flush_immediate_scheduled", "flush_delayed_scheduled", "flush_promotions", "proposal_batches", "apply_batches"]
HELP = {
    "node_id": "This process's Raft node id.",
    "leader_id": "Current leader id, or -1 when this node does not know one.",
    "term": "Current Raft term.",
    "commit_index": "Highest log index known to be committed.",
    "last_applied": "Highest log index applied to the state machine.",
    "apply_lag": "Committed entries not yet applied (commit_index - last_applied).",
    "overload_rejections": "Admission failures that rejected a request or closed a connection.",
    "snapshot_index": "Last included index of the latest snapshot, or 0 when none exists.",
}
SUFFIX_HELP = {
    "_total_us": "Sum of successful stage samples, in microseconds, since process start.",
    "_max_us": "Largest successful stage sample, in microseconds, since process start.",
    "_avg_us": "Integer-truncated mean of successful stage samples, in microseconds.",
    "_count": "Successful stage samples since process start.",
}
OTHER_HELP = "INFO field exported for scraping."


def latency_stats(samples: DataFrame, by: list[str], us: str = "us", extra: list[str] | None = None) -> DataFrame:
    """count, total_us, max_us, avg_us (whole) and the sums and whole means of ``extra`` columns."""
    n = F.count(F.lit(1))
    cols = [n.alias("count"), F.sum(us).alias("total_us"), F.max(us).alias("max_us"), F.expr(f"coalesce(sum({us}) div count(1), 0L)").alias("avg_us")]
    for c in extra or []:
        cols += [F.sum(c).alias(c), F.expr(f"coalesce(sum({c}) div count(1), 0L)").alias(f"avg_{c}")]
    return samples.groupBy(*by).agg(*cols)


def info_text(fields: dict[str, Column]) -> Column:
    return F.concat(*[x for k, v in fields.items() for x in (F.lit(f"{k}:"), v.cast("string"), F.lit("\r\n"))])


def info_lines(rows: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """(keys..., pos, key, value): lines are divided at their first colon; the last of repeated keys wins."""
    lines = rows.select(*keys, F.posexplode(F.split(F.col(text), "\r?\n")).alias("pos", "line")).filter(F.locate(":", "line") > 1)
    cut = F.locate(":", F.col("line"))
    parts = lines.select(*keys, "pos", F.substring("line", 1, cut - 1).alias("key"), F.substring(F.col("line"), cut + 1, F.length("line")).alias("value"))
    return parts.groupBy(*keys, "key").agg(F.max(F.struct("pos", "value")).alias("x")).select(*keys, F.col("x.pos").alias("pos"), "key", F.col("x.value").alias("value"))


def is_integer(text: Column) -> Column:
    return text.rlike(r"\A-?[0-9]+\z")


def is_metric_name(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z][A-Za-z0-9_]*\z")


def is_counter(name: Column) -> Column:
    suffix = name.rlike("(" + "|".join(COUNTER_SUFFIXES) + r")\z")
    return ~name.isin(*GAUGES_IN_SPITE_OF_SUFFIX) & (suffix | name.isin(*COUNTERS))


def help_text(name: Column) -> Column:
    out = F.lit(OTHER_HELP)
    for suffix, text in reversed(SUFFIX_HELP.items()):
        out = F.when(F.endswith(name, F.lit(suffix)), F.lit(text)).otherwise(out)
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in HELP.items() for x in kv]), name), out)


def prometheus(lines: DataFrame, keys: list[str], prefix: str) -> DataFrame:
    """One row per exposed metric: keys..., pos, text (HELP, TYPE and value lines); names start with ``prefix``."""
    name = F.concat(F.lit(prefix), F.col("key"))
    plain = F.concat(F.lit("# HELP "), name, F.lit(" "), help_text(F.col("key")), F.lit("\n# TYPE "), name, F.when(is_counter(F.col("key")), " counter\n").otherwise(" gauge\n"), name, F.lit(" "), F.col("value"), F.lit("\n"))
    one_hot = F.array_join(F.transform(F.array(*map(F.lit, ROLES)), lambda r: F.concat(F.lit(f'{prefix}role{{role="'), r, F.lit('"} '), F.when(r == F.col("value"), "1").otherwise("0"), F.lit("\n"))), "")
    role = F.concat(F.lit(f"# HELP {prefix}role Current Raft role. One known role is 1.\n# TYPE {prefix}role gauge\n"), one_hot)
    known = (F.col("key") != "namespace") & ((F.col("key") == "state") | (is_metric_name(F.col("key")) & is_integer(F.col("value"))))
    return lines.filter(known).select(*keys, "pos", F.when(F.col("key") == "state", role).otherwise(plain).alias("text"))


def scrape_request(raw: Column) -> Column:
    """Kind of an HTTP request: Incomplete, BadRequest, MethodNotAllowed, Health, NotFound, Ok."""
    line = F.substring_index(raw, "\r\n", 1)
    part = lambda i: F.regexp_extract(line, r"\A([^ ]+) ([^ ]*) (.*)\z", i)
    target = F.substring_index(part(2), "?", 1)
    return (
        F.when(~raw.contains("\r\n\r\n"), "Incomplete")
        .when(~line.rlike(r"\A[^ ]+ [^ ]* ") | ~part(3).isin("HTTP/1.0", "HTTP/1.1"), "BadRequest")
        .when(part(1) != "GET", "MethodNotAllowed")
        .when(target == "/health", "Health")
        .when(target != "/metrics", "NotFound")
        .otherwise("Ok")
    )


def health_text(node: Column, state: Column, term: Column, leader: Column, healthy: Column, storage: Column) -> Column:
    fields = F.concat_ws("\n", F.concat(F.lit("node_id:"), node), F.concat(F.lit("state:"), state), F.concat(F.lit("term:"), term), F.concat(F.lit("leader_id:"), leader), F.concat(F.lit("storage_healthy:"), storage.cast("int")))
    return F.concat(F.when(healthy, "ok\n").otherwise("unavailable\n"), fields, F.lit("\n"))


def is_healthy_body(body: Column) -> Column:
    return body.startswith("ok\n")


def running_bytes(events: DataFrame, stream: str, order: str) -> DataFrame:
    """Bytes in minus bytes out after every event of a stream (delta is signed)."""
    from pyspark.sql import Window

    return events.withColumn("held", F.sum("delta").over(Window.partitionBy(stream).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def scrape_response(kind: Column, metrics: Column, health: Column, healthy: Column) -> Column:
    """The HTTP/1.1 answer to a request of a kind; null while the request is incomplete."""
    def answer(status: str, body: Column, mime: str = "text/plain; charset=utf-8") -> Column:
        return F.concat(F.lit(f"HTTP/1.1 {status}\r\nContent-Type: {mime}\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\nConnection: close\r\n\r\n"), body)

    return (
        F.when(kind == "Ok", answer("200 OK", metrics, "text/plain; version=0.0.4; charset=utf-8"))
        .when(kind == "Health", F.when(healthy, answer("200 OK", health)).otherwise(answer("503 Service Unavailable", health)))
        .when(kind == "NotFound", answer("404 Not Found", F.lit("not found\n")))
        .when(kind == "MethodNotAllowed", answer("405 Method Not Allowed", F.lit("method not allowed\n")))
        .when(kind == "BadRequest", answer("400 Bad Request", F.lit("bad request\n")))
    )


def health_fields(body: Column) -> Column:
    """Struct (up, node_id, state, term, leader_id, storage_healthy) of a health text."""
    field = lambda name: F.regexp_extract(body, rf"(?m)^{name}:(.*)$", 1)
    whole = lambda name: field(name).try_cast("long")
    return F.struct(is_healthy_body(body).alias("up"), whole("node_id").alias("node_id"), field("state").alias("state"), whole("term").alias("term"), whole("leader_id").alias("leader_id"), (field("storage_healthy") == "1").alias("storage_healthy"))


def event_counters(events: DataFrame, by: list[str], kinds: dict[str, Column]) -> DataFrame:
    """How often each kind of event happened, by group; counters only rise as events are added."""
    return events.groupBy(*by).agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
