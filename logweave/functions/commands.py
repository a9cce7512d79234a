"""Scalar rules of the command protocol as columns: classification, admission, replies.

Argument lists are ARRAY<STRING>; the verb is the first element, upper-cased by ``upper_verb``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_REQUEST_ID = "18446744073709551615"
REDIRECT_ERRORS = ["not leader", "no leader", "leadership lost", "server stopped"]


def _first(*rules: tuple[Column, Column | str | None], default=None) -> Column:
    """The value of the first rule whose condition holds."""
    lit = lambda v: v if isinstance(v, Column) else F.lit(v)
    out = lit(default)
    return reduce(lambda acc, r: F.when(r[0], lit(r[1])).otherwise(acc), reversed(rules), out)


def arg(args: Column, i: int) -> Column:
    return F.get(args, F.lit(i))


def ascii_upper(text: Column) -> Column:
    """a-z to A-Z; other letters stay, so no Unicode letter turns into a verb's."""
    return F.translate(text, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def upper_verb(args: Column) -> Column:
    return F.when(F.size(args) > 0, F.concat(F.array(ascii_upper(arg(args, 0))), F.slice(args, 2, F.greatest(F.size(args) - 1, F.lit(0))))).otherwise(args)


def valid_namespace(name: Column) -> Column:
    return name.rlike(r"\A[A-Za-z0-9_-]{1,63}\z")


def user_key(namespace: Column, raw: Column) -> Column:
    return F.concat(F.coalesce(namespace, F.lit("default")), F.lit(":"), raw)


def split_key(key: Column) -> tuple[Column, Column]:
    """(namespace, raw key): names hold no colon, so the first one divides."""
    at = F.locate(":", key)
    return F.substring_index(key, ":", 1), F.substring(key, at + 1, F.length(key))


def request_id(text: Column) -> Column:
    """1 to 2**64-1 without a leading zero as DECIMAL(20,0), else null."""
    value = F.when(text.rlike(r"\A[1-9][0-9]{0,19}\z"), text.try_cast("decimal(20,0)"))
    return F.when(value <= F.lit(MAX_REQUEST_ID).cast("decimal(20,0)"), value)


def wrong_arity(verb: Column) -> Column:
    return F.concat(F.lit("ERR wrong number of arguments for '"), verb, F.lit("' command"))


def unknown_command(verb: Column) -> Column:
    return F.concat(F.lit("ERR unknown command '"), verb, F.lit("'"))


def idemp_error(args: Column) -> Column:
    """Error of an IDEMP command, null if it is valid."""
    n, inner = F.size(args), ascii_upper(arg(args, 3))
    size = F.octet_length(arg(args, 1))
    fits = ((inner == "SET") & (n == 6)) | ((inner == "DEL") & (n == 5))
    return _first(
        (F.coalesce(ascii_upper(arg(args, 0)) != "IDEMP", F.lit(True)), "ERR unknown command"),
        (~n.isin(5, 6), "ERR wrong number of arguments for 'IDEMP' command"),
        (~size.between(1, 128), "ERR invalid client id"),
        (request_id(arg(args, 2)).isNull(), "ERR invalid request id"),
        (fits, F.lit(None).cast("string")),
        (inner.isin("SET", "DEL"), wrong_arity(inner)),
        default=unknown_command(arg(args, 3)),
    )


def classify(args: Column) -> Column:
    """Struct (kind READ, WRITE or ERROR; error) of a command whose verb is already upper-case."""
    n, verb = F.size(args), arg(args, 0)
    arity = F.element_at(F.create_map(*[F.lit(x) for kv in {"PING": 1, "INFO": 1, "SELECT": 2, "GET": 2, "DEL": 2, "SET": 3}.items() for x in kv]), verb)
    idemp = idemp_error(args)
    error = _first((n == 0, "ERR empty command"), (verb == "IDEMP", idemp), (arity.isNull(), unknown_command(verb)), (arity != n, wrong_arity(verb)))
    kind = F.when(error.isNotNull(), "ERROR").when(verb.isin("SET", "DEL", "IDEMP"), "WRITE").otherwise("READ")
    return F.struct(kind.alias("kind"), error.alias("error"))


def key_position(args: Column) -> Column:
    """0-based place of the user key in a write."""
    return F.when(arg(args, 0) == "IDEMP", 4).otherwise(1)


def is_redirect(error: Column) -> Column:
    return error.isin(*REDIRECT_ERRORS)


def get_decision(success: Column, leader: Column, error: Column) -> Column:
    return F.when(success & leader, "Serve").when(~success & leader & ~is_redirect(error), "Fail").otherwise("Redirect")


def accounted_bytes(args: Column, consumed: Column) -> Column:
    return F.greatest(consumed, F.aggregate(args, F.lit(0).cast("long"), lambda s, a: s + F.octet_length(a)))


def queue_full(commands: Column, n_bytes: Column, max_commands: int = 1000, max_bytes: int = 4 << 20) -> Column:
    return (commands >= max_commands) | (n_bytes >= max_bytes)


def write_admission(size: Column, is_leader: Column, leader_id: Column, queued: Column, queued_bytes: Column) -> Column:
    """Null if a write is admitted, else its error; limits count the write itself."""
    return _first(
        (size > (1 << 20), "ERR command too large"),
        (~is_leader, F.concat(F.lit("ERR MOVED "), leader_id.cast("string"))),
        ((queued >= 1024) | (queued_bytes + size > (16 << 20)), "ERR BUSY write queue full"),
        default=F.lit(None).cast("string"),
    )


def proposal_admission(is_leader: Column, healthy: Column, entries: Column, batch_bytes: Column, largest: Column, pending: Column, pending_bytes: Column) -> Column:
    """0 if a batch may be proposed; -1 not leader, -3 unhealthy, -2 empty or beyond a limit.  ``largest``: bytes of its largest command."""
    over = (entries < 1) | (largest > (1 << 20)) | (entries > 128) | (pending + entries > 1024) | (pending_bytes + batch_bytes > (16 << 20)) | (batch_bytes > (2 << 20) - 128 - 64 * entries)
    return _first((~is_leader, F.lit(-1)), (~healthy, F.lit(-3)), (over, F.lit(-2)), default=F.lit(0))


def reply_category(reply: Column) -> Column:
    text = F.upper(reply)
    return F.when(text.contains("MOVED "), "moved").when(text.rlike("PROPOSAL LIMIT|OVERLOAD|BUSY"), "overload").otherwise("other")


def write_outcome(reply: Column, sent: Column) -> Column:
    """acknowledged, rejected, unknown, not_sent; ``unexpected`` for replies that no rule covers."""
    return F.when(reply.isNull(), F.when(sent, "unknown").otherwise("not_sent")).when(reply == "OK", "acknowledged").when(F.endswith(reply, F.lit("outcome unknown")), "unknown").when(reply.startswith("ERR MOVED ") | reply.startswith("ERR BUSY "), "rejected").otherwise("unexpected")


def recovered_value_ok(outcome: Column, written: Column, found: Column) -> Column:
    return F.when(outcome == "acknowledged", found.eqNullSafe(written)).when(outcome == "unknown", found.isNull() | (found == written)).otherwise(found.isNull())


def up_to_date(last_term: Column, last_index: Column, own_term: Column, own_index: Column) -> Column:
    return F.struct(last_term, last_index) >= F.struct(own_term, own_index)


def valid_entries(entries: Column, prev_index: Column, prev_term: Column, term: Column) -> Column:
    """Entries (log_index, term) follow prev_index without a gap, with terms that never fall nor pass the request's."""
    placed = F.transform(entries, lambda e, i: e["log_index"] == prev_index + i + 1)
    terms = F.concat(F.array(prev_term), F.transform(entries, lambda e: e["term"]))
    rising = F.transform(terms, lambda t, i: (i == 0) | (t >= F.get(terms, F.greatest(i - 1, F.lit(0)))))
    return (prev_index >= 0) & (term > 0) & F.forall(placed, lambda x: x) & F.forall(rising, lambda x: x) & F.forall(terms, lambda t: t <= term)


def op_kind(i: Column, ratio: float) -> Column:
    """Evenly spread writes: global operation i is a write if the running share passes a whole number."""
    return F.when(F.floor((i + 1) * F.lit(ratio)) > F.floor(i * F.lit(ratio)), "SET").otherwise("GET")


def vote_request_valid(sender: Column, candidate: Column, term: Column, last_log_index: Column, last_log_term: Column, is_peer: Column) -> Column:
    """Whether a vote request is looked at: from a peer and by itself, with numbers that can be."""
    return is_peer & (candidate == sender) & (term > 0) & (last_log_index >= 0) & (last_log_term >= 0) & (last_log_term <= term)


def append_request_valid(sender: Column, leader: Column, term: Column, rpc_id: Column, prev_index: Column, prev_term: Column, leader_commit: Column, is_peer: Column) -> Column:
    """The head of an append request; its entries are judged by ``valid_entries``."""
    numbers = (term > 0) & (rpc_id != 0) & (prev_index >= 0) & (prev_term >= 0) & (prev_term <= term) & (leader_commit >= 0)
    return is_peer & (leader == sender) & numbers & ((prev_index == 0) == (prev_term == 0))


def follower_commit(commit: Column, leader_commit: Column, matched: Column) -> Column:
    return F.greatest(commit, F.least(leader_commit, matched))


SAFE_READ_ERRORS = ["read index timeout", "MOVED", "leadership lost", "server stopped", "no leader", "not leader"]


def safe_read(is_error: Column, text: Column) -> Column:
    """An isolated leader may answer a read only with one of these errors; silence and values are not safe."""
    return F.coalesce(is_error & reduce(lambda a, b: a | b, [text.contains(x) for x in SAFE_READ_ERRORS]), F.lit(False))


def transient_reply(is_error: Column, text: Column) -> Column:
    return F.coalesce(is_error & (F.endswith(text, F.lit("outcome unknown")) | text.startswith("ERR MOVED ")), F.lit(False))


#: fixed limits of the node's own accounts
BOUNDS = {"connected_clients": 32, "queued_writes": 1024, "pending_proposals": 1024, "queued_write_bytes": 16 << 20, "pending_proposal_bytes": 16 << 20, "client_input_bytes": 64 << 20, "client_output_reserved_bytes": 64 << 20}
DRAINED = ["queued_writes", "queued_write_bytes", "pending_proposals", "pending_proposal_bytes", "apply_lag", "apply_inflight", "client_input_bytes", "client_output_reserved_bytes"]


def within_bounds() -> Column:
    """Of rows with the INFO fields as columns."""
    return reduce(lambda a, b: a & b, [F.col(k).between(0, v) for k, v in BOUNDS.items()])


def drained() -> Column:
    return reduce(lambda a, b: a & b, [F.col(k) == 0 for k in DRAINED], F.col("connected_clients") == 1)


def apply_lag(commit_index: Column, last_applied: Column) -> Column:
    return commit_index - last_applied


def is_up(storage_healthy: Column, state: Column) -> Column:
    return storage_healthy & (state != "stopped")


def replies_to_invalid_frame(executing: Column, waiting: Column, queue_empty: Column) -> Column:
    """An error for a broken frame would be taken for the reply of a command under way, so there must be none."""
    return ~executing & ~waiting & queue_empty


def can_deliver(connected: Column, closing: Column) -> Column:
    return connected & ~closing


def work_share(requests: Column, workers: int, worker: Column) -> Column:
    """Requests of a worker: the rest goes to the first ones, one each."""
    return F.floor(requests / workers).cast("long") + (worker < requests % workers).cast("long")


def soak_key(worker: Column, index: Column) -> Column:
    return F.concat(F.lit("soak-"), worker.cast("string"), F.lit("-"), (index % 64).cast("string"))


def ping_reply(verb: Column) -> Column:
    return F.when(verb == "PING", F.lit("+PONG\r\n"))


#: fixed: message types of frames and what handles each
HANDLERS = {0: "RequestVote", 1: "RequestVoteResponse", 2: "AppendEntries", 3: "AppendEntriesResponse", 4: "InstallSnapshot", 5: "InstallSnapshotResponse"}


def handler(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in HANDLERS.items() for x in kv]), kind.cast("int"))


def read_timeout(age_ms: Column, stage: Column) -> Column:
    """Reason for which a read of a stage (round, unsent, pending) fails, null while it may go on; a round ends at 150 ms, a queue's read after 1000 ms."""
    return F.when((stage == "round") & (age_ms >= 150), "read index timeout").when((stage == "unsent") & (age_ms > 1000), "read index timeout").when((stage == "pending") & (age_ms > 1000), "apply timeout")


def flow_relay(writer: Column, recipient: Column) -> Column:
    """Struct (src, dst, direction): the lower id dials, its bytes are the request; null for a node and itself."""
    return F.when(writer != recipient, F.struct(F.least(writer, recipient).alias("src"), F.greatest(writer, recipient).alias("dst"), F.when(writer < recipient, "request").otherwise("reply").alias("direction")))
