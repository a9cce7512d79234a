"""Quorum decisions over replica, vote and acknowledgement rows; groups are keyed, never collected to the driver."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.commands import up_to_date

FRESH_MS = 150
LEASE_MS = 300


def quorum_size(n: Column) -> Column:
    return F.floor(n / 2).cast("int") + 1


def commit_index(progress: DataFrame) -> DataFrame:
    """Per group the index that a majority holds: the (n div 2)-th largest match (from 0).  A group is one set of replicas."""
    order = Window.partitionBy("group_id").orderBy(F.col("match_index").desc(), "peer")
    sized = progress.withColumn("r", F.row_number().over(order)).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("group_id")))
    return sized.filter(F.col("r") == quorum_size(F.col("n"))).select("group_id", F.col("match_index").alias("commit_index"), F.col("n").cast("int").alias("n"))


def advance_commit(candidates: DataFrame, log: DataFrame, commit: Column, current_term: Column) -> DataFrame:
    """Candidates that really commit: beyond the old commit, at an entry of the current term."""
    held = candidates.join(log.select(F.col("log_index").alias("commit_index"), "term"), "commit_index")
    return held.filter((F.col("commit_index") > commit) & (F.col("term") == current_term))


def tally(votes: DataFrame, voters: int) -> DataFrame:
    """Per election and kind of vote the distinct grants and whether they are a majority of ``voters``."""
    got = votes.groupBy("election", "prevote").agg(F.countDistinct(F.when(F.col("granted"), F.col("voter"))).alias("grants"))
    return got.withColumn("won", F.col("grants") >= voters // 2 + 1)


def _heard(groups: DataFrame, contacts: DataFrame, at: str, now_ms: Column, window_ms: int) -> DataFrame:
    """``groups(group_id, leader, members, leader_since_ms)`` with ``fresh``: the leader and the peers whose last ``at`` lies in the window."""
    last = contacts.groupBy("group_id", "peer").agg(F.max(at).alias("last"))
    other = last.join(groups.select("group_id", "leader"), "group_id").filter(F.col("peer") != F.col("leader"))
    fresh = other.groupBy("group_id").agg(F.count_if(now_ms - F.col("last") < window_ms).alias("n"))
    return groups.join(fresh, "group_id", "left").withColumn("fresh", 1 + F.coalesce("n", F.lit(0))).drop("n")


def check_quorum(groups: DataFrame, contacts: DataFrame, now_ms: Column, window_ms: int = FRESH_MS) -> DataFrame:
    """Per group whether its leader stays: it heard from a quorum of all ``members`` (itself included) within the window.

    Silent peers have no row in ``contacts(group_id, peer, last_contact_ms)``; in the first ``window_ms`` of a leadership
    and where a quorum is one, nobody is asked.
    """
    need = quorum_size(F.col("members"))
    stays = (need <= 1) | (now_ms - F.col("leader_since_ms") < window_ms) | (F.col("fresh") >= need)
    return _heard(groups, contacts, "last_contact_ms", now_ms, window_ms).select("group_id", "members", "fresh", stays.alias("stays"))


def lease_valid(groups: DataFrame, acks: DataFrame, now_ms: Column, window_ms: int = FRESH_MS, lease_ms: int = LEASE_MS) -> DataFrame:
    """Per group whether the leader may read under its lease: it has led for ``lease_ms``, and with it a quorum acknowledged
    requests *sent* within the window."""
    need = quorum_size(F.col("members"))
    lease = (now_ms - F.col("leader_since_ms") >= lease_ms) & ((need <= 1) | (F.col("fresh") >= need))
    return _heard(groups, acks, "sent_ms", now_ms, window_ms).select("group_id", "members", "fresh", lease.alias("lease"))


def match_acks(acks: DataFrame, flights: DataFrame, timeout_ms: int = FRESH_MS) -> DataFrame:
    """Acknowledgements of requests in flight: same peer and id, in time."""
    return acks.join(flights, ["peer", "rpc_id"]).filter(F.col("acked_ms") - F.col("sent_ms") < timeout_ms)


def grant_vote(r: str = "req", v: str = "own") -> Column:
    """Whether a voter (own: state, leader_id, heard_recently, current_term, voted_for, last_term, last_index) grants a request."""
    req, own = (lambda c: F.col(f"{r}.{c}")), (lambda c: F.col(f"{v}.{c}"))
    log_ok = up_to_date(req("last_log_term"), req("last_log_index"), own("last_term"), own("last_index"))
    disturbs = (own("state") == "FOLLOWER") & (own("leader_id") != -1) & (own("leader_id") != req("candidate")) & own("heard_recently")
    newer = req("term") > own("current_term")
    free = newer | own("voted_for").isin(-1) | (own("voted_for") == req("candidate"))
    return F.when(req("prevote") & (own("state") == "LEADER"), False).when(disturbs, False).when(req("prevote"), newer & log_ok).otherwise((req("term") >= own("current_term")) & free & log_ok)


def follow_up(match: Column, next_index: Column, success: Column, acknowledged: Column, hint: Column) -> Column:
    """(match_index, next_index) after an append's response."""
    up = F.greatest(match, acknowledged)
    back = F.greatest(match + 1, F.least(next_index - 1, hint + 1))
    return F.struct(F.when(success, up).otherwise(match).alias("match_index"), F.when(success, up + 1).otherwise(back).alias("next_index"))


def leadership_agreement(samples: DataFrame) -> DataFrame:
    """Per sample of ``samples(sample, node_id, state, leader_id, term)`` its leader, null unless there is one leader, every
    node names it and its term, and all others are followers."""
    is_leader = F.col("state") == "leader"
    leaders = samples.groupBy("sample").agg(F.count_if(is_leader).alias("leaders"), F.max(F.when(is_leader, F.struct("node_id", "term"))).alias("l"))
    seen = samples.join(leaders, "sample")
    role = F.when(F.col("node_id") == F.col("l.node_id"), "leader").otherwise("follower")
    fits = F.col("leader_id").eqNullSafe(F.col("l.node_id")) & F.col("term").eqNullSafe(F.col("l.term")) & F.col("state").eqNullSafe(role)
    agg = seen.groupBy("sample").agg(F.max("leaders").alias("leaders"), F.bool_and(fits).alias("fits"), F.max("l.node_id").alias("node_id"))
    return agg.select("sample", "leaders", F.when((F.col("leaders") == 1) & F.col("fits"), F.col("node_id")).alias("leader"))


def replica_agreement(states: DataFrame, replicas: int) -> DataFrame:
    """Keys on which ``states(replica, k, v)`` differ or that a replica lacks."""
    got = states.groupBy("k").agg(F.countDistinct("v").alias("values"), F.countDistinct("replica").alias("replicas"))
    return got.filter((F.col("values") != 1) | (F.col("replicas") != replicas))


def convergence(samples: DataFrame, least: int) -> DataFrame:
    """Per group whether every replica has committed and applied alike, at ``least`` or beyond."""
    agg = samples.groupBy("group_id").agg(F.min("commit_index").alias("lo"), F.max("commit_index").alias("hi"), F.min("last_applied").alias("applied"))
    return agg.select("group_id", ((F.col("lo") == F.col("hi")) & (F.col("applied") == F.col("hi")) & (F.col("lo") >= least)).alias("converged"))
