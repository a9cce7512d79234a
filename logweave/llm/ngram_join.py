"""N-gram Jaccard join: size-aware, heavy sets apart from light ones.  Exact; returns connected groups.

Texts with equal shingle sets are one set from the start.  Two sets of sizes a and b link when
100 * overlap >= 90 * union (``percent``), which asks for an overlap of at least c(a, b).

* Light sets (size up to a boundary) enumerate their c-subsets for every c that a partner can ask for.  Sets that
  share a c-subset overlap in c shingles, so a group needs only links to its smallest set: no pairs.
* Heavy sets are found by inverted lists over their rarest shingles (a prefix: two linked sets share one of
  them).  Rarity comes from hashed counters over the whole corpus, of fixed size but many enough to tell rare shingles
  apart, so lists stay short.  Lists are
  scanned three times.  First every set meets only the first set of its list and its predecessor, and these linear
  candidates are verified and merged.  Then sets of still different groups meet; long lists are dealt out in
  blocks to many tasks, and the tokens' places in both prefixes and a count sketch (a lower bound of the symmetric
  difference, so nothing is lost) drop nearly all pairs before the exact check on whole shingle sets.  A first pass over
  a block takes only pairs that tie its groups together; the second takes all pairs of what is still apart.

The boundary between light and heavy is where the number of subset keys passes the weighted number of list entries,
from the histogram of set sizes.

A node of all this is a distinct shingle set, known by its 128-bit digest and numbered once in a written table; doc_ids
only come in at the end, so they may repeat.

Defined cases: null and blank texts have an empty set and link with nothing; repeated rows and equal texts share a
group; of rows with equal doc_id each has the group of its own text; a text of fewer words than a shingle is one
shingle; documents with null doc_id take part in no group and return component_id null; extra columns, whatever
their names, are kept by ``drop_near_copies``; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import components, free_name, saved, ship_package, skewed_join, table
from .textops import chunks, lazily, mixed, shingle_sets, trimmed

#: with few, frequent shingles that share a counter hide the rare ones, and lists fill up with chance meetings
COUNTERS = 1 << 24
CHUNKS = 256
#: tasks that hand counters and filters of fixed size to the driver, one after the other
HANDING = 16
#: a task's counters stop here, and are cut to it each time so many sets have been added that they could pass 16 bits
MOST = 1 << 15
#: buckets of the two count sketches of a set: 16-bit counts for a first look, 8-bit counts for a closer one
BUCKETS = 32
WIDE = 256
MAX_LIGHT = 40
BLOCK = 1024
#: lists are sorted in this many ways, by token, so that a set's neighbours in the linear round are not the same in all its lists
ORDERS = 4


def needed_overlap(a, b, percent: int):
    """Least overlap of linked sets of sizes a and b: 100 i >= percent (a + b - i)."""
    return -(-percent * (a + b) // (100 + percent))


def subset_sizes(s: int, percent: int) -> list[int]:
    """Overlaps that partners of any allowed size ask of a set of size s."""
    low, high = -(-percent * s // 100), 100 * s // percent
    return sorted({needed_overlap(s, b, percent) for b in range(max(1, low), high + 1)})


def n_keys(s: int, percent: int) -> int:
    return sum(math.comb(s, c) for c in subset_sizes(s, percent) if c <= s)


def prefix_length(s: int, percent: int) -> int:
    return s - -(-percent * s // 100) + 1


def choose_boundary(histogram: dict[int, int], percent: int, list_cost: float) -> int:
    """Largest size of light sets: the costs of both ways are summed for every boundary and the cheapest is taken."""
    sizes = range(1, MAX_LIGHT + 1)
    best, at = None, 0
    for x in range(0, MAX_LIGHT + 1):
        cost = sum(histogram.get(s, 0) * (n_keys(s, percent) if s <= x else prefix_length(s, percent) * list_cost) for s in sizes)
        if best is None or cost < best:
            best, at = cost, x
    return at


def _column(data: np.ndarray) -> pa.Array:
    return pa.array(data)


def sizes_and_digests(docs: DataFrame, words: int) -> DataFrame:
    """One row (kind 0) per document: doc_id, n, digest; and rows (kind 1) with parts of the hashed shingle counts of its task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, added = np.zeros(COUNTERS, np.uint16), 0
        names = ["kind", "doc_id", "n", "digest", "part", "counts"]
        for batch in batches:
            for ids, texts in chunks(lazily(batch.column("doc_id")), lazily(batch.column("text"))):
                sets = list(shingle_sets(texts, words))
                n = np.array([len(s) for s in sets], np.int64)
                for a in range(0, len(sets), MOST // 2):
                    part = sets[a : a + MOST // 2]
                    if added + len(part) > MOST // 2:
                        np.minimum(total, MOST, out=total)
                        added = 0
                    np.add.at(total, (np.concatenate(part) % np.uint64(COUNTERS)).astype(np.int64), np.uint16(1))
                    added += len(part)
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets]
                k = len(ids)
                yield pa.RecordBatch.from_arrays([pa.array([0] * k, pa.int32()), pa.array(ids, pa.int64()), _column(n), pa.array(digests, pa.binary()), pa.nulls(k, pa.int32()), pa.nulls(k, pa.binary())], names=names)
        if total.any():
            step = COUNTERS // CHUNKS
            for i in range(CHUNKS):
                part = _packed(np.minimum(total[i * step : (i + 1) * step], MOST))
                yield pa.RecordBatch.from_arrays([pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([i], pa.int32()), pa.array([part], pa.binary())], names=names)

    return docs.mapInArrow(lambda b: trimmed(run(b)), "kind int, doc_id long, n long, digest binary, part int, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    """Small numbers take about their bits: all lowest bytes come first, the highest last."""
    return pa.compress(np.ascontiguousarray(counts.astype("<u4").view(np.uint8).reshape(-1, 4).T), codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> np.ndarray:
    step = COUNTERS // CHUNKS
    planes = np.frombuffer(pa.decompress(data, decompressed_size=4 * step, codec="zstd"), np.uint8).reshape(4, step)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _sum_counts(t: pa.Table) -> pa.Table:
    """Summed counters of one part, up to the largest 32-bit number."""
    total = sum((_unpacked(x).astype(np.int64) for x in lazily(t.column("counts"), 16)), np.int64(0))
    return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "counts": pa.array([_packed(np.minimum(total, 2**32 - 1))], pa.binary())})


def corpus_counts(rows: DataFrame) -> np.ndarray:
    """The summed counters, one byte for each of COUNTERS (8 times their binary logarithm), whatever the corpus; sums run in two levels of groups."""
    first = rows.filter("kind = 1").select("part", "counts").withColumn("g", (F.spark_partition_id() / 16).cast("int"))
    some = first.groupBy("part", "g").applyInArrow(_sum_counts, "part int, counts binary")
    whole = some.groupBy("part").applyInArrow(_sum_counts, "part int, counts binary")
    out = np.zeros(COUNTERS, np.uint8)
    step = COUNTERS // CHUNKS
    for r in whole.coalesce(HANDING).toLocalIterator():
        out[r["part"] * step : (r["part"] + 1) * step] = np.minimum(8 * np.log2(1.0 + _unpacked(r["counts"])), 255)
    return out


def signatures(docs: DataFrame, words: int, percent: int, counts: np.ndarray, boundary: int) -> DataFrame:
    """Per document: doc_id, n, digest, count sketch, prefix (rarest hashes) if it can meet a heavy set, subset keys if light."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)
    least_listed = -(-percent * (boundary + 1) // 100)

    def keys_of(s: np.ndarray) -> list[tuple[int, int]]:
        out = []
        for c in subset_sizes(len(s), percent):
            if c == len(s):
                out.append((c, int(mixed(np.bitwise_xor.reduce(mixed(s + np.uint64(c)), keepdims=True))[0])))
            elif c < len(s):
                part = mixed(s + np.uint64(c))
                whole = np.bitwise_xor.reduce(part)
                drop = np.array([np.bitwise_xor.reduce(part[list(x)]) for x in combinations(range(len(s)), len(s) - c)], np.uint64)
                out += [(c, int(k)) for k in mixed(whole ^ drop)]
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table_ = shared.value
        names = ["doc_id", "n", "digest", "sketch", "wide", "prefix", "subsets"]
        for batch in batches:
            for ids, texts in chunks(lazily(batch.column("doc_id")), lazily(batch.column("text"))):
                rows = []
                for doc_id, s in zip(ids, shingle_sets(texts, words), strict=True):
                    if doc_id is None or not len(s):
                        continue
                    prefix: list[int] = []
                    if len(s) >= least_listed:
                        order = np.lexsort((s, table_[(s % np.uint64(COUNTERS)).astype(np.int64)]))
                        prefix = s[order[: prefix_length(len(s), percent)]].view(np.int64).tolist()
                    subsets = [{"c": c, "key": k - (1 << 64) if k >= 1 << 63 else k} for c, k in keys_of(s)] if len(s) <= boundary else []
                    sketch = np.minimum(np.bincount((s >> np.uint64(20)).astype(np.int64) % BUCKETS, minlength=BUCKETS), 65535).astype("<u2").tobytes()
                    wide = np.minimum(np.bincount((s >> np.uint64(40)).astype(np.int64) % WIDE, minlength=WIDE), 255).astype("<u1").tobytes()
                    rows.append((doc_id, len(s), hashlib.blake2b(s.tobytes(), digest_size=16).digest(), sketch, wide, prefix, subsets))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 7
                kinds = [pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.struct([("c", pa.int32()), ("key", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return docs.mapInArrow(lambda b: trimmed(run(b)), "doc_id long, n long, digest binary, sketch binary, wide binary, prefix array<long>, subsets array<struct<c: int, key: long>>")


def light_links(sets: DataFrame, percent: int) -> DataFrame:
    """Exact links (a, b) between light sets: each set of a key group to the group's smallest one."""
    keys = sets.select("node", "n", F.explode("subsets").alias("k")).select("node", "n", "k.c", "k.key")
    least = keys.groupBy("c", "key").agg(F.min(F.struct("n", "node")).alias("m"), F.count(F.lit(1)).alias("many")).filter("many > 1").select("c", "key", "m")
    met = skewed_join(keys, least, ["c", "key"]).filter("node <> m.node")
    # c shared shingles are enough for sizes that ask for no more
    enough = F.col("c") * (100 + percent) >= percent * (F.col("n") + F.col("m.n"))
    return met.filter(enough).select(F.col("m.node").alias("a"), F.col("node").alias("b"))


LISTED = "token long, node long, head long, before long, place long, n long, pos long"


def hot_tokens(entries: DataFrame, block: int) -> DataFrame:
    """(token, parts) of lists of a thousandth of all entries and of more than ``block``: 1,000 rows at most."""
    total = entries.count()
    hot = entries.groupBy("token").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(block, total // 1000))
    return saved(hot.select("token", F.ceil(F.col("n") / block).cast("long").alias("parts")), "join-hot")


def shared_tokens(entries: DataFrame, hot: DataFrame) -> DataFrame:
    """Entries of lists with two or more: token, node, first node of the list, the one before, place in the list.

    A stream over sorted lists; nothing is gathered, however long a list is.  ``hot`` lists are dealt out to several
    tasks in parts with firsts of their own.
    """
    part = F.coalesce(F.pmod(F.xxhash64("node"), F.col("parts")), F.lit(-1))
    entries = entries.join(F.broadcast(hot), "token", "left").select("token", "node", part.alias("part"), "n", "pos")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry: pa.Table | None = None
        last: tuple | None = None  # token, part, node, head, place of the last row that was decided
        names = [c.split()[0] for c in LISTED.split(", ")]

        def decided(t: pa.Table, upto: int) -> pa.RecordBatch:
            nonlocal last
            token, part, node = (t.column(c).to_numpy() for c in ("token", "part", "node"))
            other = (token[1:] != token[:-1]) | (part[1:] != part[:-1])
            new = np.concatenate([[last is None or (token[0], part[0]) != last[:2]], other])
            start = np.maximum.accumulate(np.where(new, np.arange(len(token)), -1))
            head = np.where(start >= 0, node[start], last[3] if last else 0)
            place = np.where(start >= 0, np.arange(len(token)) - start, np.arange(len(token)) + (last[4] + 1 if last else 0))
            before = np.concatenate([[last[2] if last else 0], node[:-1]])
            followed = np.concatenate([~other, [False]])
            keep = (place > 0) | followed | (part >= 0)
            keep[upto:] = False
            if upto:
                k = upto - 1
                last = (token[k], part[k], node[k], head[k], place[k])
            cols = [token, node, head, np.where(place > 0, before, node), place, t.column("n").to_numpy(), t.column("pos").to_numpy()]
            return pa.RecordBatch.from_arrays([pa.array(c[keep].astype(np.int64)) for c in cols], names=names)

        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if carry is None else pa.concat_tables([carry, t]).combine_chunks()
            if len(t) > 1:
                yield decided(t, len(t) - 1)  # whether the last row has a follower is not known yet
                carry = t.slice(len(t) - 1)
            else:
                carry = t
        if carry is not None and len(carry):
            yield decided(carry, len(carry))

    order = F.xxhash64("node", F.pmod("token", F.lit(ORDERS)))
    return entries.repartition("token", "part").sortWithinPartitions("token", "part", order, "node").mapInArrow(run, LISTED)


def near_sketches(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of distinct pairs (a, b) those that sizes and both count sketches allow to be linked."""
    for name, kind, buckets in (("sketch", "<u2", BUCKETS), ("wide", "<u1", WIDE)):
        pairs = _within(pairs, sets.select("node", "n", F.col(name).alias("sketch")), percent, kind, buckets)
    return pairs


def _within(pairs: DataFrame, sets: DataFrame, percent: int, kind: str, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not len(batch):
                continue
            p, q = (np.frombuffer(b"".join(batch.column(c).to_pylist()), kind).reshape(len(batch), buckets).astype(np.int32) for c in ("p", "q"))
            m, n = batch.column("m").to_numpy(), batch.column("n").to_numpy()
            keep = np.abs(p - q).sum(axis=1) <= m + n - 2 * needed_overlap(m, n, percent)
            yield batch.select(["a", "b"]).filter(pa.array(keep))

    left = sets.select(F.col("node").alias("a"), F.col("n").alias("m"), F.col("sketch").alias("p"))
    right = sets.select(F.col("node").alias("b"), "n", F.col("sketch").alias("q"))
    sized = pairs.join(left, "a").join(right, "b").filter(100 * F.least("m", "n") >= percent * F.greatest("m", "n"))
    return sized.select("a", "b", "m", "n", "p", "q").mapInArrow(run, "a long, b long")


def _pairs(n, pos, root, sketch, cross: int | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of different roots that size, place in the prefix and sketch allow, with the distance that is left.

    cross: the first ``cross`` rows meet the others only.
    """
    rows = len(n)
    out_a, out_b, left = [], [], []
    last = cross if cross is not None else rows
    for i in range(last):
        j = np.arange(cross, rows) if cross is not None else np.arange(i + 1, rows)
        low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
        overlap = needed_overlap(n[i], n[j], percent)
        # a linked pair has all it shares from its first common token on, and is found in that token's list
        fits = (pos[i] <= n[i] - overlap) & (pos[j] <= n[j] - overlap)
        j = j[(root[i] != root[j]) & (100 * low >= percent * high) & fits]
        if len(j):
            distance = np.abs(sketch[i] - sketch[j]).sum(axis=1)
            room = n[i] + n[j] - 2 * needed_overlap(n[i], n[j], percent) - distance
            out_a.append(np.full(int((room >= 0).sum()), i))
            out_b.append(j[room >= 0])
            left.append(room[room >= 0])
    if not out_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(out_a), np.concatenate(out_b), np.concatenate(left)


def _forest(a: np.ndarray, b: np.ndarray, left: np.ndarray, root: np.ndarray) -> np.ndarray:
    """Of the pairs (rows a, b) those, the likeliest first, that tie roots which no pair before has tied: fewer than there are roots."""
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    keep, missing = [], len(np.unique(root)) - 1
    for k in np.argsort(-left, kind="stable").tolist():
        x, y = top(int(root[a[k]])), top(int(root[b[k]]))
        if x != y:
            above[y] = x
            keep.append(k)
            if len(keep) == missing:
                break
    return np.array(keep, np.int64)


def _runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Consecutive rows of equal keys; callers bound the size of such runs."""
    carry: pa.Table | None = None
    for batch in batches:
        t = pa.Table.from_batches([batch])
        t = t if carry is None else pa.concat_tables([carry, t]).combine_chunks()
        if not len(t):
            continue
        change = np.zeros(len(t) - 1, bool)
        for k in keys:
            x = t.column(k).to_numpy()
            change |= x[1:] != x[:-1]
        cut = np.flatnonzero(change) + 1
        at = np.concatenate([[0], cut])
        for a, b in zip(at[:-1], at[1:], strict=True):
            yield t.slice(a, b - a)
        carry = t.slice(at[-1])
    if carry is not None and len(carry):
        yield carry


def linear_candidates(lists: DataFrame, hot: DataFrame) -> DataFrame:
    """Of every list: each entry with the first entry and with its predecessor; of hot lists also the firsts of all parts with the first of one."""
    firsts = lists.filter("place = 0").join(F.broadcast(hot), "token")  # one row per part
    lead = firsts.groupBy("token").agg(F.min("node").alias("other"))
    lists = lists.select("node", "before", "head", "place").unionByName(firsts.join(lead, "token").filter("node <> other").select("node", F.col("other").alias("before"), F.col("other").alias("head"), F.lit(1).cast("long").alias("place")))
    both = lists.filter("place > 0").select("node", F.explode(F.array_distinct(F.array("before", "head"))).alias("other"))
    return both.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()


def reaching(lists: DataFrame, percent: int) -> DataFrame:
    """Entries of lists with several roots whose place leaves room for the overlap with the smallest set of the list.

    Tokens stand in one order in all prefixes, so a set of size n whose first token in common with a linked one is at ``pos``
    shares at most n - pos: the pair is found in that token's list, and entries further back are not needed for it.
    Lists of fewer than four have no pairs but the linear ones.
    """
    spread = saved(lists.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.min("n").alias("least")).filter("lo <> hi and many >= 4"), "join-spread")
    if not spread.take(1):
        return lists.select("token", "node", "root", "n", "pos").filter("false")
    other = f"greatest(least, (n * {percent} + 99) div 100)"
    room = f"pos <= n - ({percent} * (n + {other}) + {99 + percent}) div {100 + percent}"
    return skewed_join(lists, spread.select("token", "least"), ["token"]).filter(room).select("token", "node", "root", "n", "pos")


def open_candidates(lists: DataFrame, sets: DataFrame, percent: int, block: int, forest: bool = False) -> DataFrame:
    """Pairs (a, b) of different roots in one list that size, place and sketch allow.  ``lists``: what ``reaching`` leaves; ``sets``: node, wide.

    Only lists with several roots are dealt out, a list of more than ``block`` entries in pairs of blocks.  ``forest``: of
    each block only pairs that tie its roots together, fewer than its entries; most links of large groups are found so,
    and what is apart afterwards needs all its pairs.
    """
    spread = lists.groupBy("token").agg(F.count(F.lit(1)).alias("many"), F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi")
    sized = saved(spread.select("token", F.ceil(F.col("many") / block).cast("int").alias("blocks")), "join-sized")
    if not sized.take(1):
        return lists.select(F.col("node").alias("a"), F.col("node").alias("b")).filter("false")
    wide = skewed_join(lists, sized, ["token"]).join(sets.select("node", F.col("wide").alias("sketch")), "node")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    placed = wide.withColumn("own", own).withColumn("o", F.col("own") if forest else F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = placed.select("token", F.least("own", "o").alias("i"), F.greatest("own", "o").alias("j"), "own", "node", "n", "pos", "root", "sketch")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches, ["token", "i", "j"]):
            if len(t) < 2:
                continue
            node, n, pos, root, own = (t.column(c).to_numpy() for c in ("node", "n", "pos", "root", "own"))
            sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), "<u1").reshape(len(t), WIDE).astype(np.int16)
            i, j = t.column("i")[0].as_py(), t.column("j")[0].as_py()
            a, b, left = _pairs(n, pos, root, sketch, int((own == i).sum()) if i != j else None, percent)
            if forest:
                some = _forest(a, b, left, root)
                a, b = a[some], b[some]
            a, b = node[a], node[b]
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    found = cells.repartition("token", "i", "j").sortWithinPartitions("token", "i", "j", "own").mapInArrow(run, "a long, b long")
    return found.distinct()


def bit_filter(wanted: DataFrame, value: Column) -> tuple[int, Broadcast]:
    """A bit at ``value`` modulo their number for every row of ``wanted``: the number of bits, and their 64-bit words.

    16 bits per row, up to 2**31 bits (256 MB); beyond that it lets more values through.  ``wanted`` is read twice, so it should be a table.
    """
    spark = wanted.sparkSession
    bits = 1 << min(31, max(16, (16 * wanted.count()).bit_length()))
    at = F.pmod(value, F.lit(bits))
    words64 = wanted.groupBy((at / 64).cast("int").alias("w")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (at % 64).cast("int"))).alias("b"))
    filter_ = np.zeros(bits // 64, np.int64)
    # as many rows as the filter has words, fetched a partition at a time: few, as each is a job of its own
    for r in words64.coalesce(HANDING).toLocalIterator():
        filter_[r["w"]] = r["b"]
    return bits, spark.sparkContext.broadcast(filter_)


def without(docs: DataFrame, lost: DataFrame) -> DataFrame:
    """``docs`` but the rows whose doc_id is in ``lost(doc_id)``, a table of distinct ids.

    Texts of the rows that stay are not shuffled: a bit filter finds nearly all of them where they are, and only rows that it
    lets through (those of ``lost`` and about one in 16 others) meet the ids themselves.
    """
    gone, maybe = free_name(docs, "gone"), free_name(docs, "maybe")
    place = F.xxhash64(F.col("doc_id").cast("long"))
    bits, shared = bit_filter(lost, place)

    def let_through(at: pd.Series) -> pd.Series:
        at = at.to_numpy()
        return pd.Series((shared.value[at // 64] >> (at % 64)) & 1 == 1)

    marked = docs.withColumn(maybe, F.pandas_udf(let_through, "boolean")(F.pmod(place, F.lit(bits))))
    ids = lost.select(F.col("doc_id").alias(gone))
    doubtful = marked.filter(maybe).join(ids, F.col("doc_id") == F.col(gone), "left_anti")
    return marked.filter(~F.col(maybe)).unionByName(doubtful).drop(maybe)


def verified(pairs: DataFrame, docs: DataFrame, sets: DataFrame, words: int, percent: int, name: str) -> DataFrame:
    """Pairs (a, b) of nodes whose whole shingle sets are linked.  ``sets``: node, digest and the least doc_id that has the set.

    The scan computes sets only of documents whose id a bit filter lets through (it may let others through, never
    holds one back), so texts are not shuffled; only the sets of candidates are.  The join drops those of others.
    """
    spark = docs.sparkSession
    pairs = saved(pairs, f"{name}-pairs")
    if not pairs.take(1):
        return pairs
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = saved(nodes.join(sets.select("node", "digest", "low"), "node"), f"{name}-wanted")
    bits, shared = bit_filter(wanted, F.col("low"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(-1).to_numpy()
            where = ids % bits
            keep = ((shared.value[where // 64] >> (where % 64)) & 1).astype(bool) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            batch = batch.filter(pa.array(keep))
            for own, texts in chunks(lazily(batch.column("doc_id")), lazily(batch.column("text"))):
                sets_ = list(shingle_sets(texts, words))
                digests = [hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets_]
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(digests, pa.binary()), pa.array([s.tobytes() for s in sets_], pa.binary())], names=["low", "digest", "s"])

    # rows that repeat id and text become one before they are shuffled
    each = docs.mapInArrow(lambda b: trimmed(found(b)), "low long, digest binary, s binary").groupBy("digest", "low").agg(F.first("s").alias("s"))
    known = saved(each.join(wanted, ["digest", "low"]).select("node", "s"), f"{name}-sets")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(lazily(batch.column("x")), lazily(batch.column("y")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(x) + len(y) - len(np.unique(np.concatenate([x, y])))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    joined = pairs.join(known.select(F.col("node").alias("a"), F.col("s").alias("x")), "a").join(known.select(F.col("node").alias("b"), F.col("s").alias("y")), "b")
    return saved(joined.select("a", "b", "x", "y").mapInArrow(lambda b: trimmed(check(b)), "a long, b long"), f"{name}-links")


def merged(roots: DataFrame, links: DataFrame, name: str) -> DataFrame:
    """``roots`` (what ``components`` returns) after ``links(a, b)`` more; their stars stand for all links before."""
    if not links.take(1):
        return roots
    return components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(links), name)


def near_copies(docs: DataFrame, words: int = 3, percent: int = 90, list_cost: float = 8.0, block: int = BLOCK) -> DataFrame:
    """One row per row of ``docs(doc_id, text)``: doc_id, n_shingles, component_id (least doc_id of its group)."""
    out = _grouped(docs, words, percent, list_cost, block)
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id")


def _grouped(docs: DataFrame, words: int, percent: int, list_cost: float, block: int) -> DataFrame:
    """doc_id, n, digest (of the shingle set), component_id."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    rows = saved(sizes_and_digests(docs, words), "join-rows")
    counts = corpus_counts(rows)
    each = rows.filter("kind = 0").select("doc_id", "n", "digest")
    histogram = {r["n"]: r["count"] for r in each.filter(F.col("n").between(1, MAX_LIGHT)).groupBy("n").count().collect()}
    boundary = choose_boundary(histogram, percent, list_cost)
    signed = signatures(docs, words, percent, counts, boundary)
    # of rows with equal sets one stays (any: their signatures are equal); it gets a number when it is written
    one = signed.groupBy("digest").agg(F.min("doc_id").alias("low"), *[F.first(c).alias(c) for c in ("n", "sketch", "wide", "prefix", "subsets")])
    sets = saved(one.withColumn("node", F.monotonically_increasing_id()), "join-sets")
    light = saved(light_links(sets, percent), "join-light")
    entries = sets.select("node", "n", F.posexplode("prefix").alias("pos", "token")).withColumn("pos", F.col("pos").cast("long"))
    hot = hot_tokens(entries, block)
    lists = saved(shared_tokens(entries, hot), "join-shared")
    first = verified(near_sketches(linear_candidates(lists, hot), sets, percent), docs, sets, words, percent, "join-linear")
    roots = components(light.unionByName(first), "join-first")
    rooted = lists.select("token", "node", "n", "pos").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    apart = saved(reaching(saved(rooted, "join-lists"), percent), "join-reaching")
    tied = verified(open_candidates(apart, sets, percent, block, forest=True), docs, sets, words, percent, "join-forest")
    roots = merged(roots, tied, "join-second")
    apart = saved(apart.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "join-apart")
    second = verified(open_candidates(apart, sets, percent, block), docs, sets, words, percent, "join-open")
    groups = merged(roots, second, "join-all")
    member = saved(groups.join(sets.select("node", "digest", "low"), "node"), "join-member")
    least = member.groupBy("root").agg(F.min("low").alias("component_id"))
    grouped = skewed_join(member, least, ["root"]).select("digest", "component_id")
    alone = sets.join(member.select("node"), "node", "left_anti").select("digest", F.col("low").alias("component_id"))
    leader = saved(grouped.unionByName(alone), "join-leader")
    # blank documents and those without an id share digests but no group
    inside = F.col("n").isNotNull() & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    out = skewed_join(each.filter(inside), leader, ["digest"]).select("doc_id", "n", "digest", "component_id")
    return out.unionByName(each.filter(~inside).withColumn("component_id", F.col("doc_id")))


def drop_near_copies(docs: DataFrame, words: int = 5, percent: int = 80, list_cost: float = 8.0, block: int = BLOCK) -> DataFrame:
    """Pipeline stage: of each group the documents with the least doc_id stay, unchanged.

    Rows that repeat a doc_id share its fate: all stay if one of them does, so a row is never lost to a namesake.
    """
    columns = [F.col(f"`{c}`") for c in docs.columns]
    groups = saved(_grouped(docs, words, percent, list_cost, block).filter("doc_id is not null").select("doc_id", (F.col("doc_id") != F.col("component_id")).alias("copy")), "join-verdicts")
    lost = saved(groups.groupBy("doc_id").agg(F.bool_and("copy").alias("copy")).filter("copy").select("doc_id"), "join-lost")
    return without(docs, lost).select(*columns)


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))
