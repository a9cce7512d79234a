"""Threshold-scaled sketches: of a text's shingle hashes all below a fixed fraction of the hash range are kept.

Shingles are five words (case folded A-Z); a shorter text is one shingle, a text without words has none.
A text of which no hash lies below the threshold keeps its smallest one, so only texts without words have an
empty sketch.  Sketches merge by union (a lone hash above the threshold goes if any lies below), and
containment of very unequal texts is estimated on the kept hashes alone, whatever their sizes.

Defined cases: null is the empty text; two empty sketches have likeness 1, one empty and one not 0; equal texts
have equal sketches; ties of doc_id are ordered by the text; a null doc_id comes after all others in
descending order; an empty table gives an empty result; in a table of one row the next row is the row itself; extra
columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucket_of, range_bounds, ship_package, table
from .textops import CHUNK_BYTES, shingle_sets

WORDS = 5
#: the kept fraction is 1 / SCALE
SCALE = 4
#: bytes of a kept hash that a fingerprint stores (the highest ones)
KEPT_BYTES = 5


def sketch(hashes: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """Sorted kept hashes, cut to their highest KEPT_BYTES bytes, of sorted distinct 64-bit hashes."""
    below = hashes[: np.searchsorted(hashes, np.uint64((1 << 64) // scale))]
    kept = below if len(below) else hashes[:1]
    return np.unique(kept >> np.uint64(64 - 8 * KEPT_BYTES))


def merge(a: np.ndarray, b: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """The sketch of the union of two texts' shingles."""
    both = np.union1d(a, b)
    below = both[both < (1 << 8 * KEPT_BYTES) // scale]
    return below if len(below) else both[:1]


def to_string(kept: np.ndarray) -> str:
    data = kept.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - KEPT_BYTES :]
    return base64.b64encode(data.tobytes()).decode("ascii")


def from_string(text: str) -> np.ndarray:
    data = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, KEPT_BYTES)
    wide = np.zeros((len(data), 8), np.uint8)
    wide[:, 8 - KEPT_BYTES :] = data
    return wide.view(">u8").ravel().astype(np.uint64)


def containment(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of the shingles of a that b has."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    return len(np.intersect1d(a, b, assume_unique=True)) / len(a)


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def sketches(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    part: list[bytes] = []
    size = 0
    for t in texts:
        data = t.encode("utf-8", "surrogatepass")
        if part and size + len(data) > CHUNK_BYTES:
            out += [sketch(x) for x in shingle_sets(part, WORDS)]
            part, size = [], 0
        part.append(data)
        size += len(data) + 1
    if part:
        out += [sketch(x) for x in shingle_sets(part, WORDS)]
    return out


def fingerprints(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with a column ``fingerprint``; the general operator, one narrow pass without a shuffle."""
    ship_package(docs.sparkSession)
    fields = [f for f in docs.schema.fields if f.name != "fingerprint"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [to_string(s) for s in sketches([t or "" for t in batch.column(text).to_pylist()])]
            yield pa.RecordBatch.from_arrays([*[batch.column(f.name) for f in fields], pa.array(got, pa.string())], names=[*[f.name for f in fields], "fingerprint"])

    return docs.select(*[F.col(f"`{f.name}`") for f in fields]).mapInArrow(run, T.StructType([*fields, T.StructField("fingerprint", T.StringType())]))


def with_lookahead(docs: DataFrame, rows_per_bucket: int = 4096) -> DataFrame:
    """``docs(doc_id, text)`` dealt by descending doc_id, with (bucket, ahead): one shuffle of the texts.

    Buckets have exact id bounds.  The first row of each bucket is also sent, marked ``ahead``, behind the last
    row of the bucket before (and the first of all behind the last of all), so each task knows every row's next one.
    """
    total = docs.count()
    per_bucket = max(rows_per_bucket, -(-total // 20_000))
    bounds = range_bounds(docs.select("doc_id"), [F.col("doc_id")], "doc_id", per_bucket, "fp-ids")
    last = len(bounds)
    bucket = F.when(F.col("doc_id").isNull(), last).otherwise(F.lit(last) - bucket_of(F.col("doc_id"), bounds))
    rows = docs.select("doc_id", "text", bucket.cast("int").alias("bucket"))
    # the first row of a bucket: its largest id, and of equal ids the largest text hash
    order = F.struct(F.coalesce(F.col("doc_id"), F.lit(-(1 << 62))).alias("i"), F.xxhash64("text").alias("x"))
    narrow = docs.select("doc_id", bucket.cast("int").alias("bucket"))
    top = narrow.groupBy("bucket").agg(F.max(F.coalesce(F.col("doc_id"), F.lit(-(1 << 62)))).alias("i"))
    tops = {r["bucket"]: r["i"] for r in top.collect()}  # one id per bucket, 20,001 at most
    used = sorted(tops)
    if not used:
        return rows.withColumn("ahead", F.lit(False)).withColumn("x", F.lit(0).cast("long"))
    heads = docs.sparkSession.createDataFrame([(tops[b], used[k - 1]) for k, b in enumerate(used)], "head long, before int")
    keyed = rows.withColumn("k", order["i"]).withColumn("x", order["x"])
    joined = keyed.join(F.broadcast(heads), F.col("k") == F.col("head"), "left")
    to = F.when(F.col("before").isNull(), F.array(F.struct(F.col("bucket"), F.lit(False).alias("ahead")))).otherwise(F.array(F.struct(F.col("bucket"), F.lit(False).alias("ahead")), F.struct(F.col("before").alias("bucket"), F.lit(True).alias("ahead"))))
    dealt = joined.select("k", "x", "doc_id", "text", F.explode(to).alias("to")).select("to.bucket", "to.ahead", "k", "x", "doc_id", "text")
    return dealt.repartitionById(last + 1, "bucket").sortWithinPartitions("bucket", "ahead", F.col("k").desc(), F.col("x").desc())


def edited(text: str, following: str) -> str:
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, jaccard_edited double, jaccard_next double"


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a bucket in order, then the rows marked ahead (the first of them is the next row)."""
    held: list[tuple] = []  # (doc_id, text, bucket) whose next text is not known yet: one row
    ready: list[tuple] = []
    done = None  # bucket whose next row has come

    def flush() -> pa.RecordBatch:
        own = [r[1] for r in ready]
        nexts = [r[2] for r in ready]
        new = [edited(a, b) for a, b in zip(own, nexts, strict=True)]
        mine, changed = sketches(own), sketches(new)
        # a row's next row mostly is the following one: its sketch is computed once
        after: list = [mine[i + 1] if i + 1 < len(own) and own[i + 1] == nexts[i] else None for i in range(len(own))]
        missing = [i for i, x in enumerate(after) if x is None]
        for i, x in zip(missing, sketches([nexts[i] for i in missing]), strict=True):
            after[i] = x
        cols = [
            pa.array([r[0] for r in ready], pa.int64()),
            pa.array([len(t) for t in own], pa.int64()),
            pa.array([hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new], pa.string()),
            pa.array([to_string(s) for s in mine], pa.string()),
            pa.array([to_string(s) for s in changed], pa.string()),
            *[pa.array([f(a, b) for a, b in zip(mine, other, strict=True)], pa.float64()) for f in (containment, jaccard) for other in (changed, after)],
        ]
        ready.clear()
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in RESULT.split(", ")])

    size = 0
    for batch in batches:
        for doc_id, text, bucket, ahead in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "bucket", "ahead")), strict=True):
            text = text or ""
            if ahead and done == bucket:
                continue
            if held:
                ready.append((held[0][0], held[0][1], text))
                size += len(held[0][1])
                held.clear()
            if ahead:
                done = bucket
            else:
                held.append((doc_id, text))
            if size > CHUNK_BYTES // 2 or len(ready) >= 2000:
                yield flush()
                size = 0
    if ready:
        yield flush()


def compare_neighbours(docs: DataFrame) -> DataFrame:
    ship_package(docs.sparkSession)
    return with_lookahead(docs.select("doc_id", "text")).select("doc_id", "text", "bucket", "ahead").mapInArrow(_compare, RESULT)


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_neighbours(table(spark, sf_dir, "documents"))
