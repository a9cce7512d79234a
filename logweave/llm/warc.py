"""Deterministic sharded WARC writer and reader.

Pages are dealt into shards by exact, repeatable page_id bounds and sorted inside them.  Each task writes its shard as
gzip members, one per record, rolls to a new file once the compressed size passes ``file_bytes``, regenerates
headers and digests, and gives each file a temporary name until it is complete.  The job's result is the
manifest (one row per file); the manifest, written last by Spark's own commit, is what makes files count, so a task that
ran twice or died leaves nothing that is read.  Equal pages give equal bytes: names, dates and record ids
come from the rows and parameters only.

A payload is the html in UTF-8.  Of records with equal payloads the one with the largest page_id is a ``response``, the
others are ``revisit`` records that name it (payloads below ``min_revisit_bytes`` are always responses).

Defined cases: null html is an empty payload; a null url is written as an empty target; a null page_id sorts first and
comes back as null; of rows with equal page_id and payload one is the response and the rest revisit it; an empty table
writes no file and reads as an empty result; extra columns are not written.
"""

from __future__ import annotations

import base64
import hashlib
import io
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bucket_of, range_bounds, saved, scratch_path, ship_package, skewed_join, table
from .textops import lazily

DATE = "2024-01-01T00:00:00Z"
MANIFEST = "file string, shard int, first_page long, last_page long, n_records long, n_bytes long, sha256 string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, file string, offset long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode("ascii")


def record_id(page_id: int | None, digest: str, copy: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{copy}')}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, copy: int, date: str = DATE) -> bytes:
    """One WARC/1.1 record.  Revisits hold the HTTP header block only."""
    digest = base32_sha1(payload)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    target = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page_id, digest, copy)),
        ("WARC-Date", date),
        ("WARC-Target-URI", target),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    if revisit:
        fields.append(("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"))
        fields.append(("X-Payload-Length", str(len(payload))))
        if refers_to is not None:
            fields += [("WARC-Refers-To", record_id(refers_to, digest, 0)), ("X-Refers-To-Page-Id", str(refers_to))]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return head.encode("utf-8", "surrogatepass") + block + b"\r\n\r\n"


def gzip_member(data: bytes, level: int) -> bytes:
    """A gzip member without time or name, so equal data give equal bytes."""
    z = zlib.compressobj(level, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _File:
    """A file under a temporary name; ``close`` gives it its own name and returns its manifest row."""

    def __init__(self, fs, folder: str, shard: int, number: int):
        self.fs, self.shard = fs, shard
        self.name = f"shard-{shard:06d}-{number:05d}.warc.gz"
        self.path, self.temporary = f"{folder}/{self.name}", f"{folder}/_tmp-{uuid.uuid4().hex}-{self.name}"
        self.out = fs.open_output_stream(self.temporary, compression=None)
        self.sha, self.size, self.records, self.first, self.last = hashlib.sha256(), 0, 0, None, None

    def write(self, page_id: int | None, data: bytes) -> None:
        self.out.write(data)
        self.sha.update(data)
        self.size += len(data)
        self.first = page_id if not self.records else self.first
        self.last = page_id
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        self.fs.move(self.temporary, self.path)  # a second run of the task puts the same bytes there
        return {"file": self.name, "shard": self.shard, "first_page": self.first, "last_page": self.last, "n_records": self.records, "n_bytes": self.size, "sha256": self.sha.hexdigest()}


def _write(batches: Iterator[pa.RecordBatch], folder: str, file_bytes: int, level: int, date: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs as pafs

    store, base = pafs.FileSystem.from_uri(folder)
    kind = pa.schema([("file", pa.string()), ("shard", pa.int32()), ("first_page", pa.int64()), ("last_page", pa.int64()), ("n_records", pa.int64()), ("n_bytes", pa.int64()), ("sha256", pa.string())])
    out: _File | None = None
    number, last, told = 0, (object(), "", 0), (object(), "", None)
    done: list[dict] = []
    for batch in batches:
        columns = [lazily(batch.column(c), 50) for c in ("page_id", "url", "html", "digest", "refers", "copies", "shard", "kind")]
        for page_id, url, html, digest, refers, copies, shard, kind_of in zip(*columns, strict=True):
            if kind_of == 0:
                told = (page_id, digest, refers)
                continue
            copies = told[:2] == (page_id, digest)
            refers = told[2] if copies else None
            payload = (html or "").encode("utf-8", "surrogatepass")
            copy = last[2] + 1 if last[:2] == (page_id, digest) else 0
            last = (page_id, digest, copy)
            revisit = copies and not (copy == 0 and page_id == refers)
            data = gzip_member(record_bytes(page_id, url, payload, refers, revisit, copy, date), level)
            if out is not None and (out.shard != shard or out.size + len(data) > file_bytes and out.records):
                done.append(out.close())
                number = number + 1 if out.shard == shard else 0
                out = None
            if out is None:
                out = _File(store, base, shard, number)
            out.write(page_id, data)
    if out is not None:
        done.append(out.close())
    yield pa.RecordBatch.from_pylist(done, schema=kind)


def write_warc(pages: DataFrame, folder: str, file_bytes: int = 64 << 20, rows_per_shard: int = 4096, min_revisit_bytes: int = 0, level: int = 6, date: str = DATE) -> DataFrame:
    """Write ``pages(page_id, url, html)`` as archives into ``folder`` (a URI that pyarrow's file systems open) and return the manifest.

    Shuffles: sizes and ids by digest, the verdicts of repeated payloads by page_id and digest, and whole rows once, by page_id,
    together with their verdicts.
    """
    spark = pages.sparkSession
    ship_package(spark)
    from pyarrow import fs as pafs

    store, base = pafs.FileSystem.from_uri(folder)
    store.create_dir(base, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html", F.sha1(F.coalesce("html", F.lit("")).cast("binary")).alias("digest"))
    narrow = saved(rows.select("page_id", "digest", F.octet_length(F.coalesce("html", F.lit(""))).alias("size")), "warc-narrow")
    able = narrow.filter(F.col("size") >= min_revisit_bytes)
    repeated = saved(able.groupBy("digest").agg(F.max("page_id").alias("refers"), F.count(F.lit(1)).alias("copies")).filter("copies > 1"), "warc-repeated")
    total = narrow.count()
    bounds = range_bounds(narrow.select("page_id"), [F.col("page_id")], "page_id", max(rows_per_shard, -(-total // 20_000)), "warc-ids")
    shard = F.when(F.col("page_id").isNull(), 0).otherwise(bucket_of(F.col("page_id"), bounds)).cast("int").alias("shard")
    # a verdict goes before the pages that it is about, so pages are dealt out by page_id only, however many share a payload
    verdicts = skewed_join(able.select("page_id", "digest"), repeated, ["digest"]).distinct()
    heads = verdicts.select(shard, "page_id", "digest", F.lit(0).alias("kind"), "refers", "copies", F.lit(None).cast("string").alias("url"), F.lit(None).cast("string").alias("html"))
    wide = rows.select(shard, "page_id", "digest", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("refers"), F.lit(None).cast("long").alias("copies"), "url", "html")
    dealt = heads.unionByName(wide).repartitionById(len(bounds) + 1, "shard").sortWithinPartitions("shard", F.col("page_id").asc_nulls_first(), "digest", "kind", "url")
    manifest = dealt.mapInArrow(lambda b: _write(b, folder, file_bytes, level, date), MANIFEST)
    manifest.write.parquet(f"{folder}/_manifest")
    return spark.read.parquet(f"{folder}/_manifest")


def members(stream, block: int = 1 << 20) -> Iterator[tuple[int, bytes]]:
    """(offset, content) of the gzip members of a stream; memory holds one record."""
    offset, data = 0, b""
    while True:
        z, out, used = zlib.decompressobj(31), io.BytesIO(), 0
        while not z.eof:
            if not data:
                data = stream.read(block)
                if not data:
                    if used:
                        raise ValueError("truncated gzip member")
                    return
            out.write(z.decompress(data))
            used += len(data) - len(z.unused_data)
            data = z.unused_data
        yield offset, out.getvalue()
        offset += used


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower-case names) and payload of a record; raises ValueError if digests or lengths are wrong."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
    block = rest[: int(fields["content-length"])]
    if len(block) != int(fields["content-length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("record has another length than it says")
    if fields["warc-block-digest"] != f"sha1:{base32_sha1(block)}":
        raise ValueError("block digest differs")
    payload = block.partition(b"\r\n\r\n")[2]
    if fields["warc-type"] == "response" and fields["warc-payload-digest"] != f"sha1:{base32_sha1(payload)}":
        raise ValueError("payload digest differs")
    return fields, payload


def _read(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs as pafs

    store, base = pafs.FileSystem.from_uri(folder)
    kind = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("file", pa.string()), ("offset", pa.int64())])
    for batch in batches:
        for name in batch.column("file").to_pylist():
            rows = []
            with store.open_input_stream(f"{base}/{name}", compression=None) as stream:
                for offset, data in members(stream):
                    f, payload = parse_record(data)
                    revisit = f["warc-type"] == "revisit"
                    number = lambda k: int(f[k]) if k in f else None
                    rows.append({"page_id": number("x-page-id"), "url": f["warc-target-uri"], "payload_bytes": number("x-payload-length") if revisit else len(payload), "payload_digest": f["warc-payload-digest"].removeprefix("sha1:"), "record_type": f["warc-type"], "refers_to": number("x-refers-to-page-id"), "file": name, "offset": offset})
                    if len(rows) >= 5000:
                        yield pa.RecordBatch.from_pylist(rows, schema=kind)
                        rows = []
            yield pa.RecordBatch.from_pylist(rows, schema=kind)


def read_warc(spark: SparkSession, folder: str) -> DataFrame:
    """All records of the files in the manifest, one row each."""
    ship_package(spark)
    files = spark.read.parquet(f"{folder}/_manifest").select("file", "shard")
    # as many tasks as files; a count that is given is not made smaller
    return files.repartition(max(1, files.count())).select("file").mapInArrow(lambda b: _read(b, folder), RECORD)


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "warc")
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
