"""Wire formats: RESP commands, length-prefixed frames, snapshot payloads.

Encoding stays in the JVM (``functions.bytes``); decoding variable-length bytes is a small Python helper in a
table function or a streaming pass over ordered chunks.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

MAX_ARGS = 1024
MAX_COMMAND = 1 << 20
MAX_FRAME = 10 << 20
#: no binary of Spark is longer
ANY_COMMAND = (1 << 31) - 1
OUT_BYTES = 64 << 20
FRAME_TYPES = range(6)
MAX_SENDER = (1 << 31) - 1
#: limits of replies: header line, bulk, array elements, nesting
MAX_HEADER, MAX_BULK, MAX_ITEMS, MAX_DEPTH = 1024, 8 << 20, 1024, 16


class Invalid(ValueError):
    """Bytes that no continuation makes valid."""


def _line(data: bytes, at: int, mark: bytes, most: int) -> tuple[int, int] | None:
    """(number, next position) of a ``mark``-prefixed decimal line; None if more bytes are needed."""
    if at < len(data) and data[at : at + 1] != mark:
        raise Invalid(f"expected {mark.decode()}")
    end = data.find(b"\r\n", at)
    digits = data[at + 1 : end if end >= 0 else len(data)]
    if end < 0 and digits.endswith(b"\r"):
        digits = digits[:-1]
    if digits.strip(b"0123456789") or len(digits) > 20:
        raise Invalid("bad length")
    if end < 0:
        return None
    if not digits or int(digits) > most:
        raise Invalid("bad length")
    return int(digits), end + 2


def parse_command(data: bytes, at: int = 0, most: int = MAX_COMMAND) -> tuple[list[bytes], int] | None:
    """(arguments, bytes used) of the command at ``at``; None if it is incomplete; raises Invalid, also beyond ``most`` bytes."""
    start, head = at, _line(data, at, b"*", MAX_ARGS)
    if head is None:
        return None
    n, at = head
    if not n:
        raise Invalid("empty command")
    args = []
    for _ in range(n):
        got = _line(data, at, b"$", most)
        if got is None:
            return None
        size, at = got
        if at - start + size + 2 > most:
            raise Invalid("command too large")
        if len(data) < at + size + 2:
            if len(data) > at + size and data[at + size : at + size + 1] != b"\r":
                raise Invalid("bulk without end")
            return None
        if data[at + size : at + size + 2] != b"\r\n":
            raise Invalid("bulk without end")
        args.append(data[at : at + size])
        at += size + 2
    return args, at - start


def _decoded(chunks: DataFrame, parse, kind: pa.Schema, ddl: str) -> DataFrame:
    """Rows of ordered ``chunks(conn, seq, bytes)``; ``parse(data, at)`` gives (rows, bytes used), None for more bytes, or raises Invalid.

    Each connection's chunks are read in order as a stream; only an incomplete message is carried along, and one that is
    still incomplete at the end gives no row.  After invalid bytes a connection yields one row with ``error`` and nothing more.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conn, tail, n, broken = None, b"", 0, False
        for batch in batches:
            rows, held = [], 0
            for c, data in zip(batch.column("conn").to_pylist(), batch.column("bytes").to_pylist(), strict=True):
                if c != conn:
                    conn, tail, n, broken = c, b"", 0, False
                if broken:
                    continue
                tail, at = tail + (data or b""), 0
                try:
                    while (got := parse(tail, at) if at < len(tail) else None) is not None:
                        rows += [{"conn": conn, "n": n, **r} for r in got[0]]
                        n, at, held = n + 1, at + got[1], held + got[1]
                        if held > OUT_BYTES:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows, held = [], 0
                except Invalid as bad:
                    rows.append({"conn": conn, "n": n, "error": str(bad)})
                    broken = True
                tail = tail[at:]
            yield pa.RecordBatch.from_pylist(rows, schema=kind)

    ordered = chunks.select(F.col("conn").cast("string").alias("conn"), "seq", "bytes").repartition("conn").sortWithinPartitions("conn", "seq")
    return ordered.select("conn", "bytes").mapInArrow(run, ddl)


def decode_commands(chunks: DataFrame, most: int = MAX_COMMAND) -> DataFrame:
    """Commands of ``chunks(conn, seq, bytes)``: conn, n, args, consumed, error.  One of more than ``most`` bytes is invalid."""

    def parse(data: bytes, at: int):
        got = parse_command(data, at, most)
        return None if got is None else ([{"args": got[0], "consumed": got[1]}], got[1])

    kind = pa.schema([("conn", pa.string()), ("n", pa.int64()), ("args", pa.list_(pa.binary())), ("consumed", pa.int64()), ("error", pa.string())])
    return _decoded(chunks, parse, kind, "conn string, n long, args array<binary>, consumed long, error string")


def decode_frames(chunks: DataFrame) -> DataFrame:
    """Frames of ``chunks(conn, seq, bytes)``: conn, n, type, sender, payload, error."""

    def parse(data: bytes, at: int):
        got = decode_frame(data[at:] if len(data) - at < 4 else data[at : at + 4 + struct.unpack_from(">I", data, at)[0]])
        return None if got is None else ([{"type": got[0], "sender": got[1], "payload": got[2]}], got[3])

    kind = pa.schema([("conn", pa.string()), ("n", pa.int64()), ("type", pa.int32()), ("sender", pa.int32()), ("payload", pa.binary()), ("error", pa.string())])
    return _decoded(chunks, parse, kind, "conn string, n long, type int, sender int, payload binary, error string")


def parse_reply(data: bytes, at: int = 0, path: str = "", depth: int = 0) -> tuple[list[dict], int] | None:
    """(rows, bytes used) of the reply at ``at``: a row for the reply and one for every element below it, with its path.

    Kinds: simple, error, bulk (with data), integer (with number), null, array (number is its size).
    """
    if depth > MAX_DEPTH:
        raise Invalid("nested too deep")
    end = data.find(b"\r\n", at)
    if end < 0:
        if len(data) - at > MAX_HEADER + 1:
            raise Invalid("header too long")
        return None
    mark, line, start = data[at : at + 1], data[at + 1 : end], at
    if len(line) + 2 > MAX_HEADER:
        raise Invalid("header too long")
    at = end + 2
    if mark in (b"+", b"-"):
        return [{"path": path, "kind": "simple" if mark == b"+" else "error", "data": line}], at - start
    if mark not in (b":", b"$", b"*") or not line.removeprefix(b"-").isdigit():
        raise Invalid("unknown kind or bad number")
    number = int(line)
    if mark == b":":
        return [{"path": path, "kind": "integer", "number": number}], at - start
    if number == -1:
        return [{"path": path, "kind": "null"}], at - start
    if not 0 <= number <= (MAX_BULK if mark == b"$" else MAX_ITEMS):
        raise Invalid("bad length")
    if mark == b"$":
        if len(data) < at + number + 2:
            return None
        if data[at + number : at + number + 2] != b"\r\n":
            raise Invalid("bulk without end")
        return [{"path": path, "kind": "bulk", "data": data[at : at + number]}], at + number + 2 - start
    rows = [{"path": path, "kind": "array", "number": number}]
    for i in range(number):
        got = parse_reply(data, at, f"{path}/{i}", depth + 1) if at < len(data) else None
        if got is None:
            return None
        rows += got[0]
        at += got[1]
    return rows, at - start


def decode_replies(chunks: DataFrame) -> DataFrame:
    """Replies of ``chunks(conn, seq, bytes)``: conn, n, path (empty for the reply itself), kind, data, number, error."""
    kind = pa.schema([("conn", pa.string()), ("n", pa.int64()), ("path", pa.string()), ("kind", pa.string()), ("data", pa.binary()), ("number", pa.int64()), ("error", pa.string())])
    return _decoded(chunks, parse_reply, kind, "conn string, n long, path string, kind string, data binary, number long, error string")


def swap_frames(data: bytes) -> tuple[bytes, int]:
    """A relay's reordering: the first two complete frames of a block change places; (bytes, bytes moved)."""
    first = decode_frame(data)
    second = decode_frame(data[first[3] :]) if first else None
    if second is None:
        return data, 0
    a, b = first[3], first[3] + second[3]
    return data[a:b] + data[:a] + data[b:], b


def count_commands(commands: DataFrame, arg: int) -> DataFrame:
    """Per connection of ``decode_commands``: n commands, n_bytes of their argument ``arg`` (null if none has it), n_errors."""
    fine = F.col("error").isNull()
    return commands.groupBy("conn").agg(F.count_if(fine).alias("n"), F.sum(F.octet_length(F.get("args", F.lit(arg)))).alias("n_bytes"), F.count_if(~fine).alias("n_errors"))


def encode_frame(kind: int, sender: int, payload: bytes) -> bytes:
    if kind not in FRAME_TYPES or not 0 <= sender <= MAX_SENDER or len(payload) > MAX_FRAME - 5:
        raise Invalid("bad frame header or size")
    return struct.pack(">IBI", len(payload) + 5, kind, sender) + payload


def decode_frame(data: bytes) -> tuple[int, int, bytes, int] | None:
    """(type, sender, payload, bytes used) of the first frame; None if incomplete; raises Invalid."""
    if len(data) < 4:
        return None
    size = struct.unpack(">I", data[:4])[0]
    if not 5 <= size <= MAX_FRAME:
        raise Invalid("bad frame length")
    if len(data) < 4 + size:
        return None
    kind, sender = struct.unpack(">BI", data[4:9])
    if kind not in FRAME_TYPES or sender > MAX_SENDER:
        raise Invalid("bad frame header")
    return kind, sender, data[9 : 4 + size], 4 + size


def encode_snapshot(pairs: list[tuple[bytes, bytes]]) -> bytes:
    """Count, then length-prefixed keys and values in key order."""
    out = [struct.pack(">I", len(pairs))]
    for k, v in sorted(pairs):
        out += [struct.pack(">I", len(k)), k, struct.pack(">I", len(v)), v]
    return b"".join(out)


def decode_snapshot(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """Pairs of a payload; raises Invalid on truncation or trailing bytes."""

    def piece(at: int) -> tuple[bytes, int]:
        if at + 4 > len(data):
            raise Invalid("truncated snapshot")
        size = struct.unpack_from(">I", data, at)[0]
        if at + 4 + size > len(data):
            raise Invalid("truncated snapshot")
        return data[at + 4 : at + 4 + size], at + 4 + size

    if len(data) < 4:
        raise Invalid("truncated snapshot")
    at = 4
    for _ in range(struct.unpack(">I", data[:4])[0]):
        k, at = piece(at)
        v, at = piece(at)
        yield k, v
    if at != len(data):
        raise Invalid("trailing bytes")


def snapshot_payloads(state: DataFrame, payload_bytes: int = 16 << 20) -> DataFrame:
    """Payloads of about ``payload_bytes`` of ``state(k binary, v binary)``, each a range of keys in order: (first_key, entries, payload).

    Spark's range partitions grow with the state; a task holds one payload's pairs (one pair at least).
    """

    def encoded(pairs: list) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"first_key": pa.array([pairs[0][0]], pa.binary()), "entries": pa.array([len(pairs)], pa.int64()), "payload": pa.array([encode_snapshot(pairs)], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, size = [], 0
        for batch in batches:
            for k, v in zip(batch.column("k").to_pylist(), batch.column("v").to_pylist(), strict=True):
                if pairs and size + len(k) + len(v) > payload_bytes:
                    yield encoded(pairs)
                    pairs, size = [], 0
                pairs.append((k, v))
                size += len(k) + len(v) + 8
        if pairs:
            yield encoded(pairs)

    return state.select("k", "v").repartitionByRange("k").sortWithinPartitions("k").mapInArrow(run, "first_key binary, entries long, payload binary")


def read_payloads(payloads: DataFrame) -> DataFrame:
    """(k, v) of snapshot payloads; a damaged payload fails the query, nothing of it is taken."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("payload").to_pylist():
                pairs = list(decode_snapshot(data))
                yield pa.RecordBatch.from_pydict({"k": pa.array([k for k, _ in pairs], pa.binary()), "v": pa.array([v for _, v in pairs], pa.binary())})

    return payloads.select("payload").mapInArrow(run, "k binary, v binary")


def peers(spark: SparkSession, text: str) -> DataFrame:
    """Members of ``id:host:port,...``: the id ends at the first colon, the port starts at the last."""
    one = F.explode(F.split(F.lit(text), ",")).alias("p")
    part = lambda i: F.regexp_extract("p", r"\A([0-9]+):(.*):([0-9]+)\z", i)
    return spark.range(1).select(one).select(part(1).try_cast("int").alias("id"), part(2).alias("host"), part(3).try_cast("int").alias("raft_port"))


def valid_peers(members: DataFrame, own_id: int) -> DataFrame:
    """``members``, or a failed query: ids are unique and not negative, hosts not empty, ports 1 to 65535, and ``own_id`` is a member."""
    fine = F.coalesce((F.col("id") >= 0) & (F.col("host") != "") & F.col("raft_port").between(1, 65535), F.lit(False))
    seen = members.agg(F.coalesce(F.bool_and(fine), F.lit(False)).alias("fine"), F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"), F.count_if(F.col("id") == own_id).alias("own")).first()
    if not seen["fine"] or seen["n"] != seen["ids"] or seen["own"] != 1:
        raise ValueError("invalid, duplicate or missing peers")
    return members


def archive_members(archives: DataFrame, allowed: str, max_bytes: int = 2_000_000) -> DataFrame:
    """(path, member, content) of tar archives read with the ``binaryFile`` source; ``allowed`` is a pattern of member names.

    A member that is no plain file or folder, whose name leaves the archive's folder, repeats or does not match, or that is larger than
    ``max_bytes`` fails the query.
    """
    import io
    import re
    import tarfile
    from pathlib import PurePosixPath

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                seen: set[str] = set()
                with tarfile.open(fileobj=io.BytesIO(content)) as tar:
                    for m in tar:
                        name = PurePosixPath(m.name)
                        if name.is_absolute() or ".." in name.parts or "\\" in m.name or m.name in seen:
                            raise Invalid(f"bad member {m.name}")
                        seen.add(m.name)
                        if m.isdir():
                            continue
                        if not m.isfile() or m.size > max_bytes or not re.fullmatch(allowed, m.name):
                            raise Invalid(f"unexpected member {m.name}")
                        yield pa.RecordBatch.from_pydict({"path": pa.array([path]), "member": pa.array([m.name]), "content": pa.array([tar.extractfile(m).read()], pa.binary())})

    return archives.select("path", "content").mapInArrow(run, "path string, member string, content binary")
