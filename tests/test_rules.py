"""Golden cases of the protocol rules, replay, wire formats and streams."""

import pytest
from pyspark.sql import functions as F

from logweave.functions import bytes as b
from logweave.functions import commands as c
from logweave.operators import batching, quorum, replay, reports, telemetry
from logweave.operators import log as log_ops
from logweave.plans import catalogue, rules
from logweave.sources import wire
from logweave.streaming.views import VersionedView, stream_idemp, stream_kv_view


def test_replies_and_state(spark):
    log = spark.createDataFrame([(1, "SET", "k", "one"), (2, "SET", "k", "two"), (3, "DEL", "k", None), (4, "DEL", "k", None), (5, "NOOP", "", None)], "log_index long, op string, k string, v string")
    assert [r.reply for r in replay.replies(log).orderBy("log_index").collect()] == ["+OK", "+OK", ":1", ":0", "+OK"]
    assert replay.kv_state(log).count() == 0 and replay.last_applied(log).first()[0] == 5


def test_idempotent_requests(spark):
    rows = [(1, "c", 1, "SET", "k", "one"), (2, "c", 1, "SET", "k", "other"), (3, "c", 1, "DEL", "k", None), (4, "c", 2, "DEL", "k", None), (5, "c", 2, "DEL", "k", None), (6, "c", 1, "SET", "k", "x"), (7, "other", 1, "SET", "k", "two")]
    log = spark.createDataFrame(rows, "log_index long, client_id string, request_id long, op string, k string, v string")
    assert [r.reply for r in replay.idemp_replies(log).orderBy("log_index").collect()] == ["+OK", "+OK", "+OK", ":1", ":1", "-ERR stale request id", "+OK"]
    assert [(r.k, r.v) for r in replay.kv_state(replay.effective(log)).collect()] == [("k", "two")]


@pytest.mark.parametrize(
    "args,kind,error",
    [
        ([], "ERROR", "ERR empty command"),
        (["SET", "k", "v"], "WRITE", None),
        (["GET"], "ERROR", "ERR wrong number of arguments for 'GET' command"),
        (["BOGUS"], "ERROR", "ERR unknown command 'BOGUS'"),
        (["IDEMP", "c", "1", "set", "k", "v"], "WRITE", None),
        (["IDEMP", "c", "01", "SET", "k", "v"], "ERROR", "ERR invalid request id"),
        (["IDEMP", "c", "18446744073709551615", "DEL", "k"], "WRITE", None),
        (["IDEMP", "c", "18446744073709551616", "DEL", "k"], "ERROR", "ERR invalid request id"),
        (["IDEMP", "", "1", "DEL", "k"], "ERROR", "ERR invalid client id"),
        (["IDEMP", "c", "1", "Get", "k"], "ERROR", "ERR unknown command 'Get'"),
    ],
)
def test_classifier(spark, args, kind, error):
    row = spark.createDataFrame([(args,)], "a array<string>").select(c.classify(F.col("a")).alias("x")).first().x
    assert (row.kind, row.error) == (kind, error)


def test_integers(spark):
    row = spark.range(1).select(b.from_be(b.to_be(F.lit(258), 8)).alias("be"), b.from_le32(b.to_le32(F.lit(-1))).alias("le"), F.hex(b.to_be(F.lit(258), 4)).alias("h")).first()
    assert (int(row.be), row.le, row.h) == (258, -1, "00000102")


def test_commands_cut_anywhere(spark):
    data = b"*1\r\n$4\r\nPING\r\n*2\r\n$3\r\nGET\r\n$3\r\na\0b\r\n"
    chunks = [(str(i), s, bytearray(x)) for i in range(1, len(data)) for s, x in enumerate((data[:i], data[i:]))]
    got = wire.decode_commands(spark.createDataFrame(chunks, "conn string, seq int, bytes binary"))
    assert got.filter("error is not null").count() == 0 and got.count() == 2 * (len(data) - 1)


@pytest.mark.parametrize("bad", [b"*0\r\n", b"*-1\r\n", b"+PING\r\n", b"*1\r\n$-1\r\n", b"*1\r\n$1\r\nab\r\n", b"*x\r\n", b"*1025\r\n"])
def test_invalid_commands(bad):
    with pytest.raises(wire.Invalid):
        wire.parse_command(bad)


def test_null_long_and_repeated_documents_decode(spark, tmp_path):
    texts = [(1, "a", "x"), (2, None, "x"), (3, "b" * (3 << 20), "x"), (3, "", "x"), (3, "é", "x"), (None, "cc", "x"), (None, "d", "x"), (4, None, "y"), (5, "e", None)]
    spark.createDataFrame(texts, "doc_id long, text string, source string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.conn: (r.n, r.n_bytes) for r in catalogue.QUERIES["resp_decode"](spark, str(tmp_path)).collect()}
    assert got == {"x": (7, 1 + (3 << 20) + 0 + 2 + 2 + 1), "y": (1, None), None: (1, 1)}


def test_errors_are_counted_apart(spark):
    long = b"*1\r\n$%d\r\n%s\r\n" % (1 << 20, b"x" * (1 << 20))
    chunks = spark.createDataFrame([(c, s, bytearray(x)) for c in "ab" for s, x in enumerate((b"*1\r\n$4\r\nPING\r\n", long if c == "a" else b"*1\r\n$-1\r\n", b"*1\r\n$4\r\nPING\r\n"))], "conn string, seq int, bytes binary")
    counts = lambda *most: {r.conn: (r.n, r.n_bytes, r.n_errors) for r in wire.count_commands(wire.decode_commands(chunks, *most), 0).collect()}
    assert counts() == {"a": (1, 4, 1), "b": (1, 4, 1)}
    assert counts(wire.ANY_COMMAND) == {"a": (3, 8 + (1 << 20), 0), "b": (1, 4, 1)}


def test_frames_and_snapshots():
    assert wire.decode_frame(wire.encode_frame(2, 42, b"abc\0xyz")) == (2, 42, b"abc\0xyz", 16)
    assert wire.decode_frame(b"\0\0") is None
    pairs = [(b"b", b""), (b"a\0", b"x\r\n")]
    assert list(wire.decode_snapshot(wire.encode_snapshot(pairs))) == sorted(pairs)
    for broken in (wire.encode_snapshot(pairs)[:-1], wire.encode_snapshot(pairs) + b"x"):
        with pytest.raises(wire.Invalid):
            list(wire.decode_snapshot(broken))


def test_greedy_batches(spark):
    rows = spark.createDataFrame([("s", i, 1) for i in range(257)], "s string, i long, n long")
    assert sorted(r["count"] for r in batching.greedy(rows, "s", "i", "n").groupBy("batch").count().collect()) == [1, 128, 128]


def test_scrape_requests(spark):
    end = "\r\nHost: x\r\n\r\n"
    cases = {"GET /metrics HTTP/1.1" + end: "Ok", "GET /metrics HTTP/1.1\r\n": "Incomplete", "POST /metrics HTTP/1.1" + end: "MethodNotAllowed", "GET /health?x HTTP/1.0" + end: "Health", "GET /x HTTP/1.1" + end: "NotFound", "GET /metrics HTTP/2" + end: "BadRequest", "nonsense" + end: "BadRequest"}
    got = spark.createDataFrame([(k,) for k in cases], "r string").select("r", telemetry.scrape_request(F.col("r")).alias("x")).collect()
    assert {r.r: r.x for r in got} == cases


def test_streams_equal_batches(spark, tmp_path):
    rows = [(i, f"c{i % 3}", 1 + i % 5, ("SET", "DEL", "SET")[i % 3], f"k{i % 4}", i) for i in range(60)]
    log = spark.createDataFrame(rows, "log_index long, client_id string, request_id long, op string, k string, v long")
    for n in range(3):
        log.filter(f"log_index div 20 = {n}").coalesce(1).write.mode("append").parquet(str(tmp_path / "log"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "log"))
    view = VersionedView(spark, str(tmp_path / "view"))
    stream_kv_view(stream, view, str(tmp_path / "ck")).awaitTermination(120)
    assert sorted(map(tuple, view.latest().collect())) == sorted(map(tuple, replay.kv_state(log).collect()))
    assert stream_idemp(stream).isStreaming


def test_stream_idemp_equals_batch(spark):
    got = catalogue.QUERIES["stream_idemp"](spark, "/root/testdata/sf0.001")
    want = catalogue.QUERIES["kv_idemp_status"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


@pytest.fixture
def many_parts(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.enabled")


def test_stream_idemp_reads_its_log_in_many_tasks(spark, many_parts):
    stream, path = rules._as_stream(spark, "/root/testdata/sf0.001", "idemp")
    assert spark.read.parquet(f"{path}/log").select(F.input_file_name()).distinct().count() > 1
    got = rules.stream_idemp(spark, "/root/testdata/sf0.001")
    want = catalogue.QUERIES["kv_idemp_status"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, got.select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_stream_kv_state_reads_its_log_in_many_tasks(spark, many_parts):
    stream, path = rules._as_stream(spark, "/root/testdata/sf0.001", "kv")
    view = VersionedView(spark, f"{path}/view")
    query = stream_kv_view(stream, view, f"{path}/checkpoint")
    query.awaitTermination(120)
    assert spark.read.parquet(f"{path}/log").select(F.input_file_name()).distinct().count() > 1
    assert view._versions() == [0]  # one micro-batch, however many files
    want = catalogue.QUERIES["kv_state"](spark, "/root/testdata/sf0.001")
    assert sorted(map(tuple, view.latest().select(want.columns).collect())) == sorted(map(tuple, want.collect()))


def test_verbs_are_upper_cased_in_ascii_only(spark):
    row = spark.createDataFrame([(["ſet", "k", "v"],), (["set", "k", "v"],)], "a array<string>").select(c.classify(c.upper_verb(F.col("a"))).alias("x")).collect()
    assert [r.x.kind for r in row] == ["ERROR", "WRITE"]


def test_reconnect_golden(spark):
    rows = spark.createDataFrame([("p", i, x) for i, x in enumerate([100, 2000, 100, 12_000, 100])], "peer string, seq int, lived_ms int")
    assert [r.delay_ms for r in batching.reconnect_delays(rows).orderBy("seq").collect()] == [500, 1000, 2000, 500, 1000]


def test_silent_peers_do_not_lower_the_quorum(spark):
    groups = spark.createDataFrame([(1, 0, 5, 0), (2, 0, 5, 900), (3, 0, 1, 0)], "group_id int, leader int, members int, leader_since_ms int")
    contacts = spark.createDataFrame([(1, 1, 990), (1, 0, 990)], "group_id int, peer int, last_contact_ms int")
    got = {r.group_id: (r.fresh, r.stays) for r in quorum.check_quorum(groups, contacts, F.lit(1000)).collect()}
    assert got == {1: (2, False), 2: (1, True), 3: (1, True)}
    acks = contacts.withColumnRenamed("last_contact_ms", "sent_ms")
    lease = quorum.lease_valid(groups.withColumn("members", F.lit(3)), acks, F.lit(1000))
    assert {r.group_id: r.lease for r in lease.collect()} == {1: True, 2: False, 3: False}


def test_info_summary_golden(spark):
    def sample(at, term, lag, agree=True):
        return [("r", at, 1, "leader", 1, term, lag), ("r", at, 0, "follower", 1 if agree else 0, term, 0)]

    rows = sample(0, 1, 2) + sample(1, 1, 4) + sample(2, 1, 0, False) + sample(3, 2, 1)
    s = spark.createDataFrame(rows, "run string, at int, node int, state string, leader_id int, term int, lag int")
    assert tuple(reports.info_summary(s).first()) == ("r", 4, 4, 1, 1)


def test_stages_golden(spark):
    before = spark.createDataFrame([(1, 3, "leader", 10, 1000, 40, 10, 1000)], "node_id int, term int, state string, log_count long, log_total_us long, log_entries long, read_count long, read_total_us long")
    after = before.withColumns({"log_count": F.lit(12), "log_total_us": F.lit(1600), "log_entries": F.lit(50)})
    got = {r.stage: (r["count"], r.mean_us, r.mean_entries) for r in reports.stage_summary(before, after, ["log", "read"]).collect()}
    assert got == {"log": (2, 300.0, 5.0), "read": (0, None, None)}
    for wrong in (after.withColumn("term", F.lit(4)), after.withColumn("log_count", F.lit(9))):
        with pytest.raises(Exception, match="not comparable|moved backwards"):
            reports.stage_summary(before, wrong, ["log", "read"]).collect()


def test_cpu_golden(spark):
    rows = spark.createDataFrame([("a", "user", 100), ("a", "idle", 300), ("b", "user", -1), ("b", "idle", 5), ("c", "user", 0)], "g string, f string, d long")
    got = {(r.g, r.f): r.share_pct for r in reports.cpu_shares(rows, "g", "f", "d").collect()}
    assert got == {("a", "user"): 25.0, ("a", "idle"): 75.0, ("b", "user"): None, ("b", "idle"): None, ("c", "user"): None}
    start = spark.createDataFrame([("client", 10.0, 2.0)], "process string, at double, cpu_seconds double")
    end = spark.createDataFrame([("client", 12.0, 3.0)], start.schema)
    assert tuple(reports.process_shares(start, end).first()) == ("client", 1.0, 50.0)
    with pytest.raises(Exception, match="not comparable"):
        reports.process_shares(end, start).collect()


@pytest.mark.parametrize("data", [b"*" * 5, b"$-2\r\n", b"$3\r\nabcd\r\n", b"?\r\n", b":x\r\n", b"*1\r\n" * 18 + b":1\r\n", b"+" + b"x" * 1100 + b"\r\n", b"$%d\r\n" % ((8 << 20) + 1), b"*1025\r\n"])
def test_invalid_replies(data):
    if data == b"*" * 5:
        assert wire.parse_reply(data) is None
    else:
        with pytest.raises(wire.Invalid):
            wire.parse_reply(data)


def test_frames_refuse_bad_headers():
    for kind, sender in ((6, 1), (2, -1), (2, 1 << 31)):
        with pytest.raises(wire.Invalid):
            wire.encode_frame(kind, sender, b"")
    with pytest.raises(wire.Invalid):
        wire.decode_frame(b"\0\0\0\x05\x02\x80\0\0\0")
    a, c_, tail = wire.encode_frame(1, 2, b"aa"), wire.encode_frame(3, 4, b"b"), b"\0\0"
    assert wire.swap_frames(a + c_ + tail) == (c_ + a + tail, len(a) + len(c_)) and wire.swap_frames(a + tail) == (a + tail, 0)


def test_chunks_that_do_not_fit_are_dropped(spark):
    rows = [("a", 0, 0, b"old", False), ("a", 1, 0, b"ne", False), ("a", 2, 2, b"w", True), ("a", 3, 3, b"x", True), ("b", 0, 0, b"x", False), ("b", 1, 5, b"y", True), ("c", 0, 1, b"x", True)]
    chunks = spark.createDataFrame([(s, n, 9, 1, o, bytearray(x), e) for s, n, o, x, e in rows], "stream string, seq int, last_index long, last_term long, offset long, data binary, done boolean")
    assert [(r.stream, r.seq, bytes(r.payload)) for r in log_ops.reassemble(chunks).collect()] == [("a", 2, b"new")]


def test_append_and_replace(spark, tmp_path):
    path = str(tmp_path / "log")
    rows = spark.createDataFrame([(1, 1), (2, 1)], "log_index long, term long")
    assert log_ops.append_batch(rows, path, 0) == 2 and log_ops.append_batch(rows.limit(0), path, 2) == 2
    for bad in (rows, rows.withColumn("log_index", F.col("log_index") * 2 + 1), spark.createDataFrame([(3, 0)], rows.schema)):
        with pytest.raises(ValueError):
            log_ops.append_batch(bad, path, 2)
    assert spark.read.parquet(path).count() == 2
    log_ops.replace_all(spark.createDataFrame([(9, 2)], rows.schema), path)
    assert [tuple(r) for r in spark.read.parquet(path).collect()] == [(9, 2)]
    rows.write.parquet(f"{path}.staged")  # died after staging
    assert log_ops.finish_replace(spark, path) and not log_ops.finish_replace(spark, path)
    assert spark.read.parquet(path).count() == 2


def test_archive_members(spark, tmp_path):
    import io
    import tarfile

    def archive(name):
        with tarfile.open(tmp_path / "a.tar", "w") as t:
            info = tarfile.TarInfo(name)
            info.size = 2
            t.addfile(info, io.BytesIO(b"hi"))
        return spark.read.format("binaryFile").load(str(tmp_path / "a.tar"))

    assert [(r.member, bytes(r.content)) for r in wire.archive_members(archive("run/result.json"), r"run/.*\.json").collect()] == [("run/result.json", b"hi")]
    for bad in ("../x.json", "/run/x.json", "run/x.txt"):
        with pytest.raises(Exception, match="member"):
            wire.archive_members(archive(bad), r"run/.*\.json").collect()


@pytest.mark.parametrize("text", ["0:a:1,0:b:2", "1:a:1", "0:a:0", "0:a:70000", "0::5"])
def test_invalid_peers(spark, text):
    with pytest.raises(ValueError):
        wire.valid_peers(wire.peers(spark, text), 0)


def test_snapshot_rule(spark):
    lg = spark.createDataFrame([(5, 2), (6, 2), (7, 3)], "log_index long, term long")
    assert {r.term: r.first_index for r in log_ops.conflict_index(lg, 4, 2).collect()} == {2: 4, 3: 7}
    assert {r.term: r.first_index for r in log_ops.conflict_index(lg, 4, 1).collect()} == {2: 5, 3: 7}
