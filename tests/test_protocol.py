"""Protocol messages byte by byte, and streams with state and timers."""

import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from imgframe.operators import dictionary as D
from imgframe.operators import negotiation as N
from imgframe.sources import codec
from imgframe.streaming import messages as M
from imgframe.streaming import pdu

REQUEST = {
    "kind": "associate_rq",
    "version": 1,
    "called": "THEM",
    "calling": "US",
    "application_context": "1.2.840.10008.3.1.1.1",
    "contexts": [{"id": 1, "result": None, "abstract_syntax": "1.2", "transfer_syntaxes": ["1.2.840.10008.1.2", "1.3"]}, {"id": 3, "result": None, "abstract_syntax": "1.4", "transfer_syntaxes": []}],
    "max_length": 16384,
    "implementation_class": "1.5",
    "implementation_version": "V1",
    "roles": [{"uid": "1.2", "scu": True, "scp": False}],
    "extended": [{"uid": "1.2", "data": b"\1\2"}],
}
VALUES = {"kind": "p_data", "pdvs": [{"context": 1, "command": True, "last": False, "data": b"ab"}, {"context": 3, "command": False, "last": True, "data": b""}]}


def read(data, **options):
    return [{k: v for k, v in m.items() if v is not None} for m in pdu.read_messages(data, **options)]


def bare(m):
    return {k: v for k, v in m.items() if v is not None}


def test_bytes():
    assert pdu.write_message(VALUES) == bytes.fromhex("0400 0000000e 00000004 01 01 6162 00000002 03 02")
    assert pdu.write_message({"kind": "release_rq"}) == bytes.fromhex("0500 00000004 00000000")
    assert pdu.write_message({"kind": "abort", "source": 2, "reason": 1}) == bytes.fromhex("0700 00000004 0000 02 01")
    assert pdu.write_message({"kind": "associate_rj", "result": 1, "source": 1, "reason": 7}) == bytes.fromhex("0300 00000004 00 01 01 07")
    written = pdu.write_message(REQUEST)
    assert written[:2] == b"\1\0" and int.from_bytes(written[2:6]) == len(written) - 6
    assert written[6:10] == b"\0\1\0\0" and written[10:26] == b"THEM            " and written[74:78] == bytes.fromhex("10000015")


def test_round_trips():
    accept = {**REQUEST, "kind": "associate_ac", "contexts": [{"id": 1, "result": 0, "transfer_syntaxes": ["1.3"]}, {"id": 3, "result": 3, "transfer_syntaxes": ["1.3"]}]}
    messages = [REQUEST, accept, VALUES, {"kind": "release_rq"}, {"kind": "release_rp"}, {"kind": "unknown", "rest": b"\x55xyz"}, {"kind": "abort", "source": 0, "reason": 0}]
    full = [{**dict.fromkeys(pdu.TYPES), **m} for m in messages]
    for m in full:
        for c in m["contexts"] or []:
            c.setdefault("abstract_syntax", None)
            c.setdefault("result", None)
    back = read(b"".join(map(pdu.write_message, full)))
    assert [m["kind"] for m in back] == [m["kind"] for m in messages]
    assert back[0] == {**REQUEST} and back[2] == VALUES and back[5] == messages[5]
    assert [c["result"] for c in back[1]["contexts"]] == [0, 3]


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=80))
def test_any_bytes_end(data):
    """Whatever comes, all bytes are read or left over, and only the last message may be none."""
    kinds = [m["kind"] for m in pdu.read_messages(data)]
    assert not set(kinds[:-1]) & {"incomplete", "error"}


def test_cut_and_long():
    data = pdu.write_message(VALUES)
    assert read(data[:-1]) == [{"kind": "incomplete", "rest": data[:-1]}]
    assert read(data + data, max_length=13)[0]["kind"] == "error"
    assert [m["kind"] for m in read(data + data[:3], max_length=14)] == ["p_data", "incomplete"]
    with pytest.raises(pdu.MessageError):
        pdu.write_message({"kind": "error"})


def test_written_by_columns(spark):
    """Column functions give the bytes that one message's fields give, for every kind, with missing fields and long titles."""
    answer = REQUEST | {"kind": "associate_ac", "called": "a title of more than 16", "roles": None, "implementation_version": None}
    messages = [VALUES, REQUEST, answer, {"kind": "associate_rq", "contexts": [{"id": 1, "result": None, "abstract_syntax": None, "transfer_syntaxes": None}]}, {"kind": "release_rq"}, {"kind": "release_rp"}, {"kind": "abort", "source": 2, "reason": 1}, {"kind": "associate_rj", "result": 1, "source": 1, "reason": 7}, {"kind": "unknown", "rest": b"\x55xyz"}, {"kind": "p_data", "pdvs": []}]
    full = [{c: m.get(c) for c in pdu.TYPES} for m in messages]
    frame = spark.createDataFrame([(i, *m.values()) for i, m in enumerate(full)], "id long, " + pdu.FIELDS)
    out = pdu.write(frame, ["id"])
    assert "Python" not in out._jdf.queryExecution().executedPlan().toString() and "Arrow" not in out._jdf.queryExecution().executedPlan().toString()
    assert {r.id: bytes(r.data) for r in out.collect()} == {i: pdu.write_message(m) for i, m in enumerate(full)}
    with pytest.raises(Exception, match="can't be written"):
        pdu.write(spark.createDataFrame([(1, "error")], "id long, kind string"), ["id"]).collect()


def test_pieces_of_messages():
    data = pdu.write_message(VALUES)
    whole = lambda d, most=None: pdu.whole_messages(d, most)
    assert whole(b"") == ([], b"", 6) and whole(data[:5]) == ([], data[:5], 6) and whole(data[:6]) == ([], data[:6], len(data))
    assert whole(data + data[:7]) == ([(False, data)], data[:7], len(data)) and whole(data * 2) == ([(False, data)] * 2, b"", 6)
    assert whole(data + data, 3) == ([(True, data + data)], b"", 6)


def test_registry(spark):
    more = spark.createDataFrame([("1.2.840.10008.1.2.4.50", "JPEG", "read"), ("1.2.840.10008.1.2.5", "RLE", "read"), ("9.9", "new", "stub")], "uid string, name string, codec string")
    held = {r.uid: (r.name, r.codec) for r in D.register(D.transfer_syntaxes(spark), more).collect()}
    assert len(held) == 47 and held["1.2.840.10008.1.2.4.50"] == ("JPEG", "read") and held["1.2.840.10008.1.2.5"][1] == "full" and "9.9" in held
    found = D.lookup_transfer_syntax(spark.createDataFrame([("9.9\0",)], "uid string"), registry=D.capabilities(D.register(D.transfer_syntaxes(spark), more))).first()
    assert found.encapsulated and not found.can_decode_all


def test_roles(spark):
    rows = spark.createDataFrame([([("1", True, False), ("2", True, True)], ["2"]), ([("1", True, True)], ["3"]), (None, ["1"])], "roles array<struct<uid:string,scu:boolean,scp:boolean>>, accepted array<string>")
    got = [r[0] for r in rows.select(N.answer_roles(rows.roles, rows.accepted)).collect()]
    assert [None if g is None else [tuple(x) for x in g] for g in got] == [[("2", True, True)], None, None]


@pytest.fixture
def stream(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    running = []

    def start(schema, batches, run, name, **trigger):
        source = str(tmp_path / name)
        for rows in batches:
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        frame = run(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source))
        query = frame.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / f"{name}-state")).trigger(**trigger).start()
        running.append(query)
        return source, query

    yield start
    for query in running:
        query.stop()


def test_store_stream(spark, stream):
    """A command and its data over three batches; data that no command asked for gives nothing."""
    command = codec.encode([("(0000,0002)", 2, "UI", ["1.2"]), ("(0000,0110)", 0x110, "US", ["5"]), ("(0000,1000)", 0x1000, "UI", ["1.3"])], explicit=False)
    schema = "association long, seq long, kind string, data binary, is_last boolean"
    batches = [[(1, 0, "command", command[:9], False), (2, 0, "data", b"x", True)], [(1, 1, "command", command[9:], True), (1, 2, "data", b"ab", False)], [(1, 3, "data", b"cd", True), (1, 4, "data", b"no", True), (2, 1, "command", command, True), (2, 2, "release", b"", False), (2, 3, "data", b"late", True)]]
    _, query = stream(schema, batches, M.store_stream, "stored", availableNow=True)
    query.awaitTermination()
    assert [(r.association, r.sop_class, r.sop_instance, r.message_id, bytes(r.data), r.status) for r in spark.table("stored").collect()] == [(1, "1.2", "1.3", 5, b"abcd", 0)]


def test_wire_stream(spark, stream):
    """Chunks cut anywhere give whole messages; one that is too long says so."""
    data = pdu.write_message(VALUES) + pdu.write_message({"kind": "release_rq"})
    schema = "connection long, seq long, data binary"
    batches = [[(1, 0, data[:3]), (2, 0, b"\4\0\0\1\0\0x")], [(1, 1, data[3:25])], [(1, 2, data[25:]), (1, 3, data[:7])]]
    _, query = stream(schema, batches, lambda f: pdu.wire_stream(f, 100), "wire", availableNow=True)
    query.awaitTermination()
    rows = sorted((r.connection, r.place, r.too_long, bytes(r.data)) for r in spark.table("wire").collect())
    assert rows == [(1, 0, False, data[:20]), (1, 1, False, data[20:]), (2, 0, True, b"\4\0\0\1\0\0x")]
    parsed = pdu.parse(spark.table("wire").where("NOT too_long"), "connection", "data").collect()
    assert {r.kind for r in parsed} == {"p_data", "release_rq"}


def test_a_message_that_never_ends(spark, stream):
    """It is given up after its time, and comes out as it is; its state goes."""
    schema = "association long, seq long, data binary, is_last boolean"
    source, query = stream(schema, [[(1, 0, b"a", False)], [(1, 1, b"b", False), (2, 0, b"x", True)]], lambda f: M.reassemble_stream(f, seconds=1), "waiting", processingTime="200 milliseconds")
    end = time.time() + 90
    while time.time() < end and spark.table("waiting").where("association = 1").count() == 0:
        time.sleep(1)
    assert {(r.association, r.message, bytes(r.data), r.complete) for r in spark.table("waiting").collect()} == {(1, 0, b"ab", False), (2, 0, b"x", True)}
