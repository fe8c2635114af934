"""Binary data sets, pixel codecs, JSON and streamed messages: there and back."""

import json
import random
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from imgframe.operators.elements import ELEMENTS
from imgframe.sources import codec, tagged_json
from imgframe.streaming import messages

NESTED = [
    ("(0008,0060)", 0x00080060, "CS", ["CT", "PET"]),
    ("(0010,0010)", 0x00100010, "PN", ["Adams^John"]),
    ("(0028,0010)", 0x00280010, "US", ["512", "7"]),
    ("(0040,A730)", 0x0040A730, "SQ", []),
    ("(0040,A730)[0].(0008,0100)", 0x00080100, "SH", ["a"]),
    ("(0040,A730)[1].(0040,A730)", 0x0040A730, "SQ", []),
    ("(0040,A730)[1].(0040,A730)[0].(0008,0104)", 0x00080104, "LO", ["odd"]),
    ("(7FE0,0010)", 0x7FE00010, "OB", ["00ff10"]),
]


def test_nested_round_trip():
    back = list(codec.decode(codec.encode(NESTED)))
    assert [b[:3] for b in back] == [n[:3] for n in NESTED]
    assert [b[3] for b in back][:-1] == [n[3] for n in NESTED][:-1]
    assert back[-1][3] == ["00ff1000"]
    assert [b[0] for b in codec.decode(b"\0" * 128 + b"DICM" + codec.encode(NESTED), until=0x00280010)] == ["(0008,0060)", "(0010,0010)"]


def test_forms():
    """A file says its own form; pixel fragments stay apart; text follows the declared character set."""
    pixels = [("(7FE0,0010)", 0x7FE00010, "OB", ["", "aabb", "cc00"])]
    for explicit in (True, False):
        back = list(codec.decode(codec.write_file(NESTED[:2] + pixels, explicit), None))
        assert [b[0] for b in back] == ["(0002,0000)", "(0002,0010)", "(0008,0060)", "(0010,0010)", "(7FE0,0010)"]
        assert back[-1][3] == ["", "aabb", "cc00"]
    assert list(codec.decode(codec.encode(NESTED[:2], False), None)) == NESTED[:2]
    latin = codec.encode([("(0008,0005)", 0x00080005, "CS", ["ISO_IR 100"])]) + b"\x10\x00\x10\x00PN\x04\x00J\xf6rg"
    assert list(codec.decode(latin))[-1][3] == ["Jörg"]


def test_odd_lengths():
    data = b"\x08\x00\x60\x00CS\x03\x00CTx" + codec.encode(NESTED[1:2])
    assert [e[0] for e in codec.decode(data)] == ["(0008,0060)", "(0010,0010)"]
    with pytest.raises(codec.DecodeError):
        list(codec.decode(data, odd="fail"))


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "a").write_bytes(codec.write_file(NESTED))
    (tmp_path / "in" / "b").write_bytes(codec.write_file(NESTED[:2], False))
    (tmp_path / "c.txt").write_bytes(b"no data set at all, just text of some length" * 9)
    rows = codec.read_files(spark, f"file://{tmp_path}", until=0x00280010).collect()
    assert sorted((r.file[-1], r.path) for r in rows) == [(f, p) for f in "ab" for p in ("(0002,0000)", "(0002,0010)", "(0008,0060)", "(0010,0010)")]
    broken = codec.read_files(spark, f"file://{tmp_path}").where("path IS NULL").collect()
    assert [r.file[-5:] for r in broken] == ["c.txt"]


def test_frames_of_data_sets(spark):
    rows = [(1, *n) for n in NESTED] + [(2, "(0010,0010)", 0x00100010, "PN", [])]
    data = codec.encode_datasets(spark.createDataFrame(rows, ELEMENTS))
    bad = spark.createDataFrame([(3, b"\x10\x00\x10\x00PN\xff\x00x"), (4, b""), (5, None)], "instance long, data binary")
    back = codec.decode_datasets(data.unionByName(bad), "instance", "data").collect()
    assert sorted((r.instance, r.path or "") for r in back) == sorted([*((1, n[0]) for n in NESTED), (2, "(0010,0010)"), (3, "")])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 3) | st.integers(0, 65535), min_size=1, max_size=600), st.sampled_from(["uint8", "uint16"]), st.sampled_from([1, 3]))
def test_run_lengths(samples, kind, n):
    frame = np.resize(np.array(samples), (len(samples), n)).astype(kind)
    assert (codec.rle_decode(codec.rle_encode(frame), len(frame), n, kind) == frame).all()


@given(st.binary(max_size=500))
def test_deflate(data):
    assert codec.inflate(codec.deflate(data)) == data


def test_json(spark):
    rows = [(1, "(0008,0060)", 0x00080060, "CS", ["CT", 'q"\\\n']), (1, "(0010,0010)", 0x00100010, "PN", ["^Bob^^Dr."]), (1, "(0020,0013)", 0x00200013, "IS", []), (1, "(0000,0900)", 0x0900, "US", ["5"]), (1, "(0000,0901)", 0x0901, "UL", ["4294967295"])]
    text = tagged_json.to_json(spark.createDataFrame(rows, ELEMENTS)).first().json
    assert text == '{"00000900":{"vr":"US","Value":[5]},"00000901":{"vr":"UL","Value":["4294967295"]},"00080060":{"vr":"CS","Value":["CT","q\\"\\\\\\n"]},"00100010":{"vr":"PN","Value":[{"Alphabetic":"^Bob^^Dr."}]},"00200013":{"vr":"IS"}}'
    back = tagged_json.from_json(spark.createDataFrame([(1, text)], "instance long, json string")).collect()
    assert sorted((r.path, r.vr, tuple(r["values"])) for r in back) == sorted((r[1], r[3], tuple(r[4])) for r in rows)


@pytest.mark.parametrize("text", ["", "short", "é" * 5000])
def test_fragments(spark, text):
    cut = messages.fragment(spark.createDataFrame([(1, text)], "id long, data string"), "data", 1018)
    assert max(len(r.data) for r in cut.collect()) <= 1012
    whole = messages.reassemble(cut, ["id"], ["seq"], "data").first()
    assert (bytes(whole.data).decode(), whole.complete) == (text, True)


def test_stream(spark, tmp_path):
    """Fragments of two associations over two files; a message goes on where the file before it stopped."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "association long, seq long, data binary, is_last boolean"
    source = str(tmp_path / "in")
    for rows in ([(1, 0, b"a", False), (2, 0, b"x", True)], [(1, 1, b"b", True), (1, 2, b"c", False)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    run = messages.reassemble_stream(stream).writeStream.format("memory").queryName("messages").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    run.awaitTermination()
    assert {(r.association, r.message, bytes(r.data)) for r in spark.table("messages").collect()} == {(1, 0, b"ab"), (2, 0, b"x")}


def test_tokens_of_bytes():
    """Sequences of known and unknown lengths, an item mark at the root, and bytes that run over."""
    known = bytes.fromhex("1800 1160 5351 0000 26000000 feff00e0 0e000000 1800 1260 5553 0200 0100 6b00 0000 feff00e0 08000000 1800 1460 5553 0000".replace(" ", ""))
    known = bytes.fromhex("18001160 53510000 22000000 feff00e0 0a000000 18001260 5553 0200 0100 feff00e0 08000000 18001460 5553 0000".replace(" ", ""))
    kinds = [(t[0], t[1]) for t in codec.Reader(known + bytes.fromhex("feff0de0 00000000".replace(" ", ""))).tokens()]
    assert kinds == [("sequence", "(0018,6011)"), ("item", "(0018,6011)[0]"), ("element", "(0018,6011)[0].(0018,6012)"), ("item_end", "(0018,6011)[0]"), ("item", "(0018,6011)[1]"), ("element", "(0018,6011)[1].(0018,6014)"), ("item_end", "(0018,6011)[1]"), ("sequence_end", "(0018,6011)")]
    unknown = codec.encode(NESTED)
    assert [t[0] for t in codec.Reader(unknown).tokens()].count("item") == 3
    with pytest.raises(codec.DecodeError):
        list(codec.decode(bytes.fromhex("10001000504e ff00 41".replace(" ", ""))))


def test_big_endian_bytes():
    data = codec.encode([("(0028,0010)", 0x00280010, "US", ["258"]), ("(7FE0,0010)", 0x7FE00010, "OW", ["0102"])], big=True)
    assert data == bytes.fromhex("0028 0010 5553 0002 0102 7fe0 0010 4f57 0000 00000002 0201".replace(" ", ""))
    assert [e[3] for e in codec.decode(data, big=True)] == [["258"], ["0102"]]


def test_declared_sets():
    """Text is written in the declared set and read back; what the set lacks is an error; plain types are never in it."""
    for name, text in (("ISO_IR 100", "Müller"), ("ISO_IR 144", "Люк"), ("ISO_IR 192", "Люк"), ("GB18030", "王"), ("ISO_IR 13", "ﾔﾏﾀﾞ")):
        rows = [("(0008,0005)", 0x00080005, "CS", [name]), ("(0010,0010)", 0x00100010, "PN", [text])]
        assert list(codec.decode(codec.encode(rows))) == rows
    with pytest.raises(codec.EncodeError):
        codec.encode([("(0008,0005)", 0x00080005, "CS", ["ISO_IR 100"]), ("(0010,0010)", 0x00100010, "PN", ["王"])])
    with pytest.raises(codec.EncodeError):
        codec.encode([("(0028,0010)", 0x00280010, "US", ["70000"])])
    latin = codec.encode([("(0008,0005)", 0x00080005, "CS", ["ISO_IR 100"])]) + b"\x08\x00\x16\x00AE\x02\x00\xe4\xf6"
    assert [list(codec.decode(latin, any_vr=v))[-1][3] for v in (False, True)] == [["��"], ["äö"]]


def test_preambles():
    body = codec.encode(NESTED[:2])
    for policy, data in (("auto", b"x" * 128 + b"DICM" + body), ("auto", body), ("never", body), ("never", b"DICM" + body), ("always", b"x" * 128 + body)):
        assert [e[0] for e in codec.decode(data, preamble=policy)] == [n[0] for n in NESTED[:2]]


def test_items_in_order():
    """More than ten items keep their order, and empty items their places, whatever the order of rows."""
    rows = [("(0040,A730)", 0x0040A730, "SQ", [])] + [(f"(0040,A730)[{i}].(0008,0100)", 0x00080100, "SH", [str(i)]) for i in range(12) if i != 3]
    assert list(codec.decode(codec.encode(rows[::-1]))) == rows


def test_meta_errors():
    good = codec.write_file(NESTED[:2])
    assert codec.read_meta(good)["transfer_syntax"] == codec.EXPLICIT
    assert codec.read_meta(good)["information_version"] == "0001"
    for bad, why in ((b"", "magic"), (good[:132] + codec.encode(NESTED[:2]), "length"), (good[:132] + bytes.fromhex("0200000055 4c040000000000"), "syntax")):
        with pytest.raises(codec.DecodeError, match=why):
            codec.read_meta(bad)


def test_json_without_loss(spark):
    """Nested items, an empty one between others, names in groups, bytes, tags and links; and what is no element."""
    rows = [(1, *n) for n in NESTED] + [(1, "(0040,A730)[3].(0008,0100)", 0x00080100, "SH", ["d"]), (1, "(0028,0009)", 0x00280009, "AT", ["(0018,1063)"]), (1, "(0010,1001)", 0x00101001, "PN", ["a=b=c", "=i"])]
    text = tagged_json.to_json(spark.createDataFrame(rows, ELEMENTS))
    back = tagged_json.from_json(text).collect()
    assert sorted((r.path, r.vr, tuple(r["values"])) for r in back) == sorted((r[1], r[3], tuple(r[4])) for r in rows)
    frame = lambda *texts: spark.createDataFrame(list(enumerate(texts)), "instance long, json string")
    linked = frame('{"7FE00010":{"vr":"OW","BulkDataURI":"file:x"}}')
    assert [(r.path, r.link) for r in tagged_json.from_json(linked, links=True).collect()] == [("(7FE0,0010)", "file:x")]
    assert [(r.path, r["values"]) for r in tagged_json.from_json(linked).collect()] == [("(7FE0,0010)", [])]
    odd = frame("no json", None, '{"00100010":{"Value":["x"]}}', '{"name":{"vr":"PN"}}', '{"00280010":{"vr":"DS","Value":[1.0,2.5,null,"3"]}}')
    assert sorted((r.instance, r.path or "", r.vr or "", tuple(r["values"] or ())) for r in tagged_json.from_json(odd).collect()) == [(0, "", "", ()), (2, "(0010,0010)", "UN", ("x",)), (3, "", "", ()), (4, "(0028,0010)", "DS", ("1", "2.5", "", "3"))]
    for bad in ('{"00100010":{"Value":["x"]}}', '{"00100010":{"vr":"UN","Value":["x"]}}', '{"00100010":{"vr":"PN","x":1}}'):
        with pytest.raises(Exception, match="JsonError"):
            tagged_json.from_json(frame(bad), strict=True).collect()


def test_read_options(spark, tmp_path):
    (tmp_path / "a").write_bytes(codec.write_file(NESTED, syntax=codec.BIG))
    paths = lambda o: [r.path for r in codec.open_files(spark, f"file://{tmp_path}", o).orderBy("path").collect() if r.path > "(0003"]
    options = codec.ReadOptions()
    assert paths(options.read_until(0x00280010)) == ["(0008,0060)", "(0010,0010)"]
    assert paths(options.read_to(0x00280010)) == ["(0008,0060)", "(0010,0010)", "(0028,0010)"]
    assert paths(options.read_to(0x00280010).read_until(0x00100010)) == ["(0008,0060)"]
    assert len(paths(options.read_until(0x00280010).read_all())) == len(NESTED)
    assert options.with_dictionary({0x00990001: "LO"}).vrs[0x00990001] == "LO"
    with pytest.raises(ValueError):
        codec.ReadOptions(odd="maybe")


def test_query_lines(spark):
    from imgframe.operators.matching import parse_query_lines

    lines = spark.createDataFrame([("# no",), ("  # no",), ("",), ("  ",), (" a=b ",), ("c=#",)], "value string")
    assert [r.value for r in parse_query_lines(lines).collect()] == [" a=b ", "c=#"]


def test_every_control_character_in_json(spark):
    rows = [(i, "(0020,4000)", 0x00204000, "LT", [f"a{chr(i)}b"]) for i in range(33)] + [(40, "(0010,0010)", 0x00100010, "PN", ['"q"\\^\x1b=é']), (41, "(0020,4000)", 0x00204000, "LT", ["ü\u2028\U0001f600[]"])]
    text = tagged_json.to_json(spark.createDataFrame(rows, ELEMENTS), depth=0)
    assert all(json.loads(r.json) for r in text.collect())
    assert sorted((r.instance, r.path, r.tag, r.vr, r["values"]) for r in tagged_json.from_json(text).collect()) == rows


def nested_object(rng, depth=0):
    """A random tagged object with sequences in sequences, empty items and empty sequences; no empty items at the end."""
    out = {}
    for tag in sorted(rng.sample(range(12), rng.randrange(4))):
        items = [nested_object(rng, depth + 1) for _ in range(rng.choice([0, 1, 2, 12]))] if depth < 3 and rng.random() < 0.5 else None
        while items and not items[-1]:
            items.pop()
        out[f"0010{tag:04X}"] = {"vr": "LO", "Value": [rng.choice(["a", '"', "b\\"])]} if items is None else {"vr": "SQ"} | ({"Value": items} if items else {})
    return out


def test_nested_json_in_any_order_of_rows(spark):
    """Elements in any order, and sequences of which only items have rows, give the text that the object has."""
    rng = random.Random(3)
    objects = [nested_object(rng) for _ in range(300)]
    rows = []
    for i, o in enumerate(objects):
        found = [(i, p, t, vr, v) for p, t, vr, v, _ in tagged_json.read_object(o)]
        rows += [e for e in found if not (e[3] == "SQ" and any(x[1].startswith(e[1] + "[") for x in found) and rng.random() < 0.3)]
    rng.shuffle(rows)
    text = tagged_json.to_json(spark.createDataFrame([*rows, (1000, None, None, None, None)], ELEMENTS))
    assert {r.instance: r.json for r in text.collect()} == {i: json.dumps(o, separators=(",", ":")) for i, o in enumerate(objects) if o}
    assert text._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
