"""Frames decoded from bytes of several forms, attributes by frame, and what is no image."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from imgframe.functions import pixels
from imgframe.operators import images as I
from imgframe.operators.elements import ELEMENTS, tag_at
from imgframe.operators.frames import cut_fragments, offset_table
from imgframe.sources import codec

RLE, DEFLATED_FRAMES = "1.2.840.10008.1.2.5", "1.2.840.10008.1.2.8.1"


def rows_of(instance, pixels, **attributes):
    """Elements of one image: ``pixels`` are the hex values of its pixel data."""
    own = {"samples": 1, "interpretation": "MONOCHROME2", "n_frames": 1, "rows": 2, "columns": 3, "allocated": 8, "stored": 8, "signed": 0} | attributes
    found = [(instance, I.ROOT[c], tag_at(I.ROOT[c]), "US", [str(v)]) for c, v in own.items() if c in I.ROOT and v is not None]
    more = [(instance, p, tag_at(p), "DS", list(v)) for p, v in own.items() if p.startswith("(")]
    return [*found, *more, (instance, "(7FE0,0010)", codec.PIXEL_DATA, "OB", pixels)]


def values(spark, rows, syntax=codec.EXPLICIT, kind="array", **options):
    out = I.decode_frames(spark.createDataFrame(rows, ELEMENTS), syntax, kind, I.Options(**options))
    return {(r.instance, r.frame): r["values"] if r.problem is None else r.problem for r in out.collect()}


FRAME = bytes([0, 1, 2, 127, 128, 255])


def test_forms_of_pixel_data(spark):
    """The same samples in run lengths, deflated, by fragments and native, of one and of two frames."""
    packed, small = codec.rle_encode(np.frombuffer(FRAME, np.uint8)[:, None]).hex(), codec.deflate(FRAME).hex()
    plain = [float(x) for x in FRAME]
    assert values(spark, rows_of(1, ["", packed]), RLE) == {(1, 0): plain}
    assert values(spark, rows_of(1, ["", packed, packed], n_frames=2), RLE) == {(1, 0): plain, (1, 1): plain}
    assert values(spark, rows_of(1, ["", small]), DEFLATED_FRAMES) == {(1, 0): plain}
    assert values(spark, rows_of(1, ["", FRAME[:4].hex(), FRAME[4:].hex()]), "1.2.840.10008.1.2.1.98") == {(1, 0): plain}
    table = "00000000" + (8 + 4 + 8 + 2).to_bytes(4, "little").hex()
    cut = ["", FRAME[:4].hex(), FRAME[4:].hex(), FRAME[:2].hex(), FRAME[2:].hex()]
    assert values(spark, rows_of(1, [table, *cut[1:]], n_frames=2), "1.2.840.10008.1.2.1.98") == {(1, 0): plain, (1, 1): plain}
    assert values(spark, rows_of(1, [(FRAME + FRAME[::-1]).hex()], n_frames=2)) == {(1, 0): plain, (1, 1): plain[::-1]}
    assert values(spark, rows_of(1, ["b503"], allocated=1, stored=1, columns=4)) == {(1, 0): [255.0 if b == "1" else 0.0 for b in "10101101"]}


def test_signs_and_options(spark):
    low = np.array([0, 1, -1, 2047, -2048, 100], "<i2").tobytes().hex()
    image = rows_of(1, [low], allocated=16, stored=12, signed=1, **{"(0028,1053)": ["2"], "(0028,1052)": ["-10"]})
    x = np.array([0, 1, -1, 2047, -2048, 100]) * 2.0 - 10
    assert values(spark, image) == {(1, 0): x.tolist()}
    assert values(spark, image, modality="none") == {(1, 0): ((x + 10) / 2).tolist()}
    assert values(spark, image, modality=(0.5, 1.0)) == {(1, 0): ((x + 10) / 4 + 1).tolist()}
    whole = values(spark, image, kind="image")[1, 0]
    assert (min(whole), max(whole)) == (0.0, 65535.0)
    narrow = values(spark, image, kind="image", depth="8")[1, 0]
    assert (min(narrow), max(narrow)) == (0.0, 255.0)
    turned = values(spark, rows_of(1, [low], allocated=16, stored=12, signed=1, interpretation="MONOCHROME1", **{"(0028,1053)": ["2"], "(0028,1052)": ["-10"]}), kind="image")[1, 0]
    assert turned == [65535.0 - v for v in whole]
    assert values(spark, rows_of(1, [FRAME.hex()]), kind="image", voi="identity", depth="16") == {(1, 0): [float(x * 257) for x in FRAME]}
    for bad in ({"voi": "x"}, {"modality": "x"}, {"depth": "12"}):
        with pytest.raises(I.ImageError):
            I.Options(**bad)


def test_options_of_grey_images(spark):
    """Identity is the rescale alone, none the samples as they are; a window of the options stands before the data set's."""
    low = np.array([0, 1, -1, 2047, -2048, 100], "<i2")
    data = {"allocated": 16, "stored": 12, "signed": 1, "(0028,1053)": ["2"], "(0028,1052)": ["5000"], "(0028,1050)": ["100"], "(0028,1051)": ["50"]}
    image = rows_of(1, [low.tobytes().hex()], **data)
    assert values(spark, image, kind="image", voi="identity") == {(1, 0): (low * 2.0 + 5000).tolist()}
    assert values(spark, image, kind="image", modality="none") == {(1, 0): (low.astype(int) + 32768.0).tolist()}
    assert values(spark, image, kind="image", modality="none", depth="8") == {(1, 0): ((low.astype(int) + 32768) >> 8).astype(float).tolist()}
    assert "values from" in values(spark, image, kind="image", voi="identity", modality=(1.0, 0.0))[1, 0]
    ramp = lambda x, c, w: float(np.trunc(np.clip(((x - (c - 0.5)) / (w - 1) + 0.5) * 65535, 0, 65535)))
    assert values(spark, image, kind="image", voi=(5100.0, 400.0)) == {(1, 0): [ramp(x * 2 + 5000, 5100, 400) for x in low.tolist()]}
    exact = values(spark, image, kind="image", voi=(5100.0, 400.0, "LINEAR_EXACT"))[1, 0]
    assert exact[5] == float(np.trunc((5200 - 5100) / 400 * 65535 + 65535 / 2))
    assert values(spark, image, voi=(5100.0, 400.0)) == {(1, 0): [ramp(x * 2 + 5000, 5100, 400) for x in low.tolist()]}
    white = rows_of(1, [FRAME.hex()], interpretation="MONOCHROME1")
    assert values(spark, white, kind="image", voi="identity", interpretation="keep") == {(1, 0): [float(x) for x in FRAME]}
    assert values(spark, white, kind="image", voi="identity") == {(1, 0): [255.0 - x for x in FRAME]}
    for bad in ({"voi": (1.0,)}, {"voi": (1.0, 2.0, "CUBIC")}, {"interpretation": "x"}):
        with pytest.raises(I.ImageError):
            I.Options(**bad)


def table_rows(at, first, bits, entries, words=False):
    data = [np.array(entries, "<u2").tobytes().hex()] if words else [str(e) for e in entries]
    return {f"{at}.(0028,3002)": [str(len(entries)), str(first), str(bits)], f"{at}.(0028,3006)": data}


def test_tables_of_data_sets(spark):
    """The root's tables stand before those of frames, these before shared ones, all before a window; broken ones don't count."""
    own, shared = "(5200,9230)[{}].(0028,9132)[0].(0028,3010)[0]", "(5200,9229)[0].(0028,9132)[0].(0028,3010)[0]"
    one, two, three = [1, 2, 3, 4], [10, 20, 30, 40], [5, 6, 7, 8]
    at = lambda t, shift=0: [float(t[min(max(x - 1, 0), 3)] << shift) for x in FRAME]
    pixels, window = [(FRAME * 2).hex()], {"(0028,1050)": ["100"], "(0028,1051)": ["50"]}
    root = table_rows("(0028,3010)[0]", 1, 8, one)
    frames = table_rows(own.format(0), 1, 8, two, words=True) | table_rows(own.format(1), 1, 6, three)
    both = table_rows(shared, 1, 8, three)
    got = values(
        spark,
        [
            *rows_of(1, pixels, n_frames=2, **root, **frames, **both, **window),
            *rows_of(2, pixels, n_frames=2, **frames, **both, **window),
            *rows_of(3, pixels, n_frames=2, **both, **window),
            *rows_of(4, pixels, n_frames=2, **(root | {"(0028,3010)[0].(0028,3002)": ["5", "1", "8"]}), **both),
            *rows_of(5, pixels, n_frames=2, **root, **table_rows("(0028,3010)[1]", 1, 8, two)),
            *rows_of(6, pixels, n_frames=2, **table_rows("(0028,3010)[0]", 1, 12, one)),
            *rows_of(7, [(FRAME * 3).hex()], n_frames=3, **root, **table_rows("(0028,3010)[1]", 1, 8, two)),
        ],
        kind="image",
    )
    assert got[1, 0] == got[1, 1] == at(one)
    assert (got[2, 0], got[2, 1]) == (at(two), at(three, 2))
    assert got[3, 0] == got[3, 1] == got[4, 0] == at(three)
    assert (got[5, 0], got[5, 1]) == (at(one), at(two))
    assert "a table of 12 bits" in got[6, 0]
    assert (got[7, 1], got[7, 2]) == (at(two), "no table of the frame")


def test_one_table_for_many_frames():
    I.composed_table.cache_clear()
    a = {"samples": 1, "interpretation": "MONOCHROME2", "allocated": 16, "stored": 12, "signed": 0, "slope": 2.0, "intercept": 0.0, "center": None, "width": None, "function": "LINEAR", "n_tables": 1, "first": 0, "bits": 12, "entries": np.arange(4096, dtype="<u2").tobytes()}
    for k in range(1000):
        I.image_values(np.full((4, 1), k, np.uint16), dict(a), I.Options())
    assert I.composed_table.cache_info().misses == 1


def test_frames_in_proportion(spark):
    """Frames are cut in one pass: also those of many fragments by an offset table, in which frames may be empty."""
    n = 500
    pieces = [bytes([k % 256] * (1 + k % 5)) for k in range(2 * n)]
    sizes = np.array([(len(p) + 1) // 2 * 2 + 8 for p in pieces])
    starts = (np.cumsum(sizes) - sizes)[::2]
    rows = rows_of(1, [starts.astype("<u4").tobytes().hex(), *(p.hex() for p in pieces)], n_frames=n)
    frame = spark.createDataFrame(rows, ELEMENTS)
    got = {r.frame: bytes(r.data) for r in I.frame_bytes(frame, I.image_attributes(frame)).collect()}
    assert got == {k: pieces[2 * k] + pieces[2 * k + 1] for k in range(n)}


@pytest.mark.parametrize("data", [b"", b"a", b"aa", b"aab", b"aaab", b"abcabc" * 50, b"a" * 127, b"a" * 128, b"a" * 129, b"a" * 257 + b"bc" + b"d" * 3, bytes(range(256)) * 2])
def test_run_lengths(data):
    packed = codec.pack_bits(data)
    assert codec.unpack_bits(packed, len(data)) == data and len(packed) % 2 == 0 and len(packed) <= len(data) + len(data) // 64 + 4


def test_colours(spark):
    """Luminance and differences become colours as the column functions say; planes are put together by pixel."""
    ybr = bytes([50, 128, 128, 200, 90, 160])
    kind = {"samples": 3, "interpretation": "YBR_FULL", "rows": 1, "columns": 2}
    got = values(spark, rows_of(1, [ybr.hex()], **kind), kind="image")[1, 0]
    expected = spark.range(1).select(*[c for k in (0, 3) for c in pixels.ybr_to_rgb(*[F.lit(x) for x in ybr[k : k + 3]])]).first()
    assert got == [float(x) for x in expected]
    planes = values(spark, rows_of(1, ["0102030405060708090a0b0c0d0e0f101112"], samples=3, interpretation="RGB", planar=1), kind="image")[1, 0]
    assert planes[:6] == [1.0, 7.0, 13.0, 2.0, 8.0, 14.0]
    assert "colours of" in values(spark, rows_of(1, [ybr.hex()], **(kind | {"interpretation": "YBR_ICT"})), kind="image")[1, 0]


def test_no_images(spark):
    rows = rows_of(1, ["00"], rows=None) + rows_of(2, ["00"]) + rows_of(3, ["", "00"], n_frames=0) + rows_of(4, ["00" * 6], allocated=12) + rows_of(5, [FRAME.hex()]) + rows_of(6, ["", "aa", "bb", "cc"], n_frames=2)
    got = values(spark, rows)
    assert got[1, None] == "no rows" and got[3, None] == "no frames" and got[4, None] == "bits of another depth"
    assert isinstance(got[2, 0], str) and got[5, 0] == [float(x) for x in FRAME] and got[6, 0] == got[6, 1] == "no such frame"
    assert "no decoder" in values(spark, rows_of(1, ["", "00"]), "1.2.840.10008.1.2.4.50")[1, 0]
    more = I.decode_frames(spark.createDataFrame(rows_of(1, ["", "00"]), ELEMENTS), "9", decoders={"9": lambda data, a: np.full((6, 1), 7, np.uint8)})
    assert more.first()["values"] == [7.0] * 6
    assert values(spark, []) == {}


@pytest.mark.parametrize(("size", "pieces"), [(0, ["0001027f80ff"]), (4, ["0001027f", "80ff0000"]), (5, ["0001027f80ff"]), (2, ["0001", "027f", "80ff"])])
def test_cutting(spark, size, pieces):
    out = cut_fragments(spark.createDataFrame([(1, FRAME), (2, b"")], "i int, d binary"), "d", size).orderBy("i", "fragment").collect()
    assert [bytes(r.d).hex() for r in out if r.i == 1] == pieces
    assert [bytes(r.d).hex() for r in out if r.i == 2] == ["00" * (size + size % 2)]


def test_transcoding_and_import(spark):
    rows = rows_of(1, [(FRAME + FRAME[::-1]).hex()], n_frames=2) + rows_of(2, ["00"])
    frame = spark.createDataFrame(rows, ELEMENTS)
    there = I.transcode(frame, codec.EXPLICIT, RLE)
    held = {(r.instance, r.path): r["values"] for r in there.collect()}
    assert len(held[1, "(7FE0,0010)"]) == 3 and held[2, "(7FE0,0010)"] == ["00"]
    assert int.from_bytes(bytes.fromhex(held[1, "(7FE0,0010)"][0])[4:], "little") == 8 + len(held[1, "(7FE0,0010)"][1]) // 2
    back = {(r.instance, r.path): r["values"] for r in I.transcode(there, RLE, codec.EXPLICIT).collect()}
    assert back[1, "(7FE0,0010)"] == [(FRAME + FRAME[::-1]).hex()]
    with pytest.raises(I.ImageError):
        I.transcode(frame, codec.EXPLICIT, "1.2.840.10008.1.2.4.50")
    files = spark.createDataFrame([(1, b"P6\n# c\n2 1\n255\n" + b"\1\2\3\4\5\6"), (2, b"P5 2 1 9999 \0"), (3, None)], "instance long, file binary")
    new = I.insert_images(frame, files, "file")
    assert values(spark, [tuple(r) for r in new.where("instance = 1").collect()], kind="image") == {(1, 0): [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]}
    assert new.where("instance = 2").count() == len(rows_of(2, ["00"]))


@pytest.mark.parametrize("part_rows", [1, 7, 1000])
def test_offsets_in_parts(spark, part_rows):
    """A running sum in parts is the one in a piece, for a key with most rows, gaps in the order, and a NULL key."""
    rows = [(None if i % 11 == 0 else i % 3 // 2, i * 37 % 101 * 10 + i % 5, i % 50) for i in range(97)]
    frame = spark.createDataFrame(rows, "k int, at long, n long")
    got = sorted((r.k is None, r.k, r.at, r.offset) for r in offset_table(frame, "k", "at", frame.n, part_rows).collect())
    expected = []
    for k in (0, 1, None):
        total = 0
        for _, at, n in sorted(r for r in rows if r[0] == k):
            expected.append((k is None, k, at, total))
            total += n + n % 2 + 8
    assert sorted(got, key=str) == sorted(expected, key=str)


def test_tables_composed_by_rows(spark):
    """Rows with the same parameters share one table; parameters that give none have a problem."""
    kind = "bits int, signed boolean, slope double, intercept double, center double, width double, function string, first int, entry_bits int, entries binary"
    window, table = (8, True, 1.0, 0.0, 10.0, 20.0, "LINEAR", None, None, None), (4, False, 1.0, 0.0, None, None, None, 2, 4, bytes([1, 0, 2, 0, 3, 0]))
    rows = [(1, *window), (2, *window), (3, *table), (4, 0, *window[1:]), (5, 8, True, 1.0, 0.0, *[None] * 6), (6, *[None] * 10), (7, 8, False, 1.0, 0.0, *[None] * 6)]
    keyed, tables = I.composed_tables(spark.createDataFrame(rows, "id int, " + kind))
    assert tables.count() == 6
    got = {r.id: (np.frombuffer(bytes(r["values"]), "<u2").tolist() if r["values"] is not None else None, r.problem) for r in keyed.join(tables, "table").collect()}
    assert got[1] == got[2] and got[1][0][:2] == [0, 13] and len(got[1][0]) == 256
    assert got[3][0] == [1, 1, 1, 2, 3, *[3] * 11] and got[7][0] == list(range(256))
    assert "samples of 0 bits" in got[4][1] and "values from" in got[5][1] and got[6][1]
    value = keyed.where("id = 7").join(tables, "table").select(I.table_value(F.col("values"), F.lit(300), F.col("bits"))).first()[0]
    assert value == 300 & 255
