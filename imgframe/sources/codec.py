"""Binary data sets of explicit, implicit or big-endian form, and codecs of pixel data.

A data set is decoded from one row of binary, in Arrow batches: reading a header says where the next one is, which no
column function can express. It is encoded from its elements in the order of their paths, as they stream past. Nested
sequences become elements with longer paths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator, Mapping
from dataclasses import dataclass, field, replace
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import tags
from ..operators import meta
from ..operators.dictionary import SEED
from ..operators.elements import ELEMENTS

UNDEFINED = 0xFFFFFFFF
ITEM, ITEM_END, SEQUENCE_END = 0xFFFEE000, 0xFFFEE00D, 0xFFFEE0DD
LONG_VRS = frozenset("OB OD OF OL OV OW SQ SV UC UN UR UT UV".split())
VRS = LONG_VRS | frozenset("AE AS AT CS DA DS DT FD FL IS LO LT PN SH SL SS ST TM UI UL US".split())
NUMBERS = {"US": "H", "SS": "h", "UL": "I", "SL": "i", "UV": "Q", "SV": "q", "FL": "f", "FD": "d"}
BYTES = frozenset("OB OD OF OL OV OW UN".split())
MAGIC = b"DICM"
#: What decoded elements may hold before they are passed on.
BATCH_BYTES, BATCH_ROWS = 8 << 20, 20_000
PIXEL_DATA, CHARSET, TRANSFER_SYNTAX = 0x7FE00010, 0x00080005, 0x00020010
IMPLICIT, EXPLICIT, BIG, DEFLATED = "1.2.840.10008.1.2", "1.2.840.10008.1.2.1", "1.2.840.10008.1.2.2", "1.2.840.10008.1.2.1.99"

#: Python's names of character sets, by the number in ``ISO_IR n`` and ``ISO 2022 IR n`` or by name.
CHARSETS = {"6": "ascii", "13": "shift_jis", "58": "gb2312", "87": "iso2022_jp", "100": "latin_1", "101": "iso8859_2", "109": "iso8859_3", "110": "iso8859_4", "126": "iso8859_7", "127": "iso8859_6", "138": "iso8859_8", "144": "iso8859_5", "148": "iso8859_9", "149": "euc_kr", "166": "cp874", "192": "utf_8", "GB18030": "gb18030", "GBK": "gbk"}
#: Text of these is never in the declared character set.
PLAIN_TEXT = frozenset("AE AS CS DA DS DT IS TM UI UR".split())
KNOWN_VRS = {tag: vr for tag, _, _, vr in SEED if vr in VRS}


class DecodeError(ValueError):
    """The bytes are no data set."""


class EncodeError(ValueError):
    """Values that their representation or the declared character set can't hold."""


def charset_of(name: str) -> str | None:
    """Python's name of a declared character set; None for an unknown one."""
    return CHARSETS.get(name.strip().removeprefix("ISO_IR ").removeprefix("ISO 2022 IR "))


def _values(vr: str, data: bytes, charset: str, order: str = "<") -> list[str]:
    if not data:
        return []
    if vr in NUMBERS:
        code = order + NUMBERS[vr]
        size = struct.calcsize(code)
        return [repr(x) for (x,) in struct.iter_unpack(code, data[: len(data) // size * size])]
    if vr == "AT":
        return [f"({g:04X},{e:04X})" for g, e in struct.iter_unpack(f"{order}HH", data[: len(data) // 4 * 4])]
    if vr in BYTES:
        return [_swapped(vr, data, order).hex()]
    text = data.decode(charset, "replace").rstrip("\0 ")
    return [text] if vr in ("LT", "ST", "UT", "UR") else text.split("\\")


def _swapped(vr: str, data: bytes, order: str) -> bytes:
    """Words in little-endian order, whatever the data set's."""
    width = {"OW": 2, "OF": 4, "OL": 4, "OD": 8, "OV": 8}.get(vr, 1)
    return data if order == "<" or width == 1 or len(data) % width else np.frombuffer(data, f">u{width}").astype(f"<u{width}").tobytes()


def _bytes(vr: str, values: list[str], charset: str = "utf_8", order: str = "<") -> bytes:
    try:
        if vr in NUMBERS:
            kind = float if vr in ("FL", "FD") else int
            return b"".join(struct.pack(order + NUMBERS[vr], kind(v)) for v in values)
        if vr == "AT":
            return b"".join(struct.pack(f"{order}HH", int(v[1:5], 16), int(v[6:10], 16)) for v in values)
        data = _swapped(vr, bytes.fromhex("".join(values)), order) if vr in BYTES else "\\".join(values).encode("utf_8" if vr in PLAIN_TEXT else charset)
    except (ValueError, struct.error) as e:
        raise EncodeError(f"{vr} can't hold {values!r:.80}: {e}") from e
    return data + (b"\0" if vr == "UI" or vr in BYTES else b" ") * (len(data) % 2)


#: (kind, path, tag, vr, length, start, end) with kind one of: element, sequence, item, item_end, sequence_end,
#: pixels, offset_table, fragment. start and end are of the value in ``Reader.data``, which is not looked at.
Token = tuple[str, str, int, str, int, int, int]


class Bytes(Protocol):
    """Bytes, or what gives them by slices."""

    def __len__(self) -> int: ...
    def __getitem__(self, part: slice) -> bytes: ...


class Reader:
    """Reads one data set's headers.

    explicit: None finds out: after magic, a meta table in explicit form says the form of the rest, which may be big
    endian or deflated; without, the first element shows it. odd: what to do about odd lengths: accept, next_even or
    fail. preamble: always or never skips 128 bytes, auto where magic follows them. vrs: representations by tag, for
    the implicit form. until: the first root tag from which on nothing is read. data: bytes, or what has a length and
    gives bytes by slices, of which only headers and what says the form are taken.
    """

    def __init__(self, data: Bytes, explicit: bool | None = True, until: int | None = None, odd: str = "accept", preamble: str = "auto", vrs: Mapping[int, str] = KNOWN_VRS, big: bool = False):
        self.data, self.until, self.odd, self.vrs = data, until, odd, vrs
        at = 128 if preamble == "always" or preamble == "auto" and data[128:132] == MAGIC else 0
        self.at = at + 4 if data[at : at + 4] == MAGIC else at
        self.in_meta = explicit is None and self.at > at
        if explicit is None:
            explicit = self.in_meta or data[self.at + 4 : self.at + 6].decode("ascii", "replace") in VRS
        self.explicit, self.order, self.syntax = explicit, ">" if big else "<", ""

    def header(self, at: int) -> tuple[int, str, int, int]:
        """(tag, vr, length, where the value begins)."""
        head, order = self.data[at : at + 12], self.order
        if len(head) < 8:
            raise DecodeError(f"cut off at {at}")
        group, element = struct.unpack_from(f"{order}HH", head)
        tag = group << 16 | element
        if group == 0xFFFE or not self.explicit:
            return tag, "" if group == 0xFFFE else self.vrs.get(tag, "UN"), struct.unpack_from(f"{order}I", head, 4)[0], at + 8
        vr = head[4:6].decode("ascii", "replace")
        vr = vr if vr in VRS else "UN"
        if vr in LONG_VRS:
            if len(head) < 12:
                raise DecodeError(f"cut off at {at}")
            return tag, vr, struct.unpack_from(f"{order}I", head, 8)[0], at + 12
        return tag, vr, struct.unpack_from(f"{order}H", head, 6)[0], at + 8

    def tokens(self) -> Iterator[Token]:
        yield from self._elements(self.at, len(self.data), "")

    def _even(self, length: int, path: str) -> int:
        if length % 2 and self.odd == "fail":
            raise DecodeError(f"{path} has an odd length")
        return length + (length % 2 if self.odd == "next_even" else 0)

    def _elements(self, at: int, end: int, prefix: str) -> Iterator[Token]:
        while at < end:
            if self.in_meta and not prefix and self.data[at : at + 2] != b"\2\0":
                self.in_meta, self.explicit, self.order = False, self.syntax != IMPLICIT, ">" if self.syntax == BIG else "<"
                if self.syntax == DEFLATED:
                    self.data = self.data[:at] + inflate(self.data[at:])
                    end = len(self.data)
            tag, vr, length, start = self.header(at)
            if tag in (ITEM_END, SEQUENCE_END):
                return start
            if not prefix and self.until is not None and tag >= self.until:
                return end
            path = f"{prefix}({tag >> 16:04X},{tag & 0xFFFF:04X})"
            if tag == PIXEL_DATA and length == UNDEFINED:
                yield "pixels", path, tag, "OB", length, start, start
                at = yield from self._fragments(start, path)
            elif vr == "SQ" or length == UNDEFINED:
                yield "sequence", path, tag, "SQ", length, start, start
                at = yield from self._items(start, start + length if length != UNDEFINED else end, path)
                yield "sequence_end", path, tag, "SQ", 0, at, at
            else:
                length = self._even(length, path)
                if start + length > end:
                    raise DecodeError(f"{path} runs over the end")
                if tag == TRANSFER_SYNTAX:
                    self.syntax = self.data[start : start + length].decode("ascii", "replace").rstrip("\0 ")
                yield "element", path, tag, vr, length, start, start + length
                at = start + length
        return at

    def _items(self, at: int, end: int, path: str) -> Iterator[Token]:
        n = 0
        while at < end:
            tag, _, length, start = self.header(at)
            if tag == SEQUENCE_END:
                return start
            if tag != ITEM:
                raise DecodeError(f"no item in {path}")
            item = f"{path}[{n}]"
            yield "item", item, tag, "", length, start, start
            at = yield from self._elements(start, start + length if length != UNDEFINED else end, item + ".")
            yield "item_end", item, tag, "", 0, at, at
            n += 1
        return at

    def _fragments(self, at: int, path: str) -> Iterator[Token]:
        kind = "offset_table"
        while True:
            tag, _, length, start = self.header(at)
            if tag == SEQUENCE_END:
                yield "sequence_end", path, tag, "OB", 0, start, start
                return start
            if tag != ITEM or start + length > len(self.data):
                raise DecodeError("no fragment")
            yield kind, path, tag, "OB", length, start, start + length
            kind, at = "fragment", start + length


def decode(data: bytes, explicit: bool | None = True, until: int | None = None, odd: str = "accept", any_vr: bool = False, **options) -> Iterator[tuple[str, int, str, list[str]]]:
    """(path, tag, vr, values) in order; see ``Reader`` for the options.

    The first declared character set counts for what follows, but not for types of plain text unless ``any_vr``; an
    unknown one changes nothing. Encapsulated pixel data has the offset table as its first value, then fragments.
    """
    reader = Reader(data, explicit, until, odd, **options)
    charset, plain = "utf_8", frozenset() if any_vr else PLAIN_TEXT
    pixels: tuple | None = None
    for kind, path, tag, vr, _, start, end in reader.tokens():
        if kind == "element":
            values = _values(vr, reader.data[start:end], "utf_8" if vr in plain else charset, reader.order)
            yield path, tag, vr, values
            if tag == CHARSET and values:
                charset = charset_of(values[0]) or charset
        elif kind == "sequence":
            yield path, tag, vr, []
        elif kind == "pixels":
            pixels = (path, tag, vr, [])
        elif kind in ("offset_table", "fragment"):
            pixels[3].append(reader.data[start:end].hex())
        elif kind == "sequence_end" and pixels is not None:
            yield pixels
            pixels = None


class Writer:
    """Puts one data set together from elements in the order of their paths."""

    def __init__(self, explicit: bool = True, big: bool = False, charset: str = "utf_8"):
        self.explicit, self.order, self.charset = explicit, ">" if big else "<", charset
        self.out = bytearray()
        self.open: list[tuple[str, int]] = []  # sequences and the last item begun in each

    def _head(self, tag: int, vr: str, length: int) -> None:
        order = self.order
        self.out += struct.pack(f"{order}HH", tag >> 16, tag & 0xFFFF)
        if not self.explicit or tag >> 16 == 0xFFFE:
            self.out += struct.pack(f"{order}I", length)
        elif vr in LONG_VRS:
            self.out += vr.encode() + struct.pack(f"{order}HI", 0, length)
        elif length > 0xFFFF:
            raise EncodeError(f"{length} bytes are too long for {vr}")
        else:
            self.out += vr.encode() + struct.pack(f"{order}H", length)

    def _close(self, keep: int) -> None:
        while len(self.open) > keep:
            _, item = self.open.pop()
            if item >= 0:
                self._head(ITEM_END, "", 0)
            self._head(SEQUENCE_END, "", 0)

    def _enter(self, path: str) -> None:
        """Closes and opens what lies between the last element and one at ``path``."""
        depth, at = 0, 0
        while (cut := path.find("].", at)) >= 0:
            sequence, _, item = path[:cut].rpartition("[")
            if depth >= len(self.open) or self.open[depth][0] != sequence:
                self._close(depth)
                tag = sequence.rsplit(".", 1)[-1]
                self._head(int(tag[1:5] + tag[6:10], 16), "SQ", UNDEFINED)
                self.open.append((sequence, -1))
            begun, wanted = self.open[depth][1], int(item)
            if begun != wanted:
                self._close(depth + 1)
                for n in range(begun + 1, wanted + 1):  # items without elements in between
                    if n > 0 and (n > begun + 1 or begun >= 0):
                        self._head(ITEM_END, "", 0)
                    self._head(ITEM, "", UNDEFINED)
                self.open[depth] = (sequence, wanted)
            depth, at = depth + 1, cut + 2
        self._close(depth)

    def put(self, path: str, tag: int, vr: str, values: list[str]) -> None:
        if self.open or "[" in path:
            self._enter(path)
        if vr == "SQ":
            self._head(tag, vr, UNDEFINED)
            self.open.append((path, -1))
        elif tag == PIXEL_DATA and len(values) > 1:
            self._head(tag, vr, UNDEFINED)
            for fragment in map(bytes.fromhex, values):
                self._head(ITEM, "", len(fragment) + len(fragment) % 2)
                self.out += fragment + b"\0" * (len(fragment) % 2)
            self._head(SEQUENCE_END, "", 0)
        else:
            body = _bytes(vr, values, self.charset, self.order)
            self._head(tag, vr, len(body))
            self.out += body
            if tag == CHARSET and values:
                self.charset = charset_of(values[0]) or self.charset

    def done(self) -> bytes:
        self._close(0)
        return bytes(self.out)


def path_order(path: str) -> tuple:
    """The order in which paths stand in a data set: by tag, then item."""
    return tuple((step[:11], int(step[12:-1] or 0)) for step in path.split("."))


def encode(rows: list[tuple[str, int, str, list[str]]], explicit: bool = True, big: bool = False) -> bytes:
    """The bytes of (path, tag, vr, values), sorted by path; sequences get undefined lengths.

    Text goes in the declared character set, UTF-8 where none is; what it can't hold is an ``EncodeError``.
    """
    writer = Writer(explicit, big)
    for row in sorted(rows, key=lambda r: path_order(r[0])):
        writer.put(*row)
    return writer.done()


def decode_datasets(rows: DataFrame, instance: str, column: str, explicit: bool | None = True, until: int | None = None, odd: str = "accept", **options) -> DataFrame:
    """Elements of the data sets in a binary column. Bytes that are no data set give one row with a NULL path."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(element_batch)
        for batch in batches:
            for i in range(batch.num_rows):
                key = batch.column(0)[i].as_py()
                data = batch.column(1)[i].as_py() or b""
                try:
                    found = [(key, *e) for e in decode(data, explicit, until, odd, **options)]
                except (DecodeError, struct.error, zlib.error):
                    found = [(key, None, None, None, None)]
                yield from held.add(found, 2 * len(data))
        yield from held.rest()

    return rows.select(F.col(instance).cast("long"), F.col(column)).mapInArrow(run, ELEMENTS)


class _Held:
    """Rows that are held until they are worth a batch: a bounded number of them, and bytes beside those of one data set."""

    def __init__(self, batch: Callable[[list[tuple]], pa.RecordBatch]):
        self.batch, self.out, self.size = batch, [], 0

    def add(self, rows: list[tuple], size: int) -> Iterator[pa.RecordBatch]:
        self.out += rows
        self.size += size
        if self.size >= BATCH_BYTES or len(self.out) >= BATCH_ROWS:
            yield from self.rest()

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.out:
            yield self.batch(self.out)
        self.out, self.size = [], 0


def element_batch(rows: list[tuple], first: str = "instance", kind: pa.DataType = pa.int64()) -> pa.RecordBatch:
    """(key, path, tag, vr, values) as a batch; values go as one flat array with offsets."""
    keys, paths, names, vrs, values = zip(*rows, strict=True) if rows else [()] * 5
    sizes = np.fromiter((len(v) if v is not None else 0 for v in values), np.int32, len(values))
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.array([x for v in values if v for x in v], pa.string()), mask=pa.array([v is None for v in values], pa.bool_()))
    return pa.RecordBatch.from_arrays([pa.array(keys, kind), pa.array(paths, pa.string()), pa.array(names, pa.int64()), pa.array(vrs, pa.string()), lists], [first, "path", "tag", "vr", "values"])


TOKENS = "instance long, place int, kind string, path string, tag long, vr string, length long, value binary"


def token_rows(rows: DataFrame, instance: str, column: str, explicit: bool | None = True, values: bool = True, **options) -> DataFrame:
    """(instance, place, kind, path, tag, vr, length, value) of each data set in a binary column, in the order of its bytes.

    Kinds: see ``Token``. Without ``values`` (the lazy form) no value is taken out, only headers are read. Bytes that
    are no data set end in a row of the kind ``error``.
    """

    def tokens(key: int, data: bytes) -> Iterator[tuple]:
        place, reader = 0, Reader(data, explicit, **options)
        try:
            for place, (kind, path, tag, vr, length, start, end) in enumerate(reader.tokens(), 1):
                yield key, place - 1, kind, path, tag, vr, length, reader.data[start:end] if values and kind in ("element", "offset_table", "fragment") else None
        except (DecodeError, struct.error, zlib.error):
            yield key, place, "error", None, None, None, None, None

    kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
    return _by_data_set(rows, instance, column, tokens, kinds, TOKENS)


def _by_data_set(rows: DataFrame, instance: str, column: str, each: Callable[[int, bytes], Iterator[tuple]], kinds: tuple[pa.DataType, ...], schema: str) -> DataFrame:
    """What ``each`` gives for each data set in a binary column; values, which are last, are held in bounded batches."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(lambda out: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names))
        for batch in batches:
            for i in range(batch.num_rows):
                for row in each(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""):
                    yield from held.add([row], len(row[-1] or b""))
        yield from held.rest()

    return rows.select(F.col(instance).cast("long"), F.col(column)).mapInArrow(run, schema)


def pixel_fragments(rows: DataFrame, instance: str, column: str, explicit: bool | None = True, **options) -> DataFrame:
    """(instance, fragment, data): one row for each fragment of pixel data, from 0; native pixel data is one fragment.

    The offset table of encapsulated pixel data is fragment -1; native data has none. Fragments are numbered as they are
    read; bytes that are no data set have what comes before the error.
    """

    def fragments(key: int, data: bytes) -> Iterator[tuple]:
        reader, number = Reader(data, explicit, **options), -1
        try:
            for kind, path, _, _, _, start, end in reader.tokens():
                if kind == "element" and path == "(7FE0,0010)":
                    yield key, 0, reader.data[start:end]
                elif kind in ("offset_table", "fragment"):
                    yield key, number, reader.data[start:end]
                    number += 1
        except (DecodeError, struct.error, zlib.error):
            return

    return _by_data_set(rows, instance, column, fragments, (pa.int64(), pa.int32(), pa.binary()), "instance long, fragment int, data binary")


@dataclass(frozen=True)
class ReadOptions:
    """How data sets are read; each method gives new options with one of them changed.

    until and up_to: nothing is read from the first root tag that is not less than, or is greater than, theirs; both
    may be set. The rest: see ``Reader`` and ``decode``.
    """

    until: int | None = None
    up_to: int | None = None
    odd: str = "accept"
    preamble: str = "auto"
    any_vr: bool = False
    vrs: Mapping[int, str] = field(default_factory=lambda: KNOWN_VRS)

    def __post_init__(self):
        if self.odd not in ("accept", "next_even", "fail") or self.preamble not in ("auto", "always", "never"):
            raise ValueError(f"no such option: {self}")

    def read_until(self, tag: int) -> ReadOptions:
        return replace(self, until=tag)

    def read_to(self, tag: int) -> ReadOptions:
        return replace(self, up_to=tag)

    def read_all(self) -> ReadOptions:
        return replace(self, until=None, up_to=None)

    def with_dictionary(self, entries: Mapping[int, str]) -> ReadOptions:
        """With representations by tag beside those known, for the implicit form."""
        return replace(self, vrs={**self.vrs, **entries})

    def arguments(self) -> dict:
        ends = [t for t in (self.until, None if self.up_to is None else self.up_to + 1) if t is not None]
        return {"until": min(ends, default=None), "odd": self.odd, "preamble": self.preamble, "any_vr": self.any_vr, "vrs": self.vrs}


def open_files(spark: SparkSession, path: str, options: ReadOptions = ReadOptions()) -> DataFrame:
    """``read_files`` with ``ReadOptions``."""
    return read_files(spark, path, **options.arguments())


def read_files(spark: SparkSession, path: str, until: int | None = None, odd: str = "accept", **options) -> DataFrame:
    """(file, path, tag, vr, values) of all files under a folder, in any form; a file that is no data set has one row with a NULL path.

    Files are dealt to tasks whole, by Spark's own reader; elements from ``until`` on are not decoded.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                try:
                    out = [(name, *e) for e in decode(batch.column(1)[i].as_py() or b"", None, until, odd, **options)]
                except (DecodeError, struct.error, zlib.error):
                    out = [(name, None, None, None, None)]
                yield element_batch(out, "file", pa.string())

    return files.mapInArrow(run, ELEMENTS.replace("instance long", "file string"))


META_FIELDS = "error string, information_version string, " + ", ".join(f"{c} string" for c in meta.COLUMNS.values())


def read_meta(data: Bytes) -> dict[str, str | None]:
    """The meta table of a file's bytes by column; only its own elements are read, unknown ones are skipped.

    A ``DecodeError`` says what is wrong: no magic, no group length first, or no transfer syntax. The version is 0001
    where there is none, identifiers of class and instance are empty.
    """
    at = 128 if data[128:132] == MAGIC else 0
    if data[at : at + 4] != MAGIC:
        raise DecodeError("no magic")
    reader = Reader(data, True, preamble="always" if at else "never")
    tag, _, length, start = reader.header(reader.at)
    if tag != 0x00020000 or length != 4:
        raise DecodeError("no group length")
    end = start + 4 + struct.unpack("<I", data[start : start + 4])[0]
    found = {tag: data[a:b] for _, _, tag, _, _, a, b in Reader(data[:end], True, preamble="always" if at else "never").tokens()}
    texts = {c: found[t].decode("ascii", "replace").rstrip("\0 ") if t in found else None for t, c in meta.COLUMNS.items()}
    if not texts["transfer_syntax"]:
        raise DecodeError("no transfer syntax")
    ids = ("media_storage_sop_class_uid", "media_storage_sop_instance_uid")
    return {"information_version": found.get(0x00020001, b"\0\1").hex(), **texts, **{c: texts[c] or "" for c in ids}}


def meta_tables(rows: DataFrame, instance: str, column: str) -> DataFrame:
    """(instance, error, information_version, …): the meta table of each file in a binary column, or why there is none."""
    names = [f.split()[0] for f in META_FIELDS.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for data in batch.column(1).to_pylist():
                try:
                    out.append(read_meta(data or b""))
                except (DecodeError, struct.error) as e:
                    out.append({"error": str(e)})
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([r.get(c) for r in out], pa.string()) for c in names)], ["instance", *names])

    return rows.select(F.col(instance).cast("long"), F.col(column)).mapInArrow(run, f"instance long, {META_FIELDS}")


def write_file(elements: list[tuple[str, int, str, list[str]]], explicit: bool = True, syntax: str | None = None) -> bytes:
    """A file's bytes: preamble, magic, meta table and data set in the form that ``syntax`` says."""
    syntax = syntax or (EXPLICIT if explicit else IMPLICIT)
    return file_of(syntax, encode(elements, syntax != IMPLICIT, syntax == BIG))


def file_of(syntax: str, body: bytes) -> bytes:
    table = encode([("(0002,0010)", TRANSFER_SYNTAX, "UI", [syntax])])
    return b"\0" * 128 + MAGIC + encode([("(0002,0000)", 0x00020000, "UL", [str(len(table))])]) + table + (deflate(body) if syntax == DEFLATED else body)


#: Paths whose items have two digits or more sort by their numbers: each item is written with ten digits to sort by.
def sort_key(path: Column) -> Column:
    return F.when(path.contains("["), F.regexp_replace(F.regexp_replace(path, r"\[(\d+)\]", "[0000000000$1]"), r"\[0*(\d{10})\]", "[$1]")).otherwise(path)


def encode_datasets(elements: DataFrame, explicit: bool = True, big: bool = False, syntax: str | None = None) -> DataFrame:
    """(instance, data): the bytes of each data set; with ``syntax`` those of a whole file in that transfer syntax.

    Elements are dealt by instance and stream past in the order of their paths; a task holds one data set at a time.
    What can't be encoded is an ``EncodeError``.
    """
    form = (syntax != IMPLICIT, syntax == BIG) if syntax else (explicit, big)
    rows = elements.select("instance", "path", "tag", "vr", "values")
    # A window and no repartition(): what is dealt by instance already is not dealt again.
    rows = rows.withColumn("_place", F.row_number().over(Window.partitionBy("instance").orderBy(sort_key(F.col("path")))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, writer = None, None
        finish = lambda: file_of(syntax, writer.done()) if syntax else writer.done()
        for batch in batches:
            ids, data = [], []
            lists = batch.column("values")
            flat, ends = lists.values.to_pylist(), lists.offsets.to_numpy().tolist()
            for i, (instance, path, tag, vr) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("instance", "path", "tag", "vr")), strict=True)):
                if instance != key or writer is None:
                    if writer is not None:
                        ids.append(key)
                        data.append(finish())
                    key, writer = instance, Writer(*form)
                writer.put(path, tag, vr, flat[ends[i] : ends[i + 1]])
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["instance", "data"])
        if writer is not None:
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array([finish()], pa.binary())], ["instance", "data"])

    return rows.mapInArrow(run, "instance long, data binary")


def write_files(elements: DataFrame, folder: str, syntax: str = EXPLICIT) -> None:
    """Writes a table (instance, data) of whole files in place of what ``folder`` held, one row a file.

    Parquet holds the bytes, as millions of small files serve no cluster; ``decode_datasets`` reads the column back.
    """
    encode_datasets(elements, syntax=syntax).write.mode("overwrite").parquet(folder)


def pack_bits(data: bytes) -> bytes:
    """Run-length encoding of one segment, padded to an even length: runs of three or more, and what is between them."""
    values = np.frombuffer(data, np.uint8)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    lengths = np.diff(np.append(starts, len(values)))
    out, at = bytearray(), 0

    def literal(end: int) -> None:
        for i in range(at, end, 128):
            part = data[i : min(i + 128, end)]
            out.extend(bytes([len(part) - 1]) + part)

    for start, n in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
        literal(start)
        left = n
        while left > 1:
            take = min(left, 128)
            out.extend(bytes([257 - take, data[start]]))
            left -= take
        at = start + n - left  # a last one alone goes with what follows
    literal(len(data))
    return bytes(out) + b"\0" * (len(out) % 2)


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += n + 2
        elif n > 128:
            out += data[at + 1 : at + 2] * (257 - n)
            at += 2
        else:
            at += 1
    return bytes(out[:size])


def rle_encode(frame: np.ndarray) -> bytes:
    """A frame (pixels, samples) of unsigned integers: a segment for each byte of each sample, the highest byte first."""
    width = frame.dtype.itemsize
    planes = frame.astype(frame.dtype.newbyteorder(">")).view(np.uint8).reshape(len(frame), frame.shape[1], width)
    segments = [pack_bits(planes[:, s, b].tobytes()) for s in range(frame.shape[1]) for b in range(width)]
    offsets = 64 + np.cumsum([0, *map(len, segments)])[:-1]
    return struct.pack("<16I", len(segments), *offsets, *[0] * (15 - len(segments))) + b"".join(segments)


def rle_decode(data: bytes, pixels: int, samples: int, dtype: str) -> np.ndarray:
    n, *offsets = struct.unpack_from("<16I", data)
    kind = np.dtype(dtype)
    if n != samples * kind.itemsize:
        raise DecodeError(f"{n} segments")
    ends = [*offsets[1:n], len(data)]
    planes = [np.frombuffer(unpack_bits(data[a:b], pixels), np.uint8) for a, b in zip(offsets[:n], ends, strict=True)]
    stacked = np.stack(planes).reshape(samples, kind.itemsize, pixels).transpose(2, 0, 1)
    return np.ascontiguousarray(stacked).view(kind.newbyteorder(">"))[:, :, 0].astype(kind)


def deflate(data: bytes) -> bytes:
    packer = zlib.compressobj(wbits=-15)
    return packer.compress(data) + packer.flush()


def inflate(data: bytes) -> bytes:
    return zlib.decompressobj(-15).decompress(data)


def round_trip(rows: DataFrame, column: str, codec: str) -> DataFrame:
    """``rows`` (id, array<int> of 16-bit samples) encoded and decoded again, with the encoded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            back, sizes = [], []
            for values in batch.column(1).to_pylist():
                frame = np.array(values, np.uint16)[:, None]
                packed = rle_encode(frame) if codec == "rle" else deflate(frame.astype("<u2").tobytes())
                again = rle_decode(packed, len(frame), 1, "uint16") if codec == "rle" else np.frombuffer(inflate(packed), "<u2")[:, None]
                back.append(again[:, 0].astype(np.int32))
                sizes.append(len(packed))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(back, pa.list_(pa.int32()))], [batch.schema.names[0], column])

    key = rows.columns[0]
    return rows.select(key, column).mapInArrow(run, f"{key} long, {column} array<int>")


def tag_filter(elements: DataFrame, *wanted: int) -> DataFrame:
    """Elements of the given root tags, as a filter that reaches a Parquet scan."""
    return elements.where(F.col("path").isin(*[f"({t >> 16:04X},{t & 0xFFFF:04X})" for t in wanted]) & (tags.group_of(F.col("tag")) >= 0))
