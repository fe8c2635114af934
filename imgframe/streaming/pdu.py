"""Protocol messages as bytes: written by column functions, and read from captured streams in Arrow batches.

A message says its own length, and its items theirs, so in reading, where one begins depends on all before it; that no
column function can express. All numbers are big endian.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.negotiation import MAX_PDU

#: Kinds of messages by their first byte, and of items within them.
KINDS = {1: "associate_rq", 2: "associate_ac", 3: "associate_rj", 4: "p_data", 5: "release_rq", 6: "release_rp", 7: "abort"}
NUMBERS = {kind: n for n, kind in KINDS.items()}
APPLICATION_CONTEXT, PROPOSED, ANSWERED, ABSTRACT, TRANSFER, USER = 0x10, 0x20, 0x21, 0x30, 0x40, 0x50
MAX_LENGTH, IMPLEMENTATION_CLASS, ROLE, IMPLEMENTATION_VERSION, EXTENDED = 0x51, 0x52, 0x54, 0x55, 0x56
HEADER = 6

FIELDS = (
    "kind string, version int, called string, calling string, application_context string, "
    "contexts array<struct<id:int,result:int,abstract_syntax:string,transfer_syntaxes:array<string>>>, "
    "max_length long, implementation_class string, implementation_version string, "
    "roles array<struct<uid:string,scu:boolean,scp:boolean>>, extended array<struct<uid:string,data:binary>>, "
    "result int, source int, reason int, "
    "pdvs array<struct<context:int,command:boolean,last:boolean,data:binary>>, rest binary"
)
TYPES = {
    "kind": pa.string(),
    "version": pa.int32(),
    "called": pa.string(),
    "calling": pa.string(),
    "application_context": pa.string(),
    "contexts": pa.list_(pa.struct([("id", pa.int32()), ("result", pa.int32()), ("abstract_syntax", pa.string()), ("transfer_syntaxes", pa.list_(pa.string()))])),
    "max_length": pa.int64(),
    "implementation_class": pa.string(),
    "implementation_version": pa.string(),
    "roles": pa.list_(pa.struct([("uid", pa.string()), ("scu", pa.bool_()), ("scp", pa.bool_())])),
    "extended": pa.list_(pa.struct([("uid", pa.string()), ("data", pa.binary())])),
    "result": pa.int32(),
    "source": pa.int32(),
    "reason": pa.int32(),
    "pdvs": pa.list_(pa.struct([("context", pa.int32()), ("command", pa.bool_()), ("last", pa.bool_()), ("data", pa.binary())])),
    "rest": pa.binary(),
}


class MessageError(ValueError):
    """The bytes are no message."""


def _text(data: bytes) -> str:
    return data.decode("ascii", "replace").strip("\0 ")


def _items(data: bytes) -> Iterator[tuple[int, bytes]]:
    at = 0
    while at < len(data):
        if at + 4 > len(data):
            raise MessageError("an item is cut off")
        kind, length = data[at], struct.unpack_from(">H", data, at + 2)[0]
        if at + 4 + length > len(data):
            raise MessageError("an item is cut off")
        yield kind, data[at + 4 : at + 4 + length]
        at += 4 + length


def _association(data: bytes) -> dict:
    out = {"version": struct.unpack_from(">H", data)[0], "called": _text(data[4:20]), "calling": _text(data[20:36]), "contexts": [], "roles": [], "extended": []}
    for kind, item in _items(data[68:]):
        if kind == APPLICATION_CONTEXT:
            out["application_context"] = _text(item)
        elif kind in (PROPOSED, ANSWERED):
            parts = list(_items(item[4:]))
            abstract = [_text(d) for k, d in parts if k == ABSTRACT]
            out["contexts"].append({"id": item[0], "result": item[2] if kind == ANSWERED else None, "abstract_syntax": abstract[0] if abstract else None, "transfer_syntaxes": [_text(d) for k, d in parts if k == TRANSFER]})
        elif kind == USER:
            for k, d in _items(item):
                if k == MAX_LENGTH:
                    out["max_length"] = struct.unpack(">I", d)[0]
                elif k == IMPLEMENTATION_CLASS:
                    out["implementation_class"] = _text(d)
                elif k == IMPLEMENTATION_VERSION:
                    out["implementation_version"] = _text(d)
                elif k in (ROLE, EXTENDED):
                    n = struct.unpack_from(">H", d)[0]
                    uid, own = _text(d[2 : 2 + n]), d[2 + n :]
                    if k == ROLE:
                        out["roles"].append({"uid": uid, "scu": bool(own[0]), "scp": bool(own[1])})
                    else:
                        out["extended"].append({"uid": uid, "data": own})
    return out


def _values(data: bytes) -> list[dict]:
    found, at = [], 0
    while at < len(data):
        length = struct.unpack_from(">I", data, at)[0]
        if length < 2 or at + 4 + length > len(data):
            raise MessageError("a value is cut off")
        found.append({"context": data[at + 4], "command": bool(data[at + 5] & 1), "last": bool(data[at + 5] & 2), "data": data[at + 6 : at + 4 + length]})
        at += 4 + length
    return found


def read_message(kind: int, data: bytes) -> dict:
    """The fields of one message from what follows its header."""
    name = KINDS.get(kind)
    if name is None:
        return {"kind": "unknown", "rest": bytes([kind]) + data}
    if name in ("associate_rq", "associate_ac"):
        return {"kind": name, **_association(data)}
    if name == "associate_rj":
        return {"kind": name, "result": data[1], "source": data[2], "reason": data[3]}
    if name == "p_data":
        return {"kind": name, "pdvs": _values(data)}
    if name == "abort":
        return {"kind": name, "source": data[2], "reason": data[3]}
    return {"kind": name}


def read_messages(data: bytes, max_length: int | None = None) -> Iterator[dict]:
    """All messages of a stream of bytes; what is left of one that has not wholly come is of the kind incomplete.

    A message that is no message, or is longer than ``max_length`` allows, is of the kind error and ends the stream.
    """
    at = 0
    while at < len(data):
        if len(data) - at < HEADER:
            yield {"kind": "incomplete", "rest": data[at:]}
            return
        kind, _, length = struct.unpack_from(">BBI", data, at)
        if max_length is not None and length > max_length:
            yield {"kind": "error", "rest": data[at:]}
            return
        if len(data) - at - HEADER < length:
            yield {"kind": "incomplete", "rest": data[at:]}
            return
        try:
            yield read_message(kind, data[at + HEADER : at + HEADER + length])
        except (MessageError, struct.error, IndexError):
            yield {"kind": "error", "rest": data[at:]}
            return
        at += HEADER + length


def _item(kind: int, data: bytes) -> bytes:
    return struct.pack(">BBH", kind, 0, len(data)) + data


def write_message(m: dict) -> bytes:
    """The bytes of one message from its fields, where there is no table of messages: see ``write``."""
    kind = m["kind"]
    if kind == "unknown":
        body, number = m["rest"][1:], m["rest"][0]
    elif kind not in NUMBERS:
        raise MessageError(f"{kind!r} can't be written")
    else:
        number = NUMBERS[kind]
        if kind in ("associate_rq", "associate_ac"):
            body = struct.pack(">HH16s16s32x", m["version"] or 1, 0, (m["called"] or "").ljust(16).encode("ascii"), (m["calling"] or "").ljust(16).encode("ascii"))
            body += _item(APPLICATION_CONTEXT, (m["application_context"] or "").encode("ascii"))
            for c in m["contexts"] or []:
                parts = b"" if c["abstract_syntax"] is None else _item(ABSTRACT, c["abstract_syntax"].encode("ascii"))
                parts += b"".join(_item(TRANSFER, t.encode("ascii")) for t in c["transfer_syntaxes"] or [])
                body += _item(PROPOSED if kind == "associate_rq" else ANSWERED, struct.pack(">BBBB", c["id"], 0, c["result"] or 0, 0) + parts)
            user = _item(MAX_LENGTH, struct.pack(">I", m["max_length"] or 0)) + _item(IMPLEMENTATION_CLASS, (m["implementation_class"] or "").encode("ascii"))
            user += b"".join(_item(ROLE, struct.pack(">H", len(r["uid"])) + r["uid"].encode("ascii") + bytes([r["scu"], r["scp"]])) for r in m["roles"] or [])
            if m["implementation_version"]:
                user += _item(IMPLEMENTATION_VERSION, m["implementation_version"].encode("ascii"))
            user += b"".join(_item(EXTENDED, struct.pack(">H", len(e["uid"])) + e["uid"].encode("ascii") + e["data"]) for e in m["extended"] or [])
            body += _item(USER, user)
        elif kind == "associate_rj":
            body = bytes([0, m["result"], m["source"], m["reason"]])
        elif kind == "p_data":
            body = b"".join(struct.pack(">IBB", len(v["data"]) + 2, v["context"], v["command"] | v["last"] << 1) + v["data"] for v in m["pdvs"] or [])
        elif kind == "abort":
            body = bytes([0, 0, m["source"], m["reason"]])
        else:
            body = b"\0\0\0\0"
    return struct.pack(">BBI", number, 0, len(body)) + body


def parse(rows: DataFrame, key: str, data: str, max_length: int | None = None) -> DataFrame:
    """(key, place, …): the messages in a binary column, one row each, with the fields of ``FIELDS``; see ``read_messages``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_kind: dict[str, list[tuple[int, int, dict]]] = {}
            for i in range(batch.num_rows):
                k, held = batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b""
                for place, message in enumerate(read_messages(held, max_length)):
                    by_kind.setdefault(message["kind"], []).append((k, place, message))
            for kind, found in by_kind.items():
                keys, places, messages = zip(*found, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(places, pa.int32()), *_columns(kind, messages)], [key, "place", *TYPES])

    return rows.select(F.col(key).cast("long"), F.col(data)).mapInArrow(run, f"`{key}` long, place int, {FIELDS}")


def _columns(kind: str, messages: Sequence[dict]) -> list[pa.Array]:
    """The fields of messages of one kind: those that it lacks are nulls, and data values are flat arrays with offsets."""
    n = len(messages)
    held = {c for m in messages for c in m} if kind.startswith("associate") else set(messages[0])
    out = []
    for c, t in TYPES.items():
        if c not in held:
            out.append(pa.nulls(n, t))
        elif c == "pdvs":
            offsets = np.concatenate([[0], np.cumsum([len(m["pdvs"]) for m in messages])]).astype(np.int32)
            flat = [v for m in messages for v in m["pdvs"]]
            fields = t.value_type
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays([pa.array([v[f.name] for v in flat], f.type) for f in fields], fields=list(fields))))
        else:
            out.append(pa.array([m.get(c) for m in messages], t))
    return out


def complete(messages: DataFrame) -> DataFrame:
    """``messages`` with all fields of ``FIELDS``, NULL where they are missing."""
    types = dict(f.split(" ", 1) for f in FIELDS.split(", "))
    return messages.withColumns({c: F.lit(None).cast(t) for c, t in types.items() if c not in messages.columns})


def _number(n: Column, width: int) -> Column:
    """Bytes of a whole number, the highest first."""
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def _ascii(text: Column) -> Column:
    return F.encode(F.coalesce(text, F.lit("")), "US-ASCII")


def _joined(pieces: Column) -> Column:
    """An array of bytes in one; none for NULL."""
    return F.unhex(F.array_join(F.transform(F.coalesce(pieces, F.array().cast("array<binary>")), F.hex), ""))


def _bytes(*values: int) -> Column:
    return F.lit(bytes(values))


def _part(kind: int | Column, data: Column) -> Column:
    first = _bytes(kind) if isinstance(kind, int) else _number(kind, 1)
    return F.concat(first, _bytes(0), _number(F.octet_length(data), 2), data)


def message_bytes() -> Column:
    """The bytes of a message from columns with the names of ``FIELDS``, by column functions; an error for a kind that can't be written."""
    c, zero, nothing = F.col, F.lit(0), F.lit(b"")
    request = c("kind") == "associate_rq"

    def context(x: Column) -> Column:
        abstract = F.when(x["abstract_syntax"].isNull(), nothing).otherwise(_part(ABSTRACT, _ascii(x["abstract_syntax"])))
        head = F.concat(_number(x["id"], 1), _bytes(0), _number(F.coalesce(x["result"], zero), 1), _bytes(0))
        return _part(F.when(request, PROPOSED).otherwise(ANSWERED), F.concat(head, abstract, _joined(F.transform(x["transfer_syntaxes"], lambda t: _part(TRANSFER, _ascii(t))))))

    named = lambda x, data: F.concat(_number(F.octet_length(_ascii(x["uid"])), 2), _ascii(x["uid"]), data)
    roles = F.transform("roles", lambda r: _part(ROLE, named(r, F.concat(_number(r["scu"].cast("int"), 1), _number(r["scp"].cast("int"), 1)))))
    extended = F.transform("extended", lambda e: _part(EXTENDED, named(e, e["data"])))
    version = F.when(F.coalesce(c("implementation_version"), F.lit("")) == "", nothing).otherwise(_part(IMPLEMENTATION_VERSION, _ascii(c("implementation_version"))))
    user = F.concat(_part(MAX_LENGTH, _number(F.coalesce("max_length", zero), 4)), _part(IMPLEMENTATION_CLASS, _ascii(c("implementation_class"))), _joined(roles), version, _joined(extended))
    title = lambda name: _ascii(F.rpad(F.coalesce(c(name), F.lit("")), 16, " "))
    version_number = F.when(F.coalesce(c("version"), zero) == 0, 1).otherwise(c("version"))
    association = F.concat(_number(version_number, 2), _bytes(0, 0), title("called"), title("calling"), F.lit(bytes(32)), _part(APPLICATION_CONTEXT, _ascii(c("application_context"))), _joined(F.transform("contexts", context)), _part(USER, user))
    value = lambda v: F.concat(_number(F.octet_length(v["data"]) + 2, 4), _number(v["context"], 1), _number(v["command"].cast("int") + v["last"].cast("int") * 2, 1), v["data"])
    bodies = {
        "associate_rq": association,
        "associate_ac": association,
        "associate_rj": F.concat(_bytes(0), *(_number(c(f), 1) for f in ("result", "source", "reason"))),
        "p_data": _joined(F.transform("pdvs", value)),
        "abort": F.concat(_bytes(0, 0), _number(c("source"), 1), _number(c("reason"), 1)),
        "release_rq": _bytes(0, 0, 0, 0),
        "release_rp": _bytes(0, 0, 0, 0),
    }
    whole = lambda first, body: F.concat(first, _bytes(0), _number(F.octet_length(body), 4), body)
    out = F.when(c("kind") == "unknown", whole(F.substring("rest", 1, 1), F.substring(c("rest"), F.lit(2), F.octet_length("rest"))))
    for kind, body in bodies.items():
        out = out.when(c("kind") == kind, whole(_bytes(NUMBERS[kind]), body))
    return out.otherwise(F.raise_error(F.concat(F.coalesce("kind", F.lit("NULL")), F.lit(" can't be written"))).cast("binary"))


def write(messages: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, data): the bytes of each message, from the fields of ``FIELDS`` that it has."""
    return complete(messages).select(*[F.col(k).cast("long").alias(k) for k in keys], message_bytes().alias("data"))


def too_long(data: Column, peer_max: Column) -> Column:
    """Whether a written message is longer than its peer takes; 0 says no limit but our own."""
    limit = F.when(peer_max == 0, MAX_PDU).otherwise(peer_max)
    return F.octet_length(data) - HEADER > limit


def whole_messages(data: bytes, max_length: int | None) -> tuple[list[tuple[bool, bytes]], bytes, int]:
    """The messages that are whole (whether too long, bytes), what is left, and how many bytes the next one takes, as far as is known.

    A message that is too long takes all that there is.
    """
    out, at = [], 0
    while len(data) - at >= HEADER:
        length = struct.unpack_from(">I", data, at + 2)[0]
        if max_length is not None and length > max_length:
            return [*out, (True, data[at:])], b"", HEADER
        if len(data) - at - HEADER < length:
            return out, data[at:], HEADER + length
        out.append((False, data[at : at + HEADER + length]))
        at += HEADER + length
    return out, data[at:], HEADER


class Wire(StatefulProcessor):
    """Bytes of one connection as they come: messages go out when they are whole, the rest is held.

    What is held is a list of pieces, beside how many bytes it takes until the next message is whole. So a piece that
    completes none is put at the list's end, and what came before it is neither read nor written again.
    """

    def __init__(self, max_length: int | None):
        self.max_length = max_length

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.pieces = handle.getListState("pieces", "data binary")
        self.place = handle.getValueState("place", "n long, held long, needed long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        new = b"".join(bytes(d) for d in frame["data"])
        n, held, needed = self.place.get() if self.place.exists() else (0, 0, HEADER)
        out = []
        if held + len(new) < needed:
            if new:
                self.pieces.appendValue((new,))
            self.place.update((n, held + len(new), needed))
        else:
            data = b"".join(bytes(d) for (d,) in self.pieces.get()) + new if held else new
            found, rest, needed = whole_messages(data, self.max_length)
            out = [(key[0], n + i, too_long, message) for i, (too_long, message) in enumerate(found)]
            if rest:
                self.pieces.put([(rest,)])
            elif held:
                self.pieces.clear()
            self.place.update((n + len(out), len(rest), needed))
        yield pd.DataFrame(out, columns=["connection", "place", "too_long", "data"])

    def close(self) -> None:
        pass


def wire_stream(chunks: DataFrame, max_length: int | None = None) -> DataFrame:
    """(connection, place, too_long, data) of a stream (connection, seq, data): the bytes of one whole message a row, for ``parse``.

    A message that is longer than ``max_length`` says so and ends what is held.
    """
    return chunks.groupBy("connection").transformWithStateInPandas(Wire(max_length), "connection long, place long, too_long boolean, data binary", "Append", "None")
