"""Fragmented messages: cut to a peer's limit, and put together again in batches and in streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.negotiation import PDV_HEADER
from ..sources.codec import decode


def fragment(messages: DataFrame, data: str, max_pdu: int) -> DataFrame:
    """``messages`` with seq, data (binary) and is_last: pieces of at most ``max_pdu - 6`` bytes; empty data is one empty piece."""
    size = max_pdu - PDV_HEADER
    whole = F.encode(F.col(data), "UTF-8") if messages.schema[data].dataType.simpleString() == "string" else F.col(data)
    n = F.greatest(F.ceil(F.octet_length(whole) / size), F.lit(1)).cast("int")
    pieces = messages.withColumn(data, F.coalesce(whole, F.lit(b""))).withColumn("_n", n).withColumn("seq", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    return pieces.withColumn(data, F.substring(data, F.col("seq") * size + 1, F.lit(size))).withColumn("is_last", F.col("seq") == F.col("_n") - 1).drop("_n")


def message_number(keys: list[str], order: list[str], is_last: Column) -> Column:
    """Which message of its key a fragment belongs to, from 0: the messages that ended before it."""
    before = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return F.coalesce(F.sum(is_last.cast("long")).over(before), F.lit(0))


def reassemble(fragments: DataFrame, keys: list[str], order: list[str], data: str) -> DataFrame:
    """(keys, message, data, complete): fragments put together in order. Text is joined as text, bytes as bytes; a message without a last fragment is not complete."""
    rows = fragments.withColumn("message", message_number(keys, order, F.col("is_last")))
    joined = F.transform(F.array_sort(F.collect_list(F.struct(*order, F.col(data).alias("_d")))), lambda x: x["_d"])
    text = fragments.schema[data].dataType.simpleString() == "string"
    whole = F.array_join(joined, "") if text else F.unhex(F.array_join(F.transform(joined, F.hex), ""))
    return rows.groupBy(*keys, "message").agg(whole.alias(data), F.max("is_last").alias("complete"))


class Reassembly(StatefulProcessor):
    """Keeps the fragments of a message until its last one comes; state of a message that is done goes.

    Fragments are appended to what is held, which is read once, when the message is whole. One that nothing has come
    for ``seconds`` is given up: it comes out as it is, not complete.
    """

    def __init__(self, seconds: int | None = None):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.pieces = handle.getListState("pieces", "seq long, data binary")
        self.done = handle.getValueState("done", "n long")
        self.due = handle.getValueState("due", "at long")

    def _take(self) -> bytes:
        whole = b"".join(d for _, d in sorted((int(s), bytes(d)) for s, d in self.pieces.get()))
        self.pieces.clear()
        return whole

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        n = self.done.get()[0] if self.done.exists() else 0
        out, waiting = [], []
        for seq, data, is_last in zip(frame["seq"], frame["data"], frame["is_last"], strict=True):
            waiting.append((int(seq), bytes(data)))
            if is_last:
                self.pieces.appendList(waiting)
                out.append((key[0], n, self._take(), True))
                waiting, n = [], n + 1
        if waiting:
            self.pieces.appendList(waiting)
        self.done.update((n,))
        if self.seconds is not None:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
                self.due.clear()
            if waiting or self.pieces.exists():
                at = timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds
                self.handle.registerTimer(at)
                self.due.update((at,))
        yield pd.DataFrame(out, columns=["association", "message", "data", "complete"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        n = self.done.get()[0] if self.done.exists() else 0
        out = [(key[0], n, self._take(), False)] if self.pieces.exists() else []
        self.done.update((n + len(out),))
        self.due.clear()
        yield pd.DataFrame(out, columns=["association", "message", "data", "complete"])

    def close(self) -> None:
        pass


def reassemble_stream(fragments: DataFrame, seconds: int | None = None) -> DataFrame:
    """(association, message, data, complete) of a stream (association, seq, data, is_last); needs the RocksDB state store.

    seconds: how long a message may wait for its next fragment, by the clock; a query with such timers runs until it
    is stopped. Without, for ever.
    """
    mode = "None" if seconds is None else "ProcessingTime"
    return fragments.groupBy("association").transformWithStateInPandas(Reassembly(seconds), "association long, message long, data binary, complete boolean", "Append", mode)


#: Representations of the attributes of commands, which are in implicit form.
COMMAND_VRS = {0x00000000: "UL", 0x00000002: "UI", 0x00000100: "US", 0x00000110: "US", 0x00000800: "US", 0x00000900: "US", 0x00001000: "UI"}
SOP_CLASS, MESSAGE_ID, SOP_INSTANCE = 0x00000002, 0x00000110, 0x00001000


def command_ids(data: bytes) -> tuple[str | None, str | None, int | None]:
    """(class, instance, message id) that a command names."""
    found = {tag: values[0] for _, tag, _, values in decode(data, False, vrs=COMMAND_VRS) if values}
    return found.get(SOP_CLASS), found.get(SOP_INSTANCE), int(found[MESSAGE_ID]) if MESSAGE_ID in found else None


class StoreLoop(StatefulProcessor):
    """What a storage service does with an association: a command's last part names an instance and clears what is held;
    parts of data are held; the last one gives the instance out, with a response of success to be sent. A release or
    an abort ends it; so does silence for ``seconds``.
    """

    def __init__(self, seconds: int | None = None):
        self.seconds = seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.command = handle.getListState("command", "data binary")
        self.pieces = handle.getListState("pieces", "data binary")
        self.ids = handle.getValueState("ids", "sop_class string, sop_instance string, message_id long")
        self.due = handle.getValueState("due", "at long")

    def _end(self) -> None:
        for state in (self.command, self.pieces, self.ids):
            state.clear()

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        frame = pd.concat(list(rows)).sort_values("seq")
        out = []
        for kind, data, last in zip(frame["kind"], frame["data"], frame["is_last"], strict=True):
            if kind in ("release", "abort"):
                self._end()
                continue
            held = self.command if kind == "command" else self.pieces
            held.appendValue((bytes(data),))
            if not last:
                continue
            whole = b"".join(bytes(d) for (d,) in held.get())
            held.clear()
            if kind == "command":
                self.pieces.clear()
                self.ids.update(command_ids(whole))
            elif self.ids.exists():
                out.append((key[0], *self.ids.get(), whole, 0))
                self.ids.clear()
        if self.seconds is not None:
            if self.due.exists():
                self.handle.deleteTimer(self.due.get()[0])
            at = timerValues.getCurrentProcessingTimeInMs() + 1000 * self.seconds
            self.handle.registerTimer(at)
            self.due.update((at,))
        yield pd.DataFrame(out, columns=STORED_COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self._end()
        self.due.clear()
        yield pd.DataFrame([], columns=STORED_COLUMNS)

    def close(self) -> None:
        pass


STORED = "association long, sop_class string, sop_instance string, message_id long, data binary, status int"
STORED_COLUMNS = [f.split()[0] for f in STORED.split(", ")]


def store_stream(parts: DataFrame, seconds: int | None = None) -> DataFrame:
    """(association, sop_class, sop_instance, message_id, data, status) of a stream (association, seq, kind, data, is_last), kinds: command, data, release, abort.

    seconds: of silence that end an association, by the clock; a query with such timers runs until it is stopped.
    """
    mode = "None" if seconds is None else "ProcessingTime"
    return parts.groupBy("association").transformWithStateInPandas(StoreLoop(seconds), STORED, "Append", mode)


def store_loop(parts: DataFrame) -> DataFrame:
    """``store_stream`` of parts that are all there, as windows and one grouping.

    A part of data belongs to the instance of the last command that was whole before it; what no last part ends, or
    what a release or another command cuts off, gives no instance.
    """
    own = Window.partitionBy("association").orderBy("seq")
    before = own.rowsBetween(Window.unboundedPreceding, -1)
    command, data, last = F.col("kind") == "command", F.col("kind") == "data", F.col("is_last")
    ends = (command | data) & last | F.col("kind").isin("release", "abort")
    rows = parts.withColumn("unit", F.coalesce(F.sum(ends.cast("long")).over(before), F.lit(0)))
    joined = F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("data").alias("h")))), lambda x: x.h))
    units = rows.groupBy("association", "unit", "kind").agg(F.unhex(joined).alias("data"), F.max(F.when(last, F.col("seq"))).alias("end"), F.max("seq").alias("seq"))
    wholes = units.where(F.col("end").isNotNull() | F.col("kind").isin("release", "abort"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [command_ids(d) if k == "command" else (None, None, None) for k, d in zip(batch.column("kind").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            columns = (pa.array([x[i] for x in ids], t) for i, t in ((0, pa.string()), (1, pa.string()), (2, pa.int64())))
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "sop_class", "sop_instance", "message_id"])

    named = wholes.select("association", "seq", "kind", "data").mapInArrow(run, "association long, seq long, kind string, data binary, sop_class string, sop_instance string, message_id long")
    previous = lambda c: F.lag(c).over(Window.partitionBy("association").orderBy("seq"))
    paired = named.withColumns({"asked": previous("kind"), "sop_class": previous("sop_class"), "sop_instance": previous("sop_instance"), "message_id": previous("message_id")})
    return paired.where((F.col("kind") == "data") & (F.col("asked") == "command")).select("association", "sop_class", "sop_instance", "message_id", "data", F.lit(0).alias("status"))
