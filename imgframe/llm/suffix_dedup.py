"""Removal of byte strings that also start in an earlier document, from common prefixes of sorted suffixes.

Two windows of ``length`` bytes are equal if their suffixes stand in one stretch of the suffix order in which each has
at least ``length`` bytes in common with its neighbour. Those stretches come from a Burrows-Wheeler transform alone:
backward extension goes breadth first over the intervals of longer and longer strings, and finds the places where
neighbours have 0, 1, 2, ... bytes in common, in this order. It stops at ``length``; what has no value by then has at
least that many (``common_prefix_starts``).

A transform of the whole corpus would be one task's work, so windows are dealt to many of them by content: each
window by the least hash of the ``length // 2`` byte strings in it, so that equal windows meet. Consecutive windows of
one least hash travel as one string. A first pass over hashes alone leaves out the windows whose hash only one
document has. A hash that very many documents have is split further, window by window, by the window's own hash.

Documents are written once, in blocks, as a table bucketed by block, so that the later passes join what comes back for
a block to its texts without a shuffle of texts. What is shuffled are packed arrays, one row for each pair of a block
and a part that have something in common (never more than there are runs of windows).
"""

from __future__ import annotations

import hashlib
import itertools
import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, new_path, steps

#: Bytes of text in a block, and in what is hashed at a time.
BLOCK_BYTES, CHUNK_BYTES = 4 << 20, 1 << 20
#: Bytes of the whole corpus for each part of hashes, and for each bucket of blocks and part of windows.
PART_BYTES = 16 << 20
#: Symbols that one transform works on, if no single hash has more.
TRANSFORM_SYMBOLS = 1 << 18
#: Documents that have a hash in common before its windows are dealt one by one.
HOT_DOCUMENTS = 10_000

_BYTE_HASHES = np.frombuffer(b"".join(hashlib.sha256(bytes([b])).digest()[:8] for b in range(256)), "<u8")
_BASE = 0x9E3779B97F4A7C15


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(_BASE)
    return h ^ (h >> np.uint64(29))


def substring_hashes(data: np.ndarray, k: int) -> np.ndarray:
    """A 64-bit hash of each string of ``k`` bytes, from those of its halves."""
    power = lambda s: np.uint64(pow(_BASE, s, 1 << 64))
    half, span, out, done = _BYTE_HASHES[data], 1, None, 0
    while True:
        if k & span:
            n = len(data) - done - span + 1
            out = half if out is None else out[:n] * power(span) + half[done : done + n]
            done += span
        if 2 * span > k:
            return _mixed(out)
        n = len(data) - 2 * span + 1
        half, span = half[:n] * power(span) + half[span : span + n], 2 * span


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values."""
    span = 1
    while 2 * span <= width:
        values, span = np.minimum(values[:-span], values[span:]), 2 * span
    rest = width - span
    return np.minimum(values[: len(values) - rest], values[rest:]) if rest else values


def window_runs(text: bytes, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one least hash: (hashes, first windows, numbers of windows)."""
    keys, starts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    k, data = length // 2, np.frombuffer(text, np.uint8)
    for at in range(0, len(data) - length + 1, CHUNK_BYTES):
        least = sliding_least(substring_hashes(data[at : at + CHUNK_BYTES + length - 1], k), length - k + 1)
        first = np.flatnonzero(np.concatenate([[True], least[1:] != least[:-1]]))
        keys.append(least[first])
        starts.append(first + at)
        counts.append(np.diff(np.append(first, len(least))))
    return np.concatenate(keys), np.concatenate(starts), np.concatenate(counts)


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes sorted by their first ``depth`` symbols at least; ranks by 4, 8, 16, ... symbols. Symbols are 0 to 256."""
    n, span = len(symbols), 4
    bits = np.uint64(n.bit_length())
    place = np.arange(n, dtype=np.uint64)
    padded = np.concatenate([symbols, np.zeros(span, symbols.dtype)]).astype(np.uint64)
    key, width = np.zeros(n, np.uint64), 9 * span
    for i in range(span):
        key = (key << np.uint64(9)) | padded[i : i + n]
    while True:
        if width + int(bits) <= 64:  # the place fits beside the key, and plain sorting is several times as fast
            ordered = np.sort((key << bits) | place)
            order = (ordered & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
            ordered >>= bits
        else:
            order = np.argsort(key, kind="stable")
            ordered = key[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
        if span >= depth or new.all():
            return order
        rank = np.zeros(n + span, np.uint64)
        rank[order] = np.cumsum(new, dtype=np.uint64)
        key, width, span = (rank[:n] << bits) | rank[span:], 2 * int(bits), 2 * span


def common_prefix_starts(symbols: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """Where in ``order`` a suffix has under ``length`` symbols in common with the one before it.

    ``order`` need only be right for the first ``length`` symbols. At level l the queue holds the intervals of strings
    of l symbols whose right ends have just been found; each is extended to the left by every symbol before it, and
    where the right end of an extended interval has no value yet, its value is l and the interval joins the queue of
    the next level. The end symbol 0 stands last in strings only: no window holds one.
    """
    n, kind = len(order), np.int32 if len(order) < 1 << 31 else np.int64
    before = symbols[order - 1].astype(np.uint16)  # the transform
    by_symbol = np.argsort(before, kind="stable")
    step = np.empty(n, kind)
    step[by_symbol] = np.arange(n, dtype=kind)
    following = np.full(n, n, kind)  # the next place of the same symbol in the transform
    same = before[by_symbol[1:]] == before[by_symbol[:-1]]
    following[by_symbol[:-1][same]] = by_symbol[1:][same]
    known = np.zeros(n + 1, bool)
    known[[0, n]] = True
    left, right = np.array([0], kind), np.array([n], kind)
    for level in range(length):
        sizes = right - left
        places = np.repeat(left - (np.cumsum(sizes, dtype=kind) - sizes), sizes) + np.arange(int(sizes.sum()), dtype=kind)
        places = places[(following[places] >= np.repeat(right, sizes)) & (before[places] >= (level > 0))]
        ends = step[places] + 1
        ends = np.sort(ends[~known[ends]])
        if not len(ends):
            break
        known[ends] = True
        starts = np.flatnonzero(known).astype(kind)
        left, right = starts[np.searchsorted(starts, ends) - 1], ends
    return np.flatnonzero(known[:n])


def least_owners(texts: list[bytes], owners: np.ndarray, length: int) -> np.ndarray:
    """For each window of each text, one text after the other, the least owner of a text that holds it."""
    sizes = np.array([len(t) + 1 for t in texts])
    ends = np.cumsum(sizes)
    symbols = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.uint16) + 1
    symbols[ends - 1] = 0
    order = suffix_order(symbols, length)
    starts = common_prefix_starts(symbols, order, length)
    least = np.minimum.reduceat(np.repeat(owners, sizes)[order], starts)
    out = np.empty(len(order), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(order))))
    whole = removed_bytes(len(out), ends - length, length)  # the suffixes too short for a window
    return out[~whole]


def _packed(values: np.ndarray, kind: str) -> bytes:
    return np.ascontiguousarray(values.astype(kind)).tobytes()


def _zipped(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _unzipped(value: pa.BinaryScalar) -> bytes:
    return zstandard.ZstdDecompressor().decompress(value.as_py())


def _slices(begins: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """``counts`` consecutive numbers from each of ``begins``."""
    return np.repeat(begins - (np.cumsum(counts) - counts), counts) + np.arange(int(counts.sum()))


def _write_blocks(docs: DataFrame, buckets: int) -> DataFrame:
    """(block, doc_id, text as bytes), written as a table bucketed by block and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 32, 0
        for batch in steps(batches, "text", BLOCK_BYTES // 4):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(batch.num_rows, block)), batch.column("doc_id"), batch.column("text")], ["block", "doc_id", "text"])
            size += batch.column("text").nbytes
            if size >= BLOCK_BYTES:
                block, size = block + 1, 0

    spark, name = docs.sparkSession, f"suffix_blocks_{uuid.uuid4().hex}"
    rows = docs.mapInArrow(run, "block long, doc_id long, text binary")
    rows.write.bucketBy(buckets, "block").sortBy("block").option("path", new_path(spark, "suffix-blocks")).option("compression", "zstd").format("parquet").saveAsTable(name)
    return spark.table(name)


def _hash_rows(blocks: DataFrame, length: int, parts: int) -> DataFrame:
    """(part, block, hashes, documents): for each block and part, the distinct hashes of runs and how many of the block's documents have each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", BLOCK_BYTES):
            ids = np.array(batch.column("block").to_pylist())
            for block in np.unique(ids).tolist():
                own = batch.filter(pa.array(ids == block))
                found = [np.unique(window_runs(t, length)[0]) for t, d in zip(own.column("text").to_pylist(), own.column("doc_id").to_pylist(), strict=True) if d is not None]
                keys, counts = np.unique(np.concatenate([np.zeros(0, np.uint64), *found]), return_counts=True)
                part, rest = (keys % np.uint64(parts)).astype(np.int64), keys // np.uint64(parts) & np.uint64(0xFFFFFFFF)
                order = np.argsort(part, kind="stable")
                edges = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0])) if len(order) else order
                rows = [(int(part[g[0]]), block, _packed(rest[g], "<u4"), _packed(np.minimum(counts[g], 65535), "<u2")) for g in np.split(order, edges[1:]) if len(g)]
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(("part", "block", "hashes", "documents"), map(list, zip(*rows, strict=True)), strict=True)), schema=pa.schema([("part", pa.int64()), ("block", pa.int64()), ("hashes", pa.binary()), ("documents", pa.binary())]))

    return blocks.mapInArrow(run, "part long, block long, hashes binary, documents binary")


def _shared_hashes(hashes: DataFrame, hot_documents: int) -> DataFrame:
    """(block, part, hashes, hot): of each row of hashes, those that several documents of the corpus have, and which very many have."""

    def run(rows: pa.Table) -> pa.Table:
        own = [np.frombuffer(h.as_py(), "<u4") for h in rows.column("hashes")]
        distinct, place = np.unique(np.concatenate(own), return_inverse=True)
        total = np.bincount(place, np.concatenate([np.frombuffer(d.as_py(), "<u2") for d in rows.column("documents")]))
        out, at = [], 0
        for h in own:
            n = total[place[at : at + len(h)]]
            at += len(h)
            out.append((_packed(h[n > 1], "<u4"), _packed(n[n > 1] > hot_documents, "u1")))
        return pa.table([rows.column("block"), rows.column("part"), pa.array([h for h, _ in out], pa.binary()), pa.array([x for _, x in out], pa.binary())], ["block", "part", "hashes", "hot"])

    return hashes.groupBy("part").applyInArrow(run, "block long, part long, hashes binary, hot binary").where("length(hashes) > 0")


def _snippets(blocks: DataFrame, shared: DataFrame, length: int, parts: int, deals: int) -> DataFrame:
    """For each block and deal, its distinct strings of shared windows with their least owners and a byte that equal windows have alike (texts, sizes, keys, owners); and with deal -1, where they stand in each document.

    A row of a deal has its strings in one order, to which ``_answers`` keeps.
    """

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        known = [(np.frombuffer(h.as_py(), "<u4").astype(np.uint64) * np.uint64(parts) + np.uint64(p.as_py()), np.frombuffer(x.as_py(), "u1")) for h, p, x in zip(answers.column("hashes"), answers.column("part"), answers.column("hot"), strict=True)]
        rows = []
        if known and texts.num_rows:
            keys, hot = np.concatenate([k for k, _ in known]), np.concatenate([x for _, x in known]).astype(bool)
            order = np.argsort(keys)
            rows = _block_snippets(texts, keys[order], hot[order], length, parts, deals)
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, _SNIPPET_TYPES, strict=True)], list(_SNIPPET_NAMES))

    kinds = "block long, deal long, texts binary, sizes binary, keys binary, owners binary, places binary"
    return blocks.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(run, kinds)


_SNIPPET_NAMES = ("block", "deal", "texts", "sizes", "keys", "owners", "places")
_SNIPPET_TYPES = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary(), pa.binary(), pa.binary())


def _block_snippets(texts: pa.Table, shared: np.ndarray, hot: np.ndarray, length: int, parts: int, deals: int) -> list[tuple]:
    block, found = texts.column("block")[0].as_py(), defaultdict(itertools.count().__next__)
    owners, keys, where = [], [], []
    for row, (doc, text) in enumerate(_in_order(texts)):  # by doc_id, so that the first owner is the least
        if doc is None:
            continue
        key, start, count = window_runs(text, length)
        key = (key // np.uint64(parts) & np.uint64(0xFFFFFFFF)) * np.uint64(parts) + key % np.uint64(parts)
        at = np.minimum(np.searchsorted(shared, key), len(shared) - 1)
        held = shared[at] == key
        key, start, count, single = key[held], start[held], count[held], hot[at[held]]
        if single.any():
            alone = _slices(start[single], count[single])
            own = np.array([int.from_bytes(hashlib.blake2b(text[i : i + length], digest_size=8).digest(), "little") for i in alone.tolist()], np.uint64)
            key, start, count = np.concatenate([key[~single], own]), np.concatenate([start[~single], alone]), np.concatenate([count[~single], np.ones(len(alone), np.int64)])
        known = len(found)
        ids = np.array([found[text[a:b]] for a, b in zip(start.tolist(), (start + count + (length - 1)).tolist(), strict=True)], np.int64)
        if len(found) > known:
            new, first = np.unique(ids, return_index=True)
            keys.append(key[first[new >= known]])
            owners.append(np.full(len(found) - known, doc))
        where.append(np.stack([np.full(len(ids), row), start, ids]))
    if not found:
        return []
    strings, owners, keys, where = list(found), np.concatenate(owners), _mixed(np.concatenate(keys)), np.concatenate(where, axis=1)
    deal = (keys % np.uint64(deals)).astype(np.int64)
    order = np.argsort(deal, kind="stable")
    place = np.empty(len(order), np.int64)  # of each string in all deals, one after the other
    place[order] = np.arange(len(order))
    where[2] = place[where[2]]
    rows = []
    for g in np.split(order, np.flatnonzero(np.diff(deal[order])) + 1):
        own = [strings[i] for i in g.tolist()]
        rows.append((block, int(deal[g[0]]), _zipped(b"".join(own)), _packed(np.array([len(s) for s in own]), "<u4"), _packed(_mixed(keys[g]), "u1"), _zipped(_packed(owners[g], "<i8")), None))
    return [*rows, (block, -1, None, None, None, None, _zipped(_packed(where, "<i8")))]


def _in_order(texts: pa.Table) -> list[tuple[int | None, bytes]]:
    """(doc_id, text) of the documents of a block, in an order that is the same each time."""
    rows = zip(texts.column("doc_id").to_pylist(), texts.column("text").to_pylist(), strict=True)
    return sorted(((d, t or b"") for d, t in rows), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def _answers(snippets: DataFrame, length: int, symbols: int) -> DataFrame:
    """(block, deal, least, repeats): for the strings of each block and deal, the least owner of each window, as runs of equal ones.

    The strings of a deal go to transforms of about ``symbols`` symbols by their keys.
    """

    def run(rows: pa.Table) -> pa.Table:
        found, own = defaultdict(itertools.count().__next__), []
        for texts, sizes in zip(rows.column("texts"), rows.column("sizes"), strict=True):
            data, end = _unzipped(texts), np.cumsum(np.frombuffer(sizes.as_py(), "<u4")).tolist()
            own.append(np.array([found[data[a:b]] for a, b in zip([0, *end[:-1]], end, strict=True)]))
        strings, ids = list(found), np.concatenate(own)
        owners, keys = np.full(len(strings), np.iinfo(np.int64).max), np.empty(len(strings), np.uint8)
        np.minimum.at(owners, ids, np.concatenate([np.frombuffer(_unzipped(o), "<i8") for o in rows.column("owners")]))
        keys[ids] = np.concatenate([np.frombuffer(k.as_py(), "u1") for k in rows.column("keys")])
        counts = np.array([len(t) for t in strings]) - (length - 1)
        group = keys % min(256, -(-int(counts.sum() + length * len(counts)) // symbols))
        order = np.argsort(group, kind="stable")
        least, begins = [], np.empty(len(order), np.int64)
        begins[order] = np.cumsum(counts[order]) - counts[order]
        for g in np.split(order, np.flatnonzero(np.diff(group[order])) + 1):
            least.append(least_owners([strings[i] for i in g.tolist()], owners[g], length))
        least, out = np.concatenate(least), []
        for mine in own:
            values = least[_slices(begins[mine], counts[mine])]
            first = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
            out.append((_zipped(_packed(values[first], "<i8")), _zipped(_packed(np.diff(np.append(first, len(values))), "<u4")), _zipped(_packed(counts[mine], "<u4"))))
        return pa.table([rows.column("block"), rows.column("deal"), *(pa.array(c, pa.binary()) for c in zip(*out, strict=True))], ["block", "deal", "least", "repeats", "sizes"])

    dealt = snippets.where("deal >= 0").select("block", "deal", "texts", "sizes", "keys", "owners")
    return dealt.groupBy("deal").applyInArrow(run, "block long, deal long, least binary, repeats binary, sizes binary")


def removed_bytes(size: int, starts: np.ndarray, length: int) -> np.ndarray:
    """Which of ``size`` bytes stand in a window that begins at one of ``starts``."""
    change = np.bincount(starts, minlength=size + 1)[: size + 1] - np.bincount(starts + length, minlength=size + 1)[: size + 1]
    return np.cumsum(change[:size]) > 0


def _marked(texts: pa.Table, answers: pa.Table, length: int) -> list[np.ndarray]:
    """Which bytes go, for each of the documents of a block, from what came back for it."""
    docs = _in_order(texts)
    row, at = np.zeros(0, np.int64), np.zeros(0, np.int64)
    by_deal = sorted((d, i) for i, d in enumerate(answers.column("deal").to_pylist()))
    if by_deal:
        column = lambda c, i, kind: np.frombuffer(_unzipped(answers.column(c)[i]), kind)
        rows, first, string = column("places", by_deal[0][1], "<i8").reshape(3, -1)
        least = np.concatenate([np.repeat(column("least", i, "<i8"), column("repeats", i, "<u4")) for _, i in by_deal[1:]])
        sizes = np.concatenate([column("sizes", i, "<u4") for _, i in by_deal[1:]]).astype(np.int64)
        count, begin = sizes[string], (np.cumsum(sizes) - sizes)[string]
        row, at = np.repeat(rows, count), _slices(first, count)
        gone = least[_slices(begin, count)] < np.array([d or 0 for d, _ in docs], np.int64)[row]
        row, at = row[gone], at[gone]
    edges = np.searchsorted(row, np.arange(len(docs) + 1))  # rows are in order
    return [removed_bytes(len(t), at[a:b], length) for (_, t), a, b in zip(docs, edges[:-1].tolist(), edges[1:].tolist(), strict=True)]


def remove_repeated_bytes(docs: DataFrame, length: int = 50, hot_documents: int = HOT_DOCUMENTS, symbols: int = TRANSFORM_SYMBOLS) -> DataFrame:
    """For each row of ``docs``: doc_id, n_bytes, n_removed, n_spans, spans (array of structs start, end), kept (bytes).

    A byte of a text's UTF-8 form is removed if a string of ``length`` bytes that covers it also starts in a row with a
    smaller doc_id. Strings do not cross rows, may overlap, and are judged on the input.

    Defined cases: a null text counts as empty; texts under ``length`` bytes stay whole; rows that repeat a doc_id are
    no reason to remove each other's bytes; a row without doc_id stays whole and removes nothing; ``kept`` may cut a
    character in two, so it is bytes; other columns are ignored; no rows in, no rows out. ``length`` is 2 or more.
    """
    if length < 2:
        raise ValueError("length must be 2 or more")
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(4, -(-size // PART_BYTES))
    blocks = _write_blocks(docs, parts)
    shared = _shared_hashes(_hash_rows(blocks, length, parts), hot_documents)
    snippets = materialize(_snippets(blocks, shared, length, parts, 2 * parts), "suffix-snippets")
    nothing = [F.lit(None).cast("binary").alias(c) for c in ("least", "repeats", "sizes")]
    replies = _answers(snippets, length, symbols).withColumn("places", F.lit(None).cast("binary"))
    replies = replies.unionByName(snippets.where("deal = -1").select("block", "deal", *nothing, "places"))

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        rows = []
        for (doc, text), gone in zip(_in_order(texts), _marked(texts, answers, length), strict=True):
            edges = np.flatnonzero(np.diff(np.concatenate([[False], gone, [False]]).astype(np.int8)))
            spans = [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]
            rows.append((doc, len(text), int(gone.sum()), len(spans), spans, np.frombuffer(text, np.uint8)[~gone].tobytes()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.binary())
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 6, kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "spans", "kept"])

    out = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start:long,end:long>>, kept binary"
    return blocks.groupBy("block").cogroup(replies.groupBy("block")).applyInArrow(run, out)
