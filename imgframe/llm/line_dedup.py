"""Line deduplication that can be undone: sharded cuckoo filters backed by exact reference tables.

The exact state is a table of references, one row for each (line key, document) that holds it, dealt into shards by
key, with the reference counts of the keys in enough documents. From these counts comes one cuckoo filter a shard. A
lookup asks the shard's filter first, which rules nearly all keys out without the table, and confirms the rest against
the exact counts, so a false positive of a filter never drops a line.

``insert`` and ``delete`` work on what they touch: they write the references that come or go, count the touched keys
anew from the touched folders of the table, and change the filters of shards in which a key got or lost its place,
key by key; a filter that is full is made anew at twice its size. All else stays as it was written. After a deletion a
line that is no longer common is kept again.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, new_path, steps

#: Stripped from both ends of a line to get its key.
LINE_SPACE = " \t\n\v\f\r"

#: References of a shard, about, at most; folders of a reference table, at most; documents of a key that meet in one task, about.
SHARD_REFS, SLOTS, HOT_DOCS = 500_000, 256, 20_000
#: Tables that an index is made of, before it is written anew.
LAYERS = 16


class CuckooFilter:
    """A set of 64-bit hashes in buckets of four 16-bit fingerprints; supports removal.

    No false negatives for what was added. When an eviction chain gets too long the hash goes to an exact
    overflow list, so ``add`` never fails and loses nothing.
    """

    WAYS, KICKS = 4, 200

    def __init__(self, capacity: int):
        self.buckets = 1 << max(1, int(np.ceil(np.log2(max(capacity, 1) / (self.WAYS * 0.85)))))
        self.table = np.zeros((self.buckets, self.WAYS), np.uint16)
        self.overflow: Counter[int] = Counter()

    @property
    def capacity(self) -> int:
        """How many hashes it takes before it should be made anew."""
        return int(self.buckets * self.WAYS * 0.85)

    def _places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mask = np.uint64(self.buckets - 1)
        prints = np.maximum(hashes >> np.uint64(48), np.uint64(1)).astype(np.uint16)
        first = hashes & mask
        return prints, first, first ^ (self._spread(prints) & mask)

    @staticmethod
    def _spread(prints):
        with np.errstate(over="ignore"):
            return np.asarray(prints).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)

    def add_all(self, hashes: np.ndarray) -> None:
        """Adds all hashes: at once those that find a free place in one of their buckets, one by one the others."""
        for turn in (0, 1):
            if not len(hashes):
                return
            prints, *places = self._places(hashes)
            by = np.argsort(places[turn], kind="stable")
            place = places[turn][by]
            nth = np.arange(len(by)) - np.searchsorted(place, place)
            full = self.table[place] != 0
            slots = np.argsort(full, axis=1, kind="stable")
            fits = nth < (~full).sum(axis=1)
            self.table[place[fits], slots[fits, nth[fits]]] = prints[by][fits]
            hashes = hashes[by][~fits]
        for value in hashes.tolist():
            self.add(value)

    def add(self, value: int) -> None:
        prints, first, second = self._places(np.array([value], np.uint64))
        item, places = int(prints[0]), (int(first[0]), int(second[0]))
        for place in places:
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = item
                return
        place, moved = places[0], []
        for kick in range(self.KICKS):
            way = (item + kick) % self.WAYS
            moved.append((place, way, int(self.table[place, way])))
            item, self.table[place, way] = int(self.table[place, way]), item
            place ^= int(self._spread(item)) & (self.buckets - 1)
            free = np.flatnonzero(self.table[place] == 0)
            if len(free):
                self.table[place, free[0]] = item
                return
        for place, way, old in reversed(moved):
            self.table[place, way] = old
        self.overflow[value] += 1

    def remove(self, value: int) -> bool:
        """Takes one occurrence out; it must have been added."""
        if self.overflow[value] > 0:
            self.overflow[value] -= 1
            return True
        prints, first, second = self._places(np.array([value], np.uint64))
        for place in (int(first[0]), int(second[0])):
            held = np.flatnonzero(self.table[place] == prints[0])
            if len(held):
                self.table[place, held[0]] = 0
                return True
        return False

    def contains(self, hashes: np.ndarray) -> np.ndarray:
        prints, first, second = self._places(hashes.astype(np.uint64))
        found = ((self.table[first] == prints[:, None]) | (self.table[second] == prints[:, None])).any(axis=1)
        return found | np.isin(hashes, self._overflow()) if self.overflow else found

    def _overflow(self) -> np.ndarray:
        return np.fromiter(self.overflow.elements(), np.uint64)

    def dump(self) -> bytes:
        extra = self._overflow()
        return np.array([self.buckets, len(extra)], np.uint64).tobytes() + extra.tobytes() + self.table.tobytes()

    @classmethod
    def load(cls, data: bytes) -> CuckooFilter:
        self = cls(1)
        self.buckets, n = map(int, np.frombuffer(data, np.uint64, 2))
        self.overflow = Counter(np.frombuffer(data, np.uint64, n, 16).tolist())
        self.table = np.frombuffer(data, np.uint16, offset=16 + 8 * n).reshape(self.buckets, cls.WAYS).copy()
        return self


def line_keys(text: str | None, min_chars: int) -> list[bytes | None]:
    """For each line the 16-byte key, None where the key has fewer than ``min_chars`` code points."""
    keys = []
    for line in (text or "").split("\n"):
        line = line.strip(LINE_SPACE)
        keys.append(hashlib.blake2b(line.encode("utf-8", "surrogatepass").lower(), digest_size=16).digest() if len(line) >= min_chars else None)
    return keys


def references(docs: DataFrame, min_chars: int, shards: int) -> DataFrame:
    """(shard, key, doc_id): the exact reference table of ``docs``; a document counts once for a key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            ids, keys = [], []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                own = {k for k in line_keys(text, min_chars) if k}
                ids += [doc_id] * len(own)
                keys += own
            yield pa.RecordBatch.from_arrays([pa.array([int.from_bytes(k[:4], "little") % shards for k in keys], pa.int32()), pa.array(keys, pa.binary()), pa.array(ids, pa.int64())], ["shard", "key", "doc_id"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL")
    return rows.mapInArrow(run, "shard int, key binary, doc_id long")


def hash_of(key: Column) -> Column:
    """The 64 bits of a key that filters use, other bits than those that choose the shard."""
    return F.conv(F.hex(F.substring(key, 9, 8)), 16, -10).cast("long")


def layer(refs: DataFrame, shards: int, name: str) -> DataFrame:
    """References written with a folder for each slot (some shards), several files for a slot that holds a common key."""
    slots = min(shards, SLOTS)
    rows = refs.select((F.col("shard") % slots).alias("slot"), F.pmod(F.xxhash64("doc_id"), F.lit(8)).alias("salt"), "shard", "key", "doc_id")
    rows = rows.repartition("slot", "salt").groupBy("slot", "salt", "shard", "key", "doc_id").agg(F.lit(1).alias("_")).drop("_", "salt")
    path = new_path(refs.sparkSession, name)
    rows.write.partitionBy("slot").parquet(path)
    return refs.sparkSession.read.schema("shard int, key binary, doc_id long, slot int").parquet(path)


KEY = ["slot", "shard", "key"]


@dataclass(frozen=True)
class LineIndex:
    """References, exact counts and filters of the documents put in so far, each as the tables written for it.

    refs, gone: [(version, (slot, shard, key, doc_id))], what came and what went since. counts: [(version, (slot, shard,
    key, n_docs, keeper))], a later row of a key in place of an earlier one; keeper is the largest doc_id that
    holds the key. filters: [(version, (shard, filter, capacity, n, salts))], likewise. members: [(version, (doc_id, there))].
    The number of shards follows the size of the texts that the index was built from; at most ``LAYERS`` tables are
    held before all is written anew (``compact``).
    """

    spark: SparkSession
    min_chars: int
    min_docs: int
    shards: int
    version: int = 0
    refs: tuple = ()
    gone: tuple = ()
    counts: tuple = ()
    filters: tuple = ()
    members: tuple = ()

    @classmethod
    def build(cls, docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shards: int | None = None) -> LineIndex:
        """The index of ``docs``; without ``shards`` there are as many as their bytes may hold keys for."""
        if shards is None:
            size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
            shards = max(16, -(-size // (max(1, min_chars) * SHARD_REFS)))
        return cls(docs.sparkSession, min_chars, min_docs, shards)._insert(docs)

    # What the tables say now.

    def references(self, slots: list[int] | None = None) -> DataFrame:
        """(slot, shard, key, doc_id) of what is there, of all folders or of some."""
        rows = self._read(self.refs, slots)
        if not self.gone:
            return rows.drop("version")
        gone = self._read(self.gone, slots).withColumnRenamed("version", "until")
        gone = gone.groupBy(*KEY, "doc_id").agg(F.max("until").alias("until"))
        rows = rows.join(gone, [*KEY, "doc_id"], "left").where("until IS NULL OR version > until")
        return rows.select(*KEY, "doc_id").distinct()

    def common(self, slots: list[int] | None = None) -> DataFrame:
        """(slot, shard, key, n_docs, keeper) of the keys in enough documents."""
        return self._latest(self._read(self.counts, slots), KEY, len(self.counts)).where(F.col("n_docs") >= self.min_docs)

    def held_filters(self) -> DataFrame:
        return self._latest(self._read(self.filters, None), ["shard"], len(self.filters))

    def known(self) -> DataFrame:
        """(doc_id) of the documents of the index."""
        return self._latest(self._read(self.members, None), ["doc_id"], len(self.members)).where("there").select("doc_id")

    @staticmethod
    def _read(layers: tuple, slots: list[int] | None) -> DataFrame:
        parts = [df if slots is None else df.where(F.col("slot").isin(slots)) for _, df in layers]
        return reduce(DataFrame.unionByName, [df.withColumn("version", F.lit(v)) for (v, _), df in zip(layers, parts, strict=True)])

    @staticmethod
    def _latest(rows: DataFrame, key: list[str], layers: int) -> DataFrame:
        if layers == 1:
            return rows.drop("version")
        rest = [c for c in rows.columns if c not in (*key, "version")]
        return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), "version").alias("r")).select(*key, "r.*")

    # Changes.

    def insert(self, docs: DataFrame) -> LineIndex:
        """The index with ``docs`` added; a document whose doc_id it has stays as it is (delete it first to replace it)."""
        return self._insert(docs.join(self.known(), "doc_id", "left_anti"))._compacted()

    def _insert(self, docs: DataFrame) -> LineIndex:
        v = self.version + 1
        new = layer(references(docs, self.min_chars, self.shards), self.shards, "line-refs")
        ids = materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id")).where("doc_id IS NOT NULL").distinct().withColumn("there", F.lit(True)), "line-members")
        return replace(self, version=v, refs=(*self.refs, (v, new)), members=(*self.members, (v, ids)))._counted(new, None if v == 1 else self)

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """The index without the documents of ``doc_ids`` (column doc_id). Their keys are looked up in all references, but only theirs are written."""
        v = self.version + 1
        ids = materialize(self.known().join(doc_ids.select(F.col("doc_id").cast("long").alias("doc_id")).distinct(), "doc_id", "left_semi").withColumn("there", F.lit(False)), "line-members")
        old = layer(self.references().join(ids, "doc_id", "left_semi"), self.shards, "line-gone")
        return replace(self, version=v, gone=(*self.gone, (v, old)), members=(*self.members, (v, ids)))._counted(old, self)._compacted()

    def _counted(self, touched: DataFrame, was: LineIndex | None) -> LineIndex:
        """Counts of the touched keys, and the filters of shards in which a key became common or ceased to be."""
        v = self.version
        if was is None:
            rows = touched
        else:
            slots = sorted(r.slot for r in touched.select("slot").distinct().collect())  # at most SLOTS
            keys = touched.select(*KEY).distinct()
            old = materialize(was.common(slots).join(keys, KEY, "left_semi"), "line-old-counts")
            rows = self.references(slots).join(keys, KEY, "left_semi")
        now = rows.groupBy(*KEY).agg(F.count("*").alias("n_docs"), F.max("doc_id").alias("keeper")).where(F.col("n_docs") >= self.min_docs)
        if was is not None:  # a key that is common no more has a count of 0 from now on
            now = now.unionByName(old.join(now, KEY, "left_anti").withColumn("n_docs", F.lit(0).cast("long")))
        now = materialize(now, "line-counts")
        then = replace(self, counts=(*self.counts, (v, now)))
        if was is None:
            moves, held = now.withColumn("sign", F.lit(1)), None
        else:
            side = now.where("n_docs > 0")
            moves = side.join(old, KEY, "left_anti").withColumn("sign", F.lit(1)).unionByName(old.join(side, KEY, "left_anti").withColumn("sign", F.lit(-1)))
            moves = materialize(moves, "line-moves")
            held = was.held_filters()
            grown = moves.groupBy("shard").agg(F.sum("sign").alias("more")).join(held, "shard").where("n + more > capacity").select("shard")
            full = materialize(grown, "line-full-filters")
            held = held.join(full, "shard", "left_anti").join(moves.select("shard").distinct(), "shard", "left_semi")
            moves = moves.join(full, "shard", "left_anti").unionByName(then.common().join(full, "shard", "left_semi").withColumn("sign", F.lit(1)))
        made = materialize(change_filters(held, moves.select("shard", "key", "sign", "n_docs")), "line-filters")
        return replace(then, filters=(*self.filters, (v, made)))

    def _compacted(self) -> LineIndex:
        return self.compact() if len(self.refs) + len(self.gone) >= LAYERS else self

    def compact(self) -> LineIndex:
        """The same index, all written anew in one table each."""
        refs = layer(self.references(), self.shards, "line-refs")
        ids = materialize(self.known().withColumn("there", F.lit(True)), "line-members")
        return replace(self, version=1, refs=((1, refs),), gone=(), counts=(), filters=(), members=((1, ids),))._counted(refs, None)

    # Use.

    def dropped(self, refs: DataFrame) -> DataFrame:
        """(doc_id, key): the lines that documents lose, of references (shard, key, doc_id). Filters first, exact counts after."""
        filters = self.held_filters()
        maybe = probe(refs, filters)
        counts = self.common().join(filters.select("shard", "salts"), "shard").select("key", "keeper", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        return maybe.join(counts, ["key", "salt"]).where(F.col("doc_id") != F.col("keeper")).select("doc_id", "key")

    def apply(self, docs: DataFrame, refs: DataFrame | None = None) -> DataFrame:
        """``docs`` with text, n_lines, n_dropped of what stays: see ``dedup_lines``. ``refs``: their references, if they are at hand."""
        min_chars, drop = self.min_chars, "_drop_keys"
        while drop in docs.columns:
            drop += "_"
        lost = self.dropped(references(docs, min_chars, self.shards) if refs is None else refs)
        drops = lost.groupBy("doc_id").agg(F.collect_set("key").alias(drop))
        wide = docs.drop("n_lines", "n_dropped").join(drops, "doc_id", "left")
        fields = [f for f in wide.schema if f.name != drop]
        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_lines long, n_dropped long"

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in steps(batches, "text"):
                texts, n_lines, n_dropped = [], [], []
                for text, keys in zip(batch.column("text").to_pylist(), batch.column(drop).to_pylist(), strict=True):
                    lines = (text or "").split("\n")
                    if keys:
                        gone = set(keys)
                        kept = [x for x, k in zip(lines, line_keys(text, min_chars), strict=True) if k not in gone]
                    else:
                        kept = lines
                    texts.append("\n".join(kept))
                    n_lines.append(len(lines))
                    n_dropped.append(len(lines) - len(kept))
                out = {f.name: batch.column(f.name) for f in fields} | {"text": pa.array(texts, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
                yield pa.RecordBatch.from_arrays(list(out.values()), list(out))

        return wide.mapInArrow(run, schema)


def change_filters(filters: DataFrame | None, changes: DataFrame) -> DataFrame:
    """(shard, filter, capacity, n, salts) after the keys of ``changes`` (shard, key, sign, n_docs) were added (1) or removed (-1).

    One shard a group, whose number of keys is bounded. Shards that ``filters`` lacks get a new one with room for twice
    their keys. salts: into how many parts references are dealt where they meet the shard's counts.
    """

    def run(key, held, moves):
        import pandas as pd

        hashes = moves["hash"].to_numpy(np.int64).view(np.uint64)
        added, taken = np.sort(hashes[moves["sign"] > 0]), hashes[moves["sign"] < 0]
        old = CuckooFilter.load(held["filter"].iloc[0]) if len(held) else CuckooFilter(max(64, 2 * len(added)))
        for value in taken.tolist():
            old.remove(value)
        old.add_all(added)
        n = len(added) - len(taken) + (int(held["n"].iloc[0]) if len(held) else 0)
        salts = max(1, int(moves["n_docs"].max() // HOT_DOCS) if len(moves) else 1, int(held["salts"].iloc[0]) if len(held) else 1)
        return pd.DataFrame({"shard": [key[0]], "filter": [old.dump()], "capacity": [old.capacity], "n": [n], "salts": [salts]})

    out = "shard int, filter binary, capacity long, n long, salts int"
    moves = changes.select("shard", hash_of(F.col("key")).alias("hash"), "sign", "n_docs")
    if filters is None:
        filters = changes.sparkSession.createDataFrame([], out)
    return filters.groupBy("shard").cogroup(moves.groupBy("shard")).applyInPandas(run, out)


def probe(refs: DataFrame, filters: DataFrame, parts: int = 8) -> DataFrame:
    """(key, doc_id, salt): the references whose key the shard's filter may hold.

    References stream past their shard's filter: both are dealt by (shard, part) and sorted so that the filter comes
    first; a task holds one filter at a time. Part and salt are the document's, so a key that a third of all documents
    hold is spread too.
    """
    left = refs.select("shard", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int").alias("part"), F.lit(None).cast("binary").alias("filter"), F.lit(None).cast("int").alias("salts"), "key", "doc_id", hash_of(F.col("key")).alias("hash"))
    right = filters.select("shard", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "filter", "salts", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("long").alias("hash"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, filt, n = None, None, 1
        for batch in batches:
            shards = batch.column("shard").to_numpy()
            isf = np.flatnonzero(batch.column("filter").is_valid().to_numpy(zero_copy_only=False))
            keep, salts = np.zeros(batch.num_rows, bool), np.zeros(batch.num_rows, np.int32)
            cuts = sorted({0, batch.num_rows, *isf.tolist(), *(isf + 1).tolist(), *(np.flatnonzero(np.diff(shards)) + 1).tolist()})
            for a, b in zip(cuts, cuts[1:], strict=False):
                if batch.column("filter")[a].is_valid:
                    shard, filt, n = shards[a], CuckooFilter.load(batch.column("filter")[a].as_py()), batch.column("salts")[a].as_py()
                elif filt is not None and shards[a] == shard:
                    keep[a:b] = filt.contains(batch.column("hash").slice(a, b - a).to_numpy().view(np.uint64))
                    salts[a:b] = batch.column("doc_id").slice(a, b - a).to_numpy() // parts % n
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), pa.array(salts)], ["key", "doc_id", "salt"]).filter(pa.array(keep))

    rows = left.unionByName(right).repartition("shard", "part").sortWithinPartitions("shard", "part", F.col("filter").isNull())
    return rows.mapInArrow(run, "key binary, doc_id long, salt int")


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, shards: int | None = None) -> DataFrame:
    """``docs`` without the lines that many documents share; all columns stay, n_lines and n_dropped come on top.

    A text is split at \\n; a null or empty text is one empty line. A line's key is the line without ASCII white
    space at its ends, A-Z lower-cased. A key of at least ``min_chars`` code points that at least ``min_docs``
    documents hold loses all its lines except in the largest doc_id that holds it. The other lines, joined by \\n,
    are the new text; a null text becomes an empty one.

    Defined cases: rows with the same doc_id are one document; rows without doc_id take no part (their lines count
    for nothing and stay); ``n_lines`` or ``n_dropped`` columns of the input are replaced, other columns are passed
    on; no rows in, no rows out.
    """
    index = LineIndex.build(docs, min_chars, min_docs, shards)
    return index.apply(docs, index.references())
