"""Near-duplicate documents: one-permutation MinHash, banded buckets, star-shaped candidates, exact links.

1. Every text is sketched in one pass: a word-shingle set is hashed once, each of ``BINS`` ranges of the hash
   keeps its least value, and an empty bin borrows from a bin that its own random order of bins reaches first
   (optimal densification). Equal sets make one class, known by the fingerprint of its set.
2. ``BANDS`` bands of ``ROWS`` bins each give buckets. A bucket's members are joined to its smallest member
   only: a star, so candidates grow with the members and not with their square.
3. Candidates are confirmed on the full sets, and confirmed links joined up to components.
4. A star misses links between members that its centre is not linked with. So the members of buckets that still
   hold several components go through an exact prefix join, from rare shingles to common ones, with bounds on sizes
   and places, and on the bits in which two sets must differ (each shingle flips one bit of a short row of bits). Only
   pairs of different components that pass all bounds are written; these are confirmed too. So of a family of pages
   from one template that are just not similar enough, next to no pair is written. No bucket is capped, and the rows
   of a common shingle are compared in blocks.

At the similarities confirmed here a pair shares no bucket with probability under 1e-6.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, ascii_words, materialize, steps

BANDS, ROWS = 48, 5
BINS = BANDS * ROWS
#: For each bin, the order in which it looks for a bin to borrow from.
BORROW = np.stack([np.random.default_rng([7, i]).permutation(BINS) for i in range(BINS)])

#: Bits of a set's row of bits, at most.
FLIP_BITS = 4_096
#: Rows of a common shingle that are compared in one block, about.
BLOCK_ROWS = 2_048


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
        x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
        return x ^ (x >> np.uint64(33))


def shingle_sets(texts: pa.Array, k: int) -> Iterator[np.ndarray]:
    """For each text the sorted 64-bit hashes of its distinct k-word shingles; of fewer words the whole sequence."""
    codes, ends, words = ascii_words(pc.ascii_lower(pc.fill_null(texts, "")))
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in words.cast(pa.large_binary()).to_pylist()), np.uint64, len(words))[codes] if len(codes) else np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        rolled = np.zeros(max(0, len(hashes) - k + 1), np.uint64)
        for j in range(k):
            rolled = rolled * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + len(rolled)]
        rolled = mixed(rolled)
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            if b - a >= k:
                yield np.unique(rolled[a : b - k + 1])
            elif b > a:
                yield mixed(np.array([xxhash.xxh3_64_intdigest(hashes[a:b].tobytes())], np.uint64))
            else:
                yield np.zeros(0, np.uint64)


def bands_of(shingles: np.ndarray) -> np.ndarray:
    """The bucket of each band for a non-empty sorted set: int64[BANDS]."""
    filled, first = np.unique(((shingles >> np.uint64(32)) * np.uint64(BINS)) >> np.uint64(32), return_index=True)
    filled = filled.astype(np.int64)
    sketch = np.zeros(BINS, np.uint64)
    sketch[filled] = shingles[first]
    if len(filled) < BINS:
        full = np.zeros(BINS, bool)
        full[filled] = True
        empty = np.flatnonzero(~full)
        order = BORROW[empty]
        sketch[empty] = sketch[order[np.arange(len(empty)), full[order].argmax(axis=1)]]
    with np.errstate(over="ignore"):
        out = np.arange(1, BANDS + 1, dtype=np.uint64)
        for column in sketch.reshape(BANDS, ROWS).T:
            out = mixed(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out.view(np.int64)


def fingerprint(own: np.ndarray, doc_id: int) -> bytes:
    """Of a set; an empty one is a class of its own for each doc_id."""
    return hashlib.blake2b(own.tobytes() if len(own) else b"%d" % doc_id, digest_size=16).digest()


def flips_of(shingles: np.ndarray) -> np.ndarray:
    """A row of bits, of which each shingle flips one: int64 words, 16 bits a shingle or more, but at most ``FLIP_BITS``.

    Two sets differ in at least as many shingles as their rows in bits.
    """
    bits = 256
    while bits < min(16 * len(shingles), FLIP_BITS):
        bits *= 2
    odd = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits).astype(np.uint8) & 1
    return np.packbits(odd, bitorder="little").view("<i8")


def sketches(docs: DataFrame, k: int) -> DataFrame:
    """(doc_id, n, fp, bands): set size, fingerprint of the set, buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            n, fps, bands = [], [], []
            for doc_id, own in zip(batch.column("doc_id").to_pylist(), shingle_sets(batch.column("text"), k), strict=True):
                n.append(len(own))
                fps.append(fingerprint(own, doc_id))
                bands.append(bands_of(own) if len(own) else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(fps, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc_id", "n", "fp", "bands"])

    return docs.mapInArrow(run, "doc_id long, n long, fp binary, bands array<long>")


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """(fp, n, shingles, flips): the whole sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            sets = list(shingle_sets(batch.column("text"), k))
            fps = [fingerprint(x, d) for x, d in zip(sets, batch.column("doc_id").to_pylist(), strict=True)]
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(fps, pa.binary()), pa.array([len(x) for x in sets], pa.int64()), pa.array([x.view(np.int64) for x in sets], longs), pa.array([flips_of(x) for x in sets], longs)], ["fp", "n", "shingles", "flips"])

    return docs.mapInArrow(run, "fp binary, n long, shingles array<long>, flips array<long>")


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets have 100 * intersection >= percent * union."""
    side = lambda c: sets.select(F.col("node").alias(c), F.col("n").alias(f"n_{c}"), F.col("shingles").alias(f"s_{c}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a")
    shared = F.size(F.array_intersect("s_a", "s_b")).cast("long")
    return both.select("a", "b", "n_a", "n_b", shared.alias("shared")).where(F.col("shared") * (100 + percent) >= (F.col("n_a") + F.col("n_b")) * percent).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b): the least node that links reach.

    Alternates large-star and small-star steps, each a grouping and a join, until the edges stay the same.
    """
    edge = lambda u, v: F.struct(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
    rounds = Scratch(links.sparkSession)
    edges = rounds.keep(links.where("a <> b").select(edge(F.col("a"), F.col("b")).alias("e")).select("e.*").distinct(), "component-edges")
    mark = lambda e: tuple(e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first())
    seen = mark(edges)
    while seen[0]:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        edges = edges.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u > v").distinct()
        last = rounds
        rounds = Scratch(links.sparkSession)
        edges = rounds.keep(edges, "component-edges")
        last.clear()
        now = mark(edges)
        if now == seen:
            break
        seen = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """For each row of ``docs``: doc_id, n_shingles, component_id (the smallest doc_id that links reach), kept.

    Words are runs without ASCII white space, A-Z lower-cased. A text's set is its distinct ``k``-word shingles,
    or the whole sequence where it has fewer words. Documents whose sets have a similarity of at least
    ``percent`` / 100 are linked; kept is true for the smallest doc_id of a component.

    Defined cases: a null or blank text has an empty set and is linked with nothing; a row without doc_id is
    linked with nothing, has a null component_id and is kept; rows that repeat a doc_id are judged each by its own
    text, also where their texts differ; other columns are ignored; no rows in, no rows out.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    known = docs.where("doc_id IS NOT NULL")
    sketch = materialize(sketches(known, k), "near-sketches")
    scratch = Scratch(docs.sparkSession)
    classes, members, sets = candidates(sketch, known, k, scratch)

    stars = members.where("node <> centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    linked = components(confirmed(stars, sets, percent))
    found = scratch.keep(linked, "near-components")
    more, _ = remaining_links(members, found, sets, percent, scratch)
    final = classes.select("fp", "node", "rep").join(components(more), "node", "left").select("fp", "rep", F.coalesce("component", "node").alias("component"))
    final = materialize(final, "near-final")
    scratch.clear()
    least = final.groupBy("component").agg(F.min("rep").alias("component_id"))
    out = sketch.join(final.join(least, "component").select("fp", "component_id"), "fp")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))

    def lone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text"):
            n = [len(x) for x in shingle_sets(batch.column("text"), k)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.nulls(len(n), pa.int64()), pa.array([True] * len(n))], ["doc_id", "n_shingles", "component_id", "kept"])

    return out.unionByName(docs.where("doc_id IS NULL").mapInArrow(lone, "doc_id long, n_shingles long, component_id long, kept boolean"))


def candidates(sketch: DataFrame, known: DataFrame, k: int, scratch: Scratch) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes (node, fp, rep) of equal sets; members (node, bucket, centre) of buckets that hold several; the whole sets (node, …) of these.

    A class gets its number as it is written, once.
    """
    classes = sketch.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id())
    classes = scratch.keep(classes, "near-classes")
    nodes = scratch.keep(classes.select("node", F.explode("bands").alias("bucket")), "near-buckets")
    centres = nodes.groupBy("bucket").agg(F.min("node").alias("centre"), F.max("node").alias("last")).where("centre < last").drop("last")
    members = scratch.keep(nodes.join(centres, "bucket"), "near-members")
    held = classes.join(members.select("node").distinct(), "node", "left_semi").select("fp", "node", F.col("rep").alias("doc_id"))
    sets = full_sets(known.join(held.select("doc_id").distinct(), "doc_id", "left_semi"), k).join(held.select("fp", "node"), "fp").select("node", "n", "shingles", "flips")
    if sketch.groupBy("fp", "doc_id").count().where("count > 1").limit(1).count():  # rows that repeat both doc_id and text
        sets = sets.groupBy("node").agg(*[F.first(c).alias(c) for c in ("n", "shingles", "flips")])
    return classes, members, scratch.keep(sets, "near-sets")


def differing_bits(a: Column, b: Column) -> Column:
    """In how many bits two rows of bits differ, the longer one folded to the length of the shorter."""
    words = F.least(F.size(a), F.size(b))
    fold = lambda z: F.when(F.size(z) == words, z).otherwise(F.aggregate(F.sequence(F.lit(1), (F.size(z) / words).cast("int") - 1), F.slice(z, F.lit(1), words), lambda s, i: F.zip_with(s, F.slice(z, i * words + 1, words), lambda x, y: x.bitwiseXOR(y))))
    return F.aggregate(F.zip_with(fold(a), fold(b), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)


def open_classes(members: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, part): the classes in buckets that hold several components; part is struct<size, component> of its own."""
    rows = members.select("bucket", "node").join(found, "node", "left").select("bucket", "node", F.coalesce("component", "node").alias("component"))
    several = rows.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low < high").select("bucket")
    still_open = scratch.keep(rows.join(several, "bucket").select("node", "component").distinct(), "near-open")
    sizes = still_open.groupBy("component").agg(F.count("*").alias("size"))
    return scratch.keep(still_open.join(sizes, "component").select("node", F.struct("size", "component").alias("part")), "near-parts")


def prefixes(sets: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(node, n, x, place, df, flips): the shingles of each of the open ``classes`` that may be the first shared with a set over the threshold.

    A set's shingles are put in order from rare to common among these sets. Two sets that reach the threshold share
    one of the first ``n - percent / 100 * n + 1`` shingles of each.
    """
    shingles = scratch.keep(sets.join(classes.select("node"), "node", "left_semi").select("node", "n", F.explode("shingles").alias("x")), "near-open-shingles")
    counts = shingles.groupBy("x").agg(F.count("*").alias("df"))
    place = F.row_number().over(Window.partitionBy("node").orderBy("df", "x")) - 1
    placed = shingles.join(counts, "x").withColumn("place", place).where((F.col("df") > 1) & (F.col("n") - F.col("place") >= F.ceil(F.col("n") * percent / 100)))
    return scratch.keep(placed.join(sets.select("node", "flips"), "node"), "near-prefixes")


def open_pairs(placed: DataFrame, classes: DataFrame, percent: int, scratch: Scratch) -> DataFrame:
    """(a, b): pairs of ``classes`` in different components that may still reach the threshold, from ``prefixes``.

    At the first shingle that two sets share, what is left of either must hold the rest of the intersection that the
    threshold asks for; and their rows of bits may differ in no more bits than the sets in shingles. Where a shingle
    is common, the members of its largest component are joined with those of others only, and rows are dealt to
    blocks, each of which meets each once.
    """
    rows = placed.join(classes, "node")
    largest = rows.groupBy("x").agg(F.max("part").alias("largest"), F.min("part").alias("least")).where("least < largest").drop("least")
    rows = rows.join(largest, "x").withColumn("blocks", F.ceil(F.col("df") / BLOCK_ROWS).cast("int"))
    rows = scratch.keep(rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")), "near-placed")
    each = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    a, b = (rows.select("x", "largest", F.col("block").alias(own), each.alias(other), *(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "part", "place", "flips"))) for s, own, other in (("a", "i", "j"), ("b", "j", "i")))
    left = F.least(F.col("n_a") - F.col("place_a"), F.col("n_b") - F.col("place_b"))
    both = F.col("n_a") + F.col("n_b")
    fits = (left * (100 + percent) >= both * percent) & (differing_bits(F.col("flips_a"), F.col("flips_b")) * (100 + percent) <= both * (100 - percent))
    pairs = a.where(F.col("part_a") != F.col("largest")).drop("largest").join(b.drop("largest"), ["x", "i", "j"]).where((F.col("part_a") < F.col("part_b")) & fits)
    return pairs.select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def remaining_links(members: DataFrame, found: DataFrame, sets: DataFrame, percent: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Links (a, b) that stars leave open, and all pairs that were written to find them.

    First each class is tried with one of those that it may be linked with; that joins most of what is to be joined.
    Then all pairs that may still be linked across components are tried.
    """
    classes = open_classes(members, found, scratch)
    placed = prefixes(sets, classes, percent, scratch)
    links = found.select(F.col("component").alias("a"), F.col("node").alias("b"))
    first = scratch.keep(open_pairs(placed, classes, percent, scratch).groupBy("a").agg(F.min("b").alias("b")), "near-first")
    links = scratch.keep(links.unionByName(confirmed(first, sets, percent)), "near-links")
    classes = open_classes(members, scratch.keep(components(links), "near-components"), scratch)
    rest = scratch.keep(open_pairs(placed, classes, percent, scratch).distinct(), "near-rest")
    return links.unionByName(confirmed(rest, sets, percent)), first.unionByName(rest)
