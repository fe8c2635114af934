"""Benchmark decontamination as a prefix-filtered set join, in DataFrame functions only.

An item is cut into windows of ``window`` consecutive words; a document is hit where it contains a window whole.
Seen as sets of shingles with their places, containment is a similarity join with threshold one: a window's
prefix, in an order of shingles from rare to common, then needs a single token. So

1. the shingles (``shingle`` words; all words of a shorter window) of every document that items have too are
   written down with their places and counted, which gives each shingle's rarity in the whole corpus;
2. each distinct window keeps its rarest shingle and that shingle's place in it (the prefix);
3. those of the documents join prefixes; the place of the match fixes the only place where the window can begin, and
   length and position bounds drop what would not fit;
4. the words at that place are compared with the window's words.

Only hashes and places are exploded; words are joined back once, by a hash of the row, for the last step.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import A_TO_Z, A_TO_Z_LOWER, materialize

#: What lies between words, once A-Z are lower-cased.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Rows of the items' shingle table up to which it is broadcast (about 100 bytes each); a larger one is shuffled.
BROADCAST_ROWS = 200_000


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased and nothing else; the quicker way for texts of ASCII alone."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, A_TO_Z, A_TO_Z_LOWER))


def words_of(text: Column) -> Column:
    """Lower-cased (A-Z) words; a null text has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles by place; null at the last places, where fewer words are left."""
    token = lambda x, i: F.when(i <= F.size(words) - k, F.xxhash64(F.lit(k), x, *(F.get(words, i + j) for j in range(1, k))))
    return F.transform(words, token)


def item_windows(items: DataFrame, window: int, shingle: int) -> DataFrame:
    """(win array<string>, k, item_ids array<string> sorted): distinct windows, their shingle size and items."""
    words = items.select(F.col("item_id").cast("string").alias("item_id"), words_of(F.col("text")).alias("words")).where(F.size("words") > 0)
    starts = F.sequence(F.lit(0), F.greatest(F.size("words") - window, F.lit(0)))
    rows = words.select("item_id", F.explode(F.transform(starts, lambda i: F.slice(F.col("words"), i + 1, window))).alias("win"))
    return rows.groupBy("win").agg(F.sort_array(F.collect_set("item_id")).alias("item_ids")).withColumn("k", F.least(F.size("win"), F.lit(shingle)))


def small(df: DataFrame, rows: int) -> DataFrame:
    """``df`` with a broadcast hint if its ``rows``, counted before, are within the bound."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, shingle: int = 5) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, n_hit (words inside a window), item_ids (of occurring windows, sorted).

    Words are runs of 0-9, a-z and all characters from U+0080, after lower-casing A-Z. An item of fewer than
    ``window`` words, but not none, is one window. All occurrences count, overlapping ones too.

    Defined cases: a null or empty text has no words and is not hit; items without words have no window; an item
    without item_id hits words but is in no list; equal items hit together; repeated doc_id rows are judged each
    by its own text; other columns of either table are ignored; without items nothing is hit.
    """
    windows = materialize(item_windows(items, window, shingle), "decontaminate-windows")
    sizes = sorted(r.k for r in windows.select("k").distinct().collect())  # at most `shingle` values
    base = docs.select("doc_id", F.col("text").cast("string").alias("text")).withColumn("row_key", F.xxhash64("doc_id", "text"))
    if not sizes:
        return base.select("doc_id", F.size(words_of(F.col("text"))).cast("long").alias("n_words"), F.lit(0).cast("long").alias("n_hit"), F.array().cast("array<string>").alias("item_ids"))

    def tokens(df: DataFrame, words: str, *keep: str) -> DataFrame:
        sized = [df.select(*keep, F.size(words).alias("n_words"), F.posexplode_outer(shingles(F.col(words), k)).alias("pos", "token")) for k in sizes]
        return reduce(DataFrame.unionByName, sized).where("token IS NOT NULL")

    # Of items only: with the shingle size of their window.
    placed = reduce(DataFrame.unionByName, [windows.where(F.col("k") == k).select("win", "item_ids", F.posexplode(shingles(F.col("win"), k)).alias("offset", "token")) for k in sizes]).where("token IS NOT NULL")
    names = materialize(placed.select("token").distinct(), "decontaminate-tokens")
    own = tokens(base.select("row_key", words_of(F.col("text")).alias("words")), "words", "row_key")
    matches = materialize(own.join(small(names, names.count()), "token"), "decontaminate-matches")
    counted = matches.groupBy("token").agg(F.count("*").alias("n_corpus"))
    # The rarest shingle of each window, at the first of its places there; a window with one that no document has occurs nowhere.
    ranked = placed.join(counted, "token").groupBy("win").agg(F.count("*").alias("found"), F.min_by(F.struct("token", "offset", "item_ids"), F.struct("n_corpus", "token", "offset")).alias("p"))
    ranked = ranked.where(F.col("found") == F.size("win") - F.least(F.size("win"), F.lit(shingle)) + 1)
    prefixes = materialize(ranked.select(F.col("p.token").alias("token"), F.col("p.offset").alias("offset"), F.size("win").alias("n_win"), "win", F.col("p.item_ids").alias("item_ids")), "decontaminate-prefixes")

    start = F.col("pos") - F.col("offset")
    found = matches.join(small(prefixes, prefixes.count()), "token").where((start >= 0) & (start + F.col("n_win") <= F.col("n_words")))
    candidates = found.groupBy("row_key").agg(F.collect_set(F.struct(start.alias("start"), "win", "item_ids")).alias("candidates"))

    joined = base.join(candidates, "row_key", "left").select("doc_id", words_of(F.col("text")).alias("words"), "candidates")
    hits = F.filter(F.coalesce("candidates", F.array().cast("array<struct<start:int,win:array<string>,item_ids:array<string>>>")), lambda c: F.slice(F.col("words"), c.start + 1, F.size(c.win)) == c.win)
    judged = joined.select("doc_id", F.size("words").cast("long").alias("n_words"), hits.alias("hits"))
    covered = F.flatten(F.transform("hits", lambda h: F.sequence(h.start, h.start + F.size(h.win) - 1)))
    ids = F.flatten(F.transform("hits", lambda h: h.item_ids))
    return judged.select("doc_id", "n_words", F.size(F.array_distinct(covered)).cast("long").alias("n_hit"), F.array_sort(F.array_distinct(ids)).alias("item_ids"))
