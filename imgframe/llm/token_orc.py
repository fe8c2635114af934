"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are dealt into ranges of doc_id and encoded in that order; each range is one ORC file, whose rows carry
the document's place among the file's ids. A document's place among all ids is then its file's base, a running sum
over one row a file, plus that. Files are read stripe by stripe in parallel, and a lookup of documents skips
files, stripes and row groups by their statistics and Bloom filters before any ids are read.
"""

from __future__ import annotations

import functools
import json
import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import ascii_words, forget, joined_ids, new_path, steps

END_ID = 1

ORC_OPTIONS = {
    "compression": "zstd",
    "orc.create.index": "true",
    "orc.row.index.stride": "1000",
    "orc.stripe.size": str(16 << 20),
    "orc.bloom.filter.columns": "doc_id",
    "orc.bloom.filter.fpp": "0.01",
}


class WordEncoder:
    """Encodes whole texts by their distinct words, with a BPE file of word ends that lower-cases and drops white space.

    White space separates words wherever it stands, and a letter from marks after it, so the ids of a text are those
    of its words in order. Distinct words are encoded together and their ids kept for later texts: words of letters
    alone or marks alone, whose ids end with a word end, by the model alone, and all others through the whole
    tokenizer with ``MARK`` between them.
    """

    MARK = "\x01"
    #: Letters and marks of which words stay whole; the wide ones are tried on the file first. Characters of special tokens and the apostrophe are in neither.
    WIDE, NARROW = ("A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:;=?@\[-`{}~"), ("A-Za-z", ",.;:!?")

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.letters = Tokenizer(self.whole.model)  # one model in memory for both
        self.letters.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        suffix = json.loads(self.whole.to_str())["model"]["end_of_word_suffix"]
        vocabulary = self.whole.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith(suffix)]] = True
        (self.mark,) = self.whole.encode(self.MARK, add_special_tokens=False).ids
        letters, marks = self.WIDE if self._is_wide() else self.NARROW
        self.before_marks = (f"([{letters}])([{marks}]+)(\\s|$)", r"\1 \2\3")
        self.alone = f"^[{letters}]+$|^[{marks}]+$"
        self.known: dict[str, bytes] = {}

    def _is_wide(self) -> bool:
        """Whether the file takes words of wide letters and of wide marks as a whole, and parts the two."""
        letters, marks = (re.findall(f"[{kind}]", "".join(map(chr, range(256)))) for kind in self.WIDE)
        words = [*(f"a{c}b" for c in letters), *(m + n for m in marks for n in marks)]
        parted = [(f"a{m}", f"a {m}") for m in marks]
        ids = lambda tokenizer, texts: [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        return ids(self.whole, words) == ids(self.letters, [w.lower() for w in words]) and ids(self.whole, [x for x, _ in parted]) == ids(self.whole, [y for _, y in parted])

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, where each text's ids begin and the end)."""
        codes, ends, words = ascii_words(pc.replace_substring_regex(pc.fill_null(texts, "").cast(pa.large_string()), *self.before_marks))
        flat, place = joined_ids(self._of_words(words), codes, np.uint32)
        return flat, place[ends]

    def _of_words(self, words: pa.Array) -> list[bytes]:
        """The ids of each word; those of new words are worked out and kept."""
        alone = pc.match_substring_regex(words, self.alone)
        keys = pc.if_else(alone, pc.utf8_lower(words), words).to_numpy(zero_copy_only=False).tolist()
        new = {w: a for w, a in zip(keys, alone.to_numpy(zero_copy_only=False).tolist(), strict=True) if w not in self.known}
        for kind, encode in ((True, self._of_letters), (False, self._of_any)):
            some = [w for w, a in new.items() if a is kind]
            flat, lengths = encode(some)
            data, ends = flat.astype(np.uint32).tobytes(), (4 * np.cumsum(lengths)).tolist()
            self.known.update(zip(some, map(data.__getitem__, map(slice, [0, *ends[:-1]], ends)), strict=True))
        out = [self.known[w] for w in keys]
        forget(self.known, new)
        return out

    def _of_letters(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, number of ids of each)."""
        flat = self._joined(self.letters, words, " ")
        lengths = np.diff(np.flatnonzero(self.ends[flat]), prepend=-1)
        self._check(lengths, words)
        return flat, lengths

    def _of_any(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if any(self.MARK in w for w in words):
            ids = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch(words, add_special_tokens=False)]
            return np.concatenate(ids), np.array([len(x) for x in ids])
        flat = self._joined(self.whole, [f"{w} {self.MARK}" for w in words], " ")
        marks = flat == self.mark
        lengths = np.diff(np.flatnonzero(marks), prepend=-1) - 1
        self._check(lengths, words)
        return flat[~marks], lengths

    @staticmethod
    def _check(lengths: np.ndarray, words: list[str]) -> None:
        if len(lengths) != len(words):
            raise ValueError("this tokenizer does not encode words apart from each other")

    @staticmethod
    def _joined(tokenizer, words: list[str], by: str) -> np.ndarray:
        parts = [np.zeros(0, np.uint32)]
        for i in range(0, len(words), 2000):  # one at a time, as what the library returns is many times the size of the ids
            (encoding,) = tokenizer.encode_batch_fast([by.join(words[i : i + 2000])], add_special_tokens=False)
            parts.append(np.array(encoding.ids, np.uint32))
        return np.concatenate(parts)


@functools.cache
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def token_batches(batches: Iterator[pa.RecordBatch], encode: WordEncoder, file: int, end_id: int) -> Iterator[pa.RecordBatch]:
    """(doc_id, file, local_start, ids) of the (doc_id, text) of one file, a bounded step of text at a time."""
    start = 0
    for batch in steps(batches, "text"):
        flat, place = encode(batch.column("text"))
        n = np.diff(place) + 1
        ends = np.cumsum(n)
        ids = np.insert(flat, place[1:], end_id).astype(np.int32)
        rows = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(ids))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.full(len(n), file, np.int32)), pa.array(start + ends - n), rows], ["doc_id", "file", "local_start", "ids"])
        start += int(ends[-1])


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Writes (doc_id, file, local_start, ids) as ORC under ``path``, in ascending doc_id order over the files.

    ``tokenizer`` is a file of the tokenizers library as ``WordEncoder`` wants it. ``end_id`` ends each document. A null text counts as empty; rows that repeat a doc_id follow each other in the order of their
    texts' hashes; rows without doc_id come first; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return token_batches(batches, word_encoder(tokenizer), TaskContext.get().partitionId(), end_id)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    dealt = rows.repartitionByRange(F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    dealt.mapInArrow(run, "doc_id long, file int, local_start long, ids array<int>").write.options(**ORC_OPTIONS).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, ids): each document's ids, end id included, and how many ids all documents before it have."""
    rows = spark.read.schema("doc_id long, file int, local_start long, ids array<int>").orc(path)
    ends = rows.groupBy("file").agg(F.max(F.col("local_start") + F.size("ids")).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ends.select("file", before.alias("base"))  # one row a file
    return rows.join(F.broadcast(bases), "file").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "ids")


def lookup_tokens(spark: SparkSession, path: str, doc_ids: list[int]) -> DataFrame:
    """(doc_id, ids) of a few documents; the filter reaches the ORC reader, which prunes by indexes and Bloom filters."""
    return spark.read.schema("doc_id long, ids array<int>").orc(path).where(F.col("doc_id").isin([int(x) for x in doc_ids]))


def token_digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of rows of ``read_tokens``; the crc is over little-endian unsigned 32-bit ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            offsets = lists.offsets.to_numpy()
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy(zero_copy_only=False).astype("<u4"))).cast("B")
            crcs = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("start"), pa.array(np.diff(offsets).astype(np.int64)), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_to_orc(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes the tokens of ``docs`` to a new place in the shared folder and returns ``read_tokens`` of it."""
    path = new_path(docs.sparkSession, "token-ids")
    write_tokens(docs, path, tokenizer)
    return read_tokens(docs.sparkSession, path)
