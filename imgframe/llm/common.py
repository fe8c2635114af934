"""What several of the training-data operators share: the shared folder, and words in Arrow batches."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

A_TO_Z, A_TO_Z_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that one step of a Python task works on; a longer text is a step of its own.
STEP_BYTES = 4 << 20
#: Distinct words whose ids a worker remembers; then it forgets all and starts anew. Words of more characters are not kept.
MEMO_WORDS, MEMO_CHARS = 250_000, 64


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset it is an error on a cluster; in a session of one process a new local folder is set.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="imgframe-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing uses yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


class Scratch:
    """Tables written on the way to a result, to be deleted once it stands without them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` written and read back, as by ``materialize``."""
        path = new_path(self.spark, name)
        self.paths.append(path)
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def clear(self) -> None:
        delete(self.spark, *self.paths)
        self.paths.clear()


def delete(spark: SparkSession, *paths: str) -> None:
    """Deletes folders by the file system that they are in."""
    for path in paths:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def materialize(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as a Parquet table in the shared folder and read back: cuts lineage, survives lost executors."""
    return Scratch(df.sparkSession).keep(df, name)


def steps(batches: Iterator[pa.RecordBatch], column: str, size: int = STEP_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches, cut so that the texts of ``column`` in each have about ``size`` bytes (one row at least)."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        group = (np.cumsum(lengths) - lengths) // size
        ends = [*(np.flatnonzero(np.diff(group)) + 1), batch.num_rows]
        start = 0
        for end in ends:
            yield batch.slice(start, end - start)
            start = end


def ascii_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between ASCII white space: (codes of all texts' words, first word of each text with the end, distinct words)."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
    offsets = lists.offsets.to_numpy()
    words = lists.flatten()
    real = pc.not_equal(words, "").to_numpy(zero_copy_only=False)
    kept = np.concatenate([[0], np.cumsum(real)])
    coded = words.filter(pa.array(real)).dictionary_encode()
    return coded.indices.to_numpy(zero_copy_only=False), kept[offsets - offsets[0]], coded.dictionary


def joined_ids(ids: list[bytes], codes: np.ndarray, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(ids of the words ``codes``, where each word's ids begin and the end); ``ids``: of each distinct word, as bytes."""
    flat = np.frombuffer(b"".join(ids), kind)
    lengths = np.fromiter(map(len, ids), np.int64, len(ids)) // flat.itemsize
    n = lengths[codes]
    place = np.concatenate([[0], np.cumsum(n)])
    at = np.repeat((np.cumsum(lengths) - lengths)[codes] - place[:-1], n)
    at += np.arange(place[-1])
    return flat[at], place


def forget(known: dict[str, bytes], new: Iterable[str]) -> None:
    """Keeps what a worker remembers of words within its bounds; ``new``: the words that came last."""
    if len(known) > MEMO_WORDS:
        known.clear()
    for word in new:
        if len(word) > MEMO_CHARS:
            known.pop(word, None)
