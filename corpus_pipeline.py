"""A corpus pipeline of five stages over ``documents``: each works on all rows that the one before it kept.

All stages take nulls in any column: a null text counts as empty, and stays so until line dedup makes it an empty one;
rows without doc_id are judged by their texts as others are, but for near duplicates, where they stay. Empty tables
give empty tables; columns beside those of ``documents`` are not passed on.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from imgframe.llm.common import delete, shared_folder
from imgframe.llm.decontaminate import decontaminate
from imgframe.llm.line_dedup import dedup_lines
from imgframe.llm.near_dedup import near_duplicates
from imgframe.llm.piece_viterbi import encode_pieces
from imgframe.llm.toxicity import fit_on_documents, score_toxicity

#: File of a public tokenizer.
PIECES = public_tokenizers.path("piece_bpe_32k.model")
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: SQL can't express the classifier; the tests hold the stages against plain versions.
ORACLE_SQL = None


def remove_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score under 0.5, by a classifier that learns from ``labels``.

    Each row is judged by its own text, also where doc_ids repeat or are missing; an empty text scores as the model's
    bias. Without labels of both kinds nothing is learnt, and no document goes.
    """
    model = fit_on_documents(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    if not model.weights:
        return docs.select(*COLUMNS)
    return score_toxicity(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def remove_common_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines of 40 or more code points that at least 5 of them share; n_chars follows the text."""
    return dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def remove_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest doc_id, of each group linked by a similarity of 0.8 on five-word shingles.

    A doc_id goes with all its rows if any of them is not the one that stays; rows without doc_id stay.
    """
    docs = docs.select(*COLUMNS)
    gone = near_duplicates(docs, k=5, percent=80).where("NOT kept").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def remove_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of ten words of any ``benchmark`` item.

    A row goes if its own text holds one, whatever its doc_id; such rows are known by digests of doc_id and text.
    """
    docs = docs.select(*COLUMNS).withColumn("digest", F.sha2(F.concat_ws(" ", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text"), 256))
    texts = docs.select(F.col("digest").alias("doc_id"), "text")
    hit = decontaminate(texts, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("n_hit > 0").select(F.col("doc_id").alias("digest")).distinct()
    return docs.join(hit, "digest", "left_anti").select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with the piece ids of their texts, their number, and whether decoding gives the text back; repeated rows are encoded each."""
    return encode_pieces(docs.select(*COLUMNS), PIECES, verify=True).select("doc_id", "lang", "source", "n_chars", "n_pieces", "ids", "exact")


STAGES = [
    ("toxicity", remove_toxic),
    ("line dedup", remove_common_lines),
    ("near duplicates", remove_near_duplicates),
    ("decontamination", remove_contaminated),
    ("pieces", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``; each stage's result is written to the shared folder and read again.

    A result is deleted when the next one has been written; the last one stays, as it is returned.
    """
    docs, folder, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}", None
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            delete(spark, last)
        last = path
    return docs
