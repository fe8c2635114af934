"""The pipeline's stages against plain versions, each on its own input."""

import random

import corpus_pipeline as P
import pytest
from imgframe.llm.piece_viterbi import piece_model

from tests.conftest import DATA
from tests.llm import test_decontaminate, test_line_dedup, test_near_dedup

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def documents(spark):
    """Documents of the smallest table with copies, common lines, benchmark passages and nulls put in."""
    rng = random.Random(1)
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").orderBy("doc_id").limit(60).collect()]
    line = "A common line that several of these documents hold in full length."
    rows = [(d, f"{t}\n{line}" if d % 7 == 0 else t) for d, t in rows]
    rows += [(1000 + k, " ".join(test_near_dedup.edited(rng, (t or "x").split(), 1))) for k, (_, t) in enumerate(rows[:20])]
    rows += [(2000, f"before {item} after"), (2001, None), (2002, ""), (2003, item.upper())]
    return [(d, t, "en", "s", len(t or "")) for d, t in rows]


def pairs(frame):
    return sorted((r.doc_id, r.text or "") for r in frame.collect())


def test_stages(spark, documents):
    docs = spark.createDataFrame(documents, SCHEMA)
    rows = [(d, t) for d, t, *_ in documents]

    lines = P.remove_common_lines(spark, docs, str(DATA))
    assert lines.columns == docs.columns
    assert pairs(lines) == test_line_dedup.brute(rows)
    assert all(r.n_chars == len(r.text) for r in lines.collect())

    near = P.remove_near_duplicates(spark, docs, str(DATA))
    kept = {d for d, _, _, keep in test_near_dedup.plain(rows, 5, 80) if keep}
    assert pairs(near) == sorted((d, t or "") for d, t in rows if d in kept)

    clean = P.remove_contaminated(spark, docs, str(DATA))
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [test_decontaminate.words(t)] for i in range(max(1, len(w) - 9)) if w}
    hit = {d for d, t in rows for w in [test_decontaminate.words(t)] if any(tuple(w[i : i + k]) in windows for k in {len(x) for x in windows} for i in range(len(w) - k + 1))}
    assert {2000, 2003} <= hit
    assert pairs(clean) == sorted((d, t or "") for d, t in rows if d not in hit)

    encoded = P.encode(spark, docs, str(DATA)).collect()
    held = piece_model(P.PIECES)
    assert all(r.exact for r in encoded) and len(encoded) == len(rows)
    assert {(r.doc_id, held.decode(r.ids)) for r in encoded} == {(d, t or "") for d, t in rows}


def test_run(spark):
    """Every stage takes something away and most documents come through; columns stay but for the last stage."""
    assert [name for name, _ in P.STAGES] == ["toxicity", "line dedup", "near duplicates", "decontamination", "pieces"]
    out = P.run(spark, str(DATA))
    n = spark.read.parquet(f"{DATA}/documents.parquet").count()
    assert 0.5 * n < out.count() < n and out.where("NOT exact").count() == 0
    empty = spark.createDataFrame([], SCHEMA)
    for _, stage in P.STAGES:
        assert stage(spark, empty, str(DATA)).count() == 0


def test_rows_without_ids_and_repeated_ids(spark):
    """Each row is judged by its own text: contaminated ones go without doc_id too, and take no other of their doc_id along."""
    item = spark.read.parquet(f"{DATA}/benchmark.parquet").first().text
    rows = [(None, item, None, None, None), (None, "clean", None, None, None), (5, item, "en", "s", 1), (5, "also clean", "en", "s", 1), (6, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("digest", P.F.lit("clash"))
    clean = P.remove_contaminated(spark, docs, str(DATA))
    assert clean.columns == list(P.COLUMNS)
    assert sorted((r.doc_id or 0, r.text or "") for r in clean.collect()) == [(0, "clean"), (5, "also clean"), (6, "")]
    for _, stage in P.STAGES[:3]:
        assert stage(spark, docs, str(DATA)).count() in (4, 5)
    assert P.encode(spark, docs, str(DATA)).count() == 5


def test_the_table_runs_without_labels_of_its_documents(spark):
    """With no document labelled, no row goes by toxicity."""
    docs = spark.createDataFrame([(10**9, "a text", "en", "s", 6)], SCHEMA)
    assert P.remove_toxic(spark, docs, str(DATA)).count() == 1
