import os
import subprocess
import sys
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from imgframe.llm.queries import op4_token_orc
from imgframe.llm.token_orc import WordEncoder, encode_to_orc, lookup_tokens, read_tokens, token_digests, word_encoder, write_tokens
from tokenizers import Tokenizer

from tests.conftest import DATA, REPO

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def plain(tokenizer, rows):
    """Whole texts, one by one, in order of doc_id."""
    start = 0
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        yield doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())
        start += len(ids)


def test_against_whole_texts(spark, tokenizer):
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").collect())
    got = sorted(tuple(r) for r in op4_token_orc(spark, str(DATA)).select("doc_id", "start", "n_tokens", "ids_crc32").collect())
    assert got == list(plain(tokenizer, rows))


def test_cases(spark, tokenizer):
    texts = [(5, "Hello, World!"), (1, None), (2, ""), (3, " \u00a0\u2003 tab\tnew\nline\u0085x "), (4, "a<|endoftext|>b <|startoftext|>"), (9, "ＡＢＣ ﬁ İ é e\u0301 ß"), (7, "wo\u200brd " * 50_000), (8, "x" * 30_000)]
    frame = spark.createDataFrame([(*t, 0) for t in texts], "doc_id long, text string, start int")
    got = sorted(tuple(r) for r in token_digests(encode_to_orc(frame, PATH)).collect())
    assert got == list(plain(tokenizer, sorted(texts)))


def test_lookup_and_repeats(spark, tmp_path):
    frame = spark.createDataFrame([(i, f"word{i}") for i in range(500)] + [(7, "again"), (None, "lost")], "doc_id long, text string")
    write_tokens(frame, f"file://{tmp_path}/t", PATH)
    assert sorted(r.doc_id for r in lookup_tokens(spark, f"file://{tmp_path}/t", [7, 499]).collect()) == [7, 7, 499]
    rows = read_tokens(spark, f"file://{tmp_path}/t").orderBy("start").collect()
    assert [r.doc_id for r in rows] == [None, *sorted([*range(500), 7])]
    assert rows[-1].start + len(rows[-1].ids) == sum(len(r.ids) for r in rows)


def test_no_rows(spark):
    assert encode_to_orc(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0


def test_files(spark, tmp_path):
    """Stripes with row indexes, Bloom filters on doc_id and run lengths; a lookup reads few rows of many."""
    rows = spark.range(0, 60_000, 1, 1).selectExpr("id AS doc_id", "concat('some words of document ', id) AS text")
    write_tokens(rows, f"file://{tmp_path}/t", PATH)
    files = sorted(str(f) for f in (tmp_path / "t").glob("*.orc"))
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n, blooms, kinds = 0, 0, set()
    for f in files:
        reader = jvm.org.apache.orc.OrcFile.createReader(jvm.org.apache.hadoop.fs.Path(f"file://{f}"), jvm.org.apache.orc.OrcFile.readerOptions(conf))
        assert reader.getRowIndexStride() > 0
        n += reader.getNumberOfRows()
        inner = reader.rows()
        for stripe in reader.getStripes():
            footer = inner.readStripeFooter(stripe)
            blooms += sum(s.getKind().toString() == "BLOOM_FILTER_UTF8" and s.getColumn() == 1 for s in footer.getStreamsList())
            kinds |= {c.getKind().toString() for c in footer.getColumnsList()}
        inner.close()
    assert n == 60_000 and blooms >= len(files) and "DIRECT_V2" in kinds
    found = lookup_tokens(spark, f"file://{tmp_path}/t", [77, 31_000])
    assert "PushedFilters: [In(doc_id, [31000,77])]" in found._jdf.queryExecution().executedPlan().toString() or "In(doc_id, [77,31000])" in found._jdf.queryExecution().executedPlan().toString()
    assert sorted(r.doc_id for r in found.collect()) == [77, 31_000]
    scan = found._jdf.queryExecution().executedPlan().collectLeaves().head()
    assert scan.metrics().apply("numOutputRows").value() < 60_000 / 2


@settings(max_examples=300, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("aZsÉßİµÿ×0'$%,.#_`^-<|>\u0301\u0338 \n\u00a0"), max_size=12), max_size=6))
def test_letters_and_marks(tokenizer, texts):
    flat, place = word_encoder(PATH)(pa.array([*texts, "É<|endoftext|>$$ <|ENDOFTEXT|> a<|startoftext|>"], pa.string()))
    assert [flat[a:b].tolist() for a, b in zip(place, place[1:])][: len(texts)] == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert 49407 in flat[place[-2] :] and 49406 in flat[place[-2] :]


def test_words_are_encoded_once(monkeypatch):
    """Of a worker's texts each word of letters, with or without marks after it, goes through the model once; few go through the whole tokenizer."""
    encode, seen = WordEncoder(PATH), []
    for name in ("_of_letters", "_of_any"):
        monkeypatch.setattr(encode, name, lambda words, name=name, own=getattr(encode, name): (seen.extend((name, w) for w in words), own(words))[1])
    for text in ("Été word$$$ other,%%% word", "word été*** <b> WORD. Été other"):
        encode(pa.array([text]))
    assert sorted(seen) == sorted([("_of_any", "<b>"), *(("_of_letters", w) for w in ("été", "word", "other", "$$$", ",%%%", "***", "."))])


MEMORY = """
import resource, sys
import numpy as np, pyarrow as pa
from imgframe.llm import token_orc
rng = np.random.default_rng(1)
words = np.array(["".join(map(chr, row)) for row in rng.integers(97, 123, (400_000, 6))])
batch = pa.record_batch({"doc_id": pa.array(range(4000)), "text": pa.array([" ".join(rng.choice(words, 600)) for _ in range(4000)])})
encode = token_orc.word_encoder(sys.argv[1])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
assert sum(b.num_rows for b in token_orc.token_batches([batch] * 2, encode, 0, 1)) == 8000
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) / 1024)
"""


def test_memory_of_a_task():
    """What encoding takes beside its batch of 17 MB of text."""
    out = subprocess.run([sys.executable, "-c", MEMORY, PATH], env=os.environ | {"PYTHONPATH": str(REPO)}, capture_output=True, text=True, check=True)
    assert float(out.stdout) < 200
