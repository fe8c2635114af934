import random
from collections import defaultdict

from hypothesis import given, settings
from hypothesis import strategies as st
import numpy as np
from imgframe.llm.line_dedup import CuckooFilter, LineIndex, dedup_lines

LINE = "This line is said by many documents, word for word."


def brute(rows, min_chars=40, min_docs=5):
    """Text by document after dropping, from the definition."""
    key = lambda line: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in line.strip(" \t\n\v\f\r"))
    held = defaultdict(set)
    for doc_id, text in rows:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars and doc_id is not None:
                held[key(line)].add(doc_id)
    lost = lambda d, line: d is not None and len(held[key(line)]) >= min_docs and d != max(held[key(line)])
    return sorted((-1 if d is None else d, "\n".join(x for x in (t or "").split("\n") if not lost(d, x))) for d, t in rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n_lines int, `key` string")


def kept(df):
    return sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in df.collect())


ROWS = [(i, f"own line {i}\n  {LINE.upper() if i % 2 else LINE}\t\n\n{LINE}") for i in range(6)] + [(6, None), (7, ""), (None, LINE), (8, "short\n" * 9), (9, LINE[:39]), (0, "own line 0\n" + LINE), (10, ("é" * 45 + "\n") * 3)]


def test_cases(spark):
    out = dedup_lines(frame(spark, ROWS))
    assert out.columns == ["doc_id", "text", "key", "n_lines", "n_dropped"]
    assert kept(out) == brute(ROWS)
    assert {r.n_lines for r in out.where("doc_id IN (6, 7)").collect()} == {1}
    assert dedup_lines(frame(spark, [])).count() == 0


def test_deletion_undoes_insertion(spark):
    """After documents go, a line that is no longer common is kept again; after they return, it is dropped again."""
    docs = frame(spark, ROWS)
    index = LineIndex.build(docs, shards=4)
    assert kept(index.apply(docs)) == brute(ROWS)
    less = index.delete(spark.createDataFrame([(4,), (5,)], "doc_id long"))
    rest = [r for r in ROWS if r[0] not in (4, 5)]
    assert kept(less.apply(frame(spark, rest))) == brute(rest) == sorted((-1 if d is None else d, t or "") for d, t in rest)
    again = less.insert(frame(spark, [r for r in ROWS if r[0] in (4, 5)]))
    assert kept(again.apply(docs)) == brute(ROWS)


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(0, 2**64 - 1), unique=True, max_size=300), st.integers(1, 64))
def test_cuckoo_filter(values, capacity):
    """Nothing that was added is missed, however full; what is removed is gone but for shared fingerprints."""
    filt = CuckooFilter(capacity)
    if capacity % 2:
        filt.add_all(np.array(values, np.uint64))
    else:
        for v in values:
            filt.add(v)
    filt = CuckooFilter.load(filt.dump())
    assert filt.contains(np.array(values, np.uint64)).all()
    gone, stay = values[::2], values[1::2]
    assert all(filt.remove(v) for v in gone)
    assert filt.contains(np.array(stay, np.uint64)).all()
    assert (filt.table > 0).sum() + filt.overflow.total() == len(stay)


def test_ten_changes_from_a_small_build(spark):
    """Insertions and deletions in a row, more keys than the first filters had room for, against the definition."""
    rng = random.Random(11)
    line = lambda n: f"This is the shared line of number {n:05d}, said word for word."
    text = lambda: "\n".join(line(rng.randrange(400)) for _ in range(30))
    rows = {i: text() for i in range(12)}
    index = LineIndex.build(spark.createDataFrame(list(rows.items()), "doc_id long, text string"), shards=3)
    for turn in range(10):
        if turn % 3 == 2:
            gone = rng.sample(sorted(rows), len(rows) // 3)
            index = index.delete(spark.createDataFrame([(i,) for i in [*gone, 9999]], "doc_id long"))
            rows = {i: t for i, t in rows.items() if i not in gone}
        else:
            new = {rng.randrange(1000): text() for _ in range(8 + 4 * turn)}
            index = index.insert(spark.createDataFrame(list(new.items()), "doc_id long, text string"))
            rows = new | rows  # a document that is there stays as it is
        if turn in (1, 2, 5, 9):
            docs = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
            assert kept(index.apply(docs)) == brute(list(rows.items()))
            assert index.held_filters().where("n > capacity").count() == 0
    again = index.compact()
    assert len(again.refs) == 1 and kept(again.apply(docs)) == brute(list(rows.items()))


def test_an_increment_writes_what_it_touches(spark):
    """One document more of a hundred: its references, its keys' counts, filters of the shards where a key became common."""
    docs = [(i, "\n".join(f"Line {j} of the documents that leave {i % 20} as a remainder." for j in range(20))) for i in range(100)]
    index = LineIndex.build(spark.createDataFrame(docs, "doc_id long, text string"), min_docs=6, shards=32)
    more = index.insert(spark.createDataFrame([(100, docs[3][1] + "\n" + docs[4][1][:90])], "doc_id long, text string"))
    rows = lambda layers: [df.count() for _, df in layers]
    assert rows(index.counts) == [0] and rows(index.refs) == [2000]
    touched = rows(more.refs)[-1]
    assert 20 <= touched <= 22 and rows(more.counts)[-1] == touched
    shards = more.refs[-1][1].select("shard").distinct().count()
    assert rows(more.filters)[-1] == shards < 32
    assert len(more.refs[-1][1].inputFiles()) <= touched
    back = more.delete(spark.createDataFrame([(100,)], "doc_id long"))
    assert rows(back.gone)[-1] == touched and back.common().count() == 0 and back.held_filters().agg({"n": "sum"}).first()[0] == 0


def test_clashing_column(spark):
    rows = [(i, LINE, "own") for i in range(6)]
    out = dedup_lines(spark.createDataFrame(rows, "doc_id long, text string, _drop_keys string")).collect()
    assert {(r.doc_id, r.text, r._drop_keys) for r in out} == {(i, LINE if i == 5 else "", "own") for i in range(6)}
