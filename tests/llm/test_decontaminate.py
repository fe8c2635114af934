import re

from imgframe.llm.decontaminate import decontaminate


def words(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)


def brute(docs, items, window=10):
    """Every window tried at every place."""
    out = []
    for doc_id, text in docs:
        w, hit, ids = words(text), set(), set()
        for item_id, item in items:
            v = words(item)
            size = min(window, len(v))
            for s in range(max(1, len(v) - window + 1) if v else 0):
                for p in range(len(w) - size + 1):
                    if w[p : p + size] == v[s : s + size]:
                        hit |= set(range(p, p + size))
                        ids |= {str(item_id)} if item_id is not None else set()
        out.append((str(doc_id), len(w), len(hit), tuple(sorted(ids))))
    return sorted(out)


def got(frame):
    return sorted((str(r.doc_id), r.n_words, r.n_hit, tuple(r.item_ids)) for r in frame.collect())


ITEM = "The quick brown fox, jumps over the lazy dog; then it sleeps all day."
ITEMS = [(1, ITEM), (2, ITEM), (10, "the the the the the the the the the the the the"), (3, None), (4, ""), (5, "Short one"), (6, "é"), (None, "lost words of no item at all but ten of them"), (7, "a b c d e f g h i j a b c d e f g h i j k")]
DOCS = [
    (1, "x " + ITEM.upper() + " y"),
    (2, "the quick brown fox jumps over the lazy dog"),
    (3, "the " * 25),
    (4, None),
    (5, ""),
    (6, "a short-ONE here; Short, one again: É é"),
    (7, "a b c d e f g h i j a b c d e f g h i j a b c d e f g h i j k"),
    (8, "We lost words of no item at all but ten of them."),
    (8, "short one"),
    (None, "short one"),
    (9, ("nothing here " * 50_000) + ITEM),
    (11, "then it sleeps all day the quick brown fox jumps over the lazy dog then"),
]


def test_cases(spark):
    docs = spark.createDataFrame([(*d, 0, "clash") for d in DOCS], "doc_id long, text string, pos int, token string")
    items = spark.createDataFrame([(*i, 0) for i in ITEMS], "item_id long, text string, k int")
    assert got(decontaminate(docs, items)) == brute(DOCS, ITEMS)


def test_empty_tables(spark):
    docs, items = spark.createDataFrame(DOCS[:3], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert {r.n_hit for r in decontaminate(docs, items.limit(0)).collect()} == {0}
    assert decontaminate(docs.limit(0), items).count() == 0


def test_no_python_in_the_plan(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    plan = decontaminate(docs, items)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
