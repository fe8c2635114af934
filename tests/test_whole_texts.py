"""Values of whole texts, past any prefix, against plain Python."""

from imgframe.plans import QUERIES

TEXTS = ("", "one", "é ü\nab", "short  two\\three ", " ".join(f"wörd{i}" for i in range(20_000)))


def test_values_of_whole_texts(spark, tmp_path):
    spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    joined = {i: text.replace("\n", " ").replace(" ", "\\") for i, text in enumerate(TEXTS)}
    texts = {r.doc_id: (r.joined, r.n) for r in QUERIES["value_to_str_whole"](spark, str(tmp_path)).collect()}
    assert texts == {i: (j, j.count("\\") + 1) for i, j in joined.items()}
    lengths = {r.doc_id: (r.vm, r.n_bytes) for r in QUERIES["value_bytelen_whole"](spark, str(tmp_path)).collect()}
    assert lengths == {i: (len(text.replace("\n", " ").split(" ")), (len(joined[i].encode()) + 1) // 2 * 2) for i, text in enumerate(TEXTS)}
