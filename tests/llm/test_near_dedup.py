import random
from itertools import combinations

import pytest
from imgframe.llm import near_dedup as N
from imgframe.llm.near_dedup import components, near_duplicates


def plain(rows, k, percent):
    """Components from every pair's sets."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = {}
    for doc_id, text in rows:
        words = [w for w in (text or "").translate(lower).replace("\v", " ").replace("\f", " ").replace("\t", " ").replace("\n", " ").replace("\r", " ").split(" ") if w]
        sets[doc_id] = {tuple(words[i : i + k]) for i in range(len(words) - k + 1)} if len(words) >= k else {tuple(words)} if words else set()
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for a, b in combinations(sorted(sets), 2):
        shared = len(sets[a] & sets[b])
        if shared and 100 * shared >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return {(d, len(s), find(d), find(d) == d) for d, s in sets.items()}


def got(frame):
    return {tuple(r) for r in frame.select("doc_id", "n_shingles", "component_id", "kept").collect()}


def edited(rng, words, n):
    words = list(words)
    for _ in range(n):
        words[rng.randrange(len(words))] = rng.choice(["x", "y", f"w{rng.randrange(10**6)}"])
    return words


@pytest.mark.parametrize(("k", "percent"), [(3, 85), (5, 80)])
def test_chains_and_crowds(spark, k, percent):
    """Near copies whose centres do not link them, chains of copies of copies, exact copies and strangers."""
    rng = random.Random(k)
    base = [f"b{rng.randrange(500)}" for _ in range(120)]
    texts = [edited(rng, base, rng.randrange(9)) for _ in range(120)]
    chain = [f"c{rng.randrange(500)}" for _ in range(100)]
    for _ in range(30):
        chain = edited(rng, chain, 2)
        texts.append(chain)
    texts += [base] * 5 + [[f"s{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 60))] for _ in range(60)]
    rng.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    assert got(near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), k, percent)) == plain(rows, k, percent)


def test_cases(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one two"), (5, "ONE\vTwo"), (6, "one"), (7, "one two three four"), (8, "One two three"), (9, "very long " * 200_000), (10, "long very " * 200_000)]
    frame = spark.createDataFrame([(*r, 0, "clash") for r in rows], "doc_id long, text string, n int, bucket string")
    assert got(near_duplicates(frame, 3, 85)) == plain(rows, 3, 85)


def test_rows_that_repeat_or_lack_an_id(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (2, "a b c d"), (None, "a b c d"), (None, None)]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 85)
    assert sorted((r.doc_id or 0, r.component_id or 0, r.kept) for r in out.collect()) == [(0, 0, True), (0, 0, True), (1, 1, True), (1, 1, True), (2, 1, False)]
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_components_of_a_long_path(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 500), (700, 600)], "a long, b long")
    found = {r.node: r.component for r in components(links).collect()}
    assert found == {**dict.fromkeys(range(201), 0), 600: 600, 700: 600}


def test_different_texts_of_one_id(spark):
    """Each row is linked by its own text: copies of B, which stands under 5 as A does, get no link to A's."""
    a, b = "a1 a2 a3 a4 a5 a6", "b1 b2 b3 b4 b5 b6"
    rows = [(5, a), (5, b), (5, b), (7, a), (9, b), (3, "c1 c2 c3 c4"), (4, b + " b7"), (2, "b1 b2 b3 b4 b5 b6 b7")]
    out = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 3, 75).collect()
    assert sorted((r.doc_id, r.component_id) for r in out) == [(2, 2), (3, 3), (4, 2), (5, 2), (5, 2), (5, 5), (7, 5), (9, 2)]


def family(n, seed):
    """Documents of one template, each with two of its 110 words changed: nearly all pairs are just under 0.85."""
    rng = random.Random(seed)
    base = [f"t{i}" for i in range(110)]
    return [(i, " ".join(f"u{i}-{j}" if j in own else w for j, w in enumerate(base))) for i in range(n) for own in [rng.sample(range(110), 2)]]


def test_a_family_under_the_threshold(spark):
    """About as many pairs are written as there are documents, of all those just under the threshold, and no link is lost."""
    written = {}
    for n in (300, 600, 1200):
        rows = family(n, n)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
        sketch = N.sketches(docs, 3).cache()
        scratch = N.Scratch(spark)
        _, members, sets = N.candidates(sketch, docs, 3, scratch)
        found = components(N.confirmed(members.where("node <> centre").select(N.F.col("centre").alias("a"), N.F.col("node").alias("b")).distinct(), sets, 85)).cache()
        written[n] = N.remaining_links(members, found, sets, 85, scratch)[1].count()
        if n == 300:
            assert got(near_duplicates(docs, 3, 85)) == plain(rows, 3, 85)
    assert all(pairs < 2 * n for n, pairs in written.items()), written


@pytest.mark.parametrize(("n", "m"), [(30, 30), (900, 1000), (3, 4000), (40, 90)])
def test_bits_bound_the_difference(spark, n, m):
    """Rows of bits never differ in more bits than the sets in shingles, of whatever lengths."""
    rng = N.np.random.default_rng(n)
    pool = rng.integers(0, 2**63, n + m).astype(N.np.uint64)
    a, b = N.np.unique(pool[:n]), N.np.unique(pool[n // 2 : n // 2 + m])
    row = spark.createDataFrame([(N.flips_of(a).tolist(), N.flips_of(b).tolist())], "a array<long>, b array<long>")
    differ = row.select(N.differing_bits(N.F.col("a"), N.F.col("b"))).first()[0]
    assert 0 < differ <= len(set(a.tolist()) ^ set(b.tolist()))
    assert row.select(N.differing_bits(N.F.col("a"), N.F.col("a"))).first()[0] == 0


def test_what_is_written_on_the_way_goes(spark):
    from pathlib import Path

    folder = Path(spark.conf.get("spark.checkpoint.dir").removeprefix("file://"))
    before = set(folder.iterdir()) if folder.exists() else set()
    out = near_duplicates(spark.createDataFrame([(i, f"a b c d e f g {i % 7} h i j k l m n o p") for i in range(50)], "doc_id long, text string"), 3, 60)
    assert out.count() == 50
    left = {p.name.rsplit("-", 1)[0] for p in set(folder.iterdir()) - before}
    assert left <= {"near-sketches", "near-final", "component-edges"}
