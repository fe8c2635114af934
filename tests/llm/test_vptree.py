import numpy as np
import pytest
from imgframe.llm import vptree
from imgframe.llm.vptree import VPTree, _split, build_trees, deal, nearest, other_shards, usable
from pyspark.sql import functions as F


def table(spark, vectors):
    return spark.createDataFrame([(i, v, "clash") for i, v in vectors], "vec_id long, embedding array<float>, score string")


def brute(vectors, every, k):
    ok = [(i, np.array(v, np.float32).astype(float)) for i, v in vectors if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    out = set()
    for i, q in ok:
        if i % every == 0:
            near = sorted((-float(np.cumsum(q * v)[-1]), j) for j, v in ok if j != i)[:k]
            out |= {(i, r + 1, j, round(-s, 9)) for r, (s, j) in enumerate(near)}
    return out


def found(frame):
    return {(r.query_id, r["rank"], r.vec_id, round(r.score, 9)) for r in frame.collect()}


@pytest.mark.parametrize("shard_rows", [10_000, 400])
def test_exact_against_brute_force(spark, shard_rows):
    rng = np.random.default_rng(3)
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(1200, 12)) * rng.uniform(0.2, 3, size=(1200, 1)))]
    assert found(nearest(table(spark, vectors), 20, 20, 1.0, shard_rows)) == brute(vectors, 20, 20)


def test_relaxed_keeps_recall(spark):
    rng = np.random.default_rng(4)
    vectors = [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(rng.normal(size=(2000, 8)))]
    exact = {(q, v) for q, _, v, _ in brute(vectors, 20, 20)}
    relaxed = {(q, v) for q, _, v, _ in found(nearest(table(spark, vectors), 20, 20, 1.2))}
    assert len(exact & relaxed) >= 0.9 * len(exact)


def test_cases(spark):
    """Copies tie and go by vec_id; nulls, zeros and non-finite rows take no part; few rows give few neighbours."""
    vectors = [(0, [1.0, 0.0]), (20, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [None, 1.0]), (8, [float("inf"), 0.0]), (None, [1.0, 1.0]), (40, [-2.0, 0.5])]
    assert found(nearest(table(spark, vectors), 20, 20)) == brute(vectors, 20, 20)
    assert nearest(table(spark, []), 20, 20).count() == 0
    assert nearest(table(spark, [(0, [1.0])]), 20, 20).count() == 0


def test_many_copies(spark):
    vectors = [(i, [0.5, 0.5, 0.1]) for i in range(700)] + [(i, [0.1 * (i % 7), 0.2, 0.3]) for i in range(700, 900)]
    assert found(nearest(table(spark, vectors), 20, 20, 1.0, 300)) == brute(vectors, 20, 20)


def wide_table(spark, vectors):
    return spark.createDataFrame(vectors, "vec_id long, embedding array<double>")


def plain(vectors, every, k):
    """As ``brute``, of doubles: one vector for each id, candidates of the query's own length."""
    own = {}
    for i, v in vectors:
        if i is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            own[i] = max(own.get(i, v), v)
    out = []
    for i, q in own.items():
        if i % every == 0:
            near = sorted((-float(np.cumsum(np.array(q) * np.array(v))[-1]), j) for j, v in own.items() if j != i and len(v) == len(q))[:k]
            out += [(i, r + 1, j, -s) for r, (s, j) in enumerate(near)]
    return sorted(out)


def rows_of(frame):
    return sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in frame.collect())


@pytest.mark.parametrize("times", [1e3, 1e5, 1e8, 1e150, 1e-150])
def test_one_long_vector(spark, times):
    """A vector of another scale changes no other's neighbours: exactly those of brute force, scores to the last digit."""
    rng = np.random.default_rng(5)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(1500, 16)))]
    vectors[40] = (40, [x * times for x in vectors[40][1]])
    assert rows_of(nearest(wide_table(spark, vectors), 20, 20, 1.0, 400)) == plain(vectors, 20, 20)


def test_odd_rows(spark):
    """Repeated rows and ids, unequal lengths, an empty vector, components near the end of the range."""
    vectors = [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (40, [1.0]), (41, [2.0]), (42, [2.0]), (42, [3.0]), (60, []), (61, [1.5e308, 1e308]), (80, [1e-300, 0.0]), (81, [1.0, 2.0, 3.0]), (100, [0.0, -1.0]), (0, [-1.0, 0.25])]
    found = rows_of(nearest(wide_table(spark, vectors), 20, 5))
    assert found == plain(vectors, 20, 5)
    assert {q for q, *_ in found} == {0, 20, 40, 80, 100}


def test_repeated_table(spark):
    rng = np.random.default_rng(6)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(300, 4)))]
    assert rows_of(nearest(wide_table(spark, vectors * 3), 20, 20, 1.0, 50)) == plain(vectors, 20, 20)


def test_pruning_within_and_between_shards(spark):
    """Groups of near vectors: most rows are not compared within a tree, and most shards not visited."""
    rng = np.random.default_rng(7)
    centres = rng.normal(size=(24, 8))
    points = np.repeat(centres / np.linalg.norm(centres, axis=1)[:, None] * 3, 400, axis=0) + rng.normal(scale=0.02, size=(9600, 8))
    tree = VPTree(np.arange(len(points)), points)
    who, found, _ = tree.search(np.arange(0, 9600, 40), points[::40], 20, 1.0)
    assert len(who) == 240 * 20
    assert tree.compared < 0.4 * 240 * 9600
    rows = usable(wide_table(spark, [(i, v.tolist()) for i, v in enumerate(points[rng.permutation(9600)])])).cache()
    dealt = deal(rows, 500).cache()
    trees = build_trees(dealt).cache()
    queries = dealt.where("vec_id % 40 = 0").withColumn("floor", F.lit(8.0))
    assert dealt.count() == 9600 and trees.count() > 15
    assert other_shards(queries, trees, 1.0).count() < 0.5 * 240 * trees.count()


@pytest.mark.parametrize("bounds", [1, 7])
def test_more_shards_than_are_broadcast(spark, monkeypatch, bounds):
    """Queries stream past the bounds of a few shards at a time, each in several blocks: the same as brute force."""
    monkeypatch.setattr(vptree, "BROADCAST_SHARDS", bounds)
    rng = np.random.default_rng(8)
    vectors = [(i, v.tolist()) for i, v in enumerate(rng.normal(size=(700, 6)) * rng.choice([0.1, 1, 30], size=(700, 1)))] + [(1000 + i, [float(i), 1.0]) for i in range(50)]
    assert rows_of(nearest(wide_table(spark, vectors), 20, 10, 1.0, 60)) == plain(vectors, 20, 10)


def test_all_as_far_from_each_other(spark):
    """One-hot vectors, copies and a few others: the tree over the sample stays flat, and nothing is lost."""
    n = 1100
    hot = np.eye(n)
    for rows in (hot, np.ones((n, 4)), np.concatenate([np.ones((n, 4)), np.random.default_rng(1).normal(size=(40, 4))])):
        nodes = _split(rows, 50, np.random.default_rng(1))
        assert len(nodes) < 200
    small = [(i, np.eye(60)[i % 60].tolist()) for i in range(600)]
    assert rows_of(nearest(wide_table(spark, small), 20, 20, 1.0, 40)) == plain(small, 20, 20)
