"""Nearest neighbours by largest inner product: vantage-point trees per shard.

Inner products become distances by one more component: with M a shard's largest norm, (x, sqrt(M^2 - |x|^2)) and
(q, 0) are at the squared distance |q|^2 + M^2 - 2 q.x, so nearest in distance is largest in inner product. What is
further than the k-th best so far by the triangle inequality is skipped: a subtree, or a whole shard. Factor one
searches exactly; a larger factor skips more.

Shards: vectors of one length and of norms within a power of two go together, so that a long vector sets no scale but
its own, and are dealt by vantage points of a bounded sample to leaves of near ones; a leaf with many rows, as copies
of one vector, is split by id. A query is searched in its own shard first; what it finds there tells which of the
other shards, each known by a centre, a radius and its largest norm, may hold better ones, and only to these it goes.

Distances only decide what is skipped, with a margin for their rounding; what is kept is compared by inner products,
added up component by component in double precision. Vectors are scaled by powers of two, which changes no digit, so
that no square overflows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize

LEAF = 256
#: Vectors of a shard, at most; with 64 components a tree has some 10 MB.
SHARD_ROWS = 16_384
#: Vectors that choose the vantage points of shards, at most; every vector is put in a shard.
SAMPLE_ROWS = 8_192
#: Shards whose centres are broadcast, at most (one vector each); of more, so many at a time meet the queries in blocks.
BROADCAST_SHARDS = 50_000

ROUNDING = 16 * np.finfo(float).eps


def scaled(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows divided by powers of two so that the largest component of each is in [0.5, 1), and the exponents."""
    exponents = np.frexp(np.abs(vectors).max(axis=1))[1]
    return np.ldexp(vectors, -exponents[:, None]), exponents


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The inner product of each row of one with that of the other, added up component by component as others do."""
    return np.cumsum(a * b, axis=1)[:, -1]


class VPTree:
    """A vantage-point tree; leaves hold up to ``LEAF`` rows.

    nodes: (vantage point, first row, end row, least and largest distance on the inner and the outer side, left,
    right) with rows in tree order. Lengths are in units of 2 ** exponent.
    """

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.exponent = int(np.frexp(np.abs(vectors).max())[1])
        unit = np.ldexp(vectors, -self.exponent)
        norms = np.einsum("ij,ij->i", unit, unit)
        self.largest = float(np.sqrt(norms.max()) * (1 + ROUNDING * unit.shape[1]))
        points = np.concatenate([unit, np.sqrt(np.maximum(self.largest**2 - norms, 0))[:, None]], axis=1)
        order, self.nodes, self.compared = np.arange(len(ids)), [], 0
        self.centre = points.mean(axis=0)
        self.radius = float(np.sqrt(((points - self.centre) ** 2).sum(axis=1).max()))
        self._grow(points, order, 0, len(ids), np.random.default_rng(len(ids)))
        self.ids, self.vectors = ids[order], unit[order]

    def _grow(self, points: np.ndarray, order: np.ndarray, a: int, b: int, random) -> int:
        place = len(self.nodes)
        self.nodes.append(None)
        if b - a <= LEAF:
            self.nodes[place] = (None, a, b, 0.0, 0.0, 0.0, 0.0, -1, -1)
            return place
        vantage = points[order[random.integers(a, b)]].copy()
        far = np.sqrt(((points[order[a:b]] - vantage) ** 2).sum(axis=1))
        by = np.argsort(far, kind="stable")
        order[a:b], far = order[a:b][by], far[by]
        m = (b - a) // 2
        left = self._grow(points, order, a, a + m, random)
        right = self._grow(points, order, a + m, b, random)
        self.nodes[place] = (vantage, a, b, far[0], far[m - 1], far[m], far[-1], left, right)
        return place

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float, floor: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query position, vec_id, score) of the up to ``k`` nearest of each query with a score of its ``floor`` at least.

        Rows with the query's own id are left out. ``compared`` counts the rows that a query's product was worked out for.
        """
        n = len(queries)
        own, exponents = scaled(queries)
        lift = exponents + self.exponent  # products in units of 2 ** lift
        norms = np.einsum("ij,ij->i", own, own)
        lengths = np.sqrt(norms)
        margin = ROUNDING * (own.shape[1] + 2) * (lengths + self.largest)
        slack = margin * (lengths + self.largest)
        q = np.concatenate([own, np.zeros((n, 1))], axis=1)
        worst = np.full(n, -np.inf) if floor is None else np.ldexp(np.minimum(floor, np.finfo(float).max), -lift)
        best = np.full((n, k), -np.inf)
        rows = np.full((n, k), -1)
        last_id = np.iinfo(np.int64).max

        def leaf(a: int, b: int, who: np.ndarray) -> None:
            self.compared += len(who) * (b - a)
            near = own[who] @ self.vectors[a:b].T >= (worst[who] - slack[who])[:, None]
            near &= self.ids[a:b] != query_ids[who, None]
            at, row = np.nonzero(near)
            score = products(own[who[at]], self.vectors[a + row])
            real = score >= worst[who[at]]
            at, row, score = at[real], row[real] + a, score[real]
            hit = np.unique(at)
            if not len(hit):
                return
            held = who[hit]
            at = np.concatenate([np.searchsorted(hit, at), np.repeat(np.arange(len(hit)), k)])
            row, score = np.concatenate([row, rows[held].ravel()]), np.concatenate([score, best[held].ravel()])
            ids = np.where(row >= 0, self.ids[row], last_id)
            by = np.lexsort((ids, -score, at))
            starts = np.searchsorted(at[by], np.arange(len(hit)))
            first = by[starts[:, None] + np.arange(k)]
            rows[held], best[held] = row[first], score[first]
            worst[held] = np.maximum(worst[held], best[held, -1])

        def visit(place: int, who: np.ndarray) -> None:
            vantage, a, b, near, inner, outer, far, left, right = self.nodes[place]
            if vantage is None:
                leaf(a, b, who)
                return
            d = np.sqrt(((q[who] - vantage) ** 2).sum(axis=1))
            inward = d <= (inner + outer) / 2
            for turn in (True, False):  # each query takes the side it is on first
                for side, low, high, to in ((True, near, inner, left), (False, outer, far, right)):
                    chosen = inward == (turn == side)
                    mine = who[chosen]
                    gap = np.maximum(np.maximum(low - d[chosen], d[chosen] - high) - margin[mine], 0)
                    mine = mine[(gap * factor) ** 2 <= norms[mine] + self.largest**2 - 2 * worst[mine] + slack[mine]]
                    if len(mine):
                        visit(to, mine)

        visit(0, np.arange(n))
        who, slot = np.nonzero(rows >= 0)
        return who, self.ids[rows[who, slot]], np.ldexp(best[who, slot], lift[who])


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """(vec_id, vector array<double>, length) of what takes part: one row for each vec_id.

    Rows without vec_id take no part, nor vectors that are null, zero, or hold null or non-finite components. Of
    several different vectors of one vec_id the largest in array order stands.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("vector"))
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("vector", lambda x: x != 0))
    return rows.groupBy("vec_id").agg(F.max("vector").alias("vector")).select("vec_id", "vector", F.size("vector").alias("length"))


def sizes_of(vectors: np.ndarray) -> np.ndarray:
    """The exponents of the norms of rows."""
    unit, exponents = scaled(vectors)
    return np.frexp(np.sqrt(np.einsum("ij,ij->i", unit, unit)))[1] + exponents


def matrix_of(column: pa.Array, length: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, length)


def runs(*columns: np.ndarray) -> Iterator[tuple[int, int]]:
    """(start, end) of the runs of rows that agree in all columns."""
    change = np.zeros(max(0, len(columns[0]) - 1), bool)
    for c in columns:
        change |= c[1:] != c[:-1]
    cuts = [0, *(np.flatnonzero(change) + 1).tolist(), len(columns[0])]
    return ((a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a)


def _split(vectors: np.ndarray, leaf_rows: float, random) -> list[tuple]:
    """A tree of vantage points and distances over a sample: nodes (vantage, distance, left, right), or (leaf,).

    A side that would hold under a sixteenth of the rows, as where all are about as far from each other, is not split
    off: such rows stay one leaf, which is split by id. So the tree's depth is of the order of log n for any rows.
    """
    nodes: list[tuple] = [(0,)]
    stack = [(0, np.arange(len(vectors)))]
    while stack:
        place, held = stack.pop()
        if len(held) <= max(leaf_rows, 1):
            continue
        vantage = vectors[held[random.integers(len(held))]]
        far = np.sqrt(((vectors[held] - vantage) ** 2).sum(axis=1))
        middle = np.partition(far, len(far) // 2)[len(far) // 2]
        near = far < middle
        if 16 * near.sum() < len(held):
            beyond = far[far > middle]
            middle = beyond.min() if 16 * len(beyond) >= len(held) else None
            near = far < middle if middle is not None else near
        if middle is None:
            continue
        left, right = len(nodes), len(nodes) + 1
        nodes += [(left,), (right,)]
        nodes[place] = (vantage, middle, left, right)
        stack += [(left, held[near]), (right, held[~near])]
    return nodes


def deal(rows: DataFrame, shard_rows: int = SHARD_ROWS, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """``rows`` of ``usable`` with size (the exponent of the norm), leaf and part: (length, size, leaf, part) is the shard, of about ``shard_rows`` at most.

    At most ``sample_rows`` vectors, those with the least hashes of their ids, choose the vantage points.
    """
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample_rows).select("vector", "length").collect()
    share = shard_rows * len(sample) / max(1, rows.count())
    groups: dict[tuple[int, int], list] = {}
    for r in sample:
        vector = np.array(r["vector"])
        groups.setdefault((r["length"], int(sizes_of(vector[None])[0])), []).append(vector)
    trees: dict[tuple[int, int], list] = {}
    for key, held in groups.items():
        trees[key] = _split(scaled(np.array(held))[0], share, np.random.default_rng(key[0]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column("length").to_numpy()
            sizes, leaves = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int32)
            for length in np.unique(lengths).tolist():
                of_length = np.flatnonzero(lengths == length)
                matrix = matrix_of(batch.column("vector").take(pa.array(of_length)), length)
                sizes[of_length] = sizes_of(matrix)
                unit = scaled(matrix)[0]
                for size in np.unique(sizes[of_length]).tolist():
                    chosen = sizes[of_length] == size
                    nodes, at, vectors = trees.get((length, size), [(0,)]), of_length[chosen], unit[chosen]
                    stack = [(0, np.arange(len(at)))]
                    while stack:
                        place, who = stack.pop()
                        if len(nodes[place]) == 1:
                            leaves[at[who]] = place
                            continue
                        vantage, middle, left, right = nodes[place]
                        near = np.sqrt(((vectors[who] - vantage) ** 2).sum(axis=1)) < middle
                        stack += [(left, who[near]), (right, who[~near])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sizes), pa.array(leaves)], [*batch.schema.names, "size", "leaf"])

    dealt = materialize(rows.mapInArrow(run, "vec_id long, vector array<double>, length int, size int, leaf int"), "vptree-dealt")
    shard = ["length", "size", "leaf"]
    parts = dealt.groupBy(*shard).agg(F.ceil(F.count("*") / shard_rows).cast("int").alias("parts"))
    return dealt.join(parts, shard).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")


SHARD = ["length", "size", "leaf", "part"]


def build_trees(dealt: DataFrame) -> DataFrame:
    """(length, size, leaf, part, tree, exponent, largest, centre, radius): every row is in the tree of its shard."""

    def run(key, rows):
        import pandas as pd

        order = np.argsort(rows["vec_id"].to_numpy(), kind="stable")
        tree = VPTree(rows["vec_id"].to_numpy()[order], np.stack(rows["vector"].to_numpy())[order])
        return pd.DataFrame({**{c: [x] for c, x in zip(SHARD, key, strict=True)}, "tree": [pickle.dumps(tree, protocol=5)], "exponent": [tree.exponent], "largest": [tree.largest], "centre": [tree.centre], "radius": [tree.radius]})

    return dealt.groupBy(*SHARD).applyInPandas(run, "length int, size int, leaf int, part int, tree binary, exponent int, largest double, centre array<double>, radius double")


def search_trees(trees: DataFrame, queries: DataFrame, k: int, factor: float, blocks: int) -> DataFrame:
    """(vec_id of the query as query_id, vec_id, score): up to ``k`` of each shard for each row of ``queries`` (its shard, vec_id, vector, floor).

    Queries are dealt to shards in blocks and stream past the shard's tree, which comes first in the sort; a task
    holds one tree and one batch of queries.
    """
    block = F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")
    left = queries.select(*SHARD, block.alias("block"), F.lit(None).cast("binary").alias("tree"), "vec_id", "vector", "floor")
    right = trees.select(*SHARD, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "tree", F.lit(None).cast("long").alias("vec_id"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("double").alias("floor"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, tree = None, None
        for batch in batches:
            held = batch.column("tree").is_valid().to_numpy(zero_copy_only=False)
            keys = [batch.column(c).to_numpy() for c in SHARD]
            for a, b in runs(held.astype(int) * np.arange(1, batch.num_rows + 1), *keys):
                here = tuple(int(x[a]) for x in keys)
                if held[a]:
                    shard, tree = here, pickle.loads(batch.column("tree")[a].as_py())
                elif shard == here:
                    ids = batch.column("vec_id").slice(a, b - a).to_numpy()
                    vectors = matrix_of(batch.column("vector").slice(a, b - a), here[0])
                    who, found, scores = tree.search(ids, vectors, k, factor, batch.column("floor").slice(a, b - a).to_numpy())
                    yield pa.RecordBatch.from_arrays([pa.array(ids[who]), pa.array(found), pa.array(scores)], ["query_id", "vec_id", "score"])

    rows = left.unionByName(right).repartition(*SHARD, "block").sortWithinPartitions(*SHARD, "block", F.col("tree").isNull())
    return rows.mapInArrow(run, "query_id long, vec_id long, score double")


def other_shards(queries: DataFrame, trees: DataFrame, factor: float) -> DataFrame:
    """``queries`` (own shard, vec_id, vector, floor) once for each other shard of their length that may hold a score of ``floor`` or more.

    The bounds of shards are broadcast if they are few. Else they are dealt to chunks, and queries to blocks, and each
    block of queries streams past each chunk of bounds, which come first in the sort: no key is shared by more.
    """
    n = trees.count()
    bounds, asked = trees.select(*SHARD, *BOUNDS), queries.select(*SHARD, "vec_id", "vector", "floor")
    if n <= BROADCAST_SHARDS:
        known = _known(bounds.collect())
        held = queries.sparkSession.sparkContext.broadcast(known)

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield from _to_shards(batch, held.value, factor)

        return asked.mapInArrow(near, ASKED)
    chunks, blocks = -(-n // max(BROADCAST_SHARDS, 1)), 2 * queries.sparkSession.sparkContext.defaultParallelism
    every = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    left = asked.withColumns({"chunk": every(chunks), "block": F.pmod(F.xxhash64("vec_id"), F.lit(blocks)).cast("int")}).withColumns({c: F.lit(None).cast(kind) for c, kind in BOUNDS.items()})
    right = bounds.withColumns({"chunk": F.pmod(F.xxhash64(*SHARD), F.lit(chunks)).cast("int"), "block": every(blocks), "vec_id": F.lit(None).cast("long"), "vector": F.lit(None).cast("array<double>"), "floor": F.lit(None).cast("double")})
    rows = left.unionByName(right).repartition("chunk", "block").sortWithinPartitions("chunk", "block", F.col("centre").isNull())

    def past(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        known, here = {}, None
        for batch in batches:
            bound = batch.column("centre").is_valid().to_numpy(zero_copy_only=False)
            for a, b in runs(bound, batch.column("chunk").to_numpy(), batch.column("block").to_numpy()):
                part, key = batch.slice(a, b - a), (batch.column("chunk")[a].as_py(), batch.column("block")[a].as_py())
                if key != here:
                    held, known, here = [], {}, key
                if bound[a]:
                    held += part.select([*SHARD, *BOUNDS]).to_pylist()
                else:
                    if held:
                        known, held = _known(held), []
                    yield from _to_shards(part.select([*SHARD, "vec_id", "vector", "floor"]), known, factor)

    return rows.mapInArrow(past, ASKED)


ASKED = "length int, size int, leaf int, part int, vec_id long, vector array<double>, floor double"
#: What is known of a shard: its tree's exponent and largest norm, and a centre and radius of all its points.
BOUNDS = {"exponent": "int", "largest": "double", "centre": "array<double>", "radius": "double"}


def _known(rows: list) -> dict[int, tuple]:
    """By length: the shards' keys, and their bounds as arrays."""
    by_length: dict[int, list] = {}
    for r in rows:
        by_length.setdefault(r["length"], []).append(r)
    return {n: (np.array([[r[c] for c in SHARD] for r in of]), *(np.array([r[c] for r in of]) for c in BOUNDS)) for n, of in by_length.items()}


def _to_shards(batch: pa.RecordBatch, known: dict[int, tuple], factor: float) -> Iterator[pa.RecordBatch]:
    """Of a batch of queries, for each known shard those that it may hold a better one for."""
    mine = np.stack([batch.column(c).to_numpy() for c in SHARD], axis=1)
    floors = batch.column("floor").to_numpy()
    for length in np.unique(mine[:, 0]).tolist():
        if length not in known:
            continue
        shards, exponent, largest, centre, radius = known[length]
        at = np.flatnonzero(mine[:, 0] == length)
        own, exponents = scaled(matrix_of(batch.column("vector").take(pa.array(at)), length))
        norms = np.einsum("ij,ij->i", own, own)
        for s in range(len(shards)):
            margin = ROUNDING * (length + 2) * (np.sqrt(norms) + largest[s])
            away = np.sqrt(((own - centre[s, :-1]) ** 2).sum(axis=1) + centre[s, -1] ** 2)
            gap = np.maximum(np.maximum(away - radius[s] * (1 + ROUNDING * length), np.abs(np.sqrt(norms) - largest[s])) - 2 * margin, 0)
            floor = np.ldexp(floors[at], -(exponents + exponent[s]))
            open_ = ((gap * factor) ** 2 <= norms + largest[s] ** 2 - 2 * floor + margin * (np.sqrt(norms) + largest[s])) & (mine[at] != shards[s]).any(axis=1)
            out = batch.select(["vec_id", "vector", "floor"]).take(pa.array(at[open_]))
            if out.num_rows:
                yield pa.RecordBatch.from_arrays([*(pa.array(np.full(out.num_rows, x, np.int32)) for x in shards[s]), *out.columns], [*SHARD, "vec_id", "vector", "floor"])


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, factor: float = 1.0, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest by inner product for each vec_id divisible by ``every``, among all others.

    Defined cases: vectors that are null, empty, zero, or hold null or non-finite components are neither query nor
    candidate, nor are rows without vec_id; a vec_id counts once, and of its different vectors the largest in array
    order stands; vectors of different lengths have no inner product, so a query's candidates are those of its own
    length; fewer than ``k`` of these give as many as there are; ties go to the smaller vec_id; a product beyond
    the double range is infinite; other columns are ignored; no rows in, no rows out.
    """
    rows = materialize(usable(vectors), "vptree-vectors")
    dealt = materialize(deal(rows, shard_rows), "vptree-shards")
    trees = materialize(build_trees(dealt), "vptree-trees")
    queries = dealt.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-2 * vectors.sparkSession.sparkContext.defaultParallelism // max(1, trees.count())))
    home = materialize(search_trees(trees, queries.withColumn("floor", F.lit(float("-inf"))), k, factor, blocks), "vptree-home")
    floors = home.groupBy("query_id").agg(F.count("*").alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select(F.col("query_id").alias("vec_id"), "least")
    queries = queries.join(floors, "vec_id", "left").withColumn("floor", F.coalesce("least", F.lit(float("-inf"))))
    away = search_trees(trees, other_shards(queries, trees, factor), k, factor, blocks)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return home.unionByName(away).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
