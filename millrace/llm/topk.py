"""Exact top-k inner-product search with two cover trees.

Vectors become integers. The upper level of the tree is a net of centers from a bounded sample; every vector
goes to its nearest center, and a center's vectors are dealt to blocks of a bounded number of rows, so a
center that holds a third of all rows is many blocks. For each query the sample gives a first bound, the
k-th best score in it. A query is sent only to the blocks of those centers whose upper bound
(center score + query norm x covering radius) reaches that bound.

In a block both sides get a cover tree, halving the covering radius from level to level. The two trees are
walked together, best pair first: a pair of nodes is left out if its upper bound is below the worst k-th
score of the query node. Leaves are compared exactly. The k best of every query and block meet at the end.

Defined cases: vectors that are NULL or hold NULL, NaN or infinite components take no part; shorter vectors
count as filled up with zeros; ties go to the smaller id; rows with the id of the query are its own and
are left out; further rows with one id are candidates of their own; rows with a NULL id take no part; fewer
candidates than k give fewer rows; scores beyond a long are cut to its range.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


SAMPLE = 4_096
CENTERS = 64
BLOCKS = 160
LEAST_BLOCK, MOST_BLOCK = 64, 8_192
QUERY_ROWS = 4_096
LEAF = 48
FANOUT = 8
LONG = (1 << 63) - 1


def integers(vector: Column, factor: int = 1024) -> Column:
    """floor(factor * x) of every component as longs; NULL if the vector takes no part."""
    fine = F.forall(vector, lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    return F.when(fine, F.transform(vector, lambda x: F.floor(x.cast("double") * factor).cast("long")))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of longs, filled up with zeros."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    if not len(column) or not width:
        return np.zeros((len(column), width), np.int64)
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.flatten().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(-1, width)
    out = np.zeros((len(column), width), np.int64)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def _farthest(points: np.ndarray, count: int, enough: float = 0.0) -> tuple[list[int], np.ndarray, np.ndarray]:
    """Net of at most ``count`` points until all lie within ``enough``; nearest net point and distance of each."""
    chosen = [0]
    gap = np.sqrt(((points - points[0]) ** 2).sum(axis=1))
    near = np.zeros(len(points), np.int64)
    while len(chosen) < count and gap.max() > enough:
        pick = int(gap.argmax())
        fresh = np.sqrt(((points - points[pick]) ** 2).sum(axis=1))
        closer = fresh < gap
        near[closer] = len(chosen)
        gap = np.where(closer, fresh, gap)
        chosen.append(pick)
    return chosen, near, gap


class Node:
    """Node of a cover tree: rows, center, covering radius and children."""

    __slots__ = ("rows", "center", "radius", "norm", "children")

    def __init__(self, points: np.ndarray, rows: np.ndarray):
        own = points[rows]
        self.rows = rows
        self.center = own[0]
        self.radius = float(np.sqrt(((own - own[0]) ** 2).sum(axis=1)).max())
        self.norm = float(np.sqrt((own[0] ** 2).sum()))
        self.children: list[Node] = []
        if len(rows) > LEAF and self.radius > 0:
            _, near, _ = _farthest(own, FANOUT, self.radius / 2)
            self.children = [Node(points, rows[near == i]) for i in range(near.max() + 1)]


def _reach(a: Node, b: Node) -> float:
    """Upper bound of any inner product between the rows of two nodes, with room for rounding."""
    top = float(a.center @ b.center) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
    return top + 1e-9 * abs(top) + 1.0


def _products(queries: np.ndarray, data: np.ndarray) -> np.ndarray:
    """Exact integer inner products; floats where all sums stay exact in them, else whole numbers of any size."""
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * max(1, queries.shape[1])
    if most < 2 ** 53:
        return (queries.astype(float) @ data.T.astype(float)).astype(np.int64)
    exact = queries.astype(object) @ data.T.astype(object)
    return np.clip(exact, -LONG - 1, LONG).astype(np.int64)


class Search:
    """The k best of every query among the rows of one block."""

    def __init__(self, queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray,
                 data: np.ndarray, ids: np.ndarray, k: int):
        self.q, self.x, self.query_ids, self.ids, self.k = queries, data, query_ids, ids, k
        self.worst = floors.copy()  # k-th score so far
        self.best: list[list[tuple[int, int]]] = [[] for _ in range(len(queries))]
        if len(queries) and len(data):
            self._walk(Node(queries.astype(float), np.arange(len(queries))), Node(data.astype(float), np.arange(len(data))))

    def _walk(self, query_root: Node, data_root: Node) -> None:
        turn = 0
        heap = [(-_reach(query_root, data_root), turn, query_root, data_root)]
        while heap:
            bound, _, a, b = heapq.heappop(heap)
            if -bound < self.worst[a.rows].min():
                continue
            if not a.children and not b.children:
                self._compare(a.rows, b.rows)
                continue
            split_data = b.children and (not a.children or b.radius >= a.radius)
            for child in (b.children if split_data else a.children):
                pair = (a, child) if split_data else (child, b)
                reach = _reach(*pair)
                if reach >= self.worst[pair[0].rows].min():
                    turn += 1
                    heapq.heappush(heap, (-reach, turn, *pair))

    def _compare(self, rows: np.ndarray, others: np.ndarray) -> None:
        scores = _products(self.q[rows], self.x[others])
        good = (scores >= self.worst[rows][:, None]) & (self.query_ids[rows][:, None] != self.ids[others])
        for i in np.flatnonzero(good.any(axis=1)):
            row, hit = int(rows[i]), np.flatnonzero(good[i])
            found = self.best[row] + list(zip((-scores[i, hit]).tolist(), self.ids[others[hit]].tolist()))
            found.sort()
            self.best[row] = found[: self.k]
            if len(found) >= self.k:
                self.worst[row] = max(self.worst[row], float(-self.best[row][-1][0]))


def _kth(scores: np.ndarray, k: int) -> float:
    return float(np.partition(scores, len(scores) - k)[len(scores) - k]) if len(scores) >= k else -np.inf


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score of the k best rows of ``vectors`` for every row of ``queries``.

    Both have the columns vec_id (long) and values (array of longs). Equal query rows are asked once.
    """
    vectors = vectors.where("vec_id IS NOT NULL AND values IS NOT NULL").select("vec_id", "values")
    asked = queries.where("vec_id IS NOT NULL AND values IS NOT NULL").select("vec_id", "values").distinct()
    schema = "query_id long, rank int, vec_id long, score long"
    spark = vectors.sparkSession
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], schema)
    width = int(vectors.agg(F.max(F.size("values"))).first()[0])
    points, sample_ids = _matrix(sample.column("values"), width), sample.column("vec_id").to_numpy()
    chosen, _, _ = _farthest(points.astype(float), CENTERS)
    centers = points[chosen].astype(float)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = (centers ** 2).sum(axis=1)
        for batch in batches:
            own = _matrix(batch.column("values"), width).astype(float)
            nearest = np.argmin(lengths - 2 * own @ centers.T, axis=1) if len(own) else np.zeros(0, int)
            gap = np.sqrt(((own - centers[nearest]) ** 2).sum(axis=1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(nearest.astype(np.int32)), pa.array(gap)], names=["vec_id", "values", "node", "gap"])

    placed = vectors.mapInArrow(place, "vec_id long, values array<long>, node int, gap double")
    held = {r.node: (r.n, r.radius) for r in placed.groupBy("node").agg(F.count("*").alias("n"), F.max("gap").alias("radius")).collect()}
    total = sum(n for n, _ in held.values())
    rows = min(MOST_BLOCK, max(LEAST_BLOCK, -(-total // BLOCKS)))
    salts = {node: -(-n // rows) for node, (n, _) in held.items()}
    query_salts = max(1, -(-asked.count() // QUERY_ROWS))

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes = np.array(sorted(held))
        radii = np.array([held[n][1] for n in nodes.tolist()])
        copies = np.array([salts[n] for n in nodes.tolist()])
        for batch in batches:
            own, ids = _matrix(batch.column("values"), width), batch.column("vec_id").to_numpy()
            if not len(own):
                continue
            norms = np.sqrt((own.astype(float) ** 2).sum(axis=1))
            seen = _products(own, points)
            floors = np.array([_kth(seen[i][sample_ids != ids[i]], k) for i in range(len(own))])
            top = own.astype(float) @ centers[nodes].T + norms[:, None] * radii
            query, node = np.nonzero(top + 1e-9 * np.abs(top) + 1.0 >= floors[:, None])
            times = copies[node]
            query, node = np.repeat(query, times), np.repeat(node, times)
            salt = np.arange(len(query)) - np.repeat(np.cumsum(times) - times, times)
            taken = batch.take(pa.array(query))
            yield pa.RecordBatch.from_arrays(
                [taken.column("vec_id"), taken.column("values"), pa.array(floors[query]), pa.array(nodes[node].astype(np.int32)),
                 pa.array(salt.astype(np.int32))], names=["vec_id", "values", "floor", "node", "salt"])

    def search(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        ids, names = theirs.column("vec_id").to_numpy(), ours.column("vec_id").to_numpy()
        found = Search(_matrix(ours.column("values"), width), names, ours.column("floor").to_numpy().copy(),
                       _matrix(theirs.column("values"), width), ids, k)
        out = [(key, hit[1], -hit[0]) for key, hits in zip(ours.column("key").to_pylist(), found.best) for hit in hits]
        own = {key: name for key, name in zip(ours.column("key").to_pylist(), names.tolist())}
        return pa.table([pa.array([o[0] for o in out], pa.int64()), pa.array([own[o[0]] for o in out], pa.int64()),
                         pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], pa.int64())],
                        names=["key", "query_id", "vec_id", "score"])

    by_node = F.create_map(*[F.lit(x) for pair in salts.items() for x in pair])
    data = placed.withColumn("salt", F.pmod(F.xxhash64("vec_id"), by_node[F.col("node")]).cast("int")).select(
        "vec_id", "values", "node", "salt", F.explode(F.array(*[F.lit(i) for i in range(query_salts)])).alias("part"))
    sent = asked.mapInArrow(route, "vec_id long, values array<long>, floor double, node int, salt int").withColumn(
        "key", F.xxhash64("vec_id", "values")).withColumn("part", F.pmod(F.col("key"), F.lit(query_salts)).cast("int"))
    block = ["node", "salt", "part"]
    hits = sent.groupBy(*block).cogroup(data.groupBy(*block)).applyInArrow(
        search, "key long, query_id long, vec_id long, score long")
    order = Window.partitionBy("key").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
