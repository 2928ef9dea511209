"""Exact top-k inner products by dual-tree search over cover trees.

Candidates are dealt into shards by a hash of the id, each candidate once. A task reads its shard's candidates, builds one cover tree
over them, and then streams all queries past it in blocks of BLOCK_ROWS, each with a cover tree of its own: rows reach the task
sorted, candidates first, so it holds one shard and one block. Pairs of nodes are walked best bound first: <a, b> <= <cq, cr> + |cq| rr +
|cr| rq + rq rr, where c are centres and r covering radii. A pair is pruned only when its bound is below the worst kth
score of the query node, so ties survive. `walked` tells how many pairs were visited and pruned: few are pruned where vectors have no clusters (as directions drawn at random in 64 dimensions).
There, going down to the leaves only costs time: while bounds prune less than one pair in PRUNES, a pair of nodes with at most BASE scores is scored as one. At leaves, and there, scores are integer products. The k best of each shard are merged per query by a
window over k rows a shard.

Equal vectors are one point of the tree that holds its k + 1 smallest ids: no other of them can be in a
result (one may be the query's own). So a vector that a third of all rows share costs one point.

Doubles hold scores exactly below 2^53. Where a block's and a shard's vectors could exceed that, scores are doubles with an error bound
first, and those that may be among the k best are computed again in whole numbers of any size.

Cases: vectors that are null, of another length than the most common, or with null or non-finite components take no part, as query or
candidate, and so do components that overflow a double once multiplied by 256; scores beyond a long's range count as its limits;
ties go to the smaller vec_id; repeated rows of one id count once; fewer candidates than k
give fewer rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Candidates of a shard at most and, while there are fewer than two shards a core, at least.
SHARD_ROWS, LEAST_SHARD_ROWS = 100_000, 5_000
BLOCK_ROWS = 2_048
#: Points of a leaf, and children of a node.
LEAF, FANOUT = 64, 16
#: Scores of a leaf pair that are held at once.
TILE = 1 << 22
#: A walk that has visited TRIED pairs and pruned less than one in PRUNES of them scores pairs of nodes of at most BASE scores as they are.
TRIED, PRUNES, BASE = 64, 8, 1 << 16
LONG_MIN, LONG_MAX = -(2**63), 2**63 - 1


class Node:
    __slots__ = ("center", "norm", "radius", "rows", "children")

    def __init__(self, center, radius, rows, children):
        self.center, self.norm, self.radius, self.rows, self.children = center, float(np.sqrt(center @ center)), radius, rows, children


def cover_tree(x: np.ndarray, leaf: int = LEAF, base: float = 2.0, fanout: int = FANOUT) -> Node | None:
    """A cover tree over the rows of x, with measured radii and leaves of at most `leaf` points (more only where they are equal).

    A node's children are a net of its points, taken farthest first: until every point is within the node's radius divided by `base` of its own centre or, where
    that takes more than `fanout` centres, until there are so many; the next level goes on from the radii that these reach. Covering: every point is within its node's
    measured radius of the centre. Separation: any two children's centres are at least as far apart as any child's points are from its own. The first child keeps the node's centre (nesting).
    """
    if not len(x):
        return None
    length = (x**2).sum(axis=1)
    # nodes whose children are to be made, with the list that they go to
    top: list[Node] = []
    todo = [(np.arange(len(x)), 0, top)]
    while todo:
        rows, c, into = todo.pop()
        own_x, own_l = x[rows], length[rows]
        away = lambda i: np.sqrt(np.maximum(own_l + length[i] - 2 * (own_x @ x[i]), 0))
        near = away(c)
        radius = float(near.max())
        # differences of large numbers: a measured distance may be short by as much
        slack = 1e-7 * float(np.sqrt(own_l.max()))
        if len(rows) <= leaf or radius <= slack:
            into.append(Node(x[c], radius + slack, rows, None))
            continue
        own, centres = np.zeros(len(rows), np.int64), [c]
        while len(centres) < fanout and near[far := int(near.argmax())] > radius / base:
            centres.append(int(rows[far]))
            e = away(centres[-1])
            closer = e < near
            near[closer], own[closer] = e[closer], len(centres) - 1
        node = Node(x[c], radius + slack, None, [])
        into.append(node)
        todo += [(rows[own == i], ci, node.children) for i, ci in reversed(list(enumerate(centres)))]
    return top[0]


def dual_tree_top_k(queries: np.ndarray, points: np.ndarray, k: int, tree: Node | None = None, counts: dict[str, int] | None = None) -> list[list[tuple[float, int]]]:
    """For each query (row): the k best (score, row of points), equal scores by the smaller row.

    counts: gets the numbers of node pairs `visited` and `pruned`, and of `scores` computed, added up.

    Both sides hold whole numbers. A score s with row j is kept as s * n + (n - 1 - j), which orders by score, then row; `packable`
    says whether all such numbers are exact. tree: that of the points, where it is there already.
    """
    n = len(points)
    if not n or not len(queries):
        return [[] for _ in queries]
    k = min(k, n)
    best = np.full((len(queries), k), -np.inf)
    qt, pt = cover_tree(queries), tree or cover_tree(points)

    def bound(q: Node, p: Node) -> float:
        ub = float(q.center @ p.center) + q.norm * p.radius + p.norm * q.radius + q.radius * p.radius
        return (ub + abs(ub) * 1e-12 + 1e-6) * n + n

    def rows_of(node: Node) -> np.ndarray:
        if node.rows is None:
            node.rows = np.concatenate([rows_of(c) for c in node.children])
        return node.rows

    heap, tick = [(-bound(qt, pt), 0, qt, pt)], 0
    visited = pruned = scores = 0
    while heap:
        b, _, q, p = heapq.heappop(heap)
        if -b < best[rows_of(q), 0].min():
            pruned += 1
            continue
        visited += 1
        qr, pr = rows_of(q), rows_of(p)
        if q.children is None and p.children is None or visited > TRIED and pruned * PRUNES < visited and len(qr) * len(pr) <= BASE:
            scores += len(qr) * len(pr)
            step = max(1, TILE // len(qr))
            for at in range(0, len(pr), step):
                own = pr[at : at + step]
                s = (queries[qr] @ points[own].T) * n + (n - 1 - own)
                both = np.concatenate([best[qr], s], axis=1)
                both = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
                # the smallest of the k stands first: it is what prunes
                best[qr] = np.sort(both, axis=1)
            continue
        split_q = q.children is not None and (p.children is None or q.radius >= p.radius)
        for a, c in [(a, p) for a in q.children] if split_q else [(q, c) for c in p.children]:
            ub = bound(a, c)
            if ub >= best[rows_of(a), 0].min():
                tick += 1
                heapq.heappush(heap, (-ub, tick, a, c))
            else:
                pruned += 1
    if counts is not None:
        for name, more in (("visited", visited), ("pruned", pruned), ("scores", scores)):
            counts[name] = counts.get(name, 0) + more
    out = []
    for row in best[:, ::-1]:
        row = row[np.isfinite(row)]
        s = np.floor(row / n)
        out.append([(float(v), int(n - 1 - (c - v * n))) for v, c in zip(s, row)])
    return out


def packable(queries: np.ndarray, points: np.ndarray) -> bool:
    """Whether every score, with a row beside it, is exact in a double."""
    with np.errstate(over="ignore"):
        largest = np.sqrt((queries**2).sum(axis=1).max()) * np.sqrt((points**2).sum(axis=1).max())
        return bool((largest + 1) * len(points) < 2.0**52)


def large_top_k(queries: np.ndarray, points: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
    """As dual_tree_top_k, for whole numbers of any size: scores with an error bound, then exact ones of those that may be among the best.

    Rows are divided by a power of two each, so that products don't overflow; scores are compared as extended doubles.
    """
    def scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        e = np.frexp(np.abs(x).max(axis=1))[1]
        return np.ldexp(x, -e[:, None]), e

    (q, eq), (p, ep) = scaled(queries), scaled(points)
    d, clamp = queries.shape[1], lambda s: min(max(s, LONG_MIN), LONG_MAX)
    exact_p: dict[int, list[int]] = {}
    out, step = [], max(1, TILE // max(len(points), 1))
    for at in range(0, len(queries), step):
        part = q[at : at + step]
        power = (eq[at : at + step, None] + ep[None, :]).astype(np.int32)
        near = np.ldexp((part @ p.T).astype(np.longdouble), power)
        error = np.ldexp(((np.abs(part) @ np.abs(p).T + 1e-300) * (4 * d * 2.0**-53)).astype(np.longdouble), power)
        low, high = near - error, np.minimum(near + error, np.longdouble(2.0**63))
        need = np.minimum(np.partition(low, len(points) - min(k, len(points)), axis=1)[:, len(points) - min(k, len(points))], np.longdouble(2.0**63))
        for i, row in enumerate(high >= need[:, None]):
            own = [int(v) for v in queries[at + i]]
            found = []
            for j in np.flatnonzero(row).tolist():
                if j not in exact_p:
                    exact_p[j] = [int(v) for v in points[j]]
                found.append((-clamp(sum(map(int.__mul__, own, exact_p[j]))), j))
            out.append([(-s, j) for s, j in heapq.nsmallest(k, found)])
    return out


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(256 x) of each component, as exact doubles."""
    return np.floor(256.0 * np.asarray(vectors, np.float64))


class Shard:
    """Distinct points in order of their smallest id, the k + 1 smallest ids of each, and their tree."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        points, inverse = np.unique(vectors, axis=0, return_inverse=True)
        order = np.lexsort((ids, inverse.ravel()))
        group, ids = inverse.ravel()[order], ids[order]
        first = np.searchsorted(group, np.arange(len(points) + 1))
        held = [np.unique(ids[a:b])[: k + 1].tolist() for a, b in zip(first[:-1], first[1:])]
        # points in order of their smallest id, so that equal scores go by it
        order = sorted(range(len(points)), key=lambda i: held[i][0])
        self.points, self.held, self.k, self.tree = points[order], [held[i] for i in order], k, None
        self.counts: dict[str, int] = {}

    def search(self, ids: np.ndarray, queries: np.ndarray) -> list[tuple[int, int, int]]:
        """(query id, point id, score): the k best of each query other than itself, ties to the smaller id."""
        if not len(self.points) or not len(ids):
            return []
        # one more than k: a query's own vector may be among them
        if packable(queries, self.points):
            self.tree = self.tree or cover_tree(self.points)
            got = dual_tree_top_k(queries, self.points, self.k + 1, self.tree, self.counts)
        else:
            got = large_top_k(queries, self.points, self.k + 1)
        out = []
        for i, found in zip(ids.tolist(), got):
            rows = [(-int(s), v) for s, j in found for v in self.held[j] if v != i]
            out += [(i, v, -s) for s, v in heapq.nsmallest(self.k, rows)]
        return out


def search_shards(k: int, block_rows: int, report: bool = False):
    """Maps sorted rows (shard, is_query, vec_id, v): builds each shard when its first query comes, then searches block by block. report: what was walked, a row a block, instead of results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard, last = None, None, None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def joined() -> tuple[np.ndarray, np.ndarray]:
            ids, vectors = np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held])
            # a repeated row of an id counts once, the first in the sorted order
            fresh = np.concatenate(([last is None or ids[0] > last], ids[1:] > ids[:-1]))
            return ids[fresh], vectors[fresh]

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal held, size, shard, last
            if held and now[1]:
                ids, vectors = joined()
                got = shard.search(ids, vectors) if shard else []
                last = held[-1][0][-1]
                if report:
                    counts, shard.counts = shard.counts, {}
                    yield pa.RecordBatch.from_arrays([pa.array([len(ids)], pa.int64()), *[pa.array([counts.get(c, 0)], pa.int64()) for c in REPORTED]], ["queries", *REPORTED])
                    held, size = [], 0
                    return
                cols = list(zip(*got)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["query_id", "vec_id", "score"])
            elif held:
                shard = Shard(*joined(), k)
            held, size = [], 0

        for batch in batches:
            place, kind = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False)
            ids, v = batch.column(2).to_numpy(), batch.column(3)
            vectors = integers(v.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1))
            cut = np.flatnonzero(np.concatenate(([True], (place[1:] != place[:-1]) | (kind[1:] != kind[:-1])))) if batch.num_rows else []
            for a, b in zip(cut, np.append(cut[1:], batch.num_rows)):
                key = int(place[a]), bool(kind[a])
                if key != now:
                    yield from flush()
                    last = None
                    if now is None or key[0] != now[0]:
                        shard = None
                    now = key
                for at in range(a, b, block_rows):
                    stop = min(b, at + block_rows)
                    held.append((ids[at:stop], vectors[at:stop]))
                    size += stop - at
                    if now[1] and size >= block_rows:
                        yield from flush()
        yield from flush()

    return run


#: What a search has walked: node pairs, pairs that bounds closed, and scores computed.
REPORTED = ("visited", "pruned", "scores")


def _dealt(df: DataFrame, every: int, id_col: str, vector_col: str, shard_rows: int | None) -> DataFrame | None:
    """Rows (shard, is_query, vec_id, v), each shard in one task, its candidates first; None without usable vectors."""
    spark = df.sparkSession
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    rows = rows.where(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x * 256.0) < float("inf"))))
    usual = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if usual is None:
        return None
    rows = rows.where(F.size("v") == usual["d"])
    n = usual["count"]
    if not shard_rows:
        shard_rows = min(SHARD_ROWS, max(LEAST_SHARD_ROWS, -(-n // (2 * spark.sparkContext.defaultParallelism))))
    shards = max(1, math.ceil(n / shard_rows))
    points = rows.select(F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int").alias("shard"), F.lit(False).alias("is_query"), "vec_id", "v")
    queries = rows.where(F.col("vec_id") % every == 0).select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.lit(True).alias("is_query"), "vec_id", "v")
    return points.unionByName(queries).repartition(shards, "shard").sortWithinPartitions("shard", "is_query", "vec_id", "v")


def walked(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """queries, visited, pruned, scores: what `top_k` walks, a row a block of queries and shard."""
    dealt, schema = _dealt(df, every, id_col, vector_col, shard_rows), "queries long, visited long, pruned long, scores long"
    return df.sparkSession.createDataFrame([], schema) if dealt is None else dealt.mapInArrow(search_shards(k, block_rows, report=True), schema)


def top_k(df: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding", shard_rows: int | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score: each query (id divisible by `every`) against all other rows. shard_rows: candidates of a shard, chosen by their number if not given."""
    dealt = _dealt(df, every, id_col, vector_col, shard_rows)
    if dealt is None:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    found = dealt.mapInArrow(search_shards(k, block_rows), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
