"""Connected components by alternating large-star and small-star rounds.

Every round is a handful of aggregates and joins on edges; it is written to the shared folder, so that
lineage stays short and lost executors cost one round at most. A node's many edges are reduced to one
minimum with map-side partial minima, and joined back by a join that Spark can split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.shared import discard, materialize

#: Edges that one task thins.
JOINED_EDGES = 250_000


def forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Indices of edges that make a spanning forest."""
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    keep = []
    for i, (u, v) in enumerate(zip(a.tolist(), b.tolist())):
        u, v = find(u), find(v)
        if u != v:
            root[max(u, v)] = min(u, v)
            keep.append(i)
    return np.array(keep, np.int64)


def thinned(edges: DataFrame) -> DataFrame:
    """Edges a, b (longs) without those that close a circle within 100,000 edges of one task: as many components, fewer edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n > 100_000:
                held = [_thin(held)]
                if held[0].num_rows > 50_000:
                    yield held.pop()
                n = sum(h.num_rows for h in held)
        if held:
            yield _thin(held)

    return edges.select("a", "b").mapInArrow(run, "a long, b long")


def _thin(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    a, b = (np.concatenate([h.column(i).to_numpy() for h in held]) for i in (0, 1))
    at = forest(a, b)
    return pa.RecordBatch.from_arrays([pa.array(a[at], pa.int64()), pa.array(b[at], pa.int64())], ["a", "b"])


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """node, root for every node with an edge to another; root is the smallest node reachable.

    edges: columns a, b, longs without nulls; direction, loops and repeats don't matter.
    """
    now = thinned(edges.where("a <> b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(now, "edges")
    # many tasks each keep a forest over the same nodes: thin those forests together, in tasks of JOINED_EDGES
    first = now
    now = materialize(thinned(now.coalesce(max(4, -(-first.count() // JOINED_EDGES))).toDF("a", "b")).toDF("u", "v"), "edges")
    discard(now.sparkSession, first)
    state = None
    for _ in range(max_rounds):
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        nxt = small.where("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")).unionByName(small_low.select("u", F.col("m").alias("v"))).distinct()
        nxt = materialize(nxt, "edges")
        got = nxt.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        discard(now.sparkSession, now)
        now = nxt
        if tuple(got) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = tuple(got)
    raise RuntimeError("components did not settle")
