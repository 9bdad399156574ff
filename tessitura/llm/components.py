"""Connected components over edges that stay distributed."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, schema, stored, written

#: Edges that a task contracts at a time.
LOCAL_EDGES = 1 << 18


def union_find(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges (node, least node of its class) that hold together what the edges (u, v) do."""
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in zip(at[: len(u)].tolist(), at[len(u) :].tolist(), strict=True):
        a, b = root(a), root(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    roots = np.array([root(x) for x in range(len(nodes))], dtype=np.int64)
    moved = roots != np.arange(len(nodes))
    return nodes[moved], nodes[roots[moved]]


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (u, v) that connect what ``edges`` do: each task replaces ``LOCAL_EDGES`` of its own at a time by stars about their least nodes."""

    def stars(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        u, v = (np.concatenate([b.column(name).to_numpy() for b in held]) for name in ("u", "v"))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in union_find(u, v)], names=["u", "v"])

    def run(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.num_rows for b in held) >= LOCAL_EDGES:
                yield stars(held)
                held = []
        if held:
            yield stars(held)

    return edges.select("u", "v").mapInArrow(run, schema("u long, v long"))


def _written_small(edges: DataFrame) -> DataFrame:
    """Distinct edges, written down and contracted: where there are few, few tasks read them and join most of what hangs together."""
    start = written()
    out = stored(contracted(stored(edges.where("u <> v").distinct())))
    discard(edges.sparkSession, start, keep=1)
    return out


def unsettled(edges: DataFrame) -> DataFrame:
    """(x, m, into) of the nodes that keep edges from being stars: with two targets, or a target and edges into them. m: the least target."""
    nothing = F.lit(None).cast("long")
    ends = F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("t"), F.lit(False).alias("into")), F.struct(F.col("v").alias("x"), nothing.alias("t"), F.lit(True).alias("into")))
    each = edges.select(F.inline(ends)).groupBy("x").agg(F.min("t").alias("m"), F.max("t").alias("most"), F.max("into").alias("into"))
    return each.where("m < most or (m is not null and into)").select("x", "m", "into")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (u, v), component being the smallest node reachable.

    Alternates large-star and small-star steps until the edges are stars about their least nodes. Only nodes that a step changes are joined
    with the edges: those between a larger and a smaller neighbour, then those with several targets. They are found by aggregations that are
    partially summed before their shuffles, and written down, so that Spark knows their size: where they are few, the edges of a hub stay
    where they are. Each round is written to the shared folder, and the one before deleted. Loops (u = v) and repeated edges count for
    nothing; without edges the result is empty.
    """
    spark, start = edges.sparkSession, written()
    now = _written_small(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")))
    while not (between := stored(unsettled(now))).isEmpty():
        targets = between.where("into and m is not null").select(F.col("x").alias("v"), "m")
        large = stored(now.join(targets, "v", "left").select("u", F.coalesce("m", "v").alias("v")))
        forks = stored(large.groupBy("u").agg(F.min("v").alias("m"), F.max("v").alias("most")).where("m < most").select("u", "m"))
        both = F.array(F.struct(F.col("u"), F.coalesce("m", "v").alias("v")), F.struct(F.col("v").alias("u"), F.coalesce("m", "v").alias("v")))
        now = _written_small(large.join(forks, "u", "left").select(F.inline(both)))
        discard(spark, start, keep=1)
    discard(spark, written() - 1)
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(now.select("v", "v")).distinct()
