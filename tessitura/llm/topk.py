"""Exact top-k inner-product search: one ball tree for each shard, searched by branch and bound."""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import bounded_batches, repeated, schema, stored
from .text import gathered, trim

#: Bytes (as doubles) of the vectors in a shard and of the queries in a block; vectors in a leaf; the part of the shards that is searched first.
SHARD_BYTES, BLOCK_BYTES, LEAF, FIRST = 64 << 20, 1 << 20, 128, 8
#: Doubles from here on are whole numbers; the largest double; components from here on lie in a tree of their own.
WHOLE, LARGEST, TALL = 2.0**52, 1.7976931348623157e308, 2.0**24
#: The ends of a long; what stands for no score among longs, and among whole numbers of any size.
LEAST, MOST = -(2**63) + 1, 2**63 - 1
NONE, WIDE_NONE = np.iinfo(np.int64).min, -(10**700)


@dataclass
class Node:
    rows: np.ndarray
    least: int
    children: tuple[int, int] | None


def narrow(vectors: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest type that holds them."""
    most = np.abs(vectors).max(initial=0.0)
    return vectors.astype(np.int16 if most < 2**15 else np.float32 if most < TALL else np.float64)


class BallTree:
    """Vectors in nested balls: each node knows its centre, radius and smallest id. ``copy`` numbers equal rows from 0."""

    def __init__(self, vectors: np.ndarray, ids: np.ndarray, copy: np.ndarray | None = None, leaf: int = LEAF) -> None:
        self.vectors, self.ids, self.nodes, centres, radii = narrow(vectors), ids, [], [], []
        self.copy = np.zeros(len(ids), dtype=np.int64) if copy is None else copy
        self.most = float(np.abs(vectors).max(initial=0.0))
        waiting = [(np.arange(len(ids)), -1)]
        links: dict[int, list[int]] = {}
        while waiting:
            rows, parent = waiting.pop()
            points = self.vectors[rows].astype(np.float64)
            with np.errstate(over="ignore", invalid="ignore"):
                centre = points.mean(axis=0)
                radius = np.sqrt(((points - centre) ** 2).sum(axis=1).max())
            me = len(self.nodes)
            centres.append(centre)
            radii.append(radius)
            self.nodes.append(Node(rows, int(ids[rows].min()), None))
            if parent >= 0:
                links.setdefault(parent, []).append(me)
            if len(rows) > leaf and radii[-1] > 0:
                axis = int(np.argmax(points.max(axis=0) - points.min(axis=0)))
                half = np.argpartition(points[:, axis], len(rows) // 2)
                waiting += [(rows[half[: len(rows) // 2]], me), (rows[half[len(rows) // 2 :]], me)]
        for parent, pair in links.items():
            self.nodes[parent].children = (pair[0], pair[1])
        self.centres, self.radii = np.array(centres), np.array(radii)

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """An upper bound of the score of each query with anything in each node, with room for rounding. Where it overflows it rules nothing out."""
        with np.errstate(over="ignore", invalid="ignore"):
            norms = np.sqrt((queries**2).sum(axis=1))
            top = queries @ self.centres.T + norms[:, None] * self.radii[None, :]
            top = top + 1e-9 * (np.abs(top) + norms[:, None] * (1 + np.abs(self.centres).max(initial=0.0) + self.radii[None, :]))
        return np.where(np.isnan(top), np.inf, top)


def reach(most: float, other: float, dim: int) -> float:
    """What no score of vectors with such largest components exceeds."""
    with np.errstate(over="ignore"):
        return float(np.float64(most) * np.float64(other) * dim)


def exact_scores(queries: np.ndarray, vectors: np.ndarray, wide: bool = False) -> np.ndarray:
    """Whole inner products: through doubles where all sums stay below 2**53, else longs, with ``wide`` Python's whole numbers."""
    vectors = vectors.astype(np.float64)
    if wide:
        whole = np.frompyfunc(int, 1, 1)
        return whole(queries) @ whole(vectors).T
    if reach(np.abs(queries).max(initial=0.0), np.abs(vectors).max(initial=0.0), queries.shape[1]) < 2.0**53:
        return (queries @ vectors.T).astype(np.int64)
    return queries.astype(np.int64) @ vectors.astype(np.int64).T


def as_doubles(scores: np.ndarray) -> np.ndarray:
    """Scores as doubles to compare bounds with; those beyond all doubles are held at the ends."""
    if scores.dtype != object:
        return scores.astype(np.float64)
    return np.array([float(max(-int(LARGEST), min(int(LARGEST), x))) for x in scores.tolist()], dtype=np.float64)


def best_of(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """The places of the ``k`` best of each row, ties to the smaller id."""
    if scores.dtype != object:
        return np.lexsort((ids, ~scores), axis=-1)[:, :k]
    return np.array([sorted(range(len(s)), key=lambda j: (-s[j], i[j]))[:k] for s, i in zip(scores.tolist(), ids.tolist(), strict=True)], dtype=np.int64)


def search(tree: BallTree, queries: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, id, score) of the best ``k`` of a tree for each query; none that ``floor``, a known kth score, rules out.

    Nodes are visited by their largest upper bound. At each, only queries go on whose bound reaches their current kth score, and at a tie
    only if the node holds a smaller id. Of a query's own row (its id in ``own``, and its vector) one copy is left out.
    """
    wide = reach(np.abs(queries).max(initial=0.0), tree.most, queries.shape[1]) >= 2.0**63
    nothing, nobody = (WIDE_NONE if wide else NONE), np.iinfo(np.int64).max
    bound = tree.bounds(queries)
    scores = np.full((len(queries), k), nothing, dtype=object if wide else np.int64)
    found = np.full((len(queries), k), nobody)
    bar = np.where(floor <= LEAST, -np.inf, floor.astype(np.float64))  # the low end of a long rules nothing out
    kth = bar.copy()
    heap = [(-float(bound[:, 0].max()), 0)] if len(queries) else []
    while heap:
        _, at = heapq.heappop(heap)
        node = tree.nodes[at]
        active = np.flatnonzero((bound[:, at] > kth) | ((bound[:, at] >= kth) & (wide | (node.least < found[:, -1]))))
        if not len(active):
            continue
        if node.children:
            for child in node.children:
                heapq.heappush(heap, (-float(bound[active, child].max()), child))
            continue
        ids = tree.ids[node.rows]
        new = exact_scores(queries[active], tree.vectors[node.rows], wide)
        a, b = np.nonzero((own[active][:, None] == ids[None, :]) & (tree.copy[node.rows] == 0)[None, :])
        mine = (queries[active][a] == tree.vectors[node.rows][b]).all(axis=1)
        new[a[mine], b[mine]] = nothing
        better = np.flatnonzero(as_doubles(new.max(axis=1)) >= kth[active])
        if not len(better):
            continue
        rows = active[better]
        every = np.concatenate([scores[rows], new[better]], axis=1)
        who = np.concatenate([found[rows], np.broadcast_to(ids, (len(better), len(ids)))], axis=1)
        who[every == nothing] = nobody
        best = best_of(every, who, k)
        scores[rows], found[rows] = np.take_along_axis(every, best, 1), np.take_along_axis(who, best, 1)
        kth[rows] = np.maximum(bar[rows], as_doubles(scores[rows, -1]))
    at, place = np.nonzero((found != nobody) & ((scores >= floor[:, None]) | (floor <= LEAST)[:, None]))
    return at, found[at, place], scores[at, place]


def beyond(score: int) -> str:
    """Orders scores that share an end of a long: empty within its range, else text that sorts as the score does."""
    if LEAST < score <= MOST:
        return ""
    if score == LEAST:
        return "~"
    digits = str(abs(score))
    rank = f"{len(digits):05d}{digits}"
    return rank if score > 0 else "".join(str(9 - int(c)) for c in rank)


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def quantised(vectors: DataFrame, *, key: str, vector: str, scale: int) -> DataFrame:
    """(id, v, dim) of the vectors that take part: floor(scale * x) of finite components, identical rows as one with their number.

    Null vectors, empty ones and those with a null, infinite or NaN component take no part. None is left out by its size; components that
    scaling would make infinite become the largest double.
    """

    def whole(x: Column) -> Column:
        scaled = F.lit(scale) * x.cast("double")
        return F.when(F.abs(scaled) < WHOLE, F.floor(scaled).cast("double")).otherwise(F.greatest(F.least(scaled, F.lit(LARGEST)), F.lit(-LARGEST)))

    v = F.transform(F.col(f"`{vector}`"), whole)
    sound = F.forall(F.col(f"`{vector}`"), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    fit = vectors.where(F.col(f"`{vector}`").isNotNull() & (F.size(f"`{vector}`") > 0) & F.coalesce(sound, F.lit(False)) & F.col(f"`{key}`").isNotNull())
    return fit.select(F.col(f"`{key}`").cast("long").alias("id"), v.alias("v")).groupBy("id", "v").agg(F.count("*").alias("times")).withColumn("dim", F.size("v"))


def query_blocks(queries: DataFrame, block_bytes: int) -> DataFrame:
    """One row for each block of queries of one dimension: their ids, rows, numbers, floors and vectors, packed small."""

    def pack(batches):
        for table in gathered(batches, block_bytes):
            dims = table["dim"].to_numpy()
            for dim in np.unique(dims):
                mine = table.filter(pa.array(dims == dim))
                v = narrow(_matrix(mine["v"]))
                head = np.array([len(v), dim, np.dtype(v.dtype).num], dtype=np.int64).tobytes()
                body = b"".join(mine["body"].to_pylist())
                raw = head + mine["id"].to_numpy().tobytes() + mine["times"].to_numpy().tobytes() + mine["floor"].to_numpy().tobytes() + body + v.tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(raw)], pa.binary())], names=["pack"])

    return queries.select("id", "body", "times", "floor", "dim", "v").mapInArrow(pack, schema("pack binary"))


def opened(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(ids, numbers, floors, rows, vectors) of a block."""
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, dim, kind = (int(x) for x in np.frombuffer(raw, np.int64, 3))
    ids, times, floor = (np.frombuffer(raw, np.int64, n, 24 + 8 * n * i) for i in range(3))
    body = np.frombuffer(raw, "S16", n, 24 + 24 * n)
    dtype = next(d for d in map(np.dtype, (np.int16, np.float32, np.float64)) if d.num == kind)
    return ids, times, floor, body, np.frombuffer(raw, dtype, n * dim, 24 + 40 * n).reshape(n, dim).astype(np.float64)


def trees_of(batches: list[pa.RecordBatch], k: int) -> dict[int, list[BallTree]]:
    """By dimension the trees of a shard: one, and another where some vectors have huge components."""
    rows = pa.Table.from_batches(batches)
    dims, out = rows["dim"].to_numpy(), {}
    for dim in np.unique(dims):
        mine = rows.filter(pa.array(dims == dim))
        v, ids = _matrix(mine["v"]), mine["id"].to_numpy()
        times = np.minimum(mine["times"].to_numpy(), k + 1)
        tall = np.abs(v).max(axis=1) >= TALL
        for some in (~tall, tall):
            if some.any():
                at = np.repeat(np.flatnonzero(some), times[some])
                copy = np.arange(len(at)) - np.repeat(np.cumsum(times[some]) - times[some], times[some])
                out.setdefault(int(dim), []).append(BallTree(v[at], ids[at], copy))
    return out


def search_shards(base: DataFrame, queries: DataFrame, first: int, end: int, shards: int, k: int, block_bytes: int) -> DataFrame:
    """The best ``k`` of each of the shards ``first`` to ``end`` for each query, as far as its floor lets them through.

    In a task the vectors of a shard come first; their tree is built once, and the blocks of queries stream through it one by one.
    """
    held = base.withColumn("shard", F.pmod(F.xxhash64("id", "v"), F.lit(shards))).where(F.col("shard").between(first, end - 1))
    held = held.select("shard", F.lit(0).alias("kind"), "id", "times", "dim", "v", F.lit(None).cast("binary").alias("pack"))
    asked = query_blocks(queries, block_bytes).withColumn("shard", F.explode(F.sequence(F.lit(first).cast("long"), F.lit(end - 1).cast("long"))))
    asked = asked.select("shard", F.lit(1).alias("kind"), *(F.lit(None).cast(t).alias(c) for c, t in (("id", "long"), ("times", "long"), ("dim", "int"), ("v", "array<double>"))), "pack")
    out = schema("query_id long, body binary, times long, vec_id long, score long, beyond string")

    def answer(trees: dict[int, list[BallTree]], blob: bytes):
        ids, times, floor, body, v = opened(blob)
        tall = np.abs(v).max(axis=1) >= TALL
        for tree in trees.get(v.shape[1], ()):
            for some in (np.flatnonzero(~tall), np.flatnonzero(tall)):
                if len(some):
                    at, who, score = search(tree, v[some], ids[some], floor[some], k)
                    if len(at):
                        q, exact = some[at], score.tolist()
                        rows = [body[q].tobytes()[i : i + 16] for i in range(0, 16 * len(q), 16)]
                        held_at = pa.array([max(LEAST, min(MOST, x)) for x in exact], pa.int64())
                        yield pa.RecordBatch.from_arrays([pa.array(ids[q]), pa.array(rows, pa.binary()), pa.array(times[q]), pa.array(who), held_at, pa.array([beyond(x) for x in exact], pa.string())], names=out.names)

    def run(batches):
        now, held, trees = None, [], {}
        for batch in batches:
            shard, kind = batch.column("shard").to_numpy(), batch.column("kind").to_numpy()
            cuts = np.flatnonzero((np.diff(shard) != 0) | (np.diff(kind) != 0)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
                if a == b:
                    continue
                if shard[a] != now:
                    now, held, trees = shard[a], [], {}
                    trim()
                if kind[a] == 0:
                    held.append(batch.slice(a, b - a))
                    continue
                if held:
                    trees, held = trees_of(held, k), []
                for blob in batch.column("pack").slice(a, b - a).to_pylist():
                    yield from answer(trees, blob)

    return held.unionByName(asked).repartitionById(max(1, end - first), (F.col("shard") - first).cast("int")).sortWithinPartitions("shard", "kind").mapInArrow(run, out)


def top_k(vectors: DataFrame, is_query: Column, *, k: int = 5, key: str = "vec_id", vector: str = "embedding", scale: int = 256, shard_bytes: int = SHARD_BYTES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """For each query row the ``k`` other rows of highest inner product: (query_id, rank, vec_id, score), ties to the smaller id.

    Queries are the rows where ``is_query`` holds (a condition on ``id``); candidates all rows but the query's own, of the same dimension.
    Vectors are dealt to shards of about ``shard_bytes`` by a hash, so that none is larger by much. A shard's ball tree is built once and all
    queries stream through it in blocks. An eighth of the shards is searched first; the kth score that a query has then goes with it to the
    others as the bound to beat. Repeated rows are rows of their own: each is a candidate, of a query's own row its other copies too, and
    each repeated query row has its answers. Rows of one id and unlike vectors are rows like others. An empty table, or one without
    queries, gives no rows. Scores are compared exactly; those that do not fit a long are shown as its ends. See ``quantised`` for the
    vectors that take no part.
    """
    bounded_batches(vectors.sparkSession)
    base = stored(quantised(vectors, key=key, vector=vector, scale=scale))
    size = base.agg(F.coalesce(F.sum(F.col("dim").cast("long") * 8), F.lit(0)).alias("size")).first()["size"]
    shards = max(1, -(-size // shard_bytes), vectors.sparkSession.sparkContext.defaultParallelism)
    first = max(1, shards // FIRST)
    body = F.unhex(F.md5(F.array_join(F.transform("v", lambda x: x.cast("string")), ",")))
    queries = base.where(is_query).select("id", body.alias("body"), "times", "dim", "v")
    rank = F.row_number().over(Window.partitionBy("query_id", "body").orderBy(F.col("score").desc(), F.col("beyond").desc(), "vec_id"))

    def ranked(found: DataFrame) -> DataFrame:
        return found.withColumn("rank", rank).where(F.col("rank") <= k)

    none = F.lit(int(NONE)).cast("long")
    some = ranked(search_shards(base, queries.withColumn("floor", none), 0, first, shards, k, block_bytes))
    if first < shards:
        early = stored(some)
        floors = early.where(F.col("rank") == k).select(F.col("query_id").alias("id"), "body", F.col("score").alias("floor"))
        later = search_shards(base, queries.join(floors, ["id", "body"], "left").withColumn("floor", F.coalesce("floor", none)), first, shards, shards, k, block_bytes)
        some = ranked(early.drop("rank").unionByName(later))
    return repeated(some, "times").select("query_id", "rank", "vec_id", "score")
