"""N-gram Jaccard join by parity sketches: exact classes of near-duplicate documents."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, union_find
from .rowfilter import row_filter
from .shared import bounded_batches, discard, schema, stored, written
from .sketches import Bands, exact_classes, sketch_keys
from .text import NOT_SPACE, chunks, gathered, mix, trim

#: Stands for a null key: before all others.
NULL_KEY = -(2**63)
#: Bytes of text that a map task gathers before it deals out shingles; items that meet in one exact comparison; slices of a bucket that are
#: sorted one after the other.
GATHER_BYTES, GROUP_ITEMS, SLICES = 4 << 20, 1_000_000, 8
#: Bytes of text whose shingles one part counts: at least so many, and so many times the root of all bytes, so that neither the parts nor
#: the rows that a task deals to them become too many.
PART_BYTES, PART_ROOT = 16 << 20, 25


def parts_of(total: int) -> int:
    return max(1, round(total / max(PART_BYTES, PART_ROOT * total**0.5)))


def fingerprints(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(size, node, check) of each set: two 64-bit sums over its items, of which the first names the set."""
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    sums = []
    items = np.concatenate([*sets, np.zeros(1, dtype=np.uint64)])
    first = np.concatenate([[0], np.cumsum(sizes)])
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        total = np.concatenate([[np.uint64(0)], np.cumsum(mix(items ^ np.uint64(salt)))])
        sums.append(mix(total[first[1:]] - total[first[:-1]] + sizes.astype(np.uint64)).view(np.int64))
    return sizes, *sums


def all_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    return [s for c in chunks(column, NOT_SPACE, lower=True) for s in c.shingle_sets(width)]


def _groups(values: np.ndarray, count: int) -> tuple[np.ndarray, np.ndarray]:
    """An order that sorts small integers, and where each of them begins in it."""
    order = np.argsort(values, kind="stable")
    return order, np.searchsorted(values[order], np.arange(count + 1))


def profile(docs: DataFrame, width: int, parts: int) -> DataFrame:
    """Rows of two kinds, written to the shared folder after one pass over the texts.

    kind 0, one for each document: id, n (distinct shingles), node and check of its set. kind 1: node and n, in all the number of its
    shingles that no other set has. To count them, shingles go to buckets as packed 5-byte fingerprints; two that collide count as shared,
    never as alone. A shingle that several sets of a task have goes out twice, without a set, however many they are.
    """
    fields = schema("part int, kind int, id long, n long, node long, check long, pack binary")

    def deal(batches):
        for table in gathered(batches, GATHER_BYTES):
            ids = table["id"].to_numpy()
            sets = all_sets(table["text"].combine_chunks(), width)
            sizes, node, check = fingerprints(sets)
            part = (mix(node.view(np.uint64)) % np.uint64(parts)).astype(np.int32)
            nothing = pa.nulls(len(ids), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(np.zeros(len(ids), dtype=np.int32)), pa.array(ids), pa.array(sizes), pa.array(node), pa.array(check), nothing], names=fields.names)
            _, once = np.unique(node, return_index=True)
            once = once[sizes[once] > 0]
            if not len(once):
                continue
            items = np.concatenate([sets[i] for i in once])
            owner = np.repeat(np.arange(len(once)), sizes[once])
            order = np.argsort(items, kind="stable")
            items, owner = items[order], owner[order]
            new = np.concatenate([[True], items[1:] != items[:-1]])
            times = np.diff(np.append(np.flatnonzero(new), len(items)))
            items, owner = items[new], np.where(times > 1, -1, owner[new])
            bucket = ((items >> np.uint64(40)) % np.uint64(parts)).astype(np.int32)
            print_of = items & np.uint64((1 << 40) - 1)
            where = np.lexsort((owner, bucket))
            bucket, owner, print_of = bucket[where], owner[where], print_of[where]
            begin = np.searchsorted(bucket, np.arange(parts + 1))
            packed = np.ascontiguousarray(print_of.view(np.uint8).reshape(-1, 8)[:, :5])
            names = node[once]
            rows = []
            for b in np.flatnonzero(np.diff(begin)):
                a, e = begin[b], begin[b + 1]
                who, many = np.unique(owner[a:e], return_counts=True)
                head = np.array([len(who), int(who[0] < 0)], dtype=np.int32)
                rows.append((int(b), head.tobytes() + np.where(who < 0, 0, names[who]).tobytes() + many.astype(np.int32).tobytes() + packed[a:e].tobytes()))
            none = pa.nulls(len(rows), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array(np.ones(len(rows), dtype=np.int32)), none, none, none, none, pa.array([r[1] for r in rows], pa.binary())], names=fields.names)

    between = schema("part int, kind int, id long, n long, node long, check long, pack binary")

    def count(batches):
        held: dict[int, list] = {}
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            plain = batch.filter(pa.array(kind == 0))
            if plain.num_rows:
                yield plain
            packs = batch.filter(pa.array(kind == 1))
            for b, pack in zip(packs.column("part").to_pylist(), packs.column("pack").to_pylist(), strict=True):
                held.setdefault(b, []).append(pack)
        for packs in held.values():
            nodes, total = alone_in(packs)
            # to where the set's own total is made: one pack for each place, not a row for each set
            where = (mix(nodes.view(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order, begin = _groups(where, parts)
            to = np.flatnonzero(np.diff(begin))
            bodies = [nodes[order[begin[t] : begin[t + 1]]].tobytes() + total[order[begin[t] : begin[t + 1]]].tobytes() for t in to]
            none = pa.nulls(len(to), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(np.ones(len(to), dtype=np.int32)), none, none, none, none, pa.array(bodies, pa.binary())], names=between.names)
        trim()

    out = schema("kind int, id long, n long, node long, check long")

    def total(batches):
        nodes, counts = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
        for batch in batches:
            kind = batch.column("kind").to_numpy()
            plain = batch.filter(pa.array(kind == 0))
            if plain.num_rows:
                yield plain.select(out.names)
            for pack in batch.filter(pa.array(kind == 1)).column("pack").to_pylist():
                half = len(pack) // 16
                nodes.append(np.frombuffer(pack, np.int64, half))
                counts.append(np.frombuffer(pack, np.int64, half, 8 * half))
        names, at = np.unique(np.concatenate(nodes), return_inverse=True)
        sums = np.zeros(len(names), dtype=np.int64)
        np.add.at(sums, at, np.concatenate(counts))
        none = pa.nulls(len(names), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(names), dtype=np.int32)), none, pa.array(sums), pa.array(names), none], names=out.names)
        trim()

    return stored(docs.mapInArrow(deal, fields).repartitionById(parts, "part").mapInArrow(count, between).repartitionById(parts, "part").mapInArrow(total, out))


def alone_in(packs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(node, number of its fingerprints that no other node has) over the packs of one bucket."""
    names, counts, shared, prints = [], [], [], []
    for pack in packs:
        size, has = np.frombuffer(pack, np.int32, 2)
        names.append(np.frombuffer(pack, np.int64, size, 8))
        counts.append(np.frombuffer(pack, np.int32, size, 8 + 8 * size))
        flag = np.zeros(size, dtype=bool)
        flag[0] = has
        shared.append(flag)
        prints.append(np.frombuffer(pack, np.uint8, offset=8 + 12 * size).reshape(-1, 5))
    names, counts, shared, prints = (np.concatenate(x) for x in (names, counts, shared, prints))
    nodes, place = np.unique(names, return_inverse=True)
    entry = np.repeat(np.arange(len(names), dtype=np.int32), counts)
    total = np.zeros(len(nodes), dtype=np.int64)
    for piece in range(SLICES):
        rows = np.flatnonzero(prints[:, 4] % SLICES == piece)
        if len(rows):
            raw = np.zeros((len(rows), 8), dtype=np.uint8)
            raw[:, :5] = prints[rows]
            value = raw.view(np.uint64).ravel()
            order = np.argsort(value, kind="stable")
            value, who = value[order], entry[rows[order]]
            new = np.flatnonzero(np.concatenate([[True], value[1:] != value[:-1]]))
            least, most = np.minimum.reduceat(place[who], new), np.maximum.reduceat(place[who], new)
            alone = (least == most) & ~np.logical_or.reduceat(shared[who], new)
            total += np.bincount(least[alone], minlength=len(nodes))
    got = np.flatnonzero(total)
    return nodes[got], total[got]


def _stars(keys: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """One (key, least node) for each key, and the edges from that node to the others of the key."""
    order = np.lexsort((nodes, keys))
    keys, nodes = keys[order], nodes[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, dtype=np.int64)
    least = nodes[np.repeat(first, np.diff(np.append(first, len(keys))))] if len(keys) else nodes
    other = least != nodes
    return keys[first], nodes[first], nodes[other], least[other]


def candidate_edges(sets: DataFrame, width: int, bands: Bands) -> DataFrame:
    """Edges (u, v) that connect all nodes of one sketch key; a key that many sets share makes one row in each map task."""
    fields = schema("key long, node long, least long")

    def deal(batches):
        for table in gathered(batches, GATHER_BYTES):
            node = table["node"].to_numpy()
            at, key = sketch_keys(all_sets(table["text"].combine_chunks(), width), bands)
            key, node, u, v = _stars(key.view(np.int64), node[at])
            u, v = union_find(u, v)
            none = pa.nulls(len(key), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(node), none], names=fields.names)
            yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(u), pa.array(v)], names=fields.names)

    def meet(batches):
        held = [(np.zeros(0, dtype=np.int64),) * 2]
        edges = [(np.zeros(0, dtype=np.int64),) * 2]
        for batch in batches:
            direct = batch.filter(batch.column("least").is_valid())
            edges.append((direct.column("node").to_numpy(), direct.column("least").to_numpy()))
            plain = batch.filter(batch.column("least").is_null())
            held.append((plain.column("key").to_numpy(), plain.column("node").to_numpy()))
            if sum(len(k) for k, _ in held[1:]) > 2 * len(held[0][0]) + (1 << 20):
                key, node, u, v = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
                held = [(key, node)]
                edges = [union_find(*(np.concatenate(x) for x in zip(*edges, (u, v), strict=True)))]
        _, _, u, v = _stars(*(np.concatenate(x) for x in zip(*held, strict=True)))
        u, v = union_find(*(np.concatenate(x) for x in zip(*edges, (u, v), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
        held, edges = [], []
        trim()

    return sets.select("node", "text").mapInArrow(deal, fields).repartition("key").mapInArrow(meet, schema("u long, v long"))


def meeting_places(sets: DataFrame, labels: DataFrame, bands: Bands, limit: int) -> DataFrame:
    """(place, node): where sets of one component of candidates are compared, a row for each.

    Components are cut by size: a set meets those of its own band and of the bands beside it. What holds more than ``limit`` items still is
    cut into blocks, each pair of which has a place: quadratic in the blocks, but never more than ``limit`` items in a place (or two sets),
    and every two sets that can be similar have one. Sets that would be alone in a place, or only with others that meet in their own band,
    have none there.
    """
    edges = bands.edges(sets.agg(F.coalesce(F.max("n"), F.lit(1))).first()[0] + 1).tolist()
    bounds = F.array(*map(F.lit, edges))
    placed = sets.select("node", "n").join(labels, "node").withColumn("own", (F.size(F.filter(bounds, lambda e: e <= F.col("n"))) - 1).cast("int"))
    # as the larger of a pair: only if a smaller set of the band below is similar enough
    reaches = (F.col("own") > 0) & ((F.element_at(bounds, F.greatest(F.col("own"), F.lit(1)) + 1) - 1) * bands.den >= F.col("n") * bands.num)
    placed = placed.withColumn("band", F.explode(F.when(reaches, F.array("own", F.col("own") - 1)).otherwise(F.array("own"))))
    sums = placed.groupBy("component", "band").agg(F.sum("n").alias("banded"), F.count("*").alias("members"), F.max((F.col("own") == F.col("band")).cast("int")).alias("at_home")).where("members > 1 and at_home = 1")
    placed = placed.join(sums, ["component", "band"])
    blocks = F.when(F.col("banded") <= limit, F.lit(1)).otherwise(F.ceil(F.col("banded") / (limit // 2))).cast("int")
    placed = placed.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    place = F.xxhash64("component", "band", F.least("block", "other"), F.greatest("block", "other"))
    return placed.select(place.alias("place"), "node")


def linked_sets(sets: DataFrame, labels: DataFrame, width: int, bands: Bands, limit: int) -> DataFrame:
    """(node, component) of the sets that are linked with others, exactly: a class may reach over several places of its component."""
    # written down, so that Spark knows their size and moves the texts once only where the places are few
    places = stored(meeting_places(sets, labels, bands, limit))
    return components(exact_edges(sets.select("node", "text").join(places, "node"), width, bands))


def exact_edges(places: DataFrame, width: int, bands: Bands) -> DataFrame:
    """Edges (u, v) between sets of one place that are similar, as many as hold each class together."""

    def compare(batches):
        now, rows = None, []
        u, v = [], []

        def close() -> None:
            if len(rows) > 1:
                sets = all_sets(pa.array([t for _, t in rows], pa.string()), width)
                label = exact_classes(sets, bands)
                moved = np.flatnonzero(label != np.arange(len(rows)))
                names = np.array([x for x, _ in rows], dtype=np.int64)
                u.append(names[moved])
                v.append(names[label[moved]])

        for batch in batches:
            for place, node, text in zip(batch.column("place").to_pylist(), batch.column("node").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if place != now:
                    close()
                    now, rows = place, []
                rows.append((node, text))
            if sum(map(len, u)) > 100_000:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])
                u.clear()
                v.clear()
        close()
        rows.clear()
        trim()
        if u:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(u)), pa.array(np.concatenate(v))], names=["u", "v"])

    return places.select("place", "node", "text").repartition("place").sortWithinPartitions("place").mapInArrow(compare, schema("u long, v long"))


def near_duplicates(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 5, num: int = 4, den: int = 5, group_items: int = GROUP_ITEMS) -> DataFrame:
    """(key, n_shingles, component_id) for every row of ``docs``: classes of documents linked at Jaccard similarity ``num / den`` or more.

    A document's set: its distinct shingles of ``width`` words (what stands between ASCII white space, A-Z lower-cased) over the whole text;
    with fewer words, all of them as one; without words or text, empty and linked with nothing. component_id: the smallest key reachable
    over links, its own included. Equal sets are linked; repeated rows are documents of their own with the same class. A null key counts as
    the smallest, and a class that holds one has component_id null. An empty table gives no rows.

    Sets are compared through 64-bit shingle hashes and recognised as equal by 128 bits. (1) Equal sets become one node. (2) A set with more
    shingles of its own than similar sets may differ in is linked with nothing, exactly. (3) The others are cut into size bands; each makes
    a parity sketch for its bands, and sets with an agreeing sketch word are candidates, joined by stars and never by all pairs. (4) In each
    component of candidates, cut by bands, sets that share a sketch word and whose sketches differ in no more bits than similar sets can
    differ in items are compared exactly. No link is lost and none is added. Hot shingles and keys are reduced in the map tasks; a component
    of more than ``group_items`` in a band is compared in blocks; nothing but a row filter of bounded size comes to the driver.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    bands = Bands(num, den)
    slim = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_KEY)).alias("id"), F.col(f"`{text}`").alias("text"))
    size = slim.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    start = written()
    profiled = profile(slim, width, max(parts_of(size), spark.sparkContext.defaultParallelism))
    each = profiled.where("kind = 0").select("id", "n", "node", "check")
    alone = profiled.where("kind = 1").select("node", F.col("n").alias("alone"))
    nodes = each.where("n > 0").groupBy("node", "check", "n").agg(F.min("id").alias("id"))
    left = nodes.join(alone, "node", "left").where(F.coalesce("alone", F.lit(0)) * num <= F.col("n") * (den - num)).select("node", "check", "n", "id")
    left = stored(left)
    some = row_filter(left.select("id"))

    def matching(batches):
        # an id may stand for several texts
        for batch in batches:
            _, node, check = fingerprints(all_sets(batch.column("text"), width))
            yield batch.filter(pa.array((node == batch.column("node").to_numpy()) & (check == batch.column("check").to_numpy())))
            trim()

    joined = slim.mapInArrow(some.passing, schema("id long, text string")).join(left, "id").select("node", "check", "n", "text")
    sets = stored(joined.mapInArrow(matching, joined.schema))
    labels = components(candidate_edges(sets, width, bands))
    linked = stored(linked_sets(sets, labels, width, bands, group_items))
    discard(spark, start + 1, keep=1)  # all but the profile and the classes
    named = nodes.join(linked, "node", "left").withColumn("component", F.coalesce("component", "node"))
    least = named.groupBy("component").agg(F.min("id").alias("component_id"))
    classes = named.join(least, "component").select("node", "check", "n", "component_id")
    out = each.join(classes, ["node", "check", "n"], "left")
    real = lambda c: F.when(F.col(c) != NULL_KEY, F.col(c))
    # an empty set is linked with nothing: its component is itself
    return out.select(real("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, real("component_id")).otherwise(real("id")).alias("component_id"))
