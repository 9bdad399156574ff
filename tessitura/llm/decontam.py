"""Benchmark decontamination: a prefix-filtered join of item windows with documents."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded_batches, extended, schema, spare, stored
from .text import ALPHANUMERIC, Chunk, chunks, rolling, trim

#: Words of a prefix shingle; bytes of benchmark text in one broadcast index.
SHINGLE, BLOCK_BYTES = 3, 8 << 20


class Lookup:
    """Positions of uint64 values in a sorted array, most misses told by a bit table."""

    def __init__(self, values: np.ndarray) -> None:
        self.values = values
        self.shift = np.uint64(64 - min(22, max(10, len(values).bit_length() + 5)))
        self.bits = np.zeros(1 << (64 - int(self.shift)), dtype=bool)
        self.bits[(values >> self.shift).astype(np.int64)] = True

    def find(self, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which of ``asked`` is there, where)."""
        if not len(self.values) or not len(asked):
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        maybe = np.flatnonzero(self.bits[(asked >> self.shift).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.values, asked[maybe]), len(self.values) - 1)
        sure = self.values[at] == asked[maybe]
        return maybe[sure], at[sure]


def shingle_hashes(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(first word, hash) of the shingles of ``width`` words; widths have hashes of their own."""
    at, value = chunk.windows(width)
    return at, value ^ np.uint64(width)


@dataclass
class Windows:
    """The windows of a block of items: the hashes of all its words one behind the other, and where each window begins in them, its length and item."""

    words: np.ndarray
    begin: np.ndarray
    length: np.ndarray
    item: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, items: list[str], texts: list[str], width: int) -> Windows:
        words, begin, length, item, at = [], [], [], [], 0
        for chunk in chunks(pa.array(texts, pa.string()), ALPHANUMERIC, lower=True):
            size = np.minimum(width, chunk.counts)
            many = np.where(size > 0, chunk.counts - size + 1, 0)
            owner = np.repeat(np.arange(chunk.texts), many)
            begin.append((at + chunk.word_from[:-1])[owner] + np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many))
            length.append(size[owner].astype(np.int32))
            item.append((chunk.row + owner).astype(np.int32))
            words.append(chunk.hashes)
            at += len(chunk.hashes)
        none = np.zeros(0, dtype=np.int64)
        return cls(np.concatenate([*words, np.zeros(width, dtype=np.uint64)]), *(np.concatenate(x) if x else none for x in (begin, length, item)), items)

    def prefix_options(self) -> dict[int, np.ndarray]:
        """For each shingle width (that of the window, where it is shorter) the windows that use it."""
        used = np.minimum(self.length, SHINGLE)
        return {int(w): np.flatnonzero(used == w) for w in np.unique(used)}


@dataclass
class Index:
    """By shingle width: the prefix shingles, and for each the windows that have it as their rarest, with its place in them."""

    windows: Windows
    lookups: dict[int, tuple[Lookup, np.ndarray, np.ndarray, np.ndarray]]

    def hits(self, chunk: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first word, words, item) of each occurrence of a window inside one text."""
        found = []
        for width, (lookup, begin, window, offset) in self.lookups.items():
            at, value = shingle_hashes(chunk, width)
            which, token = lookup.find(value)
            many = begin[token + 1] - begin[token]
            entry = np.repeat(begin[token] - np.concatenate([[0], np.cumsum(many)[:-1]]), many) + np.arange(many.sum()) if len(many) else token
            start, window_at = np.repeat(at[which], many) - offset[entry], window[entry]
            text = np.repeat(chunk.text_of_word[at[which]], many) if len(which) else which
            # positional bound: the window begins in the text; length bound: enough words are left of it
            length = self.windows.length[window_at]
            fits = (start >= chunk.word_from[text]) & (start + length <= chunk.word_from[text + 1])
            start, window_at, length = start[fits], window_at[fits], length[fits]
            for k in range(int(length.max(initial=0))):
                same = (k >= length) | (chunk.hashes[np.minimum(start + k, len(chunk.hashes) - 1)] == self.windows.words[self.windows.begin[window_at] + k])
                start, window_at, length = start[same], window_at[same], length[same]
            found.append((start, length, self.windows.item[window_at]))
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, dtype=np.int64),) * 3


def corpus_counts(docs: DataFrame, text: str, tokens: dict[int, np.ndarray]) -> dict[int, np.ndarray]:
    """How often each token occurs in all texts. To the driver come sums for the tokens of one bounded block."""
    lookups = {w: Lookup(t) for w, t in tokens.items()}

    def count(batches):
        total = {w: np.zeros(len(t), dtype=np.int64) for w, t in tokens.items()}
        for batch in batches:
            for chunk in chunks(batch.column(0), ALPHANUMERIC, lower=True):
                for w, lookup in lookups.items():
                    _, at = lookup.find(shingle_hashes(chunk, w)[1])
                    total[w] += np.bincount(at, minlength=len(lookup.values))
            trim()
        for w, x in total.items():
            got = np.flatnonzero(x)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), w, dtype=np.int32)), pa.array(got), pa.array(x[got])], names=["w", "token", "n"])

    rows = docs.select(F.col(f"`{text}`")).mapInArrow(count, schema("w int, token long, n long")).groupBy("w", "token").agg(F.sum("n").alias("n")).toArrow()
    out = {w: np.zeros(len(t), dtype=np.int64) for w, t in tokens.items()}
    kind, at, n = (rows[c].to_numpy() for c in ("w", "token", "n"))
    for w in out:
        out[w][at[kind == w]] = n[kind == w]
    return out


def build_index(docs: DataFrame, text: str, windows: Windows) -> Index:
    """Orders each window's shingles by their count in the documents and keeps the rarest as its prefix: at full containment one is enough.

    A window whose prefix occurs nowhere cannot occur itself and leaves the index.
    """
    shingles = {}
    for w, rows in windows.prefix_options().items():
        count = np.maximum(windows.length[rows] - w + 1, 1)
        places = int(count.max())
        every = rolling(windows.words, w) ^ np.uint64(w)
        value = np.stack([every[np.minimum(windows.begin[rows] + p, len(every) - 1)] for p in range(places)], axis=1)
        shingles[w] = (rows, value, np.arange(places)[None, :] < count[:, None])
    tokens = {w: np.unique(value[ok]) for w, (_, value, ok) in shingles.items()}
    counts = corpus_counts(docs, text, tokens) if tokens else {}
    lookups = {}
    for w, (rows, value, ok) in shingles.items():
        place = np.searchsorted(tokens[w], value)
        seen = np.where(ok, counts[w][np.minimum(place, len(tokens[w]) - 1)], np.iinfo(np.int64).max)
        best = np.argmin(seen, axis=1)
        there = seen[np.arange(len(rows)), best] > 0
        prefix, rows, best = value[np.arange(len(rows)), best][there], rows[there], best[there]
        order = np.argsort(prefix, kind="stable")
        prefix, rows, best = prefix[order], rows[order], best[order]
        distinct, begin = np.unique(prefix, return_index=True)
        lookups[w] = (Lookup(distinct), np.append(begin, len(prefix)), rows, best)
    return Index(windows, lookups)


def item_blocks(items: DataFrame, key: str, text: str, size: int):
    """The items in blocks of about ``size`` bytes, one after the other: (ids, texts)."""
    slim = items.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("item"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("body"))
    total = slim.agg(F.coalesce(F.sum(F.octet_length("body").cast("long")), F.lit(0))).first()[0]
    count = max(1, -(-total // size))
    for k in range(count):
        rows = slim.where(F.pmod(F.xxhash64("item", "body"), F.lit(count)) == k).toArrow()
        yield rows["item"].to_pylist(), rows["body"].to_pylist()


def spans_of(first: np.ndarray, words: np.ndarray) -> list[tuple[int, int]]:
    """Overlapping or touching (first word, words) merged into (first, last + 1)."""
    out: list[list[int]] = []
    for a, n in sorted(zip(first.tolist(), words.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], a + n)
        else:
            out.append([a, a + n])
    return [(a, b) for a, b in out]


def mark_benchmark(docs: DataFrame, items: DataFrame, *, text: str = "text", item_key: str = "item_id", item_text: str = "text", width: int = 10, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Adds n_words, n_hit, item_ids (sorted) and spans (first word, end) to every document: where windows of benchmark items occur in it.

    Words: A-Z lower-cased, then runs of characters other than ASCII ones that are neither digits nor letters. A window is ``width``
    consecutive words of an item, or all of an item with fewer; an item without words, or null, has none. A document word inside any
    occurrence of a window is hit. Null texts have no words. Items that share an id count as one; a null id as the empty string. Repeated
    rows are marked alike; extra columns stay, those of the new names are replaced. Empty documents give an empty result, an empty benchmark
    hits nothing. Words are compared through 64-bit hashes, one by one over the whole window.

    The benchmark is cut into blocks of about ``block_bytes`` and each block's index, bounded by that, is broadcast. One block, as usual,
    needs no shuffle; of more, each is worked through and its broadcast freed before the next, and the rare hits are joined in the end.
    """
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    key, ids_name, found_name, marks = spare(docs, "body_key"), spare(docs, "_ids"), spare(docs, "_found"), []
    indexes = (spark.sparkContext.broadcast(build_index(docs, text, Windows.of(*block, width))) for block in item_blocks(items, item_key, item_text, block_bytes))
    index, more = next(indexes), next(indexes, None)
    ddl = "n_words long, n_hit long, item_ids array<string>, spans array<struct<first:long,end:long>>"

    def results(counts: list[int], spans: list[list[tuple[int, int]]], ids: list[list[str]]) -> list[pa.Array]:
        kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
        return [pa.array(counts, pa.int64()), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array(ids, pa.list_(pa.string())), pa.array([[{"first": a, "end": b} for a, b in s] for s in spans], kind)]

    def scan(column: pa.Array, index: Index):
        """(words of each text, {text: (spans, items)})."""
        counts, hit = [], {}
        for chunk in chunks(column, ALPHANUMERIC, lower=True):
            counts += chunk.counts.tolist()
            first, words, item = index.hits(chunk)
            where = chunk.text_of_word[first] if len(first) else first
            for t in np.unique(where).tolist():
                mine = where == t
                hit[chunk.row + t] = (spans_of(first[mine] - chunk.word_from[t], words[mine]), sorted({index.windows.items[i] for i in np.unique(item[mine]).tolist()}))
        return counts, hit

    if more is None:

        def find(batch: pa.RecordBatch) -> list[pa.Array]:
            counts, hit = scan(batch.column(text), index.value)
            return results(counts, [hit.get(i, ((), ()))[0] for i in range(len(counts))], [hit.get(i, ((), ()))[1] for i in range(len(counts))])

        return extended(docs, find, ddl)

    for one in chain((index, more), indexes):

        def find_some(batches, one=one):
            for batch in batches:
                _, hit = scan(batch.column("text"), one.value)
                at = sorted(hit)
                kind = pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(key).take(pa.array(at, pa.int64())), pa.array([hit[i][1] for i in at], pa.list_(pa.string())), pa.array([[{"first": a, "end": b} for a, b in hit[i][0]] for i in at], kind)], names=[key, "ids", "found"])

        body = docs.select(F.md5(f"`{text}`").alias(key), F.col(f"`{text}`").alias("text")).where("text is not null")
        marks.append(stored(body.mapInArrow(find_some, schema(f"{key} string, ids array<string>, found array<struct<first:long,end:long>>")).distinct()))
        one.destroy()
    union = marks[0]
    for more in marks[1:]:
        union = union.unionByName(more)
    # copies of a text have the same marks: sets of them stay small
    merged = union.groupBy(key).agg(F.array_distinct(F.flatten(F.collect_set("ids"))).alias(ids_name), F.array_distinct(F.flatten(F.collect_set("found"))).alias(found_name))
    joined = docs.withColumn(key, F.md5(f"`{text}`")).join(merged, key, "left").drop(key)

    def finish(batch: pa.RecordBatch) -> list[pa.Array]:
        counts = [n for chunk in chunks(batch.column(text), ALPHANUMERIC, lower=True) for n in chunk.counts.tolist()]
        spans = [spans_of(np.array([x["first"] for x in f]), np.array([x["end"] - x["first"] for x in f])) if f else [] for f in batch.column(found_name).to_pylist()]
        return results(counts, spans, [sorted(x or ()) for x in batch.column(ids_name).to_pylist()])

    return extended(joined, finish, ddl).drop(ids_name, found_name)
