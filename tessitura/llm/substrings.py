"""Substring de-duplication by super-k-mers: repeated windows of words, counted exactly."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .jaccard import NULL_KEY
from .shared import bounded_batches, extended, schema, spare, stored
from .text import NOT_SPACE, Chunk, chunks, gathered, mix, powers, rolling, trim

#: Words of a minimiser; bytes of text that a map task gathers; bytes that a bucket should hold, and those that a task should; bytes of
#: unlike runs from which on a bucket is heavy.
MINIMISER, GATHER_BYTES, BUCKET_BYTES, TASK_BYTES, HEAVY_BYTES = 3, 8 << 20, 3 << 20, 96 << 20, 48 << 20


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    n, span, out = len(values) - width + 1, 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[:n], out[width - span : width - span + n])


def super_kmers(chunk: Chunk, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first word, windows, minimiser) of the runs of consecutive windows of one text that share their minimiser.

    The minimiser of a window is the least hash of ``MINIMISER`` consecutive words in it, so equal windows have equal minimisers.
    """
    m = min(MINIMISER, width)
    n = len(chunk.hashes) - width + 1
    if n <= 0:
        return (np.zeros(0, dtype=np.int64),) * 2 + (np.zeros(0, dtype=np.uint64),)
    least = sliding_least(rolling(chunk.hashes, m), width - m + 1)
    inside = chunk.text_of_word[:n] == chunk.text_of_word[width - 1 :]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | ~inside[:-1] | ~inside[1:]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, n))
    real = inside[first]
    return first[real], count[real], least[first[real]]


def run_hashes(chunk: Chunk, first: np.ndarray, words: np.ndarray) -> np.ndarray:
    """A hash of the words of each run, whatever their length."""
    n = len(chunk.hashes)
    up, down = powers(n)
    total = np.concatenate([[np.uint64(0)], np.cumsum(chunk.hashes * up[:n])])
    return mix((total[first + words] - total[first]) * down[first] + words.astype(np.uint64))


def pack(key: np.ndarray, body: np.ndarray, first: np.ndarray, count: np.ndarray, texts: list[bytes] | None) -> bytes:
    head = np.array([len(key), texts is not None], dtype=np.int64).tobytes()
    raw = head + key.tobytes() + body.astype(np.int32).tobytes() + first.astype(np.int32).tobytes() + count.astype(np.int32).tobytes()
    if texts is not None:
        raw += np.array([len(t) for t in texts], dtype=np.int32).tobytes() + b"".join(texts)
    return zstandard.ZstdCompressor(level=3).compress(raw)


def unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[bytes] | None]:
    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, has = (int(x) for x in np.frombuffer(raw, np.int64, 2))
    key = np.frombuffer(raw, np.int64, n, 16)
    body, first, count = (np.frombuffer(raw, np.int32, n, 16 + 8 * n + 4 * n * k) for k in range(3))
    if not has:
        return key, body, first, count, None
    at = np.concatenate([[0], np.cumsum(np.frombuffer(raw, np.int32, n, 16 + 20 * n).astype(np.int64))]) + 16 + 24 * n
    cuts = at.tolist()
    return key, body, first, count, [raw[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def later_copies(key: np.ndarray, body: np.ndarray, first: np.ndarray, content: tuple[np.ndarray, ...]) -> tuple[np.ndarray, np.ndarray]:
    """(rows to keep, rows that repeat a kept one from an earlier place): of equal contents the earliest stays.

    A row that another text of the same key has at the same place stays beside it; one that repeats key, text and place is neither.
    """
    order = np.lexsort((body, first, key, *content))
    key, body, first = key[order], body[order], first[order]
    new = np.ones(len(order), dtype=bool)
    new[1:] = np.logical_or.reduce([k[order][1:] != k[order][:-1] for k in content])
    source = np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))
    elsewhere = (key != key[source]) | (first != first[source])
    other_text = np.ones(len(order), dtype=bool)
    other_text[1:] = body[1:] != body[:-1]
    return order[new | (~elsewhere & other_text)], order[elsewhere]


def window_repeats(texts: list[bytes], key: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(run, first window, windows) of the windows of the runs ``texts`` that start earlier elsewhere, consecutive ones together.

    Windows are sorted by hash, then by place; those of one hash are compared word by word with the first of them.
    """
    column = pa.array(texts, pa.binary()).cast(pa.string())
    runs, starts, counts = [], [], []
    (chunk,) = chunks(column, NOT_SPACE, lower=False, limit=1 << 40)
    at, value = chunk.windows(width)
    run = chunk.text_of_word[at]
    place = first[run] + at - chunk.word_from[run]
    order = np.lexsort((place, key[run], value))
    sorted_value = value[order]
    begin = np.flatnonzero(np.concatenate([[True], sorted_value[1:] != sorted_value[:-1]])) if len(order) else order
    source = np.repeat(begin, np.diff(np.append(begin, len(order))))
    later = np.flatnonzero(source != np.arange(len(order)))
    a, b = order[later], order[source[later]]
    repeated = (key[run[a]] != key[run[b]]) | (place[a] != place[b])
    for k in range(width):
        repeated &= chunk.hashes[at[a] + k] == chunk.hashes[at[b] + k]
    hit = np.zeros(len(at), dtype=bool)
    hit[a[repeated]] = True
    got = np.flatnonzero(hit)
    if len(got):
        new = np.flatnonzero(np.concatenate([[True], (np.diff(got) != 1) | (np.diff(run[got]) != 0)]))
        runs, starts, counts = run[got[new]], place[got[new]], np.diff(np.append(new, len(got)))
    return np.asarray(runs, dtype=np.int64), np.asarray(starts, dtype=np.int64), np.asarray(counts, dtype=np.int64)


def single_windows(texts: list[bytes], width: int) -> tuple[np.ndarray, ...]:
    """(run, place in it, two hashes) of each window of the runs ``texts``."""
    (chunk,) = chunks(pa.array(texts, pa.binary()).cast(pa.string()), NOT_SPACE, lower=False, limit=1 << 40)
    at, value = chunk.windows(width)
    other = rolling(mix(chunk.hashes ^ np.uint64(0x94D049BB133111EB)), width)[at] if len(at) else value
    run = chunk.text_of_word[at]
    return run, at - chunk.word_from[run], value.view(np.int64), other.view(np.int64)


def repeated_windows(docs: DataFrame, width: int, buckets: int, tasks: int, heavy: int) -> DataFrame:
    """(key, body, first, count): windows of (key, body, text) that start earlier elsewhere, as runs of consecutive first words.

    A bucket whose unlike runs exceed ``heavy`` bytes, as of a very common minimiser, is not held: its windows go on one by one, by two
    64-bit hashes of their own, and meet in an aggregation that any number of tasks can share.
    """
    fields, out = schema("bucket long, pack binary"), schema("key long, body int, first int, count int, one long, two long")

    def deal(batches):
        for table in gathered(batches, GATHER_BYTES):
            keys, bodies = table["key"].to_numpy(), table["body"].to_numpy()
            parts = []
            for chunk in chunks(table["text"].combine_chunks(), NOT_SPACE, lower=False):
                at, count, least = super_kmers(chunk, width)
                raw, (start, end) = chunk.data.tobytes(), chunk.spans
                last = at + count + width - 2
                text = [raw[a:b] for a, b in zip(start[at].tolist(), end[last].tolist(), strict=True)]
                row = chunk.text_of_word[at] if len(at) else at
                parts.append((keys[chunk.row + row], bodies[chunk.row + row], at - chunk.word_from[row], count, least, run_hashes(chunk, at, count + width - 1), text))
            key, body, first, count, least, content = (np.concatenate([p[k] for p in parts]) for k in range(6))
            texts = [t for p in parts for t in p[6]]
            # a run that this task has already seen is known to repeat: it does not travel
            kept, again = later_copies(key, body, first, (content, least, count))
            bucket = (mix(least) % np.uint64(buckets)).astype(np.int64)
            rows = []
            for rows_of, label, with_text in ((kept, bucket, True), (again, -1 - (mix(key.view(np.uint64)) % np.uint64(max(1, buckets // 16))).astype(np.int64), False)):
                order = rows_of[np.lexsort((first[rows_of], key[rows_of], label[rows_of]))]
                named = label[order]
                cuts = np.flatnonzero(np.concatenate([[True], named[1:] != named[:-1], [True]])) if len(order) else [0]
                for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                    mine = order[a:b]
                    rows.append((int(named[a]), pack(key[mine], body[mine], first[mine], count[mine], [texts[i] for i in mine.tolist()] if with_text else None)))
            for a in range(0, len(rows), 256):
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows[a : a + 256]], pa.int64()), pa.array([r[1] for r in rows[a : a + 256]], pa.binary())], names=fields.names)

    def rows_of(key, body, first, count, one=None, two=None):
        none = pa.nulls(len(key), pa.int64())
        places = [pa.array(key), *(pa.array(x.astype(np.int32)) for x in (body, first, count))]
        return pa.RecordBatch.from_arrays([*places, none if one is None else pa.array(one), none if two is None else pa.array(two)], names=out.names)

    def singles(key, body, first, count, texts):
        """The windows of runs, one by one; in slices of bounded size."""
        ends = np.cumsum([len(t) for t in texts])
        for some in np.split(np.arange(len(texts)), np.flatnonzero(np.diff(ends // GATHER_BYTES)) + 1):
            if len(some):
                run, place, one, two = single_windows([texts[i] for i in some.tolist()], width)
                mine = some[run]
                yield rows_of(key[mine], body[mine], first[mine] + place, np.ones(len(mine)), one, two)

    def merged(held: list):
        """The runs held, equal ones once; rows for the others."""
        key, body, first, count = (np.concatenate([h[k] for h in held]) for k in range(4))
        texts = [t for h in held for t in h[4]]
        names: dict[bytes, int] = {}
        content = np.array([names.setdefault(b" ".join(t.split()), len(names)) for t in texts], dtype=np.int64)
        kept, again = later_copies(key, body, first, (content,))
        return (key[kept], body[kept], first[kept], count[kept], [texts[i] for i in kept.tolist()]), rows_of(key[again], body[again], first[again], count[again])

    def count_windows(batches):
        now, held, size, spread = None, [], 0, False

        def close():
            if held:
                one, rest = merged(held)
                yield rest
                key, body, first, count, texts = one
                run, at, many = window_repeats(texts, key, first, width)
                yield rows_of(key[run], body[run], at, many)

        for batch in batches:
            for bucket, blob in zip(batch.column("bucket").to_pylist(), batch.column("pack").to_pylist(), strict=True):
                if bucket < 0:
                    yield rows_of(*unpack(blob)[:4])
                    continue
                if bucket != now:
                    yield from close()
                    now, held, size, spread = bucket, [], 0, False
                    trim()
                got = unpack(blob)
                if spread:
                    yield from singles(*got)
                    continue
                held.append(got)
                size += sum(map(len, got[4]))
                if size > max(4 * BUCKET_BYTES, heavy):
                    one, rest = merged(held)
                    yield rest
                    held, size = [one], sum(map(len, one[4]))
                    if size > heavy // 2:
                        yield from singles(*one)
                        held, size, spread = [], 0, True
        yield from close()

    found = stored(docs.mapInArrow(deal, fields).repartition(tasks, "bucket").sortWithinPartitions("bucket").mapInArrow(count_windows, out))
    windows = found.where("one is not null").select("key", "body", "first", "one", "two")
    earliest = windows.groupBy("one", "two").agg(F.min(F.struct("key", "first")).alias("least"), F.count("*").alias("n")).where("n > 1").drop("n")
    later = windows.join(earliest, ["one", "two"]).where(F.struct("key", "first") > F.col("least")).select("key", "body", "first", F.lit(1).alias("count"))
    return found.where("one is null").select("key", "body", "first", "count").unionByName(later)


def drop_repeated_windows(docs: DataFrame, *, key: str = "doc_id", text: str = "text", width: int = 20, bucket_bytes: int = BUCKET_BYTES, heavy_bytes: int = HEAVY_BYTES) -> DataFrame:
    """Adds n_words, n_removed and kept: the words of each text without those that repeated windows cover, joined by one space.

    Words are what stands between ASCII white space, unchanged. A window is ``width`` consecutive words of one text; it repeats if its words
    also start earlier: under a smaller key, or before in a text of the same key. Every word that a repeating window covers goes; windows
    are judged on the input. A null text has no words and an empty ``kept``, as an empty one has; texts of fewer words stay whole. Rows that
    repeat both key and text are one text read twice and fare alike. A null key comes before all others. Extra columns stay, those of the
    new names are replaced. An empty table gives an empty result.

    Consecutive windows with one minimiser travel as one packed run to the minimiser's bucket. Runs that a task has seen before are dropped
    there, so a passage of many copies travels once from each task. The number of buckets and of tasks grows with the texts; a bucket of
    ``heavy_bytes`` of unlike runs is dealt on by the windows themselves, compared by 128 bits of hash instead of word by word.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_KEY)).alias("key"), F.hash(f"`{text}`").alias("body"), F.col(f"`{text}`").alias("text")).where("text is not null")
    total = slim.agg(F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()[0]
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * total // TASK_BYTES))
    repeats = repeated_windows(slim, width, max(1, 3 * total // bucket_bytes), tasks, heavy_bytes)
    k, b, held = (spare(docs, name) for name in ("_key", "_body", "_spans"))
    # written down, so that Spark knows their size and moves the texts only where there are many
    spans = stored(repeats.groupBy("key", "body").agg(F.collect_list(F.struct("first", "count")).alias(held)).select(F.col("key").alias(k), F.col("body").alias(b), held))
    joined = docs.join(spans, (F.coalesce(F.col(f"`{key}`").cast("long"), F.lit(NULL_KEY)) == F.col(k)) & (F.hash(f"`{text}`") == F.col(b)), "left").drop(k, b)

    def keep(batch: pa.RecordBatch) -> list[pa.Array]:
        spans = batch.column(held)
        size = np.where(spans.is_valid().to_numpy(zero_copy_only=False), np.diff(spans.offsets.to_numpy()), 0)
        flat = spans.flatten()
        first, count = flat.field(0).to_numpy(zero_copy_only=False).astype(np.int64), flat.field(1).to_numpy(zero_copy_only=False).astype(np.int64)
        owner = np.repeat(np.arange(batch.num_rows), size)
        total, removed, kept = [], [], []
        for chunk in chunks(batch.column(text), NOT_SPACE, lower=False):
            mine = (owner >= chunk.row) & (owner < chunk.row + chunk.texts)
            at = chunk.word_from[owner[mine] - chunk.row] + first[mine]
            words = len(chunk.spans[0])
            step = np.zeros(words + 1, dtype=np.int64)
            np.add.at(step, at, 1)
            np.add.at(step, at + count[mine] + width - 1, -1)
            stays = np.cumsum(step[:-1]) == 0
            sums = np.concatenate([[0], np.cumsum(stays)])[chunk.word_from]
            total += chunk.counts.tolist()
            removed += (chunk.counts - np.diff(sums)).tolist()
            start, end = (x[stays] for x in chunk.spans)
            # each word with one separator behind it, but none behind a text's last word
            data = chunk.data.copy()
            data[end] = 0x20
            edge = np.zeros(len(data) + 1, dtype=np.int8)
            edge[start] += 1
            edge[end + 1] -= 1
            mask = np.cumsum(edge[:-1]).astype(bool)
            some = np.flatnonzero(np.diff(sums))
            mask[end[sums[some + 1] - 1]] = False
            bytes_to = np.concatenate([[0], np.cumsum(mask)])
            edges = np.append(bytes_to[chunk.first], bytes_to[-1]).astype(np.int32)
            kept.append(pa.StringArray.from_buffers(chunk.texts, pa.py_buffer(edges.tobytes()), pa.py_buffer(data[mask].tobytes())))
        return [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.concat_arrays(kept) if kept else pa.array([], pa.string())]

    return extended(joined, keep, "n_words long, n_removed long, kept string").drop(held)
