"""Toxicity: a linear classifier over words and their beginnings whose scores must not depend on which group a text mentions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_labels
from .shared import bounded_batches, extended, schema
from .text import ALPHANUMERIC, Chunk, chunks, mix

#: Hash buckets (as bits), labelled documents learnt from, bytes of the word beginnings that count as features.
BUCKET_BITS, TRAIN_ROWS, BEGINNINGS = 20, 20_000, (4, 5, 6, 7)
#: Features of training texts that are summed at a time.
SLICE = 1 << 18

# Terms for groups of people, by kind; a counterfactual swaps a term for the others of its kind.
IDENTITY_TERMS = (
    ("women", "men", "girls", "boys", "woman", "man"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("black", "white", "asian", "latino", "arab", "african"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals", "citizens"),
    ("old", "young", "disabled", "blind", "deaf"),
)


def features(chunk: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the words of a chunk and of the beginnings of longer words, by which inflected forms share a weight."""
    found = [(np.arange(len(chunk.hashes)), chunk.hashes)]
    for size in BEGINNINGS:
        at, value = chunk.prefix_hashes(size)
        found.append((at, mix(value + np.uint64(size))))
    word, value = (np.concatenate(x) for x in zip(*found, strict=True))
    return chunk.text_of_word[word], (value >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def term_features(terms: Sequence[str]) -> list[np.ndarray]:
    """For each term its buckets: first the word, then its beginnings."""
    return [features(chunk)[1] for term in terms for chunk in chunks(pa.array([term], pa.string()), ALPHANUMERIC, lower=True)]


def distinct_features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the features of each text, each once."""
    rows, buckets = [], []
    for chunk in chunks(column, ALPHANUMERIC, lower=True):
        text, bucket = features(chunk)
        pairs = np.unique((text << BUCKET_BITS) | bucket)
        rows.append((pairs >> BUCKET_BITS) + chunk.row)
        buckets.append(pairs & ((1 << BUCKET_BITS) - 1))
    none = np.zeros(0, dtype=np.int64)
    return np.concatenate([none, *rows]), np.concatenate([none, *buckets])


@dataclass
class Linear:
    weight: np.ndarray
    bias: float

    def score(self, column: pa.Array) -> np.ndarray:
        """The sigmoid of the bias and the weights of the distinct features of each whole text."""
        heavy, scores = self.weight != 0, []
        for chunk in chunks(column, ALPHANUMERIC, lower=True):
            text, bucket = features(chunk)
            at = np.flatnonzero(heavy[bucket])
            pairs = np.unique((text[at] << BUCKET_BITS) | bucket[at])
            odds = self.bias + np.bincount(pairs >> BUCKET_BITS, weights=self.weight[pairs & ((1 << BUCKET_BITS) - 1)], minlength=chunk.texts)
            scores.append(1 / (1 + np.exp(-np.clip(odds, -500, 500))))
        return np.concatenate(scores) if scores else np.zeros(0)


def counterfactuals(has: list[list[float]], kinds: list[list[np.ndarray]], size: int) -> np.ndarray:
    """The sum of outer products of the changes that swapping identity terms makes to the ``size`` features of such terms.

    ``kinds``: by kind, the places of each term's features; ``has``: how many texts have the term. A text with a term is swapped to each other
    term of its kind, which takes away the term's word and beginnings and brings the other's.
    """
    penalty = np.zeros((size, size))
    for terms, counts in zip(kinds, has, strict=True):
        for a, count in zip(terms, counts, strict=True):
            for b in terms:
                step = np.zeros(size)
                step[a] -= 1
                step[b] += 1
                step = np.clip(step, -1, 1)
                if count and step.any():
                    penalty += count / (len(terms) - 1) * np.outer(step, step)
    return penalty


def clearness(one: np.ndarray, zero: np.ndarray, positive: int, negative: int) -> np.ndarray:
    """By how many standard errors the shares of each feature among the two labels differ."""
    total = positive + negative
    share = (one + zero) / total
    return np.abs(one / positive - zero / negative) / np.sqrt(np.maximum(share * (1 - share), 0.25 / total) * (1 / positive + 1 / negative))


@dataclass
class Presence:
    """Which features each text has: the features of text i are ``column[start[i] : start[i + 1]]``. Worked through in slices of bounded size."""

    start: np.ndarray
    column: np.ndarray
    width: int

    def slices(self):
        """(first text, end, their features, counts) of some ``SLICE`` features each."""
        at = 0
        while at < len(self.start) - 1:
            end = max(at + 1, int(np.searchsorted(self.start, self.start[at] + SLICE, side="right")) - 1)
            yield at, end, self.column[self.start[at] : self.start[end]], np.diff(self.start[at : end + 1])
            at = end

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """For each text the sum of the weights of its features."""
        return np.concatenate([np.bincount(np.repeat(np.arange(end - at), n), weights=weight[c], minlength=end - at) for at, end, c, n in self.slices()])

    def spread(self, value: np.ndarray) -> np.ndarray:
        """For each feature the sum of the values of the texts that have it."""
        out = np.zeros(self.width)
        for at, end, c, n in self.slices():
            out += np.bincount(c, weights=np.repeat(value[at:end], n), minlength=self.width)
        return out


def least(value, w: np.ndarray, *, steps: int = 500, memory: int = 6, close: float = 1e-6) -> np.ndarray:
    """Where the convex ``value`` (which gives value and gradient) is least: L-BFGS from ``w``."""
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    now, slope = value(w)
    for _ in range(steps):
        if np.abs(slope).max() < close * max(1.0, abs(now)):
            break
        way, shares = slope.copy(), []
        for s, y, sy in reversed(past):
            shares.append((s @ way) / sy)
            way -= shares[-1] * y
        way *= past[-1][2] / (past[-1][1] @ past[-1][1]) if past else 1 / max(1.0, np.linalg.norm(slope))
        for (s, y, sy), share in zip(past, reversed(shares), strict=True):
            way += s * (share - (y @ way) / sy)
        length, fall = 1.0, slope @ way
        while True:
            there = w - length * way
            then, steep = value(there)
            if then <= now - 1e-4 * length * fall or length < 1e-10:
                break
            length /= 2
        if then >= now:
            break
        s, y = there - w, steep - slope
        if s @ y > 0:
            past = [*past, (s, y, float(s @ y))][-memory:]
        w, now, slope = there, then, steep
    return w


def fit(x: Presence, label: np.ndarray, kinds: list[list[np.ndarray]], *, fairness: float, ridge: float, clear_z: float, balance: float) -> tuple[np.ndarray, float]:
    """Weights and bias of a logistic regression on all features, with a ridge and a penalty on changes between counterfactuals.

    A feature counts by the square of its clearness: from ``clear_z`` standard errors on (or as clear as the clearest, if none reaches them)
    in full, below by (z / clear_z)**2. None is left out. ``kinds``: the columns of identity terms; these count in full, so that the penalty
    can hold them together. A text of the rarer label counts as the ratio of the labels to the power ``balance``: 1 for even weights of both.
    Solved in variables in which ridge and penalty together are ``ridge`` times the identity.
    """
    positive = int(label.sum())
    one, every = x.spread(label), x.spread(np.ones(len(label)))
    z = clearness(one, every - one, positive, len(label) - positive)
    scale = np.minimum(1.0, z / max(min(clear_z, z.max(initial=0.0)), 1e-12)) ** 2
    terms = np.unique(np.concatenate([np.zeros(0, dtype=np.int64), *(t for kind in kinds for t in kind)]))
    scale[terms] = 1.0
    places = [[np.searchsorted(terms, t) for t in kind] for kind in kinds]
    penalty = counterfactuals([[float(every[t[0]]) for t in kind] for kind in kinds], places, len(terms))
    ratio = (len(label) - positive) / positive
    counts = np.where((label == 1) == (ratio > 1), max(ratio, 1 / ratio) ** balance, 1.0)
    turn = np.linalg.inv(np.linalg.cholesky(fairness / ridge * penalty + np.eye(len(terms))))

    def weights(u: np.ndarray) -> np.ndarray:
        w = scale * u[:-1]
        w[terms] = turn.T @ u[terms]
        return w

    def value(u: np.ndarray) -> tuple[float, np.ndarray]:
        odds = x.sums(weights(u)) + u[-1]
        miss = counts * (1 / (1 + np.exp(-np.clip(odds, -500, 500))) - label)
        raw = x.spread(miss)
        slope = scale * raw + ridge * u[:-1]
        slope[terms] = turn @ raw[terms] + ridge * u[terms]
        return float(counts @ np.logaddexp(0, odds) - (counts * label) @ odds + ridge / 2 * (u[:-1] @ u[:-1])), np.append(slope, miss.sum())

    u = least(value, np.append(np.zeros(x.width), np.log(positive / (len(label) - positive))))
    return weights(u), float(u[-1])


def packed(first: int, steps: np.ndarray) -> bytes:
    """Sorted buckets as their first and the steps between them, made small for the way to the task that learns."""
    return zstandard.ZstdCompressor(level=1).compress(np.concatenate([[first], steps[1:]]).astype(np.int32).tobytes()) if len(steps) else b""


def unpacked(blob: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.int32), dtype=np.int32) if blob else np.zeros(0, dtype=np.int32)


def present(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, label, n, has) of (id, label, text): how many and which features a text has."""
    for batch in batches:
        text, bucket = distinct_features(batch.column("text"))
        at = np.searchsorted(text, np.arange(batch.num_rows + 1))
        steps = np.diff(bucket, prepend=0).astype(np.int32)
        has = pa.array([packed(bucket[a] if a < b else 0, steps[a:b]) for a, b in zip(at[:-1], at[1:], strict=True)], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array(np.diff(at)), has], names=["id", "label", "n", "has"])


def learnt(texts: pa.Table, identity, **how) -> tuple[np.ndarray, float]:
    """Weights of all buckets and bias from (id, label, n, has), the same for any order of its rows; without both labels a bias alone."""
    texts = texts.sort_by("id")
    truth = texts["label"].to_numpy().astype(float)
    positive, total = int(truth.sum()), len(truth)
    weight = np.zeros(1 << BUCKET_BITS)
    if not 0 < positive < total:
        return weight, float(np.log((positive + 0.5) / (total - positive + 0.5)))
    kinds = [term_features(kind) for kind in identity]
    start = np.concatenate([[0], np.cumsum(texts["n"].to_numpy())])
    bucket = np.empty(start[-1], dtype=np.int32)
    for i, blob in enumerate(texts["has"]):
        bucket[start[i] : start[i + 1]] = unpacked(blob.as_py())
    seen = np.zeros(1 << BUCKET_BITS, dtype=bool)
    seen[bucket] = True
    seen[[b for kind in kinds for t in kind for b in t]] = True
    place = (np.cumsum(seen) - 1).astype(np.int32)
    np.take(place, bucket, out=bucket, mode="clip")
    x = Presence(start, bucket, int(seen.sum()))
    weight[seen], bias = fit(x, truth, [[place[t].astype(np.int64) for t in kind] for kind in kinds], **how)
    return weight, bias


def train(docs: DataFrame, labels: DataFrame, *, key: str, text: str, label: str, modulus: int, kept_out: int, rows: int, identity, **how) -> Linear:
    """Learns from at most ``rows`` labelled keys, those of the smallest hashes; one task has which features each has, the driver gets the weights."""
    known = training_labels(labels, key=key, label=label, modulus=modulus, kept_out=kept_out)
    sample = F.broadcast(known.orderBy(F.xxhash64("label_key"), "label_key").limit(rows))
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))
    joined = slim.join(sample, F.col("id") == F.col("label_key")).select("id", "label", "text")

    def learn(batches):
        weight, bias = learnt(pa.Table.from_batches(batches, pa.schema({"id": pa.int64(), "label": pa.int32(), "n": pa.int64(), "has": pa.binary()})), identity, **how)
        yield pa.RecordBatch.from_arrays([pa.array([bias]), pa.array([zstandard.compress(weight.tobytes())], pa.binary())], names=["bias", "weight"])

    # a key that repeats is learnt from once
    texts = joined.mapInArrow(present, schema("id long, label int, n long, has binary")).groupBy("id").agg(F.min(F.struct("label", "n", "has")).alias("r")).select("id", "r.*")
    for model in texts.repartition(1).mapInArrow(learn, schema("bias double, weight binary")).toArrow().to_pylist():
        return Linear(np.frombuffer(zstandard.decompress(model["weight"])), model["bias"])
    return Linear(np.zeros(1 << BUCKET_BITS), 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "toxic", modulus: int = 4, kept_out: int = 2, threshold: float = 0.3, rows: int = TRAIN_ROWS, identity: tuple[tuple[str, ...], ...] = IDENTITY_TERMS, fairness: float = 50.0, ridge: float = 0.5, clear_z: float = 6.5, balance: float = 0.5) -> DataFrame:
    """Adds score (0 to 1; higher: label 1 likelier), predicted (1 from ``threshold``) and held_out to every document.

    The distinct words and word beginnings of whole texts alone make a score. Learnt from labelled documents whose crc32(key as text) leaves another remainder
    than ``kept_out`` modulo ``modulus``, at most ``rows`` of them. ``fairness`` weighs how much a score may change when identity terms are
    swapped; features whose shares differ by fewer than ``clear_z`` standard errors among the labels count for less. Null and empty texts score as texts without telling words. Without usable labels all scores are even. Labels that are null or
    not 0 or 1, or have a null key, do not count; of unlike labels of one key the largest does. Repeated documents score alike. Extra
    columns stay, those of the new names are replaced. An empty table gives an empty result.
    """
    bounded_batches(docs.sparkSession)
    model = train(docs, labels, key=key, text=text, label=label, modulus=modulus, kept_out=kept_out, rows=rows, identity=identity, fairness=fairness, ridge=ridge, clear_z=clear_z, balance=balance)

    def judge(batch: pa.RecordBatch) -> list[pa.Array]:
        score = model.score(batch.column(text))
        return [pa.array(score), pa.array((score >= threshold).astype(np.int32))]

    return extended(docs, judge, "score double, predicted int").withColumn("held_out", held_out(key, modulus, kept_out))
