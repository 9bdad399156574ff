"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labelled import held_out, training_labels
from .rowfilter import row_filter
from .shared import bounded_batches, extended, schema
from .text import NOT_SPACE, Chunk, chunks, trim

_NOT_NEWLINE = np.arange(256) != 0x0A
#: Classes of bytes: lower, upper, digit, beyond ASCII, sentence end, comma-like, other punctuation, space, line feed, rest.
_LOWER, _UPPER, _DIGIT, _HIGH, _END, _COMMA, _MARK, _SPACE, _FEED, _REST = range(10)
_CLASS = np.full(256, _REST, dtype=np.int64)
_CLASS[0x61:0x7B], _CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x80:] = _LOWER, _UPPER, _DIGIT, _HIGH
for _chars, _kind in ((".?", _END), (",;:'\"-", _COMMA), ("!#$%&()*+/<=>@[\\]^_`{|}~", _MARK), (" \t\r\x0b\x0c", _SPACE), ("\n", _FEED)):
    _CLASS[[ord(c) for c in _chars]] = _kind
FEATURES = ("bytes", "words", "lines", "word_bytes", "upper", "digit", "high", "end", "comma", "mark", "rest", "distinct", "top_word", "repeated_next", "long_words", "one_byte_words", "repeated_lines", "words_per_line", "longest_word", "marked_words")


def _ratio(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Shares, brought to the scale of angles, where small ones stand apart."""
    return np.arcsin(np.sqrt(np.clip(a / np.maximum(b, 1), 0, 1)))


def chunk_features(chunk: Chunk) -> np.ndarray:
    """One row of ``FEATURES`` for each text of the chunk; an empty text has zeros."""
    n = chunk.texts
    sizes = chunk.last - chunk.first
    text_of_byte = np.repeat(np.arange(n), sizes + 1)
    by_class = np.bincount(text_of_byte * 10 + _CLASS[chunk.data], minlength=n * 10).reshape(n, 10).astype(float)
    start, end = chunk.spans
    length, words, owner = end - start, chunk.counts.astype(float), chunk.text_of_word

    def per_text(flags: np.ndarray) -> np.ndarray:
        return np.bincount(owner[flags], minlength=n).astype(float)

    marked = np.cumsum(np.concatenate([[0], (_CLASS[chunk.data] == _MARK) | (_CLASS[chunk.data] == _DIGIT)]))
    same = np.zeros(len(start), dtype=bool)
    same[1:] = (chunk.hashes[1:] == chunk.hashes[:-1]) & (owner[1:] == owner[:-1])
    distinct, top = np.zeros(n), np.zeros(n)
    fed = chunk.data.copy()
    fed[chunk.last] = 0x0A
    lines = Chunk(chunk.row, fed, chunk.first, chunk.last, _NOT_NEWLINE)
    repeated = np.zeros(n)
    for k in range(n):
        own = chunk.hashes[chunk.word_from[k] : chunk.word_from[k + 1]]
        if len(own):
            own = np.sort(own)
            cuts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1], [True]]))
            distinct[k], top[k] = len(cuts) - 1, np.diff(cuts).max()
        own = lines.hashes[lines.word_from[k] : lines.word_from[k + 1]]
        repeated[k] = len(own) - len(set(own.tolist()))
    longest = np.zeros(n)
    np.maximum.at(longest, owner, length)
    letters = np.bincount(owner, weights=length, minlength=n)
    size = sizes.astype(float)
    return np.stack([
        np.log1p(size), np.log1p(words), np.log1p(lines.counts), np.log1p(letters / np.maximum(words, 1)), _ratio(by_class[:, _UPPER], size), _ratio(by_class[:, _DIGIT], size),
        _ratio(by_class[:, _HIGH], size), _ratio(by_class[:, _END], size), _ratio(by_class[:, _COMMA], size), _ratio(by_class[:, _MARK], size), _ratio(by_class[:, _REST], size),
        np.log1p(distinct) / np.maximum(np.log1p(words), 1), _ratio(top, words), _ratio(per_text(same), words), _ratio(per_text(length > 12), words), _ratio(per_text(length == 1), words),
        _ratio(repeated, lines.counts), np.log1p(words / np.maximum(lines.counts, 1)), np.log1p(longest), _ratio(per_text(marked[end] > marked[start]), words),
    ], axis=1)


def features(column: pa.Array) -> np.ndarray:
    rows = [chunk_features(c) for c in chunks(column, NOT_SPACE, lower=False)]
    return np.concatenate(rows) if rows else np.zeros((0, len(FEATURES)))


@dataclass
class Discriminant:
    """Per class: log prior, mean, and the Cholesky factor of its covariance with its inverse, both computed once."""

    centre: np.ndarray
    scale: np.ndarray
    prior: tuple[float, float]
    mean: tuple[np.ndarray, np.ndarray]
    factor: tuple[np.ndarray, np.ndarray]
    inverse: tuple[np.ndarray, np.ndarray]
    temperature: float

    @classmethod
    def fit(cls, count: np.ndarray, total: np.ndarray, square: np.ndarray, *, pooled: float, ridge: float, temperature: float, spread: float) -> Discriminant:
        """From each class' number of rows, sums and sums of outer products.

        A class' covariance is shrunk toward the pooled one by ``pooled``, then toward the identity by ``ridge``. A class without rows has
        the pooled shape at the common mean. Classes far apart have log densities that differ by hundreds, which a probability can't show:
        where the smaller divergence between them, cooled by ``temperature``, exceeds ``spread``, all odds are cooled by their ratio more.
        """
        d = total.shape[1]
        rows = max(count.sum(), 1.0)
        centre = total.sum(axis=0) / rows
        scale = np.sqrt(np.maximum(np.diag(square.sum(axis=0)) / rows - centre**2, 1e-12))
        means, scatters = [], []
        for c in (0, 1):
            n = max(count[c], 1.0)
            raw = total[c] / n if count[c] else centre
            means.append((raw - centre) / scale)
            scatters.append((square[c] - n * np.outer(raw, raw)) / np.outer(scale, scale) if count[c] else np.zeros((d, d)))
        common = (scatters[0] + scatters[1]) / max(rows - 2, 1.0)
        factors = []
        for c in (0, 1):
            own = scatters[c] / max(count[c] - 1, 1.0)
            weight = pooled if count[c] > 1 else 1.0
            mixed = (1 - weight) * own + weight * common
            factors.append(np.linalg.cholesky((1 - ridge) * mixed + ridge * np.eye(d)))
        prior = np.log((count + 1) / (count.sum() + 2))
        inverse = [np.linalg.inv(f) for f in factors]
        apart = []
        for a, b in ((0, 1), (1, 0)):
            # the divergence of two normal distributions
            logs = np.log(np.diag(factors[b])).sum() - np.log(np.diag(factors[a])).sum()
            apart.append(logs + 0.5 * (((inverse[b] @ factors[a]) ** 2).sum() + ((inverse[b] @ (means[b] - means[a])) ** 2).sum() - d))
        more = max(1.0, min(apart) / temperature / spread)
        return cls(centre, scale, (float(prior[0]) / more, float(prior[1]) / more), (means[0], means[1]), (factors[0], factors[1]), (inverse[0], inverse[1]), temperature * more)

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of class 1: half the difference of Mahalanobis distances and log determinants, cooled, plus the log prior odds."""
        z = (x - self.centre) / self.scale
        density = []
        for c in (0, 1):
            away = (z - self.mean[c]) @ self.inverse[c].T
            density.append(-0.5 * (away**2).sum(axis=1) - np.log(np.diag(self.factor[c])).sum())
        odds = (density[1] - density[0]) / self.temperature + self.prior[1] - self.prior[0]
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def moments(rows: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Number, sums and sums of outer products of ``x`` by ``label``, over all rows; a few hundred numbers come to the driver."""
    d = len(FEATURES)

    def partial(batches):
        total = np.zeros((2, 1 + d + d * d))
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, d)
            label = batch.column("label").to_numpy()
            for c in (0, 1):
                own = x[label == c]
                total[c] += np.concatenate([[len(own)], own.sum(axis=0), (own.T @ own).ravel()])
        at = np.arange(total.size)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total.ravel())], names=["at", "v"])

    got = rows.mapInArrow(partial, schema("at long, v double")).groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    flat = np.zeros(2 * (1 + d + d * d))
    flat[got["at"].to_numpy()] = got["v"].to_numpy()
    flat = flat.reshape(2, -1)
    return flat[:, 0], flat[:, 1 : 1 + d], flat[:, 1 + d :].reshape(2, d, d)


def score_quality(docs: DataFrame, labels: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "quality", modulus: int = 3, kept_out: int = 1, pooled: float = 0.15, ridge: float = 0.02, temperature: float = 2.0, spread: float = 4.0) -> DataFrame:
    """Adds score (0 to 1; higher: label 1 likelier), predicted (1 from 0.5) and held_out to every document.

    Statistics of whole texts alone make a score. The classifier is learnt from all labelled documents whose crc32(key as text) leaves
    another remainder than ``kept_out`` modulo ``modulus``; only class moments leave the executors. Null and empty texts have statistics
    of 0 and a score. Without usable labels scores are even. Labels that are null or not 0 or 1, or have a null key, do not count; of
    unlike labels of one key the largest does; repeated documents are learnt from as often as they are there, and score alike. Extra
    columns stay, those of the new names are replaced. An empty table gives an empty result. Unlabelled documents are told beforehand by
    a bit table of the labelled keys, of bounded size, and measured once only.
    """
    bounded_batches(docs.sparkSession)
    known = training_labels(labels, key=key, label=label, modulus=modulus, kept_out=kept_out)
    slim = docs.select(F.col(f"`{key}`").cast("long").alias("id"), F.col(f"`{text}`").alias("text"))

    def measure(batches):
        for batch in batches:
            x = features(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["id", "x"])
            trim()

    some = row_filter(known.select("label_key"))
    measured = slim.where("id is not null").mapInArrow(some.passing, slim.schema).mapInArrow(measure, schema("id long, x array<double>")).join(known, F.col("id") == F.col("label_key")).select("x", "label")
    model = Discriminant.fit(*moments(measured), pooled=pooled, ridge=ridge, temperature=temperature, spread=spread)

    def judge(batch: pa.RecordBatch) -> list[pa.Array]:
        score = model.score(features(batch.column(text)))
        return [pa.array(score), pa.array((score >= 0.5).astype(np.int32))]

    return extended(docs, judge, "score double, predicted int").withColumn("held_out", held_out(key, modulus, kept_out))
