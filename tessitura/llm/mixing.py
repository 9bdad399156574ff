"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math
from collections.abc import Mapping
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import repeated, spare

#: Bits of a hash that make the uniform number of a document.
UNIT_BITS = 48
#: Rates up to this are summed from 0, where exp(-rate) is still a full number; larger ones from the mode.
NEAR_RATE = 700


def unit(*columns: Column | str, seed: int) -> Column:
    """A uniform number of ``UNIT_BITS`` bits from the md5 of seed and columns, which any SQL engine can repeat. Null counts as empty."""
    text = F.concat_ws("|", F.lit(str(seed)), *(F.coalesce((F.col(c) if isinstance(c, str) else c).cast("string"), F.lit("")) for c in columns))
    return (F.conv(F.substring(F.md5(text), 1, UNIT_BITS // 4), 16, 10).cast("double") + 0.5) * F.lit(2.0**-UNIT_BITS)


def poisson_steps(rate: float) -> list[float]:
    """The Poisson distribution function at 0, 1, 2, ... until it can't be told from 1 at ``UNIT_BITS`` bits."""
    if rate > NEAR_RATE:
        first, steps = poisson_window(rate)
        return [0.0] * first + steps
    steps, term, total, k = [], math.exp(-rate), 0.0, 0
    while True:
        total += term
        steps.append(min(1.0, total))
        if k > rate and term < 2.0 ** -(UNIT_BITS + 8):
            return steps
        k += 1
        term *= rate / k


def poisson_window(rate: float) -> tuple[int, list[float]]:
    """(first, the distribution function at first, first + 1, ...): what can be told from 0 and 1 at ``UNIT_BITS`` bits, for large rates.

    Terms are taken relative to that of the mode, so that none is lost; there are some 18 * sqrt(rate) of them.
    """
    mode, least = int(rate), 2.0 ** -(UNIT_BITS + 10)
    below, above, term, k = [], [], 1.0, mode
    while k > 0 and term >= least:
        term *= k / rate
        k -= 1
        below.append(term)
    first, term, k = k, 1.0, mode
    while term >= least:
        k += 1
        term *= rate / k
        above.append(term)
    sums = list(accumulate([*reversed(below), 1.0, *above]))
    return first, [x / sums[-1] for x in sums]


def rates(docs: DataFrame, weights: Mapping[str, float], *, rest: float, source: str, text: str, epochs: float) -> dict[str | None, float]:
    """Mean repetitions by source, under None those of all other sources together.

    Sizes are UTF-8 bytes over all rows. Named sources and the rest together receive ``epochs`` times the bytes of the table, in proportion
    to their weights; weights of sources that have no bytes are dealt to the others. The rows of such a source, whose texts are all null or
    empty, have the mean ``epochs``. What comes to the driver is one number for each name.
    """
    name = F.when(F.col(f"`{source}`").isin(*weights), F.col(f"`{source}`")) if weights else F.lit(None).cast("string")
    rows = docs.groupBy(name.alias("name")).agg(F.sum(F.coalesce(F.octet_length(f"`{text}`"), F.lit(0)).cast("long")).alias("size")).collect()
    sizes = {r["name"]: r["size"] for r in rows if r["size"]}
    wanted = {**weights, None: rest}
    total, share = sum(sizes.values()), sum(wanted[k] for k in sizes)
    return {r["name"]: epochs if not r["size"] else epochs * total * wanted[r["name"]] / share / r["size"] if share else 0.0 for r in rows}


def copies(source: Column, by_source: Mapping[str | None, float], at: Column) -> Column:
    """The count of a document: its Poisson distribution inverted at ``at``. Sources without a rate get 0."""

    def count(rate: float) -> Column:
        if rate <= NEAR_RATE:
            return F.size(F.filter(F.array(*map(F.lit, poisson_steps(rate))), lambda step: step <= at))
        first, steps = poisson_window(rate)
        # one literal, since a column for each step would swell the plan
        return F.lit(first) + F.size(F.filter(F.split(F.lit(",".join(map(repr, steps))), ",").cast("array<double>"), lambda step: step <= at))

    out = count(by_source[None]) if None in by_source else F.lit(0)
    for name, rate in sorted((k, v) for k, v in by_source.items() if k is not None):
        out = F.when(source.eqNullSafe(F.lit(name)), count(rate)).otherwise(out)
    return out


def mix(docs: DataFrame, weights: Mapping[str, float], *, rest: float = 0.0, key: str = "doc_id", source: str = "source", text: str = "text", epochs: float = 1.0, seed: int = 11, shuffle: bool = True, copy: str = "copy", place: str = "place") -> DataFrame:
    """Repeats each row by a Poisson count whose mean brings its source to its target weight, then shuffles all copies.

    ``weights``: target shares by source; ``rest``: that of all other sources together, a null source included. Adds ``copy`` (from 0) and
    ``place``, a uniform number by which the copies are dealt to partitions and sorted in them; columns of these names are replaced, all
    others stay. Seed, key and text alone decide the count and the places, so a rerun gives the same rows, and rows that share a key (or
    have none) but not the text are counted and dealt on their own; rows equal in both share count and places. Texts that are null or empty
    have no size but are repeated like others of their source, by ``epochs`` on average where it has no bytes at all. An empty table gives
    no rows.
    """
    by_source = rates(docs, weights, rest=rest, source=source, text=text, epochs=epochs)
    n, body = spare(docs, "n_copies"), spare(docs, "body")
    out = docs.withColumn(body, F.md5(F.coalesce(F.col(f"`{text}`"), F.lit(""))))
    out = out.withColumn(n, copies(F.col(f"`{source}`"), by_source, unit(f"`{key}`", body, seed=seed))).where(F.col(n) > 0)
    if max(by_source.values(), default=0.0) > NEAR_RATE:
        out = repeated(out, n, copy)
    else:
        out = out.withColumn(copy, F.explode(F.sequence(F.lit(0), F.col(n) - 1))).drop(n)
    out = out.withColumn(place, unit(f"`{key}`", F.col(copy), F.col(body), seed=seed + 1)).drop(body)
    return out.repartition(F.col(place)).sortWithinPartitions(place, copy) if shuffle else out
