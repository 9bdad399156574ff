"""Interval, nearest, scored, anti and positional joins. Equi keys always come first, so that none becomes a nested loop."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from operator import and_, or_

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def interval_join(points: DataFrame, intervals: DataFrame, keys: Sequence[str], point: str, start: str, end: str, *, margin: float = 0.0, width: float | None = None) -> DataFrame:
    """Pairs with ``start - margin <= point < end + margin`` and equal ``keys``.

    With ``width`` both sides also meet on a bucket of that length: an interval is repeated once for each bucket that it touches, and a join
    whose keys hold many rows stays a hash or sort-merge join on small groups. Choose it near the usual interval length.
    """
    low, high = F.col(start) - F.lit(margin), F.col(end) + F.lit(margin)
    inside = (F.col(point) >= low) & (F.col(point) < high)
    if width is None:
        return points.join(intervals, list(keys)).where(inside)
    slot = "_slot"
    left = points.withColumn(slot, F.floor(F.col(point) / F.lit(width)))
    right = intervals.where(high > low).withColumn(slot, F.explode(F.sequence(F.floor(low / F.lit(width)), F.floor(high / F.lit(width)))))
    return left.join(right, [*keys, slot]).where(inside).drop(slot)


def first_match(pairs: DataFrame, row: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """Of the pairs of each left row the first in ``order``."""
    rank = F.row_number().over(Window.partitionBy(*row).orderBy(*order))
    return pairs.withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def lookup_default(left: DataFrame, right: DataFrame, keys: Sequence[str], defaults: dict[str, object]) -> DataFrame:
    """A left lookup whose missing values get defaults."""
    out = left.join(right.select(*keys, *defaults), list(keys), "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def nearest(left: DataFrame, right: DataFrame, keys: Sequence[str], row: Sequence[str], distance: Column, tie: Sequence[str], *, within: float | None = None, kind: str = "inner") -> DataFrame:
    """Each left row with the right row of equal ``keys`` at the least ``distance``, ties by ``tie``; farther ones than ``within`` do not count.

    The least is a partial aggregation over a struct: only one candidate for each left row is shuffled.
    """
    pairs = left.join(right, list(keys)).withColumn("_distance", distance)
    if within is not None:
        pairs = pairs.where(F.col("_distance") < within)
    others = [c for c in right.columns if c not in keys]
    best = pairs.groupBy(*row).agg(F.min(F.struct("_distance", *tie, *(c for c in others if c not in tie))).alias("_best"))
    picked = best.select(*row, F.col("_best._distance").alias("distance"), *(F.col(f"_best.{c}").alias(c) for c in others))
    return left.join(picked, list(row), kind)


def scored_attach(left: DataFrame, right: DataFrame, keys: Sequence[str], row: Sequence[str], score: Column, tie: Sequence[str], *, above: float) -> DataFrame:
    """Each left row with its right row of best ``score``, if that is greater than ``above``; ties by ``tie``."""
    return nearest(left, right, keys, row, -score, tie).where(-F.col("distance") > above).withColumn("score", -F.col("distance")).drop("distance")


def nearest_on_line(left: DataFrame, right: DataFrame, keys: Sequence[str], row: Sequence[str], at: str, to: str, order: Callable[[Column, Column], list[Column]], tie: Sequence[str], *, width: float | None = None, wanted: Callable[[Column], Column] | None = None) -> DataFrame:
    """(row, tie, distance): for each ``row`` the right row of equal ``keys`` that comes first by ``order`` of (``at``, ``to``), then by ``tie``, nulls last.

    ``distance`` is the last column of ``order``, which must depend on the two numbers alone and never come earlier when ``to`` moves away from
    ``at`` on either side. So only the neighbours of ``at`` are tried, never all pairs of a key. ``wanted``, of ``distance``, names the results
    to return; what comes before a wanted one must be wanted too.

    With ``width`` a key's line is cut into slots of that length, sorted apart; neighbours beyond a slot come from a table of slots. Null, NaN
    and infinite ``to`` (four a key at most) are tried for each row. Rows whose neighbour is as near in floating point as the one behind it are
    compared with all positions of their key, and so is each null, NaN or infinite ``at`` of a key once.
    """
    keys, row = list(keys), list(row)
    here = [*keys, "_slot"]
    finite = lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False))
    slot = lambda c: F.lit(0) if width is None else F.floor(F.col(c) / F.lit(width))
    last = lambda c, w, end: F.last(c, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, end))

    def ranked(a: Column, b: Column) -> Column:
        return F.struct(*(c.alias(f"_{i}") for i, c in enumerate(order(a, b))))

    known = lambda df: df.where(F.expr(" and ".join(f"`{k}` is not null" for k in keys)))
    lefts = known(left).select(*dict.fromkeys([*keys, *row]), F.col(at).alias("_at"))
    tied = F.struct(*(c for t in tie for c in (F.col(t).isNull().alias(f"_no_{t}"), F.col(t))))
    rights = known(right).groupBy(*keys, F.col(to).alias("_to")).agg(F.min(tied).alias("_tie"))
    lefts_on, rights_on = (df.where(finite(F.col(c))).withColumn("_slot", slot(c)) for df, c in ((lefts, "_at"), (rights, "_to")))

    along, by_slot, down = Window.partitionBy(*here).orderBy("_to"), Window.partitionBy(*keys).orderBy("_slot"), Window.partitionBy(*keys).orderBy(F.desc("_slot"))
    point = F.struct("_to", F.lag("_to").over(along).alias("_prev"), F.lead("_to").over(along).alias("_next"), "_tie")
    points = rights_on.select(*here, F.col("_to").alias("_x"), point.alias("_point"))

    # the neighbours of a slot, with those behind them, and the positions off the line, for slots of either side
    held = points.groupBy(*here).agg(F.max("_point").alias("_hi"), F.min("_point").alias("_lo"))
    slots = held.unionByName(lefts_on.select(*here).distinct(), allowMissingColumns=True).groupBy(*here).agg(F.max("_hi").alias("_hi"), F.min("_lo").alias("_lo"))
    slots = slots.withColumns({"_under": last("_hi._to", by_slot, -1), "_over": last("_lo._to", down, -1)})
    ends = {c: F.when(F.col(c).isNotNull(), F.col(c).withField(f, F.coalesce(f"{c}.{f}", beyond))) for c, f, beyond in (("_hi", "_prev", "_under"), ("_lo", "_next", "_over"))}
    slots = slots.withColumns(ends).select(*here, last("_hi", by_slot, -1).alias("_lower"), last("_lo", down, -1).alias("_upper"))
    off = rights.where(~finite(F.col("_to"))).groupBy(*keys).agg(F.collect_list(F.struct("_to", "_tie")).alias("_off"))
    slots = slots.join(off, keys, "left")

    both = lefts_on.withColumns({"_x": F.col("_at"), "_left": F.lit(True)}).unionByName(points, allowMissingColumns=True)
    up, down = (Window.partitionBy(*here).orderBy(x, F.col("_point").isNull()) for x in (F.asc("_x"), F.desc("_x")))
    filled = both.select("*", last("_point", up, Window.currentRow).alias("_below"), last("_point", down, Window.currentRow).alias("_above")).where("_left")
    behind = {"_prev": F.coalesce("_below._prev", F.when(F.col("_below").isNotNull(), F.col("_lower._to")), "_lower._prev"), "_next": F.coalesce("_above._next", F.when(F.col("_above").isNotNull(), F.col("_upper._to")), "_upper._next")}
    met = filled.join(slots, here).withColumns({**behind, "_below": F.coalesce("_below", "_lower"), "_above": F.coalesce("_above", "_upper")})

    def judged(p: Column) -> Column:
        return F.struct(ranked(F.col("_at"), p["_to"]).alias("rank"), p["_tie"].alias("tie"))

    def level(near: str, beyond: str) -> Column:
        """Whether the position behind the neighbour comes no later, but for its tie."""
        alike = (x.eqNullSafe(y) for x, y in zip(order(F.col("_at"), F.col(near)), order(F.col("_at"), F.col(beyond)), strict=True))
        return F.col(beyond).isNotNull() & reduce(and_, alike)

    tries = {f"_try{i}": F.when(F.col(c).isNotNull(), judged(F.col(c))) for i, c in enumerate(("_below", "_above"))}
    tries["_try2"] = F.when(F.col("_off").isNotNull(), F.array_min(F.transform("_off", judged)))
    more = {"_more0": level("_below._to", "_prev"), "_more1": level("_above._to", "_next")}
    found = met.select(*lefts.columns, *(c.alias(n) for n, c in {**tries, **more}.items())).withColumn("_best", F.least(*tries)).where("_best is not null")
    name = f"_{len(order(F.lit(0.0), F.lit(0.0))) - 1}"
    keep = (lambda df: df) if wanted is None else (lambda df: df.where(wanted(F.col(f"_best.rank.{name}"))))
    found = keep(found).withColumn("_more", reduce(or_, (F.coalesce(F.col(f"_more{i}") & (F.col(f"_try{i}.rank") == F.col("_best.rank")), F.lit(False)) for i in range(2))))

    # the hard ones, against all positions
    judge = judged(F.struct("_to", "_tie")).alias("_best")
    level_rows = keep(found.where("_more").select(*lefts.columns).join(rights, keys).select(*row, judge))
    strange = lefts.where(~finite(F.col("_at")))
    least = keep(strange.select(*keys, "_at").distinct().join(rights, keys).select(*keys, "_at", judge).groupBy(*keys, "_at").agg(F.min("_best").alias("_best")))
    least = least.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), F.col("_at").alias("_same"), "_best")
    strange = strange.join(least, [*(F.col(k) == F.col(f"_key{i}") for i, k in enumerate(keys)), F.col("_at").eqNullSafe(F.col("_same"))])
    every = found.where("not _more").select(*row, "_best").unionByName(level_rows).unionByName(strange.select(*row, "_best"))
    out = every.groupBy(*row).agg(F.min("_best").alias("_best"))
    return out.select(*row, *(F.col(f"_best.tie.{t}").alias(t) for t in tie), F.col(f"_best.rank.{name}").alias("distance"))


def attached_having(left: DataFrame, right: DataFrame, keys: Sequence[str], row: Sequence[str], condition: Column, *, least: int) -> DataFrame:
    """The left rows with ``least`` or more partners that satisfy ``condition``, and how many (``n_attached``)."""
    return left.join(right, list(keys)).where(condition).groupBy(*row).agg(F.count("*").alias("n_attached")).where(F.col("n_attached") >= least)


def anti_within(left: DataFrame, right: DataFrame, condition: Column) -> DataFrame:
    """The left rows without a partner; ``condition`` holds the equi keys and the distance, over ``left`` and ``right`` aliases."""
    return left.alias("left").join(right.alias("right"), condition, "left_anti")


def zip_by_position(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """The i-th left row of each group with the i-th right row; the shorter side decides. Adds ``position`` from 1."""

    def numbered(df: DataFrame, order: Sequence[str]) -> DataFrame:
        return df.withColumn("position", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))

    return numbered(left, left_order).join(numbered(right, right_order), [*keys, "position"])


def override_minus_rejected(base: DataFrame, overrides: DataFrame, rejected: DataFrame, keys: Sequence[str], value: str, override: str) -> DataFrame:
    """``value`` replaced where ``overrides`` has one, without the rows whose keys are rejected."""
    kept = base.join(rejected.select(*keys).distinct(), list(keys), "left_anti")
    return kept.join(overrides.select(*keys, override), list(keys), "left").withColumn(value, F.coalesce(override, value)).drop(override)


def overlap(a: Sequence[Column], b: Sequence[Column]) -> tuple[Column, Column]:
    """(area of the intersection, intersection over union) of boxes x0, y0, x1, y1; boxes that only touch do not meet."""
    w = F.least(a[2], b[2]) - F.greatest(a[0], b[0])
    h = F.least(a[3], b[3]) - F.greatest(a[1], b[1])
    common = F.when((w > 0) & (h > 0), w * h).otherwise(F.lit(0.0))
    area = lambda x: (x[2] - x[0]) * (x[3] - x[1])
    return common, common / (area(a) + area(b) - common)


def merge_upsert(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, same: Callable[[dict, dict], bool], better: str) -> DataFrame:
    """Folds the rows of each group, in ``order``, into a list: a row takes the place of the first entry that is ``same`` if its ``better``
    is greater, goes if it is not, and is appended if there is none.

    Each step depends on all before, so a group is one task; keys must keep groups small (pages, users).
    """

    def fold(frame: pd.DataFrame) -> pd.DataFrame:
        kept: list[dict] = []
        for row in frame.sort_values(list(order), kind="stable").to_dict("records"):
            at = next((i for i, other in enumerate(kept) if same(other, row)), None)
            if at is None:
                kept.append(row)
            elif row[better] > kept[at][better]:
                kept[at] = row
        return pd.DataFrame(kept, columns=frame.columns)

    return df.groupBy(*keys).applyInPandas(fold, df.schema)


def interval_or_any(points: DataFrame, intervals: DataFrame, keys: Sequence[str], scope: Sequence[str], row: Sequence[str], point: str, start: str, end: str, order: Sequence[str]) -> DataFrame:
    """Each point with the first interval of its ``keys`` that holds it; where its ``keys`` have none at all, of all those of its ``scope``."""
    own = intervals.select(*keys).distinct()
    here = interval_join(points.join(own, list(keys), "left_semi"), intervals, keys, point, start, end)
    others = intervals.select(*scope, *(c for c in intervals.columns if c not in keys))
    far = interval_join(points.join(own, list(keys), "left_anti"), others, scope, point, start, end)
    return first_match(here.unionByName(far), row, order)


def linked_or_zipped(notes: DataFrame, glyphs: DataFrame, keys: Sequence[str], note_id: str, glyph_id: str, note_order: Sequence[str], glyph_order: Sequence[str]) -> DataFrame:
    """(keys, note id, glyph id): by equal ids where half of a group's notes or more have one, else by position, the shorter side deciding."""
    total = notes.groupBy(*keys).agg(F.count("*").alias("_n"))
    same = notes.join(glyphs, [*(notes[k] == glyphs[k] for k in keys), notes[note_id] == glyphs[glyph_id]]).select(*(notes[k] for k in keys), notes[note_id], glyphs[glyph_id])
    linked = same.groupBy(*keys).agg(F.count("*").alias("_l"))
    state = total.join(linked, list(keys), "left").select(*keys, (F.coalesce("_l", F.lit(0)) >= F.greatest(F.lit(1), F.floor(F.col("_n") * 0.5))).alias("_direct"))
    direct = same.join(state.where("_direct"), list(keys)).drop("_direct")
    zipped = zip_by_position(notes.select(*keys, note_id, *(c for c in note_order if c != note_id)), glyphs.select(*keys, glyph_id, *(c for c in glyph_order if c != glyph_id)), keys, note_order, glyph_order)
    return direct.select(*keys, note_id, glyph_id).unionByName(zipped.join(state.where("not _direct"), list(keys)).select(*keys, note_id, glyph_id))


def spanned(bars: DataFrame, members: DataFrame, keys: Sequence[str], staff: str, system: str, bar: Sequence[str], *, share: float = 0.4) -> DataFrame:
    """(keys, system, bar) of bars that cross ``share`` of a system's staves or more, at least one."""
    size = members.groupBy(*keys, system).agg(F.count("*").alias("_n"))
    met = bars.join(members, [*keys, staff]).groupBy(*keys, system, *bar).agg(F.count("*").alias("_hits"))
    return met.join(size, [*keys, system]).where(F.col("_hits") >= F.greatest(F.lit(1.0), F.col("_n") * share)).drop("_hits", "_n")
