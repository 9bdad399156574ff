"""The generic operators as named queries over the star-schema tables, each with SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, ids, pitch, scores, ticks
from ..operators import aggregate as agg
from ..operators import decode, joins, select
from ..operators import sequence as seq

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if sql:
            SQL[function.__name__] = sql
        return function

    return register


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with ``sec``, seconds since the epoch of the wall-clock time."""
    return read(spark, sf_dir, "events").withColumn("sec", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)


def r6(c: Column | str) -> Column:
    return F.round(c, 6)


EV = "events_sec as (select *, epoch_us(ts) / 1e6 as sec from events)"


@query("""select l_orderkey, round(sum(case when l_returnflag = 'R' then 0 else l_quantity end), 6) as actual, max(o_totalprice) / 1000 as expected,
case when round(sum(case when l_returnflag = 'R' then 0 else l_quantity end), 6) > max(o_totalprice) / 1000 then 'OVER' when round(sum(case when l_returnflag = 'R' then 0 else l_quantity end), 6) < max(o_totalprice) / 1000 then 'UNDER' else 'OK' end as status
from lineitem join orders on l_orderkey = o_orderkey group by 1""")
def balance_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order, returned lines counting nothing, against a budget."""
    joined = read(spark, sf_dir, "lineitem").join(read(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    amount = F.when(F.col("l_returnflag") == "R", 0.0).otherwise(F.col("l_quantity"))
    return agg.balance(joined, ["l_orderkey"], amount, F.col("o_totalprice") / 1000).withColumn("actual", r6("actual"))


@query("""select event_type, count(*) filter (value >= 60) as positive, count(*) filter (value >= 25 and value < 60) as uncertain, count(*) filter (value < 25) as reject from events group by 1""")
def triage_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.label_counts(read(spark, sf_dir, "events"), ["event_type"], select.triage(F.col("value"), 60, 25), ["positive", "uncertain", "reject"])


@query("""select p_partkey, round(case when p_size <= 5 or p_size >= 45 then 0 when p_size < 15 then (p_size - 5) / 10.0::double when p_size <= 30 then 1 else (45 - p_size) / 15.0::double end, 6) as score from part""")
def trapezoid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select("p_partkey", r6(scores.trapezoid(F.col("p_size"), 5, 15, 30, 45)).alias("score"))


@query("""with s as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  case when l_quantity <= 0 or l_quantity >= 60 then 0 when l_quantity < 10 then l_quantity / 10 when l_quantity <= 40 then 1 else (60 - l_quantity) / 20 end as a,
  case when l_discount <= -0.01 or l_discount >= 0.12 then 0 when l_discount < 0.02 then (l_discount + 0.01) / 0.03 when l_discount <= 0.06 then 1 else (0.12 - l_discount) / 0.06 end as b from lineitem)
select l_partkey, count(*) as n, round(sum(greatest(0, least(1, (0.6 * a + 0.4 * b) * 0.82 + 0.18 * 0.5))), 4) as confidence from s group by 1""")
def weighted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    q, d = F.col("l_quantity"), F.col("l_discount")
    mixed = scores.weighted([(0.6, scores.trapezoid(q, 0, 10, 40, 60)), (0.4, scores.trapezoid(d, -0.01, 0.02, 0.06, 0.12))], keep=0.82, prior=0.5)
    return read(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("n"), F.round(F.sum(mixed), 4).alias("confidence"))


@query("""select l_returnflag, count(*) as n, round(sum(l_extendedprice), 2) as price from lineitem where l_quantity between 5 and 30 and l_extendedprice between 2000 and 40000 and l_discount between 0.02 and 0.08 group by 1""")
def size_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = select.size_window(read(spark, sf_dir, "lineitem"), {"l_quantity": (5, 30), "l_extendedprice": (2000, 40000), "l_discount": (0.02, 0.08)})
    return kept.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query("""with m as (select l_suppkey, median(l_extendedprice) as m, count(l_extendedprice) as c from lineitem group by 1)
select l_suppkey, count(*) as n, round(sum(l_extendedprice), 2) as price from lineitem join m using (l_suppkey) where c < 5 or l_extendedprice between 0.35 * m and 1.65 * m group by 1""")
def median_relative(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = select.near_median(read(spark, sf_dir, "lineitem"), ["l_suppkey"], "l_extendedprice")
    return kept.groupBy("l_suppkey").agg(F.count("*").alias("n"), F.round(F.sum("l_extendedprice"), 2).alias("price"))


@query(f"""with {EV}, g as (select event_id, user_id, sec - lag(sec) over w as back, lead(sec) over w - sec as ahead from events_sec window w as (partition by user_id order by ts, event_id)),
m as (select user_id, median(back) as m from g group by 1), f as (select g.*, coalesce(back <= 2 * m, false) or coalesce(ahead <= 2 * m, false) as near from g join m using (user_id)),
s as (select *, sum(case when near then 1 else 0 end) over (partition by user_id) as n from f) select event_id, user_id from s where near or n < 5""")
def isolated_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.not_isolated(timed_events(spark, sf_dir), ["user_id"], F.col("sec"), ["ts", "event_id"]).select("event_id", "user_id")


@query(f"""with {EV}, s as (select event_id, user_id, row_number() over w as span_number, lead(sec) over w - sec as span from events_sec window w as (partition by user_id order by ts, event_id))
select event_id, user_id, span_number, round(span, 6) as span from s where span >= 60""")
def min_span_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = select.numbered_spans(timed_events(spark, sf_dir), ["user_id"], F.col("sec"), ["ts", "event_id"], least=60)
    return spans.select("event_id", "user_id", F.col("span_number").cast("long").alias("span_number"), r6("span").alias("span"))


BANDS = [("F", 0.0, 100000.0), ("F", 100000.0, 250000.0), ("O", 0.0, 150000.0), ("O", 150000.0, 600000.0), ("P", 0.0, 300000.0)]
BANDS_SQL = "bands(o_orderstatus, lo, hi) as (values " + ", ".join(f"('{s}', {a}::double, {b}::double)" for s, a, b in BANDS) + ")"


def bands(spark: SparkSession) -> DataFrame:
    return F.broadcast(spark.createDataFrame(BANDS, "o_orderstatus string, lo double, hi double"))


@query(f"with {BANDS_SQL} select o_orderkey, lo, hi from orders join bands using (o_orderstatus) where o_totalprice >= lo and o_totalprice < hi")
def interval_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = joins.interval_join(read(spark, sf_dir, "orders"), bands(spark), ["o_orderstatus"], "o_totalprice", "lo", "hi")
    return joins.first_match(pairs, ["o_orderkey"], ["lo"]).select("o_orderkey", "lo", "hi")


@query(f"with {BANDS_SQL} select o_orderkey, lo, hi from orders join bands using (o_orderstatus) where o_totalprice >= lo - 5000 and o_totalprice < hi + 5000")
def interval_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.interval_join(read(spark, sf_dir, "orders"), bands(spark), ["o_orderstatus"], "o_totalprice", "lo", "hi", margin=5000).select("o_orderkey", "lo", "hi")


@query(f"""with {EV}, e as (select user_id, event_id as span_id, sec as a, sec + 600 as b from events_sec where event_type = 'purchase')
select p.event_id, e.span_id from events_sec p join e on p.user_id = e.user_id and p.sec >= a and p.sec < b where p.event_type = 'click'""")
def interval_bucketed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks in the ten minutes after a purchase, met on time buckets."""
    events = timed_events(spark, sf_dir)
    spans = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("span_id"), F.col("sec").alias("a"), (F.col("sec") + 600).alias("b"))
    clicks = events.where("event_type = 'click'").select("user_id", "event_id", "sec")
    return joins.interval_join(clicks, spans, ["user_id"], "sec", "a", "b", width=600.0).select("event_id", "span_id")


@query("select d.doc_id, d.lang, coalesce(l.quality, -1) as quality, coalesce(l.toxic, -1) as toxic from documents d left join labels l using (doc_id)")
def lookup_default(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "lang")
    return joins.lookup_default(docs, read(spark, sf_dir, "labels"), ["doc_id"], {"quality": -1, "toxic": -1})


NEAREST = """select {cols} from (select *, row_number() over (partition by c_custkey order by {order}) as rn from customer join supplier on c_nationkey = s_nationkey) where rn = 1"""


#: About a twentieth of the range of account balances.
ACCOUNT_SLOT = 500.0


def accounts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    left = read(spark, sf_dir, "customer").select("c_custkey", "c_acctbal", F.col("c_nationkey").alias("nation"))
    return left, read(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal", F.col("s_nationkey").alias("nation"))


@query(NEAREST.format(cols="c_custkey, s_suppkey, round(abs(c_acctbal - s_acctbal), 6) as distance", order="abs(c_acctbal - s_acctbal), s_suppkey"))
def nearest_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = accounts(spark, sf_dir)

    def order(a: Column, b: Column) -> list[Column]:
        return [F.abs(a - b).isNull(), F.abs(a - b)]

    found = joins.nearest_on_line(left, right, ["nation"], ["c_custkey"], "c_acctbal", "s_acctbal", order, ["s_suppkey"], width=ACCOUNT_SLOT)
    return found.select("c_custkey", "s_suppkey", r6("distance").alias("distance"))


@query("""with p as (select c_custkey, s_suppkey, 2 * exp(-abs(c_acctbal - s_acctbal) / 500) - case when s_acctbal < c_acctbal then 0.25 else 0 end as score from customer join supplier on c_nationkey = s_nationkey)
select c_custkey, s_suppkey, round(score, 6) as score from (select *, row_number() over (partition by c_custkey order by score desc, s_suppkey) as rn from p) where rn = 1 and score > 0.5""")
def scored_attach(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = accounts(spark, sf_dir)

    def order(a: Column, b: Column) -> list[Column]:
        score = 2 * F.exp(-F.abs(a - b) / 500) - F.when(b < a, 0.25).otherwise(0.0)
        return [score.isNull(), ~F.isnan(score), -score]

    found = joins.nearest_on_line(left, right, ["nation"], ["c_custkey"], "c_acctbal", "s_acctbal", order, ["s_suppkey"], width=ACCOUNT_SLOT, wanted=lambda distance: -distance > 0.5)
    return found.select("c_custkey", "s_suppkey", r6(-F.col("distance")).alias("score"))


@query(f"""with {EV} select e.event_id, count(*) as n_attached from events_sec e join events_sec o on e.user_id = o.user_id and o.event_id <> e.event_id and abs(o.sec - e.sec) <= 300
where e.event_type = 'error' group by 1 having count(*) >= 2""")
def band_attach_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed_events(spark, sf_dir)
    left = events.where("event_type = 'error'").select("user_id", "event_id", "sec")
    right = events.select("user_id", F.col("event_id").alias("other"), F.col("sec").alias("other_sec"))
    near = (F.col("other") != F.col("event_id")) & (F.abs(F.col("other_sec") - F.col("sec")) <= 300)
    return joins.attached_having(left, right, ["user_id"], ["event_id"], near, least=2)


@query(f"""with {EV} select event_id, user_id from events_sec a where not exists (select 1 from events_sec b where a.user_id = b.user_id and a.event_type <> b.event_type and abs(a.sec - b.sec) < 600)""")
def anti_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed_events(spark, sf_dir).select("event_id", "user_id", "event_type", "sec")
    near = (F.col("left.user_id") == F.col("right.user_id")) & (F.col("left.event_type") != F.col("right.event_type")) & (F.abs(F.col("left.sec") - F.col("right.sec")) < 600)
    return joins.anti_within(events, events, near).select("event_id", "user_id")


@query("""with k as (select *, round_even(value, 0) as v from events) select event_id, v from k a where event_type = 'click' and not exists (select 1 from k b where b.event_type = 'purchase' and a.user_id = b.user_id and a.v = b.v)""")
def key_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("v", F.bround("value", 0))
    seen = events.where("event_type = 'purchase'").select("user_id", "v").distinct()
    return events.where("event_type = 'click'").join(seen, ["user_id", "v"], "left_anti").select("event_id", "v")


@query(f"""with {EV} select a.event_id as first_id, b.event_id as second_id from events_sec a join events_sec b on a.user_id = b.user_id and a.event_id < b.event_id and abs(a.sec - b.sec) <= 60 and abs(a.value - b.value) <= 5""")
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = timed_events(spark, sf_dir).select("user_id", F.col("event_id").alias("first_id"), F.col("sec").alias("a_sec"), F.col("value").alias("a_value"))
    b = timed_events(spark, sf_dir).select("user_id", F.col("event_id").alias("second_id"), F.col("sec").alias("b_sec"), F.col("value").alias("b_value"))
    return a.join(b, "user_id").where("first_id < second_id and abs(a_sec - b_sec) <= 60 and abs(a_value - b_value) <= 5").select("first_id", "second_id")


@query()
def fuzzy_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequential upsert of a user's events: near in time and of one type, the larger value stays."""
    events = timed_events(spark, sf_dir).select("user_id", "event_id", "event_type", "sec", "value")
    return joins.merge_upsert(events, ["user_id"], ["sec", "event_id"], same=lambda kept, row: kept["event_type"] == row["event_type"] and abs(kept["sec"] - row["sec"]) <= 3600, better="value")


@query(f"""with {EV} select e.event_id, coalesce(n.value, 1) as inherited from events_sec e left join (select a.event_id, b.value, row_number() over (partition by a.event_id order by abs(a.sec - b.sec), b.event_id) as rn
from events_sec a join events_sec b on a.user_id = b.user_id and b.event_type = 'purchase' and abs(a.sec - b.sec) < 3000 where a.event_type = 'view') n on n.event_id = e.event_id and rn = 1 where e.event_type = 'view'""")
def nearest_inherit(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed_events(spark, sf_dir)
    views = events.where("event_type = 'view'").select("user_id", "event_id", "sec")
    buys = events.where("event_type = 'purchase'").select("user_id", F.col("event_id").alias("buy"), F.col("sec").alias("buy_sec"), F.col("value").alias("inherited"))
    near = joins.nearest(views, buys, ["user_id"], ["event_id"], F.abs(F.col("sec") - F.col("buy_sec")), ["buy"], within=3000, kind="left")
    return near.select("event_id", F.coalesce("inherited", F.lit(1.0)).alias("inherited"))


@query("""with n as (select *, row_number() over (partition by user_id, event_type order by ts, event_id) as position from events where event_type in ('click', 'purchase'))
select a.user_id, position, a.event_id as click_id, b.event_id as purchase_id from n a join n b using (user_id, position) where a.event_type = 'click' and b.event_type = 'purchase'""")
def zip_by_position(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    left = events.where("event_type = 'click'").select("user_id", "ts", F.col("event_id").alias("click_id"))
    right = events.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("buy_ts"), F.col("event_id").alias("purchase_id"))
    return joins.zip_by_position(left, right, ["user_id"], ["ts", "click_id"], ["buy_ts", "purchase_id"]).select("user_id", F.col("position").cast("long").alias("position"), "click_id", "purchase_id")


@query("""with o as (select o_orderkey, max(l_quantity) as q from orders join lineitem on o_orderkey = l_orderkey where l_returnflag = 'A' group by 1), r as (select distinct l_orderkey as o_orderkey from lineitem where l_quantity = 1)
select o_orderkey, round(coalesce(q, o_totalprice), 6) as amount from orders left join o using (o_orderkey) where not exists (select 1 from r where r.o_orderkey = orders.o_orderkey)""")
def override_minus_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey")
    overrides = lines.where("l_returnflag = 'A'").groupBy("o_orderkey").agg(F.max("l_quantity").alias("q"))
    base = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("amount"))
    return joins.override_minus_rejected(base, overrides, lines.where("l_quantity = 1"), ["o_orderkey"], "amount", "q").select("o_orderkey", r6("amount").alias("amount"))


@query("""with t as (select user_id, count(*) filter (event_type = 'click') as target from events group by 1), g as (select unnest(range(0, 101))::int as threshold),
p as (select g.threshold, t.user_id, t.target, count(*) filter (e.value >= g.threshold * 5) as n from events e join t using (user_id) cross join g group by all),
s as (select threshold, avg(abs(n - target)) as mae, abs(sum(n) - sum(target))::bigint as off from p group by 1) select threshold, round(mae, 6) as mae, off from s order by s.mae, off, threshold desc limit 1""")
def threshold_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold whose counts per user come closest to a target. One histogram pass; the grid never meets the rows."""
    events = read(spark, sf_dir, "events")
    targets = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("target"))
    grid = decode.threshold_counts(events, ["user_id"], F.col("value"), [5.0 * t for t in range(101)])
    errors = grid.join(targets, "user_id").groupBy("step").agg(F.avg(F.abs(F.col("n") - F.col("target"))).alias("mae"), F.abs(F.sum("n") - F.sum("target")).alias("off"))
    best = select.best_row(errors, ["mae", "off", F.col("step").desc()])
    return best.select(F.col("step").alias("threshold"), r6("mae").alias("mae"), "off")


@query("""with l as (select user_id, event_id, event_type, lead(event_type) over w as next_type, lead(event_id) over w as next_id from events window w as (partition by user_id order by ts, event_id))
select user_id, event_id as click_id, next_id as purchase_id from l where event_type = 'click' and next_type = 'purchase'""")
def lead_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    pairs = read(spark, sf_dir, "events").withColumn("next_type", F.lead("event_type").over(w)).withColumn("purchase_id", F.lead("event_id").over(w))
    return pairs.where("event_type = 'click' and next_type = 'purchase'").select("user_id", F.col("event_id").alias("click_id"), "purchase_id")


@query("""with b as (select l_orderkey, l_partkey, l_linenumber, l_quantity as x0, l_quantity + 10 as x1, l_discount * 100 as y0, l_discount * 100 + 3 as y1 from lineitem),
p as (select a.l_orderkey, greatest(0, least(a.x1, c.x1) - greatest(a.x0, c.x0)) as w, greatest(0, least(a.y1, c.y1) - greatest(a.y0, c.y0)) as h from b a join b c on a.l_orderkey = c.l_orderkey and a.l_linenumber < c.l_linenumber)
select l_orderkey, count(*) as pairs, round(sum(w * h / (60 - w * h)), 4) as iou from p group by 1""")
def box_overlap_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem")
    box = geometry.box(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_quantity") + 10, F.col("l_discount") * 100 + 3)
    a = lines.select("l_orderkey", F.col("l_linenumber").alias("i"), box.alias("a"))
    b = lines.select("l_orderkey", F.col("l_linenumber").alias("j"), box.alias("b"))
    pairs = a.join(b, "l_orderkey").where("i < j")
    return pairs.groupBy("l_orderkey").agg(F.count("*").alias("pairs"), F.round(F.sum(geometry.iou(F.col("a"), F.col("b"))), 4).alias("iou"))


@query("select l_orderkey, list_reduce(list_sort(list(distinct l_linenumber))::bigint[], lambda a, b: lcm(a, b))::bigint as multiple from lineitem group by 1")
def lcm_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_linenumber")).alias("v")).select("l_orderkey", agg.lcm_of(F.col("v")).alias("multiple"))


@query("""select user_id, count(*) as total, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type = 'click') as warnings, count(*) filter (event_type = 'view') as info,
bool_or(event_type = 'error') as has_errors, bool_or(event_type = 'click') as has_warnings from events group by 1""")
def severity_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    severity = F.when(kind == "error", "error").when(kind == "click", "warning").when(kind == "view", "info").otherwise("none")
    return agg.severity_summary(read(spark, sf_dir, "events"), ["user_id"], severity)


@query("""with t as (select distinct event_type from events), u as (select distinct user_id from events) select user_id, event_type, count(event_id) as n from u cross join t left join events using (user_id, event_type) group by 1, 2""")
def histogram_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    return agg.histogram_zero(events, ["user_id"], events.select("event_type").distinct(), ["event_type"])


@query("""with m as (select event_type, median(value) as m from events group by 1), d as (select event_type, any_value(m) as median, median(abs(value - m)) as mad from events join m using (event_type) group by 1),
t as (select *, greatest(10, median - 1.5 * greatest(1.4826 * mad, 5)) as threshold from d)
select event_type, round(any_value(median), 6) as median, round(any_value(mad), 6) as mad, count(*) filter (value < threshold) as n_below from events join t using (event_type) group by 1""")
def mad_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    level = agg.mad_threshold(events, ["event_type"], "value")
    return events.join(F.broadcast(level), "event_type").groupBy("event_type").agg(r6(F.first("median")).alias("median"), r6(F.first("mad")).alias("mad"), F.count_if(F.col("value") < F.col("threshold")).alias("n_below"))


HOURS = "h as (select (floor(epoch_us(ts) / 3600e6))::bigint as hour, count(*) as n from events group by 1)"


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return timed_events(spark, sf_dir).groupBy(F.floor(F.col("sec") / 3600).alias("hour")).agg(F.count("*").alias("n"))


@query(f"with {HOURS} select hour, n from h where n >= (select avg(n) + 1.2 * stddev_pop(n) from h)")
def peak_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.peaks(hourly(spark, sf_dir), "n").select("hour", "n")


@query(f"""with {EV}, g as (select user_id, sec - lag(sec) over (partition by user_id order by ts, event_id) as gap from events_sec) select user_id, round(quantile_cont(gap, 0.25), 4) as p25 from g group by 1""")
def gap_p25(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    gap = F.col("sec") - F.lag("sec").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return timed_events(spark, sf_dir).withColumn("gap", gap).groupBy("user_id").agg(F.round(F.percentile("gap", 0.25), 4).alias("p25"))


@query("select l_suppkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 4) as price, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) as discount from lineitem group by 1")
def weighted_centroid(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.weighted_centroid(read(spark, sf_dir, "lineitem"), ["l_suppkey"], {"price": "l_extendedprice", "discount": "l_discount"}, "l_quantity")
    return out.select("l_suppkey", F.round("price", 4).alias("price"), r6("discount").alias("discount"))


@query("""with c as (select user_id, event_type, count(*) as votes, min(event_id) as f from events group by 1, 2) select user_id, event_type, votes from (select *, row_number() over (partition by user_id order by votes desc, f) as rn from c) where rn = 1""")
def majority_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.majority_vote(read(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


COUNTS = "c as (select user_id, count(*) filter (value >= 120) as p, count(*) filter (event_type = 'click') as g from events group by 1)"


def per_user_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("value") >= 120).alias("p"), F.count_if(F.col("event_type") == "click").alias("g"))


@query(f"with {COUNTS} select count(*) as n, count(*) filter (p = g) as exact, round(avg(abs(p - g)), 6) as mae, sum(p)::bigint as total_predicted, sum(g)::bigint as total_target, count(*) filter (p < g) as infeasible from c")
def eval_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.count_errors(per_user_counts(spark, sf_dir), F.col("p"), F.col("g")).withColumn("mae", r6("mae"))


@query(f"""with {COUNTS}, s as (select case when p > 0 then least(p, g) / p::double else 0 end as a, case when g > 0 then least(p, g) / g::double else 0 end as b from c)
select round(avg(a), 6) as precision, round(avg(b), 6) as recall, round(avg(case when a + b > 0 then 2 * a * b / (a + b) else 0 end), 6) as f1 from s""")
def prf_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = agg.precision_recall(per_user_counts(spark, sf_dir), F.col("p"), F.col("g"))
    return out.select(*(r6(c).alias(c) for c in out.columns))


@query("""with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) as i from events), n as (select user_id from e group by 1 having count(*) >= 6),
s as (select a.user_id, k, avg(case when a.event_type = b.event_type then 1.0::double else 0 end) as share from e a join n using (user_id) cross join (values (4), (3), (2)) t(k) join e b on a.user_id = b.user_id and b.i = a.i + k group by 1, 2)
select user_id, k as best_lag, round(share, 6) as best_share from (select *, row_number() over (partition by user_id order by share desc, k desc) as rn from s) where rn = 1 and share > 0.2""")
def periodicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seq.periodicity(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type", [4, 3, 2], above=0.2)
    return out.withColumn("best_share", r6("best_share"))


@query("select l_suppkey, bool_and(l_discount <= 0.09) as all_valid, bool_or(l_discount <= 0.09) as any_valid, count(*) filter (l_discount <= 0.09) as n_valid, round(count(*) filter (l_discount <= 0.09) / count(*)::double, 4) as rate from lineitem group by 1")
def validity_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agg.validity(read(spark, sf_dir, "lineitem"), ["l_suppkey"], F.col("l_discount") <= 0.09)


@query("select event_id, last_value(case when event_type = 'purchase' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as carried from events")
def carry_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.when(F.col("event_type") == "purchase", F.col("value"))
    return seq.carry_forward(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], value, "carried").select("event_id", "carried")


@query(f"""with {EV}, b as (select *, case when sec - lag(sec) over w <= 1800 then 0 else 1 end as new from events_sec window w as (partition by user_id order by ts, event_id)),
c as (select *, sum(new) over (partition by user_id order by ts, event_id) as cluster from b)
select user_id, cluster::bigint as cluster, count(*) as n, round(max(sec) - min(sec), 6) as length, round(median(value), 6) as median from c group by 1, 2""")
def gap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    clusters = seq.gap_clusters(timed_events(spark, sf_dir), ["user_id"], ["ts", "event_id"], F.col("sec"), 1800)
    return clusters.groupBy("user_id", "cluster").agg(F.count("*").alias("n"), r6(F.max("sec") - F.min("sec")).alias("length"), r6(F.median("value")).alias("median"))


@query("""with e as (select user_id, event_type, row_number() over (partition by user_id order by ts, event_id) - row_number() over (partition by user_id, event_type order by ts, event_id) as g from events)
select user_id, max(n) as longest from (select user_id, event_type, g, count(*) as n from e group by all) group by 1""")
def longest_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = seq.runs(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], "event_type")
    return runs.groupBy("user_id", "run").agg(F.count("*").alias("n")).groupBy("user_id").agg(F.max("n").alias("longest"))


KERNEL = [0.006, 0.061, 0.242, 0.382, 0.242, 0.061, 0.006]


@query("with h as (select user_id, (floor(epoch_us(ts) / 3600e6))::bigint as hour, count(*) as n from events group by 1, 2) select user_id, hour, round(" + " + ".join(f"coalesce({'lag' if k > 0 else 'lead'}(n, {abs(k)}) over w, 0) * {KERNEL[3 + k]}::double" for k in range(-3, 4)) + ", 6) as smoothed from h window w as (partition by user_id order by hour)")
def gaussian_smooth(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = timed_events(spark, sf_dir).groupBy("user_id", F.floor(F.col("sec") / 3600).alias("hour")).agg(F.count("*").alias("n"))
    return seq.smooth(counts, ["user_id"], ["hour"], "n", KERNEL, "smoothed").select("user_id", "hour", r6("smoothed").alias("smoothed"))


@query("""with h as (select distinct user_id, (floor(epoch_us(ts) / 3600e6))::bigint as hour from events), g as (select *, lead(hour) over (partition by user_id order by hour) - hour as gap from h)
select user_id, hour::double as hour, false as filled from g union all select user_id, hour + gap / 2.0::double, true from g where gap > 1.5 * 4 and gap <= 2.5 * 4""")
def interpolate_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    hours = timed_events(spark, sf_dir).select("user_id", F.floor(F.col("sec") / 3600).alias("hour")).distinct()
    return seq.fill_gaps(hours, ["user_id"], ["hour"], "hour", F.lit(4.0))


@query("""with l as (select o_orderkey, o_custkey, o_totalprice, lag(o_totalprice) over (partition by o_custkey order by o_orderdate, o_orderkey) as previous from orders) select o_orderkey, o_totalprice, previous from l where o_totalprice <= previous""")
def monotonic_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return seq.not_increasing(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice").select("o_orderkey", "o_totalprice", "previous")


@query("""with r as (select event_id, round_even(value, 0) as v, row_number() over (partition by user_id, round_even(value, 0) order by ts, event_id) as occurrence from events) select event_id, occurrence from r where occurrence > 1""")
def first_seen_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("v", F.bround("value", 0))
    return seq.repeats(events, ["user_id", "v"], ["ts", "event_id"]).select("event_id", F.col("occurrence").cast("long").alias("occurrence"))


@query("""select o_orderkey, round(coalesce(sum(o_totalprice) over (w rows between unbounded preceding and 1 preceding), 0) / sum(o_totalprice) over (partition by o_custkey), 6) as onset from orders window w as (partition by o_custkey order by o_orderdate, o_orderkey)""")
def prefix_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = seq.prefix_fraction(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_totalprice", "onset")
    return out.select("o_orderkey", r6("onset").alias("onset"))


@query("""with v as (select *, case event_type when 'click' then 1 when 'purchase' then -1 when 'view' then 0 end as s from events),
a as (select *, coalesce(sum(s) over w, 0) as t from v window w as (partition by user_id order by ts, event_id rows between unbounded preceding and current row)),
d as (select *, t - least(0, min(t) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row)) as depth from a)
select event_id, depth::bigint as depth, coalesce(s <= 0 and coalesce(lag(depth) over (partition by user_id order by ts, event_id), 0) <= 0, false) as unopened from d""")
def bracket_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    step = F.when(kind == "click", 1).when(kind == "purchase", -1).when(kind == "view", 0)
    return seq.bracket_depth(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], step).select("event_id", "depth", "unopened")


@query("""with m as (select event_id, user_id, ts, event_id % 4 as item, event_type in ('click', 'signup') as st, event_type in ('purchase', 'signup') as sp, event_type = 'view' as kp from events),
k as (select *, case when kp then null when st then 1 when sp then 0 end as mk from m),
o as (select *, coalesce(last_value(mk ignore nulls) over (partition by user_id, item order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as ob from k),
d as (select *, coalesce(sum(coalesce(mk, ob) - ob) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as openv from o)
select event_id, ob::int as was_open, openv::bigint as open_in_scope, case when kp and (st or sp) then 'INVALID' when kp and ob = 0 then 'CONTINUE_WITHOUT_START' when not kp and sp and ob = 0 then case when openv > 0 then 'STOP_PITCH_MISMATCH' else 'STOP_WITHOUT_START' end
when not kp and st and not sp and ob = 1 then 'START_WHILE_OPEN' end as code from d""")
def set_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    events = read(spark, sf_dir, "events").withColumn("item", F.col("event_id") % 4)
    out = seq.set_state(events, ["user_id"], ["item"], ["ts", "event_id"], kind.isin("click", "signup"), kind.isin("purchase", "signup"), kind == "view")
    return out.select("event_id", "was_open", "open_in_scope", "code")


@query("""with a as (select *, last_value(case when event_type <> 'error' then value end ignore nulls) over (partition by user_id order by ts, event_id rows between unbounded preceding and 1 preceding) as anchor from events) select event_id, anchor from a where event_type = 'error'""")
def last_anchor(spark: SparkSession, sf_dir: str) -> DataFrame:
    anchor = F.when(F.col("event_type") != "error", F.col("value"))
    return seq.last_anchor(read(spark, sf_dir, "events"), ["user_id"], ["ts", "event_id"], anchor, "anchor").where("event_type = 'error'").select("event_id", "anchor")


@query("select user_id, event_id, rank from (select *, row_number() over (partition by user_id order by ts, event_id) as rank from events where event_type = 'error') where rank <= 3")
def first_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.first_k(read(spark, sf_dir, "events").where("event_type = 'error'"), ["user_id"], ["ts", "event_id"], 3).select("user_id", "event_id", F.col("rank").cast("long").alias("rank"))


@query("""with t as (select user_id, count(*) filter (event_type = 'click') as target from events group by 1), r as (select event_id, user_id, value, target, row_number() over (partition by user_id order by value desc, event_id) as rn,
sum(case when value >= 100 then 1 else 0 end) over (partition by user_id) as above, count(*) over (partition by user_id) as c from events join t using (user_id))
select event_id, user_id, case when above = target then 'threshold' when c < target then 'infeasible' else 'top_k' end as mode from r where rn <= target""")
def topk_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    targets = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("target"))
    return select.top_k_repair(events.join(targets, "user_id"), ["user_id"], "value", "event_id", threshold=100, target="target").select("event_id", "user_id", "mode")


@query("""with r as (select s_suppkey, row_number() over (order by sha256(s_name)) as rn, count(*) over () as n from supplier) select s_suppkey, rn <= least(n - 1, greatest(1, round_even(n * 0.2, 0))) as is_validation from r""")
def hash_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.hash_split(read(spark, sf_dir, "supplier"), "s_name", 0.2).select("s_suppkey", "is_validation")


@query("""with a as (select o_orderkey as k, o_orderstatus as s from orders), b as (select o_orderkey as k, case when o_totalprice > 300000 then 'X' else o_orderstatus end as s from orders)
select 'left' as side, * from (select * from a except all select * from b) union all select 'right', * from (select * from b except all select * from a)""")
def structural_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = read(spark, sf_dir, "orders")
    a = orders.select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    b = orders.select(F.col("o_orderkey").alias("k"), F.when(F.col("o_totalprice") > 300000, "X").otherwise(F.col("o_orderstatus")).alias("s"))
    return decode.structural_diff(a, b)


@query("""with m as (select max(c_custkey) + 1 as m from customer) select 'customer' as kind, c_custkey as id, c_name as name from customer union all select 'supplier', s_suppkey + m, s_name from supplier, m""")
def union_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "customer").select(F.lit("customer").alias("kind"), F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    b = read(spark, sf_dir, "supplier").select(F.lit("supplier").alias("kind"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))
    return decode.union_offset(a, b, "id")


@query("""with t as (select conv_id, turn, 0 as part, 'ROLE_' || upper(role) as token from conversations union all select conv_id, turn, 1, 'CHARS_' || length(text) from conversations
union all select conv_id, -1, 0, 'BOS' from (select distinct conv_id from conversations) union all select conv_id, 1000000, 0, 'EOS' from (select distinct conv_id from conversations))
select conv_id, row_number() over (partition by conv_id order by turn, part, token) as position, token from t""")
def linearize(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as ordered token rows."""
    turns = read(spark, sf_dir, "conversations")
    tokens = F.array(F.struct(F.lit(0).alias("part"), F.concat(F.lit("ROLE_"), F.upper("role")).alias("token")), F.struct(F.lit(1).alias("part"), F.concat(F.lit("CHARS_"), F.length("text").cast("string")).alias("token")))
    body = turns.select("conv_id", "turn", F.inline(tokens))
    ends = turns.select("conv_id").distinct().select("conv_id", F.inline(F.array(F.struct(F.lit(-1).cast("long").alias("turn"), F.lit(0).alias("part"), F.lit("BOS").alias("token")), F.struct(F.lit(1000000).cast("long").alias("turn"), F.lit(0).alias("part"), F.lit("EOS").alias("token")))))
    rows = body.unionByName(ends)
    from pyspark.sql import Window

    position = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "part", "token"))
    return rows.withColumn("position", position.cast("long")).select("conv_id", "position", "token")


@query("""select c_custkey, 'customer-' || lpad(c_custkey::varchar, greatest(3, length(c_custkey::varchar))::int, '0') as id, 'customer' as prefix, c_custkey::bigint as number, nullif(regexp_replace(c_name, '[^0-9]', '', 'g'), '')::bigint as digits from customer""")
def ids_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = read(spark, sf_dir, "customer").withColumn("id", ids.format_id("customer", F.col("c_custkey")))
    prefix, number = ids.parse_id(F.col("id"))
    return made.select("c_custkey", "id", prefix.alias("prefix"), number.alias("number"), ids.digits(F.col("c_name")).alias("digits"))


@query("""with q as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, case (l_quantity::int % 5) when 0 then 1920 when 1 then 960 when 2 then 480 when 3 then 240 else 120 end as base, l_linenumber % 3 as dots from lineitem),
t as (select *, base + case when dots >= 1 then base // 2 else 0 end + case when dots >= 2 then base // 4 else 0 end as ticks from q),
l as (select ticks, case ticks when 1920 then 'whole' when 2880 then 'whole.' when 3360 then 'whole..' when 960 then 'half' when 1440 then 'half.' when 1680 then 'half..' when 480 then 'quarter' when 720 then 'quarter.' when 840 then 'quarter..'
when 240 then 'eighth' when 360 then 'eighth.' when 420 then 'eighth..' when 120 then '16th' when 180 then '16th.' when 210 then '16th..' else 'unknown:' || ticks end as label from t) select label, ticks, count(*) as n from l group by 1, 2""")
def tick_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.element_at(F.array(*map(F.lit, ("whole", "half", "quarter", "eighth", "16th"))), F.col("l_quantity").cast("int") % 5 + 1)
    t = ticks.dotted(ticks.of_name(name), F.col("l_linenumber") % 3)
    return read(spark, sf_dir, "lineitem").select(t.alias("ticks")).withColumn("label", ticks.label(F.col("ticks"))).groupBy("label", "ticks").agg(F.count("*").alias("n"))


@query("""with s as (select event_id, event_id % 31 - 15 as step from events), n as (select *, 7 * 4 + 2 + step as n from s) select event_id, substr('CDEFGAB', (((n % 7) + 7) % 7 + 1)::int, 1) as letter, least(9, greatest(0, floor(n / 7.0)))::int as octave from n""")
def pitch_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    letter, octave = pitch.of_step((F.col("event_id") % 31 - 15).cast("double"), F.lit("G"), F.lit(2))
    return read(spark, sf_dir, "events").select("event_id", letter.alias("letter"), octave.alias("octave"))


@query("""with c as (select l_orderkey, l_linenumber, l_partkey, l_returnflag <> 'N' as filled, l_linestatus = 'F' as stem, (l_quantity::int % 4) as flags from lineitem),
k as (select case when not filled then case when stem then 'open_stem' else 'open' end when not stem then 'filled' else 'filled_stem_' || least(flags, 3) end as rule from c),
r(rule, n, best) as (values ('open_stem', 3, 960), ('open', 2, 1920), ('filled', 3, 480), ('filled_stem_0', 2, 480), ('filled_stem_1', 3, 240), ('filled_stem_2', 3, 120), ('filled_stem_3', 2, 60))
select rule, count(*) * any_value(n) as hypotheses, any_value(best) as best_ticks from k join r using (rule) group by 1""")
def lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duration hypotheses from visual flags, by the broadcast rule table."""
    flags = read(spark, sf_dir, "lineitem").select((F.col("l_returnflag") != "N").alias("is_filled"), (F.col("l_linestatus") == "F").alias("has_stem"), (F.col("l_quantity").cast("int") % 4).alias("flag_count"), F.lit(0).alias("dot_count"), F.lit(False).alias("is_rest"))
    hypotheses = decode.duration_hypotheses(flags)
    return hypotheses.groupBy("rule").agg(F.count("*").alias("hypotheses"), F.max_by("ticks", "visual_score").alias("best_ticks"))


@query("""with t as (select o_orderkey, max(o_totalprice) as expected, coalesce(sum(l_extendedprice), 0) as total from orders left join lineitem on l_orderkey = o_orderkey group by 1)
select l_orderkey as o_orderkey, 'line' as kind, round(l_extendedprice, 2) as amount from lineitem union all select o_orderkey, 'fill', round(expected - total, 2) from t where round(expected - total, 2) > 0""")
def gap_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_extendedprice").alias("amount"))
    orders = read(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("expected"))
    return decode.gap_fill(lines, orders, ["o_orderkey"], "amount", "expected", digits=2)


@query()
def measure_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A measure for each order: its lines are symbols, their quantities decide the hypotheses."""
    lines = read(spark, sf_dir, "lineitem")
    symbols = lines.select(F.col("l_orderkey").alias("measure_id"), F.monotonically_increasing_id().alias("row"), F.col("l_extendedprice").alias("x"), (F.col("l_returnflag") != "N").alias("is_filled"), (F.col("l_linestatus") == "F").alias("has_stem"), (F.col("l_quantity").cast("int") % 3).alias("flag_count"), F.lit(0).alias("dot_count"), F.lit(False).alias("is_rest"))
    symbols = symbols.withColumn("symbol_id", F.concat_ws("-", F.col("measure_id"), F.format_number("x", 2), "flag_count")).drop("row")
    return decode.decode_measures(symbols, ["measure_id"], F.lit(4), F.lit(4)).select("measure_id", "expected_ticks", "total_ticks", F.round("total_score", 6).alias("total_score"), "valid", F.size("selected").alias("n_selected"), F.size("rejected").alias("n_rejected"))


@query()
def sequence_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monotone alignment of a user's events with the tick lengths that follow from their types."""
    events = timed_events(spark, sf_dir).where("event_type <> 'signup'")
    offered = events.select("user_id", F.col("event_id").cast("string").alias("symbol_id"), F.col("sec").alias("x"), F.array(F.when(F.col("value") > 100, 480).otherwise(240), F.lit(960)).alias("ticks"))
    wanted = events.where("event_type = 'click'").select("user_id", F.col("sec").alias("x"), F.when(F.col("value") > 100, 480).otherwise(240).alias("target"))
    return decode.align_sequences(offered, wanted, ["user_id"])


@query()
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8-neighbour components of the (user, hour) grid of days with errors."""
    cells = timed_events(spark, sf_dir).where("event_type = 'error'").select(F.floor(F.col("sec") / 86400).alias("page"), F.col("user_id").cast("int").alias("y"), F.floor(F.col("sec") / 3600 % 24).cast("int").alias("x")).distinct()
    return decode.grid_components(cells, ["page"], "x", "y")
