"""Operators of layout, symbols, selection and evaluation as named queries over the event and order tables, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import domains, geometry, ids, pitch, scores, ticks
from ..operators import aggregate, decode, groups, joins, select, sequence
from ..vision import pages as vision_pages
from . import assembly, evaluation, policy
from .table_queries import EV, query, r6, read, timed_events


def cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with c, their value in cents."""
    return timed_events(spark, sf_dir).withColumn("c", F.round(F.col("value") * 100).cast("long"))


C = f"{EV}, ec as (select *, round(value * 100)::bigint as c from events_sec)"


@query("select user_id, event_type, count(*) as n from events where value >= case event_type when 'error' then 100 when 'click' then 20 else 50 end group by 1, 2")
def class_minimum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.at_least(read(spark, sf_dir, "events"), "value", "event_type", {"error": 100.0, "click": 20.0}, 50.0).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("select event_id, 'threshold' as mode from events where value / 500 >= 0.4")
def threshold_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "events").withColumn("confidence", F.col("value") / 500)
    return policy.select_by_threshold(labels, ["user_id"], 0.4).select("event_id", "mode")


@query("select l_orderkey, count(*) as n from lineitem where l_orderkey in (select l_orderkey from lineitem where l_returnflag = 'R' group by 1 having count(*) >= 2) group by 1")
def groups_having(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.having(read(spark, sf_dir, "lineitem"), ["l_orderkey"], F.col("l_returnflag") == "R", least=2).groupBy("l_orderkey").agg(F.count("*").alias("n"))


@query("select conv_id, turn from conversations where contains(lower(concat_ws(' ', role, text)), 'the')")
def text_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.contains_text(read(spark, sf_dir, "conversations"), " The ", ["role", "text"]).select("conv_id", "turn")


@query("""with n as (select user_id, count(*) filter (event_type = 'click') as n, count(*) filter (event_type in ('click', 'view') and value > 20) as m, count(*) / 10 as size from events group by 1), r as (select user_id, n < 2 * size and m > n and m <= round_even(n * 1.5, 0) as rescued from n)
select event_id, rescued from events join r using (user_id) where case when rescued then event_type in ('click', 'view') and value > 20 else event_type = 'click' end""")
def bounded_rescue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a user, or clicks and views where clicks are scarce."""
    events = read(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    sizes = events.groupBy("user_id").agg((F.count("*") / 10).alias("size"))
    out = select.rescue(events.where("event_type = 'click'"), events.where("event_type in ('click', 'view') and value > 20"), sizes, ["user_id"], few=2.0)
    return out.select("event_id", "rescued")


@query(f"""with {C}, l as (select *, sec - lag(sec) over (partition by user_id order by sec, event_id) as gap from ec), g as (select *, sum(case when gap <= 3600 then 0 else 1 end) over (partition by user_id order by sec, event_id) as cluster from l),
b as (select user_id, cluster, count(*) as n, max(struct_pack(x := sec, width := c % 7, side := (c % 5) / 20.0::double, relative := (c % 10) / 10.0::double)) as m from g group by 1, 2)
select user_id, (m).x as x, not (n > 1 or ((m).width >= 4 and (m).side <= 0.25)) as weak from b where n > 1 or ((m).width >= 4 and (m).side <= 0.25) or ((m).width >= 3 and (m).side <= 0.05 and (m).relative >= 0.28)""")
def accepted_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = cents(spark, sf_dir).select("user_id", "event_id", F.col("sec").alias("x"), (F.col("c") % 7).alias("width"), ((F.col("c") % 5) / 20.0).alias("side"), ((F.col("c") % 10) / 10.0).alias("relative"))
    return select.accepted_bars(sequence.gap_clusters(rows, ["user_id"], ["x", "event_id"], F.col("x"), 3600.0), ["user_id"], "cluster")


@query(f"""with {C}, k as (select distinct user_id, c // 100 as p from ec), l as (select *, p - lag(p) over (partition by user_id order by p) as gap from k), g as (select *, sum(case when gap <= 5 then 0 else 1 end) over (partition by user_id order by p) as run from l)
select user_id, run::bigint as run, min(p) as "start", max(p) as "end", max(p) - min(p) + 1 as length from g group by 1, 2""")
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.merge_runs(cents(spark, sf_dir).withColumn("p", F.expr("c div 100")), ["user_id"], "p", 5)


@query("""with b as (select o_custkey % 5 as system_index, o_orderpriority as kind, o_orderkey, o_totalprice as x from orders), i as (select * from (values (0, 1, 0.0, 100000.0), (0, 2, 100000.0, 250000.0), (1, 1, 0.0, 150000.0), (1, 2, 140000.0, 300000.0), (3, 1, 50000.0, 400000.0)) t(system_index, number, lo, hi)),
h as (select o_orderkey, number, lo from b join i on b.system_index = i.system_index and x >= lo and x < hi union all select o_orderkey, number, lo from b join i on x >= lo and x < hi where b.system_index not in (0, 1, 3))
select o_orderkey, arg_min(number, number * 1e9 + lo) as number, arg_min(lo, number * 1e9 + lo)::double as lo from h group by 1""")
def boundary_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first span of an order's group that holds its price; groups without spans take those of all."""
    spans = spark.createDataFrame([(1, 0, 1, 0.0, 1e5), (1, 0, 2, 1e5, 2.5e5), (1, 1, 1, 0.0, 1.5e5), (1, 1, 2, 1.4e5, 3e5), (1, 3, 1, 5e4, 4e5)], "page int, system_index long, number int, lo double, hi double")
    orders = read(spark, sf_dir, "orders").select(F.lit(1).alias("page"), (F.col("o_custkey") % 5).cast("long").alias("system_index"), "o_orderkey", F.col("o_totalprice").alias("x"))
    return joins.interval_or_any(orders, spans, ["page", "system_index"], ["page"], ["o_orderkey"], "x", "lo", "hi", ["number", "lo"]).select("o_orderkey", "number", "lo")


@query("""with m as (select distinct s_nationkey as staff, s_nationkey % 4 as system_index from supplier), z as (select system_index, count(*) as n from m group by 1), b as (select distinct c_nationkey as staff, floor(c_acctbal / 100)::bigint as bar from customer)
select system_index, bar from b join m using (staff) join z using (system_index) group by system_index, bar, n having count(*) >= greatest(1, n * 0.4)""")
def bars_of_systems(spark: SparkSession, sf_dir: str) -> DataFrame:
    members = read(spark, sf_dir, "supplier").select(F.lit(1).alias("page"), F.col("s_nationkey").alias("staff"), (F.col("s_nationkey") % 4).alias("system_index")).distinct()
    bars = read(spark, sf_dir, "customer").select(F.lit(1).alias("page"), F.col("c_nationkey").alias("staff"), F.floor(F.col("c_acctbal") / 100).alias("bar")).distinct()
    return joins.spanned(bars, members, ["page"], "staff", "system_index", ["bar"]).select("system_index", "bar")


@query(f"""with {C}, g as (select user_id, c // 5000 as system_index, floor(sec / 60) as x0 from ec), l as (select *, x0 - lag(x0) over (partition by user_id, system_index order by x0) as gap from g), k as (select *, sum(case when gap <= 240 then 0 else 1 end) over (partition by user_id, system_index order by x0) as k from l)
select user_id, system_index, round(avg(x0), 4) as x from k group by user_id, system_index, k""")
def system_barlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars of staves brought together by system."""
    bars = cents(spark, sf_dir).select(F.col("user_id").alias("page_id"), F.expr("c div 100").alias("staff_index"), F.floor(F.col("sec") / 60).cast("double").alias("x"))
    members = bars.select("page_id", "staff_index", F.expr("staff_index div 50").alias("system_index")).distinct()
    return assembly.system_barlines(bars, members, 240.0).select(F.col("page_id").alias("user_id"), "system_index", F.round("x", 4).alias("x"))


@query(f"""with {C}, x as (select user_id, event_type, sec as x from ec union select user_id, event_type, 1e9::double from (select distinct user_id, event_type from ec) union select user_id, event_type, 4e9::double from (select distinct user_id, event_type from ec)),
s as (select user_id, event_type, x, lead(x) over w as x_end, row_number() over w as number from x window w as (partition by user_id, event_type order by x))
select user_id, event_type, number::int as measure_number, x as x_start, x_end, 's' || event_type || '_m' || number as measure_id from s where x_end - x >= 7200""")
def measure_boundaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans between a left edge, events and a right edge, numbered before the short ones go."""
    bars = timed_events(spark, sf_dir).select(F.col("user_id").alias("page_id"), F.col("event_type").alias("system_index"), F.col("sec").alias("x"))
    extents = bars.select("page_id", "system_index", F.lit(1e9).alias("x_left"), F.lit(4e9).alias("x_right")).distinct()
    out = assembly.measure_boundaries(bars, extents, least=7200.0)
    return out.select(F.col("page_id").alias("user_id"), F.col("system_index").alias("event_type"), "measure_number", "x_start", "x_end", "measure_id")


@query(f"""with {C}, o as (select user_id, event_id, row_number() over w - 1 as i, c, sum(10 + c % 13 * case when c % 4 = 0 then 9 else 1 end) over w as y from ec window w as (partition by user_id order by sec, event_id)), b as (select *, y - lag(y + 4) over (partition by user_id order by i) as gap, 4 + c % 3 as unit from o),
s as (select user_id, median(gap) as m, median(unit) as u, count(gap) as n from b group by 1), r as (select b.*, m, case when gap is null or gap > case when n <= 3 then u * 6 else least(greatest(u * 4, m * 2.5), u * 10) end then 1 else 0 end as new from b join s using (user_id)), q as (select *, sum(new) over (partition by user_id order by i) as grp from r),
t as (select *, case when new = 0 then gap end as inn, count(*) over (partition by user_id, grp) as size from q), v as (select *, max(inn) over (partition by user_id, grp) as most, bool_or(coalesce(inn > m * 1.6, false)) over (partition by user_id, grp) as clear from t),
z as (select *, sum(case when inn = most and most > m * 1.5 then 1 else 0 end) over (partition by user_id, grp order by i) as nth from v)
select event_id, (sum(case when new = 1 or (size > 8 and case when clear then inn > m * 1.6 else inn = most and most > m * 1.5 and nth = 1 end) then 1 else 0 end) over (partition by user_id order by i) - 1)::int as system_index from z""")
def system_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    step = 10 + F.col("c") % 13 * F.when(F.col("c") % 4 == 0, 9).otherwise(1)
    rows = cents(spark, sf_dir).withColumn("bottom", F.sum(step).over(w)).withColumn("top", F.col("bottom") + 4).withColumn("unit", 4 + F.col("c") % 3)
    return sequence.split_systems(rows, ["user_id"], ["sec", "event_id"], "top", "bottom", "unit").select("event_id", "system_index")


@query(f"""with {C}, g as (select user_id, c - lag(c) over (partition by user_id order by sec, event_id) as gap from ec), m as (select user_id, median(gap) as m, count(gap) as n from g group by 1)
select user_id, round(case when any_value(n) >= 2 then sum(abs(gap - m)) / greatest(1.0, any_value(m)) else 0 end, 4) as dispersion from g join m using (user_id) group by 1""")
def spacing_dispersion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sequence.dispersion(cents(spark, sf_dir), ["user_id"], ["sec", "event_id"], F.col("c")).select("user_id", F.round("dispersion", 4).alias("dispersion"))


@query(f"""with {EV}, g as (select floor(sec / 86400)::bigint as day, floor(sec / 3600)::bigint % 24 as hour, user_id % 10 as y, count(*) as n from events_sec group by 1, 2, 3), d as (select distinct day from g),
f as (select day, y, hour, coalesce(n, 0) as n from d cross join range(10) a(y) cross join range(24) b(hour) left join g using (day, y, hour))
select day, y, hour, sum(t) over (partition by day, hour order by y)::bigint as total from (select *, sum(n) over (partition by day, y order by hour) as t from f)""")
def integral_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = timed_events(spark, sf_dir).select(F.floor(F.col("sec") / 86400).alias("day"), (F.floor(F.col("sec") / 3600) % 24).alias("hour"), (F.col("user_id") % 10).cast("long").alias("y"))
    cells = events.groupBy("day", "y", "hour").agg(F.count("*").alias("n"))
    full = events.select("day").distinct().select("day", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(9).cast("long"))).alias("y")).select("day", "y", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(23).cast("long"))).alias("hour"))
    return sequence.box_sums(full.join(cells, ["day", "y", "hour"], "left").fillna(0, ["n"]), ["day"], "hour", "y", "n").select("day", "y", "hour", "total")


@query("select o_orderkey, o_custkey, 'order-' || lpad(n::varchar, greatest(3, length(n::varchar))::int, '0') as id, 'order-' || lpad((n + 1)::varchar, greatest(3, length((n + 1)::varchar))::int, '0') as next_id from (select *, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) + 4 as n from orders)")
def row_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids in sequence from 5, and the one that a sequence would give next."""
    rows = ids.with_ids(read(spark, sf_dir, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "order", "id", seed=5)
    return rows.select("o_orderkey", "o_custkey", "id", ids.format_id("order", ids.parse_id(F.col("id"))[1] + 1).alias("next_id"))


@query("""select event_id, row_number() over (partition by user_id order by case when event_type = 'error' then 9999 else value end, ts, event_id) - 1 as position from events""")
def composite_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "events").withColumn("staff", F.when(F.col("event_type") != "error", F.col("value")))
    return select.ordered(rows, ["user_id"], [("staff", 9999.0), "ts", "event_id"]).select("event_id", "position")


@query("select user_id, event_id, event_type from (select *, row_number() over (partition by user_id order by floor(value / 50) desc, event_id) as rn from events) where rn = 1")
def argmax_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select.best_per(read(spark, sf_dir, "events"), ["user_id"], F.floor(F.col("value") / 50), ["event_id"], ["event_id", "event_type"])


@query("""with u as (select c_nationkey as band, floor(c_acctbal / 50) * 50 as x, 0 as pass, c_custkey as id from customer union all select s_nationkey, floor(s_acctbal / 50) * 50, 1, s_suppkey from supplier), f as (select * from (select *, row_number() over (partition by band, x order by pass, id) as rn from u) where rn = 1)
select band, x, pass, id from f where band not in (select n_nationkey from nation where n_regionkey = 2)""")
def candidate_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of several passes, of equal places the first, less those of set-aside bands."""
    one = read(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("band"), (F.floor(F.col("c_acctbal") / 50) * 50.0).alias("x"), F.lit(0).alias("pass"), F.col("c_custkey").alias("id"))
    two = read(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("band"), (F.floor(F.col("s_acctbal") / 50) * 50.0).alias("x"), F.lit(1).alias("pass"), F.col("s_suppkey").alias("id"))
    aside = read(spark, sf_dir, "nation").where("n_regionkey = 2").select(F.col("n_nationkey").alias("band"))
    return select.first_of_equal(one.unionByName(two), ["band", "x"], ["pass", "id"]).join(aside, "band", "left_anti")


@query(f"""with {C}, b as (select user_id, c // 100 as x, max(c % 100) as w from ec where event_type = 'click' group by 1, 2), n as (select user_id, event_id, c // 100 as cx, c % 100 as cy from ec where event_type = 'view'),
p as (select n.user_id, n.event_id, x, w, row_number() over (partition by event_id order by x, -w) as rn from n join b on n.user_id = b.user_id and x > cx and x <= cx + 40 and abs(w - cy) <= 20)
select event_id, count(*) as dots, sum(x)::bigint as xs from p where rn <= 2 group by 1""")
def dots_of_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two components in a window to the right of a symbol."""
    events = cents(spark, sf_dir)
    dots = events.where("event_type = 'click'").groupBy("user_id", F.expr("c div 100").alias("x")).agg(F.max(F.expr("c % 100")).alias("w"))
    symbols = events.where("event_type = 'view'").select("user_id", "event_id", F.expr("c div 100").alias("cx"), F.expr("c % 100").alias("cy"), F.expr("c div 100 + 1").alias("lo"), F.expr("c div 100 + 41").alias("hi"))
    # the windows are the intervals, so that both sides meet on buckets of them
    met = joins.interval_join(dots, symbols, ["user_id"], "x", "lo", "hi", width=40.0).where(F.abs(F.col("w") - F.col("cy")) <= 20)
    return select.first_k(met, ["event_id"], ["x", -F.col("w")], 2).groupBy("event_id").agg(F.count("*").alias("dots"), F.sum("x").alias("xs"))


@query("""with b as (select l_orderkey, l_linenumber % 3 as stem, l_partkey % 4 as level from lineitem) select o_orderkey, o_orderkey % 3 as stem, coalesce(max(level), 0) as flags from orders left join b on l_orderkey = o_orderkey and b.stem = o_orderkey % 3 group by 1""")
def beam_bridge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The highest level of the beams on a head's stem."""
    beams = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("page"), (F.col("l_linenumber") % 3).cast("long").alias("stem"), (F.col("l_partkey") % 4).alias("level"))
    heads = read(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_orderkey") % 3).alias("stem"))
    best = beams.groupBy("page", "stem").agg(F.max("level").alias("flags"))
    return joins.lookup_default(heads.withColumn("page", F.col("o_orderkey")), best, ["page", "stem"], {"flags": 0}).select("o_orderkey", "stem", "flags")


@query(f"""with {C} select event_id from ec a where event_type = 'view' and not exists (select 1 from ec b where b.user_id = a.user_id and b.event_type = 'click' and abs(a.c // 100 - b.c // 100) <= 2)""")
def off_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that lie more than two pixels off every line of their page; lines are spread over the rows that they cover, so that the join has equal keys only."""
    events = cents(spark, sf_dir).withColumn("y", F.expr("c div 100"))
    covered = events.where("event_type = 'click'").select("user_id", F.explode(F.sequence(F.col("y") - 2, F.col("y") + 2)).alias("y")).distinct()
    return events.where("event_type = 'view'").join(covered, ["user_id", "y"], "left_anti").select("event_id")


@query("select flags, count(*) as n, min(x) as x_min, max(x) as x_max from (select l_partkey % 5 as flags, l_extendedprice as x from lineitem) group by 1")
def flag_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").groupBy((F.col("l_partkey") % 5).alias("flags")).agg(F.count("*").alias("n"), F.min("l_extendedprice").alias("x_min"), F.max("l_extendedprice").alias("x_max"))


@query("select event_id, count(*) over (partition by user_id, event_type) as notes, count(*) over (partition by user_id, event_type) = 1 as alone from events")
def notes_in_measure(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type")
    counts = events.groupBy("user_id", "event_type").agg(F.count("*").alias("notes"))
    return events.join(counts, ["user_id", "event_type"]).select("event_id", "notes", (F.col("notes") == 1).alias("alone"))


@query("""with p as (select user_id, count(*) filter (event_type = 'view') as selected, count(*) filter (value > 60) as valid, count(*) as measures from events group by 1), t as (select user_id, count(*) as gt from events where event_type = 'click' group by 1)
select count(*) as fixtures, count(*) filter (selected = gt) as exact, round(avg(abs(selected - gt)), 6) as mae, sum(selected)::bigint as total_selected, sum(gt)::bigint as total_gt, sum(valid)::bigint as valid_measures, sum(measures)::bigint as total_measures, count(*) filter (valid = measures) as all_valid from p join t using (user_id)""")
def leak_free_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    found = events.groupBy(F.col("user_id").alias("fixture")).agg(F.count_if(F.col("event_type") == "view").alias("selected"), F.count_if(F.col("value") > 60).alias("valid_measures"), F.count("*").alias("measures"))
    truth = events.where("event_type = 'click'").groupBy(F.col("user_id").alias("fixture")).agg(F.count("*").alias("gt"))
    return evaluation.leak_free(found, truth).withColumn("mae", r6("mae"))


@query("""with p as (select user_id, bool_and(value > 20) as page_exact, count(*) filter (value > 20) as exact, count(*) as measures, count(*) filter (event_type = 'view') as selected, count(*) filter (event_type in ('view', 'click')) as gt from events group by 1)
select count(*) as fixture_count, count(*) filter (page_exact) || '/' || count(*) as page_exact, sum(exact) || '/' || sum(measures) as exact_measures, sum(selected) || '/' || sum(gt) as selected_events, sum(exact) = sum(measures) as all_measures_exact, round(avg(abs(selected - gt)), 6) as mean_error from p""")
def supervised_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    pages = events.groupBy("user_id").agg(F.bool_and(F.col("value") > 20).alias("page_exact"), F.count_if(F.col("value") > 20).alias("exact_measure_count"), F.count("*").alias("measure_count"), F.count_if(F.col("event_type") == "view").alias("selected_count"), F.count_if(F.col("event_type").isin("view", "click")).alias("gt_event_count"))
    means = evaluation.mean_errors(pages, {"mean_error": ("selected_count", "gt_event_count")})
    return evaluation.supervised_summary(pages).crossJoin(F.broadcast(means.select(r6("mean_error").alias("mean_error"))))


@query("""with p as (select user_id, count(*) filter (value / 500 >= 0.6) as n, count(*) filter (event_type = 'click') as target from events group by 1) select round(avg(abs(n - target)), 6) as mean_abs_error, count(*) filter (n = target) as exact_count, count(*) as fixture_count, sum(n)::bigint as total_selected, sum(target)::bigint as total_target, count(*) filter (n < target) as infeasible_count from p""")
def threshold_evaluation(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").withColumn("confidence", F.col("value") / 500)
    targets = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("target"))
    return policy.evaluate(policy.page_errors(policy.select_by_threshold(events, ["user_id"], 0.6), targets, ["user_id"])).withColumn("mean_abs_error", r6("mean_abs_error"))


@query("""with p as (select user_id, value / 500 as s, event_id, count(*) filter (event_type = 'click') over (partition by user_id) as target, count(*) filter (value / 500 >= 0.6) over (partition by user_id) as n, row_number() over (partition by user_id order by value / 500 desc, event_id) as rn from events) select event_id from p where case when n = target then s >= 0.6 else rn <= target end""")
def oracle_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events").select("user_id", F.col("event_id").alias("index"), (F.col("value") / 500).alias("confidence"), "event_type")
    targets = events.groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("target"))
    return policy.oracle_selection(events, targets, ["user_id"], 0.6).select(F.col("index").alias("event_id"))


@query("select user_id, count(*) filter (value / 500 >= 0.82) as positive, count(*) filter (value / 500 >= 0.55 and value / 500 < 0.82) as uncertain, count(*) filter (value / 500 < 0.55) as reject, count(*) as candidates from events group by 1")
def page_triage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.triage_page(read(spark, sf_dir, "events").withColumn("confidence", F.col("value") / 500), ["user_id"])


@query("select unnest(range(40, 99)) / 100.0::double as threshold")
def threshold_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(t,) for t in policy.threshold_grid()], "threshold double")


@query("""with n as (select user_id, event_id as note, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type = 'click'), g as (select user_id, case when event_id % 3 = 0 or user_id % 2 = 0 then event_id - event_id % 2 else event_id end as glyph, row_number() over (partition by user_id order by ts, event_id) as rn from events where event_type in ('click', 'view') and event_id % 5 <> 0),
s as (select n.user_id, note, glyph from n join g on n.user_id = g.user_id and note = glyph), t as (select user_id, count(*) as n from n group by 1), d as (select user_id, coalesce(l, 0) >= greatest(1, floor(n * 0.5)) as direct from t left join (select user_id, count(*) as l from s group by 1) using (user_id))
select s.* from s join d using (user_id) where direct union all select n.user_id, note, glyph from n join g using (user_id, rn) join d using (user_id) where not direct""")
def linked_glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = read(spark, sf_dir, "events")
    notes = events.where("event_type = 'click'").select("user_id", F.col("event_id").alias("note"), F.col("ts").alias("at"))
    moved = (F.col("event_id") % 3 == 0) | (F.col("user_id") % 2 == 0)
    glyphs = events.where("event_type in ('click', 'view') and event_id % 5 <> 0").select("user_id", F.when(moved, F.col("event_id") - F.col("event_id") % 2).otherwise(F.col("event_id")).alias("glyph"), F.col("ts").alias("seen"), "event_id")
    return joins.linked_or_zipped(notes, glyphs, ["user_id"], "note", "glyph", ["at", "note"], ["seen", "event_id"])


@query("""with e as (select event_id, value, event_id % 9 as n, event_id % 4 as d, row_number() over () as x from events)
select event_id, 'C' || case when event_id % 3 - 1 < 0 then '' else '+' end || (event_id % 3 - 1) || ':' || (event_id % 10) as pitch_key, round((20 - value) / 5 + 4, 6) as staff_step, 's' || n || '_m' || d as measure_id, n::int as staff, case when event_id % 2 = 0 then n::int end as staff_of_id,
(n + 1) * 1920 // (2 << d) as expected_ticks, case when (d + 1) * 4 * 6 % (n + 1) = 0 then ((d + 1) * 24 // (n + 1))::int end as units, 'half' || repeat('.', d::int) as label, round_even(n * 480 / (d + 1), 0)::int as ticks, (d + 1) // gcd(d + 1, n + 1) as num, (n + 1) // gcd(d + 1, n + 1) as den from e""")
def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, n, d = F.col("event_id"), (F.col("event_id") % 9).cast("int"), (F.col("event_id") % 4).cast("int")
    lines, common = F.array(*map(F.lit, (0, 10, 20, 30, 40))), aggregate.gcd((d + 1).cast("long"), (n + 1).cast("long"))
    ident = F.when(e % 2 == 0, F.format_string("ev_s%d_%d", n, d)).otherwise(F.lit("ev"))
    return read(spark, sf_dir, "events").select(
        "event_id", pitch.key(F.lit("C"), (e % 3 - 1).cast("int"), (e % 10).cast("int")).alias("pitch_key"), r6(pitch.staff_step(lines, F.lit(10.0), F.col("value"))).alias("staff_step"), ids.measure_id(n, d).alias("measure_id"),
        n.alias("staff"), ids.staff_of(ident).alias("staff_of_id"), ticks.per_measure(n + 1, F.shiftleft(F.lit(1), 1) * F.element_at(F.array(*map(F.lit, (1, 2, 4, 8))), d + 1)).cast("long").alias("expected_ticks"),
        ticks.units(d + 1, n + 1, F.lit(6)).alias("units"), ticks.typed_label(F.lit(" Half "), d).alias("label"), ticks.of_duration(n, d + 1).alias("ticks"), ((d + 1) / common).cast("long").alias("num"), ((n + 1) / common).cast("long").alias("den"),
    )


@query("""with e as (select event_id, event_id % 2 = 0 as filled, event_id % 3 > 0 as stem, event_id % 6 as flags, event_id % 4 as dots from events), b as (select *, case when filled then case when stem and flags between 1 and 4 then 4 << flags::int else 4 end when stem then 2 else 1 end as den from e)
select event_id, ((2 << dots::int) - 1)::int as num, (den * (1 << dots::int))::int as den from b""")
def classified_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    num, den = ticks.duration_of(e % 2 == 0, e % 3 > 0, (e % 6).cast("int"), (e % 4).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", num.alias("num"), den.alias("den"))


@query("""with s as (select event_id, 4.0 + event_id % 9 as w, 4.0 + event_id % 7 as h, (4.0 + event_id % 9) * (4.0 + event_id % 7) * (0.3 + event_id % 8 / 10.0) as area, value / 100 - 1 as behind, value / 8 as reach, abs(event_id % 5 / 3.0) as err from events),
k as (select *, area / (w * h) as density, w / h as aspect, w / 20 as wu, h / 20 as hu from s), f as (select *, case when wu <= 0.1 or wu >= 0.7 then 0 when wu < 0.18 then (wu - 0.1) / 0.08 when wu <= 0.45 then 1 else (0.7 - wu) / 0.25 end as ws, case when hu <= 0.1 or hu >= 0.7 then 0 when hu < 0.18 then (hu - 0.1) / 0.08 when hu <= 0.45 then 1 else (0.7 - hu) / 0.25 end as hs,
case when aspect <= 0.45 or aspect >= 2.2 then 0 when aspect < 0.75 then (aspect - 0.45) / 0.3 when aspect <= 1.45 then 1 else (2.2 - aspect) / 0.75 end as sh, case when density >= 0.55 then case when density <= 1 then 1 else 0 end else (density - 0.35) / 0.2 end as fu, greatest(0, 1 - err / 1.1) as pl from k)
select event_id, round(case when density >= 0.35 and aspect between 0.45 and 2.2 and wu between 0.1 and 0.7 and hu between 0.1 and 0.7 and area / 400 between 0.015 and 0.35 and behind > 0 and reach <= 60 and err <= 1.1 then 0.2 * ws + 0.2 * hs + 0.2 * sh + 0.25 * pl + 0.15 * fu else 0 end, 4)::double as score from f""")
def dot_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    w, h = 4.0 + e % 9, 4.0 + e % 7
    score = scores.dot(w, h, w * h * (0.3 + e % 8 / 10.0), F.col("value") / 100 - 1, F.col("value") / 8, F.abs(e % 5 / 3.0), F.lit(20.0))
    return read(spark, sf_dir, "events").select("event_id", F.round(score, 4).alias("score"))


@query("select p_partkey, p_size % 2 = 0 as articulation, p_size % 3 = 0 as dynamic from part")
def word_domains(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size")
    mark = F.when(size % 2 == 0, F.element_at(F.array(*map(F.lit, domains.ARTICULATIONS)), (size % len(domains.ARTICULATIONS) + 1).cast("int"))).otherwise("bounce")
    loud = F.when(size % 3 == 0, F.element_at(F.array(*map(F.lit, domains.DYNAMICS)), (size % len(domains.DYNAMICS) + 1).cast("int"))).otherwise("ppppp")
    return read(spark, sf_dir, "part").select("p_partkey", domains.is_articulation(mark).alias("articulation"), domains.is_dynamic(loud).alias("dynamic"))


@query("""with b as (select l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity as x0, l_discount * 100 as y0, l_tax * 100 + 1 as w, l_quantity / 2 as h from lineitem)
select l_orderkey, round(sum(w), 4) as width, round(sum(h), 4) as height, round(sum(w * h), 4) as area, round(sum(x0 + w / 2), 4) as cx, count(*) filter (25 between x0 and x0 + w and 5 between y0 and y0 + h) as holding, count(*) filter (x0 < 30 and x0 + w > 20 and y0 < 8 and y0 + h > 2) as crossing from b group by 1""")
def box_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = geometry.from_xywh(F.col("l_quantity"), F.col("l_discount") * 100, F.col("l_tax") * 100 + 1, F.col("l_quantity") / 2)
    fixed = geometry.box(F.lit(20.0), F.lit(2.0), F.lit(30.0), F.lit(8.0))
    back = geometry.to_xywh(F.col("b"))
    rows = read(spark, sf_dir, "lineitem").withColumn("b", made)
    return rows.groupBy("l_orderkey").agg(F.round(F.sum(back["width"]), 4).alias("width"), F.round(F.sum(back["height"]), 4).alias("height"), F.round(F.sum(geometry.area(F.col("b"))), 4).alias("area"), F.round(F.sum(geometry.center(F.col("b"))["x"]), 4).alias("cx"), F.count_if(geometry.contains(F.col("b"), F.lit(25.0), F.lit(5.0))).alias("holding"), F.count_if(geometry.intersects(F.col("b"), fixed)).alias("crossing"))


@query(f"""with {C}, m as (select *, case c % 10 when 0 then c % 3 + 2 when 1 then 0 end as mark from ec) select event_id, nullif(last_value(mark ignore nulls) over (partition by user_id order by sec, event_id rows between unbounded preceding and 1 preceding), 0) as open_ratio from m""")
def last_marker(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ratio of the group that is open before an event: marks open it, 0 closes it."""
    c = F.col("c")
    mark = F.when(c % 10 == 0, c % 3 + 2).when(c % 10 == 1, 0)
    return sequence.last_anchor(cents(spark, sf_dir), ["user_id"], ["sec", "event_id"], mark, "open").select("event_id", F.nullif(F.col("open"), F.lit(0)).alias("open_ratio"))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("sec", "event_id")
    rows = cents(spark, sf_dir).withColumn("n", F.row_number().over(w) - 1)
    return rows.where(F.col("c") % 17 != 0).select(F.col("user_id").alias("page_id"), (F.col("n") * 10 + F.expr("n div 5") * 30 + F.when(F.col("c") % 7 == 0, F.col("c") % 9).otherwise(F.col("c") % 2)).alias("y"))


@query(f"""with recursive {C}, o as (select user_id as page_id, c, row_number() over (partition by user_id order by sec, event_id) - 1 as n from ec), l0 as (select distinct page_id, n * 10 + n // 5 * 30 + case when c % 7 = 0 then c % 9 else c % 2 end as y from o where c % 17 <> 0),
d0 as (select *, y - lag(y) over w as back, lead(y) over w - y as ahead, count(*) over (partition by page_id) as size from l0 window w as (partition by page_id order by y)), m0 as (select page_id, greatest(4, coalesce(median(back) filter (back between 3 and 80), 12)) as med from d0 group by 1),
k0 as (select *, size <= 5 or coalesce(back <= med * 2, false) or coalesce(ahead <= med * 2, false) as near from d0 join m0 using (page_id)), s0 as (select page_id, count(*) filter (near) as kept from k0 group by 1), l1 as (select page_id, y from k0 join s0 using (page_id) where size >= 5 and (near or kept < 5)),
d1 as (select *, y - lag(y) over w as back, lead(y) over w - y as ahead, count(*) over (partition by page_id) as size from l1 window w as (partition by page_id order by y)), m1 as (select page_id, greatest(4, coalesce(quantile_cont(back, 0.25) filter (back between 4 and 50), 12)) as i from d1 group by 1),
f1 as (select *, coalesce(back <= i * 2, false) or coalesce(ahead <= i * 2, false) as staff from d1 join m1 using (page_id)), g1 as (select *, lead(staff) over (partition by page_id order by y) as next_staff from f1),
l2 as (select page_id, y::double as y, i from g1 union all select page_id, round_even(y + ahead / 2.0, 0), i from g1 where size >= 3 and staff and next_staff and ahead > i * 1.5 and ahead <= i * 2.5), b as (select *, row_number() over w as pos, lead(y, 1) over w as y1, lead(y, 2) over w as y2, lead(y, 3) over w as y3, lead(y, 4) over w as y4 from l2 window w as (partition by page_id order by y)),
ev as (select * from b where y4 is not null and greatest(abs(y1 - y - i), abs(y2 - y1 - i), abs(y3 - y2 - i), abs(y4 - y3 - i)) <= greatest(2, i * 0.35)), g(page_id, pos) as (select page_id, min(pos) from ev group by 1 union all select g.page_id, (select min(pos) from ev where ev.page_id = g.page_id and ev.pos >= g.pos + 5) from g where g.pos is not null)
select page_id, (row_number() over (partition by page_id order by y) - 1)::int as staff_index, y as top, y4 as bottom, round((y4 - y) / 4, 6) as interline from g join ev using (page_id, pos)""")
def staff_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-line bands among lines with jitter, faint ones left out."""
    bands = vision_pages.staff_bands(_lines(spark, sf_dir).distinct())
    return bands.select("page_id", "staff_index", F.col("line_ys")[0].alias("top"), F.col("line_ys")[4].alias("bottom"), r6("interline_px").alias("interline"))


@query("""with e as (select event_id, user_id, event_type, event_id % 4 = 0 as rest, count(*) over (partition by user_id, event_type) as n, count(*) filter (event_id % 4 <> 0) over (partition by user_id, event_type) as notes, case when event_id % 4 = 0 then 'quarter' else 'half' end as kind from events)
select event_id, 1920 as ticks, case when n = 1 then 0.4 when notes = 0 then 1.5 else -2.0 end::double as visual_score, case when n = 1 then 'single_symbol_measure_fill' else 'full_measure_rest_context' end as evidence from e where n = 1 or rest""")
def context_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hypotheses by which a lone symbol, or a rest, fills its measure."""
    symbols = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", (F.col("event_id") % 4 == 0).alias("is_rest"), F.lit(False).alias("known"))
    return decode.context_hypotheses(symbols, ["user_id", "event_type"], F.lit(1920)).select("event_id", "ticks", "visual_score", "evidence")


@query()
def pruned_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars less weak ones that break the spacing; tested against a plain version."""
    bars = cents(spark, sf_dir).select("user_id", F.expr("c div 10").cast("double").alias("x"), (F.col("c") % 3 == 0).alias("weak"), F.lit(0.0).alias("left"), F.lit(6.0).alias("unit"))
    return groups.prune_weak(bars, ["user_id"], "x", "weak", "left", "unit")


@query()
def joined_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components that an erased line has parted, brought together; tested against a plain version."""
    c = F.col("c")
    x, y = (c % 97).cast("double"), F.expr("c div 97 % 211").cast("double")
    pieces = cents(spark, sf_dir).select("user_id", (1.0 + c % 5).alias("area"), x.alias("cx"), y.alias("cy"), (x - 2).alias("x0"), (y - 2).alias("y0"), (x + 2).alias("x1"), (y + 2).alias("y1"), F.lit(20.0).alias("unit"))
    return groups.join_pieces(pieces, ["user_id"], "unit").select(*("user_id", *(F.round(p, 6).alias(p) for p in groups.PIECE)))
