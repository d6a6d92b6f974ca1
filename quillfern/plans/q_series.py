"""Queries on ordered series: the events of each user."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillfern.operators import intervals as I
from quillfern.operators import series as S
from quillfern.plans.catalogue import query
from quillfern.sources.tables import table

HOUR = 3_600_000_000
#: The series in DuckDB: e(user_id, event_id, us, event_type, value) and numbered rows.
E_SQL = "with e as (select user_id, event_id, epoch_us(ts) as us, event_type, value from events)"
N_SQL = E_SQL + ", n as (select *, row_number() over (partition by user_id order by us, event_id) as i from e)"
FRAME_SQL = E_SQL + f""",
h as (select user_id, us // {HOUR} as hour, count(*) as n, max(value) as peak, min(value) as low from e group by all),
r as (select user_id, min(hour) as a, max(hour) as b from h group by 1),
f as (select r.user_id, t.hour - a as frame, coalesce(n, 0) as n, n is not null as active, peak, low from r, lateral (select unnest(range(a, b + 1)) as hour) t left join h on h.user_id = r.user_id and h.hour = t.hour)
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "event_type", "value")


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames of one hour from a user's first to last event: frame, n, active, peak, low."""
    h = events(spark, sf_dir).groupBy("user_id", F.floor(F.col("us") / F.lit(HOUR)).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("peak"), F.min("value").alias("low"))
    span = h.groupBy("user_id").agg(F.min("hour").alias("a"), F.max("hour").alias("b"))
    grid = span.select("user_id", "a", F.explode(F.sequence("a", "b")).alias("hour"))
    return grid.join(h, ["user_id", "hour"], "left").select("user_id", (F.col("hour") - F.col("a")).alias("frame"), F.coalesce("n", F.lit(0)).alias("n"), F.col("n").isNotNull().alias("active"), "peak", "low")


def activity(spark: SparkSession, sf_dir: str, gap: int = 6 * HOUR, width: int = HOUR) -> DataFrame:
    """Segments of a user's events at most gap apart, longer than width."""
    runs = events(spark, sf_dir).select("user_id", F.col("us").alias("start"), F.col("us").alias("stop"))
    return S.merge_and_drop(runs, "user_id", gap, width)


ACTIVITY_SQL = E_SQL + f""",
g as (select user_id, us, case when us - lag(us) over w > {6 * HOUR} or lag(us) over w is null then 1 else 0 end as f from e window w as (partition by user_id order by us)),
a as (select user_id, us, sum(f) over (partition by user_id order by us rows unbounded preceding) as k from g),
s as (select user_id, min(us) as start, max(us) as stop from a group by user_id, k),
act as (select user_id, start, stop, row_number() over (partition by user_id order by start) - 1 as seg from s where stop - start > {HOUR})
"""


@query("activity_segments", ACTIVITY_SQL + "select user_id, cast(seg as bigint) as seg, start as start_us, stop as stop_us from act")
def activity_segments(spark, sf_dir):
    return activity(spark, sf_dir).select("user_id", F.col("seg").cast("long").alias("seg"), F.col("start").alias("start_us"), F.col("stop").alias("stop_us"))


@query("merge_gaps_frames", FRAME_SQL + """,
g as (select user_id, frame, case when frame - lag(frame) over w - 1 > 3 or lag(frame) over w is null then 1 else 0 end as k from f where active window w as (partition by user_id order by frame)),
a as (select user_id, frame, sum(k) over (partition by user_id order by frame rows unbounded preceding) as k from g),
s as (select user_id, min(frame) as start, max(frame) + 1 as stop from a group by user_id, k)
select user_id, start as start_frame, stop as stop_frame, cast(row_number() over (partition by user_id order by start) - 1 as bigint) as seg from s where stop - start > 2""")  # fmt: skip
def merge_gaps_frames(spark, sf_dir):
    hours = events(spark, sf_dir).select("user_id", F.floor(F.col("us") / F.lit(HOUR)).cast("long").alias("hour")).distinct()
    # Active hours alone make the runs: no grid of silent ones is needed.
    frames = hours.select("user_id", (F.col("hour") - F.min("hour").over(W.partitionBy("user_id"))).alias("frame"), F.lit(True).alias("active"))
    runs = S.islands(frames, "user_id", "frame", "active")
    return S.merge_and_drop(runs, "user_id", 3, 2).select("user_id", F.col("start").alias("start_frame"), F.col("stop").alias("stop_frame"), F.col("seg").cast("long").alias("seg"))


@query("threshold_mask", E_SQL + """,
l as (select user_id, quantile_cont(value, 0.05) + 0.2 * stddev_pop(value) as lim from e group by 1)
select event_id, e.user_id, value > lim as mask from e join l using (user_id)""")  # fmt: skip
def threshold_mask(spark, sf_dir):
    return S.threshold_mask(events(spark, sf_dir), "user_id", "value").select("event_id", "user_id", "mask")


@query("moving_average", N_SQL + """,
c as (select user_id, max(i) as m from n group by 1),
p as (select user_id, i, value from n
  union all select user_id, 1 - i, value from n where i <= 2
  union all select user_id, 2 * m + 1 - i, value from n join c using (user_id) where i > m - 2),
w as (select user_id, i, avg(value) over (partition by user_id order by i rows between 2 preceding and 2 following) as s from p)
select n.event_id, n.user_id, round(s, 6) as smoothed from n join w using (user_id, i)""")  # fmt: skip
def moving_average(spark, sf_dir):
    return S.moving_average(events(spark, sf_dir), "user_id", ["us", "event_id"], "value", 5).select("event_id", "user_id", F.round("smoothed", 6).alias("smoothed"))


@query("max_normalize", E_SQL + " select event_id, user_id, round(value / nullif(max(value) over (partition by user_id), 0), 6) as normalized from e")
def max_normalize(spark, sf_dir):
    return S.max_normalize(events(spark, sf_dir), "user_id", "value").select("event_id", "user_id", F.round("normalized", 6).alias("normalized"))


@query("standardize", """select l_orderkey, l_linenumber, l_partkey, l_suppkey,
round((l_extendedprice - avg(l_extendedprice) over w) / (stddev_samp(l_extendedprice) over w + 1e-8), 6) as standardized
from lineitem window w as (partition by l_suppkey)""")  # fmt: skip
def standardize(spark, sf_dir):
    rows = S.standardize(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round("standardized", 6).alias("standardized"))


@query("edges", N_SQL + """
select event_id, user_id, on_ and not coalesce(lag(on_) over w, false) as rising, on_ and not coalesce(lead(on_) over w, false) as falling
from (select *, value > 20 as on_ from n) window w as (partition by user_id order by i)""")  # fmt: skip
def edges(spark, sf_dir):
    return S.edges(events(spark, sf_dir).withColumn("on_", F.col("value") > 20), "user_id", ["us", "event_id"], "on_").select("event_id", "user_id", "rising", "falling")


@query("local_minima", N_SQL + """ select event_id, user_id from (select event_id, user_id, value, lag(value) over w as p, lead(value) over w as q from n window w as (partition by user_id order by i)) where p > value and q > value""")
def local_minima(spark, sf_dir):
    return S.local_minima(events(spark, sf_dir), "user_id", ["us", "event_id"], "value").where("is_valley").select("event_id", "user_id")


@query("onset_lookahead_fill", FRAME_SQL + """,
o as (select *, not active and coalesce(lag(active) over (partition by user_id order by frame), false) and frame % 5 = 0 as onset from f),
t as (select *, case when onset then min(case when active then frame end) over (partition by user_id order by frame rows between current row and 11 following) end as upto from o)
select user_id, frame, active or coalesce(frame < max(upto) over (partition by user_id order by frame rows unbounded preceding), false) as filled from t""")  # fmt: skip
def onset_lookahead_fill(spark, sf_dir):
    f = hourly(spark, sf_dir)
    f = f.withColumn("onset", ~F.col("active") & F.coalesce(F.lag("active").over(S.over("user_id", "frame")), F.lit(False)) & (F.col("frame") % 5 == 0))
    return S.lookahead_fill(f, "user_id", "frame", "active", "onset", 12).select("user_id", "frame", "filled")


@query("forward_stretch", FRAME_SQL + """,
v as (select *, frame % 7 = 3 as valley, active and not coalesce(lead(active) over (partition by user_id order by frame), false) as falling,
  min(case when frame % 7 = 3 then frame end) over (partition by user_id order by frame rows between 1 following and unbounded following) as nxt from f),
t as (select *, case when falling and nxt - frame <= 4 then nxt end as upto from v)
select user_id, frame, active or coalesce(frame < max(upto) over (partition by user_id order by frame rows unbounded preceding), false) as stretched from t""")  # fmt: skip
def forward_stretch(spark, sf_dir):
    f = hourly(spark, sf_dir).withColumn("valley", F.col("frame") % 7 == 3)
    return S.forward_stretch(f, "user_id", "frame", "active", "valley", 4).select("user_id", "frame", "stretched")


@query("forward_fill", N_SQL + """ select event_id, user_id, coalesce(last_value(case when event_type = 'signup' then value end ignore nulls) over (partition by user_id order by i rows unbounded preceding), -1.0) as filled from n""")
def forward_fill(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("v", F.when(F.col("event_type") == "signup", F.col("value")))
    return S.forward_fill(e, "user_id", ["us", "event_id"], "v", F.lit(-1.0)).select("event_id", "user_id", "filled")


@query("gap_interpolate", N_SQL + """,
m as (select *, case when event_type <> 'error' and event_type <> 'view' then value end as s from n),
w as (select *, last_value(s + 1 ignore nulls) over (partition by user_id order by i rows between unbounded preceding and current row) as p,
  first_value(s ignore nulls) over (partition by user_id order by i rows between current row and unbounded following) as q,
  last_value(case when s is not null then i end ignore nulls) over (partition by user_id order by i rows between unbounded preceding and current row) as pi,
  first_value(case when s is not null then i end ignore nulls) over (partition by user_id order by i rows between current row and unbounded following) as qi from m)
select event_id, user_id, round(coalesce(s, p + (i - pi - 1) * (q - p) / (qi - pi - 1)), 6) as start_filled,
  round(coalesce(s + 1, p + (i - pi) * (q - p) / (qi - pi - 1)), 6) as end_filled from w""")  # fmt: skip
def gap_interpolate(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("s", F.when(~F.col("event_type").isin("error", "view"), F.col("value"))).withColumn("t", F.col("s") + 1)
    rows = S.interpolate_gaps(e, "user_id", ["us", "event_id"], "s", "t")
    return rows.select("event_id", "user_id", F.round("start_filled", 6).alias("start_filled"), F.round("end_filled", 6).alias("end_filled"))


@query("range_ids_fill", """with o as (select o_custkey as c, o_orderkey as k, case when o_orderstatus = 'F' then cast(o_orderkey % 10 as integer) end as id from orders),
w as (select c, k, id, coalesce(last_value(id ignore nulls) over (partition by c order by k rows unbounded preceding), 0) as a,
  coalesce(first_value(id ignore nulls) over (partition by c order by k rows between current row and unbounded following), 9) as b from o)
select c as o_custkey, k as o_orderkey, case when id is not null then cast(id as varchar) when a <= b then array_to_string(range(a, b + 1), ',') else '' end as ids from w""")  # fmt: skip
def range_ids_fill(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("ids", F.when(F.col("o_orderstatus") == "F", F.array((F.col("o_orderkey") % 10).cast("int"))))
    return S.range_fill(o, "o_custkey", "o_orderkey", "ids", F.lit(9)).select("o_custkey", "o_orderkey", F.array_join("ids_filled", ",").alias("ids"))


@query("run_groups", N_SQL + """,
g as (select *, case when event_type is distinct from lag(event_type) over w or i = 1 then 1 else 0 end as f from n window w as (partition by user_id order by i)),
r as (select *, sum(f) over (partition by user_id order by i rows unbounded preceding) as run from g)
select user_id, cast(run as bigint) as run, min(event_type) as event_type, count(*) as n, min(us) as start_us, max(us) as stop_us from r group by user_id, run""")  # fmt: skip
def run_groups(spark, sf_dir):
    rows = S.run_numbers(events(spark, sf_dir), "user_id", ["us", "event_id"], "event_type")
    return rows.groupBy("user_id", F.col("run").cast("long").alias("run")).agg(F.min("event_type").alias("event_type"), F.count(F.lit(1)).alias("n"), F.min("us").alias("start_us"), F.max("us").alias("stop_us"))


@query("nearest_event", E_SQL + """
select c.event_id, c.user_id, p.event_id as nearest_id from (select * from e where event_type = 'click') c
left join (select * from e where event_type = 'purchase') p on p.user_id = c.user_id
qualify row_number() over (partition by c.event_id order by abs(p.us - c.us), p.us, p.event_id) = 1""")  # fmt: skip
def nearest_event(spark, sf_dir):
    e = events(spark, sf_dir)
    rows = I.nearest_asof(e.where("event_type = 'click'").select("user_id", "event_id", "us"), e.where("event_type = 'purchase'").select("user_id", "us", "event_id"), ["user_id"], "us", "us", "event_id")
    return rows.select("event_id", "user_id", "nearest_id")


@query("asof_forward", E_SQL + f"""
select c.event_id, c.user_id, case when min(p.us) - any_value(c.us) <= {48 * HOUR} then min(p.us) end as next_at from (select * from e where event_type = 'click') c
left join (select * from e where event_type = 'purchase') p on p.user_id = c.user_id and p.us > c.us group by 1, 2""")  # fmt: skip
def asof_forward(spark, sf_dir):
    e = events(spark, sf_dir)
    return I.forward_asof(e.where("event_type = 'click'").select("user_id", "event_id", "us"), e.where("event_type = 'purchase'").select("user_id", "us"), ["user_id"], "us", "us", 48 * HOUR).select("event_id", "user_id", "next_at")


@query("padded_windows", ACTIVITY_SQL + """
select user_id, cast(seg as bigint) as seg, greatest(0, start - 500000) as pad_start,
  least(stop, lead(start, 1, stop) over (partition by user_id order by seg) + 1000000) + 500000 as pad_end from act""")  # fmt: skip
def padded_windows(spark, sf_dir):
    a = activity(spark, sf_dir)
    nxt = F.lead("start").over(S.over("user_id", "seg"))
    return a.select("user_id", F.col("seg").cast("long").alias("seg"), F.greatest(F.lit(0), F.col("start") - 500_000).alias("pad_start"), (F.least(F.col("stop"), F.coalesce(nxt, F.col("stop")) + 1_000_000) + 500_000).alias("pad_end"))


@query("shift_to_global", ACTIVITY_SQL + """ select e.event_id, e.user_id, cast(seg as bigint) as seg, e.us - start as local_us, e.us - start + start as global_us from e join act on e.user_id = act.user_id and e.us between start and stop""")
def shift_to_global(spark, sf_dir):
    a = activity(spark, sf_dir).select("user_id", "seg", "start", (F.col("stop") + 1).alias("stop"))
    e = events(spark, sf_dir).select("user_id", "event_id", "us", (F.col("us") + 1).alias("us_end"))
    rows = I.overlap_join(e, a, ["user_id"], 24 * HOUR, ("us", "us_end"), ("start", "stop")).withColumn("local_us", F.col("us") - F.col("start"))
    return rows.select("event_id", "user_id", F.col("seg").cast("long").alias("seg"), "local_us", (F.col("local_us") + F.col("start")).alias("global_us"))


@query("ordered_segments", ACTIVITY_SQL + """ select user_id, start as start_us, cast(row_number() over (partition by user_id order by stop - start desc, start) as bigint) as by_length, cast(row_number() over (partition by user_id order by coalesce(start, 0)) as bigint) as by_start from act""")
def ordered_segments(spark, sf_dir):
    a = activity(spark, sf_dir)
    w = W.partitionBy("user_id")
    return a.select("user_id", F.col("start").alias("start_us"), F.row_number().over(w.orderBy(F.desc(F.col("stop") - F.col("start")), "start")).cast("long").alias("by_length"), F.row_number().over(w.orderBy(F.coalesce("start", F.lit(0)))).cast("long").alias("by_start"))


@query("quality_checks", ACTIVITY_SQL + """
select user_id, cast(seg as bigint) as seg, stop > start as non_empty, coalesce(lag(stop) over w < start, true) as ordered, seg = row_number() over w - 1 as numbered,
  abs((stop - start) / 7e6 - round((stop - start) / 7e6)) <= 0.03 + 1e-5 * abs(round((stop - start) / 7e6)) as close_, isfinite(start / 1e6) as finite_ from act window w as (partition by user_id order by seg)""")  # fmt: skip
def quality_checks(spark, sf_dir):
    w = S.over("user_id", "seg")
    d = (F.col("stop") - F.col("start")) / F.lit(7e6)  # lengths are compared with whole multiples of seven seconds
    return activity(spark, sf_dir).select(
        "user_id", F.col("seg").cast("long").alias("seg"), (F.col("stop") > F.col("start")).alias("non_empty"), F.coalesce(F.lag("stop").over(w) < F.col("start"), F.lit(True)).alias("ordered"),
        (F.col("seg") == F.row_number().over(w) - 1).alias("numbered"), (F.abs(d - F.round(d)) <= 0.03 + 1e-5 * F.abs(F.round(d))).alias("close_"), (~F.isnan(F.col("start") / F.lit(1e6)) & (F.abs(F.col("start") / F.lit(1e6)) != float("inf"))).alias("finite_"))


@query("session_window_stream", E_SQL + f""",
g as (select *, case when us - lag(us) over w > {6 * HOUR} or lag(us) over w is null then 1 else 0 end as f from e window w as (partition by user_id order by us)),
a as (select *, sum(f) over (partition by user_id order by us, event_id rows unbounded preceding) as k from g)
select user_id, min(us) as start_us, max(us) + {6 * HOUR} as end_us, count(*) as n from a group by user_id, k""")  # fmt: skip
def session_window_stream(spark, sf_dir):
    from quillfern.streaming.sessions import sessions

    return sessions(table(spark, sf_dir, "events"), "6 hours")


@query("topk_first_max", N_SQL + """ select user_id, min(event_id) filter (where r1 = 1) as top_event, min(event_id) filter (where r2 = 1) as low_event from
(select *, row_number() over (partition by user_id order by value desc, i) as r1, row_number() over (partition by user_id order by value, i) as r2 from n) group by 1""")  # fmt: skip
def topk_first_max(spark, sf_dir):
    key = F.struct("us", "event_id")
    return events(spark, sf_dir).groupBy("user_id").agg(F.min_by("event_id", F.struct(-F.col("value"), key)).alias("top_event"), F.min_by("event_id", F.struct(F.col("value"), key)).alias("low_event"))


@query("change_audit", N_SQL + """ select event_id, user_id, p as before_, value as after_ from (select *, lag(value) over (partition by user_id order by i) as p from n) where p is not null and p is distinct from value""")
def change_audit(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("before_", F.lag("value").over(S.over("user_id", ["us", "event_id"])))
    return e.where(F.col("before_").isNotNull() & ~F.col("before_").eqNullSafe(F.col("value"))).select("event_id", "user_id", "before_", F.col("value").alias("after_"))


@query("anchor_bounds", N_SQL + """ select user_id, min(i) filter (where a) - 1 as gap_start, max(i) - max(i) filter (where a) as gap_end, min(us) filter (where a) as first_us, max(us) filter (where a) as last_us from (select *, event_type <> 'error' as a from n) group by 1""")
def anchor_bounds(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("i", F.row_number().over(S.over("user_id", ["us", "event_id"])).cast("long"))
    a = F.col("event_type") != "error"
    return e.groupBy("user_id").agg((F.min(F.when(a, F.col("i"))) - 1).alias("gap_start"), (F.max("i") - F.max(F.when(a, F.col("i")))).alias("gap_end"), F.min(F.when(a, F.col("us"))).alias("first_us"), F.max(F.when(a, F.col("us"))).alias("last_us"))


@query("later_minimum", N_SQL + " select event_id, user_id, min(value) over (partition by user_id order by i rows between 1 following and unbounded following) as later_min from n")
def later_minimum(spark, sf_dir):
    w = S.following("user_id", ["us", "event_id"])
    return events(spark, sf_dir).select("event_id", "user_id", F.min("value").over(w).alias("later_min"))


@query("rms_frames", N_SQL + """,
k as (select user_id, value, i - 1 as x, unnest(range(greatest(0, cast(ceil((i - 8) / 4.0) as bigint)), (i - 1) // 4 + 1)) as frame from n)
select user_id, frame, round(sqrt(avg(value * value)), 6) as rms from k group by 1, 2 having count(*) = 8""")  # fmt: skip
def rms_frames(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("x", F.row_number().over(S.over("user_id", ["us", "event_id"])).cast("long") - 1)
    return S.framed_rms(e, "user_id", "x", "value", 4, 8).select("user_id", "frame", F.round("rms", 6).alias("rms"))


@query("frame_grid", N_SQL + """ select event_id, user_id, i * 220 as sample, cast(round(i * 220 * 1000000.0 / 44100) as bigint) as at_us, cast(ceil(i / 7.0) as bigint) as n_chunks, cast(round(220 / (1 - 0.75)) as bigint) as frame_size, round(i * 220 / 44100.0, 3) as at_s from n""")
def frame_grid(spark, sf_dir):
    i = F.row_number().over(S.over("user_id", ["us", "event_id"])).cast("long")
    e = events(spark, sf_dir).withColumn("i", i)
    hop = 220  # int(44100 / 1000 * 5 ms)
    return e.select("event_id", "user_id", (F.col("i") * hop).alias("sample"), F.round(F.col("i") * hop * 1e6 / 44100).cast("long").alias("at_us"), F.ceil(F.col("i") / 7.0).cast("long").alias("n_chunks"), F.lit(round(hop / (1 - 0.75))).cast("long").alias("frame_size"), F.round(F.col("i") * hop / F.lit(44100.0), 3).alias("at_s"))


@query("transpose_sources", FRAME_SQL.replace("max(value) as peak", "max(value) filter (where event_type = 'click') as peak, max(value) filter (where event_type = 'view') as v, max(value) filter (where event_type = 'error') as x").split("r as (")[0].rstrip().rstrip(",") + " select user_id, hour, peak as click, v as view_, x as error_ from h")
def transpose_sources(spark, sf_dir):
    e = events(spark, sf_dir).withColumn("hour", F.floor(F.col("us") / F.lit(HOUR)).cast("long"))
    wide = e.groupBy("user_id", "hour").pivot("event_type", ["click", "view", "error"]).agg(F.max("value"))
    return wide.select("user_id", "hour", "click", F.col("view").alias("view_"), F.col("error").alias("error_"))
