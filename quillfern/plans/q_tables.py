"""Queries on relational tables, arrays and timed events."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillfern.functions import text as T
from quillfern.operators import intervals as I
from quillfern.plans.catalogue import query
from quillfern.sources.tables import table

DAY = 86_400_000_000


def us(c: str):
    return F.unix_micros(F.col(c).cast("timestamp"))


@query("positional_zip", """
with o as (select o_custkey as k, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders where o_orderstatus = 'F'),
p as (select o_custkey as k, o_orderkey as other, row_number() over (partition by o_custkey order by o_orderkey) as pos from orders where o_orderstatus = 'O')
select k as o_custkey, pos, o_orderkey, other from o join p using (k, pos)""")
def positional_zip(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    a = o.where("o_orderstatus = 'F'").select("o_custkey", "o_orderkey")
    b = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("other"))
    return I.positional_join(a, b, ["o_custkey"], ["o_orderkey"], ["other"]).select("o_custkey", F.col("pos").cast("long").alias("pos"), "o_orderkey", "other")


@query("interval_overlap", f"""
with a as (select o_custkey as k, o_orderkey, epoch_us(o_orderdate) as s, epoch_us(o_orderdate) + {30 * DAY} as e from orders),
b as (select o_custkey as k, o_orderkey as other, s as s2, s + {10 * DAY} as e2 from (select o_custkey, o_orderkey, epoch_us(o_orderdate) as s from orders where o_orderstatus = 'O'))
select k as o_custkey, o_orderkey, other, least(e, e2) - greatest(s, s2) as common_us from a join b using (k) where s < e2 and e > s2 and o_orderkey <> other""")
def interval_overlap(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("s", us("o_orderdate"))
    a = o.select("o_custkey", "o_orderkey", "s", (F.col("s") + 30 * DAY).alias("e"))
    b = o.where("o_orderstatus = 'O'").select("o_custkey", F.col("o_orderkey").alias("other"), F.col("s").alias("s2"), (F.col("s") + 10 * DAY).alias("e2"))
    rows = I.overlap_join(a, b, ["o_custkey"], 30 * DAY, ("s", "e"), ("s2", "e2")).where("o_orderkey <> other")
    return rows.select("o_custkey", "o_orderkey", "other", (F.least("e", "e2") - F.greatest("s", "s2")).alias("common_us"))


@query("dropped_segments", "select c_custkey, c_name from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def dropped_segments(spark, sf_dir):
    used = table(spark, sf_dir, "orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name").join(used, "c_custkey", "left_anti")


@query("midpoint_filter", f"select l_orderkey, l_linenumber, l_partkey, l_suppkey from lineitem join orders on l_orderkey = o_orderkey where (epoch_us(l_shipdate) + epoch_us(o_orderdate)) // 2 between epoch_us(o_orderdate) and epoch_us(o_orderdate) + {20 * DAY}")
def midpoint_filter(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = us("o_orderdate")
    return rows.where(F.floor((us("l_shipdate") + s) / 2).between(s, s + 20 * DAY)).select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")


@query("project_alignment", "select o_orderkey, l_linenumber, l_suppkey, case when l_returnflag in ('A', 'N') then round_even(l_discount, 3) end as start_, case when l_returnflag in ('A', 'N') then round_even(l_discount + l_tax, 3) end as end_ from orders left join lineitem on o_orderkey = l_orderkey")
def project_alignment(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select("o_orderkey").join(table(spark, sf_dir, "lineitem"), F.col("o_orderkey") == F.col("l_orderkey"), "left")
    hit = F.col("l_returnflag").isin("A", "N")
    return rows.select("o_orderkey", "l_linenumber", "l_suppkey", F.when(hit, F.bround("l_discount", 3)).alias("start_"), F.when(hit, F.bround(F.col("l_discount") + F.col("l_tax"), 3)).alias("end_"))


@query("set_ops", """
with e as (select user_id, epoch_us(ts) // 86400000000 as day, event_type from events), c as (select distinct user_id, day from e where event_type = 'click'), p as (select distinct user_id, day from e where event_type = 'purchase')
select 'union' as op, user_id, day from (select * from c union select * from p) union all select 'intersect', user_id, day from (select * from c intersect select * from p)
union all select 'except', user_id, day from (select * from c except select * from p) union all select 'symmetric', user_id, day from ((select * from c except select * from p) union all (select * from p except select * from c))""")
def set_ops(spark, sf_dir):
    """Days of a user with clicks and with purchases: all four operations from one aggregate."""
    e = table(spark, sf_dir, "events").where("event_type in ('click', 'purchase')").withColumn("day", F.floor(us("ts") / F.lit(DAY)).cast("long"))
    flags = e.groupBy("user_id", "day").agg(F.bool_or(F.col("event_type") == "click").alias("c"), F.bool_or(F.col("event_type") == "purchase").alias("p"))
    ops = F.array_compact(F.array(F.lit("union"), F.when(F.col("c") & F.col("p"), "intersect"), F.when(F.col("c") & ~F.col("p"), "except"), F.when(F.col("c") != F.col("p"), "symmetric")))
    return flags.select(F.explode(ops).alias("op"), "user_id", "day")


@query("weighted_blend", "select l_partkey, round(sum(l_quantity * l_extendedprice) / sum(l_quantity), 6) as blended from lineitem group by l_partkey")
def weighted_blend(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_partkey").agg(F.round(F.sum(F.col("l_quantity") * F.col("l_extendedprice")) / F.sum("l_quantity"), 6).alias("blended"))


@query("any_all_flags", "select l_orderkey, bool_or(l_returnflag = 'R') as any_returned, bool_and(l_linestatus = 'F') as all_final, max(length(l_returnflag || l_linestatus)) as widest from lineitem group by l_orderkey")
def any_all_flags(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bool_or(F.col("l_returnflag") == "R").alias("any_returned"), F.bool_and(F.col("l_linestatus") == "F").alias("all_final"), F.max(F.length(F.concat("l_returnflag", "l_linestatus"))).cast("long").alias("widest"))


#: Vectors in long form in DuckDB: x(vec_id, label, k, v), k from 0.
X_SQL = "with x as (select vec_id, label, unnest(range(0, len(embedding))) as k, unnest(embedding)::double as v from embeddings)"


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").withColumn("x", F.transform("embedding", lambda v: v.cast("double")))


@query("overlap_add", X_SQL + """,
c as (select vec_id, k, v, unnest(range(greatest(0, cast(ceil((k - 15) / 8.0) as bigint)), least(6, k // 8) + 1)) as chunk from x),
w as (select vec_id, k, chunk, v * (1 + 0.1 * chunk) as y, least(k - 8 * chunk + 1, 16 - (k - 8 * chunk)) / 8.0 as wt from c)
select vec_id, k, round(sum(y * wt) / sum(wt), 6) as blended from w group by vec_id, k""")
def overlap_add(spark, sf_dir):
    # Chunks of 16 at stride 8, scaled apart, blended again under triangular weights.
    x = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("k", "v"))
    x = x.withColumn("chunk", F.explode(F.sequence(F.greatest(F.lit(0), F.ceil((F.col("k") - 15) / 8.0).cast("int")), F.least(F.lit(6), F.floor(F.col("k") / 8).cast("int")))))
    at = F.col("k") - 8 * F.col("chunk")
    w = F.least(at + 1, 16 - at) / 8.0
    return x.groupBy("vec_id", F.col("k").cast("long").alias("k")).agg(F.round(F.sum(F.col("v") * (1 + 0.1 * F.col("chunk")) * w) / F.sum(w), 6).alias("blended"))


@query("channel_mix", X_SQL + " select vec_id, k % 32 as k, round(avg(v), 6) as mono from x group by 1, 2")
def channel_mix(spark, sf_dir):
    v = _vectors(spark, sf_dir)
    mono = F.zip_with(F.slice("x", 1, 32), F.slice("x", 33, 32), lambda a, b: (a + b) / 2)
    return v.select("vec_id", F.posexplode(mono).alias("k", "m")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("m", 6).alias("mono"))


@query("residual", X_SQL + " select a.vec_id, a.k, round(a.v - b.v, 6) as rest from x a join x b on a.vec_id = b.vec_id and b.k = 63 - a.k")
def residual(spark, sf_dir):
    rest = F.zip_with("x", F.reverse("x"), lambda a, b: a - b)
    return _vectors(spark, sf_dir).select("vec_id", F.posexplode(rest).alias("k", "r")).select("vec_id", F.col("k").cast("long").alias("k"), F.round("r", 6).alias("rest"))


@query("frame_energy", X_SQL + ", e as (select vec_id, any_value(label) as label, sum(v * v) as e from x group by vec_id) select vec_id, round(e, 6) as energy, round(e / max(e) over (partition by label), 6) as share from e")
def frame_energy(spark, sf_dir):
    """The largest energy of each label is an aggregate that is joined back; labels are few and may be hot."""
    e = _vectors(spark, sf_dir).select("vec_id", "label", F.aggregate("x", F.lit(0.0), lambda a, v: a + v * v).alias("e"))
    top = e.groupBy(F.col("label").alias("of")).agg(F.max("e").alias("top"))
    return e.join(top, F.col("label").eqNullSafe(F.col("of"))).select("vec_id", F.round("e", 6).alias("energy"), F.round(F.col("e") / F.col("top"), 6).alias("share"))


@query("slice_frames", X_SQL + " select vec_id, round(sum(v), 6) as total, count(*) as n from x where k >= cast(0.25 * 64 as integer) and k < cast(0.6 * 64 as integer) group by vec_id")
def slice_frames(spark, sf_dir):
    a, b = int(0.25 * 64), int(0.6 * 64)
    part = F.slice("x", a + 1, b - a)
    return _vectors(spark, sf_dir).select("vec_id", F.round(F.aggregate(part, F.lit(0.0), lambda s, v: s + v), 6).alias("total"), F.size(part).cast("long").alias("n"))


@query("shift_average", X_SQL + " select vec_id, k, round(avg(v * (1 + (k + s) / 100.0)), 6) as mean_ from x, (values (0), (3), (7)) t(s) group by 1, 2")
def shift_average(spark, sf_dir):
    # Each shift moves the samples; what stands for the model depends on where a sample then is; the shift is undone before averaging.
    x = _vectors(spark, sf_dir).select("vec_id", F.posexplode("x").alias("k", "v"))
    moved = x.withColumn("s", F.explode(F.array(*map(F.lit, (0, 3, 7))))).withColumn("at", F.col("k") + F.col("s")).withColumn("y", F.col("v") * (1 + F.col("at") / 100.0))
    return moved.groupBy("vec_id", (F.col("at") - F.col("s")).cast("long").alias("k")).agg(F.round(F.avg("y"), 6).alias("mean_"))


@query("positive_difference", X_SQL + ", d as (select vec_id, k, v - lag(v) over (partition by label, k order by vec_id) as d from x) select vec_id, round(avg(greatest(0, d)), 6) as flux from d group by vec_id")
def positive_difference(spark, sf_dir):
    x = _vectors(spark, sf_dir).select("vec_id", "label", F.posexplode("x").alias("k", "v"))
    d = x.withColumn("d", F.col("v") - F.lag("v").over(W.partitionBy("label", "k").orderBy("vec_id")))
    return d.groupBy("vec_id").agg(F.round(F.avg(F.when(F.col("d").isNotNull(), F.greatest(F.lit(0.0), F.col("d"))).otherwise(F.when(F.col("d").isNull(), F.lit(0.0)))), 6).alias("flux"))


#: Word times made from conversations: a word lasts five centiseconds a character, words are ten apart, turns twenty more.
_TIMES_SQL = r"""
with w as (select conv_id, turn, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from (select conv_id, turn, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from conversations)),
t as (select conv_id, turn, i, word, 5 * length(word) as d, sum(5 * length(word) + 10 + case when i = 1 then 20 * (turn % 8) else 0 end) over (partition by conv_id order by turn, i rows unbounded preceding) as e from w),
s as (select conv_id, turn, i, word, cast(e - d as bigint) as s, cast(e as bigint) as e from t),
l as (select conv_id, turn, min(s) as s, max(e) as e, string_agg(word, ' ' order by i) as text from s group by 1, 2)"""


def _lines(spark, sf_dir):
    """Per turn its words with their times, as one array, and the line's first start and last end. Only lines are windowed, never words."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("words")).where(F.size("words") > 0)
    length = lambda ws: F.aggregate(ws, F.lit(0).cast("long"), lambda a, w: a + 5 * F.length(w) + 10)
    rows = rows.withColumn("total", length(F.col("words")) + 20 * (F.col("turn") % 8))
    rows = rows.withColumn("base", F.sum("total").over(W.partitionBy("conv_id").orderBy("turn").rowsBetween(W.unboundedPreceding, 0)) - length(F.col("words")))
    timed = F.transform("words", lambda w, i: F.struct(w.alias("word"), (F.col("base") + length(F.slice("words", 1, i + 1))).alias("e"), (F.col("base") + length(F.slice("words", 1, i + 1)) - 5 * F.length(w)).alias("s")))
    rows = rows.withColumn("w", timed)
    return rows.select("conv_id", "turn", "w", F.array_join("words", " ").alias("text"), F.get("w", F.lit(0)).s.alias("ls"), F.element_at("w", -1).e.alias("le"))


@query("ass_events", _TIMES_SQL + r""",
n as (select *, lead(s) over w as nx from l window w as (partition by conv_id order by turn)),
p as (select *, case when nx is null then e + 100 else e + least((greatest(0, nx - e) * 7) // 10, 150) end as pe from n),
q as (select *, greatest(0, s - 80, coalesce(lag(pe) over (partition by conv_id order by turn), 0)) as ps from p),
k as (select s.*, q.ps, q.pe, q.s as ls, q.e as le, q.text, lead(s.s) over w as ns, lag(s.e) over w as pr from s join q using (conv_id, turn) window w as (partition by s.conv_id, s.turn order by s.i)),
g as (select *, greatest(0, s - greatest(s - 30, coalesce(pr, ps))) as lead_, least((greatest(0, coalesce(ns, pe) - e) * 7) // 10, 60) as tail_ from k)
select conv_id, turn, 'Dialogue: 0,' || printf('%d:%02d:%d.%02d', any_value(ps) // 360000, any_value(ps) // 6000 % 60, any_value(ps) // 100 % 60, any_value(ps) % 100) || ',' || printf('%d:%02d:%d.%02d', any_value(pe) // 360000, any_value(pe) // 6000 % 60, any_value(pe) // 100 % 60, any_value(pe) % 100)
  || ',' || case when regexp_matches(any_value(text), '[一-鿿぀-ヿ가-힯]') then 'CJK_Duet' else 'Lat_Duet' end || ',,0,0,0,,{\fad(' || greatest(0, least(300, (any_value(ls) - any_value(ps)) * 10)) || ',' || greatest(0, least(300, (any_value(pe) - any_value(le)) * 10)) || ')}{\an2}'
  || string_agg('{\kf' || lead_ || '}{\kf' || (e - s) || '}' || word || '{\kf' || tail_ || '} ', '' order by i) as event from g group by conv_id, turn""")
def ass_events(spark, sf_dir):
    """Subtitle events in whole centiseconds: padding depends on the neighbouring lines alone, so lag and lead over lines do; words stay in their line's array."""
    conv = W.partitionBy("conv_id").orderBy("turn")
    zero = F.lit(0).cast("long")
    nx = F.lead("ls").over(conv)
    share = lambda gap: F.floor(F.greatest(zero, gap) * 7 / F.lit(10)).cast("long")
    seg = _lines(spark, sf_dir).withColumn("pe", F.when(nx.isNull(), F.col("le") + 100).otherwise(F.col("le") + F.least(share(nx - F.col("le")), F.lit(150))))
    seg = seg.withColumn("ps", F.greatest(zero, F.col("ls") - 80, F.coalesce(F.lag("pe").over(conv), zero)))

    def token(x, i):
        before = F.when(i == 0, F.col("ps")).otherwise(F.get("w", i - 1).e)
        after = F.coalesce(F.get("w", i + 1).s, F.col("pe"))
        lead, tail = F.greatest(zero, x.s - F.greatest(x.s - 30, before)), F.least(share(after - x.e), F.lit(60))
        return F.concat(F.lit("{\\kf"), lead, F.lit("}{\\kf"), x.e - x.s, F.lit("}"), x.word, F.lit("{\\kf"), tail, F.lit("} "))

    fade = lambda d: F.greatest(zero, F.least(F.lit(300).cast("long"), d * 10))
    style = F.when(T.has_cjk(F.col("text")), "CJK_Duet").otherwise("Lat_Duet")
    body = F.array_join(F.transform("w", token), "")
    return seg.select("conv_id", "turn", F.concat(F.lit("Dialogue: 0,"), T.ass_time(F.col("ps")), F.lit(","), T.ass_time(F.col("pe")), F.lit(","), style, F.lit(",,0,0,0,,{\\fad("), fade(F.col("ls") - F.col("ps")), F.lit(","), fade(F.col("pe") - F.col("le")), F.lit(")}{\\an2}"), body).alias("event"))


@query("subtitle_legacy", _TIMES_SQL + r""",
q as (select *, greatest(0, s - 80, coalesce(lag(e + 10) over (partition by conv_id order by turn), 0)) as ds, e + 10 as de from l),
k as (select s.*, q.ds, q.de, q.s as ls, q.text, s.s - coalesce(lag(s.e) over (partition by s.conv_id, s.turn order by s.i), q.ds) as gap from s join q using (conv_id, turn))
select conv_id, turn, printf('%d:%02d:%02d.%02d', any_value(ds) // 360000, any_value(ds) // 6000 % 60, any_value(ds) // 100 % 60, any_value(ds) % 100) as shown, printf('%d:%02d:%02d.%02d', any_value(de) // 360000, any_value(de) // 6000 % 60, any_value(de) // 100 % 60, any_value(de) % 100) as hidden,
  string_agg(case when gap > 1 then '{\kf' || gap || '} ' else '' end || '{\kf' || greatest(1, e - s) || '}' || word || ' ', '' order by i) || '{\kf10}' as body,
  case when regexp_matches(any_value(text), '[一-鿿぀-ヿ가-힯]') then 'CJK_Duet' else 'Lat_Duet' end || ',,20,20,50,,{\fad(' || greatest(0, least(300, (any_value(ls) - any_value(ds)) * 10)) || ',200)}{\an2}' as lead from k group by conv_id, turn""")
def subtitle_legacy(spark, sf_dir):
    conv = W.partitionBy("conv_id").orderBy("turn")
    zero = F.lit(0).cast("long")
    seg = _lines(spark, sf_dir).withColumn("de", F.col("le") + 10)
    seg = seg.withColumn("ds", F.greatest(zero, F.col("ls") - 80, F.coalesce(F.lag("de").over(conv), zero)))

    def token(x, i):
        gap = x.s - F.when(i == 0, F.col("ds")).otherwise(F.get("w", i - 1).e)
        return F.concat(F.when(gap > 1, F.concat(F.lit("{\\kf"), gap, F.lit("} "))).otherwise(""), F.lit("{\\kf"), F.greatest(F.lit(1).cast("long"), x.e - x.s), F.lit("}"), x.word, F.lit(" "))

    body = F.concat(F.array_join(F.transform("w", token), ""), F.lit("{\\kf10}"))
    return seg.select("conv_id", "turn", T.legacy_time(F.col("ds")).alias("shown"), T.legacy_time(F.col("de")).alias("hidden"), body.alias("body"), T.legacy_lead(F.col("text"), F.col("ls") - F.col("ds")).alias("lead"))


@query("monotonic_clamp", """
with recursive n as (select conv_id, length(text) % 100 as v, row_number() over (partition by conv_id order by turn) as i from conversations),
r as (select conv_id, i, v as c, v + 10 as e from n where i = 1 union all select n.conv_id, n.i, greatest(r.e, n.v), greatest(r.e, n.v) + 10 from r join n on n.conv_id = r.conv_id and n.i = r.i + 1)
select conv_id, max(i) as n, cast(sum(c) as bigint) as total, max(e) as last_end from r group by conv_id""")
def monotonic_clamp(spark, sf_dir):
    """Starts that lie before the previous end move there; a fold over one conversation's turns."""
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", (F.length("text") % 100).cast("long").alias("v")))).alias("x"))
    zero = F.struct(F.lit(0).cast("long").alias("e"), F.lit(0).cast("long").alias("total"))

    def step(a, x):
        s = F.greatest(a.e, x.v)
        return F.struct((s + 10).alias("e"), (a.total + s).alias("total"))

    done = c.withColumn("r", F.aggregate("x", zero, step))
    return done.select("conv_id", F.size("x").cast("long").alias("n"), F.col("r.total").alias("total"), F.col("r.e").alias("last_end"))
