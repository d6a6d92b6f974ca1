"""Queries whose operators go step by step within a group, and similarity functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillfern.functions import phonetic as P
from quillfern.functions import signal
from quillfern.functions.text import strip_punctuation
from quillfern.operators import grouped as G
from quillfern.operators import seams
from quillfern.plans import step_sql as Q
from quillfern.plans.catalogue import query
from quillfern.plans.q_series import activity, events, hourly
from quillfern.sources.tables import table


@query("jaro_winkler", "select p_partkey, round(jaro_winkler_similarity(p_name, lower(p_type)), 6) as similarity from part")
def jaro_winkler(spark, sf_dir):
    """Each distinct pair is compared once and joined back."""
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.lower("p_type").alias("b"))
    pairs = p.select("a", "b").distinct().withColumn("similarity", F.round(P.pair_udf(P.jaro_winkler_similarity)("a", "b"), 6))
    return p.join(pairs, ["a", "b"]).select("p_partkey", "similarity")


@query("metaphone_codes", Q.METAPHONE)
def metaphone_codes(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("i", "word"))
    codes = p.select("word").distinct().withColumn("code", P.word_udf(P.metaphone)("word"))
    return p.join(codes, "word").select("p_partkey", "i", "word", "code")


@query("seqmatch_ratio", Q.RATIO)
def seqmatch_ratio(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"), F.lower("p_type").alias("b"))
    pairs = p.select("a", "b").distinct().withColumn("ratio", F.round(P.pair_udf(P.sequence_ratio)("a", "b"), 6))
    return p.join(pairs, ["a", "b"]).select("p_partkey", "ratio", (F.col("ratio") >= 0.6).alias("alike"))


@query("prominent_valleys", Q.VALLEYS)
def prominent_valleys(spark, sf_dir):
    def fn(d: pd.DataFrame) -> pd.DataFrame:
        x = -d["value"].to_numpy()
        at = G.peaks(x)
        p = G.prominences(x, at)
        keep = p >= 5.0
        return pd.DataFrame({"user_id": d["user_id"].iloc[at[keep]].to_numpy(), "event_id": d["event_id"].iloc[at[keep]].to_numpy(), "prominence": np.round(p[keep], 6)})

    return G.per_group(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "user_id long, event_id long, prominence double", fn)


@query("onset_peaks", Q.ONSETS)
def onset_peaks(spark, sf_dir):
    def fn(d: pd.DataFrame) -> pd.DataFrame:
        x = d["value"].to_numpy()
        at = G.onset_peaks(x, 3, 1, 10, 11, 0.07, 3)
        back = G.backtrack(x, at)
        return pd.DataFrame({"user_id": d["user_id"].iloc[at].to_numpy(), "event_id": d["event_id"].iloc[at].to_numpy(), "from_event": d["event_id"].iloc[back].to_numpy()})

    return G.per_group(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "user_id long, event_id long, from_event long", fn)


@query("block_split", Q.SPLIT)
def block_split(spark, sf_dir):
    def fn(d: pd.DataFrame) -> pd.DataFrame:
        level = d["peak"].fillna(0.0).to_numpy()
        n = d["n"].to_numpy()
        wide = np.convolve(n > 0, np.ones(13), "same") > 0
        out = G.split_blocks(wide, n > 1, level, np.flatnonzero(n == 0), 48, 6, 3, 4, 1)
        return pd.DataFrame({"user_id": d["user_id"], "frame": d["frame"], "active": out})

    return G.per_group(hourly(spark, sf_dir), ["user_id"], ["frame"], "user_id long, frame long, active boolean", fn)


@query("bandpass", Q.bandpass_sql(200, 5000, 16000))
def bandpass(spark, sf_dir):
    def fn(d: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"user_id": d["user_id"], "event_id": d["event_id"], "y": np.round(G.bandpass(d["value"].to_numpy(), 200, 5000, 16000), 6)})

    return G.per_group(events(spark, sf_dir), ["user_id"], ["us", "event_id"], "user_id long, event_id long, y double", fn)


@query("spectral_features", Q.SPECTRUM)
def spectral_features(spark, sf_dir):
    def each(batches):
        for d in batches:
            rows = [G.spectrum_db(np.asarray(x, float)) for x in d["embedding"]]
            yield pd.DataFrame({"vec_id": d["vec_id"], "peak_bin": [int(np.argmax(r)) for r in rows], "mean_db": [float(np.round(r.mean(), 6)) for r in rows]})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(each, "vec_id long, peak_bin int, mean_db double")


def _adjacent(spark, sf_dir):
    """All words of each turn and of the one before it."""
    words = F.filter(F.split(strip_punctuation(F.col("text")), r"\s+"), lambda w: w != "")
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn", words.alias("hyp"))
    return c.withColumn("ref", F.lag("hyp").over(W.partitionBy("conv_id").orderBy("turn"))).where("ref is not null")


ALIGNED = "conv_id long, turn long, step int, op string, ref_idx int, hyp_idx int"


@query("token_align")
def token_align(spark, sf_dir):
    def each(batches):
        for d in batches:
            for c, t, r, h in zip(d["conv_id"], d["turn"], d["ref"], d["hyp"], strict=True):
                steps = G.align_tokens(list(r), list(h))
                yield pd.DataFrame({"conv_id": c, "turn": t, "step": range(len(steps)), "op": [s[0] for s in steps], "ref_idx": pd.array([s[1] for s in steps], "Int32"), "hyp_idx": pd.array([s[2] for s in steps], "Int32")})

    return _adjacent(spark, sf_dir).select("conv_id", "turn", "ref", "hyp").mapInPandas(each, ALIGNED)


@query("align_stats")
def align_stats(spark, sf_dir):
    n = lambda op: F.count_if(F.col("op") == op)
    s = token_align(spark, sf_dir).groupBy("conv_id", "turn").agg(n("M").alias("m"), n("S").alias("s"), n("D").alias("d"), n("I").alias("i"))
    wer = (F.col("s") + F.col("d") + F.col("i")) / F.greatest(F.col("m") + F.col("s") + F.col("d"), F.lit(1))
    return s.withColumn("wer", F.round(wer, 6)).withColumn("doubtful", F.col("wer") > 0.5)


@query("sequence_diff", Q.DIFF)
def sequence_diff(spark, sf_dir):
    def each(batches):
        for d in batches:
            fixed = [G.repaired(list(r), list(h)) for r, h in zip(d["ref"], d["hyp"], strict=True)]
            yield pd.DataFrame({"conv_id": d["conv_id"], "turn": d["turn"], "n": [len(f) for f in fixed], "text": [" ".join(f) for f in fixed]})

    return _adjacent(spark, sf_dir).select("conv_id", "turn", "ref", "hyp").mapInPandas(each, "conv_id long, turn long, n int, text string")


@query("edge_interpolate", Q.EDGES)
def edge_interpolate(spark, sf_dir):
    """A user's segments, in units of six hours, are the audio; each makes a line of six words, of which the outer ones lack times."""
    a = activity(spark, sf_dir).select("user_id", "seg", (F.col("start") / 2.16e10).alias("s"), (F.col("stop") / 2.16e10).alias("e"))

    def fn(d: pd.DataFrame) -> pd.DataFrame:
        segs = list(zip(d["s"], d["e"], strict=True))
        lines = [[None if i in ((0,), (5,), (0, 5), (0, 1, 2, 3, 4, 5))[k % 4] else t for i, t in enumerate(G.evenly(*x, 6))] for k, x in enumerate(segs)]
        done, ids = G.fill_edges(lines, [[k] for k in range(len(segs))], segs)
        rows = [(int(d["user_id"][0]), k, i, round(t[0], 3), round(t[1], 3), len(ids[k])) for k, line in enumerate(done) for i, t in enumerate(line)]
        return pd.DataFrame(rows, columns=["user_id", "line", "word", "start_s", "end_s", "n_ids"])

    return G.per_group(a, ["user_id"], ["seg"], "user_id long, line int, word int, start_s double, end_s double, n_ids int", fn)


_CLUSTER_SQL = """
with recursive s as (select distinct l_orderkey as k, l_linenumber as line, l_suppkey % 4 as id from lineitem),
l as (select k, line, list_sort(list(id)) as ids from s group by k, line),
n as (select *, row_number() over (partition by k order by line) as i from l),
r as (select k, i, line, ids as held, 0 as cluster from n where i = 1
  union all select n.k, n.i, n.line, case when list_has_any(r.held, n.ids) then list_distinct(list_concat(r.held, n.ids)) else n.ids end, case when list_has_any(r.held, n.ids) then r.cluster else r.cluster + 1 end
  from r join n on n.k = r.k and n.i = r.i + 1)
select k as l_orderkey, line as l_linenumber, cluster from r"""


@query("cluster_overlap", _CLUSTER_SQL)
def cluster_overlap(spark, sf_dir):
    """Lines of an order that share a supplier group with the running cluster join it: one fold over the order's own lines."""
    found = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set(F.struct(F.col("l_linenumber").alias("line"), (F.col("l_suppkey") % 4).alias("id")))).alias("found"))
    lines = F.array_distinct(F.transform("found", lambda f: f.line))
    own = lambda n: F.transform(F.filter("found", lambda f: f.line == n), lambda f: f.id)
    orders = found.select("l_orderkey", F.transform(lines, lambda n: F.struct(n.alias("l_linenumber"), own(n).alias("ids"))).alias("x"))
    zero = F.struct(F.array().cast("array<bigint>").alias("held"), F.lit(-1).alias("k"), F.array().cast("array<struct<line:int,cluster:int>>").alias("out"))

    def step(a, x):
        joins = (a.k >= 0) & F.arrays_overlap(a.held, x.ids)
        k = F.when(joins, a.k).otherwise(a.k + 1)
        return F.struct(F.when(joins, F.array_union(a.held, x.ids)).otherwise(x.ids).alias("held"), k.alias("k"), F.concat(a.out, F.array(F.struct(x.l_linenumber.alias("line"), k.alias("cluster")))).alias("out"))

    return orders.select("l_orderkey", F.inline(F.aggregate("x", zero, step, lambda a: a.out))).select("l_orderkey", F.col("line").alias("l_linenumber"), "cluster")


@query("resolve_boundaries", Q.BOUNDS)
def resolve_boundaries(spark, sf_dir):
    """Three event types stand for three aligners of the same words; errors are onsets, activity segments the masks."""

    def fn(key: tuple, d: pd.DataFrame, m: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["us", "event_id"], kind="stable")
        zero = int(d["us"].min()) if len(d) else 0
        d = d.assign(t=(d["us"] - zero) / 1e6)
        at = {k: d[d["event_type"] == k] for k in ("click", "view", "purchase", "error")}
        n = min(len(at[k]) for k in ("click", "view", "purchase"))
        span = lambda k, i: (at[k]["t"].iloc[i], at[k]["t"].iloc[i] + 1 + at[k]["value"].iloc[i] / 100)
        words = [{"q": span("click", i), "w": span("view", i), "m": span("purchase", i), "ws": at["view"]["value"].iloc[i] / 500, "ms": at["purchase"]["value"].iloc[i] / 500} for i in range(n)]
        masks = [((a - zero) / 1e6, (b - zero) / 1e6) for a, b in sorted(zip(m["start"].tolist(), m["stop"].tolist(), strict=True))]
        out = G.resolve_bounds(words, np.sort(at["error"]["t"].to_numpy()), masks)
        return pd.DataFrame({"user_id": [int(key[0])] * n, "word": range(n), "start_s": [round(o[0], 3) for o in out], "end_s": [round(o[1], 3) for o in out], "score": [round(float(o[2]), 6) for o in out]})

    e, masks = events(spark, sf_dir).where("user_id is not null"), activity(spark, sf_dir).select("user_id", "start", "stop")
    return e.groupBy("user_id").cogroup(masks.groupBy("user_id")).applyInPandas(fn, "user_id long, word int, start_s double, end_s double, score double")


_MEL_SQL = Q.SPECTRUM.split("d as (")[0] + """pt as (select i, case when m < 15 then m * 200 / 3 else 1000 * pow(6.4, (m - 15) / 27) end as hz from (select i, i * (15 + 27 * ln(8.0) / ln(6.4)) / 9 as m from range(10) t(i))),
w as (select a.i as band, b, greatest(0, least((b * 250.0 - a.hz) / (m.hz - a.hz), (z.hz - b * 250.0) / (z.hz - m.hz))) * 2 / (z.hz - a.hz) as w from pt a join pt m on m.i = a.i + 1 join pt z on z.i = a.i + 2, range(33) t(b))
select vec_id, cast(band as integer) as band, round(sum(p * w), 6) as energy from f join w using (b) group by vec_id, band"""


@query("mel_energy", _MEL_SQL)
def mel_energy(spark, sf_dir):
    """Vectors as frames of 64 samples at 16 kHz: power in eight mel bands."""

    def each(batches):
        filters = signal.mel_filters(16000, 64, 8)
        for d in batches:
            power = np.abs(np.fft.rfft(np.stack(d["embedding"]).astype(float) * signal.hann(64), axis=1)) ** 2
            energy = np.round(power @ filters.T, 6)
            yield pd.DataFrame({"vec_id": np.repeat(d["vec_id"].to_numpy(), 8), "band": np.tile(np.arange(8, dtype=np.int32), len(d)), "energy": energy.reshape(-1)})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(each, "vec_id long, band int, energy double")


@query("pitch_classes", Q.SPECTRUM.split("d as (")[0] + """c as (select vec_id, cast(round(69 + 12 * log2(b * 250.0 / 440)) as bigint) % 12 as class, sum(p) as p from f where b > 0 group by 1, 2)
select vec_id, cast(class as integer) as class, round(p / max(p) over (partition by vec_id), 6) as share from c""")
def pitch_classes(spark, sf_dir):
    """Vectors as frames of 64 samples at 16 kHz: power by pitch class, over the largest of a vector; classes that no bin is near to have no row."""

    def each(batches):
        classes = np.unique(np.round(69 + 12 * np.log2(np.arange(1, 33) * 250.0 / 440)).astype(int) % 12)
        for d in batches:
            power = np.abs(np.fft.rfft(np.stack(d["embedding"]).astype(float) * signal.hann(64), axis=1)) ** 2
            share = np.round(signal.chroma(power.T, 16000, 64)[classes].T, 6)
            yield pd.DataFrame({"vec_id": np.repeat(d["vec_id"].to_numpy(), len(classes)), "class": np.tile(classes.astype(np.int32), len(d)), "share": share.reshape(-1)})

    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding").mapInPandas(each, "vec_id long, class int, share double")


@query("aligner_seam", r"""
with w as (select conv_id * 1000 + turn as segment, turn * 10.0 as s, turn * 10.0 + 8 as e, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as ws from conversations),
i as (select *, unnest(range(0, len(ws))) as i from w)
select segment, 'even' as aligner, cast(i as integer) as word_idx, ws[i + 1] as word, round(s + i * ((e - s) / len(ws)), 6) as start_s, round(s + (i + 1) * ((e - s) / len(ws)), 6) as end_s from i""")
def aligner_seam(spark, sf_dir):
    """A registered aligner on the turns of conversations, whose times are made up from their numbers."""
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    t = F.col("turn") * 10.0
    c = table(spark, sf_dir, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("segment"), t.alias("start"), (t + 8).alias("end"), words.alias("words"))
    return seams.run(c, "aligner", "even").select("segment", "aligner", "word_idx", "word", F.round("start", 6).alias("start_s"), F.round("end", 6).alias("end_s"))
