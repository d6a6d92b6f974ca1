"""Queries on media records, settings, spans of characters and merged lists of times."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillfern.functions import media as M
from quillfern.functions import text as T
from quillfern.operators import intervals as I
from quillfern.plans.catalogue import query
from quillfern.plans.q_series import E_SQL, N_SQL, events
from quillfern.sources.tables import table

WORDS = r"[^\x20\x09-\x0D]+"


def _words(c):
    return F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")


@query("hypothesis_filter", f"select conv_id, turn, i - 1 as word_idx, words[i] as word, score from (select *, unnest(range(1, len(words) + 1)) as i, round(1.0 / length(words[i]), 6) as score from (select conv_id, turn, regexp_extract_all(text, '{WORDS}') as words from conversations)) where score > 0.1")
def hypothesis_filter(spark, sf_dir):
    """Recognised words count if their score is above 0.1; here a word's score falls with its length."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.posexplode(_words("text")).alias("word_idx", "word"))
    rows = rows.withColumn("score", F.round(1.0 / F.length("word"), 6))
    return M.confident(rows, "score").select("conv_id", "turn", F.col("word_idx").cast("long").alias("word_idx"), "word", "score")


@query("char_spans_to_words", rf"""
with w as (select conv_id, turn, regexp_extract_all(text, '{WORDS}') as ws from conversations),
i as (select conv_id, turn, ws, unnest(range(1, len(ws) + 1)) as i from w),
o as (select conv_id, turn, i - 1 as word_idx, cast(coalesce(list_sum(list_transform(ws[1:i - 1], lambda x: length(x))), 0) as bigint) as a, length(ws[i]) as n from i)
select conv_id, turn, word_idx, cast(320 * (2 * a) as bigint) / 16000.0 as start_s, cast(320 * (2 * (a + n - 1) + 1) as bigint) / 16000.0 as end_s,
  round(list_avg(list_transform(range(a, a + n), lambda k: 1.0 / (1 + k % 7))), 6) as score from o""")
def char_spans_to_words(spark, sf_dir):
    """Characters of a line have spans of frames; a word takes those of its characters: first start, last end, mean score."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", _words("text").alias("words"))
    n = F.aggregate("words", F.lit(0), lambda a, w: a + F.length(w))
    spans = F.transform(F.sequence(F.lit(0), n - 1), lambda k: F.struct((2 * k).alias("start"), (2 * k + 1).alias("end"), (1.0 / (1 + k % 7)).alias("score")))
    rows = rows.where(F.size("words") > 0).withColumn("spans", spans)
    return rows.select("conv_id", "turn", F.inline(M.word_spans(F.col("words"), F.col("spans"), 320, 16000))).select(
        "conv_id", "turn", F.col("word_idx").cast("long").alias("word_idx"), "start_s", "end_s", F.round("score", 6).alias("score")
    )


@query("zip_aligners", E_SQL + """,
t as (select *, row_number() over (partition by user_id, event_type order by us, event_id) as pos from e where event_type in ('click', 'view', 'purchase')),
c as (select user_id, count(*) filter (where event_type = 'click') = count(*) filter (where event_type = 'view') and count(*) filter (where event_type = 'click') = count(*) filter (where event_type = 'purchase') as even from t group by 1)
select a.user_id, a.pos, a.event_id as a, b.event_id as b, d.event_id as c, even from t a join t b on b.user_id = a.user_id and b.pos = a.pos and b.event_type = 'view'
join t d on d.user_id = a.user_id and d.pos = a.pos and d.event_type = 'purchase' join c on c.user_id = a.user_id where a.event_type = 'click'""")  # fmt: skip
def zip_aligners(spark, sf_dir):
    """Three aligners' words of one line are put side by side by position; lines whose counts differ are marked."""
    e = events(spark, sf_dir).where(F.col("event_type").isin("click", "view", "purchase"))
    return I.positional_zip(e, ["user_id"], "event_type", ["us", "event_id"], "event_id", {"click": "a", "view": "b", "purchase": "c"}).select("user_id", F.col("pos").cast("long").alias("pos"), "a", "b", "c", "even")


@query("ordered_onsets", E_SQL + """,
o as (select user_id, us as t, case event_type when 'error' then 0 when 'view' then 1 when 'signup' then 2 else 3 end as src from e where event_type in ('error', 'view', 'signup', 'purchase')),
c as (select user_id, event_id, us from e where event_type = 'click'),
j as (select c.event_id, c.user_id, o.t, o.src, row_number() over (partition by c.event_id order by abs(o.t - c.us), o.src, o.t) as k from c join o on o.user_id = c.user_id where o.t > c.us - 86400000000 and o.t < c.us + 86400000000)
select event_id, user_id, t as onset_us, src from j where k = 1""")  # fmt: skip
def ordered_onsets(spark, sf_dir):
    """Lists of onsets from several detectors as one; the nearest to each click within a day, ties by detector, then by time."""
    e = events(spark, sf_dir)
    kind = {"error": 0, "view": 1, "signup": 2, "purchase": 3}
    src = F.create_map(*(F.lit(x) for kv in kind.items() for x in kv))
    onsets = e.where(F.col("event_type").isin(*kind)).select("user_id", F.col("us").alias("t"), src[F.col("event_type")].alias("src"))
    clicks = e.where("event_type = 'click'").select("user_id", "event_id", "us")
    rows = I.nearest_of_many(clicks, onsets, ["user_id"], "us", "t", "src", 86_400_000_000)
    return rows.select("event_id", "user_id", F.col("t").alias("onset_us"), "src")


@query("channel_convert", """with v as (select vec_id, embedding::double[] as x from embeddings),
c as (select vec_id, [x[1:16], x[17:32], x[33:48], x[49:64]] as ch from v),
o as (select vec_id, 'same' as kind, ch as y from c union all select vec_id, 'mono', [list_transform(range(1, 17), lambda k: (ch[1][k] + ch[2][k] + ch[3][k] + ch[4][k]) / 4)] from c
  union all select vec_id, 'first', ch[1:2] from c union all select vec_id, 'replicate', [ch[1], ch[1], ch[1]] from c),
e as (select vec_id, kind, unnest(range(1, len(y) + 1)) as n, unnest(y) as z from o)
select vec_id, kind, n - 1 as channel, round(list_sum(list_transform(z, lambda s, k: s * k)), 6) as mark from e""")  # fmt: skip
def channel_convert(spark, sf_dir):
    """Four channels kept, mixed to one, cut to the first two, and one channel copied to three."""
    x = F.transform("embedding", lambda v: v.cast("double"))
    c = table(spark, sf_dir, "embeddings").select("vec_id", F.array(*(F.slice(x, 16 * k + 1, 16) for k in range(4))).alias("ch"))
    one = F.slice("ch", 1, 1)
    kinds = {"same": M.convert_channels(F.col("ch"), 4), "mono": M.convert_channels(F.col("ch"), 1), "first": M.convert_channels(F.col("ch"), 2), "replicate": M.convert_channels(one, 3)}
    rows = c.select("vec_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), v.alias("y")) for k, v in kinds.items()))).alias("o"))
    rows = rows.select("vec_id", "o.kind", F.posexplode("o.y").alias("channel", "z"))
    mark = F.aggregate(F.transform("z", lambda s, k: s * (k + 1)), F.lit(0.0), lambda a, s: a + s)
    return rows.select("vec_id", "kind", F.col("channel").cast("long").alias("channel"), F.round(mark, 6).alias("mark"))


@query("destandardize", """with w as (select l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice as x, avg(l_extendedprice) over w as m, stddev_samp(l_extendedprice) over w + 1e-8 as s from lineitem window w as (partition by l_suppkey))
select l_orderkey, l_linenumber, l_partkey, l_suppkey, round((x - m) / s * s + m, 4) as restored, round((x - m) / s * s + m, 4) = round(x, 4) as same from w""")  # fmt: skip
def destandardize(spark, sf_dir):
    from quillfern.operators import series as S

    rows = S.standardize(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", keep=True)
    rows = rows.withColumn("restored", F.round(S.destandardized("standardized", "standardized_mean", "standardized_std"), 4))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "restored", (F.col("restored") == F.round("l_extendedprice", 4)).alias("same"))


@query("refinement_chunk", E_SQL + """,
p as (select user_id, us // 86400000000 as day, min(us) filter (where event_type = 'click') as qs, max(us) filter (where event_type = 'click') as qe, min(us) filter (where event_type = 'view') as ws, max(us) filter (where event_type = 'view') as we, min(us) as s, max(us) as e from e group by 1, 2)
select user_id, day, least(qs, ws, s) as chunk_start, least(greatest(qe, we), e) as chunk_end, greatest(0, greatest(least(s, ws), s - 1000000) - 500000) as pad_start, least(greatest(e, we), e + 1000000) + 500000 as pad_end from p""")  # fmt: skip
def refinement_chunk(spark, sf_dir):
    """The chunk that all aligners' words of a day lie in, and the padded window that is cut out for an aligner."""
    e = events(spark, sf_dir).withColumn("day", F.floor(F.col("us") / F.lit(86_400_000_000)).cast("long"))
    of = lambda f, k: f(F.when(F.col("event_type") == k, F.col("us")))
    p = e.groupBy("user_id", "day").agg(of(F.min, "click").alias("qs"), of(F.max, "click").alias("qe"), of(F.min, "view").alias("ws"), of(F.max, "view").alias("we"), F.min("us").alias("s"), F.max("us").alias("e"))
    start, end = M.padded(F.col("s"), F.col("e"), F.col("ws"), F.col("we"), 1_000_000, 500_000)
    return p.select("user_id", "day", F.least("qs", "ws", "s").alias("chunk_start"), F.least(F.greatest("qe", "we"), F.col("e")).alias("chunk_end"), start.alias("pad_start"), end.alias("pad_end"))


@query("reset_times", N_SQL + " select event_id, user_id, event_type, cast(null as bigint) as start_us, us as was_us from n")
def reset_times(spark, sf_dir):
    """Times are emptied before they are found anew; what they were stays beside them."""
    e = events(spark, sf_dir).withColumn("start_us", F.col("us"))
    return M.reset(e, ["start_us"], "was_").select("event_id", "user_id", "event_type", "start_us", F.col("was_start_us").alias("was_us"))


@query("lyrics_preference", "select page_id, coalesce(nullif(regexp_extract(html, '<p>([^<]*)</p>', 1), ''), nullif(regexp_extract(html, '<title>([^<]*)</title>', 1), '')) as lyrics from pages")
def lyrics_preference(spark, sf_dir):
    """The plain text of a record if there is any, else the other one."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", M.first_said(F.regexp_extract("html", "<p>([^<]*)</p>", 1), F.regexp_extract("html", "<title>([^<]*)</title>", 1)).alias("lyrics"))


@query("clock_labels", """with t as (select event_id, case when event_id % 11 <> 0 then cast(floor(value * 100 + 0.5) as bigint) end as cs from events)
select event_id, case when cs is null then '--:--.--' else printf('%02d:%02d.%02d', cs // 6000, cs // 100 % 60, cs % 100) end as label from t""")  # fmt: skip
def clock_labels(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.hms(F.when(F.col("event_id") % 11 != 0, F.floor(F.col("value") * 100 + 0.5) / 100)).alias("label"))


@query("setting_values", """with s as (select c_custkey, case c_custkey % 8 when 0 then 'True' when 1 then 'yes' when 2 then '0' when 3 then 'off' when 4 then 'None' when 5 then '' when 6 then c_mktsegment else null end as raw from customer),
v as (select c_custkey, raw, case when lower(trim(raw)) in ('none', '') then null when lower(trim(raw)) in ('true', 'yes', 'on', '1') then true when lower(trim(raw)) in ('false', 'no', 'off', '0') then false end as flag from s)
select c_custkey, flag, case when lower(trim(raw)) in ('none', '') then null else raw end as text, coalesce(case when c_custkey % 3 = 0 then 'cli' end, case when c_custkey % 5 = 0 then 'env' end, 'default') as origin from v""")  # fmt: skip
def setting_values(spark, sf_dir):
    """Settings as text become flags or nothing; the command line goes before the environment, that before the default."""
    c = table(spark, sf_dir, "customer")
    raw = F.element_at(F.array(F.lit("True"), F.lit("yes"), F.lit("0"), F.lit("off"), F.lit("None"), F.lit(""), F.col("c_mktsegment"), F.lit(None).cast("string")), (F.col("c_custkey") % 8 + 1).cast("int"))
    c = c.withColumn("raw", raw)
    origin = M.first_said(F.when(F.col("c_custkey") % 3 == 0, "cli"), F.when(F.col("c_custkey") % 5 == 0, "env"), F.lit("default"))
    return c.select("c_custkey", M.as_flag(F.col("raw")).alias("flag"), M.as_setting(F.col("raw")).alias("text"), origin.alias("origin"))


@query("option_ladder", """with p as (select page_id, case when page_id % 4 = 0 then 'cookies.txt' end as cookie, case when page_id % 3 = 0 then 'firefox' when page_id % 5 = 0 then 'chrome' end as browser, case when page_id % 7 = 0 then 'http://proxy' end as proxy from pages)
select page_id, case when cookie is not null then 'cookie file' when browser is not null then 'browser' else 'anonymous' end as method, cookie is null and browser is null as anonymous,
  to_json(struct_pack(cookiefile := cookie, cookiesfrombrowser := case when cookie is null then browser end, proxy := proxy)) as options from p""".replace("to_json(struct_pack(cookiefile := cookie, cookiesfrombrowser := case when cookie is null then browser end, proxy := proxy)) as options", "concat_ws('&', case when cookie is not null then 'cookiefile=' || cookie end, case when cookie is null and browser is not null then 'cookiesfrombrowser=' || browser end, case when proxy is not null then 'proxy=' || proxy end) as options"))  # fmt: skip
def option_ladder(spark, sf_dir):
    """Options of a download: a cookie file goes before a browser, that before none; a proxy only if there is one."""
    n = F.col("page_id")
    p = table(spark, sf_dir, "pages").select("page_id", F.when(n % 4 == 0, "cookies.txt").alias("cookie"), F.when(n % 3 == 0, "firefox").when(n % 5 == 0, "chrome").alias("browser"), F.when(n % 7 == 0, "http://proxy").alias("proxy"))
    method, options = M.download_options(F.col("cookie"), F.col("browser"), F.col("proxy"))
    return p.select("page_id", method.alias("method"), (method == "anonymous").alias("anonymous"), options.alias("options"))


@query("probe_order", """with c as (select p_brand as host, p_type as program, p_partkey % 7 as place, p_size > 10 as found from part)
select host, program from (select host, program, row_number() over (partition by host order by place, program) as k from c where found) where k = 1""")  # fmt: skip
def probe_order(spark, sf_dir):
    """Of the programs found on a host the first in a fixed order of preference."""
    c = table(spark, sf_dir, "part").where("p_size > 10").select(F.col("p_brand").alias("host"), F.col("p_type").alias("program"), (F.col("p_partkey") % 7).alias("place"))
    return c.groupBy("host").agg(F.min_by("program", F.struct("place", "program")).alias("program"))


@query("tolerant_json", """with r as (select event_id, case event_id % 5 when 0 then '{"k": ' when 1 then '[1]' else props end as body, case event_id % 7 when 0 then 429 when 1 then 404 when 2 then 500 else 200 end as status from events)
select event_id, case when status = 200 and json_valid(body) and json_type(body) = 'OBJECT' then cast(json_extract(body, '$.k') as bigint) end as k, status <> 200 or not json_valid(body) as failed from r""")  # fmt: skip
def tolerant_json(spark, sf_dir):
    """Answers of a service: other codes than 200 and broken JSON give nothing instead of an error; what is no record gives no record."""
    e = table(spark, sf_dir, "events")
    n = F.col("event_id")
    r = e.select("event_id", F.when(n % 5 == 0, '{"k": ').when(n % 5 == 1, "[1]").otherwise(F.col("props")).alias("body"), F.when(n % 7 == 0, 429).when(n % 7 == 1, 404).when(n % 7 == 2, 500).otherwise(200).alias("status"))
    good = M.tolerant(F.col("status"), F.col("body"))
    return r.select("event_id", F.from_json(good, "k bigint").k.alias("k"), good.isNull().alias("failed"))


@query("ctc_tokens", rf"""with w as (select item_id, list_transform(regexp_extract_all(text, '{WORDS}'), lambda x: regexp_replace(replace(translate(lower(x), '{T.ACCENTED}', '{T.PLAIN}'), 'ß', 'ss'), '[^a-z]', '', 'g')) as ws from benchmark)
select item_id, '*' || array_to_string(list_transform(ws, lambda x: x || '*'), '') as tokens, cast(1 + len(ws) + coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) as bigint) as n from w""")  # fmt: skip
def ctc_tokens(spark, sf_dir):
    """Tokens of a forced aligner: the letters of each word between separators, one separator at both ends."""
    b = table(spark, sf_dir, "benchmark")
    tokens = M.separated_letters(_words("text"))
    return b.select("item_id", F.array_join(tokens, "").alias("tokens"), F.size(tokens).cast("long").alias("n"))


@query("command_list", "select p_type as name, count(*) as n, cast(row_number() over (order by p_type) as bigint) as place, max(length(p_type)) over () as width from part group by p_type")
def command_list(spark, sf_dir):
    """Names in order with the widest one's width; the names are few (part types), so one window over them is bounded."""
    c = table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count(F.lit(1)).alias("n"))
    return c.select("name", "n", F.row_number().over(W.orderBy("name")).cast("long").alias("place"), F.max(F.length("name").cast("long")).over(W.partitionBy()).alias("width"))


@query("transfer_progress", N_SQL + """,
r as (select user_id, i, cast(trunc(value) as bigint) as done, event_type = 'signup' as last from n),
m as (select *, coalesce(max(done) over w, 0) as seen, coalesce(bool_or(last) over w, false) as over_ from r window w as (partition by user_id order by i rows between unbounded preceding and 1 preceding))
select cast(user_id as varchar) as key, case when last then 'finished' else 'downloading' end as status, greatest(done, seen, 0) as done, greatest(0, done - greatest(seen, 0)) as delta from m where not over_ and (done > greatest(seen, 0) or last) and user_id is not null""")  # fmt: skip
def transfer_progress(spark, sf_dir):
    """Reports of running transfers: what came since the last one, until a transfer is finished."""
    from quillfern.operators import series as S
    from quillfern.streaming.progress import progress

    e = events(spark, sf_dir).withColumn("i", F.row_number().over(S.over("user_id", ["us", "event_id"])))
    return progress(e.withColumn("done", F.col("value").cast("long")).withColumn("last", F.col("event_type") == "signup"), "user_id", "i", "done", "last")


@query("download_chunks", "select page_id, k as chunk, k * 512 as from_, least((k + 1) * 512, strlen(html)) as to_ from (select page_id, html, unnest(range(0, cast(ceil(strlen(html) / 512.0) as bigint))) as k from pages)")
def download_chunks(spark, sf_dir):
    """The byte ranges in which a file is fetched."""
    size = F.octet_length("html").cast("long")
    return M.chunks(table(spark, sf_dir, "pages").select("page_id", size.alias("size")), "size", 512).select("page_id", "chunk", "from_", "to_")


@query("registry_entries", """with r as (select p_partkey, case when p_partkey % 4 = 0 then '{"config_yaml": "m.yaml", "is_roformer": true}' else '{"compensate": ' || (1 + p_size / 100.0) || ', "mdx_dim_f_set": ' || p_size || ', "primary_stem": "Vocals"}' end as body from part)
select p_partkey, cast(json_extract(body, '$.compensate') as double) as compensate, cast(json_extract(body, '$.mdx_dim_f_set') as integer) as dim_f, json_extract_string(body, '$.primary_stem') as stem,
  coalesce(cast(json_extract(body, '$.is_roformer') as boolean), false) as roformer from r""")  # fmt: skip
def registry_entries(spark, sf_dir):
    """Entries of a model registry: one record type for all models, with what an entry lacks empty."""
    from quillfern.sources.files import REGISTRY

    p = table(spark, sf_dir, "part")
    body = F.when(F.col("p_partkey") % 4 == 0, '{"config_yaml": "m.yaml", "is_roformer": true}').otherwise(F.concat(F.lit('{"compensate": '), 1 + F.col("p_size") / 100, F.lit(', "mdx_dim_f_set": '), "p_size", F.lit(', "primary_stem": "Vocals"}')))
    r = p.select("p_partkey", F.from_json(body, REGISTRY).alias("e"))
    return r.select("p_partkey", "e.compensate", F.col("e.mdx_dim_f_set").alias("dim_f"), F.col("e.primary_stem").alias("stem"), F.coalesce("e.is_roformer", F.lit(False)).alias("roformer"))


@query("audio_streams", """with s as (select o_orderkey, o_custkey % 3 as a, length(o_orderpriority) % 2 as v from orders)
select o_orderkey, cast(a as bigint) as n_audio, case when a > 0 then 2 end as channels, case when a > 0 then 44100 end as rate from s""")  # fmt: skip
def audio_streams(spark, sf_dir):
    """Of a probe's streams only those of audio count; the first one's channels and rate."""
    o = table(spark, sf_dir, "orders")
    kinds = F.concat(F.array_repeat(F.lit("video"), (F.length("o_orderpriority") % 2).cast("int")), F.array_repeat(F.lit("audio"), (F.col("o_custkey") % 3).cast("int")))
    streams = F.transform(kinds, lambda k, i: F.struct(k.alias("codec_type"), (F.when(k == "audio", 2).otherwise(0)).alias("channels"), F.lit("44100").alias("sample_rate")))
    audio = F.filter(streams, lambda s: s.codec_type == "audio")
    return o.select("o_orderkey", F.size(audio).cast("long").alias("n_audio"), F.get(audio, F.lit(0)).channels.alias("channels"), F.get(audio, F.lit(0)).sample_rate.try_cast("int").alias("rate"))
