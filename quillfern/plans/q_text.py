"""Queries on texts, titles, messages and candidates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillfern.functions import text as T
from quillfern.operators import intervals as I
from quillfern.plans.catalogue import query
from quillfern.sources.tables import table

WORDS = r"[^\x20\x09-\x0D]+"
TITLE = "<title>([^<]*)</title>"


@query("scan_project_defaults", "select c_custkey, coalesce(nullif(c_name, ''), 'unknown') as name, coalesce(nullif(c_mktsegment, ''), 'Unknown') as segment, coalesce(c_acctbal, 0.0) as balance from customer")
def scan_project_defaults(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", F.coalesce(F.nullif("c_name", F.lit("")), F.lit("unknown")).alias("name"), F.coalesce(F.nullif("c_mktsegment", F.lit("")), F.lit("Unknown")).alias("segment"), F.coalesce("c_acctbal", F.lit(0.0)).alias("balance"))


@query("source_dispatch", "select page_id, case when lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*):', 1)) in ('http', 'https') then 'download' when url is null then 'error' else 'file' end as route, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) as host from pages")
def source_dispatch(spark, sf_dir):
    p = table(spark, sf_dir, "pages")
    scheme = F.lower(F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    return p.select("page_id", F.when(scheme.isin("http", "https"), "download").when(F.col("url").isNull(), "error").otherwise("file").alias("route"), F.try_parse_url("url", F.lit("HOST")).alias("host"))


@query("json_props", "select event_id, cast(json_extract(props, '$.k') as bigint) as k, json_valid(props) as valid from events")
def json_props(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    parsed = F.from_json("props", "k bigint")
    return e.select("event_id", parsed.k.alias("k"), F.try_parse_json("props").isNotNull().alias("valid"))


@query("tokenize_lines", rf"""
with l as (select doc_id, unnest(range(1, len(ls) + 1)) as li, unnest(ls) as line from (select doc_id, string_split(text, chr(10)) as ls from documents)),
k as (select doc_id, li - 1 as line_idx, regexp_extract_all(line, '{WORDS}') as ws from l where trim(line) <> '' and not starts_with(line, '['))
select doc_id, line_idx, unnest(range(0, len(ws))) as word_idx, unnest(ws) as word from k""")
def tokenize_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    lines = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_idx", "line")).where((F.trim("line") != "") & ~F.startswith("line", F.lit("[")))
    words = F.filter(F.split("line", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return lines.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), F.posexplode(words).alias("word_idx", "word")).withColumn("word_idx", F.col("word_idx").cast("long"))


@query("word_count_by_lang", rf"select lang, count(*) as n_docs, cast(sum(len(regexp_extract_all(text, '{WORDS}'))) as bigint) as n_words from documents group by lang")
def word_count_by_lang(spark, sf_dir):
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.count(F.lit(1)).alias("n_docs"), F.sum(words).cast("long").alias("n_words"))


@query("text_lines_source", "select doc_id, unnest(range(0, len(ls))) as line_no, unnest(ls) as line from (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x <> '') as ls from documents)")
def text_lines_source(spark, sf_dir):
    lines = F.filter(F.split("text", "\n"), lambda x: x != "")
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(lines).alias("n", "line")).select("doc_id", F.col("n").cast("long").alias("line_no"), "line")


@query("flatten_turns", rf"select conv_id, turn, role, unnest(range(0, len(w))) as word_idx, unnest(w) as word from (select *, regexp_extract_all(text, '{WORDS}') as w from conversations)")
def flatten_turns(spark, sf_dir):
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))  # a conversation's own turns
    t = c.select("conv_id", F.explode("turns").alias("t"))
    words = F.filter(F.split("t.text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    return t.select("conv_id", "t.turn", "t.role", F.posexplode(words).alias("i", "word")).select("conv_id", "turn", "role", F.col("i").cast("long").alias("word_idx"), "word")


_NOISE_SQL = "|".join(T.NOISE)
_TITLE_SQL = f"""
with t as (select page_id, trim(regexp_extract(html, '{TITLE}', 1)) as t from pages),
a as (select page_id, regexp_replace(t, '\\s*(?:///|//|｜|[|])\\s*.*$', '', 'g') as t from t),
b as (select page_id, regexp_replace(regexp_replace(t, '\\([^)]*\\)', ' ', 'g'), '\\[[^\\]]*\\]', ' ', 'g') as t from a),
c as (select page_id, regexp_replace(regexp_replace(t, '\\b(?:{_NOISE_SQL})\\b', ' ', 'gi'), '\\s+', ' ', 'g') as t from b),
titles as (select page_id, trim(t, ' -–—') as title from c)
"""


@query("normalize_title", _TITLE_SQL + "select page_id, title from titles")
def normalize_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_title(F.regexp_extract("html", TITLE, 1)).alias("title"))


@query("split_artist_title", r"""
with p as (select p_partkey, p_brand || ' - ' || p_name as title, case when p_partkey % 3 = 0 then p_brand || ' Channel' when p_partkey % 3 = 1 then p_name || ' Channel' else 'Uploader' end as who from part),
s as (select *, trim(regexp_extract(title, '^(.+?)\s*[-–—]\s*(.+?)$', 1)) as a, trim(regexp_extract(title, '^(.+?)\s*[-–—]\s*(.+?)$', 2)) as b from p)
select p_partkey, case when a <> '' and b <> '' and contains(lower(who), lower(a)) then b when a <> '' and b <> '' and contains(lower(who), lower(b)) then a else title end as title,
case when a <> '' and b <> '' and contains(lower(who), lower(a)) then a when a <> '' and b <> '' and contains(lower(who), lower(b)) then b else who end as artist from s""")  # fmt: skip
def split_artist_title(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.concat("p_brand", F.lit(" - "), "p_name").alias("title"), F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(" Channel"))).when(F.col("p_partkey") % 3 == 1, F.concat("p_name", F.lit(" Channel"))).otherwise("Uploader").alias("who"))
    title, artist = T.split_title(F.col("title"), F.col("who"))
    return p.select("p_partkey", title.alias("title"), artist.alias("artist"))


@query("safe_title", rf"select page_id, trim(regexp_replace(regexp_extract(html, '{TITLE}', 1), '[^\p{{L}}\p{{N}} _-]', '', 'g')) as safe from pages")
def safe_title(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.safe_title(F.regexp_extract("html", TITLE, 1)).alias("safe"))


@query("strip_punct", r"""select doc_id, trim(lower(regexp_replace(text, '[!"#$%&''()*+,\-./:;<=>?@\[\\\]^_`{|}~]', '', 'g'))) as plain from documents""")
def strip_punct(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.strip_punctuation(F.col("text")).alias("plain"))


@query("cjk_style", "select doc_id, case when regexp_matches(text, '[一-鿿぀-ヿ가-힯]') then 'CJK_Duet' else 'Lat_Duet' end as style, regexp_matches(text, '[\u1100-\u11ff\u3000-\u30ff\u3130-\u318f\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uac00-\ud7af\uf900-\ufaff\uff65-\uff9f]') as any_cjk from documents")
def cjk_style(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.when(T.has_cjk(F.col("text")), "CJK_Duet").otherwise("Lat_Duet").alias("style"), F.col("text").rlike(T.CJK_CLASS).alias("any_cjk"))


@query("script_flags", "select doc_id, regexp_matches(text, '[一-鿿]') as chinese, regexp_matches(text, '[぀-ヿ]') as japanese, regexp_matches(text, '[가-힯]') as korean, regexp_matches(text, '[^\\x00-\\x7F]') as non_ascii from documents")
def script_flags(spark, sf_dir):
    t = F.col("text")
    return table(spark, sf_dir, "documents").select("doc_id", t.rlike("[一-鿿]").alias("chinese"), t.rlike("[぀-ヿ]").alias("japanese"), t.rlike("[가-힯]").alias("korean"), t.rlike(r"[^\x00-\x7F]").alias("non_ascii"))


def _message(e):
    """Messages in the needles' wording: an event's number chooses one of all needles, every ninth has none."""
    flat = [n for _, ns in T.NEEDLES for n in ns]
    return F.when(F.col("event_id") % 9 == 0, F.lit("Something else")).otherwise(F.concat(F.lit("ERROR: "), F.initcap(F.element_at(F.array(*map(F.lit, flat)), (F.col("event_id") % len(flat) + 1).cast("int"))), F.lit(" at "), F.col("event_type")))


_FLAT = [n for _, ns in T.NEEDLES for n in ns]
_LIST_SQL = "[" + ", ".join("'" + n.replace("'", "''") + "'" for n in _FLAT) + "]"
_CASE_SQL = "case " + " ".join("when " + " or ".join(f"contains(m, '{n.replace(chr(39), chr(39) * 2)}')" for n in ns) + f" then '{c}'" for c, ns in T.NEEDLES) + " else 'UNKNOWN' end"
_CLASS_SQL = f"with m as (select event_id, event_type, case when event_id % 9 = 0 then 'something else' else 'error: ' || ({_LIST_SQL})[event_id % {len(_FLAT)} + 1] || ' at ' || event_type end as m from events), c as (select event_id, {_CASE_SQL} as category from m) "


@query("classify_messages", _CLASS_SQL + "select event_id, category from c")
def classify_messages(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.classify(_message(None)).alias("category"))


@query("fatal_errors", _CLASS_SQL + "select event_id, category, category in ('UNAVAILABLE', 'GEO_BLOCKED', 'UNKNOWN') as fatal from c")
def fatal_errors(spark, sf_dir):
    return classify_messages(spark, sf_dir).withColumn("fatal", F.col("category").isin(*T.FATAL))


@query("retry_backoff", _CLASS_SQL + "select event_id, category, event_id % 7 + 1 as attempt, case category when 'RATE_LIMIT' then least(60.0, 2.0 * pow(2.0, event_id % 7)) when 'NETWORK' then least(30.0, 2.0 * pow(2.0, event_id % 7)) else 2.0 end as wait_s from c")
def retry_backoff(spark, sf_dir):
    rows = classify_messages(spark, sf_dir).withColumn("attempt", F.col("event_id") % 7 + 1)
    return rows.withColumn("wait_s", T.backoff(F.col("category"), F.col("attempt"), 2.0))


@query("query_ladder", """
with q as (select p_partkey, p_name as title, p_brand as artist from part),
l as (select p_partkey, 1 as pass_no, title || '|' || artist as q from q where title <> '' and artist <> '' union all select p_partkey, 2, title from q where title <> ''
  union all select p_partkey, 3, artist || ' ' || title from q where artist <> '' union all select p_partkey, 4, title from q),
d as (select *, min(pass_no) over (partition by p_partkey, q) as first_pass, row_number() over (partition by p_partkey, q order by pass_no desc) as r from l)
select p_partkey, first_pass, pass_no as last_pass, q from d where r = 1""")
def query_ladder(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("t"), F.col("p_brand").alias("a"))
    some = lambda *c: F.when(sum(((x != "").cast("int") for x in c), F.lit(0)) == len(c), F.concat_ws("|", *c))
    passes = F.array(some(F.col("t"), F.col("a")), some(F.col("t")), F.when(F.col("a") != "", F.concat_ws(" ", "a", "t")), F.col("t"))
    rows = p.select("p_partkey", F.posexplode(passes).alias("k", "q")).where("q is not null").withColumn("pass_no", F.col("k") + 1)
    w = W.partitionBy("p_partkey", "q")
    rows = rows.withColumn("first_pass", F.min("pass_no").over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc("pass_no"))))
    return rows.where("r = 1").select("p_partkey", "first_pass", F.col("pass_no").alias("last_pass"), "q")


@query("exact_lookup", "select l_orderkey, l_linenumber, l_suppkey, p_partkey, p_name from lineitem join part on l_partkey = p_partkey and cast(round_even(l_quantity, 0) as bigint) = p_size where p_name is not null and p_name <> ''")
def exact_lookup(spark, sf_dir):
    l, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "part").where("p_name <> ''")
    rows = l.join(p, (F.col("l_partkey") == F.col("p_partkey")) & (F.bround("l_quantity").cast("long") == F.col("p_size").cast("long")))
    return rows.select("l_orderkey", "l_linenumber", "l_suppkey", "p_partkey", "p_name")


@query("candidate_search", "select a.p_partkey, b.p_partkey as candidate from part a join part b on split_part(a.p_name, ' ', 2) = split_part(b.p_name, ' ', 2) and a.p_brand = b.p_brand and a.p_partkey <> b.p_partkey where b.p_type is not null")
def candidate_search(spark, sf_dir):
    """Every pair of parts of one token and brand. Lists of parts are paired and dealt evenly before pairs are written out, as few groups may hold most pairs."""
    p = table(spark, sf_dir, "part").withColumn("token", F.split_part("p_name", F.lit(" "), F.lit(2)))
    return I.pairs_within(p, ["token", "p_brand"], "p_partkey", "candidate", right=F.col("p_type").isNotNull())


@query("rank_top1_gate", """
with s as (select source, doc_id, 50 * quality + 30 * (1 - toxic) + cast(least(20, n_chars // 100) as integer) as score from labels join documents using (doc_id)),
r as (select *, row_number() over (partition by source order by score desc, doc_id) as k from s)
select source, case when score >= 70 then doc_id end as doc_id, score from r where k = 1""")
def rank_top1_gate(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    score = (50 * F.col("quality") + 30 * (1 - F.col("toxic")) + F.least(F.lit(20).cast("long"), F.floor(F.col("n_chars") / 100)).cast("int")).cast("int")
    best = d.withColumn("score", score).groupBy("source").agg(F.min_by(F.struct("doc_id", "score"), F.struct(-F.col("score"), F.col("doc_id"))).alias("b"))
    return best.select("source", F.when(F.col("b.score") >= 70, F.col("b.doc_id")).alias("doc_id"), F.col("b.score").alias("score"))


@query("path_ladder", "select page_id, coalesce(nullif(regexp_extract(url, '([^/?#]+)\\.mp4', 1), ''), nullif(regexp_extract(url, '/([0-9]+)(?:[?#]|$)', 1), ''), 'none') as stem, case when contains(url, 'blog') then 'Vocals' when contains(url, '//m.') then 'Instrumental' else 'Other' end as kind from pages")
def path_ladder(spark, sf_dir):
    u = F.col("url")
    some = lambda rx: F.nullif(F.regexp_extract(u, rx, 1), F.lit(""))
    return table(spark, sf_dir, "pages").select("page_id", F.coalesce(some(r"([^/?#]+)\.mp4"), some(r"/([0-9]+)(?:[?#]|$)"), F.lit("none")).alias("stem"), F.when(F.contains(u, F.lit("blog")), "Vocals").when(F.contains(u, F.lit("//m.")), "Instrumental").otherwise("Other").alias("kind"))


@query("markdown_record", "select c_custkey, '# ' || c_name || chr(10) || chr(10) || '- **Segment**: ' || c_mktsegment || chr(10) || '- **Nation**: ' || c_nationkey as md from customer")
def markdown_record(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.format_string("# %s\n\n- **Segment**: %s\n- **Nation**: %d", "c_name", "c_mktsegment", "c_nationkey").alias("md"))


@query("segment_text", "select conv_id, string_agg(text, ' ' order by turn) as text, min(turn) as first_turn, max(turn) as last_turn from conversations group by conv_id")
def segment_text(spark, sf_dir):
    turns = F.array_sort(F.collect_list(F.struct("turn", "text")))
    return table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(turns, lambda x: x.text), " ").alias("text"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


@query("neighbour_lines", "select conv_id, turn, length(text) as n, lag(length(text)) over w as before_, lead(length(text)) over w as after_ from conversations window w as (partition by conv_id order by turn)")
def neighbour_lines(spark, sf_dir):
    w = W.partitionBy("conv_id").orderBy("turn")
    n = F.length("text").cast("long")
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", n.alias("n"), F.lag(n).over(w).alias("before_"), F.lead(n).over(w).alias("after_"))


@query("latin_fold", f"select doc_id, regexp_replace(replace(translate(lower(text), '{T.ACCENTED}', '{T.PLAIN}'), 'ß', 'ss'), '[^a-z\\s]', '', 'g') as latin from documents")
def latin_fold(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", T.latin_fold(F.col("text")).alias("latin"))


@query("id_template", "select page_id, lpad(cast(page_id as varchar), cast(greatest(4, length(cast(page_id as varchar))) as integer), '0') || '_' as name from pages")
def id_template(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.format_string("%04d_", "page_id").alias("name"))


@query("hash_ids", "select c_custkey, upper(substr(sha256(c_name), 1, 12)) as session from customer")
def hash_ids(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", F.upper(F.substring(F.sha2("c_name", 256), 1, 12)).alias("session"))


@query("legacy_fields", "select c_custkey, coalesce(case when c_custkey % 2 = 0 then c_acctbal end, c_acctbal) as start_, c_custkey % 2 = 1 as migrated from customer")
def legacy_fields(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    new = c.where("c_custkey % 2 = 0").select("c_custkey", F.col("c_acctbal").alias("_start"))
    old = c.where("c_custkey % 2 = 1").select("c_custkey", F.col("c_acctbal").alias("start"))
    both = new.unionByName(old, allowMissingColumns=True)
    return both.select("c_custkey", F.coalesce("_start", "start").alias("start_"), F.col("_start").isNull().alias("migrated"))


@query("char_span_scores", rf"""
with w as (select doc_id, unnest(range(1, len(ws) + 1)) as i, unnest(ws) as word from (select doc_id, regexp_extract_all(text, '{WORDS}') as ws from documents))
select doc_id, i - 1 as word_idx, coalesce(sum(length(word)) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding), 0) as from_,
sum(length(word)) over (partition by doc_id order by i rows unbounded preceding) as to_, round(length(word) / 10.0, 6) as score from w""")
def char_span_scores(spark, sf_dir):
    words = F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != "")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(words).alias("i", "word")).withColumn("n", F.length("word"))
    w = W.partitionBy("doc_id").orderBy("i")
    upto = F.sum("n").over(w.rowsBetween(W.unboundedPreceding, 0))
    return rows.select("doc_id", F.col("i").cast("long").alias("word_idx"), (upto - F.col("n")).alias("from_"), upto.alias("to_"), F.round(F.col("n") / F.lit(10.0), 6).alias("score"))


@query("hex_rgba", """with c as (select c_custkey, rpad(substr(sha256(c_name), 1, 6 + cast(2 * (c_custkey % 2) as integer)), 8, 'F') as h from customer),
n as (select c_custkey, cast('0x' || h as bigint) as n from c)
select c_custkey, n >> 24 as red, (n >> 16) & 255 as green, (n >> 8) & 255 as blue, round((n & 255) / 255.0, 2) as alpha from n""")
def hex_rgba(spark, sf_dir):
    digits = F.substr(F.sha2("c_name", 256), F.lit(1), F.lit(6) + (2 * (F.col("c_custkey") % 2)).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", T.rgba(F.concat(F.lit("#"), digits)).alias("c")).select("c_custkey", "c.*")


@query("path_parts", r"""with n as (select page_id, regexp_extract(regexp_replace(url, '[?#].*$', ''), '([^/]*)/*$', 1) as name from pages),
f as (select page_id, name || case when page_id % 3 = 0 then '.tar.gz' when page_id % 3 = 1 then '.mp4' else '' end as name from n),
s as (select page_id, name, regexp_extract(name, '[^.].*?(\.[^.]+)$', 1) as suffix from f)
select page_id, name, left(name, length(name) - length(suffix)) as stem, suffix from s""")
def path_parts(spark, sf_dir):
    more = F.when(F.col("page_id") % 3 == 0, ".tar.gz").when(F.col("page_id") % 3 == 1, ".mp4").otherwise("")
    named = table(spark, sf_dir, "pages").select("page_id", F.concat(T.file_name(F.col("url")), more).alias("name"))
    return named.select("page_id", "name", T.stem(F.col("name")).alias("stem"), T.suffix(F.col("name")).alias("suffix"))


@query("palette_index", """select conv_id, turn, least(4, cast(floor((row_number() over w - 1) / (count(*) over (partition by conv_id)) * 5) as integer)) as colour
from conversations window w as (partition by conv_id order by turn)""")
def palette_index(spark, sf_dir):
    by = W.partitionBy("conv_id")
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn")
    return rows.select("conv_id", "turn", T.palette_index(F.row_number().over(by.orderBy("turn")) - 1, F.count(F.lit(1)).over(by), 5).alias("colour"))
