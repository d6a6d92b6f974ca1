"""The queries opN_<name> of the corpus operators over a data folder, and the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillfern.llm import decontam, license_scan, piece_sampling, quality_fm, quality_rules, secret_scan, sharding, simhash, suffix_dedup, token_counts
from quillfern.llm.common import fresh_path

N_SHARDS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op2_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = license_scan.scan(table(spark, sf_dir, "documents"))
    spans = F.transform("findings", lambda x: F.concat_ws(":", x.license, x.start, x.stop))
    return rows.select(
        "doc_id",
        "n_blocks",
        F.size("findings").cast("long").alias("n_findings"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("findings", lambda x: x.license))), ",").alias("licenses"),
        F.array_join(spans, ",").alias("spans"),
        F.aggregate("findings", F.lit(0), lambda a, x: a + x.missing).cast("long").alias("missing_words"),
        F.aggregate("findings", F.lit(0), lambda a, x: a + x.added).cast("long").alias("added_words"),
        F.round(F.array_max(F.transform("findings", lambda x: x.reduction)), 6).alias("best_reduction"),
    )


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inserts all documents; revises those with long numbers, which are masked; takes back those labelled toxic; sends the first batch again (no effect); compacts; returns the totals."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    rollup = token_counts.Rollup(spark, fresh_path(spark, "rollup"))
    load = docs.select("doc_id", F.lit("insert").alias("op"), "source", "lang", "text")
    rollup.commit("load", load)
    long_number = "[0-9]{6,}"
    rollup.commit("mask", docs.where(F.col("text").rlike(long_number)).select("doc_id", F.lit("revise").alias("op"), "source", "lang", F.regexp_replace("text", long_number, "#").alias("text")))
    rollup.commit("takedown", labels.where("toxic = 1").select("doc_id", F.lit("delete").alias("op"), *(F.lit(None).cast("string").alias(c) for c in ("source", "lang", "text"))))
    rollup.commit("load", load)
    rollup.compact()
    return rollup.totals()


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    machine = quality_fm.fit(docs, table(spark, sf_dir, "labels"))
    rows = quality_fm.score(docs, machine)
    return rows.select("doc_id", (F.coalesce(F.crc32(F.col("doc_id").cast("string")), F.lit(1)) % 5 == 0).alias("held_out"), "score", "predicted")


def op6_sentencepiece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_sampling.sample_digests(table(spark, sf_dir, "documents"))


def op7_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = secret_scan.train_forest(secret_scan.labelled_findings(spark))
    rows = secret_scan.scan(table(spark, sf_dir, "documents"), model)
    return rows.select(
        "doc_id",
        "n_candidates",
        F.size("spans").cast("long").alias("n_secrets"),
        F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s.start, s.stop)), ",").alias("secret_spans"),
        F.sha2("redacted", 256).alias("redacted_sha256"),
    )


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "n_chars")
    return sharding.place(docs, "doc_id", shard_names())


def op10_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontam.with_verdict(decontam.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def shard_names() -> list[str]:
    return [f"shard-{k:03d}" for k in range(N_SHARDS)]


QUERIES = (
    op1_quality_rules,
    op2_license_scans,
    op3_simhash_near_dedup,
    op4_token_counts,
    op5_quality_classifier,
    op6_sentencepiece_sampling,
    op7_suffix_array_dedup,
    op8_secret_scans,
    op9_sharding,
    op10_benchmark_decontamination,
)


def queries() -> dict:
    return {f.__name__: f for f in QUERIES}


def _op1_sql() -> str:
    c = quality_rules.RiskControl()
    m = len(quality_rules.RULES)
    p = c.alpha / m
    return rf"""
with d as (select doc_id, coalesce(text, '') as t, coalesce(lang, '') as stratum from documents),
w as (
  select doc_id, stratum, t, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as words,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as lines
  from d),
grams as (
  select doc_id, i, array_to_string(words[i:i + 4], ' ') as g
  from (select doc_id, words, unnest(range(1, len(words) - 3)) as i from w where len(words) >= 5)),
again as (select doc_id, i from (select *, count(*) over (partition by doc_id, g) as c from grams) where c > 1),
cover as (select doc_id, count(distinct i + k) as n from again, range(5) as r(k) group by doc_id),
f as (
  select w.doc_id, stratum, cast(len(words) as bigint) as n_words, cast(length(array_to_string(words, '')) as bigint) as word_chars,
    cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
    cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines, coalesce(cover.n, 0) as n_repeat_words
  from w left join cover using (doc_id)),
b as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed from f),
s as (
  select doc_id, stratum, base_failed, rule, cast((part * {c.grid} + greatest(whole, 1) - 1) // greatest(whole, 1) as integer) as step
  from (
    select doc_id, stratum, base_failed, unnest(['symbol_share', 'word_length', 'dup_line_share', 'repeat_share']) as rule,
      unnest([n_symbols, word_chars, n_dup_lines, n_repeat_words]) as part, unnest([word_chars, 20 * n_words, n_lines, n_words]) as whole
    from b)),
y as (select doc_id, min(quality) as y from labels where doc_id is not null and quality is not null group by doc_id),
counts as (
  select stratum, rule, step, count(*) filter (where y = 1) as good, count(*) filter (where y <> 1) as bad
  from s join y using (doc_id) where not base_failed group by all),
tests as (select greatest(1, count(distinct stratum) * {m}) as m from counts),
rows as (
  select c.stratum, c.rule, k as cutoff, sum(good) as n, sum(case when step > k then good else 0 end) as kg, sum(case when step > k then bad else 0 end) as kb
  from counts c, range({c.grid} + 1) as r(k) group by all),
tails as (
  select *, case when kg >= n * {p} then 1.0 else (
      select sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({p}) + (n - i) * ln(1 - {p}))) from range(cast(kg as bigint) + 1) as q(i)) end as tail
  from rows),
allowed as (
  select *, min(case when tail * (select m from tests) <= {c.delta} then 1 else 0 end) over (partition by stratum, rule order by cutoff desc) as ok from tails),
best as (
  select stratum, rule, cutoff from allowed where ok = 1
  qualify row_number() over (partition by stratum, rule order by kb - {c.good_weight} * kg desc, cutoff desc) = 1),
failed as (select distinct doc_id from s join best using (stratum, rule) where step > cutoff)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and doc_id not in (select doc_id from failed) as kept
from b
"""


def _op9_sql() -> str:
    names = shard_names()
    slots = ",".join(map(str, sharding.fill_table(names)))
    listed = ", ".join(f"'{n}'" for n in sorted(names))
    return f"""
with slots as (select string_split('{slots}', ',') as s),
names as (select [{listed}] as n),
d as (select doc_id, source, n_chars, cast(('0x' || substr(md5(cast(doc_id as varchar)), 1, 15))::bigint % {sharding.TABLE_SIZE} as integer) as slot from documents)
select doc_id, source, n_chars, slot, n[cast(s[slot + 1] as integer) + 1] as shard from d, slots, names
"""


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_OP10_SQL = rf"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
iw as (select item_id, regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark where item_id is not null and text is not null),
ig as (
  select distinct item_id, least(len(w), 13) as size, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from iw where len(w) > 0)),
sizes as (select distinct size from ig),
dg as (
  select doc_id, size, i, array_to_string(w[i:i + size - 1], ' ') as g
  from (select doc_id, w, size, unnest(range(1, len(w) - size + 2)) as i from dw, sizes where len(w) >= size)),
hits as (select doc_id, i, dg.size, item_id from dg join ig on dg.g = ig.g and dg.size = ig.size),
words as (select doc_id, count(distinct i + k) as n_hit from (select distinct doc_id, i, size from hits), range(13) as r(k) where k < size group by doc_id),
items as (select doc_id, count(distinct item_id) as n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) as ids from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(ids, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": _op1_sql(), "op9_sharding": _op9_sql(), "op10_benchmark_decontamination": _OP10_SQL}
