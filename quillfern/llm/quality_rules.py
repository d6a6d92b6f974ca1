"""Quality rules with risk-controlled cutoffs, in DataFrame functions only.

Every text gets counts of words, symbols, repeated lines and repeated word windows. Four shares
derived from them are rules: a document is rejected where a share lies above the cutoff of its
stratum. Cutoffs come from a labelled holdout: for each stratum and rule, cutoffs are tried from
the laxest to the strictest, and one is allowed while the exact binomial tail P(Bin(n, a) <= k)
is at most delta / (strata * rules), where n counts the stratum's labelled good documents, k those
that the cutoff would reject and a = alpha / rules. Trying in a fixed order needs no correction
within a rule; Bonferroni's covers strata and rules; splitting alpha covers the rules' union. So
with confidence 1 - delta, no stratum loses more than the share alpha of its good documents to
these rules. Of the allowed cutoffs, the one with most rejected bad less good_weight times the rejected good
holdout documents is taken, the laxest on ties. A rule without an allowed cutoff rejects nothing.

Every stratum stands on its own holdout: none is pooled with others, and one without an allowed cutoff, or
not in the holdout at all, rejects nothing. Cutoffs are joined by stratum, so their number has no bound.

Defined cases: a null or empty text has no words and fails the base rule; a null stratum is the
stratum ''; several labels of a document count as their minimum; repeated rows each get a row (and count
each in the holdout); no labels: the base rule alone decides; an empty table gives an empty result. Extra
columns are ignored, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quillfern.llm.common import WHITE, stash

SYMBOLS = "#*$%&|<>"
RULES = ("symbol_share", "word_length", "dup_line_share", "repeat_share")


@dataclass(frozen=True)
class RiskControl:
    """alpha: share of a stratum's good documents that may be lost; delta: chance of missing that; grid: cutoffs between 0 and 1; good_weight: what a lost good document outweighs."""

    alpha: float = 0.02
    delta: float = 0.05
    grid: int = 50
    good_weight: int = 50


def measures(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """doc_id, stratum and the counts of each text; one pass, no shuffle.

    Windows of five words are told apart by the 64-bit hash of their words' 64-bit hashes; texts in which
    some hash occurs twice compare the words of those windows too.
    """
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    s = F.coalesce(F.col(stratum).cast("string"), F.lit("")) if stratum else F.lit("")
    df = docs.select(F.col(doc_id).cast("long").alias("doc_id"), s.alias("stratum"), t.alias("t"))
    rare = reduce(or_, (F.contains("t", F.lit(c)) for c in "\t\x0b\x0c\r"))
    # Blanks and line ends alone, the usual case, need no regular expression.
    split = F.when(rare, F.split("t", f"[{WHITE}]+")).otherwise(F.split(F.replace("t", F.lit("\n"), F.lit(" ")), " "))
    df = df.withColumn("words", F.array_remove(split, ""))
    df = df.withColumn("lines", F.filter(F.split("t", "\n"), lambda x: F.btrim(x, F.lit(" \t\x0b\x0c\r")) != ""))
    df = df.select(
        "doc_id",
        "stratum",
        "words",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(f"[{SYMBOLS}]")).cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
    )
    df = df.withColumn("each", F.when(F.col("n_words") >= 5, F.transform("words", lambda w: F.xxhash64(w))))
    shifted = F.arrays_zip(*(F.slice("each", F.lit(k + 1), F.greatest(F.size("each") - 4, F.lit(0))).alias(f"w{k}") for k in range(5)))
    df = df.withColumn("hashes", F.transform(shifted, lambda x: F.xxhash64(x)))
    again = F.size(F.array_distinct("hashes")) < F.size("hashes")
    df = df.withColumn("sorted", F.when(again, F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("p"))))))

    def same(x: Column, i: Column, k: int) -> Column:
        other = F.get("sorted", i + F.lit(k))
        return F.coalesce((x.h == other.h) & (F.slice("words", x.p + F.lit(1), 5) == F.slice("words", other.p + F.lit(1), 5)), F.lit(False))

    df = df.withColumn("at", F.sort_array(F.transform(F.filter("sorted", lambda x, i: same(x, i, -1) | same(x, i, 1)), lambda x: x.p)))
    # Windows overlap: each adds its words up to the next repeated window's start.
    covered = F.aggregate(
        F.transform("at", lambda p, i: F.least(F.lit(5), F.coalesce(F.get("at", i + F.lit(1)) - p, F.lit(5)))), F.lit(0).cast("long"), lambda a, x: a + x
    )
    return df.select("doc_id", "stratum", "n_words", "word_chars", "n_symbols", "n_dup_lines", F.coalesce(covered, F.lit(0)).alias("n_repeat_words"), "n_lines")


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


def _steps(rule: str, grid: int) -> Column:
    """The share in steps of 1 / grid, rounded up in whole numbers: above cutoff j exactly if it is greater than j. word_length is the mean in units of 20 characters."""
    part, whole = {
        "symbol_share": ("n_symbols", "word_chars"),
        "word_length": ("word_chars", "n_long"),
        "dup_line_share": ("n_dup_lines", "n_lines"),
        "repeat_share": ("n_repeat_words", "n_words"),
    }[rule]
    whole = F.greatest(20 * F.col("n_words") if whole == "n_long" else F.col(whole), F.lit(1))
    return F.floor((F.col(part) * grid + whole - 1) / whole).cast("int")


def _log_gamma(x: Column) -> Column:
    """ln Gamma(x) for x >= 1: Stirling's series at x + 8, taken back by the recurrence."""
    y = x + F.lit(8.0)
    back = F.lit(0.0)
    for k in range(8):
        back = back + F.log(x + F.lit(float(k)))
    series = 1 / (12 * y) - 1 / (360 * y * y * y) + 1 / (1260 * y * y * y * y * y)
    return (y - 0.5) * F.log(y) - y + F.lit(0.9189385332046727) + series - back


def binomial_tail(n: Column, k: Column, p: float) -> Column:
    """P(Bin(n, p) <= k) for k below the mean, by the terms from k down; 1 from the mean on (never significant there).

    Terms shrink as fast as a normal density or faster, so those beyond 12 standard deviations add nothing to a double.
    """
    from math import log, log1p

    span = F.ceil(12 * F.sqrt(n * F.lit(p)) + 50).cast("long")
    term = lambda i: F.exp(
        _log_gamma(n + F.lit(1.0)) - _log_gamma(i + F.lit(1.0)) - _log_gamma(n - i + F.lit(1.0)) + i * F.lit(log(p)) + (n - i) * F.lit(log1p(-p))
    )
    total = F.aggregate(F.sequence(F.greatest(F.lit(0).cast("long"), k - span), k), F.lit(0.0), lambda a, i: a + term(i.cast("double")))
    return F.when(k >= n * F.lit(p), F.lit(1.0)).otherwise(F.least(F.lit(1.0), total))


def cutoffs(measured: DataFrame, labels: DataFrame, control: RiskControl = RiskControl()) -> DataFrame:
    """stratum, rule, cutoff, n_good, k_good, k_bad, tail of each chosen cutoff, written and read again: at most one row a stratum and rule.

    The holdout is every labelled document that passes the base rule. Counts are aggregated per stratum, rule and step before anything is
    compared, so the rest works on strata * rules * grid rows. The base rule is a condition inside the sums: as a filter it would be pushed
    below the measures and repeat their expressions within each other.
    """
    y = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").alias("y")).where("doc_id is not null and y is not null").groupBy("doc_id").agg(F.min("y").alias("y"))
    steps = F.explode(F.array(*(F.struct(F.lit(r).alias("rule"), _steps(r, control.grid).alias("step")) for r in RULES)))
    hold = measured.join(y, "doc_id").select("stratum", "y", base_failed().alias("out"), steps.alias("s"))
    some = lambda is_good: F.sum(F.when(~F.col("out") & ((F.col("y") == 1) == F.lit(is_good)), 1).otherwise(0))
    counts = hold.groupBy("stratum", F.col("s.rule").alias("rule"), F.col("s.step").alias("step")).agg(some(True).alias("good"), some(False).alias("bad"))
    counts = stash(counts.where("good + bad > 0"), "rule-counts")
    cells = counts.select("stratum", "rule").distinct().withColumn("cutoff", F.explode(F.sequence(F.lit(0), F.lit(control.grid))))
    rows = cells.join(counts, ["stratum", "rule"]).groupBy("stratum", "rule", "cutoff").agg(
        F.sum("good").alias("n_good"),
        F.sum(F.when(F.col("step") > F.col("cutoff"), F.col("good")).otherwise(0)).alias("k_good"),
        F.sum(F.when(F.col("step") > F.col("cutoff"), F.col("bad")).otherwise(0)).alias("k_bad"),
    )
    tests = max(1, counts.select("stratum").distinct().count() * len(RULES))
    rows = rows.withColumn("tail", binomial_tail(F.col("n_good"), F.col("k_good"), control.alpha / len(RULES)))
    lax_first = W.partitionBy("stratum", "rule").orderBy(F.desc("cutoff"))
    rows = rows.withColumn("allowed", F.min(F.when(F.col("tail") * tests <= control.delta, 1).otherwise(0)).over(lax_first) == 1)
    best = W.partitionBy("stratum", "rule").orderBy(F.desc(F.col("k_bad") - control.good_weight * F.col("k_good")), F.desc("cutoff"))
    return stash(rows.where("allowed").withColumn("r", F.row_number().over(best)).where("r = 1").drop("r", "allowed"), "rule-cutoffs")


def verdicts(measured: DataFrame, chosen: DataFrame | None, control: RiskControl = RiskControl()) -> DataFrame:
    """The measured rows with base_failed, kept and failed_rules (comma-joined names). The cutoffs are joined by stratum: Spark broadcasts them where their size allows it."""
    if chosen is None:
        df = measured.withColumn("limits", F.create_map().cast("map<string,int>"))
    else:
        limits = chosen.groupBy("stratum").agg(F.map_from_entries(F.collect_list(F.struct("rule", "cutoff"))).alias("limits"))  # one entry a rule
        df = measured.join(limits, "stratum", "left")
    fails = [F.when(_steps(rule, control.grid) > F.try_element_at("limits", F.lit(rule)), F.lit(rule)) for rule in RULES]
    df = df.withColumn("base_failed", base_failed()).withColumn("failed_rules", F.concat_ws(",", *fails)).drop("limits")
    return df.withColumn("kept", ~F.col("base_failed") & (F.col("failed_rules") == "")).select(*measured.columns, "base_failed", "failed_rules", "kept")


def apply_rules(docs: DataFrame, labels: DataFrame | None, control: RiskControl = RiskControl(), doc_id: str = "doc_id", text: str = "text", stratum: str | None = "lang") -> DataFrame:
    """Measures every text once, chooses cutoffs on the labelled documents and returns one row per document."""
    measured = stash(measures(docs, doc_id, text, stratum), "rule-measures")
    return verdicts(measured, cutoffs(measured, labels, control) if labels is not None else None, control)
