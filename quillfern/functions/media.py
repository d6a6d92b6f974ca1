"""Rules on media records, settings and spans, as Column and DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillfern.functions.text import latin_fold

#: Spellings of settings.
YES, NO, NOTHING = ("true", "yes", "on", "1"), ("false", "no", "off", "0"), ("none", "")


def first_said(*values: Column) -> Column:
    """The first value that is neither null nor empty."""
    return F.coalesce(*(F.nullif(v, F.lit("")) for v in values))


def as_setting(raw: Column) -> Column:
    """A setting's text; 'None' and blank ones are nothing."""
    return F.when(~F.lower(F.trim(raw)).isin(*NOTHING), raw)


def as_flag(raw: Column) -> Column:
    """A setting as a flag, null where it names none."""
    said = F.lower(F.trim(raw))
    return F.when(said.isin(*YES), True).when(said.isin(*NO), False)


def download_options(cookie: Column, browser: Column, proxy: Column) -> tuple[Column, Column]:
    """(method, options): a cookie file goes before a browser, that before an anonymous download."""
    method = F.when(cookie.isNotNull(), "cookie file").when(browser.isNotNull(), "browser").otherwise("anonymous")
    part = lambda name, value: F.concat(F.lit(f"{name}="), value)  # noqa: E731  null where the value is
    return method, F.concat_ws("&", part("cookiefile", cookie), F.when(cookie.isNull(), part("cookiesfrombrowser", browser)), part("proxy", proxy))


def tolerant(status: Column, body: Column) -> Column:
    """The body of a service's answer, null unless its code is 200 and the body is JSON."""
    return F.when((status == 200) & F.try_parse_json(body).isNotNull(), body)


def confident(rows: DataFrame, score: str, above: float = 0.1) -> DataFrame:
    return rows.where(F.col(score) > above)


def reset(rows: DataFrame, columns: list[str], prefix: str = "was_") -> DataFrame:
    """The columns emptied; their values go on under names with the prefix."""
    return rows.withColumns({f"{prefix}{c}": F.col(c) for c in columns}).withColumns({c: F.lit(None).cast(rows.schema[c].dataType) for c in columns})


def padded(start: Column, end: Column, other_start: Column, other_end: Column, reach: int, pad: int) -> tuple[Column, Column]:
    """The window around a span and another estimate of it, which counts up to reach away, with pad on both sides; never before 0."""
    first = F.greatest(F.least(start, other_start), start - reach)
    last = F.least(F.greatest(end, other_end), end + reach)
    return F.greatest(F.lit(0).cast("long"), first - pad), last + pad


def convert_channels(channels: Column, n: int) -> Column:
    """Channels (an array of arrays of samples) as n: the same number stays, one is their mean, one alone is copied, more are cut to the first n; else an error."""
    size = F.size(channels)
    mean = F.transform(F.get(channels, F.lit(0)), lambda _, k: F.aggregate(channels, F.lit(0.0), lambda a, c: a + F.get(c, k)) / size)
    wrong = F.raise_error(F.concat(size.cast("string"), F.lit(f" channels do not make {n}"))).cast("array<array<double>>")
    copies = F.array_repeat(F.get(channels, F.lit(0)), n)
    return F.when(size == n, channels).when(F.lit(n) == 1, F.array(mean)).when(size == 1, copies).when(size > n, F.slice(channels, 1, n)).otherwise(wrong)


def let(value: Column, body) -> Column:
    """body of the value, which is computed once a row; a column named inside a lambda is computed once an element if the optimiser puts its expression there."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def word_spans(words: Column, spans: Column, ratio: int, rate: int) -> Column:
    """An array of (word_idx, start_s, end_s, score) from the spans (start, end, score) of a line's characters: first start, last end, mean score.

    ratio: samples a frame. A word without a character of its own has no entry. The work grows with the characters.
    """
    second = lambda frame: (frame * ratio).cast("long") / F.lit(float(rate))
    mean = lambda s: F.aggregate(s, F.lit(0.0), lambda a, x: a + x.score) / F.size(s)

    def spanned(words, spans, owner):
        first = F.filter(F.transform(owner, lambda i, at: F.struct(i.alias("i"), at.alias("at"))), lambda x: (x.at == 0) | (F.get(owner, x.at - 1) != x.i))
        own = F.transform(first, lambda x: F.struct(x.i.alias("i"), F.slice(spans, x.at + 1, F.length(F.get(words, x.i))).alias("s")))
        some = F.filter(own, lambda x: F.size(x.s) > 0)
        return F.transform(some, lambda x: F.struct(x.i.alias("word_idx"), second(F.get(x.s, F.lit(0)).start).alias("start_s"), second(F.element_at(x.s, -1).end).alias("end_s"), mean(x.s).alias("score")))

    owners = lambda ws: F.flatten(F.transform(ws, lambda w, i: F.array_repeat(i, F.coalesce(F.length(w), F.lit(0)))))
    return let(words, lambda ws: let(spans, lambda ss: let(owners(ws), lambda o: spanned(ws, ss, o))))


def separated_letters(words: Column, separator: str = "*") -> Column:
    """The Latin letters of the words with a separator before, between and after the words."""
    letters = F.transform(words, lambda w: F.concat(F.filter(F.split(latin_fold(w), ""), lambda c: c != ""), F.array(F.lit(separator))))
    return F.concat(F.array(F.lit(separator)), F.flatten(letters))


def chunks(files: DataFrame, size: str, step: int) -> DataFrame:
    """A row for every step bytes of a file of the given size: chunk, from_, to_."""
    rows = files.where(F.col(size) > 0).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(size) - 1) / step))))
    return rows.withColumn("from_", F.col("chunk") * step).withColumn("to_", F.least((F.col("chunk") + 1) * step, F.col(size)))
