"""Text expressions of the catalogue, as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"

#: Alternatives of title noise, in the order they are tried.
NOISE = (
    "official", r"official\s+audio", r"official\s+video", r"official\s+music\s+video", r"music\s+video", "lyrics?", r"lyric\s+video",
    "lirik", "video", "audio", "visualizer", "performance", "live", r"live\s+performance", "mv", "hd", "4k", "8k", "remastered",
    "remaster", "karaoke", "instrumental", "cover", r"sped\s*up", r"slowed\s*(?:\+\s*reverb)?", "nightcore",
)

#: Message categories in order of priority with the lower-case needles of each.
NEEDLES = (
    ("AUTH", ("sign in to confirm", "login required", "authentication", "cookies", "cookies are no longer valid", "confirm you're not a bot")),
    ("PO_TOKEN", ("po token", "potoken", "proof of origin", "botguard", "attestation")),
    ("HTTP_403", ("http error 403", "403 forbidden", "forbidden")),
    ("RATE_LIMIT", ("http error 429", "too many requests", "rate limit")),
    ("FORMAT", ("requested format is not available", "requested format")),
    ("UNAVAILABLE", ("private video", "video unavailable", "video is unavailable", "has been removed", "deleted video")),
    ("GEO_BLOCKED", ("geo-restricted", "not available in your country", "country")),
    ("NETWORK", ("network error", "timed out", "timeout", "connection reset", "temporary failure")),
)
FATAL = ("UNAVAILABLE", "GEO_BLOCKED", "UNKNOWN")

#: Code point ranges of Chinese, Japanese and Korean characters.
CJK_RANGES = (
    (0x1100, 0x11FF), (0x3000, 0x303F), (0x3040, 0x309F), (0x30A0, 0x30FF), (0x3130, 0x318F), (0x31F0, 0x31FF), (0x3400, 0x4DBF),
    (0x4E00, 0x9FFF), (0xAC00, 0xD7AF), (0xF900, 0xFAFF), (0xFF65, 0xFF9F), (0x20000, 0x2A6DF), (0x2A700, 0x2B73F), (0x2B740, 0x2B81F),
    (0x2B820, 0x2CEAF), (0x2CEB0, 0x2EBEF), (0x2EBF0, 0x2EE5F), (0x30000, 0x3134F), (0x31350, 0x323AF),
)
CJK_CLASS = "[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in CJK_RANGES) + "]"


def strip_punctuation(c: Column) -> Column:
    """Without ASCII punctuation, lower case, trimmed."""
    return F.trim(F.lower(F.translate(c, PUNCTUATION, "")))


def normalize_title(c: Column) -> Column:
    """A title without translation, bracketed parts and noise words, with single blanks."""
    c = F.trim(c)
    c = F.regexp_replace(c, r"\s*(?:///|//|｜|[|])\s*.*$", "")
    c = F.regexp_replace(c, r"\([^)]*\)", " ")
    c = F.regexp_replace(c, r"\[[^\]]*\]", " ")
    c = F.regexp_replace(c, r"(?i)\b(?:" + "|".join(NOISE) + r")\b", " ")
    return F.btrim(F.regexp_replace(c, r"\s+", " "), F.lit(" -–—"))


SPLIT = r"^(.+?)\s*[-–—]\s*(.+?)$"


def split_title(title: Column, uploader: Column) -> tuple[Column, Column]:
    """(title, artist) of 'A - B': whichever part the uploader's name contains is the artist; else title and uploader stay."""
    a, b = F.trim(F.regexp_extract(title, SPLIT, 1)), F.trim(F.regexp_extract(title, SPLIT, 2))
    who = F.trim(F.coalesce(uploader, F.lit("")))
    both = (a != "") & (b != "")
    first = both & F.contains(F.lower(who), F.lower(a))
    second = both & F.contains(F.lower(who), F.lower(b))
    return F.when(first, b).when(second, a).otherwise(title), F.when(first, a).when(second, b).otherwise(who)


def classify(c: Column) -> Column:
    """The first category with a needle in the message, else UNKNOWN."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = None
    for category, needles in NEEDLES:
        hit = None
        for n in needles:
            here = F.contains(low, F.lit(n))
            hit = here if hit is None else hit | here
        out = F.when(hit, category) if out is None else out.when(hit, category)
    return out.otherwise("UNKNOWN")


def backoff(category: Column, attempt: Column, base: float) -> Column:
    """Seconds to wait: doubled each attempt, at most 60 for rate limits and 30 for network errors; the base otherwise."""
    grown = F.lit(base) * F.pow(F.lit(2.0), attempt - 1)
    return F.when(category == "RATE_LIMIT", F.least(F.lit(60.0), grown)).when(category == "NETWORK", F.least(F.lit(30.0), grown)).otherwise(F.lit(float(base)))


def safe_title(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[^\p{L}\p{N} _-]", ""))


def has_cjk(c: Column) -> Column:
    return c.rlike("[一-鿿぀-ヿ가-힯]")


def hms(seconds: Column) -> Column:
    """MM:SS.ss of whole centiseconds, or --:--.-- for null."""
    cs = F.round(seconds * 100).cast("long")
    whole = F.format_string("%02d:%02d.%02d", F.floor(cs / 6000).cast("long"), F.floor(cs / 100).cast("long") % 60, cs % 100)
    return F.when(seconds.isNull(), "--:--.--").otherwise(whole)


def ass_time(centis: Column) -> Column:
    """H:MM:S.cc of whole centiseconds; seconds under ten have one digit."""
    s = F.floor(centis / 100).cast("long")
    return F.format_string("%d:%02d:%d.%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60, centis % 100)


def legacy_time(centis: Column) -> Column:
    """H:MM:SS.cc of whole centiseconds."""
    s = F.floor(centis / 100).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(s / 3600).cast("long"), F.floor(s / 60).cast("long") % 60, s % 60, centis % 100)


def legacy_lead(text: Column, wait: Column) -> Column:
    """Style, margins and effects that stand before a legacy event's words; wait: centiseconds from its display to its first word."""
    fade = F.greatest(F.lit(0).cast("long"), F.least(F.lit(300).cast("long"), wait * 10)).cast("string")
    return F.concat(F.when(has_cjk(text), "CJK_Duet").otherwise("Lat_Duet"), F.lit(",,20,20,50,,{\\fad("), fade, F.lit(",200)}{\\an2}"))


ACCENTED, PLAIN = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy"


def latin_fold(c: Column) -> Column:
    """Lower-case Latin letters and white space: common accents folded, ß as ss, other characters dropped."""
    c = F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), "ß", "ss")
    return F.regexp_replace(c, r"[^a-z\s]", "")


def rgba(c: Column) -> Column:
    """Red, green, blue (0 to 255) and alpha (0 to 1, two places) of a colour like #A0B1C2 or #A0B1C2D4; missing digits are F, what is no colour gives null."""
    digits = F.rpad(F.ltrim(c, F.lit("#")), 8, "F")
    n = F.when(digits.rlike("^[0-9A-Fa-f]{8}$"), F.conv(digits, 16, 10).cast("long"))
    part = lambda shift: F.shiftright(n, shift).bitwiseAND(F.lit(255))
    return F.when(n.isNotNull(), F.struct(part(24).alias("red"), part(16).alias("green"), part(8).alias("blue"), F.round(part(0) / 255, 2).alias("alpha")))


def file_name(c: Column) -> Column:
    """The last part of a path or address, without query and fragment."""
    return F.regexp_extract(F.regexp_replace(c, r"[?#].*$", ""), r"([^/]*)/*$", 1)


def suffix(name: Column) -> Column:
    """The last extension of a file name, dot included; none for names that only start with a dot."""
    return F.regexp_extract(name, r"[^.].*?(\.[^.]+)$", 1)


def stem(name: Column) -> Column:
    return F.left(name, F.length(name) - F.length(suffix(name)))


def palette_index(i: Column, n: Column, size: int) -> Column:
    """The palette entry of line i of n, from 0, so that the palette is spread over all lines."""
    return F.least(F.lit(size - 1), F.floor(i / n * size).cast("int"))
