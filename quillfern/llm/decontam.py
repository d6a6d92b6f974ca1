"""Benchmark decontamination by one Aho-Corasick automaton.

Items and documents are normalised alike: A-Z lower-cased, words are runs of [0-9a-z] and non-ASCII
characters, joined by single blanks. Every window of 13 consecutive item words (an item of fewer
words, but not none, is one window) is a pattern of the automaton, which reads each document once.
Hits become word positions and, through the byte offsets of the words, spans of the original text.

The automaton holds every seventh stretch of seven words of an item: each window of 13 words holds one of them in full. Where one
is hit, the words on both sides are compared with the item's, six at most, which gives all windows around it. So the
automaton takes two nodes a word in place of 26. An item of fewer words than a window is held in full.

The items are broadcast, as one automaton, if their text has at most max_bytes; a worker process builds it once, at about 20 times
those bytes. More items than that make further automata, one after the other: the driver holds two groups of items at most,
a worker one automaton, and their hits are merged per document.

Defined cases: null or empty texts have no words and are never contaminated; null items and items
without words are ignored; items of the same text all count; repeated rows each get a row; an empty
benchmark hits nothing, an empty table gives an empty result. Extra columns are ignored by hits() and kept by keep_clean(), whatever their names.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillfern.llm.common import free_name, id_and_text, stash, text_slices

WINDOW = 13
#: Bytes of item text that one automaton holds.
MAX_BYTES = 16_000_000
#: First code points of a word code's two characters, and the code of words that no item holds.
HIGH, LOW, NO_WORD = 0x10000, 0x20000, "  "
#: A-Z to a-z; ASCII characters that are neither letters nor digits to blanks; bytes of non-ASCII characters stay.
FOLD = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)))

HITS = "doc_id long, n_words long, words array<struct<first:int,last:int>>, spans array<struct<start:int,stop:int>>, items array<long>"


def folded_words(text: str) -> list[bytes]:
    return text.encode().translate(FOLD).split()


class Patterns:
    """The automaton of a group of items, over codes of words.

    A word's code is two characters, the quotient and the remainder of its number by about the root of the vocabulary, from alphabets
    that do not meet: hits lie at word starts, a pattern takes two nodes a word however long words are, and no node
    has more children than that root, which matters as the automaton looks through them one by one.
    """

    def __init__(self, items: list[tuple[int, str]], size: int = WINDOW):
        import ahocorasick

        self.size, self.step = size, (size + 1) // 2
        same: dict[tuple, list[int]] = {}
        for item, text in items:
            if words := tuple(folded_words(text or "")):
                same.setdefault(words, []).append(item)
        known = dict.fromkeys(w for words in same for w in words)
        base = int(len(known) ** 0.5) + 1
        self.code = {w: chr(HIGH + n // base) + chr(LOW + n % base) for n, w in enumerate(known)}
        self.automaton = ahocorasick.Automaton() if known else None
        self.texts: list[str] = []  # codes of each distinct item
        self.ids: list[list[int]] = []
        for words, ids in same.items():
            coded, number = "".join([self.code[w] for w in words]), len(self.texts)
            self.texts.append(coded)
            self.ids.append(ids)
            step = self.step if len(words) >= size else len(words)
            for at in range(0, len(words) - step + 1, step):
                part = coded[2 * at : 2 * (at + step)]
                held = self.automaton.get(part, None)
                if held is None:
                    self.automaton.add_word(part, [(number, at, step)])
                else:
                    held.append((number, at, step))
        if known:
            self.automaton.make_automaton()

    def windows_around(self, coded: str, at: int, number: int, item_at: int, step: int) -> tuple[int, int] | None:
        """First and last word of all windows of an item around a stretch of step words that is hit at word `at`, or None."""
        item = self.texts[number]
        if 2 * step == len(item):
            return at, at + step - 1
        a, b = 2 * at, 2 * item_at
        most = 2 * (self.size - step)
        left = 0
        while left < most and b - left >= 2 and a - left >= 2 and coded[a - left - 2 : a - left] == item[b - left - 2 : b - left]:
            left += 2
        a, b, right = a + 2 * step, b + 2 * step, 0
        while right < most and b + right < len(item) and coded[a + right : a + right + 2] == item[b + right : b + right + 2]:
            right += 2
        if left // 2 + step + right // 2 < self.size:
            return None
        return at - left // 2, at + step - 1 + right // 2


_BUILT: dict[str, Patterns] = {}


def built(name: str, items: list[tuple[int, str]]) -> Patterns:
    """The patterns of a broadcast group, made once per worker process; one group is held at a time."""
    if name not in _BUILT:
        _BUILT.clear()
        _BUILT[name] = Patterns(items)
    return _BUILT[name]


def scan(text: str, patterns: Patterns) -> tuple[int, list[tuple[int, int]], list[int]]:
    """Number of words, merged runs of hit words (first and last position) and the items with occurring windows."""
    words = folded_words(text)
    if patterns.automaton is None or not words:
        return len(words), [], []
    code = patterns.code
    coded = "".join([code.get(w, NO_WORD) for w in words])
    found, items = set(), set()
    for end, held in patterns.automaton.iter(coded):
        for number, item_at, step in held:
            if span := patterns.windows_around(coded, (end + 1) // 2 - step, number, item_at, step):
                found.add(span)
                items.add(number)
    runs: list[list[int]] = []
    for a, b in sorted(found):
        if runs and a <= runs[-1][1] + 1:
            runs[-1][1] = max(runs[-1][1], b)
        else:
            runs.append([a, b])
    return len(words), [(a, b) for a, b in runs], sorted({i for n in items for i in patterns.ids[n]})


def original_spans(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs of words as code point offsets [start, stop) of the original text."""
    if not runs:
        return []
    raw = np.frombuffer(text.encode(), np.uint8)
    inside = np.frombuffer(text.encode().translate(FOLD), np.uint8) != 32
    edge = np.diff(np.concatenate(([0], inside.view(np.int8), [0])))
    starts, stops = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    points = np.concatenate(([0], np.cumsum((raw & 0xC0) != 0x80)))  # code points before a byte
    return [(int(points[starts[a]]), int(points[stops[b]])) for a, b in runs]


def item_groups(benchmark: DataFrame, item_id: str, text: str, max_bytes: int) -> Iterator[list[tuple[int, str]]]:
    """The items in groups of at most max_bytes of text each (an item larger than that is a group); read row by row, not all at once. At least one group."""
    items = benchmark.select(F.col(item_id).cast("long").alias("i"), F.col(text).cast("string").alias("t")).where("i is not null and t is not null")
    group: list[tuple[int, str]] = []
    held = 0
    for i, t in items.toLocalIterator():
        size = len(t.encode())
        if group and held + size > max_bytes:
            yield group
            group, held = [], 0
        group.append((i, t))
        held += size
    yield group


def hits(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """One row per document: its number of words, hit runs of words, their spans in the original text, and the items found."""
    spark = docs.sparkSession
    groups = item_groups(benchmark, item_id, item_text, max_bytes)
    first, second = next(groups), next(groups, None)

    def searched(wanted: DataFrame, group: list[tuple[int, str]], numbered: bool):
        patterns = spark.sparkContext.broadcast(group)
        name = uuid.uuid4().hex

        def look(batches):
            import pyarrow as pa

            found = built(name, patterns.value)
            kind = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("words", pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))), ("items", pa.list_(pa.int64()))] + [("row", pa.int64())] * numbered)
            for batch in batches:
                rows = batch.column(2).to_pylist() if numbered else None
                done = 0
                for ids, texts in text_slices([batch]):
                    out = [(i, *scan(t, found), t) for i, t in zip(ids, texts, strict=True)]
                    columns = {
                        "doc_id": [o[0] for o in out],
                        "n_words": [o[1] for o in out],
                        "words": [[{"first": a, "last": b} for a, b in o[2]] for o in out],
                        "spans": [[{"start": a, "stop": b} for a, b in original_spans(o[4], o[2])] for o in out],
                        "items": [o[3] for o in out],
                    }
                    if numbered:
                        columns["row"] = rows[done : done + len(ids)]
                    done += len(ids)
                    yield pa.RecordBatch.from_pydict(columns, schema=kind)

        return wanted.mapInArrow(look, HITS + (", row long" if numbered else "")), patterns

    wanted = id_and_text(docs, doc_id, text)
    if second is None:
        return searched(wanted, first, False)[0]
    wanted = stash(wanted.withColumn("row", F.monotonically_increasing_id()), "decontam-docs")
    every = None
    for group in itertools.chain((first, second), groups):
        found, patterns = searched(wanted, group, True)
        found = stash(found, "decontam-hits")  # done with, so the group's broadcast can go
        patterns.destroy()
        every = found if every is None else every.unionByName(found)
    # One row per automaton and document. A run's words and its span of the text are merged together.
    runs = F.flatten(F.collect_list(F.zip_with("words", "spans", lambda w, s: F.struct(w["first"].alias("first"), w["last"].alias("last"), s["start"].alias("start"), s["stop"].alias("stop")))))
    merged = every.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("n_words").alias("n_words"), F.sort_array(runs).alias("runs"), F.flatten(F.collect_list("items")).alias("found"))

    def grow(acc, x):
        end = F.try_element_at(acc, F.lit(-1))
        wider = F.struct(end["first"].alias("first"), F.greatest(end["last"], x["last"]).alias("last"), end["start"].alias("start"), F.greatest(end["stop"], x["stop"]).alias("stop"))
        touches = (F.size(acc) > 0) & (x["first"] <= end["last"] + 1)
        return F.when(touches, F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(wider))).otherwise(F.concat(acc, F.array(x)))

    merged = merged.withColumn("runs", F.aggregate("runs", F.slice("runs", 1, 0), grow))
    pick = lambda a, b: F.transform("runs", lambda r: F.struct(r[a].alias(a), r[b].alias(b)))
    return merged.select("doc_id", "n_words", pick("first", "last").alias("words"), pick("start", "stop").alias("spans"), F.array_sort(F.array_distinct("found")).alias("items"))


def with_verdict(found: DataFrame) -> DataFrame:
    """n_hit, n_items, items_sha256 and contaminated of the rows of hits()."""
    n_hit = F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + (x["last"] - x["first"] + 1))
    ids = F.array_join(F.array_sort(F.transform("items", lambda i: i.cast("string"))), ",")
    out = found.select("*", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(ids, 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def keep_clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", max_bytes: int = MAX_BYTES) -> DataFrame:
    """The rows of docs, all columns, that are not contaminated. With one automaton no shuffle; with several, rows are found again by their place in a written table, in a column whose name docs does not have."""
    groups = item_groups(benchmark, "item_id", "text", max_bytes)
    first = next(groups)
    if next(groups, None) is not None:
        place = free_name(docs, "row")
        named = stash(docs.withColumn(place, F.monotonically_increasing_id()), "decontam-docs")
        bad = with_verdict(hits(named.select(F.col(place).alias("doc_id"), F.col(text).alias("text")), benchmark, max_bytes=max_bytes)).where("contaminated").select(F.col("doc_id").alias(place))
        return named.join(bad, place, "left_anti").select(*docs.columns)
    patterns = docs.sparkSession.sparkContext.broadcast(first)
    name = uuid.uuid4().hex
    at = docs.columns.index(text)

    def each(batches):
        import pyarrow as pa

        found = built(name, patterns.value)
        for batch in batches:
            keep = []
            for _, texts in text_slices([pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["i", "t"])]):
                for t in texts:
                    n, runs, _ = scan(t, found)
                    hit = sum(b - a + 1 for a, b in runs)
                    keep.append(not (hit > 0 and 20 * hit >= n))
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(each, docs.schema)
