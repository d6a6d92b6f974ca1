"""Seams for models that are not part of the engine: separators, recognisers and aligners as named functions over Arrow batches.

A model is registered under a kind and a name as a function that is called once per task, loads what it needs and returns a function from a
batch to a batch. run() applies it to a table without a shuffle; weights are loaded once a task, not once a row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

#: Contracts: the columns that a model of a kind reads, and the schema of what it returns.
KINDS = {
    "separator": (("track", "channel", "rate", "first", "samples"), "track string, stem string, channel int, rate int, first long, samples array<float>"),
    "recogniser": (("segment", "start", "samples", "rate"), "segment long, word_idx int, word string, start double, end double, score double"),
    "aligner": (("segment", "start", "end", "words"), "segment long, aligner string, word_idx int, word string, start double, end double, score double"),
}
MODELS: dict[tuple[str, str], Callable] = {}


def register(kind: str, name: str):
    """Registers a loader: () -> (batch -> batch)."""
    if kind not in KINDS:
        raise ValueError(f"unknown kind of model: {kind}")

    def put(load: Callable) -> Callable:
        if (kind, name) in MODELS:
            raise ValueError(f"{kind} {name} is registered twice")
        MODELS[kind, name] = load
        return load

    return put


def run(rows: DataFrame, kind: str, name: str) -> DataFrame:
    """The results of a registered model on rows that have the columns of its kind; others are left out."""
    reads, schema = KINDS[kind]
    load = MODELS.get((kind, name))
    if load is None:
        raise ValueError(f"no {kind} is registered as {name}: {sorted(n for k, n in MODELS if k == kind)}")

    def each(batches):
        model = load()
        for batch in batches:
            if batch.num_rows:
                yield model(batch)

    return rows.select(*reads).mapInArrow(each, schema)


@register("aligner", "even")
def even():
    """A stand-in for an acoustic aligner: a segment's words share its time evenly, with score 0."""
    import pyarrow as pa

    def align(batch):
        out = []
        for segment, start, end, words in zip(*(batch.column(c).to_pylist() for c in ("segment", "start", "end", "words")), strict=True):
            step = (end - start) / max(1, len(words))
            out += [(segment, "even", i, w, start + i * step, start + (i + 1) * step, 0.0) for i, w in enumerate(words)]
        types = [pa.int64(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64()]
        columns = list(zip(*out, strict=True)) if out else [()] * 7
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["segment", "aligner", "word_idx", "word", "start", "end", "score"])

    return align
