"""Progress of running transfers: a status machine per key that reports what came since the last report."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

REPORT = "key string, status string, done long, delta long"
STATE = "done long, finished boolean"


def advance(done: int, finished: bool, reports: list[tuple[int, int, bool]]) -> tuple[int, bool, list[tuple[str, int, int]]]:
    """The state after (order, bytes done, is last) reports, and (status, done, delta) of each that says something new.

    What is not beyond what was known adds nothing; after the last report of a transfer nothing is reported any more.
    """
    out = []
    for _, now, last in sorted(reports):
        if finished:
            break
        if now > done or last:
            out.append(("finished" if last else "downloading", max(now, done), max(0, now - done)))
            done, finished = max(now, done), last
    return done, finished, out


def progress(reports: DataFrame, key: str, order: str, done: str, last: str) -> DataFrame:
    """key, status, done, delta for each report that says something new, on a stream with state or on a whole table."""
    import pandas as pd

    columns = ["key", "status", "done", "delta"]
    rows = reports.select(F.col(key).cast("string").alias("key"), F.col(order).cast("long").alias("order"), F.col(done).cast("long").alias("done"), F.coalesce(F.col(last), F.lit(False)).alias("last"))
    rows = rows.where("key is not null and done is not null")
    listed = lambda pdf: list(zip(pdf["order"].tolist(), pdf["done"].tolist(), pdf["last"].tolist(), strict=True))

    def table(name: str, found: list) -> pd.DataFrame:
        return pd.DataFrame([(name, *f) for f in found], columns=columns)

    def once(group: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return table(group[0], advance(0, False, listed(pdf))[2])

    def ongoing(group: tuple, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        # A batch's rows of a key come in pieces without order: they are one step of the machine.
        new = [r for pdf in pdfs for r in listed(pdf)]
        known, finished, found = advance(*(state.get if state.exists else (0, False)), new)
        state.update((known, finished))
        yield table(group[0], found)

    if reports.isStreaming:
        return rows.groupBy("key").applyInPandasWithState(ongoing, REPORT, STATE, "append", GroupStateTimeout.NoTimeout)
    return rows.groupBy("key").applyInPandas(once, REPORT)
