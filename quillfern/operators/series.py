"""Operators on ordered series: rows of a partition key, an order key and a value or a flag.

All are windows over the series, so one shuffle by the key serves a chain of them; no series is
ever collected. `keys` are column names; `order` is a column name or a list of them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _names(x: str | list[str]) -> list[str]:
    return [x] if isinstance(x, str) else list(x)


def over(keys: str | list[str], order: str | list[str]) -> W:
    return W.partitionBy(*_names(keys)).orderBy(*_names(order))


def following(keys: str | list[str], order: str | list[str], first: int = 1) -> W:
    """The rows from `first` after the current one to the end, as a running frame in reverse order: such a frame grows by a row at a time, where
    one that ends at UNBOUNDED FOLLOWING is computed anew for every row. What comes first ahead is `last` here.
    """
    return W.partitionBy(*_names(keys)).orderBy(*(F.desc(c) for c in _names(order))).rowsBetween(W.unboundedPreceding, -first)


def edges(df: DataFrame, keys, order, flag: str) -> DataFrame:
    """rising, falling: the flag turns on at a row, or a row is the last before it turns off; outside the series it is off."""
    w = over(keys, order)
    on = F.coalesce(F.col(flag), F.lit(False))
    return df.withColumn("rising", on & ~F.coalesce(F.lag(on).over(w), F.lit(False))).withColumn("falling", on & ~F.coalesce(F.lead(on).over(w), F.lit(False)))


def run_numbers(df: DataFrame, keys, order, value: str, name: str = "run") -> DataFrame:
    """Numbers consecutive rows of equal value (nulls equal) from 1."""
    w = over(keys, order)
    fresh = F.when(F.row_number().over(w) == 1, 1).when(F.col(value).eqNullSafe(F.lag(value).over(w)), 0).otherwise(1)
    return df.withColumn("__fresh", fresh).withColumn(name, F.sum("__fresh").over(w)).drop("__fresh")


def islands(df: DataFrame, keys, index: str, flag: str) -> DataFrame:
    """(keys, start, stop): maximal runs of true flags over whole-number frames, stop exclusive."""
    names = _names(keys)
    on = df.where(F.col(flag))
    place = F.col(index) - F.row_number().over(over(keys, index))
    return on.withColumn("__g", place).groupBy(*names, "__g").agg(F.min(index).alias("start"), (F.max(index) + 1).alias("stop")).drop("__g")


def merge_and_drop(runs: DataFrame, keys, gap: int | Column, width: int | Column) -> DataFrame:
    """(keys, seg, start, stop): joins runs at most gap apart, then drops those at most width long; seg counts from 0."""
    names = _names(keys)
    w = over(keys, "start")
    reach = F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col("start") - reach > gap), 1).otherwise(0)
    merged = runs.withColumn("__f", fresh).withColumn("__g", F.sum("__f").over(w)).groupBy(*names, "__g").agg(F.min("start").alias("start"), F.max("stop").alias("stop")).drop("__g")
    return merged.where(F.col("stop") - F.col("start") > width).withColumn("seg", F.row_number().over(w) - 1)


def moving_average(df: DataFrame, keys, order, value: str, n: int, name: str = "smoothed") -> DataFrame:
    """Centred mean of n rows, rows [i - n // 2, i + n - n // 2 - 1]; the series is mirrored at both ends (edge rows repeat)."""
    names = _names(keys)
    w = over(keys, order)
    left, right = n // 2, n - n // 2 - 1
    df = df.withColumn("__i", F.row_number().over(w)).withColumn("__n", F.count(F.lit(1)).over(W.partitionBy(*names)))
    if left == right == 0:
        return df.withColumn(name, F.col(value).cast("double")).drop("__i", "__n")
    # Mirrored copies of the edge rows stand before and after the series.
    head = df.where(F.col("__i") <= left).withColumn("__at", 1 - F.col("__i"))
    tail = df.where(F.col("__i") > F.col("__n") - right).withColumn("__at", 2 * F.col("__n") + 1 - F.col("__i"))
    both = df.withColumn("__at", F.col("__i")).withColumn("__own", F.lit(True)).unionByName(head.withColumn("__own", F.lit(False))).unionByName(tail.withColumn("__own", F.lit(False)))
    frame = W.partitionBy(*names).orderBy("__at").rowsBetween(-left, right)
    return both.withColumn(name, F.avg(value).over(frame)).where("__own").drop("__i", "__n", "__at", "__own")


def threshold_mask(df: DataFrame, keys, value: str, share: float = 0.05, spread: float = 0.2, name: str = "mask") -> DataFrame:
    """value > percentile(share) + spread * population deviation, per series."""
    names = _names(keys)
    limits = df.groupBy(*names).agg((F.percentile(value, F.lit(share)) + spread * F.stddev_pop(value)).alias("__limit"))
    return df.join(limits, names).withColumn(name, F.col(value) > F.col("__limit")).drop("__limit")


def max_normalize(df: DataFrame, keys, value: str, name: str = "normalized") -> DataFrame:
    return df.withColumn(name, F.try_divide(F.col(value), F.max(value).over(W.partitionBy(*_names(keys)))))


def standardize(df: DataFrame, keys, value: str, name: str = "standardized", keep: bool = False) -> DataFrame:
    """(value - mean) / deviation per series; keep: name_mean and name_std stay, for destandardized()."""
    w = W.partitionBy(*_names(keys))
    df = df.withColumn(f"{name}_mean", F.avg(value).over(w)).withColumn(f"{name}_std", F.stddev_samp(value).over(w) + 1e-8)
    df = df.withColumn(name, (F.col(value) - F.col(f"{name}_mean")) / F.col(f"{name}_std"))
    return df if keep else df.drop(f"{name}_mean", f"{name}_std")


def destandardized(value: str, mean: str, std: str) -> Column:
    return F.col(value) * F.col(std) + F.col(mean)


def local_minima(df: DataFrame, keys, order, value: str, name: str = "is_valley") -> DataFrame:
    """Rows strictly below both neighbours."""
    w = over(keys, order)
    return df.withColumn(name, F.coalesce((F.lag(value).over(w) > F.col(value)) & (F.lead(value).over(w) > F.col(value)), F.lit(False)))


def lookahead_fill(df: DataFrame, keys, index: str, active: str, onset: str, frames: int, name: str = "filled") -> DataFrame:
    """From an onset up to the first active frame within the next frames - 1 rows, frames become active."""
    w = over(keys, index)
    ahead = F.min(F.when(F.col(active), F.col(index))).over(w.rowsBetween(0, frames - 1))
    df = df.withColumn("__to", F.when(F.col(onset) & ~F.col(active), ahead))
    reach = F.max("__to").over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, F.col(active) | F.coalesce(F.col(index) < reach, F.lit(False))).drop("__to")


def forward_stretch(df: DataFrame, keys, index: str, active: str, valley: str, frames: int, name: str = "stretched") -> DataFrame:
    """From the last frame of a run up to the next valley strictly after it, if that is at most frames away, frames become active (the valley's own stays)."""
    w = over(keys, index)
    falling = F.col(active) & ~F.coalesce(F.lead(active).over(w), F.lit(False))
    nxt = F.min(F.when(F.col(valley), F.col(index))).over(following(keys, index))
    df = df.withColumn("__to", F.when(falling & (nxt - F.col(index) <= frames), nxt))
    reach = F.max("__to").over(w.rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, F.col(active) | F.coalesce(F.col(index) < reach, F.lit(False))).drop("__to")


def forward_fill(df: DataFrame, keys, order, value: str, default: Column | None = None, name: str = "filled") -> DataFrame:
    last = F.last(value, ignorenulls=True).over(over(keys, order).rowsBetween(W.unboundedPreceding, 0))
    return df.withColumn(name, last if default is None else F.coalesce(last, default))


def interpolate_gaps(df: DataFrame, keys, order, start: str, end: str) -> DataFrame:
    """Rows without times between anchored rows p and q divide [p.end, q.start] evenly; runs at the ends stay null."""
    w = over(keys, order)
    back, ahead = w.rowsBetween(W.unboundedPreceding, 0), following(keys, order, 0)
    df = df.withColumn("__i", F.row_number().over(w))
    known = F.col(start).isNotNull()
    df = df.withColumns({
        "__p": F.last(F.when(known, F.col(end)), ignorenulls=True).over(back),
        "__q": F.last(F.when(known, F.col(start)), ignorenulls=True).over(ahead),
        "__pi": F.last(F.when(known, F.col("__i")), ignorenulls=True).over(back),
        "__qi": F.last(F.when(known, F.col("__i")), ignorenulls=True).over(ahead),
    })
    step = (F.col("__q") - F.col("__p")) / (F.col("__qi") - F.col("__pi") - 1)
    j = F.col("__i") - F.col("__pi")
    filled = df.withColumn("start_filled", F.when(known, F.col(start)).otherwise(F.col("__p") + (j - 1) * step)).withColumn("end_filled", F.when(known, F.col(end)).otherwise(F.col("__p") + j * step))
    return filled.drop("__i", "__p", "__q", "__pi", "__qi")


def range_fill(df: DataFrame, keys, order, ids: str, last_id: Column, name: str = "ids_filled") -> DataFrame:
    """Rows without ids take the whole range from the largest id of the nearest earlier row (else 0) to the smallest of the nearest later one (else last_id)."""
    w = over(keys, order)
    some = F.size(F.coalesce(F.col(ids), F.array().cast("array<int>"))) > 0
    a = F.coalesce(F.last(F.when(some, F.array_max(ids)), ignorenulls=True).over(w.rowsBetween(W.unboundedPreceding, 0)), F.lit(0))
    b = F.coalesce(F.last(F.when(some, F.array_min(ids)), ignorenulls=True).over(following(keys, order, 0)), last_id)
    df = df.withColumn("__a", a.cast("int")).withColumn("__b", b.cast("int"))
    return df.withColumn(name, F.when(some, F.col(ids)).when(F.col("__a") <= F.col("__b"), F.sequence("__a", "__b")).otherwise(F.array().cast("array<int>"))).drop("__a", "__b")


def framed_rms(df: DataFrame, keys, index: str, value: str, hop: int, frame: int) -> DataFrame:
    """(keys, frame, rms): root mean square of rows [k * hop, k * hop + frame) for every frame that fits."""
    names = _names(keys)
    first = F.greatest(F.lit(0), F.ceil((F.col(index) - frame + 1) / F.lit(hop))).cast("long")
    rows = df.withColumn("frame", F.explode(F.sequence(first, F.floor(F.col(index) / F.lit(hop)).cast("long"))))
    return rows.groupBy(*names, "frame").agg(F.sqrt(F.avg(F.col(value) * F.col(value))).alias("rms"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") == frame).drop("__n")
