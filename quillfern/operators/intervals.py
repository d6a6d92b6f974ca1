"""Joins on intervals and nearest times.

Range predicates alone become nested loops; here every interval is dealt to the buckets of time that it touches, an equi join on
(key, bucket) finds candidates, and one bucket (that of the later start) reports a pair, so nothing needs to be made distinct.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], bucket: int, left_span: tuple[str, str], right_span: tuple[str, str]) -> DataFrame:
    """Inner join of half-open intervals [start, end) with a common part. Column names apart from keys must differ. bucket: about the usual length."""
    (ls, le), (rs, re_) = left_span, right_span

    def dealt(df: DataFrame, s: str, e: str, name: str) -> DataFrame:
        at = lambda c: F.floor(c / F.lit(bucket)).cast("long")
        return df.where(F.col(e) > F.col(s)).withColumn(name, F.explode(F.sequence(at(F.col(s)), at(F.col(e) - 1))))

    a, b = dealt(left, ls, le, "__bucket"), dealt(right, rs, re_, "__bucket")
    both = a.join(b, [*keys, "__bucket"])
    first = F.floor(F.greatest(F.col(ls), F.col(rs)) / F.lit(bucket)).cast("long")
    return both.where((F.col(ls) < F.col(re_)) & (F.col(le) > F.col(rs)) & (F.col("__bucket") == first)).drop("__bucket")


def nearest_asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, right_id: str, name: str = "nearest") -> DataFrame:
    """For every left row the right row of the same key nearest in time; ties go to the earlier time, then the smaller id. One union and two running windows, no pairs."""
    cols = left.columns
    tagged = left.withColumn("__t", F.col(left_at)).withColumn("__r", F.lit(None).cast("struct<at:bigint,id:bigint>")).withColumn("__left", F.lit(True))
    other = right.select(*keys, F.col(right_at).alias("__t"), F.struct(F.col(right_at).cast("long").alias("at"), F.col(right_id).cast("long").alias("id")).alias("__r"))
    for c in cols:
        if c not in keys:
            other = other.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    both = tagged.unionByName(other.withColumn("__left", F.lit(False)))
    # Before a left row of the same time stand all right rows of that time; the smallest id of the latest time is wanted.
    order = W.partitionBy(*keys).orderBy("__t", "__left", F.desc(F.col("__r.id")))
    back = F.last("__r", ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, 0))
    # What comes first ahead is what came last in reverse order: a running frame, unlike one to UNBOUNDED FOLLOWING.
    fwd = W.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__left"), F.desc(F.col("__r.id")))
    ahead = F.last("__r", ignorenulls=True).over(fwd.rowsBetween(W.unboundedPreceding, -1))
    both = both.withColumn("__b", back).withColumn("__a", ahead).where("__left")
    pick = F.when(F.col("__b").isNull(), F.col("__a")).when(F.col("__a").isNull() | (F.col("__t") - F.col("__b.at") <= F.col("__a.at") - F.col("__t")), F.col("__b")).otherwise(F.col("__a"))
    return both.withColumn("__p", pick).select(*cols, F.col("__p.id").alias(f"{name}_id"), F.col("__p.at").alias(f"{name}_at"))


def forward_asof(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, tolerance: int, name: str = "next") -> DataFrame:
    """For every left row the first right time strictly after it, at most tolerance later, else null."""
    cols = left.columns
    other = right.select(*keys, F.col(right_at).cast("long").alias("__t"), F.col(right_at).cast("long").alias("__r")).withColumn("__left", F.lit(False))
    for c in cols:
        if c not in keys:
            other = other.withColumn(c, F.lit(None).cast(left.schema[c].dataType))
    both = left.withColumn("__t", F.col(left_at).cast("long")).withColumn("__r", F.lit(None).cast("long")).withColumn("__left", F.lit(True)).unionByName(other)
    w = W.partitionBy(*keys).orderBy(F.desc("__t"), F.desc("__left")).rowsBetween(W.unboundedPreceding, -1)
    both = both.withColumn("__n", F.last("__r", ignorenulls=True).over(w)).where("__left")
    return both.select(*cols, F.when(F.col("__n") - F.col(left_at) <= tolerance, F.col("__n")).alias(f"{name}_at"))


def positional_join(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str], right_order: list[str]) -> DataFrame:
    """Pairs the k-th rows of both sides per key; what one side has more is dropped."""
    a = left.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy(*left_order)))
    b = right.withColumn("pos", F.row_number().over(W.partitionBy(*keys).orderBy(*right_order)))
    return a.join(b, [*keys, "pos"])


def positional_zip(rows: DataFrame, keys: list[str], source: str, order: list[str], value: str, names: dict[str, str]) -> DataFrame:
    """The k-th values of every source side by side, per key, as far as all sources go; even: whether they have equally many. names: source -> column.

    One shuffle by the keys: places are numbered within key and source, and sources become columns in an aggregate.
    """
    placed = rows.withColumn("pos", F.row_number().over(W.partitionBy(*keys, source).orderBy(*order)))
    sizes = [F.count_if(F.col(source) == s).over(W.partitionBy(*keys)) for s in names]
    even = sizes[0] == sizes[0]
    for n in sizes[1:]:
        even = even & (n == sizes[0])
    placed = placed.withColumn("even", even)
    wide = placed.groupBy(*keys, "pos").agg(*(F.max(F.when(F.col(source) == s, F.col(value))).alias(c) for s, c in names.items()), F.count(F.lit(1)).alias("__n"), F.first("even").alias("even"))
    return wide.where(F.col("__n") == len(names)).drop("__n")


def nearest_of_many(left: DataFrame, right: DataFrame, keys: list[str], left_at: str, right_at: str, source: str, reach: int) -> DataFrame:
    """For every left row with a right row less than reach away the nearest one of all sources; ties go to the smaller source, then to the earlier time.

    The last right row up to a left row's time and the first one from it on are the only ones that can win, so two running windows find both.
    """
    cols = left.columns
    none = F.lit(None).cast("struct<t:bigint,s:int>")
    mine = left.select(*cols, F.col(left_at).cast("long").alias("__t"), none.alias("__r"), F.lit(True).alias("__left"))
    other = right.select(*keys, F.col(right_at).cast("long").alias("__t"), F.struct(F.col(right_at).cast("long").alias("t"), F.col(source).cast("int").alias("s")).alias("__r"), F.lit(False).alias("__left"))
    both = mine.unionByName(other, allowMissingColumns=True)
    back = W.partitionBy(*keys).orderBy("__t", "__left", F.desc(F.col("__r.s"))).rowsBetween(W.unboundedPreceding, 0)
    ahead = W.partitionBy(*keys).orderBy(F.desc("__t"), "__left", F.desc(F.col("__r.s"))).rowsBetween(W.unboundedPreceding, 0)
    both = both.withColumn("__b", F.last("__r", ignorenulls=True).over(back)).withColumn("__a", F.last("__r", ignorenulls=True).over(ahead)).where("__left")
    rank = lambda c: F.struct(F.abs(F.col(f"{c}.t") - F.col("__t")).alias("d"), F.col(f"{c}.s").alias("s"), F.col(f"{c}.t").alias("t"))
    found = F.array_min(F.filter(F.array(*(F.when(F.col(c).isNotNull(), rank(c)) for c in ("__b", "__a"))), lambda x: x.isNotNull() & (x.d < reach)))
    return both.withColumn("__w", found).where("__w is not null").select(*cols, F.col("__w.t").alias(right_at), F.col("__w.s").alias(source))


def pairs_within(rows: DataFrame, keys: list[str], value: str, name: str, right=None, block: int = 2048, task_pairs: int = 20_000_000) -> DataFrame:
    """(value, name) of every pair of rows with equal keys and different values; right: condition on the second row of a pair. Rows with a null among keys and value have no pairs.

    A group is dealt in lists of about `block` values, pairs of lists go evenly to tasks of about `task_pairs` pairs, and only there become pairs of
    values. So what is shuffled stays small beside the result, and a group's pairs are the work of many tasks.
    """
    right = F.lit(True) if right is None else right
    rows = rows.select(*keys, F.col(value), right.alias("__right")).dropna(subset=[*keys, value])
    sizes = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"), F.count_if("__right").alias("__m"))
    total = sizes.agg(F.sum(F.col("__n").cast("double") * F.col("__m"))).first()[0] or 0
    dealt = rows.join(sizes, keys).withColumn("__block", F.pmod(F.xxhash64(value), F.ceil(F.col("__n") / block)))
    lists = dealt.groupBy(*keys, "__block").agg(F.collect_list(value).alias("__left"), F.collect_list(F.when(F.col("__right"), F.col(value))).alias("__others"))
    both = lists.select(*keys, "__left").join(lists.where(F.size("__others") > 0).select(*keys, "__others"), keys)
    tasks = max(1, round(total / task_pairs))
    # Generated code holds all rows that one row becomes; coalesce() ends it between the lists, so that is one value's pairs and not two lists'.
    both = both.select("__left", "__others").repartition(tasks).select(F.explode("__left").alias(value), "__others").coalesce(tasks)
    return both.select(value, F.explode("__others").alias(name)).where(F.col(value) != F.col(name))
