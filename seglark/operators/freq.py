"""Frequency distributions as tables ``(sample, cnt)`` and, by condition, ``(cond, sample, cnt)``.

All functions take ``by``: columns that hold one distribution each.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def count(df: DataFrame, sample: Column | str, weight: Column | None = None, by: Sequence[str] = ()) -> DataFrame:
    """Counts of samples, or sums of weights; samples whose weights sum to nothing are left out."""
    sample = F.col(sample) if isinstance(sample, str) else sample
    amount = F.count("*") if weight is None else F.sum(weight)
    out = df.groupBy(*by, sample.alias("sample")).agg(amount.alias("cnt"))
    return out if weight is None else out.filter("cnt <> 0")


def add(*dists: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The sum of distributions; also how one is updated with another."""
    out = dists[0]
    for d in dists[1:]:
        out = out.unionByName(d)
    return out.groupBy(*by, "sample").agg(F.sum("cnt").alias("cnt"))


def totals(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``n`` samples counted and ``b`` distinct samples."""
    return dist.groupBy(*by).agg(F.coalesce(F.sum("cnt"), F.lit(0)).alias("n"), F.count("*").alias("b"))


def ordered(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """By falling count, ties by sample."""
    return dist.orderBy(*by, F.desc("cnt"), "sample")


def hapaxes(dist: DataFrame) -> DataFrame:
    return dist.filter(F.col("cnt") == 1)


def count_of_counts(dist: DataFrame, bins: int | None = None, by: Sequence[str] = ()) -> DataFrame:
    """``(r, nr)``: how many samples have count r; with ``bins``, row 0 has the unseen ones."""
    out = dist.groupBy(*by, F.col("cnt").alias("r")).agg(F.count("*").alias("nr"))
    if bins is None:
        return out
    zero = dist.groupBy(*by).agg((F.lit(bins) - F.count("*")).alias("nr")).withColumn("r", F.lit(0))
    return out.unionByName(zero.select(*by, F.col("r").cast(out.schema["r"].dataType), "nr"))


def with_total(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``dist`` with ``n`` and ``b``: joined from a partial aggregate, not a window over all rows."""
    sums = totals(dist, by)
    return dist.join(sums, list(by)) if by else dist.crossJoin(F.broadcast(sums))  # one row


def relative(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    freq = F.when(F.col("n") == 0, 0.0).otherwise(F.col("cnt") / F.nullif("n", F.lit(0)))
    return with_total(dist, by).select(*by, "sample", "cnt", freq.alias("freq"))


def mode(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """The most frequent sample; of equals the greatest."""
    return dist.groupBy(*by).agg(F.max(F.struct("cnt", "sample")).alias("m")).select(*by, F.col("m.sample").alias("sample"), F.col("m.cnt").alias("cnt"))


def coarse(col: str, df: DataFrame) -> Column:
    """A coarser key in the same order: the first symbols of a text, or a whole number without its last digits."""
    kind = df.schema[col].dataType
    if isinstance(kind, T.StringType):
        return F.substring(col, 1, 3)
    return F.floor(F.col(col) / 4096) if isinstance(kind, T.IntegralType) else F.col(col)


def running(df: DataFrame, value: Column, by: Sequence[str], order: str) -> DataFrame:
    """``df`` with ``before``: the sum of ``value`` over earlier rows of the group in order of ``order``.

    Sums are taken within stretches of a coarser key, and over the stretches'
    totals: one group may hold most of the rows and needn't fit in a task.
    """
    rows = df.withColumn("_v", value).withColumn("_k", coarse(order, df))
    keys = [*by, "_k"]
    sums = rows.groupBy(*keys).agg(F.sum("_v").alias("_sum"))
    earlier = Window.partitionBy(*by).orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = [rows[k].eqNullSafe(sums[k]) for k in keys]
    joined = rows.join(sums, reduce(lambda x, y: x & y, same))
    return joined.select(*[rows[c] for c in df.columns], (F.col("_in") + F.col("_base")).alias("before"))


def cumulative(dist: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Running sums in the order of :func:`ordered`.

    Counts repeat far more than samples: sums over whole counts are taken on
    the counts of counts, and within a count the rank of the sample is enough.
    """
    levels = dist.groupBy(*by, "cnt").agg(F.count("*").alias("k"))
    above = Window.partitionBy(*by).orderBy(F.desc("cnt")).rowsBetween(Window.unboundedPreceding, -1)
    levels = levels.withColumn("above", F.coalesce(F.sum(F.col("cnt") * F.col("k")).over(above), F.lit(0))).drop("k")
    out = running(dist, F.lit(1), [*by, "cnt"], "sample").join(levels, [*by, "cnt"])
    return out.select(*by, "sample", "cnt", (F.col("above") + (F.col("before") + 1) * F.col("cnt")).alias("cum"))


def lookup(dist: DataFrame, samples: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts of the given samples, 0 for those not in the distribution."""
    return samples.join(dist, [*by, "sample"], "left").na.fill(0, ["cnt"])


def without(dist: DataFrame, samples: DataFrame) -> DataFrame:
    """The distribution without some samples; its total goes down with them."""
    return dist.join(samples, "sample", "left_anti")


def compare(a: DataFrame, b: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One row (per condition): ``equal``, ``contained`` (every count of a is at most that of b) and ``contains``."""
    left, right = a.select(*by, "sample", F.col("cnt").alias("x")), b.select(*by, "sample", F.col("cnt").alias("y"))
    both = left.join(right, [*by, "sample"], "full_outer").na.fill(0, ["x", "y"])
    rules = {"equal": F.col("x") == F.col("y"), "contained": F.col("x") <= F.col("y"), "contains": F.col("x") >= F.col("y")}
    return both.groupBy(*by).agg(*[F.coalesce(F.bool_and(r), F.lit(True)).alias(k) for k, r in rules.items()])


def conditions(dist: DataFrame, cond: str = "cond") -> DataFrame:
    """Conditions in order, with total and distinct samples of each."""
    return totals(dist, [cond]).orderBy(cond)


def tabulate(dist: DataFrame, samples: Sequence[str], cond: str = "cond", running: bool = False) -> DataFrame:
    """One row per condition, one column per sample; with ``running``, sums from left to right."""
    table = dist.groupBy(cond).pivot("sample", list(samples)).agg(F.sum("cnt")).na.fill(0)
    if not running:
        return table
    sums: list[Column] = []
    for s in samples:
        sums.append(F.col(f"`{s}`") if not sums else sums[-1] + F.col(f"`{s}`"))
    return table.select(cond, *[x.alias(s) for s, x in zip(samples, sums)])
