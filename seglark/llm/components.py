"""Connected components of a table of links, and totals by key where one key may hold any share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut

#: Parts in which the rows of a key are kept.
SALT = 64


def with_totals(rows: DataFrame, key: str, member: str, **totals: tuple[str, str]) -> DataFrame:
    """``rows`` with totals of their key, ``name=("min" | "max" | "sum", column)``; no key's rows meet in one task.

    The rows of a key are dealt to ``SALT`` parts by the hash of ``member``.
    Totals are taken by part, then by key (at most ``SALT`` rows each), and go
    back to the parts that exist: at most as many rows as there were.
    """
    kinds = {"min": F.min, "max": F.max, "sum": F.sum}
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(member), F.lit(SALT)).cast("int"))
    parts = salted.groupBy(key, "_salt").agg(*[kinds[kind](column).alias(name) for name, (kind, column) in totals.items()])
    whole = parts.groupBy(key).agg(*[kinds[kind](name).alias(name) for name, (kind, _) in totals.items()])
    spread = parts.select(key, "_salt").join(whole, key)
    return salted.join(spread, [key, "_salt"]).drop("_salt")


def are_stars(edges: DataFrame) -> bool:
    """Whether every node of ``edges (u, v)``, without repeated rows, is the ``u`` of one row only, or of none and the ``v`` of some."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("u").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")), F.struct(F.col("v").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))).alias("e")).select("e.*")
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links (a, b)``; root is the least node of its component.

    Alternates large-star and small-star steps until the links are stars.  A
    step gives every link the least neighbour of its node by
    :func:`with_totals`, so that the centre of a star may have any share of the
    links.  Each round is written to the shared folder, so a lost executor
    costs one round.  Only whether all links are stars reaches the driver.
    """
    spark = links.sparkSession
    edges = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct()
    edges = cut(edges, "links")
    while not are_stars(edges):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = with_totals(both, "u", "v", m=("min", "v")).filter("v > u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        small = with_totals(large, "u", "v", m=("min", "v"))
        # the least neighbour takes the others, and the node itself
        small = small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*")
        after = cut(small.filter("u <> v").distinct(), "links")
        drop_cut(spark, edges)
        edges = after
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
