"""Mixing sources to target weights by Pfair scheduling.

Each source's documents form blocks of about equal size.  With weight w, block
j (from 0) of a source may not run before slot floor(j / w) and has to run
before slot ceil((j + 1) / w).  Earliest deadline first among the released
blocks meets all deadlines where the weights sum to one, and so after every
slot each source has had within one block of its share.

Weights are fractions of a period that the whole mixture fits in, and so are
not rounded again and again.  A mixture of up to ``SLOTS`` slots takes one
period of that many.  A longer one takes ``FINE`` times as many slots as it
needs, where a weight is off by less than a thousandth of a block over the
whole mixture; only the blocks that exist are then scheduled, one heap entry
and one row for each ``BLOCK_CHARS`` characters (300,000 for 30 GB).
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Mapping
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SLOTS, BLOCK_CHARS, GROUP_ROWS = 1000, 100_000, 1024
FINE = 1000
TEMPERATURE = 0.5
#: Key under which rows without a source are scheduled.
NO_SOURCE = "\0none"


def quotas(weights: Mapping[str, float], slots: int = SLOTS) -> dict[str, int]:
    """Slots of a period for each source by largest remainders; none for weights that round to none."""
    if not weights:
        return {}
    if any(not (w > 0 and math.isfinite(w)) for w in weights.values()):
        raise ValueError("weights must be positive and finite")
    slots = max(slots, 10 * len(weights))
    total = sum(map(Fraction, weights.values()))
    exact = {s: slots * Fraction(w) / total for s, w in weights.items()}
    out = {s: int(x) for s, x in exact.items()}
    rest = slots - sum(out.values())
    for s in sorted(weights, key=lambda s: (out[s] - exact[s], s))[:rest]:
        out[s] += 1
    return out


def schedule(quota: Mapping[str, int]) -> list[tuple[str, int]]:
    """Per slot of one period, the source and the number of its block in the period."""
    return [(s, j) for _, s, j in slots_of(quota, quota)]


def slots_of(quota: Mapping[str, int], blocks: Mapping[str, int]) -> list[tuple[int, str, int]]:
    """Slot, source and number of the first ``blocks`` of each source (its quota at most), in order of slots."""
    period = sum(quota.values())
    waiting = [(0, s, 0) for s in sorted(quota) if quota[s] and blocks[s]]  # release, source, block
    heapq.heapify(waiting)
    ready: list[tuple[int, str, int]] = []  # deadline, source, block
    out, slot = [], 0
    while waiting or ready:
        if not ready:
            slot = max(slot, waiting[0][0])
        while waiting and waiting[0][0] <= slot:
            _, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-(j + 1) * period // quota[s]), s, j))
        deadline, s, j = heapq.heappop(ready)
        if deadline <= slot:
            raise AssertionError("a deadline was missed")
        out.append((slot, s, j))
        if j + 1 < blocks[s]:
            heapq.heappush(waiting, ((j + 1) * period // quota[s], s, j + 1))
        slot += 1
    return out


def mixture(target: Mapping[str, float], blocks: Mapping[str, int], slots: int = SLOTS) -> list[tuple[int, str, int]]:
    """Slot, source and number of all ``blocks``, by target weights."""
    if not target:
        return []
    total = sum(map(Fraction, target.values()))
    needed = max(math.ceil(blocks[s] * total / Fraction(w)) for s, w in target.items())
    quota = quotas(target, slots)
    if needed <= sum(quota.values()):  # and so no quota is under the source's blocks
        return slots_of(quota, quota)
    return slots_of(quotas(target, FINE * needed), blocks)


def plan(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, temperature: float = TEMPERATURE, slots: int = SLOTS) -> DataFrame:
    """The slot of every document: ``doc_id, source, n_chars, block, slot, chars_before``.

    ``weights`` maps sources to target shares (of characters); sources it
    doesn't name, or all without it, weigh their characters to the power
    ``temperature``.  A document belongs to the block in which it begins; order
    within a source is by hash of ``doc_id``.  Slots of sources that have run
    out stay empty, so that the others keep their proportions.  Every row gets
    a slot: null and empty texts count one character, rows without a source
    form a source of their own, repeated rows are placed each.  An empty table
    gives an empty plan.  Read the mixture in order of (slot, chars_before).
    """
    own = docs.select(
        docs["doc_id"].alias("doc_id"),
        docs["source"].alias("source"),
        F.coalesce(docs["source"], F.lit(NO_SOURCE)).alias("_s"),
        F.greatest(F.coalesce(F.length(docs["text"]), F.lit(0)), F.lit(1)).cast("long").alias("n_chars"),
        F.xxhash64(docs["doc_id"]).alias("_h"),
    )
    return _place(own, weights, block_chars, temperature, slots)


def _place(own: DataFrame, weights, block_chars: int, temperature: float, slots: int) -> DataFrame:
    spark = own.sparkSession
    sums = own.groupBy("_s").agg(F.sum("n_chars").alias("chars"), F.count("*").alias("rows")).collect()  # one row per source
    given = {NO_SOURCE if s is None else s: w for s, w in (weights or {}).items()}
    powers = {r["_s"]: float(r["chars"]) ** temperature for r in sums}
    unnamed = {s: p for s, p in powers.items() if s not in given}
    left = max(1e-9, 1 - sum(given.values())) if unnamed else 0
    target = {s: given[s] if s in given else left * p / sum(unnamed.values()) for s, p in powers.items()}
    blocks = {r["_s"]: -(-r["chars"] // block_chars) for r in sums}
    groups = {r["_s"]: -(-r["rows"] // GROUP_ROWS) for r in sums}
    per_source = spark.createDataFrame([(s, groups[s]) for s in sorted(groups)], "_s string, _groups long")
    template = spark.createDataFrame([(s, j, t) for t, s, j in mixture(target, blocks, slots) if j < blocks[s]], "_s string, block long, slot long")

    # A source's rows are split by hash into groups of about GROUP_ROWS; running sums are taken within
    # the groups, over the totals of as many groups, and over those: no source has to fit in one task.
    rows = own.join(per_source, "_s")
    part = F.floor((F.shiftrightunsigned("_h", 1).cast("double") / F.lit(float(1 << 63))) * F.col("_groups"))
    rows = rows.withColumn("_g", F.least(part, F.col("_groups") - 1))
    inside = Window.partitionBy("_s", "_g").orderBy(F.shiftrightunsigned("_h", 1), "doc_id", "n_chars").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy("_s", "_g").agg(F.sum("n_chars").alias("_sum")).withColumn("_m", F.floor(F.col("_g") / GROUP_ROWS))
    merged = totals.groupBy("_s", "_m").agg(F.sum("_sum").alias("_sums"))

    def sum_before(name: str, *keys: str) -> Column:
        window = Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(window), F.lit(0))

    merged = merged.select("_s", "_m", sum_before("_sums", "_s", "_m").alias("_merged"))
    totals = totals.withColumn("_before", sum_before("_sum", "_s", "_m", "_g")).join(merged, ["_s", "_m"])
    totals = totals.select("_s", "_g", (F.col("_before") + F.col("_merged")).alias("_before"))
    rows = rows.withColumn("_in", F.coalesce(F.sum("n_chars").over(inside), F.lit(0))).join(totals, ["_s", "_g"])
    rows = rows.withColumn("chars_before", F.col("_in") + F.col("_before"))
    rows = rows.withColumn("block", F.floor(F.col("chars_before") / block_chars))
    rows = rows.join(template, ["_s", "block"])  # one row per block
    kept = [c for c in own.columns if not c.startswith("_")]
    return rows.select(*kept, "block", "slot", "chars_before")


def mix(docs: DataFrame, weights: Mapping[str | None, float] | None = None, block_chars: int = BLOCK_CHARS, temperature: float = TEMPERATURE, slots: int = SLOTS) -> DataFrame:
    """The rows of ``docs`` in mixture order: sorted within partitions that are ranges of slots.

    All columns and all rows are kept, also rows that are equal in everything.
    Texts move twice: to the group of their source, and to their range of slots.
    """
    names = docs.columns
    own = docs.select(
        F.struct(*[docs[c].alias(f"c{i}") for i, c in enumerate(names)]).alias("row"),
        docs["doc_id"].alias("doc_id"),
        F.coalesce(docs["source"], F.lit(NO_SOURCE)).alias("_s"),
        F.greatest(F.coalesce(F.length(docs["text"]), F.lit(0)), F.lit(1)).cast("long").alias("n_chars"),
        F.xxhash64(docs["doc_id"]).alias("_h"),
    )
    placed = _place(own, weights, block_chars, temperature, slots)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = placed.repartitionByRange(n, "slot", "chars_before").sortWithinPartitions("slot", "chars_before")
    return placed.select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(names)])
