"""Queries on feature charts in long form, ``(phone, feature)``."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def features_for(chart: DataFrame, phone: str) -> DataFrame:
    """Features of a phone; none for an unknown one."""
    return chart.filter(F.col("phone") == phone).select("feature").distinct()


def phones_with(chart: DataFrame, features: Sequence[str]) -> DataFrame:
    """Phones that have all of ``features``; all phones for an empty query."""
    wanted = list(dict.fromkeys(features))
    if not wanted:
        return chart.select("phone").distinct()
    hits = chart.filter(F.col("feature").isin(wanted)).groupBy("phone").agg(F.count_distinct("feature").alias("n"))
    return hits.filter(F.col("n") == len(wanted)).select("phone")


def syllabics(chart: DataFrame) -> DataFrame:
    """``(phone, kind)``: syllabic phones, vowels where they are one symbol and diphthongs where more."""
    kind = F.when(F.length("phone") > 1, "diphthong").otherwise("vowel")
    return phones_with(chart, ["+syllabic"]).select("phone", kind.alias("kind"))


def feature_sets(chart: DataFrame) -> DataFrame:
    return chart.groupBy("phone").agg(F.array_sort(F.collect_set("feature")).alias("features"))


def feature_ngrams(sets: Sequence[Column]) -> Column:
    """All sequences of one feature per position, joined with commas, from one array of features per position."""
    def extended(grams: Column, nxt: Column) -> Column:
        return F.flatten(F.transform(grams, lambda a: F.transform(nxt, lambda x: F.concat_ws(",", a, x))))

    return reduce(extended, sets[1:], sets[0])


def feature_counts(grams: DataFrame, chart: DataFrame, n: int) -> DataFrame:
    """``(gram, cnt)`` of feature n-grams of symbol n-grams ``(ngram, cnt)``.

    Distinct n-grams are expanded, each once; the chart is a small table by
    nature and joined once per position.
    """
    sets, out = feature_sets(chart), grams
    for k in range(n):
        side = sets.select(F.col("phone").alias(f"p{k}"), F.col("features").alias(f"f{k}"))
        out = out.withColumn(f"p{k}", F.substring("ngram", k + 1, 1)).join(side, f"p{k}")
    out = out.select("cnt", F.explode(feature_ngrams([F.col(f"f{k}") for k in range(n)])).alias("gram"))
    return out.groupBy("gram").agg(F.sum("cnt").alias("cnt"))
