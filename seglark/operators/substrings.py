"""Words inside words."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as X


def containment(words: DataFrame, prefix: bool = False, suffix: bool = False, tokens: bool = False) -> DataFrame:
    """``(word, cnt)``: in how many other words each word occurs, literally; zeros are kept.

    ``prefix`` and ``suffix`` ask for occurrences at the start, at the end, or
    (both) at either.  With ``tokens`` every token of a containing word counts.
    Instead of comparing all pairs, the distinct proper substrings of each word
    are listed and joined with the words by equality.
    """
    counted = words.groupBy("word").agg(F.count("*").alias("k"))
    w = F.col("word")
    n = F.length(w)
    sizes = F.when(n > 1, F.sequence(F.lit(1), n - 1)).otherwise(F.array().cast("array<int>"))
    starts = F.transform(sizes, lambda k: F.substring(w, F.lit(1), k))
    ends = F.transform(sizes, lambda k: F.substring(w, n - k + 1, k))
    if prefix or suffix:
        parts = F.concat(*([starts] if prefix else []), *([ends] if suffix else []))
    else:
        parts = F.transform(X.substrings(w), lambda x: x["word"])
    inside = counted.select("k", w.alias("whole"), F.explode(F.array_distinct(parts)).alias("word")).filter("word <> whole")
    types = words.select("word").distinct()
    amount = F.col("k") if tokens else F.lit(1)
    hits = inside.join(types, "word", "left_semi").groupBy("word").agg(F.sum(amount).alias("cnt"))
    return types.join(hits, "word", "left").na.fill(0, ["cnt"]).select("word", F.col("cnt").cast("long").alias("cnt"))
