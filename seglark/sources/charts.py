"""Feature charts and transliteration keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_chart(spark: SparkSession, path: str, sep: str = "\t", encoding: str = "UTF-8") -> DataFrame:
    """Wide chart: ``phone`` and one column per feature with values + - 0.

    ``path`` may be a glob over several files of one header.  White space is
    kept, since a phone may be a blank.
    """
    wide = spark.read.csv(path, sep=sep, header=True, encoding=encoding, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    return wide.withColumnRenamed(wide.columns[0], "phone")


def feature_names(chart: DataFrame) -> list[str]:
    return [c for c in chart.columns if c != "phone"]


def chart_long(chart: DataFrame) -> DataFrame:
    """``(phone, feature)`` with signed features such as +voice; unspecified values (0) are dropped."""
    long = chart.unpivot(["phone"], feature_names(chart), "name", "value").filter(F.col("value") != "0")
    return long.select("phone", F.concat("value", "name").alias("feature"))


def chart_wide(long: DataFrame, names: list[str]) -> DataFrame:
    """The chart of a long table again; features that a phone doesn't have are 0."""
    parts = long.select("phone", F.substring("feature", 1, 1).alias("value"), F.expr("substring(feature, 2)").alias("name"))
    return parts.groupBy("phone").pivot("name", names).agg(F.first("value")).na.fill("0", names)


def read_key(spark: SparkSession, path: str, encoding: str = "UTF-8") -> list[tuple[str, str]]:
    """Ordered replacement rules of a key file (a few lines, read on the driver)."""
    rows = spark.read.option("encoding", encoding).text(path, wholetext=True).collect()
    if encoding.upper().replace("-", "") != "UTF8":
        rows = spark.read.format("binaryFile").load(path).select("content").collect()
        text = "".join(bytes(r["content"]).decode(encoding) for r in rows)
    else:
        text = "".join(r["value"] for r in rows)
    pairs = [line.split("\t") for line in text.splitlines() if line]
    return [(p[0], p[1] if len(p) > 1 else "") for p in pairs]
