"""Corpus scans and writers.

Order is part of a corpus: every utterance has an explicit ``utt_id``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X


def read_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(file, utt_id, text)``: one utterance per line, numbered from 1 within its file.

    A file is read as a whole, because line numbers need it; keep single files
    below what fits in a task, or use :func:`from_table` for tables.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.regexp_replace("value", "\r?\n$", "").alias("value"))
    lines = lines.select("file", F.posexplode(F.split("value", "\r?\n")).alias("at", "text"))
    return lines.select("file", (F.col("at") + 1).cast("long").alias("utt_id"), "text")


def from_table(table: DataFrame, order: Column, text: str = "text", step: int = 1_000_000) -> DataFrame:
    """``(utt_id, text)``: the lines of a text column, ``utt_id`` = order * step + line.

    ``order`` is a whole number that is unique per row and below 2^63 / step;
    a text may have up to ``step`` lines, and a longer one fails the query.  No
    shuffle; blank lines are dropped.
    """
    lines = table.select(order.cast("long").alias("o"), F.posexplode(F.split(F.col(text), "\n")).alias("at", "line"))
    at = F.when(F.col("at") < step, F.col("at")).otherwise(F.raise_error(F.concat(F.lit(f"more than {step} lines in text "), F.col("o").cast("string"))))
    return lines.filter(F.trim("line") != "").select((F.col("o") * step + at).alias("utt_id"), F.col("line").alias("text"))


def turn_order() -> Column:
    """Order of the rows of ``conversations``; a turn that would take the number of another conversation's fails the query."""
    turn = F.col("turn").cast("long")
    return F.col("conv_id") * 1000 + F.when(turn.between(0, 999), turn).otherwise(F.when(turn.isNotNull(), F.raise_error(F.concat(F.lit("turn out of 0 to 999 in conversation "), F.col("conv_id").cast("string"))).cast("long")))


def numbered(corpus: DataFrame, stretch: int = 1_000_000) -> DataFrame:
    """``corpus`` with ``utt_id`` counted from 1 without gaps, in the same order.

    Rows are counted within stretches of ids and over the stretches' totals.
    """
    rows = corpus.withColumn("_k", F.floor(F.col("utt_id") / stretch))
    sums = rows.groupBy("_k").agg(F.count("*").alias("_n"))
    sums = sums.select("_k", F.coalesce(F.sum("_n").over(Window.orderBy("_k").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_base"))  # one row per stretch
    rows = rows.withColumn("_in", F.row_number().over(Window.partitionBy("_k").orderBy("utt_id"))).join(sums, "_k")
    return rows.withColumn("utt_id", (F.col("_base") + F.col("_in")).cast("long")).select(*corpus.columns)


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of all conversations in order of conversation, turn and line."""
    table = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return from_table(table, turn_order(), step=1000)


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_table(spark.read.parquet(f"{sf_dir}/documents.parquet"), F.col("doc_id"))


def pair(gold: DataFrame, found: DataFrame, delim: str = " ", check: bool = True) -> DataFrame:
    """``(utt_id, gold, found)``: two segmentations of the same utterances.

    With ``check``, a row whose sides differ in more than delimiters fails the query.
    """
    both = gold.select("utt_id", F.col("text").alias("gold")).join(found.select("utt_id", F.col("text").alias("found")), "utt_id")
    if not check:
        return both
    same = X.strip_delimiters(F.col("gold"), delim) == X.strip_delimiters(F.col("found"), delim)
    return both.withColumn("found", F.when(same, F.col("found")).otherwise(F.raise_error(F.concat(F.lit("utterances differ: "), F.col("utt_id").cast("string")))))


def word_tokens(corpus: DataFrame, delim: str = " ") -> DataFrame:
    """``(utt_id, pos, word)`` of all word tokens, positions from 0."""
    return corpus.select("utt_id", F.posexplode(X.words(F.col("text"), delim)).alias("pos", "word"))


def word_types(corpus: DataFrame, delim: str = " ") -> DataFrame:
    return word_tokens(corpus, delim).select("word").distinct()


def word_list(corpus: DataFrame, tokens: bool = False, delim: str = " ") -> DataFrame:
    """``(word, size)`` for substring analysis: types, or all tokens."""
    found = word_tokens(corpus, delim).select("word") if tokens else word_types(corpus, delim)
    return found.withColumn("size", F.length("word"))


def inventory(corpus: DataFrame, delim: str = " ") -> DataFrame:
    """Distinct symbols of a corpus without white space, and the delimiter."""
    found = corpus.select(F.explode(F.array_distinct(X.symbols(F.col("text")))).alias("symbol")).filter(~F.col("symbol").rlike(r"^\s$")).distinct()
    return found.unionByName(corpus.sparkSession.createDataFrame([(delim,)], "symbol string")).distinct()


def syllable_types(corpus: DataFrame, delim: str = " ", vowels: str = X.VOWELS, diphthongs=X.DIPHTHONGS) -> int:
    """Number of syllable types of a corpus, and one for the boundary; words without a vowel count whole."""
    types = word_types(corpus, delim)
    parts = types.select(F.explode(F.coalesce(X.syllabify(vowels, diphthongs)(F.col("word")), F.array("word"))).alias("s"))
    return parts.agg(F.count_distinct("s")).first()[0] + 1


def format_utterances(segmented: DataFrame, line_numbers: bool = False, utterance_delimiter: str | None = None, delim: str = " ") -> DataFrame:
    """``(utt_id, line)`` from ``(utt_id, words)`` and, if there, ``weight``: only segmentations of weight 1 are written."""
    if "weight" in segmented.columns:
        segmented = segmented.filter("weight = 1")
    line = F.array_join("words", delim)
    if line_numbers:
        line = F.concat(F.col("utt_id").cast("string"), F.lit(": "), line)
    if utterance_delimiter is not None:
        line = F.concat(line, F.lit(utterance_delimiter))
    return segmented.select("utt_id", line.alias("line"))


def write_utterances(segmented: DataFrame, path: str, **options) -> None:
    """Text files in order of ``utt_id`` (a range per file)."""
    format_utterances(segmented, **options).orderBy("utt_id").select("line").write.text(path)


def write_counts(counts: DataFrame, path: str) -> None:
    """``key<tab>count`` lines; n-gram tables (column ``n``) in a folder per n."""
    writer = counts.write.option("sep", "\t").option("header", False)
    (writer.partitionBy("n") if "n" in counts.columns else writer).csv(path)


def write_report(report: DataFrame, path: str, header: bool = True) -> None:
    report.write.option("sep", "\t").option("header", header).csv(path)
