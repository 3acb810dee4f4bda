"""Quality rules: text statistics and cross-document line frequency.

Lines are normalised (lower case, runs of digits as 0, runs of white space as
one blank) and hashed.  Per host, the distinct documents that hold a line are
counted; lines in more than ``max_docs`` documents of their host count as boilerplate
and are removed, and documents of which too little is left are rejected.

DataFrame functions only.  Counts are aggregated before they are shuffled, by
(host, line, document) and then (host, line): a host may hold any share of the
rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, cut, let, words_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
MAX_DOCS, LEAST_LEFT = 20, 0.3
#: Parts in which a frequent line is joined.
SALT = 16


def lines_of(text: Column) -> Column:
    """Lines, split at newlines, that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: x.rlike(f"[^{SPACE}]"))


def normalised(line: Column) -> Column:
    line = F.regexp_replace(F.lower(line), "[0-9]+", "0")
    return F.trim(F.regexp_replace(line, f"[{SPACE}]+", " "))


def repeated_words(windows: Column, width: int = WINDOW) -> Column:
    """Words covered by windows (their hashes, in order) that occur twice or more."""
    placed = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def covered(s: Column) -> Column:
        n = F.size(s)
        same = F.filter(
            F.sequence(F.lit(0), n - 1),
            lambda k: ((k > 0) & (s[F.greatest(k - 1, F.lit(0))]["h"] == s[k]["h"])) | ((k < n - 1) & (s[F.least(k + 1, n - 1)]["h"] == s[k]["h"])),
        )
        at = F.sort_array(F.transform(same, lambda k: s[k]["i"]))
        start = F.struct(F.lit(-width).alias("last"), F.lit(0).alias("sum"))
        return F.aggregate(at, start, lambda a, x: F.struct(x.alias("last"), (a["sum"] + F.least(F.lit(width), x - a["last"])).alias("sum")), lambda a: a["sum"])

    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(placed, covered))


def statistics(docs: DataFrame) -> DataFrame:
    """One row per document: ``row`` (a number), ``doc_id``, ``host``, statistics and its ``lines``.

    ``lines`` holds each distinct normalised line once: its hash, its
    characters and how often the text has it.  Null texts have no words.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    own = docs.select(docs["doc_id"].alias("doc_id"), docs["source"].alias("host"), text.alias("text"), words_of(text).alias("words"), lines_of(text).alias("lines"))
    windows = F.when(
        F.size("words") >= WINDOW,
        F.transform(F.sequence(F.lit(1), F.size("words") - (WINDOW - 1)), lambda i: F.xxhash64(F.slice("words", i, WINDOW))),
    ).otherwise(F.array().cast("array<bigint>"))
    hashed = F.transform("lines", lambda x: let(normalised(x), lambda n: F.struct(F.xxhash64(n).alias("line"), F.length(n).alias("chars"))))
    own = own.select(
        "doc_id",
        "host",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.regexp_replace("text", f"[{SYMBOLS}]+", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.sort_array(hashed).alias("sorted"),
        windows.alias("windows"),
    )
    n = F.size("sorted")
    first = F.filter(F.sequence(F.lit(0), n - 1), lambda k: (k == 0) | (F.get("sorted", k - 1)["line"] != F.get("sorted", k)["line"]))
    first = F.when(n > 0, first).otherwise(F.array().cast("array<int>"))

    def counted(at: Column) -> Column:
        return F.transform(at, lambda k, i: F.struct(F.get("sorted", k)["line"].alias("line"), F.get("sorted", k)["chars"].alias("chars"), (F.coalesce(F.get(at, i + 1), n) - k).alias("times")))

    return own.select(
        F.monotonically_increasing_id().alias("row"),
        "doc_id",
        "host",
        "n_words",
        "word_chars",
        "n_symbols",
        "n_dup_lines",
        repeated_words(F.col("windows")).cast("long").alias("n_repeat_words"),
        F.aggregate("sorted", F.lit(0).cast("long"), lambda a, x: a + x["chars"]).alias("line_chars"),
        let(first, counted).alias("lines"),
    )


def frequent_lines(lines: DataFrame, max_docs: int = MAX_DOCS) -> DataFrame:
    """``host, line`` of ``lines (doc_id, host, line)`` that more than ``max_docs`` distinct documents of their host hold.

    Rows that share a ``doc_id`` are one document, and so are rows without
    one.  Pairs of line and document are made distinct first, each by its own
    hash; a line of any frequency then is one row per task.
    """
    counted = lines.groupBy("host", "line").agg(F.count_distinct(F.struct("doc_id")).alias("n_docs"))
    return counted.filter(F.col("n_docs") > max_docs).select("host", "line")


def judge(docs: DataFrame, max_docs: int = MAX_DOCS, least_left: float = LEAST_LEFT) -> DataFrame:
    """Statistics and verdict of every row of ``docs (doc_id, source, text)``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines,
    n_repeat_words, base_failed, removed_lines, removed_chars, kept``.
    ``base_failed``: fewer than 10 words, or more than 20 % of the words in
    repeated five-word windows.  ``kept``: not failed, and at least
    ``least_left`` of the characters of its (normalised) lines stay when the
    frequent ones are removed.  Rows without a source share one host; null and
    empty texts have no words and fail; rows that share a ``doc_id`` count as
    one document (so do those without) and each get a verdict; an empty table
    gives an empty result; columns other than ``doc_id, source, text`` are not
    read.

    Texts are read once: statistics and line hashes go to a table of the shared
    folder.  A frequent line is joined in ``SALT`` parts, so that none brings
    all its documents to one task.
    """
    table = cut(statistics(docs), "line-statistics")
    lines = table.select("row", "doc_id", "host", F.explode("lines").alias("l")).select("row", "doc_id", "host", "l.*")
    often = frequent_lines(lines, max_docs).select(F.col("host").alias("h"), F.col("line").alias("l"), F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))).alias("s"))
    lines = lines.select("row", "host", "line", "chars", "times", F.pmod("row", F.lit(SALT)).cast("int").alias("salt"))
    hit = lines.join(often, lines["host"].eqNullSafe(often["h"]) & (lines["line"] == often["l"]) & (lines["salt"] == often["s"]), "left_semi")
    removed = hit.groupBy("row").agg(F.sum("times").cast("long").alias("removed_lines"), F.sum(F.col("chars") * F.col("times")).cast("long").alias("removed_chars"))
    own = table.drop("lines").join(removed, "row", "left").fillna(0, ["removed_lines", "removed_chars"])
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    left = F.col("line_chars") - F.col("removed_chars") >= F.lit(least_left) * F.col("line_chars")
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "removed_lines", "removed_chars", (~failed & left).alias("kept"))


ORACLE = f"""
WITH d AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, i, list_slice(words, i, i + {WINDOW - 1}) AS w
  FROM d, unnest(range(1, len(words) - {WINDOW - 2})) AS t(i)
), again AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, w) > 1
), covered AS (
  SELECT doc_id, sum(least({WINDOW}, coalesce(i - before, {WINDOW}))) AS n
  FROM (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM again) GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, trim(regexp_replace(regexp_replace(lower(x), '[0-9]+', '0', 'g'), '[\\x20\\x09-\\x0D]+', ' ', 'g'), ' ') AS line
  FROM (SELECT doc_id, source, unnest(lines) AS x FROM d)
), often AS (
  SELECT source, line FROM lines GROUP BY source, line HAVING count(DISTINCT doc_id) + max(CASE WHEN doc_id IS NULL THEN 1 ELSE 0 END) > {MAX_DOCS}
), removed AS (
  SELECT l.doc_id, count(*) FILTER (o.line IS NOT NULL) AS removed_lines,
         coalesce(sum(length(l.line)) FILTER (o.line IS NOT NULL), 0) AS removed_chars, sum(length(l.line)) AS line_chars
  FROM lines l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line GROUP BY l.doc_id
), s AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
         CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
         CAST(coalesce(removed_lines, 0) AS BIGINT) AS removed_lines, CAST(coalesce(removed_chars, 0) AS BIGINT) AS removed_chars,
         coalesce(line_chars, 0) AS line_chars
  FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN removed USING (doc_id)
), f AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM s
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, removed_lines, removed_chars,
       NOT base_failed AND line_chars - removed_chars >= {LEAST_LEFT} * line_chars AS kept
FROM f"""
