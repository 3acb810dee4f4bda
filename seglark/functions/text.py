"""String operators on utterances and words, as Column functions.

A symbol is one code point.  An utterance is a string of words with a
delimiter between them; a segmentation is an array of offsets (0, the end of
each word), an array of booleans (true: a word ends here) or a string of 0
and 1 for the places between symbols.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator, Sequence
from fractions import Fraction
from functools import reduce
from operator import xor

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Vowel symbols and diphthongs of the phonemic alphabet (fixed values).
VOWELS = "&69AEIOUaeiouR~ML"
DIPHTHONGS = ("9I", "9U", "OI")


def _quoted(delim: str) -> str:
    return re.escape(delim)


def words(col: Column, delim: str = " ") -> Column:
    """Non-empty words; doubled, leading and trailing delimiters leave no word."""
    return F.filter(F.split(col, _quoted(delim)), lambda w: w != "")


def strip_delimiters(col: Column, delim: str = " ") -> Column:
    return F.replace(col, F.lit(delim), F.lit(""))


def _ends(sizes: Column) -> Column:
    start = F.array().cast("array<int>")
    return F.aggregate(sizes, start, lambda a, x: F.concat(a, F.array(x + F.coalesce(F.get(a, F.size(a) - 1), F.lit(0)))))


def to_offsets(col: Column, delim: str = " ") -> Column:
    """``[0, end of first word, ..., length]`` in the stripped utterance."""
    return F.concat(F.array(F.lit(0)), _ends(F.transform(words(col, delim), F.length)))


def to_booleans(col: Column, delim: str = " ") -> Column:
    """One boolean per symbol of the stripped utterance: true where a word ends."""
    return F.flatten(F.transform(words(col, delim), lambda w: F.concat(F.array_repeat(F.lit(False), F.length(w) - 1), F.array(F.lit(True)))))


def to_bits(col: Column, delim: str = " ") -> Column:
    return F.transform(to_booleans(col, delim), lambda b: b.cast("int"))


def join_words(col: Column, delim: str = " ") -> Column:
    return F.array_join(col, delim)


def words_at(text: Column, offsets: Column) -> Column:
    """Words of a stripped utterance between consecutive offsets."""
    return F.zip_with(F.slice(offsets, 1, F.size(offsets) - 1), F.slice(offsets, 2, F.size(offsets) - 1), lambda a, b: F.substring(text, a + 1, b - a))


def bits(col: Column, delim: str = " ") -> Column:
    """:func:`to_bits` as a string of digits, from the sizes of the words."""
    return F.array_join(F.transform(words(col, delim), lambda w: F.concat(F.repeat(F.lit("0"), F.length(w) - 1), F.lit("1"))), "")


def words_from_bits(text: Column, bits: Column) -> Column:
    """Words of ``text`` cut after each place whose digit in ``bits`` is 1; ``bits`` is one shorter than ``text``."""

    def cut(t: str | None, b: str | None) -> list[str]:
        out, at, t = [], 0, t or ""
        for zeros in (b or "")[: max(0, len(t) - 1)].split("1")[:-1]:
            out.append(t[at : at + len(zeros) + 1])
            at += len(zeros) + 1
        return [*out, t[at:]] if t else []

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series, digits: pd.Series) -> pd.Series:
        return pd.Series([cut(t, b) for t, b in zip(texts, digits)], dtype=object)

    return run(text, bits)


def char_ngrams(col: Column, n: int, left: str = "", right: str = "") -> Column:
    """n-grams of symbols of ``left + col + right``, in order."""
    padded = F.concat(F.lit(left), col, F.lit(right))
    count = F.length(padded) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.substring(padded, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def element_ngrams(col: Column, n: int, sep: str = ".") -> Column:
    """n-grams of array elements, each joined with ``sep``."""
    count = F.size(col) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(col, i, n), sep))).otherwise(F.array().cast("array<string>"))


def tagged(grams: Column, n: int, name: str) -> Column:
    """n-grams as structs of ``n`` and the n-gram."""
    return F.transform(grams, lambda g: F.struct(F.lit(n).alias("n"), g.alias(name)))


def padded_ngrams(col: Column, n: int, pad: str = "", both: bool = True) -> Column:
    """n-grams as arrays over an array with n - 1 pads before it (and after it)."""
    pads = F.array(*[F.lit(pad)] * (n - 1)) if n > 1 else F.array().cast("array<string>")
    padded = F.concat(pads, col, pads) if both else F.concat(pads, col)
    count = F.size(padded) - (n - 1)
    return F.when(count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.slice(padded, i, n))).otherwise(F.array().cast("array<array<string>>"))


def substrings(col: Column, max_len: int | None = None) -> Column:
    """All substrings ``(s, e, word)`` with 0 <= s < e <= length, optionally no longer than ``max_len``."""
    n = F.length(col)

    def ending(e: Column) -> Column:
        first = F.lit(0) if max_len is None else F.greatest(e - max_len, F.lit(0))
        return F.transform(F.sequence(first, e - 1), lambda s: F.struct(s.alias("s"), e.alias("e"), F.substring(col, s + 1, e - s).alias("word")))

    none = F.array().cast("array<struct<s:int,e:int,word:string>>")
    return F.when(n > 0, F.flatten(F.transform(F.sequence(F.lit(1), n), ending))).otherwise(none)


def each_substring(df: DataFrame, name: str, max_len: int | None = None) -> DataFrame:
    """``df`` with the column ``name`` replaced by its :func:`substrings`, a row each; never all of a text in one array."""
    others = [c for c in df.columns if c != name]
    ends = df.filter(F.length(name) > 0).select(*others, name, F.explode(F.sequence(F.lit(1), F.length(name))).alias("e"))
    first = F.lit(0) if max_len is None else F.greatest(F.col("e") - max_len, F.lit(0))
    both = ends.select(*others, name, "e", F.explode(F.sequence(first, F.col("e") - 1)).alias("s"))
    return both.select(*others, "s", "e", F.substring(F.col(name), F.col("s") + 1, F.col("e") - F.col("s")).alias("word"))


def symbols(col: Column) -> Column:
    return F.filter(F.split(col, ""), lambda c: c != "")


def precedence_pairs(col: Column, delim: str = " ") -> Column:
    """Pairs of each symbol, where it first occurs, with every later one; a delimiter in front pairs with the next symbol only."""
    chars = symbols(col)
    n = F.size(chars)

    def pairs(c: Column, i: Column) -> Column:
        last = F.when((i == 0) & (c == delim), F.least(F.lit(1), n - 1)).otherwise(n - 1)
        later = F.when(last > i, F.sequence(i + 1, last)).otherwise(F.array().cast("array<int>"))
        first = F.array_position(chars, c) == i + 1
        return F.when(first, F.transform(later, lambda j: F.concat(c, F.get(chars, j)))).otherwise(F.array().cast("array<string>"))

    return F.flatten(F.transform(chars, pairs))


def preceding_sets(col: Column) -> Column:
    """For each symbol but the first, itself and the sorted set of symbols before it."""
    chars = symbols(col)
    count = F.size(chars)
    none = F.array().cast("array<struct<symbol:string,before:array<string>>>")
    return F.when(
        count > 1,
        F.transform(F.sequence(F.lit(1), count - 1), lambda i: F.struct(F.get(chars, i).alias("symbol"), F.array_sort(F.array_distinct(F.slice(chars, 1, i))).alias("before"))),
    ).otherwise(none)


def transliterate(col: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Literal replacements in order; each rule sees what the ones before have made."""
    return reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), rules, col)


def sequences(spark: SparkSession, items: Sequence[str], length: int, sep: str = "") -> DataFrame:
    """All sequences of ``length`` items with repetition, in column ``item``: the items' table joined with itself."""
    base = spark.createDataFrame([(x,) for x in items], "item string")
    out = base
    for k in range(length - 1):
        out = out.crossJoin(base.select(F.col("item").alias(f"_{k}"))).select(F.concat("item", F.lit(sep), f"_{k}").alias("item"))
    return out


def falling_factorial(n: int, r: int) -> int:
    """n (n - 1) ... (n - r + 1)"""
    return reduce(lambda a, k: a * (n - k), range(r), 1)


def parse_rational(text: str) -> Fraction:
    """The exact value of a decimal; negative numbers are refused."""
    value = Fraction(text)
    if value < 0:
        raise ValueError(f"not a non-negative decimal: {text}")
    return value


def syllables_of(word: str | None, vowels: str = VOWELS, diphthongs: Sequence[str] = DIPHTHONGS) -> list[str] | None:
    """Syllables of one word, or None where it has no vowel.

    Every vowel or diphthong is a nucleus.  In turns, each nucleus takes the
    consonant before it, then the one after it, until none is free.
    """
    if not word:
        return None
    owner: list[int] = [-1] * len(word)
    nuclei, i = 0, 0
    while i < len(word):
        size = 2 if word[i : i + 2] in diphthongs else int(word[i] in vowels)
        owner[i : i + size] = [nuclei] * size
        nuclei += size > 0
        i += max(1, size)
    if not nuclei:
        return None
    while -1 in owner:
        for at in range(len(word) - 1):  # onsets: one symbol each
            if owner[at] < 0 <= owner[at + 1]:
                owner[at] = owner[at + 1] + nuclei  # marked, so that it takes no other in this turn
        owner = [k - nuclei if k >= nuclei else k for k in owner]
        for at in range(len(word) - 1, 0, -1):  # codas
            if owner[at] < 0 <= owner[at - 1]:
                owner[at] = owner[at - 1] + nuclei
        owner = [k - nuclei if k >= nuclei else k for k in owner]
    out: list[str] = []
    for at, symbol in enumerate(word):
        if at and owner[at] == owner[at - 1]:
            out[-1] += symbol
        else:
            out.append(symbol)
    return out


def syllabify(vowels: str = VOWELS, diphthongs: Sequence[str] = DIPHTHONGS):
    """A vectorised function from words to arrays of syllables (null without a vowel).

    The assignment of consonants is a fixpoint over the whole word, which no
    built-in expresses; apply it to distinct words and join.
    """

    @F.pandas_udf("array<string>")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda w: syllables_of(w, vowels, diphthongs))

    return run


def syllabified(col: Column, no_vowel: str = "null", vowels: str = VOWELS, diphthongs: Sequence[str] = DIPHTHONGS, sep: str = ".") -> Column:
    """Words with ``sep`` between syllables; without a vowel null, ``""`` ("empty") or the word itself ("keep")."""
    joined = F.array_join(syllabify(vowels, diphthongs)(col), sep)
    other = {"null": F.lit(None), "empty": F.lit(""), "keep": col}[no_vowel]
    return F.coalesce(joined, other)


def has_vowel(col: Column, vowels: str = VOWELS) -> Column:
    return col.rlike("[" + re.escape(vowels) + "]")


def flip(bits: str, at: int) -> str:
    """``bits`` with the digit at one place inverted."""
    return inverted(bits, [at])


def flip_n(bits: str, n: int, rng: random.Random) -> str:
    """``n`` inversions at random places, which may repeat; all places are drawn first."""
    return inverted(bits, rng.choices(range(len(bits)), k=n)) if bits else bits


def inverted(bits: str, places: Iterable[int]) -> str:
    """``bits`` as a number, with the digits at ``places`` inverted, once for each time a place is named."""
    width = len(bits)
    mask = reduce(xor, (1 << (width - 1 - at) for at in places), 0)
    return format(int(bits, 2) ^ mask, f"0{width}b")
