import random
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from seglark.functions import text as X


def one(spark, col, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values))
    return row.select(col.alias("x")).first()["x"]


def test_segmentation_forms(spark):
    u = F.col("u")
    assert one(spark, X.to_bits(u), u="yu want tu") == [0, 1, 0, 0, 0, 1, 0, 1]
    assert one(spark, X.to_offsets(u), u="yu want tu") == [0, 2, 6, 8]
    assert one(spark, X.words(u), u="  yu  want tu ") == ["yu", "want", "tu"]
    assert one(spark, X.strip_delimiters(u), u="yu want tu") == "yuwanttu"
    assert one(spark, X.words_at(F.col("t"), F.array(F.lit(0), F.lit(2), F.lit(6), F.lit(8))), t="yuwanttu") == ["yu", "want", "tu"]
    assert one(spark, X.words_from_bits(F.col("t"), F.col("b")), t="yuwanttu", b="0100010") == ["yu", "want", "tu"]
    assert one(spark, X.to_offsets(u), u="") == [0]


def test_ngrams_and_substrings(spark):
    w = F.col("w")
    assert one(spark, X.char_ngrams(w, 2, " ", " "), w="ab") == [" a", "ab", "b "]
    assert one(spark, X.char_ngrams(w, 4), w="ab") == []
    assert one(spark, X.element_ngrams(F.array(F.lit("a"), F.lit("b"), F.lit("c")), 2), w="") == ["a.b", "b.c"]
    assert one(spark, X.padded_ngrams(F.array(F.lit("a")), 2), w="") == [["", "a"], ["a", ""]]
    found = {(x["s"], x["e"], x["word"]) for x in one(spark, X.substrings(w), w="abc")}
    assert found == {(0, 1, "a"), (0, 2, "ab"), (1, 2, "b"), (0, 3, "abc"), (1, 3, "bc"), (2, 3, "c")}
    assert len(one(spark, X.substrings(w, 2), w="abcd")) == 7
    assert one(spark, X.substrings(w), w="") == []


def test_precedence(spark):
    w = F.col("w")
    assert one(spark, X.precedence_pairs(w), w=" tat ") == [" t", "ta", "tt", "t ", "at", "a "]
    assert [(x["symbol"], x["before"]) for x in one(spark, X.preceding_sets(w), w=" ta")] == [("t", [" "]), ("a", [" ", "t"])]


@pytest.mark.parametrize("word,expected", [("bAsk6t", "bAs.k6t"), ("AplE", "Ap.lE"), ("AstrE", "As.trE"), ("9Iv&", "9I.v&"), ("kts", None), ("", None)])
def test_syllables(spark, word, expected):
    assert one(spark, X.syllabified(F.col("w")), w=word) == expected
    assert one(spark, X.syllabified(F.col("w"), "keep"), w=word) == (word if expected is None else expected)


def test_transliterate_cascades(spark):
    assert one(spark, X.transliterate(F.col("w"), [("9", "9I"), ("Q", "9U")]), w="9 Q") == "9I 9U"


def test_scalars(spark):
    assert X.falling_factorial(5, 2) == 20
    assert X.parse_rational("0.0001") == Fraction(1, 10000)
    with pytest.raises(ValueError):
        X.parse_rational("-1")
    assert X.flip("010", 1) == "000"
    assert X.flip("1", 0) == "0" and X.flip("0010", 0) == "1010" and X.inverted("0101", [0, 3, 3]) == "1101"
    for n in range(6):
        turned = X.flip_n("0" * 9, n, random.Random(n))
        assert len(turned) == 9 and turned.count("1") <= n and turned.count("1") % 2 == n % 2
    assert X.flip_n("", 3, random.Random(1)) == ""
    assert sorted(r["item"] for r in X.sequences(spark, ["a", "b"], 2).collect()) == ["aa", "ab", "ba", "bb"]


def test_words_from_bits_of_a_long_text(spark):
    """One pass over a text, not a look from its beginning for each place."""
    from pyspark.sql import functions as F

    from seglark.functions import text as X

    rows = [("é" * 300_000, "001" * 99_999 + "00"), ("", ""), ("a", ""), ("abc", "11"), ("abc", "0"), (None, None)]
    df = spark.createDataFrame(rows, "t string, b string")
    got = [r[0] for r in df.select(X.words_from_bits(F.col("t"), F.col("b"))).collect()]
    assert got[0] == ["ééé"] * 100_000 and got[1:] == [[], ["a"], ["a", "b", "c"], ["abc"], []]
    assert [r[0] for r in spark.createDataFrame([("ab  c d",), ("",)], "t string").select(X.bits(F.col("t"))).collect()] == ["0111", ""]
