import pytest

from seglark.operators import evaluate, features, substrings
from seglark.sources import charts
from seglark.sources import corpus as C


def table(spark, *lines):
    return evaluate.word_table(spark.createDataFrame([(i + 1, t) for i, t in enumerate(lines)], "utt_id long, text string"))


def kinds(df):
    return [(r["word"], r["kind"]) for r in df.orderBy("utt_id", "widx").collect()]


def test_crossing_fixture(spark):
    gold, found = table(spark, "yu want tu"), table(spark, "yu wan ttu")
    assert kinds(evaluate.classify_true(gold, found)) == [("yu", "perfect"), ("want", "both"), ("tu", "under")]
    assert kinds(evaluate.classify_found(gold, found)) == [("yu", "perfect"), ("wan", "over"), ("ttu", "partial")]
    row = evaluate.summary(gold, found).first()
    for name in ("WP", "WR", "WF", "LP", "LR", "LF"):
        assert row[name] == pytest.approx(33.33)
    assert (row["BP"], row["BR"], row["BF"]) == (50, 50, 50)


def test_identity(spark):
    gold = table(spark, "yu want tu", "it")
    row = evaluate.summary(gold, gold).first().asDict()
    assert all(row[k] == 100 for k in ("WP", "WR", "WF", "BP", "BR", "BF", "LP", "LR", "LF"))
    assert all(row[k] == 0 for k in ("FO", "FU", "FB", "TO", "TU", "TB"))


def test_flags(spark):
    gold, found = table(spark, "D6 dOg z"), table(spark, "D6dOg z")
    assert [r["determiner_under"] for r in evaluate.classify_true(gold, found).orderBy("widx").collect()] == [True, False, False]
    assert evaluate.classify_found(gold, found).orderBy("widx").first()["determiner_under"]
    gold, found = table(spark, "dOgz"), table(spark, "dOg z")
    assert evaluate.classify_true(gold, found).first()["affix_over"]


def test_collocation_counts_run(spark):
    lines = ["a b"] * 4
    gold, found = table(spark, *lines), table(spark, *["ab"] * 4)
    got = [r["collocation_under"] for r in evaluate.classify_found(gold, found, threshold=3).orderBy("utt_id").collect()]
    assert got == [False, False, True, True]


def test_blocks_and_ignored(spark):
    gold = table(spark, "a b", "c d", "e f", "g h")
    blocks = evaluate.with_block(gold, 2, ignore=1)
    assert [r["block"] for r in blocks.select("block").distinct().orderBy("block").collect()] == [3, 5]
    assert evaluate.summary(blocks, blocks, ["block"]).count() == 2


def test_differing_sides_fail(spark):
    a = spark.createDataFrame([(1, "a b")], "utt_id long, text string")
    b = spark.createDataFrame([(1, "a c")], "utt_id long, text string")
    with pytest.raises(Exception, match="differ"):
        C.pair(a, b).collect()


def test_containment(spark):
    words = spark.createDataFrame([(w,) for w in ("a", "ab", "cab", "abc")], "word string")
    get = lambda **o: {r["word"]: r["cnt"] for r in substrings.containment(words, **o).collect()}
    assert get() == {"a": 3, "ab": 2, "cab": 0, "abc": 0}
    assert get(prefix=True) == {"a": 2, "ab": 1, "cab": 0, "abc": 0}
    assert get(suffix=True) == {"a": 0, "ab": 1, "cab": 0, "abc": 0}


def test_charts(spark, tmp_path):
    path = tmp_path / "chart.tab"
    path.write_text("\tsyllabic\tvoice\na\t+\t+\nt\t-\t-\n9I\t+\t0\n \t0\t-\n")
    chart = charts.read_chart(spark, str(path))
    long = charts.chart_long(chart)
    assert {r["feature"] for r in features.features_for(long, "a").collect()} == {"+syllabic", "+voice"}
    assert {r["phone"] for r in features.phones_with(long, ["+syllabic"]).collect()} == {"a", "9I"}
    assert features.phones_with(long, []).count() == 4 and features.phones_with(long, ["+x"]).count() == 0
    assert {r["phone"]: r["kind"] for r in features.syllabics(long).collect()} == {"a": "vowel", "9I": "diphthong"}
    back = {r["phone"]: (r["syllabic"], r["voice"]) for r in charts.chart_wide(long, ["syllabic", "voice"]).collect()}
    assert back[" "] == ("0", "-") and back["a"] == ("+", "+")
    key = tmp_path / "key.txt"
    key.write_text("9\t9I\nQ\t9U\n")
    assert charts.read_key(spark, str(key)) == [("9", "9I"), ("Q", "9U")]
    key.write_bytes("9\t9I\n".encode("utf-16"))
    assert charts.read_key(spark, str(key), "UTF-16") == [("9", "9I")]


def test_corpus_files(spark, tmp_path):
    path = tmp_path / "gold.txt"
    path.write_text("yu want tu\nit\n\nwant\n")
    corpus = C.read_corpus(spark, str(path)).select("utt_id", "text")
    assert [tuple(r) for r in corpus.orderBy("utt_id").collect()] == [(1, "yu want tu"), (2, "it"), (3, ""), (4, "want")]
    assert C.word_types(corpus).count() == 4
    seg = spark.createDataFrame([(2, ["a", "b"], 1.0), (1, ["c"], 1.0), (3, ["d"], 0.5)], "utt_id long, words array<string>, weight double")
    C.write_utterances(seg, str(tmp_path / "out"), line_numbers=True, utterance_delimiter="$")
    assert sorted(r["value"] for r in spark.read.text(str(tmp_path / "out")).collect()) == ["1: c$", "2: a b$"]
    C.write_counts(spark.createDataFrame([(1, "a", 2)], "n int, gram string, cnt long"), str(tmp_path / "counts"))
    assert spark.read.csv(str(tmp_path / "counts"), sep="\t").count() == 1
    assert C.syllable_types(corpus) == len({"yu", "want", "tu", "it"} ) + 1
    assert {r["symbol"] for r in C.inventory(corpus).collect()} == set("yuwanti ")


def test_overlaps_of_long_lines_need_no_pairs(spark):
    """A line of 4,000 words beside others, over several batches; no join of all words of a line with all of the other side."""
    words = ["ab", "c", "def"] * 1334
    lines = [" ".join(words), "x", "", "yu want tu"]
    gold, found = table(spark, *lines), table(spark, "".join(words), "x", "", "yu wan ttu")
    true = evaluate.classify_true(gold, found)
    assert kinds(true) == [(w, "under") for w in words] + [("x", "perfect"), ("yu", "perfect"), ("want", "both"), ("tu", "under")]
    assert kinds(evaluate.classify_found(gold, found))[:2] == [("".join(words), "under"), ("x", "perfect")]
    assert "Join" not in true._jdf.queryExecution().optimizedPlan().toString()
    merged = evaluate.merge_words(spark.createDataFrame([(1, "a b c d"), (2, " a"), (3, "")], "utt_id long, text string"))
    assert [r["text"] for r in merged.orderBy("utt_id").collect()] == ["ab c d", "a", ""]


def test_words_that_overlap_on_one_side(spark):
    spans = "utt_id long, widx int, s int, e int, word string"
    a = spark.createDataFrame([(1, 0, 0, 2, "ab"), (1, 1, 5, 6, "f")], spans)
    b = spark.createDataFrame([(1, 0, 0, 4, "abcd"), (1, 1, 1, 2, "b"), (2, 0, 0, 2, "ab")], spans)
    assert [(r["word"], [tuple(o) for o in r["other"]]) for r in evaluate.overlaps(a, b).collect()] == [("ab", [(0, 4, "abcd"), (1, 2, "b")])]


def test_collocations_are_dealt_out_before_they_are_counted(spark):
    counts = evaluate.collocations(table(spark, "a b c", "a b"))
    assert {(r["n"], r["collocation"], r["cnt"]) for r in counts.collect()} == {(2, "a b", 2), (2, "b c", 1), (3, "a b c", 1)}
    assert "RepartitionByExpression" in counts._jdf.queryExecution().optimizedPlan().toString().split("Generate")[0]
