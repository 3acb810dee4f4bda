import itertools
import math

import pytest
from pyspark.sql import functions as F

from seglark.operators import combine, crossval, cues, search
from seglark.plans import learner
from seglark.plans.config import SegmenterConfig
from seglark.plans.learner import Segmenter, symbols_in
from seglark.sources import corpus as C

LINES = ["yu want tu", "yu wan ttu", "want it", "tu it want"]
OPTIONS = [
    dict(score_piecewise=True),
    dict(phoneme_window=2),
    dict(phoneme_window=3, type_denominator=True),
    dict(phoneme_window=2, hypothetical_phonotactics=True),
    dict(hypothetical_phonotactics=True),
    dict(phoneme_window=2, joint_probability=True),
    dict(phoneme_window=2, ignore_word_boundary=True),
    dict(mbdp=True, hypothetical_phonotactics=True),
    dict(phoneme_window=2, subseq_denominator=True),
    dict(phoneme_window=2, subseq_denominator=True, joint_probability=True),
    dict(phoneme_window=2, token_phonotactics=True),
    dict(phoneme_window=2, witten_bell=True),
]


def corpus_of(spark, lines=LINES):
    return spark.createDataFrame([(i + 1, t) for i, t in enumerate(lines)], "utt_id long, text string")


def taught(config, lines=LINES):
    m = Segmenter(config, symbols_in(lines))
    for line in lines:
        m.count_subsequences(line.replace(" ", ""))
        for w in line.split():
            m.learn_word(w)
        m.end_utterance()
    m.lexicon["$"] = m.number(0)
    return m


@pytest.mark.parametrize("options", OPTIONS, ids=lambda o: "-".join(o))
def test_frozen_tables_agree_with_learner(spark, options):
    config = SegmenterConfig(**options)
    model, corpus = taught(config), corpus_of(spark)
    words = spark.createDataFrame([(w,) for w in ("want", "tu", "ant", "tuyu", "w", "it")], "word string")
    got = combine.score_words(words, corpus, cues.train(corpus, config), cues.subsequence_counts(corpus)).collect()
    assert len(got) == 6
    for r in got:
        exact = model.scores(r["word"]) | {"score": model.score(r["word"])}
        for name in set(exact) & set(r.asDict()):
            value = float(exact[name])
            assert r[name] == pytest.approx(math.log(value) if value > 0 else cues.NO_SCORE, rel=1e-9, abs=1e-9)


def test_piecewise_by_joins(spark, monkeypatch):
    corpus, config = corpus_of(spark), SegmenterConfig()
    words = C.word_types(corpus)
    a = {r["word"]: r["piecewise"] for r in cues.piecewise(words, corpus, config).collect()}
    monkeypatch.setattr(cues, "MAX_INVENTORY", 1)
    b = {r["word"]: r["piecewise"] for r in cues.piecewise(words, corpus, config).collect()}
    assert a == pytest.approx(b) and len(a) == 6


def test_familiar_scores():
    m = Segmenter(SegmenterConfig(), "yuwantit")
    m.add(2, ["want"])
    m.add(1, ["tu"])
    assert float(m.familiar_score("want")) == pytest.approx(2 / 3)
    m.config = SegmenterConfig(type_denominator=True)
    assert float(m.familiar_score("want")) == pytest.approx(2 / 5)
    m.config = SegmenterConfig(mbdp=True)
    assert float(m.familiar_score("want")) == pytest.approx(1 / 3)
    assert m.pairs(["tat"])["tat"] == [" t", "ta", "tt", "t ", "at", "a "]


def test_uniform_start():
    m = Segmenter(SegmenterConfig(phoneme_window=2, initial_count="0.01"), "abcdefghi")
    assert [float(x) for x in m.phoneme.initial] == pytest.approx([0.2, 0.01])
    assert [float(x) for x in m.phoneme.totals] == pytest.approx([2, 0.9])


def test_first_utterance_is_one_word_under_mbdp():
    found = learner.learn(["yu want tu"], SegmenterConfig(mbdp=True, hypothetical_phonotactics=True))
    assert found[0][0][1] == ["yuwanttu"]


def best_by_hand(model, text):
    best = None
    for cuts in itertools.product((0, 1), repeat=len(text) - 1):
        path = [0, *[i + 1 for i, c in enumerate(cuts) if c], len(text)]
        value = math.prod((model.score(text[a:b]) for a, b in zip(path, path[1:])), start=model.number(1))
        if best is None or value > best:
            best = value
    return best


@pytest.mark.parametrize("exact", [True, False])
@pytest.mark.parametrize("window", [1, 2])
def test_search_is_best(exact, window):
    model = taught(SegmenterConfig(phoneme_window=window, exact=exact))
    for text in ("yuwanttu", "itwantyu", "wanwan", "x", "tttttt"):
        path = model.search(text)
        value = math.prod((model.score(text[a:b]) for a, b in zip(path, path[1:])), start=model.number(1))
        assert float(value) == pytest.approx(float(best_by_hand(model, text)))
        assert float(model.n_best(text, 3)[0][0]) == pytest.approx(float(value))


def test_native_search_agrees(spark):
    corpus, config = corpus_of(spark), SegmenterConfig()
    model = taught(config)
    cands = search.candidates(corpus)
    scores = combine.score_words(cands.select("word").distinct(), corpus, cues.train(corpus, config)).select("word", "score")
    scored = cands.join(scores, "word").select("utt_id", "s", "e", "score")
    got = {r["utt_id"]: r["offsets"] for r in search.viterbi(scored).collect()}
    many = {r["utt_id"]: r["paths"] for r in search.n_best(scored, 2).collect()}
    broad = {r["utt_id"]: r["words"] for r in search.segment_with(corpus, model).collect()}
    loaded = {r["utt_id"]: r["words"] for r in search.segment_with(corpus, search.load(cues.train(corpus, SegmenterConfig(exact=False)))).collect()}
    for i, line in enumerate(LINES, 1):
        text = line.replace(" ", "")
        path = model.search(text)
        assert got[i] == path and many[i][0]["offsets"] == path
        assert broad[i] == loaded[i] == [text[a:b] for a, b in zip(path, path[1:])]
        assert many[i][0]["score"] >= many[i][1]["score"]


def test_runs(spark):
    corpus = corpus_of(spark).withColumn("run", F.lit("one"))
    both = corpus.unionByName(corpus.withColumn("run", F.lit("two")))
    runs = {"one": SegmenterConfig(), "two": SegmenterConfig(supervised_for=2, semisupervised=True)}
    got = learner.run(both, runs).collect()
    by = {(r["run"], r["utt_id"]): r["words"] for r in got}
    for name, config in runs.items():
        for i, found in enumerate(learner.learn(LINES, config), 1):
            assert by[name, i] == found[0][1]
            assert "".join(found[0][1]) == LINES[i - 1].replace(" ", "")
    assert by["two", 1] == ["yu", "want", "tu"]


@pytest.mark.parametrize("options", [dict(gold_phonotactics=True), dict(wait_until=2), dict(wait_for_stable=True), dict(utterance_limit=2), dict(n_best=2), dict(weighted_sum=True), dict(syllable_window=1, initialize_syllables=True), dict(uniform_phonotactics=True), dict(no_lexicon=True), dict(require_syllabic=True)], ids=str)
def test_all_processors(options):
    found = learner.learn(LINES, SegmenterConfig(**options))
    assert len(found) == options.get("utterance_limit", len(LINES))
    for line, many in zip(LINES, found):
        assert all("".join(words) == line.replace(" ", "") for _, words in many)
        assert float(many[0][0]) == 1
    if "wait_until" in options:
        assert found[0][0][1] == ["yuwanttu"]


def test_flags():
    assert SegmenterConfig.from_flags(phonemeWindow=2, MBDP=True, waitUntilUtterance=3) == SegmenterConfig(phoneme_window=2, mbdp=True, wait_until=3)
    assert SegmenterConfig(mbdp=True).initial_count == "0"
    with pytest.raises(ValueError):
        SegmenterConfig.from_flags(nope=1)


def test_folds(spark):
    corpus = spark.createDataFrame([(i, "a b") for i in range(1, 24)], "utt_id long, text string")
    got = crossval.folds(corpus, 10).groupBy("fold").count().collect()
    assert sorted((r["count"] for r in got)) == [2] * 10 + [3]
    plan = crossval.plans(corpus, 10)
    assert plan.filter("part = 'test'").count() == 20 and plan.filter("part = 'supervised'").count() == 180


def test_cross_validation(spark):
    corpus = corpus_of(spark, LINES * 3)
    total = crossval.cross_validate(corpus, SegmenterConfig(), k=3).first()
    assert 0 <= total["WP"] <= 100
    assert crossval.cross_validate(corpus, SegmenterConfig(), k=3, per_fold=True).count() == 3


def test_anneal(spark):
    rows = spark.createDataFrame([(1, "doyouseethedoggy", "0" * 15)], "utt_id long, text string, bits string")
    a, b = (search.anneal(rows, 20, 1.5, seed=4).first() for _ in range(2))
    assert a == b and "".join(a["words"]) == "doyouseethedoggy" and a["cost"] <= search.description_length(["doyouseethedoggy"])
    assert search.description_length(["yu", "want", "tu", "want"]) == 14


def test_cost_from_boundaries():
    import numpy as np

    rng = np.random.default_rng(3)
    for text in ("", "a", "abab", "doyouseethedoggydoyou"):
        for _ in range(30):
            bits = rng.integers(0, 2, max(0, len(text) - 1))
            assert search.boundary_cost(text, bits) == search.description_length(search.cut_at(text, "".join(map(str, bits))))
    assert search.temperatures(4.0, 2.0) == [4.0, 2.0, 1.0] and search.temperatures(0.5, 2.0) == []


def test_a_run_without_a_name(spark):
    from seglark.plans import learner

    rows = [(None, 1, "we want it"), ("a", 1, "we want"), (None, 2, "it"), ("b", 1, "x")]
    own = spark.createDataFrame(rows, "run string, utt_id long, text string")
    got = {(r["run"], r["utt_id"]): "".join(r["words"]) for r in learner.run(own, {None: SegmenterConfig(exact=False), "a": SegmenterConfig(exact=False)}).collect()}
    assert got == {(None, 1): "wewantit", (None, 2): "it", ("a", 1): "wewant"}
    assert learner.run(own, {"b": SegmenterConfig(exact=False)}).count() == 1


def test_logarithms_find_what_exact_numbers_find():
    """Equal products of different factors: their sums of logarithms differ in the last digits."""
    lines = ["bbab", "c", "ba", "bb", "ccc", "cab  b bc", "accc ca", "bcc", "bb", "a ab", "acbc", "ba b"]
    options = dict(type_denominator=True, supervised_for=6, semisupervised=True)
    exact, logs = (learner.learn(lines, SegmenterConfig(exact=e, **options)) for e in (True, False))
    assert [f[0][1] for f in logs] == [f[0][1] for f in exact]


def test_pairs_are_counted_when_asked_for():
    m = Segmenter(SegmenterConfig(exact=False), "abc")
    m.learn_word("abc" * 1000)
    assert not m.piecewise._pairs and m.piecewise.pairs["ab"] == pytest.approx(1000.0001)


@pytest.mark.parametrize("most", [None, 1, 4, 5, 8])
def test_substrings_by_suffixes(spark, most):
    """Against every substring; what moves is a row a symbol, so the plan has no row per substring before its last step."""
    lines = ["abababab", "aaaaaaaaa", "xabababy", "é😀é😀é😀é", "abababab", "b", ""]
    own = corpus_of(spark, lines)
    every = [t[s:e] for t in lines for s in range(len(t)) for e in range(s + 1, len(t) + 1) if most is None or e - s <= most]
    counts = cues.subsequence_counts(own, most)
    rows = [(r["gram"], r["subs"]) for r in counts.collect()]
    assert len(rows) == len(set(every)) and dict(rows) == {w: every.count(w) for w in every}
    if most is None:
        plan = counts._jdf.queryExecution().optimizedPlan().toString()
        assert "Aggregate [word" not in plan and "suffix" in plan


def test_a_words_own_counts_need_no_join(spark):
    corpus, config = corpus_of(spark), SegmenterConfig(hypothetical_phonotactics=True)
    scored = cues.phoneme(C.word_types(corpus), cues.train(corpus, config))
    assert scored._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1
