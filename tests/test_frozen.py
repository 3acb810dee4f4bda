import random
import time

import pyarrow as pa
import pytest

from seglark.operators import cues, search
from seglark.plans import frozen
from seglark.plans.config import SegmenterConfig
from seglark.plans.frozen import FrozenSearch
from seglark.plans.learner import Segmenter

ALPHABETS = ["ab", "abc", "abcdefgh$", "aé漢😀b", "a\tb$\0c", "".join(map(chr, range(0x4E00, 0x5000)))]
OPTIONS = [{}, dict(type_denominator=True), dict(token_phonotactics=True), dict(ignore_word_boundary=True), dict(joint_probability=True), dict(initial_count="3")]


def one_by_one(model, lines):
    texts = {i: (x or "").replace(" ", "") for i, x in enumerate(lines)}
    paths = {i: (t, model.search(t)) for i, t in texts.items() if t}
    return {i: [t[a:b] for a, b in zip(p, p[1:])] for i, (t, p) in paths.items()}


@pytest.mark.parametrize("seed", range(60))
def test_batches_are_segmented_as_single_texts(seed, monkeypatch):
    rng = random.Random(seed)
    alphabet, options = rng.choice(ALPHABETS), OPTIONS[seed % len(OPTIONS)]
    model = Segmenter(SegmenterConfig(exact=False, **options), alphabet[: rng.randint(1, len(alphabet))])
    draw = lambda symbols, n: "".join(rng.choice(symbols) for _ in range(n))
    for _ in range(rng.choice([0, 1, 5, 50, 400])):
        model.learn_word(draw(alphabet, rng.randint(1, rng.choice([1, 2, 4, 12]))), rng.choice([1, 1, 2, 50]))
    if seed % 3 == 0:
        model.learn_word(draw(alphabet, 300))
    lines = [draw(alphabet + " ?", rng.choice([0, 1, 3, 20, 80])) for _ in range(40)] + [None, " ", "  a "]
    rng.shuffle(lines)
    for name, values in (("CHUNK", [1, 30, 200, 1 << 18]), ("DIRECT", [1, 100, 1 << 20]), ("FEW", [0, 3, 12, 1 << 30])):
        monkeypatch.setattr(frozen, name, rng.choice(values))
    words, at = FrozenSearch.of(model).segment(pa.array(lines, pa.string()).slice(seed % 3))
    assert dict(zip((at + seed % 3).tolist(), words.to_pylist())) == {i: w for i, w in one_by_one(model, lines).items() if i >= seed % 3}


def test_batches_without_texts():
    model = FrozenSearch.of(Segmenter(SegmenterConfig(exact=False), "ab"))
    for lines in ([], [None], ["", " "]):
        words, at = model.segment(pa.array(lines, pa.string()))
        assert len(words) == len(at) == 0


@pytest.mark.parametrize("options", [dict(exact=True), dict(exact=False, phoneme_window=2), dict(exact=False, mbdp=True), dict(exact=False, max_word_len=3)], ids=str)
def test_other_searches_are_left_alone(options):
    assert FrozenSearch.of(Segmenter(SegmenterConfig(**options), "ab")) is None


def test_time_does_not_grow_with_the_sizes_of_words_that_end_alike(spark):
    """Words of a thousand sizes end with the same symbols; only those that stand in the text may cost time."""
    rng = random.Random(1)
    took = {}
    lines = [("xyabcd" * 400, i) for i in range(100)]
    corpus = spark.createDataFrame(lines, "text string, utt_id long").coalesce(1).persist()
    for sizes in (1, 1000):
        model = Segmenter(SegmenterConfig(exact=False), "abcdxyz")
        for n in range(sizes):
            model.learn_word("z" + "".join(rng.choice("abcdxy") for _ in range(n)) + "abcd")
        found = search.segment_with(corpus, model)
        assert found.filter("array_join(words, '') = repeat('xyabcd', 400)").count() == 100
        began = time.time()
        found.selectExpr("sum(size(words))").collect()
        took[sizes] = time.time() - began
    corpus.unpersist()
    assert took[1000] < 4 * took[1] + 3


def test_tables_and_memory_give_the_same_model(spark):
    lines = ["yu want tu", "yu wan ttu", "want it $", "tu it want", "", "é漢 tu"]
    corpus = spark.createDataFrame(list(enumerate(lines)), "utt_id long, text string")
    for options in (dict(exact=False), dict(exact=False, type_denominator=True), dict(exact=False, phoneme_window=2), dict()):
        kept = cues.train(corpus, SegmenterConfig(**options), keep=True)
        plain = cues.train(corpus, SegmenterConfig(**options))
        assert (kept.n_words, kept.n_types, kept.n_symbols, kept.totals, kept.initial) == (plain.n_words, plain.n_types, plain.n_symbols, plain.totals, plain.initial)
        batch, single = search.load_batch(kept), search.load(plain)
        kept.lexicon.unpersist()
        assert isinstance(batch, FrozenSearch) == (options.get("phoneme_window", 1) == 1 and not options.get("exact", True))
        got = {r["utt_id"]: r["words"] for r in search.segment_with(corpus, batch).collect()}
        assert got == one_by_one(single, lines)
    with pytest.raises(ValueError):
        search.segment_with(corpus, search.load_batch(cues.train(corpus, SegmenterConfig(exact=False))), n_best=2)


def test_a_lexicon_beyond_the_rows_of_load_is_searched(spark):
    corpus = spark.createDataFrame([(1, "yu want tu")], "utt_id long, text string")
    tables = cues.train(corpus, SegmenterConfig(exact=False))
    with pytest.raises(ValueError):
        search.load(tables, max_rows=2)
    assert search.segment_with(corpus, search.load_batch(tables)).first()["words"] == ["yu", "want", "tu"]
