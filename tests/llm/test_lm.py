import collections
import math

import numpy as np
import pytest

from seglark.llm import lm


def by_hand(rows, mu, order):
    """Base score and model score of (doc_id, text) rows, from plain counts."""
    tokens = [[*(t or "").encode().lower().split(), "END"] for _, t in rows]  # words are bytes, marks are strings
    train = [ws for (i, _), ws in zip(rows, tokens) if not lm.held_out(i)]
    counts = [collections.Counter() for _ in range(order + 1)]
    for ws in train:
        for k in range(1, order + 1):
            padded = ["START", *ws] if k > 1 else ws
            counts[k].update(tuple(padded[i : i + k]) for i in range(len(padded) - k + 1))
    n, v = sum(counts[1].values()), len(counts[1])
    out = []
    for ws in tokens:
        base = sum(math.log10((counts[1][w,] + 1) / (n + v + 1)) for w in ws)
        total, padded = 0.0, ["START", *ws]
        for i in range(1, len(padded)):
            p = (counts[1][padded[i],] + 1) / (n + v + 1)
            for k in range(2, order + 1):
                if i - k + 1 < 0:
                    break
                context = tuple(padded[i - k + 1 : i])
                seen = len(train) if context == ("START",) else counts[k - 1][context]
                if seen:
                    m = mu if isinstance(mu, float) else mu[min(k - 2, len(mu) - 1)]
                    p = (counts[k][(*context, padded[i])] + m * p) / (seen + m)
            total += math.log10(p)
        out.append((base, total, len(ws), sum(counts[1][w,] > 0 for w in ws), n))
    return out


@pytest.mark.parametrize("order,lane", [(1, 256), (2, 256), (2, 1), (3, 5), (4, 2), (4, 256)])
def test_scores(spark, edges, order, lane, monkeypatch):
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 40)
    monkeypatch.setattr(lm, "LANE", lane)
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()] + [(95, "\0end end \0start START END x"), (96, "\0end")] + [(i, f"a b c {'d ' * (i % 5)}a b {i % 3}") for i in range(100, 160)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, round(r["base_score"], 6), round(r["score"], 6), r["n_tokens"], r["n_known"], r["train_tokens"], r["held_out"]) for r in lm.score(df, order=order, mu=(3.0, 0.5)).collect()))
    expected = sorted((i is not None, i or 0, round(b, 6), round(s, 6), k, known, n, lm.held_out(i)) for (i, _), (b, s, k, known, n) in zip(rows, by_hand(rows, (3.0, 0.5), order)))
    assert len(got) == len(expected)
    for x, y in zip(got, expected):
        assert x[:2] == y[:2] and x[2:4] == pytest.approx(y[2:4], abs=1e-4) and x[4:] == y[4:]


def test_probabilities_sum_to_one(spark):
    """After "a": the words of the training texts, the end, and one share for all unseen words."""
    rows = [(i, t) for i, t in enumerate(["a b", "a c", "b a a", "c"] * 5)]
    held = [i for i in range(1000, 3000) if lm.held_out(i)]
    words = ["a", "b", "c", "unseen"]
    probes = {held[k]: f"a {w}" for k, w in enumerate(words)} | {held[30]: "a"}
    docs = spark.createDataFrame([*rows, *probes.items()], "doc_id long, text string")
    score = {r["doc_id"]: r["score"] for r in lm.score(docs, order=2, mu=7.0).collect()}
    alone = spark.createDataFrame([*rows, *((held[50 + k], w) for k, w in enumerate(words))], "doc_id long, text string")
    single = {r["doc_id"]: r["score"] for r in lm.score(alone, order=2, mu=7.0).collect()}
    counts = by_hand([*rows, (held[60], "")], 7.0, 2)
    n = counts[-1][4]
    v = 4  # a, b, c and the end
    count = {"a": 0, "b": 0, "c": 0, "unseen": 0}
    starts, train = {}, [t.split() for i, t in rows if not lm.held_out(i)]
    for ws in train:
        starts[ws[0]] = starts.get(ws[0], 0) + 1
        for w in ws:
            count[w] += 1
    first = lambda w: (starts.get(w, 0) + 7.0 * (count[w] + 1) / (n + v + 1)) / (len(train) + 7.0)
    total = 10 ** score[held[30]] / first("a")  # p(end | a)
    for k, w in enumerate(words):
        end = 10 ** single[held[50 + k]] / first(w)  # p(end | w)
        total += 10 ** score[held[k]] / first("a") / end
    assert total == pytest.approx(1)


def test_better_than_base_on_held_out(spark):
    rows = [(i, " ".join(f"w{(i + 3 * k) % 7} v{(i + 3 * k) % 7}" for k in range(30))) for i in range(300)]
    got = [r for r in lm.score(spark.createDataFrame(rows, "doc_id long, text string")).collect() if r["held_out"]]
    assert got and sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_states_arcs_and_failure_arcs():
    """The automaton of one small chunk, arc by arc."""
    words = [[b"a", b"b", b"c"], [b"a", b"b", b"d"], [b"b", b"c"]]
    vocabulary = sorted({w for ws in words for w in ws} | {lm.END}, key=lambda w: lm.hashes([w])[0])
    flat = [vocabulary.index(w) for ws in words for w in [*ws, lm.END]]
    c = lm.Chunk(lm.Chunk.stored([1, 2, 3], np.zeros(3, bool), np.array([4, 4, 3]), np.array(flat), vocabulary))
    unigram = np.bincount(c.tokens, minlength=len(vocabulary))
    ngrams = [(n[2], n[1]) for n in (np.unique(k, return_inverse=True, return_counts=True) for k in c.keys(3))]
    a = lm.Automaton(c, unigram, ngrams, 11, 5, (2.0,))
    # states: root, start, a, b, c, d and the pairs (start a), (a b), (b c), (b d), (start b)
    assert len(a.fail) == 11
    name = {0: (), a.start: ("start",)}
    name |= {int(s): (vocabulary[w],) for w, s in enumerate(a.first_to) if s}
    arcs = {}
    for _ in range(3):
        for code, to in zip(a.codes.tolist(), a.to.tolist()):
            if code >> 32 in name:
                arcs[name[code >> 32], vocabulary[code & 0xFFFFFFFF]] = to
                if to:
                    name[to] = (*name[code >> 32], vocabulary[code & 0xFFFFFFFF])[-2:]
    assert len(name) == 11 and len(arcs) == len(a.codes)
    assert name[arcs[("start",), b"a"]] == ("start", b"a")
    assert name[arcs[("start", b"a"), b"b"]] == (b"a", b"b") and name[arcs[(b"a", b"b"), b"d"]] == (b"b", b"d") and arcs[(b"b", b"c"), lm.END] == 0
    for s, context in name.items():
        if s:
            assert name[int(a.fail[s])] == context[1:]
    p = dict(zip(vocabulary, (unigram + 1) / 17))
    weight = {(name[c >> 32], vocabulary[c & 0xFFFFFFFF]): w for c, w in zip(a.codes.tolist(), a.arc.tolist())}
    p2 = (2 + 2 * p[b"b"]) / (2 + 2)
    assert 10 ** weight[(b"a",), b"b"] == pytest.approx(p2) and 10 ** weight[("start", b"a"), b"b"] == pytest.approx((2 + 2 * p2) / 4)


def test_groups_do_not_grow_with_the_corpus(spark, monkeypatch):
    """Twice the chunks: twice the hash ranges, and no range with more keys."""
    monkeypatch.setattr(lm, "CHUNK_TOKENS", 500)
    sizes = []
    for n in (40, 160):
        rows = [(i, " ".join(f"w{(i * 37 + k * k) % 5003}" for k in range(250))) for i in range(n)]
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
        out = lm.scratch(spark, "lm-test")
        table = lm.chunks(docs, out)
        parts = table.count()
        counted = lm.ngram_counts(table, out, parts, 3)
        of = {}
        for r in counted.collect():
            of[r["n"], r["part"]] = of.get((r["n"], r["part"]), 0) + len(lm.unpack(r["totals"]))
        sizes.append((parts, max(of.values())))
    assert sizes[1][0] >= 3 * sizes[0][0] and sizes[1][1] < 1.5 * sizes[0][1]


def test_empty(spark, empty):
    assert lm.score(empty).collect() == []


def test_packing():
    rng = np.random.default_rng(1)
    for size in (0, 1, 2, 1000):
        keys = np.sort(rng.integers(0, 1 << 63, size, dtype=np.uint64) * np.uint64(2))
        assert (lm.unpack_keys(lm.pack_keys(keys)) == keys).all()
    small = np.arange(5000, dtype=np.uint64) * np.uint64(77) + np.uint64(1 << 60)
    assert (lm.unpack_keys(lm.pack_keys(small)) == small).all()
    for top in (3, 300, 70_000, 1 << 40):
        values = rng.integers(0, top, 50)
        assert (lm.unpack(lm.pack(values)) == values).all()
