import numpy as np
import pytest

from seglark.llm import toxicity


def corpus(spark, n=600):
    rng = np.random.default_rng(2)
    rows, labels = [], []
    for i in range(n):
        words = [f"w{rng.integers(400)}" for _ in range(60)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(1 + i % 7):
                words[rng.integers(60)] = ["vileword", "nastything", "horridname"][rng.integers(3)] + ("" if i % 2 else f"x{rng.integers(99)}")
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_accuracy(spark):
    docs, labels = corpus(spark)
    model = toxicity.train(docs, labels.filter("doc_id % 3 > 0"))
    got = toxicity.score(docs, model).join(labels, "doc_id").filter("doc_id % 3 = 0").collect()
    right = sum(r["rejected"] == bool(r["toxic"]) for r in got)
    assert right / len(got) > 0.97
    assert not any(r["rejected"] for r in got if not r["toxic"])
    assert model.thetas[0] < model.thetas[1]
    for r in got:
        assert r["severity"] == pytest.approx(r["p_toxic"] + r["p_severe"]) and r["p_severe"] <= r["p_toxic"]
    kept = toxicity.keep_clean(docs, model)
    assert kept.columns == docs.columns and kept.count() == toxicity.score(docs, model).filter("not rejected").count()


def dense(x):
    return toxicity.Sparse.of([(list(range(x.shape[1])), list(row)) for row in x], x.shape[1])


def test_gradient():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(400, 2))
    y = np.clip(np.digitize(x[:, 0] * 2 + rng.logistic(size=400) * 0.2, [-1, 1]), 0, 2)
    w, thetas = toxicity.fit_ordinal(dense(x), y, 3, steps=800)
    assert w[0] > 5 * abs(w[1]) and thetas[0] < 0 < thetas[1]
    twice = toxicity.fit_ordinal(dense(x), y, 3, steps=50, times=np.full(400, 2.0))
    assert np.allclose(twice[0], toxicity.fit_ordinal(dense(x), y, 3, steps=50)[0])


def test_fit_against_brute_force():
    """No point of a grid over weights and thresholds has a higher penalised likelihood, and the best of them is near."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(60, 2))
    y = np.clip(np.digitize(x @ [1.0, -0.5] + rng.logistic(size=60), [-0.5, 1]), 0, 2)

    def value(a, b, low, high):
        total = 0.0
        for (u, v), grade in zip(x, y):
            above = [1.0, *(1 / (1 + np.exp(t - a * u - b * v)) for t in (low, high)), 0.0]
            total += np.log(above[grade] - above[grade + 1])
        return total / 60 - 0.05 / 2 * (a * a + b * b)

    w, thetas = toxicity.fit_ordinal(dense(x), y, 3, l2=0.05, steps=3000, rate=0.02)
    best = value(*w, *thetas)
    assert best == pytest.approx(toxicity.log_likelihood(dense(x), y, w, thetas, np.ones(60)) / 60 - 0.025 * w @ w)
    grid = [(a, b, low, high) for a in np.linspace(-2, 2, 9) for b in np.linspace(-2, 2, 9) for low in np.linspace(-2, 2, 9) for high in np.linspace(-2, 2, 9) if low < high]
    near = max(grid, key=lambda g: value(*g))
    assert best >= value(*near) and np.abs(np.array(near) - [*w, *thetas]).max() <= 0.5
    for k in range(4):
        for by in (-0.02, 0.02):
            other = [*w, *thetas]
            other[k] += by
            assert value(*other) < best


def test_scores_by_hand(spark, edges):
    model = toxicity.OrdinalModel([b"dog", b"text", b"^quick"[:6]], np.array([1.0, -0.5, 0.3, 0.2, 0.7, 0.1]), np.array([0.5, 1.5]))
    rows = [(r["doc_id"], r["text"]) for r in edges.collect()]
    expected = []
    for i, text in rows:
        words = "".join(c if ord(c) > 127 or c.isalnum() else " " for c in (text or "")).encode().lower().split()
        counts = [words.count(b"dog"), words.count(b"text"), sum(len(w) > 5 and w[:5] == b"quick" for w in words)]
        margin = sum(model.weights[k] + model.weights[k + 3] * np.log1p(100 * n / len(words)) for k, n in enumerate(counts) if n)
        p = [1 / (1 + np.exp(t - margin)) for t in model.thetas]
        expected.append((str(i), round(sum(p), 9), int(sum(x >= 0.5 for x in p))))
    got = [(str(r["doc_id"]), round(r["severity"], 9), r["grade"]) for r in toxicity.score(edges, model).collect()]
    assert sorted(got) == sorted(expected)


def test_repeated_rows_train_once(spark):
    docs, labels = corpus(spark, 200)
    model = toxicity.train(docs, labels)
    again = toxicity.train(docs.unionByName(docs).unionByName(docs.filter("doc_id = 5")), labels.unionByName(labels))
    assert model.terms == again.terms and np.allclose(model.weights, again.weights) and np.allclose(model.thetas, again.thetas)


def test_no_limit_of_terms(spark):
    rows = [(i, " ".join(f"bad{k}" for k in range(i % 2 * 400)) + " plain words") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, docs.selectExpr("doc_id", "int(doc_id % 2) toxic"))
    assert {f"bad{k}".encode() for k in range(400)} <= set(model.terms)


def test_bounds_and_edges(spark, edges, empty):
    docs, labels = corpus(spark, 200)
    model = toxicity.train(docs, labels.unionByName(spark.createDataFrame([(None, 1), (3, None)], labels.schema)), max_train=100)
    assert toxicity.score(edges, model).count() == edges.count()
    assert toxicity.score(empty, model).count() == 0
    assert toxicity.keep_clean(edges, model).columns == edges.columns
    nothing = toxicity.train(docs, labels.limit(0))
    assert not any(r["rejected"] for r in toxicity.score(edges, nothing).collect())
    assert toxicity.keep_clean(edges, nothing).count() == edges.count()
