import math

import pytest
from pyspark.sql import functions as F

from seglark.operators import freq, ngram_model, prob


def dist(spark, **counts):
    return spark.createDataFrame(list(counts.items()), "sample string, cnt long")


def probs(df):
    return {r["sample"]: r["prob"] for r in df.collect()}


def test_order_mode_and_sums(spark):
    d = dist(spark, a=2, b=2, c=1)
    assert [r["sample"] for r in freq.ordered(d).collect()] == ["a", "b", "c"]
    assert freq.mode(d).first()["sample"] == "b"
    assert {r["sample"]: r["cum"] for r in freq.cumulative(d).collect()} == {"a": 2, "b": 4, "c": 5}
    assert {r["r"]: r["nr"] for r in freq.count_of_counts(d, 10).collect()} == {0: 7, 1: 1, 2: 2}
    assert freq.compare(dist(spark, a=1), d).first().asDict() == {"equal": False, "contained": True, "contains": False}
    assert {r["sample"]: r["cnt"] for r in freq.lookup(d, spark.createDataFrame([("a",), ("z",)], "sample string")).collect()} == {"a": 2, "z": 0}
    assert freq.without(d, spark.createDataFrame([("a",)], "sample string")).count() == 2


def test_lidstone_and_witten_bell(spark):
    d = dist(spark, a=3, b=1)
    rows = prob.lidstone(d, 0.5, 3).collect()
    assert {r["sample"]: r["prob"] for r in rows} == {"a": 3.5 / 5.5, "b": 1.5 / 5.5}
    assert rows[0]["unseen"] == 0.5 / 5.5 and rows[0]["discount"] == pytest.approx(1.5 / 5.5)
    rows = prob.witten_bell(d, 3).collect()
    assert {r["sample"]: r["prob"] for r in rows} == {"a": 3 / 6, "b": 1 / 6}
    assert rows[0]["unseen"] == pytest.approx(1 / 3)


@pytest.mark.parametrize("estimator", [prob.lidstone, prob.witten_bell, prob.simple_good_turing, prob.mle])
def test_sums_to_one(spark, estimator):
    d = spark.range(1, 200).select(F.col("id").cast("string").alias("sample"), (F.lit(200) / F.col("id")).cast("long").alias("cnt"))
    options = {"bins": 300} if estimator is not prob.mle else {}
    if estimator is prob.lidstone:
        options["gamma"] = 0.3
    rows = estimator(d, **options).collect()
    total = sum(r["prob"] for r in rows) + (300 - len(rows)) * rows[0]["unseen"]
    assert total == pytest.approx(1)


def test_too_few_bins(spark):
    with pytest.raises(Exception, match="bins"):
        prob.laplace(dist(spark, a=1, b=1), 1).collect()


def test_uniform_dictionary_override(spark):
    d = dist(spark, a=1, b=1)
    assert probs(prob.uniform(d)) == {"a": 0.5, "b": 0.5}
    given = spark.createDataFrame([("a", 1.0), ("b", 3.0)], "sample string, prob double")
    assert probs(prob.dictionary(given, normalise=True)) == {"a": 0.25, "b": 0.75}
    logs = spark.createDataFrame([("a", -1.0), ("b", -1.0)], "sample string, prob double")
    assert probs(prob.dictionary(logs, log=True, normalise=True)) == pytest.approx({"a": 0.5, "b": 0.5})
    zero = spark.createDataFrame([("a", 0.0), ("b", 0.0)], "sample string, prob double")
    assert probs(prob.dictionary(zero, normalise=True)) == {"a": 0.5, "b": 0.5}
    assert probs(prob.override(given, spark.createDataFrame([("a", 9.0)], "sample string, prob double"))) == {"a": 9.0, "b": 3.0}


def test_logs_and_entropy(spark):
    row = spark.createDataFrame([(-1.0, -1.0)], "a double, b double").select(prob.add_logs(F.col("a"), F.col("b")).alias("x"), prob.log_prob(F.lit(0.0)).alias("z")).first()
    assert row["x"] == 0.0 and row["z"] == prob.NO_PROB
    assert prob.entropy(prob.uniform(dist(spark, a=1, b=1, c=1, d=1))).first()["entropy"] == 2.0


def test_generate_follows_distribution(spark):
    table = prob.mle(dist(spark, a=3, b=1))
    drawn = [r["sample"] for r in prob.generate(table, 2000, seed=3).collect()]
    assert len(drawn) == 2000 and 0.7 < drawn.count("a") / 2000 < 0.8


def test_conditional_lookup(spark):
    d = spark.createDataFrame([("x", "a", 3), ("x", "b", 1)], "cond string, sample string, cnt long")
    table = prob.conditional(d, prob.lidstone, gamma=0.5, bins=3)
    asked = spark.createDataFrame([("x", "a"), ("x", "c"), ("y", "a")], "cond string, sample string")
    got = {(r["cond"], r["sample"]): r["prob"] for r in prob.conditional_lookup(table, asked, 1 / 3).collect()}
    assert got == pytest.approx({("x", "a"): 3.5 / 5.5, ("x", "c"): 0.5 / 5.5, ("y", "a"): 1 / 3})


def test_backoff_model(spark):
    seqs = spark.createDataFrame([(["a", "b", "a"],), (["a", "b"],)], "tokens array<string>")
    model = ngram_model.train(seqs, 2, gamma=0.5)
    asked = spark.createDataFrame([(["a"], "b"), (["b"], "b"), (["z"], "a")], "context array<string>, token string")
    got = {(r["context"][0], r["token"]): r["prob"] for r in ngram_model.score(model, asked).collect()}
    # bins 3: two tokens and the pad; contexts: a -> b b "", b -> a "", unigrams a 3 b 2
    assert got["a", "b"] == pytest.approx(2.5 / 4.5)
    beta_b, beta_0 = 1.5 / 3.5, 1.5 / 6.5
    assert got["b", "b"] == pytest.approx(beta_b / beta_0 * 2.5 / 6.5)
    assert got["z", "a"] == pytest.approx(1 / beta_0 * 3.5 / 6.5)
    assert ngram_model.known(model, asked).count() == 1
    h = ngram_model.entropy(model, seqs).first()
    assert h["perplexity"] == pytest.approx(2 ** h["entropy"])
    assert ngram_model.generate(model, 5, seed=1) == ngram_model.generate(model, 5, seed=1)
    counts = ngram_model.gram_counts(seqs, 1)
    more = ngram_model.update(counts, seqs, 1, amount=0.5)
    assert {r["sample"]: r["cnt"] for r in more.collect()} == {"a": 4.5, "b": 3.0}
    assert math.isfinite(h["entropy"])
