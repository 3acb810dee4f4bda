import collections
import random
from fractions import Fraction

import pytest

from seglark.llm import mixing


@pytest.mark.parametrize("seed", range(8))
def test_less_than_one_block_off(seed):
    rng = random.Random(seed)
    quota = mixing.quotas({f"s{i}": rng.random() ** 3 + 0.001 for i in range(rng.randrange(1, 30))}, 300)
    period = sum(quota.values())
    had = collections.Counter()
    for slot, (s, j) in enumerate(mixing.schedule(quota), 1):
        assert had[s] == j
        had[s] += 1
        for name, q in quota.items():
            assert abs(had[name] - Fraction(q * slot, period)) < 1
    assert had == collections.Counter(quota)


def test_quotas():
    assert mixing.quotas({"a": 1, "b": 1}, 10) == {"a": 5, "b": 5} or sum(mixing.quotas({"a": 1, "b": 1}, 10).values()) == 20
    assert min(mixing.quotas({f"s{i}": 1 for i in range(500)}, 10).values()) >= 1
    with pytest.raises(ValueError):
        mixing.quotas({"a": 0.0})


def test_plan_by_hand(spark, edges, monkeypatch):
    monkeypatch.setattr(mixing, "GROUP_ROWS", 3)
    rows = [(i, "x" * (i % 9 * 10), "hot" if i % 3 else f"s{i % 4}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").unionByName(edges.select("doc_id", "text", "source"))
    got = mixing.plan(docs, block_chars=200).collect()
    assert len(got) == docs.count()
    by = collections.defaultdict(list)
    for r in got:
        by[r["source"]].append(r)
    sums = {s: sum(r["n_chars"] for r in v) for s, v in by.items()}
    weights = {mixing.NO_SOURCE if s is None else s: c**mixing.TEMPERATURE for s, c in sums.items()}
    total = sum(weights.values())
    quota = mixing.quotas({s: w / total for s, w in weights.items()})
    template = {x: t for t, x in enumerate(mixing.schedule(quota))}
    period = sum(quota.values())
    for s, own in by.items():
        name = mixing.NO_SOURCE if s is None else s
        at = 0
        for r in sorted(own, key=lambda r: r["chars_before"]):
            assert r["chars_before"] == at and r["block"] == at // 200
            assert r["slot"] == r["block"] // quota[name] * period + template[name, r["block"] % quota[name]]
            at += r["n_chars"]


def test_given_weights_and_order(spark, edges, empty):
    rows = [(i, "x" * 100, "ab"[i % 2]) for i in range(2000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = sorted(mixing.plan(docs, {"a": 0.75, "b": 0.25}, block_chars=1000).collect(), key=lambda r: (r["slot"], r["chars_before"]))
    first = collections.Counter(r["source"] for r in got[:800])
    assert abs(first["a"] - 600) <= 20
    mixed = mixing.mix(edges)
    assert mixed.columns == edges.columns and mixed.count() == edges.count()
    assert sorted(map(str, mixed.collect())) == sorted(map(str, edges.collect()))
    assert mixing.plan(empty).count() == 0 and mixing.mix(empty).count() == 0


def test_less_than_one_block_off_the_target_over_several_periods(spark):
    target = {"hot": 0.5, "rare": 0.0001} | {f"s{i}": 0.4999 / 18 for i in range(18)}
    n = 6000
    rows = [(i, "x", s) for i, s in enumerate(s for s, w in target.items() for _ in range(int(w * n) + 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["slot"]: r["source"] for r in mixing.plan(docs, target, block_chars=1).collect()}
    assert len(got) == len(rows)
    had = collections.Counter()
    for slot in range(n):
        had[got.get(slot)] += 1
        assert all(abs(had[s] - w * (slot + 1)) < 1.01 for s, w in target.items())


def test_quotas_round_the_weights():
    got = mixing.quotas({"hot": 0.5, **{f"s{i}": 0.5 / 19 for i in range(19)}})
    assert got["hot"] == 500 and sum(got.values()) == 1000
    assert mixing.quotas({"a": 0.0001, "b": 0.9999}) == {"a": 0, "b": 1000}
