import random
import re

import numpy as np
import pytest

from seglark.llm import components, neardup


def by_hand(rows, width, percent):
    sets = []
    for _, t in rows:
        words = [w.encode().lower() for w in re.findall(r"[^\x20\x09-\x0D]+", t or "")]
        sets.append({tuple(words[i : i + width]) for i in range(len(words) - width + 1)} if len(words) >= width else {tuple(words)} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= percent * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    out = []
    for k, (i, _) in enumerate(rows):
        c = least.get(find(k)) if sets[k] else i
        out.append((i, len(sets[k]), c, i == c))
    return sorted(out, key=str)


def cloud(n, seed=3):
    """Texts around one original, most of them not similar enough to each other."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(60)]
    out = []
    for _ in range(n):
        own = list(base)
        for _ in range(rng.randrange(8)):
            own[rng.randrange(60)] = f"n{rng.randrange(10**6)}"
        out.append(" ".join(own))
    return out


@pytest.mark.parametrize("width,percent", [(3, 85), (5, 80)])
@pytest.mark.parametrize("block", [3, 1024])
def test_components(spark, edges, width, percent, block):
    rng = random.Random(1)
    texts = cloud(40) + [" ".join(f"w{rng.randrange(500)}" for _ in range(40)) for _ in range(40)]
    texts += [texts[5]] * 30 + ["a b", "a b", "A B", "b a", "a"]
    rows = [(1000 + i, t) for i, t in enumerate(texts)] + [(r["doc_id"], r["text"]) for r in edges.collect()]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = neardup.near_duplicates(docs, width, percent, list_block=block, group_block=block).collect()
    assert sorted((tuple(r) for r in got), key=str) == by_hand(rows, width, percent)


def test_keep_one(spark, edges, empty):
    kept = neardup.keep_one(edges, 3, 80)
    assert kept.columns == edges.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(1) == 0 and ids.count(-11) == 1  # -11 is the least of its component
    assert {2, 3, 4, None} <= set(ids)
    assert neardup.keep_one(empty).count() == 0 and neardup.near_duplicates(empty).count() == 0
    twice = edges.filter("doc_id = 1")
    assert neardup.keep_one(twice, 3, 80).count() == 1


def test_thresholds():
    assert neardup.matches_for(85) == 16 and neardup.matches_for(80) == 14 and neardup.matches_for(100) == 32


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(1)
    a = np.unique(rng.integers(0, 1 << 63, 2000, dtype=np.uint64))
    b = np.unique(np.concatenate([a[:1700], rng.integers(0, 1 << 63, 300, dtype=np.uint64)]))
    sig = neardup.signatures([a, b], 256)
    assert abs((sig[0] == sig[1]).mean() - 1700 / 2300) < 0.1


def test_connected_components(spark):
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000 + rng.randrange(50), 1000 + rng.randrange(50)) for _ in range(60)] + [(5000, 5000)]
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(201)) and 5000 not in got
    near = {}
    for a, b in edges:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set()).add(a)
    for start in {a for e in edges for a in e if e[0] != e[1]}:
        seen, todo = {start}, [start]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert got[start] == min(seen)


def test_collisions_by_merging():
    rng = np.random.default_rng(4)
    for n, values, coordinates, matches in ((3, 2, 4, 2), (40, 3, 8, 5), (40, 50, 8, 1), (60, 2, 16, 16), (5, 1, 4, 4)):
        sig = rng.integers(0, values, (n, coordinates)).astype(np.int32)
        lists = neardup.Postings(sig, matches)
        for i in range(n):
            left = rng.permutation(n)[: n // 2 + 1]
            assert (lists.agrees(i, left) == ((sig[left] == sig[i]).sum(1) >= matches)).all()


def test_a_common_value_is_refined(spark):
    """Lists of classes that share one value, two clusters that share another: links as by hand, no list searched above its size."""
    rng = np.random.default_rng(6)
    sig = rng.integers(10, 1 << 30, (120, 6)).astype(np.int32)
    sig[:, 0] = 1
    sig[:40, 1:5] = [2, 3, 4, 5]
    sig[40:80, 2:] = [6, 7, 8, 9]
    sig[20:60, 1] = 2
    for i in range(80):
        sig[i, rng.integers(1, 6)] = 1000 + i
    reps = spark.createDataFrame([(i, [int(x) for x in row]) for i, row in enumerate(sig)], "node long, sig array<int>")
    searched = []
    original = neardup.search_lists

    def watched(rows, coordinates, matches):
        searched.append(rows.groupBy("list", "cell").count().agg({"count": "max"}).first()[0] or 0)
        return original(rows, coordinates, matches)

    neardup.search_lists = watched
    try:
        links = neardup.candidate_links(reps, 6, 3, list_block=10).collect()
    finally:
        neardup.search_lists = original
    assert len(searched) > 1 and max(searched) <= 30
    root = list(range(120))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    expected = [(i, j) for i in range(120) for j in range(i) if (sig[i] == sig[j]).sum() >= 3]
    assert all((sig[a] == sig[b]).sum() >= 3 for a, b in links)
    for a, b in links:
        root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(find(i) == find(j) for i, j in expected)
