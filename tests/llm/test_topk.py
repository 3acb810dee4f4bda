import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from seglark.llm import topk


def by_hand(rows, k, every):
    usable = [(i, v) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    q = {id(v): [math.floor(1024 * float(np.float32(x))) for x in v] for _, v in usable}
    out = []
    for i, v in usable:
        if i % every:
            continue
        scored = sorted((-sum(a * b for a, b in zip(q[id(v)], q[id(w)])), j) for j, w in usable if j != i and len(w) == len(v))
        out += [(i, r, j, -s) for r, (s, j) in enumerate(scored[:k], 1)]
    return sorted(out)


def vectors(n=400, dim=6):
    rng = np.random.default_rng(4)
    rows = [(i, [float(np.float32(x)) for x in rng.normal(size=dim)]) for i in range(n)]
    rows += [(n + i, rows[3][1]) for i in range(30)]  # ties
    rows += [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * dim), (903, [float("inf")] * dim), (None, [0.5] * dim), (910, [1.0, 2.0]), (920, [3.0, 4.0]), (930, []), (940, [])]
    return rows


@pytest.mark.parametrize("block,fanout", [(7, 64), (3, 2), (1000, 64)])
def test_exact(spark, tmp_path, block, fanout, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "FANOUT", fanout)
    rows = vectors()
    # repeated rows, of a query and of another row, and an identifier with two vectors
    rows += [rows[10], rows[10], rows[11], (20, rows[12][1]), (None, rows[10][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("dim", F.lit(1)).repartition(3)
    got = topk.search(df, F.col("vec_id") % 10 == 0, f"file://{tmp_path}/t", k=5).collect()
    assert sorted(tuple(r) for r in got) == by_hand(rows, 5, 10)


def test_blocks_are_skipped():
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(12, 8)) * 5
    low, high, blocks = [], [], []
    for c in centres:
        m = topk.quantised((c + rng.normal(size=(50, 8)) * 0.01).tolist())
        blocks.append(m)
        low.append(m.min(0))
        high.append(m.max(0))
    ids = np.arange(600).reshape(12, 50)
    read = []

    class Files:
        pass

    original = topk.read_block
    topk.read_block = lambda fs, path: (read.append(path), (ids[int(path)], blocks[int(path)]))[1]
    try:
        found, scored = topk.answer([-1], [centres[0].tolist()], np.array(low), np.array(high), [str(i) for i in range(12)], Files, 10)
    finally:
        topk.read_block = original
    every = sorted((-int(s), int(i)) for i, s in zip(ids.ravel(), topk.products(topk.quantised([centres[0].tolist()]), np.concatenate(blocks))[0]))
    assert [(-int(s), int(i)) for i, s in zip(found[0].ids, found[0].scores)] == every[:10]
    assert scored < 12


def test_huge_values_and_empty(spark, tmp_path):
    assert topk.products(np.array([[1e30, 1.0]]), np.array([[1e30, 1.0]]))[0, 0] == (1 << 63) - 1
    assert topk.products(np.array([[2.0**40, 1.0]]), np.array([[2.0**22, 3.0]]))[0, 0] == 2**62 + 3
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert topk.search(df, F.col("vec_id") % 10 == 0, f"file://{tmp_path}/e").count() == 0
