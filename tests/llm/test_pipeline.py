import glob
import os

import duckdb
import pytest

import corpus_pipeline
from seglark.llm import neardup, queries

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    from seglark.llm.common import cut

    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = cut(stage(spark, docs, SF), "test-stage")
        kept[name] = docs
        if name != "bpe":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    toxic = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    stay = {r["doc_id"] for r in kept["toxicity"].collect()}
    assert all(i in stay for i, t in toxic.items() if not t)
    one = neardup.near_duplicates(kept["toxicity"], 5, 80).filter("kept").select("doc_id")
    assert sorted(r[0] for r in one.collect()) == sorted(r["doc_id"] for r in kept["near_duplicates"].collect())
    ids = {n: sorted(r["doc_id"] for r in kept[n].collect()) for n in ("near_duplicates", "personal_data", "mixing", "bpe")}
    assert ids["near_duplicates"] == ids["personal_data"] == ids["mixing"] == ids["bpe"]
    assert len(ids["bpe"]) < len(before)
    assert kept["personal_data"].filter("n_chars <> length(text)").count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.columns[:2] == ["doc_id", "n_tokens"] and out.count() > 50


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df, other = queries.QUERIES[name](spark, SF), duck.sql(queries.ORACLES[name])
    order = sorted(df.columns)
    assert sorted(other.columns) == order
    names = list(other.columns)
    assert sorted(repr([r[c] for c in order]) for r in df.collect()) == sorted(repr([r[names.index(c)] for c in order]) for r in other.fetchall())


def test_registered(spark):
    import __spark_entry__ as entry

    assert set(entry.queries()) >= {*queries.QUERIES, "pipeline"}


def test_the_mixture_decides_the_result(spark, monkeypatch):
    """The last stage tells the order of the mixing stage, read again from files, and every prefix has its shares."""
    from seglark.llm import mixing
    from seglark.llm.common import cut

    monkeypatch.setattr(mixing.mix, "__defaults__", (None, 300, *mixing.mix.__defaults__[2:]))
    rows = [(i, "word " * 6, "en", "hot" if i % 3 else f"s{i % 4}", 30) for i in range(3000)]
    docs = cut(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"), "test-mix")
    mixed = corpus_pipeline.mix_sources(spark, docs, SF)
    source = {i: s for i, _, _, s, _ in rows}
    plan = mixing.plan(docs, block_chars=300).collect()
    expected = [source[r["doc_id"]] for r in sorted(plan, key=lambda r: (r["slot"], r["chars_before"]))]
    weights = {s: sum(x == s for x in source.values()) ** 0.5 for s in set(source.values())}
    for read in (mixed, cut(mixed, "test-mixed")):
        out = sorted(corpus_pipeline.encode(spark, read, SF).collect(), key=lambda r: r["position"])
        assert len({r["position"] for r in out}) == len(out) == 3000
        assert [source[r["doc_id"]] for r in out] == expected
        for n in range(100, 1000, 100):  # until a source has run out
            for s, w in weights.items():
                assert abs(sum(source[r["doc_id"]] == s for r in out[:n]) - n * w / sum(weights.values())) <= 20
    plain = sorted(corpus_pipeline.encode(spark, docs, SF).collect(), key=lambda r: r["position"])
    assert [r["doc_id"] for r in plain] != [r["doc_id"] for r in out]
