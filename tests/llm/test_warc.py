import pytest
from pyspark.sql import functions as F

from seglark.llm import warc

PAGES = [(i, f"http://x.example/{i}", f"<p>{i} é</p>" * (i % 40)) for i in range(300)] + [(None, None, None), (5, "again\r\nx", ""), (5, "again\r\nx", "")]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("shard", F.lit(1)).repartition(3)


def test_record():
    raw = warc.record(4, "http://x", "<p>é</p>")
    assert warc.parse(raw) == (4, "http://x", "<p>é</p>")
    spoilt = bytearray(raw)
    spoilt[len(raw) // 2] ^= 1
    with pytest.raises(ValueError):
        warc.parse(bytes(spoilt))


def test_audit_finds_what_was_spoilt(spark, pages, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    index = warc.write(pages, a)
    assert index.count() == len(PAGES)
    warc.replicate(spark, a, b, F.col("page_id").isin(3, 77, 299))
    ours, theirs = (warc.tree(warc.digests(spark, x), 4) for x in (a, b))
    assert len(ours) > 3
    got = warc.audit(ours, theirs, 4).join(index, ["shard", "record"]).collect()
    assert sorted(r["page_id"] for r in got) == [3, 77, 299] and {r["kind"] for r in got} == {"changed"}
    assert warc.audit(ours, warc.tree(warc.digests(spark, a), 4), 4).count() == 0
    back = warc.read(spark, b)
    assert sorted(r["page_id"] for r in back.filter("damaged").collect()) == [3, 77, 299]
    texts = {(r["page_id"], r["html"]) for r in warc.read(spark, a).collect()}
    assert texts == {(i, h or "") for i, _, h in PAGES}


def test_missing_and_extra(spark, pages, tmp_path):
    a = f"file://{tmp_path}/a"
    warc.write(pages, a)
    leaves = warc.digests(spark, a)
    cut = leaves.filter("record < 40")
    got = warc.audit(warc.tree(leaves), warc.tree(cut)).groupBy("kind").count().collect()
    assert [(r["kind"], r["count"]) for r in got] == [("missing", leaves.filter("record >= 40").count())]
    got = warc.audit(warc.tree(cut), warc.tree(leaves)).select("kind").distinct().collect()
    assert [r["kind"] for r in got] == ["extra"]


def test_lost_and_short_files(spark, pages, tmp_path):
    a, b = f"file://{tmp_path}/a", f"file://{tmp_path}/b"
    index = warc.write(pages, a)
    warc.replicate(spark, a, b)
    records = index.orderBy("shard", "record").collect()
    gone, short = sorted({r["shard"] for r in records})[:2]
    (tmp_path / "b" / gone).unlink()
    own = [r for r in records if r["shard"] == short]
    with open(tmp_path / "b" / short, "r+b") as f:
        f.truncate(own[-3]["offset"] + 10)
    expected = {(r["shard"], r["record"], "missing") for r in records if r["shard"] == gone} | {(short, own[-3]["record"], "changed")} | {(short, r["record"], "missing") for r in own[-2:]}
    got = warc.audit(warc.tree(warc.digests(spark, a), 4), warc.tree(warc.digests(spark, b), 4), 4).collect()
    assert {(r["shard"], r["record"], r["kind"]) for r in got} == expected and len(got) == len(expected)
    assert warc.read(spark, b).filter("damaged").count() == len(expected)


def test_a_node_covers_its_ranges(spark):
    rows = [("s", i, i * 10, 10, None, b"same") for i in range(9)]
    moved = [("s", i, i * 10 + (i > 4), 10, None, b"same") for i in range(9)]
    roots = [warc.tree(spark.createDataFrame(x, f"{warc.INDEX}, digest binary"), 3)[-1].collect() for x in (rows, rows, moved)]
    assert roots[0] == roots[1] and roots[0][0]["digest"] != roots[2][0]["digest"]
    assert (roots[2][0]["first_offset"], roots[2][0]["end_offset"]) == (0, 91)


def test_empty(spark, pages, tmp_path):
    a = f"file://{tmp_path}/a"
    warc.write(pages.limit(0), a)
    levels = warc.tree(warc.digests(spark, a))
    assert warc.audit(levels, levels).count() == 0 and warc.read(spark, a).count() == 0
