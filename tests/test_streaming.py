import time

from seglark.plans.config import SegmenterConfig
from seglark.plans.learner import learn
from seglark.streaming.learner import running_counts, segment_stream

LINES = ["yu want tu", "yuwant", "want it", "tuit want"]


def drain(query):
    deadline = time.time() + 120
    while query.isActive and time.time() < deadline:
        query.awaitTermination(1)
    assert not query.isActive


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    for part, rows in enumerate((LINES[:2], LINES[2:])):
        spark.createDataFrame([("c", part * 2 + i, t) for i, t in enumerate(rows)], "corpus_id string, utt_id long, text string").coalesce(1).write.mode("append").json(str(source))
    stream = spark.readStream.schema("corpus_id string, utt_id long, text string").json(str(source))
    symbols = "".join(sorted(set("".join(LINES)) - {" "}))
    out = segment_stream(stream, SegmenterConfig(), symbols)
    query = out.writeStream.format("memory").queryName("segmented").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    drain(query)
    got = {r["utt_id"]: r["words"] for r in spark.table("segmented").collect()}
    assert got == {i: found[0][1] for i, found in enumerate(learn(LINES, SegmenterConfig()))}


def test_running_counts(spark, tmp_path):
    source = tmp_path / "in"
    spark.createDataFrame([("a b a",)], "text string").write.json(str(source))
    stream = spark.readStream.schema("text string").json(str(source))
    query = running_counts(stream).writeStream.format("memory").queryName("counted").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    drain(query)
    assert {r["sample"]: r["cnt"] for r in spark.table("counted").collect()} == {"a": 2, "b": 1}
