import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seglark.llm import shards

PATH = public_tokenizers.path("byte_bpe_50k.json")


def test_file_round_trip_and_lookup(monkeypatch):
    monkeypatch.setattr(shards, "BLOCK_BYTES", 2000)
    stream = io.BytesIO()
    writer = shards.ShardWriter(stream, 2)
    ids = [None, -5, 0, 3, 3, *range(10, 40_000, 7)]
    for i in ids:
        writer.add(shards.key_bytes(i), np.arange((i or 0) % 5, dtype=np.uint32))
    with pytest.raises(ValueError):
        writer.add(shards.key_bytes(1), np.zeros(1, np.uint32))
    writer.close()
    reader = shards.ShardReader(stream)
    assert [shards.key_value(k) for k, _ in reader] == ids and len(reader.blocks) > 1
    for i in (None, -5, 3, 10, 39_995):
        assert [x.tolist() for x in reader.get(i)] == [list(range((i or 0) % 5))] * ids.count(i)
    assert reader.get(11) == []
    assert sum(reader.may_have(shards.key_bytes(i)) for i in range(11, 39_000, 7)) < 0.05 * 5570


def test_bad_files():
    with pytest.raises(ValueError, match="short"):
        shards.ShardReader(io.BytesIO(b"x"))
    with pytest.raises(ValueError, match="magic"):
        shards.ShardReader(io.BytesIO(b"\0" * 200))


def test_operator(spark, edges, empty, tmp_path):
    out = f"file://{tmp_path}/s"
    shards.write(edges, out, PATH, end_id=2, partitions=3)
    library = Tokenizer.from_file(PATH)
    rows = sorted(((r["doc_id"] is not None, r["doc_id"] or 0, r["text"] or "") for r in edges.collect()))
    start, expected = 0, []
    for known, i, text in rows:
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        expected.append((i if known else None, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    got = sorted((tuple(r) for r in shards.scan(spark, out, "crc32").collect()), key=lambda r: r[1])
    assert got == expected
    found = shards.lookup(spark, out, [1, 9, None, 12345])
    assert len(found[1]) == 2 and len(found[None]) == 1 and found[12345] == []
    assert found[9][0].tolist() == [*library.encode(dict((r["doc_id"], r["text"]) for r in edges.collect())[9], add_special_tokens=False).ids, 2]
    assert shards.scan(spark, out).filter("size(ids) <> n_tokens").count() == 0
    shards.write(empty, f"{out}2", PATH)
    assert shards.scan(spark, f"{out}2").count() == 0
