"""WARC files and Merkle fixity audits.

Pages are written as WARC response records, one gzip member each, with an
index of (shard, record, offset, length).  For an audit every stored record is
hashed where it lies; offset ranges and digests of consecutive records are
hashed together into a tree.  Records that a replica's files no longer hold
have no leaf there, and so are found missing.  Two replicas are compared from the root of
each shard down, and only children of nodes that differ are looked at, until
the records that differ are found.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut
from .shards import filesystem

FANOUT, SHARD_BYTES = 16, 64 << 20
INDEX = "shard string, record long, offset long, length long, page_id long"


def record(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A WARC/1.1 response record, as one gzip member with fixed time stamps."""
    body = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n" + (html or "").encode()
    name = hashlib.sha256(f"{page_id}\n{url}".encode()).hexdigest()
    lines = [
        "WARC/1.1",
        "WARC-Type: response",
        f"WARC-Record-ID: <urn:uuid:{name[:8]}-{name[8:12]}-{name[12:16]}-{name[16:20]}-{name[20:32]}>",
        "WARC-Date: 2000-01-01T00:00:00Z",
        f"WARC-Target-URI: {(url or '').replace(chr(13), ' ').replace(chr(10), ' ')}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(body).hexdigest()}",
        f"X-Page-Id: {'' if page_id is None else page_id}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    raw = "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", compresslevel=1, mtime=0) as z:
        z.write(raw)
    return out.getvalue()


def parse(stored: bytes) -> tuple[int | None, str, str]:
    """(page_id, url, html) of one stored record; raises ``ValueError`` where it is damaged."""
    if not stored:
        raise ValueError("lost record")
    try:
        raw = gzip.decompress(stored)
    except (OSError, EOFError, zlib.error) as e:
        raise ValueError(f"damaged record: {e}") from None
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)
    body = rest[: int(fields["Content-Length"])]
    if hashlib.sha256(body).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:"):
        raise ValueError("damaged record: block digest")
    page = fields.get("X-Page-Id", "")
    return int(page) if page else None, fields.get("WARC-Target-URI", ""), body.partition(b"\r\n\r\n")[2].decode()


def write(pages: DataFrame, out: str) -> DataFrame:
    """Write pages where they are read, without a shuffle; returns the index, also kept in ``out/index``.

    Null urls and texts are written empty, a null ``page_id`` stays null,
    repeated rows are written each; columns other than ``page_id, url, html``
    are not read; an empty table writes no file.
    """
    spark = pages.sparkSession
    own = pages.select(pages["page_id"].cast("long").alias("page_id"), pages["url"].alias("url"), pages["html"].alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get()
        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)
        shard, stream, offset, rows = 0, None, 0, []

        def finish():
            stream.close()
            fs.move(f"{root}/.{name}.{task.taskAttemptId()}", f"{root}/{name}")

        for batch in batches:
            for page in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                if stream is None:
                    name, offset, number = f"pages-{task.partitionId():05d}-{shard:05d}.warc.gz", 0, 0
                    stream = fs.open_output_stream(f"{root}/.{name}.{task.taskAttemptId()}", compression=None)
                stored = record(*page)
                stream.write(stored)
                rows.append((name, number, offset, len(stored), page[0]))
                number += 1
                offset += len(stored)
                if offset >= SHARD_BYTES:
                    finish()
                    stream, shard = None, shard + 1
            yield _rows(rows)
            rows = []
        if stream is not None:
            finish()

    own.mapInArrow(run, INDEX).write.parquet(f"{out}/index")
    return spark.read.schema(INDEX).parquet(f"{out}/index")


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), *[pa.int64()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=[c.split(" ")[0] for c in INDEX.split(", ")])


def replicate(spark: SparkSession, source: str, target: str, damage: Column | None = None) -> None:
    """Copy all shards; in records of the index where ``damage`` holds, one stored byte is inverted."""
    index = spark.read.schema(INDEX).parquet(f"{source}/index")
    spoilt = index.withColumn("bad", F.coalesce(damage, F.lit(False)) if damage is not None else F.lit(False))
    # the offsets to spoil of one shard: bounded by the records of a shard
    shards = spoilt.groupBy("shard").agg(F.collect_list(F.when(F.col("bad"), F.col("offset") + F.col("length") - 6)).alias("spots"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        attempt = TaskContext.get().taskAttemptId()
        fs, root = filesystem(source)
        _, to = filesystem(target)
        fs.create_dir(to, recursive=True)
        for batch in batches:
            for shard, spots in zip(batch.column("shard").to_pylist(), batch.column("spots").to_pylist()):
                with fs.open_input_file(f"{root}/{shard}") as f:
                    raw = bytearray(f.read())
                for at in spots:
                    raw[at] ^= 255
                with fs.open_output_stream(f"{to}/.{shard}.{attempt}", compression=None) as f:
                    f.write(bytes(raw))
                fs.move(f"{to}/.{shard}.{attempt}", f"{to}/{shard}")
            yield pa.RecordBatch.from_arrays([batch.column("shard")], names=["shard"])

    shards.mapInArrow(run, "shard string").write.mode("overwrite").parquet(f"{target}/copied")
    index.write.mode("overwrite").parquet(f"{target}/index")


def read(spark: SparkSession, root: str) -> DataFrame:
    """``page_id, url, html, damaged`` of all records; damaged and lost ones have null url and html."""

    def run(raw: bytes, page_id: int | None) -> tuple:
        try:
            return (*parse(raw), False)
        except ValueError:
            return page_id, None, None, True

    return _stored(spark, root, run, "page_id long, url string, html string, damaged boolean", [pa.int64(), pa.string(), pa.string(), pa.bool_()], with_index=False)


def digests(spark: SparkSession, root: str) -> DataFrame:
    """The index with the SHA-256 of every stored record, without the records that are lost.

    A record is lost where its shard's file is gone or ends before it; of a
    record that is cut short, what is left is hashed.
    """
    found = _stored(spark, root, lambda raw, _: (hashlib.sha256(raw).digest() if raw else None,), "digest binary", [pa.binary()], with_index=True)
    return found.filter("digest is not null")


def _stored(spark: SparkSession, root: str, make, columns: str, types: list[pa.DataType], with_index: bool) -> DataFrame:
    """Each shard is one task's work, record by record; what a file doesn't hold is read as no bytes."""
    index = spark.read.schema(INDEX).parquet(f"{root}/index")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    by_shard = index.repartition(n, "shard").sortWithinPartitions("shard", "record")
    names = [c.split(" ")[0] for c in columns.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, at = filesystem(root)
        stream, name = None, None
        for batch in batches:
            rows = []
            for shard, offset, length, page_id in zip(*(batch.column(c).to_pylist() for c in ("shard", "offset", "length", "page_id"))):
                if shard != name:
                    try:
                        stream, name = fs.open_input_file(f"{at}/{shard}"), shard
                        size = stream.size()
                    except FileNotFoundError:
                        stream, name, size = None, shard, 0
                raw = b""
                if offset < size:
                    stream.seek(offset)
                    raw = stream.read(length)
                rows.append(make(raw, page_id))
            made = [pa.array([r[k] for r in rows], t) for k, t in enumerate(types)]
            own = batch.columns if with_index else []
            yield pa.RecordBatch.from_arrays([*own, *made], names=[*(batch.schema.names if with_index else []), *names])

    return by_shard.mapInArrow(run, f"{INDEX}, {columns}" if with_index else columns)


def tree(leaves: DataFrame, fanout: int = FANOUT) -> list[DataFrame]:
    """Levels of the Merkle trees of all shards, records first, one root per shard last.

    A node has ``shard, node, digest, first_offset, end_offset``; node i covers
    children i * fanout to i * fanout + fanout - 1 in order of their offsets,
    and its digest is that of their numbers, offset ranges and digests.
    """
    leaves = cut(leaves, "merkle-leaves")
    level = leaves.select("shard", F.col("record").alias("node"), F.hex("digest").alias("digest"), F.col("offset").alias("first_offset"), (F.col("offset") + F.col("length")).alias("end_offset"))
    most = leaves.agg(F.max("record")).first()[0]
    levels, last = [level], most or 0
    while last > 0:
        level = cut(above(level, fanout), "merkle-level")
        levels.append(level)
        last //= fanout
    return levels


def above(level: DataFrame, fanout: int = FANOUT) -> DataFrame:
    """The nodes over those of ``level``."""
    children = F.sort_array(F.collect_list(F.struct("node", "first_offset", "end_offset", "digest")))  # at most fanout of them
    written = F.transform(children, lambda c: F.concat_ws(":", (c["node"] % fanout).cast("string"), c["first_offset"].cast("string"), c["end_offset"].cast("string"), c["digest"]))
    return level.groupBy("shard", F.floor(F.col("node") / fanout).alias("node")).agg(
        F.sha2(F.concat_ws(",", written), 256).alias("digest"),
        F.min("first_offset").alias("first_offset"),
        F.max("end_offset").alias("end_offset"),
    )


def audit(ours: list[DataFrame], theirs: list[DataFrame], fanout: int = FANOUT) -> DataFrame:
    """Records that differ: ``shard, record, offset, end_offset, kind`` ("changed", "missing", "extra").

    Roots are compared first; each further level is read only below the nodes
    that differ one level up.
    """
    ours, theirs = list(ours), list(theirs)
    for levels in (ours, theirs):
        while len(levels) < max(len(ours), len(theirs)):
            levels.append(above(levels[-1], fanout))
    open_: DataFrame | None = None
    for k in range(len(ours) - 1, -1, -1):
        a, b = ours[k], theirs[k]
        if open_ is not None:
            at = [F.col("shard"), F.floor(F.col("node") / fanout).alias("parent")]
            a, b = (x.select("*", at[1]).join(open_, ["shard", "parent"], "left_semi").drop("parent") for x in (a, b))
        a = a.select("shard", "node", F.col("digest").alias("a"), F.col("first_offset").alias("a_first"), F.col("end_offset").alias("a_end"))
        b = b.select("shard", "node", F.col("digest").alias("b"), F.col("first_offset").alias("b_first"), F.col("end_offset").alias("b_end"))
        both = a.join(b, ["shard", "node"], "full_outer").filter(~F.col("a").eqNullSafe(F.col("b")))
        if k:
            open_ = both.select("shard", F.col("node").alias("parent"))
    kind = F.when(F.col("b").isNull(), "missing").when(F.col("a").isNull(), "extra").otherwise("changed")
    return both.select("shard", F.col("node").alias("record"), F.coalesce("a_first", "b_first").alias("offset"), F.coalesce("a_end", "b_end").alias("end_offset"), kind.alias("kind"))
