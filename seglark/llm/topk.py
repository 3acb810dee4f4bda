"""Exact top-k search by inner product, a block at a time.

Vectors are put in an order that brings similar ones together and cut into
blocks of consecutive places.  A block keeps, for each component (term), its
largest and smallest value; the sum over terms of the larger of
``q * largest`` and ``q * smallest`` bounds every score in the block.  A query
takes blocks in order of these bounds, scores each through the block's own
forward index, and stops when the next bound is below its k-th score, so the
result is exact.

Blocks are files in the shared folder, and so are the nodes of a tree over
them: a node keeps the bounds of ``FANOUT`` blocks or nodes, and its own bounds
cover theirs.  A task answers a batch of queries.  It begins with one root for
each task that wrote blocks, opens the node or block with the best bound next,
and holds the bounds that are still open and one block at a time.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shards import filesystem

BLOCK_ROWS, QUERY_ROWS, FANOUT = 2048, 128, 64
SCALE = 1024
#: Up to here whole numbers are exact in double precision.
EXACT = 1 << 53
HEAD = "<2Q"


def _usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def quantised(rows: list, scale: int = SCALE) -> np.ndarray:
    """``floor(scale * x)`` of equally long vectors, as whole doubles."""
    return np.floor(scale * np.array(rows, np.float64).reshape(len(rows), -1))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b``; beyond 64 bits they stay at the limit."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = np.array([[int(x) for x in r] for r in a], object).reshape(a.shape) @ np.array([[int(x) for x in r] for r in b], object).reshape(b.shape).T
    return np.clip(whole, -(1 << 63), (1 << 63) - 1).astype(np.int64)


def build(vectors: DataFrame, out: str, id_col: str = "vec_id", vector_col: str = "embedding", block_rows: int | None = None) -> DataFrame:
    """Write the blocks and the tree over them; returns its roots ``(dim, path, low, high)``.

    Vectors are ordered by length, by the component of greatest size and its
    value, then by id; ranges of that order are dealt to tasks, which cut them
    in blocks, and have one root for each length of vectors.  Rows whose id or vector is null, or whose vector holds a null
    or non-finite component, take no part.
    """
    spark = vectors.sparkSession
    block_rows = block_rows or BLOCK_ROWS
    own = vectors.select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    own = own.filter(F.col("id").isNotNull() & _usable(F.col("v")))
    sizes = F.transform("v", F.abs)
    lead = F.array_position(sizes, F.array_max(sizes)).cast("int")
    own = own.select("id", "v", F.size("v").alias("dim"), lead.alias("lead"), F.when(lead > 0, F.get("v", lead - 1)).alias("top"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = own.repartitionByRange(n, "dim", "lead", "top", "id").sortWithinPartitions("dim", "lead", "top", "id").select("dim", "id", "v")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt, written = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId(), 0
        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)

        def store(kind: str, raw: bytes) -> str:
            nonlocal written
            path = f"{root}/{kind}-{part:05d}-{written:07d}"
            with fs.open_output_stream(f"{path}.{attempt}") as f:
                f.write(raw)
            fs.move(f"{path}.{attempt}", path)
            written += 1
            return path

        def block(ids: list, rows: list) -> tuple:
            matrix = quantised(rows)
            raw = struct.pack(HEAD, len(ids), matrix.shape[1]) + np.array(ids, "<i8").tobytes() + matrix.astype("<f8").tobytes()
            return store("block", raw), matrix.min(0), matrix.max(0)

        def tree(level: list[tuple]) -> tuple:
            while len(level) > 1:
                level = [node(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
            return level[0]

        def node(children: list[tuple]) -> tuple:
            low, high = np.array([c[1] for c in children]), np.array([c[2] for c in children])
            raw = struct.pack(HEAD, *low.shape) + low.astype("<f8").tobytes() + high.astype("<f8").tobytes() + "\n".join(c[0] for c in children).encode()
            return store("node", raw), low.min(0), high.max(0)

        dim, ids, rows, made, roots = -1, [], [], [], []
        for batch in batches:
            for d, i, v in zip(*(batch.column(k).to_pylist() for k in range(3))):
                if ids and (d != dim or len(ids) >= block_rows):
                    made.append(block(ids, rows))
                    ids, rows = [], []
                if made and d != dim:
                    roots.append((dim, *tree(made)))
                    made = []
                dim = d
                ids.append(i)
                rows.append(v)
        if ids:
            made.append(block(ids, rows))
        if made:
            roots.append((dim, *tree(made)))
        types, names = [pa.int32(), pa.string(), pa.list_(pa.float64()), pa.list_(pa.float64())], ["dim", "path", "low", "high"]
        yield pa.RecordBatch.from_arrays([pa.array([list(r[k]) if k > 1 else r[k] for r in roots], t) for k, t in enumerate(types)], names=names)

    bounds = ranged.mapInArrow(run, "dim int, path string, low array<double>, high array<double>")
    bounds.write.parquet(f"{out}/bounds")
    return spark.read.schema(bounds.schema).parquet(f"{out}/bounds")


def read_block(fs, path: str) -> tuple[np.ndarray, np.ndarray]:
    with fs.open_input_file(path) as f:
        raw = f.read()
    n, dim = struct.unpack_from(HEAD, raw)
    return np.frombuffer(raw, "<i8", n, struct.calcsize(HEAD)), np.frombuffer(raw, "<f8", n * dim, struct.calcsize(HEAD) + 8 * n).reshape(n, dim)


def read_node(fs, path: str) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Paths and bounds of a node's children."""
    with fs.open_input_file(path) as f:
        raw = f.read()
    n, dim = struct.unpack_from(HEAD, raw)
    head = struct.calcsize(HEAD)
    low, high = (np.frombuffer(raw, "<f8", n * dim, head + 8 * n * dim * k).reshape(n, dim) for k in range(2))
    return raw[head + 16 * n * dim :].decode().split("\n"), low, high


def bounds_of(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each query and each child, a score that nothing below the child exceeds."""
    # rounding in the sum is far below the slack; it may only let a block in
    slack = np.abs(q) @ np.maximum(np.abs(low), np.abs(high)).T * 1e-12 + 1
    return np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T + slack


class TopK:
    """The k best of what has been offered: highest score first, ties to the smaller id."""

    def __init__(self, k: int):
        self.k, self.ids, self.scores = k, np.zeros(0, np.int64), np.zeros(0, np.int64)

    def offer(self, ids: np.ndarray, scores: np.ndarray) -> None:
        ids, scores = np.concatenate([self.ids, ids]), np.concatenate([self.scores, scores])
        best = np.lexsort((ids, ~scores))[: self.k]
        self.ids, self.scores = ids[best], scores[best]

    def kth(self) -> int | None:
        return int(self.scores[-1]) if len(self.scores) == self.k else None


def answer(query_ids: list[int], rows: list, low: np.ndarray, high: np.ndarray, paths: list[str], fs, k: int) -> tuple[list[TopK], int]:
    """Results of a batch of equally long queries, and how many (query, block) pairs were scored."""
    q = quantised(rows)
    found = [TopK(k) for _ in query_ids]
    bound, paths = bounds_of(q, low, high), list(paths)
    left, scored = np.ones_like(bound, bool), 0
    own = np.array(query_ids, np.int64)
    while left.any():
        # each query points at the best node or block left; the one most queries ask for is opened next
        ahead = np.where(left, bound, -np.inf)
        best = ahead.argmax(1)
        wants = ahead[np.arange(len(found)), best]
        for i, t in enumerate(found):
            kth = t.kth()
            if kth is not None and wants[i] < kth:
                left[i] = False
        open_ = left.any(1)
        if not open_.any():
            break
        chosen = np.bincount(best[open_], minlength=bound.shape[1]).argmax()
        who = np.flatnonzero(left[:, chosen])
        need = [i for i in who if (kth := found[i].kth()) is None or bound[i, chosen] >= kth]
        left[:, chosen] = False
        if not need:
            continue
        if paths[chosen].rsplit("/", 1)[-1].startswith("node-"):
            children, low, high = read_node(fs, paths[chosen])
            inner = np.zeros((len(found), len(children)), bool)
            inner[need] = True
            keep = np.flatnonzero(left.any(0))  # bounds that no query needs any more go
            bound, left = np.hstack([bound[:, keep], bounds_of(q, low, high)]), np.hstack([left[:, keep], inner])
            paths = [paths[c] for c in keep] + children
            continue
        ids, matrix = read_block(fs, paths[chosen])
        scores = products(q[need], matrix)
        scored += len(need)
        for i, s in zip(need, scores):
            other = ids != own[i]
            found[i].offer(ids[other], s[other])
    return found, scored


def search(vectors: DataFrame, queries: Column, out: str, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: the k best other rows of every row where ``queries`` holds.

    Scores are inner products of ``floor(1024 * x)``; ties go to the smaller
    id; all candidates are returned where there are fewer than k.  Rows that
    share the query's id count as the query itself and are left out; a query
    row that is repeated is answered each time.  Vectors are compared with
    vectors of their own length.  Null ids, null vectors and vectors with null
    or non-finite components take no part.  An empty table gives an empty
    result.
    """
    spark: SparkSession = vectors.sparkSession
    bounds = build(vectors, out, id_col, vector_col).select("dim", "path", "low", "high")
    own = vectors.filter(queries).select(vectors[id_col].cast("long").alias("id"), vectors[vector_col].cast("array<double>").alias("v"))
    own = own.filter(F.col("id").isNotNull() & _usable(F.col("v"))).withColumn("dim", F.size("v"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    own = own.repartition(n, F.xxhash64("id"))
    where = f"{out}/bounds"
    columns = bounds.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        fs, root = filesystem(where)
        for batch in batches:
            by_dim: dict[int, list[tuple[int, list]]] = {}
            for i, v, d in zip(*(batch.column(c).to_pylist() for c in ("id", "v", "dim"))):
                by_dim.setdefault(d, []).append((i, v))
            for dim, asked in by_dim.items():
                # one root for each task that wrote blocks
                table = ds.dataset(root, filesystem=fs, format="parquet").to_table(columns=columns, filter=ds.field("dim") == dim)
                paths = table.column("path").to_pylist()
                low, high = (np.array(table.column(c).to_pylist(), np.float64).reshape(len(paths), dim) for c in ("low", "high"))
                for at in range(0, len(asked), QUERY_ROWS):
                    some = asked[at : at + QUERY_ROWS]
                    found, _ = answer([i for i, _ in some], [v for _, v in some], low, high, paths, fs, k)
                    made = [(i, rank, int(v), int(s)) for (i, _), t in zip(some, found) for rank, (v, s) in enumerate(zip(t.ids, t.scores), 1)]
                    types = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                    yield pa.RecordBatch.from_arrays([pa.array([m[c] for m in made], t) for c, t in enumerate(types)], names=["query_id", "rank", "vec_id", "score"])

    return own.mapInArrow(run, "query_id long, rank int, vec_id long, score long")
