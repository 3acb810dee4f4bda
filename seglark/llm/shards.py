"""Token ids in sorted-string-table shards.

A shard holds entries in ascending key order: the key is the document's
identifier in an order-preserving byte form, the value its token ids.  Entries
are packed in blocks in which each key stores only what it doesn't share with
the key before; then come a sparse index (first key, offset and sizes of every
block), a Bloom filter over all keys, and a footer of fixed size that tells
where they are.  A reader fetches the footer, the filter and the index, finds
the block by binary search and decodes that block alone.

Layout: ``blocks | index | filter | footer``; integers are little-endian,
``varint`` is 7 bits a byte, low bits first.

* block (zstd): for each entry varint shared, varint rest, varint bytes of
  value, rest of the key, value
* index (zstd): for each block varint key size, first key, varint offset,
  varint stored size, varint entries, varint tokens
* footer: six unsigned 64-bit integers (index offset and size, filter offset
  and size, entries, tokens), id width and number of hash functions as
  unsigned 32-bit integers, magic
"""

from __future__ import annotations

import bisect
import hashlib
import os
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .bpe import ChunkCoder, byte_alphabet, flat_lists, once, text_batches, tidy, tokenizer_text

MAGIC, FOOTER = b"SGLKSST1", "<6Q2I8s"
BLOCK_BYTES, SHARD_BYTES = 64 << 10, 64 << 20
BITS_PER_KEY, HASHES = 10, 7
#: Pieces that are encoded in one call.
JOINED = 2000
#: Bytes of text encoded at a time, and pieces that a worker remembers.
BATCH_BYTES = 6_000_000
CACHE_PIECES = 1_200_000


def key_bytes(doc_id: int | None) -> bytes:
    """Byte form of an identifier; byte order is null first, then numeric order."""
    return b"\0" if doc_id is None else b"\1" + struct.pack(">Q", doc_id + (1 << 63))


def key_value(raw: bytes) -> int | None:
    return None if raw == b"\0" else struct.unpack(">Q", raw[1:])[0] - (1 << 63)


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _bits(key: bytes, m: int, hashes: int) -> list[int]:
    a, b = struct.unpack("<QQ", hashlib.blake2b(key, digest_size=16).digest())
    return [(a + i * (b | 1)) % m for i in range(hashes)]


class ShardWriter:
    """Appends entries in key order to an open binary stream."""

    def __init__(self, stream, width: int):
        self.stream, self.width = stream, width
        self.pack = zstandard.ZstdCompressor(level=1).compress
        self.offset = self.entries = self.tokens = 0
        self.index: list[bytes] = []
        self.keys: list[bytes] = []
        self._begin()

    def _begin(self) -> None:
        self.block, self.count, self.in_block, self.before, self.first = bytearray(), 0, 0, b"", b""

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must come in ascending order")
        shared = len(os.path.commonprefix([key, self.before])) if self.count else 0
        value = ids.astype("<u2" if self.width == 2 else "<u4").tobytes()
        self.first = self.first or key
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:] + value
        self.count += 1
        self.in_block += len(ids)
        self.before = key
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        stored = self.pack(bytes(self.block))
        self.stream.write(stored)
        self.index.append(_varint(len(self.first)) + self.first + b"".join(map(_varint, (self.offset, len(stored), self.count, self.in_block))))
        self.offset += len(stored)
        self.entries += self.count
        self.tokens += self.in_block
        self._begin()

    def close(self) -> None:
        if self.count:
            self._flush()
        m = max(64, BITS_PER_KEY * self.entries + 7 & ~7)
        bits = np.zeros(m, bool)
        for key in self.keys:
            bits[_bits(key, m, HASHES)] = True
        index, bloom = self.pack(b"".join(self.index)), np.packbits(bits).tobytes()
        self.stream.write(index + bloom)
        self.stream.write(struct.pack(FOOTER, self.offset, len(index), self.offset + len(index), len(bloom), self.entries, self.tokens, self.width, HASHES, MAGIC))


class ShardReader:
    """Random and sequential access to one shard; only what is asked for is read."""

    def __init__(self, stream):
        self.stream = stream
        stream.seek(0, 2)
        size = stream.tell()
        tail = struct.calcsize(FOOTER)
        if size < tail:
            raise ValueError("not a shard: too short")
        self.index_at, self.index_size, self.bloom_at, self.bloom_size, self.entries, self.tokens, self.width, self.hashes, magic = struct.unpack(FOOTER, self._read(size - tail, tail))
        if magic != MAGIC:
            raise ValueError("not a shard: bad magic")
        self.unpack = zstandard.ZstdDecompressor().decompress
        raw, at = self.unpack(self._read(self.index_at, self.index_size)), 0
        self.firsts: list[bytes] = []
        self.blocks: list[tuple[int, int, int, int]] = []
        while at < len(raw):
            n, at = _read_varint(raw, at)
            self.firsts.append(raw[at : at + n])
            at += n
            numbers = []
            for _ in range(4):
                n, at = _read_varint(raw, at)
                numbers.append(n)
            self.blocks.append(tuple(numbers))
        self.bloom = None

    def _read(self, at: int, n: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(n)

    def block(self, k: int) -> list[tuple[bytes, np.ndarray]]:
        offset, size, count, _ = self.blocks[k]
        raw, at, key, out = self.unpack(self._read(offset, size)), 0, b"", []
        for _ in range(count):
            shared, at = _read_varint(raw, at)
            rest, at = _read_varint(raw, at)
            n, at = _read_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            out.append((key, np.frombuffer(raw, "<u2" if self.width == 2 else "<u4", n // self.width, at)))
            at += n
        return out

    def __iter__(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.blocks)):
            yield from self.block(k)

    def may_have(self, key: bytes) -> bool:
        if self.bloom is None:
            self.bloom = np.unpackbits(np.frombuffer(self._read(self.bloom_at, self.bloom_size), np.uint8))
        return bool(self.bloom[_bits(key, len(self.bloom), self.hashes)].all())

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this identifier (none, one, or as many as were written)."""
        key = key_bytes(doc_id)
        if not self.may_have(key):
            return []
        out: list[np.ndarray] = []
        k = max(0, bisect.bisect_left(self.firsts, key) - 1)
        while k < len(self.blocks) and self.firsts[k] <= key:
            own = self.block(k)
            keys = [x for x, _ in own]
            out += [ids for _, ids in own[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]]
            k += 1
        return out


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


def library_encoder(library):
    """Encodes pieces with the tokenizers library, many that begin with a blank or newline in one call.

    Where such pieces stand one after another, the library splits the text
    before their blanks and newlines, so its ids are those of the pieces, one
    after the other.  Where each piece ends follows from the lengths of the
    tokens in bytes; pieces for which that doesn't fit are encoded alone.
    """
    alphabet = byte_alphabet()
    vocab = library.get_vocab(with_added_tokens=True)
    lengths = np.zeros(max(vocab.values()) + 1, np.int64)
    for token, i in vocab.items():
        lengths[i] = len(token) if all(c in alphabet for c in token) else len(token.encode())

    def alone(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return flat_lists([e.ids for e in library.encode_batch_fast(pieces, add_special_tokens=False)])

    def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids, sizes = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        at = 0
        while at < len(pieces):
            end = at
            while end < len(pieces) and end < at + JOINED and (end == at or pieces[end][:1] in (" ", "\n") and pieces[end][1:2].strip()):
                end += 1
            some = pieces[at:end]
            whole = np.array(library.encode_batch_fast(["".join(some)], add_special_tokens=False)[0].ids, np.int64)
            bounds = np.cumsum([len(p.encode()) for p in some])
            ends = np.cumsum(lengths[whole])
            last = np.searchsorted(ends, bounds) + 1
            if len(whole) and last[-1] == len(whole) and (ends[last - 1] == bounds).all():
                ids.append(whole)
                sizes.append(np.diff(last, prepend=0))
            else:
                own = alone(some)
                ids.append(own[0])
                sizes.append(own[1])
            at = end
        return np.concatenate(ids), np.concatenate(sizes)

    return encode


MANIFEST = "part int, seq int, path string, first_id long, last_id long, n_docs long, n_tokens long"


def write(docs: DataFrame, out: str, tokenizer: str, end_id: int | None = None, partitions: int | None = None) -> DataFrame:
    """Encode ``documents`` with the tokenizers library and write shards in ``doc_id`` order.

    ``docs`` has ``doc_id`` (integer) and ``text``; other columns are ignored.
    The rows are dealt by range of ``doc_id`` and text and sorted within each range, so
    that shard (part, seq) order is ``doc_id`` order.  Null identifiers come
    first; rows that share an identifier are all kept, in order of their text.
    Null and empty texts hold the end id alone, or nothing without one.  An
    empty table writes no shard.  ``out`` is a URI that all executors reach.
    Returns the manifest, which is also written to ``out/manifest``.  A task
    that is run again writes the same shards under their final names, moved
    there only when complete.
    """
    spark = docs.sparkSession
    own = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].alias("text"))
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    # the beginning of the text tells rows of one identifier apart, so that no identifier has to fit in one task
    ranged = own.repartitionByRange(n, F.col("doc_id"), F.substring("text", 1, 64)).sortWithinPartitions("doc_id", "text")
    shared = spark.sparkContext.broadcast(tokenizer_text(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from tokenizers import Tokenizer

        def make():
            library = Tokenizer.from_str(shared.value)
            library.no_truncation()
            library.no_padding()
            coder = ChunkCoder(library_encoder(library), cache_words=CACHE_PIECES)
            coder.vocabulary = library.get_vocab_size()
            return coder

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        coder = once("library" + hashlib.sha256(shared.value.encode()).hexdigest(), make)
        width = 2 if max(coder.vocabulary, (end_id or 0) + 1) <= 1 << 16 else 4
        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)
        part, rows, open_ = TaskContext.get().partitionId(), [], None
        tail = [] if end_id is None else [end_id]

        def finish():
            writer, stream, temp, ids = open_
            writer.close()
            stream.close()
            name = f"{root}/part-{part:05d}-{len(rows):05d}.sst"
            fs.move(temp, name)
            rows.append((part, len(rows), name, ids[0], ids[1], writer.entries, writer.tokens))

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for begin, texts in text_batches(batch.column("text"), BATCH_BYTES):
                for doc_id, ids in zip(ids_of[begin:], coder.encode(texts)):
                    if open_ and open_[0].offset >= SHARD_BYTES:
                        finish()
                        open_ = None
                    if not open_:
                        temp = f"{root}/.{part:05d}-{uuid.uuid4().hex}"
                        stream = fs.open_output_stream(temp)
                        open_ = [ShardWriter(stream, width), stream, temp, [doc_id, doc_id]]
                    open_[0].add(key_bytes(doc_id), np.concatenate([ids, np.array(tail, ids.dtype)]))
                    open_[3][1] = doc_id
        if open_:
            finish()
        types = [pa.int32(), pa.int32(), pa.string(), *[pa.int64()] * 4]
        names = [c.split(" ")[0] for c in MANIFEST.split(", ")]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)

    made = ranged.mapInArrow(tidy(run, keep=True), MANIFEST)
    made.write.mode("overwrite").parquet(f"{out}/manifest")
    return manifest(spark, out)


def manifest(spark: SparkSession, out: str) -> DataFrame:
    """One row per shard, with ``start``: the tokens in all shards before it."""
    shards = spark.read.schema(MANIFEST).parquet(f"{out}/manifest")
    before = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return shards.withColumn("start", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long"))


def scan(spark: SparkSession, out: str, value: str = "ids") -> DataFrame:
    """All entries, read back shard by shard.

    ``value`` "ids" returns ``(doc_id, start, n_tokens, ids array<int>)``,
    "crc32" an unsigned ``ids_crc32`` of the ids as little-endian unsigned
    32-bit integers instead of the ids.
    """
    shards = manifest(spark, out).select("path", "start")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    root = out
    columns = "ids array<int>" if value == "ids" else "ids_crc32 long"
    schema = f"doc_id long, start long, n_tokens long, {columns}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = filesystem(root)
        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                with fs.open_input_file(path) as stream:
                    reader = ShardReader(stream)
                    for k in range(len(reader.blocks)):
                        rows = []
                        for key, ids in reader.block(k):
                            wide = ids.astype("<u4")
                            rows.append((key_value(key), start, len(ids), wide.tolist() if value == "ids" else zlib.crc32(wide.tobytes())))
                            start += len(ids)
                        last = pa.list_(pa.int32()) if value == "ids" else pa.int64()
                        types = [pa.int64(), pa.int64(), pa.int64(), last]
                        names = ["doc_id", "start", "n_tokens", columns.split(" ")[0]]
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    return shards.repartition(n, F.xxhash64("path")).mapInArrow(run, schema)


def lookup(spark: SparkSession, out: str, ids: Iterable[int | None]) -> dict[int | None, list[np.ndarray]]:
    """Token ids of a few identifiers: only shards whose key range holds them are opened."""
    wanted = list(dict.fromkeys(ids))
    fs, _ = filesystem(out)
    keys = [key_bytes(i) for i in wanted]
    found: dict[int | None, list[np.ndarray]] = {i: [] for i in wanted}
    known = [i for i in wanted if i is not None]
    hit = F.col("first_id").isNull()
    if known:
        between = F.exists(F.array(*[F.lit(i).cast("long") for i in known]), lambda x: (x <= F.col("last_id")) & (x >= F.coalesce(F.col("first_id"), x)))
        hit = hit | between
    shards = spark.read.schema(MANIFEST).parquet(f"{out}/manifest").filter(hit).orderBy("part", "seq")
    for row in shards.toLocalIterator():
        with fs.open_input_file(row.path) as stream:
            reader = ShardReader(stream)
            for i, key in zip(wanted, keys):
                if reader.firsts and reader.firsts[0] <= key:
                    found[i] += [np.array(x) for x in reader.get(i)]
    return found
