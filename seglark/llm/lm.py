"""Language-model scoring with a weighted backoff automaton.

The model is an n-gram model smoothed towards the next shorter context,

    p(w | context) = (count(context w) + mu * p(w | shorter)) / (count(context) + mu)

with a mu for each order and add-one counts at the root.  As an automaton: every context seen in
training is a state; a seen n-gram is an arc that carries its log probability
and leads to the longest context it ends in; every state has one failure arc
to its shorter context that carries log(mu / (count(context) + mu)).  A text is
scored in one traversal from left to right: follow the arc of the next token,
or failure arcs until there is one, and add up what they carry.

Nothing of the model is collected or broadcast but two totals.  Documents are
packed in chunks (files of the shared folder); each chunk asks for the counts
of exactly the n-grams it holds.  Words or 64-bit n-gram keys go, once per
chunk and sorted, to the group that owns their hash range, which adds up all
chunks' training counts and answers each chunk with totals in the order of its
own keys.  From these a chunk builds the states, arcs and failure arcs that its
texts can reach, and walks them.  There are as many hash ranges as chunks, so
that neither a group nor a chunk grows with the corpus.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import text_batches
from .common import cut, scratch
from .shards import filesystem

#: Tokens of a chunk; what a task holds at a time grows with this and not with the corpus.
CHUNK_TOKENS = 2_000_000
#: Tasks that add up counts, by chunk.
GROUPS = 2
#: Tokens that are read one after the other; all such stretches of a chunk are read side by side.
LANE = 256
ORDER = 3
#: mu of bigrams, trigrams and so on; the last also holds for all higher orders.  Chosen on held-out texts.
MU = (1000.0, 5.0)
FOLDS, HELD_OUT = 7, 2
END, START = b" end", b" start"  # no word holds a blank
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)

def held_out(doc_id: int | None) -> bool:
    """Whether a document is kept from training; a null identifier counts as an empty text."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % FOLDS == HELD_OUT


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def extend(context: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Keys of n-grams from the keys of their contexts and of their last tokens."""
    x = context * _ODD + (word << np.uint64(31) | word >> np.uint64(33))
    x ^= x >> np.uint64(32)
    x *= _MIX
    return x ^ x >> np.uint64(29)


def slices(keys: np.ndarray, parts: int) -> np.ndarray:
    """Where the sorted ``keys`` of each of ``parts`` equal hash ranges begin, and their end."""
    owner = ((keys >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
    return np.searchsorted(owner, np.arange(parts + 1, dtype=np.uint64))


def pack(values: np.ndarray) -> bytes:
    """Counts, in the fewest bytes a count needs, compressed."""
    most = int(values.max()) if len(values) else 0
    kind = next(k for k in ("<u1", "<u2", "<u4", "<u8") if most < 1 << 8 * int(k[2]))
    return kind[2].encode() + zlib.compress(values.astype(kind).tobytes(), 1)


def unpack(raw: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(raw[1:]), f"<u{raw[:1].decode()}").astype(np.int64)


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as their differences: the low five bytes as they are, the high ones, which repeat, in Huffman codes."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype("<u8").view(np.uint8).reshape(-1, 8)
    high = zlib.compressobj(1, zlib.DEFLATED, 15, 9, zlib.Z_HUFFMAN_ONLY)
    return gaps[:, :5].tobytes() + high.compress(gaps[:, 5:].T.tobytes()) + high.flush() + len(keys).to_bytes(8, "little")


def unpack_keys(raw: bytes) -> np.ndarray:
    n = int.from_bytes(raw[-8:], "little")
    gaps = np.empty((n, 8), np.uint8)
    gaps[:, :5] = np.frombuffer(raw, np.uint8, 5 * n).reshape(n, 5)
    gaps[:, 5:] = np.frombuffer(zlib.decompress(raw[5 * n : -8]), np.uint8).reshape(3, n).T
    return np.cumsum(gaps.reshape(-1).view("<u8"), dtype=np.uint64)


class Chunk:
    """Some documents as arrays: ``tokens`` are ranks in ``words``, which are sorted by hash."""

    def __init__(self, raw: bytes):
        parts = pa.ipc.open_stream(pa.decompress(raw[8:], int.from_bytes(raw[:8], "little"), "zstd", asbytes=True)).read_all().to_pydict()
        self.doc_ids = parts["doc_ids"][0]
        self.held = np.frombuffer(parts["held"][0], bool)
        self.sizes = np.frombuffer(parts["sizes"][0], "<i8")
        self.tokens = np.frombuffer(parts["tokens"][0], "<i4")
        self.words = parts["words"][0].split(b"\n")
        self.hash = hashes(self.words)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.training = np.repeat(~self.held, self.sizes)

    @staticmethod
    def stored(doc_ids: list[int | None], held: np.ndarray, sizes: np.ndarray, tokens: np.ndarray, words: list[bytes]) -> bytes:
        row = (doc_ids, held.tobytes(), sizes.astype("<i8").tobytes(), tokens.astype("<i4").tobytes(), b"\n".join(words))
        batch = _batch([row], [pa.list_(pa.int64()), *[pa.large_binary()] * 4], ["doc_ids", "held", "sizes", "tokens", "words"])
        stream = pa.BufferOutputStream()
        with pa.ipc.new_stream(stream, batch.schema) as out:
            out.write_batch(batch)
        raw = stream.getvalue()
        return raw.size.to_bytes(8, "little") + pa.compress(raw, "zstd", asbytes=True)

    @classmethod
    def read(cls, fs, path: str) -> Chunk:
        with fs.open_input_file(path) as f:
            return cls(f.read())

    def place(self) -> np.ndarray:
        """The number of each token in its text."""
        return np.arange(len(self.tokens), dtype=np.int32) - np.repeat(self.starts, self.sizes).astype(np.int32)

    def keys(self, order: int) -> Iterator[np.ndarray]:
        """For orders 2 and up, the key of the n-gram that ends at each token; 0 where the text is too short."""
        context, place = self.hash[self.tokens], self.place()
        for n in range(2, order + 1):
            key = np.empty_like(context)
            key[1:] = context[:-1]
            key[place == 0] = np.uint64(xxhash.xxh3_64_intdigest(START)) if n == 2 else np.uint64(0)
            key = extend(key, self.hash[self.tokens])
            if n > 2:
                key[place < n - 2] = 0
            yield key
            context = key


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct keys, and the rank of every key in them."""
    order = np.argsort(keys)
    own = keys[order]
    new = np.ones(len(own), bool)
    new[1:] = own[1:] != own[:-1]
    rank = np.empty(len(keys), np.int32)
    rank[order] = np.cumsum(new, dtype=np.int32) - 1
    return own[new], rank


def chunks(docs: DataFrame, out: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Documents packed in chunks, one file of the folder ``out`` each; returns a table of their numbers (``chunk``)."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, seq = TaskContext.get(), 0
        fs, root = filesystem(out)
        fs.create_dir(root, recursive=True)

        def fresh():
            return {END: 0}, [], [], [], 0

        def flush():
            words = list(local)
            order = np.argsort(hashes(words), kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            held = np.array([held_out(i) for i in ids], bool)
            chunk = task.partitionId() << 24 | seq
            path = path_of(root, chunk)
            with fs.open_output_stream(f"{path}.{task.taskAttemptId()}", compression=None) as f:
                f.write(Chunk.stored(ids, held, np.array(sizes), rank[np.concatenate(parts)], [words[i] for i in order]))
            fs.move(f"{path}.{task.taskAttemptId()}", path)
            return pa.RecordBatch.from_arrays([pa.array([chunk])], names=["chunk"])

        local, ids, sizes, parts, tokens = fresh()
        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for begin, texts in text_batches(batch.column("text")):
                for doc_id, text in zip(ids_of[begin:], texts):
                    own_words = text.encode().lower().split()
                    own_words.append(END)
                    parts.append(np.fromiter((local.setdefault(w, len(local)) for w in own_words), np.int64, len(own_words)))
                    ids.append(doc_id)
                    sizes.append(len(own_words))
                    tokens += len(own_words)
                    if tokens >= CHUNK_TOKENS:
                        yield flush()
                        seq += 1
                        local, ids, sizes, parts, tokens = fresh()
        if ids:
            yield flush()

    return cut(own.mapInArrow(run, "chunk long"), "lm-chunks")


def path_of(root: str, chunk: int) -> str:
    return f"{root}/chunk-{chunk >> 24:06d}-{chunk & 0xFFFFFF:06d}"


def word_counts(table: DataFrame, out: str, parts: int) -> DataFrame:
    """``(chunk, part, totals, n_types, n_tokens)``: training counts of each chunk's words by hash range."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                c = Chunk.read(fs, path_of(root, chunk))
                counts = np.bincount(c.tokens[c.training], minlength=len(c.words))
                at = slices(c.hash, parts)
                filled = np.flatnonzero(np.diff(at))
                made = [(int(p), chunk, b"\n".join(c.words[at[p] : at[p + 1]]), pack(counts[at[p] : at[p + 1]])) for p in filled]
                yield _batch(made, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["part", "chunk", "keys", "counts"])

    def add_up(group: pa.Table) -> pa.Table:
        total: dict[bytes, int] = {}
        asked = []
        for keys, counts in zip(group.column("keys").to_pylist(), group.column("counts").to_pylist()):
            words = keys.split(b"\n")
            asked.append(words)
            for w, n in zip(words, unpack(counts).tolist()):
                total[w] = total.get(w, 0) + n
        answers = [pack(np.fromiter(map(total.__getitem__, words), np.int64, len(words))) for words in asked]
        seen = [n for n in total.values() if n]
        sums = ([len(seen)] + [0] * (len(asked) - 1), [sum(seen)] + [0] * (len(asked) - 1))
        return pa.table({"chunk": group.column("chunk"), "part": group.column("part"), "totals": pa.array(answers, pa.binary()), "n_types": pa.array(sums[0], pa.int64()), "n_tokens": pa.array(sums[1], pa.int64())})

    asked = table.mapInArrow(emit, "part long, chunk long, keys binary, counts binary").repartition(_tasks(table, GROUPS), "part")
    return asked.groupBy("part").applyInArrow(add_up, "chunk long, part long, totals binary, n_types long, n_tokens long")


def ngram_counts(table: DataFrame, out: str, parts: int, order: int) -> DataFrame:
    """``(chunk, n, part, totals)``: training counts of each chunk's n-grams by hash range."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        for batch in batches:
            for chunk in batch.column("chunk").to_pylist():
                c = Chunk.read(fs, path_of(root, chunk))
                for n, keys in enumerate(c.keys(order), 2):
                    own, back = distinct(keys)
                    counts = np.bincount(back[c.training], minlength=len(own))
                    at = slices(own, parts)
                    filled = np.flatnonzero(np.diff(at))
                    made = [(n * parts + int(p), chunk, pack_keys(own[at[p] : at[p + 1]]), pack(counts[at[p] : at[p + 1]])) for p in filled]
                    yield _batch(made, [pa.int64(), pa.int64(), pa.binary(), pa.binary()], ["part", "chunk", "keys", "counts"])

    def add_up(group: pa.Table) -> pa.Table:
        asked = [unpack_keys(k) for k in group.column("keys").to_pylist()]
        counts = np.concatenate([unpack(c) for c in group.column("counts").to_pylist()])
        own, back = np.unique(np.concatenate(asked), return_inverse=True)
        total = np.bincount(back, counts, len(own)).astype(np.int64)[back]
        ends = np.cumsum([len(a) for a in asked])[:-1]
        answers = [pack(a) for a in np.split(total, ends)]
        n = [p // parts for p in group.column("part").to_pylist()]
        part = [p % parts for p in group.column("part").to_pylist()]
        return pa.table({"chunk": group.column("chunk"), "n": pa.array(n, pa.int32()), "part": pa.array(part, pa.int64()), "totals": pa.array(answers, pa.binary())})

    asked = table.mapInArrow(emit, "part long, chunk long, keys binary, counts binary").repartition(_tasks(table, GROUPS), "part")
    return asked.groupBy("part").applyInArrow(add_up, "chunk long, n int, part long, totals binary")


def _batch(rows: list[tuple], types: list[pa.DataType], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(types)], names=names)


class Automaton:
    """The states, arcs and failure arcs that the texts of one chunk can reach.

    State 0 is the root; every other state is a context of one token or more
    that training texts hold.  ``codes`` (state and word, sorted), ``arc`` (log
    probability) and ``to`` (state) are the arcs of seen n-grams; the root has
    an arc for every word (``first``, ``first_to``).  ``fail`` and
    ``fail_weight`` are the failure arc of each state.
    """

    def __init__(self, c: Chunk, unigram: np.ndarray, ngrams: list[tuple[np.ndarray, np.ndarray]], n_tokens: int, n_types: int, mus: tuple[float, ...]):
        self.order = len(ngrams) + 1
        tokens, end = c.tokens, c.words.index(END)
        n_docs = int(unigram[end])  # every training document has one end
        self.known = unigram > 0
        p = (unigram + 1) / (n_tokens + n_types + 1)
        self.first = np.log10(p)
        # state of each context: by word, then by distinct n-gram of the chunk; -1 where training texts lack it
        count, at = unigram, tokens
        states = np.full(len(unigram), -1, np.int32)
        if self.order > 1:
            self.start = 1
            seen = self.known.copy()
            seen[end] = False
            states[seen] = np.arange(2, 2 + seen.sum())
        else:
            self.start = 0
        self.first_to = np.maximum(states, 0)
        longest = self.first_to[tokens]  # of what ends at each token, the longest state so far
        total = 2 + int((states >= 0).sum()) if self.order > 1 else 1
        fail, fail_count = [np.zeros(total, np.int32)], [np.concatenate([[0, n_docs][: 1 + self.start], count[states >= 0]])]
        fail_mu = [np.full(total, mus[0])]
        codes, arcs, to = [], [], []
        place = c.place()
        for n, (count_n, at_n) in enumerate(ngrams, 2):
            rep = np.empty(len(count_n), np.int32)
            rep[at_n] = np.arange(len(at_n), dtype=np.int32)  # the last place of each
            seen = (count_n > 0) & (place[rep] >= n - 2)
            own = rep[seen]
            before = np.where(place[own] == 0, -1, states[at[own - 1]])
            before_count = np.where(place[own] == 0, n_docs, count[at[own - 1]])
            before = np.where((n == 2) & (place[own] == 0), self.start, before)
            p_n, mu = np.zeros(len(count_n)), mus[min(n - 2, len(mus) - 1)]
            p_n[seen] = (count_n[seen] + mu * p[at[own]]) / (before_count + mu)
            new = np.full(len(count_n), -1, np.int32)
            if n < self.order:
                inner = seen.copy()
                inner[seen] = tokens[own] != end
                new[inner] = np.arange(total, total + inner.sum())
                total += int(inner.sum())
                fail.append(longest[rep[inner]])
                fail_count.append(count_n[inner])
                fail_mu.append(np.full(len(fail_count[-1]), mus[min(n - 1, len(mus) - 1)]))
                longest = np.where(new[at_n] >= 0, new[at_n], longest)
            # states of longer contexts have higher numbers: sorted by level, the arcs are sorted
            code = before.astype(np.int64) << 32 | tokens[own]
            by_code = np.argsort(code)
            codes.append(code[by_code])
            arcs.append(np.log10(p_n[seen])[by_code])
            to.append(own[by_code])
            count, at, states, p = count_n, at_n, new, p_n
        self.fail = np.concatenate(fail)
        fail_mu = np.concatenate(fail_mu)
        self.fail_weight = np.log10(fail_mu / (np.concatenate(fail_count) + fail_mu))
        self.codes = np.concatenate(codes) if codes else np.zeros(0, np.int64)
        self.arc = np.concatenate(arcs) if arcs else np.zeros(0)
        self.to = longest[np.concatenate(to)] if to else np.zeros(0, np.int32)

    def walk(self, tokens: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Log probability of every token: from left to right, all lanes take their t-th step together.

        A lane is up to ``LANE`` tokens of one text.  The state after a token is
        the longest state that the text so far ends in, and no state is longer
        than ``order - 1`` tokens: a lane that begins inside a text gets its
        state by reading as many tokens before it from the root.
        """
        out = np.empty(len(tokens))
        lanes = -(-sizes // LANE)
        doc = np.repeat(np.arange(len(sizes)), lanes)
        number = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = starts[doc] + number * LANE
        stop = np.minimum(begin + LANE, starts[doc] + sizes[doc])
        warm = np.where(number > 0, min(self.order - 1, LANE), 0)
        state = np.where(number > 0, 0, self.start)
        longest_first = np.argsort(-(stop - begin + warm), kind="stable")
        at, stop, state, begin = (begin - warm)[longest_first], stop[longest_first], state[longest_first], begin[longest_first]
        while len(at) and at[0] < stop[0]:
            n = int(np.searchsorted(at >= stop, True))  # lanes that go on: their steps left never grow from one to the next
            at, stop, state, begin = at[:n], stop[:n], state[:n], begin[:n]
            words = tokens[at]
            total = np.zeros(n)
            todo = np.flatnonzero(state)
            final = np.zeros(n, np.int64)
            rooted = [np.flatnonzero(state == 0)]
            while len(todo):
                code = state[todo].astype(np.int64) << 32 | words[todo]
                found = np.searchsorted(self.codes, code)
                found[found == len(self.codes)] = 0
                takes = self.codes[found] == code if len(self.codes) else np.zeros(len(todo), bool)
                hit = todo[takes]
                total[hit] += self.arc[found[takes]]
                final[hit] = self.to[found[takes]]
                todo = todo[~takes]
                total[todo] += self.fail_weight[state[todo]]
                state[todo] = self.fail[state[todo]]
                rooted.append(todo[state[todo] == 0])
                todo = todo[state[todo] != 0]
            root = np.concatenate(rooted)
            total[root] += self.first[words[root]]
            final[root] = self.first_to[words[root]]
            counts = at >= begin
            out[at[counts]] = total[counts]
            state = final
            at = at + 1
        return out


SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def score(docs: DataFrame, order: int = ORDER, mu: float | tuple[float, ...] = MU, parts: int | None = None) -> DataFrame:
    """Score every document with the model learnt from those that are not held out.

    Returns ``doc_id``, ``held_out``, ``n_tokens``, ``n_known`` (tokens seen in
    training), ``train_tokens``, ``base_score`` (add-one unigram) and ``score``
    (the automaton), both base-10 logarithms of the text's probability.  Null
    and empty texts consist of the end token.  Repeated rows are scored (and
    counted) each; a null ``doc_id`` is a training document; an empty table
    gives an empty result.  Columns other than ``doc_id`` and ``text`` are not
    read.
    """
    spark: SparkSession = docs.sparkSession
    mus = tuple(mu) if isinstance(mu, (tuple, list)) else (float(mu),)
    out = scratch(spark, "lm")
    table = chunks(docs, out)
    # as many hash ranges as chunks: a range then holds about as many keys as one chunk asks for, at any size
    parts = parts or max(1, table.count())
    words = cut(word_counts(table, out, parts), "lm-words")
    n_tokens, n_types = (int(x or 0) for x in words.agg(F.sum("n_tokens"), F.sum("n_types")).first())
    answers = words.select("chunk", F.lit(1).alias("n"), "part", "totals")
    if order > 1:
        answers = answers.unionByName(ngram_counts(table, out, parts, order))
    answers = answers.repartition(_tasks(table, 1), "chunk").sortWithinPartitions("chunk", "n", "part")

    def scored(chunk: int, totals: dict[int, list[np.ndarray]], fs, root: str) -> pa.RecordBatch:
        c = Chunk.read(fs, path_of(root, chunk))
        ngrams = []
        for n, keys in enumerate(c.keys(order), 2):
            ngrams.append((np.concatenate(totals.pop(n)), distinct(keys)[1]))
        a = Automaton(c, np.concatenate(totals[1]), ngrams, n_tokens, n_types, mus)
        del ngrams
        base = np.add.reduceat(a.first[c.tokens], c.starts)
        known = np.add.reduceat(a.known[c.tokens].astype(np.int64), c.starts)
        total = np.add.reduceat(a.walk(c.tokens, c.starts, c.sizes), c.starts)
        columns = [c.doc_ids, c.held, c.sizes, known, np.full(len(c.sizes), n_tokens), base, total]
        types = [pa.int64(), pa.bool_(), *[pa.int64()] * 3, *[pa.float64()] * 2]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=[x.split(" ")[0] for x in SCORES.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = filesystem(out)
        chunk, totals = None, {}
        for batch in batches:
            for own, n, raw in zip(*(batch.column(k).to_pylist() for k in ("chunk", "n", "totals"))):
                if own != chunk:
                    if chunk is not None:
                        yield scored(chunk, totals, fs, root)
                    chunk, totals = own, {}
                totals.setdefault(n, []).append(unpack(raw))
        if chunk is not None:
            yield scored(chunk, totals, fs, root)

    return answers.mapInArrow(run, SCORES)


def _tasks(table: DataFrame, per_chunk: int) -> int:
    """Tasks for work that grows with the chunks, at least the session's number of shuffle partitions."""
    return max(int(table.sparkSession.conf.get("spark.sql.shuffle.partitions")), per_chunk * table.count())
