"""BPE encoding and decoding by prefix-sharing trie traversal.

The encoding of a string under BPE is fixed by its prefixes: for every prefix
there is exactly one last token, and the prefix without that token is encoded
in the same way.  Distinct words are therefore put in a trie and traversed
depth first; each node keeps the last token of its prefix, so that what words
share at their beginning is computed once.  A word's ids are read off by
walking back from its node along the token lengths.

A token ``t`` that ends at a node is the last token if ``t`` may follow the
last token of the rest, i.e. if BPE would never merge across their boundary
before each of them is complete.  That is decided from the two merge trees
alone and remembered per pair.
"""

from __future__ import annotations

import contextlib
import ctypes
import gc
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Splitting pattern of byte-level BPE (fixed values of the public tokenizer file format).
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Below this code point all Unicode versions agree on the classes in WORDS.
STABLE = "՘"
#: Pieces, characters of pieces, and token pairs that a worker remembers before it starts anew.
CACHE_WORDS, CACHE_CHARS, CACHE_PAIRS = 500_000, 8_000_000, 600_000
#: Bytes of text that are encoded at a time.
BATCH_CHARS = 2_000_000
MAX_FILE = 64 << 20


def byte_alphabet() -> dict[str, int]:
    """Printable stand-in character of every byte, as byte-level files write them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class TrieBPE:
    """Byte-level BPE from the text of a ``tokenizers`` JSON file."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model, self.added = spec["model"], {}
        pre = spec.get("pre_tokenizer") or {}
        if model["type"] != "BPE" or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or spec.get("normalizer"):
            raise ValueError("a byte-level BPE file without normalizer or prefix space is needed")
        alphabet = byte_alphabet()
        vocab = {bytes(alphabet[c] for c in k): v for k, v in model["vocab"].items()}
        for a in spec.get("added_tokens", []):
            if a["lstrip"] or a["rstrip"] or a["single_word"] or a["normalized"] and spec.get("normalizer"):
                raise ValueError("added tokens with strip or single-word flags are not supported")
            self.added[a["content"]] = a["id"]
        size = 1 + max([*vocab.values(), *self.added.values()])
        self.bytes_of: list[bytes] = [b""] * size
        for b, i in vocab.items():
            self.bytes_of[i] = b
        for content, i in self.added.items():
            known = all(c in alphabet for c in content)
            self.bytes_of[i] = bytes(alphabet[c] for c in content) if known else content.encode()
        self.vocab, self.shift = vocab, size.bit_length()
        self.rank: dict[int, int] = {}
        self.left, self.right = [-1] * size, [-1] * size
        self.made = [-1] * size
        for rank, merge in enumerate(model["merges"]):
            a, b = merge.split(" ") if isinstance(merge, str) else merge
            x, y = (vocab[bytes(alphabet[c] for c in s)] for s in (a, b))
            t = vocab[self.bytes_of[x] + self.bytes_of[y]]
            self.rank.setdefault(x << self.shift | y, rank)
            if self.made[t] < 0:
                self.left[t], self.right[t], self.made[t] = x, y, rank
        if any(len(b) > 1 and self.made[i] < 0 for b, i in vocab.items()):
            raise ValueError("a token longer than a byte has no merge")
        self.prefixes = {b[:n] for b in vocab for n in range(1, len(b) + 1)}
        self.can_follow: dict[int, bool] = {}
        #: Suffix automaton over token beginnings: texts of states, tokens that end each, and steps by byte.
        self.states, self.state_of, self.ends, self.steps = [b""], {b"": 0}, [()], {}
        self.lengths = [len(b) for b in self.bytes_of]
        self.find = regex.compile(WORDS).findall
        self.split_added = regex.compile("|".join(regex.escape(c) for c in sorted(self.added, key=len, reverse=True))) if self.added else None
        self._library = self.coder = None

    def _fits(self, a: int, b: int) -> bool:
        """Whether BPE leaves ``a`` and ``b`` as they are when they stand side by side."""
        left, right, made, rank = self.left, self.right, self.made, self.rank
        x, x_ends = a, 1 << 60
        while x >= 0:
            y, y_ends = b, 1 << 60
            while y >= 0:
                # x and y touch from the later of their beginnings to the earlier of their ends;
                # of two equal merges the one further left comes first.
                r = rank.get(x << self.shift | y)
                if r is not None and r < x_ends and r <= y_ends:
                    return False
                y_ends, y = made[y], left[y]
            x_ends, x = made[x], right[x]
        return True

    def _step(self, state: int, byte: int) -> int:
        """The state after one more byte: the longest suffix that begins a token; made when first asked for."""
        text = self.states[state] + bytes((byte,))
        while text not in self.prefixes:
            text = text[1:]
            if not text:
                raise ValueError("this vocabulary has no token for a byte")
        after = self.state_of.get(text)
        if after is None:
            after = self.state_of[text] = len(self.states)
            self.states.append(text)
            ends = (self.vocab.get(text[i:]) for i in range(len(text)))
            self.ends.append(tuple((self.lengths[t], t) for t in ends if t is not None))
        self.steps[state << 8 | byte] = after
        return after

    def encode_words(self, words: Iterable[str]) -> dict[str, list[int]]:
        """Ids of distinct words, by one depth-first walk over their trie.

        The walk keeps, for every prefix of the current word, its last token
        and which tokens may end there: those that end the longest suffix that
        begins a token, longest first.
        """
        known, shift, lengths, steps, ends = self.can_follow, self.shift, self.lengths, self.steps, self.ends
        if len(known) > CACHE_PAIRS:
            known.clear()
        last, state, before, out = [-1], [0], b"", {}
        for raw, word in sorted((w.encode(), w) for w in words):
            at, most = 0, min(len(raw), len(before))
            while at < most and raw[at] == before[at]:
                at += 1
            del last[at + 1 :], state[at + 1 :]
            now = state[at]
            for end, byte in enumerate(raw[at:], at + 1):
                after = steps.get(now << 8 | byte)
                now = self._step(now, byte) if after is None else after
                state.append(now)
                for size, token in ends[now]:
                    if size == end:
                        break
                    pair = last[end - size] << shift | token
                    ok = known.get(pair)
                    if ok is None:
                        ok = known[pair] = self._fits(last[end - size], token)
                    if ok:
                        break
                last.append(token)
            ids, end = [], len(raw)
            while end:
                ids.append(last[end])
                end -= lengths[last[end]]
            ids.reverse()
            out[word] = ids
            before = raw
        return out

    def _pretokens(self, piece: str) -> list[str]:
        if max(piece, default="") < STABLE:
            return self.find(piece)
        if self._library is None:
            from tokenizers.pre_tokenizers import ByteLevel

            self._library = ByteLevel(add_prefix_space=False).pre_tokenize_str
        return [piece[a:b] for _, (a, b) in self._library(piece)]

    def encode_many(self, pieces: list[str]) -> list[list[int]]:
        """Ids of whole texts or of pieces that no pre-token crosses."""
        parsed: list[list] = []
        missing: set[str] = set()
        for piece in pieces:
            parts: list = []
            at = 0
            for m in self.split_added.finditer(piece) if self.split_added else ():
                parts += self._pretokens(piece[at : m.start()]) if m.start() > at else []
                parts.append(self.added[m[0]])
                at = m.end()
            parts += self._pretokens(piece[at:]) if at else self._pretokens(piece)
            parsed.append(parts)
            missing.update(p for p in parts if isinstance(p, str))
        fresh = self.encode_words(missing)
        out = []
        for parts in parsed:
            ids: list[int] = []
            for p in parts:
                ids += (p,) if isinstance(p, int) else fresh[p]
            out.append(ids)
        return out

    def forget(self) -> None:
        if self.coder:
            self.coder.forget()

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids; bytes that are no UTF-8 become U+FFFD, unknown ids nothing."""
        table = self.bytes_of
        try:
            raw = b"".join(map(table.__getitem__, ids))
        except IndexError:
            raw = b"".join(table[i] for i in ids if i < len(table))
        return raw.decode("utf-8", "replace")


class ChunkCoder:
    """Encodes texts through their distinct pieces between blanks and newlines.

    In a text where every blank and newline is followed by something that isn't
    white space, no pre-token reaches across one of them, except that a blank
    goes with what follows.  Such texts are cut before their blanks and
    newlines, each distinct piece is encoded once, and a document's ids are
    gathered from the pieces' ids.  All other texts are encoded as a whole.

    ``encode_flat`` takes pieces and returns all their ids, one after the
    other, and the number of ids of each piece.
    """

    def __init__(self, encode_flat: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], dtype: str = "<u4", cache_words: int = CACHE_WORDS):
        self.encode_flat, self.dtype, self.most = encode_flat, dtype, cache_words
        self.forget()

    def forget(self) -> None:
        #: Place of each piece: without its blank, with its newline, or with a zero before it where it begins a text.
        self.at: dict[str, int] = {}
        self.chars = self.used = 0
        self.flat = np.empty(1 << 16, self.dtype)
        self.start, self.size = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)
        self.odd = np.zeros(1 << 12, bool)

    def _learn(self, keys: list[str]) -> None:
        ids, sizes = self.encode_flat([k[1:] if k[:1] == "\0" else k if k[:1] == "\n" else " " + k for k in keys])
        n, to = len(self.at), len(self.at) + len(keys)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while to > len(self.start):
            self.start, self.size, self.odd = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size, self.odd))
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n:to] = self.used + np.cumsum(sizes) - sizes
        self.size[n:to] = sizes
        self.odd[n:to] = [len(k) < 2 or k[1].isspace() if k[:1] in ("\0", "\n") else not k or k[0].isspace() for k in keys]
        self.used += len(ids)
        self.chars += sum(map(len, keys))
        self.at.update(zip(keys, range(n, to)))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self.at) > self.most or self.chars > CACHE_CHARS * self.most / CACHE_WORDS:
            self.forget()
        keyed = [text.replace("\n", " \n").split(" ") for text in texts]
        for own in keyed:
            own[0] = "\0" + own[0]
        fresh = set().union(*keyed) - self.at.keys()
        self._learn(list(fresh)) if fresh else None
        counts = np.fromiter(map(len, keyed), np.int64, len(keyed))
        where = np.fromiter(map(self.at.__getitem__, chain.from_iterable(keyed)), np.int64, int(counts.sum()))
        ends = np.cumsum(counts)
        sizes = self.size[where]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        ids = self.flat[np.repeat(self.start[where] - upto[:-1], sizes) + np.arange(upto[-1])]
        odd = np.concatenate([[0], np.cumsum(self.odd[where])])
        out: list = []
        begin = 0
        for text, end in zip(texts, ends.tolist()):
            whole = text and odd[end] > odd[begin] or "\0" in text
            out.append(None if whole else ids[upto[begin] : upto[end]])
            begin = end
        for i in [i for i, x in enumerate(out) if x is None]:
            out[i] = np.array(self.encode_flat([texts[i]])[0], self.dtype)
        return out


def flat_lists(ids: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    sizes = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), np.int64, int(sizes.sum())), sizes


def text_batches(texts: pa.Array, chars: int = BATCH_CHARS) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) with about ``chars`` bytes each; null counts as empty."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        before = upto[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(upto, before + chars)))
        yield begin, [t or "" for t in texts.slice(begin, end - begin).to_pylist()]
        begin = end


def tidy(run: Callable, keep: bool = False) -> Callable:
    """``run`` for ``mapInArrow``; afterwards the worker, which stays for later tasks, gives its memory back.

    With ``keep`` it remembers its encodings for the next task.
    """

    def whole(batches):
        try:
            yield from run(batches)
        finally:
            for made in () if keep else _LOADED.values():
                getattr(made, "forget", lambda: None)()
            gc.collect()
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not every C library has it
                ctypes.CDLL(None).malloc_trim(0)

    return whole


_LOADED: dict[str, object] = {}


def once(key: str, make: Callable):
    """One object per worker process, so that its cache lives on between tasks."""
    if key not in _LOADED:
        if len(_LOADED) > 3:
            _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def tokenizer_text(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        text = f.read(MAX_FILE + 1)
    if len(text) > MAX_FILE:
        raise ValueError(f"{path} is over {MAX_FILE} characters")
    return text


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens, ids binary)``: ids as little-endian unsigned 32-bit integers.

    A map without any shuffle: every document is encoded where it was read.
    Null and empty texts have no tokens; repeated rows are encoded one by one;
    no other column is read, so clashing names don't matter; an empty table
    gives an empty table.  The tokenizer file (at most 64 MB) is broadcast.
    """
    return _map_ids(docs, tokenizer, id_col, text_col, "n_tokens long, ids binary", lambda bpe, ids: (ids.astype("<u4").tobytes(),))


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", more: Sequence[str] = ()) -> DataFrame:
    """``(doc_id, n_tokens, ids_sha256, decoded_sha256)`` of the encoded and again decoded texts, and the columns ``more`` as they are."""

    def make(bpe: TrieBPE, ids: np.ndarray) -> tuple:
        raw = ids.astype("<u4").tobytes()
        text = bpe.decode(np.frombuffer(raw, "<u4").tolist())
        return hashlib.sha256(raw).hexdigest(), hashlib.sha256(text.encode()).hexdigest()

    return _map_ids(docs, tokenizer, id_col, text_col, "n_tokens long, ids_sha256 string, decoded_sha256 string", make, more)


def _map_ids(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, columns: str, make: Callable, more: Sequence[str] = ()) -> DataFrame:
    spark = docs.sparkSession
    own = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"), *more)
    shared = spark.sparkContext.broadcast(tokenizer_text(tokenizer))
    made_here = T.StructType.fromDDL(columns)
    schema = T.StructType([own.schema["doc_id"], *made_here, *own.schema.fields[2:]])
    arrow = pa.schema([("n_tokens", pa.int64()), *((f.name, pa.binary() if f.dataType == T.BinaryType() else pa.string()) for f in made_here.fields[1:])])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(hashlib.sha256(shared.value.encode()).hexdigest(), lambda: TrieBPE(shared.value))
        if bpe.coder is None:
            bpe.coder = ChunkCoder(lambda pieces: flat_lists(bpe.encode_many(pieces)))
        for batch in batches:
            for begin, texts in text_batches(batch.column("text")):
                ids = bpe.coder.encode(texts)
                rows = [(len(i), *make(bpe, i)) for i in ids]
                made = [pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)]
                kept = [batch.column(c).slice(begin, len(texts)) for c in ("doc_id", *more)]
                yield pa.RecordBatch.from_arrays([kept[0], *made, *kept[1:]], names=schema.names)

    return own.mapInArrow(tidy(run), schema)


def decode(encoded: DataFrame, tokenizer: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """``(doc_id, text)`` from ids as :func:`encode` returns them; null ids give a null text."""
    spark = encoded.sparkSession
    own = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))
    shared = spark.sparkContext.broadcast(tokenizer_text(tokenizer))
    schema = T.StructType([own.schema["doc_id"], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = once(hashlib.sha256(shared.value.encode()).hexdigest(), lambda: TrieBPE(shared.value))
        for batch in batches:
            texts = [None if b is None else bpe.decode(np.frombuffer(b, "<u4").tolist()) for b in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=schema.names)

    return own.mapInArrow(tidy(run), schema)
