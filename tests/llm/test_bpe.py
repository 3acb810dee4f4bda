import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from seglark.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
BITS = ["a", "aa", "the", " ", "  ", "\n", "\t", "'s", "'ll", "é", "日本", "<|endoftext|>", "1", "23", "!!", " ", "　", "😀", "ing", "tion", "\U00018d80", "\x1c", "\x85", "'", "\0", "\0x"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def own():
    return bpe.TrieBPE(bpe.tokenizer_text(PATH))


def test_same_ids_as_library(own, library):
    rng = random.Random(5)
    texts = ["".join(rng.choice(BITS) for _ in range(rng.randrange(25))) for _ in range(3000)]
    coder = bpe.ChunkCoder(lambda pieces: bpe.flat_lists(own.encode_many(pieces)))
    for text, ids, other in zip(texts, coder.encode(texts), library.encode_batch(texts, add_special_tokens=False)):
        assert ids.tolist() == other.ids, text
        assert own.decode(ids.tolist()) == library.decode(other.ids, skip_special_tokens=False) == text


def test_every_token_and_random_bytes(own, library):
    rng = random.Random(6)
    ids = [rng.randrange(50_257) for _ in range(2000)]
    assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
    assert own.decode([60_000]) == ""
    singles = [own.bytes_of[i].decode("utf-8", "ignore") for i in range(50_256)]
    for text, got, other in zip(singles, own.encode_many(singles), library.encode_batch(singles, add_special_tokens=False)):
        assert got == other.ids, text


def test_shared_prefixes_once(own):
    calls = []
    fits = own._fits
    own._fits = lambda a, b: calls.append((a, b)) or fits(a, b)
    own.can_follow.clear()
    own.encode_words(["qwzx", "qwzxa", "qwzxab"])
    first = len(calls)
    own.encode_words(["qwzxab"])
    own._fits = fits
    assert first and len(calls) == first


def test_operator(spark, edges, empty, library):
    rows = bpe.digests(edges, PATH).collect()
    texts = [r["text"] for r in edges.collect()]
    expected = sorted((r["doc_id"] is not None, r["doc_id"] or 0, hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r, t in zip(edges.collect(), texts))
    assert sorted((r["doc_id"] is not None, r["doc_id"] or 0, r["ids_sha256"]) for r in rows) == expected
    back = bpe.decode(bpe.encode(edges, PATH), PATH).collect()
    assert sorted(r["text"] for r in back) == sorted(t or "" for t in texts)
    assert bpe.digests(empty, PATH).collect() == []


def test_other_files_are_refused():
    with pytest.raises(ValueError):
        bpe.TrieBPE(bpe.tokenizer_text(public_tokenizers.path("word_bpe_49k.json")))
