"""Byte BPE and packing against the public libraries and the definition."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

from sessionflow.llm import byte_bpe, packing, word_bpe
from sessionflow.llm.word_bpe import WordBpe

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")
ODD = ["", "a", " a", " \n  b  c ", "x" * 3000, "😀é ひらがな don't we'll     x\t\ty\n\n",
       "ab" * 700 + " " + "!" * 900, "aaaaab" * 200, "a b c", "İSTANBUL ΣΑΣ ²½ ﬁ é",
       "<|endoftext|> a<|startoftext|>b", "12345 1a2b 'S 'LL don'T"]


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _random_texts(n: int) -> list[str]:
    r = random.Random(3)
    return ["".join(r.choice("aab bé \n\t.!1ñ'sＡ中") for _ in range(r.randint(0, 60))) for _ in range(n)]


def test_byte_bpe_equals_the_library(reference):
    codec = byte_bpe.ByteBpe.load(RANKS, public_tokenizers.PATTERN)
    texts = ODD + _random_texts(500)
    for _ in range(2):  # cold and cached
        flat, counts = codec.encode_batch(texts)
        ends = np.cumsum(counts)
        for t, e, c in zip(texts, ends, counts, strict=True):
            ids = flat[e - c : e]
            assert ids.tolist() == reference.encode_ordinary(t), t
            assert codec.decode(ids) == t.encode()


def test_word_bpe_equals_the_library():
    library, codec = Tokenizer.from_file(WORDS), WordBpe(WORDS)
    texts = ODD + _random_texts(300)
    flat, counts = codec.encode_batch(texts)
    ends = np.cumsum(counts)
    for t, e, c in zip(texts, ends, counts, strict=True):
        assert flat[e - c : e].tolist() == library.encode(t, add_special_tokens=False).ids, t


def test_words_are_remembered_by_hash_within_bounds(monkeypatch):
    monkeypatch.setattr(word_bpe, "CACHE_WORDS", 150)
    monkeypatch.setattr(word_bpe, "CACHE_LETTERS", 6)
    monkeypatch.setattr(word_bpe, "LOOKUP_CHARS", 700)
    library, codec = Tokenizer.from_file(WORDS), WordBpe(WORDS)
    held = {k: id(v) for k, v in vars(codec).items()}
    words, sizes = codec.cache(), []
    for part in (ODD, _random_texts(300), [], [""], _random_texts(300), ODD):
        flat, counts = codec.encode_batch(part, words)
        assert len(counts) == len(part) and counts.sum() == len(flat)
        ends = np.cumsum(counts)
        for t, e, c in zip(part, ends, counts, strict=True):
            assert flat[e - c : e].tolist() == library.encode(t, add_special_tokens=False).ids, t
        sizes.append(len(words._counts))
    assert 0 < max(sizes) < 600 and len(words._keys) < sizes[-1]  # started over; long words have no key
    # the codec, which a worker keeps, remembers no word
    assert {k: id(v) for k, v in vars(codec).items()} == held and not hasattr(codec, "_cache")


def test_byte_bpe_rows(spark, edge_docs, no_docs, reference):
    out = byte_bpe.encode_digests(edge_docs, RANKS, public_tokenizers.PATTERN)
    assert out.count() == edge_docs.count()
    want = sorted(
        (hashlib.sha256(np.array(reference.encode_ordinary(r.text or ""), "<u4").tobytes()).hexdigest(),
         hashlib.sha256((r.text or "").encode()).hexdigest())
        for r in edge_docs.collect()
    )
    assert sorted((r.ids_sha256, r.decoded_sha256) for r in out.collect()) == want
    assert byte_bpe.encode_digests(no_docs, RANKS, public_tokenizers.PATTERN).count() == 0
    ids = byte_bpe.encode(edge_docs, RANKS, public_tokenizers.PATTERN).collect()
    assert all(bytes(reference.decode_bytes(r.ids)) == r.decoded for r in ids)


def _check_packing(rows, capacity):
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_packing_rows(spark, edge_docs, no_docs):
    library = Tokenizer.from_file(WORDS)
    rows = packing.pack_documents(edge_docs, WORDS, 64).collect()
    want = []
    for r in edge_docs.collect():
        ids = [*library.encode(r.text or "", add_special_tokens=False).ids, 0]
        for k, at in enumerate(range(0, len(ids), 64)):
            cut = ids[at : at + 64]
            want.append((r.doc_id, k, at, len(cut), zlib.crc32(np.array(cut, "<u4").tobytes())))
    key = lambda x: tuple(-1 if v is None else v for v in x)
    got = [(r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows]
    assert sorted(got, key=key) == sorted(want, key=key)
    total = sum(r.length for r in rows)
    assert _check_packing(rows, 64) <= -(-total // 64) + 2
    assert packing.pack_documents(no_docs, WORDS, 64).count() == 0


def test_plan_follows_best_fit_decreasing():
    r = random.Random(1)
    for _ in range(50):
        histogram = {r.randint(1, 30): r.randint(1, 40) for _ in range(12)}
        plan = packing.plan_slots(histogram, 30)
        placed: dict[int, list] = {}
        seen = {length: [] for length in histogram}
        for length, a, b, first, per, offset in plan:
            seen[length] += range(a, b)
            for k in range(b - a):
                placed.setdefault(first + k // per, []).append((offset + k % per * length, length))
        assert all(sorted(v) == list(range(histogram[n])) for n, v in seen.items())
        for places in placed.values():
            at = 0
            for offset, length in sorted(places):
                assert offset == at
                at += length
            assert at <= 30
        # document by document: the fullest sequence that has room
        rooms: list[int] = []
        for length in sorted(histogram, reverse=True):
            for _ in range(histogram[length]):
                fits = [i for i, room in enumerate(rooms) if room >= length]
                if fits:
                    rooms[min(fits, key=lambda i: rooms[i])] -= length
                else:
                    rooms.append(30 - length)
        assert len(placed) == len(rooms)
