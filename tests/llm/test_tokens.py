"""BPE transducers, prefix counts and the token store against the tokenizers library."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from topoeval.llm import bpe, token_counts, token_store

WORDS = public_tokenizers.path("word_bpe_49k.json")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", "th", "ing", " ", "  ", "\n", "'s", "'ll", "'", "!", "é", "É", "ß", "İ", "Σ", "中", "1", "²", "\xa0", "\x85", "\x1c", "é", "<|endoftext|>", "<|startoftext|>", "<|", "\U0001f600", "\x00", "\t", "K", "Hello", "\r\n"]


def some_texts(n, seed):
    r = random.Random(seed)
    return ["".join(r.choice(PIECES) for _ in range(r.randint(0, 14))) for _ in range(n)]


@pytest.fixture(scope="module")
def word_library():
    return Tokenizer.from_file(WORDS)


@pytest.fixture(scope="module")
def byte_library():
    return Tokenizer.from_file(BYTES)


@pytest.fixture(scope="module")
def word_tokens():
    return bpe.word_tokenization(open(WORDS, encoding="utf-8").read())


@pytest.fixture(scope="module")
def counter():
    return token_counts.prefix_counter(open(BYTES, encoding="utf-8").read())


def test_encode_and_decode_as_library(word_tokens, word_library):
    for text in some_texts(2000, 1):
        ids = word_library.encode(text, add_special_tokens=False).ids
        assert [i for part in word_tokens.encode(text) for i in part] == ids
        d = bpe.Decoder(word_tokens)
        assert d.feed(ids[:2]) + d.feed(ids[2:]) + d.flush() == word_library.decode(ids, skip_special_tokens=False)


def test_transducer_equals_whole_merge(word_tokens):
    r = random.Random(2)
    m = word_tokens.merges
    assert 1 < m.lookahead < 1000
    for k in range(12):
        word = "".join(r.choice(["the", "ing", "and", "tion", "er", "on", "a", "in", "z"]) for _ in range(r.choice([5, 300, 2000]))).encode()
        symbols, t, out = m.symbols(word), bpe.Transducer(m), []
        for at in range(0, len(symbols), 97):  # an unfinished word, until the flush
            ids, counts = t.feed(np.array(symbols[at : at + 97], np.int32), np.empty(0, np.int64))
            assert len(counts) == 0 and len(t.held) < m.window + 97
            out += ids.tolist()
        assert len(symbols) < m.window or out  # long words are emitted before they end
        assert [*out, *t.flush().tolist()] == m.merge(symbols), k
        assert len(t.held) == 0


def test_transducer_emits_at_word_ends(word_tokens):
    m, r = word_tokens.merges, random.Random(3)
    words = ["".join(r.choice("abcdeinrst") for _ in range(r.choice([1, 2, 3, 7, 20, 64, 65, 200]))).encode() for _ in range(300)]
    symbols = [s for w in words for s in m.symbols(w)]
    ends = np.cumsum([len(w) for w in words])
    t, got, counts = bpe.Transducer(m), [], []
    cuts = sorted(r.sample(range(1, len(symbols)), 20))
    for a, b in zip([0, *cuts], [*cuts, len(symbols)], strict=True):
        inside = ends[(ends > a) & (ends <= b)] - a
        ids, n = t.feed(np.array(symbols[a:b], np.int32), inside)
        got += ids.tolist()
        counts += n.tolist()
    assert got == [i for w in words for i in m.merge(m.symbols(w))]
    assert len(counts) == len(words) and len(t.held) == 0


def test_all_words_go_through_the_transducer(word_tokens, monkeypatch):
    fed = []
    feed = bpe.Transducer.feed

    def watched(self, symbols, ends):
        fed.append(len(ends))
        return feed(self, symbols, ends)

    monkeypatch.setattr(bpe.Transducer, "feed", watched)
    monkeypatch.setattr(word_tokens, "known", {})
    ((n, _, _),) = word_tokens.digests(["some words, SOME more"])
    assert n == 5 and fed == [4]  # some , words more


def test_byte_state_machine(word_tokens):
    m = word_tokens.merges
    text = "中\U0001f600x"
    ids = m.symbols(text.encode())  # one token for each byte: characters are spread over tokens
    d = bpe.Decoder(word_tokens, library=False)
    assert "".join(d.feed([i]) for i in ids) + d.flush() == text
    d = bpe.Decoder(word_tokens, library=False)
    assert d.feed(ids[:2]) + d.flush() == "�"


def test_round_trip_operator(odd, none, word_library):
    got = sorted((tuple(r) for r in bpe.bpe_round_trip(odd, WORDS).collect()), key=str)
    want = []
    for r in odd.collect():
        ids = word_library.encode(r.text or "", add_special_tokens=False).ids
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (" ".join(map(str, ids)), word_library.decode(ids, skip_special_tokens=False))]
        want.append((r.doc_id, len(ids), *sha))
    assert got == sorted(want, key=str)
    assert bpe.bpe_round_trip(none, WORDS).count() == 0


def test_encode_decode_operators(docs):
    df = docs([(1, "hello  World 12"), (2, None), (3, "naïve café")])
    text = {r.doc_id: r.text for r in bpe.bpe_decode(bpe.bpe_encode(df, WORDS), WORDS).collect()}
    assert text == {1: "hello world 1 2", 2: "", 3: "naïve café"}


def test_counts_as_library(counter, byte_library):
    for text in some_texts(2000, 3):
        assert sum(sum(c) for _, _, c in counter.counts(text)) == len(byte_library.encode(text, add_special_tokens=False).ids), repr(text)


def test_every_prefix(counter, byte_library):
    for text in some_texts(400, 4):
        want = [len(byte_library.encode(text[:p], add_special_tokens=False).ids) for p in range(len(text) + 1)]
        assert counter.prefix_counts(text).tolist() == want, repr(text)
        for budget in (0, 1, 3):
            assert counter.fit(text, budget) == max(p for p, n in enumerate(want) if n <= budget)


def test_counts_operator(odd, none, byte_library):
    got = sorted((tuple(r) for r in token_counts.token_counts(odd, BYTES, 5).collect()), key=str)
    want = []
    for r in odd.collect():
        n = len(byte_library.encode(r.text or "", add_special_tokens=False).ids)
        want.append((r.doc_id, len((r.text or "").encode()), n, n > 5))
    assert got == sorted(want, key=str)
    assert token_counts.token_counts(none, BYTES).count() == 0


def test_truncation(docs, byte_library):
    df = docs([(1, "one two three four five"), (2, None), (3, "x")])
    got = {r.doc_id: (r.text, r.cut) for r in token_counts.truncated(df, BYTES, 3).collect()}
    assert got == {1: ("one two three", True), 2: ("", False), 3: ("x", False)}
    counts = {r.doc_id: r.counts for r in token_counts.prefix_counts(df, BYTES).collect()}
    assert counts[2] == [0] and counts[3] == [0, 1]


# --- token store --------------------------------------------------------------------------


@pytest.mark.parametrize("n", [1, 2, 3, 50, 3000])
def test_huffman(n):
    ids = np.minimum(np.random.default_rng(n).zipf(1.2, 9000), n).astype(np.int64) - 1
    lengths = token_store.code_lengths(np.bincount(ids, minlength=n), 12)
    assert lengths.max() <= 12 and (2.0 ** -lengths[lengths > 0].astype(float)).sum() <= 1
    bits, steps = token_store.pack(ids, lengths, token_store.code_words(lengths))
    assert (token_store.unpack(bits, steps, len(ids), lengths.tobytes()) == ids).all()


def test_lengths_are_optimal():
    assert token_store.code_lengths(np.array([1, 1, 2, 4, 8, 0])).tolist() == [4, 4, 3, 2, 1, 0]
    assert token_store.code_lengths(np.array([1, 1, 2, 4, 8]), 3).tolist() == [3, 3, 3, 3, 1]


def test_crc_of_parts():
    a, b = b"abc" * 77, bytes(range(256)) * 3
    assert token_store.crc32_join(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    assert token_store.crc32_join(zlib.crc32(a), zlib.crc32(b""), 0) == zlib.crc32(a)


@pytest.mark.parametrize("block", [7, 1 << 16])
def test_store(spark, docs, tmp_path, byte_library, block):
    rows = [(k * 7 % 50, t) for k, t in enumerate([*some_texts(40, 6), None, "", "long " * 400])]
    path = str(tmp_path / "store")
    token_store.write_tokens(docs(rows), path, BYTES, block=block)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in token_store.read_summary(spark, path).collect()}
    at, want = 0, {}
    for i, t in sorted(rows):
        ids = [*byte_library.encode(t or "", add_special_tokens=False).ids, 2]
        want[i] = (at, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        at += len(ids)
    assert got == want
    parts = sorted((r.doc_id, r.at, r.ids) for r in token_store.read_tokens(spark, path).collect())
    whole = {}
    for i, _, ids in parts:
        whole[i] = whole.get(i, []) + list(ids)
    assert whole == {i: [*byte_library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in rows}


def test_store_odd(odd, none, byte_library):
    got = sorted((r.start, str(r.doc_id), r.n_tokens, r.ids_crc32) for r in token_store.round_trip(odd, BYTES).collect())
    rows, want = odd.collect(), []
    for r in rows:
        ids = [*byte_library.encode(r.text or "", add_special_tokens=False).ids, 2]
        want.append((str(r.doc_id), len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    assert sorted(x[1:] for x in got) == sorted(want)
    assert got[0][1] == "None" and [int(x[1]) for x in got[1:]] == sorted(r.doc_id for r in rows if r.doc_id is not None)
    assert [x[0] for x in got] == [sum(x[2] for x in got[:k]) for k in range(len(got))]
    assert token_store.round_trip(none, BYTES).count() == 0


def test_encoder_as_library(byte_library):
    r = random.Random(8)
    plain = ["a", "th", "ing", " b", " The", "\n", "\n\n", "'s", "'ll", "!", "é", " É", "1", " 2", "\t", " 中", ","]
    some = some_texts(1500, 9) + ["".join(r.choice(plain) for _ in range(r.randint(0, 14))) for _ in range(1500)]
    encoder = token_store._encoder(open(BYTES, encoding="utf-8").read())
    for text, ids in zip(some, encoder.encode(some, 2), strict=True):
        assert np.frombuffer(ids, "<u2").tolist() == [*byte_library.encode(text, add_special_tokens=False).ids, 2], repr(text)
