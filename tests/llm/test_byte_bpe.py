from __future__ import annotations

import base64
import hashlib
import random

import numpy as np
import pytest
from conftest import ODD_TEXTS

from topoeval.llm import byte_bpe
from topoeval.llm.queries import tokenizer

PATH = tokenizer("byte_bpe_50k.tiktoken")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'s", "'re", "'S", "1", "²", "é", "ß", "中", "文", "　", "\x85", "\xa0", "\x1c", "😀", "\U0001e030", "ａ", "٣", "!", "...", "the", "ing", " ", "ʰ", "̀", "\x00", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, "rb") as f:
        return byte_bpe.RankVocabulary(f.read(), byte_bpe.character_classes())


def texts():
    rng = random.Random(5)
    out = ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    out += ["".join(chr(rng.choice([rng.randint(0, 0x2FF), rng.randint(0, 0xD7FF), rng.randint(0xE000, 0x10FFFF)])) for _ in range(40)) for _ in range(1000)]
    out += ["a" * n for n in (1, 2, 3, 100, 5000)] + ["ab" * 3000, " " * 3000 + "x", "\n" * 999, "aaaab" * 500, "".join(rng.choice("ab") for _ in range(5000))]
    return out


def test_equal_to_the_library(vocabulary, library):
    for x in texts():
        assert vocabulary.encode(x) == np.array(library.encode_ordinary(x), "<u4").tobytes(), x


def test_pieces_of_a_long_text(vocabulary, library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "SLICE_CHARS", 7)
    for x in texts()[:1500]:
        assert vocabulary.encode(x) == np.array(library.encode_ordinary(x), "<u4").tobytes(), x


def test_neighbours_decide(vocabulary):
    """A sequence is what the merges give exactly if each pair of neighbours is."""
    rng = random.Random(2)
    for _ in range(300):
        word = "".join(rng.choice("abrtiones ") for _ in range(rng.randint(2, 14)))
        want = [vocabulary.ranks[t] for t in vocabulary.merged(word)]
        assert vocabulary.encode_word(word) == want
        assert all(vocabulary.compatible(a, b) for a, b in zip(want, want[1:], strict=False))


def test_backtracking_is_used_and_linear(vocabulary):
    asked = []
    real = vocabulary.longest
    vocabulary.longest = lambda w, at: asked.append(at) or real(w, at)
    try:
        n = 20_000
        rng = random.Random(1)
        word = "".join(rng.choice("aeinorst") for _ in range(n))
        vocabulary.encode_word(word)
    finally:
        del vocabulary.longest
    assert any(b <= a for a, b in zip(asked, asked[1:], strict=False))
    assert len(asked) <= 2 * n


def test_operators_on_odd_texts(odd, none, library):
    want = sorted((i if i is not None else -1, tuple(library.encode_ordinary(t or ""))) for i, t in [*enumerate(ODD_TEXTS), *((100 + k, t) for k, t in enumerate(ODD_TEXTS)), (None, "n")])
    encoded = byte_bpe.byte_encode(odd, PATH)
    got = encoded.collect()
    assert sorted((r.doc_id if r.doc_id is not None else -1, tuple(r.ids)) for r in got) == want
    decoded = byte_bpe.byte_decode(encoded, PATH).collect()
    plain = {r.doc_id: r.text or "" for r in odd.collect()}
    assert all(bytes(r.decoded).decode() == plain[r.doc_id] for r in decoded) and len(decoded) == len(got)
    both = {r.doc_id: r for r in byte_bpe.byte_round_trip(odd, PATH).collect()}
    assert all(np.frombuffer(both[r.doc_id].ids, "<u4").tolist() == r.ids for r in got)
    assert all(bytes(both[i].decoded).decode() == t for i, t in plain.items())
    assert byte_bpe.byte_encode(none, PATH).collect() == byte_bpe.byte_round_trip(none, PATH).collect() == []


def test_decoding_nulls_parts_of_characters_and_strange_ids(spark):
    rows = [(1, None), (2, []), (3, [158])]
    made = spark.createDataFrame(rows, "doc_id long, ids array<int>")
    got = {r.doc_id: bytes(r.decoded) for r in byte_bpe.byte_decode(made, PATH).collect()}
    assert got[1] == got[2] == b"" and len(got[3]) == 1
    with pytest.raises(Exception, match="without a token"):
        byte_bpe.byte_decode(spark.createDataFrame([(1, [10**6])], "doc_id long, ids array<int>"), PATH).collect()


def test_query(spark, tmp_path, library):
    from topoeval.llm.queries import op12_byte_bpe

    rows = [(k, t) for k, t in enumerate([None, *texts()[:40]])]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r) for r in op12_byte_bpe(spark, str(tmp_path)).collect()}
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (np.array(ids, "<u4").tobytes(), (t or "").encode())]
        assert got[i] == (i, len(ids), *sha)
