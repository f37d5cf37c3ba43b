from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from topoeval.llm import periodic
from topoeval.llm.queries import op11_periodic_runs

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def by_hand(words):
    """Every period, every place: (start, period, length) of all runs."""
    n, out = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i < n - q:
            if words[i] != words[i + q]:
                i += 1
                continue
            e = i
            while e < n - q and words[e] == words[e + q]:
                e += 1
            length = e - i + q
            if length >= max(12, 2 * q):
                run = words[i : i + length]
                if not any(all(run[k] == run[k + d] for k in range(length - d)) for d in range(1, q)):
                    out.append((i, q, length))
            i = e
    return sorted(out)


def collapsed(words, runs):
    gone = {k for s, q, n in runs for k in range(s + q, s + n)}
    return " ".join(w for k, w in enumerate(words) if k not in gone)


def cases(seed, count, longest):
    rng = random.Random(seed)
    out = [[], ["a"], ["a"] * 11, ["a"] * 12, ["a"] * 400, ["a", "b"] * 6, list("abcabcabcabc") * 7, ["a"] * 30 + ["b"] + ["a"] * 30]
    fib = ["a", "b"]
    while len(fib) < 300:
        fib += fib[: len(fib) - 1] if len(fib) > 2 else ["a"]
    out.append(fib)
    for _ in range(count):
        words = []
        while len(words) < rng.randint(0, longest):
            kind, block = rng.random(), [rng.choice("abcdefgh"[: rng.randint(1, 8)]) for _ in range(rng.randint(1, 40))]
            words += block * rng.randint(2, 6) if kind < 0.5 else [str(rng.random()) for _ in range(rng.randint(1, 30))]
            if kind > 0.9 and words:
                words += words[-rng.randint(1, len(words)) :]
        out.append(words)
    return out


def test_intervals_against_brute_force():
    for words in cases(1, 250, 300):
        codes = np.array([*map(hash, words)], np.int64) >> 1
        rows = periodic.intervals(codes & 0xFFFFFFF, periodic.FIRST, periodic.largest_scale(len(words)))
        found = sorted((a, q, e - a + q) for q, a, e in rows.tolist() if e - a + q >= max(12, 2 * q))
        assert found == by_hand(words), words


def test_z_function():
    rng = random.Random(3)
    for _ in range(300):
        x = [rng.choice("ab") for _ in range(rng.randint(1, 40))]
        full = [0] + [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(1, len(x))]
        assert periodic.z_function(x, len(x)) == full


@pytest.mark.parametrize("tile", [16, 64, periodic.TILE])
def test_operator_against_brute_force(docs, tile):
    texts = [" ".join(w) for w in cases(tile, 40, 500)]
    rows = [(k, t) for k, t in enumerate(texts)] + [(0, texts[-1]), (0, texts[-1]), (None, texts[-2]), (None, texts[-3])]
    got = periodic.periodic_runs(docs(rows), tile=tile).collect()
    assert len(got) == len(rows)
    want = []
    for i, t in rows:
        runs = by_hand(t.split(" ") if t else [])
        want.append((i, len(WORD.findall(t)), runs, collapsed(WORD.findall(t), runs)))
    key = lambda r: (r[0] is None, r[0] or 0, r[3], str(r[2]))
    assert sorted([(r.doc_id, r.n_words, [(x.start, x.period, x.length) for x in r.runs], r.collapsed) for r in got], key=key) == sorted(want, key=key)


def test_odd_texts(odd, none):
    got = periodic.periodic_runs(odd, tile=256).collect()
    assert len(got) == odd.count()
    by_text = {r.doc_id: r for r in got}
    assert by_text[0].collapsed == "" and by_text[0].runs == []
    assert [tuple(x) for x in by_text[9].runs] == [(0, 1, 30_000)] and by_text[9].collapsed == "word"
    assert by_text[10].collapsed == "\x00\x1c\x85 \xa0."
    assert periodic.periodic_runs(none).collect() == []


def test_query_against_brute_force(spark, tmp_path):
    rng = random.Random(9)
    rows = [(k, None if k == 7 else " \n".join(rng.choice(["x", "y", "zz", "é"]) for _ in range(rng.randint(0, 60)))) for k in range(120)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: tuple(r) for r in op11_periodic_runs(spark, str(tmp_path)).collect()}
    for i, text in rows:
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(i).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if k < a else words[a + (k - a) % p] for k, w in enumerate(words)]
        runs = by_hand(words)
        s, q, length = min(runs, key=lambda r: (-r[2], r[0], r[1])) if runs else (None,) * 3
        lines = "".join(f"{s},{n},{q}\n" for s, q, n in runs)
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in (lines, collapsed(words, runs))]
        assert got[i] == (i, len(runs), s, length, q, 1000 * length // q if runs else None, *sha)
