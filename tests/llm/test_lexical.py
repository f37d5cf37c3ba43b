from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from conftest import ODD_TEXTS

from topoeval.llm import lexical

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def by_hand(rows, items, top):
    docs = [(i, Counter(terms(t))) for i, t in rows]
    docs = [(i, c, sum(c.values())) for i, c in docs if c]
    n_docs, words, df = len(docs), sum(n for _, _, n in docs), Counter(t for _, c, _ in docs for t in c)
    held = {}
    for i, t in items:
        held.setdefault(i, set()).update(terms(t))
    out = []
    for item, its in held.items():
        found = []
        for i, c, n in docs:
            m = 100 - 50 + 50 * n * n_docs // words
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m)) for t in its if t in c
            )
            if score > 0:
                found.append((score, i))
        found.sort(key=lambda r: (-r[0], r[1] is not None, r[1] or 0))
        out += [(item, k, i, score) for k, (score, i) in enumerate(found[:top], 1)]
    return out


def drawn(seed, n, words=40):
    rng = random.Random(seed)
    pool = [f"w{int(rng.paretovariate(0.7))}" for _ in range(words * 30)]
    return [" ".join(rng.choice(pool) for _ in range(rng.randint(0, words))) for _ in range(n)]


key = lambda r: (str(r[0]), r[1])


@pytest.mark.parametrize(("top", "leaf", "tree_docs"), [(50, 64, 65_536), (3, 4, 50), (7, 1, 200)])
def test_against_brute_force(spark, docs, monkeypatch, top, leaf, tree_docs):
    monkeypatch.setattr(lexical, "LEAF", leaf)
    monkeypatch.setattr(lexical, "TREE_DOCS", tree_docs)
    texts = drawn(top, 700)
    texts += texts[:5] * 40 + ODD_TEXTS  # copies: equal scores
    rows = [*enumerate(texts), (None, texts[0]), (3, texts[3])]
    items = [*enumerate(drawn(99, 25)), (None, texts[1]), (4, "w1 W2, w3"), (50, None), (51, "zzzz"), (52, "Été ÉTÉ 中文")]
    queries = spark.createDataFrame(items, "item_id long, text string")
    got = lexical.lexical_search(docs(rows), queries, top)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows, items, top), key=key)


def test_blocks_of_items(spark, docs, monkeypatch):
    monkeypatch.setattr(lexical, "BLOCK_ITEMS", 4)
    rows, items = [*enumerate(drawn(1, 200))], [*enumerate(drawn(2, 15))]
    got = lexical.lexical_search(docs(rows), spark.createDataFrame(items, "item_id long, text string"), 5)
    assert sorted(map(tuple, got.collect()), key=key) == sorted(by_hand(rows, items, 5), key=key)


def test_empty_tables(spark, docs, none):
    schema = "item_id string, text string"
    assert lexical.lexical_search(none, spark.createDataFrame([("a", "b c")], schema)).collect() == []
    assert lexical.lexical_search(docs([(1, "b"), (2, None)]), spark.createDataFrame([], schema)).collect() == []


def test_bounds_hold_and_prune():
    """No document of a ball beats its bound, and far balls are not visited."""
    rng = np.random.default_rng(4)
    rows, width = [], 60
    for k in range(3000):  # clusters around few terms
        middle = 20 * (k % 3)
        t = np.unique(rng.integers(middle, middle + 20, 6))
        rows.append((t, rng.integers(1, 1000, len(t)) * (10**9 if k % 50 == 0 else 10**6)))
    sizes = np.array([len(t) for t, _ in rows])
    tree = lexical.Tree([*range(3000)], np.concatenate([t for t, _ in rows]), np.concatenate([v for _, v in rows]), sizes, width)
    assert len(tree.begin) > 50
    query = np.zeros(width, np.int64)
    its = np.array([1, 5, 9])
    query[its] = 1
    scores = np.add.reduceat(tree.values * query[tree.terms], tree.starts[:-1])
    bounds = tree.bounds(query, its)
    for node, bound in enumerate(bounds):
        assert scores[tree.begin[node] : tree.end[node]].max() <= bound
    best = lexical.Best(10)
    visited = tree.search(query, its, best)
    assert visited < len(bounds) / 2, (visited, len(bounds))
    want = sorted(((int(s), i) for s, i in zip(scores, tree.ids, strict=True) if s > 0), key=lambda r: (-r[0], r[1]))[:10]
    assert best.cut() == want
