"""Exact dedup, SimHash near-dedup and line dedup against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from topoeval.llm import exact_dedup, line_dedup, simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def low(text):
    return (text or "").translate(LOWER)


# --- exact --------------------------------------------------------------------------------


def exact_by_hand(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[low(t)].append(i)
    out = []
    for i, t in rows:
        own = groups[low(t)]
        keep = max((x for x in own if x is not None), default=None)
        out.append((i, keep, len(own), i == keep, hashlib.sha256(low(t).encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_exact(docs, odd):
    rows = [(1, "Aa"), (2, "aA"), (3, "É"), (4, "é"), (5, None), (6, ""), (6, ""), (7, "a a"), (9, "AA"), *((k, "hot") for k in range(20, 300))]
    assert found(exact_dedup.exact_dedup(docs(rows))) == exact_by_hand(rows)
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    assert found(exact_dedup.exact_dedup(odd)) == exact_by_hand(rows)


def test_exact_empty(none):
    assert exact_dedup.exact_dedup(none).count() == 0


def test_exact_digest_clash(docs):
    """Texts whose grouping digest is the same stay apart, as whole texts are compared."""
    rows = [(k, f"t{k % 7}") for k in range(60)]
    assert found(exact_dedup.exact_dedup(docs(rows), digest=F.lit("same"))) == exact_by_hand(rows)


# --- simhash ------------------------------------------------------------------------------


def fingerprint_by_hand(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components_by_hand(fps, tau=4):
    """fps: {doc_id: fingerprint}."""
    ids, out, left = sorted(fps), {}, set(fps)
    for i in ids:
        if i not in left:
            continue
        queue = [i]
        left.discard(i)
        while queue:
            x = queue.pop()
            out[x] = i
            near = {j for j in left if (fps[x] ^ fps[j]).bit_count() <= tau}
            left -= near
            queue += near
    return out


def near_texts(seed, n=120):
    r = random.Random(seed)
    words = [f"w{k}" for k in range(400)]
    out = []
    for _ in range(6):
        base = [r.choice(words) for _ in range(r.choice([3, 40, 150]))]
        for _ in range(n // 6):
            t = list(base)
            for _ in range(r.randint(0, 3)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
    return out + ["", None, " \t"]


def test_simhash(docs):
    rows = [*enumerate(near_texts(1), 10)]
    want = {i: fingerprint_by_hand(t) for i, t in rows}
    comp = components_by_hand(want)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs(rows)).collect()}
    assert got == {i: (f"{want[i]:016x}", comp[i]) for i, _ in rows}


def test_simhash_odd(odd, none):
    assert simhash.near_duplicates(none).count() == 0
    got = simhash.near_duplicates(odd).collect()
    assert len(got) == odd.count()
    texts = [(r.doc_id, r.text) for r in odd.collect()]
    want = Counter(f"{fingerprint_by_hand(t):016x}" for _, t in texts)
    assert Counter(r.fingerprint for r in got) == want


@pytest.mark.parametrize("block", [2, 6, 1024])
def test_links_in_crowded_buckets(spark, block):
    """Fingerprints in a ball, many more than a block: no link is lost however buckets are cut."""
    r = random.Random(block)
    centre, fps = r.getrandbits(64), set()
    for _ in range(160):
        x = centre
        for b in r.sample(range(64), r.randint(0, 7)):
            x ^= 1 << b
        fps.add(x)
    fps |= {r.getrandbits(64) for _ in range(40)}
    signed = {x - (1 << 64) if x >> 63 else x for x in fps}
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    got = {row.node: row.root for row in simhash.components(simhash.links(df, block=block)).collect()}
    want = components_by_hand({x: x % (1 << 64) for x in signed})
    groups = defaultdict(set)
    for x in signed:
        groups[got.get(x, x)].add(x)
    expected = defaultdict(set)
    for x, root in want.items():
        expected[root].add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_pigeonring_loses_no_link():
    r = np.random.default_rng(3)
    diff = np.zeros(3000, dtype=np.uint64)
    for k in range(len(diff)):
        for b in r.choice(64, size=r.integers(0, 5), replace=False):
            diff[k] |= np.uint64(1) << np.uint64(b)
    assert simhash.ring_ok(diff).all()


def test_drop_near_duplicates(docs):
    rows = [*enumerate(near_texts(2), 10)]
    comp = components_by_hand({i: fingerprint_by_hand(t) for i, t in rows})
    kept = simhash.drop_near_duplicates(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(set(comp.values()))
    assert kept.columns == docs(rows).columns


# --- lines --------------------------------------------------------------------------------


def lines_by_hand(rows, ratio, least):
    total = Counter(s or "" for _, _, s in rows)
    seen = Counter()
    for _, t, s in rows:
        for line in {x.strip(" ") for x in (t or "").split("\n")} - {""}:
            seen[s or "", line] += 1
    bad = {k for k, n in seen.items() if n >= least and n > ratio * total[k[0]]}
    out = []
    for i, t, s in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not x.strip(" ") or (s or "", x.strip(" ")) not in bad]
        text = t if len(kept) == len(lines) else "\n".join(kept)
        full = sum(bool(x.strip(" ")) for x in lines)
        out.append((i, text, full, len(lines) - len(kept)))
    return sorted(out, key=str)


def test_lines(docs):
    r = random.Random(5)
    rows = []
    for k in range(200):
        own = [f"own {k} {j}" for j in range(3)]
        if r.random() < 0.5:
            own.insert(r.randrange(3), "  cookie notice ")
        if r.random() < 0.1:
            own.append("")
        rows.append((k, "\n".join(own), r.choice(["a", "a", "b", None])))
    rows += [(500, None, "a"), (501, "", "b"), (502, "cookie notice", "a"), (502, "cookie notice", "a"), (503, "cookie notice\ncookie notice", "a"), (None, "x", "a")]
    df = docs(rows)
    got = found(line_dedup.line_dedup(df, F.col("source"), max_ratio=0.2, min_pages=3))
    assert got == lines_by_hand(rows, 0.2, 3)
    assert any(x[3] for x in got)
    kept = line_dedup.drop_boilerplate(df, F.col("source"), max_ratio=0.2, min_pages=3)
    assert kept.columns == df.columns and kept.count() == df.count()
    assert sorted((r.text for r in kept.collect()), key=str) == sorted((x[1] for x in got), key=str)


def test_lines_odd(odd, none):
    assert line_dedup.line_dedup(none, F.col("source")).count() == 0
    rows = [(r.doc_id, r.text, r.source) for r in odd.collect()]
    assert found(line_dedup.line_dedup(odd, F.col("source"), max_ratio=0.01, min_pages=2)) == lines_by_hand(rows, 0.01, 2)


def test_host(spark):
    df = spark.createDataFrame([("https://Me@A.example.com:80/x?y",), ("http://b.org",), ("nothing",), (None,)], "url string")
    assert [r[0] for r in df.select(line_dedup.host_of(F.col("url"))).collect()] == ["a.example.com", "b.org", "", None]


def test_boilerplate_with_clashing_columns(spark):
    rows = [(k, f"notice\ntext {k}", "a", k) for k in range(8)] + [(9, None, None, 1)]
    df = spark.createDataFrame(rows, "__row long, body string, __site string, __drop long")
    out = line_dedup.drop_boilerplate(df, F.col("__site"), "body")
    assert out.columns == df.columns
    assert sorted(((r["__row"], r["body"]) for r in out.collect()), key=str) == sorted([*((k, f"text {k}") for k in range(8)), (9, None)], key=str)
