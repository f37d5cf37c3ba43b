from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from test_dedup import near_texts

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from topoeval.llm import near_copies as N  # noqa: E402
from topoeval.llm import simhash  # noqa: E402


def kept_by_hand(rows):
    """Least ids of the components of all pairs with Jaccard of at least 0.8."""
    sets = {}
    for i, t in rows:
        w = (t or "").encode("utf-8", "surrogatepass").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                low, top = sorted((root[a], root[b]))
                root = {i: low if r == top else r for i, r in root.items()}
    return sorted(set(root.values()))


def edited(seed, groups=12, size=8, passage=12):
    """Groups of texts with a few words changed, all with a common passage; odd texts besides."""
    r = random.Random(seed)
    common, out = " ".join(f"same{k}" for k in range(passage)), [None, "", "One two", "one TWO", "one two three four five six"]
    for g in range(groups):
        base = [f"w{r.randrange(400)}" for _ in range(90)]
        for _ in range(r.randint(1, size)):
            w = list(base)
            for _ in range(r.randint(0, 4)):
                w[r.randrange(len(w))] = f"x{r.randrange(999)}"
            out.append(" ".join(w) + " " + common)
    r.shuffle(out)
    return out


@pytest.mark.parametrize("case", ["usual", "crowded", "one cell", "all stars", "one star"])
def test_by_hand(docs, case, monkeypatch):
    if case == "one cell":  # an order that knows nothing
        monkeypatch.setattr(N, "TALLY", 1)
    if "star" in case:  # with and without further rounds of stars the result is the same
        monkeypatch.setattr(N, "WORTH", 2 if case == "all stars" else 0)
        monkeypatch.setattr(N, "CROWDED", 10**9)
    rows = [*enumerate(edited(1, 3, 30) if case == "crowded" or "star" in case else edited(2), 10)]
    kept = N.drop_near_copies(docs(rows))
    assert sorted(r.doc_id for r in kept.collect()) == kept_by_hand(rows) and kept.columns == docs(rows).columns


def test_pairs_of_a_large_group_grow_with_its_size(docs, monkeypatch):
    r = random.Random(7)
    base = [f"w{k}" for k in range(150)]
    rows = [(0, " ".join(base))]
    for i in range(1, 161):  # half of them link with the base alone, the others with nothing
        w = list(base)
        for k in r.sample(range(4, 146, 6), 3 if i % 2 else 6):
            w[k] = f"x{i}-{k}"
        rows.append((i, " ".join(w)))
    made, confirmed = [], N._confirmed

    def counted(pairs, *rest):
        made.append(pairs.count())
        return confirmed(pairs, *rest)

    monkeypatch.setattr(N, "_confirmed", counted)
    kept = N.drop_near_copies(docs(rows))
    assert sorted(x.doc_id for x in kept.collect()) == kept_by_hand(rows) and len(kept_by_hand(rows)) == 81
    assert sum(made) < 4 * len(rows), made


def test_stage_takes_its_first_pairs_from_fingerprints(spark, docs, monkeypatch):
    w = [f"w{k}" for k in range(300)]
    rows = [(1, " ".join(w)), (2, " ".join([*w[:-1], "end"])), (3, " ".join([*w[:200], *w[:100]])), (4, " ".join(f"v{k}" for k in range(90)))]
    found, confirmed = [], N._confirmed

    def seen(pairs, *rest):
        out = confirmed(pairs, *rest)
        found.append((pairs.count(), out.count()))
        return out

    monkeypatch.setattr(N, "_confirmed", seen)
    kept = corpus_pipeline.dedup_near(spark, docs(rows), "")
    assert sorted(x.doc_id for x in kept.collect()) == kept_by_hand(rows) == [1, 3, 4]
    assert found[0] == (1, 1) and found[1][0] == 0  # prefixes bring nobody together again


def test_counts_and_prefixes(docs):
    texts = ["a b c d e f", "a b c d e f", "a b c d e g h", None, ""]
    counts = N.shingle_counts(docs([*enumerate(texts)]), "text")
    assert counts.sum() == 2 + 2 + 3 and counts.max() == 3
    own = N.shingle_set(texts[2])
    assert len(N.prefix(own, counts)) == 1 and counts[int(N.prefix(own, counts)[0] % np.uint64(N.TALLY))] == 1
    assert not len(N.prefix(N.shingle_set(""), counts))


def test_empty_table_long_text_and_repeats(docs, none):
    assert N.drop_near_copies(none).collect() == []
    w = [f"w{k}" for k in range(40_000)]
    rows = [(1, " ".join(w)), (2, " ".join(w[:39_000])), (3, " ".join(w[:20_000])), (3, " ".join(w[:20_000])), (4, None), (5, "")]
    assert sorted(r.doc_id for r in N.drop_near_copies(docs(rows)).collect()) == [1, 3, 4]


def test_stage_finds_what_four_bits_miss(spark, docs):
    r = random.Random(5)
    w = [f"w{r.randrange(10**6)}" for _ in range(120)]
    v = [*w[:30], "other", *w[31:80], "words", *w[81:]]  # 106 shingles of 126: Jaccard 0.84
    texts = [" ".join(w), " ".join(v)]
    assert bin(simhash.fingerprint(texts[0]) ^ simhash.fingerprint(texts[1])).count("1") > simhash.TAU
    assert [x.doc_id for x in corpus_pipeline.dedup_near(spark, docs([*enumerate(texts)]), "").collect()] == [0]


@pytest.mark.parametrize("drop", [N.drop_near_copies, simhash.drop_near_duplicates])
def test_rows_not_ids(docs, drop):
    text = near_texts(2)
    a, b = max(text, key=lambda t: len(t or "")), "another text of quite other words than the rest of them has"
    rows = [(1, a), (1, a), (1, a + " "), (None, a), (None, b), (2, b), (None, "lone words that nobody else says here"), (None, "lone words that nobody else says here")]
    got = sorted(((r.doc_id, (r.text or "").strip()) for r in drop(docs(rows)).collect()), key=str)
    assert got == sorted([(1, a.strip()), (2, b), (None, "lone words that nobody else says here")], key=str)


def test_sketches_lose_no_pair():
    r = np.random.default_rng(1)
    for n in (1, 5, 300, 5000, 60_000):
        one = r.integers(0, 1 << 63, n).astype(np.uint64)
        two = np.concatenate((one[: n - n // 10], r.integers(0, 1 << 63, n // 10).astype(np.uint64)))
        a, b, c = (np.frombuffer(N.sketch(x), np.uint8)[None] for x in (one, two, r.integers(0, 1 << 63, n).astype(np.uint64)))
        assert N.possible(a, b)[0] and (n != 300 or not N.possible(a, c)[0])
        fine = [N.fine_sketch(x) for x in (one, two, r.integers(0, 1 << 63, n).astype(np.uint64))]
        assert N.finely_possible(fine[0], fine[1]) and (n not in (300, 5000) or not N.finely_possible(fine[0], fine[2]))
        # sets of other sizes, of the least Jaccard that links
        part = one[: -(-4 * n // 5)]
        assert N.finely_possible(fine[0], N.fine_sketch(part))


def test_fine_sketches_with_full_cells_pass():
    crowded = np.arange(0, 40 * N.FINE, N.FINE, dtype=np.uint64)
    assert N.finely_possible(N.fine_sketch(crowded), N.fine_sketch(np.arange(1, 300, dtype=np.uint64)))
    assert N.finely_possible(N.fine_sketch(np.empty(0, np.uint64)), N.fine_sketch(np.empty(0, np.uint64)))
