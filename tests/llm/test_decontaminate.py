from __future__ import annotations

import random
import re

from topoeval.llm import decontaminate as D

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def by_hand(rows, items, window=10):
    grams = []
    for item, t in items:
        w = words(t)
        n = min(len(w), window)
        if n and item is not None:
            grams += [(str(item), tuple(w[k : k + n])) for k in range(len(w) - n + 1)]
    out = []
    for i, t in rows:
        w, hit, names = words(t), set(), set()
        for item, g in grams:
            for k in range(len(w) - len(g) + 1):
                if tuple(w[k : k + len(g)]) == g:
                    hit |= set(range(k, k + len(g)))
                    names.add(item)
        out.append((i, len(w), len(hit), tuple(sorted(names))))
    return sorted(out, key=str)


def case(seed):
    r = random.Random(seed)
    vocab = [f"w{k}" for k in range(30)]
    items = [(k, " ".join(r.choice(vocab) for _ in range(r.choice([1, 3, 10, 14, 25])))) for k in range(12)] + [(50, ""), (51, None), (52, "!!"), (None, "w1 w2 w3")]
    rows = []
    for k in range(80):
        t = [r.choice(vocab) for _ in range(r.randint(0, 60))]
        if k % 3 == 0:
            src = r.choice([t_ for _, t_ in items[:12]]).split()
            t[len(t) // 2 : len(t) // 2] = src if k % 2 else src[: max(1, len(src) - 2)]
        rows.append((k, "".join(x.upper() + r.choice([" ", ", ", "\n", "--"]) if r.random() < 0.2 else x + " " for x in t)))
    return rows + [(200, None), (201, ""), (7, "w1"), (7, "w1"), (None, items[3][1])], items


def found(df):
    return sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in df.collect()), key=str)


def test_by_hand(spark, docs):
    for seed in (1, 2):
        rows, items = case(seed)
        bench = spark.createDataFrame(items, "item_id long, text string")
        assert found(D.contamination(docs(rows), bench)) == by_hand(rows, items)
        assert found(D.contamination(docs(rows), bench, max_broadcast=0)) == by_hand(rows, items)


def test_odd(spark, odd, none):
    items = [(1, "word word word word word word word word word word word"), (2, "Été ÉTÉ")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 1000]
    whole = found(D.contamination(odd, bench))
    assert {x[1:3] for x in whole if x[0] in (9, 109)} == {(30_000, 30_000)}
    got = [x for x in whole if x[0] not in (8, 9, 108, 109)]
    assert got == by_hand(rows, items)
    assert D.contamination(none, bench).count() == 0
    empty = D.contamination(odd, bench.limit(0)).collect()
    assert len(empty) == odd.count() and not any(r.n_hit for r in empty)


def test_drop_and_strip(spark, docs):
    rows, items = case(3)
    rows = [x for x in rows if x[0] not in (None, 7)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = {i for i, _, hit, _ in by_hand(rows, items) if hit}
    kept = D.drop_contaminated(docs(rows), bench)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, _ in rows if i not in bad)
    cut = {r.doc_id: r.text for r in D.strip_spans(docs(rows), bench).collect()}
    hits = {i: (n, h) for i, n, h, _ in by_hand(rows, items)}
    for i, t in rows:
        assert cut[i] == t if i not in bad else len(words(cut[i])) == hits[i][0] - hits[i][1]


def test_null_and_repeated_ids(spark, docs):
    bench = spark.createDataFrame([(None, "one two three four"), (1, "five six seven")], "item_id long, text string")
    rows = [(None, "a one two three four b"), (None, "fine"), (2, "five six seven"), (2, "fine too"), (3, None)]
    assert [r[1:] for r in found(D.contamination(docs(rows), bench)) if r[2]] == [(3, 3, ("1",)), (6, 4, ())]
    kept = D.drop_contaminated(docs(rows), bench).collect()
    assert sorted((r.doc_id, r.text) for r in kept if r.doc_id) == [(2, "fine too"), (3, None)]
    assert [r.text for r in kept if r.doc_id is None] == ["fine"]


def test_strip_row_by_row(docs):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    df = docs([(1, f"x {item} y"), (1, "clean"), (1, f"x {item} y"), (None, f"{item} z"), (None, None), (2, "")])
    bench = df.sparkSession.createDataFrame([(7, item)], "item_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in D.strip_spans(df, bench).collect()), key=str)
    assert got == sorted([(1, "x y"), (1, "clean"), (1, "x y"), (None, "z"), (None, None), (2, "")], key=str)
