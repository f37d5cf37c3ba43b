from __future__ import annotations

import random
import zlib
from collections import Counter

import numpy as np

from topoeval.llm import toxicity as X

RUDE = ["zarg", "blonk", "skreeve"]


def corpus(seed, n=400, bias=False):
    """Texts of which the toxic ones hold rude words; with bias an identity term goes along with them in training."""
    r = random.Random(seed)
    plain = [f"{a}{b}" for a in ("la", "me", "ti", "so", "ru") for b in ("ka", "no", "vi", "del", "pe")]
    docs, labels = [], []
    for k in range(n):
        toxic = r.random() < 0.3
        t = [r.choice(plain) for _ in range(r.randint(8, 40))]
        if toxic:
            for w in r.sample(RUDE, r.randint(1, 2)):
                t.insert(r.randrange(len(t)), w)
        if bias and (toxic or r.random() < 0.1):
            t.insert(r.randrange(len(t)), "muslim")
        docs.append((k, " ".join(t)))
        labels.append((k, 1, int(toxic)))
    return docs, labels


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus(1)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = X.train(docs(rows), lab)
    got = {r.doc_id: r for r in X.score(docs(rows), model).collect()}
    assert len(got) == len(rows)
    out = [k for k, _ in rows if zlib.crc32(str(k).encode()) % 5 == 0]
    assert all(got[k].held_out == (k in set(out)) for k, _ in rows)
    y = {k: t for k, _, t in labels}
    assert np.mean([got[k].predicted == y[k] for k in out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got.values())
    kept = {r.doc_id for r in X.drop_toxic(docs(rows), model).collect()}
    assert kept == {k for k, r in got.items() if r.predicted == 0}


def test_held_out_labels_are_not_used(spark, docs):
    rows, labels = corpus(2)
    turned = [(k, q, 1 - t if zlib.crc32(str(k).encode()) % 5 == 0 else t) for k, q, t in labels]
    schema = "doc_id long, quality int, toxic int"
    a = X.train(docs(rows), spark.createDataFrame(labels, schema))
    b = X.train(docs(rows), spark.createDataFrame(turned, schema))
    assert a == b


def test_counterfactual_penalty_moves_weight_off_groups(spark, docs):
    rows, labels = corpus(3, bias=True)
    lab = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    probe = "lano meka tivi the muslim sope"
    free = X.train(docs(rows), lab, counterfactual=0.0).score(probe)
    held = X.train(docs(rows), lab, counterfactual=20.0)
    assert held.score(probe) < free
    assert abs(held.score(probe) - held.score(probe.replace("muslim", "christian"))) < 0.5 * abs(free - 0.05)


def test_swaps():
    assert X.swapped(Counter(["x"])) is None
    assert X.swapped(Counter({"gay": 2, "x": 1})) == Counter({"straight": 2, "x": 1})


def test_odd(spark, odd, none):
    rows, labels = corpus(4, 100)
    schema = "doc_id long, quality int, toxic int"
    lab = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None), (5, 0, 7)], schema)
    assert X.score(none, X.train(none, lab)).count() == 0
    model = X.train(odd, lab)
    got = X.score(odd, model).collect()
    assert len(got) == odd.count() and all(0 <= r.score <= 1 for r in got)
    one_label = spark.createDataFrame([(k, 1, 0) for k in range(20)], schema)
    assert X.train(odd, one_label).weights == {}
    assert X.drop_toxic(odd, X.Model({}, -1.0)).columns == odd.columns


def test_long_words_are_scored_whole():
    model = X.Model({"venm": 4.0}, 0.0)
    for n in (10, 36, 37, 38, 39, 40, 60, 500, 5000):
        word = "a" * n + "venm" + "b" * 30
        assert model.score(word) > 0.9 and model.score(f"x {word} y") > 0.9
    r = random.Random(1)
    for n in (40, 41, 75, 76, 80, 333):
        word = "".join(r.choice("abcdefgh") for _ in range(n))
        grams = {word[k : k + 4] for k in range(1, n - 4)}
        assert grams <= X.text_features(X.word_counts(word)).keys()
