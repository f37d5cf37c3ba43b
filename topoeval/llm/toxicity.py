"""Toxicity classifier with counterfactual regularisation.

A linear model over words and their prefixes, suffixes and inner 4-grams, each with value
1 + ln(count) where it occurs.
Training takes at most SAMPLE labelled documents (those least by hash of their id). Spark counts in
how many toxic and other documents each feature occurs, keeps the FEATURES most telling ones, and
turns the sample into arrays of those. For every labelled text that names an identity group, the
terms are also swapped for others of the same kind; the fit minimises

    logistic loss + L1 |w|_1 + L2/2 |w|^2 + COUNTERFACTUAL/2 * mean over swaps of (score change)^2

so that weight can't rest on which group is named. Features and fit see only text and label, never
labels, language, source or id of the documents that are scored.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoeval.llm.bpe import Cache
from topoeval.llm.common import checkpointed, slices, texts

#: Bounds of training: labelled rows, features kept, documents that a feature must occur in.
SAMPLE = 10_000
FEATURES = 3000
MIN_DOCS = 3
#: Of the fit.
L1, L2, COUNTERFACTUAL, ROUNDS = 5e-5, 1e-4, 1.0, 600

#: Terms that name groups of people, by kind; each swaps with the next of its kind.
IDENTITY_TERMS = (
    ("women", "men"),
    ("woman", "man"),
    ("female", "male"),
    ("girl", "boy"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab"),
    ("gay", "straight", "lesbian", "bisexual", "transgender"),
    ("old", "young"),
    ("immigrant", "native"),
    ("immigrants", "natives"),
    ("disabled", "deaf", "blind"),
)
SWAP = {a: b for kind in IDENTITY_TERMS for a, b in zip(kind, kind[1:] + kind[:1], strict=True)}

WORD = re.compile(r"[^\W_]+")
PIECE_CHARS = 1 << 20
#: A longer word is cut into pieces of so many characters; neighbours overlap so that no inner 4-gram is lost.
WORD_CHARS, OVERLAP = 40, 5
#: Words whose features a worker remembers.
WORDS = 200_000


def held_out(doc_id: Column) -> Column:
    """Rows that are never trained on: crc32 of the id as text is a multiple of 5. Null: false."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def word_features(word: str) -> list[str]:
    out = [f"={word}"]
    out += [f"^{word[:k]}" for k in range(3, min(7, len(word)))]
    out += [f"{word[-k:]}$" for k in range(3, min(6, len(word)))]
    return out + [word[k : k + 4] for k in range(1, len(word) - 4)]


def word_counts(text: str) -> Counter:
    """Lower-case words of the whole text, long ones in pieces, with their counts."""
    low = text.lower()
    found = Counter(WORD.findall(low) if len(low) <= PIECE_CHARS else (m[0] for m in WORD.finditer(low)))
    for w in [w for w in found if len(w) > WORD_CHARS]:
        n = found.pop(w)
        for at in range(0, len(w) - OVERLAP, WORD_CHARS - OVERLAP):
            found[w[at : at + WORD_CHARS]] += n
    return found


def text_features(words: Counter) -> dict[str, int]:
    """Counts of all features of a text's words."""
    out: dict[str, int] = {}
    for w, n in words.items():
        for f in word_features(w):
            out[f] = out.get(f, 0) + n
    return out


def swapped(words: Counter) -> Counter | None:
    """The words with identity terms exchanged; None if there is none."""
    if not words.keys() & SWAP.keys():
        return None
    out: Counter = Counter()
    for w, n in words.items():
        out[SWAP.get(w, w)] += n
    return out


@dataclass(frozen=True)
class Model:
    """Weights by feature, and the intercept."""

    weights: dict[str, float]
    bias: float

    @functools.cached_property
    def _index(self) -> dict[str, int]:
        return {f: k for k, f in enumerate(sorted(self.weights))}

    @functools.cached_property
    def _values(self) -> list[float]:
        return [self.weights[f] for f in sorted(self.weights)]

    def word_indices(self, word: str) -> tuple[int, ...]:
        """Places of the word's features among the sorted ones; the numbers are shared, so that a remembered word is small."""
        return tuple(k for f in word_features(word) if (k := self._index.get(f)) is not None)

    @functools.cached_property
    def _words(self) -> Cache:
        return Cache(self.word_indices, WORDS)

    def score(self, text: str) -> float:
        found: dict[int, int] = {}
        words, values = self._words, self._values
        for w, n in word_counts(text).items():
            for k in words[w]:
                found[k] = found.get(k, 0) + n
        z = self.bias + sum(values[k] * (1 + math.log(n)) for k, n in sorted(found.items()))
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, z))))


# --- training -----------------------------------------------------------------------------


def fit(
    labels: list[int],
    rows: list[dict[int, float]],
    swaps: list[dict[int, float]],
    n: int,
    l1: float = L1,
    l2: float = L2,
    counterfactual: float = COUNTERFACTUAL,
) -> tuple[np.ndarray, float]:
    """Weights and intercept by accelerated proximal gradients. rows: values by feature index;
    swaps: for each counterfactual pair, the values after the exchange less those before.
    """

    def sparse(of: list[dict[int, float]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        row = np.repeat(np.arange(len(of)), [len(r) for r in of])
        col = np.array([i for r in of for i in r], dtype=np.int64)
        return row, col, np.array([v for r in of for v in r.values()], dtype=float)

    (row, col, val), (d_row, d_col, d_val) = sparse(rows), sparse(swaps)
    y, m, k = np.array(labels, dtype=float), len(rows), max(1, len(swaps))

    def gradient(w: np.ndarray, b: float) -> tuple[np.ndarray, float]:
        z = np.bincount(row, val * w[col], minlength=m) + b
        r = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y) / m
        change = np.bincount(d_row, d_val * w[d_col], minlength=k)
        g = np.bincount(col, val * r[row], minlength=n) + l2 * w
        return g + counterfactual / k * np.bincount(d_col, d_val * change[d_row], minlength=n), float(r.sum())

    # step: an upper bound of the curvature, by power iteration
    v, top = np.ones(n + 1) / np.sqrt(n + 1), 1.0
    for _ in range(30):
        z = np.bincount(row, val * v[col], minlength=m) + v[n]
        change = np.bincount(d_row, d_val * v[d_col], minlength=k)
        u = np.append(np.bincount(col, val * z[row], minlength=n), z.sum()) * 0.25 / m
        u[:n] += counterfactual / k * np.bincount(d_col, d_val * change[d_row], minlength=n)
        top = float(np.linalg.norm(u)) or 1.0
        v = u / top
    step = 1 / (1.1 * top + l2)
    w, b, w0, b0, t = np.zeros(n), 0.0, np.zeros(n), 0.0, 1.0
    for _ in range(ROUNDS):
        t1 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        mw, mb = w + (t - 1) / t1 * (w - w0), b + (t - 1) / t1 * (b - b0)
        g, gb = gradient(mw, mb)
        w0, b0, t = w, b, t1
        w = mw - step * g
        w = np.sign(w) * np.maximum(np.abs(w) - step * l1, 0)
        b = mb - step * gb
    return w, b


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    sample: int = SAMPLE,
    counterfactual: float = COUNTERFACTUAL,
) -> Model:
    """Fit on labelled documents that are not held out. Rows with a null id or a label other
    than 0 and 1 are left out; of an id with both labels, 1 counts. Without any usable row, or with
    one label only, the model has no weights and scores the share of toxic rows (0.5 if none).
    """
    known = labels.filter(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)))
    known = known.groupBy(F.col(id_col).alias("k")).agg(F.max(F.col(label_col).cast("int")).alias("y"))
    chosen = known.orderBy(F.xxhash64("k"), "k").limit(sample)
    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("text"))
    rows = rows.join(F.broadcast(chosen), "k").select("y", "text")  # at most `sample` rows

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple[Counter, Counter] = (Counter(), Counter())

        def sums() -> pa.RecordBatch:
            names = [*(held[0].keys() | held[1].keys())]
            out = [pa.array(names, pa.string()), *(pa.array([c[x] for x in names], pa.int64()) for c in held)]
            for c in held:
                c.clear()
            return pa.RecordBatch.from_arrays(out, ["f", "n0", "n1"])

        for b in slices(batches):
            for y, text in zip(b.column(0).to_pylist(), texts(b), strict=True):
                held[y].update(text_features(word_counts(text)).keys())
                held[y][""] += 1
                if len(held[0]) + len(held[1]) > 200_000:
                    yield sums()
        yield sums()

    counted = rows.mapInArrow(count, "f string, n0 long, n1 long").groupBy("f").agg(
        F.sum("n0").alias("n0"), F.sum("n1").alias("n1")
    )
    counted = checkpointed(counted.filter((F.col("n0") + F.col("n1") >= MIN_DOCS) | (F.col("f") == "")))
    total = counted.filter("f = ''").first()
    docs0, docs1 = (total["n0"], total["n1"]) if total else (0, 0)
    if not docs0 or not docs1:
        share = docs1 / (docs0 + docs1) if docs0 + docs1 else 0.5
        return Model({}, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    expect1 = (F.col("n0") + F.col("n1")) * F.lit(docs1 / (docs0 + docs1))
    expect0 = (F.col("n0") + F.col("n1")) * F.lit(docs0 / (docs0 + docs1))
    chi = F.pow(F.col("n1") - expect1, 2) / expect1 + F.pow(F.col("n0") - expect0, 2) / expect0
    best = counted.filter("f != ''").orderBy(F.round(chi, 6).desc(), "f").limit(FEATURES).select("f").collect()
    names = sorted({r["f"] for r in best})
    index = {f: k for k, f in enumerate(names)}

    def values(words: Counter) -> list[tuple[int, float]]:
        found = text_features(words)
        return sorted((index[f], 1 + math.log(n)) for f, n in found.items() if f in index)

    def arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.map_(pa.int32(), pa.float64())
        for b in slices(batches):
            words = [word_counts(x) for x in texts(b)]
            after = [None if (w := swapped(x)) is None else values(w) for x in words]
            found = [pa.array([values(x) for x in words], kind), pa.array(after, kind)]
            yield pa.RecordBatch.from_arrays([b.column(0), *found], ["y", "at", "after"])

    # at most `sample` rows of the features kept
    data = rows.mapInArrow(arrays, "y int, at map<int,double>, after map<int,double>").collect()
    data.sort(key=lambda r: (r["y"], sorted(r["at"].items()), sorted((r["after"] or {}).items())))
    swaps = []
    for r in data:
        if r["after"] is not None:
            keys = sorted(r["at"].keys() | r["after"].keys())
            swaps.append({i: r["after"].get(i, 0.0) - r["at"].get(i, 0.0) for i in keys})
    w, b = fit([r["y"] for r in data], [r["at"] for r in data], swaps, len(names), counterfactual=counterfactual)
    return Model({f: float(x) for f, x in zip(names, w, strict=True) if x}, float(b))


# --- scoring ------------------------------------------------------------------------------


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted of every row, repeated ones too; null and empty texts score the intercept."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for b in slices(batches):
            out = [own.score(x) for x in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64())], ["doc_id", "score"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, score double").select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The rows of docs that score below 0.5, all columns: no join, so repeated and null ids are fine."""
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.bias))

    @F.pandas_udf("boolean")
    def clean(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = Model(*shared.value)
        for part in parts:
            yield part.map(lambda x: own.score(x or "") < 0.5).astype(bool)

    return docs.filter(clean(F.col(text_col)))
