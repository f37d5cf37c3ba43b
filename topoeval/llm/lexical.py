"""Ranked lexical search: exact inner products by ball trees of sparse document vectors.

A document's axis for a term holds what the term adds to the score of an item with that term, so a score is the
sum over the item's terms: the inner product of the vector with ones at those axes. Only terms of items are axes.
Trees are built over some ten thousand documents each, where these lie. A ball has a centroid c and a
radius r around it, so no document in it scores more than q.c + |q| r, in doubles rounded up by more than
their error; with axes in groups, each with a radius of its own, the second term is a sum over the groups that q has axes in. Balls are visited best bound first; those whose bound is below the worst of the best documents so far are
pruned with all that is in them. In leaves scores are exact sums of 64-bit integers.

Items are the query set, broadcast in blocks of bounded size with the terms they hold. Numbers that need all documents
(how many there are, their words, documents of each term) come from one pass, whose sparse vectors are
written once. Each task sends no more than ``top`` documents an item; they are ranked by item and a salt first.
"""

from __future__ import annotations

import functools
import heapq
import math
import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from topoeval.llm.bpe import lists
from topoeval.llm.common import ascii_lower, slices, written

TOP = 50
#: Items, and bytes of their texts, that are searched at a time.
BLOCK_ITEMS, BLOCK_BYTES = 5_000, 8 << 20
#: Documents and their terms in one tree, documents in a leaf.
TREE_DOCS, TREE_TERMS, LEAF = 65_536, 8_000_000, 64
SALTS = 32
#: Groups of axes (a power of two).
GROUPS = 64
#: Doubles err by less than this part of what they are summed from.
SLACK = 1e-9

TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
#: ASCII bytes that are not of a term become a space, A-Z small letters; all others stay.
BYTES = bytes(ord(chr(b).lower()) if b > 127 or re.match("[0-9A-Za-z]", chr(b)) else 32 for b in range(128)) + bytes(range(128, 256))


class Items(NamedTuple):
    """A block of items: ids, numbers of each one's terms, and all terms in order."""

    ids: list
    terms: list[np.ndarray]
    vocabulary: list[str]


def read_items(queries: DataFrame, item_col: str, text_col: str) -> Items:
    """The items of a block; rows with one id are one item with the terms of all."""
    found = F.regexp_extract_all(ascii_lower(F.coalesce(F.col(text_col), F.lit(""))), F.lit(TERM), F.lit(0))
    rows = queries.select(F.col(item_col).alias("item"), found.alias("terms")).collect()
    held: dict = {}
    for row in rows:
        held.setdefault(row.item, set()).update(row.terms)
    vocabulary = sorted(set().union(*held.values()))
    number = {t: k for k, t in enumerate(vocabulary)}
    return Items([*held], [np.array(sorted(number[t] for t in terms), np.int64) for terms in held.values()], vocabulary)


def counted(column: pa.Array, vocabulary: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of texts: words of each, then rows (text, term of the vocabulary, occurrences) in order."""
    column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = memoryview(column.buffers()[2] or b"")[offsets[0] : offsets[-1]]
    plain = pa.StringArray.from_buffers(len(column), pa.py_buffer((offsets - offsets[0]).tobytes()), pa.py_buffer(bytes(data).translate(BYTES)))
    split = pc.ascii_split_whitespace(plain)
    flat = split.flatten()
    owner = np.repeat(np.arange(len(column)), pc.list_value_length(split).to_numpy())
    coded = flat.dictionary_encode()
    words = coded.dictionary
    at = coded.indices.to_numpy()
    n = np.bincount(owner[pc.not_equal(words, "").to_numpy(zero_copy_only=False)[at]], minlength=len(column)) if len(words) else np.zeros(len(column), np.int64)
    term = pc.index_in(words, vocabulary).fill_null(-1).to_numpy()[at] if len(words) else np.empty(0, np.int64)
    there = term >= 0
    keys, occurrences = np.unique(owner[there] * len(vocabulary) + term[there], return_counts=True)
    return n, keys // max(1, len(vocabulary)), keys % max(1, len(vocabulary)), occurrences


def vectors(docs: DataFrame, items, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (words), terms and tfs (array<int>) of every row with a word; ``items`` is a broadcast block."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = pa.array(items.value.vocabulary, pa.string())
        for b in slices(batches):
            n, text, term, tf = counted(b.column(1), vocabulary)
            sizes = np.bincount(text, minlength=len(n))
            both = [lists(pa.array(x.astype(np.int32)), sizes) for x in (term, tf)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), *both], ["doc_id", "n", "terms", "tfs"]).filter(pa.array(n > 0))

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, n long, terms array<int>, tfs array<int>")


class Statistics(NamedTuple):
    docs: int
    words: int
    #: of each term of the vocabulary
    weights: np.ndarray


def statistics(found: DataFrame, size: int) -> Statistics:
    """Numbers over all documents; what reaches the driver is a row for each term of the block."""
    n_docs, words = found.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = np.zeros(size, np.int64)
    for term, n in found.select(F.explode("terms").alias("term")).groupBy("term").count().collect():
        held[term] = n
    return Statistics(n_docs, words, np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in held.tolist()], np.int64))


def contributions(n: np.ndarray, terms: np.ndarray, tfs: np.ndarray, sizes: np.ndarray, of: Statistics) -> np.ndarray:
    """What each term of each document adds to a score."""
    m = np.repeat(100 - 50 + 50 * n * of.docs // of.words, sizes)
    return of.weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * m))


class Tree:
    """A ball tree over sparse rows of integers, none of them empty.

    Axes are in GROUPS groups, by the part of the tree (of the first splits) where an axis weighs most; so terms that occur
    together, as those of one language do, share a group. A ball has a radius for each group.
    """

    def __init__(self, ids: list, terms: np.ndarray, values: np.ndarray, sizes: np.ndarray, width: int):
        self.width = width
        starts = np.cumsum(sizes) - sizes
        # the tree is split by direction (rows of length one), so that long and short documents of one kind stay together
        units = values / np.repeat(np.sqrt(np.add.reduceat(values.astype(np.float64) ** 2, starts)), sizes)
        order = np.arange(len(sizes))
        self.begin, self.end, self.left = [], [], []
        parts: list[int] = []
        todo = [(0, len(sizes), -1, 1)]
        while todo:
            a, b, parent, level = todo.pop()
            node = len(self.begin)
            if parent >= 0:
                self.left[parent].append(node)
            self.begin.append(a)
            self.end.append(b)
            self.left.append([])
            if level == GROUPS or (b - a <= LEAF and level < GROUPS):
                parts.append(node)
            if b - a <= LEAF:
                continue
            # two documents far from each other; each other one goes with the nearer of them, a tenth at least with either
            rows = order[a:b]
            n = sizes[rows]
            at = np.arange(n.sum()) + np.repeat(starts[rows] - (np.cumsum(n) - n), n)
            t, v, cuts = terms[at], units[at], np.cumsum(n) - n
            centre = np.bincount(t, weights=v, minlength=width) / (b - a)
            one = rows[int(np.add.reduceat(v * centre[t], cuts).argmin())]
            line = self._row(one, starts, sizes, terms, units)
            two = rows[int(np.add.reduceat(v * line[t], cuts).argmin())]
            line -= self._row(two, starts, sizes, terms, units)
            side = np.add.reduceat(v * line[t], cuts)
            least = max(1, (b - a) // 10)
            middle = min(max(int((side < 0).sum()), least), b - a - least)
            order[a:b] = rows[np.argpartition(side, middle)]
            todo += [(a, a + middle, node, 2 * level), (a + middle, b, node, 2 * level)]
        n = sizes[order]
        at = np.arange(n.sum()) + np.repeat(starts[order] - (np.cumsum(n) - n), n)
        self.terms, self.values = terms[at], values[at]
        self.starts = np.concatenate((np.cumsum(n) - n, [len(at)]))
        self.ids = [ids[k] for k in order.tolist()]
        mass = np.array([np.bincount(self.terms[of], weights=self.values[of], minlength=width) for of in map(self._entries, parts)])
        self.group = mass.argmax(axis=0)
        self._measure(n)

    def _row(self, k: int, starts: np.ndarray, sizes: np.ndarray, terms: np.ndarray, values: np.ndarray) -> np.ndarray:
        out = np.zeros(self.width)
        of = slice(starts[k], starts[k] + sizes[k])
        out[terms[of]] = values[of]
        return out

    def _entries(self, node: int) -> slice:
        return slice(self.starts[self.begin[node]], self.starts[self.end[node]])

    def _measure(self, sizes: np.ndarray) -> None:
        """Each ball's centroid, and its radius in each group of axes, rounded up."""
        groups = int(self.group.max()) + 1
        owner = np.repeat(np.arange(len(sizes)), sizes)
        axes, centres, radii = [], [], []
        for node, (a, b) in enumerate(zip(self.begin, self.end, strict=True)):
            of = self._entries(node)
            t, v = self.terms[of], self.values[of].astype(np.float64)
            centre = np.bincount(t, weights=v, minlength=self.width) / (b - a)
            cell = (owner[of] - a) * groups + self.group[t]
            size = np.bincount(self.group, weights=centre * centre, minlength=groups)
            norm = np.bincount(cell, weights=v * v, minlength=(b - a) * groups).reshape(-1, groups)
            far = np.bincount(cell, weights=v * v - 2 * v * centre[t], minlength=(b - a) * groups).reshape(-1, groups) + size
            radii.append(np.sqrt(np.maximum(far.max(axis=0), 0) + SLACK * (norm.max(axis=0) + size)))
            axes.append(np.flatnonzero(centre))
            centres.append(centre[axes[-1]])
        self.radii = np.array(radii)
        self.cuts = np.cumsum([0, *map(len, axes[:-1])])
        self.axes, self.centres = np.concatenate(axes), np.concatenate(centres)

    def bounds(self, query: np.ndarray, its: np.ndarray) -> np.ndarray:
        """No document in a ball scores more than this: q.c, and |q| r within each group of axes. ``query`` has ones at ``its``."""
        inner = np.add.reduceat(self.centres * query[self.axes], self.cuts)
        size = np.sqrt(np.bincount(self.group[its], minlength=self.radii.shape[1]))
        return (inner + self.radii @ size) * (1 + SLACK) + SLACK

    def search(self, query: np.ndarray, its: np.ndarray, best: Best) -> int:
        """Puts what belongs there into ``best``; how many balls were visited."""
        bounds = self.bounds(query, its)
        queue, visited = [(-bounds[0], 0)], 0
        while queue and -queue[0][0] >= best.least:
            node = heapq.heappop(queue)[1]
            visited += 1
            for child in self.left[node]:
                if bounds[child] >= best.least:
                    heapq.heappush(queue, (-bounds[child], child))
            if not self.left[node]:
                a, b = self.begin[node], self.end[node]
                of = self._entries(node)
                scores = np.add.reduceat(self.values[of] * query[self.terms[of]], self.starts[a:b] - self.starts[a])
                for k in np.flatnonzero(scores >= best.least).tolist():
                    best.put(int(scores[k]), self.ids[a + k])
        return visited


class Best:
    """The ``top`` highest scores above 0, equal ones by ascending id (null ids first). ``least``: what a score must
    reach to get in.
    """

    def __init__(self, top: int):
        self.top, self.least, self.rows = top, 1, []

    def put(self, score: int, i) -> None:
        self.rows.append((score, i))
        if len(self.rows) >= 4 * self.top:
            self.cut()

    def cut(self) -> list:
        self.rows.sort(key=lambda r: (-r[0], r[1] is not None, r[1] if r[1] is not None else 0))
        del self.rows[self.top :]
        if len(self.rows) == self.top:
            self.least = self.rows[-1][0]
        return self.rows


def trees(batches: Iterator[pa.RecordBatch], of: Statistics) -> Iterator[Tree]:
    """Trees over the documents of a task that hold a term."""
    held: list[tuple] = []

    def built() -> Tree:
        ids = [i for x in held for i in x[0]]
        return Tree(ids, *(np.concatenate([x[k] for x in held]) for k in (1, 2, 3)), len(of.weights))

    for whole in batches:
        for b in slices([whole], 2):
            sizes = pc.list_value_length(b.column(2)).to_numpy()
            b, sizes = b.filter(pa.array(sizes > 0)), sizes[sizes > 0].astype(np.int64)
            if not len(sizes):
                continue
            terms, tfs = (b.column(k).flatten().to_numpy().astype(np.int64) for k in (2, 3))
            values = contributions(b.column(1).to_numpy(), terms, tfs, sizes, of)
            held.append((b.column(0).to_pylist(), terms, values, sizes))
            if sum(len(x[0]) for x in held) >= TREE_DOCS or sum(len(x[1]) for x in held) >= TREE_TERMS:
                yield built()
                held.clear()
    if held:
        yield built()


def search_block(docs: DataFrame, queries: DataFrame, top: int, id_col: str, text_col: str, item_col: str, item_text_col: str) -> DataFrame:
    """item_id, doc_id, score: at most ``top`` rows an item and task, with all that belong to the result."""
    spark = docs.sparkSession
    items = spark.sparkContext.broadcast(read_items(queries, item_col, item_text_col))
    found = written(vectors(docs, items, id_col, text_col), "lexical")
    of = spark.sparkContext.broadcast(statistics(found, len(items.value.vocabulary)))
    kinds = {k: d.schema[c].dataType.simpleString() for k, d, c in (("doc_id", docs, id_col), ("item_id", queries, item_col))}
    arrow = {"item_id": to_arrow_type(queries.schema[item_col].dataType), "doc_id": to_arrow_type(docs.schema[id_col].dataType)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, terms, vocabulary = items.value
        best, query = [Best(top) for _ in ids], np.zeros(len(vocabulary), np.int64)
        for tree in trees(batches, of.value):
            for its, mine in zip(terms, best, strict=True):
                query[its] = 1
                tree.search(query, its, mine)
                mine.cut()
                query[its] = 0
        rows = [(i, d, score) for i, mine in zip(ids, best, strict=True) for score, d in mine.rows]
        item, doc, score = zip(*rows, strict=True) if rows else ((), (), ())
        yield pa.RecordBatch.from_pydict({"item_id": pa.array(item, arrow["item_id"]), "doc_id": pa.array(doc, arrow["doc_id"]), "score": pa.array(score, pa.int64())})

    return found.mapInArrow(run, f"item_id {kinds['item_id']}, doc_id {kinds['doc_id']}, score long")


def lexical_search(
    docs: DataFrame, queries: DataFrame, top: int = TOP, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """item_id, rank (from 1), doc_id, score of each item's ``top`` best documents with a score above 0, equal scores by doc_id.

    Items whose terms no document holds, and items without terms, have no rows; null texts have no terms. Rows of
    ``queries`` with one id are one item with the terms of all. Rows of ``docs`` that repeat are documents of their own,
    null ids come first among equal scores. Other columns are not read.
    """
    n, size = queries.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(F.col(item_text_col))), F.lit(0))).first()
    blocks = max(1, -(-n // BLOCK_ITEMS), -(-size // BLOCK_BYTES))
    block = F.pmod(F.xxhash64(F.col(item_col)), F.lit(blocks))
    parts = [search_block(docs, queries.where(block == k), top, id_col, text_col, item_col, item_text_col) for k in range(blocks)]
    found = functools.reduce(DataFrame.unionByName, parts)
    order = [F.col("score").desc(), F.col("doc_id").asc()]
    salted = Window.partitionBy("item_id", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).orderBy(*order)
    first = found.withColumn("rank", F.row_number().over(salted)).where(F.col("rank") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy(*order))).where(F.col("rank") <= top)
    return ranked.select("item_id", "rank", "doc_id", "score")
