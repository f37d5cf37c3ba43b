"""Runs: stretches of words that repeat with a period, found over tiles of one scale of periods each.

A run is a stretch of at least max(MIN_LENGTH, 2 * period) words with this smallest period, which no neighbouring
word extends. Words a period apart are equal over an interval of positions; such an interval of
period q in [s, 2s) is no shorter than s, so a grid of boundaries s apart has one in it. At a boundary two
Z-functions, of the words after it and of those before it backwards, give how far the words agree with those q
later, for all q of the scale together. Agreement that matters spans several words next to the boundary, so
boundaries whose neighbouring words' fingerprints occur nowhere a period later are passed by.

1. A document is exploded into overlapping tiles: one for the small scales together (``tile`` words and what its
   boundaries may look at), further ones for every scale above, sixteen times as wide as the scale. Tiles of one document are dealt
   over the cluster; a document no longer than a tile is one tile and is solved where it is read.
2. Each tile gives the intervals that its boundaries see, cut off at twice the scale, without those whose words
   repeat with a divisor of the period.
3. The intervals are shuffled by document and period and stitched where they touch.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoeval.llm.bpe import lists
from topoeval.llm.common import slices

MIN_LENGTH = 12
#: Words of a tile of small scales; the first scale, of periods 1 to 7; scales above it are of periods s to 2s - 1.
TILE = 8192
FIRST = 4
#: A tile of a larger scale is so many times as wide.
WIDE = 16
#: A document of at most so many bytes for each word of a tile is one tile.
WORD_BYTES = 8
RUNS = "array<struct<start:bigint,period:bigint,length:bigint>>"


def coded(column: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The words of all texts as numbers, how many each text has, and the words."""
    split = pc.ascii_split_whitespace(column.fill_null(""))
    flat = split.flatten()
    there = pc.not_equal(flat, "")
    owner = np.repeat(np.arange(len(column)), pc.list_value_length(split).to_numpy())
    sizes = np.bincount(owner[there.to_numpy(zero_copy_only=False)], minlength=len(column))
    words = flat.filter(there)
    return words.dictionary_encode().indices.to_numpy().astype(np.int32), sizes, words


def joined(codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts' codes behind each other, a negative number of its own behind each; where each text begins."""
    starts = np.cumsum(sizes + 1) - (sizes + 1)
    out = np.empty(len(codes) + len(sizes), np.int64)
    last = np.zeros(len(out), bool)
    last[starts + sizes] = True
    out[~last] = codes
    out[last] = -1 - np.arange(len(sizes))
    return out, starts


def z_function(x: list, upto: int) -> list[int]:
    """For places 0 ... upto - 1: how long the words from there agree with those from the start (0 for place 0)."""
    n, z, left, right = len(x), [0] * upto, 0, 0
    for i in range(1, upto):
        k = 0
        if i < right:
            k = z[i - left]
            if k < right - i:
                z[i] = k
                continue
            k = right - i
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


@functools.cache
def divisors(q: int) -> tuple[int, ...]:
    """q divided by each of its prime factors."""
    out, rest, f = [], q, 2
    while f * f <= rest:
        if rest % f == 0:
            out.append(q // f)
            while rest % f == 0:
                rest //= f
        f += 1
    return (*out, q // rest) if rest > 1 else tuple(out)


def fingerprints(codes: np.ndarray, m: int) -> np.ndarray:
    """A 64-bit fingerprint of each window of m (3, 4 or 8) words."""
    x = (codes.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    factor = 0xD6E8FEB86659FD93
    two = x[:-1] * np.uint64(factor) + x[1:]
    square = factor * factor % 2**64
    if m == 3:
        return two[:-1] * np.uint64(factor) + x[2:]
    four = two[:-2] * np.uint64(square) + two[2:]
    return four if m == 4 else four[:-4] * np.uint64(square * square % 2**64) + four[4:]


def candidates(prints: np.ndarray, s: int, m: int) -> dict[int, set[int]]:
    """boundary -> periods of the scale for which the m words behind it, or before it, come again a period later."""
    out: dict[int, set[int]] = {}
    for shifted in (prints, np.concatenate((np.arange(m, dtype=np.uint64), prints))):
        blocks = shifted[: len(shifted) // s * s].reshape(-1, s)
        hits = [(blocks[1:] == blocks[:-1, :1], s)]
        if s == FIRST:
            hits.append((blocks[:, 1:] == blocks[:, :1], 1))
        for found, least in hits:
            for j, c in np.argwhere(found).tolist():
                out.setdefault(j * s, set()).add(least + c)
    return out


def intervals(codes: np.ndarray, first: int, last: int) -> np.ndarray:
    """Rows (period, a, e): for a <= i < e the word i equals the word i + period; periods from the scales first ... last.

    Every interval of a run is covered by rows that touch each other, but for what lies beyond the ends of ``codes``.
    """
    rows: list[tuple[int, int, int]] = []
    codes = np.concatenate((codes, np.iinfo(np.int64).min + np.arange(8 * last + 16)))  # numbers that come once
    s = first
    while s <= last:
        m = min(8, max(3, s // 2))
        margin = max(2 * s, 16)
        for b, periods in candidates(fingerprints(codes, m), s, m).items():
            ahead = codes[b : b + 2 * s + margin].tolist()
            z = z_function(ahead, min(2 * s, len(ahead)))
            begin = max(0, b - margin)
            back = codes[begin : b + 2 * s][::-1].tolist()
            before = codes[begin:b][::-1].tolist()
            y = z_function([*before, None, *back], len(before) + 1 + 2 * s)
            for q in periods:
                left, right = y[len(before) + 1 + 2 * s - q], z[q]
                if left + right >= max(q, MIN_LENGTH - q) and not any(z[d] >= q - d for d in divisors(q)):
                    rows.append((q, b - left, b + right))
        s *= 2
    return stitched(np.array(rows, np.int64).reshape(-1, 3))


def stitched(rows: np.ndarray) -> np.ndarray:
    """Rows (period, a, e) in order, those of a period that touch as one."""
    if not len(rows):
        return rows
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    period, a, e = rows.T
    group = np.cumsum(np.diff(period, prepend=period[0]) != 0)
    base = group * (e.max() + 1)
    reach = np.maximum.accumulate(e + base) - base
    new = np.concatenate(([True], (group[1:] != group[:-1]) | (a[1:] > reach[:-1])))
    at = np.flatnonzero(new)
    return np.stack((period[at], a[at], np.maximum.reduceat(e, at)), axis=1)


def bands(n: int, tile: int) -> Iterator[tuple[int, int, int, int, int]]:
    """(first scale, last scale, words of a tile, words before, words behind) of the tiles for a document of n words."""
    first, last = FIRST, FIRST
    while 2 * last <= max(FIRST, tile // WIDE):
        last *= 2
    while first <= max(FIRST, n // 2):
        yield first, last, max(tile, WIDE * last) if first == FIRST else WIDE * last, max(2 * last, 16), max(4 * last, 32)
        first = last = 2 * last


def largest_scale(n: int) -> int:
    """The scale of the largest period that a run of n words can have."""
    s = FIRST
    while 2 * s <= n // 2:
        s *= 2
    return s


_KEY = ["doc_id", "digest"]
_FRAGMENT = ["period", "a", "e"]


def _fragments(key: pa.RecordBatch, codes: np.ndarray, sizes: np.ndarray, offsets: np.ndarray, first: int, last: int) -> pa.RecordBatch:
    line, starts = joined(codes, sizes)
    rows = intervals(line, first, last)
    of = np.searchsorted(starts, rows[:, 1], side="right") - 1
    move = offsets[of] - starts[of]
    columns = [key.column(0).take(pa.array(of)), key.column(1).take(pa.array(of)), *map(pa.array, (rows[:, 0], rows[:, 1] + move, rows[:, 2] + move))]
    return pa.RecordBatch.from_arrays(columns, [*_KEY, *_FRAGMENT])


def fragments(base: DataFrame, tile: int) -> DataFrame:
    """doc_id, digest, period, a, e: what the tiles of all documents (doc_id, digest, text) see.

    One pass over the texts: documents of one tile are solved, longer ones give tiles, and both kinds of rows go on.
    """
    kind = base.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, digest string, period long, a long, e long"
    nothing = {"at": pa.int64(), "first": pa.int32(), "last": pa.int32(), "codes": pa.binary()}

    def tiles(key: pa.RecordBatch, codes: np.ndarray) -> Iterator[pa.RecordBatch]:
        for first, last, width, before, behind in bands(len(codes), tile):
            for core in range(0, max(1, len(codes)), width):
                at = max(0, core - before)
                values = (at, first, last, codes[at : core + width + behind].tobytes())
                columns = [pa.array([v], t) for v, t in zip(values, nothing.values(), strict=True)]
                yield pa.RecordBatch.from_arrays([key.column(0), key.column(1), *[pa.nulls(1, pa.int64())] * 3, *columns], [*_KEY, *_FRAGMENT, *nothing])

    def exploded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, 2):
            short = pc.less_equal(pc.binary_length(b.column(2)), WORD_BYTES * tile)
            own = b.filter(short)
            if own.num_rows:
                codes, sizes, _ = coded(own.column(2))
                found = _fragments(own, codes, sizes, np.zeros(len(sizes), np.int64), FIRST, largest_scale(int(sizes.max())))
                yield pa.RecordBatch.from_arrays([*found.columns, *(pa.nulls(found.num_rows, t) for t in nothing.values())], [*_KEY, *_FRAGMENT, *nothing])
            for k in np.flatnonzero(~short.to_numpy(zero_copy_only=False)).tolist():
                one = b.slice(k, 1)
                yield from tiles(one, coded(one.column(2))[0])

    def solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            there = pc.is_valid(b.column(8))
            yield b.filter(pc.invert(there)).select([*_KEY, *_FRAGMENT])
            for k in np.flatnonzero(there.to_numpy(zero_copy_only=False)).tolist():
                one = b.slice(k, 1)
                at, first, last, packed = (one.column(c)[0].as_py() for c in range(5, 9))
                codes = np.frombuffer(packed, np.int32)
                yield _fragments(one, codes, np.array([len(codes)]), np.array([at]), first, last)

    dealt = base.mapInArrow(exploded, f"{schema}, at long, first int, last int, codes binary").repartition("doc_id", "digest", "first", "at")
    return dealt.mapInArrow(solved, schema)


def runs(base: DataFrame, tile: int = TILE) -> DataFrame:
    """doc_id, digest, start, length, period of every run of the documents (doc_id, digest, text)."""
    by = Window.partitionBy(*_KEY, "period").orderBy("a", "e")
    before = F.max("e").over(by.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col("a") <= F.col("before"), 0).otherwise(1)).over(by.rowsBetween(Window.unboundedPreceding, 0))
    seen = fragments(base, tile).withColumn("before", before).withColumn("island", island)
    one = seen.groupBy(*_KEY, "period", "island").agg(F.min("a").alias("start"), (F.max("e") - F.min("a") + F.col("period")).alias("length"))
    return one.where((F.col("length") >= MIN_LENGTH) & (F.col("length") >= 2 * F.col("period"))).drop("island")


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tile: int = TILE) -> DataFrame:
    """doc_id, n_words, runs (array of start, period, length by start, then period) and collapsed of every row.

    Words are what white space of ASCII separates, numbered from 0. ``collapsed`` is the text's words joined by a
    space, without those that a run holds beyond its first period. Null and empty texts have no words, no runs and
    an empty ``collapsed``. Rows that repeat are each returned; rows with equal ids and different texts, or null
    ids, are told apart by the text. ``tile`` (words of a tile) changes no result.
    """
    whole = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    base = whole.withColumn("digest", F.sha2("text", 256)).select("doc_id", "digest", "text")
    # the runs of a document are fewer than its words
    found = runs(base, tile).groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("start", "period", "length"))).alias("runs"))
    other = found.select(F.col("doc_id").alias("i"), F.col("digest").alias("d"), "runs")
    both = base.join(other, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("d")), "left")
    rows = both.select("doc_id", "text", F.coalesce("runs", F.array().cast(RUNS)).alias("runs"))
    kind = docs.schema[id_col].dataType.simpleString()

    def collapse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            _, sizes, words = coded(b.column(1))
            starts = np.cumsum(sizes) - sizes
            change = np.zeros(len(words) + 1, np.int64)
            flat = b.column(2).flatten()
            base = np.repeat(starts, pc.list_value_length(b.column(2)).to_numpy())
            start, period, length = (flat.field(k).to_numpy() for k in range(3))
            np.add.at(change, base + start + period, 1)
            np.add.at(change, base + start + length, -1)
            keep = np.cumsum(change)[:-1] == 0
            owner = np.repeat(np.arange(len(sizes)), sizes)
            kept = np.bincount(owner[keep], minlength=len(sizes))
            text = pc.binary_join(lists(words.filter(pa.array(keep)), kept), " ")
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), b.column(2), text], ["doc_id", "n_words", "runs", "collapsed"])

    return rows.mapInArrow(collapse, f"doc_id {kind}, n_words long, runs {RUNS}, collapsed string")
