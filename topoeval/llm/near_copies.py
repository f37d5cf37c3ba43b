"""Near copies by exact similarity: texts link if their sets of five-word shingles have Jaccard 0.8 or more.

The first candidates are what SimHash fingerprints of these shingles link by pigeonring filtering (see simhash.py), confirmed
on the whole sets. Fingerprints miss most sets of Jaccard 0.8, so what they have not connected goes by
prefix filtering, which loses no pair: in any one order of all shingles, two sets of n and m
shingles with Jaccard of at least t have a shingle in common among the first n - ceil(t n) + 1 of the one
and the first m - ceil(t m) + 1 of the other. The order is by how many texts have a shingle, as counted over all texts in
TALLY cells by hash, then by hash (so a passage that several texts share brings nobody together unless it is most of
the text); what shares a cell changes the cost only, never the result. Where two sets first meet in that order, they
can have no more in common than what is left of the shorter rest (positional filter). Every candidate pair that counts is
confirmed on the whole sets.

Members of a group with a shingle in common that can link with none of the sizes there by the positional filter leave it.
Only components are wanted, so groups of more than SMALL sets are then compared with one of their members: first with
the one that has the least share of rarer shingles before the common one (the text that near copies were made of, where it is
there), then with others (up to STARS times, while that spares a tenth of the comparisons left or these are many);
then all pairs of such a group that are not yet connected are compared. A group whose members could all link by the positional
filter and do not is compared at a cost that grows with its square.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoeval.llm.common import discard, slices, texts, written
from topoeval.llm.simhash import SALTS, components, labelled, keep_least, links, majority, shingle_hashes

SHINGLE = 5
SIMILAR = Fraction(4, 5)
SMALL = 4
CELLS = 128
#: Cells of a fine sketch at most.
FINE = 1 << 15
STARS = 4
#: Stars that one set is compared with in a round: those that come first by hash, which most of a group share.
PICKS = 4
#: Another round of stars is worth while if the last one left at most this share of the open pairs, or if more than so
#: many a member are open. The result is the same with any.
WORTH, CROWDED = 0.9, 64
#: Ids of sets that are broadcast at most (16 bytes each).
WANTED = 200_000
#: Cells that count in how many texts a shingle is, for the order of shingles (16 bits each are broadcast); cells sent at a time.
TALLY, PIECE = 1 << 22, 1 << 16


def shingle_set(text: str, width: int = SHINGLE) -> np.ndarray:
    """Sorted distinct hashes of a text's shingles; a text of fewer words is one shingle, one without words none."""
    return _distinct(list(shingle_hashes(text, width)))


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint64)


def prefix(own: np.ndarray, counts: np.ndarray, similar: Fraction = SIMILAR) -> np.ndarray:
    """The first shingles of a sorted set in the order (count of the cell, hash)."""
    if not len(own):
        return own
    n = len(own)
    first = np.argsort(counts[(own % np.uint64(len(counts))).astype(np.int64)], kind="stable")
    return own[first[: n - -(-similar.numerator * n // similar.denominator) + 1]]


def shingle_counts(docs: DataFrame, text_col: str, width: int = SHINGLE) -> np.ndarray:
    """In how many texts the shingles of each cell are (65,535 at most): TALLY numbers, whatever the data. Each task sends its
    own counts in pieces, which are added up piece by piece.
    """
    cells = TALLY
    piece = min(cells, PIECE)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(cells, np.uint32)
        for b in slices(batches, 0):
            for x in texts(b, 0):
                np.add.at(held, (shingle_set(x, width) % np.uint64(cells)).astype(np.int64), np.uint32(1))
        yield from sent(held.reshape(-1, piece))

    def sent(pieces: np.ndarray) -> Iterator[pa.RecordBatch]:
        for k, of in enumerate(pieces):
            if of.any():
                counts = np.minimum(of, 65_535).astype(np.uint16).tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([counts], pa.binary())], ["piece", "counts"])

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for b in batches:
            for k, of in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                held[k] = held.get(k, 0) + np.frombuffer(of.as_py(), np.uint16).astype(np.uint32)
        for k, of in held.items():
            yield from (pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), b.column(1)], ["piece", "counts"]) for b in sent(of[None]))

    schema = "piece int, counts binary"
    parts = docs.select(text_col).mapInArrow(tally, schema).repartition("piece").mapInArrow(added, schema)
    out = np.zeros((cells // piece, piece), np.uint16)
    for row in parts.toLocalIterator():
        out[row.piece] = np.frombuffer(row.counts, np.uint16)
    return out.ravel()


def _signed(docs: DataFrame, id_col: str, text_col: str, width: int, similar: Fraction) -> DataFrame:
    """doc_id, sid (64-bit hash of the shingle set), n (its size), fp (SimHash), prefix and sketch of every row."""
    counts = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, text_col, width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            sids, sizes, fps, prefixes, sketches = [], [], [], [], []
            for x in texts(b):
                hashes = list(shingle_hashes(x, width))
                own = _distinct(hashes)
                fps.append(majority(hashes))
                sids.append(int.from_bytes(hashlib.blake2b(own.tobytes(), digest_size=8).digest(), "little", signed=True))
                sizes.append(len(own))
                prefixes.append(prefix(own, counts.value, similar).view(np.int64))
                sketches.append(sketch(own))
            fp = pa.array(np.array(fps, np.uint64).view(np.int64))
            cols = [b.column(0), pa.array(sids, pa.int64()), pa.array(sizes, pa.int64()), fp, pa.array(prefixes, pa.list_(pa.int64())), pa.array(sketches, pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "sid", "n", "fp", "prefix", "sketch"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, sid long, n long, fp long, prefix array<long>, sketch binary")


def _sets(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, width: int) -> DataFrame:
    """sid, fine (sketch) and own (the whole set) for the wanted (doc_id, sid), one row each. At most WANTED of them are
    broadcast, so that the texts stay where they are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            own = [shingle_set(x, width) for x in texts(b)]
            fine = pa.array([fine_sketch(x) for x in own], pa.binary())
            whole = pa.array([x.view(np.int64) for x in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([b.column(0), fine, whole], ["sid", "fine", "own"])

    # repeated ids may carry other texts: those have another set, and the hash tells
    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in run(batches):
            good = [
                int.from_bytes(hashlib.blake2b(x.values.to_numpy().tobytes(), digest_size=8).digest(), "little", signed=True) == s.as_py()
                for s, x in zip(b.column(0), b.column(2), strict=True)
            ]
            yield b.filter(pa.array(good, pa.bool_()))

    ids = written(wanted.select(F.col("doc_id").alias("__id"), "sid").distinct(), "wanted-sets")
    ids = F.broadcast(ids) if ids.count() <= WANTED else ids
    found = docs.select(F.col(id_col).alias("__own"), F.col(text_col).alias("text")).join(ids, F.col("__own").eqNullSafe(F.col("__id")))
    return found.select("sid", "text").mapInArrow(check, "sid long, fine binary, own array<long>").dropDuplicates(["sid"])


def _can_link(n: str, at: str, m: str, to: str, similar: Fraction) -> Column:
    """Whether sets of n and m shingles that first meet at these places of their orders are of near sizes and have enough left."""
    sizes = F.least(n, m) * similar.denominator >= F.greatest(n, m) * similar.numerator
    left = F.least(F.col(n) - F.col(at), F.col(m) - F.col(to))
    return sizes & (left * (similar.numerator + similar.denominator) >= (F.col(n) + F.col(m)) * similar.numerator)


def _reach(n: str, at: str, similar: Fraction) -> Column:
    """Sets of m shingles can link with one of n that meets them at this place only if m * numerator is not more."""
    return F.col(n) * similar.denominator - F.col(at) * (similar.numerator + similar.denominator)


def _live(n: str, at: str, similar: Fraction) -> Column:
    """Whether a set can link with any in a group of which ``low`` is the least size and ``high`` the greatest reach."""
    return (_reach(n, at, similar) >= F.col("low") * similar.numerator) & (F.col("high") >= F.col(n) * similar.numerator)


def sketch(own: np.ndarray) -> bytes:
    """How many shingles of a set fall into each of CELLS cells; all 255 if a cell has that many."""
    n = np.bincount((own.view(np.uint64) % CELLS).astype(np.int64), minlength=CELLS)
    return (n if n.max() < 255 else np.full(CELLS, 255)).astype(np.uint8).tobytes()


def possible(one: np.ndarray, two: np.ndarray, similar: Fraction = SIMILAR) -> np.ndarray:
    """Rows of sketches (uint8) whose sets can be similar: no cell has more in common than the lesser count."""
    shared, total = np.minimum(one, two).sum(axis=1, dtype=np.int64), one.sum(axis=1, dtype=np.int64) + two.sum(axis=1, dtype=np.int64)
    full = (one.max(axis=1) == 255) | (two.max(axis=1) == 255)
    return full | (shared * (similar.numerator + similar.denominator) >= total * similar.numerator)


def fine_sketch(own: np.ndarray) -> bytes:
    """As sketch, in at least as many cells as the set has shingles (a power of two, FINE at most) of four bits each; all
    15 if a cell has that many.
    """
    cells = min(FINE, max(CELLS, 1 << (len(own) - 1).bit_length() if len(own) else 1))
    n = np.bincount((own.view(np.uint64) % cells).astype(np.int64), minlength=cells)
    n = (n if n.max() < 15 else np.full(cells, 15)).astype(np.uint8)
    return (n[0::2] | n[1::2] << 4).tobytes()


def finely_possible(one: bytes, two: bytes, similar: Fraction = SIMILAR) -> bool:
    """As possible, by fine sketches: the one with more cells is folded to the cells of the other."""
    counts = []
    for x in (one, two):
        packed = np.frombuffer(x, np.uint8)
        counts.append(np.stack((packed & 15, packed >> 4), axis=1).ravel())
    if max(c.max() for c in counts) == 15:
        return True
    a, b = sorted(counts, key=len)
    b = b.reshape(-1, len(a)).sum(axis=0, dtype=np.int64)
    shared, total = int(np.minimum(a, b).sum(dtype=np.int64)), int(a.sum(dtype=np.int64) + b.sum())
    return shared * (similar.numerator + similar.denominator) >= total * similar.numerator


def _met(pairs: DataFrame, sets: DataFrame, col: str) -> DataFrame:
    """(a, b, one, two): the pairs with col of both sets. One side may be in many pairs: it is salted."""
    pairs = pairs.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))
    left = pairs.groupBy("a").agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    left = left.join(sets.select(F.col("sid").alias("a"), F.col(col).alias("one")), "a").select(
        "a", "one", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(salts, s) = 1)")).alias("salt")
    )
    right = pairs.join(sets.select(F.col("sid").alias("b"), F.col(col).alias("two")), "b")
    return right.join(left, ["a", "salt"]).select("a", "b", "one", "two")


def _confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similar: Fraction) -> DataFrame:
    """The distinct pairs (a, b) of which the sets are similar, written. Sketches go first; only sets in pairs that these
    leave are made again from their texts, and only those in pairs that their fine sketches leave are compared whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            one, two = (np.frombuffer(b"".join(b.column(k).to_pylist()), np.uint8).reshape(-1, CELLS) for k in (2, 3))
            yield b.select(["a", "b"]).filter(pa.array(possible(one, two, similar), pa.bool_()))

    def finely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [finely_possible(x.as_py(), y.as_py(), similar) for x, y in zip(b.column(2), b.column(3), strict=True)]
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    left = written(_met(pairs.distinct(), classes, "sketch").mapInArrow(run, "a long, b long"), "near-pairs")
    if left.isEmpty():
        return left
    ends = left.select(F.col("a").alias("sid")).union(left.select("b")).distinct()
    wanted = ends.join(classes.select("sid", F.col("least").alias("doc_id")), "sid")
    sets = written(_sets(docs, id_col, text_col, wanted, width), "shingle-sets")
    close = written(_met(left, sets, "fine").mapInArrow(finely, "a long, b long"), "close-pairs")
    total = F.size("one") + F.size("two")
    shared = F.size(F.array_intersect("one", "two"))
    both = _met(close, sets, "own")
    both = both.filter(shared * (similar.numerator + similar.denominator) >= total * similar.numerator)
    found = written(both.select("a", "b"), "near-links")
    discard(left, sets, close)
    return found


def _by_fingerprint(classes: DataFrame) -> DataFrame:
    """Pairs (a, b) of sets that the fingerprints bring together: sets of one fingerprint with the least of them, and the least
    sets of two fingerprints that simhash.links joins.
    """
    sets = classes.select("sid", "fp", "n")
    least = F.min(F.struct("sid", "n"))
    first = written(sets.groupBy("fp").agg(least.alias("s")).select("fp", F.col("s.sid").alias("a"), F.col("s.n").alias("n")), "near-fingerprints")
    same = sets.select("fp", F.col("sid").alias("b"), F.col("n").alias("m")).join(first, "fp").filter("a < b")
    near = links(first.select("fp")).toDF("fp", "to").join(first, "fp").join(first.toDF("to", "b", "m"), "to")
    return same.select("a", "n", "b", "m").unionByName(near.select(F.least("a", "b").alias("a"), "n", F.greatest("a", "b").alias("b"), "m"))


def _roots(classes: DataFrame, docs: DataFrame, id_col: str, text_col: str, width: int, similar: Fraction) -> DataFrame:
    """(node, root) of the distinct sets with links: the components of all links. They are found anew only if a round has links."""
    keyed = classes.select("sid", "n", F.posexplode("prefix").alias("at", "token"))
    bounds = [F.min("n").alias("low"), F.max(_reach("n", "at", similar)).alias("high")]
    sizes = written(keyed.groupBy("token").agg(F.count("*").alias("size"), *bounds).filter("size > 1"), "shared-sizes")
    live = keyed.join(sizes, "token").filter(_live("n", "at", similar)).drop("low", "high")
    shared = written(live, "shared-shingles")
    discard(sizes)
    made = (classes, docs, id_col, text_col, width, similar)

    near = _by_fingerprint(classes).filter(F.least("n", "m") * similar.denominator >= F.greatest("n", "m") * similar.numerator)
    alike = _confirmed(near.select("a", "b"), *made)

    few = shared.filter(F.col("size") <= SMALL).select("token", F.col("sid").alias("a"), "n", "at")
    more = few.toDF("token", "b", "m", "to")
    pairs = few.join(more, "token").filter((F.col("a") < F.col("b")) & _can_link("n", "at", "m", "to", similar))
    edges = written(alike.union(_confirmed(pairs.select("a", "b").join(alike, ["a", "b"], "left_anti"), *made)), "near-edges")

    # tables are written, not checkpointed: a checkpoint keeps its plan's constraints, which grow from round to round
    crowd = shared.filter(F.col("size") > SMALL).select("token", "sid", "n", "at")
    roots = components(edges)
    if crowd.isEmpty():
        return roots
    left, before = None, [shared]
    for k in range(STARS + 1):
        known = crowd.join(roots.withColumnRenamed("node", "sid"), "sid", "left").select("token", "sid", "n", "at", F.coalesce("root", "sid").alias("root"))
        rarer = F.col("at") / F.col("n") if k == 0 else F.lit(0.0)
        least = F.struct(rarer.alias("rarer"), F.xxhash64("sid", F.lit(k)).alias("hash"), "sid", "n", "at", "root")
        parts = known.groupBy("token", "root").agg(F.count("*").cast("double").alias("size"), F.min(least).alias("star"), *bounds)
        open_ = parts.groupBy("token").agg(
            F.count("*").alias("roots"), F.sum("size").alias("size"), (F.pow(F.sum("size"), 2) - F.sum(F.pow("size", 2))).alias("pairs"),
            F.min("star").alias("star"), F.min("low").alias("low"), F.max("high").alias("high"),
        )
        open_ = written(open_.filter("roots > 1").select("token", "size", "pairs", "star", "low", "high"), "near-open")
        members, pairs_left = open_.agg(F.sum("size"), F.sum("pairs") / 2).first()
        if members is None:
            break
        known = known.join(open_.select("token", "star", "low", "high"), "token").filter(_live("n", "at", similar))
        known = written(known.drop("low", "high"), "near-known")
        discard(*before, open_)
        before = [known]
        crowd = known.select("token", "sid", "n", "at")
        stars = k < STARS and (left is None or pairs_left <= WORTH * left or pairs_left > CROWDED * members)
        left = pairs_left
        if stars:
            pairs = known.select(F.col("star.sid").alias("a"), F.col("star.n").alias("n"), F.col("star.at").alias("at"), F.col("star.root").alias("r"), F.col("sid").alias("b"), F.col("n").alias("m"), F.col("at").alias("to"), "root")
            pairs = pairs.filter((F.col("r") != F.col("root")) & _can_link("n", "at", "m", "to", similar))
            first = F.slice(F.sort_array(F.collect_set(F.struct(F.xxhash64("a", F.lit(k)).alias("hash"), "a"))), 1, PICKS)  # of a prefix's stars
            pairs = pairs.groupBy("b").agg(first.alias("s")).select(F.explode("s.a").alias("a"), "b")
        else:
            one = known.select("token", F.col("sid").alias("a"), "n", "at", F.col("root").alias("r"))
            two = known.select("token", F.col("sid").alias("b"), F.col("n").alias("m"), F.col("at").alias("to"), "root")
            pairs = one.join(two, "token").filter((F.col("a") < F.col("b")) & (F.col("r") != F.col("root")) & _can_link("n", "at", "m", "to", similar))
        found = _confirmed(pairs.select("a", "b"), *made)
        if not found.isEmpty():
            edges, old = written(edges.union(found), "near-edges"), [edges, found]
            roots = components(edges)
            discard(*old)
        if not stars:
            break
    return roots


def near_copies(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE, similar: Fraction = SIMILAR
) -> DataFrame:
    """One row per input row: doc_id and component_id (least doc_id that links reach, its own included).

    Texts without words, null texts among them, are copies of each other.
    """
    rows = written(_signed(docs, id_col, text_col, width, similar), "near-copies")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    classes = rows.withColumn("salt", salt).groupBy("sid").agg(
        F.min("doc_id").alias("least"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"),
        F.first("n").alias("n"),
        F.min("fp").alias("fp"),  # texts that repeat other shingles of a set have others
        F.first("prefix").alias("prefix"),
        F.first("sketch").alias("sketch"),
    )
    classes = written(classes, "shingle-classes")
    roots = _roots(classes, docs, id_col, text_col, width, similar)
    return labelled(rows.select("doc_id", "sid"), classes.select("sid", "least", "salts"), roots, "sid").select("doc_id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each component of near copies, all columns: that with the least id, null last."""
    return keep_least(docs, id_col, text_col, near_copies, **options)
