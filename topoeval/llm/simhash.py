"""SimHash near-dedup with pigeonring filtering.

Fingerprint: words are runs without ASCII white space of the text with A-Z lower-cased; the
hashes are XXH64 (seed 42) of all 4-word shingles; a bit is 1 if more than half of them set
it. Texts link if their fingerprints differ in at most TAU bits.

Links are found on the distinct fingerprints only. The 64 bits form a ring of M = 9
segments. If two fingerprints differ in at most TAU bits, then by the pigeonring principle some
start segment exists from which every chain of l consecutive segments differs in at most
floor(l * TAU / M) bits: none in the first two segments, at most one in the first four.
So the first two segments and one of the next two agree: 9 * 2 keys of 21 bits bring
every such pair together. Inside a bucket of equal keys, the chain budgets of all lengths
prune the pairs before the full Hamming check, and a task reports a spanning forest of the links
of the bucket, never all of its pairs.

Crowded buckets (more than BLOCK fingerprints, as near copies of one text make) are not
compared whole. Their fingerprints are first joined to all others within two bits by way of their 64
one-bit neighbours (grouped by a minimum, so no pairs). Then each crowded bucket is cut
into blocks of one such component each, and blocks meet only blocks of other components.
Nothing is capped: every pair of the bucket that is not yet connected is still compared.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topoeval.llm.common import checkpointed, slices, texts, written

SHINGLE = 4
TAU = 4
SEED = 42
BLOCK = 1024
SALTS = 32

#: Ring of nine segments: first bit and width of each, 64 bits in all.
M = 9
WIDTHS = [64 * (k + 1) // M - 64 * k // M for k in range(M)]
STARTS = [64 * k // M for k in range(M)]
MASKS = np.array([((1 << w) - 1) << s for s, w in zip(STARTS, WIDTHS, strict=True)], dtype=np.uint64)


# --- fingerprints -------------------------------------------------------------------------


def shingle_hashes(text: str, width: int = SHINGLE) -> Iterator[np.ndarray]:
    """Hashes of a text's shingles, in arrays of bounded size."""
    import xxhash

    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    width = min(width, len(words))
    starts = np.concatenate(([0], ends[: len(words) - width] + 1)).tolist()
    stops = ends[width - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    for at in range(0, len(starts), 1 << 16):
        part = zip(starts[at : at + (1 << 16)], stops[at : at + (1 << 16)], strict=True)
        yield np.array([digest(joined[a:b], SEED) for a, b in part], dtype=np.uint64)


def fingerprint(text: str, width: int = SHINGLE) -> int:
    """64-bit SimHash; 0 for a text without words."""
    return majority(shingle_hashes(text, width))


def majority(hashes: Iterable[np.ndarray]) -> int:
    """The bits that more than half of the hashes have, 0 if there are none."""
    ones, n = np.zeros(64, dtype=np.int64), 0
    for h in hashes:
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        n += len(h)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = SHINGLE) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every row; a null text has no words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            fp = np.array([fingerprint(x, width) for x in texts(b)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], ["doc_id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, fp long")


# --- links --------------------------------------------------------------------------------


def ring_ok(diff: np.ndarray, tau: int = TAU) -> np.ndarray:
    """For XORs of fingerprints: does some start keep all chains of consecutive segments within
    their proportional budgets?
    """
    counts = np.bitwise_count(diff[:, None] & MASKS[None, :]).astype(np.int16)
    ok = np.ones(counts.shape, dtype=bool)
    total = np.zeros_like(counts)
    for length in range(1, M + 1):
        total = total + np.roll(counts, 1 - length, axis=1)
        ok &= total * M <= length * tau
    return ok.any(axis=1)


def linked(one: np.ndarray, others: np.ndarray, tau: int = TAU) -> np.ndarray:
    """Which of the others are within tau bits of one. Pigeonring first, then all bits."""
    diff = others ^ one
    hit = np.flatnonzero(np.bitwise_count(diff & MASKS[0]) + np.bitwise_count(diff & MASKS[4]) <= tau)
    hit = hit[ring_ok(diff[hit], tau)]
    return hit[np.bitwise_count(diff[hit]) <= tau]


def forest(fps: np.ndarray, tau: int = TAU) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the links among distinct fingerprints (uint64)."""
    left, edges = np.sort(fps), []
    while len(left):
        root, queue, left = int(left[0]), [left[0]], left[1:]
        while queue and len(left):
            hit = linked(queue.pop(), left, tau)
            if len(hit):
                found = left[hit]
                edges += [(root, int(x)) for x in found]
                queue += list(found)
                left = np.delete(left, hit)
    return edges


def ring_keys(fp: str = "fp") -> list:
    """The 18 keys of a fingerprint: segments k, k+1 and one of k+2, k+3, with k and the choice."""

    def segment(k: int):
        k %= M
        return F.shiftrightunsigned(F.col(fp), STARTS[k]).bitwiseAND((1 << WIDTHS[k]) - 1)

    keys = []
    for k in range(M):
        for far in (2, 3):
            parts = [segment(k), segment(k + 1), segment(k + far)]
            key = F.lit(2 * k + far - 2)
            for p in parts:
                key = F.shiftleft(key.cast("long"), 8).bitwiseOR(p)
            keys.append(key)
    return keys


def _bucket_edges(pairs: DataFrame, tau: int) -> DataFrame:
    """(a, b) edges of a forest in each group of (key, fp), groups sorted and of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.empty(0, np.int64), np.empty(0, np.int64)

        def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            cut = np.flatnonzero(np.diff(keys)) + 1
            begin, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(keys)]))
            size, u = end - begin, fps.view(np.uint64)
            two = begin[size == 2]
            diff = u[two] ^ u[two + 1]
            good = ring_ok(diff, tau) & (np.bitwise_count(diff) <= tau) & (diff != 0)
            a, b = [u[two[good]]], [u[two[good] + 1]]
            for s, e in zip(begin[size > 2].tolist(), end[size > 2].tolist(), strict=True):
                if found := forest(np.unique(u[s:e]), tau):
                    x = np.array(found, dtype=np.uint64)
                    a.append(x[:, 0])
                    b.append(x[:, 1])
            cols = [np.concatenate(x).view(np.int64) for x in (a, b)]
            return pa.RecordBatch.from_arrays([pa.array(x) for x in cols], ["a", "b"])

        for batch in batches:
            keys = np.concatenate((held_k, batch.column(0).to_numpy()))
            fps = np.concatenate((held_f, batch.column(1).to_numpy()))
            if not len(keys):
                continue
            last = int(np.searchsorted(keys, keys[-1]))  # the last group may go on
            held_k, held_f = keys[last:], fps[last:]
            if last:
                yield edges(keys[:last], fps[:last])
        if len(held_k):
            yield edges(held_k, held_f)

    return (
        pairs.select("key", "fp").repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long")
    )


def _two_bit_edges(fps: DataFrame) -> DataFrame:
    """Edges that join all fingerprints within two bits of each other: each meets the least
    fingerprint that shares one of its one-bit neighbours (or is that neighbour).
    """
    flips = F.array(F.lit(0).cast("long"), *(F.lit(-(1 << 63) if k == 63 else 1 << k).cast("long") for k in range(64)))
    near = fps.select("fp", F.explode(flips).alias("bit")).select("fp", F.col("fp").bitwiseXOR(F.col("bit")).alias("z"))
    least = near.groupBy("z").agg(F.min("fp").alias("a"), F.max("fp").alias("top")).filter("a < top")
    return near.join(least, "z").filter("fp != a").select("a", F.col("fp").alias("b")).distinct()


def components(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(node, root): root is the least node of the node's component, for all nodes of edges
    (a, b), which are links in either direction. Min-label rounds with pointer jumping.
    """
    both = checkpointed(edges.union(edges.select("b", "a")).toDF("a", "b").filter("a != b").distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("least")).select(
        "node", F.least("node", "least").alias("root")
    )
    labels = checkpointed(labels)
    while True:
        seen = labels.select(F.col("node").alias("b"), "root")
        low = both.join(seen, "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        hooked = labels.join(low, "node").select("node", "root", F.least("root", "low").alias("next"))
        jump = labels.select(F.col("node").alias("next"), F.col("root").alias("far"))
        new = checkpointed(
            hooked.join(jump, "next").select("node", F.least("next", "far").alias("root"), F.col("root").alias("old"))
        )
        moved = not new.filter("root != old").isEmpty()
        labels = new.select("node", "root")
        if not moved:
            return labels


def links(fps: DataFrame, tau: int = TAU, block: int = BLOCK) -> DataFrame:
    """Edges (a, b) on distinct fingerprints ``fp`` with the same components as all links of at
    most tau bits. The ring keys are laid out for tau = 4.
    """
    if tau > TAU:
        raise ValueError(f"the ring keys find links of at most {TAU} bits")
    keyed = fps.select(F.explode(F.array(*ring_keys())).alias("key"), "fp")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    crowded = checkpointed(sizes.filter(F.col("n") > block))
    if crowded.isEmpty():
        return checkpointed(_bucket_edges(keyed, tau).distinct())
    usual = _bucket_edges(keyed.join(crowded, "key", "left_anti"), tau)

    dense = checkpointed(keyed.join(crowded, "key", "left_semi"))
    near = checkpointed(_two_bit_edges(dense.select("fp").distinct()))
    if tau < 2:
        near = near.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= tau)
    roots = components(near)
    dense = dense.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "key", "fp", F.coalesce("root", "fp").alias("root")
    )
    # blocks: large components are cut by hash, small ones share blocks marked as mixed (-1)
    size = dense.groupBy("key", "root").agg(F.count("*").alias("n"))
    many = size.groupBy("key").agg(F.count("*").alias("n_roots"), F.sum("n").alias("n_key")).filter("n_roots > 1")
    size = size.join(many, "key")
    cut = F.ceil(F.col("n") / block).cast("int")
    kind = F.when(F.col("n") * 2 > block, F.col("root"))  # null: mixed with other small components
    tagged = dense.join(size, ["key", "root"])
    small = tagged.filter(kind.isNull()).groupBy("key").agg(F.ceil(F.count("*") / block).cast("int").alias("n_mixed"))
    tagged = tagged.join(small, "key", "left").select(
        "key",
        "fp",
        F.coalesce(kind, F.lit(None).cast("long")).alias("big"),
        F.when(kind.isNull(), F.pmod(F.xxhash64("fp"), F.col("n_mixed")))
        .otherwise(F.pmod(F.xxhash64("fp"), cut))
        .alias("slot"),
    )
    blocks = checkpointed(tagged)
    ids = blocks.select("key", "big", "slot").distinct()
    ids = ids.withColumn("block", F.xxhash64("key", F.coalesce("big", F.lit(0)), F.col("big").isNull(), "slot"))
    other = ids.select("key", F.col("big").alias("o_big"), F.col("block").alias("o_block"))
    meets = ids.join(other, "key").filter(
        "block <= o_block and (big is null or o_big is null or big != o_big)"
    )  # a pair of blocks of one component is connected already; a mixed block also meets itself
    pair_id = F.xxhash64("key", "block", "o_block")
    sides = meets.select("key", "block", pair_id.alias("pair")).union(
        meets.filter("block != o_block").select("key", "o_block", pair_id)
    )
    located = blocks.withColumn("block", F.xxhash64("key", F.coalesce("big", F.lit(0)), F.col("big").isNull(), "slot"))
    rest = located.join(sides, ["key", "block"]).select(F.col("pair").alias("key"), "fp")
    found = usual.unionByName(_bucket_edges(rest, tau)).unionByName(near.select("a", "b"))
    return checkpointed(found.distinct())


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    width: int = SHINGLE,
    tau: int = TAU,
    block: int = BLOCK,
) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (least doc_id that
    links reach, its own included).

    Texts without words have fingerprint zero and link like any other; a null text is one. Rows
    that repeat are each returned. A null id never is a component_id unless its component has
    no other.
    """
    docs = written(fingerprints(docs, id_col, text_col, width), "fingerprints")
    # rows of one fingerprint, be they a third of all, are spread over salts; a class has those it needs
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    classes = docs.withColumn("salt", salt).groupBy("fp").agg(
        F.min("doc_id").alias("least"), F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts")
    )
    classes = checkpointed(classes)
    roots = components(links(classes.select("fp"), tau, block))
    return labelled(docs, classes, roots, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def labelled(docs: DataFrame, classes: DataFrame, roots: DataFrame, by: str) -> DataFrame:
    """docs (doc_id, by) with component_id, from classes (by, least, salts) and roots (node, root)."""
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    root = roots.withColumnRenamed("node", by)
    joined = root.join(classes, by)
    by_root = joined.groupBy("root").agg(F.min("least").alias("component_id"))
    named = root.join(by_root, "root").select(by, "component_id")
    known = classes.join(named, by, "left").select(
        by,
        F.coalesce("component_id", "least").alias("component_id"),
        F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(salts, s) = 1)")).alias("salt"),
    )
    return docs.withColumn("salt", salt).join(known, [by, "salt"])


def keep_least(docs: DataFrame, id_col: str, text_col: str, operator, **options) -> DataFrame:
    """One row of docs for each component that operator(docs, id, text) finds, all columns: that with
    the least id, null last, then least hash of its text. Rows that share both are one.
    """
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("hash"))
    found = operator(docs.select(key.alias("__key"), F.col(text_col).alias("__text")), "__key", "__text", **options)
    kept = found.filter("doc_id = component_id").groupBy(F.col("doc_id").alias("__kept")).agg((F.count("*") > 1).alias("__many"))
    kept = checkpointed(kept.select("__many", *(F.col(f"__kept.{c}").alias(f"__{c}") for c in ("id", "hash"))))
    rows = docs.withColumn("__row", key.getField("hash")).join(
        kept, F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__row") == F.col("__hash"))
    )
    one = rows.filter("not __many").select(*docs.columns)
    return one.unionByName(rows.filter("__many").dropDuplicates(["__id", "__hash"]).select(*docs.columns))


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row of docs for each component, all columns: that with the least id, null last."""
    return keep_least(docs, id_col, text_col, near_duplicates, **options)
