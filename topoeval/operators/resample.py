"""Bootstraps. A draw is a row number from whole-number arithmetic on (seed, replicate, draw), so any engine can repeat it.

Rows are numbered within their key and cut into chunks of CHUNK. First it is drawn how many of a replicate's draws fall
into each chunk (tasks of some DRAWS draws each, whatever the key's size; a key of one chunk needs none), then each chunk
draws that many of its own rows and adds up their values. Only counts and sums per chunk and block of replicates move; the
values of a chunk go to each block of replicates once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topoeval.functions.lineage import cut
from topoeval.functions.ranges import numbers, quantiles, ranked, running_sum, with_count

REPLICATES = 10_000
CHUNK = 4096
#: Draws of a task, replicates of a block at most.
DRAWS, BLOCK = 1 << 24, 1000
#: For the AUC: rows of a range of scores, draws made at a time, blocks of replicates at most.
SCORES, PIECE, BLOCKS = 1 << 20, 1 << 16, 64
PRIME = 2**31 - 1


#: After each part: (bits to turn, factor, modulus) of the steps that mix a number.
STEPS = [(0, 48271, PRIME), (0x2A5A5A5A, 69621, 2**31 - 249), (0x155F3C3C, 40692, PRIME), (0x3C1E0F87, 16807, 2**31 - 249)]


def mixed(*parts) -> np.ndarray:
    """A number from whole numbers below PRIME (arrays or scalars): bits are turned, then multiplied modulo a prime, by turns."""
    h = np.int64(7)
    for p in parts:
        h = h ^ np.asarray(p, np.int64)
        for bits, factor, modulus in STEPS:
            h = ((h ^ bits) * factor) % modulus
    return h


def mixed_column(*parts: Column) -> Column:
    """mixed() as a Column."""
    h = F.lit(7).cast("long")
    for p in parts:
        h = h.bitwiseXOR(p.cast("long"))
        for bits, factor, modulus in STEPS:
            h = (h.bitwiseXOR(F.lit(bits).cast("long")) * factor) % modulus
    return h


def _lists(values: np.ndarray, width: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, values.size + 1, width, dtype=np.int32)), pa.array(values.ravel()))


def chunk_counts(blocks: DataFrame, keys: Sequence[str], seed: int) -> DataFrame:
    """keys, chunk, reps, counts: for blocks(keys, n, reps) how many of the n draws of each replicate fall into each chunk."""
    schema = ", ".join(f"{k} {blocks.schema[k].dataType.simpleString()}" for k in keys) + ", chunk long, reps array<bigint>, counts array<bigint>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in range(b.num_rows):
                n, reps = b.column(len(keys))[row].as_py(), b.column(len(keys) + 1)[row].as_py()
                chunks = -(-n // CHUNK)
                found = np.zeros((chunks, len(reps)), np.int64)
                if chunks == 1:
                    found[:] = n
                for k, rep in enumerate(reps if chunks > 1 else []):
                    for at in range(0, n, DRAWS):
                        drawn = mixed(seed, rep, np.arange(at, min(n, at + DRAWS))) % n
                        found[:, k] += np.bincount(drawn // CHUNK, minlength=chunks)
                same = [pa.array([b.column(i)[row].as_py()] * chunks, b.schema.field(i).type) for i in range(len(keys))]
                every = _lists(np.tile(np.array(reps, np.int64), chunks), len(reps))
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(chunks), pa.int64()), every, _lists(found, len(reps))], [*keys, "chunk", "reps", "counts"])

    return blocks.select(*keys, "n", "reps").mapInArrow(run, schema)


def _sums(met: DataFrame, keys: Sequence[str], width: int, seed: int) -> DataFrame:
    """keys, rep, s0, s1, ...: for rows (keys, chunk, values, reps, counts) the sums over the rows drawn in the chunk."""
    schema = ", ".join(f"{k} {met.schema[k].dataType.simpleString()}" for k in keys) + ", rep long" + "".join(f", s{i} double" for i in range(width))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = len(keys)
        for b in batches:
            for row in range(b.num_rows):
                chunk = b.column(at)[row].as_py()
                values = np.array(b.column(at + 1)[row].as_py(), float).reshape(-1, width)
                reps, counts = (np.array(b.column(at + k)[row].as_py(), np.int64) for k in (2, 3))
                out = np.zeros((len(reps), width))
                step = max(1, DRAWS // max(1, int(counts.max(initial=1))) // 8)
                for a in range(0, len(reps), step):
                    c = counts[a : a + step]
                    owner = np.repeat(np.arange(len(c)), c)
                    inner = np.arange(len(owner)) - np.repeat(np.cumsum(c) - c, c)
                    drawn = values[mixed(seed, reps[a : a + step][owner], chunk, inner) % len(values)]
                    for k in range(width):
                        out[a : a + step, k] = np.bincount(owner, drawn[:, k], len(c))
                same = [pa.array([b.column(i)[row].as_py()] * len(reps), b.schema.field(i).type) for i in range(at)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(reps), *(pa.array(out[:, k]) for k in range(width))], [*keys, "rep", *(f"s{k}" for k in range(width))])

    return met.select(*keys, "chunk", "values", "reps", "counts").mapInArrow(run, schema)


def resampled(rows: DataFrame, keys: Sequence[str], order: Sequence[str], values: Sequence[str], blocks: DataFrame, seed: int) -> DataFrame:
    """keys, rep, s0, s1, ... and n: sums of the values over n draws of a key's n rows, for every replicate of blocks(keys,
    reps). The order numbers the rows and must be unique within a key; keys are not null.
    """
    numbered = cut(ranked(rows.select(*keys, *order, *[F.col(v).cast("double").alias(f"__v{i}") for i, v in enumerate(values)]), keys, order, "__r"))
    sizes = numbered.groupBy(*keys).agg(F.max("__r").alias("n"))
    own = F.sort_array(F.collect_list(F.struct("__r", F.array(*[f"__v{i}" for i in range(len(values))]).alias("v"))))
    chunks = numbered.groupBy(*keys, F.floor((F.col("__r") - 1) / CHUNK).alias("chunk")).agg(F.flatten(F.transform(own, lambda x: x["v"])).alias("values"))
    asked = blocks.join(sizes, list(keys)).repartition(*keys, F.element_at("reps", 1))
    counts = chunk_counts(asked, keys, seed)
    met = counts.join(chunks, [*keys, "chunk"]).repartition(*keys, "chunk", F.element_at("reps", 1))
    sums = _sums(met, keys, len(values), seed + 1).groupBy(*keys, "rep").agg(*[F.sum(f"s{i}").alias(f"s{i}") for i in range(len(values))])
    return sums.join(sizes, list(keys))


def _blocks(sizes: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """keys, reps: replicates 1 ... in blocks of some DRAWS draws."""
    per = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(F.lit(DRAWS) / F.col("n")))).cast("long")
    first = sizes.withColumn("per", per).withColumn("first", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(replicates).cast("long"), F.col("per"))))
    return first.select(*keys, F.sequence("first", F.least(F.col("first") + F.col("per") - 1, F.lit(replicates))).alias("reps"))


def _interval(df: DataFrame, stat: str, keys: Sequence[str] = ()) -> DataFrame:
    """keys, boot_mean, ci_low, ci_high, replicates over the replicates of each key."""
    cuts = quantiles(df, stat, [0.025, 0.975], keys, "__q")
    means = df.groupBy(*keys).agg(F.avg(stat).alias("boot_mean"), F.count("*").alias("replicates"))
    both = means.join(cuts, list(keys), "left") if keys else means.join(F.broadcast(cuts), F.lit(True), "left")
    return both.select(*keys, "boot_mean", F.try_element_at("__q", F.lit(1)).alias("ci_low"), F.try_element_at("__q", F.lit(2)).alias("ci_high"), "replicates")


def bootstrap_mean(df: DataFrame, keys: Sequence[str], order: str, value: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Percentile bootstrap of the mean per key; ``order`` numbers the rows and must be unique within a key. Rows without a
    value or with a null key don't count.
    """
    by = list(keys) or ["__key"]
    rows = df if keys else df.withColumn("__key", F.lit(0))
    there = rows.select(*by, order, value).dropna(subset=[*by, value])
    sizes = there.groupBy(*by).agg(F.count("*").alias("n"))
    means = resampled(there, by, [order], [value], _blocks(sizes, by, replicates), seed).withColumn("m", F.col("s0") / F.col("n"))
    return _interval(cut(means.select(*keys, "m")), "m", keys)


def hierarchical_bootstrap(df: DataFrame, outer: str, order: str, value: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Outer groups are drawn, then rows within each draw; a replicate is the mean of the drawn groups' means. A draw of a group is
    a replicate of its own there: number (replicate - 1) * groups + slot.
    """
    there = df.filter(F.col(value).isNotNull() & F.col(outer).isNotNull())
    named = with_count(ranked(there.select(outer).distinct(), [], [outer], "__g"), [], "__groups")
    named = cut(named)
    total = named.agg(F.max("__groups").alias("groups"))
    slots = numbers(total, F.col("groups") * replicates, "slot")
    slots = slots.select("slot", "groups", (F.floor((F.col("slot") - 1) / F.col("groups")) + 1).alias("rep"))
    drawn = slots.withColumn("__g", mixed_column(F.lit(seed), F.col("rep"), F.col("slot") % F.col("groups")) % F.col("groups") + 1).join(named.select("__g", outer), "__g")
    drawn = cut(drawn.select("slot", "rep", outer))
    block = F.floor(F.col("slot") / (F.lit(BLOCK) * F.greatest(F.col("__groups"), F.lit(1))))
    blocks = drawn.join(named.select(outer, "__groups"), outer).groupBy(outer, block.alias("b")).agg(F.sort_array(F.collect_list("slot")).alias("reps")).drop("b")
    inner = resampled(there, [outer], [order], [value], blocks, seed + 1).select(outer, F.col("rep").alias("slot"), (F.col("s0") / F.col("n")).alias("m"))
    by_rep = drawn.join(inner, [outer, "slot"]).groupBy("rep").agg(F.avg("m").alias("m"))
    return _interval(cut(by_rep), "m")


def cluster_bootstrap(df: DataFrame, cluster: str, value: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """Clusters are drawn; a replicate is the mean over all rows of the drawn clusters. Only cluster sums move."""
    one = F.lit(0).alias("__key")
    sums = df.filter(F.col(cluster).isNotNull()).groupBy(one, cluster).agg(F.sum(value).alias("__s"), F.count(value).alias("__k")).filter("__k > 0")
    sums = cut(sums)
    sizes = sums.groupBy("__key").agg(F.count("*").alias("n"))
    drawn = resampled(sums, ["__key"], [cluster], ["__s", "__k"], _blocks(sizes, ["__key"], replicates), seed)
    return _interval(cut(drawn.select((F.col("s0") / F.col("s1")).alias("m"))), "m")


def _draws(sizes: DataFrame, replicates: int, seed: int) -> DataFrame:
    """For rows (keys, n): rep, and __i (1 ... n) drawn n times; the draws of a row are spread over tasks."""
    drawn = numbers(sizes, F.col("n") * replicates, "__d").withColumns({"rep": F.floor((F.col("__d") - 1) / F.col("n")) + 1, "__j": (F.col("__d") - 1) % F.col("n")})
    return drawn.withColumn("__i", mixed_column(F.lit(seed), F.col("rep"), F.col("__j")) % F.col("n") + 1).drop("__d", "__j")


def direction_stability(df: DataFrame, cluster: str, metrics: Sequence[str], target: str, replicates: int = 50, seed: int = 0) -> DataFrame:
    """Per metric: Spearman with the target on all rows, share of cluster-bootstrap replicates of that sign, quantiles."""
    from topoeval.operators.stats import long_metrics, safe_correlation

    long = cut(long_metrics(df.filter(F.col(cluster).isNotNull()), [cluster, target], metrics))
    names = cut(ranked(long.select(cluster).distinct(), [], [cluster], "__i"))
    drawn = _draws(names.agg(F.max("__i").alias("n")), replicates, seed).join(names, "__i").select("rep", cluster)
    # a row for each cluster: whichever side is sent round, it is not a replicate of the rows
    held = drawn.groupBy(cluster).agg(F.collect_list("rep").alias("reps"))
    met = long.join(held, cluster).withColumn("rep", F.explode("reps")).drop("reps")
    reps = cut(safe_correlation(met, ["metric", "rep"], "value", target).select("metric", "rep", F.col("spearman").alias("rho")))
    full = safe_correlation(long, ["metric"], "value", target).select("metric", "spearman")
    cuts = quantiles(reps, "rho", [0.025, 0.975], ["metric"])
    share = reps.join(full, "metric").groupBy("metric", "spearman").agg(F.avg((F.signum("rho") == F.signum("spearman")).cast("double")).alias("sign_stability"))
    return share.join(cuts, "metric", "left").select("metric", "spearman", "sign_stability", F.try_element_at("cuts", F.lit(1)).alias("q025"), F.try_element_at("cuts", F.lit(2)).alias("q975"))


def bootstrap_auc(df: DataFrame, y: str, p: str, order: str, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """AUC replicates with positives and negatives drawn separately (seed and seed + 1). Rows are numbered within their class by
    ``order`` and dealt by ranges of score of some SCORES rows (those of one score stay together). A task draws a block
    of replicates again and counts what falls into its range, so no draw is ever a row; a range sends a replicate's
    numbers of both classes and its pairs in order.
    """
    rows = df.filter(F.col(y).isin(0, 1)).select(F.col(y).cast("int").alias("y"), F.col(p).cast("double").alias("p"), order)
    rows = cut(ranked(rows, ["y"], [order], "i").select("y", "p", (F.col("i") - 1).alias("i")))
    sizes = cut(rows.groupBy().agg(*[F.count_if(F.col("y") == side).alias(f"n{side}") for side in (0, 1)]))
    upto = running_sum(rows.groupBy("p").agg(F.count("*").alias("k")), [], ["p"], upto="k")
    dealt = rows.join(upto.select(F.col("p").alias("at"), F.floor((F.col("upto") - 1) / SCORES).alias("part")), F.col("p").eqNullSafe(F.col("at"))).drop("at")
    per = max(1, -(-replicates // BLOCKS))
    blocks = F.explode(F.sequence(F.lit(1), F.lit(replicates), F.lit(per))).alias("first")
    met = dealt.crossJoin(F.broadcast(sizes)).select("*", blocks)  # one row of sizes

    def run(key: tuple, table: pa.Table) -> pa.Table:
        side, score, i = (table.column(c).to_numpy() for c in ("y", "p", "i"))
        level, at = np.unique(score, return_inverse=True)
        reps = np.arange(key[1].as_py(), min(replicates, key[1].as_py() + per - 1) + 1)
        found = np.zeros((2, len(reps), len(level)), np.int64)
        for s in (0, 1):
            n = table.column(f"n{s}")[0].as_py()
            mine = side == s
            place = np.full(n, -1, np.int32)
            place[i[mine]] = at[mine]
            for k, rep in enumerate(reps if mine.any() else []):
                for low in range(0, n, PIECE):
                    hit = place[mixed(seed + s, rep, np.arange(low, min(n, low + PIECE))) % n]
                    found[s, k] += np.bincount(hit[hit >= 0], minlength=len(level))
        b, a = found
        below = (a * (np.cumsum(b, axis=1) - b / 2)).sum(axis=1)
        cols = [pa.array([key[0].as_py()] * len(reps), pa.int64()), *map(pa.array, (reps, a.sum(axis=1), b.sum(axis=1), below))]
        return pa.table(cols, names=["part", "rep", "a", "b", "below"])

    parts = cut(met.groupBy("part", "first").applyInArrow(run, "part long, rep long, a long, b long, below double"))
    before = Window.partitionBy("rep").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.sum(F.col("below") + F.col("a") * F.coalesce(F.col("before"), F.lit(0))).alias("wins")
    won = parts.withColumn("before", F.sum("b").over(before)).groupBy("rep").agg(wins).crossJoin(F.broadcast(sizes))
    both = F.col("n0") * F.col("n1")
    return _interval(cut(won.select(F.when(both > 0, F.col("wins") / both).alias("m"))), "m")


def binned_bootstrap(df: DataFrame, x: str, value: str, order: str, bins: int = 4, replicates: int = REPLICATES, seed: int = 0) -> DataFrame:
    """bin, boot_mean, ci_low, ci_high, replicates of the value's mean within quantile bins of x."""
    from topoeval.functions.scalars import quantile_bin

    return bootstrap_mean(cut(quantile_bin(df.filter(F.col(x).isNotNull()), x, bins)), ["bin"], order, value, replicates, seed)
