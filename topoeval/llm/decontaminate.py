"""Benchmark decontamination, natively: n-gram windows against a broadcast hash set.

Words are the runs of ASCII letters, ASCII digits and non-ASCII characters of the text with
A-Z lower-cased. Every benchmark item gives its windows of WINDOW consecutive words (one
window with all words if it has fewer). Every document window of such a length is hashed and
probed against the benchmark's windows; a hash hit is verified word by word. All of this
is one pass over the documents: what is shuffled is one row per document and the hits.

The benchmark side is broadcast only if it has at most MAX_BROADCAST_WINDOWS windows (about
100 bytes each); a larger benchmark is joined by hash with an ordinary shuffle join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoeval.llm.common import ascii_lower

WINDOW = 10
MAX_BROADCAST_WINDOWS = 200_000
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Array of the words of a text; empty for null."""
    low = ascii_lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(low, NOT_WORD), "")


def benchmark_windows(
    benchmark: DataFrame, window: int = WINDOW, item_col: str = "item_id", text_col: str = "text"
) -> DataFrame:
    """Distinct windows: len, hash, gram (array of words), items (sorted item ids as strings).

    Items without words give none; an item whose id is null counts for hits and is not listed.
    """
    items = benchmark.select(
        F.col(item_col).cast("string").alias("item"), words(F.col(text_col)).alias("w")
    ).filter("size(w) > 0")
    length = F.least(F.size("w"), F.lit(window))
    grams = (
        items.withColumn("len", length)
        .select(
            "item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("i")
        )
        .select("item", "len", F.slice("w", F.col("i"), F.col("len")).alias("gram"))
    )
    return (
        grams.groupBy("len", "gram")
        .agg(F.array_sort(F.collect_set("item")).alias("items"))
        .withColumn("hash", F.xxhash64("gram"))
    )


def window_hits(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_broadcast: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """Rows (row, doc_id, n_words, i, len, items): one with i null for each document, and one for
    each of its windows that the benchmark has. ``row`` tells rows with equal ids apart.
    """
    grams = benchmark_windows(benchmark, window)
    size = grams.groupBy("len").count().collect()  # at most `window` rows
    lengths = sorted(r["len"] for r in size)
    if sum(r["count"] for r in size) <= max_broadcast:
        grams = F.broadcast(grams)
    tokens = docs.select(
        F.monotonically_increasing_id().alias("row"),
        F.col(id_col).alias("doc_id"),
        words(F.col(text_col)).alias("w"),
    )
    # position 0 stands for the document itself and meets no window
    at = tokens.select("row", "doc_id", "w", F.explode(F.sequence(F.lit(0), F.size("w"))).alias("i"))
    if len(lengths) == 1:
        at = at.withColumn("len", F.lit(lengths[0]))
    elif lengths:
        at = at.select("*", F.explode(F.array(*map(F.lit, lengths))).alias("len"))
    else:
        at = at.filter("i = 0").withColumn("len", F.lit(0))
    whole = (F.col("i") > 0) & (F.col("i") + F.col("len") - 1 <= F.size("w"))
    probe = at.select(
        "row",
        "doc_id",
        F.size("w").alias("n_words"),
        "i",
        "len",
        F.when(whole, F.slice("w", F.greatest("i", F.lit(1)), F.col("len"))).alias("gram"),
    ).withColumn("hash", F.when(F.col("gram").isNotNull(), F.xxhash64("gram")))
    hit = probe.join(grams.withColumnsRenamed({"len": "b_len", "gram": "b_gram", "hash": "b_hash"}),
        (F.col("hash") == F.col("b_hash")) & (F.col("len") == F.col("b_len")) & (F.col("gram") == F.col("b_gram")),
        "left",
    )
    return hit.filter("i = 0 or items is not null").select(
        "row", "doc_id", "n_words", F.when(F.col("i") > 0, F.col("i")).alias("i"), "len", "items"
    )


def contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    window: int = WINDOW,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_broadcast: int = MAX_BROADCAST_WINDOWS,
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_hit, items (sorted), spans (merged word ranges).

    A word inside any occurrence of a benchmark window is hit. Null and wordless texts have
    no words and no hits; rows with equal or null ids stay apart.
    """
    hits = window_hits(docs, benchmark, window, id_col, text_col, max_broadcast)
    by_doc = hits.groupBy("row").agg(
        F.first("doc_id").alias("doc_id"),
        F.max("n_words").alias("n_words"),
        F.array_sort(
            F.collect_set(F.when(F.col("i").isNotNull(), F.struct("i", (F.col("i") + F.col("len") - 1).alias("j"))))
        ).alias("at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("items")))).alias("items"),
    )
    spans = F.expr(
        """aggregate(at, cast(array() as array<struct<i:int,j:int>>), (s, x) ->
             if(size(s) > 0 and x.i <= element_at(s, -1).j + 1,
                concat(slice(s, 1, size(s) - 1),
                       array(named_struct('i', element_at(s, -1).i, 'j', greatest(element_at(s, -1).j, x.j)))),
                concat(s, array(named_struct('i', x.i, 'j', x.j)))))"""
    )
    n_hit = F.expr("aggregate(spans, 0L, (n, x) -> n + x.j - x.i + 1)")
    return by_doc.withColumn("spans", spans).select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        n_hit.alias("n_hit"),
        "items",
        "spans",
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of docs without any hit word, all columns. Each row goes by its own id and text, also
    where ids repeat or are null.
    """
    text_col = options.pop("text_col", "text")
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    keyed = docs.select(key.alias("__key"), F.col(text_col).alias("__text"))
    bad = contamination(keyed, benchmark, id_col="__key", text_col="__text", **options).filter("n_hit > 0")
    bad = bad.select(F.col("doc_id.id").alias("__bad"), F.col("doc_id.hash").alias("__hash")).distinct()
    same = F.col(id_col).eqNullSafe(F.col("__bad")) & (F.xxhash64(text_col) == F.col("__hash"))
    return docs.join(bad, same, "left_anti")


def strip_spans(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW
) -> DataFrame:
    """doc_id and text of every row with the hit words cut out: the text's other words, space-joined in order,
    where anything was hit, else the text as it is. Each row goes by its own id and text, also where ids repeat or are null.
    """
    key = F.struct(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("hash"))
    keyed = docs.select(key.alias("__key"), F.col(text_col).alias("__text"))
    bad = contamination(keyed, benchmark, window, "__key", "__text").filter("n_hit > 0")
    bad = bad.select(F.col("doc_id.id").alias("__id"), F.col("doc_id.hash").alias("__hash"), "spans").dropDuplicates(["__id", "__hash"])
    left = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), words(F.col(text_col)).alias("w"))
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__hash"))
    cut = F.expr("array_join(filter(w, (x, k) -> not exists(spans, s -> k + 1 between s.i and s.j)), ' ')")
    return left.join(bad, same, "left").select("doc_id", F.when(F.col("spans").isNull(), F.col("text")).otherwise(cut).alias("text"))
