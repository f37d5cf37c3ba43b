"""Exact dedup, natively: skew-safe combining of equal texts.

Texts are equal when they are identical after lower-casing A-Z. The winners are found in
three combining steps, each of which groups by digest *and* whole normalised text, so that
a digest collision can never merge two texts:

1. locally: Spark's map-side aggregation of step 2 folds the copies of one input partition;
2. salted: partial winners meet by (digest, salt, text), so that a group holding a third of
   all rows is spread over SALTS tasks;
3. globally: the at most SALTS winners of each text meet by (digest, text).

The result for every row is then joined back by key (SHA-256, XXH64 and length of the text)
and salt, which moves ids and digests but no texts and spreads a large group as the second step
does (each text's salts travel as a bit mask). That is safe because the last step has
compared the whole texts behind each key; should two different texts ever share all three
parts of a key, the query stops with an error instead of merging them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topoeval.llm.common import ascii_lower

#: Tasks over which the copies of one text are spread before they meet; 63 at most.
SALTS = 32


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    digest: Column | None = None,
) -> DataFrame:
    """One row per input row: id, keep_id, group_size, kept, text_sha256.

    The row with the largest id of a group stays. Null texts count as empty. Repeated ids:
    each row counts in group_size; all rows that carry the largest id are kept. A null id is
    smaller than any other; a group of null ids only has keep_id null and keeps its rows.
    ``digest`` replaces the grouping digest (tests use one that collides).
    """
    norm = ascii_lower(F.coalesce(F.col(text_col), F.lit("")))
    rows = docs.select(F.col(id_col).alias("doc_id"), norm.alias("norm")).select(
        "doc_id",
        "norm",
        F.sha2("norm", 256).alias("sha"),
        F.xxhash64("norm").alias("xx"),
        F.octet_length("norm").alias("len"),
    )
    rows = rows.withColumn("digest", F.col("sha") if digest is None else digest)
    key = ["digest", "xx", "len"]

    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    salted = rows.groupBy(*key, salt.alias("salt"), "norm").agg(
        F.max("doc_id").alias("keep_id"), F.count("*").alias("n")
    )
    winners = salted.groupBy(*key, "norm").agg(
        F.max("keep_id").alias("keep_id"),
        F.sum("n").alias("group_size"),
        F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"),
    )
    by_key = winners.groupBy(*key).agg(
        F.count("*").alias("n_texts"), *(F.max(c).alias(c) for c in ("keep_id", "group_size", "salts"))
    )
    sure = by_key.select(
        *key,
        "keep_id",
        F.when(F.col("n_texts") == 1, F.col("group_size"))
        .otherwise(F.raise_error(F.lit("different texts share a key")).cast("long"))
        .alias("group_size"),
        F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(salts, s) = 1)")).alias("salt"),
    )
    return (
        rows.select("doc_id", "sha", *key, salt.alias("salt"))
        .join(sure, [*key, "salt"])
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("sha").alias("text_sha256"),
        )
    )
