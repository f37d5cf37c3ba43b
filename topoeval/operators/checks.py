"""Data-quality checks: each returns rows (check, expected, actual, passed), so that reports can be unioned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _report(df: DataFrame, check: str, expected, actual: Column, passed: Column | None = None) -> DataFrame:
    e = expected if isinstance(expected, Column) else F.lit(expected)
    e, a = e.cast("double"), actual.cast("double")
    return df.select(F.lit(check).alias("check"), e.alias("expected"), a.alias("actual"), F.coalesce(e == a if passed is None else passed, F.lit(False)).alias("passed"))


def expect_table(df: DataFrame, name: str, rows: int, distinct: dict[str, int] | None = None) -> DataFrame:
    """Row count, and distinct values of columns, in one pass."""
    found = df.agg(F.count("*").alias("n"), *[F.count_distinct(c).alias(f"d_{c}") for c in distinct or {}])
    out = _report(found, f"{name}: rows", rows, F.col("n"))
    for c, n in (distinct or {}).items():
        out = out.union(_report(found, f"{name}: distinct {c}", n, F.col(f"d_{c}")))
    return out


def expect_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    found = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    out = _report(found, f"nulls {columns[0]}", 0, F.col(columns[0]))
    for c in columns[1:]:
        out = out.union(_report(found, f"nulls {c}", 0, F.col(c)))
    return out


def expect_group_distinct(df: DataFrame, group: str, column: str, n: int) -> DataFrame:
    """Groups that have another number of distinct values than n."""
    bad = df.groupBy(group).agg(F.count_distinct(column).alias("d")).agg(F.count_if(F.col("d") != n).alias("bad"))
    return _report(bad, f"{column} per {group}", 0, F.col("bad"))


def expect_counts(actual: DataFrame, expected: DataFrame, check: str = "counts") -> DataFrame:
    a, e = actual.agg(F.count("*").alias("a")), expected.agg(F.count("*").alias("e"))
    return _report(a.crossJoin(e), check, F.col("e"), F.col("a"))


def expect_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    bad = df.groupBy(*keys).agg(F.count("*").alias("n")).agg(F.count_if(F.col("n") > 1).alias("bad"))
    return _report(bad, f"unique {','.join(keys)}", 0, F.col("bad"))


def expect_equal_when(df: DataFrame, condition: Column, a: Column, b: Column, check: str = "equal") -> DataFrame:
    return _report(df.agg(F.count_if(condition & ~a.eqNullSafe(b)).alias("bad")), check, 0, F.col("bad"))


def expect_close(a: DataFrame, b: DataFrame, check: str = "close", least: int = 10, share: float = 0.001) -> DataFrame:
    """Row counts differ by at most max(least, ceil(share * first))."""
    both = a.agg(F.count("*").alias("x")).crossJoin(b.agg(F.count("*").alias("y")))
    tol = F.greatest(F.lit(least), F.ceil(F.col("x") * share))
    return _report(both, check, F.col("x"), F.col("y"), F.abs(F.col("x") - F.col("y")) <= tol)


def expect_complete(tables: dict[str, DataFrame], rows: dict[str, int], protocol: str | None = None) -> DataFrame:
    """All tables non-empty, of the expected size, and with one protocol tag."""
    out = None
    for name, df in tables.items():
        tag = F.bool_and(F.col("protocol") == protocol) if protocol is not None else F.lit(True)
        found = df.agg(F.count("*").alias("n"), tag.alias("tag"))
        one = _report(found, name, rows[name], F.col("n"), (F.col("n") == rows[name]) & F.col("tag") & (F.col("n") > 0))
        out = one if out is None else out.union(one)
    return out
