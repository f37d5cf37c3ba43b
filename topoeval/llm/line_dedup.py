"""Line dedup, natively, by site-relative frequency.

A line (trimmed, not empty) is boilerplate on a site if the pages of the site that contain it
are more than MAX_RATIO of the site's pages, and at least MIN_PAGES. Boilerplate lines are
dropped; all other lines stay as they are, in order.

What is shuffled: one 24-byte row per distinct line of a page (site and line as two
independently seeded 64-bit hashes), pre-summed on the map side, so a site or a line that
most pages share costs each task one row. Boilerplate lines, few by their definition
(at most lines-per-page / MAX_RATIO for each site), then meet the lines of the pages; that
join is salted by page, so a line on all pages of a large site spreads over SALTS tasks. Texts
move once at most, to meet the hashes of the lines that their page loses (not at all where
those are few enough for Spark's own broadcast threshold).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_RATIO = 0.08
MIN_PAGES = 5
SALTS = 16


def host_of(url: Column) -> Column:
    """Lower-case host of a URL, without port; the site column of raw pages."""
    return F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def _keys(site: Column, line: Column) -> list[Column]:
    return [F.xxhash64(F.lit(k), site, line).alias(f"k{k}") for k in (1, 2)]


def line_frequencies(pages: DataFrame, site: Column, text_col: str = "text") -> DataFrame:
    """site, line, n_pages, site_pages, ratio of every line: the report form of the operator."""
    rows = pages.select(F.coalesce(site.cast("string"), F.lit("")).alias("site"), F.col(text_col).alias("text"))
    total = rows.groupBy("site").agg(F.count("*").alias("site_pages"))
    lines = F.array_distinct(F.transform(_lines(F.col("text")), lambda x: F.trim(x)))
    counts = (
        rows.select("site", F.explode(lines).alias("line")).filter("line != ''").groupBy("site", "line").agg(
            F.count("*").alias("n_pages")
        )
    )
    return counts.join(total, "site").withColumn("ratio", F.col("n_pages") / F.col("site_pages"))


def _boilerplate_of_rows(
    pages: DataFrame, site: Column, text_col: str, max_ratio: float, min_pages: int, salts: int
) -> tuple[DataFrame, Column]:
    """The pages joined to the hashes of their boilerplate lines; the cleaned text.

    The columns added are named __site, __row and __drop.
    """
    rows = pages.withColumn("__site", F.coalesce(site.cast("string"), F.lit(""))).withColumn(
        "__row", F.xxhash64(*[c for c in pages.columns if c != text_col], text_col)
    )
    lines = (
        rows.select(
            F.col("__row").alias("row"),
            F.col("__site").alias("site"),
            F.explode(F.array_distinct(F.transform(_lines(F.col(text_col)), lambda x: F.trim(x)))).alias("line"),
        )
        .filter("line != ''")
        .select("row", "site", *_keys(F.col("site"), F.col("line")))
    )
    total = rows.groupBy(F.col("__site").alias("site")).agg(F.count("*").alias("site_pages"))
    counts = lines.groupBy("site", "k1", "k2").agg(F.count("*").alias("n_pages")).filter(F.col("n_pages") >= min_pages)
    boilerplate = (
        counts.join(total, "site")
        .filter(F.col("n_pages") > F.col("site_pages") * max_ratio)
        .select("k1", "k2", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    )
    salted = lines.select("row", "k1", "k2", F.pmod(F.col("row"), F.lit(salts)).cast("int").alias("salt"))
    drops = (
        salted.join(boilerplate, ["k1", "k2", "salt"])
        .groupBy(F.col("row").alias("__row"))
        .agg(F.collect_set("k1").alias("__drop"))
    )
    kept = F.filter(
        _lines(F.col(text_col)),
        lambda x: (F.trim(x) == "") | ~F.array_contains("__drop", F.xxhash64(F.lit(1), F.col("__site"), F.trim(x))),
    )
    cleaned = F.when(F.col("__drop").isNull(), F.col(text_col)).otherwise(F.array_join(kept, "\n"))
    return rows.join(drops, "__row", "left"), cleaned


def line_dedup(
    pages: DataFrame,
    site: Column,
    id_col: str = "doc_id",
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    salts: int = SALTS,
) -> DataFrame:
    """One row per input row: doc_id, text (without boilerplate), n_lines, n_dropped, both counting
    lines that are not blank.

    A null site is a site of its own named ''; a null text has no lines and stays null. Rows that
    repeat count as pages of their own; rows with equal ids are told apart by their content. A page that
    loses all its lines stays, with what blank lines it had.
    """
    slim = pages.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), site.alias("site"))
    joined, cleaned = _boilerplate_of_rows(slim, F.col("site"), "text", max_ratio, min_pages, salts)
    full = lambda c: F.size(F.filter(_lines(c), lambda x: F.trim(x) != "")).cast("long")
    out = joined.select("doc_id", cleaned.alias("text"), full(F.col("text")).alias("n_lines"))
    return out.select("doc_id", "text", "n_lines", (F.col("n_lines") - full(F.col("text"))).alias("n_dropped"))


def drop_boilerplate(
    pages: DataFrame,
    site: Column,
    text_col: str = "text",
    max_ratio: float = MAX_RATIO,
    min_pages: int = MIN_PAGES,
    salts: int = SALTS,
) -> DataFrame:
    """All rows and columns of pages, whatever their names, with boilerplate lines gone from the text; nulls, repeated
    rows and empty tables as in line_dedup. Columns of map type can't be grouped by and stop the query.
    """
    rest = F.struct(F.lit(0).alias("none"), *[F.col(c).alias(f"c{k}") for k, c in enumerate(pages.columns) if c != text_col])
    slim = pages.select(rest.alias("rest"), F.col(text_col).alias("text"), F.coalesce(site.cast("string"), F.lit("")).alias("site"))
    joined, cleaned = _boilerplate_of_rows(slim, F.col("site"), "text", max_ratio, min_pages, salts)
    return joined.select(*[(cleaned if c == text_col else F.col(f"rest.c{k}")).alias(c) for k, c in enumerate(pages.columns)])
