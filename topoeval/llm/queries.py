"""The registered queries of this subpackage: one thin query per operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topoeval.llm import bpe, byte_bpe, decontaminate, exact_dedup, lexical, licenses, line_dedup, periodic, quotes, simhash, token_counts, token_store, toxicity
from topoeval.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer(name: str) -> str:
    """Path of one of the public tokenizer files of this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.line_dedup(table(spark, sf_dir, "documents"), F.col("source"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents"))


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_store.round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    linked = quotes.link_conversations(table(spark, sf_dir, "conversations"))
    return linked.select(
        "conv_id", "turn", "role", "position", "parent_turn", "link", "n_quotes", F.sha2("body", 256).alias("body_sha256")
    )


def with_planted_runs(docs: DataFrame) -> DataFrame:
    """doc_id and text, where a tenth of the documents (by the CRC-32 of their ids) repeat a block of words up to their end."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = F.coalesce(h % 10 == 0, F.lit(False)) & F.col("text").isNotNull()
    words = F.when(chosen, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    cut = docs.select("doc_id", "text", F.floor(h / 10).cast("long").alias("g"), words.alias("words"))
    n = F.size("words")
    a = (F.col("g") % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + F.col("g") % 8))).cast("int")
    times = F.ceil((n - a) / p).cast("int")
    block = F.slice("words", a + 1, p)
    tail = F.slice(F.flatten(F.array_repeat(block, times)), F.lit(1), n - a)
    planted = F.array_join(F.concat(F.slice("words", F.lit(1), a), tail), " ")
    return cut.select("doc_id", F.when(n > 0, planted).otherwise(F.col("text")).alias("text"))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(with_planted_runs(table(spark, sf_dir, "documents")))
    lines = F.transform("runs", lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("s"), (-r["period"]).alias("p"))))
    most = found.withColumn("most", longest)
    length, period = F.col("most.length"), -F.col("most.p")
    return most.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("most.s")).alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(1000 * length / period).alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = byte_bpe.byte_round_trip(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.tiktoken"))
    return found.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.lexical_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_toxicity": op1_toxicity,
    "op2_bpe": op2_bpe,
    "op3_simhash": op3_simhash,
    "op4_token_counts": op4_token_counts,
    "op5_decontamination": op5_decontamination,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_line_dedup": op7_line_dedup,
    "op8_licenses": op8_licenses,
    "op9_token_store": op9_token_store,
    "op10_chat": op10_chat,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_byte_bpe": op12_byte_bpe,
    "op13_lexical_search": op13_lexical_search,
}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op5_decontamination": f"""
WITH b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT item, w, least(len(w), 10) AS n FROM b WHERE len(w) > 0),
g AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bw)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS gram
      FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
            FROM d, (SELECT DISTINCT n FROM g))),
h AS (SELECT doc_id, n, i, item FROM p JOIN g USING (n, gram)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit
        FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM h) GROUP BY 1),
it AS (SELECT doc_id, count(DISTINCT item) AS n_items,
              array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit,
       coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN it USING (doc_id)""",
    "op6_exact_dedup": f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size::BIGINT AS group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256
FROM d JOIN g USING (t)""",
    "op7_line_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS site, text, string_split(coalesce(text, ''), chr(10)) AS ls
           FROM documents),
x AS (SELECT site, unnest(list_distinct(list_transform(ls, lambda l: trim(l)))) AS line FROM d),
n AS (SELECT site, count(*) AS pages FROM d GROUP BY 1),
bad AS (SELECT site, list(line) AS bad FROM (
          SELECT site, line, count(*) AS k FROM x WHERE line != '' GROUP BY 1, 2) JOIN n USING (site)
        WHERE k >= {line_dedup.MIN_PAGES} AND k > pages * {line_dedup.MAX_RATIO}::DOUBLE GROUP BY site),
c AS (SELECT doc_id, text, ls, list_filter(ls, lambda l: trim(l) = '' OR NOT list_contains(coalesce(bad, []), trim(l))) AS kept
      FROM d LEFT JOIN bad USING (site))
SELECT doc_id, len(list_filter(ls, lambda l: trim(l) != ''))::BIGINT AS n_lines,
       (len(ls) - len(kept))::BIGINT AS n_dropped,
       sha256(CASE WHEN len(kept) = len(ls) THEN text ELSE array_to_string(kept, chr(10)) END) AS text_sha256
FROM c""",
    "op13_lexical_search": f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
t AS (SELECT doc_id, unnest(w) AS term FROM d),
g AS (SELECT count(*) AS n_docs, sum(len(w))::BIGINT AS n_words FROM d WHERE len(w) > 0),
m AS (SELECT doc_id, 100 - 50 + ((50 * len(w) * n_docs) // n_words) AS m FROM d, g WHERE len(w) > 0),
tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY 1, 2),
wt AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE))::BIGINT AS weight
       FROM (SELECT term, count(*) AS df FROM tf GROUP BY 1), g),
q AS (SELECT DISTINCT item_id, unnest({_WORDS}) AS term FROM benchmark),
s AS (SELECT item_id, doc_id, sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
      FROM q JOIN wt USING (term) JOIN tf USING (term) JOIN m USING (doc_id) GROUP BY 1, 2),
r AS (SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank, doc_id, score
      FROM s WHERE score > 0)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM r WHERE rank <= 50""",
}


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE_SQL)
