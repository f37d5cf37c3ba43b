"""Chat formatting by quotation linking.

A line that starts with ">" marks is quoted, at the depth of its marks. A passage is a stretch of quoted
lines of equal depth; a message's own text is what is left without quotes and without the
"On ... wrote:" line before one. Passages are normalised (lower case, white space folded) and
hashed, and so are the whole, the paragraphs and the lines of every message's own text. A passage
belongs to the earliest message of the conversation whose own text has its hash. A message's parent is
the message that its shallowest, then longest passage belongs to, if that came before; else the
message before it. Conversations are ordered so that replies follow what they answer.

Sizes: originals are aggregated to one row per (conversation, hash) before they meet the passages,
and that meeting is salted by message; positions are ranked within stretches of turns first, then over
stretches, so that no task holds a whole conversation.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topoeval.llm.common import slices, written

SALTS = 16
STRETCH = 256
QUOTED = re.compile(r"^[ \t]*((?:>[ \t]?)+)(.*)$")
WROTE = re.compile(r"^On .* wrote:[ \t]*$")


def normalised(text: str) -> str:
    return " ".join(text.lower().split())


def digest(text: str) -> int | None:
    """64-bit hash of a normalised text; None if it is blank."""
    text = normalised(text)
    if not text:
        return None
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parse(text: str) -> tuple[str, list[tuple[int, str]]]:
    """A message's own text, and its quoted passages as (depth, text) in order."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    open_depth = 0
    for line in text.split("\n"):
        if m := QUOTED.match(line):
            depth = m[1].count(">")
            if depth != open_depth:
                # the line that introduces a quote is neither the message's own text nor part of the passage before
                before = own if not open_depth else passages[-1][1] if depth > open_depth else []
                if before and WROTE.match(before[-1]):
                    before.pop()
                passages.append((depth, []))
            passages[-1][1].append(m[2])
            open_depth = depth
        else:
            own.append(line)
            open_depth = 0
    if not passages:
        return text, []
    body = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")
    return body, [(d, "\n".join(p)) for d, p in passages]


def own_hashes(body: str) -> set[int]:
    """Hashes of the whole, the paragraphs and the lines of a message's own text."""
    parts = [body, *re.split(r"\n[ \t]*\n", body), *body.split("\n")]
    return {h for p in parts if (h := digest(p)) is not None}


def _parsed(messages: DataFrame) -> DataFrame:
    """The messages with body, n_quotes, own (hashes), quoted (depth, hash, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        passage = pa.struct([("depth", pa.int32()), ("hash", pa.int64()), ("words", pa.int64())])
        for b in slices(batches, 4):
            bodies, counts, own, quoted = [], [], [], []
            for text in b.column(4).to_pylist():
                body, passages = parse(text or "")
                bodies.append(body)
                counts.append(len(passages))
                own.append(sorted(own_hashes(body)))
                quoted.append(
                    [{"depth": d, "hash": h, "words": len(p.split())} for d, p in passages if (h := digest(p)) is not None]
                )
            yield pa.RecordBatch.from_arrays(
                [b.column(k) for k in range(4)]
                + [pa.array(bodies, pa.string()), pa.array(counts, pa.int64()), pa.array(own, pa.list_(pa.int64())), pa.array(quoted, pa.list_(passage))],
                ["conv", "conv_id", "turn", "role", "body", "n_quotes", "own", "quoted"],
            )

    kinds = {c: messages.schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}
    schema = f"conv string, conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, body string, " + (
        "n_quotes long, own array<long>, quoted array<struct<depth:int,hash:long,words:long>>"
    )
    return messages.mapInArrow(run, schema)


def link_conversations(
    messages: DataFrame,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: conv_id, turn, role, position (1, 2, ... within the conversation), parent_turn,
    link ("start", "sequence" or "quote"), n_quotes, body.

    Rows with a null conv_id are one conversation; a null turn comes first and is nobody's parent; equal turns
    and repeated rows keep a place each, ordered by role and body. A null text is empty.
    """
    rows = messages.select(
        F.coalesce(F.concat(F.lit("="), F.col(conv_col).cast("string")), F.lit("")).alias("conv"),
        F.col(conv_col).alias("conv_id"),
        F.col(turn_col).alias("turn"),
        F.col(role_col).alias("role"),
        F.col(text_col).alias("text"),
    )
    parsed = written(_parsed(rows), "messages")  # read four times below, parsed once
    origins = (
        parsed.filter("turn is not null")
        .select("conv", "turn", F.explode("own").alias("hash"))
        .groupBy("conv", "hash")
        .agg(F.min("turn").alias("origin"))
    )
    salt = F.pmod(F.xxhash64("turn"), F.lit(SALTS)).cast("int")
    quoted = parsed.select("conv", "turn", F.explode("quoted").alias("q")).select("conv", "turn", "q.*")
    quoted = quoted.withColumn("salt", salt)
    wanted = quoted.groupBy("conv", "hash").agg(F.bit_or(F.expr("shiftleft(1L, salt)")).alias("salts"))
    known = wanted.join(origins, ["conv", "hash"]).select(
        "conv", "hash", "origin", F.explode(F.expr(f"filter(sequence(0, {SALTS - 1}), s -> getbit(salts, s) = 1)")).alias("salt")
    )
    parents = (
        quoted.join(known, ["conv", "hash", "salt"])
        .filter("origin < turn")
        .groupBy("conv", "turn")
        .agg(F.max_by("origin", F.struct(-F.col("depth"), "words", "origin")).alias("quoted_turn"))
    )

    # places: within stretches of turns, then over the stretches of a conversation
    slim = parsed.select("conv", "conv_id", "turn", "role", "n_quotes", "body").withColumn(
        "stretch", F.floor(F.coalesce(F.col("turn"), F.lit(-STRETCH)) / STRETCH)
    )
    inside = Window.partitionBy("conv", "stretch").orderBy(F.col("turn").asc_nulls_first(), "role", F.xxhash64("body"))
    earlier = Window.partitionBy("conv", "stretch").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    placed = slim.withColumn("place", F.row_number().over(inside)).withColumn("near", F.max("turn").over(earlier))
    size = slim.groupBy("conv", "stretch").agg(F.count("*").alias("n"), F.max("turn").alias("last"))
    over = Window.partitionBy("conv").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    size = size.select(
        "conv", "stretch", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("ahead"), F.max("last").over(over).alias("far")
    )
    before = F.coalesce("near", "far")
    return (
        placed.join(size, ["conv", "stretch"])
        .join(parents, ["conv", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            "role",
            (F.col("ahead") + F.col("place")).alias("position"),
            F.coalesce("quoted_turn", F.when(F.col("turn").isNotNull(), before)).alias("parent_turn"),
            F.when(F.col("quoted_turn").isNotNull(), "quote")
            .when(before.isNotNull() & F.col("turn").isNotNull(), "sequence")
            .otherwise("start")
            .alias("link"),
            "n_quotes",
            "body",
        )
    )


def rendered(linked: DataFrame) -> DataFrame:
    """conv_id, position, text: each message in chat format, to be read in this order."""
    text = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("body"), F.lit("\n"))
    return linked.select("conv_id", "position", text.alias("text"))
