"""Token-id files in canonical, length-limited Huffman code.

A store is a folder of two Parquet tables:

* ``code``: one row with the code lengths (one byte per id, 0 for ids that never occur), which
  fix the canonical code, and the spacing of checkpoints;
* ``blocks``: rows in ascending doc_id order (part by part and row by row). A block holds at most
  BLOCK consecutive ids: ``first`` (position of its first id among all ids), ``n``, the documents
  it touches (doc_id, position of the document's first id, number of the block's ids that are
  the document's), ``bits`` (the code words, most significant bit first) and ``steps`` (bits of
  each run of STEP ids, as 16-bit integers). Prefix sums of ``steps`` are the bit offsets from
  which a block, or a part of one, can be decoded without what stands before.

Writing: documents are range-partitioned and sorted by id, encoded once, and their ids
checkpointed; global counts of the ids (at most one row per id of the vocabulary) give the code;
each partition then streams its ids into blocks. Decoding looks 2**LONGEST code prefixes up in a
table and advances from all checkpoints of a block at the same time.
"""

from __future__ import annotations

import functools
import os
import re
import sys
import uuid
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topoeval.llm.bpe import CACHED_CHARS, tokenizer_file
from topoeval.llm.common import checkpointed, shared_dir, slices, texts
from topoeval.llm.token_counts import ODD_POINTS, ByteTokenization

END_ID = 2
LONGEST = 20
BLOCK = 1 << 16
STEP = 64
#: Units whose ids a worker remembers (some 200 bytes each).
UNITS = 600_000
#: Bytes of text whose distinct units are encoded at a time.
SLICE = 8 << 20


# --- code ---------------------------------------------------------------------------------


def code_lengths(counts: np.ndarray, longest: int = LONGEST) -> np.ndarray:
    """Optimal code lengths of at most ``longest`` bits (package-merge); 0 for counts of 0."""
    used = np.flatnonzero(counts)
    out = np.zeros(len(counts), dtype=np.uint8)
    if len(used) < 2:
        out[used] = 1
        return out
    if len(used) > 1 << longest:
        raise ValueError("more ids than code words of that length")
    order = used[np.argsort(counts[used], kind="stable")]
    leaves = counts[order].astype(np.int64)
    rows, weights = [], np.empty(0, dtype=np.int64)
    for _ in range(longest):
        both = np.concatenate((leaves, weights))
        by_weight = np.argsort(both, kind="stable")
        rows.append(by_weight < len(leaves))
        both = both[by_weight]
        weights = both[: len(both) // 2 * 2].reshape(-1, 2).sum(axis=1)
    take, lengths = 2 * len(leaves) - 2, np.zeros(len(leaves), dtype=np.uint8)
    for is_leaf in reversed(rows):
        n = int(is_leaf[:take].sum())
        lengths[:n] += 1
        take = 2 * (take - n)
    out[order] = lengths
    return out


def code_words(lengths: np.ndarray) -> np.ndarray:
    """Canonical code words: by length, then by id."""
    out, code, before = np.zeros(len(lengths), dtype=np.uint32), 0, 0
    used = np.flatnonzero(lengths)
    used = used[np.lexsort((used, lengths[used]))]
    for length in np.unique(lengths[used]).tolist():
        of = used[lengths[used] == length]
        code <<= length - before
        out[of] = code + np.arange(len(of), dtype=np.uint32)
        code, before = code + len(of), length
    return out


@functools.lru_cache(maxsize=2)
def decode_table(lengths: bytes) -> tuple[np.ndarray, np.ndarray, int]:
    """Id and code length for each value of the next bits; how many bits that takes."""
    size = np.frombuffer(lengths, dtype=np.uint8)
    bits = int(size.max(initial=1))
    used = np.flatnonzero(size)
    used = used[np.lexsort((used, size[used]))]
    span = 1 << (bits - size[used].astype(np.int64))
    ids = np.zeros(1 << bits, dtype=np.int32)
    steps = np.ones(1 << bits, dtype=np.uint8)
    n = int(span.sum())
    ids[:n], steps[:n] = np.repeat(used, span), np.repeat(size[used], span)
    return ids, steps, bits


def pack(ids: np.ndarray, lengths: np.ndarray, words: np.ndarray) -> tuple[bytes, bytes]:
    """Code words of some ids as bytes; bits of each run of STEP ids."""
    size = lengths[ids].astype(np.int32)
    ends = np.cumsum(size, dtype=np.int32)
    left = (np.repeat(ends, size) - np.arange(1, ends[-1] + 1, dtype=np.int32)).astype(np.uint8)  # bits behind this one
    bits = (np.repeat(words[ids], size) >> left) & 1
    steps = np.add.reduceat(size, np.arange(0, len(ids), STEP)).astype("<u2")
    return np.packbits(bits.astype(np.uint8)).tobytes(), steps.tobytes()


def unpack(bits: bytes, steps: bytes, n: int, lengths: bytes) -> np.ndarray:
    """The n ids of a block."""
    ids, size, wide = decode_table(lengths)
    data = np.frombuffer(bits + bytes(8), dtype=np.uint8).astype(np.uint32)
    # the four bytes from each byte on, as a big-endian integer: LONGEST bits from any bit of the first one
    window = (data[:-3] << 24) | (data[1:-2] << 16) | (data[2:-1] << 8) | data[3:]
    run = np.frombuffer(steps, dtype="<u2").astype(np.int32)
    at = np.cumsum(run, dtype=np.int32) - run
    out = np.zeros((STEP, len(run)), dtype=np.int32)
    last, mask = len(window) - 1, np.uint32((1 << wide) - 1)
    for k in range(STEP):
        look = (window[np.minimum(at >> 3, last)] >> (32 - wide - (at & 7)).astype(np.uint32)) & mask
        out[k] = ids[look]
        at += size[look]
    out = out.T
    return out.reshape(-1)[:n]


# --- crc32 of parts -----------------------------------------------------------------------


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo that of crc32, in its reflected bit order."""
    out = 0
    while b:
        if b & 0x80000000:
            out ^= a
        b = (b << 1) & 0xFFFFFFFF
        a = (a >> 1) ^ (0xEDB88320 if a & 1 else 0)
    return out


def crc32_join(one: int, two: int, two_bytes: int) -> int:
    """crc32(a + b) from crc32(a), crc32(b) and len(b)."""
    power, square, n = 0x80000000, 0x00800000, two_bytes  # x**0 and x**8
    while n:
        if n & 1:
            power = _times(power, square)
        square, n = _times(square, square), n >> 1
    return _times(one, power) ^ two


# --- writing ------------------------------------------------------------------------------


class _Encoder(ByteTokenization):
    """Ids of texts, as bytes (two for each id if all ids fit, else four).

    Plain texts are cut before every space that a word follows; the distinct units of a slice of texts that are not
    remembered are encoded once, all together. Texts with special strings, controls, other white space or
    runs of it are cut by the tokenizer's own rules.
    """

    #: What makes a text not plain, for Arrow's regular expressions: controls and rare white space, two kinds of white space
    #: in a row from a space on, a space at the end. "<|" begins all special strings of the known files.
    UNPLAIN = "[" + "".join(f"\\x{{{c:x}}}" for c in ODD_POINTS) + "]| [ \\t\\n\\r\\v\\f]| \\z"

    def __init__(self, text: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        super().__init__(text)
        self.code = "H" if self.library.get_vocab_size() <= 1 << 16 else "I"
        self.kind = np.dtype("<u2" if self.code == "H" else "<u4")
        self.unplain = "|".join([self.UNPLAIN, *map(re.escape, self.special)])
        #: unit -> ids, of units as they are and of those behind a space
        self.known: dict[str, dict[str, bytes]] = {"": {}, " ": {}}

    def as_bytes(self, ids: list[int]) -> bytes:
        if sys.byteorder == "little":
            return array(self.code, ids).tobytes()
        return np.array(ids, dtype=self.kind).tobytes()

    def fresh(self, units: list[str]) -> dict[str, bytes]:
        """The ids of units: Latin ones by the merge list, a round of merges for all at a time, others by the library."""
        latin = [u for u in units if u.isascii() and u.isprintable() or self.latin(u)]
        rest = [*set(units).difference(latin)] if len(latin) < len(units) else []
        out = {}
        if latin:
            words = self.WORD_OR_NUL.findall("\x00".join(latin))
            breaks = np.flatnonzero(np.frombuffer(b"".join([b"\1" if w == "\x00" else b"\0" for w in words]), np.uint8))
            sizes = np.diff(np.concatenate(([-1], breaks, [len(words)]))) - 1
            ids, counts = self.transduced([w for w in words if w != "\x00"], sizes)
            raw, ends = ids.astype(self.kind).tobytes(), np.cumsum(counts) * self.kind.itemsize
            begins = ends - counts * self.kind.itemsize
            out = {u: raw[i:j] for u, i, j in zip(latin, begins.tolist(), ends.tolist(), strict=True)}
        if rest:
            out |= zip(rest, [self.as_bytes(e.ids) for e in self.library.encode_batch_fast(rest, add_special_tokens=False)], strict=True)
        return out

    def found(self, units: list[str], lead: str = "") -> list[bytes]:
        """The ids of units, each behind ``lead``, from those remembered or fresh."""
        known = self.known[lead]
        out = list(map(known.get, units))
        missing = [k for k, ids in enumerate(out) if ids is None]
        if missing:
            new = [*dict.fromkeys(units[k] for k in missing)]
            if len(known) + len(new) > UNITS:
                known.clear()
            fresh = self.fresh([lead + u for u in new] if lead else new)
            for k in missing:
                out[k] = fresh[lead + units[k]]
            known.update((u, fresh[lead + u]) for u in new if len(u) <= CACHED_CHARS)
        return out

    def plain(self, plain: pa.StringArray) -> list[bytes]:
        split = pc.split_pattern(plain, " ")
        offsets = split.offsets.to_numpy()
        pieces = split.flatten()
        coded = pieces.dictionary_encode()
        first = pieces.take(pa.array(offsets[:-1])).dictionary_encode()  # these have no space before them
        inner = self.found(coded.dictionary.to_pylist(), " ")
        outer = self.found(first.dictionary.to_pylist())
        at = coded.indices.to_numpy().copy()
        at[offsets[:-1]] = len(inner) + first.indices.to_numpy()
        strings = pa.array([*inner, *outer], pa.binary()).take(pa.array(at))
        return pc.binary_join(pa.ListArray.from_arrays(split.offsets, strings), b"").to_pylist()

    def encode(self, batch_texts: list[str], end_id: int) -> list[bytes]:
        whole, end = pa.array(batch_texts, pa.string()), self.as_bytes([end_id])
        odd = pc.match_substring_regex(whole, self.unplain).to_numpy(zero_copy_only=False)
        plain = iter(self.plain(whole.filter(pa.array(~odd))) if not odd.all() else [])
        out = []
        for text, is_odd in zip(batch_texts, odd.tolist(), strict=True):
            if not is_odd:
                out.append(next(plain) + end)
                continue
            parts = []
            for part, special in self.segments(text):
                if special is not None:
                    parts.append(self.as_bytes([special]))
                else:
                    for units, _ in self.units(part):
                        ids = dict(zip(of := [*dict.fromkeys(units)], self.found(of), strict=True))
                        parts += map(ids.__getitem__, units)
            out.append(b"".join([*parts, end]))
        return out


@functools.lru_cache(maxsize=2)
def _encoder(text: str) -> _Encoder:
    return _Encoder(text)


def encoded(docs: DataFrame, path: str, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, shard, at (ids before it in the shard), n, ids (zstd) in ascending order of doc_id."""
    file = tokenizer_file(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        encoder, zip_ = _encoder(file.value), zstandard.ZstdCompressor(level=1)
        mark, width = (b"2", 2) if encoder.code == "H" else (b"", 4)
        shard, at = TaskContext.get().partitionId(), 0
        for b in slices(batches, size=SLICE):
            ns, ats, ids = [], [], []
            for x in encoder.encode(texts(b), end_id):
                ns.append(len(x) // width)
                ats.append(at)
                ids.append(zip_.compress(mark + x))
                at += ns[-1]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([shard] * len(ns), pa.int32()), pa.array(ats), pa.array(ns), pa.array(ids, pa.binary())],
                ["doc_id", "shard", "at", "n", "ids"],
            )

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    dealt = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", F.xxhash64("text"))
    return dealt.mapInArrow(run, f"doc_id {kind}, shard int, at long, n long, ids binary")


def _plain(ids: bytes) -> np.ndarray:
    """Ids of a row: two bytes each behind a mark, or four bytes each."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(ids)
    return np.frombuffer(raw, dtype="<u2", offset=1) if len(raw) % 2 else np.frombuffer(raw, dtype="<u4")


def id_counts(rows: DataFrame) -> DataFrame:
    """id and count over all rows of ``encoded``; each task sends one row per id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, dtype=np.int64)
        for b in batches:
            for ids in b.column(0):
                n = np.bincount(_plain(ids.as_py()), minlength=len(total))
                n[: len(total)] += total
                total = n
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used], pa.int64())], ["id", "n"])

    return rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write_tokens(
    docs: DataFrame,
    path: str,
    tokenizer: str,
    end_id: int = END_ID,
    id_col: str = "doc_id",
    text_col: str = "text",
    block: int = BLOCK,
) -> None:
    """Write all texts' ids, each text with end_id behind it, as a store in folder ``path``.

    Null and empty texts are an end id only. A null doc_id comes first; rows that share an id are
    documents of their own, in an order that their texts fix. An empty table gives empty blocks.
    """
    spark = docs.sparkSession
    rows = checkpointed(encoded(docs, tokenizer, end_id, id_col, text_col))
    found = id_counts(rows).collect()  # at most one row for each id of the vocabulary
    counts = np.zeros(max((r["id"] for r in found), default=0) + 1, dtype=np.int64)
    for r in found:
        counts[r["id"]] = r["n"]
    lengths = code_lengths(counts)
    words = code_words(lengths)
    totals = {r["shard"]: r["n"] for r in rows.groupBy("shard").agg(F.sum("n").alias("n")).collect()}  # one per task
    before, offsets = 0, {}
    for shard in sorted(totals):
        offsets[shard], before = before, before + totals[shard]
    kind = pa.struct([("doc_id", _arrow_type(docs.schema[id_col].dataType)), ("start", pa.int64()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, inside, first, n = [], [], 0, 0

        def full() -> pa.RecordBatch:
            bits, steps = pack(np.concatenate(held), lengths, words)
            return pa.RecordBatch.from_arrays(
                [pa.array([first]), pa.array([n], pa.int32()), pa.array([inside], pa.list_(kind)), pa.array([bits], pa.binary()), pa.array([steps], pa.binary())],
                ["first", "n", "documents", "bits", "steps"],
            )

        for b in batches:
            for doc, shard, at, ids in zip(*(b.column(k).to_pylist() for k in (0, 1, 2, 4)), strict=True):
                start, x = offsets[shard] + at, _plain(ids)
                for begin in _cuts(len(x), block, n):
                    if n == block:
                        yield full()
                        held, inside, n = [], [], 0
                    part = x[begin : begin + block - n]
                    if not n:
                        first = start + begin
                    held.append(part)
                    inside.append({"doc_id": doc, "start": start, "n": len(part)})
                    n += len(part)
        if n:
            yield full()

    schema = T.StructType().add("first", "long").add("n", "integer")
    inner = T.StructType().add("doc_id", docs.schema[id_col].dataType).add("start", "long").add("n", "integer")
    schema = schema.add("documents", T.ArrayType(inner)).add("bits", "binary").add("steps", "binary")
    rows.mapInArrow(run, schema).write.option("compression", "none").parquet(os.path.join(path, "blocks"))
    code = spark.createDataFrame([(bytearray(lengths.tobytes()), STEP, end_id)], "lengths binary, step int, end_id int")
    code.coalesce(1).write.parquet(os.path.join(path, "code"))


def _cuts(n: int, block: int, filled: int) -> list[int]:
    """Where a document of n ids begins anew in blocks, the first of which has some ids already."""
    room = block - filled if filled < block else block
    return [0, *range(room, n, block)]


def _arrow_type(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


# --- reading ------------------------------------------------------------------------------


def _blocks(spark: SparkSession, path: str) -> tuple[DataFrame, bytes]:
    code = spark.read.parquet(os.path.join(path, "code")).first()
    if code["step"] != STEP:
        raise ValueError("the store has other checkpoints")
    return spark.read.parquet(os.path.join(path, "blocks")), bytes(code["lengths"])


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, at (the part's place in the document), ids: a row for each document and block."""
    blocks, lengths = _blocks(spark, path)
    kind = blocks.schema["documents"].dataType.elementType["doc_id"].dataType
    arrow = _arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, inside, bits, steps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, at, out = unpack(bits, steps, n, lengths), 0, []
                for d in inside:
                    out.append((d["doc_id"], d["start"], first + at - d["start"], ids[at : at + d["n"]]))
                    at += d["n"]
                cols = [*zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], arrow), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.int32()))],
                    ["doc_id", "start", "at", "ids"],
                )

    schema = T.StructType().add("doc_id", kind).add("start", "long").add("at", "long").add("ids", T.ArrayType(T.IntegerType()))
    return blocks.select("first", "n", "documents", "bits", "steps").mapInArrow(run, schema)


def read_summary(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the decoded ids of its blocks."""
    blocks, lengths = _blocks(spark, path)
    kind = blocks.schema["documents"].dataType.elementType["doc_id"].dataType
    arrow = _arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, n, inside, bits, steps in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids, at, out = unpack(bits, steps, n, lengths).astype("<u4"), 0, []
                for d in inside:
                    crc = zlib.crc32(ids[at : at + d["n"]].tobytes())
                    out.append((d["doc_id"], d["start"], first + at - d["start"], d["n"], crc))
                    at += d["n"]
                cols = [*zip(*out, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], arrow), *(pa.array(c, pa.int64()) for c in cols[1:])],
                    ["doc_id", "start", "at", "n", "crc"],
                )

    schema = T.StructType().add("doc_id", kind)
    for name in ("start", "at", "n", "crc"):
        schema = schema.add(name, "long")
    parts = blocks.select("first", "n", "documents", "bits", "steps").mapInArrow(run, schema)

    @F.pandas_udf("long")
    def joined(sizes: pd.Series, crcs: pd.Series) -> pd.Series:
        def one(ns, cs) -> int:
            out = cs[0]
            for n, c in zip(ns[1:], cs[1:], strict=True):
                out = crc32_join(int(out), int(c), 4 * int(n))
            return int(out)

        return pd.Series([one(a, b) for a, b in zip(sizes, crcs, strict=True)], dtype="int64")

    docs = parts.groupBy("doc_id", "start").agg(
        F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("at", "n", "crc"))).alias("parts")
    )
    return docs.select("doc_id", "start", "n_tokens", joined("parts.n", "parts.crc").alias("ids_crc32"))


def round_trip(
    docs: DataFrame, tokenizer: str, path: str | None = None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Write a store (in the shared folder unless a path is given) and summarise what it reads back."""
    path = path or os.path.join(shared_dir(docs.sparkSession), "tokens", uuid.uuid4().hex)
    write_tokens(docs, path, tokenizer, id_col=id_col, text_col=text_col)
    return read_summary(docs.sparkSession, path)
