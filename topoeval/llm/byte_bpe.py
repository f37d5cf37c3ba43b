"""Byte-level BPE from a file of ranks: encoding by longest matches and backtracking, decoding by table.

Bytes are mapped to Latin-1, so that an Aho-Corasick automaton of strings finds tokens of bytes. A
sequence of tokens is what the merges give for a word exactly if each pair of neighbours is what they give
for the bytes of that pair; whether it is, is worked out once a pair and remembered. So a word is
encoded from left to right: the longest match that is compatible with the token before it, else the next shorter
token that starts there, else a step back. A place from which a step back was made is never
tried again, for only one sequence of tokens can lead there: the time is linear in the word.

Texts are cut into words by the pattern of the public rank files. Letters, numbers and white space
beyond Latin-1 are what the tiktoken library itself takes for them (its tables of Unicode are not Python's).
"""

from __future__ import annotations

import base64
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from topoeval.llm.bpe import Cache, lists
from topoeval.llm.common import slices, texts

#: Characters of text that are cut into words at a time; pairs whose compatibility is remembered.
SLICE_CHARS = 1 << 18
PAIRS = 1 << 17
NEVER = 1 << 60

LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACE = "\t-\r \x85\xa0"
#: The pattern of the rank files for text in Latin-1.
WORD = re.compile(
    f" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:[stmd]|re|ve|ll)| ?[^{SPACE}{LETTER}{NUMBER}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
#: No word goes over such a place.
EDGE = re.compile(f"(?<=[^{SPACE}])[{SPACE}]")


def character_classes() -> bytes:
    """For each code point a Latin-1 character that WORD treats alike: itself, or one letter, number, white space
    or other character for those beyond Latin-1, as the library sorts them.
    """
    import tiktoken

    single = {bytes([b]): b for b in range(256)}
    points = "".join(chr(c) for c in range(256, 0x110000) if not 0xD800 <= c < 0xE000)
    table = np.full(0x110000, ord("\xf7"), np.uint8)
    table[:256] = np.arange(256)
    for pattern, stand_in in ((r"\p{L}", "\xff"), (r"\p{N}", "\xbe"), (r"\s", "\x85")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = bytes(probe.encode_ordinary(points)).decode()
        table[np.frombuffer(found.encode("utf-32-le"), "<u4")] = ord(stand_in)
    return table.tobytes()


class RankVocabulary:
    """Tokens of bytes by rank, every single byte among them."""

    def __init__(self, file: bytes, classes: bytes):
        import ahocorasick

        rows = [line.split() for line in file.splitlines() if line.strip()]
        #: token, a character for each byte -> id, which is its rank
        self.ranks = {base64.b64decode(t).decode("latin-1"): int(r) for t, r in rows}
        if missing := [b for b in range(256) if chr(b) not in self.ranks]:
            raise ValueError(f"no token for the bytes {missing}")
        self.tokens = {i: t for t, i in self.ranks.items()}
        self.classes = np.frombuffer(classes, np.uint8)
        self.automaton = ahocorasick.Automaton()
        for t, i in self.ranks.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        self.compatible = functools.lru_cache(maxsize=PAIRS)(self._compatible)
        self.shorter = functools.cache(self._shorter)
        #: word -> its ids, packed
        self.packed = Cache(lambda w: np.array(self.encode_word(w.encode().decode("latin-1")), "<u4").tobytes())
        self.width = max(map(len, self.ranks))
        last = max(self.tokens)
        self.table = pa.array([self.tokens[i].encode("latin-1") if i in self.tokens else None for i in range(last + 1)], pa.binary())

    def merged(self, word: str) -> list[str]:
        """By definition: the neighbours whose joined bytes have the least rank are joined, leftmost first."""
        parts = list(word)
        while len(parts) > 1:
            ranks = [self.ranks.get(a + b, NEVER) for a, b in zip(parts, parts[1:], strict=False)]
            best = min(ranks)
            if best == NEVER:
                break
            at = ranks.index(best)
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        a, b = self.tokens[left], self.tokens[right]
        return self.merged(a + b) == [a, b]

    def _shorter(self, token: int) -> int:
        """The longest token that is a proper beginning of this one; -1 if there is none."""
        t = self.tokens[token]
        return next((self.ranks[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in self.ranks), -1)

    def longest(self, word: str, at: int) -> int:
        """The longest token that starts here; a match takes time in proportion to the string that is searched."""
        return next(self.automaton.iter_long(word[at : at + self.width]))[1]

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word, whose characters stand for its bytes."""
        if (whole := self.ranks.get(word)) is not None:
            return [whole]
        out: list[int] = []
        at, n, left = 0, len(word), set()
        token = self.longest(word, 0) if n else -1
        while at < n:
            end = at + len(self.tokens[token])
            if end not in left and (not out or self.compatible(out[-1], token)):
                out.append(token)
                at = end
                if at < n:
                    token = self.longest(word, at)
                continue
            token = self.shorter(token)
            while token < 0:  # nothing fits here: this place is left for good
                if not out:
                    raise ValueError("no sequence of tokens fits")
                left.add(at)
                token = out.pop()
                at -= len(self.tokens[token])
                token = self.shorter(token)
        return out

    def words(self, text: str) -> Iterator[list[str]]:
        """The words of a text, in lists of bounded size."""
        try:
            text.encode("latin-1")
            like = text
        except UnicodeEncodeError:
            like = self.classes[np.frombuffer(text.encode("utf-32-le"), "<u4")].tobytes().decode("latin-1")
        at, n = 0, len(text)
        while at < n:
            edge = EDGE.search(like, at + SLICE_CHARS) if n - at > SLICE_CHARS else None
            end = edge.start() if edge else n
            found = WORD.findall(like if end - at == n else like[at:end])
            if like is not text:
                ends = np.cumsum([at, *map(len, found)]).tolist()
                found = [text[i:j] for i, j in zip(ends, ends[1:], strict=False)]
            yield found
            at = end

    def encode(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        return b"".join([b"".join(map(self.packed.__getitem__, words)) for words in self.words(text)])

    def decode(self, ids: pa.BinaryArray) -> pa.BinaryArray:
        """Bytes of rows of packed ids; null rows have none."""
        sizes = np.array([0 if x is None else len(x) // 4 for x in ids.to_pylist()], np.int64)
        flat = np.frombuffer(b"".join([x or b"" for x in ids.to_pylist()]), "<u4")
        if flat.size and int(flat.max()) >= len(self.table):
            raise ValueError("an id without a token")
        tokens = self.table.take(pa.array(flat))
        if tokens.null_count:
            raise ValueError("an id without a token")
        at = np.frombuffer(tokens.buffers()[1], np.int32, len(tokens) + 1) if len(tokens) else np.zeros(1, np.int32)
        ends = at[np.concatenate(([0], np.cumsum(sizes)))]
        data = tokens.buffers()[2] if len(tokens) else pa.py_buffer(b"")
        return pa.BinaryArray.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), data])


@functools.lru_cache(maxsize=2)
def rank_vocabulary(file: bytes, classes: bytes) -> RankVocabulary:
    return RankVocabulary(file, classes)


def _shared(spark: SparkSession, path: str):
    """The rank file and the table of character classes, broadcast: 2 MB, whatever the data."""
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast((f.read(), character_classes()))


def byte_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode every whole text and decode its ids: doc_id, ids (binary, four little-endian bytes an id), decoded (binary).

    Null and empty texts have no ids. Rows that repeat are each returned; other columns are not read.
    """
    file = _shared(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rank_vocabulary(*file.value)
        for b in slices(batches):
            ids = pa.array([vocabulary.encode(x) for x in texts(b)], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), ids, vocabulary.decode(ids)], ["doc_id", "ids", "decoded"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids binary, decoded binary")


def byte_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row, repeated ones too; an empty array for null and empty texts."""
    file = _shared(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rank_vocabulary(*file.value)
        for b in slices(batches):
            packed = [vocabulary.encode(x) for x in texts(b)]
            flat = np.frombuffer(b"".join(packed), "<u4").astype(np.int32)
            found = lists(pa.array(flat), np.array([len(x) // 4 for x in packed], np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), found], ["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def byte_decode(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and decoded (binary: ids may end within a character) of every row of ids (array<int>), repeated ones too;
    no bytes for null or no ids. An id that the file lacks stops the query.
    """
    file = _shared(encoded.sparkSession, path)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = rank_vocabulary(*file.value)
        for b in slices(batches):
            packed = pa.array([np.array(x or [], "<u4").tobytes() for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), vocabulary.decode(packed)], ["doc_id", "decoded"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, decoded binary")
