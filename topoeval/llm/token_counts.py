"""Token counts by prefix dynamic programming over byte-level BPE.

The last token of the encoding of each prefix of a word is the only token that ends there,
stands for itself and is compatible with the last token of the prefix before it. Two tokens
are compatible if no merge can ever join a part on the left one's right edge to a part on the
right one's left edge while both are there. So one pass over a word stores the exact count, and the
last token, of every prefix; a text's prefix counts follow by adding the counts of the words before.
Truncation and budget questions are then lookups: nothing is encoded again. (Not so for stretches with controls or white
space beyond tab, line ends and the plain space, whose prefixes are cut into words one by one, at quadratic cost.)
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from topoeval.llm.bpe import _SPACE, CACHED_CHARS, Cache, Tokenization, cut_at_space, tokenizer_file
from topoeval.llm.common import slices, texts

LIMIT = 512
ENDLESS = 1 << 60
#: Code points of controls, and of white space beyond tab, line ends and the plain space.
ODD_POINTS = [
    *range(0x09), *range(0x0E, 0x20), 0x7F, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000,
]


class ByteTokenization(Tokenization):
    """Byte-level tokenizer files whose words keep one leading space (no normaliser)."""

    #: No token goes over the ends of a unit: a stretch without white space and one leading space, or
    #: white space.
    UNIT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
    #: Words of texts in Latin-1, whose letters and numbers are the same in all versions of Unicode.
    LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
    NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
    WORD = re.compile(
        f" ?[{LETTER}]+| ?[{NUMBER}]+|'(?:[stmd]|re|ve|ll)| ?[^{_SPACE}{LETTER}{NUMBER}]+"
        f"|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+"
    )
    #: The same for texts joined by a NUL, which stays by itself.
    WORD_OR_NUL = re.compile("\0|" + WORD.pattern.replace(f"[^{_SPACE}", f"[^\0{_SPACE}"))
    #: Texts with these are cut by the library.
    ODD = re.compile(f"[{re.escape(''.join(map(chr, ODD_POINTS)))}]")
    ODD_LATIN = bytes(c for c in ODD_POINTS if c < 256)

    def latin(self, text: str) -> bool:
        try:
            raw = text.encode("latin-1")
        except UnicodeEncodeError:
            return False
        return len(raw.translate(None, self.ODD_LATIN)) == len(raw)

    def units(self, part: str) -> Iterator[tuple[list[str], bool]]:
        """An ordinary stretch of text in units, in lists of bounded size; True if each is one word."""
        if self.latin(part):
            for piece in cut_at_space(part):
                yield self.WORD.findall(piece), True
        elif self.ODD.search(part):
            yield [part], False
        else:
            for piece in cut_at_space(part):
                yield self.UNIT.findall(piece), False

    def words(self, unit: str) -> list[bytes]:
        if self.latin(unit):
            return [w.encode() for w in self.WORD.findall(unit)]
        byte_of = self.merges.byte_of
        return [bytes(byte_of[c] for c in w) for w in self.library_words(unit)]


class PrefixCounter(ByteTokenization):
    """Exact token counts of all prefixes."""

    def __init__(self, text: str):
        super().__init__(text)
        m = self.merges
        named = {bytes(m.byte_of[c] for c in t): i for t, i in m.vocab.items() if all(c in m.byte_of for c in t)}
        #: tokens whose own string encodes to them
        self.tokens = {t: i for t, i in named.items() if m.merge(m.symbols(t)) == [i]}
        self.longest = max(map(len, self.tokens))
        self.parts: dict[int, tuple[int, int, int]] = {}
        for (a, b), (r, merged) in m.rank.items():
            if merged in self.parts:
                raise ValueError("a token of two merges: its parts are not known")
            self.parts[merged] = (a, b, r)
        self.compatible = functools.lru_cache(maxsize=CACHE_PAIRS)(self._compatible)
        self.edge = functools.cache(self._edge)
        self.unit_count = Cache(self._unit_count)
        self.single_count = Cache(lambda w: self.word_count(w.encode()))
        #: prefix -> (its last token, its count); holds all prefixes of what it holds
        self.known: dict[bytes, tuple[int, int]] = {b"": (-1, 0)}

    def _edge(self, token: int, side: int) -> list[tuple[int, int]]:
        """The parts on a token's left (0) or right (1) edge, with the rank that takes each away."""
        out, death = [(token, ENDLESS)], ENDLESS
        while token in self.parts:
            death = self.parts[token][2]
            token = self.parts[token][side]
            out.append((token, death))
        return out

    def _compatible(self, a: int, b: int) -> bool:
        rank = self.merges.rank
        for x, until_x in self.edge(a, 1):
            for y, until_y in self.edge(b, 0):
                r = rank.get((x, y))
                if r is not None and r[0] < until_x and r[0] <= until_y:
                    return False
        return True

    def extend(self, word: bytes) -> None:
        """Put all prefixes of a word into ``known``. Words that begin alike share the work."""
        known, tokens, compatible = self.known, self.tokens, self.compatible
        if len(known) > PREFIXES:
            known.clear()
            known[b""] = (-1, 0)
        n = len(word)
        done = n - 1
        while word[:done] not in known:
            done -= 1
        for p in range(done + 1, n + 1):
            for q in range(max(0, p - self.longest), p):
                t = tokens.get(word[q:p])
                if t is not None:
                    last, count = known[word[:q]]
                    if q == 0 or compatible(last, t):
                        known[word[:p]] = (t, count + 1)
                        break
            else:
                raise ValueError("no token ends here")

    def word_count(self, word: bytes) -> int:
        if len(word) > CACHED_CHARS:
            return self.prefix_tokens(word)[-1]
        if word not in self.known:
            self.extend(word)
        return self.known[word][1]

    def prefix_tokens(self, word: bytes) -> list[int]:
        """Token counts of word[:p] for p = 0 ... len(word)."""
        n, tokens, compatible = len(word), self.tokens, self.compatible
        count, last = [0] * (n + 1), [-1] * (n + 1)
        for p in range(1, n + 1):
            for q in range(max(0, p - self.longest), p):
                t = tokens.get(word[q:p])
                if t is not None and (q == 0 or compatible(last[q], t)):
                    last[p], count[p] = t, count[q] + 1
                    break
            else:
                raise ValueError("no token ends here")
        return count

    def _unit_count(self, unit: str) -> int:
        return sum(map(self.word_count, self.words(unit)))

    def counts(self, text: str) -> Iterator[tuple[str | None, list[str], list[int]]]:
        """(special string or None, units, token count of each unit), in order."""
        for part, special in self.segments(text):
            if special is not None:
                yield part, [part], [1]
            else:
                for units, single in self.units(part):
                    counts = self.single_count if single else self.unit_count
                    yield None, units, list(map(counts.__getitem__, units))

    def prefix_counts(self, text: str) -> np.ndarray:
        """Token counts of text[:p] for p = 0 ... len(text): what the tokenizer gives for each prefix."""
        out, total = [0], 0
        for part, special in self.segments(text):
            if special is not None:
                # a special string that is cut short is ordinary text after what stands before it
                out += self._cut_special(text[: len(out) - 1], part)
                total += 1
                out.append(total)
                continue
            out += [total + c for c in self._part_counts(part)]
            total = out[-1]
        return np.array(out, dtype=np.int64)

    def _cut_special(self, before: str, special: str) -> list[int]:
        done = sum(sum(c) for _, _, c in self.counts(before)) if before else 0
        start = max([m.end() for m in self._special.finditer(before)], default=0)
        tail = before[start:]
        done -= self._plain(tail)
        return [done + self._plain(tail + special[:k]) for k in range(1, len(special))]

    def _plain(self, part: str) -> int:
        return sum(self.unit_count[u] for units, _ in self.units(part) for u in units) if part else 0

    def _part_counts(self, part: str) -> list[int]:
        """Counts of part[:p] for p = 1 ... len(part), for text without special strings."""
        out: list[int] = []
        before, space, space_before = 0, b"", 0  # tokens before this word; the white space just before it
        if self.ODD.search(part):  # rare: words may change with what follows, so each prefix is cut anew
            return [self._plain(part[:p]) for p in range(1, len(part) + 1)]
        for units, _ in self.units(part):
            for unit in units:
                for word in self.words(unit):
                    counts = self.prefix_tokens(word)
                    text = word.decode("utf-8")
                    at, blank = 0, not word.strip()
                    for k, c in enumerate(text, 1):
                        at += len(c.encode())
                        n = before + counts[at]
                        if k == 1 and space and c in _SPACE:  # joins the white space before it
                            n = space_before + self.prefix_tokens(space + c.encode())[-1]
                        elif word[:1] == b"'" and len(word) > 2 and word[1:].isalpha() and k == 2:
                            n = before + self._plain(text[:2])  # not yet a contraction
                        out.append(n)
                    if blank:
                        space_before, space = (before, word) if not space else (space_before, space + word)
                    else:
                        space = b""
                    before += counts[-1]
        return out

    def fit(self, text: str, budget: int) -> int:
        """The longest prefix, in characters, of at most ``budget`` tokens."""
        return int(np.flatnonzero(self.prefix_counts(text) <= budget)[-1])


#: Pairs of tokens whose compatibility is remembered, and prefixes of words whose counts are.
CACHE_PAIRS = 1 << 18
PREFIXES = 400_000


@functools.lru_cache(maxsize=4)
def prefix_counter(text: str) -> PrefixCounter:
    return PrefixCounter(text)


def token_counts(
    docs: DataFrame, path: str, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit of every row, repeated ones too. Null and empty texts count 0."""
    file = tokenizer_file(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(file.value)
        for b in slices(batches):
            n_bytes, n_tokens = [], []
            for text in texts(b):
                n_bytes.append(len(text.encode()))
                n_tokens.append(sum(sum(c) for _, _, c in counter.counts(text)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(n_bytes, pa.int64()),
                    pa.array(n_tokens, pa.int64()),
                    pa.array([n > limit for n in n_tokens], pa.bool_()),
                ],
                ["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean"
    )


def prefix_counts(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and counts (array<long>: the tokens of each prefix of 0, 1, ... characters) of every row, repeated ones too;
    [0] for null and empty texts.
    """
    file = tokenizer_file(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(file.value)
        for b in slices(batches):
            found = [counter.prefix_counts(x) for x in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "counts"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, counts array<long>")


def truncated(
    docs: DataFrame, path: str, budget: int = LIMIT, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """doc_id, text (its longest prefix of at most ``budget`` tokens), cut (whether anything went) of every row, repeated
    ones too; a null text is empty.
    """
    file = tokenizer_file(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_counter(file.value)
        for b in slices(batches):
            whole = texts(b)
            out = [x[: counter.fit(x, budget)] for x in whole]
            cut = [len(x) < len(y) for x, y in zip(out, whole, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(out, pa.string()), pa.array(cut, pa.bool_())], ["doc_id", "text", "cut"]
            )

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, text string, cut boolean")
