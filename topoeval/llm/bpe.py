"""BPE encoding and decoding as bounded-lookahead streaming transducers.

Encoder. A merge can only wait for symbols to its right through a chain of merges of ever
smaller rank, so the merge list itself gives the number of symbols after which nothing to the
right can change a token any more (Merges.lookahead). The transducer reads symbols and emits a token once
it is stable: once its word has ended, or that many symbols of the word stand behind it. What is
not stable yet is its memory: less than a window of a few lookaheads, whatever the length of the word. Every
word goes through it, the words of a slice of texts in one stream; all words that have ended
inside the stream are merged side by side, a round of merges for all of them at a time.

Decoder. A state machine turns ids into the bytes that their token strings stand for, and bytes
into text: UTF-8, decoded incrementally, so that a character may be spread over tokens and calls; or
the byte alphabet of the file, as the tokenizers library writes ids for a file without a decoder.

Texts are read in slices of bounded size, cut at white space. The distinct chunks (stretches
without white space) of a slice are encoded and decoded once, and those of late slices are remembered
in a bounded table; a text's digests follow from the joined forms of its chunks. Normalisation and
the cutting of chunks into words are those of the tokenizer file, by the tokenizers library except for
Latin-1, where both are a regular expression.
"""

from __future__ import annotations

import codecs
import functools
import hashlib
import heapq
import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from topoeval.llm.common import slices, texts

#: Characters of text that are encoded at a time, entries of a cache, longest word in it.
SLICE_CHARS = 1 << 18
CACHE = 400_000
#: Chunks whose forms a worker remembers (some 350 bytes each).
KNOWN = 250_000
CACHED_CHARS = 64
#: Longest word that is merged side by side with others.
SHORT = 64
#: Pairs of ids below this (single bytes, in the known files) are looked up in a square table.
BASE = 512
NEVER = np.int32(1 << 30)

_SPACE = " \t\n\r\x0b\x0c"


# --- merges -------------------------------------------------------------------------------


def byte_chars() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    table = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class Merges:
    """The merge list of a tokenizer file."""

    def __init__(self, spec: dict):
        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        pairs = [p if isinstance(p, list) else p.split(" ") for p in model["merges"]]
        ids = self.vocab
        #: (left, right) -> (rank, merged)
        self.rank = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in reversed([*enumerate(pairs)])}
        self.order = {p: r for p, (r, _) in self.rank.items()}
        self.made = {r: merged for r, merged in self.rank.values()}
        chars = byte_chars()
        self.first = [ids[c] for c in chars]
        self.last = [ids[c + self.suffix] for c in chars]
        self.byte_of = {c: b for b, c in enumerate(chars)}
        self.strings = {i: t for t, i in ids.items()}
        self.width = {
            i: len(t) - len(self.suffix) * (bool(self.suffix) and t.endswith(self.suffix) and len(t) > len(self.suffix))
            for t, i in ids.items()
        }
        self.first_of, self.last_of = np.array(self.first, np.int32), np.array(self.last, np.int32)
        keys = np.array([a << 32 | b for a, b in self.rank], np.int64)
        by_key = np.argsort(keys)
        self._keys = keys[by_key]
        self._ranks = np.array([r for r, _ in self.rank.values()], np.int32)[by_key]
        small = keys[(keys >> 32 < BASE) & (keys & 0xFFFFFFFF < BASE)]
        self._base = np.full((BASE, BASE), NEVER, np.int32)
        self._base[small >> 32, small & 0xFFFFFFFF] = [self.order[k >> 32, k & 0xFFFFFFFF] for k in small.tolist()]
        self._made = np.zeros(len(pairs), np.int32)
        self._made[list(self.made)] = list(self.made.values())

    def symbols(self, word: bytes) -> list[int]:
        out = [self.first[b] for b in word]
        if out:
            out[-1] = self.last[word[-1]]
        return out

    def merge(self, symbols: list[int]) -> list[int]:
        """Tokens of a sequence of symbols: least rank first, leftmost of equal ones."""
        if len(symbols) > 64:
            return self._merge_long(symbols)
        get, made, never = self.order.get, self.made, 1 << 30
        s = list(symbols)
        ranks = [get(p, never) for p in zip(s, s[1:], strict=False)]
        while ranks:
            best = min(ranks)
            if best == never:
                break
            at = ranks.index(best)
            s[at : at + 2] = [made[best]]
            del ranks[at]
            if at:
                ranks[at - 1] = get((s[at - 1], s[at]), never)
            if at < len(ranks):
                ranks[at] = get((s[at], s[at + 1]), never)
        return s

    def _merge_long(self, symbols: list[int]) -> list[int]:
        rank, s, n = self.rank, list(symbols), len(symbols)
        after, before = [*range(1, n), -1], [-1, *range(n - 1)]
        heap = [(r[0], k, s[k], s[k + 1], r[1]) for k in range(n - 1) if (r := rank.get((s[k], s[k + 1])))]
        heapq.heapify(heap)
        while heap:
            _, k, a, b, merged = heapq.heappop(heap)
            j = after[k]
            if s[k] != a or j < 0 or s[j] != b:
                continue
            s[k], s[j], after[k] = merged, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = k
            for x, y in ((before[k], k), (k, after[k])):
                if x >= 0 and y >= 0 and (r := rank.get((s[x], s[y]))):
                    heapq.heappush(heap, (r[0], x, s[x], s[y], r[1]))
        return [x for x in s if x >= 0]

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of symbols; NEVER if there is none."""
        if left.size and max(left.max(), right.max()) < BASE:
            return self._base[left, right]
        keys = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self._keys, keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._ranks[at], NEVER)

    def merge_equal(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of words of one size (a row of symbols each): the rows, filled with -1, and their sizes."""
        n, width = words.shape
        out, sizes = np.full((n, width), -1, np.int32), np.full(n, width, np.int64)
        rank = np.full((n, width), NEVER, np.int32)
        rank[:, : width - 1] = self.ranks(words[:, :-1], words[:, 1:])
        tokens, row, last = words.copy(), np.arange(n), width
        while len(row):
            at = rank.argmin(axis=1)
            every = np.arange(len(row))
            best = rank[every, at]
            live = best < NEVER
            if not live.all():
                out[row[~live], :last] = tokens[~live, :last]
                sizes[row[~live]] = last
                row, at, best, every = row[live], at[live], best[live], every[: int(live.sum())]
                tokens, rank = tokens[live], rank[live]
            if not len(row):
                break
            tokens[every, at] = self._made[best]
            last -= 1  # every live word loses one symbol in every round
            cols = np.arange(last)[None, :]
            tokens = np.take_along_axis(tokens, cols + (cols > at[:, None]), axis=1)
            rank = np.take_along_axis(rank, cols + (cols >= at[:, None]), axis=1)
            left = np.flatnonzero(at > 0)
            rank[left, at[left] - 1] = self.ranks(tokens[left, at[left] - 1], tokens[left, at[left]])
            right = np.flatnonzero(at < last - 1)
            rank[right, at[right]] = self.ranks(tokens[right, at[right]], tokens[right, at[right] + 1])
        return out, sizes

    def merge_words(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of many words that end (behind a symbol) at ``ends``, and how many each word has."""
        begins = np.concatenate(([0], ends[:-1]))
        size = ends - begins
        order = np.argsort(size, kind="stable")
        cuts = np.flatnonzero(np.diff(size[order], prepend=-1))
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        counts = np.zeros(len(ends), np.int64)
        for of in np.split(order, cuts[1:]):
            width = int(size[of[0]]) if len(of) else 0
            if width == 0:
                continue
            if width == 1:
                rows, n = symbols[begins[of]][:, None], np.ones(len(of), np.int64)
            elif width <= SHORT:
                rows, n = self.merge_equal(symbols[begins[of][:, None] + np.arange(width)])
            else:
                for w in of.tolist():
                    tokens = np.array([*self.windowed(symbols[begins[w] : ends[w]].tolist())], np.int32)
                    counts[w] = len(tokens)
                    found.append((np.array([w]), tokens[None, :], counts[w : w + 1]))
                continue
            counts[of] = n
            found.append((of, rows, n))
        starts = np.cumsum(counts) - counts
        out = np.empty(int(counts.sum()), np.int32)
        for of, rows, n in found:
            inside = np.arange(rows.shape[1])[None, :] < n[:, None]
            out[(starts[of][:, None] + np.arange(rows.shape[1]))[inside]] = rows[inside]
        return out, counts

    def stable(self, window: list[int]) -> tuple[list[int], int]:
        """Tokens of the window that no symbol behind it can change, and how many symbols they take."""
        bound, end, out = len(window) - self.lookahead, 0, []
        for t in self.merge(window):
            if end + self.width[t] > bound:
                break
            end += self.width[t]
            out.append(t)
        return out, end

    @functools.cached_property
    def window(self) -> int:
        return 4 * self.lookahead + 256

    def windowed(self, symbols: list[int]) -> Iterator[int]:
        """Tokens of a long word, each emitted once it is stable."""
        held: list[int] = []
        full = self.window
        for at in range(0, len(symbols), 256):
            held += symbols[at : at + 256]
            if len(held) >= full:
                out, end = self.stable(held)
                yield from out
                held = held[end:]
                full = max(self.window, len(held) + self.lookahead + 256)
        yield from self.merge(held)

    @functools.cached_property
    def lookahead(self) -> int:
        """Symbols beyond a token's end that can decide whether it comes to be and stays.

        reach[t]: by merges (t, y) seen so far, the width of y and what y itself waits for. held[t]:
        the same for the parts on t's right edge, up to the merge that takes each of them.
        """
        reach: dict[int, int] = {}
        held: dict[int, int] = {}
        for (a, b), (_, merged) in sorted(self.rank.items(), key=lambda x: x[1][0]):
            waits = max(reach.get(b, 0), held.get(b, 0))
            held[merged] = max(held.get(merged, 0), waits)
            reach[a] = max(reach.get(a, 0), self.width[b] + waits)
        return max([1, *reach.values(), *held.values()])


class Transducer:
    """Symbols in, stable tokens out. Between calls it holds the symbols of an unfinished word that
    are not stable yet: fewer than a window.
    """

    def __init__(self, merges: Merges):
        self.merges = merges
        self.held = np.empty(0, np.int32)

    def feed(self, symbols: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The next symbols; words end behind a symbol at ``ends``. Tokens that are stable now, and
        how many of them belong to each word that ended; tokens beyond those are of an unfinished word.
        """
        held = len(self.held)
        symbols = np.concatenate((self.held, symbols)).astype(np.int32, copy=False)
        ends = np.asarray(ends, np.int64) + held
        done = int(ends[-1]) if len(ends) else 0
        tokens, counts = self.merges.merge_words(symbols[:done], ends) if len(ends) else (np.empty(0, np.int32), np.empty(0, np.int64))
        rest, early = symbols[done:], []
        while len(rest) >= self.merges.window:
            out, end = self.merges.stable(rest[: self.merges.window].tolist())
            if not end:
                break
            early += out
            rest = rest[end:]
        self.held = rest
        return np.concatenate((tokens, np.array(early, np.int32))), counts

    def flush(self) -> np.ndarray:
        """The end of an unfinished word."""
        out, self.held = np.array([*self.merges.windowed(self.held.tolist())], np.int32), np.empty(0, np.int32)
        return out


# --- text to ids --------------------------------------------------------------------------


def cut_at_space(text: str, chars: int = SLICE_CHARS) -> Iterator[str]:
    """Slices of about so many characters; each but the first starts with the white space of a run."""
    edge, at = re.compile(f"(?<=[^{_SPACE}])[{_SPACE}]"), 0
    while len(text) - at > chars and (m := edge.search(text, at + chars)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:] if at else text


class Cache(dict):
    """word -> make(word), bounded: when full, what was not asked for since it was last full goes; long
    words are not kept.
    """

    def __init__(self, make: Callable, entries: int = CACHE):
        super().__init__()
        self.make, self.entries, self.old = make, entries // 2, {}

    def __missing__(self, word):
        out = self.old.get(word)
        if out is None:
            out = self.make(word)
            if len(word) > CACHED_CHARS:
                return out
        self.put(word, out)
        return out

    def put(self, word, out) -> None:
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[word] = out


def lists(values, sizes: np.ndarray) -> pa.ListArray:
    """An Arrow array of lists of these sizes."""
    ends = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=ends[1:])
    return pa.ListArray.from_arrays(pa.array(ends), values)


class Tokenization:
    """What both kinds of tokenizer files share: the file, special strings, words to ids."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer

        spec = json.loads(text)
        self.library = Tokenizer.from_str(text)
        self.library.no_truncation()
        self.library.no_padding()
        self.merges = Merges(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")

    def segments(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Ordinary stretches of a text, and the special strings in it with their ids."""
        at = 0
        for m in self._special.finditer(text):
            if m.start() > at:
                yield text[at : m.start()], None
            yield m[0], self.special[m[0]]
            at = m.end()
        if at < len(text):
            yield text[at:] if at else text, None

    def library_words(self, text: str) -> list[str]:
        if self.library.normalizer is not None:
            text = self.library.normalizer.normalize_str(text)
        return [w for w, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]

    def transduced(self, words: list[str], sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of groups of so many words each, in order, and how many each group has. The distinct words go
        through the transducer as one stream of symbols.
        """
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        distinct = coded.dictionary
        ends = np.frombuffer(distinct.buffers()[1], np.int64, len(distinct) + 1)[1:] if len(distinct) else np.empty(0, np.int64)
        raw = np.frombuffer(distinct.buffers()[2], np.uint8, int(ends[-1])) if len(ends) and ends[-1] else np.empty(0, np.uint8)
        symbols = self.merges.first_of[raw]
        symbols[ends - 1] = self.merges.last_of[raw[ends - 1]]
        ids, counts = Transducer(self.merges).feed(symbols, ends)
        each = lists(pa.array(ids), counts).take(coded.indices)
        n = np.concatenate(([0], np.cumsum(pc.list_value_length(each).to_numpy())))
        at = np.concatenate(([0], np.cumsum(sizes)))
        return each.flatten().to_numpy(), np.diff(n[at])


class WordTokenization(Tokenization):
    """Tokenizer files that lower-case, drop white space and mark the ends of words."""

    CHUNK = re.compile(f"[^{_SPACE}]+")
    #: Words of lower-case Latin-1, whose letters and numbers are the same in all versions of Unicode, which is in
    #: normal form C, and whose capitals each have one small letter. A line end stands between chunks.
    LETTER = "a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff"
    NUMBER = "0-9\xb2\xb3\xb9\xbc-\xbe"
    WORD = re.compile(rf"[{LETTER}]+|\n|[{NUMBER}]|'(?:[stmd]|re|ve|ll)|[^{_SPACE}{LETTER}{NUMBER}]+")
    #: Controls, and what else may be white space, are left to the library; so is all beyond Latin-1.
    ODD = re.compile(r"[\x00-\x1f\x7f-\xa0]|[^\x00-\xff]")

    def __init__(self, text: str):
        super().__init__(text)
        machine = Decoder(self)
        strings = self.merges.strings | {i: t for t, i in self.special.items()}
        ids = range(max(strings) + 1)
        #: for each id: a space and the id; a space and the text that the decoder gives for it
        self.decimal = pa.array([f" {i}" for i in ids], pa.string())
        self.written = pa.array([" " + machine.written(i) if i in strings else None for i in ids], pa.string())
        #: chunk -> (number of ids, decimal form, decoded form)
        self.known: dict[str, tuple[int, str, str]] = {}

    def chunk_ids(self, chunks: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """The chunks in some order, their ids and how many each has."""
        odd = [c for c in chunks if not (c.isascii() and c.isprintable()) and self.ODD.search(c)]
        if odd:
            leave = set(odd)
            chunks = [c for c in chunks if c not in leave]
        words = self.WORD.findall("\n".join(chunks).lower())
        coded = np.frombuffer(b"".join([b"\1" if w == "\n" else b"\0" for w in words]), np.uint8)
        breaks = np.flatnonzero(coded)
        sizes = np.diff(np.concatenate(([-1], breaks, [len(words)]))) - 1 if chunks else np.empty(0, np.int64)
        if len(breaks):
            words = [w for w in words if w != "\n"]
        byte_of, more = self.merges.byte_of, []
        for c in odd:
            found = [bytes(map(byte_of.__getitem__, w)).decode() for w in self.library_words(c)]
            words += found
            more.append(len(found))
        ids, counts = self.transduced(words, np.concatenate((sizes, np.array(more, np.int64))).astype(np.int64))
        return [*chunks, *odd], ids, counts

    def forms(self, chunks: list[str]) -> list[tuple[int, str, str]]:
        """Of each chunk: number of ids, its ids in decimal form, and what they decode to; a space before each."""
        known = self.known
        out = list(map(known.get, chunks))
        missing = [k for k, form in enumerate(out) if form is None]
        if missing:
            new, ids, counts = self.chunk_ids([chunks[k] for k in missing])
            found = (pc.binary_join(lists(of.take(pa.array(ids)), counts), "").to_pylist() for of in (self.decimal, self.written))
            fresh = dict(zip(new, zip(counts.tolist(), *found, strict=True), strict=True))
            for k in missing:
                out[k] = fresh[chunks[k]]
            if len(known) + len(new) > KNOWN:
                known.clear()
            known.update((c, f) for c, f in fresh.items() if len(c) <= CACHED_CHARS)
        return out

    def pieces(self, text: str) -> Iterator[tuple[str, int | None]]:
        """Slices of a text, and special strings with their ids."""
        for part, special in self.segments(text):
            if special is not None:
                yield part, special
            else:
                for piece in cut_at_space(part):
                    yield piece, None

    def encode(self, text: str) -> Iterator[list[int]]:
        """Ids of a text, in lists of bounded size for ordinary texts."""
        for piece, special in self.pieces(text):
            if special is not None:
                yield [special]
            elif chunks := self.CHUNK.findall(piece):
                names, ids, counts = self.chunk_ids([*dict.fromkeys(chunks)])
                ends = np.cumsum(counts)
                at = {c: (int(e - n), int(e)) for c, n, e in zip(names, counts, ends, strict=True)}
                yield [i for c in chunks for i in ids[slice(*at[c])].tolist()]

    def joined(self, plain: pa.StringArray) -> tuple[np.ndarray, list[bytes], list[bytes]]:
        """Of each piece of text: number of ids, the ids in decimal form and the decoded text (a space before each)."""
        split = pc.ascii_split_whitespace(plain)
        coded = split.flatten().dictionary_encode()
        forms = self.forms([c for c in coded.dictionary.to_pylist() if c])
        if (blank := pc.index(coded.dictionary, "").as_py()) >= 0:
            forms.insert(blank, (0, "", ""))  # before the first and behind the last white space
        n = np.array([f[0] for f in forms], np.int64)
        sizes = pc.list_value_length(split).to_numpy()
        ends = np.concatenate(([0], np.cumsum(sizes)))
        total = np.concatenate(([0], np.cumsum(n[coded.indices.to_numpy()])))
        out = []
        for k in (1, 2):
            strings = pa.array([f[k] for f in forms], pa.binary()).take(coded.indices)
            out.append(pc.binary_join(lists(strings, sizes), b"").to_pylist())
        return np.diff(total[ends]), *out

    def digests(self, batch_texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, SHA-256 of the ids (decimal, a space between) and of the decoded text."""
        plans = [None if len(x) <= SLICE_CHARS and not self._special.search(x) else [*self.pieces(x)] for x in batch_texts]
        plain = [x for x, p in zip(batch_texts, plans, strict=True) if p is None]
        found = zip(*self.joined(pa.array(plain, pa.string())), strict=True) if plain else iter(())
        for plan in plans:
            n, a, d = 0, hashlib.sha256(), hashlib.sha256()
            for piece, special in plan or [(None, None)]:
                if plan is None:
                    count, ids, text = next(found)
                elif special is not None:
                    count, ids, text = 1, f" {special}".encode(), f" {piece}".encode()
                else:
                    ((count, ids, text),) = zip(*self.joined(pa.array([piece], pa.string())), strict=True)
                a.update(memoryview(ids)[0 if n else 1 :])
                d.update(memoryview(text)[0 if n else 1 :])
                n += int(count)
            yield n, a.hexdigest(), d.hexdigest()


class Decoder:
    """Ids to text by a state machine over bytes. ``library``: as the tokenizers library decodes with a
    file without a decoder, that is every byte as its letter of the byte alphabet, the mark of a word's
    end, and a space between tokens. Otherwise the bytes as UTF-8 with U+FFFD for what is none, and a space
    for each end of a word but the last.
    """

    def __init__(self, tokens: Tokenization, library: bool = True):
        m = tokens.merges
        self.library, self.suffix, self.letters = library, m.suffix, byte_chars()
        self.special = {i: t for t, i in tokens.special.items()}
        self.strings, self.byte_of = m.strings, m.byte_of
        self.utf8 = codecs.getincrementaldecoder("utf-8")("replace")
        self.begun = self.gap = False

    def token(self, i: int) -> tuple[bytes, bool]:
        """The bytes that an ordinary token stands for, and whether it ends a word."""
        s = self.strings[i]
        ends = bool(self.suffix) and s.endswith(self.suffix) and len(s) > len(self.suffix)
        return bytes(self.byte_of[c] for c in (s[: -len(self.suffix)] if ends else s)), ends

    def written(self, i: int) -> str:
        """What the library writes for a token."""
        if i in self.special:
            return self.special[i]
        raw, ends = self.token(i)
        return "".join(map(self.letters.__getitem__, raw)) + (self.suffix if ends else "")

    def _bytes(self, i: int) -> bytes:
        """What the token adds to the stream of bytes; whether a space is due is the machine's state."""
        out = b" " * self.gap
        if i in self.special:
            self.gap = bool(self.suffix)
            return out + self.special[i].encode()
        raw, self.gap = self.token(i)
        return out + raw

    def feed(self, ids: list[int]) -> str:
        if self.library:
            out = "".join([" " * (self.begun or k > 0) + self.written(i) for k, i in enumerate(ids)])
            self.begun = self.begun or bool(ids)
            return out
        return "".join([self.utf8.decode(self._bytes(i)) for i in ids])

    def flush(self) -> str:
        return "" if self.library else self.utf8.decode(b"", True)


@functools.lru_cache(maxsize=4)
def word_tokenization(text: str) -> WordTokenization:
    return WordTokenization(text)


def tokenizer_file(spark: SparkSession, path: str):
    """The tokenizer file as a broadcast string (a few MB, whatever the data)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(f.read())


# --- operators ----------------------------------------------------------------------------


def bpe_round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encode and decode every text; doc_id, n_tokens, ids_sha256, decoded_sha256 of each row.

    The digests are taken while streaming, of the decimal ids joined by a space and of the decoded
    text as the library decodes it. Null and empty texts have no tokens. Rows that repeat are each
    returned.
    """
    file = tokenizer_file(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenization(file.value)
        for b in slices(batches):
            counts, ids, decoded = zip(*tokens.digests(texts(b)), strict=True)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int64()), pa.array(ids, pa.string()), pa.array(decoded, pa.string())],
                ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(id_col, text_col).mapInArrow(
        run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array<int>) of every row, repeated ones too; an empty array for null and empty texts."""
    file = tokenizer_file(docs.sparkSession, path)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenization(file.value)
        for b in slices(batches):
            ids = [[i for part in tokens.encode(x) for i in part] for x in texts(b)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, ids array<int>")


def bpe_decode(
    encoded: DataFrame, path: str, library: bool = False, id_col: str = "doc_id", ids_col: str = "ids"
) -> DataFrame:
    """doc_id and text of every row of ids, repeated ones too; an empty text for null or no ids."""
    file = tokenizer_file(encoded.sparkSession, path)
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = word_tokenization(file.value)
        for b in slices(batches):
            out = []
            for ids in b.column(1).to_pylist():
                decoder = Decoder(tokens, library)
                out.append(decoder.feed(ids or []) + decoder.flush())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string())], ["doc_id", "text"])

    return encoded.select(id_col, ids_col).mapInArrow(run, f"doc_id {kind}, text string")
