"""BPE encoding and decoding with a transducer lexicon, a piece of many documents at a time.

The corpus's most frequent words are encoded once and compiled into a minimal acyclic
automaton: words share prefixes and suffixes, every transition carries how many accepted words it passes
over, so the sums along a word's path number it, and the number finds its ids. The automaton is laid
out as a double array in an anonymous file in memory, which each Python worker maps.

Texts are handled in pieces of about PIECE bytes. Word borders of a piece come from the classes of its characters; its
distinct words then walk the automaton side by side, a byte a step, and those that it does not accept are merged exactly by the
rules, side by side as well: in each round every word merges its pair of lowest rank, the leftmost of equals. What a
worker holds is a few arrays over one piece, whatever the batch, the table or the vocabulary of the corpus.

``frequent`` counts all words of all documents, summed in each task before the shuffle; the lexicon holds
the ``lexicon_words`` most frequent (a documented bound, 50,000; words of up to 64 characters), which bounds what is collected
and broadcast to a few MB whatever the corpus. The bound affects speed only: every word is encoded exactly either way.

Defined results: a null or empty text has no ids and decodes to the empty text; the special
strings of the vocabulary found in a text get their ids; a text longer than a piece is encoded in parts cut at spaces, with the
same ids (a longer run without a space stays whole); repeated rows and ids each get their row; an empty table gives no rows;
other columns, whatever their names, are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import os
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netdensity.llm.common import lean
from netdensity.session import fewer, materialize

LEXICON_WORDS = 50_000
#: Bytes of text, about, that are encoded together.
PIECE = 2 << 20
#: Ids that are decoded together.
BLOCK = 1 << 19
#: Bytes up to which words are merged side by side; a longer word is merged with a queue of its own.
SIDE_BY_SIDE = 64
#: No rule for a pair.
NONE = np.int32(2**31 - 1)
#: Texts within these characters are already normalised but for their case.
COMMON = re.compile("[\x00-\u017f\u2010-\u2027\u2030-\u205e\u20ac]*")
SPACE, LETTER, DIGIT, OTHER = range(4)
#: What may follow an apostrophe that begins a word, as one word with it (fixed values of the splitter's pattern).
ENDINGS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")


def ranges(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All of starts[0], starts[0] + 1, ... up to n[0] of them, then the next."""
    out = np.arange(n.sum())
    return out + np.repeat(starts - np.cumsum(n) + n, n)


class Rules:
    """Vocabulary, merges, normaliser and splitter of a tokenizer file."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        shown = {i: t for t, i in (vocab | self.special).items()}
        self.tokens = [shown.get(i, "") for i in range(max(shown) + 1)]
        self.at_special = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.base = len(self.tokens)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = (np.array([vocab[p[k]] for p in pairs], np.int64) for k in (0, 1))
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self.keys, first = np.unique(left * self.base + right, return_index=True)
        self.ranks = first.astype(np.int32)
        itself = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letter = {b: chr(b) for b in itself} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(itself))}
        # Ids of the 256 bytes within a word, then of the 256 that end one.
        self.byte = np.array([vocab[letter[b] + e] for e in ("", suffix) for b in range(256)], np.int32)
        self.first = self.rank(np.repeat(self.byte[:256], 512), np.tile(self.byte, 256)).reshape(256, 512)
        self.table: dict[int, int] | None = None
        spec["model"] = model | {"vocab": {}, "merges": [], "end_of_word_suffix": None}
        spec["added_tokens"] = []
        library = Tokenizer.from_str(json.dumps(spec))
        self.normalise, self.splitter = library.normalizer.normalize_str, library.pre_tokenizer
        self.kinds = {}
        self.ascii = self.classes_of(np.arange(128))

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs of ids."""
        key = a.astype(np.int64) * self.base + b
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], NONE) if len(self.keys) else np.full(len(key), NONE)

    def classes_of(self, points: np.ndarray) -> np.ndarray:
        """The class of each code point, by the regular expressions of the library, which are asked once for each block of 256."""
        out = np.zeros(len(points), np.uint8)
        block = points >> 8
        for b in np.unique(block).tolist():
            if b not in self.kinds:
                self.kinds[b] = block_classes(b)
            m = block == b
            out[m] = self.kinds[b][points[m] & 255]
        return out

    def words(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where the words of normalised UTF-8 begin, the bytes of all words without the spaces between, and the words' ends in these."""
        kind = self.ascii[data & 127]
        lead = np.flatnonzero(data >= 0xC0)
        if len(lead):
            x = data[lead].astype(np.int32)
            size = 2 + (x >= 0xE0) + (x >= 0xF0)
            point = x & np.array([0, 0, 31, 15, 7])[size]
            for k in (1, 2, 3):
                m = size > k
                point[m] = point[m] << 6 | data[lead[m] + k] & 63
            c = self.classes_of(point)
            for k in range(4):
                m = size > k
                kind[lead[m] + k] = c[m]
        start = np.empty(len(data), bool)
        start[:1] = True
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT) & (data[1:] & 0xC0 != 0x80)
        mark = np.flatnonzero(start & (data == 39))
        for e in ENDINGS:
            m = mark[mark + len(e) < len(data)]
            for k, c in enumerate(e):
                m = m[data[m + k + 1] == c]
            start[m + 1] = False
            after = m + len(e) + 1
            start[after[after < len(data)]] = True
        solid = kind != SPACE
        begins = np.flatnonzero(start & solid)
        kept = data[solid]
        before = np.cumsum(solid)
        return begins, kept, np.append(before[begins[1:]] - 1, len(kept)) if len(begins) else np.zeros(0, np.int64)

    def merge(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one after the other, and how many each has, by merging each word's pair of the lowest rank, leftmost first."""
        n = np.diff(ends, prepend=0)
        count, done = np.zeros(len(n), np.int64), []
        long = np.flatnonzero(n > SIDE_BY_SIDE)
        for w in long.tolist():
            ids = self.merge_long(data[ends[w] - n[w] : ends[w]])
            count[w] = len(ids)
            done.append((np.array([w]), np.array([len(ids)]), ids))
        word = np.repeat(np.arange(len(n)), n)
        last = np.zeros(len(data), bool)
        last[ends - 1] = True
        wide = data.astype(np.int32) + 256 * last
        sym, rank = self.byte[wide], np.full(len(data), NONE)
        rank[:-1] = self.first[data[:-1], wide[1:]]
        rank[last] = NONE
        if len(long):
            m = n[word] <= SIDE_BY_SIDE
            word, sym, rank = word[m], sym[m], rank[m]
        while len(word):
            head = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
            size = np.diff(head, append=len(word))
            least = np.minimum.reduceat(rank, head)
            over = least == NONE
            if over.any():
                m = np.repeat(over, size)
                done.append((word[head[over]], size[over], sym[m]))
                count[word[head[over]]] = size[over]
                word, sym, rank, least, size = word[~m], sym[~m], rank[~m], least[~over], size[~over]
                if not len(word):
                    break
            at = np.flatnonzero(rank == np.repeat(least, size))
            at = at[np.append(True, word[at[1:]] != word[at[:-1]])]
            sym[at] = self.made[rank[at]]
            stay = np.ones(len(word), bool)
            stay[at + 1] = False
            word, sym, rank = word[stay], sym[stay], rank[stay]
            at -= np.arange(len(at))
            for p in (at, at[at > 0] - 1):
                ok = p + 1 < len(word)
                ok[ok] = word[p[ok]] == word[p[ok] + 1]
                rank[p[~ok]] = NONE
                rank[p[ok]] = self.rank(sym[p[ok]], sym[p[ok] + 1])
        out, begin = np.zeros(count.sum(), np.int32), np.cumsum(count) - count
        for w, size, ids in done:
            out[ranges(begin[w], size)] = ids
        return out, count

    def merge_long(self, data: np.ndarray) -> np.ndarray:
        """The same for one word of any length."""
        if self.table is None:
            self.table = dict(zip(self.keys.tolist(), self.ranks.tolist()))
        parts = self.byte[data.astype(np.int32) + 256 * (np.arange(len(data)) == len(data) - 1)].tolist()
        base, rank, made = self.base, self.table, self.made
        after, before = [*range(1, len(parts)), -1], [-1, *range(len(parts) - 1)]
        queue = [(rank[p], k, p) for k, p in enumerate(a * base + b for a, b in zip(parts, parts[1:])) if p in rank]
        heapq.heapify(queue)
        while queue:
            r, k, pair = heapq.heappop(queue)
            j = after[k]
            if parts[k] < 0 or j < 0 or parts[k] * base + parts[j] != pair:
                continue
            parts[k], parts[j], after[k] = int(made[r]), -1, after[j]
            if after[k] >= 0:
                before[after[k]] = k
            for i in (before[k], k):
                if i >= 0 and after[i] >= 0 and (p := parts[i] * base + parts[after[i]]) in rank:
                    heapq.heappush(queue, (rank[p], i, p))
        return np.array([p for p in parts if p >= 0], np.int32)


def block_classes(block: int) -> np.ndarray:
    """The classes of 256 code points; those without a character count as white space, since no text holds them."""
    from tokenizers import Regex, pre_tokenizers

    points = [p for p in range(block << 8, (block + 1) << 8) if p < 0x110000 and not 0xD800 <= p < 0xE000]
    out, text = np.zeros(256, np.uint8), "".join(map(chr, points))
    for kind, pattern in ((LETTER, r"[\p{L}]+"), (DIGIT, r"[\p{N}]+"), (OTHER, r"[^\s\p{L}\p{N}]+")):
        for _, (a, z) in pre_tokenizers.Split(Regex(pattern), "removed", invert=True).pre_tokenize_str(text) if text else []:
            out[[p & 255 for p in points[a:z]]] = kind
    return out


def compile_lexicon(entries: dict[str, list[int]]) -> bytes:
    """The automaton file for words and their ids."""
    words = sorted((w.encode(), ids) for w, ids in entries.items())
    # Incremental construction from sorted words: a state is [final, {label: state}]; equal finished states are shared.
    register: dict[tuple, int] = {}
    states: list[tuple[bool, tuple[tuple[int, int], ...]]] = []
    path: list[list] = [[False, []]]

    def close(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if key not in register:
            register[key] = len(states)
            states.append(key)
        return register[key]

    def shorten(depth: int, last: bytes) -> None:
        while len(path) - 1 > depth:
            done = close(path.pop())
            path[-1][1].append((last[len(path) - 1], done))

    last = b""
    for word, _ in words:
        same = next((k for k, (a, b) in enumerate(zip(word, last)) if a != b), min(len(word), len(last)))
        shorten(same, last)
        path.extend([False, []] for _ in word[same:])
        path[-1][0] = True
        last = word
    shorten(0, last)
    root = close(path[0])
    count = [0] * len(states)
    for k, (final, edges) in enumerate(states):  # children come before parents
        count[k] = final + sum(count[t] for _, t in edges)
    # Double array: an edge of state s with label c lies at base[s] + c; it is s's if check there is s.
    size = 512 + sum(len(e) for _, e in states)
    taken, base, top = bytearray(size + 70_000), [0] * len(states), 0
    slots: list[tuple[int, int, int, int]] = []
    low = {1: 0}
    for k in sorted(range(len(states)), key=lambda k: -len(states[k][1])):
        final, edges = states[k]
        if not edges:
            continue
        labels = [c for c, _ in edges]
        at = low.get(min(len(labels), 8), low.get(min(len(labels), 8) + 1, 0))
        tries = 0
        while True:
            at = taken.find(0, max(at, labels[0]))
            b = at - labels[0]
            if len(taken) < b + 300:
                taken.extend(bytes(70_000))
            if at >= 0 and all(not taken[b + c] for c in labels):
                break
            at, tries = at + 1, tries + 1
        low[min(len(labels), 8)] = at if tries < 64 else at - 64
        base[k] = b
        passed = int(final)
        for c, t in edges:
            taken[b + c] = 1
            slots.append((b + c, k, t, passed))
            passed += count[t]
            top = max(top, b + c)
    table = np.full((3, top + 257), -1, "<i4")
    if slots:
        p, s, t, n = np.array(slots).T
        table[0, p], table[1, p], table[2, p] = s, t, n
    ends = np.cumsum([0, *(len(ids) for _, ids in words)]).astype("<i4")
    flat = np.array([i for _, ids in words for i in ids], "<i4")
    parts = [np.array(base, "<i4"), np.array([f for f, _ in states], "<i4"), *table, ends, flat]
    return struct.pack("<9i", root, *(len(x) for x in parts), 0) + b"".join(x.tobytes() for x in parts)


class Lexicon:
    """A memory-mapped automaton file."""

    def __init__(self, blob: bytes):
        fd = os.memfd_create("lexicon")  # in memory: no folder is written to
        try:
            os.truncate(fd, len(blob))
            os.pwrite(fd, blob, 0)
            self.map = mmap.mmap(fd, 0, access=mmap.ACCESS_READ)
        finally:
            os.close(fd)
        self.root, *sizes, _ = struct.unpack_from("<9i", self.map)
        view, at, parts = np.frombuffer(self.map, "<i4"), 9, []
        for n in sizes:
            parts.append(view[at : at + n])
            at += n
        self.base, self.final, self.check, self.target, self.passed, self.ends, self.ids = parts

    def find(self, data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The number of each word, or -1; all words take a step at a time."""
        n = np.diff(ends, prepend=0)
        begin = ends - n
        out, at = np.full(len(n), -1), np.arange(len(n))
        state, number = np.full(len(n), self.root), np.zeros(len(n), np.int64)
        k = 0
        while len(at):
            over = n[at] == k
            if over.any():
                out[at[over]] = np.where(self.final[state[over]] > 0, number[over], -1)
                at, state, number = at[~over], state[~over], number[~over]
            p = self.base[state] + data[begin[at] + k]
            ok = self.check[p] == state
            p, at = p[ok], at[ok]
            state, number = self.target[p], number[ok] + self.passed[p]
            k += 1
        return out

    def get(self, word: str) -> list[int] | None:
        """The ids of one word, if the automaton accepts it."""
        data = np.frombuffer(word.encode(), np.uint8)
        number = int(self.find(data, np.array([len(data)]))[0])
        return None if number < 0 else self.ids[self.ends[number] : self.ends[number + 1]].tolist()


def joined(strings: list[str]) -> pa.Array:
    """Strings with a space after each: what is taken from them lies side by side, ready to be joined."""
    return pa.array([s + " " for s in strings], pa.large_string())


def sliced(strings: pa.Array, ids: np.ndarray) -> tuple[np.ndarray, memoryview]:
    """Where the taken strings begin and end, and their bytes."""
    taken = strings.take(pa.array(ids))
    if not len(taken):
        return np.zeros(1, np.int64), memoryview(b"")
    _, ends, data = taken.buffers()
    return np.frombuffer(ends, np.int64)[: len(taken) + 1], memoryview(data)


def batched(parts: Iterable[str | int]) -> Iterator[list[str | int]]:
    """Parts, about a piece together."""
    held, size = [], 0
    for p in parts:
        held.append(p)
        size += len(p) if isinstance(p, str) else 0
        if size >= PIECE:
            yield held
            held, size = [], 0
    if held:
        yield held


def cut(text: str) -> Iterator[str]:
    """A text in parts of at most a piece, cut after spaces."""
    at = 0
    while len(text) - at > PIECE:
        end = text.rfind(" ", at, at + PIECE) + 1 or text.find(" ", at + PIECE) + 1
        if not end:
            break
        yield text[at:end]
        at = end
    yield text[at:]


class Codec:
    """Encodes pieces of texts, and decodes ids."""

    def __init__(self, rules: Rules, lexicon: Lexicon | None):
        self.rules, self.lexicon = rules, lexicon
        self.number = joined([str(i) for i in range(len(rules.tokens))])
        self.token = joined(rules.tokens)

    def distinct(self, texts: list[str]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """The distinct words of normalised texts, which of them each word is, and the number of words up to each text's end."""
        raw = [t.encode() for t in texts]
        data = np.frombuffer(b"\n".join(raw) + b"\n", np.uint8)
        begins, kept, ends = self.rules.words(data)
        upto = np.searchsorted(begins, np.cumsum([len(r) + 1 for r in raw]))
        offsets = np.zeros(len(ends) + 1, np.int64)
        offsets[1:] = ends
        words = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(kept)]).dictionary_encode()
        return words.dictionary, words.indices.to_numpy(), upto

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words one after the other, and how many each has."""
        if not len(words):
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        _, ends, data = words.buffers()
        ends, data = np.frombuffer(ends, np.int64)[1 : len(words) + 1], np.frombuffer(data, np.uint8)
        found = self.lexicon.find(data, ends) if self.lexicon else np.full(len(words), -1)
        has, rest = np.flatnonzero(found >= 0), np.flatnonzero(found < 0)
        n = np.diff(ends, prepend=0)
        merged, m = self.rules.merge(data[ranges((ends - n)[rest], n[rest])], np.cumsum(n[rest]))
        count = np.zeros(len(words), np.int64)
        count[rest] = m
        if len(has):
            begin = self.lexicon.ends[found[has]].astype(np.int64)
            count[has] = self.lexicon.ends[found[has] + 1] - begin
        out, at = np.zeros(count.sum(), np.int32), np.cumsum(count) - count
        out[ranges(at[rest], m)] = merged
        if len(has):
            out[ranges(at[has], count[has])] = self.lexicon.ids[ranges(begin, count[has])]
        return out, count

    def normal(self, text: str) -> str:
        return text.lower() if text.isascii() or COMMON.fullmatch(text) else self.rules.normalise(text)

    def parts(self, text: str) -> Iterator[str | int]:
        """What is left between special strings, and the ids of these strings."""
        for k, piece in enumerate(self.rules.at_special.split(text) if self.rules.at_special else [text]):
            if k % 2:
                yield self.rules.special[piece]
            else:
                yield from cut(piece)

    def encode_parts(self, parts: list[str | int]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts one after the other, and the number of ids up to each part's end."""
        words, which, upto = self.distinct([self.normal(p) if isinstance(p, str) else "" for p in parts])
        ids, count = self.encode_words(words)
        n = count[which]
        flat = ids[ranges((np.cumsum(count) - count)[which], n)]
        ends = np.append(0, np.cumsum(n))[upto]
        special = np.array([k for k, p in enumerate(parts) if not isinstance(p, str)], np.int64)
        if len(special):
            flat = np.insert(flat, ends[special], [parts[k] for k in special])
            ends = ends + np.searchsorted(special, np.arange(len(parts)), "right")
        return flat, ends

    def documents(self, texts: list[str | None]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(first, ids, ends): the ids of texts from number first on, one after the other, and where each text's end."""
        first, held, lasts, size = 0, [], [], 0
        for k, t in enumerate([*texts, None]):
            long = t and len(t) > PIECE
            if held and (long or size >= PIECE or k == len(texts)):
                ids, ends = self.encode_parts(held)
                yield first, ids, ends[lasts]
                first, held, lasts, size = k, [], [], 0
            if long:
                ids = np.concatenate([self.encode_parts(p)[0] for p in batched(self.parts(t))])
                yield k, ids, np.array([len(ids)])
                first = k + 1
            elif k < len(texts):
                held += self.parts(t or "")
                lasts.append(len(held) - 1)
                size += len(t or "")

    def digests(self, ids: np.ndarray, ends: np.ndarray) -> tuple[list[str], list[str]]:
        """SHA-256 of each text's ids in decimal and of the text decoded from them, both joined by a space."""
        found: tuple[list[str], list[str]] = ([], [])
        for strings, out in zip((self.number, self.token), found):
            k, at, sha = 0, 0, hashlib.sha256()
            for a in range(0, max(1, len(ids)), BLOCK):
                upto = min(a + BLOCK, len(ids))
                cut, data = sliced(strings, ids[a:upto])
                while k < len(ends) and (ends[k] <= upto or at < upto):
                    z = min(int(ends[k]), upto)
                    if z > at:
                        sha.update(data[cut[at - a] : cut[z - a] - (z == ends[k])])  # no space after the last
                    at = z
                    if z < ends[k]:
                        break
                    out.append(sha.hexdigest())
                    k, sha = k + 1, hashlib.sha256()
        return found

    def decode(self, ids: list[int]) -> str:
        """As the library does without a decoder: the tokens with a space between."""
        _, data = sliced(self.token, np.asarray(ids, np.int64))
        return bytes(data[:-1]).decode()


_CODECS: dict = {}


def codec(path: str, blob: bytes | None) -> Codec:
    """This worker's codec for a tokenizer file and lexicon."""
    key = (path, hashlib.sha256(blob or b"").digest())
    if key not in _CODECS:
        _CODECS.clear()
        _CODECS[key] = Codec(Rules(path), Lexicon(blob) if blob else None)
    return _CODECS[key]


def frequent(docs: DataFrame, path: str, most: int = LEXICON_WORDS, text: str = "text") -> list[str]:
    """The most frequent words of all documents, ``most`` at the most: of words with equal counts all or none."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, None)
        for b in lean(batches, 0, PIECE):
            for parts in batched(p for t in b.column(0).to_pylist() for p in cut(t or "")):
                words, which, _ = c.distinct(list(map(c.normal, parts)))
                yield pa.RecordBatch.from_arrays([words.cast(pa.binary()), pa.array(np.bincount(which, minlength=len(words)))], ["word", "n"])

    rows = docs.select(F.col(text).alias("t")).mapInArrow(count, "word binary, n long")
    counts = materialize(fewer(rows.where(F.length("word") <= SIDE_BY_SIDE).groupBy("word").agg(F.sum("n").alias("n")), docs))
    # The least count down to which all words fit the bound; so no more than the bound's rows are ever sent.
    room, least = most, None
    for r in counts.groupBy("n").agg(F.count("*").alias("words")).orderBy(F.desc("n")).limit(most).collect():
        if r["words"] > room:
            break
        room, least = room - r["words"], r["n"]
    return sorted(r["word"].decode() for r in counts.where(F.col("n") >= least).select("word").collect()) if least is not None else []


def build(docs: DataFrame, path: str, most: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """The lexicon of a corpus."""
    words = frequent(docs, path, most, text)
    c = Codec(Rules(path), None)
    ids, n = c.encode_words(pa.array([w.encode() for w in words], pa.large_binary()))
    ends = np.cumsum(n).tolist()
    return compile_lexicon({w: ids[a:z].tolist() for w, a, z in zip(words, [0, *ends], ends)})


def id_lists(ids: np.ndarray, ends: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(0, ends), pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, blob: bytes, doc_id="doc_id", text="text") -> DataFrame:
    """doc_id and ids of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(blob)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, shared.value)
        for b in lean(batches, 1, PIECE):
            for first, ids, ends in c.documents(b.column(1).to_pylist()):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(ends)), id_lists(ids, ends)], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of every row of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, None)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.decode(i or []) for i in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def roundtrip(docs: DataFrame, path: str, blob: bytes, doc_id="doc_id", text="text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and the ids if asked for: encode, then decode the ids."""
    shared = docs.sparkSession.sparkContext.broadcast(blob)
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path, shared.value)
        for b in lean(batches, 1, PIECE):
            for first, ids, ends in c.documents(b.column(1).to_pylist()):
                out = [b.column(0).slice(first, len(ends)), pa.array(np.diff(ends, prepend=0)), *map(pa.array, c.digests(ids, ends))]
                yield pa.RecordBatch.from_arrays(out + [id_lists(ids, ends)] * with_ids, names)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("t")).mapInArrow(run, schema)
