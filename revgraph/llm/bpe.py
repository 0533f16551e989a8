r"""Byte-level BPE encoding by a segment tree, for whole batches of words at once.

A word is a row of symbols, one per byte at first. A complete binary tree over the positions of each row holds
the least pair rank below a node; the leaf at position i holds the rank of the pair that begins there. Going down from
the root, to the left on ties, gives the leftmost least pair. A merge changes the leaves of three positions at most
(the merged one, its live left neighbour, the swallowed one), each by a walk of logarithmic length to the root. The rows of one
width take their steps together as numpy columns; a row leaves when its root has no pair.

Texts are cut at white space first (`chunks`), which the public pattern respects, so that a chunk's ids don't depend on
what stands around it and can be remembered. The memory is bounded (`limit` entries) and only saves work.
"""

from __future__ import annotations

import base64
import functools
import re
import string
from collections.abc import Iterable
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from revgraph.llm.common import WHITE_SPACE

#: Cuts a text so that only what lies between the cuts needs the full pattern.
COARSE = re.compile(rf" ?[^{WHITE_SPACE}]+|[{WHITE_SPACE}]+(?![^{WHITE_SPACE}])|[{WHITE_SPACE}]+")
#: What Arrow's cutting doesn't serve: an empty text, a zero, other white space than space and line end, two of these together, or one at either end.
IRREGULAR = rf"^$|[\x00{WHITE_SPACE.replace(chr(9) + '-' + chr(13) + ' ', chr(9) + chr(11) + '-' + chr(13))}]|[ \n][ \n]|^[ \n]|[ \n]$"
#: A run of these after letters, up to white space, is a match of its own.
MARKS = string.punctuation
NONE = np.int32(1 << 30)


def spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each row, as many as its count."""
    return np.arange(count.sum()) + np.repeat(first - (np.cumsum(count) - count), count)


class Ranks:
    """Ranks of a vocabulary, and of each pair of its entries whose concatenation is an entry."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            self.ids = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
        self.bytes = [b""] * (max(self.ids.values()) + 1)
        for key, rank in self.ids.items():
            self.bytes[rank] = key
        pairs = sorted(
            (self.ids[key[:i]] << 32 | self.ids[key[i:]], rank)
            for key, rank in self.ids.items()
            for i in range(1, len(key))
            if key[:i] in self.ids and key[i:] in self.ids
        )
        #: A hash table with linear probing, a quarter full at most.
        self.bits = (4 * len(pairs) + 1).bit_length()
        self.keys, self.ranks = np.full(1 << self.bits, -1), np.full(1 << self.bits, NONE)
        key, rank = np.array([p for p, _ in pairs], np.int64), np.array([r for _, r in pairs], np.int32)
        at = self.slot(key)
        while len(key):
            free = self.keys[at] < 0
            self.keys[at[free]] = key[free]
            here = self.keys[at] == key
            self.ranks[at[here]] = rank[here]
            key, rank, at = key[~here], rank[~here], at[~here] + 1 & len(self.keys) - 1
        self.single = np.array([self.ids[bytes([b])] for b in range(256)], np.int64)
        #: Ranks of all pairs of single bytes, with which every word begins.
        self.first = self.pair(np.repeat(self.single, 256), np.tile(self.single, 256))

    def slot(self, key: np.ndarray) -> np.ndarray:
        return (key.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def pair(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = self.slot(key)
        held = self.keys[at]
        out = np.where(held == key, self.ranks[at], NONE)
        on = np.nonzero((held != key) & (held >= 0))[0]
        while len(on):
            at[on] = at[on] + 1 & len(self.keys) - 1
            held = self.keys[at[on]]
            same = on[held == key[on]]
            out[same] = self.ranks[at[same]]
            on = on[(held != key[on]) & (held >= 0)]
        return out


@functools.cache
def ranks(path: str) -> Ranks:
    return Ranks(path)


def merge_rows(words: list[bytes], width: int, r: Ranks) -> list[bytes]:
    """Ids of words of at most `width` (a power of two) bytes each, as little-endian unsigned 32-bit numbers."""
    n, w2, levels = len(words), 2 * width, width.bit_length() - 1
    length = np.fromiter(map(len, words), np.int64, n)
    joined = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(length) - length
    cell = np.arange(len(joined)) + np.repeat(np.arange(n) * width - start, length)
    symbol = np.zeros(n * width + 1, np.int64)
    symbol[cell] = r.single[joined]
    live = np.zeros(n * width + 1, bool)
    live[cell] = True
    place = np.arange(n * width, dtype=np.int64)
    before = np.where(place % width == 0, -1, place - 1)
    after = np.append(place + 1, -1)
    after[np.arange(n) * width + length - 1] = -1
    tree = np.full(n * w2 + 1, NONE, np.int32)
    has = np.nonzero(after[cell] >= 0)[0]
    both = cell[has]
    tree[both // width * w2 + width + both % width] = r.first[joined[has].astype(np.int64) << 8 | joined[has + 1]]
    grid = tree[:-1].reshape(n, w2)
    at = width
    while at > 1:
        grid[:, at // 2 : at] = np.minimum(grid[:, at : 2 * at : 2], grid[:, at + 1 : 2 * at : 2])
        at //= 2
    rows = np.nonzero(grid[:, 1] < NONE)[0]
    base = rows * w2
    while len(rows):
        node = np.ones(len(rows), np.int64)
        for _ in range(levels):
            node <<= 1
            left = base + node
            node += tree[left] > tree[left + 1]
        here = rows * width + node - width
        gone = after[here]
        symbol[here] = tree[base + 1]
        live[gone] = False
        then = after[gone]
        after[here] = then
        inner = np.nonzero(then >= 0)[0]
        before[then[inner]] = here[inner]
        prior = before[here]
        has = np.nonzero(prior >= 0)[0]
        # Leaves that change: the merged pair's, the swallowed symbol's, the left neighbour's.
        rank = r.pair(symbol[np.concatenate((here[inner], prior[has]))], symbol[np.concatenate((then[inner], here[has]))])
        tree[base + node] = NONE
        tree[base[inner] + node[inner]] = rank[: len(inner)]
        lost = gone % width + width
        tree[base + lost] = NONE
        back = prior[has] % width + width
        tree[base[has] + back] = rank[len(inner) :]
        top = np.concatenate((base, base, base[has]))
        child = np.concatenate((node, lost, back))
        for _ in range(levels):
            child >>= 1
            left = top + 2 * child
            tree[top + child] = np.minimum(tree[left], tree[left + 1])
        keep = np.nonzero(tree[base + 1] < NONE)[0]
        rows, base = rows[keep], base[keep]
    flat = symbol[live].astype("<u4").tobytes()
    ends = (np.cumsum(np.add.reduceat(live[:-1], np.arange(n) * width, dtype=np.int64)) * 4).tolist()
    return [flat[a:b] for a, b in zip([0, *ends], ends)]


def encode_raw(raws: list[bytes], r: Ranks, cells: int = 1 << 16) -> list[bytes]:
    """Ids (little-endian unsigned 32-bit) of each word; rows of a width go through the tree in blocks of `cells` cells."""
    out = [None if k is None else k.to_bytes(4, "little") for k in map(r.ids.get, raws)]
    rows = np.array([i for i, known in enumerate(out) if known is None], np.int64)
    power = np.frexp(np.fromiter(map(len, raws), np.int64, len(raws))[rows] - 1)[1]
    for p in np.unique(power).tolist():
        group, step = rows[power == p].tolist(), max(1, cells >> p)
        for k in range(0, len(group), step):
            part = group[k : k + step]
            for i, ids in zip(part, merge_rows([raws[i] for i in part], 1 << p, r), strict=True):
                out[i] = ids
    return out


def encode_words(words: Iterable[str], r: Ranks) -> dict[str, bytes]:
    """Ids of each word."""
    words = list(words)
    return dict(zip(words, encode_raw([x.encode() for x in words], r), strict=True))


class Memory:
    """Chunks and their ids, one after another in `flat`, as many as `count` says."""

    def __init__(self) -> None:
        self.chunks, self.count, self.flat = pa.array([], pa.large_string()), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def __len__(self) -> int:
        return len(self.chunks)

    def find(self, chunks: pa.Array) -> np.ndarray:
        """The place of each chunk, -1 if it isn't here."""
        return pc.index_in(chunks, value_set=self.chunks).fill_null(-1).to_numpy()

    def ids(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First place in `flat` and count of the ids of chunks."""
        return (np.cumsum(self.count) - self.count)[at], self.count[at]

    def add(self, chunks: pa.Array, count: np.ndarray, flat: np.ndarray) -> None:
        self.chunks = pa.concat_arrays([self.chunks, chunks])
        self.count, self.flat = np.concatenate((self.count, count)), np.concatenate((self.flat, flat))


def listed(values: pa.Array) -> list:
    return values.to_numpy(zero_copy_only=False).tolist()


def joined(ids: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Count and ids, one after another."""
    return np.fromiter(map(len, ids), np.int64, len(ids)) // 4, np.frombuffer(b"".join(ids), "<u4")


class Encoder:
    """Ids of texts, as bytes of little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str, pattern: str, limit: int = 200_000):
        self.r, self.split, self.limit = ranks(path), regex.compile(pattern).findall, limit
        #: By chunk, as chunks() gives them.
        self.known = Memory()
        #: What was known before; what occurs again is taken over.
        self.before = Memory()

    @staticmethod
    def chunks(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        r"""Chunks of all texts, one after another, and how many each text has. They are written with their white space in a short form: a chunk after one space stands
        without it, any other with a leading \0.

        Where white space is only single spaces and line ends between words, Arrow does the cutting.
        """
        rows = pa.array(texts, pa.large_string())
        odd = pc.match_substring_regex(rows, IRREGULAR).to_numpy(zero_copy_only=False)
        zero, nothing = (pa.scalar(x, pa.large_string()) for x in ("\0", ""))
        plain = pc.binary_join_element_wise(zero, rows.filter(pa.array(~odd)), nothing)
        plain = pc.split_pattern(pc.replace_substring(plain, "\n", " \n"), " ")
        count = np.zeros(len(texts), np.int64)
        count[~odd] = pc.list_value_length(plain).to_numpy()
        if not odd.any():
            return plain.flatten(), count
        cut = [COARSE.findall(texts[i]) for i in np.nonzero(odd)[0]]
        count[odd] = [len(x) for x in cut]
        both = pa.concat_arrays([plain.flatten(), pa.array(["\0" + x for row in cut for x in row], pa.large_string())])
        # Back to the order of the texts.
        first = np.zeros(len(texts), np.int64)
        order = np.concatenate((np.nonzero(~odd)[0], np.nonzero(odd)[0]))
        first[order] = np.cumsum(count[order]) - count[order]
        return both.take(pa.array(spread(first, count))), count

    def unknown(self, chunks: pa.Array) -> pa.Array:
        """Those of different chunks that aren't remembered; what was known before is taken over."""
        new = chunks.filter(pa.array(self.known.find(chunks) < 0))
        at = self.before.find(new)
        first, count = self.before.ids(at[at >= 0])
        self.known.add(new.filter(pa.array(at >= 0)), count, self.before.flat[spread(first, count)])
        return new.filter(pa.array(at < 0))

    def learn(self, chunks: pa.Array) -> None:
        """Adds different chunks to what is known."""
        if len(self.known) > self.limit // 2:
            self.known, self.before = Memory(), self.known
        new = self.unknown(chunks)
        # Letters alone, or before marks, need no search.
        stems = pc.utf8_rtrim(new, MARKS)
        plain = pc.utf8_is_alpha(stems)
        words = self.unknown(stems.filter(plain).unique())
        self.known.add(words, *joined(encode_raw([b" " + x for x in listed(words.cast(pa.large_binary()))], self.r)))
        size = (pc.binary_length(new).to_numpy() - pc.binary_length(stems).to_numpy()) * plain.to_numpy(zero_copy_only=False)
        marked = pa.array(size > 0)
        both = new.filter(marked)
        tails = [x[-n:] for x, n in zip(listed(both.cast(pa.large_binary())), size[size > 0].tolist(), strict=True)]
        place = {x: i for i, x in enumerate(dict.fromkeys(tails))}
        n, flat = joined(encode_raw(list(place), self.r))
        of = np.fromiter(map(place.__getitem__, tails), np.int64, len(tails))
        first, count = self.known.ids(self.known.find(stems.filter(marked)))
        pairs = np.stack((first, len(self.known.flat) + (np.cumsum(n) - n)[of]), 1).ravel()
        flat = np.concatenate((self.known.flat, flat))[spread(pairs, np.stack((count, n[of]), 1).ravel())]
        self.known.add(both, count + n[of], flat)
        other = new.filter(pc.invert(plain))
        cut = [self.split(x[1:] if x[0] == "\0" else x if x[0] == "\n" else " " + x) for x in listed(other)]
        get = encode_words({x for pieces in cut for x in pieces}, self.r).__getitem__
        self.known.add(other, *joined([b"".join(map(get, pieces)) for pieces in cut]))

    def encode(self, texts: list[str], step: int = 1 << 22, part: int = 1 << 17) -> Iterable[bytes]:
        """In slices of about `step` characters, which share what they learn, and the ids of about `part` chunks at a time, for bounded memory."""
        at = 0
        while at < len(texts):
            size, end = 0, at
            while end < len(texts) and (size == 0 or size + len(texts[end]) <= step):
                size += len(texts[end]) or 1
                end += 1
            chunks, count = self.chunks(texts[at:end])
            coded = chunks.dictionary_encode()
            self.learn(coded.dictionary)
            first, length = self.known.ids(self.known.find(coded.dictionary))
            flat, of = self.known.flat, coded.indices.to_numpy()
            text = np.concatenate(([0], np.cumsum(count)))
            while at < end:
                k = at - end + len(count)
                until = max(k + 1, int(np.searchsorted(text, text[k] + part, "right")) - 1)
                here = of[text[k] : text[until]]
                n = length[here]
                out = flat[spread(first[here], n)].tobytes()
                ends = 4 * np.concatenate(([0], np.cumsum(n)))[text[k : until + 1] - text[k]]
                yield from (out[a:b] for a, b in pairwise(ends.tolist()))
                at += until - k

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.r.bytes.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@functools.lru_cache(maxsize=2)
def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker."""
    return Encoder(path, pattern)
