"""Vectorised word spans and word hashes over Arrow string arrays.

Every function here works on one bounded chunk of rows inside a Spark task; Spark deals out the rows.
Words are byte runs of the UTF-8 text, so a word class is a table of 256 booleans: all bytes of
multi-byte characters belong to one class in each definition used here.

A word's hash is a pair of 64-bit numbers. Up to 16 bytes the pair is a keyed permutation of the bytes (a Feistel
network, the word's length is the key), so different words of one length never share a pair; longer words have
a BLAKE2b digest of 128 bits. A run of words has two hashes too: one over the first numbers, one over the second.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that one pass of array operations covers; one longer text makes a chunk of its own.
CHUNK_BYTES = 1 << 20

_U = np.uint64
_ROOT = 0x9E3779B97F4A7C15 | 1


def _table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[np.frombuffer(members, np.uint8)] = True
    return table


SPACES = b"\x20\x09\x0a\x0b\x0c\x0d"
#: `[^\x20\x09-\x0D]+`
NON_SPACE = ~_table(SPACES)
#: `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`, after A-Z became a-z
ALNUM = _table(bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100)))
IDENTITY = np.arange(256, dtype=np.uint8)
LOWER_AZ = IDENTITY.copy()
LOWER_AZ[65:91] += 32

def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (bijective), applied to each element."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


@dataclass
class Words:
    """Words of several texts: `start`/`end` are byte places in `data`; text i owns words `first[i]:first[i+1]`;
    `hash` and `hash2` are the two halves of the words' hashes."""

    data: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    hash: np.ndarray
    hash2: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


    def take(self, keep: np.ndarray) -> Words:
        """The words of the texts that `keep` marks, as if only these had been given."""
        lengths, mine = np.diff(self.offsets), keep[self.doc]
        gone = np.cumsum(np.where(keep, 0, lengths))[self.doc[mine]]
        first = np.concatenate([[0], np.cumsum(self.counts[keep])])
        offsets = np.concatenate([[0], np.cumsum(lengths[keep])])
        return Words(self.data[np.repeat(keep, lengths)], offsets, self.start[mine] - gone, self.end[mine] - gone, self.hash[mine], self.hash2[mine], first)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and their n+1 offsets; a null is an empty text."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    buffers = texts.buffers()
    offsets = np.frombuffer(buffers[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None and buffers[2].size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


_LANE = 8
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(_LANE + 1)], _U)
_KEYS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The two hashes of each word data[start:end]."""
    padded = np.zeros(len(data) + 2 * _LANE, np.uint8)
    padded[: len(data)] = data
    lanes = np.ndarray((len(data) + _LANE + 1,), "<u8", padded, strides=(1,))
    size = end - start
    one = lanes[start] & _MASKS[np.minimum(size, _LANE)]
    two = lanes[start + np.minimum(size, _LANE)] & _MASKS[np.clip(size - _LANE, 0, _LANE)]
    with np.errstate(over="ignore"):
        length = size.astype(_U)
        for k, key in enumerate(_KEYS):
            if k % 2:
                two = two ^ mix(one + length * _U(key))
            else:
                one = one ^ mix(two + length * _U(key) + _U(key))
    for i in np.flatnonzero(size > 2 * _LANE):
        one[i], two[i] = np.frombuffer(hashlib.blake2b(data[start[i] : end[i]], digest_size=16).digest(), "<u8")
    return one, two


def find_words(texts: pa.Array, member: np.ndarray = NON_SPACE, fold: np.ndarray = IDENTITY) -> Words:
    """All words of the texts. `fold` maps each byte before `member` is asked and before hashing."""
    data, offsets = text_bytes(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(0, _U), np.zeros(0, _U), np.zeros(len(offsets), np.int64))
    folded = data if fold is IDENTITY else fold[data]
    inside = member[folded]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    edge = offsets[:-1][offsets[:-1] < n]
    begins[edge] = inside[edge]
    edge = offsets[1:][offsets[1:] > 0] - 1
    ends[edge] = inside[edge]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    one, two = word_hashes(folded, start, end)
    return Words(data, offsets, start, end, one, two, np.searchsorted(start, offsets))


def chunks(texts: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int]]:
    """Row ranges of at most `limit` bytes of text (one longer text alone)."""
    _, offsets = text_bytes(texts)
    limit = limit or CHUNK_BYTES
    at, n = 0, len(offsets) - 1
    while at < n:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        to = min(to, n)
        yield at, to
        at = to


def _runs(hashes: np.ndarray, at: np.ndarray | slice, n: int, size: int, second: bool) -> np.ndarray:
    total = np.zeros(n, _U)
    with np.errstate(over="ignore"):
        for k in range(size):
            part = hashes[at.start + k : at.stop + k] if isinstance(at, slice) else hashes[at + k]
            total += part * _U(pow(_ROOT + 2 * second, 2 * k + 3, 1 << 64) | 1)
        return mix(total + _U((size + 97 * second) * 0x5851F42D4C957F2D % (1 << 64)))


def runs_at(words: Words, at: np.ndarray, size: int, second: bool = False) -> np.ndarray:
    """First or second hashes of the runs of `size` words that begin at `at`."""
    return _runs(words.hash2 if second else words.hash, at, len(at), size, second)


def windows(words: Words, size: int, second: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first word and first or second hashes of all runs of `size` words inside one text."""
    n = len(words.hash) - size + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, _U)
    total = _runs(words.hash2 if second else words.hash, slice(0, n), n, size, second)
    doc = words.doc
    at = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return at, total[at]


def covered(starts: np.ndarray, size: int | np.ndarray, n: int) -> np.ndarray:
    """Marks of the n words that lie in [start, start + size) of any start."""
    delta = np.zeros(n + 1, np.int64)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + size, -1)
    return np.cumsum(delta[:-1]) > 0


def per_text(marks: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Sums of `marks` over each text's words."""
    sums = np.concatenate([[0], np.cumsum(marks, dtype=np.int64)])
    return sums[first[1:]] - sums[first[:-1]]
