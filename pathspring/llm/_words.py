"""Words and fingerprints of Arrow text columns, by NumPy on the UTF-8 bytes.

A text column is read through its Arrow buffers, a slice of about ``SLICE``
bytes at a time, so memory does not grow with a task's rows. A slice's distinct
words are found by their bytes, and each has a digest of 128 bits that no other
known word has (see ``digests``).
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa

SLICE = 1 << 19

SPACE = bytes([0x20, *range(0x09, 0x0E)])
"""The delimiters of words ``[^\\x20\\x09-\\x0D]+``."""

NOT_ALNUM = bytes([*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)])
"""The delimiters of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` before A-Z are lower-cased."""

U64 = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (SplitMix64)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def digests(words: pa.LargeBinaryArray) -> np.ndarray:
    """128 bits (n x 2) for each word.

    Words under 16 bytes are their own 16 bytes (filled up with zeros and the length),
    put through a Feistel network of four rounds, which is a bijection: different short
    words never have equal digests. Longer words have BLAKE2b digests.
    """
    n = len(words)
    _, offsets, data = words.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[words.offset : words.offset + n + 1] if n else np.zeros(1, dtype=np.int64)
    data = np.concatenate([np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8), np.zeros(16, np.uint8)])
    size = np.diff(at)
    cell = np.arange(16)
    block = np.where(cell < size[:, None], data[np.minimum(at[:-1, None] + cell, len(data) - 1)], 0).astype(np.uint8)
    block[:, 15] = np.minimum(size, 255)
    left, right = block.view(U64).T.copy() if n else np.zeros((2, 0), dtype=U64)
    for key in (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0, 0x082EFA98EC4E6C89):
        left, right = right, left ^ mix(right + U64(key))
    out = np.stack([left, right], axis=1)
    for i in np.flatnonzero(size > 15).tolist():
        out[i] = np.frombuffer(hashlib.blake2b(words[i].as_py(), digest_size=16).digest(), dtype=U64)
    return out


class Alphabet:
    """Which bytes are in words, and what they become there."""

    def __init__(self, delimiters: bytes, lower: bool):
        self.inside = np.ones(256, dtype=bool)
        self.inside[list(delimiters)] = False
        self.table = np.arange(256, dtype=np.uint8)
        if lower:
            self.table[0x41:0x5B] += 0x20


SPACED = Alphabet(SPACE, lower=False)
SPACED_LOWER = Alphabet(SPACE, lower=True)
ALNUM_LOWER = Alphabet(NOT_ALNUM, lower=True)


class Words:
    """The words of a slice of texts (null: none).

    ptr: the first word of each text, and the number of all words at its end;
    start, end: byte ranges in the texts; number: of each word among the slice's
    distinct words, by their bytes; hash, other: the two halves of their digests.
    """

    def __init__(self, texts: pa.Array, alphabet: Alphabet):
        data, offsets = text_bytes(texts)
        n = len(data)
        inside = alphabet.inside[data]
        first, last = inside.copy(), inside.copy()
        first[1:] &= ~inside[:-1]
        last[:-1] &= ~inside[1:]
        begins, ends = offsets[:-1], offsets[1:]
        begins, ends = begins[begins < n], ends[ends > 0] - 1
        first[begins], last[ends] = inside[begins], inside[ends]
        self.start, self.end = np.flatnonzero(first), np.flatnonzero(last) + 1
        self.ptr = np.searchsorted(self.start, offsets)
        at = np.concatenate([np.zeros(1, dtype=np.int64), np.cumsum(self.end - self.start)])
        letters = alphabet.table[data[inside]]
        words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(self.start), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
        self.number = words.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self._distinct = words.dictionary

    @functools.cached_property
    def _digests(self) -> np.ndarray:
        return digests(self._distinct)

    @functools.cached_property
    def hash(self) -> np.ndarray:
        return self._digests[self.number, 0]

    @functools.cached_property
    def other(self) -> np.ndarray:
        return self._digests[self.number, 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.ptr)

    def doc(self) -> np.ndarray:
        """The text's index for each word."""
        return np.repeat(np.arange(len(self.ptr) - 1), self.counts)

    def stop(self) -> np.ndarray:
        """For each word the index after its text's last word."""
        return np.repeat(self.ptr[1:], self.counts)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts, end to end, and each text's offsets."""
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, dtype=np.int64)
    data = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, dtype=np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def grams(hashes: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Fingerprints of k neighbours from each position on, mixed anew with each of them; the last k - 1 have none."""
    n = max(0, len(hashes) - k + 1)
    total = np.full(n, (seed * 0x9E3779B97F4A7C15 + k) % (1 << 64), dtype=U64)
    for j in range(k):
        total = mix(total * U64(0xD6E8FEB86659FD93) + hashes[j : n + j])
    return total


def ranges(hashes: np.ndarray, start: np.ndarray, count: np.ndarray, seed: int = 0) -> np.ndarray:
    """Fingerprints of count neighbours from each start on, of any counts, mixed as in grams()."""
    total = np.full(len(start), (seed * 0x9E3779B97F4A7C15) % (1 << 64), dtype=U64) + count.astype(U64)
    order = np.argsort(-count, kind="stable")
    for j in range(int(count.max(initial=0))):
        going = order[: np.searchsorted(-count[order], -j)]
        total[going] = mix(total[going] * U64(0xD6E8FEB86659FD93) + hashes[start[going] + j])
    return total


def sequences(w: Words, k: int) -> np.ndarray:
    """A number for the k words from each position on: equal numbers are equal words, without any hashing. The last k - 1 have none."""
    n = max(0, len(w.number) - k + 1)
    total = w.number[:n]
    for j in range(1, k):
        step = int(w.number.max(initial=0)) + 1
        total = np.unique(total * step + w.number[j : n + j], return_inverse=True)[1].reshape(-1).astype(np.int64)
    return total


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE):
    """The batch's rows in runs of at most limit bytes of text, or one row each."""
    texts = batch.column(column)
    _, offsets = text_bytes(texts)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1)
        yield batch.slice(at, to - at)
        at = to
