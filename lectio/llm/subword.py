"""Hashed subword features: words, their character n-grams, and vocabularies of them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of words whose features are made at a time, and of a single word's part.
PART = 100_000


def mix(x: np.ndarray) -> np.ndarray:
    x = x * _MIX
    return x ^ (x >> np.uint64(29))


def bucket(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((h >> np.uint64(20)) % np.uint64(buckets)).astype(np.int32)


def word_bytes(word: str) -> bytes:
    """A word between two boundary bytes."""
    return b"\x02" + word.encode("utf8", "surrogatepass") + b"\x03"


def gram_hashes(data: np.ndarray, room: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the byte n-grams of words laid end to end, and their places; room: bytes to the word's end."""
    at = np.flatnonzero(room >= n)
    h = np.full(len(at), n, np.uint64)
    for k in range(n):
        h = mix(h + data[at + k])
    return h, at


def features(words: list[str], buckets: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """64-bit hashes of the whole words, buckets of their n-grams, and the word number of each n-gram (ascending)."""
    if not words:
        return np.empty(0, np.uint64), np.empty(0, np.int32), np.empty(0, np.int32)
    raw = [word_bytes(w) for w in words]
    length = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    owner = np.repeat(np.arange(len(raw), dtype=np.int32), length)
    start = np.cumsum(length) - length
    place = np.arange(len(data)) - start[owner]
    room = length[owner] - place
    whole = mix(np.add.reduceat(mix(mix(data + np.uint64(257)) + place.astype(np.uint64)), start) + np.uint64(1))
    found, owners = [], []
    for n in grams:
        h, at = gram_hashes(data, room, n)
        found.append(bucket(h, buckets))
        owners.append(owner[at])
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return whole, found[order], owners[order]


def long_features(word: str, buckets: int, grams: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """features() of one long word, a bounded part at a time; its n-grams come in another order."""
    raw, total, found = word_bytes(word), np.zeros(1, np.uint64), []
    for at in range(0, len(raw), PART):
        data = np.frombuffer(raw[at : at + PART + max(grams) - 1], np.uint8).astype(np.uint64)
        own = data[:PART]
        total += mix(mix(own + np.uint64(257)) + np.arange(at, at + len(own), dtype=np.uint64)).sum(dtype=np.uint64)
        for n in grams:
            h, place = gram_hashes(data, len(data) - np.arange(len(data)), n)
            found.append(bucket(h[place < PART], buckets))
    found = np.concatenate(found)
    return mix(total + np.uint64(1)), found, np.zeros(len(found), np.int32)


def sum_by(owner: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Row sums of `values` by owner, without a slow scattered add."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(owner):
        if (owner[1:] < owner[:-1]).any():
            order = np.argsort(owner, kind="stable")
            owner, values = owner[order], values[order]
        first = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
        out[owner[first]] = np.add.reduceat(values, first, axis=0)
    return out


def scattered(rows: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows of a table of n that occur, and the sums of their values."""
    used = np.flatnonzero(np.bincount(rows, minlength=n))
    return used, np.stack([np.bincount(rows, column, n)[used] for column in np.ascontiguousarray(values.T)], axis=1).astype(np.float32)


class Vocabulary:
    """Numbers of words, and their features, made once for each word, a bounded part at a time."""

    def __init__(self, buckets: int, grams: tuple[int, ...]):
        self.buckets, self.grams = buckets, grams
        self.known: dict[str, int] = {}
        self.hashes = np.empty(0, np.uint64)
        self.found = np.empty(0, np.int32)
        self.first = np.zeros(1, np.int64)

    def __len__(self) -> int:
        return len(self.known)

    def unknown(self, split: list[list[str]]) -> set[str]:
        return {w for words in split for w in words if w not in self.known}

    def add(self, words: list[str]) -> np.ndarray:
        known = self.known
        return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int32, len(words))

    def parts(self, begin: int) -> Iterator[np.ndarray]:
        """Numbers of the words from `begin` on, in parts of about PART bytes."""
        self._make()
        size = self.first[begin + 1 :] - self.first[begin]
        at, ends = 0, []
        while at < len(size):
            base = size[at - 1] if at else 0
            at = max(at + 1, int(np.searchsorted(size, base + PART * len(self.grams), side="right")))
            ends.append(at)
        for a, b in zip([0, *ends], ends, strict=False):
            yield np.arange(begin + a, begin + b)

    def _make(self) -> None:
        have = len(self.hashes)
        if have == len(self.known):
            return
        fresh = list(islice(self.known, have, None))
        hashes, found, sizes = [self.hashes], [self.found], []
        at = 0
        while at < len(fresh):
            to, chars = at, 0
            while to < len(fresh) and (to == at or chars + len(fresh[to]) <= PART):
                chars += len(fresh[to])
                to += 1
            h, f, own = long_features(fresh[at], self.buckets, self.grams) if chars > PART else features(
                fresh[at:to], self.buckets, self.grams
            )
            hashes.append(h)
            found.append(f)
            sizes.append(np.bincount(own, minlength=to - at))
            at = to
        self.hashes, self.found = np.concatenate(hashes), np.concatenate(found)
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(np.concatenate(sizes))])

    def features(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whole-word buckets of words, buckets of their n-grams and each n-gram's place in `ids`."""
        self._make()
        size = self.first[ids + 1] - self.first[ids]
        owner = np.repeat(np.arange(len(ids), dtype=np.int32), size)
        at = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + np.repeat(self.first[ids], size)
        return bucket(self.hashes[ids], self.buckets), self.found[at], owner
