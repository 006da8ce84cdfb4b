"""Word shingles as 64-bit hashes, and sets of them compared exactly."""

from __future__ import annotations

import numpy as np
import xxhash

_A, _B, _C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB))
_S1, _S2, _S3 = (np.uint64(x) for x in (30, 27, 31))


def mixed(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit numbers that looks random, another one for each seed."""
    x = x + np.uint64((seed * 0x9E3779B97F4A7C15 + 0x1234567) & (2**64 - 1))
    x = (x ^ (x >> _S1)) * _B
    x = (x ^ (x >> _S2)) * _C
    return x ^ (x >> _S3)


def words_of(text: str | bytes | None) -> list[bytes]:
    """A-Z lower-cased; split at ASCII white space."""
    return (text.encode() if isinstance(text, str) else text or b"").lower().split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """All k-word shingles in order; fewer words are one shingle of their own kind, none are none."""
    n = len(hashes)
    if n == 0:
        return hashes
    width = min(n, k)
    out = np.full(n - width + 1, np.uint64(width))
    for i in range(width):
        out = mixed(out * _A + hashes[i : n - width + 1 + i])
    return out


def shingle_set(text: str | bytes | None, k: int) -> np.ndarray:
    """Distinct shingles, sorted."""
    return np.unique(shingles(word_hashes(words_of(text)), k))


def set_id(values: np.ndarray) -> tuple[int, int]:
    """128 bits that tell a sorted set, as two signed numbers. The first alone names sets among candidates, which are few."""
    x = xxhash.xxh3_128_intdigest(values.tobytes())
    return (x & (2**64 - 1)) - (x & 2**63) * 2, (x >> 64) - (x >> 127 << 64)


def shared_counts(left: list[np.ndarray], right: list[np.ndarray] | None, columns: int = 4096) -> np.ndarray:
    """How many values each two sorted sets share; without right, of left with itself. Counted by products of 0/1 matrices,
    some columns at a time; values of one set don't count."""
    both = left if right is None else left + right
    n = len(left)
    shared = np.zeros((n, len(both) if right is None else len(right)), np.float32)
    sizes = np.array([len(s) for s in both], np.int64)
    if not sizes.sum():
        return shared.astype(np.int64)
    owner = np.repeat(np.arange(len(both)), sizes)
    values = np.concatenate(both)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    number = np.cumsum(np.append(True, values[1:] != values[:-1])) - 1
    often = np.bincount(number) > 1
    keep = often[number]
    column = (np.cumsum(often) - 1)[number[keep]]
    owner = owner[keep]
    for c in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        a, b = np.searchsorted(column, [c, c + columns])
        m = np.zeros((len(both), columns), np.float32)
        m[owner[a:b], column[a:b] - c] = 1
        shared += m[:n] @ (m if right is None else m[n:]).T
    return shared.astype(np.int64)


def linked_pairs(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int, columns: int = 4096, may: np.ndarray | bool = True) -> list[tuple[int, int]]:
    """(i, j) of sorted sets with 100 * intersection >= percent * union, of those that may be; without right, of left with itself, i < j."""
    shared = shared_counts(left, right, columns)
    own = np.array([len(s) for s in left], np.int64)
    other = own if right is None else np.array([len(s) for s in right], np.int64)
    union = own[:, None] + other[None] - shared
    i, j = np.nonzero((100 * shared >= percent * union) & (own[:, None] > 0) & (other[None] > 0) & may)
    return [(a, b) for a, b in zip(i.tolist(), j.tolist()) if right is not None or a < b]


def forest(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """As few of the pairs as connect the same."""
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    out = []
    for a, b in pairs:
        x, y = root(a), root(b)
        if x != y:
            parent[max(x, y)] = min(x, y)
            out.append((a, b))
    return out
