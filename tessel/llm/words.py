"""Words of whole text batches as 64-bit hashes, computed over the flat UTF-8 bytes.

Separators are ASCII, so bytes are enough to split. A word's hash is a polynomial of
random byte values modulo 2^64, mixed; equal words of all batches and machines agree.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Words `[^\x20\x09-\x0D]+`.
SPACED = np.ones(256, bool)
SPACED[[32, 9, 10, 11, 12, 13]] = False
#: Words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` of lower-cased bytes.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
_BASE = int(_rng.integers(1, 2**62)) * 2 + 1
_MUL = _rng.integers(1, 2**63, 64, dtype=np.uint64) * U(2) + U(1)
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers in which every bit depends on all."""
    x = x ^ (x >> U(33))
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def _power(kind: str, n: int) -> np.ndarray:
    if len(_powers[kind]) < n:
        base = _BASE if kind == "up" else pow(_BASE, -1, 1 << 64)
        steps = np.full(1 << (n - 1).bit_length(), base & (2**64 - 1), U)
        steps[0] = 1
        _powers[kind] = np.cumprod(steps, dtype=U)
    return _powers[kind][:n]


def words(flat: np.ndarray, offs: np.ndarray, letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each row where its words begin (one more than rows)."""
    n = len(flat)
    if not n:
        return np.zeros(0, U), np.zeros(len(offs), np.int64)
    low = LOWER[flat]
    inside = letters[low]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | edge[1:-1]
    starts = np.flatnonzero(begins)
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | edge[1:-1]
    ends = np.flatnonzero(ends) + 1
    total = np.zeros(n + 1, U)
    np.cumsum(_BYTE[low] * _power("up", n), out=total[1:])
    hashed = mix((total[ends] - total[starts]) * _power("down", n)[starts])
    return hashed, np.searchsorted(starts, offs)


def rows_of(begin: np.ndarray) -> np.ndarray:
    """The row number of each item, from where each row's items begin."""
    return np.repeat(np.arange(len(begin) - 1), np.diff(begin))


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k consecutive items from each position that has k; rows are not looked at."""
    if len(hashes) < k:
        return np.zeros(0, U)
    out = hashes[: len(hashes) - k + 1] * _MUL[0]
    for j in range(1, k):
        out = out + hashes[j : len(hashes) - k + 1 + j] * _MUL[j]
    return mix(out + U(k))


def shingles(hashes: np.ndarray, begin: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct k-word shingles of each row, sorted, and their number; a row of fewer words, but not none, has one."""
    count = np.diff(begin)
    every = grams(hashes, k)
    keep = np.zeros(len(every), bool)
    row = rows_of(begin)
    if len(every):
        keep = row[: len(every)] == row[k - 1 :]
    found, owner = every[keep], row[: len(every)][keep]
    short = np.flatnonzero((count > 0) & (count < k))
    if len(short):
        alone = []
        for r in short:
            part = hashes[begin[r] : begin[r + 1]]
            alone.append(mix((part * _MUL[: len(part)]).sum(dtype=U, keepdims=True) + U(len(part)))[0])
        found, owner = np.concatenate([found, np.array(alone, U)]), np.concatenate([owner, short])
    order = np.lexsort((found, owner))
    found, owner = found[order], owner[order]
    if len(found):
        first = np.ones(len(found), bool)
        first[1:] = (found[1:] != found[:-1]) | (owner[1:] != owner[:-1])
        found, owner = found[first], owner[first]
    return found, np.bincount(owner, minlength=len(count)).astype(np.int64)
