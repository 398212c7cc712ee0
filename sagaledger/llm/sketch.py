"""HyperMinHash sketches of sets of 64-bit elements, and the arithmetic on them.

The high bits of an element choose a register.  A register keeps, of the least remainder that fell into it, the number of
leading zeros and the bits that follow the first one: the order of the remainders at a fraction of their size.  Registers
that nothing fell into are empty.
"""

from __future__ import annotations

import numpy as np

from ._text import mix64

#: Registers, and bits of the mantissa that a register keeps.
REGISTERS, MANTISSA = 256, 10
EMPTY = np.uint16(0xFFFF)
_INDEX_BITS = 8
_REST = 64 - _INDEX_BITS


def registers(elements: np.ndarray, first: np.ndarray) -> np.ndarray:
    """One row of registers for each set: elements[first[i]:first[i + 1]], sorted and distinct."""
    n = len(first) - 1
    out = np.full((n, REGISTERS), EMPTY, dtype=np.uint16)
    if not len(elements):
        return out
    index = (elements >> np.uint64(_REST)).astype(np.int64)
    lead = np.ones(len(elements), dtype=bool)
    lead[1:] = index[1:] != index[:-1]
    starts = first[:-1][first[:-1] < first[1:]]
    lead[starts] = True
    at = np.flatnonzero(lead)  # elements are sorted, so the first of a register is its least
    owner = np.searchsorted(first, at, side="right") - 1
    rest = elements[at] << np.uint64(_INDEX_BITS)
    # Leading zeros by halving; the bits after the first one are the mantissa.
    zeros = np.zeros(len(at), dtype=np.int64)
    x = rest.copy()
    for step in (32, 16, 8, 4, 2, 1):
        small = x < np.uint64(1 << (64 - step))
        zeros += np.where(small, step, 0)
        x = np.where(small, x << np.uint64(step), x)
    zeros = np.minimum(zeros, 62)
    mantissa = ((x << np.uint64(1)) >> np.uint64(64 - MANTISSA)).astype(np.int64)
    out[owner, index[at]] = ((zeros << MANTISSA) | mantissa).astype(np.uint16)
    return out


_steps = np.random.default_rng(20).permuted(np.tile(np.arange(REGISTERS), (24, 1)), axis=1)


def densified(rows: np.ndarray) -> np.ndarray:
    """Empty registers filled from others, in an order that is fixed for each register; sets without elements stay empty."""
    out = rows.copy()
    flat, source = out.ravel(), rows.ravel()
    some = (rows != EMPTY).any(1)
    at = np.flatnonzero((rows == EMPTY) & some[:, None])

    def fill(at: np.ndarray, place: np.ndarray) -> np.ndarray:
        got = source[(at - at % REGISTERS) + place]
        full = got != EMPTY
        flat[at[full]] = got[full]
        return at[~full]

    for order in _steps:
        if not len(at):
            return out
        at = fill(at, order[at % REGISTERS])
    for shift in range(1, REGISTERS):
        if not len(at):
            break
        at = fill(at, (at + shift) % REGISTERS)
    return out


def band_keys(rows: np.ndarray, bands: int, width: int) -> np.ndarray:
    """A 64-bit key for each band of each set."""
    filled = densified(rows)[:, : bands * width].astype(np.uint64).reshape(len(rows), bands, width)
    key = np.broadcast_to(mix64(np.arange(1, bands + 1, dtype=np.uint64)), (len(rows), bands)).copy()
    for k in range(width):
        key = mix64(key * np.uint64(0x100000001B3) + filled[:, :, k])
    return key.view(np.int64)


def _cells(n: np.ndarray) -> np.ndarray:
    """For set sizes n: the chance that a given register's least remainder lies in each (zeros, mantissa) cell."""
    zeros = np.arange(63, dtype=float)[:, None]
    steps = np.arange(1 << MANTISSA, dtype=float)[None, :]
    low = 2.0 ** -(zeros + 1) * (1 + steps / (1 << MANTISSA)) / REGISTERS
    high = 2.0 ** -(zeros + 1) * (1 + (steps + 1) / (1 << MANTISSA)) / REGISTERS
    low, high = low.ravel(), high.ravel()
    return np.exp(n[:, None] * np.log1p(-low)) - np.exp(n[:, None] * np.log1p(-high))


_sizes = 2.0 ** np.arange(0, 25)
_chance: np.ndarray | None = None


def chance_matches(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Expected share of registers in which unrelated sets of n and m elements agree by chance; from a grid of sizes."""
    global _chance
    if _chance is None:
        cells = _cells(_sizes)
        _chance = cells @ cells.T
    i = np.clip(np.rint(np.log2(np.maximum(n, 1))), 0, len(_sizes) - 1).astype(int)
    j = np.clip(np.rint(np.log2(np.maximum(m, 1))), 0, len(_sizes) - 1).astype(int)
    return _chance[i, j]


def estimated_jaccard(a: np.ndarray, b: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Jaccard similarity from pairs of register rows, without the matches that chance explains."""
    used = (a != EMPTY) | (b != EMPTY)
    same = (a == b) & (a != EMPTY)
    total = np.maximum(used.sum(1), 1)
    by_chance = np.minimum(chance_matches(n, m), 0.5)
    raw = same.sum(1) / total
    return np.clip((raw - by_chance) / (1 - by_chance), 0, 1)
