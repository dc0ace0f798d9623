"""MinHash values of the sliding windows of sequences, vectorised over many texts.

A window of ``size`` elements holds ``size - gram + 1`` shingles of ``gram`` elements.
Its MinHash under one permutation is the smallest mixed shingle hash. Equal windows have
equal values whatever text they stand in, so a collision search on them misses nothing;
neighbouring windows mostly share their value, so a text has few distinct ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93))
_SEEDS = (np.uint64(0x2545F4914F6CDD1D), np.uint64(0x5851F42D4C957F2D))
#: Elements handled at once; longer texts are cut into overlapping blocks.
BLOCK = 400_000


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values (splitmix finaliser)."""
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def gram_hashes(values: np.ndarray, gram: int, which: int = 0) -> np.ndarray:
    """Mixed 64-bit hash of each run of ``gram`` consecutive values."""
    n = len(values) - gram + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    if gram <= 16:
        total = np.zeros(n, dtype=np.uint64)
        for j in range(gram):
            total = total * _BASES[which] + values[j : j + n]
        return mix(total ^ _SEEDS[which])
    powers = _powers(_BASES[which], len(values))
    inverse = _powers(np.uint64(pow(int(_BASES[which]), -1, 1 << 64)), n)
    sums = np.zeros(len(values) + 1, dtype=np.uint64)
    np.cumsum(mix(values + _SEEDS[which]) * powers, out=sums[1:])
    return mix((sums[gram:] - sums[:-gram]) * inverse)


def _slide(values: np.ndarray, width: int, op) -> np.ndarray:
    """op over each run of ``width`` values, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = op(out[: len(out) - step], out[step:])
        have += step
    return out


def window_minhash(values: np.ndarray, size: int, gram: int) -> np.ndarray:
    """MinHash of each window of ``size`` elements, by start position."""
    if len(values) < size:
        return np.empty(0, dtype=np.uint64)
    return _slide(gram_hashes(values, gram), size - gram + 1, np.minimum)


def blocks(sequences: list[np.ndarray], size: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Concatenated blocks: (values, owner and position of each element, whether a window may start there).

    A long sequence is cut into blocks that overlap by ``size - 1``, so each window lies in exactly one.
    """
    parts: list[tuple[int, int, np.ndarray]] = []
    held = 0

    def flush():
        values = np.concatenate([p[2] for p in parts])
        owner = np.repeat([p[0] for p in parts], [len(p[2]) for p in parts])
        place = np.concatenate([p[1] + np.arange(len(p[2])) for p in parts])
        starts = np.concatenate([np.arange(len(p[2])) <= len(p[2]) - size for p in parts])
        return values, owner, place, starts

    for i, sequence in enumerate(sequences):
        at = 0
        while len(sequence) - at >= size:
            piece = sequence[at : at + BLOCK]
            parts.append((i, at, piece))
            held += len(piece)
            at += len(piece) - size + 1
            if held >= BLOCK:
                yield flush()
                parts, held = [], 0
    if parts:
        yield flush()
