"""Word shingles of whole texts as sorted sets of 64-bit hashes, and their signatures.

Two shingles, or two sets, are taken as equal if their hashes are (64 bits a shingle, 128 bits a set).
"""

from __future__ import annotations

import hashlib

import numpy as np

from motifold.llm.tokens import U, scrambled, word_hashes

WORDS = 5
_STEP = U(0xD1342543DE82EF95)


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Per text the distinct shingles, sorted; a text with 1 to 4 words has one, without words none."""
    hashes, before = word_hashes(data, offsets, fold=True)
    n = max(len(hashes) - WORDS + 1, 0)
    mixed = np.zeros(n, U)
    for i in range(WORDS):
        mixed = mixed * _STEP + hashes[i : i + n]
    mixed = scrambled(mixed + U(WORDS))
    out = []
    for first, last in zip(before[:-1].tolist(), before[1:].tolist(), strict=True):
        if last - first >= WORDS:
            own = np.sort(mixed[first : last - WORDS + 1])
            keep = np.ones(len(own), bool)
            keep[1:] = own[1:] != own[:-1]
            out.append(own[keep])
        elif last > first:
            whole = U(0)
            with np.errstate(over="ignore"):
                for h in hashes[first:last]:
                    whole = whole * _STEP + h
                out.append(scrambled(np.array([whole + U(last - first)], U)))
        else:
            out.append(np.zeros(0, U))
    return out


def digest(shingles: np.ndarray) -> bytes:
    return hashlib.blake2b(shingles.tobytes(), digest_size=16).digest()


def permutations(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(85)
    return rng.integers(0, 1 << 63, count, dtype=U) * U(2) + U(1), rng.integers(0, 1 << 63, count, dtype=U)


def signature(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of the set under each of the permutations, in 32 bits."""
    least = np.full(len(a), np.iinfo(U).max, U)
    for at in range(0, len(shingles), 4096):
        np.minimum(least, (shingles[at : at + 4096, None] * a + b).min(axis=0), out=least)
    return (least >> U(32)).astype(np.uint32)
