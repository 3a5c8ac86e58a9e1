"""Hashed character n-grams of one text, as arrays."""

from __future__ import annotations

import numpy as np

_STEP = np.uint32(0x9E3779B1)


def codes(text: str) -> np.ndarray:
    """Code points of the text in lower case, each run of white space as one blank, a blank at both ends."""
    plain = " " + " ".join(text.lower().split()) + " "
    return np.frombuffer(plain.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def hashed(points: np.ndarray, sizes: tuple[int, ...], bits: int) -> np.ndarray:
    """A number below 2**bits for each n-gram of the given sizes, repeats included."""
    found, h = [], np.full(len(points), 17, dtype=np.uint32)
    for n in range(1, max(sizes) + 1):
        if len(points) < n:
            break
        h = (h[: len(points) - n + 1] ^ points[n - 1 :]) * _STEP
        h ^= h >> np.uint32(15)
        if n in sizes:
            found.append(((h * np.uint32(0x85EBCA6B)) >> np.uint32(32 - bits)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.int32)
