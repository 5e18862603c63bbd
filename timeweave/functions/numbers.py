"""Numbers: equal parts of whole numbers and weights of smoothing windows."""

from __future__ import annotations

import math

import numpy as np


def parts_of(total: int, limit: int) -> int:
    """The fewest parts of `limit` at most; 1 at least."""
    return max(-(-total // limit), 1)


def equal_parts(total: int, limit: int) -> np.ndarray:
    """Sizes of those parts, as equal as whole numbers can be."""
    k = parts_of(total, limit)
    return np.diff(np.arange(k + 1, dtype=object) * total // k).astype(np.int64)


def smoothing(n: int) -> list[float]:
    """The inner weights of a raised-cosine window, without its zero ends: n of them, symmetric, the middle 1 if n is odd."""
    return [round(0.5 - 0.5 * math.cos(2 * math.pi * (k + 1) / (n + 1)), 15) for k in range(n)]


def hamming(n: int) -> np.ndarray:
    return 0.54 - 0.46 * np.cos(2 * np.pi * np.arange(n) / (n - 1)) if n > 1 else np.ones(n)
