"""Statistics of sliding windows as array operations: a window of n values is put together from blocks of 1, 2, 4, ... values.

So a window costs log n steps, whatever lies between its ends is added up in pairs and never taken away again, and series that lie
one after another are done at once: the caller leaves out the windows that begin before their series. x: doubles, NaN for no
value; a window that holds one is NaN. Results belong to the windows that end at each place.
"""

from __future__ import annotations

import numpy as np


def shifted(x: np.ndarray, n: int) -> np.ndarray:
    """x n places before; NaN where there is none."""
    if not n:
        return x
    out = np.full(len(x), np.nan)
    out[n:] = x[:-n]
    return out


def counts(known: np.ndarray, n: int) -> np.ndarray:
    """How many of the last n places are known, fewer at the start."""
    total = np.append(0, np.cumsum(known))
    at = np.arange(1, len(total))
    return total[at] - total[np.maximum(at - n, 0)]


def ordered_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums of windows added up from their first value to their last, as a loop over each window does."""
    out = np.full(len(x), np.nan)
    if len(x) >= n:
        sums = np.zeros(len(x) - n + 1)
        for k in range(n):
            sums += x[k : len(x) - n + 1 + k]
        out[n - 1 :] = sums
    return out


def moments(x: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(mean, sum of squared distances from it), without differences of large sums: both are exact where all values are equal."""
    mean, m2, size = x, np.where(np.isnan(x), np.nan, 0.0), 1
    got: tuple[np.ndarray, np.ndarray, int] | None = None
    rest = n
    with np.errstate(invalid="ignore", over="ignore"):
        while True:
            if rest & 1:
                if got is None:
                    got = mean, m2, size
                else:
                    a, q, k = got
                    d = shifted(mean, k) - a
                    got = a + d * (size / (k + size)), q + shifted(m2, k) + d * d * (k * size / (k + size)), k + size
            rest >>= 1
            if not rest:
                return got[:2]
            before = shifted(mean, size)
            d = mean - before
            mean, m2, size = before + d / 2, m2 + shifted(m2, size) + d * d * (size / 2), size * 2


def _smaller(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """The least len(a) of two ascending lists of as many, ascending: a bitonic merge."""
    k = len(a)
    out = [np.minimum(x, y) for x, y in zip(a, reversed(b), strict=True)]
    step = k // 2
    while step:
        for i in range(k):
            if not i & step:
                out[i], out[i + step] = np.minimum(out[i], out[i + step]), np.maximum(out[i], out[i + step])
        step //= 2
    return out


def smallest(x: np.ndarray, n: int, k: int) -> list[np.ndarray]:
    """The k smallest values of each window, ascending; infinity where a window has fewer. k: a power of two."""
    block, size = [x] + [np.full(len(x), np.inf)] * (k - 1), 1
    got, taken = None, 0
    rest = n
    while True:
        if rest & 1:
            part = [shifted(v, taken) for v in block]
            got, taken = part if got is None else _smaller(got, part), taken + size
        rest >>= 1
        if not rest:
            return got
        block, size = _smaller(block, [shifted(v, size) for v in block]), size * 2
