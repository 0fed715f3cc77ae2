"""Code points of many texts in one array, for numpy work inside Arrow batches."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

MULTIPLIER = np.uint32(0x01000193)


@lru_cache(maxsize=1)
def letter_table() -> np.ndarray:
    """True for every code point that is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)


def code_points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased code points, each text followed by one 0, and the end of each text in that array (at its 0)."""
    low = [(t or "").lower() for t in texts]
    ends = np.cumsum(np.fromiter((len(t) + 1 for t in low), np.int64, len(low))) - 1
    data = "\0".join([*low, ""]).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, np.uint32), ends


def blocks(rows: list, size, most: int = 1 << 20):
    """Cut a list into runs whose sizes add up to most at least; a larger row is a run of its own."""
    run, total = [], 0
    for row in rows:
        if run and total + size(row) > most:
            yield run
            run, total = [], 0
        run.append(row)
        total += size(row)
    if run:
        yield run
