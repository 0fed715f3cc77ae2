"""Arrow batches of rows that hold arrays."""

from __future__ import annotations

#: Rows that become Python objects at a time. A row is a piece of a signal, whose length is bounded.
ROWS = 128


def few(batches, rows: int = ROWS):
    """The same rows, a few at a time: a number takes four times as much as a Python object as it does in Arrow."""
    for b in batches:
        for k in range(0, b.num_rows, rows):
            yield b.slice(k, rows)
