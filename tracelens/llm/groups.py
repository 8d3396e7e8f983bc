"""Small helpers for tasks that read rows sorted by a key, and for classes inside one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[tuple, pa.Table]]:
    """Consecutive rows with equal (not null) keys, as (key, rows); a partition is never held whole."""
    pending: list[pa.RecordBatch] = []
    last: tuple | None = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        change[0] = True
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        starts = np.flatnonzero(change)
        for s, e in zip(starts, [*starts[1:], batch.num_rows], strict=True):
            key = tuple(c[s].item() if hasattr(c[s], "item") else c[s] for c in columns)
            if key != last and pending:
                yield last, pa.Table.from_batches(pending)
                pending = []
            pending.append(batch.slice(s, e - s))
            last = key
    if pending:
        yield last, pa.Table.from_batches(pending)


class Classes:
    """Disjoint sets of 0 .. n - 1; the smallest member is the root."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, x: int) -> int:
        up = self.up
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def join(self, a: int, b: int) -> None:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.up[max(a, b)] = min(a, b)

    def join_matrix(self, linked: np.ndarray, rows: np.ndarray, columns: np.ndarray) -> None:
        """Join rows[i] with columns[j] where linked[i, j]; each row costs one join for each class it meets."""
        for i, row in enumerate(linked):
            hits = columns[np.flatnonzero(row)]
            for r in {self.root(int(h)) for h in hits}:
                self.join(int(rows[i]), r)

    def roots(self) -> np.ndarray:
        return np.array([self.root(i) for i in range(len(self.up))], np.int64)
