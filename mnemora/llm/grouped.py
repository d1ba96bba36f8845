"""Arrow batches cut at the borders of groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Batches sorted by their first ``keys`` columns, cut anew so that no group of equal keys is divided."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(i).to_numpy() for i in range(keys)]
        turn = np.flatnonzero(np.any([c[1:] != c[:-1] for c in cols], axis=0))
        if held and any(held[-1].column(i)[-1] != b.column(i)[0] for i in range(keys)):
            yield pa.Table.from_batches(held)
            held = []
        if len(turn):
            yield pa.Table.from_batches([*held, b.slice(0, turn[-1] + 1)])
            held = [b.slice(turn[-1] + 1)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)
