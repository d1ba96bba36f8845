"""Continuous periods and gaps of intervals, over a global range sort."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.sources import cut

#: End of an open interval inside the computation.
OPEN = np.iinfo(np.int64).max
_SUMMARY = "part int, first_key string, first_start long, last_key string, last_max_end long, last_island long"
_OUT = "k string, kind string, start_us long, end_us long"


def _with_part(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[int, pd.DataFrame]]:
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    for frame in frames:
        if len(frame):
            yield part, frame


def _islands(key: np.ndarray, start: np.ndarray, end: np.ndarray, state: tuple | None) -> tuple[np.ndarray, np.ndarray]:
    """For rows sorted by key and start: the largest end before each row within its key (or -OPEN), and after it."""
    new_key = np.r_[True, key[1:] != key[:-1]]
    upto = pd.Series(end).groupby(np.cumsum(new_key)).cummax().to_numpy()
    if state is not None and state[0] == key[0]:
        head = int(np.argmax(np.r_[new_key[1:], True])) + 1
        upto[:head] = np.maximum(upto[:head], state[2])
    before = np.r_[-OPEN, upto[:-1]]
    before[new_key] = -OPEN
    if state is not None and state[0] == key[0]:
        before[0] = state[2]
    return before, upto


def _summaries(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    first, state, part = None, None, -1
    for part, f in _with_part(frames):
        key, start, end = f["k"].to_numpy(object), f["s"].to_numpy(np.int64), f["e"].to_numpy(np.int64)
        first = first or (key[0], start[0])
        before, upto = _islands(key, start, end, state)
        opens = np.flatnonzero((start > before) & (key == key[-1]))
        island = int(start[opens[-1]]) if len(opens) else state[1]
        state = (key[-1], island, int(upto[-1]))
    if first:
        yield pd.DataFrame([(part, first[0], first[1], state[0], state[2], state[1])], columns=[c.split()[0] for c in _SUMMARY.split(", ")])


def periods_and_gaps(rows: DataFrame, keys: dict[str, Column], start_us: Column, end_us: Column, partitions: int | None = None) -> DataFrame:
    """The periods and gaps of half-open intervals per key: the key columns, kind (period or gap), start_us, end_us.

    Intervals that overlap or touch form one ``period`` (end_us -1 if it is open, which a null ``end_us`` makes it);
    each hole between neighbouring periods of a key is a ``gap``. Rows with a null key or start are left out, as are
    empty and backward ones (end at or before start). Repeated rows change nothing; no rows give no rows. Input
    columns are reached only through the given expressions.

    The rows are range-sorted by key and start into partitions, so a key may span any number of tasks. One pass takes
    a summary per partition (its largest end, its last island); the summaries, one row for each partition, are
    combined in order on the driver; a second pass rescans each partition with the state carried into it.
    """
    # the key as one string: JSON keeps the columns apart and comparable
    flat = rows.select(*[c.alias(n) for n, c in keys.items()], start_us.cast("long").alias("__s"), end_us.cast("long").alias("__e"))
    types = {f.name: f.dataType for f in flat.schema.fields if f.name in keys}
    flat = flat.where(" AND ".join(f"`{n}` IS NOT NULL" for n in keys)).where("__s IS NOT NULL AND (__e IS NULL OR __e > __s)")
    flat = flat.select(F.to_json(F.struct(*keys)).alias("k"), F.col("__s").alias("s"), F.coalesce("__e", F.lit(OPEN)).alias("e"))
    # without a number the adaptive planner sizes the partitions
    ranged = flat.repartitionByRange(partitions, "k", "s") if partitions else flat.repartitionByRange("k", "s")
    ordered = cut(ranged.sortWithinPartitions("k", "s"))

    carry: dict[int, tuple | None] = {}
    state = None
    found = sorted(ordered.mapInPandas(_summaries, _SUMMARY).collect(), key=lambda r: r.part)
    for r in found:
        carry[r.part] = state
        if state is not None and state[0] == r.last_key:
            island = r.last_island if r.last_island > state[2] else state[1]
            state = (r.last_key, island, max(state[2], r.last_max_end))
        else:
            state = (r.last_key, r.last_island, r.last_max_end)
    last_part = found[-1].part if found else -1

    def rescan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state, begun, part = None, False, -1

        def told(k, kind, s, e):  # noqa: ANN001
            return pd.DataFrame({"k": k, "kind": kind, "start_us": s, "end_us": np.where(np.asarray(e) == OPEN, -1, e)})

        for part, f in _with_part(frames):
            if not begun:
                state, begun = carry[part], True
            key, start, end = f["k"].to_numpy(object), f["s"].to_numpy(np.int64), f["e"].to_numpy(np.int64)
            before, upto = _islands(key, start, end, state)
            at = np.flatnonzero(start > before)
            if not len(at):
                state = (state[0], state[1], int(upto[-1]))
                continue
            # islands that end at a row of this batch: the one carried in, and all but the last begun here
            if state is not None:
                if at[0] > 0 and key[at[0] - 1] == state[0]:
                    last = int(upto[at[0] - 1])
                else:
                    last = state[2]
                yield told([state[0]], "period", [state[1]], [last])
                state = (state[0], state[1], last)
            if len(at) > 1:
                yield told(key[at[:-1]], "period", start[at[:-1]], upto[at[1:] - 1])
            inner = at[before[at] > -OPEN]
            if len(inner):
                yield told(key[inner], "gap", before[inner], start[inner])
            state = (key[at[-1]], int(start[at[-1]]), int(upto[-1]))
        if begun and part == last_part:  # else the next partition tells it, from the state carried there
            yield told([state[0]], "period", [state[1]], [state[2]])

    out = ordered.mapInPandas(rescan, _OUT)
    schema = ", ".join(f"`{n}` {t.simpleString()}" for n, t in types.items())
    return out.select(F.from_json("k", schema).alias("k"), "kind", "start_us", "end_us").select("k.*", "kind", "start_us", "end_us")
