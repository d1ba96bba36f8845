"""The ledger fold over a stream of statements."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_OUT = "key string, seq long, text string, obs long, outcome string"


def _step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    value, since = state.get if state.exists else (None, None)
    begun = state.exists
    # only what the decision needs is held; a key's micro-batch is bounded by the trigger (maxFilesPerTrigger and the like)
    rows = pd.concat([f[["key", "seq", "value", "text", "obs"]] for f in frames]).sort_values("seq")
    out = []
    for v, o in zip(rows["value"], rows["obs"]):
        if not begun:
            begun, value, since = True, v, o
            out.append("first")
        elif v == value:
            out.append("restate")
        elif o < since:
            out.append("late")
        else:
            value, since = v, o
            out.append("supersede")
    state.update((value, int(since)))
    yield rows[["key", "seq", "text", "obs"]].assign(outcome=out)


def decide(statements: DataFrame) -> DataFrame:
    """The outcome of every statement of a stream (key, seq, value, text, obs): first, restate, late or supersede.

    State is one value and one time for each key. Within a micro-batch statements are taken by ``seq``; over batches
    in order of arrival. Late statements are history and never dropped, so there is no watermark.
    """
    return statements.groupBy("key").applyInPandasWithState(_step, _OUT, "value string, since long", "append", GroupStateTimeout.NoTimeout)


def run_available(spark: SparkSession, stream: DataFrame, folder: str) -> DataFrame:
    """Process what a stream has now into parquet under ``folder`` and read it back."""
    q = stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    if q.exception() is not None:
        raise q.exception()
    return spark.read.parquet(f"{folder}/out")
