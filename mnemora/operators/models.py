"""Judges, embeddings and rerankers as plain Python functions over batches of texts.

Each protocol wraps a function the user supplies. It is called with lists, an Arrow batch at a time, on the executors.
A call that raises, or gives a list of another length, has no answer: null, so that the deterministic path is taken.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _answers(f: Callable[..., Sequence], *columns: list) -> list:
    """The function's answers for the rows without a null; null for the others, and for all if it fails."""
    n = len(columns[0])
    known = [i for i in range(n) if all(c[i] is not None for c in columns)]
    out: list = [None] * n
    try:
        got = list(f(*([c[i] for i in known] for c in columns))) if known else []
    except Exception:  # noqa: BLE001 - whatever a model does, rows go on without it
        return out
    if len(got) == len(known):
        for i, x in zip(known, got):
            out[i] = x
    return out


def noul(f: Callable[[list[str], list[str]], Sequence[float | None]]):  # noqa: ANN201
    """A column function (a, b) to the probability of a yes."""

    @F.pandas_udf(T.DoubleType())
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series(_answers(f, a.tolist(), b.tolist()), dtype="Float64")

    return run


#: A cross-encoder has the same form as a yes-or-no judge: query and text to a score.
reranked = noul


def embedded(f: Callable[[list[str]], Sequence[Sequence[float]]], prefix: str = ""):  # noqa: ANN201
    """A column function from texts to vectors; ``prefix`` is set before each text, as some models ask of queries."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def run(text: pd.Series) -> pd.Series:
        t = [None if x is None else prefix + x for x in text.tolist()]
        return pd.Series([None if v is None else [float(x) for x in v] for v in _answers(f, t)], dtype=object)

    return run


def choice(options: DataFrame, f: Callable[[list[str], list[dict[str, str]]], Sequence[tuple[str, float] | None]]) -> DataFrame:
    """A judge's pick for each question: id, pick, p, of rows (id, state, key, text), one for each option.

    The function gets the states and, for each, its options by key (a question's options are few and come together). No
    row comes out for a question without an answer, or with one that is none of its options.
    """
    asked = options.groupBy("id").agg(F.first("state").alias("state"), F.array_sort(F.collect_list(F.struct("key", "text"))).alias("options"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            criteria = [{o["key"]: o["text"] for o in row} for row in frame["options"]]
            got = _answers(f, frame["state"].tolist(), criteria)
            rows = [(i, g[0], float(g[1])) for i, g, c in zip(frame["id"], got, criteria) if g is not None and g[0] in c]
            yield pd.DataFrame(rows, columns=["id", "pick", "p"])

    return asked.mapInPandas(run, f"id {options.schema['id'].dataType.simpleString()}, pick string, p double")


# stand-ins that need no model


def overlap(a: list[str], b: list[str]) -> list[float]:
    """The share of the tokens of the one that the other has."""
    from mnemora.functions.text import STOP_WORDS

    def tokens(s: str) -> list[str]:
        t = [x.lower().strip(".-") for x in re.findall(r"[A-Za-z0-9][A-Za-z0-9_.\-]*", s)]
        return [x for x in t if x and x not in STOP_WORDS]

    return [round(len(set(tokens(x)) & set(tokens(y))) / max(1, len(set(tokens(x)))), 6) for x, y in zip(a, b)]


def nearest_length(states: list[str], options: list[dict[str, str]]) -> list[tuple[str, float] | None]:
    """The option whose text has the number of characters nearest to the state's, by its last digits."""
    out: list[tuple[str, float] | None] = []
    for s, o in zip(states, options):
        p = {k: 1.0 / (1 + abs(len(t) - len(s) % 20)) for k, t in o.items() if t}
        out.append(max(((k, v) for k, v in p.items()), key=lambda kv: (kv[1], -int(kv[0])), default=None))
    return out


def letter_counts(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(sum("a" <= c <= "z" for c in t))] for t in texts]
