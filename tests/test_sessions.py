import pandas as pd
import pytest
from pyspark.sql import functions as F

from mnemora.operators.sessions import sessions

SCHEMA = "id long, who string, t long, call boolean, entity string, slice long"
MIN = 60_000_000


def run(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA)
    out = sessions(df, F.col("who"), F.col("t"), F.col("id"), counts={"calls": F.col("call")}, **more).toPandas()
    return sorted(map(tuple, out.astype(object).to_numpy()))


def brute(rows, gap):
    seen, by = set(), {}
    for i, who, t, call, *_ in rows:
        if i is not None and who is not None and t is not None and i not in seen:
            seen.add(i)
            by.setdefault(who, []).append((t, call))
    out = []
    for who, ev in by.items():
        ev.sort(key=lambda x: x[0])
        cur = [ev[0]]
        for e in ev[1:]:
            if e[0] - cur[-1][0] > gap:
                out.append((who, cur))
                cur = []
            cur.append(e)
        out.append((who, cur))
    return sorted((w, c[0][0], c[-1][0], c[-1][0] - c[0][0], len(c), sum(bool(x[1]) for x in c)) for w, c in out)


def test_gap_is_inclusive_and_copies_count_once(spark):
    rows = [(1, "a", 0, True, "x", 1), (1, "a", 0, True, "x", 1), (2, "a", 30 * MIN, False, "x", 1), (3, "a", 60 * MIN + 1, None, "x", 1)]
    assert run(spark, rows) == [("a", 0, 30 * MIN, 30 * MIN, 2, 1), ("a", 60 * MIN + 1, 60 * MIN + 1, 0, 1, 0)]


def test_nulls_ties_and_empty(spark):
    rows = [(1, None, 5, True, "x", 1), (2, "b", None, True, "x", 1), (None, "b", 7, True, "x", 1), (3, "b", 7, True, "x", 1), (4, "b", 7, False, "x", 1)]
    assert run(spark, rows) == [("b", 7, 7, 0, 2, 1)]
    assert run(spark, rows[:3]) == []


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_over_slices(spark, seed):
    import random

    r = random.Random(seed)
    rows = [(i, r.choice("aaab"), r.randrange(-3000, 6000) * MIN // 4, r.random() < 0.5, "x", 1) for i in range(600)]
    got = run(spark, rows, slice_us=3 * 60 * MIN)
    assert got == brute(rows, 30 * MIN)
    assert isinstance(pd.DataFrame(got), pd.DataFrame)
