import random

import pytest
from pyspark.sql import functions as F

from mnemora.operators.intervals import periods_and_gaps

SCHEMA = "k long, r string, s long, e long, kind string, start_us string"


def run(spark, rows, partitions=5):
    df = spark.createDataFrame(rows, SCHEMA)
    out = periods_and_gaps(df, {"k": F.col("k"), "r": F.col("r")}, F.col("s"), F.col("e"), partitions=partitions)
    return sorted(map(tuple, out.collect()))


def brute(rows):
    by, out = {}, []
    for k, r, s, e, *_ in rows:
        if k is not None and r is not None and s is not None and (e is None or e > s):
            by.setdefault((k, r), []).append((s, float("inf") if e is None else e))
    for key, iv in by.items():
        iv.sort()
        s, e = iv[0]
        for a, b in iv[1:]:
            if a > e:
                out += [(*key, "period", s, e), (*key, "gap", e, a)]
                s, e = a, b
            e = max(e, b)
        out.append((*key, "period", s, -1 if e == float("inf") else e))
    return sorted(out)


def test_touching_nested_open_backward_and_null(spark):
    rows = [(1, "a", 0, 10, "x", "y"), (1, "a", 10, 20, "x", "y"), (1, "a", 2, 4, "x", "y"), (1, "a", 30, None, "x", "y"), (1, "a", 5, 5, "x", "y"), (1, "a", 9, 1, "x", "y"), (None, "a", 0, 1, "x", "y"), (1, None, 0, 1, "x", "y"), (1, "b", None, 1, "x", "y")]
    assert run(spark, rows) == [(1, "a", "gap", 20, 30), (1, "a", "period", 0, 20), (1, "a", "period", 30, -1)]


def test_empty(spark):
    assert run(spark, [(None, None, None, None, None, None)]) == []


@pytest.mark.parametrize("seed", range(4))
def test_equals_brute_force_with_a_hot_key(spark, seed):
    r = random.Random(seed)
    rows = []
    for _ in range(400):
        s = r.randrange(0, 3000)
        rows.append((r.choice([1, 1, 1, 2, 3]), r.choice(["a", "a", "b"]), s, None if r.random() < 0.003 else s + r.randrange(-1, 25), "x", "y"))
    assert run(spark, rows, partitions=7) == brute(rows)
