import math
import random

from pyspark.sql import functions as F

from mnemora.llm.percentiles import digit_histogram, histogram_percentiles, merge_histograms, percentiles

SCHEMA = "g string, v double, pct int, n int, prefix string"


def brute(values, pct):
    v = sorted(values, key=lambda x: (math.isnan(x), x))
    return v[max(0, math.ceil(round(pct * len(v), 6) / 100) - 1)]


def test_equals_brute_force(spark):
    r = random.Random(1)
    rows = [(r.choice("aaab"), r.choice([r.gauss(0, 1e3), -0.0, 0.0, float(r.randrange(50)), 1e300, -1e-300, float("inf")]), 1, 1, "x") for _ in range(3000)]
    rows += [(None, 5.0, 1, 1, "x"), ("c", None, 1, 1, "x"), ("d", float("nan"), 1, 1, "x")]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(x.g, x.pct): (x.value, x.n) for x in percentiles(df, {"g": F.col("g")}, F.col("v"), [0.1, 50, 95, 99.9, 100]).collect()}
    by = {}
    for g, v, *_ in rows:
        if v is not None:
            by.setdefault(g, []).append(v)
    assert set(g for g, _ in got) == set(by)
    for (g, p), (v, n) in got.items():
        want = brute(by[g], p)
        assert n == len(by[g]) and (v == want or (math.isnan(v) and math.isnan(want)))


def test_empty_and_minimum(spark):
    df = spark.createDataFrame([("a", 1.0, 1, 1, "x")], SCHEMA)
    assert percentiles(df.limit(0), {"g": F.col("g")}, F.col("v"), [50]).collect() == []
    assert percentiles(df, {"g": F.col("g")}, F.col("v"), [50], at_least=2).collect() == []


def test_days_combine_within_the_bound(spark):
    r = random.Random(2)
    rows = [(r.choice("ab"), r.lognormvariate(5, 2), r.randrange(7), 1, "x") for _ in range(2000)]
    df = spark.createDataFrame(rows, SCHEMA)
    days = [digit_histogram(df.where(F.col("pct") == d), {"g": F.col("g")}, F.col("v")) for d in range(7)]
    whole = days[0]
    for d in days[1:]:
        whole = whole.unionByName(d)
    for x in histogram_percentiles(merge_histograms(whole, ["g"]), ["g"], [50, 95]).collect():
        want = brute([v for g, v, *_ in rows if g == x.g], x.pct)
        assert x.low <= want <= x.high and x.high - x.low <= want * 2**-11


def test_whole_numbers_stay_whole(spark):
    r = random.Random(5)
    values = [r.choice([r.randrange(-(2**63), 2**63), 2**53 + r.randrange(9), r.randrange(-5, 5)]) for _ in range(2000)]
    df = spark.createDataFrame([("a", v) for v in values] + [("b", 2**63 - 1), ("c", 7), ("c", 7), (None, -3)], "g string, v long")
    got = {(x.g, x.pct): x.value for x in percentiles(df, {"g": F.col("g")}, F.col("v"), [1, 25, 50, 75, 99]).collect()}
    s = sorted(values)
    assert all(got["a", float(p)] == s[max(0, -(-p * len(s) // 100) - 1)] for p in (1, 25, 50, 75, 99))
    assert got["b", 50.0] == 2**63 - 1 and got["c", 99.0] == 7 and got[None, 1.0] == -3
    one = percentiles(df.where("g = 'c'"), {"g": F.col("g")}, F.col("v"), [50]).first()
    assert (one.value, one.n) == (7, 2)
