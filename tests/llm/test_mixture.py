import random

import pytest
from pyspark.sql import functions as F

from mnemora.llm.mixture import mix_to_targets, plain_source, token_count

SCHEMA = "doc_id long, source string, n long, copies string, h string"
TARGETS = [("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.0, 1)]


def run(spark, rows, **more):
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)
    m, rep = mix_to_targets(df, F.col("doc_id"), F.col("source"), F.col("n"), TARGETS, **more)
    return {r.doc_id: r.copies for r in m.collect()}, {r.source: r for r in rep.collect()}


def rows(seed=0):
    r = random.Random(seed)
    return [(i, r.choice("aaaaaaabbc"), r.randrange(1, 200)) for i in range(3000)]


def test_shares_caps_and_report(spark):
    data = rows()
    copies, rep = run(spark, data)
    size = {s: sum(n * copies.get(i, 0) for i, x, n in data if x == s) for s in "abc"}
    whole = sum(size.values())
    for s, share, most in TARGETS[:3]:
        assert abs(size[s] / whole - share) < 0.01 and rep[s].size == size[s] and abs(rep[s].actual_share - size[s] / whole) < 1e-9
        assert max(copies.get(i, 0) for i, x, _ in data if x == s) <= most
    assert rep["none"].size == 0


def test_larger_totals_keep_what_smaller_ones_have(spark):
    data = rows(1)
    small, _ = run(spark, data, total=20_000)
    large, _ = run(spark, data, total=60_000)
    assert all(large.get(i, 0) >= c for i, c in small.items())
    assert abs(sum(n * small.get(i, 0) for i, _, n in data) - 20_000) < 600


def test_null_zero_unknown_and_empty(spark):
    copies, rep = run(spark, [(1, "a", 0), (2, None, 5), (None, "a", 5), (3, "zzz", 5), (4, "a", None)])
    assert copies == {} and rep["a"].available == 0
    copies, rep = run(spark, [])
    assert copies == {} and len(rep) == 4


def test_tokens_and_sources(spark):
    P = pytest.importorskip("public_tokenizers")
    df = spark.createDataFrame([(1, "Written-Answers ", None, "", ""), (2, None, 1, "", "")], SCHEMA)
    n = token_count(spark, F.col("source"), str(P.path("byte_bpe_multi_50k.tiktoken")), P.PATTERN)
    got = df.select(plain_source(F.col("source")).alias("s"), n.alias("n")).collect()
    assert got[0].s == "written_answers" and got[0].n > 0 and got[1].s is None and got[1].n == 0
