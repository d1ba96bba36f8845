import numpy as np

from mnemora.operators.near import band_bits, near_later

DIM = 48
SCHEMA = "id long, v array<float>"


def brute(rows, k, least):
    ok = [(i, np.array(v, np.float32).astype(np.float64)) for i, v in rows if v is not None and len(v) == DIM and any(v)]
    out = set()
    for i, x in ok:
        s = sorted((-(x @ y / np.linalg.norm(x) / np.linalg.norm(y)).round(6), j) for j, y in ok if j > i)
        out |= {(i, j, -c) for c, j in s[:k] if -c >= least}
    return out


def test_equals_brute_force_with_copies(spark):
    r = np.random.default_rng(1)
    base = r.standard_normal((40, DIM))
    x = np.repeat(base, 6, axis=0) + 0.2 * r.standard_normal((240, DIM))
    x[200:215] = x[3]  # copies of one, and of another that is near to it
    x[220:228] = x[4]
    x = x.astype(np.float32)
    ids = r.permutation(1000)[:240].tolist()
    rows = [(i, v.tolist()) for i, v in zip(ids, x)] + [(2000, None), (2001, [0.0] * DIM), (2002, [1.0] * 3)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = near_later(df, DIM, 3, 0.9).collect()
    want = brute(rows, 3, 0.9)
    assert {(g["query"], g.id) for g in got} == {w[:2] for w in want}
    assert all(abs(g.similarity - {w[:2]: w[2] for w in want}[g["query"], g.id]) < 2e-6 for g in got) and len(got) == len(want)


def test_empty_and_bits(spark):
    assert near_later(spark.createDataFrame([], SCHEMA), DIM, 3, 0.9).collect() == []
    assert band_bits(0.92) == 16 and band_bits(0.88) == 13 and band_bits(0.0) >= 1
