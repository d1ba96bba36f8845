import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemora.llm.neighbours import RECALL, Probing, _steps, _whole_or_hot, nearest, perturbations

SCHEMA = "id long, embedding array<float>, rank string, x string"
DIM = 64


def data(n, seed=0):
    r = np.random.default_rng(seed)
    base = r.standard_normal((n // 4, DIM))
    x = np.repeat(base, 4, axis=0) + 0.25 * r.standard_normal((n // 4 * 4, DIM))
    return x.astype(np.float32)


def brute(x, ids, k=5, least=0.7):
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    s = (u @ u.T).round(6)
    np.fill_diagonal(s, -2)
    out = {}
    for i in range(len(x)):
        top = sorted(range(len(x)), key=lambda j: (-s[i, j], ids[j]))[:k]
        out[ids[i]] = [(ids[j], s[i, j]) for j in top if s[i, j] >= least]
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, v, "r", "x") for i, v in rows], SCHEMA)
    got = {}
    for r in nearest(df, F.col("id"), F.col("embedding"), DIM, **more).orderBy("id", "rank").collect():
        got.setdefault(r.id, []).append((r.neighbour, r.similarity))
    return got


def test_recall_and_exact_values(spark):
    x = data(600)
    ids = list(range(600))
    got, want = run(spark, list(zip(ids, x.tolist()))), brute(x, ids)
    pairs = {(i, j) for i, l in want.items() for j, _ in l}
    hits = {(i, j) for i, l in got.items() for j, _ in l}
    assert len(pairs & hits) / len(pairs) >= 0.9
    value = {(i, j): s for i, l in want.items() for j, s in l}
    assert all(abs(value[i, j] - s) <= 1.1e-6 for i, l in got.items() for j, s in l if (i, j) in value)


@pytest.mark.parametrize("rows", [4_800, 25_000_000])
def test_recall_in_every_band(spark, rows):
    """Planted pairs at given cosines are found in nine of ten cases at least, also with the index of 25 million rows."""
    r = np.random.default_rng(5)
    dim, each, bands = 128, 600, (0.705, 0.75, 0.80, 0.90)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    x = unit(r.standard_normal((each * len(bands), dim)))
    z = r.standard_normal(x.shape)
    z = unit(z - (z * x).sum(axis=1, keepdims=True) * x)
    c = np.repeat(bands, each)[:, None]
    y = c * x + np.sqrt(1 - c * c) * z
    both = np.stack([x, y], axis=1).reshape(-1, dim).astype(np.float32)
    df = spark.createDataFrame([(i, v, "r", "x") for i, v in enumerate(both.tolist())], SCHEMA)
    probing = Probing.reaching(RECALL, 0.7, rows)
    got = {(v.id, v.neighbour) for v in nearest(df, F.col("id"), F.col("embedding"), dim, probing=probing).collect()}
    found = [np.mean([(2 * i, 2 * i + 1) in got for i in range(b * each, (b + 1) * each)]) for b in range(len(bands))]
    print(rows, probing.functions, probing.tables, dict(zip(bands, np.round(found, 3).tolist())))
    assert min(found) >= 0.9, found


def test_more_rows_never_ask_for_less():
    sizes = [Probing.reaching(RECALL, 0.7, n) for n in (10, 10**5, 10**6, 10**7, 10**8)]
    assert sizes == sorted(sizes, key=lambda p: (p.functions, p.tables)) and sizes[0].functions == 14


def test_copies_scaled_unusable_and_ties(spark):
    v = [1.0] * DIM
    rows = [(i, v) for i in (7, 3, 9, 1, 5, 8, 2)] + [(20, [0.0] * DIM), (21, None), (22, [1.0] * 3), (23, [float("nan")] * DIM), (24, [2.0] * DIM), (None, v)]
    got = run(spark, rows)
    assert set(got) == {1, 2, 3, 5, 7, 8, 9, 24}
    assert [n for n, _ in got[9]] == [1, 2, 3, 5, 7] and [n for n, _ in got[1]] == [2, 3, 5, 7, 8]
    assert [n for n, _ in got[24]] == [1, 2, 3, 5, 7]


def test_empty(spark):
    assert run(spark, [(1, None)]) == {}


def test_hot_buckets_are_compared_in_blocks(spark):
    r = np.random.default_rng(3)
    x = (np.ones((120, DIM)) + 0.05 * r.standard_normal((120, DIM))).astype(np.float32)
    ids = list(range(120))
    got = run(spark, list(zip(ids, x.tolist())), probing=Probing(block=20))
    assert got == {i: l for i, l in brute(x, ids).items()}


def test_steps_are_lossless():
    r = np.random.default_rng(4)
    q = r.integers(-60, 60, (50, DIM)).astype(np.float32)
    x = np.concatenate([q * np.float32(0.00364508), r.standard_normal((5, DIM)).astype(np.float32)])
    ok, step, codes = _steps(x)
    assert ok[:50].mean() > 0.9 and not ok[50:].any()
    assert all((codes[i] * step[i] == x[i]).all() for i in np.flatnonzero(ok))
    assert perturbations(12, 3, 8).sum(axis=0).min() == 1


def test_buckets_are_cut_at_their_borders():
    r = np.random.default_rng(6)
    key = np.sort(r.choice([1, 2, 3, 4, 5, 6], 4000, p=[0.001, 0.2, 0.002, 0.6, 0.1, 0.097]))
    for size in (1, 7, 100, 5000):
        batches = [pa.RecordBatch.from_arrays([pa.array(key[i : i + size]), pa.array(np.arange(i, min(i + size, 4000)))], ["key", "n"]) for i in range(0, 4000, size)]
        parts = [(t.column(0).to_numpy(), t.column(1).to_numpy(), hot) for t, hot in _whole_or_hot(iter(batches), 500)]
        assert np.concatenate([n for _, n, _ in parts]).tolist() == list(range(4000))
        for k, _, hot in parts:
            assert not hot or len(set(k)) == 1
        whole = [set(k) for k, _, hot in parts if not hot]
        assert sum(map(len, whole)) == len(set().union(*whole)) and not set().union(*whole) & {k[0] for k, _, hot in parts if hot}


def test_entries_hardly_grow_with_the_rows():
    few, many = (Probing.reaching(RECALL, 0.7, n) for n in (1_000_000, 9_000_000))
    assert few.tables * (1 + few.probes) <= 40 and many.tables * (1 + many.probes) <= 60
