"""Most similar vectors for every vector, by multiprobe cross-polytope hashing with exact reranking."""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.llm.grouped import groups
from mnemora.sources import cut

_I64 = pa.int64()
#: Chance of two vectors of the least similarity to meet; the screen leaves 0.93 and more of it.
RECALL = 0.97
#: Words of 64 sketch bits that a pair is looked at first.
LOOK = 2
#: Ids of copies up to which they are sent to every executor (8 bytes each).
MOST_SENT = 1_000_000


@dataclass(frozen=True)
class Probing:
    """Parameters of the index.

    tables: hash tables; functions: Gaussian axes of a table's key, divided among ``polytopes``, of each of which the key
    has the axis, with its sign, that a vector lies nearest to; probes: perturbed buckets visited in each table besides a
    vector's own; slots: polytopes, nearest first, in which a perturbation may take the second axis; sketch: sign bits (a multiple of 64) that a candidate pair is screened
    with, at ``slack`` standard deviations beyond the expectation at the least similarity by all of them, after a first
    look at 128 with 0.6 more; block: members beyond which a bucket is compared in tiles of this size, each a task's work of its own.
    """

    tables: int = 10
    functions: int = 14
    polytopes: int = 2
    probes: int = 3
    slots: int = 8
    sketch: int = 256
    slack: float = 2.0
    block: int = 1 << 16
    seed: int = 7

    @staticmethod
    @lru_cache(64)
    def reaching(recall: float, least: float, rows: int, bucket: int = 1500) -> Probing:
        """The index in which two vectors of similarity ``least`` meet with probability ``recall``, whatever the number of rows.

        Functions are as many as keep the expected bucket of unrelated vectors to ``bucket`` of ``rows``, at least the
        default's: m axes have 2m signed ones, which are equally likely. The chance to meet in one table follows from a
        seeded simulation of pairs just at ``least``, and tables are as many as the recall asks for. So more rows make
        more tables, never fewer links; near vectors share the nearest of many axes far more often than the slots of as
        selective a set of projections, so tables grow slowly.
        """
        p = Probing()
        functions = max(p.functions, p.polytopes * math.ceil((rows / bucket) ** (1 / p.polytopes) / 2))
        meet = _chance_to_meet(functions, p, least)
        return replace(p, functions=functions, tables=math.ceil(math.log(1 - recall) / math.log(1 - meet)))


def _chance_to_meet(functions: int, p: Probing, similarity: float, pairs: int = 20_000) -> float:
    """The share of pairs of unit vectors of that similarity that meet in one table, by a seeded simulation."""
    rng = np.random.default_rng(1)
    x = rng.standard_normal((pairs, functions))
    y = similarity * x + math.sqrt(1 - similarity**2) * rng.standard_normal((pairs, functions))
    numbers = rng.integers(-(2**62), 2**62, (p.polytopes, 2 * functions // p.polytopes))
    (a, near_a), (b, near_b) = (_keys(z, numbers, perturbations(p.polytopes, p.probes, p.slots)) for z in (x, y))
    return float(((a == b) | (near_a == b[:, None]).any(axis=1) | (near_b == a[:, None]).any(axis=1)).mean())


def _keys(y: np.ndarray, numbers: np.ndarray, crossed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of a table, own and perturbed ones, from projections on its axes; numbers: a random one for each signed axis of each polytope."""
    n, polytopes = np.arange(len(y)), len(numbers)
    own, moves, gaps = np.zeros(len(y), np.int64), [], []
    for number, z in zip(numbers, np.split(y, polytopes, axis=1)):
        size = np.abs(z)
        first = size.argmax(axis=1)
        most = size[n, first]
        size[n, first] = -1
        second = size.argmax(axis=1)
        at, other = (number[2 * i + (z[n, i] > 0)] for i in (first, second))
        own += at
        moves.append(other - at)
        gaps.append(most - size[n, second])
    nearest_ = np.argsort(np.stack(gaps, axis=1), axis=1)[:, : crossed.shape[0]]
    return own, own[:, None] + np.take_along_axis(np.stack(moves, axis=1), nearest_, axis=1) @ crossed


def perturbations(functions: int, probes: int, slots: int) -> np.ndarray:
    """0/1 matrix (slots x probes): the sets of nearest borders to cross, in order of their expected score.

    The score of a set is the sum of its squared distances to the crossed borders; the expectation of the j-th
    smallest of 2m uniform distances is closed-form, so one order serves all vectors. A set never holds both borders
    of one projection, as those are ranks j and 2m + 1 - j.
    """
    m = functions
    slots = min(slots, m)
    j = np.arange(1, slots + 1)
    score = j * (j + 1) / (4 * (m + 1) * (m + 2))
    sets = sorted((score[list(s)].sum(), s) for r in (1, 2, 3) for s in itertools.combinations(range(slots), r))
    out = np.zeros((slots, min(probes, len(sets))), np.int64)
    for k, (_, s) in enumerate(sets[: out.shape[1]]):
        out[list(s), k] = 1
    return out


def _unit(column: pa.Array) -> np.ndarray:
    """Rows of a list column as unit vectors; all lists have one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False)
    x = flat.reshape(len(column), -1)
    return x / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True).astype(np.float32)


def _hasher(dim: int, p: Probing):  # noqa: ANN202
    """A function from record batches (id, v) to (id, own list<long>, near list<long>, s0, s1, ...: 64 sketch bits each)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(p.seed)
        n_keys = p.tables * p.functions
        axes = rng.standard_normal((dim, n_keys + p.sketch)).astype(np.float32)
        numbers = rng.integers(-(2**62), 2**62, (p.tables, p.polytopes, 2 * p.functions // p.polytopes))
        crossed = perturbations(p.polytopes, p.probes, p.slots)
        rows = max(1, min(4096, (1 << 23) // axes.shape[1]))
        weights = np.left_shift(np.int64(1), np.arange(64, dtype=np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, rows):
                part = batch.slice(at, rows)
                y = _unit(part.column(1)) @ axes
                n = len(y)
                bits = (y[:, n_keys:] > 0).astype(np.int64)
                prints = [pa.array(bits[:, s : s + 64] @ weights) for s in range(0, p.sketch, 64)]
                own, near = np.empty((n, p.tables), np.int64), np.empty((n, p.tables, crossed.shape[1]), np.int64)
                for t in range(p.tables):
                    own[:, t], near[:, t] = _keys(y[:, t * p.functions : (t + 1) * p.functions], numbers[t], crossed)
                lists = lambda a: pa.ListArray.from_arrays(pa.array(np.arange(0, a.size + 1, a.size // n, dtype=np.int32)), pa.array(a.ravel()))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), lists(own), lists(near), *prints], ["id", "own", "near", *_prints(p)])

    return run


def _prints(p: Probing) -> list[str]:
    return [f"s{i}" for i in range(p.sketch // 64)]


def _limits(p: Probing, least: float) -> tuple[int, int]:
    """Differing sketch bits up to which a pair passes: of the first ``LOOK`` words, and of all."""
    angle = math.acos(least) / math.pi
    return tuple(math.floor(n * angle + slack * math.sqrt(n * angle * (1 - angle))) for n, slack in ((min(64 * LOOK, p.sketch), p.slack + 0.6), (p.sketch, p.slack)))  # type: ignore[return-value]


def _screened(x: np.ndarray, y: np.ndarray, prints: list[np.ndarray], most: int) -> np.ndarray:
    """Which of the pairs of rows x and y differ in no more than ``most`` bits of the words given."""
    far = np.zeros(len(x), np.int16)
    for s in prints:
        far += np.bitwise_count(s[x] ^ s[y])
    return np.flatnonzero(far <= most)


def _crossed(rows: np.ndarray, cols: np.ndarray, prints: list[np.ndarray], first: int, most: int, later: bool) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of each of ``rows`` with each of ``cols`` that pass the sketch; with ``later`` (both the same) each pair once.

    The first look takes two words, so that few pairs are left to be listed; its tiles are written over and over, and stay in the cache.
    """
    out = []
    height, width = 64, 1 << 11
    left, right = ([s[at] for s in prints[:LOOK]] for at in (rows, cols))
    bits, count, far = (np.empty(height * width, kind) for kind in (np.uint64, np.uint8, np.uint8))
    for i in range(0, len(rows), height):
        r = rows[i : i + height]
        for j in range(i - i % width if later else 0, len(cols), width):
            c = cols[j : j + width]
            b, n, f = (t[: len(r) * len(c)].reshape(len(r), len(c)) for t in (bits, count, far))
            for k, (u, v) in enumerate(zip(left, right)):
                np.bitwise_xor(u[i : i + height, None], v[None, j : j + width], out=b)
                np.bitwise_count(b, out=n if k else f)
                if k:
                    f += n
            u, v = np.divmod(np.flatnonzero(f <= first), len(c))
            if later:
                once = j + v > i + u
                u, v = u[once], v[once]
            x, y = r[u], c[v]
            ok = _screened(x, y, prints, most)
            out.append((x[ok], y[ok]))
    return tuple(np.concatenate(o) if out else np.empty(0, np.int64) for o in (zip(*out) if out else ((), ())))  # type: ignore[return-value]


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    """Distinct pairs of different ids, the smaller first."""
    a, b = np.minimum(a, b), np.maximum(a, b)
    ab = np.unique(np.stack([a, b], axis=1)[a != b], axis=0)
    return pa.RecordBatch.from_arrays([pa.array(ab[:, 0]), pa.array(ab[:, 1]), pa.nulls(len(ab), _I64), pa.nulls(len(ab), _I64)], ["a", "b", "hot", "far"])


def _hot_rows(table: pa.Table, hot: np.ndarray) -> pa.RecordBatch:
    kept = table.filter(pa.array(hot)).combine_chunks()
    key, far, ids = (kept.column(i).combine_chunks() for i in range(3))
    return pa.RecordBatch.from_arrays([ids, pa.nulls(len(ids), _I64), key, far.cast(_I64)], ["a", "b", "hot", "far"])


def _whole_or_hot(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[tuple[pa.Table, bool]]:
    """Batches sorted by their first column, cut anew at the borders of keys; a key of more than ``block`` rows comes out in parts, marked hot, and is never held whole."""
    held: list[pa.RecordBatch] = []
    hot = None
    for b in batches:
        while b.num_rows:
            key = b.column(0).to_numpy()
            if hot is not None:
                n = int(np.searchsorted(key != hot, True)) if key[-1] != hot else len(key)
                if n:
                    yield pa.Table.from_batches([b.slice(0, n)]), True
                b, hot = b.slice(n), hot if n == len(key) else None
                continue
            if held and held[-1].column(0)[-1].as_py() != key[0]:
                yield pa.Table.from_batches(held), False
                held = []
            turn = np.flatnonzero(key[1:] != key[:-1])
            if len(turn):
                yield pa.Table.from_batches([*held, b.slice(0, turn[-1] + 1)]), False
                held, b = [], b.slice(turn[-1] + 1)
            held.append(b)
            b = b.slice(b.num_rows)
            if sum(x.num_rows for x in held) > block:
                hot = held[0].column(0)[0].as_py()
                yield pa.Table.from_batches(held), True
                held = []
    if held:
        yield pa.Table.from_batches(held), False


def _bucket_pairs(first: int, most: int, block: int):  # noqa: ANN202
    """From rows (key, far, id, s0, ...) sorted by key and far to pairs (a, b), or (id, null, key, far) of a hot bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, hot in _whole_or_hot(batches, block):
            if hot:
                yield _hot_rows(table, np.ones(table.num_rows, bool))
                continue
            key, far, ids, *prints = (table.column(i).to_numpy() for i in range(table.num_columns))
            prints = [s.view(np.uint64) for s in prints]  # bits of a signed number would be those of its absolute value
            start = np.r_[0, np.flatnonzero(key[1:] != key[:-1]) + 1]
            size = np.diff(np.r_[start, len(key)])
            own = np.add.reduceat((far == 0).astype(np.int64), start)
            if (size > block).any():
                yield _hot_rows(table, np.repeat(size > block, size))
            a_out, b_out = [], []
            large = (size > 96) & (size <= block) & (own > 0)
            for s, n, o in zip(start[large], size[large], own[large]):
                mine, others = np.arange(s, s + o), np.arange(s + o, s + n)
                for cols, later in ((mine, True), (others, False)):
                    x, y = _crossed(mine, cols, prints, first, most, later)
                    a_out.append(ids[x])
                    b_out.append(ids[y])
            last = np.repeat(start + size, size)
            i, d = np.flatnonzero((far == 0) & np.repeat(size <= 96, size)), 1
            while len(i):
                i = i[i + d < last[i]]
                near = _screened(i, i + d, prints[:LOOK], first)
                near = near[_screened(i[near], i[near] + d, prints, most)]
                a_out.append(ids[i[near]])
                b_out.append(ids[i[near] + d])
                d += 1
            if a_out:
                yield _pairs(np.concatenate(a_out), np.concatenate(b_out))

    return run


def _tile_pairs(first: int, most: int):  # noqa: ANN202
    """From rows (tile, side, far, id, s0, ...) sorted by tile to pairs (a, b) of its two sides, one of them in its own bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            tile, side, far, ids, *prints = (table.column(i).to_numpy() for i in range(table.num_columns))
            prints = [s.view(np.uint64) for s in prints]
            for t in np.unique(tile):
                own = np.flatnonzero((tile == t) & (side == 0) & (far == 0))
                x, y = _crossed(own, np.flatnonzero((tile == t) & (side == 1)), prints, first, most, False)
                yield _pairs(ids[x], ids[y])

    return run


def _steps(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row of floats: whether all are whole multiples (-127 to 127) of one step, the step, the multiples."""
    with np.errstate(all="ignore"):
        gaps = np.diff(np.sort(x.astype(np.float64), axis=1), axis=1)
        least = np.where(gaps > 0, gaps, np.inf).min(axis=1)
        top = np.abs(x).max(axis=1)
        first = (top / np.maximum(1, np.rint(top / least))).astype(np.float32)
        exact, step, codes = np.zeros(len(x), bool), first.copy(), np.zeros(x.shape, np.int8)
        for ulps in (0, 1, -1, 2, -2, 3, -3, 4, -4):
            s = (first.view(np.int32) + np.int32(ulps)).view(np.float32)[:, None]
            q = np.rint(x / s)
            fits = ~exact & (np.abs(q).max(axis=1) <= 127) & (q * s == x).all(axis=1)
            exact |= fits
            step[fits], codes[fits] = s[fits, 0], q[fits].astype(np.int8)
    return exact, step, codes


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Vectors as bytes without loss: steps of a quantised store as such, others as floats, both compressed."""
    import zstandard

    z = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            b = batch.slice(at, 4096)
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32, copy=False).reshape(b.num_rows, -1)
            exact, step, codes = _steps(x)
            packed = [z.compress(b"\1" + s.tobytes() + c.tobytes() if e else b"\0" + r.tobytes()) for e, s, c, r in zip(exact, step, codes, x)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(packed, pa.binary())], ["id", "v"])


def _unpack(column: pa.Array, dim: int) -> np.ndarray:
    """Unit vectors from packed ones."""
    import zstandard

    z = zstandard.ZstdDecompressor()
    x = np.empty((len(column), dim), np.float32)
    for i, v in enumerate(column):
        raw = z.decompress(v.as_py(), max_output_size=1 + dim * 4)
        x[i] = np.frombuffer(raw, np.int8, dim, 5) * np.frombuffer(raw, np.float32, 1, 1) if raw[0] else np.frombuffer(raw, np.float32, dim, 1)
    x = x.astype(np.float64)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _verified(dim: int, least: float):  # noqa: ANN202
    """From rows (home, salt, kind, a, b, v), vectors before pairs in each group, to (a, b, similarity)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 2):
            kind, a, b = (table.column(i).to_numpy() for i in (2, 3, 4))
            is_v = kind == 0
            if is_v.all():
                continue
            ids, at = np.unique(a[is_v], return_index=True)
            x = _unpack(table.column(5).combine_chunks().filter(pa.array(is_v)).take(pa.array(at)), dim)
            pa_, pb = a[~is_v], b[~is_v]
            i, j = np.searchsorted(ids, pa_), np.searchsorted(ids, pb)
            cos = np.concatenate([np.einsum("ij,ij->i", x[i[s : s + 8192]], x[j[s : s + 8192]]) for s in range(0, len(i), 8192)]).round(6)
            ok = cos >= least
            yield pa.RecordBatch.from_arrays([pa.array(pa_[ok]), pa.array(pb[ok]), pa.array(cos[ok])], ["a", "b", "similarity"])

    return run


def nearest(rows: DataFrame, row_id: Column, vector: Column, dim: int, k: int = 5, least: float = 0.7, recall: float = RECALL, probing: Probing | None = None) -> DataFrame:
    """For every usable row its k most similar other rows: id, neighbour, similarity, rank.

    Similarity is the cosine rounded to 6 decimals, at least ``least``; ties go to the smaller id. Usable vectors are
    non-null, of length ``dim``, finite and not all zero, of rows with a non-null id; others neither ask nor answer.
    Ids must be unique; exact copies are held against the rest once and share the list of their class, so any number
    of copies costs linear work. Input columns are reached only through the given expressions.

    Every vector is hashed into ``tables`` buckets by the axes it lies nearest to and also visits the ``probes`` perturbed
    buckets of each table with the best estimated chance. Pairs that meet are screened by sign sketches, merged over
    the tables, and measured exactly where their vectors meet. A bucket of more than ``block`` members is screened
    tile by tile. Tables and functions are those by which two vectors of similarity ``least`` meet with probability
    ``recall`` (``Probing.reaching``), at every number of rows; nearer ones meet more surely, and the screen loses
    about 2.5 % at ``least``. Recall against brute force is therefore below 1: see README.
    """
    t = rows.select(row_id.cast("long").alias("id"), vector.alias("v")).where(
        (F.col("id").isNotNull()) & (F.size("v") == dim) & F.exists("v", lambda x: x != 0) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    p = probing or Probing.reaching(recall, least, rows.count())
    first, most = _limits(p, least)
    print_of = (F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), F.col("v")).alias("h2"))
    prints = t.select("id", *print_of)
    classes = prints.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("copies"))
    copied = cut(prints.join(classes.where("copies > 1"), ["h1", "h2"]).select("id", "rep"))

    s_names = _prints(p)
    s_types = ", ".join(f"{c} long" for c in s_names)
    others = copied.where("id <> rep").select("id")
    # few ids are sent to the vectors; many would be joined by a shuffle of both
    first_of_copies = t.join(F.broadcast(others) if others.count() <= MOST_SENT else others, "id", "left_anti")
    hashed = first_of_copies.mapInArrow(_hasher(dim, p), f"id long, own array<long>, near array<long>, {s_types}")
    entry = F.explode(F.concat(
        F.transform("own", lambda x: F.struct(x.alias("key"), F.lit(0).alias("far"))), F.transform("near", lambda x: F.struct(x.alias("key"), F.lit(1).alias("far")))))
    buckets = hashed.select(entry.alias("e"), "id", *s_names).select("e.key", "e.far", "id", *s_names)
    met = cut(buckets.repartition("key").sortWithinPartitions("key", "far").mapInArrow(_bucket_pairs(first, most, p.block), "a long, b long, hot long, far long"))
    hot = met.where("hot IS NOT NULL").select(F.col("hot").alias("bucket"), F.col("a").alias("id"), F.col("far"))
    if not hot.isEmpty():
        hot = hot.groupBy("bucket", "id").agg(F.min("far").alias("far"))
        sizes = hot.groupBy("bucket").agg(F.expr(f"cast(ceil(count(*) / {p.block}) as int)").alias("blocks"))
        member = hot.join(sizes, "bucket").withColumn("block", F.pmod(F.hash("id"), F.col("blocks"))).join(hashed.select("id", *s_names), "id")
        tiles = member.select(
            "id", "far", *s_names, F.explode(F.expr("""flatten(transform(sequence(0, blocks - 1), o -> array(
                struct(xxhash64(bucket, block, o) AS tile, 0 AS side), struct(xxhash64(bucket, o, block) AS tile, 1 AS side))))""")).alias("e"))
        tiles = tiles.select("e.tile", "e.side", "far", "id", *s_names).repartition("tile").sortWithinPartitions("tile")
        met = met.unionAll(tiles.mapInArrow(_tile_pairs(first, most), "a long, b long, hot long, far long"))
    pairs = cut(met.where("hot IS NULL").select("a", "b").distinct())
    packed = t.mapInArrow(_packed, "id long, v binary")

    # pairs are measured at a home: the least vector that the pair's smaller end has met, divided by salt where hot
    ends = pairs.select(F.col("a").alias("x"), F.col("b").alias("y")).unionAll(pairs.select("b", "a"))
    home = ends.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("home"))
    placed = pairs.join(home.withColumnRenamed("x", "a"), "a")
    salts = placed.groupBy("home").agg(F.expr("1 + count(*) div 2000").alias("salts")).where("salts > 1")
    placed = placed.join(salts, "home", "left").select("home", F.pmod(F.hash("b"), F.coalesce("salts", F.lit(1))).alias("salt"), "a", "b")
    placed = placed.withColumn("salt", F.col("salt").cast("long"))
    needed = placed.select("home", "salt", F.explode(F.array("a", "b")).alias("id")).distinct()
    carried = needed.join(packed, "id").select("home", "salt", F.lit(0).alias("kind"), F.col("id").alias("a"), F.lit(0).cast("long").alias("b"), "v")
    asked = placed.select("home", "salt", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast("binary").alias("v"))
    edges = carried.unionAll(asked).repartition("home", "salt").sortWithinPartitions("home", "salt", "kind").mapInArrow(_verified(dim, least), "a long, b long, similarity double")

    edges = cut(edges)

    by_rank = lambda key, n: F.row_number().over(Window.partitionBy(key).orderBy(*n))
    few = copied.withColumn("n", by_rank("rep", ["id"])).where(f"n <= {k + 1}").select(F.col("rep").alias("y"), F.col("id").alias("member"))
    both = edges.select(F.col("a").alias("x"), F.col("b").alias("y"), "similarity").unionAll(edges.select("b", "a", "similarity"))
    of_class = both.join(few, "y", "left").select("x", F.coalesce("member", "y").alias("neighbour"), "similarity").unionAll(
        few.select(F.col("y").alias("x"), F.col("member").alias("neighbour"), F.lit(1.0).alias("similarity")))
    listed = of_class.withColumn("n", by_rank("x", [F.desc("similarity"), F.col("neighbour")])).where(f"n <= {k + 1}").drop("n")
    asking = listed.join(copied.withColumnRenamed("rep", "x"), "x", "left").select(F.coalesce("id", "x").alias("id"), "neighbour", "similarity").where("id <> neighbour")
    return asking.withColumn("rank", by_rank("id", [F.desc("similarity"), F.col("neighbour")])).where(f"rank <= {k}")
