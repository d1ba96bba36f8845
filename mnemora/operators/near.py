"""Rows of nearly equal vectors, by banded sign bits: for similarities well above those of unrelated vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mnemora.functions.vectors import usable
from mnemora.operators.search import ranked
from mnemora.operators.writing import numbered
from mnemora.sources import cut

#: Bands of sign bits, and the chance that a pair at the least similarity shares none.
BANDS, LOST = 128, 1e-6
#: Bits by which members of a bucket are screened, and the deviations beyond the expectation that pass.
SKETCH, SLACK = 128, 4.5


def band_bits(least: float) -> int:
    """The most bits a band may have for a pair at the least similarity to share one of all bands but with probability ``LOST``."""
    same = 1 - math.acos(least) / math.pi
    return max(1, math.floor(math.log(1 - LOST ** (1 / BANDS)) / math.log(same)))


def _unit(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _banded(dim: int, bits: int):  # noqa: ANN202
    """From (id, v) to (id, keys, s1, s2)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(17)
        axes = rng.standard_normal((dim, BANDS * bits + SKETCH)).astype(np.float32)
        weights = np.left_shift(np.int64(1), np.arange(64, dtype=np.int64))
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                on = (_unit(b.column(1)).astype(np.float32) @ axes > 0).astype(np.int64)
                keys = on[:, : BANDS * bits].reshape(len(on), BANDS, bits) @ weights[:bits] + (np.arange(BANDS, dtype=np.int64) << np.int64(48))
                s = [pa.array(on[:, i : i + 64] @ weights) for i in (BANDS * bits, BANDS * bits + 64)]
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS, dtype=np.int32)), pa.array(keys.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0), lists, *s], ["id", "keys", "s1", "s2"])

    return run


def _met(most: int):  # noqa: ANN202
    """From (key, id, s1, s2) sorted by key to pairs (a, b) of one key with near sketches; a key's members are held as 24 bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(rows: np.ndarray) -> Iterator[pa.RecordBatch]:
            key, ids, s1, s2 = rows
            s1, s2 = s1.view(np.uint64), s2.view(np.uint64)
            size = np.diff(np.r_[np.flatnonzero(np.r_[True, key[1:] != key[:-1]]), len(key)])
            last = np.repeat(np.cumsum(size), size)
            i, d = np.arange(len(key)), 1
            while len(i):
                i = i[i + d < last[i]]
                near = i[np.bitwise_count(s1[i] ^ s1[i + d]).astype(np.int16) + np.bitwise_count(s2[i] ^ s2[i + d]) <= most]
                if len(near):
                    x, y = ids[near], ids[near + d]
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])
                d += 1

        for b in batches:
            if not b.num_rows:
                continue
            rows = np.stack([b.column(i).to_numpy() for i in range(4)])
            turn = np.flatnonzero(np.r_[held[-1][0, -1] != rows[0, 0] if held else False, rows[0, 1:] != rows[0, :-1]])
            if len(turn):
                done = np.concatenate([*held, rows[:, : turn[-1]]], axis=1)
                if done.shape[1]:
                    yield from flush(done)
                held = [rows[:, turn[-1] :]]
            else:
                held.append(rows)
        if held:
            yield from flush(np.concatenate(held, axis=1))

    return run


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            s = np.einsum("ij,ij->i", _unit(b.column(2)), _unit(b.column(3))).round(6)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(s)], ["a", "b", "similarity"])


def near_later(rows: DataFrame, dim: int, k: int, least: float) -> DataFrame:
    """For each row (id, v) its k most similar rows of larger ids, of a cosine from ``least`` on: query, id, similarity, rank.

    As ``search.vector_topk`` with side 'later', without holding every row against every other: a pair at ``least`` is
    missed with a probability of a millionth (``LOST``), nearer ones with less. Equal vectors are one in the search, and
    their rows are put in by place afterwards, so copies cost their number (once more for each class linked with theirs). Unusable vectors take no part.
    """
    t = rows.select("id", "v").where(usable(F.col("v"), dim))
    printed = t.select("id", F.xxhash64("v").alias("h1"), F.xxhash64(F.lit(1), "v").alias("h2"))
    # places within a class by a range sort, so a class of any size spreads over as many tasks as it needs
    placed_all = cut(numbered(printed, ["h1", "h2", "id"], "n", 1))
    begin = placed_all.groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.min("n").alias("n0"))
    member = cut(placed_all.join(begin, ["h1", "h2"]).select("id", "rep", (F.col("n") - F.col("n0") + 1).cast("int").alias("pos")))
    first = t.join(member.where("id = rep").select("id"), "id", "left_semi")
    bits = band_bits(least)
    angle = math.acos(least) / math.pi
    most = math.floor(SKETCH * angle + SLACK * math.sqrt(SKETCH * angle * (1 - angle)))
    entries = first.mapInArrow(_banded(dim, bits), "id long, keys array<long>, s1 long, s2 long").select(F.explode("keys").alias("key"), "id", "s1", "s2")
    met = cut(entries.repartition("key").sortWithinPartitions("key").mapInArrow(_met(most), "a long, b long").distinct())
    both = met.join(first.toDF("a", "va"), "a").join(first.toDF("b", "vb"), "b").select("a", "b", "va", "vb")
    links = cut(both.mapInArrow(_measured, "a long, b long, similarity double").where(F.col("similarity") >= least))
    # answers of a row's own class: the members after it; of a linked class: those after the place the row would have there
    own = member.select(F.col("id").alias("query"), F.col("rep").alias("of"), "pos", F.lit(1.0).alias("similarity"))
    ways = links.select(F.col("a").alias("rep"), F.col("b").alias("of"), "similarity").unionAll(links.select("b", "a", "similarity"))
    asks = ways.join(member, "rep").select("of", "rep", "similarity", F.col("id").alias("at"), F.lit(1).alias("asks"))
    stands = ways.join(member.select(F.col("rep").alias("of"), F.col("id").alias("at")), "of").select("of", "rep", "similarity", "at", F.lit(0).alias("asks"))
    upto = Window.partitionBy("of", "rep").orderBy("at", "asks").rowsBetween(Window.unboundedPreceding, 0)
    placed = asks.unionByName(stands).withColumn("pos", F.sum(1 - F.col("asks")).over(upto)).where("asks = 1").select(F.col("at").alias("query"), "of", "pos", "similarity")
    wanted = own.unionByName(placed.select("query", "of", F.col("pos").cast("int").alias("pos"), "similarity")).select("query", "of", "similarity", F.explode(F.sequence(F.col("pos") + 1, F.col("pos") + k)).alias("pos"))
    found = wanted.join(member.select("id", F.col("rep").alias("of"), "pos"), ["of", "pos"])
    return ranked(found.select("query", "id", "similarity"), "query", [F.desc("similarity"), F.col("id")], k)
