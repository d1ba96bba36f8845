"""Near-duplicate texts by one-permutation hashing, banded buckets and star-shaped candidate edges."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.grouped import groups
from mnemora.operators.components import connected_components
from mnemora.sources import cut

#: Sign bits by which the members of a bucket are compared before they are linked.
SKETCH = 128
_KEYS = "key long, id long, s1 long, s2 long"


def words(text: Column) -> Column:
    """Maximal runs of Unicode letters and digits of the lower-cased text."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingles(tokens: Column, length: int) -> Column:
    """The distinct hashes of all runs of ``length`` adjacent words; none where there are fewer words."""
    n = F.size(tokens) - (length - 1)
    runs = F.transform(F.sequence(F.lit(1), n), lambda i: F.xxhash64(F.slice(tokens, i, length)))
    return F.when(n > 0, F.array_distinct(runs)).otherwise(F.array().cast("array<long>"))


def banding(threshold: float, bands: int, recall: float) -> int:
    """The most rows a band may have for pairs at the threshold still to meet with probability ``recall``."""
    rows = 1
    while rows < 32 and 1 - (1 - threshold ** (rows + 1)) ** bands >= recall:
        rows += 1
    return rows


@lru_cache(2)
def _probe_table(bins: int, tries: int, seed: int) -> np.ndarray:
    """Bins that an empty bin borrows from, by attempt; drawn once in a process."""
    return np.random.default_rng(seed).integers(0, bins, (tries, bins)).astype(np.int32)


def signatures(flat: np.ndarray, lengths: np.ndarray, bins: int, seed: int = 11) -> np.ndarray:
    """One-permutation signatures (texts x bins) of non-empty shingle sets, densified by independent attempts.

    Each shingle falls into one bin, which keeps its least value. An empty bin tries bins of its own fixed random
    order until it meets one that was filled, and copies that one's value.
    """
    n = len(lengths)
    mixed = _mix(flat, seed)
    row = np.repeat(np.arange(n), lengths)
    cell = row * bins + ((mixed >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64)
    out = np.full(n * bins, np.iinfo(np.uint64).max, np.uint64)
    np.minimum.at(out, cell, _mix(flat, seed + 1))
    filled = np.zeros(n * bins, bool)
    filled[cell] = True
    dense = out.copy()
    empty = np.flatnonzero(~filled)
    base, bin_ = empty - empty % bins, empty % bins
    for attempt in _probe_table(bins, 40 * bins, seed):
        if not len(empty):
            break
        source = base + attempt[bin_]
        ok = filled[source]
        dense[empty[ok]] = out[source[ok]]
        empty, base, bin_ = empty[~ok], base[~ok], bin_[~ok]
    return dense.reshape(n, bins)


def _mix(x: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit finaliser over shingle hashes."""
    h = x.view(np.uint64) + np.uint64(0x9E3779B97F4A7C15 * seed % 2**64)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def sign_sketch(flat: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 sign bits whose distance follows the angle between the texts' shingle sets."""
    starts = np.r_[0, np.cumsum(lengths)[:-1]]
    out = []
    for k in (3, 4):
        bits = np.unpackbits(_mix(flat, k).view(np.uint8).reshape(-1, 8), axis=1).astype(np.int16)
        votes = 2 * np.add.reduceat(bits, starts, axis=0, dtype=np.int32) - lengths[:, None]
        out.append(np.packbits(votes > 0, axis=1).view(np.int64).ravel())
    return out[0], out[1]


def _bands(bands: int, rows: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(5)
        odd = rng.integers(0, 2**63, (bands, rows), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        salt = rng.integers(0, 2**63, bands, dtype=np.uint64)
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                b = batch.slice(at, 2048)
                col = b.column(1)
                flat, lengths = col.flatten().to_numpy(), np.diff(col.offsets.to_numpy())
                s1, s2 = sign_sketch(flat, lengths)
                sig = signatures(flat, lengths, bands * rows).reshape(-1, bands, rows)
                key = _mix(((sig * odd).sum(axis=2, dtype=np.uint64) + salt).ravel(), 9).view(np.int64)
                each = lambda a: pa.array(np.repeat(a, bands))  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays([pa.array(key), each(b.column(0).to_numpy()), each(s1), each(s2)], ["key", "id", "s1", "s2"])

    return run


def _stars(most: int):  # noqa: ANN202
    """From bucket rows (key, order, id, s1, s2) sorted by key and order to edges (centre, id, s1, s2).

    The first member of a bucket is a centre and is linked with every later member whose sketch is near; members near
    no centre become centres in turn. So a bucket of n similar members gives n - 1 edges, and one of unrelated members
    none.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in groups(batches, 1):
            key, ids, s1, s2 = (table.column(i).to_numpy() for i in (0, 2, 3, 4))
            u1, u2 = s1.view(np.uint64), s2.view(np.uint64)
            live = np.arange(len(key))
            centres, members = [], []
            while len(live):
                k = key[live]
                first = np.r_[True, k[1:] != k[:-1]]
                lead = live[np.flatnonzero(first)[np.cumsum(first) - 1]]
                near = np.bitwise_count(u1[lead] ^ u1[live]).astype(np.int16) + np.bitwise_count(u2[lead] ^ u2[live]) <= most
                link = near & ~first
                centres.append(lead[link])
                members.append(live[link])
                live = live[~near]
            c, m = np.concatenate(centres), np.concatenate(members)
            keep = ids[c] != ids[m]
            c, m = c[keep], m[keep]
            if len(c):
                _, one = np.unique(np.stack([ids[c], ids[m]]), axis=1, return_index=True)
                c, m = c[one], m[one]
                yield pa.RecordBatch.from_arrays([pa.array(ids[c]), pa.array(s1[c]), pa.array(s2[c]), pa.array(ids[m]), pa.array(s1[m]), pa.array(s2[m])], ["c", "c1", "c2", "m", "m1", "m2"])

    return run


def _most(threshold: float, slack: float) -> int:
    """Sketch bits in which two texts at the threshold may differ."""
    angle = float(np.arccos(2 * threshold / (1 + threshold)) / np.pi)
    return int(SKETCH * angle + slack * np.sqrt(SKETCH * angle * (1 - angle)))


def _near(a: str, b: str, most: int) -> Column:
    return F.bit_count(F.col(f"{a}1").bitwiseXOR(F.col(f"{b}1"))) + F.bit_count(F.col(f"{a}2").bitwiseXOR(F.col(f"{b}2"))) <= most


def star_edges(texts: DataFrame, threshold: float, bands: int = 42, recall: float = 0.995, slack: float = 3.0) -> DataFrame:
    """Candidate edges (c, c1, c2, m, m1, m2) between distinct texts (id, set), with the sketches of their ends."""
    rows = banding(threshold, bands, recall)
    buckets = texts.where(F.size("set") > 0).select("id", "set").mapInArrow(_bands(bands, rows), _KEYS)
    # another order in each bucket, so that a stray text is not the centre in all buckets that two texts share
    ordered = buckets.repartition("key").select("key", F.xxhash64("key", "id").alias("o"), "id", "s1", "s2").sortWithinPartitions("key", "o")
    edges = ordered.mapInArrow(_stars(_most(threshold, slack)), "c long, c1 long, c2 long, m long, m1 long, m2 long")
    return edges.distinct()


def siblings(asked: DataFrame, spokes: DataFrame, threshold: float, apart: str | None = None, slack: float = 3.0) -> DataFrame:
    """Candidate pairs (a, b) of the texts ``asked`` (c, m, m1, m2) with the ``spokes`` (the same) around their centre, of near sketches.

    With ``apart``, a column of both, only those of different values are paired. A centre of many spokes is divided by
    the adaptive join.
    """
    x, y = asked.alias("x"), spokes.alias("y")
    met = x.join(y, (F.col("x.c") == F.col("y.c")) & (F.col("x.m") != F.col("y.m")) & _near("x.m", "y.m", _most(threshold, slack)) & (F.lit(True) if apart is None else F.col(f"x.{apart}") != F.col(f"y.{apart}")))
    return met.select(F.least("x.m", "y.m").alias("a"), F.greatest("x.m", "y.m").alias("b"))


def _verify(candidates: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a, b) with their exact Jaccard similarity, where it reaches the threshold."""
    t = texts.select("id", "set")
    both = candidates.join(t.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(t.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.select("a", "b", (common / (F.size("sa") + F.size("sb") - common)).alias("similarity")).where(F.col("similarity") >= threshold)


def _texts(rows: DataFrame, length: int) -> tuple[DataFrame, DataFrame]:
    """Rows (id, text) as members (id, text_id) and distinct texts (id, set)."""
    # exploded, as the optimizer would else put the expression for the words wherever they are used
    tokens = rows.where("id IS NOT NULL AND text IS NOT NULL").select("id", F.explode(F.array(words(F.col("text")))).alias("w"))
    sets = tokens.select("id", F.xxhash64("w").alias("text_id"), F.greatest(F.lit(0), F.size("w") - (length - 1)).alias("shingles"), shingles(F.col("w"), length).alias("set"))
    return sets.select("id", "text_id", "shingles"), sets.groupBy("text_id").agg(F.any_value("set").alias("set")).withColumnRenamed("text_id", "id")


def similar_texts(rows: DataFrame, row_id: Column, text: Column, length: int = 5, threshold: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """The links between different texts (a, b, similarity), and which row has which text (id, text_id, and shingles, the
    number of its runs of words).

    Texts are compared as sets of ``length`` adjacent words; texts of the same words in the same order are one text,
    whatever their case, blanks and punctuation. Links have a Jaccard similarity of at least ``threshold``. Null
    texts and ids are left out; texts of fewer than ``length`` words are members but have no links. Copies are not
    expanded into pairs. Text ids are 64-bit hashes of the words.

    Buckets give stars, not pairs; texts around one centre whose sketches are near are compared as well, since two
    texts may know each other only by their centre.
    """
    members, texts = _texts(rows.select(row_id.alias("id"), text.alias("text")), length)
    texts = cut(texts.where(F.size("set") > 0))
    stars = cut(star_edges(texts, threshold))
    spokes = stars.select("c", "m", "m1", "m2")
    links = cut(_verify(_direct(stars).unionAll(siblings(spokes, spokes, threshold)).distinct(), texts, threshold))
    return links, members


def _direct(stars: DataFrame) -> DataFrame:
    return stars.select(F.least("c", "m").alias("a"), F.greatest("c", "m").alias("b"))


def _unsettled(stars: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Spokes that the links leave in another class than their centre, and all spokes of those centres; both with their class k."""
    k = connected_components(links).select(F.col("node").alias("n"), F.col("component").alias("k"))
    of = lambda df, c, name: df.join(k.select(F.col("n").alias(c), F.col("k").alias(f"__{c}")), c, "left").withColumn(name, F.coalesce(f"__{c}", c)).drop(f"__{c}")
    both = cut(of(of(stars.select("c", "m", "m1", "m2"), "c", "kc"), "m", "k"))
    left = both.where("k <> kc").drop("kc")
    return left, both.drop("kc").join(left.select("c").distinct(), "c", "left_semi")


def near_duplicate_classes(rows: DataFrame, row_id: Column, text: Column, length: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row for each row with a text: id, text_id, class_id (the least id of the class).

    A class is a connected component of the links between texts (see ``similar_texts``); equal texts share a class,
    and texts of fewer than ``length`` words have one of their own. Rows with a null id or text have no row here.

    Texts are linked with the centres of their stars first. Only those left in another class than their centre are
    then held against its other spokes, of other classes than their own: a pair within a class can't change it. So
    the variants of one text cost their number of candidates, not its square; texts around one centre that resemble
    each other less than the threshold, but have near sketches, still cost a comparison each.
    """
    members, texts = _texts(rows.select(row_id.alias("id"), text.alias("text")), length)
    texts = cut(texts.where(F.size("set") > 0))
    stars = cut(star_edges(texts, threshold))
    links = cut(_verify(_direct(stars).distinct(), texts, threshold))
    left, spokes = _unsettled(stars, links)
    if not left.isEmpty():
        links = cut(links.unionAll(_verify(siblings(left, spokes, threshold, apart="k").distinct(), texts, threshold)))
    classes = connected_components(links).select(F.col("node").alias("text_id"), F.col("component").alias("class"))
    known = members.join(classes, "text_id", "left").select("id", "text_id", F.coalesce("class", "text_id").alias("class"))
    least = known.groupBy("class").agg(F.min("id").alias("class_id"))
    return known.join(least, "class").select("id", "text_id", "class_id")
