"""Evaluation passages inside a corpus: CGK embedding, bit-sampling LSH over windows, exact edit verification."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mnemora.llm.near_duplicates import words
from mnemora.sources import cut

#: Tables that share a walk.
PER_WALK = 2
#: Bytes up to which the items' windows are sent to every executor; more of them are joined by a shuffle.
MOST_SENT = 48_000_000
#: Bits of the screen (as powers of two) at least and at most, bits for each key, and positions a key has in it.
SCREEN_LEAST, SCREEN_MOST, SCREEN_BITS, SCREEN_MARKS = 20, 30, 16, 3
#: Items of fewer words than a window are searched whole, as windows of their own length, down to this many words.
SHORTEST = 3
#: Stands for the words beyond a document's end; equal to no word.
_BEYOND = np.int64(-0x5DEECE66D0B5E55)


def _keys(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray, window: int, tables: int, sampled: int, seed: int) -> np.ndarray:
    """LSH keys (windows x tables) of the windows of ``flat`` that begin at ``starts`` and have ``lengths`` words.

    A walk reads a window's words for 3 * window steps; whether it moves on after a step is a random bit of the step
    and the word just read, the same for all windows. So an edit shifts the walks of two windows apart only until they
    meet again, and edit distance becomes Hamming distance. Each table samples some of the steps of one walk; every
    ``PER_WALK`` tables have a walk of their own.
    """
    rng = np.random.default_rng(seed)
    steps = 3 * window
    ended = rng.integers(1, 2**63, dtype=np.uint64)
    keys = np.zeros((len(starts), tables), np.uint64)
    if not len(starts):
        return keys.view(np.int64)
    low = int(starts.min())
    words_ = flat.view(np.uint64)[low : int(starts.max()) + window]
    starts, last = starts - low, len(words_) - 1
    spread = words_ ^ (words_ >> np.uint64(29))
    for first in range(0, tables, PER_WALK):
        moves = rng.integers(0, 2**63, steps, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        sample: dict[int, list[tuple[int, np.uint64]]] = {}
        for t in range(first, min(first + PER_WALK, tables)):
            for j in rng.choice(steps, min(sampled, steps), replace=False):
                sample.setdefault(int(j), []).append((t, rng.integers(0, 2**63, dtype=np.uint64) * np.uint64(2) + np.uint64(1)))
        at = np.zeros(len(starts), np.int64)
        for j in range(max(sample) + 1):
            where = np.minimum(starts + at, last)
            if j in sample:
                word = np.where(at < lengths, spread[where], ended)
                for t, odd in sample[j]:
                    keys[:, t] += word * odd
            at += ((words_ * moves[j]) >> np.uint64(63)).astype(np.int64)[where]  # beyond its window a walk may move on, unread
    keys ^= keys >> np.uint64(31)
    return (keys * np.uint64(0x9E3779B97F4A7C15) + np.arange(tables, dtype=np.uint64)).view(np.int64)


def _marks(keys: np.ndarray, bits: int) -> list[np.ndarray]:
    """The positions of keys in a screen of 2**bits bits."""
    odd = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)[:SCREEN_MARKS]
    return [((keys.view(np.uint64) * np.uint64(m)) >> np.uint64(64 - bits)).view(np.int64) for m in odd]


def _each_window(b: pa.RecordBatch, window: int, slack: int, chunk: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """The windows of a batch of (id, word hashes): flat words, row, place, start and length of each; the last ``slack`` ones of a row are shorter."""
    col = b.column(1)
    flat, offsets = col.flatten().to_numpy(), col.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0] if len(offsets) else offsets
    n = np.maximum(0, np.diff(offsets) - (window - slack) + 1)
    row = np.repeat(np.arange(len(n)), n)
    pos = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    for s in range(0, len(row), chunk):
        r, p = row[s : s + chunk], pos[s : s + chunk]
        starts = offsets[r] + p
        yield flat, r, p, starts, np.minimum(window, offsets[r + 1] - starts)


def _read(flat: np.ndarray, starts: np.ndarray, ends: np.ndarray, size: int) -> np.ndarray:
    """``size`` words from each start, those at or beyond its end marked as such."""
    at = starts[:, None] + np.arange(size)
    return np.where(at < ends[:, None], flat[np.minimum(at, len(flat) - 1)], _BEYOND)


def _windows(window: int, slack: int, tables: int, sampled: int, seed: int, screen: bytes | None, chunk: int = 1 << 16):  # noqa: ANN202
    """From (id, list of word hashes) to (id, pos, keys, win), of all windows or those with a key in the screen."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed = None if screen is None else np.frombuffer(screen, np.uint8)
        bits = 0 if packed is None else int(len(packed) * 8).bit_length() - 1
        for b in batches:
            for flat, r, p, starts, lengths in _each_window(b, window, slack, chunk):
                keys = _keys(flat, starts, lengths, window, tables, sampled, seed)
                hit = np.ones(keys.shape, bool)
                if packed is not None:
                    for m in _marks(keys, bits):
                        hit &= (packed[m >> 3] >> (m & 7).astype(np.uint8) & 1).astype(bool)
                    some = hit.any(axis=1)
                    r, p, starts, keys, hit = r[some], p[some], starts[some], keys[some], hit[some]
                if not len(r):
                    continue
                lists = lambda v, size: pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(size)].astype(np.int32)), pa.array(v))
                offsets = b.column(1).offsets.to_numpy().astype(np.int64)
                win = _read(flat, starts, offsets[r + 1] - offsets[0], window + slack)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(r)), pa.array(p.astype(np.int32)), lists(keys[hit], hit.sum(1)), lists(win.ravel(), np.full(len(r), window + slack))],
                    ["id", "pos", "keys", "win"])

    return run


def edit_distances(a: np.ndarray, b: np.ndarray, most: int = 0) -> np.ndarray:
    """Least Levenshtein distances of the rows of ``a`` to beginnings of the rows of ``b``, of all pairs of rows at once.

    The beginnings have as many symbols as ``a``, or up to ``most`` more or fewer; with 0 and rows of one length it is
    the plain distance.
    """
    n, w = a.shape
    last = np.tile(np.arange(b.shape[1] + 1, dtype=np.int16), (n, 1))
    for i in range(w):
        now = np.empty_like(last)
        now[:, 0] = i + 1
        for j in range(b.shape[1]):
            now[:, j + 1] = np.minimum(np.minimum(now[:, j], last[:, j + 1]) + 1, last[:, j] + (a[:, i] != b[:, j]))
        last = now
    return last[:, max(0, w - most) : w + most + 1].min(axis=1)


def may_be_within(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    """False where more than ``most`` symbols of ``a`` stand nowhere near in ``b``, so that more edits are needed.

    With at most k edits a kept symbol moves by at most k places, and at most k symbols aren't kept.
    """
    w, v = a.shape[1], b.shape[1]
    kept = np.zeros(a.shape, bool)
    for shift in range(-most, most + 1):
        i, end = max(0, -shift), min(w, v - shift)
        kept[:, i:end] |= a[:, i:end] == b[:, i + shift : end + shift]
    return w - kept.sum(axis=1) <= most


def _verify(window: int, most: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = b.column("win").flatten().to_numpy().reshape(-1, window + most), b.column("item_win").flatten().to_numpy().reshape(-1, window)
            near = np.flatnonzero(may_be_within(y, x, most))
            d = edit_distances(y[near], x[near], most)
            ok = near[d <= most]
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(pa.array(ok)) for c in ("doc", "item", "doc_pos", "item_pos")), pa.array(d[d <= most].astype(np.int32))], ["doc", "item", "doc_pos", "item_pos", "edits"])

    return run


def _matches(window: int, tables: int, sampled: int, seed: int, most: int, items: pa.Table, chunk: int = 1 << 16):  # noqa: ANN202
    """From (id, list of word hashes) to verified rows, with all windows of the items at hand."""
    item_keys = items["keys"].combine_chunks().flatten().to_numpy()
    order = np.argsort(item_keys, kind="stable")
    sorted_keys, owner = item_keys[order], (order // tables).astype(np.int64)
    item_win = items["win"].combine_chunks().flatten().to_numpy().reshape(-1, window)
    item_id, item_pos = items["id"].combine_chunks(), items["pos"].combine_chunks()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = np.zeros(1 << 22, bool)
        screen[sorted_keys.view(np.uint64) >> np.uint64(64 - 22)] = True
        for b in batches:
            offsets = b.column(1).offsets.to_numpy().astype(np.int64)
            offsets = offsets - offsets[0] if len(offsets) else offsets
            for flat, r, p, starts, lengths in _each_window(b, window, most, chunk):
                keys = _keys(flat, starts, lengths, window, tables, sampled, seed).ravel()
                maybe = np.flatnonzero(screen[keys.view(np.uint64) >> np.uint64(64 - 22)])
                at = np.searchsorted(sorted_keys, keys[maybe])
                same = sorted_keys[np.minimum(at, len(sorted_keys) - 1)] == keys[maybe]
                hit, at = maybe[same], at[same]
                if not len(hit):
                    continue
                size = np.searchsorted(sorted_keys, keys[hit], side="right") - at
                each = np.repeat(np.arange(len(hit)), size)
                inside = np.arange(len(each)) - np.repeat(np.cumsum(size) - size, size)
                pairs = np.unique((hit[each] // tables) * len(item_win) + owner[at[each] + inside])
                for t in range(0, len(pairs), chunk):
                    w, i = np.divmod(pairs[t : t + chunk], len(item_win))
                    win = _read(flat, starts[w], offsets[r[w] + 1], window + most)
                    near = may_be_within(item_win[i], win, most)
                    w, i, win = w[near], i[near], win[near]
                    d = edit_distances(item_win[i], win, most)
                    ok = d <= most
                    w, i = w[ok], i[ok]
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(r[w])), item_id.take(pa.array(i)), pa.array(p[w].astype(np.int32)), item_pos.take(pa.array(i)), pa.array(d[ok].astype(np.int32))],
                        ["doc", "item", "doc_pos", "item_pos", "edits"])

    return run


def _screen(keys: DataFrame, n: int) -> bytes:
    """A bitmap of the marks of ``n`` keys, put together on the executors in blocks of 4 KB."""
    bits = min(SCREEN_MOST, max(SCREEN_LEAST, (SCREEN_BITS * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for m in _marks(b.column(0).to_numpy(), bits):
                yield pa.RecordBatch.from_arrays([pa.array(m)], ["m"])

    blocks = keys.mapInArrow(run, "m long").groupBy((F.expr("m div 32768")).alias("block")).agg(F.bitmap_construct_agg(F.col("m") % 32768).alias("b"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks.toLocalIterator():
        out[row["block"] * 4096 : (row["block"] + 1) * 4096] = np.frombuffer(row["b"], np.uint8)
    return out.tobytes()


def leaked_passages(
    docs: DataFrame, doc_id: Column, text: Column, items: DataFrame, item_id: Column, item_text: Column,
    window: int = 12, max_edits: int = 1, tables: int = 8, sampled: int = 6, seed: int = 3, most_sent: int = MOST_SENT,
) -> DataFrame:
    """Passages of items that stand in documents: doc, item, doc_pos, item_pos, edits (0 to ``max_edits``).

    A passage is ``window`` consecutive words of an item, at any place of it; one row comes out for each of them and
    each place of a document from which so many words, or up to ``max_edits`` more or fewer, differ from it by at most
    ``max_edits`` words inserted, lost and changed. Passages without edits are always found; those with edits with the
    recall that ``tables`` and ``sampled`` give. An item of fewer words (at least ``SHORTEST``) is one passage, searched
    whole and without edits. Null texts and ids and shorter items give no rows. Words are maximal runs of letters and
    digits in lower case. Input columns are reached only through the given expressions.

    All windows of all documents are embedded and hashed on the executors. Items whose windows fit ``most_sent`` bytes
    are sent there, and candidates are verified where they are found. Beyond that, a bitmap of the items' keys is sent
    (``SCREEN_BITS`` bits a key, at most 2**``SCREEN_MOST``; beyond that it screens less), so mostly windows that have
    a partner leave the scan, and the keys are joined by a shuffle. Both ways give the same rows.
    """
    hashed = lambda df, i, t: df.select(i.alias("id"), F.transform(words(t), lambda w: F.xxhash64(w)).alias("w")).where(F.col("id").isNotNull())
    d, q = hashed(docs, doc_id, text), hashed(items, item_id, item_text).where(F.size("w") >= min(SHORTEST, window))
    types = f"doc {d.schema['id'].dataType.simpleString()}, item {q.schema['id'].dataType.simpleString()}, doc_pos int, item_pos int, edits int"
    length = F.least(F.size("w"), F.lit(window))
    # at most ``window`` lengths
    sizes = q.groupBy(length.alias("length")).agg(F.sum(F.size("w") - length + 1).alias("n")).collect()
    found = []
    for size, n in sorted(map(tuple, sizes)):
        whole = size < window
        of_size = q.where((F.size("w") == size) if whole else (F.size("w") >= window))
        found.append(_found(d, of_size, n, size, 0 if whole else max_edits, 1 if whole else tables, size if whole else sampled, seed, most_sent, types))
    return reduce(DataFrame.unionAll, found) if found else d.sparkSession.createDataFrame([], types)


def _found(d: DataFrame, q: DataFrame, n: int, window: int, most: int, tables: int, sampled: int, seed: int, most_sent: int, types: str) -> DataFrame:
    """Passages of one length; ``n`` is the number of windows of the items."""
    schema = lambda df: f"id {df.schema['id'].dataType.simpleString()}, pos int, keys array<long>, win array<long>"
    d = d.where(F.size("w") >= window - most)
    windows = q.mapInArrow(_windows(window, 0, tables, sampled, seed, None), schema(q))
    if n * (8 * window + 12 * tables) <= most_sent:
        return d.mapInArrow(_matches(window, tables, sampled, seed, most, windows.toArrow()), types).distinct()
    iw = cut(windows.select(F.explode("keys").alias("key"), F.col("id").alias("item"), F.col("pos").alias("item_pos"), F.col("win").alias("item_win")))
    screen = _screen(iw.select("key"), n * tables)
    dw = d.mapInArrow(_windows(window, most, tables, sampled, seed, screen), schema(d)).select(F.explode("keys").alias("key"), F.col("id").alias("doc"), F.col("pos").alias("doc_pos"), "win")
    met = dw.join(iw.hint("merge"), "key").drop("key")
    return met.mapInArrow(_verify(window, most), types).distinct()
