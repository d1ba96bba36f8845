import random

import numpy as np
from pyspark.sql import functions as F

from mnemora.llm.contamination import edit_distances, leaked_passages, may_be_within

D, I = "doc_id long, text string, item string, edits string", "item_id long, text string, doc string"


def run(spark, docs, items, **more):
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in docs], D)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], I)
    return leaked_passages(d, F.col("doc_id"), F.col("text"), q, F.col("item_id"), F.col("text"), **more).collect()


def test_edit_distance():
    a, b = np.array([[1, 2, 3, 4], [1, 2, 3, 4], [1, 2, 3, 4]]), np.array([[1, 2, 3, 4], [2, 3, 4, 5], [9, 2, 3, 8]])
    assert edit_distances(a, b).tolist() == [0, 2, 2]
    # beginnings of b that are one longer or shorter: a word inserted, lost, changed
    long = np.array([[1, 9, 2, 3, 4], [1, 3, 4, 7, 8], [1, 2, 9, 4, 5]])
    assert edit_distances(a, long, 1).tolist() == [1, 1, 1]


def test_the_bound_loses_nothing():
    r = np.random.default_rng(0)
    a, b = r.integers(0, 3, (4000, 8)), r.integers(0, 3, (4000, 8))
    for k in range(4):
        assert may_be_within(a, b, k)[edit_distances(a, b) <= k].all()


def test_exact_passages_are_all_found_and_edited_ones_mostly(spark):
    r = random.Random(0)
    word = lambda: f"w{r.randrange(3000)}"
    items = [(k, " ".join(word() for _ in range(40))) for k in range(30)]
    docs, exact, edited = [], set(), set()
    for n in range(120):
        k = r.randrange(30)
        w = items[k][1].split()
        at = r.randrange(0, 26)
        part = w[at : at + 14]
        if n % 3 == 0:
            part[6] = "changed"
            edited.add((n, k))
        elif n % 3 == 1:
            exact.add((n, k))
        else:
            part = part[:11]
        docs.append((n, " ".join(word() for _ in range(30)) + ". " + ",  ".join(part).upper() + " " + " ".join(word() for _ in range(10))))
    got = run(spark, docs, items)
    assert {(x.doc, x.item) for x in got if x.edits == 0} == exact
    assert len(edited & {(x.doc, x.item) for x in got}) >= 0.9 * len(edited)
    # the same from the way that joins by a shuffle
    assert sorted(map(tuple, run(spark, docs, items, most_sent=0))) == sorted(map(tuple, got))


def test_inserted_lost_and_changed_words_are_found(spark):
    r = random.Random(1)
    word = lambda: f"v{r.randrange(5000)}"
    items = [(k, " ".join(word() for _ in range(40))) for k in range(40)]
    edits = {
        "inserted": lambda p: [*p[:8], "new", *p[8:]],
        "lost": lambda p: [*p[:8], *p[9:]],
        "changed": lambda p: [*p[:8], "other", *p[9:]],
        "lost at the end of the document": lambda p: [*p[:6], *p[7:12]],
    }
    for kind, edit in edits.items():
        docs = []
        for n in range(120):
            at = r.randrange(0, 24)
            tail = [] if kind.endswith("document") else [word() for _ in range(12)]
            docs.append((n, " ".join([*(word() for _ in range(20)), *edit(items[n % 40][1].split()[at : at + 16]), *tail])))
        got = {(x.doc, x.item) for x in run(spark, docs, items)}
        # 16 words with the edit inside hold several windows; the last case holds a single one
        assert len(got & {(n, n % 40) for n in range(120)}) >= 0.9 * 120, (kind, len(got))
        assert got <= {(n, n % 40) for n in range(120)}


def test_items_shorter_than_a_window_are_searched_whole(spark):
    docs = [(1, "so the quick brown fox jumps."), (2, "the quick brown cat"), (3, "quick brown fox jumps " + "x " * 20)]
    got = run(spark, docs, [(1, "Quick brown fox jumps"), (2, "the quick brown"), (3, "a b")])
    assert sorted((x.doc, x.item, x.doc_pos, x.edits) for x in got) == [(1, 1, 2, 0), (1, 2, 1, 0), (2, 2, 0, 0), (3, 1, 0, 0)]
    assert sorted(map(tuple, run(spark, docs, [(1, "Quick brown fox jumps"), (2, "the quick brown"), (3, "a b")], most_sent=0))) == sorted(map(tuple, got))


def test_null_short_and_empty(spark):
    text = " ".join(f"a{i}" for i in range(12))
    got = run(spark, [(1, None), (2, ""), (3, text), (None, text)], [(1, text), (2, "a b"), (3, None), (None, text)])
    assert [(x.doc, x.item, x.doc_pos) for x in got if not x.edits] == [(3, 1, 0)]
    # the same passage less its first word is within one edit, if it is met
    assert {(x.doc, x.item, x.doc_pos) for x in got if x.edits} <= {(3, 1, 1)}
    assert run(spark, [(1, text)], []) == [] and run(spark, [], [(1, text)]) == []
