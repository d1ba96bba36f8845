import random
import re

from pyspark.sql import functions as F

from mnemora.llm.near_duplicates import _direct, _texts, _unsettled, _verify, near_duplicate_classes, siblings, similar_texts, star_edges

SCHEMA = "id long, text string, a string, class_id string"


def sets(t, n):
    w = re.findall(r"[^\W_]+", t.lower())
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def corpus(seed=0, n=40):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    out = []
    for _ in range(n):
        base = [r.choice(words) for _ in range(40)]
        for _ in range(r.randrange(1, 6)):
            t = list(base)
            for _ in range(r.randrange(0, 6)):
                t[r.randrange(len(t))] = r.choice(words)
            out.append(" ".join(t))
    return out


def test_links_equal_brute_force(spark):
    texts = corpus()
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    links, members = similar_texts(df, F.col("id"), F.col("text"), 2, 0.5)
    of = {}
    for m in members.collect():
        of.setdefault(m.text_id, []).append(m.id)
    got = {tuple(sorted((i, j))) for l in links.collect() for i in of[l.a] for j in of[l.b]}
    got |= {tuple(sorted((i, j))) for v in of.values() for i in v for j in v if i < j}
    s = [sets(t, 2) for t in texts]
    want = {(i, j) for i in range(len(s)) for j in range(i) if len(s[i] & s[j]) >= 0.5 * len(s[i] | s[j])}
    want = {tuple(sorted(p)) for p in want}
    assert got <= want and len(got) >= 0.98 * len(want)


def test_copies_short_null_long_and_empty(spark):
    long = " ".join(f"x{i}" for i in range(20_000))
    rows = [(1, "One two three four five six", "x", "y"), (2, "one,  TWO three four five six!", "x", "y"), (3, "", "x", "y"), (4, None, "x", "y"), (5, "short", "x", "y"), (6, long, "x", "y"), (7, long + " end", "x", "y"), (None, "one two", "x", "y")]
    got = {r.id: r.class_id for r in near_duplicate_classes(spark.createDataFrame(rows, SCHEMA), F.col("id"), F.col("text")).collect()}
    assert set(got) == {1, 2, 3, 5, 6, 7}
    assert got == {1: 1, 2: 1, 3: 3, 5: 5, 6: 6, 7: 6}
    assert near_duplicate_classes(spark.createDataFrame([], SCHEMA), F.col("id"), F.col("text")).collect() == []


def test_many_copies_make_no_links(spark):
    df = spark.range(3000).select("id", F.lit("the same words again and again here").alias("text"), F.lit("x").alias("a"), F.lit("y").alias("class_id"))
    links, members = similar_texts(df, F.col("id"), F.col("text"))
    assert links.count() == 0 and members.count() == 3000


def test_classes_equal_brute_force(spark):
    texts = corpus(3, 60)
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], SCHEMA)
    got = {r.id: r.class_id for r in near_duplicate_classes(df, F.col("id"), F.col("text"), 2, 0.7).collect()}
    s, least = [sets(t, 2) for t in texts], list(range(len(texts)))
    for _ in range(9):
        for i in range(len(s)):
            for j in range(i):
                if len(s[i] & s[j]) >= 0.7 * len(s[i] | s[j]):
                    least[i] = least[j] = min(least[i], least[j])
    assert sum(got[i] == least[i] for i in range(len(s))) >= 0.98 * len(s) and len(set(least)) < len(s)


def test_variants_of_one_text_cost_their_number(spark):
    """Three thousand variants, most of them nearer than the threshold: candidates grow with their number, not with its square."""
    r, n = random.Random(7), 3000
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(n):
        t = list(base)
        for _ in range(r.choice([1, 1, 2])):
            t[r.randrange(len(t))] = f"v{r.randrange(10**6)}"
        rows.append((i, " ".join(t), "x", "y"))
    df = spark.createDataFrame(rows, SCHEMA)
    _, texts = _texts(df.select("id", "text"), 5)
    stars = star_edges(texts, 0.8).cache()
    links = _verify(_direct(stars).distinct(), texts, 0.8).cache()
    left, spokes = _unsettled(stars, links)
    rest = siblings(left, spokes, 0.8, apart="k").distinct().count()
    assert stars.count() <= 42 * n and rest <= n, (stars.count(), rest)
    assert {v.class_id for v in near_duplicate_classes(df, F.col("id"), F.col("text")).collect()} == {0}
