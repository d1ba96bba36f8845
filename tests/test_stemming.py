import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from mnemora.functions.stemming import plain_words, stem, stemmed_tokens
from mnemora.operators.search import bm25_topk, phrase_postings, postings


def index(texts):
    c = sqlite3.connect(":memory:")
    try:
        c.execute("CREATE VIRTUAL TABLE f USING fts5(t, tokenize = 'porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text index here")
    c.executemany("INSERT INTO f(rowid, t) VALUES (?, ?)", enumerate(texts))
    return c


WORDS = """caresses ponies ties cats feed agreed plastered motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional
rational valency hesitancy digitizer conformably radically differently vilely analogously vietnamization predication operator feudalism decisiveness hopefulness callousness formality
sensitivity sensibility triplicate formative formalize electricity electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement
adjustment dependent adoption homologou communism activate angularity homologous effective bowdlerize probate rate cease controll roll archaeology étions über naïve niños x2 go""".split()


def test_stems_meet_the_same_words_as_the_index():
    c = index(WORDS)
    for w in WORDS:
        q = plain_words(w)
        got = {r[0] for r in c.execute("SELECT rowid FROM f WHERE f MATCH ?", (" ".join(f'"{x}"' for x in q),))}
        assert got == {i for i, v in enumerate(WORDS) if [stem(x) for x in plain_words(v)] == [stem(x) for x in q]}, w


def test_scores_equal_the_index(spark):
    r = random.Random(0)
    texts = [" ".join(r.choice(WORDS) for _ in range(r.randrange(3, 30))) for _ in range(120)]
    c = index(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    ask = ["relational", "motoring", "niños"]
    terms = spark.createDataFrame([(1, stem(x)) for w in ask for x in plain_words(w)], "query long, term string")
    got = {x.id: x.score for x in bm25_topk(terms, postings(df, stemmed_tokens(F.col("t"))), 1000).collect()}
    want = {i: -s for i, s in c.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (" OR ".join(f'"{w}"' for w in ask),))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)


def test_phrases_equal_the_index(spark):
    r = random.Random(1)
    words = ["svc", "9", "1", "alpha", "running", "ports"]
    texts = [" ".join(r.choice(words) for _ in range(r.randrange(1, 25))) for _ in range(150)] + ["svc-9.1 is down", "9 1 svc", "1 1 1 1"]
    c = index(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "id long, t string").select("id", stemmed_tokens(F.col("t")).alias("w"))
    ask = ["svc-9.1", "running ports", "1 1", "alpha"]
    terms = spark.createDataFrame([(1, " ".join(stem(x) for x in plain_words(w))) for w in ask], "query long, term string")
    both = postings(df, F.col("w")).unionByName(phrase_postings(df, F.col("w"), terms))
    got = {x.id: x.score for x in bm25_topk(terms, both, 1000).collect()}
    want = {i: -s for i, s in c.execute("SELECT rowid, bm25(f) FROM f WHERE f MATCH ?", (" OR ".join(f'"{w}"' for w in ask),))}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in got)
