"""Candidates: no caps on words, blocks that stay small, short and long tokens."""

import random

from pyspark.sql import functions as F

from mnemora.llm.names import candidates, deletes, roots, short_form, within_one
from tests.llm.test_names import run


def test_short_forms_by_rule_and_list():
    assert short_form("ben", "benjamin") and short_form("tommy", "thomas") is False and short_form("sammy", "samantha") and short_form("will", "william") and not short_form("jo", "joseph")
    assert short_form("sunny", "sunniva") and not short_form("anna", "andrew") and roots("bill") & roots("william") and roots("nick") & roots("nicholas")


def test_tokens_one_edit_apart_share_a_key():
    r = random.Random(2)
    for n in [*range(3, 12), *range(60, 70), 200]:
        for _ in range(40):
            a = "".join(r.choice("abcdefg") for _ in range(n))
            i = r.randrange(n)
            b = r.choice([a[:i] + a[i + 1 :], a[:i] + "x" + a[i:], a[:i] + "x" + a[i + 1 :], a[:i] + a[i : i + 2][::-1] + a[i + 2 :]])
            assert within_one(a, b) and deletes(a) & deletes(b), (a, b)


def test_words_beyond_the_fifth_and_short_names(spark):
    rows = [
        (1, "Zelmarden River Valley Flood Relief Water Council", [], "org"), (2, "Zelmarden River Valley Flood Relief Water Committee", [], "org"),
        (3, "Anna Maria Lucia Clara Eva Tolmidor", [], "person"), (4, "Anna Maria Lucia Clara Ida Tolmidor", [], "person"), (5, "Bo Li", [], "person"), (6, "B. Li", [], "person")]
    others = [(100 + i, f"{w} Council", [], "org") for i, w in enumerate("River Valley Flood Relief Water".split())] + [(200 + i, f"Anna Maria {w}", [], "person") for i, w in enumerate("Lucia Clara Eva Ida".split())]
    c = run(spark, rows + others)
    assert c[1] != c[2] and c[3] != c[4] and c[5] == c[6]


def test_blocks_stay_small_where_tokens_are_dense(spark):
    """Twenty thousand invented surnames of 4 to 8 letters, whose edits chain most of them together: no name meets many."""
    r = random.Random(3)
    sound = lambda: r.choice("bdfgklmnprstvz") + r.choice("aeiou")
    names = sorted({(r.choice(["anna", "boris", "clara", "david"]), "".join(sound() for _ in range(r.randint(2, 4)))) for _ in range(20_000)})
    rows = [(i + 1, "p", list(t)) for i, t in enumerate(names)]
    pairs, _ = candidates(spark.createDataFrame(rows, "name long, form string, tokens array<string>"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("name")).groupBy("name").count().agg(F.max("count"), F.sum("count")).first()
    # a surname of two syllables has at most 2 * (13 + 4) one letter away, beside its longer and shorter kin
    assert ends[0] <= 200 and ends[1] <= 40 * len(rows), ends
