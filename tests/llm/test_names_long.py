"""Names of many words are compared in all of them."""

import random
from itertools import permutations

from mnemora.llm.names import _least, _token_cost, align

WORDS = "northern harbour railway water bridge ferry".split()


def test_words_after_the_fifth_count():
    assert align("o", [*WORDS, "authority"], [*WORDS, "company"]) is None
    assert align("o", [*WORDS, "authority"], ["authority", *WORDS]) == "full"
    given = "anna berta clara dora".split()
    assert align("p", [*given, "emil"], [*given, "fritz"]) is None and align("p", [*given, "emil"], given) == "full"


def test_least_cost_is_that_of_all_permutations():
    rng = random.Random(1)
    pool = "robert bob rob r b wood woods wod anna ann william liam".split()
    for _ in range(300):
        a, b = sorted((rng.choices(pool, k=rng.randint(0, 4)), rng.choices(pool, k=rng.randint(0, 4))), key=len)
        costs = [[_token_cost(x, y, True) for x, y in zip(a, p)] for p in permutations(b, len(a))]
        assert _least(a, b, True) == min((round(sum(c), 9) for c in costs if None not in c), default=None)
