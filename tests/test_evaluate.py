from mnemora.operators import evaluate


def test_dataset_is_seeded_and_in_order():
    said, asked = evaluate.dataset(3, 20)
    assert (said, asked) == evaluate.dataset(3, 20) != evaluate.dataset(4, 20)
    assert [s[0] for s in said] == list(range(1, len(said) + 1)) and [s[-1] for s in said] == sorted(s[-1] for s in said)
    assert sum(q[1] == "changing" for q in asked) == 20 and sum(q[1] == "steady" for q in asked) == 40 and sum(q[1] == "two steps" for q in asked) == 10


def test_the_ledger_keeps_one_value_and_links_objects(spark):
    said, asked = evaluate.dataset(3, 20)
    memories, entities = evaluate.loaded(spark, said, True)
    active = memories.where("status = 'active' AND relation IS NOT NULL")
    latest = {q[3] for q in asked if q[1] == "changing"}
    rows = active.where("domain = 'identity'").collect()
    assert len(rows) == 20 and {r.object_text for r in rows} == latest
    assert active.where("object_entity_id IS NOT NULL").count() == 10 and entities.count() >= 20
    notes, _ = evaluate.loaded(spark, said, False)
    assert notes.where("status = 'active'").count() == len(said)


def test_scores(spark):
    q = spark.createDataFrame([(1, "changing", "q", "new", ["old"], None), (2, "changing", "q", "new", ["old"], None), (3, "changing", "q", "new", ["old"], None), (4, "steady", "q", None, [], "text"), (5, "two steps", "q", None, [], "other")], evaluate.QUESTIONS)
    m = spark.createDataFrame([(10, "the new one"), (11, "the old one"), (12, "text")], "id long, content string")
    hits = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 11, 1), (2, 10, 2), (4, 11, 1), (4, 12, 5), (5, 12, 1)], "query long, id long, rank int")
    assert tuple(evaluate.scored(hits, q, m).first()) == (0.3333, 0.3333, 0.3333, 1.0, 0.0)
