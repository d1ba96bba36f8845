"""Seeds of the graph channel."""

import __spark_entry__ as entry
from mnemora.operators.entities import seeds
from tests.conftest import SF


def test_queries_without_names_start_from_the_best_by_words(spark):
    e = spark.createDataFrame([
        (1, "Harbour Office", None), (2, "Harbour Water Authority", ["HWA"]), (3, "Quist", ["Lantern Quay", None]), (4, "Old Mill", []), (5, "Harbour Crane Works", []), (6, "Station", []), (7, "Fish Market", []), (8, "Chapel", []), (9, "Bakery", [])],
        "id long, name string, aliases array<string>")
    q = spark.createDataFrame([(10, "Ask the Harbour Office."), (11, "which harbour crane"), (12, "a lantern was found"), (13, "nothing at all"), (14, None)], "id long, content string")
    got = {(r.id, r.entity_id, r.weight) for r in seeds(q, e).collect()}
    assert got == {(10, 1, 1.0), (11, 5, 0.5), (11, 1, 0.5), (11, 2, 0.5), (12, 3, 0.5)}


def test_no_query_is_left_without_seeds_where_words_meet(spark):
    q = entry.queries()
    named, whole = q["entity_seeds_named"](spark, SF), q["entity_seeds"](spark, SF)
    assert named.exceptAll(whole).isEmpty() and set(whole.select("weight").distinct().toPandas().weight) <= {1.0, 0.5}
    assert whole.groupBy("id").count().join(named.select("id").distinct(), "id", "left_anti").where("count > 3").isEmpty()
