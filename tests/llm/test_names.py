from pyspark.sql import functions as F

from mnemora.llm.names import align, link_names, parse_name, shortens, within_one

SCHEMA = "id long, name string, aliases array<string>, kind string, class_id string, form string"


def run(spark, rows):
    df = spark.createDataFrame([(i, n, a, k, "x", "y") for i, n, a, k in rows], SCHEMA)
    return {r.id: r.class_id for r in link_names(df, F.col("id"), F.col("name"), F.col("aliases"), F.col("kind")).collect()}


def test_edits():
    assert within_one("abcd", "abdc") and within_one("abcd", "abd") and within_one("abcd", "abxd") and within_one("abcd", "xabcd") and not within_one("abcd", "badc")
    assert shortens("rly", "railway") and not shortens("xly", "railway")


def test_parsing():
    assert parse_name("Dr. Anna Bírkalo.", "person") == ("p", ["anna", "birkalo"])
    assert parse_name("BIRKALO, Anna", None) == ("p", ["anna", "birkalo"])
    assert parse_name("AnnaBirkalo", "org") == ("p", ["anna", "birkalo"])
    assert parse_name("The Water Co-op of Marden", None) == ("o", ["water", "cooperative", "marden"])
    assert parse_name("  ", None) is None and parse_name(None, None) is None


def test_alignment():
    assert align("p", ["victoria"], ["vicky"]) == "full" and align("p", ["v"], ["vicky"]) == "weak" and align("p", ["anna"], ["vera"]) is None
    assert align("p", ["milos", "b"], ["milos", "benjamin"]) == "full" and align("p", ["milos", "karl"], ["milos", "benjamin"]) is None
    assert align("o", ["water", "authority"], ["authority", "water"]) == "full" and align("o", ["wa"], ["water", "authority"]) == "weak" and align("o", ["water", "company"], ["water", "authority"]) is None


def test_variants_link_and_namesakes_do_not(spark):
    rows = [
        (1, "Victoria Halmarend", None, "person"), (2, "Vicky Halmarend", [], "person"), (3, "Halmarend, V.", [None, " "], None), (4, "Victoria Halmarned", [], "Person"), (5, "Robert Halmarend", [], "person"),
        (6, "Marbury Water Authority", ["Marbury WA"], "org"), (7, "Authority of Water, Marbury", [], "organisation"), (8, "Marbury Railway Authority", [], "org"), (9, "Marbury Rly Auth.", [], "org"),
        (10, "zelvokar", ["Robert Halmarend"], None), (11, None, None, None), (12, "", [], "person"), (13, "J. Tolmidor", [], "person"), (14, "Josephine Tolmidor", [], "person"), (15, "Jonathan Tolmidor", [], "person"),
        (16, "Tolmidor, J", [], "person"), (None, "Nobody", [], "person")]
    # names are blocked by their rarest token, so the words for trades must be commoner than a place's name
    others = [(100 + i, f"{town} {trade} Company", [], "org") for i, (town, trade) in enumerate((t, w) for t in ("Oxenholt", "Fremdale", "Quistow", "Vandermere", "Ilsworth", "Penhallow") for w in ("Railway", "Rly", "Water"))]
    c = {k: v for k, v in run(spark, rows + others).items() if k < 100}
    assert c[1] == c[2] == c[3] == c[4] == 1 and c[5] == c[10] == 5
    assert c[6] == c[7] == 6 and c[8] == c[9] == 8 and c[11] == 11 and c[12] == 12
    assert len({c[13], c[14], c[15]}) == 3  # the initial fits two people
    assert set(c) == set(range(1, 17))


def test_very_long_names(spark):
    long = "x" * 50_000
    assert run(spark, [(1, long, [], None), (2, long, [], None), (3, "Anna " + long, [long + "y"], "person"), (4, " ".join(f"word{i}" for i in range(3000)), [], "org")]) == {1: 1, 2: 1, 3: 1, 4: 4}  # an alias of 3 is one letter longer


def test_empty(spark):
    assert run(spark, []) == {}
