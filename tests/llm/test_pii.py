from pyspark.sql import functions as F

from mnemora.llm.pii import find_pii, redact

PEOPLE = [("Edda", "Felrant"), ("Imani", "Casniquist"), ("Odile", "Quarverg"), ("Tiago", "Navpatov"), ("Zora", "Pelkalin")]
TEXT = (
    "Mr Felrant applauded. My constituent Odile Brastomir has waited for an answer. Please write to <odile (at) brastomir dot example> before the recess. "
    "They rang +44 (0)7700 900929 eleven times. Passport PX-0344886-9 was refused twice. The damp flat is at Flat 3, 12 Larnlow\nStreet, Wexmere 5520. "
    "Nobody called Ms Brastomir back. See docket 2021-0448-78 and Bill 20/2019.")


def run(spark, texts):
    df = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, kind string, pii_text string")
    return df, sorted((r.doc_id, r.kind, r.pii_text) for r in find_pii(df, F.col("doc_id"), F.col("text"), PEOPLE).collect())


def test_kinds_borders_and_consistency(spark):
    _, got = run(spark, [TEXT])
    assert got == sorted([
        (0, "name", "Odile Brastomir"), (0, "name", "Brastomir"), (0, "email", "odile (at) brastomir dot example"), (0, "phone", "+44 (0)7700 900929"),
        (0, "id_number", "PX-0344886-9"), (0, "address", "Flat 3, 12 Larnlow Street, Wexmere 5520")])


def test_redaction_keeps_the_rest(spark):
    df, _ = run(spark, [TEXT, None, "", "Nothing here."])
    out = {r.doc_id: r.text for r in redact(df, F.col("doc_id"), F.col("text"), PEOPLE).collect()}
    assert out[0].startswith("Mr Felrant applauded. My constituent [NAME] has waited") and "[PHONE] eleven times. Passport [ID_NUMBER] was" in out[0] and "Bill 20/2019." in out[0]
    assert out[1] is None and out[2] == "" and out[3] == "Nothing here."


def test_null_empty_long_and_repeated(spark):
    long = "The government has ignored 855 permits. " * 20_000 + "They rang 07700 900 543 eleven times."
    _, got = run(spark, [None, "", long, long])
    assert got == [(2, "phone", "07700 900 543"), (3, "phone", "07700 900 543")]
    assert run(spark, [])[1] == []
    # a run of letters without end beside an address sign
    assert run(spark, ["a" * 300_000 + " @ " + "B" * 300_000])[1] == []
