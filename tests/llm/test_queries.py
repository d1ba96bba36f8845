import pytest

from mnemora.llm import queries
from tests.conftest import SF
from tests.test_queries import plain

#: The queries without SQL, and their columns.
COLUMNS = {
    "p1_found": ["collection", "id_a", "id_b"], "p6_found": ["entity_a", "entity_b"], "p6_classes": ["entity_id", "class_id"], "p7_edited": ["doc_id", "item_id", "first_word"],
    "p8_mixture": ["doc_id", "source", "size", "copies"], "p8_shares": ["source", "target_share", "actual_share", "size", "available", "docs", "max_copies"],
    "p9_found": ["doc_id", "kind", "pii_text"], "p9_redacted": ["doc_id", "text"]}


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_equals_sql(spark, con, name):
    a, b = plain(queries.QUERIES[name](spark, SF).toPandas()), plain(con.execute(queries.SQL[name]).df())
    assert list(a.columns) == list(b.columns) and a.equals(b)


def test_all_others_are_listed():
    assert set(COLUMNS) == set(queries.QUERIES) - set(queries.SQL)


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_repeats(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    got = [tuple(r) for r in rows.collect()]
    assert rows.columns == COLUMNS[name] and len(got) == len(set(got))
    assert got or name == "p7_edited"  # so few documents may hold no edited passage


def test_pairs_are_ordered_and_classes_agree(spark):
    pairs = {tuple(r) for r in queries.p6_found(spark, SF).collect()}
    of = {r.entity_id: r.class_id for r in queries.p6_classes(spark, SF).collect()}
    assert pairs == {(a, b) for a in of for b in of if a < b and of[a] == of[b]}
    assert all(c <= e and of[c] == c for e, c in of.items())


def test_redaction_keeps_every_document_and_removes_what_was_found(spark):
    text = {r.doc_id: r.text for r in queries.p9_redacted(spark, SF).collect()}
    found = queries.p9_found(spark, SF).collect()
    assert len(text) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(f.pii_text not in " ".join((text[f.doc_id] or "").split()) for f in found if f.kind in ("email", "phone", "id_number"))


def test_mixture_within_its_caps(spark):
    mixed = queries.p8_mixture(spark, SF).collect()
    most = {r.source: r.max_repeats for r in spark.read.parquet(f"{SF}/mix_targets.parquet").collect()}
    assert all(1 <= r.copies <= most[r.source] for r in mixed)
    shares = queries.p8_shares(spark, SF).collect()
    assert abs(sum(r.actual_share for r in shares) - 1) < 1e-9
    assert {r.source: r.size for r in shares if r.size} == {s: sum(r.size * r.copies for r in mixed if r.source == s) for s in {r.source for r in mixed}}
