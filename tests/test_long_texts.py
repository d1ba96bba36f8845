"""Searches for texts of thousands of characters, whose words count to the last, give the rows of their SQL."""

import sys
from pathlib import Path

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
from mnemora.operators import entities
from tests.conftest import SF

sys.path.insert(0, str(Path(__file__).parent.parent / "tools"))
from compare import plain  # noqa: E402

LONG = 2100


@pytest.fixture(scope="module")
def long_texts(tmp_path_factory):
    """The smallest tables; each query begins with a long run of words that no other text has, and then names an entity and words of its own and of others."""
    d = tmp_path_factory.mktemp("long")
    for p in Path(SF).glob("*.parquet"):
        (d / p.name).symlink_to(p)
    m = pq.read_table(d / "memories.parquet")
    name = next(x for x in pq.read_table(d / "entities.parquet")["name"].to_pylist() if x)
    ids, texts = m["id"].to_pylist(), m["content"].to_pylist()
    filler = " ".join(f"zq{i}" for i in range(LONG))[: LONG + 1]
    texts = [f"{filler} svc-9.1 {x} {texts[i - 7]} {name} " if n % 100 == 0 else x for i, (n, x) in enumerate(zip(ids, texts))]
    (d / "memories.parquet").unlink()
    pq.write_table(m.set_column(m.schema.get_field_index("content"), "content", pa.array(texts, m.schema.field("content").type)), d / "memories.parquet")
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for p in d.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return str(d), con


@pytest.mark.parametrize("name", ["bm25_phrases", "hybrid_search_history", "rrf_fusion"])
def test_whole_texts_are_searched_for(spark, long_texts, name):
    d, con = long_texts
    a, b = plain(entry.queries()[name](spark, d).toPandas()), plain(con.execute(entry.oracle_sql()[name]).df())
    assert len(b) >= 40
    assert list(a.columns) == list(b.columns)
    assert a.equals(b)


@pytest.mark.parametrize("name", ["hybrid_search_history", "rrf_fusion"])
def test_all_terms_of_a_query_weigh(name):
    assert "pos <" not in entry.oracle_sql()[name]


def test_names_at_the_end_of_a_text_of_many_words(spark):
    text = " ".join(f"w{i}" for i in range(100_000))
    queries = spark.createDataFrame([(1, f"{text} Alpha of Centauri"), (2, "Alpha of"), (3, f"{text} rho"), (4, ""), (5, None)], "id long, content string")
    known = spark.createDataFrame([(7, "alpha of centauri", []), (8, "Rho", ["alpha of"]), (9, "w99999 Alpha", None), (10, "of alpha", [])], "id long, name string, aliases array<string>")
    assert sorted((r.id, r.entity_id) for r in entities.named_in(queries, known).collect()) == [(1, 7), (1, 8), (1, 9), (2, 8), (3, 8)]
