"""Short tokens and surnames that are commoner than the given name."""

from mnemora.llm.names import alike
from tests.llm.test_names import run


def test_alike():
    assert alike("wood", "woods") and alike("lee", "leee") and alike("kim", "kmi") and not alike("kim", "kin") and alike("wu", "wu") and not alike("wu", "wi")


def test_short_and_common_surnames_meet(spark):
    rows = [(1, "Wu Li", [], "person"), (2, "Li Wu", [], "person"), (3, "Wu Fo", [], "person"), (4, "Darragh Wood", [], "person"), (5, "D. Wood", [], "person"), (6, "Petronella Lee", [], "person"), (7, "Petronella Leee", [], "person"), (8, "Darragh Stone", [], "person")]
    common = [(100 + i, f"{g} Wood", [], "person") for i, g in enumerate(("Gesine", "Henrik", "Ilka", "Marek", "Nerea"))]
    c = run(spark, rows + common)
    assert c[1] == c[2] and c[4] == c[5] and c[6] == c[7]
    assert len({c[i] for i in (1, 3, 4, 6, 8, 100, 101, 102, 103, 104)}) == 10
