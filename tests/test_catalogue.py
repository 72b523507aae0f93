"""Each query of the catalogue against its SQL, and the rest by running them."""

import math

import pytest

from spellwise.plans import catalogue
from tests import oracle

#: Columns of queries without SQL whose values are probabilities or shares.
UNIT = {"p_value", "propensity_score", "weight", "quality_score", "closeness", "treatment_retention_rate", "control_utilization_rate"}


@pytest.fixture(scope="module")
def duck(sf):
    return oracle.connect(sf)


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_equals_sql(spark, sf, duck, name):
    df = catalogue.QUERIES[name](spark, sf)
    columns, rows = oracle.rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = duck.execute(catalogue.SQL[name])
    names, expected = oracle.rows_of([d[0] for d in found.description], found.fetchall())
    assert columns == names
    assert oracle.same(rows, expected)


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.SQL)))
def test_rows_are_sound(spark, sf, name):
    """What SQL cannot give has rows, without repeats, NaN or values out of range; test_operators holds the values themselves."""
    df = catalogue.QUERIES[name](spark, sf)
    rows = df.collect()
    assert rows and len({tuple(map(str, r)) for r in rows}) == len(rows)
    for r in rows:
        for c, v in r.asDict().items():
            assert not (isinstance(v, float) and math.isnan(v)), c
            assert c not in UNIT or v is None or -1e-9 <= v <= 1 + 1e-9, (c, v)


def test_entry_imports_without_the_optional_subpackage(monkeypatch):
    import importlib
    import sys

    import __spark_entry__ as entry

    monkeypatch.setitem(sys.modules, "spellwise.llm", None)
    for name in [m for m in sys.modules if m.startswith("spellwise.llm.") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    assert not any(q.startswith("op") and q[2].isdigit() for q in importlib.reload(entry).queries())
    monkeypatch.undo()
    importlib.reload(entry)
