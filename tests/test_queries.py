"""Every registered query of the sensor operators against its SQL, on the smallest tables."""

import pytest

from sensorline.plans import registry

from .conftest import SF, canonical

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    frame = registry.queries()[name](spark, SF)
    rows = [tuple(r) for r in frame.collect()]
    if name not in ORACLES:
        assert rows and len(frame.columns) == len(set(frame.columns))
        return
    want = duck.sql(ORACLES[name])
    assert canonical(rows, frame.columns) == canonical(want.fetchall(), want.columns)


def test_entry_registers_everything():
    import __spark_entry__ as entry

    assert set(registry.queries()) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
