"""Every registered query against its SQL on the smallest tables."""

from __future__ import annotations

import math

import pytest

from conftest import SF_DIR
from sightings.catalog import ORACLES, QUERIES


def _value(v):
    if v is None:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


def _rows(frame):
    names = sorted(frame.columns)
    rows = [tuple(_value(v) for v in row) for row in frame[names].itertuples(index=False, name=None)]
    return names, sorted(rows, key=lambda r: [(v is not None, str(v)) for v in r])


@pytest.mark.parametrize("key", sorted(ORACLES))
def test_query_equals_sql(spark, duck, key):
    assert _rows(QUERIES[key](spark, SF_DIR).toPandas()) == _rows(duck.execute(ORACLES[key]).df())


def test_every_query_has_its_sql():
    assert set(ORACLES) == set(QUERIES)


def test_inventory_is_covered():
    wanted = {f"FLT{n}" for n in range(1, 31)} | {f"GEO{n}" for n in range(1, 16)} | {f"JN{n}" for n in range(1, 15)}
    wanted |= {f"AGG{n}" for n in range(1, 35)} | {f"PRJ{n}" for n in range(1, 16)} | {f"INT{n}" for n in range(1, 11)}
    wanted |= {f"EXP{n}" for n in range(1, 13)} | {f"CHG{n}" for n in range(1, 9)} | {f"SRT{n}" for n in range(1, 8)}
    wanted |= {f"SRC{n}" for n in range(1, 6)} | {f"SNK{n}" for n in range(1, 6)} | {f"TXT{n}" for n in range(1, 5)}
    wanted |= {f"DAT{n}" for n in range(1, 9)} | {f"STR{n}" for n in range(1, 8)} | {f"SET{n}" for n in range(1, 5)}
    wanted |= {"ARR1", "ARR2", "ARR3", "MAP1", "STC1", "JSN1", "WIN1", "WIN2", "UDF1", "UDF2", "UDF3"}
    assert wanted <= set(QUERIES)
