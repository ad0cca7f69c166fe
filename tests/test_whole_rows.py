"""Queries that show every column they are to show, on a few rows of their own, against their SQL."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from sightings.catalog import ORACLES, QUERIES
from test_catalog import _rows

_TABLES = {
    "nation": ("n_nationkey int, n_name string", [(0, "NATION_0"), (1, "NATION_1"), (2, None)]),
    "customer": ("c_custkey long, c_name string, c_nationkey int, c_mktsegment string",
                 [(1, "Customer#1", 0, "ADULT"), (2, "Customer#2", 1, None), (3, None, 2, "EGG")]),
    "supplier": ("s_suppkey long, s_name string, s_nationkey int", [(1, "Supplier#1", 1), (2, "Supplier#2", None)]),
    "part": ("p_partkey long, p_name string, p_brand string, p_type string, p_size int",
             [(1, "red fox", "B1", "T1", 10), (2, "blue whale", "B2", "T2", 2), (3, "grey\tseal", "B1", "T2", 5), (4, "owl", "B3", "T1", 7)]),
    "orders": ("o_orderkey long, o_custkey long, o_orderstatus string, o_orderpriority string",
               [(n, n % 3 + 1, "OP"[n % 2], None if n == 4 else f"{n % 5}-URGENT") for n in range(1, 60)]),
    "lineitem": (
        "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double,"
        " l_tax double, l_returnflag string, l_linestatus string, l_shipdate timestamp",
        [(o, (o + n) % 4 + 1, 9 if o == 59 else (o + n // 2) % 2 + 1, n, float(o % 50 + 1), 900.07 * o + n, (o % 10) / 100, None if n == 3 else (o % 8) / 100,
          "ANR"[o % 3], "FO"[n % 2], dt.datetime(1992 + o % 7, n, o % 28 + 1)) for o in range(1, 60) for n in range(1, 8)] * 2),
}


@pytest.fixture(scope="module")
def few(spark, tmp_path_factory):
    """A folder of small tables, with every line there twice, some missing values and lines of an unknown supplier."""
    folder = tmp_path_factory.mktemp("few")
    for name, (schema, rows) in _TABLES.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


@pytest.fixture(scope="module")
def few_duck(few):
    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for name in _TABLES:
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{few}/{name}.parquet/*.parquet'")
    return db


def _checked(spark, few, few_duck, key, without=()):
    found = QUERIES[key](spark, few).toPandas()
    assert len(found) == len([line for line in _TABLES["lineitem"][1] if line[0] not in without])
    assert _rows(found) == _rows(few_duck.execute(ORACLES[key]).df())
    return found


def test_verbatim_layout_has_every_verbatim_column(spark, few, few_duck):
    from sightings.sources.driver import RECORD

    found = _checked(spark, few, few_duck, "PRJ1")
    assert set(found.columns) == {"recordid", *[n for n in RECORD if n.startswith("v_")]} and len(found.columns) == 23
    assert set(found["v_identifiedby"].dropna()) == {"Supplier#1", "Supplier#2"} and set(found["v_enddayofyear"].dropna()) == {"90"}


def test_simple_with_verbatim_layout_has_every_simple_and_verbatim_column(spark, few, few_duck):
    from sightings.plans.terms import SIMPLE_TERMS, VERBATIM_TERMS

    found = _checked(spark, few, few_duck, "PRJ9", without=(59,))
    assert list(found.columns[:len(SIMPLE_TERMS) + 1]) == ["recordid", *SIMPLE_TERMS]
    assert set(found.columns[len(SIMPLE_TERMS) + 1:]) == {f"v_{n}" for n in VERBATIM_TERMS} and len(found.columns) == 72
    assert set(found["mediatype"]) == {"StillImage;Sound", "StillImage", "Sound", ""}
    assert set(found["month"]) == {-1, 1, 2, 3, 4, 5, 6} and not found["phylum"].notna().any()


def test_full_text_field_has_the_texts_of_all_columns(spark, few, few_duck):
    found = _checked(spark, few, few_duck, "TXT2")
    texts = [set(t.split("|")) for t in found["fulltext"]]
    for text in ("CC_BY_4_0", "HUMAN_OBSERVATION", "Customer#1", "Supplier#2", "ADULT", "1-URGENT", "last summer", "moon datum", "NATION_0", "T1", "60"):
        assert any(text in t for t in texts), text
    assert all(i.rsplit("-", 3)[0] not in t and "14:30" not in t for i, t in zip(found["recordid"], texts))
    assert not any(word.startswith(("ds-", "org-", "inst-", "[{")) for t in texts for word in t)


def test_full_text_takes_concepts_and_leaves_keys_and_extensions(spark):
    from sightings.operators.text_search import full_text

    df = spark.createDataFrame(
        [("r", ("Female", ["Sex", "Female"]), None, 0.25, "k1", "k2", "[{}]", ("Holotype",))],
        "recordid string, sex struct<concept:string,lineage:array<string>>, lifestage struct<concept:string,lineage:array<string>>, depth double,"
        " publishingorgkey string, v_somekey string, ext_multimedia string, other struct<name:string>")
    assert sorted(df.select(full_text(df)).first()[0]) == ["0.25", "Female", "k2"]
