"""Facets: exact term counts, several at once, each with its own filter."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sightings import model as m
from sightings.operators.params import parameter_predicate
from sightings.operators.predicates import Filters, having_child

# Page defaults and the largest number of terms a facet may reach.
DEFAULT_LIMIT, DEFAULT_OFFSET = 10, 0
MAX_FACET_TERMS = 1_200_000

# Up to here the planner cuts each task's terms to the page before the shuffle.
_WINDOW_PAGE = 1000


_ONE_TERM = (m.KEYWORD, m.UPPER, m.LOWER, m.NUMBER, m.BOOLEAN, m.DATE, m.MILLIS, m.RANK, m.STATUS)


def page_size(cardinality: int | None, offset: int, limit: int) -> int:
    """Terms to fetch for a page: bounded by the field's cardinality and the cap."""
    wanted = offset + limit
    if wanted > MAX_FACET_TERMS:
        raise ValueError(f"facet offset plus limit is above {MAX_FACET_TERMS}")
    return wanted if cardinality is None else min(wanted, cardinality)


def facet_terms(parameter: str, fields: Mapping[str, m.Field], checklist: str | None = None) -> Column:
    """Array of the record's terms: distinct ones, but every element of a nested array."""
    field = m.field_of(parameter, fields)
    if field.kind == m.NESTED:
        return F.transform(F.col(field.column), lambda e: e.getField(field.element).cast("string"))
    if field.kind == m.INTERVAL:
        ends = F.concat_ws("/", F.col("eventdategte").cast("string"), F.col("eventdatelte").cast("string"))
        return F.array(F.when(F.col("eventdategte").isNotNull(), ends))
    c = field.col(checklist)
    if field.kind in (m.ARRAY, m.ANCESTORS, m.STATUS_ARRAY):
        return F.array_distinct(c)
    if field.kind in (m.VOCABULARY, m.VOCABULARY_ARRAY):
        return F.array_distinct(c.getField("lineage"))
    return F.array(c.cast("string"))


def term_counts(df: DataFrame, parameter: str, fields: Mapping[str, m.Field], checklist: str | None = None) -> DataFrame:
    field = m.field_of(parameter, fields)
    term = field.col(checklist).cast("string") if field.kind in _ONE_TERM else F.explode(facet_terms(parameter, fields, checklist))
    terms = df.select(term.alias("term"))
    return terms.filter("term IS NOT NULL").groupBy("term").agg(F.count("*").alias("count"))


def facet(df: DataFrame, parameter: str, fields: Mapping[str, m.Field] | None = None, *, checklist: str | None = None,
          min_count: int = 1, limit: int = DEFAULT_LIMIT, offset: int = DEFAULT_OFFSET) -> DataFrame:
    """A page of the terms of one field, most frequent first, ties by term."""
    page_size(None, offset, limit)
    counts = term_counts(df, parameter, m.RECORD_FIELDS if fields is None else fields, checklist)
    kept = counts.filter(F.col("count") >= min_count)
    return kept.orderBy(F.desc("count"), "term").offset(offset).limit(limit)


def bounded_facet(df: DataFrame, parameter: str, cardinality: int, *, limit: int, offset: int = 0) -> DataFrame:
    """A facet whose page is cut to the field's cardinality."""
    size = page_size(cardinality, offset, limit)
    return facet(df, parameter, limit=max(0, size - offset), offset=offset)


def _keep(conditions: Iterable[Column]) -> Column:
    return F.coalesce(reduce(and_, conditions, F.lit(True)), F.lit(False))


def multi_select(df: DataFrame, facets: Sequence[str], selected: Mapping[str, Sequence[str]],
                 filters: Filters | None = None, *, checklist: str | None = None, limit: int = DEFAULT_LIMIT,
                 offset: int = DEFAULT_OFFSET, min_count: int = 1) -> DataFrame:
    """Facets where each ignores its own selection but obeys all the others.

    All facets come from one scan: a record is exploded into the (facet, term) pairs
    whose other conditions it meets, and one aggregation counts the pairs.
    """
    filters = Filters() if filters is None else filters
    page_size(None, offset, limit)
    tests = {name: filters.compile(parameter_predicate(name, values, filters.fields)) for name, values in selected.items()}
    pairs = []
    for name in facets:
        others = _keep(test for other, test in tests.items() if other != name)
        labelled = _labelled(name, filters.fields, checklist)
        # a missing array has no terms; it must not take the other facets' terms with it
        pairs.append(F.when(others & labelled.isNotNull(), labelled).otherwise(F.array().cast("array<struct<facet:string,term:string>>")))
    exploded = df.select(F.explode(F.concat(*pairs)).alias("p")).select("p.facet", "p.term")
    counts = (exploded.filter("term IS NOT NULL").groupBy("facet", "term").agg(F.count("*").alias("count"))
              .filter(F.col("count") >= min_count))
    return _pages(counts, facets, offset, limit)


def _labelled(name: str, fields: Mapping[str, m.Field], checklist: str | None) -> Column:
    field = m.field_of(name, fields)
    if field.kind in _ONE_TERM:  # no lambda: stays inside generated code
        return F.array(F.struct(F.lit(name).alias("facet"), field.col(checklist).cast("string").alias("term")))
    return F.transform(facet_terms(name, fields, checklist), lambda x: F.struct(F.lit(name).alias("facet"), x.alias("term")))


def _pages(counts: DataFrame, facets: Sequence[str], offset: int, limit: int) -> DataFrame:
    if offset + limit <= _WINDOW_PAGE:
        order = Window.partitionBy("facet").orderBy(F.desc("count"), "term")
        ranked = counts.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= offset + limit)
        return ranked.filter(F.col("place") > offset).drop("place")
    deep = [counts.filter(F.col("facet") == f).orderBy(F.desc("count"), "term").offset(offset).limit(limit) for f in facets]
    return reduce(DataFrame.unionByName, deep)


def post_filtered_hits(df: DataFrame, selected: Mapping[str, Sequence[str]], filters: Filters | None = None) -> DataFrame:
    """The hits that go with multi-select facets: every selection applies."""
    filters = Filters() if filters is None else filters
    for name, values in selected.items():
        df = filters.apply(df, parameter_predicate(name, values, filters.fields))
    return df


def child_facet(parents: DataFrame, children: DataFrame, keys: Sequence[str], parameter: str,
                fields: Mapping[str, m.Field], **page: int) -> DataFrame:
    """Terms of the parents that have at least one of the (already filtered) children."""
    return facet(having_child(parents, children, list(keys)), parameter, fields, **page)
