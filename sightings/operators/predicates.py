"""Filter trees (dicts, as in the JSON requests) turned into boolean columns.

A comparison is null where the record lacks the field, so a record without it is
neither matched nor matched by the negation.  An empty array counts as missing.
"""

from __future__ import annotations

import json
from collections.abc import Iterable
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings import model as m
from sightings.functions.dates import range_bounds, second_bounds
from sightings.functions.text import like_text
from sightings.operators import geo
from sightings.operators.geologic import GeologicTime

# Longer IN lists are filtered by a join against a key table, not by a literal list.
IN_LIST_LIMIT = 1000

Predicate = dict

_STORED_CASE = {m.UPPER: str.upper, m.LOWER: str.lower}


class Filters:
    """Compiles predicates for one table; the checklist picks the classification."""

    def __init__(self, fields: dict[str, m.Field] | None = None, checklist: str = "cl-1",
                 geologic: GeologicTime | None = None) -> None:
        self.fields = m.RECORD_FIELDS if fields is None else fields
        self.checklist = checklist
        self.geologic = geologic

    # ---- tree ----------------------------------------------------------------------

    def compile(self, p: Predicate) -> Column:
        p = merge_equals(normalised(p))
        kind = p["type"]
        if kind in ("and", "or"):
            return self._compound(p)
        if kind == "not":
            inner = p["predicate"]
            return ~self.compile(inner) & self._all_exist(inner)
        if kind == "within":
            return geo.within(p["geometry"], F.col("decimallatitude"), F.col("decimallongitude"))
        if kind == "geoDistance":
            return geo.geo_distance(p["latitude"], p["longitude"], p["distance"],
                                    F.col("decimallatitude"), F.col("decimallongitude"))
        field = m.field_of(p["key"], self.fields)
        checklist = p.get("checklistKey", self.checklist)
        if field.kind == m.NESTED:
            if kind == "isNull":
                present = F.exists(F.col(field.column), lambda e: e.getField(field.element).isNotNull())
                return ~F.coalesce(present, F.lit(False))
            return F.exists(F.col(field.column), lambda e: self._element(p, field, e))
        return self._leaf(p, field, checklist)

    def _compound(self, p: Predicate) -> Column:
        parts = p["predicates"]
        op = and_ if p["type"] == "and" else or_
        groups: dict[str, list[Predicate]] = {}
        rest = []
        for part in parts:
            path = self._nested_path(part)
            if path and p["type"] == "and":
                groups.setdefault(path, []).append(part)
            else:
                rest.append(self.compile(part))
        for path, conditions in groups.items():
            # every nested condition of one AND group must hold on the same element
            rest.append(self._same_element(path, conditions))
        return reduce(op, rest)

    def _same_element(self, path: str, conditions: list[Predicate]) -> Column:
        return F.exists(F.col(path), lambda e: reduce(and_, [self._element_tree(c, e) for c in conditions]))

    def _nested_path(self, p: Predicate) -> str | None:
        """The one nested array a whole subtree reads, if it reads nothing else.

        A negation stays outside: no element at all may match it.
        """
        if p["type"] in ("and", "or"):
            paths = {self._nested_path(q) for q in p["predicates"]}
            return paths.pop() if len(paths) == 1 else None
        if "key" not in p:
            return None
        field = m.field_of(p["key"], self.fields)
        return field.column if field.kind == m.NESTED else None

    def _element_tree(self, p: Predicate, e: Column) -> Column:
        if p["type"] in ("and", "or"):
            op = and_ if p["type"] == "and" else or_
            return reduce(op, [self._element_tree(q, e) for q in p["predicates"]])
        return self._element(p, m.field_of(p["key"], self.fields), e)

    def _element(self, p: Predicate, field: m.Field, e: Column) -> Column:
        return self._scalar(p, e.getField(field.element), field.element_kind)

    def _all_exist(self, p: Predicate) -> Column:
        """NOT demands that every field below it is present."""
        if p["type"] in ("and", "or"):
            return reduce(and_, [self._all_exist(q) for q in p["predicates"]])
        if p["type"] == "not":
            return self._all_exist(p["predicate"])
        if "key" not in p or p["type"] in ("isNull", "isNotNull"):
            return F.lit(True)
        return self._exists(m.field_of(p["key"], self.fields), p.get("checklistKey", self.checklist))

    # ---- leaves --------------------------------------------------------------------

    def _exists(self, field: m.Field, checklist: str) -> Column:
        if field.kind == m.INTERVAL:
            return F.col("eventdategte").isNotNull()
        c = field.col(checklist)
        if field.kind in (m.ARRAY, m.ANCESTORS, m.STATUS_ARRAY, m.NESTED):
            return c.isNotNull() & (F.size(c) > 0)
        if field.kind in (m.VOCABULARY, m.VOCABULARY_ARRAY):
            return c.getField("lineage").isNotNull() & (F.size(c.getField("lineage")) > 0)
        return c.isNotNull()

    def _leaf(self, p: Predicate, field: m.Field, checklist: str) -> Column:
        kind = p["type"]
        if kind == "isNull":
            return ~self._exists(field, checklist)
        if kind == "isNotNull":
            return self._exists(field, checklist)
        if field.kind == m.INTERVAL:
            return self._interval(p)
        if field.kind == m.AGE_RANGE:
            return self._age(p)
        c = field.col(checklist)
        if field.kind in (m.ARRAY, m.ANCESTORS, m.STATUS_ARRAY):
            return F.when(F.size(c) > 0, F.exists(c, lambda x: self._scalar(p, x, m.KEYWORD)))
        if field.kind in (m.VOCABULARY, m.VOCABULARY_ARRAY):
            names = c.getField("lineage")
            return F.when(F.size(names) > 0, F.exists(names, lambda x: self._scalar(p, x, m.KEYWORD)))
        test = self._scalar(p, c, field.kind)
        if field.null_inclusive and self._open_ended(p):
            return test | c.isNull()
        return test

    @staticmethod
    def _open_ended(p: Predicate) -> bool:
        if p["type"] in ("greaterThan", "greaterThanOrEquals"):
            return True
        return p["type"] == "equals" and str(p["value"]).endswith(",*")

    def _scalar(self, p: Predicate, c: Column, kind: str) -> Column:
        test = p["type"]
        match_case = p.get("matchCase", False)
        if test == "isNotNull":
            return c.isNotNull()
        if test == "isNull":
            return c.isNull()
        if kind in _STORED_CASE and test != "like":
            # the column's case is known: a plain comparison, which reaches the scan
            stored = _STORED_CASE[kind]
            if test == "in":
                return c.isin([stored(str(v)) for v in p["values"]])
            return _compare(test, c, F.lit(stored(str(p["value"]))))
        if test == "in":
            if kind == m.KEYWORD:
                values = [str(v) if match_case else str(v).lower() for v in p["values"]]
                return (c if match_case else F.lower(c)).isin(values)
            if kind == m.NUMBER and not any("," in str(v) for v in p["values"]):
                return c.isin([_number(str(v)) for v in p["values"]])
            return reduce(or_, [self._scalar({"type": "equals", "value": v}, c, kind) for v in p["values"]])
        if test == "like":
            return like_text(c, p["value"], match_case)
        value = p["value"]
        if kind in (m.DATE, m.MILLIS):
            return self._date(test, value, c, 1000 if kind == m.MILLIS else 1)
        if kind == m.BOOLEAN:
            return c == F.lit(str(value).lower() == "true")
        if kind == m.NUMBER:
            return self._number(test, str(value), c)
        if test == "equals":
            return c == F.lit(str(value)) if match_case else F.lower(c) == F.lit(str(value).lower())
        return _compare(test, c, F.lit(str(value)))

    @staticmethod
    def _number(test: str, value: str, c: Column) -> Column:
        if test == "equals" and "," in value:
            low, high = (v.strip() for v in value.split(",", 1))
            return _between(c, None if low == "*" else _number(low), None if high == "*" else _number(high))
        return _compare(test, c, F.lit(_number(value)))

    @staticmethod
    def _date(test: str, value: str, c: Column, scale: int) -> Column:
        if test == "equals" and "," in value:
            low, high = range_bounds(value)
        else:
            low, high = second_bounds(value)
            if test == "greaterThan":
                return c >= F.lit(high * scale)
            if test == "greaterThanOrEquals":
                return c >= F.lit(low * scale)
            if test == "lessThan":
                return c < F.lit(low * scale)
            if test == "lessThanOrEquals":
                return c < F.lit(high * scale)
        parts = []
        if low is not None:
            parts.append(c >= F.lit(low * scale))
        if high is not None:
            parts.append(c < F.lit(high * scale))
        return reduce(and_, parts) if parts else c.isNotNull()

    @staticmethod
    def _interval(p: Predicate) -> Column:
        """The record's whole interval must lie inside the asked one."""
        first, last = F.col("eventdategte"), F.col("eventdatelte")
        test = p["type"]
        if test == "in":
            return reduce(or_, [Filters._interval({"type": "equals", "value": v}) for v in p["values"]])
        value = str(p["value"])
        if test == "equals":
            low, high = range_bounds(value) if "," in value else second_bounds(value)
        else:
            start, end = second_bounds(value)
            low = {"greaterThan": end, "greaterThanOrEquals": start}.get(test)
            high = {"lessThan": start, "lessThanOrEquals": end}.get(test)
        parts = []
        if low is not None:
            parts.append(first >= F.lit(low))
        if high is not None:
            parts.append(last < F.lit(high))
        return reduce(and_, parts) if parts else first.isNotNull()

    def _age(self, p: Predicate) -> Column:
        if self.geologic is None:
            raise ValueError("a geological time filter needs the table of concepts")
        if p["type"] == "in":
            return reduce(or_, [self._age({"type": "equals", "value": v}) for v in p["values"]])
        youngest, oldest = self.geologic.bounds(str(p["value"]), p["type"])
        c = F.col("geologicaltime")
        parts = []
        if youngest is not None:
            parts.append(c.getField("gt") >= F.lit(youngest))
        if oldest is not None:
            parts.append(c.getField("lte") <= F.lit(oldest))
        return reduce(and_, parts) if parts else c.isNotNull()

    # ---- frames --------------------------------------------------------------------

    def apply(self, df: DataFrame, p: Predicate | None) -> DataFrame:
        return df if p is None else df.filter(self.compile(p))

    def check_issues(self, p: Predicate, taxonomic_issues: Iterable[str]) -> Predicate:
        """With a checklist, issues are looked up among the non-taxonomic ones only."""
        taxonomic = set(taxonomic_issues)
        values = p["values"] if p["type"] == "in" else [p["value"]]
        wrong = sorted(set(values) & taxonomic)
        if wrong:
            raise ValueError(f"taxonomic issues need the taxonomic issue parameter: {wrong}")
        return p


def _number(text: str) -> int | float:
    """Whole numbers stay integers, so comparisons with integer columns reach the scan."""
    text = text.strip()
    return int(text) if text.lstrip("-").isdigit() else float(text)


def _between(c: Column, low: float | None, high: float | None) -> Column:
    parts = []
    if low is not None:
        parts.append(c >= F.lit(low))
    if high is not None:
        parts.append(c <= F.lit(high))
    return reduce(and_, parts) if parts else c.isNotNull()


def _compare(test: str, c: Column, value: Column) -> Column:
    if test == "equals":
        return c == value
    if test == "greaterThan":
        return c > value
    if test == "greaterThanOrEquals":
        return c >= value
    if test == "lessThan":
        return c < value
    if test == "lessThanOrEquals":
        return c <= value
    raise ValueError(f"unknown predicate type {test}")


def normalised(p: Predicate) -> Predicate:
    """Some requests name the field ``parameter``, and some give the tree as JSON text."""
    if isinstance(p, str):
        p = json.loads(p)
    if "parameter" in p:
        p = {**{k: v for k, v in p.items() if k != "parameter"}, "key": p["parameter"]}
    if "predicates" in p:
        p = {**p, "predicates": [normalised(q) for q in p["predicates"]]}
    if "predicate" in p:
        p = {**p, "predicate": normalised(p["predicate"])}
    return p


def merge_equals(p: Predicate) -> Predicate:
    """OR of several equals on one key becomes a single IN; other parts stay."""
    if p["type"] != "or":
        return p
    by_key: dict[tuple, list[Predicate]] = {}
    order: list = []
    for part in p["predicates"]:
        if part["type"] == "equals" and "," not in str(part["value"]):
            key = (part["key"], part.get("matchCase", False), part.get("checklistKey"))
            if key not in by_key:
                order.append(key)
            by_key.setdefault(key, []).append(part)
        else:
            order.append(part)
    merged = []
    for item in order:
        if isinstance(item, dict):
            merged.append(item)
            continue
        same = by_key[item]
        if len(same) == 1:
            merged.append(same[0])
        else:
            one = {k: v for k, v in same[0].items() if k != "value"}
            merged.append({**one, "type": "in", "values": [q["value"] for q in same]})
    return merged[0] if len(merged) == 1 else {**p, "predicates": merged}


def keep_listed(df: DataFrame, column: Column, keys: DataFrame) -> DataFrame:
    """Semi join for IN lists too long for a literal; ``keys`` has one column ``key``.

    No broadcast hint: the adaptive planner broadcasts the keys only when their
    measured size allows it and otherwise sorts both sides and splits hot keys.
    """
    listed = keys.select(F.lower(F.col("key")).alias("listed_key")).distinct()
    return df.join(listed, F.lower(column) == F.col("listed_key"), "left_semi")


def filter_in(df: DataFrame, column: Column, values: list[str], match_case: bool = False) -> DataFrame:
    """IN over any number of values; a long list becomes a key table."""
    if len(values) <= IN_LIST_LIMIT:
        wanted = values if match_case else [v.lower() for v in values]
        return df.filter((column if match_case else F.lower(column)).isin(wanted))
    keys = df.sparkSession.createDataFrame([(v,) for v in values], "key string")
    if match_case:
        return df.join(keys.distinct(), column == F.col("key"), "left_semi")
    return keep_listed(df, column, keys)


def having_child(parents: DataFrame, children: DataFrame, keys: list[str]) -> DataFrame:
    """Parents with at least one of the (already filtered) children.

    The children's keys are made distinct before the shuffle: a parent with very many
    children sends one row per task.
    """
    return parents.join(children.select(*keys).distinct(), keys, "left_semi")
