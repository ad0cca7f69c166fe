"""Request parameters to predicates: the export rules and the search rules."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence

from sightings import model as m
from sightings.functions.dates import day_bounds

_RANGE = re.compile(r"^\s*(\*|[^,]+)\s*,\s*(\*|[^,]+)\s*$")
_NUMBER = re.compile(r"^\s*-?\d+(?:\.\d+)?\s*$")

# Minutes per unit of a duration text such as "2 hours".
DURATION_MINUTES = {
    "minute": 1, "hour": 60, "day": 1440, "week": 10080, "month": 43200, "year": 525600,
}

Params = Mapping[str, Sequence[str]]


def _is_range(value: str) -> bool:
    return bool(_RANGE.match(value))


def _range_predicate(key: str, low: str, high: str) -> dict | None:
    parts = []
    if low != "*":
        parts.append({"type": "greaterThanOrEquals", "key": key, "value": low})
    if high != "*":
        parts.append({"type": "lessThanOrEquals", "key": key, "value": high})
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else {"type": "and", "predicates": parts}


def _geo_distance(value: str) -> dict:
    lat, lon, distance = (v.strip() for v in value.split(","))
    return {"type": "geoDistance", "latitude": float(lat), "longitude": float(lon), "distance": distance}


def _one_value(key: str, value: str, match_case: bool, fields: dict[str, m.Field]) -> dict | None:
    if key == m.GEOMETRY:
        return {"type": "within", "geometry": value}
    if key == m.GEO_DISTANCE:
        return _geo_distance(value)
    kind = m.field_of(key, fields).kind
    if _is_range(value):
        low, high = (v.strip() for v in value.split(",", 1))
        numeric = all(v == "*" or _NUMBER.match(v) for v in (low, high))
        if kind == m.NUMBER and numeric:
            return _range_predicate(key, low, high)
        if kind in (m.DATE, m.MILLIS, m.INTERVAL):
            # the precision is always a day once a range has been read
            low = low if low == "*" else day_bounds(low)[0].isoformat()
            if high != "*":
                high = _last_day(high)
            return _range_predicate(key, low, high)
        if numeric:
            raise ValueError(f"ranges are for numbers and dates only, not {key}")
    if value == "*":
        return {"type": "isNotNull", "key": key}
    predicate = {"type": "equals", "key": key, "value": value}
    return {**predicate, "matchCase": True} if match_case else predicate


def _last_day(text: str) -> str:
    from datetime import timedelta

    return (day_bounds(text)[1] - timedelta(days=1)).isoformat()


def export_predicate(params: Params, fields: dict[str, m.Field] | None = None) -> dict | None:
    """One value is equals, several equals are IN, mixed ones OR, parameters AND."""
    fields = m.RECORD_FIELDS if fields is None else fields
    match_case = str(next(iter(params.get("matchCase", [])), "false")).lower() == "true"
    by_parameter = []
    for name, values in params.items():
        key = name.upper()
        if key not in fields and key not in (m.GEOMETRY, m.GEO_DISTANCE):
            continue
        parts = [p for p in (_one_value(key, v, match_case, fields) for v in values) if p]
        if not parts:
            continue
        if len(parts) == 1:
            by_parameter.append(parts[0])
        elif all(p["type"] == "equals" for p in parts):
            merged = {"type": "in", "key": key, "values": list(values)}
            by_parameter.append({**merged, "matchCase": True} if match_case else merged)
        else:
            by_parameter.append({"type": "or", "predicates": parts})
    return _conjunction(by_parameter)


def search_predicate(params: Params, fields: dict[str, m.Field] | None = None) -> dict | None:
    """Search rules: ranges of one parameter are OR-ed, plain values are IN, both AND-ed."""
    fields = m.RECORD_FIELDS if fields is None else fields
    parts: list[dict] = []
    for name, values in params.items():
        part = parameter_predicate(name, values, fields)
        if part is not None:
            parts.append(part)
    return _conjunction(parts)


def parameter_predicate(name: str, values: Sequence[str], fields: dict[str, m.Field]) -> dict | None:
    key = name.upper()
    if key in (m.GEOMETRY, m.GEO_DISTANCE):
        tests = [_one_value(key, v, False, fields) for v in values]
        return tests[0] if len(tests) == 1 else {"type": "or", "predicates": tests}
    if "*" in values:
        return {"type": "isNotNull", "key": key}
    ranged = m.field_of(key, fields).kind in (m.NUMBER, m.DATE, m.MILLIS, m.INTERVAL, m.AGE_RANGE)
    ranged = ranged or m.field_of(key, fields).element_kind == m.NUMBER
    ranges = [{"type": "equals", "key": key, "value": v} for v in values if ranged and _is_range(v)]
    plain = [v for v in values if not (ranged and _is_range(v))]
    parts = []
    if ranges:
        parts.append(ranges[0] if len(ranges) == 1 else {"type": "or", "predicates": ranges})
    if len(plain) == 1:
        parts.append({"type": "equals", "key": key, "value": plain[0]})
    elif plain:
        parts.append({"type": "in", "key": key, "values": plain})
    return _conjunction(parts)


def _conjunction(parts: list[dict]) -> dict | None:
    if not parts:
        return None
    return parts[0] if len(parts) == 1 else {"type": "and", "predicates": parts}


def duration_minutes(text: str) -> str:
    """``"2 hours"`` or ``"1 day,*"`` to minutes, kept as one value or one range."""
    if "," in text:
        low, high = (v.strip() for v in text.split(",", 1))
        return ",".join("*" if v == "*" else duration_minutes(v) for v in (low, high))
    match = re.match(r"^\s*(\d+(?:\.\d+)?)\s*([A-Za-z]+?)s?\s*$", text)
    if match is None or match.group(2).lower() not in DURATION_MINUTES:
        raise ValueError(f"not a duration: {text!r}")
    minutes = float(match.group(1)) * DURATION_MINUTES[match.group(2).lower()]
    return f"{minutes:g}"


def with_duration(params: Params) -> dict[str, Sequence[str]]:
    """The text duration parameter replaced by the one in minutes."""
    out = dict(params)
    if "HUMBOLDT_EVENT_DURATION" in out:
        text = next(iter(out.pop("HUMBOLDT_EVENT_DURATION")))
        out["HUMBOLDT_EVENT_DURATION_VALUE_IN_MINUTES"] = [duration_minutes(text)]
    return out
