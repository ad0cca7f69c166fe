"""Geological time: concept names to ages in million years."""

from __future__ import annotations

from dataclasses import dataclass, field

# Fixed values: (concept, start age, end age) of the published international
# chronostratigraphic chart, the concepts named in filters and tests.
CHRONOSTRATIGRAPHY = (
    ("phanerozoic", 538.8, 0.0),
    ("paleozoic", 538.8, 251.902),
    ("mesozoic", 251.902, 66.0),
    ("cenozoic", 66.0, 0.0),
    ("cambrian", 538.8, 485.4),
    ("ordovician", 485.4, 443.8),
    ("silurian", 443.8, 419.2),
    ("devonian", 419.2, 358.9),
    ("carboniferous", 358.9, 298.9),
    ("permian", 298.9, 251.902),
    ("triassic", 251.902, 201.4),
    ("jurassic", 201.4, 145.0),
    ("cretaceous", 145.0, 66.0),
    ("paleogene", 66.0, 23.03),
    ("neogene", 23.03, 2.58),
    ("quaternary", 2.58, 0.0),
    ("miocene", 23.03, 5.333),
    ("pliocene", 5.333, 2.58),
    ("burdigalian", 20.44, 15.98),
)


@dataclass
class GeologicTime:
    """Looks concepts up in the driver: the vocabulary has a few hundred rows."""

    concepts: dict[str, tuple[float, float]] = field(
        default_factory=lambda: {name: (start, end) for name, start, end in CHRONOSTRATIGRAPHY})

    def _ages(self, name: str) -> tuple[float | None, float | None]:
        if name == "*":
            return None, None
        if name.lower() not in self.concepts:
            raise ValueError(f"concept {name} is not in the geological time vocabulary")
        return self.concepts[name.lower()]

    def bounds(self, value: str, test: str = "equals") -> tuple[float | None, float | None]:
        """(youngest, oldest) age asked for; None leaves the end open."""
        if "," in value:
            return self._range(*(v.strip() for v in value.split(",", 1)))
        start, end = self._ages(value)
        if test == "greaterThanOrEquals":
            return end, None
        if test == "greaterThan":
            return start, None
        if test == "lessThanOrEquals":
            return None, start
        if test == "lessThan":
            return None, end
        return end, start

    def _range(self, first: str, second: str) -> tuple[float | None, float | None]:
        a, b = self._ages(first), self._ages(second)
        if first == "*":
            return None, b[0]
        if second == "*":
            return a[1], None
        for inner, outer in ((a, b), (b, a)):
            if inner[0] <= outer[0] and inner[1] >= outer[1]:
                raise ValueError("one of the concepts is contained by the other")
        return min(a[1], b[1]), max(a[0], b[0])
