"""Row filter used before records are counted into a data cube."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

# Issues that make a coordinate useless for a cube.
CUBE_ISSUES = ("ZERO_COORDINATE", "COORDINATE_OUT_OF_RANGE", "COORDINATE_INVALID", "COUNTRY_COORDINATE_MISMATCH")


def cube_quality(max_uncertainty: float, first_year: int, issues: tuple[str, ...] = CUBE_ISSUES) -> Column:
    uncertainty = F.col("coordinateuncertaintyinmeters")
    tests = [
        F.col("occurrencestatus") == "PRESENT",
        F.col("hascoordinate"),
        (uncertainty <= max_uncertainty) | uncertainty.isNull(),
        F.col("year") >= first_year,
        F.col("month").isNotNull(),
        F.col("specieskey").isNotNull(),
    ]
    tests += [~F.array_contains("issue", issue) for issue in issues]
    return reduce(and_, tests)
