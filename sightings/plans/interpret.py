"""Standardisation jobs: verbatim text to interpreted values, set by set.

Each job works on the distinct inputs where they repeat, resolves them with native
expressions or equi-joins, and joins the result back.  Lookup tables are joined without
a hint: the planner broadcasts them only when their measured size allows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sightings.operators.spatial_join import join_layer


def with_lookup(df: DataFrame, key: Column, lookup: DataFrame, lookup_key: str) -> DataFrame:
    """Left join with a lookup table whose key is unique."""
    return df.withColumn("_key", key).join(lookup, F.col("_key") == F.col(lookup_key), "left").drop("_key", lookup_key)


def _issues(*pairs: tuple[Column, str]) -> Column:
    """The names whose condition is true, as an array."""
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in pairs]))


# ---- dates ------------------------------------------------------------------------------------------

# Earliest accepted day; the latest is tomorrow.
EARLIEST = "1600-01-01"

RAW_DATES = ["v_year", "v_month", "v_day", "v_eventdate", "v_startdayofyear", "v_enddayofyear"]

_ISO = "^[0-9]{4}(-[0-9]{1,2}(-[0-9]{1,2})?)?$"


def _part(text: str, place: int) -> str:
    """Year, month or day number of an ISO-like date; null when absent or not a date."""
    return f"CASE WHEN {text} RLIKE '{_ISO}' THEN try_cast(get(split({text}, '-'), {place}) AS INT) END"


def _day_of(y: str, m: str, d: str) -> str:
    """First day of a (possibly partial) date; null when the calendar has no such day."""
    return (f"CASE WHEN {y} IS NOT NULL THEN CAST(try_to_timestamp(concat(lpad(CAST({y} AS STRING), 4, '0'), '-',"
            f" CAST(coalesce({m}, 1) AS STRING), '-', CAST(coalesce({d}, 1) AS STRING)), 'yyyy-M-d') AS DATE) END")


def _last_day_of(first: str, m: str, d: str) -> str:
    return (f"CASE WHEN {d} IS NOT NULL THEN {first} WHEN {m} IS NOT NULL THEN last_day({first})"
            f" ELSE date_sub(add_months({first}, 12), 1) END")


def standardise_dates(df: DataFrame, latest: str | None = None) -> DataFrame:
    """Adds year, month, day and the first and last second of the recorded date.

    The event date may be a date of any precision or a range; year, month and day may
    repeat it; the days of the year refine a year.  A stated day inside a range keeps
    the range; otherwise the parts both agree on remain, and a conflict in the year
    leaves no date.  Year, month and day are set where both ends agree.
    """
    distinct = df.select(*RAW_DATES).distinct()
    latest_day = F.date_add(F.current_date(), 1) if latest is None else F.lit(latest).cast("date")
    steps = distinct.selectExpr(
        "*",
        "substring_index(trim(v_eventdate), '/', 1) AS _a",
        "CASE WHEN instr(v_eventdate, '/') > 0 THEN substring_index(trim(v_eventdate), '/', -1) END AS _b",
        "try_cast(v_year AS INT) AS _fy",
        "CASE WHEN try_cast(v_year AS INT) IS NOT NULL THEN try_cast(v_month AS INT) END AS _fm",
        "CASE WHEN try_cast(v_year AS INT) IS NOT NULL AND try_cast(v_month AS INT) IS NOT NULL THEN try_cast(v_day AS INT) END AS _fd",
    ).selectExpr(
        "*", f"{_part('_a', 0)} AS _ay", f"{_part('_a', 1)} AS _am", f"{_part('_a', 2)} AS _ad",
        f"{_part('_b', 0)} AS _by", f"{_part('_b', 1)} AS _bm", f"{_part('_b', 2)} AS _bd",
    ).selectExpr(
        "*", f"{_day_of('_ay', '_am', '_ad')} AS _from", f"{_day_of('_by', '_bm', '_bd')} AS _b_first",
        f"{_day_of('_fy', '_fm', '_fd')} AS _f_first",
    ).selectExpr(
        "*", f"{_last_day_of('_b_first', '_bm', '_bd')} AS _to", f"{_last_day_of('_f_first', '_fm', '_fd')} AS _f_last",
        # parts of a single event date and of the fields that agree
        "coalesce(_ay, _fy) AS _y",
        "CASE WHEN coalesce(_am, _fm) = coalesce(_fm, _am) THEN coalesce(_am, _fm) END AS _m",
    ).selectExpr(
        "*", "CASE WHEN _m IS NOT NULL AND coalesce(_ad, _fd) = coalesce(_fd, _ad) THEN coalesce(_ad, _fd) END AS _d",
        "CASE WHEN _from IS NULL AND _fd IS NULL THEN try_cast(v_startdayofyear AS INT) END AS _s",
        "CASE WHEN _from IS NULL AND _fd IS NULL THEN coalesce(try_cast(v_enddayofyear AS INT), try_cast(v_startdayofyear AS INT)) END AS _e",
    ).selectExpr(
        "*", "_from IS NOT NULL AND _to IS NOT NULL AS _ranged",
        "_f_first IS NOT NULL AND (_f_first < _from OR _f_last > _to) AS _outside",
        "_ay IS NOT NULL AND _fy IS NOT NULL AND _ay <> _fy AS _conflict",
        f"{_day_of('_y', '_m', '_d')} AS _one",
    ).selectExpr(
        "*", f"{_last_day_of('_one', '_m', '_d')} AS _one_last",
        "CASE WHEN _s BETWEEN 1 AND 366 AND _e >= _s AND _f_first IS NOT NULL THEN date_add(trunc(_f_first, 'YEAR'), _s - 1) END AS _doy",
    ).selectExpr(
        *RAW_DATES,
        "CASE WHEN _ranged AND NOT _outside THEN _from WHEN _doy IS NOT NULL THEN _doy WHEN NOT _conflict THEN _one END AS _first",
        "CASE WHEN _ranged AND NOT _outside THEN _to WHEN _doy IS NOT NULL THEN date_add(trunc(_f_first, 'YEAR'), _e - 1)"
        " WHEN NOT _conflict THEN _one_last END AS _last",
    )
    sane = (F.col("_first") >= F.lit(EARLIEST).cast("date")) & (F.col("_last") <= latest_day) & (F.col("_first") <= F.col("_last"))
    same_year = sane & (F.year("_first") == F.year("_last"))
    same_month = same_year & (F.month("_first") == F.month("_last"))
    same_day = same_month & (F.dayofmonth("_first") == F.dayofmonth("_last"))
    parsed = steps.select(
        *[F.coalesce(c, F.lit("")).alias(f"_k{n}") for n, c in enumerate(RAW_DATES)],
        F.when(same_year, F.year("_first")).alias("year"),
        F.when(same_month, F.month("_first")).alias("month"),
        F.when(same_day, F.dayofmonth("_first")).alias("day"),
        F.when(sane, F.unix_seconds(F.col("_first").cast("timestamp"))).alias("epoch_from"),
        F.when(sane, F.unix_seconds(F.date_add("_last", 1).cast("timestamp")) - 1).alias("epoch_to"),
    )
    parsed = parsed.dropDuplicates([f"_k{n}" for n in range(len(RAW_DATES))])
    keyed = df
    for n, c in enumerate(RAW_DATES):
        keyed = keyed.withColumn(f"_k{n}", F.coalesce(c, F.lit("")))
    keys = [f"_k{n}" for n in range(len(RAW_DATES))]
    return keyed.join(parsed, keys, "left").drop(*keys)


# ---- vocabularies -----------------------------------------------------------------------------------------

# Texts (letters only, lower case) of the basis of record.
BASIS_OF_RECORD = (
    ("preservedspecimen", "PRESERVED_SPECIMEN"),
    ("specimen", "PRESERVED_SPECIMEN"),
    ("voucher", "PRESERVED_SPECIMEN"),
    ("herbariumsheet", "PRESERVED_SPECIMEN"),
    ("fossil", "FOSSIL_SPECIMEN"),
    ("fossilspecimen", "FOSSIL_SPECIMEN"),
    ("living", "LIVING_SPECIMEN"),
    ("livingspecimen", "LIVING_SPECIMEN"),
    ("observation", "OBSERVATION"),
    ("humanobservation", "HUMAN_OBSERVATION"),
    ("machineobservation", "MACHINE_OBSERVATION"),
    ("materialsample", "MATERIAL_SAMPLE"),
    ("materialcitation", "MATERIAL_CITATION"),
    ("literature", "MATERIAL_CITATION"),
    ("occurrence", "OCCURRENCE"),
)
UNKNOWN_BASIS = "OCCURRENCE"


def normalised(c: Column) -> Column:
    return F.lower(F.regexp_replace(c, r"[^\p{L}]", ""))


def standardise_vocabulary(df: DataFrame, column: str, out: str, entries: Sequence[tuple[str, str]] = BASIS_OF_RECORD,
                           default: str = UNKNOWN_BASIS) -> DataFrame:
    """Text to its term; anything unknown or missing becomes the default.

    The dictionary has a few entries, so it is a map literal, not a join.
    """
    table = F.create_map(*[F.lit(x) for pair in entries for x in pair])
    return df.withColumn(out, F.coalesce(F.try_element_at(table, normalised(F.col(column))), F.lit(default)))


# ---- countries ----------------------------------------------------------------------------------------------

def standardise_country(df: DataFrame, columns: Sequence[str], names: DataFrame) -> DataFrame:
    """First parsable of several texts; ``names`` holds unique (name in lower case, country).

    Adds ``country`` and ``countryissues``: a later text naming another country is a
    mismatch; a text that names none is invalid, and the next one is tried.
    """
    out = df
    for n, column in enumerate(columns):
        lookup = names.select(F.col("name").alias(f"_name{n}"), F.col("country").alias(f"_country{n}"))
        out = with_lookup(out, F.lower(F.trim(F.col(column))), lookup, f"_name{n}")
    started, code = F.lit(False), F.lit(None).cast("string")
    mismatch, invalid = F.lit(False), F.lit(False)
    for n, column in enumerate(columns):
        present = F.col(column).isNotNull() & (F.col(column) != "")
        parsed = F.col(f"_country{n}")
        again = present & started & code.isNull()
        other = present & started & code.isNotNull() & parsed.isNotNull() & (parsed != code)
        mismatch = F.when(again, F.lit(False)).otherwise(mismatch | other)
        invalid = invalid | again
        code = F.when(present & (~started | code.isNull()), parsed).otherwise(code)
        started = started | present
    invalid = invalid | (started & code.isNull())
    result = out.withColumn("country", code).withColumn(
        "countryissues", _issues((mismatch, "COUNTRY_MISMATCH"), (invalid, "COUNTRY_INVALID")))
    return result.drop(*[f"_country{n}" for n in range(len(columns))])


# Fixed values: (country, country, whether an issue is added).  Pairs count both ways.
CONFUSED_COUNTRIES = (
    ("CX", "AU", True), ("CC", "AU", True), ("HM", "AU", True), ("NF", "AU", True),
    ("HK", "CN", True), ("MO", "CN", True), ("GL", "DK", True), ("AX", "FI", True),
    ("FR", "GP", False), ("FR", "GF", False), ("FR", "MQ", False), ("FR", "RE", False),
    ("FR", "YT", False), ("FR", "PF", False), ("FR", "PM", False), ("FR", "WF", False),
    ("FR", "MF", False), ("FR", "BL", False), ("FR", "NC", False), ("FR", "TF", False),
    ("IE", "GB", True), ("IL", "PS", True), ("XK", "RS", False), ("EH", "MA", False),
    ("CK", "NZ", True), ("NU", "NZ", True), ("TK", "NZ", True), ("SJ", "NO", True),
    ("IM", "GB", True), ("JE", "GB", True), ("GG", "GB", True), ("VI", "US", True),
    ("PR", "US", True), ("AS", "US", True), ("MP", "US", True), ("UM", "US", True), ("GU", "US", True),
)
ANTARCTICA, ANTARCTICA_BELOW = "AQ", -60.0

# Issues of the tried transformations, in the order tried.
TRANSFORM_ISSUES = (
    (),
    ("PRESUMED_NEGATED_LATITUDE",),
    ("PRESUMED_NEGATED_LONGITUDE",),
    ("PRESUMED_NEGATED_LATITUDE", "PRESUMED_NEGATED_LONGITUDE"),
    ("PRESUMED_SWAPPED_COORDINATE",),
)
DERIVED, MISMATCH = "COUNTRY_DERIVED_FROM_COORDINATES", "COUNTRY_COORDINATE_MISMATCH"


def _candidates(lat: Column, lon: Column, country: Column) -> Column:
    """The point and its negated and swapped forms; without a country only the point itself."""
    forms = [(lat, lon), (-lat, lon), (lat, -lon), (-lat, -lon), (lon, lat)]
    tried = F.array(*[F.struct(F.lit(n).alias("form"), a.alias("try_lat"), b.alias("try_lon")) for n, (a, b) in enumerate(forms)])
    return F.when(country.isNull(), F.slice(tried, 1, 1)).otherwise(tried)


def _pairs(pairs: Sequence[tuple[str, str, bool]], with_issue: bool) -> Column:
    """Map of a country to the countries it may stand for."""
    near: dict[str, list[str]] = {}
    for a, b, issue in pairs:
        if issue == with_issue:
            near.setdefault(a, []).append(b)
            near.setdefault(b, []).append(a)
    if not near:
        return F.lit(None).cast("map<string,array<string>>")
    return F.create_map(*[x for c, others in near.items() for x in (F.lit(c), F.array(*map(F.lit, others)))])


def validate_coordinates(df: DataFrame, layer: DataFrame, confused: Sequence[tuple[str, str, bool]] = CONFUSED_COUNTRIES) -> DataFrame:
    """Checks ``lat``/``lon`` against ``country`` with the polygons of a country layer.

    Adds ``finallat``, ``finallon``, ``finalcountry`` and ``coordinateissues``.  The
    first form of the point that lies in the country wins; an equivalent country is
    taken silently, a commonly confused one with an issue, both for the unchanged
    point only; a missing country is derived; otherwise it is a mismatch.

    Distinct (point, country) triples are resolved: many records share a point.
    """
    triples = df.select("lat", "lon", "country").filter(
        F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)).distinct()
    tried = triples.select("*", F.explode(_candidates(F.col("lat"), F.col("lon"), F.col("country"))).alias("t")).select(
        "lat", "lon", "country", "t.*").filter(F.col("try_lat").between(-90, 90) & F.col("try_lon").between(-180, 180))
    located = join_layer(tried, layer.withColumnRenamed("country", "found"), "try_lat", "try_lon")
    south = tried.filter(F.col("try_lat") < ANTARCTICA_BELOW).withColumn("found", F.lit(ANTARCTICA))
    same = F.col("found") == F.col("country")
    unchanged = F.col("form") == 0
    near = F.array_contains(F.try_element_at(_pairs(confused, False), "country"), F.col("found"))
    mixed_up = F.array_contains(F.try_element_at(_pairs(confused, True), "country"), F.col("found"))
    kind = (F.when(F.col("country").isNull(), F.lit(3)).when(same, F.lit(0))
            .when(unchanged & F.coalesce(near, F.lit(False)), F.lit(1))
            .when(unchanged & F.coalesce(mixed_up, F.lit(False)), F.lit(2)))
    matched = located.unionByName(south).withColumn("kind", kind).filter("kind IS NOT NULL")
    best = matched.groupBy("lat", "lon", F.coalesce("country", F.lit("")).alias("_country")).agg(
        F.min(F.struct("form", "kind", "found", "try_lat", "try_lon")).alias("best"))
    keyed = df.withColumn("_country", F.coalesce("country", F.lit("")))
    joined = keyed.join(best, ["lat", "lon", "_country"], "left").drop("_country")
    usable = F.col("lat").between(-90, 90) & F.col("lon").between(-180, 180)
    found = F.col("best").isNotNull()
    form_issues = F.array(*[F.array(*map(F.lit, names)).cast("array<string>") for names in TRANSFORM_ISSUES])
    own = F.when(found, F.element_at(form_issues, F.col("best.form") + 1)).otherwise(F.array().cast("array<string>"))
    more = _issues((found & F.col("best.kind").isin(2, 3), DERIVED), (usable & ~found & F.col("country").isNotNull(), MISMATCH))
    return joined.select(
        *df.columns,
        F.when(found, F.col("best.try_lat")).when(usable, F.col("lat")).alias("finallat"),
        F.when(found, F.col("best.try_lon")).when(usable, F.col("lon")).alias("finallon"),
        F.when(found, F.col("best.found")).otherwise(F.col("country")).alias("finalcountry"),
        F.concat(own, more).alias("coordinateissues"),
    )


# Issues that make the coordinate unusable.
SPATIAL_ISSUES = ("ZERO_COORDINATE", "COORDINATE_INVALID", "COORDINATE_OUT_OF_RANGE", "COUNTRY_COORDINATE_MISMATCH")


def drop_contradictions(df: DataFrame, issues: Sequence[str] = SPATIAL_ISSUES) -> DataFrame:
    """Coordinates stay only without a spatial issue; the country then follows them.

    With an issue both coordinates go and the country as given remains.
    """
    bad = F.exists("coordinateissues", lambda x: x.isin(*issues)) | F.col("finallat").isNull() | F.col("finallon").isNull()
    return df.select(
        "*",
        F.when(~bad, F.col("finallat")).alias("keptlat"),
        F.when(~bad, F.col("finallon")).alias("keptlon"),
        F.when(bad, F.col("country")).otherwise(F.col("finalcountry")).alias("keptcountry"),
    )


# ---- numbers ---------------------------------------------------------------------------------------------------

# Bounds of precision (inclusive) and uncertainty (exclusive), feet in a metre text.
PRECISION_BOUNDS, UNCERTAINTY_BOUNDS = (0.0, 45.0), (0.0, 5_000_000.0)
METRES_PER_FOOT = 0.3048


def metres(c: Column) -> Column:
    """A number with an optional unit (metres or feet) in metres; null when it is neither."""
    text = F.lower(F.trim(c))
    number = F.regexp_extract(text, r"^(-?[0-9]+(?:\.[0-9]+)?)\s*(m|metres?|meters?|ft|feet|foot|')?\.?$", 1)
    unit = F.regexp_extract(text, r"(ft|feet|foot|')\.?$", 1)
    value = F.when(number != "", number.cast("double"))
    return F.when(unit != "", value * METRES_PER_FOOT).otherwise(value)


def validate_uncertainty(df: DataFrame) -> DataFrame:
    """Adds checked precision and uncertainty, and an issue where a given text is not usable."""
    precision = F.expr("try_cast(trim(v_coordinateprecision) AS DOUBLE)")
    uncertainty = F.abs(metres(F.col("v_coordinateuncertaintyinmeters")))
    good_precision = precision.between(*PRECISION_BOUNDS)
    good_uncertainty = (uncertainty > UNCERTAINTY_BOUNDS[0]) & (uncertainty < UNCERTAINTY_BOUNDS[1])

    def wrong(column: str, good: Column) -> Column:
        return F.col(column).isNotNull() & ~F.coalesce(good, F.lit(False))

    return df.select(
        "*",
        F.when(good_precision, precision).alias("coordinateprecision"),
        F.when(good_uncertainty, uncertainty).alias("coordinateuncertaintyinmeters"),
        _issues((wrong("v_coordinateprecision", good_precision), "COORDINATE_PRECISION_INVALID"),
                (wrong("v_coordinateuncertaintyinmeters", good_uncertainty), "COORDINATE_UNCERTAINTY_METERS_INVALID")).alias("uncertaintyissues"),
    )


def standardise_range(df: DataFrame, low: str, high: str, out: str) -> DataFrame:
    """Minimum and maximum in metres to their middle and half width; one alone is the value itself."""
    a, b = metres(F.col(low)), metres(F.col(high))
    both = a.isNotNull() & b.isNotNull()
    return df.select(
        "*",
        F.when(both, (a + b) / 2).otherwise(F.coalesce(a, b)).alias(out),
        F.when(both, F.abs(b - a) / 2).alias(f"{out}accuracy"),
    )


def clean_place_name(c: Column) -> Column:
    """One space between words; a name in capitals throughout becomes Capitalised."""
    spaced = F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    letters = F.regexp_replace(spaced, r"\s", "")
    capitals = letters.rlike(r"^\p{Lu}+$")
    return F.when(capitals, F.concat(F.upper(F.substring(spaced, 1, 1)), F.lower(F.substring(spaced, 2, 100000)))).otherwise(spaced)


# ---- taxa ----------------------------------------------------------------------------------------------------------

EXACT, CANONICAL, FUZZY, HIGHER_RANK, NONE = "EXACT", "CANONICAL", "FUZZY", "HIGHERRANK", "NONE"


def clean_name_part(c: Column) -> Column:
    """Blanks collapsed; empty counts as missing."""
    text = F.trim(F.regexp_replace(c, r"[\s\p{Z}]+", " "))
    return F.when(text != "", text)


def compose_name(scientific: Column, authorship: Column, generic: Column, genus: Column, epithet: Column, infra: Column) -> Column:
    """The full name, with the author unless it is already there; or built from its parts."""
    full, author = clean_name_part(scientific), clean_name_part(authorship)
    with_author = F.when(author.isNotNull() & ~F.lower(full).contains(F.lower(author)), F.concat_ws(" ", full, author)).otherwise(full)
    parts = F.concat_ws(" ", F.coalesce(clean_name_part(generic), clean_name_part(genus)), clean_name_part(epithet), clean_name_part(infra), author)
    return F.when(full.isNotNull(), with_author).otherwise(F.when(parts != "", parts))


def _one_edit_keys(c: Column) -> Column:
    """The text and the text with each single character removed: texts one edit apart share one."""
    removed = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.concat(F.substring(c, F.lit(1), i - 1), F.substring(c, i + 1, F.length(c))))
    return F.array_distinct(F.concat(F.array(c), F.when(F.length(c) > 0, removed).otherwise(F.array().cast("array<string>"))))


def _least(backbone: DataFrame, key: str, out: str) -> DataFrame:
    """One usage per key, the one with the smallest usage key."""
    return backbone.groupBy(key).agg(F.min_by("usage", "usage.usagekey").alias(out))


def match_taxa(df: DataFrame, name: str, backbone: DataFrame) -> DataFrame:
    """Adds the usage of each name: exact, without author, one edit off, or its genus.

    ``backbone``: usagekey, scientificname, canonicalname, taxonrank and any rank columns.
    The distinct names go through one chain of equality joins; the edit distance of one
    is found through shared keys inside a genus, only for names still unmatched, and
    then verified, so no pairs are enumerated.
    """
    low = F.lower(F.col(name))
    words = F.split("_name", " ")
    names = df.select(low.alias("_name")).distinct().filter("_name IS NOT NULL").select(
        "_name", words[0].alias("_genus"), F.get(words, F.lit(1)).alias("_epithet"))
    names = names.withColumn("_canon", F.concat_ws(" ", "_genus", "_epithet"))
    known = backbone.select(F.lower("scientificname").alias("_name"), F.lower("canonicalname").alias("_canon"), "taxonrank",
                            F.struct("usagekey", *[c for c in backbone.columns if c != "usagekey"]).alias("usage"))
    species = known.filter(F.instr("_canon", " ") > 0)
    genera = known.filter("taxonrank = 'GENUS'").withColumnRenamed("_canon", "_genus")
    parts = F.split("_canon", " ")
    near = species.select(parts[0].alias("_genus"), parts[1].alias("_known"), "usage").select(
        "*", F.explode(_one_edit_keys(F.col("_known"))).alias("_key"))
    direct = (names.join(_least(known, "_name", "u0"), "_name", "left").join(_least(species, "_canon", "u1"), "_canon", "left")
              .join(_least(genera, "_genus", "u3"), "_genus", "left"))
    unmatched = F.col("u0").isNull() & F.col("u1").isNull() & F.col("_epithet").isNotNull()
    asked = direct.withColumn("_key", F.explode_outer(F.when(unmatched, _one_edit_keys(F.col("_epithet")))))
    tried = asked.join(near, ["_genus", "_key"], "left")
    close = F.levenshtein("_epithet", "_known") <= 1
    fuzzy = F.min_by(F.when(close, F.col("usage")), F.when(close, F.col("usage.usagekey")))
    best = tried.groupBy("_name").agg(*[F.first(u, ignorenulls=True).alias(u) for u in ("u0", "u1", "u3")], fuzzy.alias("u2"))
    how = (F.when(F.col("u0").isNotNull(), EXACT).when(F.col("u1").isNotNull(), CANONICAL)
           .when(F.col("u2").isNotNull(), FUZZY).when(F.col("u3").isNotNull(), HIGHER_RANK).otherwise(NONE))
    resolved = best.select("_name", F.coalesce("u0", "u1", "u2", "u3").alias("usage"), how.alias("matchtype")).select("_name", "usage.*", "matchtype")
    joined = df.withColumn("_name", low).join(resolved, "_name", "left").drop("_name")
    return joined.withColumn("matchtype", F.coalesce("matchtype", F.lit(NONE)))


# ---- datum ----------------------------------------------------------------------------------------------------------

# Datum texts (letters and digits, lower case) that are understood.
KNOWN_DATUMS = (
    "wgs84", "epsg4326", "worldgeodeticsystem1984", "nad83", "epsg4269", "nad27", "epsg4267", "etrs89", "epsg4258",
    "ed50", "epsg4230", "gda94", "epsg4283", "sirgas2000", "epsg4674", "osgb36", "epsg4277", "tokyo", "epsg4301",
)
ASSUMED_DATUM, INVALID_DATUM = "GEODETIC_DATUM_ASSUMED_WGS84", "GEODETIC_DATUM_INVALID"


def datum_check(df: DataFrame) -> DataFrame:
    """A missing datum is taken as WGS84; an unknown one too, and is marked invalid."""
    given = F.col("v_geodeticdatum")
    text = F.lower(F.regexp_replace(given, r"[^\p{L}\p{N}]", ""))
    missing = given.isNull() | (given == "")
    unknown = ~missing & ~text.isin(*KNOWN_DATUMS)
    return df.withColumn("datumissues", _issues((unknown, INVALID_DATUM), (missing | unknown, ASSUMED_DATUM)))
