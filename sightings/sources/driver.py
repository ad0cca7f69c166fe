"""The driver's tables seen as record, event, DNA, Humboldt and media frames.

Every column is one SQL expression over the joined tables.  ``sighting(...)`` joins
only the tables the requested columns need, so a query that reads dataset and licence
scans ``lineitem`` alone.  ``cte(...)`` gives the same frame as DuckDB SQL.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Source:
    spark_sql: str
    duck_sql: str
    needs: tuple[str, ...]


def _source(sql: str, needs: str = "", duck: str | None = None) -> Source:
    return Source(sql, duck or sql, tuple(needs.split()))


_EPOCH = _source("unix_seconds(CAST(l_shipdate AS TIMESTAMP))", duck="CAST(epoch(l_shipdate) AS BIGINT)")
_DAY = "CAST(CAST(l_shipdate AS DATE) AS STRING)"
_ID = (
    "concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING),"
    f" CAST(l_suppkey AS STRING), {_DAY})"
)
_LAT = "CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE CAST((l_partkey * 37 + l_linenumber * 11) % 18000 AS DOUBLE) / 100 - 90 END"
_LON = "CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE CAST((l_orderkey * 53 + l_suppkey * 7) % 36000 AS DOUBLE) / 100 - 180 END"
_LAT_TEXT = "CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE CAST(CAST(((l_partkey * 37 + l_linenumber * 11) % 180) - 90 AS INT) AS STRING) END"
_LON_TEXT = "CASE WHEN l_orderkey % 50 = 0 THEN NULL ELSE CAST(CAST(((l_orderkey * 53 + l_suppkey * 7) % 360) - 180 AS INT) AS STRING) END"
_RECORDER = "CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE c_name END"
_IDENTIFIER = "CASE WHEN l_linenumber % 2 = 0 THEN s_name END"
_ISSUE1 = "CASE WHEN l_discount > 0.05 THEN 'ZERO_COORDINATE' END"
_ISSUE2 = "CASE WHEN l_linenumber = 2 THEN 'COUNTRY_COORDINATE_MISMATCH' END"
_TAXON_ISSUE = "CASE WHEN l_tax > 0.05 THEN 'TAXON_MATCH_FUZZY' END"
_SPECIES_KEY = "CASE WHEN p_size % 10 = 0 THEN NULL ELSE CAST(l_partkey AS STRING) END"


def _compact(*items: str) -> tuple[str, str]:
    """The non-null items as an array, in Spark and in DuckDB."""
    joined = ", ".join(items)
    return f"array_compact(array({joined}))", f"list_filter([{joined}], lambda x: x IS NOT NULL)"


def _array(needs: str, *items: str) -> Source:
    spark_sql, duck_sql = _compact(*items)
    return _source(spark_sql, needs, duck_sql)


def _media_json() -> str:
    still = (
        """'{"type":"StillImage","format":"image/jpeg","identifier":"http://m/' || CAST(l_partkey AS STRING)"""
        """ || '.jpg","title":"' || p_name || '","license":"CC0_1_0","created":"' || """ + _DAY + """ || '"}'"""
    )
    sound = (
        """'{"type":"Sound","identifier":"http://m/' || CAST(l_partkey AS STRING) || '.wav","creator":"'"""
        """ || p_brand || '"}'"""
    )
    return (
        f"CASE WHEN p_size % 2 = 0 AND p_size % 5 = 0 THEN '[' || {still} || ',' || {sound} || ']'"
        f" WHEN p_size % 2 = 0 THEN '[' || {still} || ']' WHEN p_size % 5 = 0 THEN '[' || {sound} || ']' END"
    )


_KINGDOM_MAP = "map('kingdom', p_type, 'family', p_brand, 'genus', split_part(p_name, ' ', 1), 'order', concat('Order ', p_brand), 'species', p_name)"

RECORD: dict[str, Source] = {
    # identity
    "recordid": _source(_ID),
    "datasetkey": _source("concat('ds-', CAST(l_suppkey AS STRING))"),
    "publishingorgkey": _source("concat('org-', CAST(l_suppkey % 10 AS STRING))"),
    "installationkey": _source("concat('inst-', CAST(l_suppkey % 4 AS STRING))"),
    "occurrenceid": _source("CASE WHEN l_linenumber = 5 THEN NULL ELSE concat('occ-', CAST(l_orderkey AS STRING), '-', CAST(l_linenumber AS STRING)) END"),
    "institutioncode": _source("concat('INST-', CAST(l_suppkey % 20 AS STRING))"),
    "collectioncode": _source("CASE WHEN l_linenumber = 6 THEN NULL ELSE concat('COLL-', CAST(l_suppkey % 5 AS STRING)) END"),
    "catalognumber": _source("CAST(l_partkey AS STRING)"),
    "recordnumber": _source("CAST(l_linenumber AS STRING)"),
    "license": _source("CASE l_suppkey % 3 WHEN 0 THEN 'CC0_1_0' WHEN 1 THEN 'CC_BY_4_0' ELSE 'CC_BY_NC_4_0' END"),
    "basisofrecord": _source("CASE l_returnflag WHEN 'A' THEN 'HUMAN_OBSERVATION' WHEN 'R' THEN 'PRESERVED_SPECIMEN' ELSE 'OCCURRENCE' END"),
    "occurrencestatus": _source("CASE WHEN l_linestatus = 'F' THEN 'PRESENT' ELSE 'ABSENT' END"),
    "individualcount": _source("CAST(l_quantity AS INT)"),
    "eventid": _source("CAST(l_orderkey div 2 AS STRING)", duck="CAST(l_orderkey // 2 AS STRING)"),
    "eventtime": _source("CASE l_linenumber % 3 WHEN 0 THEN '14:30' WHEN 1 THEN '14:30:20' END"),
    # taxonomy
    "specieskey": _source(_SPECIES_KEY, "p"),
    "taxonkey": _source("CAST(l_partkey AS STRING)"),
    "species": _source("p_name", "p"),
    "genus": _source("split_part(p_name, ' ', 1)", "p"),
    "family": _source("p_brand", "p"),
    "familykey": _source("CASE WHEN p_size = 1 THEN NULL ELSE p_brand END", "p"),
    "kingdom": _source("p_type", "p"),
    "scientificname": _source("concat(p_name, ' ', p_brand)", "p"),
    "taxonrank": _source("CASE WHEN p_size % 10 = 0 THEN 'GENUS' ELSE 'SPECIES' END", "p"),
    "classificationdetails": _source(
        f"map('cl-1', {_KINGDOM_MAP}, 'cl-2', map('kingdom', p_type, 'family', p_brand))", "p"),
    "taxonkeys": _source(
        f"map('cl-1', array_compact(array(p_type, p_brand, {_SPECIES_KEY})), 'cl-2', array(p_type, p_brand))", "p"),
    "taxonomicstatuses": _source(
        "map('cl-1', CASE WHEN p_size % 10 = 0 THEN 'DOUBTFUL' ELSE 'ACCEPTED' END, 'cl-2', 'ACCEPTED')", "p"),
    "taxonomicissue": _source(f"map('cl-1', array_compact(array({_TAXON_ISSUE})), 'cl-2', CAST(array() AS ARRAY<STRING>))"),
    # place
    "countrycode": _source("cn.n_name", "cn"),
    "publishingcountry": _source("sn.n_name", "sn"),
    "decimallatitude": _source(_LAT),
    "decimallongitude": _source(_LON),
    "hascoordinate": _source("l_orderkey % 50 <> 0"),
    "coordinateuncertaintyinmeters": _source("CASE WHEN l_linenumber % 3 = 0 THEN NULL ELSE l_quantity * 50 END"),
    "elevation": _source("l_extendedprice / 100"),
    "depth": _source("CASE WHEN l_linenumber = 1 THEN l_quantity END"),
    "distancefromcentroidinmeters": _source("CASE WHEN l_linenumber % 5 = 0 THEN NULL ELSE l_extendedprice / 10 END"),
    "locality": _source("concat('Plot ', CAST(l_suppkey AS STRING))"),
    # time
    "year": _source("CAST(year(l_shipdate) AS INT)"),
    "month": _source("CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(month(l_shipdate) AS INT) END"),
    "day": _source("CASE WHEN l_linenumber = 7 THEN NULL ELSE CAST(day(l_shipdate) AS INT) END"),
    "eventdategte": _EPOCH,
    "eventdatelte": _source(f"{_EPOCH.spark_sql} + l_linenumber * 86400L - 1", duck=f"{_EPOCH.duck_sql} + l_linenumber * 86400 - 1"),
    "dateidentified": _source(f"{_EPOCH.spark_sql} + 2592000L", duck=f"{_EPOCH.duck_sql} + 2592000"),
    "modified": _source(
        f"{_EPOCH.spark_sql} * 1000L + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_partkey % 1000 END",
        duck=f"{_EPOCH.duck_sql} * 1000 + CASE WHEN l_linenumber % 2 = 0 THEN 0 ELSE l_partkey % 1000 END"),
    "eventdate": _source(
        f"CASE l_linenumber % 4 WHEN 0 THEN substr({_DAY}, 1, 4) WHEN 1 THEN substr({_DAY}, 1, 7) ELSE {_DAY} END"),
    "geologicaltime": _source(
        "named_struct('gt', CAST(l_partkey % 300 AS DOUBLE), 'lte', CAST(l_partkey % 300 + l_linenumber * 3 AS DOUBLE))"),
    "geologicaltime_gt": _source("CAST(l_partkey % 300 AS DOUBLE)"),
    "geologicaltime_lte": _source("CAST(l_partkey % 300 + l_linenumber * 3 AS DOUBLE)"),
    # people
    "recordedby": _array("c s", _RECORDER, "CASE WHEN l_linenumber = 1 THEN s_name END"),
    "identifiedby": _array("s", _IDENTIFIER),
    "recordedby_1": _source(_RECORDER, "c"),
    "recordedby_2": _source("CASE WHEN l_linenumber = 1 THEN s_name END", "s"),
    "identifiedby_1": _source(_IDENTIFIER, "s"),
    "recordedbyid": _source("CASE WHEN l_linenumber % 3 = 1 THEN concat('https://id/', CAST(o_custkey % 97 AS STRING)) END", "o"),
    "identifiedbyid": _source("CASE WHEN l_linenumber % 3 = 2 THEN concat('https://id/', CAST(l_suppkey % 89 AS STRING)) END"),
    # vocabularies, issues, media
    "sex": _source(
        "CASE WHEN l_linenumber = 7 THEN NULL ELSE named_struct('concept', o_orderpriority, 'lineage', array(o_orderstatus, o_orderpriority)) END", "o"),
    "sex_concept": _source("CASE WHEN l_linenumber = 7 THEN NULL ELSE o_orderpriority END", "o"),
    "sex_root": _source("CASE WHEN l_linenumber = 7 THEN NULL ELSE o_orderstatus END", "o"),
    "lifestage": _source("named_struct('concept', c_mktsegment, 'lineage', array('Stage', c_mktsegment))", "c"),
    "lifestage_concept": _source("c_mktsegment", "c"),
    "typestatus": _source(
        "CASE WHEN l_linenumber = 5 THEN named_struct('concepts', array('Holotype', 'Paratype'), 'lineage', array('Type', 'Holotype', 'Paratype'))"
        " WHEN l_linenumber = 6 THEN named_struct('concepts', array('Isotype'), 'lineage', array('Type', 'Isotype')) END"),
    "typestatus_text": _source("CASE WHEN l_linenumber = 5 THEN 'Holotype;Paratype' WHEN l_linenumber = 6 THEN 'Isotype' END"),
    "nontaxonomicissue": _array("", _ISSUE1, _ISSUE2),
    "issue": _array("", _ISSUE1, _ISSUE2, _TAXON_ISSUE),
    "issue_1": _source(_ISSUE1),
    "issue_2": _source(_ISSUE2),
    "taxonissue_1": _source(_TAXON_ISSUE),
    "mediatype": _array("p", "CASE WHEN p_size % 2 = 0 THEN 'StillImage' END", "CASE WHEN p_size % 5 = 0 THEN 'Sound' END"),
    "ext_multimedia": _source(_media_json(), "p"),
    # verbatim text
    "v_scientificname": _source(
        "CASE WHEN l_orderkey % 7 = 0 THEN upper(p_name) WHEN l_orderkey % 11 = 0 THEN concat(p_name, chr(9), p_brand, chr(10)) ELSE p_name END", "p"),
    "v_locality": _source(
        "CASE WHEN l_linenumber = 4 THEN NULL WHEN l_orderkey % 5 = 0 THEN concat('NORTH', chr(13), chr(10), '  SHORE ', CAST(l_suppkey AS STRING))"
        " ELSE concat(' Plot  ', CAST(l_suppkey AS STRING), ' ') END"),
    "v_country": _source("CASE WHEN l_orderkey % 13 = 0 THEN 'Atlantis' ELSE lower(cn.n_name) END", "cn"),
    "v_countrycode": _source("CASE WHEN l_orderkey % 17 = 0 THEN NULL WHEN l_orderkey % 19 = 0 THEN 'NATION_1' ELSE cn.n_name END", "cn"),
    "v_basisofrecord": _source("CASE l_returnflag WHEN 'A' THEN 'Human observation' WHEN 'R' THEN 'specimen' ELSE 'unheard of' END"),
    "v_decimallatitude": _source(_LAT_TEXT),
    "v_decimallongitude": _source(_LON_TEXT),
    "v_geodeticdatum": _source("CASE l_linenumber % 3 WHEN 0 THEN NULL WHEN 1 THEN 'WGS84' ELSE 'moon datum' END"),
    "v_coordinateuncertaintyinmeters": _source("CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '0' WHEN 3 THEN '-50' WHEN 4 THEN '9000000' WHEN 5 THEN 'abc' ELSE CAST(CAST(l_quantity AS INT) AS STRING) END"),
    "v_coordinateprecision": _source("CASE l_linenumber WHEN 1 THEN NULL WHEN 2 THEN '46' WHEN 3 THEN 'x' WHEN 4 THEN '-1' ELSE '0.5' END"),
    "v_minimumdepthinmeters": _source("CASE WHEN l_linenumber < 6 THEN concat(CAST(CAST(l_quantity AS INT) AS STRING), ' m') END"),
    "v_maximumdepthinmeters": _source("CASE WHEN l_linenumber < 4 THEN CAST(CAST(l_quantity AS INT) * 2 AS STRING) WHEN l_linenumber = 4 THEN 'deep' END"),
    "v_year": _source("CASE WHEN l_linenumber = 6 THEN NULL ELSE CAST(year(l_shipdate) AS STRING) END"),
    "v_month": _source("CASE WHEN l_linenumber > 5 THEN NULL ELSE CAST(month(l_shipdate) AS STRING) END"),
    "v_day": _source("CASE WHEN l_linenumber > 4 THEN NULL ELSE CAST(day(l_shipdate) AS STRING) END"),
    "v_eventdate": _source(
        f"CASE l_linenumber WHEN 1 THEN {_DAY} WHEN 2 THEN substr({_DAY}, 1, 7) WHEN 3 THEN substr({_DAY}, 1, 4)"
        f" WHEN 4 THEN concat({_DAY}, '/', substr({_DAY}, 1, 4), '-12-31') WHEN 5 THEN NULL WHEN 6 THEN 'last summer' ELSE '1066-10-14' END"),
    "v_startdayofyear": _source("CASE WHEN l_linenumber = 5 THEN '60' END"),
    "v_enddayofyear": _source("CASE WHEN l_linenumber = 5 THEN '90' END"),
    "v_recordedby": _source(_RECORDER, "c"),
    "v_identifiedby": _source(_IDENTIFIER, "s"),
    "v_recordedbyid": _source("CASE WHEN l_linenumber % 3 = 1 THEN concat('https://id/', CAST(o_custkey % 97 AS STRING)) END", "o"),
    "v_identifiedbyid": _source("CASE WHEN l_linenumber % 3 = 2 THEN concat('https://id/', CAST(l_suppkey % 89 AS STRING)) END"),
}

# Parts of arrays and structs by themselves, for the SQL; a record's own columns are the others.
_PARTS = re.compile(r"_(?:1|2|gt|lte|concept|root|text)$")
OWN_COLUMNS = tuple(n for n in RECORD if not _PARTS.search(n))

# alias -> (table, aliases joined before it, Spark condition)
_JOINS = {
    "o": ("orders", (), "l_orderkey = o_orderkey"),
    "c": ("customer", ("o",), "o_custkey = c_custkey"),
    "cn": ("nation", ("c",), "c_nationkey = cn.n_nationkey"),
    "p": ("part", (), "l_partkey = p_partkey"),
    "s": ("supplier", (), "l_suppkey = s_suppkey"),
    "sn": ("nation", ("s",), "s_nationkey = sn.n_nationkey"),
}


# The lines are spread by the key of the orders, so these come first; parts add the widest columns and come last.
_ORDER = ("o", "c", "cn", "s", "sn", "p")


def _tables_for(names: tuple[str, ...]) -> list[str]:
    wanted: list[str] = []

    def add(alias: str) -> None:
        for earlier in _JOINS[alias][1]:
            add(earlier)
        if alias not in wanted:
            wanted.append(alias)

    for name in names:
        for alias in RECORD[name].needs:
            add(alias)
    return wanted


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Rows of a task, about, where the fact table is spread: what a task sorts does not grow with the table.
TASK_ROWS = 500_000

_LINE_COLUMNS = re.compile(r"\bl_[a-z]+\b")


def _lines(spark: SparkSession, sf_dir: str, names: tuple[str, ...], aliases: list[str]) -> DataFrame:
    """The needed columns of the fact table.

    A table stored as fewer files than there are cores (one row group, one task) is
    spread by the order key, which the join with the orders can use, to more tasks the
    more rows it has (the footers tell); a table of many files, as on a cluster, is left where it is.
    """
    lines = table(spark, sf_dir, "lineitem")
    text = " ".join([*[RECORD[n].spark_sql for n in names], *[_JOINS[a][2] for a in aliases], "l_orderkey"])
    used = set(_LINE_COLUMNS.findall(text))
    lines = lines.select(*[c for c in lines.columns if c in used])
    cores = spark.sparkContext.defaultParallelism
    if len(lines.inputFiles()) >= cores:
        return lines
    return lines.repartition(max(cores, math.ceil(lines.count() / TASK_ROWS)), "l_orderkey")


def sighting(spark: SparkSession, sf_dir: str, *names: str, optional: tuple[str, ...] = ()) -> DataFrame:
    """The columns of the lines and of the tables they need; a line stays where it misses a row of an ``optional`` table."""
    names = names or tuple(RECORD)
    aliases = _tables_for(names)
    df = _lines(spark, sf_dir, names, aliases).alias("l")

    def joined(left: DataFrame, parents: tuple[str, ...]) -> DataFrame:
        """A table's own tables are joined to it before the many lines are, which then move once for all of them."""
        for alias in _ORDER:
            name, earlier, condition = _JOINS[alias]
            if alias in aliases and earlier == parents:
                how = "left" if alias in optional else "inner"
                left = left.join(joined(table(spark, sf_dir, name).alias(alias), (alias,)), F.expr(condition), how)
        return left

    df = joined(df, ())
    return df.select(*[F.expr(RECORD[n].spark_sql).alias(n) for n in names])


def cte(*names: str, name: str = "occ", optional: tuple[str, ...] = ()) -> str:
    """``occ AS (SELECT …)`` for DuckDB, with the same columns as ``sighting``."""
    joins = " ".join(f"{'LEFT JOIN' if a in optional else 'JOIN'} {_JOINS[a][0]} {a} ON {_JOINS[a][2]}" for a in _tables_for(names))
    columns = ", ".join(f"{RECORD[n].duck_sql} AS {n}" for n in names)
    return f"{name} AS (SELECT {columns} FROM lineitem l {joins})"


# ---- sampling events -------------------------------------------------------------

EVENT_DATASET = "ds-e"


def event(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.expr("CAST(event_id AS STRING)").alias("eventid"),
        F.expr("CASE WHEN event_id > 0 THEN CAST(event_id div 4 AS STRING) END").alias("parenteventid"),
        F.lit(EVENT_DATASET).alias("datasetkey"),
        F.expr("CASE WHEN event_type = 'error' THEN 'occurrence' ELSE 'event' END").alias("type"),
        F.col("event_type").alias("eventtype"),
        F.expr("concat('s', CAST(user_id % 7 AS STRING))").alias("samplingprotocol"),
        F.expr("unix_seconds(CAST(ts AS TIMESTAMP))").alias("eventdategte"),
        F.expr("unix_seconds(CAST(ts AS TIMESTAMP)) + user_id * 3600L").alias("eventdatelte"),
        F.expr(
            "array(named_struct('duration', user_id * 10.0D, 'inventory', event_type),"
            " named_struct('duration', user_id * 2.0D, 'inventory', CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'restricted' END))"
        ).alias("humboldt"),
    )


EVENT_CTE = (
    "ev AS (SELECT CAST(event_id AS STRING) AS eventid,"
    " CASE WHEN event_id > 0 THEN CAST(event_id // 4 AS STRING) END AS parenteventid,"
    f" '{EVENT_DATASET}' AS datasetkey, CASE WHEN event_type = 'error' THEN 'occurrence' ELSE 'event' END AS type,"
    " event_type AS eventtype, concat('s', CAST(user_id % 7 AS STRING)) AS samplingprotocol,"
    " CAST(floor(epoch(ts)) AS BIGINT) AS eventdategte, CAST(floor(epoch(ts)) AS BIGINT) + user_id * 3600 AS eventdatelte,"
    " user_id * 10.0 AS h1_duration, event_type AS h1_inventory, user_id * 2.0 AS h2_duration,"
    " CASE WHEN event_id % 2 = 0 THEN 'open' ELSE 'restricted' END AS h2_inventory FROM events)"
)


def humboldt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inventory rows of events: none, one or two per event."""
    return table(spark, sf_dir, "events").where("event_id % 3 <> 0").select(
        F.expr("CAST(event_id div 2 AS STRING)").alias("recordid"),
        F.expr("user_id * 10.0D").alias("eventdurationvalueinminutes"),
        F.expr(
            "map('cl-1', map('usagename', array(event_type, concat('u', CAST(user_id % 5 AS STRING))), 'family', array(event_type)))"
        ).alias("targettaxonomicscope"),
    )


HUMBOLDT_CTE = (
    "hum AS (SELECT CAST(event_id // 2 AS STRING) AS recordid, user_id * 10.0 AS eventdurationvalueinminutes,"
    " event_type || ';' || concat('u', CAST(user_id % 5 AS STRING)) AS usagename, event_type AS family"
    " FROM events WHERE event_id % 3 <> 0)"
)


# ---- DNA rows --------------------------------------------------------------------

_SEQUENCE = "CASE WHEN l_partkey % 4 = 0 THEN NULL ELSE upper(translate(p_name, 'abcdefghijklmnopqrstuvwxyz ', 'acgtacgtacgtacgtacgtacgtacn')) END"
_DNA_COLUMNS = (
    f"{_ID} AS recordid",
    "CASE WHEN l_linenumber = 2 THEN NULL ELSE concat('nsid-', CAST(l_partkey AS STRING)) END AS nucleotidesequenceid",
    f"{_SEQUENCE} AS sequence",
    f"CAST(length({_SEQUENCE}) AS INT) AS sequencelength",
)


def dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").where("l_linenumber <= 2")
    return rows.join(table(spark, sf_dir, "part"), F.expr("l_partkey = p_partkey")).selectExpr(
        *_DNA_COLUMNS,
        "CASE WHEN p_size % 3 = 0 THEN NULL ELSE named_struct('concept', p_brand, 'lineage', array('gene', p_brand)) END AS targetgene",
    )


DNA_CTE = (
    f"dna AS (SELECT {', '.join(_DNA_COLUMNS)}, CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_brand END AS targetgene_concept"
    " FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_linenumber <= 2)"
)
