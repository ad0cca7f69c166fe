"""Joins between records, extensions, events and lookup tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightings.catalog.registry import query
from sightings.operators import agents, citations, events, relations
from sightings.operators.predicates import having_child
from sightings.operators.spatial_join import join_layer
from sightings.plans.exports import extension_rows, media_rows, sequence_rows, with_humboldt
from sightings.sources.driver import DNA_CTE, EVENT_CTE, HUMBOLDT_CTE, cte, dna, event, humboldt, sighting, table
from sightings.sources.tables import build_extension_table, build_multimedia_table


def _part_extension(spark, sf_dir):
    """Two extension rows per line of an order, keyed by the record id."""
    rows = sighting(spark, sf_dir, "recordid", "locality", "recordnumber")
    return rows.select("recordid", F.explode(F.array("locality", "recordnumber")).alias("remark"))


@query("JN1", f"WITH {cte('recordid', 'locality', 'recordnumber', 'year')} SELECT recordid, unnest([locality, recordnumber]) AS remark FROM occ WHERE year = 1997")
def extension_of_export(spark, sf_dir):
    exported = sighting(spark, sf_dir, "recordid", "year").filter("year = 1997")
    return extension_rows(build_extension_table(_part_extension(spark, sf_dir)), exported)


@query("JN2", f"WITH {cte('recordid', 'ext_multimedia', 'countrycode')} SELECT recordid, unnest(regexp_extract_all(ext_multimedia, '\"type\":\"([A-Za-z]+)\"', 1)) AS type"
              " FROM occ WHERE countrycode = 'NATION_8' AND ext_multimedia IS NOT NULL")
def multimedia_of_export(spark, sf_dir):
    exported = sighting(spark, sf_dir, "recordid", "countrycode").filter("countrycode = 'NATION_8'")
    items = build_multimedia_table(sighting(spark, sf_dir, "recordid", "ext_multimedia"))
    return media_rows(items, exported).select("recordid", "type")


@query("JN3", f"WITH {DNA_CTE}, {cte('recordid', 'year')} SELECT recordid, sequence FROM dna JOIN occ USING (recordid) WHERE sequence IS NOT NULL AND year >= 1998")
def sequences_of_export(spark, sf_dir):
    exported = sighting(spark, sf_dir, "recordid", "year").filter("year >= 1998")
    return sequence_rows(dna(spark, sf_dir), exported).select("recordid", "sequence")


@query("JN4", f"WITH {EVENT_CTE}, {HUMBOLDT_CTE} SELECT eventid, eventtype, coalesce(eventdurationvalueinminutes, -1) AS minutes, usagename AS scope"
              " FROM ev LEFT JOIN hum ON eventid = recordid")
def events_with_inventories(spark, sf_dir):
    rows = with_humboldt(event(spark, sf_dir), humboldt(spark, sf_dir), "eventid")
    scope = F.array_join(F.try_element_at(F.try_element_at("targettaxonomicscope", F.lit("cl-1")), F.lit("usagename")), ";")
    return rows.select("eventid", "eventtype", F.coalesce("eventdurationvalueinminutes", F.lit(-1.0)).alias("minutes"), scope.alias("scope"))


@query("JN5", f"WITH {EVENT_CTE}, {cte('recordid', 'eventid')} SELECT recordid, eventid FROM occ WHERE eventid IN (SELECT eventid FROM ev WHERE eventtype = 'click')")
def records_of_selected_events(spark, sf_dir):
    chosen = event(spark, sf_dir).filter("eventtype = 'click'")
    records = sighting(spark, sf_dir, "recordid", "eventid").withColumn("datasetkey", F.lit("ds-e"))
    return events.records_of(chosen, records).select("recordid", "eventid")


@query("JN6", f"WITH {cte('v_recordedby', 'v_identifiedby')}, r AS (SELECT v_recordedby AS agent, count(*) AS n FROM occ WHERE v_recordedby IS NOT NULL GROUP BY 1),"
              " i AS (SELECT v_identifiedby AS agent, count(*) AS n FROM occ WHERE v_identifiedby IS NOT NULL GROUP BY 1)"
              " SELECT coalesce(r.agent, i.agent) AS agent, coalesce(r.n, 0) AS totalrecordedby, coalesce(i.n, 0) AS totalidentifiedby FROM r FULL JOIN i ON r.agent = i.agent")
def outer_join_of_totals(spark, sf_dir):
    df = sighting(spark, sf_dir, "v_recordedby", "v_identifiedby")

    def totals(column: str, out: str):
        return df.filter(F.col(column).isNotNull()).groupBy(F.col(column).alias("agent")).agg(F.count("*").alias(out))

    return agents.outer_totals(totals("v_recordedby", "totalrecordedby"), totals("v_identifiedby", "totalidentifiedby"),
                               "agent", "totalrecordedby", "totalidentifiedby")


@query("JN7", f"WITH {EVENT_CTE}, {cte('eventid', 'countrycode')} SELECT eventid, eventtype FROM ev WHERE eventid IN (SELECT eventid FROM occ WHERE countrycode = 'NATION_11')")
def events_by_child(spark, sf_dir):
    children = sighting(spark, sf_dir, "eventid", "countrycode").filter("countrycode = 'NATION_11'")
    return having_child(event(spark, sf_dir), children, ["eventid"]).select("eventid", "eventtype")


# One polygon per nation: a strip 14 degrees wide whose upper left corner is cut off.
def nation_layer(spark, sf_dir):
    x = F.col("n_nationkey") * 14.0 - 180

    def corner(dx: float, y: float):
        return F.struct((x + dx).alias("x"), F.lit(y).alias("y"))

    ring = F.array(corner(0, -60.0), corner(14.0, -60.0), corner(14.0, 80.0), corner(4.0037, 80.0), corner(0, 10.0013), corner(0, -60.0))
    return table(spark, sf_dir, "nation").select(F.col("n_name").alias("country"), ring.alias("ring"))


def layer_sql(lat: str, lon: str, key: str = "n.n_nationkey") -> str:
    """Condition that a point lies in the strip of nation ``n``."""
    x0 = f"({key} * 14.0 - 180)"
    inside = f"{lat} BETWEEN -60 AND 80 AND {lon} >= {x0} AND {lon} <= {x0} + 14.0"
    return f"({inside} AND ({lat} <= 10.0013 OR ({lat} - 10.0013) * 4.0037 <= 69.9987 * ({lon} - {x0})))"


@query("JN8", f"WITH {cte('recordid', 'decimallatitude', 'decimallongitude')} SELECT recordid, n_name AS country FROM occ JOIN nation n ON {layer_sql('decimallatitude', 'decimallongitude')}")
def points_in_countries(spark, sf_dir):
    points = sighting(spark, sf_dir, "recordid", "decimallatitude", "decimallongitude").filter("decimallatitude IS NOT NULL")
    return join_layer(points, nation_layer(spark, sf_dir), "decimallatitude", "decimallongitude").select("recordid", "country")


@query("JN9", f"WITH {cte('recordid', 'v_country')} SELECT recordid, n_name AS country FROM occ LEFT JOIN nation ON lower(n_name) = v_country")
def dictionary_lookup(spark, sf_dir):
    from sightings.plans.interpret import with_lookup

    names = table(spark, sf_dir, "nation").select(F.lower("n_name").alias("name"), F.col("n_name").alias("country"))
    return with_lookup(sighting(spark, sf_dir, "recordid", "v_country"), F.lower("v_country"), names, "name").select("recordid", "country")


def _edges(spark, sf_dir):
    """Each record linked with the first record of its taxon and month (a star, not all pairs)."""
    df = sighting(spark, sf_dir, "recordid", "taxonkey", "year", "month").filter("month IS NOT NULL")
    hubs = df.groupBy("taxonkey", "year", "month").agg(F.min("recordid").alias("id1"))
    linked = df.join(hubs, ["taxonkey", "year", "month"]).filter("id1 <> recordid")
    return linked.select("id1", F.col("recordid").alias("id2"), F.lit("SAME_TAXON,SAME_DATE").alias("reasons"))


@query("JN10", f"WITH {cte('recordid', 'taxonkey', 'year', 'month')}, hub AS (SELECT *, min(recordid) OVER (PARTITION BY taxonkey, year, month) AS id1 FROM occ WHERE month IS NOT NULL),"
               " e AS (SELECT id1, recordid AS id2 FROM hub WHERE id1 <> recordid), b AS (SELECT id1 AS recordid, id2 AS relatedid FROM e UNION ALL SELECT id2, id1 FROM e),"
               " r AS (SELECT *, row_number() OVER (PARTITION BY recordid ORDER BY relatedid) AS p FROM b)"
               " SELECT recordid, relatedid, 'SAME_TAXON' AS first_reason, 2 AS reasons FROM r WHERE p <= 100")
def related_records(spark, sf_dir):
    related = relations.related_records(_edges(spark, sf_dir))
    return related.select("recordid", "relatedid", F.col("reasons")[0].alias("first_reason"), F.size("reasons").alias("reasons"))


@query("JN11", f"WITH {EVENT_CTE} SELECT c.eventid, c.parenteventid, p.eventtype AS parenteventtype, coalesce(n.children, 0) AS children FROM ev c"
               " JOIN ev p ON c.datasetkey = p.datasetkey AND c.parenteventid = p.eventid"
               " LEFT JOIN (SELECT parenteventid, count(*) AS children FROM ev GROUP BY 1) n ON n.parenteventid = c.eventid")
def parents_and_children(spark, sf_dir):
    tree = event(spark, sf_dir)
    children = events.children_of(tree).select("datasetkey", "eventid", "children")
    return events.parents_of(tree).join(children, ["datasetkey", "eventid"], "left").select(
        "eventid", "parenteventid", "parenteventtype", F.coalesce("children", F.lit(0)).alias("children"))


@query("JN12", f"WITH RECURSIVE {EVENT_CTE}, walk AS (SELECT eventid, parenteventid AS ancestorid, 1 AS distance FROM ev WHERE parenteventid IS NOT NULL"
               " UNION ALL SELECT w.eventid, e.parenteventid, w.distance + 1 FROM walk w JOIN ev e ON e.eventid = w.ancestorid"
               " WHERE e.parenteventid IS NOT NULL AND w.distance < 300) SELECT eventid, ancestorid, distance FROM walk WHERE eventid <> ancestorid")
def lineage_of_events(spark, sf_dir):
    return events.lineage(event(spark, sf_dir).select("datasetkey", "eventid", "parenteventid")).select("eventid", "ancestorid", "distance")


@query("JN13", f"WITH {cte('recordid', 'eventid', 'species')} SELECT recordid, species FROM occ WHERE eventid = '12' ORDER BY recordid LIMIT 5 OFFSET 2")
def page_of_event_records(spark, sf_dir):
    from sightings.operators.paging import page

    one = event(spark, sf_dir).filter("eventid = '12'")
    records = sighting(spark, sf_dir, "recordid", "eventid", "species").withColumn("datasetkey", F.lit("ds-e"))
    return page(events.records_of(one, records), [F.col("recordid")], offset=2, limit=5).select("recordid", "species")


@query("JN14", f"WITH {cte('recordid', 'datasetkey', 'publishingorgkey')} SELECT datasetkey, publishingorgkey, count(*) AS affected FROM occ"
               " WHERE publishingorgkey IN ('org-2', 'org-5') GROUP BY ALL")
def records_of_changed_organisations(spark, sf_dir):
    from sightings.streaming.changes import affected_records

    changed = table(spark, sf_dir, "supplier").filter("s_suppkey % 10 IN (2, 5)").select(
        F.concat(F.lit("org-"), (F.col("s_suppkey") % 10).cast("string")).alias("publishingorgkey"))
    records = sighting(spark, sf_dir, "recordid", "datasetkey", "publishingorgkey")
    return affected_records(records, changed, "publishingorgkey").groupBy("datasetkey", "publishingorgkey").agg(F.count("*").alias("affected"))


# ---- set operations -------------------------------------------------------------------------------------

@query("SET1", f"WITH {cte('recordid', 'issue_1', 'issue_2', 'taxonissue_1')} SELECT recordid, concat_ws(';', issue_1, issue_2, taxonissue_1) AS issue FROM occ")
def union_of_issue_lists(spark, sf_dir):
    from sightings.functions.text import array_union_all, nested_value

    df = sighting(spark, sf_dir, "recordid", "nontaxonomicissue", "taxonomicissue")
    both = array_union_all(F.col("nontaxonomicissue"), nested_value(F.col("taxonomicissue"), "cl-1"))
    return df.select("recordid", F.array_join(both, ";").alias("issue"))


@query("SET2", f"WITH {cte('eventid', 'datasetkey', 'year')} SELECT DISTINCT eventid, datasetkey FROM occ WHERE year = 1996")
def distinct_event_ids(spark, sf_dir):
    return sighting(spark, sf_dir, "eventid", "datasetkey", "year").filter("year = 1996").select("eventid", "datasetkey").distinct()


@query("SET3", f"WITH {cte('datasetkey')} SELECT datasetkey, count(*) AS num_occurrences FROM occ GROUP BY 1")
def union_of_partials(spark, sf_dir):
    """Counts per year range, as workers would deliver them, added up."""
    df = sighting(spark, sf_dir, "datasetkey", "year")
    early, late = df.filter("year < 1998"), df.filter("year >= 1998")
    return citations.merge_partials([citations.citation(part, with_license=False) for part in (early, late)])


@query("SET4", f"WITH {cte('recordid', 'v_country', 'v_year')} SELECT recordid, v_country, v_year FROM occ")
def difference_of_columns(spark, sf_dir):
    """The verbatim columns that the simple layout does not already have."""
    from sightings.plans.layouts import project_grouped, simple_with_verbatim_pairs
    from sightings.plans.terms import SIMPLE_WITH_VERBATIM_TERMS, VERBATIM

    simple = set(SIMPLE_WITH_VERBATIM_TERMS)
    rest = [p for p in simple_with_verbatim_pairs(["scientificname", "locality", "eventdate", "country", "year"]) if p not in simple]
    if [group for group, _ in rest] != [VERBATIM] * len(rest):
        raise AssertionError("only verbatim columns may remain")
    return project_grouped(sighting(spark, sf_dir, "recordid", "v_country", "v_year"), rest)
