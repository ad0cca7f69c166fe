"""The tree of sampling events: parents, children, lineage and their records."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sightings.session import staged

# Fixed value: ancestors followed at most.
MAX_DEPTH = 300


def parents_of(events: DataFrame) -> DataFrame:
    """Each event with its parent's row, where the parent exists."""
    parent = events.select("datasetkey", F.col("eventid").alias("parenteventid"), F.col("eventtype").alias("parenteventtype"))
    return events.join(parent, ["datasetkey", "parenteventid"])


def children_of(events: DataFrame) -> DataFrame:
    """Each event with the number of its sub-events."""
    counts = events.filter("parenteventid IS NOT NULL").groupBy("datasetkey", "parenteventid").agg(F.count("*").alias("children"))
    return events.join(counts.withColumnRenamed("parenteventid", "eventid"), ["datasetkey", "eventid"])


def records_of(events: DataFrame, records: DataFrame) -> DataFrame:
    """Records of the selected events, matched on event and dataset; a record appears once."""
    return records.join(events.select("eventid", "datasetkey").distinct(), ["eventid", "datasetkey"], "left_semi")


def lineage(events: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """Every (event, ancestor, distance), nearest first, up to a root, a repeat or the depth.

    Ancestors are found by doubling: a round joins each event's 2**k-th ancestor with
    that ancestor's own list, so 300 levels take nine rounds, not three hundred, and
    each round writes only the pairs it found.  A walk into a cycle meets its ids again
    at a larger distance only; the smallest one is kept and an event is never its
    own ancestor.
    """
    known = events.select("datasetkey", F.col("eventid").alias("ancestorid")).distinct()
    links = events.filter("parenteventid IS NOT NULL").select("datasetkey", "eventid", F.col("parenteventid").alias("ancestorid")).distinct()
    first = links.join(known, ["datasetkey", "ancestorid"]).select("datasetkey", "eventid", "ancestorid", F.lit(1).alias("distance"))
    found, reach = [staged(first, "lineage")], 1
    while reach < max_depth:
        top = found[-1].filter(F.col("distance") == reach).select("datasetkey", "eventid", F.col("ancestorid").alias("via"))
        if top.isEmpty():
            break
        further = reduce(DataFrame.unionByName, found).select("datasetkey", F.col("eventid").alias("via"), "ancestorid", "distance")
        # an ancestor without a list of its own is a root: the inner join drops it
        grown = top.join(further, ["datasetkey", "via"]).select(
            "datasetkey", "eventid", "ancestorid", (F.col("distance") + reach).alias("distance"))
        found.append(staged(grown.filter(F.col("distance") <= max_depth), "lineage"))
        reach *= 2
    pairs = reduce(DataFrame.unionByName, found).filter(F.col("eventid") != F.col("ancestorid"))
    return pairs.groupBy("datasetkey", "eventid", "ancestorid").agg(F.min("distance").alias("distance"))
