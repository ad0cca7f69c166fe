"""Questions of the inventory answered from stored forms: intervals, curve order, postings, dictionary and kept-up cube.

Every query makes its stored form from the given tables and answers from that; the SQL is that of the plain question.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sightings.catalog import changes as change_queries
from sightings.catalog import counts, filters, joins, places, search  # noqa: F401  (their SQL is asked for below)
from sightings.catalog.registry import ORACLES, query
from sightings.operators import tree_intervals as trees
from sightings.operators.colocated import BucketedTables, buckets_for
from sightings.operators.cursors import SortedCopy, default_key
from sightings.operators.curve import ClusteredTable
from sightings.operators.dictionary import TermDictionary
from sightings.operators.heatmap import heatmap
from sightings.operators.maintained_cube import MaintainedCube
from sightings.operators.postings import DIGITS, PostingsIndex
from sightings.operators.pyramid import Pyramid
from sightings.plans.exports import extension_rows
from sightings.session import scratch_path, staged
from sightings.sources.tables import build_extension_table
from sightings.streaming import changes, versions
from sightings.sources.driver import cte, sighting, table

# ---- taxa as intervals ---------------------------------------------------------------------------

_RANKS = ("kingdom", "family", "specieskey")


def _checklist(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Records with the place of their taxon, sorted by it, and the numbered tree with each node's key and rank."""
    records = sighting(spark, sf_dir, "recordid", *_RANKS)
    names = records.select(*_RANKS).distinct()

    def node(depth: int):
        return F.concat_ws("|", *_RANKS[:depth])

    levels = [
        names.where(F.col(rank).isNotNull()).select(node(k + 1).alias("nodeid"), (node(k) if k else F.lit(None)).alias("parentid"), F.col(rank).alias("key"), F.lit(rank).alias("rank"))
        for k, rank in enumerate(_RANKS)
    ]
    nodes = staged(levels[0].unionByName(levels[1]).unionByName(levels[2]).distinct(), "taxa")
    tree = staged(trees.numbered_tree(nodes).join(nodes.drop("parentid"), "nodeid"), "tree")
    placed = records.withColumn("nodeid", F.concat_ws("|", *_RANKS)).join(tree.select("nodeid", F.col("first").alias("taxonplace")), "nodeid", "left")
    return staged(placed.select("recordid", "taxonplace").repartitionByRange("taxonplace").sortWithinPartitions("taxonplace"), "placed"), tree


@query("FLT16I", ORACLES["FLT16"])
def taxa_by_interval(spark, sf_dir):
    records, tree = _checklist(spark, sf_dir)
    return trees.below(records, "taxonplace", tree, F.col("key").isin("Brand#7", "11")).select("recordid")


@query("FLT17I", ORACLES["FLT17"])
def ranks_by_interval(spark, sf_dir):
    records, tree = _checklist(spark, sf_dir)
    wanted = ((F.col("rank") == "kingdom") & (F.col("key") == "PROMO")) | ((F.col("rank") == "family") & (F.col("key") == "Brand#3"))
    return trees.below(records, "taxonplace", tree, wanted).select("recordid")


@query("AGG21I", ORACLES["AGG21"])
def facet_by_interval(spark, sf_dir):
    records, tree = _checklist(spark, sf_dir)
    found = staged(trees.counts_above(records, "taxonplace", tree, F.lit(True)).join(tree.select("nodeid", "key", "rank"), "nodeid"), "taxon-counts")

    def top(facet: str, rows: DataFrame) -> DataFrame:
        summed = rows.groupBy(F.col("key").alias("term")).agg(F.sum("count").alias("count"))
        return summed.orderBy(F.desc("count"), "term").limit(20).select(F.lit(facet).alias("facet"), "term", "count")

    return top("TAXON_KEY", found).unionByName(top("GENUS", found.where("rank = 'genus'"))).unionByName(top("FAMILY", found.where("rank = 'family'")))


# ---- places in the curve's order -------------------------------------------------------------------

def _clustered(spark: SparkSession, sf_dir: str, *names: str) -> ClusteredTable:
    return ClusteredTable.write(sighting(spark, sf_dir, *names), scratch_path(spark, "clustered"), spread="recordid" if "recordid" in names else None)


@query("GEO1C", ORACLES["GEO1"])
def within_clustered(spark, sf_dir):
    stored = _clustered(spark, sf_dir, *places.COORDINATES)
    found = [stored.within(wkt).select("recordid") for wkt in (places.HOLED, places.PACIFIC, places.CLOCKWISE)]
    return found[0].unionByName(found[1]).unionByName(found[2]).distinct()


@query("GEO4C", ORACLES["GEO4"])
def box_clustered(spark, sf_dir):
    return _clustered(spark, sf_dir, *places.COORDINATES).box(170.0, 10.0, -100.0, 50.0).select("recordid")


@query("GEO6C", ORACLES["GEO6"])
def geohash_clustered(spark, sf_dir):
    box = (-100.0, -40.0, 60.0, 70.0)
    return heatmap(_clustered(spark, sf_dir, *places.HEAT).box(*box), zoom=4, box=box).select("cell", "count")


# ---- texts by postings, terms by a dictionary ---------------------------------------------------------

def _bm25_sql(words: list[str], k: int) -> str:
    listed = ", ".join(f"'{w}'" for w in words)
    return (
        "WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents),"
        " n AS (SELECT count(*) AS n, sum(len(ws)) / count(*) AS mean FROM w), t AS (SELECT doc_id, len(ws) AS l, unnest(ws) AS term FROM w),"
        f" tf AS (SELECT doc_id, l, term, count(*) AS tf FROM t WHERE term IN ({listed}) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1),"
        f" s AS (SELECT CAST(doc_id AS VARCHAR) AS docid, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))), {DIGITS}) AS score"
        f" FROM tf JOIN df USING (term), n GROUP BY 1) SELECT * FROM s ORDER BY score DESC, docid LIMIT {k}"
    )


def _indexed(spark: SparkSession, sf_dir: str) -> PostingsIndex:
    """The documents in two segments, as if some had come later."""
    docs, index = table(spark, sf_dir, "documents"), PostingsIndex(spark, scratch_path(spark, "postings"))
    for part in (docs.where("doc_id % 4 <> 1"), docs.where("doc_id % 4 = 1")):
        index.add(part, "doc_id", F.col("text"))
    return index


@query("TXT1P", _bm25_sql(["model", "license"], 40))
def full_text_by_postings(spark, sf_dir):
    return _indexed(spark, sf_dir).search("model, LICENSE", 40)


@query("SRT2P", _bm25_sql(["the", "data", "and", "model"], 50))
def relevance_by_postings(spark, sf_dir):
    return _indexed(spark, sf_dir).search("The data and model", 50)


@query("TXT3D", ORACLES["TXT3"])
def suggestions_by_dictionary(spark, sf_dir):
    terms = TermDictionary(spark, scratch_path(spark, "terms"))
    terms.apply("all", ["RECORDED_BY"], new=sighting(spark, sf_dir, "recordedby"))
    return terms.suggest("RECORDED_BY", "Customer#00000012", limit=8)


@query("TXT4D", ORACLES["TXT4"])
def terms_by_dictionary(spark, sf_dir):
    """Some records come twice and one version of them goes again."""
    rows, terms = sighting(spark, sf_dir, "locality", "year"), TermDictionary(spark, scratch_path(spark, "terms"))
    some = rows.where("year = 1997")
    terms.apply("first", ["LOCALITY"], new=rows)
    terms.apply("second", ["LOCALITY"], new=some)
    terms.apply("third", ["LOCALITY"], old=some)
    return terms.field_terms("LOCALITY", "17")


# ---- the kept-up cube -----------------------------------------------------------------------------------

_CUBE = ("basisofrecord", "countrycode", "publishingcountry", "year")


def _kept_up(spark: SparkSession, sf_dir: str) -> MaintainedCube:
    """The cube of all records, which came in two batches, one with a wrong year that was mended later."""
    rows, cube = sighting(spark, sf_dir, *_CUBE), MaintainedCube(spark, scratch_path(spark, "cube"), _CUBE)
    late = rows.where("year = 1998")
    wrong = late.withColumn("year", F.lit(1066))
    cube.apply("early", new=rows.where("year <> 1998"))
    cube.apply("late", new=wrong)
    cube.apply("mended", old=wrong, new=late)
    cube.apply("mended", old=wrong, new=late)
    return cube


@query("AGG25M", ORACLES["AGG25"])
def addresses_of_kept_cube(spark, sf_dir):
    cube = _kept_up(spark, sf_dir)
    asked = {"country": {"countrycode": "NATION_2"}, "basis+year": {"basisofrecord": "OCCURRENCE", "year": 1998}, "any": {}}
    found = [cube.count(address).select(F.lit(name).alias("address"), "count") for name, address in asked.items()]
    return found[0].unionByName(found[1]).unionByName(found[2])


@query("AGG27M", ORACLES["AGG27"])
def years_of_kept_cube(spark, sf_dir):
    return _kept_up(spark, sf_dir).counts({}, ["year"]).where("year BETWEEN 1996 AND 1999")


@query("AGG28M", ORACLES["AGG28"])
def countries_of_kept_cube(spark, sf_dir):
    cube = _kept_up(spark, sf_dir)
    publishers = cube.counts({"countrycode": "NATION_4"}, ["publishingcountry"]).select(F.lit("publishers").alias("side"), F.col("publishingcountry").alias("country"), "count")
    published = cube.counts({"publishingcountry": "NATION_4"}, ["countrycode"]).select(F.lit("published").alias("side"), F.col("countrycode").alias("country"), "count")
    return publishers.unionByName(published)


# ---- heatmap pyramid ------------------------------------------------------------------------------------

def _pyramid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, Pyramid]:
    records = sighting(spark, sf_dir, *places.HEAT)
    return records, Pyramid.write(records, scratch_path(spark, "pyramid"))


@query("GEO6P", ORACLES["GEO6"])
def geohash_pyramid_box(spark, sf_dir):
    records, pyramid = _pyramid(spark, sf_dir)
    return pyramid.heatmap(4, (-100.0, -40.0, 60.0, 70.0), records).select("cell", "count")


@query("GEO7P", ORACLES["GEO7"])
def geohash_pyramid_bounds(spark, sf_dir):
    return _pyramid(spark, sf_dir)[1].heatmap(0)


@query("GEO8P", ORACLES["GEO8"])
def geohash_pyramid_centroids(spark, sf_dir):
    cells = _pyramid(spark, sf_dir)[1].heatmap(2, mode="GEO_CENTROID")
    return cells.select("cell", "count", F.round("latitude", 6).alias("latitude"), F.round("longitude", 6).alias("longitude"))


# ---- pages of a sorted copy -----------------------------------------------------------------------------

@query("SRT1K", ORACLES["SRT1"])
def first_page_of_copy(spark, sf_dir):
    copy = SortedCopy.write(sighting(spark, sf_dir, "recordid", "year", "month"), scratch_path(spark, "sorted"), default_key())
    return copy.page(0, 300).select("recordid", "year")


@query("SRT4K", f"WITH {cte('recordid', 'year', 'month')}, p AS (SELECT recordid FROM occ ORDER BY year NULLS LAST, month NULLS LAST, recordid"
                " LIMIT 300 OFFSET (SELECT CAST(count(*) * 9 // 10 AS BIGINT) FROM occ)) SELECT recordid, (SELECT count(*) FROM occ) AS total FROM p")
def deep_page_of_copy(spark, sf_dir):
    """A page behind nine tenths of all rows, and the number of all."""
    copy = SortedCopy.write(sighting(spark, sf_dir, "recordid", "year", "month"), scratch_path(spark, "sorted"), default_key())
    total = copy.total()
    return copy.page(total * 9 // 10, 300).select("recordid", F.lit(total).cast("bigint").alias("total"))


# ---- tables in shared buckets ----------------------------------------------------------------------------

@query("JN1B", ORACLES["JN1"])
def extension_in_buckets(spark, sf_dir):
    rows = sighting(spark, sf_dir, "recordid", "year")
    stored = BucketedTables(spark, scratch_path(spark, "buckets"), buckets_for(table(spark, sf_dir, "lineitem").count()))
    stored.write("main", rows, ["recordid"])
    stored.write("remarks", build_extension_table(joins._part_extension(spark, sf_dir)), ["recordid"])
    return extension_rows(stored.table("remarks"), stored.table("main").where("year = 1997"))


# ---- changes of objects as a stream ------------------------------------------------------------------------

def _version_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Typed changes from a stream that brings the old snapshot, then, in files of several batches, what changed."""
    old, new = (change_queries._snapshot(spark, sf_dir, sql) for sql in (change_queries._OLD, change_queries._NEW))
    schema, dataset, day = old.schema, F.lit("dataset").alias("objecttype"), 86_400_000_000

    def messages(rows: DataFrame, at: int, gone: bool = False) -> DataFrame:
        value = F.lit(None).cast(schema) if gone else F.struct(*[F.col(c) for c in schema.names])
        return rows.select(dataset, "key", F.lit(at).cast("bigint").alias("at"), value.alias("object"))

    deleted = old.join(new.select("key"), "key", "left_anti")
    later = new.where("n % 5 = 0")
    end = spark.createDataFrame([("end",)], "key string").select(dataset, "key", F.lit(9 * day).cast("bigint").alias("at"), F.lit(None).cast(schema).alias("object"))
    folder = scratch_path(spark, "versions")
    parts = [messages(old, day), messages(new, 2 * day), messages(deleted, 2 * day, gone=True), messages(later, 2 * day), end, end.withColumn("at", F.col("at") + 1)]
    for part in parts:  # some messages come twice; the last ones only move the watermark
        part.coalesce(2).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 3).parquet(folder)
    found = versions.object_changes(stream, "1 hour")
    path = scratch_path(spark, "version-changes")
    changes.run_to_table(found, path, scratch_path(spark, "version-state"))
    rows = spark.read.schema(found.schema).parquet(f"{path}/batch=*").where(F.col("at") == 2 * day)
    return versions.with_objects(rows, schema)


@query("CHG1S", ORACLES["CHG1"])
def changed_datasets_of_stream(spark, sf_dir):
    rows = _version_stream(spark, sf_dir)
    changed = (F.col("changetype") == "UPDATED") & changes.dataset_requires_update("old", "new", change_queries._at())
    return rows.select("key", "changetype", changed.alias("changed"))


@query("CHG8S", ORACLES["CHG8"])
def actions_of_stream(spark, sf_dir):
    rows = _version_stream(spark, sf_dir)
    return rows.select("key", F.array_join(changes.dataset_actions(change_queries._at()), ";").alias("actions"))
