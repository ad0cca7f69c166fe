"""Order, pages, full text and suggestions."""

from __future__ import annotations

from pyspark.sql import functions as F

from sightings.catalog.registry import query
from sightings.operators import paging, text_search
from sightings.sources.driver import OWN_COLUMNS, cte, sighting, table


@query("SRT1", f"WITH {cte('recordid', 'year', 'month')} SELECT recordid, year FROM occ ORDER BY year NULLS LAST, month NULLS LAST, recordid LIMIT 300")
def default_order(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "year", "month")
    return paging.page(df, paging.default_order(), limit=300).select("recordid", "year")


_TOKENS = "list_distinct(list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> ''))"


@query("SRT2", f"SELECT doc_id, len(list_intersect({_TOKENS}, ['the', 'data', 'and', 'model'])) AS score FROM documents"
               f" WHERE len(list_intersect({_TOKENS}, ['the', 'data', 'and', 'model'])) > 0 ORDER BY score DESC, doc_id LIMIT 50")
def relevance_order(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    found = text_search.search(docs, "The data and model", F.col("text"))
    return paging.page(found, [F.desc("score"), F.col("doc_id")], limit=50).select("doc_id", F.col("score").cast("bigint").alias("score"))


_PLACE = "CAST('0x' || substr(md5(recordid || '|seed-1'), 1, 8) AS BIGINT) % 1000000"


@query("SRT3", f"WITH {cte('recordid', 'year')} SELECT recordid, year FROM occ ORDER BY {_PLACE}, recordid LIMIT 200")
def seeded_shuffle(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "year")
    return paging.page(df, paging.shuffled_order("seed-1"), limit=200)


@query("SRT4", f"WITH {cte('recordid', 'year', 'month')}, p AS (SELECT recordid FROM occ WHERE year = 1999 ORDER BY year, month NULLS LAST, recordid LIMIT 300 OFFSET 40)"
               " SELECT recordid, (SELECT count(*) FROM occ WHERE year = 1999) AS total FROM p")
def page_with_total(spark, sf_dir):
    """A page asked larger than allowed, and the number of all hits."""
    hits = sighting(spark, sf_dir, "recordid", "year", "month").filter("year = 1999")
    page = paging.page(hits, paging.default_order(), offset=40, limit=1000)
    total = paging.total(hits).first().total
    return page.select("recordid", F.lit(total).cast("bigint").alias("total"))


@query("SRT5", f"WITH {cte('recordid')} SELECT recordid FROM occ")
def export_slices(spark, sf_dir):
    return paging.export_slices(sighting(spark, sf_dir, "recordid"), 6)


@query("SRT6", f"WITH {cte('recordid', 'elevation')} SELECT recordid, round(elevation, 4) AS elevation FROM occ ORDER BY occ.elevation DESC, recordid LIMIT 25")
def user_order_and_limit(spark, sf_dir):
    df = sighting(spark, sf_dir, "recordid", "elevation")
    top = df.orderBy(F.desc("elevation"), "recordid").limit(25)
    return top.select("recordid", F.round("elevation", 4).alias("elevation"))


@query("SRT7", f"WITH {cte('species')} SELECT species AS term, count(*) AS count FROM occ GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 7")
def most_frequent_terms(spark, sf_dir):
    counts = sighting(spark, sf_dir, "species").groupBy(F.col("species").alias("term")).agg(F.count("*").alias("count"))
    return counts.orderBy(F.desc("count"), "term").limit(7)


@query("TXT1", f"SELECT doc_id, CAST(len(list_intersect({_TOKENS}, ['model', 'license'])) + 100 * (CASE WHEN source = 'license' THEN 1 ELSE 0 END) AS INT) AS score FROM documents"
               f" WHERE len(list_intersect({_TOKENS}, ['model', 'license'])) > 0")
def full_text_query(spark, sf_dir):
    """Every document with any word of the query, over the whole texts."""
    docs = table(spark, sf_dir, "documents")
    found = text_search.search(docs, "model, LICENSE", F.col("text"), [(F.col("source"), text_search.BOOSTS["scientific_name"])])
    return found.select("doc_id", "score")


_TEXTS = ("occurrenceid institutioncode collectioncode catalognumber recordnumber license basisofrecord occurrencestatus eventid species genus family"
          " kingdom scientificname taxonrank countrycode publishingcountry locality recordedbyid identifiedbyid sex_concept lifestage_concept"
          " v_scientificname v_locality v_country v_countrycode v_basisofrecord v_decimallatitude v_decimallongitude v_geodeticdatum"
          " v_coordinateuncertaintyinmeters v_coordinateprecision v_minimumdepthinmeters v_maximumdepthinmeters v_year v_month v_day v_eventdate"
          " v_startdayofyear v_enddayofyear v_recordedby v_identifiedby v_recordedbyid v_identifiedbyid").split()
_NUMBERS = "year month day decimallatitude decimallongitude coordinateuncertaintyinmeters elevation depth distancefromcentroidinmeters".split()
_FULL = f"list_distinct(list_filter([{', '.join([*_TEXTS, *[f'CAST({n} AS VARCHAR)' for n in _NUMBERS]])}], lambda x: x IS NOT NULL))"


@query("TXT2", f"WITH {cte('recordid', *_TEXTS, *_NUMBERS, optional=('s', 'sn'))} SELECT recordid, array_to_string(list_sort({_FULL}), '|') AS fulltext FROM occ")
def full_text_field(spark, sf_dir):
    """The texts of all columns of a record; one without a supplier, or a supplier without a country, stays."""
    df = sighting(spark, sf_dir, *OWN_COLUMNS, optional=("s", "sn"))
    return df.select("recordid", F.array_join(F.sort_array(text_search.full_text(df)), "|").alias("fulltext"))


@query("TXT3", f"WITH {cte('recordedby_1', 'recordedby_2')}, v AS (SELECT recordedby_1 AS value FROM occ UNION SELECT recordedby_2 FROM occ)"
               " SELECT value FROM v WHERE lower(value) LIKE 'customer#00000012%' ORDER BY 1 LIMIT 8")
def prefix_suggestions(spark, sf_dir):
    return text_search.suggest(sighting(spark, sf_dir, "recordedby"), "RECORDED_BY", "Customer#00000012", limit=8)


@query("TXT4", f"WITH {cte('locality')} SELECT locality AS term, count(*) AS count FROM occ WHERE locality LIKE '% 17' OR lower(locality) LIKE '17%' GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def term_search(spark, sf_dir):
    return text_search.field_terms(sighting(spark, sf_dir, "locality"), "LOCALITY", "17")
