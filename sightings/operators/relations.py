"""Related records from an edge list."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Fixed value: related records returned per record.
MAX_RELATED = 100


def related_records(edges: DataFrame, limit: int = MAX_RELATED) -> DataFrame:
    """Both directions of each edge, at most ``limit`` related records per record, reasons split.

    The row-number filter is a limit the planner also applies before the shuffle, so a
    record with many edges sends at most ``limit`` rows per task.
    """
    directions = [F.struct(F.col(a).alias("recordid"), F.col(b).alias("relatedid")) for a, b in (("id1", "id2"), ("id2", "id1"))]
    both = edges.select(F.explode(F.array(*directions)).alias("d"), "reasons").select("d.recordid", "d.relatedid", "reasons")
    order = Window.partitionBy("recordid").orderBy("relatedid")
    ranked = both.withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= limit).select("recordid", "relatedid", F.split("reasons", ",").alias("reasons"))
