"""User SQL over named views."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from sightings.functions.register import register_functions
from sightings.operators.citations import citation
from sightings.operators.metrics import count_where


def dialect(sql: str) -> str:
    """Identifiers in double quotes become backticked; quoted text is left alone."""
    out, in_text = [], False
    for ch in sql:
        if ch == "'":
            in_text = not in_text
        out.append("`" if ch == '"' and not in_text else ch)
    return "".join(out)


def run_user_sql(spark: SparkSession, views: Mapping[str, DataFrame], sql: str) -> DataFrame:
    """A user's SELECT over the given views; anything but a query is refused.

    Commands run as soon as they are given to Spark, so the text is first analysed as a
    subquery, where a command is a syntax error.
    """
    register_functions(spark)
    for name, df in views.items():
        df.createOrReplaceTempView(name)
    text = dialect(sql).strip().rstrip(";")
    spark.sql(f"SELECT * FROM (\n{text}\n) LIMIT 0")
    return spark.sql(text)


def sql_export(spark: SparkSession, views: Mapping[str, DataFrame], sql: str, base: str = "occurrence",
               where: str | None = None) -> dict[str, DataFrame]:
    """Result, row count and citation; the citation filters the base table like the query."""
    result = run_user_sql(spark, views, sql)
    rows = views[base] if where is None else views[base].where(dialect(where))
    return {"result": result, "count": count_where(result), "citation": citation(rows)}
