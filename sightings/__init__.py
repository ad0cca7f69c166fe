"""Biodiversity record analytics on Spark DataFrames."""

__all__ = ["catalog", "functions", "operators", "plans", "sources", "streaming"]
