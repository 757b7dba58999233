"""Membership files: CSV with a date and comma-joined tickers, gzip by extension."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from assay.operators.universe import Universe


def read_membership(spark: SparkSession, path: str, name: str = "universe") -> Universe:
    """A universe from a file with the columns date and tickers."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
        raise FileNotFoundError(f"{path} is missing: give a CSV file of change dates (date) and comma-joined constituents (tickers), or build a Universe from any such table")
    df = spark.read.csv(path, header=True, schema="date string, tickers string")
    rows = df.select(F.to_date(F.substring("date", 1, 10)).alias("valid_from"), F.split("tickers", ",").alias("tickers"), F.monotonically_increasing_id().alias("seq"))
    return Universe(rows, name)


def sp500(spark: SparkSession, path: str) -> Universe:
    """The S&P 500's history, from a membership file of the caller's, as none is shipped."""
    return read_membership(spark, path, "S&P 500")
