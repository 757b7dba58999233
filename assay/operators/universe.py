"""Point-in-time universe: membership snapshots stamped on change dates; a date between two has the earlier one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


class Universe:
    """snapshots: (valid_from DATE, tickers ARRAY<STRING>). Of several rows of a date the last one holds (by `seq`, if the table has it, else the longest list)."""

    def __init__(self, snapshots: DataFrame, name: str = "universe"):
        order = [F.desc("seq")] if "seq" in snapshots.columns else [F.desc(F.size("tickers")), F.desc(F.array_join("tickers", ","))]
        s = snapshots.withColumn("valid_from", F.col("valid_from").cast("date")).where("valid_from is not null")
        s = s.withColumn("_rn", F.row_number().over(W.partitionBy("valid_from").orderBy(*order))).where("_rn = 1")
        self.snapshots = s.select("valid_from", "tickers")
        self.name = name

    def tickers(self) -> DataFrame:
        """(ticker): everything that ever was a member, in order."""
        return self.snapshots.select(F.explode("tickers").alias("ticker")).where("ticker <> ''").distinct().orderBy("ticker")

    def stamped(self, dates: DataFrame) -> DataFrame:
        """(t, valid_from): the snapshot each date sees, by the last one at or before it; null before the first."""
        both = dates.select(F.col("t").cast("date").alias("t"), F.lit(None).cast("date").alias("valid_from")).distinct()
        both = both.unionByName(self.snapshots.select(F.col("valid_from").alias("t"), "valid_from"))
        # a table of dates: one ordered pass over it, snapshots first on their own day
        w = W.orderBy("t", F.col("valid_from").asc_nulls_last()).rowsBetween(W.unboundedPreceding, 0)
        seen = both.withColumn("seen", F.last("valid_from", ignorenulls=True).over(w))
        return seen.where("valid_from is null").select("t", F.col("seen").alias("valid_from"))

    def members_on(self, day: str | Column) -> DataFrame:
        """(ticker): the members on a date; none before the first snapshot."""
        day = F.lit(day).cast("date") if not isinstance(day, Column) else day
        last = self.snapshots.where(F.col("valid_from") <= day).orderBy(F.desc("valid_from")).limit(1)
        return last.select(F.explode("tickers").alias("ticker")).distinct()

    def mask(self, dates: DataFrame, assets: DataFrame) -> DataFrame:
        """(t, asset, eligible) for every date and asset. Assets that no snapshot knows never are eligible."""
        days = dates.select(F.col("t").cast("date").alias("t")).distinct()
        grid = assets.select("asset").distinct().crossJoin(F.broadcast(days))  # the mask's own shape; dates are few
        members = self.stamped(dates).join(self.snapshots, "valid_from").select("t", F.explode("tickers").alias("asset")).distinct()
        return grid.join(members.withColumn("_in", F.lit(True)), ["t", "asset"], "left").select("t", "asset", F.coalesce("_in", F.lit(False)).alias("eligible"))

    def coverage(self, assets: DataFrame) -> DataFrame:
        """One row: have, want: how many of all members ever the panel has."""
        t = self.tickers()
        have = t.join(assets.select(F.col("asset").alias("ticker")).distinct().withColumn("_in", F.lit(1)), "ticker", "left")
        return have.agg(F.count("_in").alias("have"), F.count(F.lit(1)).alias("want"))
