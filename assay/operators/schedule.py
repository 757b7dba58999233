"""Rebalance dates, their execution dates, and the holding periods between executions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .panel import local

#: Period ends by alias; weeks end on Sunday.
UNITS = {"ME": "month", "M": "month", "QE": "quarter", "Q": "quarter", "YE": "year", "Y": "year", "A": "year", "W": "week", "D": "day"}


def rebalance_dates(calendar: DataFrame, freq: str = "ME") -> DataFrame:
    """(t): the last date of each period; the last period may be partial."""
    if freq not in UNITS:
        raise ValueError(f"unknown frequency {freq!r}; known: {', '.join(UNITS)}")
    return calendar.groupBy(F.date_trunc(UNITS[freq], "t").alias("_unit")).agg(F.max("t").alias("t")).select("t")


def schedule(calendar: DataFrame, freq: str = "ME", lag: int = 1) -> DataFrame:
    """(period, t_signal, t_exec, i_exec, t_next, i_next): a signal is traded `lag` calendar rows later, if there are as many; t_next is null for the last."""
    moved = calendar.select("t", F.lead("t", lag).over(W.orderBy("t")).alias("t_exec"), (F.col("i") + lag).alias("i_exec"))
    s = rebalance_dates(calendar, freq).join(moved, "t").where("t_exec is not null").withColumnRenamed("t", "t_signal")
    w = W.orderBy("t_exec")
    return s.select((F.row_number().over(w) - 1).alias("period"), "t_signal", "t_exec", "i_exec", F.lead("t_exec").over(w).alias("t_next"), F.lead("i_exec").over(w).alias("i_next"))


def settled(sched: DataFrame) -> tuple[DataFrame, list]:
    """A schedule as a local table, and its rows: one for each rebalance date."""
    rows = sorted(sched.collect(), key=lambda r: r["period"])
    types = {"period": pa.int32(), "t_signal": pa.date32(), "t_exec": pa.date32(), "i_exec": pa.int32(), "t_next": pa.date32(), "i_next": pa.int32()}
    return local(sched.sparkSession, {c: [r[c] for r in rows] for c in types}, **types), rows
