"""Reads arriving over time: counts per case and event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def case_counts(reads: DataFrame, window: str = "1 hour", late: str = "60 days", time: str = "read_ts") -> DataFrame:
    """(start, case, reads, bases) per window of event time; rows later than
    `late` behind the newest are dropped by a stream, whose state holds the
    windows of that time (reads are loaded up to seven weeks late, so the default
    loses none). Works on a batch as well, where nothing is late."""
    counted = reads.withWatermark(time, late).groupBy(F.window(time, window).alias("w"), "case").agg(F.count("*").alias("reads"), F.sum(F.length("genomic_sequence")).alias("bases"))
    return counted.select(F.col("w.start").alias("start"), "case", "reads", "bases")
