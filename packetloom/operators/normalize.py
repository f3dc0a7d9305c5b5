"""Logs to the unified event schema."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import FIELDS, LOGS, UNIFIED
from ..sources.logs import read_log, union_all


def normalize(df: DataFrame, log_type: str) -> DataFrame:
    """One projection: renamed, cast (null where a value does not fit), missing fields null, extra ones dropped, in schema order."""
    if log_type not in FIELDS:
        raise ValueError(f"unknown log type {log_type!r}")
    source = {new: old for old, new in FIELDS[log_type].items() if old in df.columns}
    have = dict(df.dtypes)

    def field(name: str, kind: str):
        if name == "log_type":
            return F.lit(log_type)
        if name not in source:
            return F.lit(None).cast(kind)
        col = F.col(f"`{source[name]}`")
        return col if have[source[name]] == kind else col.try_cast(kind)

    return df.select([field(f.name, f.dataType.simpleString()).alias(f.name) for f in UNIFIED])


def merge(*frames: DataFrame) -> DataFrame:
    """A bag union by column name; an error without frames. Order is left to ordered()."""
    return union_all(frames)


def ordered(events: DataFrame) -> DataFrame:
    """By time, nulls last, with tie-breakers. A range-partitioned sort: use it for output, not between operators."""
    return events.orderBy(F.asc_nulls_last("timestamp"), "uid", "log_type")


def read_and_normalize(spark: SparkSession, path: str, log_type: str) -> DataFrame:
    if log_type not in LOGS:
        raise ValueError(f"unknown log type {log_type!r}")
    return normalize(read_log(spark, path, LOGS[log_type]), log_type)
