"""Regular series of buckets: gap-filled aggregates, rolling statistics, spikes, splits, autocorrelation.

Windows without a partition run over buckets, never over events: a bucket series is small by construction. Give `key` to hold many series
side by side, each ordered within its own partition.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import percent, ratio
from .eda import failed, nxdomain

UNITS = {"us": 1e-6, "ms": 1e-3, "s": 1, "sec": 1, "min": 60, "t": 60, "h": 3600, "d": 86400}


def seconds_of(width: str) -> float:
    """Seconds of an offset such as "1min", "5s" or "h"."""
    m = re.fullmatch(r"\s*(\d*)\s*([A-Za-z]+)\s*", width)
    if not m or m[2].lower() not in UNITS:
        raise ValueError(f"unknown bucket width {width!r}")
    return int(m[1] or 1) * UNITS[m[2].lower()]


def micros(ts: Column) -> Column:
    """Microseconds since the epoch, in UTC, of either kind of timestamp."""
    return F.unix_micros(ts.cast("timestamp"))


def bucket(df: DataFrame, width: str, time: str = "timestamp") -> DataFrame:
    """Adds `bucket`, the start of the row's bucket. Buckets of a width that divides a day start at midnight; others count from the
    midnight of the first day of the data (one more aggregation). Rows without a time get a null bucket."""
    size = round(seconds_of(width) * 1e6)
    day = 86_400_000_000
    at = micros(F.col(time))
    if day % size == 0:
        start = at - F.pmod(at, F.lit(size))
        return df.withColumn("bucket", F.timestamp_micros(start))
    first = df.agg(F.min(time).alias("_first")).select((micros(F.col("_first")) - F.pmod(micros(F.col("_first")), F.lit(day))).alias("_origin"))
    with_origin = df.join(F.broadcast(first))  # one row
    return with_origin.withColumn("bucket", F.timestamp_micros(at - F.pmod(at - F.col("_origin"), F.lit(size)))).drop("_origin")


def fill_gaps(buckets: DataFrame, width: str, key: Sequence[str] = ()) -> DataFrame:
    """Adds the missing buckets between the first and the last (of each key), other columns null. The spine is made from min and max alone."""
    step = F.expr(f"make_dt_interval(0, 0, 0, cast({seconds_of(width)} as decimal(18, 6)))")
    ends = buckets.where("bucket is not null").groupBy(*key).agg(F.min("bucket").alias("a"), F.max("bucket").alias("b")).where("a is not null")
    spine = ends.select(*key, F.explode(F.sequence("a", "b", step)).alias("bucket"))
    return spine.join(buckets, [*key, "bucket"], "left")


def conn_series(conn: DataFrame, width: str, key: Sequence[str] = ()) -> DataFrame:
    """Per bucket: failed, total, bytes; failed rate in percent and the ratio of summed bytes, both 0 where undefined. Gaps hold zeros."""
    b = bucket(conn, width).where("bucket is not null")
    agg = b.groupBy(*key, "bucket").agg(
        F.count_if(failed()).alias("failed_connections"), F.count("*").alias("total_connections"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_sent"), F.coalesce(F.sum("bytes_recv"), F.lit(0)).alias("bytes_recv"),
    )
    full = fill_gaps(agg, width, key).fillna(0)
    return full.withColumns({"failed_rate": percent(F.col("failed_connections"), F.col("total_connections")), "bytes_ratio": ratio(F.col("bytes_sent"), F.col("bytes_recv"), 0.0)})


def dns_series(dns: DataFrame, width: str, key: Sequence[str] = ()) -> DataFrame:
    """Per bucket: failed look-ups, look-ups with a response code, and their rate in percent."""
    b = bucket(dns, width).where("bucket is not null")
    agg = b.groupBy(*key, "bucket").agg(F.count_if(nxdomain()).alias("nxdomain_count"), F.count("dns_rcode").alias("total_dns"))
    return fill_gaps(agg, width, key).fillna(0).withColumn("nxdomain_rate", percent(F.col("nxdomain_count"), F.col("total_dns")))


def series(conn: DataFrame | None, dns: DataFrame | None, width: str = "1min", key: Sequence[str] = ()) -> DataFrame:
    """Both series side by side (each filled over its own span), zeros where one has no bucket."""
    parts = ([conn_series(conn, width, key)] if conn is not None else []) + ([dns_series(dns, width, key)] if dns is not None else [])
    if not parts:
        raise ValueError("no log given")
    return parts[0] if len(parts) == 1 else parts[0].join(parts[1], [*key, "bucket"], "full").fillna(0)


def spike_series(events: DataFrame, width: str = "1min") -> DataFrame:
    """(bucket, connections, nxdomain, failed): all events, failed look-ups and failed connections, in one pass, gaps zero."""
    b = bucket(events, width).where("bucket is not null")
    agg = b.groupBy("bucket").agg(F.count("*").alias("connections"), F.count_if(nxdomain()).alias("nxdomain"), F.count_if(failed()).alias("failed"))
    return fill_gaps(agg, width).fillna(0)


def frame(size: int | None = None, key: Sequence[str] = (), order: str = "bucket"):
    w = Window.partitionBy(*key).orderBy(order)
    return w if size is None else w.rowsBetween(-(size - 1), 0)


def rolling(df: DataFrame, metrics: Sequence[str], window: int = 10, key: Sequence[str] = ()) -> DataFrame:
    """Adds trailing mean, sample deviation, variance and z-score (0 where the deviation is not positive) of each metric."""
    w, out = frame(window, key), df
    for m in metrics:
        out = out.withColumns({f"{m}_rolling_mean": F.avg(m).over(w), f"{m}_rolling_std": F.stddev_samp(m).over(w), f"{m}_rolling_var": F.var_samp(m).over(w)})
        std = F.col(f"{m}_rolling_std")
        out = out.withColumn(f"{m}_zscore", F.when(std > 0, (F.col(m) - F.col(f"{m}_rolling_mean")) / std).otherwise(0.0))
    return out


def spikes(df: DataFrame, metric: str = "connections", window: int = 10, multiplier: float = 2.0, key: Sequence[str] = ()) -> DataFrame:
    """Adds the trailing moving average and whether the value exceeds multiplier times it."""
    return df.withColumn("sma", F.avg(metric).over(frame(window, key))).withColumn("anomaly", F.col(metric) > F.col("sma") * multiplier)


def spike_summary(df: DataFrame, first: int = 10) -> DataFrame:
    """(buckets, anomalies, first_anomalies): totals and the first few anomalous buckets in time order."""
    low = df.where("anomaly").orderBy("bucket").limit(first).agg(F.array_sort(F.collect_list("bucket")).alias("first_anomalies"))
    return df.agg(F.count("*").alias("buckets"), F.count_if("anomaly").alias("anomalies")).join(low)  # one row by one row


def split(df: DataFrame, train: float = 0.6, validation: float = 0.2, order: str = "bucket") -> DataFrame:
    """Adds `part`: train, validation or test by position in time, never at random."""
    w = Window.orderBy(order)
    n = F.count("*").over(Window.partitionBy())
    k = F.row_number().over(w) - 1
    a, b = F.floor(n * train), F.floor(n * (train + validation))
    return df.withColumn("part", F.when(k < a, "train").when(k < b, "validation").otherwise("test"))


def stationarity(df: DataFrame, metric: str, order: str = "bucket") -> DataFrame:
    """Mean and variance of the two halves and whether they agree (mean ratio under 0.5, variance ratio under 2); null under ten values."""
    rows = df.where(F.col(metric).isNotNull()).select(order, F.col(metric).cast("double").alias("x"))
    half = F.row_number().over(Window.orderBy(order)) <= F.floor(F.count("*").over(Window.partitionBy()) / 2)
    part = rows.withColumn("first", half)
    agg = part.agg(
        F.count("*").alias("n"), F.avg("x").alias("mean"), F.stddev_samp("x").alias("std"), F.var_samp("x").alias("variance"),
        F.avg(F.when(F.col("first"), F.col("x"))).alias("mean_first"), F.avg(F.when(~F.col("first"), F.col("x"))).alias("mean_second"),
        F.var_samp(F.when(F.col("first"), F.col("x"))).alias("var_first"), F.var_samp(F.when(~F.col("first"), F.col("x"))).alias("var_second"),
    )
    mean_ratio = F.abs(F.col("mean_first") - F.col("mean_second")) / (F.col("mean_first") + 1e-10)
    var_ratio = F.greatest("var_first", "var_second") / (F.least("var_first", "var_second") + 1e-10)
    return agg.withColumns({"mean_ratio": mean_ratio, "var_ratio": var_ratio}).withColumn("is_stationary", F.when(F.col("n") >= 10, (F.col("mean_ratio") < 0.5) & (F.col("var_ratio") < 2.0)))


LAGS = (5, 15, 30, 60, 120, 360, 720, 1440)


def autocorrelation(df: DataFrame, metric: str, lags: Sequence[int] = LAGS, order: str = "bucket") -> DataFrame:
    """(lag, correlation) for each lag below half the length, all from one sorted pass."""
    rows = df.where(F.col(metric).isNotNull()).select(order, F.col(metric).cast("double").alias("x"))
    w = Window.orderBy(order)
    wide = rows.select("x", *[F.lag("x", p).over(w).alias(f"l{p}") for p in lags])
    found = wide.agg(F.count("*").alias("n"), *[F.corr("x", f"l{p}").alias(f"c{p}") for p in lags])
    each = F.array(*[F.struct(F.lit(p).alias("lag"), F.col(f"c{p}").alias("correlation")) for p in lags])
    return found.select("n", F.inline(each)).where("lag < floor(n / 2)").select("lag", "correlation")


def strongest_period(correlations: DataFrame) -> DataFrame:
    """The lag of largest absolute correlation; of ties the smallest."""
    return correlations.where("correlation is not null and not isnan(correlation)").orderBy(F.desc(F.abs("correlation")), "lag").limit(1)
