"""Statistical baselines: windowed metrics, a model table of their statistics, z-scores, anomalies, per-host baselines."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.stats import percent, ratio
from ..schema import FAILED_STATES_HOST
from .eda import failed, nxdomain
from .timeseries import bucket, fill_gaps

MODEL = "metric string, mean double, std double, min double, max double, median double, p95 double, p99 double, n long"


def windowed_metrics(conn: DataFrame | None, dns: DataFrame | None, width: str = "1min") -> DataFrame:
    """(bucket, failed_rate, bytes_ratio, nxdomain_rate): null where a window has nothing to measure; windows of nulls alone go.

    bytes_ratio is the mean of the rows' own ratios (of those that received anything), not the ratio of sums.
    """
    parts, metrics = [], []
    if conn is not None:
        rows = bucket(conn, width).where("bucket is not null").groupBy("bucket").agg(
            percent(F.count_if(failed()), F.count("*"), None).alias("failed_rate"), F.avg(ratio(F.col("bytes_sent"), F.col("bytes_recv"))).alias("bytes_ratio")
        )
        parts, metrics = [rows], ["failed_rate", "bytes_ratio"]
    if dns is not None:
        rows = bucket(dns, width).where("bucket is not null").groupBy("bucket").agg(percent(F.count_if(nxdomain()), F.count("dns_rcode"), None).alias("nxdomain_rate"))
        parts, metrics = [*parts, rows], [*metrics, "nxdomain_rate"]
    if not parts:
        raise ValueError("no log given")
    out = parts[0] if len(parts) == 1 else parts[0].join(parts[1], "bucket", "full")
    return out.dropna("all", subset=metrics)


def long_form(df: DataFrame, metrics: Sequence[str] | None = None, time: str = "bucket") -> DataFrame:
    """(time, metric, value) of non-null values; NaN counts as null."""
    names = list(metrics or [c for c in df.columns if c != time])
    wide = df.select(time, *[F.col(m).cast("double").alias(m) for m in names])
    return wide.unpivot(time, names, "metric", "value").where("value is not null and not isnan(value)")


def fit(values: DataFrame) -> DataFrame:
    """The model: one row of statistics for each metric of (metric, value); a single value has deviation 0. Percentiles interpolate."""
    mid = F.percentile("value", F.array(F.lit(0.5), F.lit(0.95), F.lit(0.99)))
    agg = values.groupBy("metric").agg(
        F.avg("value").alias("mean"), F.coalesce(F.stddev_samp("value"), F.lit(0.0)).alias("std"), F.min("value").alias("min"), F.max("value").alias("max"),
        mid.alias("q"), F.count("*").alias("n"),
    )
    return agg.select("metric", "mean", "std", "min", "max", F.col("q")[0].alias("median"), F.col("q")[1].alias("p95"), F.col("q")[2].alias("p99"), "n")


def z_score(value: Column, mean: Column, std: Column) -> Column:
    """0 or infinity where the baseline has no deviation."""
    return F.when(std == 0, F.when(value == mean, 0.0).otherwise(float("inf"))).otherwise((value - mean) / std)


def detect(values: DataFrame, model: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Adds z_score, is_anomaly and threshold to (bucket, metric, value); metrics without a model row go."""
    scored = values.join(F.broadcast(model.select("metric", "mean", "std")), "metric")  # a row for each metric name
    scored = scored.withColumn("z_score", z_score(F.col("value"), F.col("mean"), F.col("std")))
    return scored.withColumns({"is_anomaly": F.abs("z_score") > threshold, "threshold": F.lit(float(threshold))}).drop("mean", "std")


def per_host(conn: DataFrame, dns: DataFrame | None = None, host: str = "src_ip") -> DataFrame:
    """Connection and look-up baselines of each host with connections; hosts seen in DNS alone are not returned."""
    agg = conn.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(
        F.count("*").alias("total_connections"), F.count_if(failed(FAILED_STATES_HOST)).alias("failed_connections"),
        F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_sent"), F.coalesce(F.sum("bytes_recv"), F.lit(0)).alias("bytes_recv"),
    )
    out = agg.withColumns({"failed_rate": percent(F.col("failed_connections"), F.col("total_connections")), "bytes_ratio": ratio(F.col("bytes_sent"), F.col("bytes_recv"))})
    if dns is None:
        return out
    looked = dns.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host")).agg(F.count("*").alias("total_dns"), F.count_if(nxdomain()).alias("nxdomain_count"))
    return out.join(looked.withColumn("nxdomain_rate", percent(F.col("nxdomain_count"), F.col("total_dns"))), "host", "left")


class BaselineModel:
    """A fitted model table with its threshold; it can be kept as Parquet or JSON."""

    def __init__(self, model: DataFrame, z_threshold: float = 3.0):
        self.model, self.z_threshold = model, z_threshold

    @classmethod
    def fit(cls, conn: DataFrame | None, dns: DataFrame | None, width: str = "1min", z_threshold: float = 3.0) -> BaselineModel:
        return cls(fit(long_form(windowed_metrics(conn, dns, width))), z_threshold)

    def detect(self, conn: DataFrame | None, dns: DataFrame | None, width: str = "1min") -> DataFrame:
        return detect(long_form(windowed_metrics(conn, dns, width)), self.model, self.z_threshold)

    def z_score(self, metric: str, value: float) -> float:
        row = self.model.where(F.col("metric") == metric).first()
        if row is None:
            raise ValueError(f"no baseline for {metric!r}")
        return (0.0 if value == row.mean else float("inf")) if row.std == 0 else (value - row.mean) / row.std

    def to_json(self) -> str:
        return json.dumps({"z_threshold": self.z_threshold, "baselines": [r.asDict() for r in self.model.orderBy("metric").collect()]})

    @classmethod
    def from_json(cls, spark: SparkSession, text: str) -> BaselineModel:
        data = json.loads(text)
        return cls(spark.createDataFrame([tuple(b.values()) for b in data["baselines"]], MODEL), data["z_threshold"])


def gap_filled_metrics(conn: DataFrame | None, dns: DataFrame | None, width: str = "1min") -> DataFrame:
    """windowed_metrics() with the missing windows as null rows."""
    return fill_gaps(windowed_metrics(conn, dns, width), width)
