"""z-tests over aggregated counts, with severities and an alerting frame. Inputs and results are DataFrames of few rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import p_value, severity
from ..sources.logs import union_all
from .eda import failed, nxdomain

ALTERNATIVES = ("two-sided", "greater", "less")


def judged(df: DataFrame, test: str, metric: str, observed: Column, expected: Column, z: Column, p: Column, alpha: float) -> DataFrame:
    out = df.select(F.lit(test).alias("test"), F.lit(metric).alias("metric"), observed.cast("double").alias("observed"), expected.cast("double").alias("expected"), z.cast("double").alias("z"), p.cast("double").alias("p_value"), F.lit(float(alpha)).alias("alpha"))
    out = out.withColumns({"reject_null": F.col("p_value") < F.col("alpha"), "severity": severity(F.col("p_value"))})
    verdict = F.when(F.col("reject_null"), "differs").otherwise("no evidence of a difference")
    return out.withColumn("interpretation", F.format_string("%s: %s %.4f against %.4f at alpha %s", verdict, "metric", "observed", "expected", F.col("alpha").cast("string")))


def one_sample_z(df: DataFrame, observed: str, n: str, mean: float, std: float, alpha: float = 0.05, alternative: str = "two-sided", metric: str = "metric") -> DataFrame:
    """Each row's observed mean of n samples against a population. n must be positive (else the row fails), std too."""
    if std <= 0:
        raise ValueError("std must be positive")
    count = F.when(F.col(n) > 0, F.col(n)).otherwise(F.raise_error(F.lit("n must be positive")).cast("long"))
    z = (F.col(observed) - mean) / (std / F.sqrt(count))
    return judged(df, "One-Sample Z-Test", metric, F.col(observed), F.lit(mean), z, p_value(z, alternative), alpha)


def proportion(df: DataFrame, successes: str, n: str, baseline: float, alpha: float = 0.05, alternative: str = "greater", metric: str = "proportion") -> DataFrame:
    """Each row's proportion against a baseline. A baseline of 0 or 1 has no error: z is 0 or infinity, p 1 or 0. Rows with n = 0 go."""
    if not 0 <= baseline <= 1:
        raise ValueError("baseline must be between 0 and 1")
    if alternative not in ALTERNATIVES:
        raise ValueError(f"unknown alternative {alternative!r}")
    rows = df.where(F.col(n) > 0)
    seen = F.col(successes) / F.col(n)
    if baseline in (0, 1):
        same = seen == float(baseline)
        z, p = F.when(same, 0.0).otherwise(float("inf")), F.when(same, 1.0).otherwise(0.0)
    else:
        z = (seen - baseline) / F.sqrt(F.lit(baseline * (1 - baseline)) / F.col(n))
        p = p_value(z, alternative)
    return judged(rows, "One-Proportion Z-Test", metric, seen, F.lit(baseline), z, p, alpha)


def two_proportions(df: DataFrame, k1: str, n1: str, k2: str, n2: str, alpha: float = 0.05, metric: str = "proportion") -> DataFrame:
    """Two pooled proportions of a row, two-sided. Without error: z 0, p 1 if they agree, else infinity and 0."""
    rows = df.where((F.col(n1) > 0) & (F.col(n2) > 0))
    p1, p2 = F.col(k1) / F.col(n1), F.col(k2) / F.col(n2)
    pooled = (F.col(k1) + F.col(k2)) / (F.col(n1) + F.col(n2))
    error = F.sqrt(pooled * (1 - pooled) * (F.lit(1.0) / F.col(n1) + F.lit(1.0) / F.col(n2)))
    z = F.when(error > 0, (p1 - p2) / F.when(error > 0, error).otherwise(1.0)).when(p1 == p2, 0.0).otherwise(float("inf"))
    return judged(rows, "Two-Proportion Z-Test", metric, p1, p2, z, F.when(error > 0, p_value(z, "two-sided")).when(p1 == p2, 1.0).otherwise(0.0), alpha)


def failed_rate_result(conn: DataFrame, baseline: float = 0.05, alpha: float = 0.05) -> DataFrame:
    counts = conn.agg(F.count_if(failed()).alias("k"), F.count("*").alias("n"))
    return proportion(counts, "k", "n", baseline, alpha, metric="failed_connection_rate")


def nxdomain_rate_result(dns: DataFrame, baseline: float = 0.10, alpha: float = 0.05) -> DataFrame:
    counts = dns.agg(F.count_if(nxdomain()).alias("k"), F.count("*").alias("n"))
    return proportion(counts, "k", "n", baseline, alpha, metric="nxdomain_rate")


class Alerting:
    """All tests of a pair of logs; a log that is absent or empty gives no row."""

    def __init__(self, failed_baseline: float = 0.05, nxdomain_baseline: float = 0.10, alpha: float = 0.05):
        self.failed_baseline, self.nxdomain_baseline, self.alpha = failed_baseline, nxdomain_baseline, alpha

    def evaluate(self, conn: DataFrame | None, dns: DataFrame | None) -> DataFrame:
        parts = [failed_rate_result(conn, self.failed_baseline, self.alpha)] if conn is not None else []
        parts += [nxdomain_rate_result(dns, self.nxdomain_baseline, self.alpha)] if dns is not None else []
        return union_all(parts)

    def alerts(self, conn: DataFrame | None, dns: DataFrame | None) -> DataFrame:
        return self.evaluate(conn, dns).where("reject_null")
