"""Threat-intelligence feeds: text files of addresses and domains, one a line."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import exists

SCHEMA = "indicator string, kind string, source string"


def read_feed(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """(indicator, kind, source): lines without comments and blanks, lower-cased; kind "ip" or "domain" (leading dots stripped)."""
    text = F.lower(F.trim(F.split("value", "#", 2)[0]))
    if kind == "domain":
        text = F.ltrim(text, F.lit("."))
    lines = spark.read.text(path).select(text.alias("indicator"), F.lit(kind).alias("kind"), F.col("_metadata.file_name").alias("source"))
    return lines.where("indicator <> ''")


@dataclass
class Indicators:
    """Indicator lines as read (duplicates included, as counts are of lines); ips() and domains() are the distinct ones."""

    rows: DataFrame

    @classmethod
    def empty(cls, spark: SparkSession) -> Indicators:
        return cls(spark.createDataFrame([], SCHEMA))

    @classmethod
    def from_directory(cls, spark: SparkSession, folder: str, ip_pattern: str = "*_ips.txt", domain_pattern: str = "*_domains.txt") -> Indicators:
        out = cls.empty(spark)
        for pattern, kind in ((ip_pattern, "ip"), (domain_pattern, "domain")):
            if exists(spark, f"{folder}/{pattern}"):
                out = cls(out.rows.unionByName(read_feed(spark, f"{folder}/{pattern}", kind)))
        return out

    def add(self, kind: str, *values: str) -> Indicators:
        rows = [(v.strip().lower().lstrip("." if kind == "domain" else ""), kind, "added") for v in values]
        return Indicators(self.rows.unionByName(self.rows.sparkSession.createDataFrame(rows, SCHEMA)))

    def ips(self) -> DataFrame:
        return self.rows.where("kind = 'ip'").select("indicator").distinct()

    def domains(self) -> DataFrame:
        return self.rows.where("kind = 'domain'").select("indicator").distinct()

    def counts(self) -> DataFrame:
        """Lines loaded of each kind and source."""
        return self.rows.groupBy("kind", "source").agg(F.count("*").alias("lines"))
