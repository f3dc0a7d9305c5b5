"""The driver tables seen as telemetry: a deterministic stand-in, so each operator has an input of any size and an SQL twin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The same view in SQL that both engines read; `events` is the driver table.
EVENTS_SQL = """
    SELECT ts AS timestamp, CAST(event_id AS VARCHAR) AS uid,
           '10.0.' || CAST(user_id // 256 AS VARCHAR) || '.' || CAST(user_id % 256 AS VARCHAR) AS src_ip,
           CASE WHEN event_id % 3 = 0 THEN '192.168.7.' || CAST(event_id % 40 AS VARCHAR) ELSE '44.230.90.' || CAST(event_id % 50 AS VARCHAR) END AS dst_ip,
           CAST(json_extract_string(props, '$.k') AS BIGINT) AS dst_port, event_type AS protocol,
           CASE event_type WHEN 'error' THEN 'S0' WHEN 'signup' THEN 'RSTO' ELSE 'SF' END AS conn_state,
           CASE event_type WHEN 'view' THEN 'NXDOMAIN' ELSE 'NOERROR' END AS dns_rcode,
           'd' || CAST(user_id % 9 AS VARCHAR) || '.zone' || CAST(event_id % 30 AS VARCHAR) || '.example.com' AS dns_query,
           CAST(floor(value * 100) AS BIGINT) AS bytes_sent,
           CASE WHEN event_id % 7 = 0 THEN NULL ELSE event_id % 5000 END AS bytes_recv,
           CAST(value AS DOUBLE) AS duration_sec
    FROM events
"""


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each row of `events`, with the columns of both kinds of log."""
    e, i = spark.read.parquet(f"{sf_dir}/events.parquet"), F.col("event_id")
    s = lambda c: c.cast("string")
    return e.select(
        F.col("ts").alias("timestamp"), s(i).alias("uid"), F.concat(F.lit("10.0."), s(F.expr("user_id div 256")), F.lit("."), s(F.col("user_id") % 256)).alias("src_ip"),
        F.when(i % 3 == 0, F.concat(F.lit("192.168.7."), s(i % 40))).otherwise(F.concat(F.lit("44.230.90."), s(i % 50))).alias("dst_ip"),
        F.get_json_object("props", "$.k").cast("long").alias("dst_port"), F.col("event_type").alias("protocol"),
        F.when(F.col("event_type") == "error", "S0").when(F.col("event_type") == "signup", "RSTO").otherwise("SF").alias("conn_state"),
        F.when(F.col("event_type") == "view", "NXDOMAIN").otherwise("NOERROR").alias("dns_rcode"),
        F.concat(F.lit("d"), s(F.col("user_id") % 9), F.lit(".zone"), s(i % 30), F.lit(".example.com")).alias("dns_query"),
        F.floor(F.col("value") * 100).cast("long").alias("bytes_sent"), F.when(i % 7 != 0, i % 5000).alias("bytes_recv"), F.col("value").cast("double").alias("duration_sec"),
    )


def carried(ip: Column) -> Column:
    """The view's source address with its third part carried into the second, and all parts modulo 256: an address whatever the user.

    The view's own text is none from user 65,536 on (10.0.256.0), which the validator rightly rejects; of smaller users it is unchanged.
    Queries whose SQL counts errors made on purpose alone validate this one.
    """
    part = F.split(ip, r"\.")
    third, last = part[2].cast("long"), part[3].cast("long")
    parts = [F.pmod(F.floor(third / 256), F.lit(256)), F.pmod(third, F.lit(256)), F.pmod(last, F.lit(256))]
    return F.concat(F.lit("10"), *[x for p in parts for x in (F.lit("."), p.cast("string"))])


def unified(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events once as connections and once as look-ups, with log_type."""
    base = events(spark, sf_dir)
    conn = base.select(F.lit("conn").alias("log_type"), "timestamp", "uid", "src_ip", "dst_ip", "dst_port", "protocol", "conn_state", F.lit(None).cast("string").alias("dns_rcode"), F.lit(None).cast("string").alias("dns_query"), "bytes_sent", "bytes_recv", "duration_sec")
    null = lambda kind, name: F.lit(None).cast(kind).alias(name)
    dns = base.select(F.lit("dns").alias("log_type"), "timestamp", "uid", "src_ip", "dst_ip", "dst_port", "protocol", null("string", "conn_state"), "dns_rcode", "dns_query", null("long", "bytes_sent"), null("long", "bytes_recv"), null("double", "duration_sec"))
    return conn.unionByName(dns)


UNIFIED_SQL = f"""
    SELECT 'conn' AS log_type, timestamp, uid, src_ip, dst_ip, dst_port, protocol, conn_state, CAST(NULL AS VARCHAR) AS dns_rcode,
           CAST(NULL AS VARCHAR) AS dns_query, bytes_sent, bytes_recv, duration_sec FROM ({EVENTS_SQL})
    UNION ALL
    SELECT 'dns', timestamp, uid, src_ip, dst_ip, dst_port, protocol, NULL, dns_rcode, dns_query, NULL, NULL, NULL FROM ({EVENTS_SQL})
"""
