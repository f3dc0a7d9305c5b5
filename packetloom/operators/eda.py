"""Exploratory aggregations and the ranking of hosts. Each is one grouped pass with map-side partial aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.network import is_internal, is_public
from ..functions.stats import percent, ratio
from ..schema import FAILED_STATES, FAILED_STATES_RISK, NXDOMAIN


def failed(states: tuple[str, ...] = FAILED_STATES):
    return F.coalesce(F.col("conn_state").isin(*states), F.lit(False))


def nxdomain():
    return F.coalesce(F.col("dns_rcode") == NXDOMAIN, F.lit(False))


def distribution(df: DataFrame, column: str, drop_null: bool = True) -> DataFrame:
    """(column, count, percent): value counts; percent is of all rows, nulls included."""
    counts = df.groupBy(column).agg(F.count("*").alias("count"))
    total = counts.agg(F.sum("count").alias("_total"))  # one row
    share = counts.join(F.broadcast(total)).withColumn("percent", F.col("count") * 100.0 / F.col("_total")).drop("_total")
    return share.where(F.col(column).isNotNull()) if drop_null else share


def country_stats(conn: DataFrame, country: str = "dst_country") -> DataFrame:
    return conn.where(F.col(country).isNotNull()).groupBy(country).agg(F.count("uid").alias("connections"), F.countDistinct("dst_ip").alias("unique_ips"), F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_out"))


def failed_rate(conn: DataFrame) -> DataFrame:
    return conn.agg(F.count("*").alias("total"), F.count_if(failed()).alias("failed")).withColumn("failed_rate", percent(F.col("failed"), F.col("total")))


def failed_sources(conn: DataFrame, scan_ports: int = 3, with_destinations: bool = False) -> DataFrame:
    """Sources of failed connections: count, distinct ports, and whether they look like scanners (more than scan_ports)."""
    more = [F.countDistinct("dst_ip").alias("unique_ips")] if with_destinations else []
    out = conn.where(failed()).groupBy("src_ip").agg(F.count("uid").alias("failed_count"), F.countDistinct("dst_port").alias("unique_ports"), *more)
    return out.withColumn("likely_scanning", F.col("unique_ports") > scan_ports).orderBy(F.desc("failed_count"), "src_ip")


def nxdomain_rate(dns: DataFrame) -> DataFrame:
    return dns.agg(F.count("*").alias("total"), F.count_if(nxdomain()).alias("nxdomain")).withColumn("nxdomain_rate", percent(F.col("nxdomain"), F.col("total")))


def nxdomain_sources(dns: DataFrame, first: int = 5) -> DataFrame:
    """Sources of failed look-ups with their first few distinct domains by time.

    Domains are reduced to their first time before they are ranked, so no list longer than `first` is ever built.
    """
    rows = dns.where(nxdomain())
    seen = rows.groupBy("src_ip", "dns_query").agg(F.count("uid").alias("n"), F.min("timestamp").alias("at"))
    place = F.row_number().over(Window.partitionBy("src_ip").orderBy(F.asc_nulls_last("at"), "dns_query"))
    early = seen.where("dns_query is not null").withColumn("k", place).where(F.col("k") <= first)  # limited by group before the shuffle
    named = early.groupBy("src_ip").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "dns_query"))), lambda x: x["dns_query"]).alias("failed_domains"))
    counts = seen.groupBy("src_ip").agg(F.sum("n").alias("nxdomain_count"), F.count("dns_query").alias("unique_domains"))
    out = counts.join(named, "src_ip", "left").withColumn("failed_domains", F.coalesce("failed_domains", F.array().cast("array<string>")))
    return out.orderBy(F.desc("nxdomain_count"), "src_ip")


def high_uploads(conn: DataFrame, least: float = 1.0) -> DataFrame:
    """Connections that sent more than they received."""
    valid = conn.where("bytes_sent is not null and bytes_recv is not null and bytes_recv > 0")
    return valid.withColumn("ratio", F.col("bytes_sent") / F.col("bytes_recv")).where(F.col("ratio") > least).select("src_ip", "dst_ip", "dst_port", "bytes_sent", "bytes_recv", "ratio")


def threat_hosts(events: DataFrame) -> DataFrame:
    return events.where("ti_match").groupBy("src_ip").agg(F.count("*").alias("match_count")).orderBy(F.desc("match_count"), "src_ip")


def threat_by_log_type(events: DataFrame) -> DataFrame:
    return events.where("ti_match").groupBy("log_type").agg(F.count("*").alias("match_count"))


def host_risk(events: DataFrame) -> DataFrame:
    """(src_ip, score, flags, flag_count, event_count): 10 a threat match, 2 a failed connection, 3 a failed look-up; unflagged hosts go.

    One grouped pass over the enriched union of both logs; flags is an array in fixed order.
    """
    conn, dns = F.col("log_type") == "conn", F.col("log_type") == "dns"
    counts = events.groupBy("src_ip").agg(
        F.count_if(F.coalesce(F.col("ti_match"), F.lit(False))).alias("ti"), F.count_if(conn & failed(FAILED_STATES_RISK)).alias("fail"),
        F.count_if(dns & nxdomain()).alias("nx"), F.count("*").alias("event_count"),
    ).where("ti + fail + nx > 0")
    flags = F.array_compact(F.array(*[F.when(F.col(c) > 0, F.concat(F.lit(f"{name}:"), F.col(c))) for c, name in (("ti", "TI"), ("fail", "FAIL"), ("nx", "NX"))]))
    out = counts.select("src_ip", F.expr("10 * ti + 2 * fail + 3 * nx").alias("score"), flags.alias("flags"), F.size(flags).alias("flag_count"), "event_count")
    return out.orderBy(F.desc("score"), "src_ip")


def host_risk_by_kinds(events: DataFrame) -> DataFrame:
    """The same hosts ranked by how many kinds of flag they have."""
    return host_risk(events).orderBy(F.desc("flag_count"), F.desc("score"), "src_ip")


def protocol_bytes(conn: DataFrame) -> DataFrame:
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0))
    return conn.groupBy("protocol").agg(zero("bytes_sent").alias("bytes_sent"), zero("bytes_recv").alias("bytes_recv")).withColumn("bytes_total", F.col("bytes_sent") + F.col("bytes_recv"))


def transfer_stats(conn: DataFrame) -> DataFrame:
    rows = conn.where("bytes_sent is not null and bytes_recv is not null")
    return rows.agg(F.avg("bytes_sent").alias("mean_sent"), F.avg("bytes_recv").alias("mean_recv"), F.percentile(ratio(F.col("bytes_sent"), F.col("bytes_recv")), F.lit(0.5)).alias("median_ratio"))


def top_external_senders(conn: DataFrame) -> DataFrame:
    """Internal sources by bytes sent to addresses outside the private ranges."""
    rows = conn.where(~is_internal(F.col("dst_ip")))
    return rows.groupBy("src_ip").agg(F.coalesce(F.sum("bytes_sent"), F.lit(0)).alias("bytes_sent"), F.count("*").alias("connections"), F.countDistinct("dst_ip").alias("destinations")).orderBy(F.desc("bytes_sent"), "src_ip")


def beaconing(conn: DataFrame, least: int = 2) -> DataFrame:
    """Source, destination and port met repeatedly, with first and last time."""
    out = conn.groupBy("src_ip", "dst_ip", "dst_port").agg(F.count("*").alias("connections"), F.min("timestamp").alias("first_seen"), F.max("timestamp").alias("last_seen"))
    return out.where(F.col("connections") >= least).orderBy(F.desc("connections"), "src_ip", "dst_ip", "dst_port")


def null_counts(df: DataFrame) -> DataFrame:
    """(column, nulls), in one aggregation."""
    found = F.array(*[F.struct(F.lit(c).alias("column"), F.count_if(F.col(f"`{c}`").isNull()).alias("nulls")) for c in df.columns])
    return df.agg(found.alias("x")).select(F.inline("x"))


def internal_flags(df: DataFrame) -> DataFrame:
    return df.withColumns({"src_internal": is_internal(F.col("src_ip")), "dst_internal": is_internal(F.col("dst_ip")), "dst_public": is_public(F.col("dst_ip"))})


def with_dns(conn: DataFrame, dns: DataFrame) -> DataFrame:
    """Connections with the look-ups of the same uid; several look-ups fan out."""
    return conn.join(dns.select("uid", F.col("dns_query").alias("query"), F.col("dns_answers").alias("answers")), "uid", "left")


def unanswered(dns: DataFrame) -> DataFrame:
    return dns.where("dns_answers is null")


def of_type(events: DataFrame, log_type: str) -> DataFrame:
    return events.where(F.col("log_type") == log_type)
