"""Schemas, rename maps and named sets of the telemetry model, and the column resolver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StringType, StructField, StructType, TimestampType

TYPES = {"string": StringType(), "long": LongType(), "double": DoubleType(), "boolean": BooleanType(), "timestamp": TimestampType()}


def fields(text: str) -> StructType:
    """A schema from "name type, ..." (a type of TYPES, or type[]); unlike DDL it needs no session, so modules import without one."""
    pairs = (part.split() for part in text.split(","))
    return StructType([StructField(name, ArrayType(TYPES[kind[:-2]]) if kind.endswith("[]") else TYPES[kind]) for name, kind in pairs])


# Field names and types of the logs, the unified schema and the common event schema.
CONN = fields("""
    ts timestamp, uid string, id.orig_h string, id.orig_p long, id.resp_h string, id.resp_p long, proto string, service string,
    duration double, orig_bytes long, resp_bytes long, conn_state string, missed_bytes long, history string, orig_pkts long,
    resp_pkts long, orig_ip_bytes long, resp_ip_bytes long
""")
DNS = fields("""
    ts timestamp, uid string, id.orig_h string, id.orig_p long, id.resp_h string, id.resp_p long, proto string, trans_id long,
    rtt double, query string, qclass long, qclass_name string, qtype long, qtype_name string, rcode long, rcode_name string, AA boolean,
    TC boolean, RD boolean, RA boolean, Z long, answers string[], TTLs double[], rejected boolean
""")
UNIFIED = fields("""
    timestamp timestamp, log_type string, uid string, src_ip string, src_port long, dst_ip string, dst_port long, protocol string,
    service string, duration_sec double, bytes_sent long, bytes_recv long, packets_sent long, packets_recv long, conn_state string,
    dns_query string, dns_qtype string, dns_rcode string, dns_answers string[]
""")
LOGS = {"conn": CONN, "dns": DNS}
TIMESTAMPS = ("ts", "start_time", "end_time")

# Field names of the two logs and of the common schemas, from each to the next.
_ENDPOINTS = {"ts": "timestamp", "uid": "uid", "id.orig_h": "src_ip", "id.orig_p": "src_port", "id.resp_h": "dst_ip", "id.resp_p": "dst_port", "proto": "protocol"}
CONN_FIELDS = _ENDPOINTS | {
    "service": "service", "duration": "duration_sec", "orig_bytes": "bytes_sent", "resp_bytes": "bytes_recv", "orig_pkts": "packets_sent",
    "resp_pkts": "packets_recv", "conn_state": "conn_state",
}
DNS_FIELDS = _ENDPOINTS | {"query": "dns_query", "qtype_name": "dns_qtype", "rcode_name": "dns_rcode", "answers": "dns_answers"}
FIELDS = {"conn": CONN_FIELDS, "dns": DNS_FIELDS}

RAW_TO_ECS = {
    "id.orig_h": "source.ip", "id.resp_h": "destination.ip", "id.orig_p": "source.port", "id.resp_p": "destination.port",
    "proto": "network.transport", "ts": "@timestamp", "uid": "event.id", "service": "network.protocol", "duration": "event.duration",
    "orig_bytes": "source.bytes", "resp_bytes": "destination.bytes", "orig_pkts": "source.packets", "resp_pkts": "destination.packets",
    "conn_state": "zeek.connection.state", "history": "zeek.connection.history", "missed_bytes": "zeek.connection.missed_bytes",
    "query": "dns.question.name", "qtype_name": "dns.question.type", "rcode_name": "dns.response_code", "answers": "dns.answers.name",
}
UNIFIED_TO_ECS = {
    "src_ip": "source.ip", "dst_ip": "destination.ip", "src_port": "source.port", "dst_port": "destination.port",
    "protocol": "network.transport", "timestamp": "@timestamp", "uid": "event.id", "service": "network.protocol",
    "duration_sec": "event.duration", "bytes_sent": "source.bytes", "bytes_recv": "destination.bytes", "packets_sent": "source.packets",
    "packets_recv": "destination.packets", "conn_state": "zeek.connection.state", "log_type": "event.dataset",
    "dns_query": "dns.question.name", "dns_qtype": "dns.question.type", "dns_rcode": "dns.response_code", "dns_answers": "dns.answers.name",
    "ti_match": "threat.indicator.matched",
}
ECS_TYPES = {
    "source.ip": "ip", "destination.ip": "ip", "source.port": "port", "destination.port": "port", "network.transport": "keyword",
    "@timestamp": "date", "event.id": "keyword", "network.protocol": "keyword", "event.duration": "float", "source.bytes": "long",
    "destination.bytes": "long", "source.packets": "long", "destination.packets": "long", "event.dataset": "keyword",
    "event.category": "keyword", "event.kind": "keyword", "event.type": "keyword", "dns.question.name": "keyword",
    "dns.question.type": "keyword", "dns.response_code": "keyword", "threat.indicator.matched": "boolean",
}
ECS_CATEGORY = {"conn": "network", "dns": "network", "http": "web", "ssl": "network", "files": "file"}
ECS_EVENT_TYPE = {"conn": "connection", "dns": "protocol", "http": "access", "ssl": "protocol", "files": "info"}
ECS_ORDER = [
    "@timestamp", "event.kind", "event.category", "event.type", "event.dataset", "event.id", "event.duration", "source.ip", "source.port",
    "source.bytes", "source.packets", "destination.ip", "destination.port", "destination.bytes", "destination.packets",
    "network.transport", "network.protocol", "dns.question.name", "dns.question.type", "dns.response_code", "threat.indicator.matched",
]

# Connection states that count as failed, by use (detection and series; per-host baselines; host ranking).
FAILED_STATES = ("S0", "REJ", "RSTO", "RSTR", "S1", "S2", "S3")
FAILED_STATES_HOST = ("S0", "REJ", "RSTO", "RSTR")
FAILED_STATES_RISK = ("S0", "REJ")
NXDOMAIN = "NXDOMAIN"


def resolve(df: DataFrame, *names: str) -> str | None:
    """The first of the names that df has, quoted for use in expressions; None if it has none."""
    return next((f"`{n}`" for n in names if n in df.columns), None)
