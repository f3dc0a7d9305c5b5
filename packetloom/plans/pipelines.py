"""End-to-end runs: analysis, standardisation, spike detection."""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import ecs, eda, enrich, reports, timeseries
from ..operators.normalize import merge, normalize
from ..schema import LOGS, UNIFIED_TO_ECS, resolve
from ..session import session
from ..sources import sinks
from ..sources.indicators import Indicators
from ..sources.logs import read_available, read_events_csv, read_log


def load(spark: SparkSession, logs: str, strict: bool = False, only: str | None = None) -> DataFrame:
    """The unified events of a folder; `only` reads one kind of log alone."""
    frames = {kind: df for kind, df in read_available(spark, logs, strict).items() if only in (None, kind)}
    if not frames:
        raise FileNotFoundError(f"{logs}: no {only} log")
    return merge(*[normalize(df, kind) for kind, df in frames.items()])


def analyze(spark: SparkSession, logs: str, feeds: str, out: str | None = None) -> tuple[DataFrame, dict]:
    """Load, normalise, enrich with sub-domain matching, analyse; with `out`, also write tables, CSVs, JSON and a manifest.

    The enriched events are written once and read back for the analysis when there is an output folder, else kept in memory and disk.
    """
    events = enrich.threat_match(load(spark, logs, strict=True), Indicators.from_directory(spark, feeds))
    if out:
        sinks.write_parquet(events, f"{out}/enriched", ["log_type"])
        events = spark.read.schema(events.schema).parquet(f"{out}/enriched").select(events.columns)
    else:
        events = events.persist()
    found = reports.findings(events)
    if out:
        ranked = eda.host_risk(events).withColumn("flags", F.concat_ws(", ", "flags")).drop("flag_count")
        sinks.write_csv(events, f"{out}/enriched_csv", single=False)
        sinks.write_csv(ranked, f"{out}/priorities_csv")
        sinks.write_json(spark, found, f"{out}/summary.json")
        sinks.write_text(spark, reports.security_report(found), f"{out}/report.txt")
        sinks.write_json(spark, sinks.manifest({"enriched": events, "priorities": ranked}), f"{out}/manifest.json")
    return events, found


def standardize(spark: SparkSession, logs: str, feeds: str | None = None, out: str | None = None, strict: bool = False, only: str | None = None) -> tuple[DataFrame, dict]:
    """Load what there is, enrich by exact matches (false without feeds), map to the common schema, validate; optionally write a version."""
    events = load(spark, logs, only=only)
    known = Indicators.from_directory(spark, feeds) if feeds else Indicators.empty(spark)
    events = enrich.threat_match_exact(events, known)
    mapped, found = ecs.project(events, log_type=ecs.single_log_type(events))
    if strict:
        ecs.require_valid(ecs.source_as_ecs(events, found)).write.format("noop").mode("overwrite").save()
    report = ecs.report(events, mapped, found)
    if out:
        folder = sinks.versioned(out)
        sinks.write_parquet(mapped, f"{folder}/ecs_events")
        sinks.write_csv(mapped, f"{folder}/ecs_csv", single=False)
        sinks.write_csv(mapped.where("`event.dataset` = 'conn'"), f"{folder}/ecs_conn_csv", single=False)
        sinks.write_json(spark, report, f"{folder}/validation_report.json")
        sinks.write_json(spark, {"coverage_pct": found.coverage, "mapped": found.mapped, "unmapped": found.unmapped}, f"{folder}/mapping_coverage.json")
        sinks.write_text(spark, reports.before_after(events, mapped, UNIFIED_TO_ECS, ["timestamp", "uid", "log_type"]), f"{folder}/before_after.md")
        sinks.write_json(spark, sinks.manifest({"ecs_events": mapped}, errors=report["validation_error_count"]), f"{folder}/manifest.json")
    return mapped, report


def convert(spark: SparkSession, path: str, out: str | None = None, kind: str | None = None) -> tuple[str, int]:
    """One log to Parquet, by the schema of its kind if it is given or the file's name begins with it; returns the folder and its rows.

    Without `out` the folder stands beside the log, with .parquet for the log's extension.
    """
    name = path.rstrip("/").rsplit("/", 1)[-1]
    kind = kind or next((k for k in LOGS if name.startswith(k)), None)
    out = out or f"{path.rstrip('/').removesuffix('.' + name.rsplit('.', 1)[-1]) if '.' in name else path.rstrip('/')}.parquet"
    sinks.write_parquet(read_log(spark, path, LOGS.get(kind)), out)
    return out, spark.read.parquet(out).count()


def detect_spikes(spark: SparkSession, path: str, out: str | None = None, bucket: str = "1min", window: int = 10, multiplier: float = 2.0) -> tuple[DataFrame, dict]:
    """Spikes of all events of a CSV, unified or standardised, against a trailing moving average."""
    df = read_events_csv(spark, path)
    null = "cast(null as string)"
    rcode, state = resolve(df, "dns.response_code", "dns_rcode") or null, resolve(df, "zeek.connection.state", "conn_state") or null
    events = df.select("timestamp", F.expr(rcode).alias("dns_rcode"), F.expr(state).alias("conn_state"))
    marked = timeseries.spikes(timeseries.spike_series(events, bucket), "connections", window, multiplier)
    row = timeseries.spike_summary(marked).first()
    summary = {"total_buckets": row.buckets, "anomalies": row.anomalies, "first_anomalies": [t.isoformat() for t in row.first_anomalies], "bucket": bucket, "window": window, "multiplier": multiplier}
    if out:
        sinks.write_csv(marked.orderBy("bucket"), f"{out}/time_series_1min")
        sinks.write_json(spark, summary, f"{out}/anomaly_summary.json")
    return marked, summary


def main(args: list[str] | None = None) -> None:
    top = argparse.ArgumentParser(prog="packetloom")
    commands = top.add_subparsers(dest="command", required=True)
    a = commands.add_parser("analyze")
    a.add_argument("--logs", required=True)
    a.add_argument("--feeds", required=True)
    a.add_argument("--out", required=True)
    s = commands.add_parser("standardize")
    s.add_argument("--logs", required=True)
    s.add_argument("--feeds")
    s.add_argument("--out", required=True)
    s.add_argument("--strict", action="store_true")
    s.add_argument("--only", choices=["conn", "dns"])
    d = commands.add_parser("spikes")
    d.add_argument("--input", required=True)
    d.add_argument("--out", required=True)
    d.add_argument("--bucket", default="1min")
    d.add_argument("--window", type=int, default=10)
    d.add_argument("--multiplier", type=float, default=2.0)
    c = commands.add_parser("convert")
    c.add_argument("log")
    c.add_argument("out", nargs="?")
    c.add_argument("--kind", choices=list(LOGS))
    o, spark = top.parse_args(args), session()
    if o.command == "convert":
        print("{1} rows in {0}".format(*convert(spark, o.log, o.out, o.kind)))
    elif o.command == "analyze":
        print(reports.security_report(analyze(spark, o.logs, o.feeds, o.out)[1]))
    elif o.command == "standardize":
        print(standardize(spark, o.logs, o.feeds, o.out, o.strict, o.only)[1])
    else:
        print(detect_spikes(spark, o.input, o.out, o.bucket, o.window, o.multiplier)[1])
