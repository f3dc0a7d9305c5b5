"""Text reports over small collected results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import calibrate, cusum, eda
from .baseline import BaselineModel
from .ecs import Mapping


def table(df: DataFrame, title: str, rows: int = 10) -> str:
    """The first rows of an ordered result under a title."""
    got = df.limit(rows).collect()
    lines = [title, "-" * 40, *("  " + ", ".join(f"{k}={v:.4f}" if isinstance(v, float) else f"{k}={v}" for k, v in r.asDict().items()) for r in got)]
    return "\n".join(lines if got else [*lines, "  none"])


def light(rate: float, red: float, amber: float, name: str) -> str:
    word = "ALERT" if rate > red else "WARNING" if rate > amber else "ok"
    return f"{word}: {name} {rate:.1f}%"


def findings(events: DataFrame, most: int | None = None) -> dict:
    """The analysis as a dictionary: a few numbers, and a row for each host concerned (the first `most` of each list, all by default)."""
    conn, dns = eda.of_type(events, "conn"), eda.of_type(events, "dns")
    failed, nx = eda.failed_rate(conn).first(), eda.nxdomain_rate(dns).first()
    rows = lambda df: [r.asDict() for r in (df if most is None else df.limit(most)).collect()]
    return {
        "total_connections": failed.total, "total_dns": nx.total, "total_events": failed.total + nx.total,
        "protocol_distribution": {r["protocol"]: {"count": r["count"], "percent": round(r["percent"], 1)} for r in rows(eda.distribution(conn, "protocol"))},
        "failed_rate": round(failed.failed_rate, 1), "nxdomain_rate": round(nx.nxdomain_rate, 1),
        "failed_sources": rows(eda.failed_sources(conn)), "nxdomain_sources": rows(eda.nxdomain_sources(dns)),
        "ti_matches": events.where("ti_match").count(), "ti_hosts": rows(eda.threat_hosts(events)), "priorities": rows(eda.host_risk(events)),
    }


def security_report(found: dict) -> str:
    lines = ["SECURITY REPORT", "=" * 40, f"Connections {found['total_connections']}, look-ups {found['total_dns']}", "", "Protocols"]
    lines += [f"  {p}: {v['count']} ({v['percent']}%)" for p, v in found["protocol_distribution"].items()]
    lines += ["", light(found["failed_rate"], 10, 5, "failed connections"), light(found["nxdomain_rate"], 30, 15, "failed look-ups"), f"{'ALERT' if found['ti_matches'] else 'ok'}: threat matches {found['ti_matches']}", "", "Hosts to investigate"]
    lines += [f"  {k}. {h['src_ip']} score {h['score']} [{', '.join(h['flags'])}]" for k, h in enumerate(found["priorities"][:10], 1)] or ["  none"]
    return "\n".join(lines)


def mapping_report(found: Mapping) -> str:
    return "\n".join([f"Mapped {len(found.mapped)} of {found.total} fields ({found.coverage:.1f}%)", f"Defaults: {', '.join(found.defaults) or 'none'}", f"Unmapped: {', '.join(found.unmapped) or 'none'}"])


def before_after(source: DataFrame, ecs: DataFrame, table_: dict[str, str], order: list[str], rows: int = 3) -> str:
    """A markdown note: which field became which, and the first rows in a given order, before and after."""
    head = ["| before | after |", "|---|---|", *(f"| {c} | {table_[c]} |" for c in source.columns if c in table_)]

    def block(df: DataFrame, by: list[str]) -> list[str]:
        got = df.orderBy(*[f"`{c}`" for c in by if c in df.columns]).limit(rows).collect()
        return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in got)]

    return "\n".join(["## Fields", *head, "", "## Before", *block(source, order), "", "## After", *block(ecs, [table_.get(c, c) for c in order])])


def headed(title: str, *blocks: tuple[str, list[str]]) -> str:
    lines = [title.upper(), "=" * 40]
    for name, body in blocks:
        lines += ["", name, "-" * 40, *(f"  {x}" for x in body or ["none"])]
    return "\n".join(lines)


def baseline_report(model: BaselineModel) -> str:
    """Each metric's statistics, in the order of their names."""
    shown = {"mean": "mean", "std": "deviation", "min": "least", "max": "greatest", "median": "median", "p95": "95 % under", "p99": "99 % under"}
    blocks = [(r.metric, [f"{text}: {r[c]:.4f}" for c, text in shown.items()] + [f"windows: {r.n}"]) for r in model.model.orderBy("metric").collect()]
    return headed("baseline", ("threshold", [f"flags values over {model.z_threshold} deviations from the mean"]), *blocks)


ACTIONS = {"CRITICAL": "investigate now", "HIGH": "investigate within the hour", "MEDIUM": "add to the day's queue"}


def hypothesis_report(results: DataFrame) -> str:
    """Every test's verdict and what the alerts ask for; results as Alerting.evaluate() gives them."""
    rows = results.orderBy("metric").collect()
    tests = [f"{'ALERT' if r.reject_null else 'ok'} [{r.severity}] {r.metric}: {r.observed:.4f} against {r.expected:.4f}, z {r.z:.2f}, p {r.p_value:.6f}" for r in rows]
    todo = [f"{r.metric}: {ACTIONS[r.severity]}" for r in rows if r.reject_null and r.severity in ACTIONS]
    return headed("hypothesis tests", ("tests", tests), ("actions", todo), ("summary", [f"{sum(r.reject_null for r in rows)} of {len(rows)} tests alert"]))


def series_report(series: DataFrame, metrics: tuple[str, ...] = ("failed_rate", "nxdomain_rate", "bytes_ratio"), z: float = 2.0, first: int = 5) -> str:
    """Span, statistics of each metric that the series has and, where it has rolling z-scores, the first buckets beyond z."""
    have = [m for m in metrics if m in series.columns]
    aggs = [f(m).alias(f"{name}_{m}") for m in have for name, f in (("mean", F.avg), ("std", F.stddev_samp), ("min", F.min), ("max", F.max))]
    row = series.agg(F.min("bucket").alias("a"), F.max("bucket").alias("b"), F.count("*").alias("n"), *aggs).first()
    blocks = [("span", [f"{row.n} buckets from {row.a} to {row.b}"])]
    number = lambda x: "none" if x is None else f"{x:.4f}"
    blocks += [(m, [f"{name}: {number(row[f'{name}_{m}'])}" for name in ("mean", "std", "min", "max")]) for m in have]
    for m in have:
        if f"{m}_zscore" in series.columns:
            far = series.where(F.abs(f"{m}_zscore") > z).orderBy("bucket")
            blocks.append((f"{m} beyond {z}", [f"{far.count()} buckets", *(f"{r.bucket}: {r[f'{m}_zscore']:.2f}" for r in far.limit(first).collect())]))
    return headed("time series", *blocks)


def cusum_report(model: DataFrame, detected: DataFrame, time: str = "bucket") -> str:
    """Parameters, every change point and the greatest sums; model and detected as cusum.fit() and cusum.detect() give them (no key)."""
    m, top = model.first(), cusum.peaks(detected).first()
    total = detected.count()
    points = cusum.change_points(detected).orderBy("index").collect()
    changes = [f"{r[time] if r[time] is not None else r['index']}: {r.direction}, sum {r.cusum_value:.4f}, mean {r.pre_mean:.4f} to {r.post_mean:.4f}" for r in points]
    return headed(
        "change points", ("parameters", [f"target {m.target:.4f}", f"deviation {m.std:.4f}", f"slack {m.slack:.4f}", f"limit {m.limit:.4f}"]),
        ("result", [f"{len(points)} changes in {total} values"]), ("changes", changes), ("greatest sums", [f"upper {top.max_upper:.4f}", f"lower {top.max_lower:.4f}"] if total else []),
    )


def calibration_report(scored: DataFrame, daily_events: int = 100_000, threshold: float | None = None, shown: tuple[float, ...] = (0.3, 0.5, 0.7, 0.9)) -> str:
    """The data, the ranking's quality, a recommended threshold (of best f1, if none is given), its daily volume and the way it moves."""
    points = calibrate.evaluate(scored).persist()
    auc = calibrate.roc_auc(scored).first()
    best = (calibrate.optimum(points) if threshold is None else calibrate.nearest(points, threshold)).first()
    day = calibrate.daily_alerts(points, best.threshold, daily_events).first()
    line = lambda r: f"{r.threshold:.2f}: precision {r.precision:.4f}, recall {r.recall:.4f}, alerts {100 * r.alert_rate:.1f} %"
    moves = [line(calibrate.nearest(points, t).first()) for t in shown]
    points.unpersist()
    total = auc.positives + auc.negatives
    return headed(
        "threshold calibration", ("data", [f"{total} rows, {auc.positives} positive ({100 * auc.positives / max(1, total):.1f} %)"]),
        ("ranking", [f"area under the curve {auc.roc_auc:.4f}" if auc.roc_auc is not None else "one class alone"]),
        ("recommended", [line(best), f"f1 {best.f1:.4f}, false positive rate {best.fpr:.4f}"]),
        (f"a day of {daily_events} events", [f"{day.expected_total_alerts} alerts, {day.expected_true_positives} of them true"]), ("other thresholds", moves),
    )
