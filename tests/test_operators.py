"""Golden values, semantics that a naive translation gets wrong, and properties."""

import ipaddress
import json
import math
from datetime import datetime, timedelta

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetloom.functions.network import ipv6_hex, is_internal, is_ip, is_public
from packetloom.functions.stats import p_value, severity
from packetloom.operators import baseline, calibrate, cusum, ecs, eda, enrich, hypothesis, ml, timeseries
from packetloom.operators.normalize import merge, normalize, ordered, read_and_normalize
from packetloom.plans import pipelines
from packetloom.schema import CONN, DNS, UNIFIED, resolve
from packetloom.sources import logs, sinks
from packetloom.sources.indicators import Indicators

T0 = datetime(2024, 5, 1, 8, 0, 0)


def conn_line(k, **more):
    row = {"ts": (T0 + timedelta(seconds=k)).isoformat() + "Z", "uid": f"C{k}", "id.orig_h": "10.0.0.1", "id.orig_p": 1000 + k, "id.resp_h": "198.51.100.7", "id.resp_p": 443, "proto": "tcp", "conn_state": "SF", "orig_bytes": 10, "resp_bytes": 20}
    return json.dumps(row | more)


def dns_line(k, **more):
    row = {"ts": (T0 + timedelta(seconds=k)).timestamp(), "uid": f"D{k}", "id.orig_h": "10.0.0.2", "id.orig_p": 53, "id.resp_h": "10.0.0.9", "id.resp_p": 53, "proto": "udp", "query": "a.example.org", "rcode_name": "NOERROR", "answers": ["192.0.2.1"]}
    return json.dumps(row | more)


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "logs").mkdir()
    (tmp_path / "ti").mkdir()
    conn = [conn_line(0), conn_line(1, **{"id.resp_h": "203.0.113.5", "conn_state": "S0"}), conn_line(2, conn_state="REJ"), conn_line(3, conn_state="RSTO"), conn_line(9, uid="12345", resp_bytes=None)]
    dns = [dns_line(1), dns_line(2, query="x.Evil.test", rcode_name="NXDOMAIN", answers=None), dns_line(4, query="notevil.test", rcode_name="NXDOMAIN"), dns_line(5, query=None, rcode_name=None)]
    (tmp_path / "logs/conn.log").write_text("\n".join(conn) + "\n")
    (tmp_path / "logs/dns.log").write_text("\n".join(dns) + "\n")
    (tmp_path / "ti/a_ips.txt").write_text("# listed\n\n203.0.113.5 # inline\n203.0.113.5\n")
    (tmp_path / "ti/a_domains.txt").write_text(".EVIL.test\n")
    return tmp_path


def test_end_to_end(spark, folder):
    events, found = pipelines.analyze(spark, f"{folder}/logs", f"{folder}/ti", f"{folder}/out")
    assert events.columns == [*UNIFIED.names, "ti_match"]
    assert events.count() == 9
    assert {r.uid for r in events.where("ti_match").collect()} == {"C1", "D2"}
    assert found["failed_rate"] == 60.0 and found["nxdomain_rate"] == 50.0
    assert [(h["src_ip"], h["score"], h["flags"], h["event_count"]) for h in found["priorities"]] == [("10.0.0.2", 16, ["TI:1", "NX:2"], 4), ("10.0.0.1", 14, ["TI:1", "FAIL:2"], 5)]
    assert json.loads((folder / "out/summary.json").read_text())["ti_matches"] == 2
    assert "Hosts to investigate" in (folder / "out/report.txt").read_text()
    first = events.where("uid = '12345'").first()
    assert first.bytes_recv is None and first.timestamp == T0 + timedelta(seconds=9)


def test_feed_counts_are_lines(spark, folder):
    feeds = Indicators.from_directory(spark, f"{folder}/ti")
    assert {r.kind: r.lines for r in feeds.counts().collect()} == {"ip": 2, "domain": 1}
    assert feeds.ips().count() == 1
    assert feeds.add("domain", ".New.Test").domains().where("indicator = 'new.test'").count() == 1


def test_standardize(spark, folder):
    mapped, report = pipelines.standardize(spark, f"{folder}/logs", f"{folder}/ti", f"{folder}/ecs")
    assert len(mapped.columns) == 22 and mapped.columns[0] == "@timestamp" and "event.type" not in mapped.columns
    assert report["mapping_coverage_pct"] == 100.0 and report["validation_error_count"] == 0
    assert report["timestamp_range"][0] == "2024-05-01T08:00:00.000000Z"
    assert mapped.where("`threat.indicator.matched`").count() == 1  # exact matches alone
    only, _ = pipelines.standardize(spark, f"{folder}/logs", only="dns")
    assert {r[0] for r in only.select("`event.type`").collect()} == {"protocol"}
    assert "source" in ecs.nested(mapped).columns
    (folder / "logs/conn.log").unlink()
    assert pipelines.load(spark, f"{folder}/logs").count() == 4
    with pytest.raises(FileNotFoundError):
        pipelines.load(spark, f"{folder}/logs", strict=True)


def test_validation_rules(spark):
    rows = [("10.0.0.1", 65536, "k" * 10_001, "x"), ("300.1.1.1", -1, "k", "5"), (None, None, None, None), ("::1", 80, "k", "2.5")]
    df = spark.createDataFrame(rows, "`source.ip` string, `source.port` long, `event.id` string, `event.duration` string")
    assert {r.field: (r.checked, r.errors) for r in ecs.validation_counts(df).collect()} == {"source.ip": (3, 1), "source.port": (3, 2), "event.id": (3, 1), "event.duration": (3, 1)}
    assert ecs.validation_errors(df, 2).count() == 2
    with pytest.raises(Exception, match="validation error in"):
        ecs.require_valid(df).collect()


def test_tsv(spark, tmp_path):
    path = tmp_path / "conn.log"
    path.write_text("#separator \\x09\n#fields\tts\tuid\tid.orig_h\tservice\torig_bytes\n#types\ttime\tstring\taddr\tstring\tcount\n1714550400.5\tu#1\t10.0.0.1\t-\t7\n1714550401.0\tu2\t10.0.0.2\t(empty)\tbad\n#close\n")
    assert logs.detect_format(spark, str(path)) == "tsv"
    rows = logs.read_log(spark, str(path), CONN).orderBy("ts").collect()
    assert [r.uid for r in rows] == ["u#1", "u2"] and rows[0].ts == datetime(2024, 5, 1, 8, 0, 0, 500000)
    assert rows[0].service is None and rows[1].service is None and [r.orig_bytes for r in rows] == [7, None]
    assert logs.read_tsv(spark, str(path)).dtypes[0] == ("ts", "timestamp")


def test_json_without_a_schema_and_corrupt_lines(spark, tmp_path):
    (tmp_path / "a.log").write_text(conn_line(0) + "\n{broken\n")
    df = logs.read_json(spark, str(tmp_path / "a.log"), CONN, corrupt="_bad")
    assert sorted(r._bad is not None for r in df.collect()) == [False, True]
    assert dict(logs.read_json(spark, str(tmp_path / "a.log")).dtypes)["ts"] == "timestamp"


def test_unknown_and_empty_inputs(spark):
    with pytest.raises(ValueError):
        read_and_normalize(spark, "x", "http")
    with pytest.raises(ValueError):
        merge()
    empty = normalize(spark.createDataFrame([], CONN), "conn")
    assert empty.schema.names == UNIFIED.names and ordered(empty).count() == 0
    assert eda.host_risk(empty.withColumn("ti_match", F.lit(False))).count() == 0
    assert eda.failed_rate(empty).first().failed_rate == 0.0
    assert timeseries.series(empty, None, "1min").count() == 0
    assert baseline.fit(baseline.long_form(baseline.windowed_metrics(empty, None))).count() == 0
    assert hypothesis.Alerting().evaluate(empty, None).count() == 0
    assert normalize(spark.createDataFrame([], DNS), "dns").schema.names == UNIFIED.names
    assert resolve(empty, "ts", "timestamp") == "`timestamp`" and resolve(empty, "none") is None


def test_addresses(spark):
    values = ["10.1.2.3", "172.31.0.1", "172.32.0.1", "8.8.8.8", "01.2.3.4", "256.1.1.1", "::1", "2001:4860:4860::8888", "fe80::1", "1::2::3", "::ffff:1.2.3.4", "224.0.0.1", "", None]
    rows = spark.createDataFrame([(v,) for v in values], "ip string").select("ip", is_ip(F.col("ip")).alias("ok"), is_internal(F.col("ip")).alias("inside"), is_public(F.col("ip")).alias("public"), ipv6_hex(F.col("ip")).alias("h")).collect()
    for r in rows:
        try:
            address = ipaddress.ip_address(r.ip)
        except ValueError:
            address = None
        assert bool(r.ok) == (address is not None), r
        if address is not None:
            assert r.public == address.is_global or address.version == 4 and not address.is_private
            if address.version == 6:
                assert int(r.h, 16) == int(address)
    assert [r.ip for r in rows if r.inside] == ["10.1.2.3", "172.31.0.1"]


def test_geo(spark):
    ranges = spark.createDataFrame([("198.0.0.0", "199.0.0.0", "AA", 1, "wide"), ("198.51.0.0", "198.51.255.255", "BB", 2, "narrow"), ("2600::", "2600:ffff::", "CC", 3, "six"), ("bad", "198.0.0.1", "DD", 4, "none")], "start_ip string, end_ip string, country string, asn long, org string")
    df = spark.createDataFrame([("198.51.7.7", "198.2.2.2"), ("2600::5", None), ("10.0.0.1", "zzz")], "src_ip string, dst_ip string")
    got = {r.src_ip: (r.src_ip_country, r.dst_ip_country) for r in enrich.geo(df, ranges, ("src_ip", "dst_ip", "none")).collect()}
    assert got == {"198.51.7.7": ("BB", "AA"), "2600::5": ("CC", None), "10.0.0.1": (None, None)}
    with pytest.raises(ValueError):
        enrich.geo(df, ranges, ("none",), strict=True)


def test_moving_average_golden(spark):
    connections = [3, 2, 2, 1, 3, 1, 1, 3, 3, 0, 1, 1]
    df = spark.createDataFrame([(T0 + timedelta(seconds=k), c) for k, c in enumerate(connections)], "bucket timestamp, connections long")
    rows = timeseries.spikes(df, "connections", 3, 1.5).orderBy("bucket").collect()
    assert [round(r.sma, 4) for r in rows] == [3.0, 2.5, 2.3333, 1.6667, 2.0, 1.6667, 1.6667, 1.6667, 2.3333, 2.0, 1.3333, 0.6667]
    assert [k for k, r in enumerate(rows) if r.anomaly] == [7]


def test_buckets(spark):
    at = [T0, T0 + timedelta(minutes=1), T0 + timedelta(minutes=9, seconds=30), None]
    df = spark.createDataFrame([(t, "SF", None) for t in at], "timestamp timestamp, conn_state string, dns_rcode string")
    filled = timeseries.spike_series(df, "5min").orderBy("bucket").collect()
    assert [(r.bucket.minute, r.connections) for r in filled] == [(0, 2), (5, 1)]
    odd = timeseries.bucket(df.where("timestamp is not null"), "7min").select("bucket").distinct().orderBy("bucket").collect()
    assert [r.bucket for r in odd] == [datetime(2024, 5, 1, 7, 56), datetime(2024, 5, 1, 8, 3)]  # counted from midnight
    with pytest.raises(ValueError):
        timeseries.seconds_of("5 parsecs")


def test_proportion_golden(spark):
    df = spark.createDataFrame([(4, 12, 3, 9)], "k long, n long, k2 long, n2 long")
    a = hypothesis.proportion(df, "k", "n", 0.05).first()
    assert math.isclose(a.z, 4.503410014, rel_tol=1e-9) and math.isclose(a.p_value, 3.3436e-06, rel_tol=1e-4) and a.severity == "CRITICAL" and a.reject_null
    b = hypothesis.proportion(df, "k2", "n2", 0.10).first()
    assert math.isclose(b.z, 2.333333333, rel_tol=1e-9) and math.isclose(b.p_value, 0.009815329, rel_tol=1e-6) and b.severity == "HIGH"
    edge = hypothesis.proportion(df, "k", "n", 0.0).first()
    assert edge.z == math.inf and edge.p_value == 0.0
    same = hypothesis.two_proportions(spark.createDataFrame([(5, 5, 7, 7)], "a long, b long, c long, d long"), "a", "b", "c", "d").first()
    assert (same.z, same.p_value) == (0.0, 1.0)
    with pytest.raises(ValueError):
        hypothesis.proportion(df, "k", "n", 0.1, alternative="sideways")


def test_normal_tail(spark):
    zs = [-9.0, -2.5, -1.0, 0.0, 0.5, 1.96, 2.4999, 2.5, 5.0, 8.0, 20.0, math.inf]
    rows = spark.createDataFrame([(z,) for z in zs], "z double").select("z", p_value(F.col("z"), "greater").alias("p")).collect()
    for r in rows:
        assert math.isclose(r.p, 0.5 * math.erfc(r.z / math.sqrt(2)), rel_tol=1e-11), r
    got = spark.range(1).select(*[severity(F.lit(p)).alias(f"s{k}") for k, p in enumerate((0.0001, 0.001, 0.01, 0.05))]).first()
    assert list(got) == ["CRITICAL", "HIGH", "MEDIUM", "LOW"]


def test_baseline_golden(spark):
    values = [("failed", x) for x in (0.0, 50.0, 100 / 3, 0.0)] + [("one", 5.0)]
    model = baseline.fit(spark.createDataFrame(values, "metric string, value double"))
    row = model.where("metric = 'failed'").first()
    assert [round(row[c], 4) for c in ("mean", "std", "median", "p95", "p99")] == [20.8333, 25.0, 16.6667, 47.5, 49.5]
    one = baseline.BaselineModel(model)
    assert one.z_score("one", 5.0) == 0.0 and one.z_score("one", 4.0) == math.inf
    back = baseline.BaselineModel.from_json(spark, one.to_json())
    assert sorted(map(tuple, back.model.collect())) == sorted(map(tuple, model.collect()))
    found = baseline.detect(spark.createDataFrame([(T0, "one", 9.0), (T0, "failed", 20.0), (T0, "other", 1.0)], "bucket timestamp, metric string, value double"), model).collect()
    assert {r.metric: r.is_anomaly for r in found} == {"one": True, "failed": False}


def test_per_host_keeps_hosts_with_connections(spark):
    conn = spark.createDataFrame([("a", "S0", 5, 0), ("a", "S1", 5, None)], "src_ip string, conn_state string, bytes_sent long, bytes_recv long")
    dns = spark.createDataFrame([("a", "NXDOMAIN"), ("b", None)], "src_ip string, dns_rcode string")
    rows = baseline.per_host(conn, dns).collect()
    assert [(r.host, r.failed_connections, r.bytes_ratio, r.nxdomain_count) for r in rows] == [("a", 1, None, 1)]


@settings(max_examples=40, deadline=None)
@given(st.lists(st.floats(-5, 5), min_size=1, max_size=60))
def test_cusum_walk(values):
    x = np.array(values)
    up, low, way, pre, post = cusum.walk(x, 0.0, 0.5, 3.0)
    assert (up >= 0).all() and (low >= 0).all()
    u = v = 0.0
    for i, value in enumerate(x):
        u, v = max(0.0, u + value - 0.5), max(0.0, v - value - 0.5)
        assert math.isclose(up[i], u, abs_tol=1e-12) and math.isclose(low[i], v, abs_tol=1e-12)
        assert way[i] == (1 if u > 3 else -1 if v > 3 else 0)
        n = i + 1
        w = min(10, n // 2)
        if way[i]:
            want = (x[n - 2 * w : n - w].mean(), x[n - w : n].mean()) if w and n > 2 * w else (0.0, value)
            assert np.allclose((pre[i], post[i]), want)
            u = v = 0.0


def test_cusum_by_key_and_split(spark):
    rows = [(k, i, 0.0 if i < 30 else 5.0) for k in ("a", "b") for i in range(40)] + [("a", 99, None)]
    df = spark.createDataFrame(rows, "k string, t long, x double")
    noisy = df.withColumn("x", F.col("x") + (F.col("t") % 3) * 0.1)
    found = cusum.detect_changes(noisy.where("k = 'a'").drop("k"), "t", "x")
    assert cusum.change_points(found).orderBy("index").first().direction == "increase"
    both = cusum.detect(noisy, cusum.fit(noisy.where("t < 30"), "x", key=["k"]), "t", "x", ["k"])
    assert {r.k: r.n for r in both.groupBy("k").agg(F.count_if("change").alias("n")).collect()} == {"a": 10, "b": 10}
    with pytest.raises(ValueError):
        cusum.detect_changes(noisy.limit(5), "t", "x")


def test_calibration(spark):
    rng = np.random.default_rng(42)
    y = (rng.random(400) < 0.2).astype(int)
    s = np.clip(np.round(rng.normal(0.3 + 0.3 * y, 0.15), 3), 0, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, s, strict=True)], "label int, score double")
    points = calibrate.evaluate(df).orderBy("threshold").collect()
    grid = np.linspace(0.01, 0.99, 100)
    for r, t in zip(points, grid, strict=True):
        assert math.isclose(r.threshold, t, rel_tol=1e-12)
        assert (r.tp, r.fp) == (int(((s >= r.threshold) & (y == 1)).sum()), int(((s >= r.threshold) & (y == 0)).sum()))
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg[None]) + 0.5 * (pos[:, None] == neg[None])).mean()
    assert math.isclose(calibrate.roc_auc(df).first().roc_auc, auc, rel_tol=1e-12)
    best = calibrate.optimum(calibrate.evaluate(df)).first()
    assert best.f1 == max(r.f1 for r in points)
    assert calibrate.optimum(calibrate.evaluate(df), least_recall=2.0).first().f1 == best.f1
    off = calibrate.workload(calibrate.evaluate(df), 1000, exact=False).orderBy("target_recall").collect()
    on = calibrate.workload(calibrate.evaluate(df), 1000).orderBy("target_recall").collect()
    assert len(on) == 5 and all(a.threshold <= b.threshold for a, b in zip(off, on, strict=True))
    assert calibrate.daily_alerts(calibrate.evaluate(df), 0.5, 1000).first().daily_events == 1000


def test_stationarity_needs_ten(spark):
    df = spark.range(9).select(F.timestamp_seconds("id").alias("bucket"), F.lit(1.0).alias("x"))
    assert timeseries.stationarity(df, "x").first().is_stationary is None


def test_svm(spark):
    rng = np.random.default_rng(0)
    xy = rng.uniform(-1, 1, (400, 2))
    rows = [(f"u{k}", float(a), float(b), int(a * a + b * b < 0.4)) for k, (a, b) in enumerate(xy)]
    df = spark.createDataFrame(rows, "uid string, a double, b double, label int")
    ring = ml.evaluate(ml.SVM(kernel="rbf", inputs=("a", "b"), components=60, max_iter=40, gamma=0.5).fit(df).predict(df)).first()
    assert ring.f1 > 0.9
    out = ml.SVM(kernel="poly", degree=2, inputs=("a", "b"), max_iter=40).fit(df).predict(df)
    assert ml.evaluate(out).first().f1 > 0.9 and out.agg(F.min("probability"), F.max("probability")).first()[1] <= 1
    single = ml.SVM(kernel="linear", inputs=("a", "b")).fit(df.where("label = 1")).predict(df)
    assert single.where("prediction = 0").count() == 0
    assert "anomaly" in ml.classification_report(out)


def test_grid_search(spark):
    df = spark.createDataFrame([(f"u{k}", float(k % 10), int(k % 10 > 4)) for k in range(60)], "uid string, a double, label int")
    found = ml.grid_search(df, {"C": (1.0,), "kernel": ("linear",), "inputs": (("a",),), "max_iter": (10,)}, folds=2)
    assert found["best_f1"] > 0.9


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, ["a", "b"], None), (2, None, "x")], "i long, l array<string>, s string")
    sinks.write_csv(df, f"{tmp_path}/csv")
    assert spark.read.option("header", True).csv(f"{tmp_path}/csv").where("i = 1").first().l == "['a', 'b']"
    assert sinks.content_hash(df).first() == sinks.content_hash(df.repartition(3)).first()
    assert sinks.signature(df)["nulls"] == {"i": 0, "l": 1, "s": 1}
    assert sinks.versioned("b", datetime(2024, 1, 2, 3, 4, 5)) == "b/v20240102_030405"


def test_spike_run(spark, folder):
    pipelines.standardize(spark, f"{folder}/logs", None, f"{folder}/ecs")
    path = next((folder / "ecs").glob("v*/ecs_csv"))
    marked, summary = pipelines.detect_spikes(spark, str(path), f"{folder}/sp", "1s", 3, 1.5)
    assert summary["total_buckets"] == 10 and marked.agg(F.sum("connections")).first()[0] == 9
    with pytest.raises(FileNotFoundError):
        logs.first_existing(spark, [f"{folder}/none"])


def test_nested_and_wide_ranges(spark):
    rows = [("2a00:1450::", "2a00:1450::fff:ffff", "AA"), ("2a00:1450::10", "2a00:1450::1f", "BB"), ("2a00::", "2aff:ffff:ffff:ffff:ffff:ffff:ffff:ffff", "WW"), ("2a00:1450:0:0:ffff:ffff:ffff:ffff", "2a00:1450:0:1::", "EE"), ("1.0.0.0", "200.255.255.255", "VV"), ("8.8.7.250", "8.8.8.8", "CC"), ("8.8.8.0", "8.8.8.255", "DD"), ("9.9.9.9", "9.9.9.9", "SS"), ("bad", "9.9.9.9", "XX")]
    ranges = spark.createDataFrame([(*r, 1, "o") for r in rows], "start_ip string, end_ip string, country string, asn long, org string")
    want = {"2a00:1450::12": "BB", "2a00:1450::20": "AA", "2a00:1450:1::": "WW", "2a00:1450:0:0:ffff:ffff:ffff:ffff": "EE", "2a00:1450:0:1::": "EE", "2a00:1450:0:1::1": "WW", "2b00::1": None, "8.8.7.255": "CC", "8.8.8.8": "CC", "8.8.8.9": "DD", "9.9.9.9": "SS", "9.9.9.8": "VV", "201.0.0.0": None, "10.1.1.1": None, "x": None}
    values = spark.createDataFrame([(v,) for v in want], "v string")
    got = {r.v: r.country for r in enrich.lookup(values, ranges).collect()}
    assert {v: got.get(v) for v in want} == want
    assert enrich.range_table(ranges).groupBy("start", "end").count().agg({"count": "max"}).first()[0] <= 256


def test_networks_as_ranges(spark, tmp_path):
    from packetloom.sources import logs

    path = tmp_path / "ranges.csv"
    path.write_text("network,country,asn\n8.8.8.0/23,US,15169\n8.8.9.128/25,DE,\n2001:4860::/33,FR,1\n0.0.0.0/0,WW,2\n1.2.3.4/40,XX,3\n,YY,4\n")
    ranges = logs.read_ranges(spark, f"file://{path}")
    values = spark.createDataFrame([("8.8.9.1",), ("8.8.9.200",), ("8.8.10.0",), ("2001:4860:7fff::1",), ("2001:4860:8000::1",)], "v string")
    got = {r.v: (r.country, r.asn) for r in enrich.lookup(values, ranges).collect()}
    assert got == {"8.8.9.1": ("US", 15169), "8.8.9.200": ("DE", None), "8.8.10.0": ("WW", 2), "2001:4860:7fff::1": ("FR", 1)}
    with pytest.raises(FileNotFoundError):
        logs.read_ranges(spark, f"file://{tmp_path}/none.csv")


def test_beta_draws(spark):
    from packetloom.sources import logs

    got = logs.generated_scores(spark, 4000, 0.25).groupBy("label").agg({"score": "avg", "i": "count"}).orderBy("label").collect()
    assert [r["count(i)"] for r in got] == [3000, 1000]
    assert abs(got[0]["avg(score)"] - 2 / 7) < 0.02 and abs(got[1]["avg(score)"] - 5 / 7) < 0.02


def test_text_reports(spark):
    from packetloom.operators import baseline, cusum, hypothesis, reports, timeseries

    rows = [(k, float(10 + k % 3 + (50 if k > 30 else 0))) for k in range(40)]
    df = spark.createDataFrame(rows, "bucket long, x double")
    model = cusum.fit(df.where("bucket < 20"), "x")
    detected = cusum.detect(df, model, "bucket", "x")
    text = reports.cusum_report(model, detected)
    assert f"{detected.where('change').count()} changes in 40 values" in text and "increase" in text
    fitted = baseline.BaselineModel(baseline.fit(df.selectExpr("bucket", "'m' as metric", "x as value")))
    assert "windows: 40" in reports.baseline_report(fitted)
    series = timeseries.rolling(df.withColumnRenamed("x", "failed_rate"), ["failed_rate"], 10)
    assert "40 buckets from 0 to 39" in reports.series_report(series) and "failed_rate beyond 2.0" in reports.series_report(series)
    counts = spark.createDataFrame([(60, 100)], "k long, n long")
    text = reports.hypothesis_report(hypothesis.proportion(counts, "k", "n", 0.1, metric="failed"))
    assert "ALERT [CRITICAL] failed" in text and "failed: investigate now" in text
    scored = spark.createDataFrame([(int(k % 4 == 0), 0.9 if k % 4 == 0 else 0.1) for k in range(100)], "label int, score double")
    text = reports.calibration_report(scored, 1000)
    assert "100 rows, 25 positive" in text and "area under the curve 1.0000" in text and "250 alerts, 250 of them true" in text


def test_coercion_warnings_are_bounded(spark):
    from packetloom.operators import ecs

    df = spark.createDataFrame([("x", "1"), (None, "y")], "`source.bytes` string, `source.port` string")
    assert ecs.coercion_warnings(df) == ["source.bytes: 1 of its string values do not fit long and become null", "source.port: 1 of its string values do not fit port and become null"]
    assert len(ecs.coercion_warnings(df, most=1)) == 1 and ecs.coercion_warnings(df.select("`source.bytes`").where("false")) == []


def test_summary_lists_are_whole(spark):
    from packetloom.operators import reports

    events = spark.createDataFrame([("conn", str(k), f"10.0.{k // 200}.{k % 200}", "8.8.8.8", 80, "tcp", "S0", None, None, False) for k in range(150)], "log_type string, uid string, src_ip string, dst_ip string, dst_port long, protocol string, conn_state string, dns_query string, dns_rcode string, ti_match boolean").withColumn("timestamp", F.current_timestamp())
    assert len(reports.findings(events)["failed_sources"]) == 150 and len(reports.findings(events, 10)["failed_sources"]) == 10


def test_grid_search_side_by_side(spark):
    from packetloom.operators import ml

    rows = spark.createDataFrame([(str(k), float(k % 2 * 10 + k % 3), 1.0, 1.0, 0.0, 0, 0, 0, k % 2) for k in range(120)], "uid string, duration double, bytes_sent double, bytes_recv double, bytes_ratio double, failed int, ti_match int, nxdomain int, label int")
    found = ml.grid_search(rows, {"C": (0.1, 1.0), "kernel": ("linear",), "max_iter": (5,)}, folds=2)
    assert len(found["results"]) == 2 and found["best_f1"] > 0.95
