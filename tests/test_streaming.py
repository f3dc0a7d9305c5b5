import json
from datetime import datetime, timedelta

from packetloom.sources.indicators import Indicators
from packetloom.streaming import online


def write(folder, name, rows):
    (folder / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")


def drain(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream(spark, tmp_path):
    t = datetime(2024, 1, 1)
    row = lambda k, ip: {"ts": (t + timedelta(seconds=k)).isoformat() + "Z", "uid": f"u{k}", "id.orig_h": "10.0.0.1", "id.resp_h": ip, "conn_state": "S0"}
    (tmp_path / "in").mkdir()
    write(tmp_path / "in", "a.log", [row(0, "203.0.113.9"), row(30, "198.51.100.1"), row(90, "198.51.100.1")])
    write(tmp_path / "in", "b.log", [row(4000, "198.51.100.1")])
    feeds = Indicators.empty(spark).add("ip", "203.0.113.9").add("domain", "evil.test")
    events = online.threat_match(online.read_log_stream(spark, f"{tmp_path}/in", "conn"), feeds)
    assert [r.uid for r in drain(events, "flagged").where("ti_match").collect()] == ["u0"]
    counts = online.windowed_counts(online.read_log_stream(spark, f"{tmp_path}/in", "conn"))
    got = {r.window_start: (r.connections, r.failed) for r in drain(counts, "counts", "complete").collect()}
    assert got[t] == (2, 2) and got[t + timedelta(minutes=1)] == (1, 1)


def test_online_cusum(spark, tmp_path):
    (tmp_path / "v").mkdir()
    write(tmp_path / "v", "a.json", [{"k": "a", "t": f"2024-01-01T00:00:{s:02d}Z", "x": 0.0 if s < 5 else 4.0} for s in range(10)])
    values = spark.readStream.schema("k string, t timestamp, x double").json(f"{tmp_path}/v")
    rows = drain(online.cusum(values, "k", "t", "x", 0.0, 0.5, 5.0), "cusum").orderBy("index").collect()
    assert [r.change for r in rows] == [False] * 6 + [True, False, True, False]
