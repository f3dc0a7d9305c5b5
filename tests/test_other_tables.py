"""Registered queries against their SQL on made events, where the driver's tables lack a case."""

import duckdb
import pytest
from test_queries import plain

from packetloom.plans import ORACLE, QUERIES


@pytest.fixture
def agree(spark, tmp_path):
    """A function that writes the rows of an SQL select as events, and asserts that a query gives what its SQL gives; returns that."""

    def check(name, select):
        duck = duckdb.connect()
        duck.execute(f"COPY ({select}) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
        duck.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
        want = duck.execute(ORACLE[name])
        columns = [d[0] for d in want.description]
        rows = sorted((tuple(map(plain, r)) for r in want.fetchall()), key=repr)
        assert sorted((tuple(plain(r[c]) for c in columns) for r in QUERIES[name](spark, str(tmp_path)).collect()), key=repr) == rows
        return [dict(zip(columns, r, strict=True)) for r in rows]

    return check


def events_of(n, time, user="i"):
    return f"SELECT i AS event_id, TIMESTAMP '2024-01-01' + to_minutes({time}) AS ts, CAST({user} AS BIGINT) AS user_id, ['view', 'error', 'click'][i % 3 + 1] AS event_type, i % 90 + 0.5::DOUBLE AS value, '{{\"k\": ' || i % 100 || '}}' AS props FROM range({n}) t(i)"


@pytest.mark.parametrize(("n", "time", "anomalies"), [(240, "CAST(10 * i AS INT)", 0), (0, "CAST(i AS INT)", 0), (240, "CAST(CASE WHEN i < 200 THEN 10 * i ELSE 2000 END AS INT)", 1)])
def test_summary_of_spikes_without_any(agree, n, time, anomalies):
    """Even hours, no event at all, and one spike."""
    assert agree("sma_summary", events_of(n, time))[0]["anomalies"] == anomalies


#: Users around the first whose source address has a part over 255, and far above.
MANY_USERS = events_of(400, "CAST(i AS INT)", "[65535, 65536, 90000, 16777216, 12345678901][i % 5 + 1] + i // 5")


def test_every_user_has_an_address(spark):
    from pyspark.sql import functions as F

    from packetloom.functions.network import is_ip
    from packetloom.sources.adapters import carried

    want = {"10.0.0.7": "10.0.0.7", "10.0.255.255": "10.0.255.255", "10.0.256.0": "10.1.0.0", "10.0.351.144": "10.1.95.144", "10.0.65536.3": "10.0.0.3", "10.0.0.-5": "10.0.0.251", None: None}
    rows = spark.createDataFrame([(x,) for x in want], "ip string").select("ip", carried(F.col("ip")).alias("c"))
    assert {r.ip: r.c for r in rows.collect()} == want and rows.where(is_ip(F.col("c"))).count() == len(want) - 1


def test_types_are_validated_for_any_user(agree):
    assert {r["field"]: r["errors"] for r in agree("validation_by_type", MANY_USERS)}["source.ip"] == 184


def test_validation_is_counted_for_any_user(agree):
    assert {r["field"]: r["errors"] for r in agree("ecs_validation_counts", MANY_USERS)}["source.ip"] == 37


def test_report_for_any_user(agree):
    """Ports beyond 65,535 are the only errors; they are in both kinds of log."""
    assert agree("validation_report", MANY_USERS.replace("i % 100", "i * 400"))[0]["errors"] == 2 * (400 - 164)
