"""Every registered query with SQL, against DuckDB on the same tables."""

import math

import duckdb
import pytest

from packetloom.plans import ORACLE, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}


@pytest.fixture(scope="module")
def duck(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6) + 0.0
    return v


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_sql(spark, sf_dir, duck, name):
    df = QUERIES[name](spark, sf_dir)
    want = duck.execute(ORACLE[name])
    columns, types = [d[0] for d in want.description], {d[0]: str(d[1]) for d in want.description}
    assert sorted(df.columns) == sorted(columns)
    assert {c: TYPES.get(t, t) for c, t in df.dtypes} == types
    order = sorted(columns)
    got = sorted((tuple(plain(r[c]) for c in order) for r in df.collect()), key=repr)
    assert got == sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in want.fetchall()), key=repr)


def test_only_hashes_and_fits_have_no_sql():
    assert set(QUERIES) - set(ORACLE) == {"content_signature", "svm_evaluation"}


def test_content_signature(spark, sf_dir):
    """The hash depends on rows and their number alone."""
    from packetloom.sources import sinks
    from packetloom.sources.adapters import events

    df, row = events(spark, sf_dir), QUERIES["content_signature"](spark, sf_dir).first()
    assert row.rows == df.count() == 1000
    assert sinks.content_hash(df.orderBy("dst_ip").repartition(7)).first() == row
    assert sinks.content_hash(df.unionByName(df.limit(1))).first().hash != row.hash != sinks.content_hash(df.where("uid <> '1'")).first().hash


def test_svm_evaluation(spark, sf_dir):
    """A linear machine on features that hold the label's own indicators must get nearly all rows of the test part right."""
    m = QUERIES["svm_evaluation"](spark, sf_dir).first()
    assert m.n == m.tp + m.fp + m.fn + m.tn and 200 < m.n < 400
    assert m.accuracy == pytest.approx((m.tp + m.tn) / m.n) and m.accuracy > 0.95 and m.f1 == pytest.approx(2 * m.tp / (2 * m.tp + m.fp + m.fn))


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
