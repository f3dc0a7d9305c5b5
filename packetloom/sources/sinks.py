"""Writers: tables, single-file CSV, JSON reports, manifests and versioned runs. Small text goes through Spark's own file systems."""

from __future__ import annotations

import json
import tempfile
import uuid
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir; where that is unset, a temporary one on a local master only."""
    if not (base := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}"
    return f"{base}/{uuid.uuid4().hex}"


def write_parquet(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Parquet, partitioned on request (by log_type and a date for pruning)."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def flat(df: DataFrame) -> DataFrame:
    """Arrays as list text and structs as JSON, so a CSV can hold them."""
    out = []
    for name, kind in df.dtypes:
        col = F.col(f"`{name}`")
        if kind == "array<string>":
            col = F.when(col.isNotNull(), F.concat(F.lit("["), F.array_join(F.transform(col, lambda x: F.concat(F.lit("'"), x, F.lit("'"))), ", "), F.lit("]")))
        elif kind.startswith(("array", "struct", "map")):
            col = F.to_json(col)
        out.append(col.alias(name))
    return df.select(out)


def write_csv(df: DataFrame, path: str, single: bool = True, escape: str = "\\") -> None:
    """CSV with a header; single asks for one part (for report-sized results)."""
    rows = flat(df)
    (rows.coalesce(1) if single else rows).write.mode("overwrite").option("header", True).option("escape", escape).csv(path)


def write_text(spark: SparkSession, text: str, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(p, True)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def write_json(spark: SparkSession, report: dict, path: str) -> None:
    write_text(spark, json.dumps(report, indent=2, default=str), path)


def content_hash(df: DataFrame) -> DataFrame:
    """(rows, hash): an order-free hash of the rows, stable whatever the files are called or how rows fall into them."""
    cols = [F.to_json(F.struct(F.col(f"`{n}`"))) if t.startswith("map") else F.col(f"`{n}`") for n, t in df.dtypes]
    return df.select(F.xxhash64(*cols).alias("h")).agg(F.count("*").alias("rows"), F.coalesce(F.expr("bit_xor(h)"), F.lit(0)).alias("xor"), F.coalesce(F.sum(F.expr("cast(h as decimal(38, 0))")), F.lit(0)).alias("sum")).select("rows", F.sha2(F.concat_ws(":", "rows", "xor", "sum"), 256).alias("hash"))


def signature(df: DataFrame) -> dict:
    """Rows, columns, types and null counts, in one aggregation."""
    row = df.agg(F.count("*").alias("n"), *[F.count_if(F.col(f"`{c}`").isNull()).alias(f"x{k}") for k, c in enumerate(df.columns)]).first()
    return {"rows": row.n, "columns": df.columns, "types": dict(df.dtypes), "nulls": {c: row[f"x{k}"] for k, c in enumerate(df.columns)}}


def manifest(tables: dict[str, DataFrame], **more: object) -> dict:
    """What a run wrote: rows and content hash of each table."""
    found = {name: content_hash(df).first().asDict() for name, df in tables.items()}
    return {"created": datetime.now(timezone.utc).isoformat(), "tables": found, **more}


def versioned(base: str, now: datetime | None = None) -> str:
    return f"{base}/v{(now or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S')}"
