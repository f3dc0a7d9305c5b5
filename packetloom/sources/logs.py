"""Connection and DNS logs: newline-delimited JSON, or tab-separated with # headers."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DataType, StringType, StructField, StructType, TimestampType

from ..schema import LOGS, TIMESTAMPS

#: What a missing value looks like in the tab-separated format.
MISSING = ("-", "(empty)")
NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"


def parse_time(text: Column) -> Column:
    """A timestamp from ISO 8601 or from epoch seconds; null if it is neither."""
    return F.when(text.rlike(NUMBER), F.timestamp_seconds(F.trim(text).try_cast("double").try_cast("decimal(20,6)"))).otherwise(F.try_to_timestamp(text))


def detect_format(spark: SparkSession, path: str) -> str:
    """"tsv" if the first line begins with #, "json" if it parses as an object, else "tsv". An empty file is "tsv"."""
    first = spark.read.text(path).select(F.trim("value").alias("line"), F.try_parse_json("value").isNotNull().alias("json")).first()
    return "json" if first and not first.line.startswith("#") and first.json else "tsv"


def read_json(spark: SparkSession, path: str | list[str], schema: StructType | None = None, corrupt: str | None = None) -> DataFrame:
    """One pass over NDJSON with a declared schema: timestamps are read as text and parsed, ISO or epoch; a value of a wrong type is null.

    Without a schema the types are inferred (a pass more) and the timestamp columns parsed. corrupt names a column for malformed lines.
    """
    reader = spark.read.option("mode", "PERMISSIVE")
    if schema is None:
        df = reader.json(path)
        found = {c: parse_time(F.col(f"`{c}`").cast("string")) for c in TIMESTAMPS if c in df.columns}
        return df.withColumns(found) if found else df
    raw = StructType([StructField(f.name, StringType() if isinstance(f.dataType, TimestampType) else f.dataType) for f in schema])
    if corrupt:
        reader, raw = reader.option("columnNameOfCorruptRecord", corrupt), StructType([*raw, StructField(corrupt, StringType())])
    df = reader.schema(raw).json(path)
    return df.select([parse_time(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, TimestampType) else F.col(f"`{f.name}`") for f in schema] + ([F.col(corrupt)] if corrupt else []))


def _value(text: Column, kind: DataType) -> Column:
    if isinstance(kind, TimestampType):
        return parse_time(text)
    if isinstance(kind, ArrayType):
        return F.transform(F.split(text, ","), lambda x: _value(x, kind.elementType))
    if isinstance(kind, BooleanType):
        return F.when(F.lower(text).isin("t", "true", "1"), True).when(F.lower(text).isin("f", "false", "0"), False)
    return text.try_cast(kind)


def read_tsv(spark: SparkSession, path: str, schema: StructType | None = None) -> DataFrame:
    """Tab-separated log: #fields names the columns, #types marks `time` ones; only lines that begin with # are comments.

    The schema, if given, is applied here too. Without one, `time` columns are timestamps and all others text.
    """
    lines = spark.read.text(path)
    head = {r.value.split("\t")[0]: r.value.split("\t")[1:] for r in lines.where(F.col("value").rlike(r"^#(fields|types)\t")).limit(2).collect()}
    if "#fields" not in head:
        raise ValueError(f"{path}: no #fields line")
    names, kinds = head["#fields"], head.get("#types", [])
    cells = F.split(F.col("value"), "\t", -1)
    rows = lines.where(~F.col("value").startswith("#") & (F.length("value") > 0)).select(cells.alias("c"))
    cell = lambda k: F.expr(f"nullif(nullif(try_element_at(c, {k + 1}), '{MISSING[0]}'), '{MISSING[1]}')")
    typed = {f.name: f.dataType for f in schema or []}
    out = []
    for k, name in enumerate(names):
        kind = typed.get(name) or (TimestampType() if k < len(kinds) and kinds[k] == "time" else StringType())
        out.append(_value(cell(k), kind).alias(name))
    df = rows.select(out)
    return apply_schema(df, schema) if schema else df


def apply_schema(df: DataFrame, schema: StructType) -> DataFrame:
    """Schema columns first, cast (null where a value does not fit), missing ones null; then the extra columns as they are."""
    have = dict(df.dtypes)
    out = []
    for f in schema:
        if f.name not in have:
            col = F.lit(None).cast(f.dataType)
        elif isinstance(f.dataType, TimestampType) and not have[f.name].startswith("timestamp"):
            col = parse_time(F.col(f"`{f.name}`").cast("string"))
        elif have[f.name] == f.dataType.simpleString():
            col = F.col(f"`{f.name}`")
        else:
            col = F.col(f"`{f.name}`").try_cast(f.dataType)
        out.append(col.alias(f.name))
    return df.select(out + [F.col(f"`{c}`") for c in df.columns if c not in schema.names])


def read_log(spark: SparkSession, path: str, schema: StructType | None = None, format: str | None = None) -> DataFrame:
    kind = format or detect_format(spark, path)
    return read_json(spark, path, schema) if kind == "json" else read_tsv(spark, path, schema)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path, or a glob, has a file, by the file system that Spark itself would read it from."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def first_existing(spark: SparkSession, paths: Iterable[str]) -> str:
    paths = list(paths)
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of {paths} exists")


def read_available(spark: SparkSession, folder: str, strict: bool = False) -> dict[str, DataFrame]:
    """The conn and dns logs of a folder. One may be missing (both, if strict, must exist); if both are, that is an error."""
    found = {kind: f"{folder}/{kind}.log" for kind in LOGS if exists(spark, f"{folder}/{kind}.log")}
    if not found or (strict and len(found) < len(LOGS)):
        raise FileNotFoundError(f"{folder}: need conn.log {'and' if strict else 'or'} dns.log")
    return {kind: read_log(spark, path, LOGS[kind]) for kind, path in found.items()}


def read_events_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV of events with its time column (timestamp or @timestamp) parsed and named timestamp; all else is text."""
    df = spark.read.option("header", True).option("escape", '"').csv(path)
    name = next((c for c in ("@timestamp", "timestamp", "ts") if c in df.columns), None)
    if name is None:
        raise ValueError(f"{path}: no time column")
    return df.select([(parse_time(F.col(f"`{c}`")).alias("timestamp") if c == name else F.col(f"`{c}`")) for c in df.columns])


def generated(spark: SparkSession, n: int, mean: float, std: float, change_at: int | None = None, shift: float = 0.0, seed: int = 42) -> DataFrame:
    """(i, value): seeded normal draws, shifted from change_at on, for demonstrations."""
    moved = F.when(F.col("id") >= change_at, shift).otherwise(0.0) if change_at is not None else F.lit(0.0)
    return spark.range(n).select(F.col("id").alias("i"), (F.randn(seed) * std + mean + moved).alias("value"))


def generated_scores(spark: SparkSession, n: int, positive_share: float = 0.05, positive: tuple[int, int] = (5, 2), negative: tuple[int, int] = (2, 5), seed: int = 42) -> DataFrame:
    """(i, label, score): seeded beta draws of whole-number shapes, the first positive_share of the rows positive, for demonstrations.

    A beta draw is the share of one gamma draw in two, and a gamma draw of whole shape a sum of exponential ones, so all is native.
    """
    if min(*positive, *negative) < 1 or not 0 <= positive_share <= 1:
        raise ValueError("shapes must be whole numbers from 1, the share between 0 and 1")
    draw = lambda k: -F.log(F.lit(1.0) - F.rand(seed + k))
    beta = lambda shape, k: sum((draw(k + j) for j in range(shape[0])), F.lit(0.0)) / sum((draw(k + j) for j in range(sum(shape))), F.lit(0.0))
    label = (F.col("id") < round(n * positive_share)).cast("int")
    drawn = spark.range(n).select(F.col("id").alias("i"), label.alias("label"), beta(positive, 0).alias("p"), beta(negative, 1000).alias("q"))
    return drawn.select("i", "label", F.when(F.col("label") == 1, F.col("p")).otherwise(F.col("q")).alias("score"))


def read_ranges(spark: SparkSession, path: str) -> DataFrame:
    """(start_ip, end_ip or network, country, asn, org) of a range file for geographic look-ups: Parquet, or CSV with a header.

    A file names its ranges by start_ip and end_ip or by network (1.2.3.0/24, 2001:db8::/32); other columns it lacks are null, more are
    dropped. A missing file is an error.
    """
    if not exists(spark, path):
        raise FileNotFoundError(path)
    df = spark.read.parquet(path) if path.rstrip("/").endswith(".parquet") else spark.read.option("header", True).csv(path)
    ends = ["network"] if "network" in df.columns else ["start_ip", "end_ip"]
    if not set(ends) <= set(df.columns):
        raise ValueError(f"{path}: needs start_ip and end_ip, or network")
    more = {"country": "string", "asn": "long", "org": "string"}
    return df.select(*ends, *[(F.col(c) if c in df.columns else F.lit(None)).try_cast(t).alias(c) for c, t in more.items()])


def union_all(frames: Iterable[DataFrame]) -> DataFrame:
    frames = list(frames)
    if not frames:
        raise ValueError("no frame to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
