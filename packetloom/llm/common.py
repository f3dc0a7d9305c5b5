"""Shared pieces of the corpus operators: Arrow mapping, shared storage, connected components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns the operators read, under fixed names; all others (clashing ones included) are pruned at the scan."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def blobs(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of a string column; a null is an empty text."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def texts(column: pa.Array | pa.ChunkedArray) -> list[str]:
    """Strings of a string column; a null is an empty text."""
    return [x or "" for x in column.to_pylist()]


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str | StructType) -> DataFrame:
    """A map-only pass of fn over Arrow batches; fn returns the rows of one batch, or None."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and (out := fn(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)


def change_rows(df: DataFrame, text_col: str, fn: Callable[[list[str]], list[str | None]], length_col: str | None = None) -> DataFrame:
    """A map-only pass that keeps df's columns: fn gives each row's new text, or None to drop the row.

    Rows whose text fn returns unchanged keep every value (a null text too); where the text changes, length_col gets its length.
    """
    at = df.columns.index(text_col)
    size = df.columns.index(length_col) if length_col in df.columns else None

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        old = texts(batch.column(at))
        new = fn(old)
        keep = pa.array([x is not None for x in new], pa.bool_())
        columns = list(batch.columns)
        changed = [k for k, (a, b) in enumerate(zip(old, new, strict=True)) if b is not None and a != b]
        if changed:
            values, sizes = batch.column(at).to_pylist(), batch.column(size).to_pylist() if size is not None else None
            for k in changed:
                values[k] = new[k]
                if sizes is not None:
                    sizes[k] = len(new[k])
            columns[at] = pa.array(values, batch.schema.field(at).type)
            if sizes is not None:
                columns[size] = pa.array(sizes, batch.schema.field(size).type)
        return pa.RecordBatch.from_arrays(columns, schema=batch.schema).filter(keep)

    return map_batches(df, run, df.schema)


def batch_of(**columns: tuple[list | pa.Array, pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x, t) for x, t in columns.values()], names=list(columns))


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where that is unset, a temporary one on a local master (tests) and an error
    on any other, whose executors would not see it."""
    if not (path := spark.conf.get("spark.checkpoint.dir", None)):
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = f"file://{tempfile.mkdtemp(prefix='packetloom-')}"
        spark.conf.set("spark.checkpoint.dir", path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Cuts lineage: writes df to the shared folder and reads it back, so a lost executor costs one task, not the history."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def forget(spark: SparkSession, *frames: DataFrame) -> None:
    """Deletes what cut() wrote for the frames, once nothing reads them any more."""
    jvm = spark.sparkContext._jvm
    for df in frames:
        for f in df.inputFiles()[:1]:
            path = jvm.org.apache.hadoop.fs.Path(f.rsplit("/", 1)[0])
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def components(edges: DataFrame, max_rounds: int = 60, salts: int = 8) -> DataFrame:
    """Connected components of an undirected graph: edges (u, v) to rows (u, root), root the smallest reachable node.

    Alternates large-star and small-star steps: O(log^2 n) rounds, each a partial aggregation for the minimum neighbour and an equi-join.
    The edges of a hub are dealt over `salts` tasks, each with its own copy of the hub's minimum, and AQE can split those again; no
    adjacency list is ever gathered. Nodes without an edge are not returned. Self-loops and nulls are ignored; repeated edges count once.
    """
    spark = edges.sparkSession
    e = edges.toDF("u", "v").where("u is not null and v is not null and u <> v").selectExpr("greatest(u, v) as u", "least(u, v) as v").distinct()
    old, state = cut(e), None
    every = F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt")
    for _ in range(max_rounds):
        sym = old.unionByName(old.selectExpr("v as u", "u as v"))
        low = sym.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"), every)
        large = sym.where("v > u").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts))).join(low, ["u", "salt"]).selectExpr("v as u", "m as v").where("u <> v")
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").selectExpr("v as u", "m as v").where("u <> v").unionByName(least.selectExpr("u", "m as v"))
        new = cut(small.distinct())
        now = new.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        forget(spark, old)
        old = new
        if now == state:
            roots = old.select("v").distinct()
            return old.selectExpr("u", "v as root").unionByName(roots.selectExpr("v as u", "v as root"))
        state = now
    raise RuntimeError("components did not converge")
