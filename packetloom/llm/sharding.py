"""Proportional stratified interleaving: shards whose source mixture equals the corpus's, from narrow rows and native operators only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Rows that a slice of the shuffle key within a source, or of the fractional rank, should hold; there are at least and at most so many.
SLICE_ROWS, LEAST_SLICES, MOST_SLICES = 50_000, 1024, 65_536


def interleave(docs: DataFrame, shards: int = 24, seed: str = "0", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", slices: int | None = None) -> DataFrame:
    """(doc_id, size, text_crc32, source, rank, share, law, shard, slot, grown_shard), one row per input row; law "rows".

    Rows of a source are shuffled by md5(seed:doc_id:text_crc32) and ranked 1..n; share = (rank - 0.5) / n. All rows sorted by (share, source) are
    cut into shards whose counts differ by one at most, so every shard holds each source in its proportion. Ranks are exact and
    distributed: a source is sliced by key range, slices are counted (partial aggregation), and a slice's offset is added to the row
    number within it; the same again for the global position over slices of the share, which are even by construction. The number of
    slices follows the row count (SLICE_ROWS each), and the text's CRC spreads rows of one id, or of none, as well. A hot source is spread
    over its slices. Text never leaves the scan.

    Null text: size 8, CRC of no bytes. Null source: a stratum of its own, before all others. A null id is an empty one. Ties in the key
    go by id, CRC and size; rows that agree in these are interchangeable. Very long texts are read by their length and CRC alone. An empty table returns no row. grown_shard is null, as the law is not "key".
    """
    spark = docs.sparkSession
    slices = slices or min(MOST_SLICES, max(LEAST_SLICES, docs.count() // SLICE_ROWS))
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    base = docs.select(
        F.col(id_col).cast("long").alias("doc_id"),
        F.when(F.col(source_col).isNull(), "").otherwise(F.concat(F.lit("="), F.col(source_col).cast("string"))).alias("stratum"),
        (F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long") + 8).alias("size"),
        crc.alias("text_crc32"),
    ).withColumn("key", F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), "text_crc32")))
    base = base.withColumn("slice", F.expr(f"cast(conv(substr(key, 1, 4), 16, 10) as int) * {slices} div 65536"))
    ahead = Window.partitionBy("stratum").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = base.groupBy("stratum", "slice").agg(F.count("*").alias("n")).select(
        "stratum", "slice", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy("stratum")).alias("total")
    )
    within = Window.partitionBy("stratum", "slice").orderBy("key", "doc_id", "text_crc32", "size")
    ranked = base.withColumn("rank", F.row_number().over(within)).join(offsets, ["stratum", "slice"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("rank")).withColumn("share", (F.col("rank") - 0.5) / F.col("total"))
    ranked = common.cut(ranked.select("doc_id", "stratum", "size", "text_crc32", "rank", "share", F.least(F.floor(F.col("share") * slices), F.lit(slices - 1)).cast("int").alias("part")))
    counts = ranked.groupBy("part").agg(F.count("*").alias("n"))  # a row a slice
    sliced = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("part", F.coalesce(F.sum("n").over(sliced), F.lit(0)).alias("before"), F.sum("n").over(Window.partitionBy()).alias("total"))
    placed = ranked.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("share", "stratum", "rank"))).join(F.broadcast(starts), "part")
    placed = placed.withColumn("at", F.col("before") + F.col("at") - 1).withColumn("shard", F.expr(f"cast(at * {shards} div total as int)"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.expr("case when stratum <> '' then substr(stratum, 2) end").alias("source"), "rank", "share",
        F.lit("rows").alias("law"), "shard", F.expr(f"at - (shard * total + {shards - 1}) div {shards}").alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interleave(common.documents(spark, sf_dir)).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
