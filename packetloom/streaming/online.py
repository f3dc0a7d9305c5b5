"""Structured Streaming forms: logs to enriched events, windowed counts with watermarks, and CUSUM with state for each series."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StringType, StructField, StructType, TimestampType

from ..functions.network import label_suffixes
from ..operators.eda import failed, nxdomain
from ..operators.enrich import BROADCAST_BYTES
from ..operators.normalize import normalize
from ..schema import LOGS
from ..sources.indicators import Indicators
from ..sources.logs import parse_time


def read_log_stream(spark: SparkSession, folder: str, log_type: str, files_per_trigger: int | None = None) -> DataFrame:
    """NDJSON files landing in a folder, as unified events."""
    schema = LOGS[log_type]
    raw = StructType([StructField(f.name, StringType() if isinstance(f.dataType, TimestampType) else f.dataType) for f in schema])
    reader = spark.readStream.schema(raw)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    df = reader.json(folder)
    return normalize(df.withColumn("ts", parse_time(F.col("ts"))), log_type)


def threat_match(events: DataFrame, feeds: Indicators) -> DataFrame:
    """Adds ti_match by stream-static joins. The static side is exploded beforehand; the row's suffixes are tested against a small set.

    Indicators are joined as one row that holds their distinct values as map keys, so a row of the stream never multiplies. Feeds of
    over BROADCAST_BYTES are refused: enrich those by the batch join in foreachBatch.
    """
    if feeds.rows.agg(F.coalesce(F.sum(F.length("indicator") + 8), F.lit(0))).first()[0] > BROADCAST_BYTES:
        raise ValueError("too many indicators to hold in each task; use enrich.threat_match in foreachBatch")
    keys = feeds.ips().unionByName(feeds.domains()).distinct().agg(F.map_from_arrays(F.collect_list("indicator"), F.collect_list(F.lit(True))).alias("_listed"))
    listed = lambda c: F.coalesce(F.try_element_at(F.col("_listed"), c), F.lit(False))
    by_ip = listed(F.lower("dst_ip"))
    by_domain = F.coalesce(F.exists(label_suffixes(F.col("dns_query")), lambda d: listed(d)), F.lit(False))
    return events.join(F.broadcast(keys)).withColumn("ti_match", F.coalesce(by_ip, F.lit(False)) | by_domain).drop("_listed")


def windowed_counts(events: DataFrame, width: str = "1 minute", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """(window_start, connections, nxdomain, failed) with a watermark: state of closed windows is dropped, later rows are not counted."""
    w = F.window("timestamp", width, slide) if slide else F.window("timestamp", width)
    agg = events.withWatermark("timestamp", late).groupBy(w.alias("w")).agg(F.count("*").alias("connections"), F.count_if(nxdomain()).alias("nxdomain"), F.count_if(failed()).alias("failed"))
    return agg.select(F.col("w.start").alias("window_start"), "connections", "nxdomain", "failed")


def sessions(events: DataFrame, gap: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Activity sessions of each source."""
    agg = events.withWatermark("timestamp", late).groupBy(F.session_window("timestamp", gap).alias("w"), "src_ip").agg(F.count("*").alias("events"))
    return agg.select("src_ip", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "events")


def cusum(values: DataFrame, key: str, time: str, value: str, target: float, k: float, h: float) -> DataFrame:
    """Online cumulative sums for each key: O(1) state (two sums and a count), rows of a batch in time order. Nulls are skipped."""

    def step(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        up, low, n = state.get if state.exists else (0.0, 0.0, 0)
        rows = pd.concat(list(frames)).dropna(subset=["_x"]).sort_values("_t")
        out = []
        for t, x in zip(rows["_t"], rows["_x"], strict=True):
            up, low = max(0.0, up + x - target - k), max(0.0, low - x + target - k)
            way = "increase" if up > h else "decrease" if low > h else None
            out.append((keys[0], n, t, x, up, low, way is not None, way))
            n += 1
            if way:
                up = low = 0.0
        state.update((up, low, n))
        yield pd.DataFrame(out, columns=["key", "index", "time", "value", "upper", "lower", "change", "direction"])

    rows = values.select(F.col(key).cast("string").alias("_k"), F.col(time).cast("timestamp").alias("_t"), F.col(value).cast("double").alias("_x"))
    schema = "key string, index long, time timestamp, value double, upper double, lower double, change boolean, direction string"
    return rows.groupBy("_k").applyInPandasWithState(step, schema, "up double, low double, n long", "append", GroupStateTimeout.NoTimeout)
