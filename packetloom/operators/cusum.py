"""Sequential change-point detection by cumulative sums with reset.

The recursion is a fold: each series goes through one grouped Arrow call that walks its buckets once, in linear time. Series, not events,
are the unit, and keys run in parallel. The variant without reset is a pure window expression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = "series"


def fit(df: DataFrame, value: str, k_factor: float = 0.5, h_factor: float = 5.0, key: Sequence[str] = ()) -> DataFrame:
    """(key..., target, std, slack, limit): population deviation, 1e-10 if it is zero; nulls and NaN do not count."""
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))
    agg = rows.groupBy(*key).agg(F.avg(value).alias("target"), F.stddev_pop(value).alias("s"))
    std = F.when(F.col("s") == 0, 1e-10).otherwise(F.col("s"))
    return agg.select(*key, "target", std.alias("std"), (std * k_factor).alias("slack"), (std * h_factor).alias("limit"))


def walk(x: np.ndarray, target: float, k: float, h: float) -> tuple[np.ndarray, ...]:
    """(upper, lower, direction, pre mean, post mean) of each value; the sums start anew after an alarm."""
    n = len(x)
    up, low, pre, post, way = np.zeros(n), np.zeros(n), np.full(n, np.nan), np.full(n, np.nan), np.zeros(n, np.int8)
    total = np.append(0.0, np.cumsum(x))
    u = v = 0.0
    for i in range(n):
        u, v = max(0.0, u + x[i] - target - k), max(0.0, v - x[i] + target - k)
        up[i], low[i] = u, v
        if u > h or v > h:
            way[i] = 1 if u > h else -1
            seen = i + 1
            w = min(10, seen // 2)
            if w and seen > 2 * w:
                pre[i], post[i] = (total[seen - w] - total[seen - 2 * w]) / w, (total[seen] - total[seen - w]) / w
            else:
                pre[i], post[i] = target, x[i]
            u = v = 0.0
    return up, low, way, pre, post


def detect(df: DataFrame, model: DataFrame, time: str, value: str, key: Sequence[str] = ()) -> DataFrame:
    """(key..., index, time, value, upper, lower, change, direction, pre_mean, post_mean), one row per non-null value in time order.

    model has fit()'s columns: a row for each key. Of equal times the smaller value comes first. Means around an alarm take the last
    w and the w values before them, w = min(10, n / 2) of the n seen (with no reset); when n = 2w, the target and the value itself.
    """
    keys = list(key)
    rows = df.where(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double"))).select(*keys, F.col(time).alias("_t"), F.col(value).cast("double").alias("_x"))
    model = model.select(*keys, F.col("target").alias("_target"), F.col("slack").alias("_slack"), F.col("limit").alias("_limit"))
    rows = rows.join(model, keys) if keys else rows.join(F.broadcast(model))  # without a key the model is one row
    if not keys:
        rows = rows.withColumn(KEY, F.lit(0))
    group = keys or [KEY]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["_t", "_x"], ignore_index=True)
        up, low, way, pre, post = walk(pdf["_x"].to_numpy(), *(float(pdf[c][0]) for c in ("_target", "_slack", "_limit")))
        name = np.where(way > 0, "increase", np.where(way < 0, "decrease", None))
        out = {"index": np.arange(len(pdf)), time: pdf["_t"], "value": pdf["_x"], "upper": up, "lower": low, "change": way != 0, "direction": name, "pre_mean": pre, "post_mean": post}
        return pd.DataFrame({**{k: pdf[k] for k in keys}, **out}).astype({"direction": object})

    types = dict(rows.dtypes)
    schema = ", ".join([f"`{k}` {types[k]}" for k in keys] + ["index long", f"`{time}` {types['_t']}", "value double, upper double, lower double, change boolean, direction string, pre_mean double, post_mean double"])
    out = rows.groupBy(*group).applyInPandas(run, schema)
    return out.withColumns({c: F.when(F.col("change"), F.col(c)) for c in ("direction", "pre_mean", "post_mean")})


def change_points(detected: DataFrame) -> DataFrame:
    """The alarms, with the sum that raised each."""
    return detected.where("change").withColumn("cusum_value", F.greatest("upper", "lower")).drop("change")


def detect_changes(df: DataFrame, time: str, value: str, k_factor: float = 0.5, h_factor: float = 4.0, baseline_fraction: float = 0.3) -> DataFrame:
    """Fits on the first part of a series and runs on the rest, indexes from 0. An error if the first part has under five values."""
    rows = df.where(F.col(value).isNotNull()).select(F.col(time), F.col(value))
    n = rows.count()
    first = int(n * baseline_fraction)
    if first < 5:
        raise ValueError("not enough data for a baseline")
    placed = rows.withColumn("_at", F.row_number().over(Window.orderBy(time, value)))
    return detect(placed.where(F.col("_at") > first).drop("_at"), fit(placed.where(F.col("_at") <= first), value, k_factor, h_factor), time, value)


def no_reset(df: DataFrame, model: DataFrame, time: str, value: str) -> DataFrame:
    """Adds upper and lower sums without reset: a prefix sum minus its running minimum, in windows alone."""
    w = Window.orderBy(time).rowsBetween(Window.unboundedPreceding, 0)
    rows = df.where(F.col(value).isNotNull()).join(F.broadcast(model))
    sums = rows.withColumns({"_p": F.sum(F.col(value) - F.col("target") - F.col("slack")).over(w), "_q": F.sum(F.col("target") - F.col(value) - F.col("slack")).over(w)})
    return sums.withColumns({"upper": F.col("_p") - F.least(F.lit(0.0), F.min("_p").over(w)), "lower": F.col("_q") - F.least(F.lit(0.0), F.min("_q").over(w))}).drop("_p", "_q", "std")


def peaks(detected: DataFrame) -> DataFrame:
    return detected.agg(F.max("upper").alias("max_upper"), F.max("lower").alias("max_lower"), F.count_if("change").alias("changes"))
