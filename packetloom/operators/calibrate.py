"""Decision thresholds: metrics over a grid, curves, constrained optimum, alert volumes and workload.

Scored rows are reduced to counts for each grid step first, so the grid is evaluated in one aggregation and a window over its points.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.stats import ratio

LOW, HIGH = 0.01, 0.99
RECALL_TARGETS = (0.99, 0.95, 0.90, 0.85, 0.80)


def grid(df: DataFrame, n: int) -> DataFrame:
    return df.sparkSession.range(n).select(F.col("id").cast("int").alias("k"), threshold_at(F.col("id"), n).alias("threshold"))


def threshold_at(k: Column, n: int) -> Column:
    return F.when(k == n - 1, HIGH).otherwise(F.lit(LOW) + k * ((HIGH - LOW) / (n - 1)))


def evaluate(scored: DataFrame, label: str = "label", score: str = "score", n: int = 100) -> DataFrame:
    """(threshold, tp, fp, fn, tn, precision, recall, f1, fpr, alert_rate) at n thresholds from 0.01 to 0.99; undefined ratios are 0."""
    s = F.col(score).cast("double")
    guess = F.least(F.greatest(F.floor((s - LOW) / ((HIGH - LOW) / (n - 1))), F.lit(-1)), F.lit(n - 1)).cast("int")
    # The last step at or under the score; the guess may be a step off by rounding, so its neighbours are compared exactly.
    step = F.when((guess < n - 1) & (s >= threshold_at(guess + 1, n)), guess + 1).when((guess >= 0) & (s < threshold_at(guess, n)), guess - 1).otherwise(guess)
    rows = scored.where(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull())
    by_step = rows.groupBy(step.alias("k")).agg(F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg"))
    points = grid(scored, n).join(by_step, "k", "full").fillna(0, ["pos", "neg"])
    down, every = Window.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy()
    c = points.select("threshold", F.sum("pos").over(down).alias("tp"), F.sum("neg").over(down).alias("fp"), F.sum("pos").over(every).alias("all_pos"), F.sum("neg").over(every).alias("all_neg")).where("threshold is not null")
    c = c.select("threshold", "tp", "fp", (F.col("all_pos") - F.col("tp")).alias("fn"), (F.col("all_neg") - F.col("fp")).alias("tn"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    c = c.withColumns({"precision": ratio(tp, tp + fp, 0.0), "recall": ratio(tp, tp + fn, 0.0), "fpr": ratio(fp, fp + tn, 0.0), "alert_rate": ratio(tp + fp, tp + fp + fn + tn, 0.0)})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def counts_by_score(scored: DataFrame, label: str, score: str, slices: int) -> DataFrame:
    """(s, p, n, p_below, n_below, p_all, n_all): positives and negatives at each distinct score, below it and in all.

    Running sums are distributed: scores fall into equal slices of their range, slices are summed (at most `slices` rows), and a window
    runs within each slice alone.
    """
    by = scored.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(F.col(score).cast("double").alias("s")).agg(F.count_if(F.col(label) == 1).alias("p"), F.count_if(F.col(label) == 0).alias("n"))
    ends = by.agg(F.min("s").alias("a"), (F.max("s") - F.min("s")).alias("w"))
    cell = F.when(F.col("w") > 0, F.least(F.floor((F.col("s") - F.col("a")) / F.when(F.col("w") > 0, F.col("w")).otherwise(1.0) * slices), F.lit(slices - 1))).otherwise(0)
    rows = by.join(F.broadcast(ends)).withColumn("cell", cell.cast("int")).drop("a", "w")  # ends is one row
    ahead, every = Window.orderBy("cell").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = rows.groupBy("cell").agg(F.sum("p").alias("cp"), F.sum("n").alias("cn"))
    before = sums.select("cell", *[f for c in "pn" for f in (F.coalesce(F.sum(f"c{c}").over(ahead), F.lit(0)).alias(f"{c}_before"), F.sum(f"c{c}").over(every).alias(f"{c}_all"))])
    within = Window.partitionBy("cell").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    inside = rows.withColumns({f"{c}_inside": F.coalesce(F.sum(c).over(within), F.lit(0)) for c in "pn"}).join(F.broadcast(before), "cell")
    return inside.select("s", "p", "n", *[(F.col(f"{c}_before") + F.col(f"{c}_inside")).alias(f"{c}_below") for c in "pn"], "p_all", "n_all")


def curve(scored: DataFrame, label: str = "label", score: str = "score", slices: int = 4096) -> DataFrame:
    """(threshold, tp, fp, tpr, fpr, precision) at every distinct score: the points of both curves."""
    c = counts_by_score(scored, label, score, slices).select(F.col("s").alias("threshold"), (F.col("p_all") - F.col("p_below")).alias("tp"), (F.col("n_all") - F.col("n_below")).alias("fp"), "p_all", "n_all")
    return c.select("threshold", "tp", "fp", ratio(F.col("tp"), F.col("p_all")).alias("tpr"), ratio(F.col("fp"), F.col("n_all")).alias("fpr"), ratio(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"))


def roc_auc(scored: DataFrame, label: str = "label", score: str = "score", slices: int = 4096) -> DataFrame:
    """(positives, negatives, roc_auc), exact: ties count half."""
    agg = counts_by_score(scored, label, score, slices).agg(F.sum("p").alias("positives"), F.sum("n").alias("negatives"), F.sum(F.col("p") * (F.col("n_below") + F.col("n") / 2.0)).alias("w"))
    return agg.select("positives", "negatives", ratio(F.col("w"), F.col("positives") * F.col("negatives").cast("double")).alias("roc_auc"))


def optimum(points: DataFrame, least_recall: float | None = None, most_fpr: float | None = None, most_alerts: float | None = None, maximize: str = "f1") -> DataFrame:
    """The grid point of largest metric under the constraints (ties: lowest threshold); if none meets them, that of largest f1."""
    metric = maximize if maximize in ("f1", "precision", "recall") else "f1"
    ok = F.lit(True)
    for name, bound, above in (("recall", least_recall, True), ("fpr", most_fpr, False), ("alert_rate", most_alerts, False)):
        if bound is not None:
            ok = ok & ((F.col(name) >= bound) if above else (F.col(name) <= bound))
    return points.withColumn("_ok", ok).orderBy(F.desc("_ok"), F.desc(F.when(F.col("_ok"), F.col(metric)).otherwise(F.col("f1"))), "threshold").limit(1).drop("_ok")


def nearest(points: DataFrame, threshold: Column | float, exact: bool = True) -> DataFrame:
    """The grid point for a threshold: the nearest, or (exact=False) the first closer than 0.01, often the one before; none if none is."""
    gap = F.abs(F.col("threshold") - threshold)
    return points.orderBy(gap, "threshold").limit(1) if exact else points.where(gap < 0.01).orderBy("threshold").limit(1)


def daily_alerts(points: DataFrame, threshold: float, daily_events: int, exact: bool = True) -> DataFrame:
    """Alerts a day at a threshold: total and true positives truncated to whole numbers."""
    total = F.floor(F.lit(daily_events) * F.col("alert_rate"))
    out = nearest(points, threshold, exact).withColumn("expected_total_alerts", total).withColumn("expected_true_positives", F.floor(F.col("expected_total_alerts") * F.col("precision")))
    return out.select("threshold", F.lit(daily_events).cast("long").alias("daily_events"), "expected_total_alerts", "expected_true_positives", (F.col("expected_total_alerts") - F.col("expected_true_positives")).alias("expected_false_positives"), "precision", "recall")


def workload(points: DataFrame, daily_events: int, capacity: int = 50, targets: tuple[float, ...] = RECALL_TARGETS, exact: bool = True) -> DataFrame:
    """One row for each recall target: its best threshold, alerts a day and analysts needed (alerts // capacity + 1).

    With exact=False the volumes are those of the first grid point within 0.01, as a look-up by tolerance gives.
    """
    spark = points.sparkSession
    wanted = spark.createDataFrame([(float(t),) for t in targets], "target_recall double")
    pairs = points.join(F.broadcast(wanted))  # the grid by a handful of targets
    rank = F.row_number().over(Window.partitionBy("target_recall").orderBy(F.desc(F.col("recall") >= F.col("target_recall")), F.desc("f1"), "threshold"))
    best = pairs.withColumn("_r", rank).where("_r = 1").select("target_recall", F.col("threshold").alias("chosen"))
    if exact:
        met = best.join(points, F.col("chosen") == F.col("threshold"))
    else:
        near = best.join(F.broadcast(points), F.abs(F.col("threshold") - F.col("chosen")) < 0.01)
        met = near.withColumn("_r", F.row_number().over(Window.partitionBy("target_recall").orderBy("threshold"))).where("_r = 1")
    met = met.withColumn("expected_daily_alerts", F.floor(F.lit(daily_events) * F.col("alert_rate"))).withColumn("expected_true_positives", F.floor(F.col("expected_daily_alerts") * F.col("precision")))
    shown = F.col("chosen") if exact else F.col("threshold")
    return met.select("target_recall", shown.alias("threshold"), "expected_daily_alerts", "expected_true_positives", (F.col("expected_daily_alerts") - F.col("expected_true_positives")).alias("expected_false_positives"), "precision", F.greatest(F.lit(1), F.floor(F.col("expected_daily_alerts") / capacity) + 1).cast("long").alias("analysts_needed"))
