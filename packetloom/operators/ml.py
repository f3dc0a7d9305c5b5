"""Supervised classification of connections: features, support-vector machines with kernels by feature maps, evaluation, search."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import product
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark import inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import PolynomialExpansion, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.stats import ratio
from .eda import failed, nxdomain

FEATURES = ("duration", "bytes_sent", "bytes_recv", "bytes_ratio", "failed", "ti_match", "nxdomain")


def features(conn: DataFrame, dns: DataFrame | None = None) -> DataFrame:
    """(uid, seven features, label) of each connection; label is whether any of the three indicators is set. Nulls become zeros."""
    rows = conn
    if dns is not None:
        seen = dns.groupBy(F.col("uid").alias("_uid")).agg(F.bool_or(nxdomain()).alias("_nx"))
        rows = rows.join(seen, F.col("uid") == F.col("_uid"), "left")
    zero = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    sent, recv = zero("bytes_sent"), zero("bytes_recv")
    out = rows.select(
        "uid", zero("duration_sec").alias("duration"), sent.alias("bytes_sent"), recv.alias("bytes_recv"), ratio(sent, recv, 0.0).alias("bytes_ratio"),
        flag(failed()).alias("failed"), flag(F.col("ti_match") if "ti_match" in rows.columns else F.lit(False)).alias("ti_match"), flag(F.col("_nx") if dns is not None else F.lit(False)).alias("nxdomain"),
    )
    return out.withColumn("label", F.greatest("failed", "ti_match", "nxdomain"))


def fold_of(key: Column, folds: int, seed: int = 42) -> Column:
    """A reproducible fold number from a row's key: no sampling state, the same on a retried task."""
    return F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(folds)).cast("int")


def split(df: DataFrame, test: float = 0.3, key: str = "uid", label: str = "label", seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Train and test rows by a hash of the key; each class is cut at the same share in expectation."""
    u = F.pmod(F.xxhash64(F.col(key), F.col(label), F.lit(seed)), F.lit(1_000_000)) / 1_000_000
    return df.where(u >= test), df.where(u < test)


@dataclass
class SVM:
    """A scaled support-vector machine with probabilities from a logistic fit of its margin.

    kernel "linear" is exact; "rbf" uses random Fourier features and "poly" a polynomial expansion, so those match a kernel machine in
    metrics, not bit by bit. class_weight "balanced" weighs classes to equal sums.
    """

    kernel: str = "rbf"
    C: float = 1.0
    gamma: float | str = "scale"
    degree: int = 3
    class_weight: str | None = "balanced"
    components: int = 200
    max_iter: int = 100
    seed: int = 42
    inputs: Sequence[str] = FEATURES
    label: str = "label"
    model: PipelineModel | None = None
    platt: object = None

    def _map(self, df: DataFrame) -> DataFrame:
        if self.kernel != "rbf":
            return df.withColumnRenamed("scaled", "mapped") if self.kernel == "linear" else PolynomialExpansion(degree=self.degree, inputCol="scaled", outputCol="mapped").transform(df)
        from pyspark.ml.functions import array_to_vector

        d = len(self.inputs)
        gamma = 1.0 / d if self.gamma in ("scale", "auto") else float(self.gamma)  # the inputs have unit variance
        rng = np.random.default_rng(self.seed)
        w, b = rng.normal(0, math.sqrt(2 * gamma), (self.components, d)), rng.uniform(0, 2 * math.pi, self.components)
        x, norm = F.col("_x"), math.sqrt(2.0 / self.components)
        rows = F.array(*[F.struct(F.array(*[F.lit(float(v)) for v in w[k]]).alias("w"), F.lit(float(b[k])).alias("b")) for k in range(self.components)])
        dot = lambda r: F.aggregate(F.zip_with(r["w"], x, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
        return df.withColumn("_x", vector_to_array("scaled")).withColumn("mapped", array_to_vector(F.transform(rows, lambda r: F.cos(dot(r) + r["b"]) * norm))).drop("_x")

    def _prepared(self, df: DataFrame) -> DataFrame:
        clean = [F.when(F.isnan(F.col(c).cast("double")) | F.col(c).isNull(), 0.0).otherwise(F.col(c).cast("double")).alias(c) for c in self.inputs]
        return df.select([c for c in df.columns if c not in self.inputs] + clean)

    def fit(self, df: DataFrame) -> SVM:
        rows = self._prepared(df).withColumn(self.label, F.col(self.label).cast("double"))
        scale = Pipeline(stages=[VectorAssembler(inputCols=list(self.inputs), outputCol="_raw"), StandardScaler(withMean=True, withStd=True, inputCol="_raw", outputCol="scaled")])
        self.model = scale.fit(rows)
        counts = {r[0]: r[1] for r in rows.groupBy(self.label).count().collect()}
        n = sum(counts.values())
        weight = F.lit(1.0)
        if self.class_weight == "balanced":
            for y, c in counts.items():
                weight = F.when(F.col(self.label) == y, n / (len(counts) * c)).otherwise(weight)
        mapped = self._map(self.model.transform(rows)).select("mapped", self.label, weight.alias("_w"))
        self.only = next(iter(counts)) if len(counts) == 1 else None
        if self.only is None:
            self.svc = LinearSVC(featuresCol="mapped", labelCol=self.label, weightCol="_w", regParam=1.0 / (self.C * max(1, n)), maxIter=self.max_iter, rawPredictionCol="_margin", predictionCol="prediction").fit(mapped)
            scored = self.svc.transform(mapped).select("_margin", self.label)
            margin = VectorAssembler(inputCols=["m"], outputCol="mv").transform(scored.select(vector_to_array("_margin")[1].alias("m"), self.label))
            self.platt = LogisticRegression(featuresCol="mv", labelCol=self.label, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_q", maxIter=50).fit(margin)
        return self

    def predict(self, df: DataFrame) -> DataFrame:
        """Adds prediction (0 or 1), margin and probability of class 1."""
        if self.model is None:
            raise ValueError("not fitted")
        rows = self._prepared(df)
        if self.only is not None:
            return rows.withColumns({"prediction": F.lit(int(self.only)), "margin": F.lit(float("nan")), "probability": F.lit(float(self.only))})
        out = self.svc.transform(self._map(self.model.transform(rows))).withColumn("margin", vector_to_array("_margin")[1])
        a, b = float(self.platt.coefficients[0]), float(self.platt.intercept)
        drop = ["_raw", "scaled", "mapped", "_margin"]
        return out.withColumns({"probability": 1 / (1 + F.exp(-(F.col("margin") * a + b))), "prediction": F.col("prediction").cast("int")}).drop(*drop)


def evaluate(predicted: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """(n, tp, fp, fn, tn, accuracy, precision, recall, f1), undefined ratios 0, in one aggregation."""
    y, p = F.col(label) == 1, F.col(prediction) == 1
    c = predicted.agg(F.count("*").alias("n"), F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    c = c.withColumns({"accuracy": ratio(tp + F.col("tn"), F.col("n"), 0.0), "precision": ratio(tp, tp + fp, 0.0), "recall": ratio(tp, tp + fn, 0.0)})
    return c.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"), 0.0))


def cross_validate(df: DataFrame, folds: int = 5, key: str = "uid", **params: object) -> dict[str, dict[str, float]]:
    """Mean and deviation of four metrics over folds; scaling is fitted inside each fold, on its training rows alone."""
    marked = df.withColumn("_fold", fold_of(F.col(key), folds))
    if keep := not df.is_cached:
        marked.persist()
    found = []
    for k in range(folds):
        train, test = marked.where(F.col("_fold") != k).drop("_fold"), marked.where(F.col("_fold") == k).drop("_fold")
        found.append(evaluate(SVM(**params).fit(train).predict(test)).first())
    if keep:
        marked.unpersist()
    return {m: {"mean": float(np.mean([r[m] for r in found])), "std": float(np.std([r[m] for r in found]))} for m in ("accuracy", "precision", "recall", "f1")}


def grid_search(df: DataFrame, grid: dict[str, Sequence] | None = None, folds: int = 5, key: str = "uid", parallelism: int = 4) -> dict:
    """The parameters of best mean f1 by cross-validation, and all results. Up to `parallelism` fits share the cluster at a time."""
    grid = grid or {"C": (0.1, 1.0, 10.0), "gamma": ("scale", 0.1), "kernel": ("rbf", "linear")}
    every = [dict(zip(grid, values, strict=True)) for values in product(*grid.values())]
    df = df.persist()
    with ThreadPool(parallelism) as pool:
        found = pool.map(inheritable_thread_target(df.sparkSession)(lambda params: cross_validate(df, folds, key, **params)), every)
    df.unpersist()
    results = [{"params": params, **scores} for params, scores in zip(every, found, strict=True)]
    best = max(results, key=lambda r: r["f1"]["mean"])
    return {"best_params": best["params"], "best_f1": best["f1"]["mean"], "results": results}


def classification_report(predicted: DataFrame) -> str:
    m = evaluate(predicted).first()
    other = {"precision": m.tn / (m.tn + m.fn) if m.tn + m.fn else 0.0, "recall": m.tn / (m.tn + m.fp) if m.tn + m.fp else 0.0}
    other["f1"] = 2 * other["precision"] * other["recall"] / (other["precision"] + other["recall"]) if other["precision"] + other["recall"] else 0.0
    row = "{:<10}{:>10.4f}{:>10.4f}{:>10.4f}{:>10d}".format
    return "\n".join([f"{'':<10}{'precision':>10}{'recall':>10}{'f1':>10}{'support':>10}", row("normal", other["precision"], other["recall"], other["f1"], m.tn + m.fp), row("anomaly", m.precision, m.recall, m.f1, m.tp + m.fn), f"accuracy {m.accuracy:.4f} of {m.n}"])
