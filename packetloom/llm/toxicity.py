"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum w_i + sum_{i<j} <v_i, v_j>) over the distinct hashed terms of a text: words, and prefixes of words, which carry
inflected and compound forms. The pairwise part learns what additive weights miss, such as an insult with the mention of a group.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BITS = 18
PREFIXES = (4, 5)
FOLDS = 3
TABLE = bytes(32 if k < 128 and not chr(k).isalnum() else k for k in range(256))


class Terms(dict):
    """Packed hashed terms of a word, held for words seen lately."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        keys = [word] + [f"{n}^{word[:n]}" for n in PREFIXES if len(word) > n]
        got = self[word] = b"".join([(zlib.crc32(k.encode()) >> (32 - BITS)).to_bytes(4, "little") for k in keys])
        return got

    def of(self, text: str) -> np.ndarray:
        """The distinct hashed terms of a text, ascending."""
        words = set(text.lower().encode().translate(TABLE).decode().split())
        return np.unique(np.frombuffer(b"".join([self[w] for w in words]), "<i4"))


@dataclass
class Machine:
    bias: float
    w: np.ndarray  # 2^BITS
    v: np.ndarray  # 2^BITS x rank

    def __post_init__(self) -> None:
        self.used = (self.w != 0) | (self.v != 0).any(axis=1)

    def score(self, terms: np.ndarray) -> float:
        t = terms[self.used[terms]]
        v = self.v[t]
        z = self.bias + float(self.w[t].sum()) + 0.5 * float((v.sum(axis=0) ** 2 - (v**2).sum(axis=0)).sum())
        return 1 / (1 + np.exp(-min(max(z, -35.0), 35.0)))


def train(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, rank: int = 4, epochs: int = 12, joint: int = 8, steps: int = 200, rate: float = 0.1, l1: float = 2e-3, l2: float = 1e-2, least: int = 2, batch: int = 64, seed: int = 0) -> Machine:
    """AdaGrad on the weighted logistic loss with an l1 step on w, so terms of no use end at zero.

    The first epochs learn w alone; terms whose w is then nonzero get factors, learnt with w in the joint epochs under an l2 penalty.
    Few rows take more epochs: `steps` batches at least, and half as many joint ones. Only terms in at least `least` of the rows get
    weights. With rows of one class or none, the machine is constant.
    """
    size = 1 << BITS
    w, v = np.zeros(size, np.float32), np.zeros((size, rank), np.float32)
    total, positive = float(weights.sum()), float(weights[labels == 1].sum())
    bias = float(np.log((positive + 0.5) / (total - positive + 0.5)))
    if not 0 < positive < total:
        return Machine(bias, w, v)
    rng = np.random.default_rng(seed)
    names = np.flatnonzero(np.bincount(np.concatenate(rows), minlength=size) >= least)
    code = np.full(size, -1)
    code[names] = np.arange(len(names))
    rows = [c[c >= 0] for c in (code[r] for r in rows)]
    a, b, paired = np.zeros(len(names)), np.zeros((len(names), rank)), np.zeros(len(names), bool)
    ga, gb, g0 = np.full(len(names), 1e-6), np.full(len(names), 1e-6), 1e-6
    weights = weights / weights.mean()
    turns = -(-len(rows) // batch)
    epochs, joint = max(epochs, -(-steps // turns)), max(joint, -(-steps // (2 * turns)))
    for epoch in range(epochs + joint):
        if epoch == epochs:
            paired = a != 0
            b[paired] = rng.normal(0, 0.05, (int(paired.sum()), rank))
        order = rng.permutation(len(rows))
        for k in range(0, len(order), batch):
            part = order[k : k + batch]
            term, owner = np.concatenate([rows[i] for i in part]), np.repeat(np.arange(len(part)), [len(rows[i]) for i in part])
            z = bias + np.bincount(owner, a[term], len(part))
            if epoch >= epochs:
                both = paired[term]
                term2, owner2 = term[both], owner[both]
                factors = b[term2]
                sums = np.stack([np.bincount(owner2, factors[:, r], len(part)) for r in range(rank)], axis=1)
                z += 0.5 * ((sums**2).sum(axis=1) - np.bincount(owner2, (factors**2).sum(axis=1), len(part)))
            err = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - labels[part]) * weights[part] / len(part)
            used = np.flatnonzero(np.bincount(term, minlength=len(names)))
            grad = np.bincount(term, err[owner], len(names))[used]
            ga[used] += grad**2
            step = rate / np.sqrt(ga[used])
            moved = a[used] - step * grad
            a[used] = np.sign(moved) * np.maximum(0, np.abs(moved) - step * l1)
            if epoch >= epochs and len(term2):
                each = err[owner2, None] * (sums[owner2] - factors)
                used = np.unique(term2)
                grad2 = np.stack([np.bincount(term2, each[:, r], len(names)) for r in range(rank)], axis=1)[used]
                gb[used] += (grad2**2).sum(axis=1)
                b[used] -= (rate / 2 / np.sqrt(gb[used]))[:, None] * (grad2 + l2 * b[used])
            g0 += err.sum() ** 2
            bias -= rate / 4 * err.sum() / np.sqrt(g0)
    w[names], v[names] = a, b
    return Machine(float(bias), w, v)


def trained_part(fold: int, rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray) -> tuple[Machine, np.ndarray]:
    """The machine of the rows outside a fold (every FOLDS-th row; FOLDS itself: of all rows) and its log-odds of those inside."""
    inside = np.arange(len(rows)) % FOLDS == fold
    machine = train([r for r, h in zip(rows, inside, strict=True) if not h], labels[~inside], weights[~inside])
    p = np.clip([machine.score(r) for r, h in zip(rows, inside, strict=True) if h], 1e-15, 1 - 1e-15)
    return machine, np.log(p / (1 - p))


def calibrate(machine: Machine, odds: np.ndarray, labels: np.ndarray, weights: np.ndarray) -> Machine:
    """The machine with its log-odds put through the line that fits the folds' log-odds of rows they were not trained on (Platt), as
    shrinkage makes them too small."""
    if not 0 < labels.sum() < len(labels):
        return machine
    z = np.column_stack([odds, np.ones(len(odds))])
    n1, n0 = labels.sum(), (labels == 0).sum()
    aim = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's targets
    line = np.array([1.0, 0.0])
    for _ in range(100):
        q = 1 / (1 + np.exp(-np.clip(z @ line, -35, 35)))
        curve = (z * (weights * q * (1 - q))[:, None]).T @ z + 1e-6 * weights.sum() * np.eye(2)
        step = np.linalg.solve(curve, z.T @ (weights * (aim - q)))
        line = line + step * min(1.0, 2 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-6:
            break
    a = min(max(line[0], 0.05), 50.0)
    return Machine(float(a * machine.bias + line[1]), (a * machine.w).astype(np.float32), (np.sqrt(a) * machine.v).astype(np.float32))


def learn(rows: list[np.ndarray], labels: np.ndarray, weights: np.ndarray, spark: SparkSession | None = None) -> Machine:
    """A machine trained on all rows, calibrated by those of the folds. With a session, the trainings run as tasks, side by side."""
    if spark is None:
        machine, parts = trained_part(FOLDS, rows, labels, weights)[0], [trained_part(k, rows, labels, weights)[1] for k in range(FOLDS)]
    else:
        sent = spark.sparkContext.broadcast(([r.tobytes() for r in rows], labels, weights))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            held, y, by = sent.value
            out = []
            for k in batch.column(0).to_pylist():
                m, odds = trained_part(k, [np.frombuffer(r, "<i4") for r in held], y, by)
                at = np.flatnonzero(m.used) if k == FOLDS else np.zeros(0, np.int64)
                out.append((k, m.bias, at.tobytes(), m.w[at].tobytes(), m.v[at].tobytes(), odds.tobytes()))
            cols = list(zip(*out, strict=True))
            kinds = {"fold": pa.int64(), "bias": pa.float64(), "at": pa.binary(), "w": pa.binary(), "v": pa.binary(), "odds": pa.binary()}
            return common.batch_of(**{c: (x, t) for (c, t), x in zip(kinds.items(), cols, strict=True)})

        schema = "fold long, bias double, at binary, w binary, v binary, odds binary"
        got = sorted(common.map_batches(spark.range(0, FOLDS + 1, 1, FOLDS + 1), run, schema).collect(), key=lambda r: r.fold)
        sent.destroy()
        parts, last = [np.frombuffer(r.odds) for r in got[:FOLDS]], got[FOLDS]
        at, w = np.frombuffer(last["at"], np.int64), np.zeros(1 << BITS, np.float32)
        v = np.zeros((1 << BITS, len(last.v) // 4 // max(1, len(at)) or 1), np.float32)
        w[at], v[at] = np.frombuffer(last.w, np.float32), np.frombuffer(last.v, np.float32).reshape(len(at), v.shape[1])
        machine = Machine(last.bias, w, v)
    odds = np.zeros(len(rows))
    for k in range(FOLDS):
        odds[k::FOLDS] = parts[k]
    return calibrate(machine, odds, labels, weights)


def fit(docs: DataFrame, labels: DataFrame, train_limit: int, id_col: str, text_col: str, label_id_col: str = "doc_id", label_col: str = "toxic", term_limit: int = 4096) -> Machine:
    """A machine from train_limit labelled documents a class at most (those of smallest hash), each class weighted up to its full count.

    A document's training row holds its distinct terms, at most term_limit of them (those of smallest hash); of rows with one id one is
    taken. So what the driver gathers is bounded in rows and in bytes: 2 * train_limit * term_limit terms.
    """
    spark = docs.sparkSession
    usable = labels.select(F.col(label_id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y"))
    usable = usable.where("doc_id is not null and y in (0, 1) and pmod(crc32(cast(doc_id as string)), 3) <> 1").groupBy("doc_id").agg(F.max("y").alias("y"))
    counts = {r.y: r["count"] for r in usable.groupBy("y").count().collect()}
    picked = [usable.where(F.col("y") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_limit) for y in (0, 1)]
    sample = F.broadcast(picked[0].unionByName(picked[1]))  # 2 * train_limit narrow rows at most
    held = common.id_text(docs, id_col, text_col).join(sample, "doc_id").select("doc_id", "text", "y")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        terms = Terms()
        some = [t if len(t) <= term_limit else np.sort(t[np.argsort((t * np.uint32(0x9E3779B1)).astype(np.uint32))[:term_limit]]) for t in map(terms.of, common.texts(batch.column(1)))]
        return common.batch_of(doc_id=(batch.column(0), pa.int64()), y=(batch.column(2), pa.int32()), terms=([t.tobytes() for t in some], pa.binary()))

    one = common.map_batches(held, run, "doc_id long, y int, terms binary").groupBy("doc_id").agg(F.max("y").alias("y"), F.min("terms").alias("terms"))
    got = sorted(one.collect(), key=lambda r: r.doc_id)
    y = np.array([r.y for r in got])
    share = {k: counts.get(k, 0) / max(1, int((y == k).sum())) for k in (0, 1)}
    return learn([np.frombuffer(r.terms, "<i4") for r in got], y, np.array([share[k] for k in y.tolist()], float), spark)


def scorer(spark: SparkSession, machine: Machine) -> Callable[[list[str]], list[float]]:
    """texts -> scores, for use in tasks; the machine (2^BITS rows, a fixed size) is broadcast."""
    sent, terms = spark.sparkContext.broadcast((machine.bias, machine.w, machine.v)), []

    def scores(xs: list[str]) -> list[float]:
        if not terms:
            terms.extend([Terms(), Machine(*sent.value)])
        return [terms[1].score(terms[0].of(x)) for x in xs]

    return scores


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_limit: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted), one row per input row, from one map-only pass over whole texts.

    Labels of rows with crc32(doc_id as text) mod 3 = 1 are never learned from; where a document has several labels the largest counts.
    Scores read the text alone. Null and empty texts get the bias's score. A null id is not held out. Repeated rows each return. An empty
    table returns no row; with no label the score is 0.5, with labels of one class that class's prior. Extra columns are ignored. Very long
    texts are read whole.
    """
    scores = scorer(docs.sparkSession, fit(docs, labels, train_limit, id_col, text_col))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = scores(common.texts(batch.column(1)))
        out = [i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in batch.column(0).to_pylist()]
        return common.batch_of(doc_id=(batch.column(0), pa.int64()), held_out=(out, pa.bool_()), score=(got, pa.float64()), predicted=([int(x >= threshold) for x in got], pa.int32()))

    return common.map_batches(common.id_text(docs, id_col, text_col), run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, train_limit: int = 8000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns kept, that score under the threshold; as toxicity() in all else."""
    scores = scorer(docs.sparkSession, fit(docs, labels, train_limit, id_col, text_col))
    return common.change_rows(docs, text_col, lambda xs: [x if s < threshold else None for x, s in zip(xs, scores(xs), strict=True)])


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))
