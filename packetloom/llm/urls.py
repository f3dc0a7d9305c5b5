"""URL filter: host and path rules, and for the rest a character language-model ratio.

Two variable-order Markov models with Witten-Bell smoothing, one for accepted and one for rejected URLs, give a log-likelihood
difference per character; a threshold calibrated on held-back labelled URLs decides.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: (verdict, host, path).
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
END = "\n"


def host_of(url: Column) -> Column:
    """After the first :// up to /, ?, # or the end, A-Z lower-cased; else empty."""
    return F.translate(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits a host (or a parent of it) and a path's start, as (rule, verdict); null if none does."""
    rule = verdict = F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


class Markov:
    """Counts of contexts up to an order; probabilities blend from order 0 upwards by Witten-Bell weights, over 2^16 symbols at the root."""

    def __init__(self, texts: list[str], order: int):
        self.order, self.next = order, defaultdict(Counter)
        for text in texts:
            line = text + END
            for k, c in enumerate(line):
                for n in range(min(order, k) + 1):
                    self.next[line[k - n : k]][c] += 1
        self.sums = {h: (sum(c.values()), len(c)) for h, c in self.next.items()}

    def log_p(self, context: str, c: str) -> float:
        p = 1 / 65536
        for n in range(len(context) + 1):
            h = context[len(context) - n :]
            if h not in self.sums:
                break
            total, kinds = self.sums[h]
            p = (self.next[h][c] + kinds * p) / (total + kinds) if c in self.next[h] else kinds * p / (total + kinds)
        return math.log(p)


@dataclass
class RatioModel:
    accepted: Markov
    rejected: Markov
    threshold: float = 0.0
    seen: dict[tuple[str, str], float] = field(default_factory=dict)

    def score(self, text: str) -> float:
        """Mean log-likelihood difference for each character (the end counts as one)."""
        line, total, order = text + END, 0.0, self.accepted.order
        for k, c in enumerate(line):
            at = (line[max(0, k - order) : k], c)
            if (d := self.seen.get(at)) is None:
                if len(self.seen) > 500_000:
                    self.seen.clear()
                d = self.seen[at] = self.accepted.log_p(*at) - self.rejected.log_p(*at)
            total += d
        return total / len(line)


def fit(accepted: list[str], rejected: list[str], order: int = 4) -> RatioModel:
    """Models from three quarters of each list; the threshold from the rest: the midpoint between scores that errs least."""
    hold = [(x, y) for xs, y in ((accepted, 1), (rejected, 0)) for x in xs[::4]]
    part = lambda xs: [x for k, x in enumerate(xs) if k % 4]
    model = RatioModel(Markov(part(accepted), order), Markov(part(rejected), order))
    if accepted and rejected:
        scored = sorted((model.score(x), y) for x, y in hold)
        wrong = sum(y == 0 for _, y in scored)
        cuts = [(wrong, abs(scored[0][0]), scored[0][0] - 1e-9)]
        for k, (s, y) in enumerate(scored):
            wrong += 1 if y else -1
            after = scored[k + 1][0] if k + 1 < len(scored) else s + 1e-9
            cuts.append((wrong, abs((s + after) / 2), (s + after) / 2))
        model.threshold = min(cuts)[2]
    return model


def judge(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules: list[tuple[str, str, str]] = RULES, train_limit: int = 20_000, most_chars: int = 2048, order: int = 4) -> DataFrame:
    """(page_id, host, path, rule, verdict, score), one row per input row.

    A rule's verdict stands; else the ratio model's: allow if the score of the whole url reaches the threshold. The models learn from
    URLs that rules judge, train_limit distinct ones a class at most (those of smallest hash) of most_chars characters at most, so the
    model sent to the executors has a fixed bound; URLs of any length are scored. Null urls and those without :// have empty host and
    path and no rule and go by their score (a null's is that of the empty text). With a class unseen the threshold is 0. Repeated rows
    each return; an empty table returns no row. Extra columns are ignored.
    """
    url = F.col("url")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).select("page_id", host_of(url).alias("host"), path_of(url).alias("path"), F.coalesce(url, F.lit("")).alias("url"))
    rule, verdict = rule_of(F.col("host"), F.col("path"), rules)
    ruled = rows.withColumns({"rule": rule, "ruled": verdict})
    known = ruled.where(F.col("ruled").isNotNull() & (F.length("url") <= most_chars)).select("url", "ruled").distinct()
    sample = {kind: [r[0] for r in known.where(F.col("ruled") == kind).orderBy(F.xxhash64("url"), "url").limit(train_limit).select("url").collect()] for kind in ("allow", "block")}
    model = fit(sample["allow"], sample["block"], order)
    sent = pages.sparkSession.sparkContext.broadcast((model.accepted.next, model.rejected.next, model.threshold))
    cached: list[RatioModel] = []

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        if not cached:
            halves = []
            for counts in sent.value[:2]:
                half = Markov([], order)
                half.next, half.sums = counts, {h: (sum(c.values()), len(c)) for h, c in counts.items()}
                halves.append(half)
            cached.append(RatioModel(*halves, threshold=sent.value[2]))
        m, host, path, url, ruled = cached[0], *(batch.column(k).to_pylist() for k in (1, 2, 3, 5))
        score = list(map(m.score, url))
        verdict = [r or ("allow" if s >= m.threshold else "block") for r, s in zip(ruled, score, strict=True)]
        return common.batch_of(page_id=(batch.column(0), pa.int64()), host=(host, pa.string()), path=(path, pa.string()), rule=(batch.column(4), pa.string()), verdict=(verdict, pa.string()), score=(score, pa.float64()))

    return common.map_batches(ruled, run, "page_id long, host string, path string, rule string, verdict string, score double")


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"))
