"""Secret scan: exact base patterns, and grammar inference for what they miss.

Prefix trees of labelled credentials (values the base patterns found) have their statistically compatible states merged (Hoeffding
bound) into probabilistic automata, one for each kind; every other token that could be a credential is scored by the likelihood of its
format under them against the likelihood under an automaton of ordinary tokens.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

# The base patterns and the least length of what they must catch.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KINDS = ["assign", "access", "hex", "format"]
WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Tokens that may be credentials: as short as the shortest assigned value with a letter and a digit, else of 20 characters or more.
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_.=-])(?:(?=[0-9+/_.=-]*[A-Za-z])(?=[A-Za-z+/_.=-]*[0-9])[A-Za-z0-9+/_.=-]{8,}|[A-Za-z0-9+/_.=-]{20,})")
CLASSES = {"d": "0123456789", "h": "abcdef", "l": "ghijklmnopqrstuvwxyz", "u": "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
CLASS_OF = {c: (k, math.log2(len(v))) for k, v in CLASSES.items() for c in v}
PLAIN = "plain"


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind index, end, value) of the base patterns, leftmost and non-overlapping within each kind, by start, then kind."""
    found = []
    low = text.lower()
    if any(w in low for w in WORDS):
        found += [(m.start(), 0, m.end(), m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end(), m[0]) for m in ACCESS.finditer(text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), m[0]) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str, base: list[tuple[int, int, int, str]]) -> list[tuple[int, int, str]]:
    """(start, end, value) of the tokens that may be credentials and are not covered by base spans (sorted); one that goes beyond a base
    span is a candidate as a whole. Both lists are walked once."""
    found, k, reach = [], 0, -1  # reach: how far the base spans go that begin at the token's start or before
    for m in CANDIDATE.finditer(text):
        s, e = m.span()
        while k < len(base) and base[k][0] <= s:
            reach = max(reach, base[k][2])
            k += 1
        if e > reach:
            found.append((s, e, m[0]))
    return found


def symbols(value: str) -> list[tuple[str, float]]:
    """Each character's class, with the bits that tell the character within the class; other characters are their own class."""
    return [CLASS_OF.get(c, (c, 0.0)) for c in value]


class Automaton:
    """A probabilistic automaton inferred from strings by red-blue state merging."""

    def __init__(self, values: list[str], alpha: float = 0.05):
        self.count: list[int] = [0]
        self.stop: list[int] = [0]
        self.edge: list[dict[str, tuple[int, int]]] = [{}]  # symbol: (state, count)
        for value in values:
            at = 0
            self.count[0] += 1
            for s, _ in symbols(value):
                to, n = self.edge[at].get(s, (len(self.count), 0))
                if not n:
                    self.count.append(0)
                    self.stop.append(0)
                    self.edge.append({})
                self.edge[at][s] = (to, n + 1)
                self.count[to] += 1
                at = to
            self.stop[at] += 1
        self.bound = math.sqrt(0.5 * math.log(2 / alpha))
        self._merge_states()

    def _differ(self, a: int, na: int, b: int, nb: int) -> bool:
        return na > 0 and nb > 0 and abs(a / na - b / nb) > self.bound * (1 / math.sqrt(na) + 1 / math.sqrt(nb))

    def _compatible(self, red: int, blue: int) -> bool:
        todo, met = [(red, blue)], set()
        while todo:
            a, b = todo.pop()
            if a == b or (a, b) in met:
                continue
            met.add((a, b))
            na, nb = self.count[a], self.count[b]
            if self._differ(self.stop[a], na, self.stop[b], nb):
                return False
            for s in self.edge[a].keys() | self.edge[b].keys():
                (x, m), (y, n) = self.edge[a].get(s, (-1, 0)), self.edge[b].get(s, (-1, 0))
                if self._differ(m, na, n, nb):
                    return False
                if m and n:
                    todo.append((x, y))
        return True

    def _fold(self, into: int, tree: int) -> None:
        """Adds a subtree's counts to a state and its successors."""
        todo = [(into, tree)]
        while todo:
            a, b = todo.pop()
            self.count[a] += self.count[b]
            self.stop[a] += self.stop[b]
            for s, (y, n) in self.edge[b].items():
                if s in self.edge[a]:
                    x, m = self.edge[a][s]
                    self.edge[a][s] = (x, m + n)
                    todo.append((x, y))
                else:
                    self.edge[a][s] = (y, n)

    def _merge_states(self) -> None:
        red, kept = [0], {0}
        while True:
            blue = [(r, s, to) for r in red for s, (to, _) in sorted(self.edge[r].items()) if to not in kept]
            if not blue:
                break
            r, s, to = max(blue, key=lambda x: (self.count[x[2]], -x[2]))
            for state in red:
                if self._compatible(state, to):
                    self.edge[r][s] = (state, self.edge[r][s][1])
                    self._fold(state, to)
                    break
            else:
                red.append(to)
                kept.add(to)
        self.states = len(red)

    def bits(self, value: str) -> float:
        """Mean bits for each character; a step that the automaton lacks has a small share of its state's mass, and the state stays."""
        at, total = 0, 0.0
        for s, within in symbols(value):
            to, n = self.edge[at].get(s, (at, 0))
            total += within - math.log2((n + 0.01) / (self.count[at] + 1))
            at = to
        return total / max(1, len(value))


def grammars(labelled: list[tuple[str, str]]) -> dict[str, Automaton]:
    by = defaultdict(list)
    for kind, value in sorted(labelled):
        by[kind].append(value)
    return {k: Automaton(v) for k, v in by.items()}


class Scanner:
    """Base spans plus the candidates whose format the automata find likely."""

    def __init__(self, automata: dict[str, Automaton], most_bits: float, margin: float):
        self.known = {k: a for k, a in automata.items() if k != PLAIN}
        self.plain, self.most_bits, self.margin = automata.get(PLAIN), most_bits, margin

    def likely(self, value: str) -> bool:
        best = min((a.bits(value) for a in self.known.values()), default=math.inf)
        return best <= self.most_bits and (self.plain is None or self.plain.bits(value) - best >= self.margin)

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """(start, kind index, end), by start, then kind."""
        base = base_spans(text)
        return sorted([(s, k, e) for s, k, e, _ in base] + [(s, 3, e) for s, e, v in candidates(text, base) if self.likely(v)])


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, base, more, word) of (doc_id, text): base spans, candidates, and an ordinary word of texts that have base spans."""
    span = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value", pa.string())]))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        base, more, words = [], [], []
        for text in common.texts(batch.column(1)):
            b = base_spans(text)
            base.append([{"start": s, "kind": k, "end": e, "value": v} for s, k, e, v in b])
            more.append([{"start": s, "kind": 3, "end": e, "value": v} for s, e, v in candidates(text, b)])
            words.append(max((w for w in text.split() if w.isalpha()), key=len, default="") if b else "")
        return common.batch_of(doc_id=(batch.column(0), pa.int64()), base=(base, span), more=(more, span), word=(words, pa.string()))

    kind = "array<struct<start: long, kind: int, end: long, value: string>>"
    return common.map_batches(docs, run, f"doc_id long, base {kind}, more {kind}, word string")


def learn(seen: DataFrame, train_limit: int, value_limit: int) -> dict[str, Automaton]:
    """Automata of the base values of a scan, and one of ordinary words, from train_limit distinct values each (those of smallest hash)
    of value_limit characters at most; longer values are no part of the sample, and none is cut."""
    values = seen.select(F.explode("base").alias("x")).select(F.col("x.kind").cast("string").alias("kind"), "x.value")
    values = values.unionByName(seen.where("word <> ''").select(F.lit(PLAIN).alias("kind"), F.col("word").alias("value"))).where(F.length("value") <= value_limit).distinct()
    labelled = []
    for k in ("0", "1", "2", PLAIN):
        labelled += [(k, r[0]) for r in values.where(F.col("kind") == k).orderBy(F.xxhash64("value"), "value").limit(train_limit).select("value").collect()]
    return grammars(labelled)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_limit: int = 400, value_limit: int = 512, most_bits: float = 5.5, margin: float = 0.75) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, spans array<struct<kind, start, end>>), one row per input row.

    One pass over whole texts finds base spans and candidates (tokens of 8 or more credential characters with a letter and a digit, or
    of 20 or more); the automata learn from train_limit distinct base values a kind (those of smallest hash, of value_limit characters at most;
    a documented bound) and as many ordinary words of the same texts; a second pass over the narrow rows scores every candidate, whole. A candidate becomes a span of kind "format" if its best automaton needs at most most_bits bits a
    character and at least margin fewer than that of ordinary words. Base spans always stay. Offsets are code points, ends exclusive.
    Null and empty texts have no span; very long ones are scanned whole. Repeated rows each return. An empty table returns no row; with no labelled value nothing is added.
    """
    seen = common.cut(scan(common.id_text(docs, id_col, text_col)))
    sent = docs.sparkSession.sparkContext.broadcast(learn(seen, train_limit, value_limit))

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        scanner = Scanner(sent.value, most_bits, margin)
        out, counts = [], ([], [], [])
        for base, more in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            spans = [(x["start"], x["kind"], x["end"]) for x in base]
            for c, n in enumerate(counts):
                n.append(sum(k == c for _, k, _ in spans))
            spans += [(x["start"], 3, x["end"]) for x in more if scanner.likely(x["value"])]
            out.append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(spans)])
        kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        return common.batch_of(doc_id=(batch.column(0), pa.int64()), **{f"n_{KINDS[c]}": (n, pa.int64()) for c, n in enumerate(counts)}, spans=(out, kinds))

    return common.map_batches(seen.select("doc_id", "base", "more"), score, "doc_id long, n_assign long, n_access long, n_hex long, spans array<struct<kind: string, start: long, end: long>>")


def redacted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str | None = "n_chars", train_limit: int = 400, value_limit: int = 512, most_bits: float = 5.5, margin: float = 0.75, mark: str = "[REDACTED]") -> DataFrame:
    """The rows of docs, all kept with all columns, with each secret that find_secrets() finds replaced by the mark.

    Overlapping spans are one mark. length_col gets a changed text's length; rows without a secret keep every value, null texts too.
    Repeated rows each return; an empty table stays empty. Clashing extra columns are kept as they are.
    """
    seen = common.cut(scan(common.id_text(docs, id_col, text_col)).select("base", "word"))
    sent = docs.sparkSession.sparkContext.broadcast(learn(seen, train_limit, value_limit))
    common.forget(docs.sparkSession, seen)

    def clean(xs: list[str]) -> list[str]:
        scanner = Scanner(sent.value, most_bits, margin)
        return [redact(x, [(s, e) for s, _, e in scanner.spans(x)], mark) for x in xs]

    return common.change_rows(docs, text_col, clean, length_col)


def redact(text: str, spans: list[tuple[int, int]], mark: str = "[REDACTED]") -> str:
    """The text with each span, overlapping ones as one, replaced."""
    out, at = [], 0
    for s, e in sorted(spans):
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(common.documents(spark, sf_dir))
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    base = F.filter("spans", lambda x: x["kind"] != "format")
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))
