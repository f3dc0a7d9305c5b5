"""Language-model scoring by a probabilistic suffix tree over bytes.

A text is its lower-cased words, one space apart, between two line feeds. Counts of all windows of depth + 1 bytes of the training texts
give, summed over ever shorter windows, the next-byte counts of every context. A context is kept if it is frequent enough and its
next-byte distribution diverges from its suffix's (count times KL divergence, in bits, over a threshold); distributions are smoothed
towards the suffix's (Witten-Bell). Scoring walks the automaton of the longest kept suffix, two table look-ups a byte.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

END = "\n"
SLICE = 1 << 21


def held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def reduced(key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of n by key, ascending."""
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else order
    return key[first], np.add.reduceat(n, first) if len(first) else n


class Windows:
    """Counts of byte windows, reduced as they grow."""

    def __init__(self, depth: int, most: int = 1_500_000):
        self.depth, self.most, self.keys, self.counts, self.size = depth, most, [], [], 0

    def add(self, lines: list[bytes]) -> None:
        """Counts the windows that end at each byte of the lines, the line's own start (zeros and a line feed) before it."""
        lead = bytes(self.depth - 1) + b"\n"
        held, total = [], 0
        for k, line in enumerate(lines):
            for a in range(0, len(line), SLICE):  # a very long line goes in slices that overlap by the depth
                held.append((line[a - self.depth : a] if a >= self.depth else (lead + line[:a])[-self.depth :]) + line[a : a + SLICE])
                total += len(held[-1])
                if total >= SLICE or (k + 1 == len(lines) and a + SLICE >= len(line)):
                    self._count(held)
                    held, total = [], 0
        if held:
            self._count(held)

    def _count(self, parts: list[bytes]) -> None:
        data = np.frombuffer(b"".join(parts), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        counted = np.ones(len(data), bool)
        starts = np.cumsum(sizes) - sizes
        for k in range(self.depth):
            counted[starts + k] = False
        key = np.zeros(len(data) - self.depth, np.uint64)
        for k in range(self.depth + 1):
            key = (key << np.uint64(8)) | data[k : k + len(key)]
        key = np.sort(key[counted[self.depth :]])
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        self.keys.append(key[first])
        self.counts.append(np.diff(np.append(first, len(key))))
        self.size += len(first)
        if self.size > self.most:
            self.reduce()

    def reduce(self) -> None:
        if self.keys:
            key, n = reduced(np.concatenate(self.keys), np.concatenate(self.counts))
            self.keys, self.counts, self.size = [key], [n], len(key)


def line_of(text: bytes) -> bytes:
    return b" ".join(text.lower().split()) + b"\n"


def corpus_counts(docs: DataFrame, depth: int) -> DataFrame:
    """(token, gram, n): counts of tokens and of byte windows in the training rows, pre-aggregated by task."""

    def rows(words: Counter | None, windows: Windows | None) -> pa.RecordBatch:
        if words is not None:
            token, n, gram = pa.array([w.decode() for w in words], pa.string()), pa.array(list(words.values()), pa.int64()), pa.nulls(len(words), pa.int64())
        else:
            windows.reduce()
            gram, n = pa.array(windows.keys[0].view(np.int64)), pa.array(windows.counts[0].astype(np.int64))
            token = pa.nulls(len(gram), pa.string())
        return pa.RecordBatch.from_arrays([token, gram, n], names=["token", "gram", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, windows, texts = Counter(), Windows(depth), 0
        for batch in batches:
            for a in range(0, batch.num_rows, 250):
                part = batch.slice(a, 250)
                blobs = [x for i, x in zip(part.column(0).to_pylist(), common.blobs(part.column(1)), strict=True) if not held_out(i)]
                lines = []
                for x in blobs:
                    found = x.lower().split()
                    words.update(found)
                    lines.append(b" ".join(found) + b"\n")
                texts += len(lines)
                windows.add(lines)
                if len(words) > 400_000:
                    yield rows(words, None)
                    words = Counter()
        words[END.encode()] += texts
        if texts:
            yield rows(words, None)
        if windows.keys:
            yield rows(None, windows)

    return docs.mapInArrow(run, "token string, gram long, n long")


def contexts(grams: DataFrame, depth: int, least_count: int, least_gain: float) -> DataFrame:
    """(size, context, symbol, n): next-byte counts of the kept contexts, context as a number of `size` bytes.

    A context needs least_count windows, however many there are in all, so more text keeps more contexts.
    """
    levels = F.array(*[F.struct(F.lit(k).alias("size"), F.expr(f"shiftrightunsigned(gram, 8) & {(1 << 8 * k) - 1}L").alias("context")) for k in range(depth + 1)])
    every = grams.select("n", F.expr("gram & 255").alias("symbol"), F.explode(levels).alias("c")).groupBy("c.size", "c.context", "symbol").agg(F.sum("n").alias("n"))
    sums = every.groupBy("size", "context").agg(F.sum("n").alias("total")).where(F.col("total") >= least_count)
    held = common.cut(every.join(sums, ["size", "context"]))
    parent = held.select((F.col("size") + 1).alias("size"), F.col("context").alias("suffix"), "symbol", (F.col("n") / F.col("total")).alias("q"))
    suffix: Column = F.expr("context & (shiftleft(1L, 8 * (size - 1)) - 1)")
    with_parent = held.where("size > 0").withColumn("suffix", suffix).join(parent, ["size", "suffix", "symbol"])
    kept = with_parent.groupBy("size", "context").agg(F.sum(F.col("n") * F.log2(F.col("n") / F.col("total") / F.col("q"))).alias("gain")).where(F.col("gain") >= least_gain)
    return held.join(kept.select("size", "context").unionByName(held.where("size = 0").select("size", "context").distinct()), ["size", "context"]).select("size", "context", "symbol", "n")


@dataclass
class Tree:
    """The automaton of the longest kept suffix, in two compact tables.

    A state is a pair of rows, kept in one number: its transitions (states that no longer state extends share their suffix's row) and its
    distribution (states that are no kept context share that of their longest kept suffix). After byte c in state (t, d), the byte's log10
    probability was logp[d, code[c]] and the next state is step[t, code[c]].
    """

    code: np.ndarray
    step: np.ndarray
    logp: np.ndarray
    depth: int

    @classmethod
    def build(cls, size: np.ndarray, context: np.ndarray, symbol: np.ndarray, n: np.ndarray, depth: int) -> Tree:
        """From the next-byte counts of the kept contexts, in any order."""
        order = np.lexsort((symbol, context, size))
        size, context, symbol, n = (x[order] for x in (size, context, symbol, n))
        first = np.flatnonzero(np.append(True, (np.diff(size) != 0) | (np.diff(context) != 0))) if len(size) else size
        names = [int(c).to_bytes(int(k), "big") for k, c in zip(size[first], context[first], strict=True)]
        rows = dict(zip(names, zip(first.tolist(), np.append(first, len(size))[1:].tolist(), strict=True), strict=True))
        seen = sorted(set(symbol.tolist()) | {c for h in names for c in h})
        code = np.full(256, len(seen), np.int64)  # the last column: bytes never seen
        code[seen] = np.arange(len(seen))
        width, column = len(seen) + 1, code[symbol]
        states = {h[a:b] for h in names for a in range(len(h) + 1) for b in range(a, len(h) + 1)} | {b""}
        longer = {h[:-1] for h in states if h} | {b""}
        # Every state's pair of rows, shorter states first: a state's suffix is a state.
        place: dict[bytes, int] = {}
        own, moves = [b""], [b""]
        for h in sorted(states, key=lambda h: (len(h), h)):
            up = place[h[1:]] if h else 0
            t, d = up >> 32, up & 0xFFFFFFFF
            if h and h in longer:
                t = len(moves)
                moves.append(h)
            if h and h in rows:
                d = len(own)
                own.append(h)
            place[h] = t << 32 | d
        step, p = np.zeros((len(moves), width), np.int64), np.zeros((len(own), width), np.float32)
        children: dict[bytes, list[bytes]] = {}
        for h in states:
            if h:
                children.setdefault(h[:-1], []).append(h)
        for k, h in enumerate(moves):  # a row is its suffix's but for the states that extend it
            if h:
                step[k] = step[place[h[1:]] >> 32]
            for x in children.get(h, ()):
                step[k, code[x[-1]]] = place[x]
        for k, h in enumerate(own):
            if h in rows:
                a, b = rows[h]
                counts = np.zeros(width)
                counts[column[a:b]] = n[a:b]
                # The root has one count for each of 256 bytes; those never seen share the last column.
                p[k] = (counts + (b - a) * p[place[h[1:]] & 0xFFFFFFFF]) / (counts.sum() + b - a) if k else (counts + 1) / (counts.sum() + 256)
            else:
                p[k] = 1 / 256
        np.log10(p, out=p)
        return cls(code, step, p, depth)

    def scores(self, lines: list[bytes], counted: np.ndarray | None = None, chunk: int = 256) -> np.ndarray:
        """log10 probability of each line; with `counted` (a flag for each byte), of the bytes that follow such a byte alone.

        Lines go in chunks, side by side; each chunk starts depth bytes early to find its state.
        """
        lead = bytes(self.depth - 1) + b"\n"
        raw = np.frombuffer(b"".join([lead + x for x in lines]), np.uint8)
        data = self.code[raw].astype(np.int32)
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        starts = np.cumsum(sizes + self.depth) - sizes - self.depth
        n = -(-sizes // chunk)
        owner = np.repeat(np.arange(len(lines)), n)
        part = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        begin = starts[owner] + part * chunk
        left = np.minimum(chunk, sizes[owner] - part * chunk)
        order = np.argsort(-left, kind="stable")
        owner, begin, left = owner[order], begin[order], left[order]
        width = self.step.shape[1]
        step, logp = self.step.ravel(), self.logp.ravel()
        state, total = np.zeros(len(owner), np.int64), np.zeros(len(owner))
        live = len(owner)
        for t in range(chunk + self.depth):
            if t >= self.depth:
                live = int(np.searchsorted(-left, -(t - self.depth), "left"))  # chunks are in falling order of length
                if not live:
                    break
            now, at = state[:live], begin[:live] + t
            c = data[at]
            if t >= self.depth:
                got = logp[(now & 0xFFFFFFFF) * width + c]
                total[:live] += got if counted is None else got * counted[raw[at - 1]]
            state[:live] = step[(now >> 32) * width + c]
        out = np.zeros(len(lines))
        np.add.at(out, owner, total)
        return out


def parts_of(found: DataFrame, table_bytes: int) -> list[list[int]]:
    """The last bytes of kept contexts in groups whose automata take about table_bytes each, a group one byte at least.

    A byte's probability depends on contexts that end in the byte before it alone, so each group can be scored by itself.
    """
    last = F.expr("cast(context & 255 as int)")
    sizes = found.where("size > 0").groupBy("size", "context").count().groupBy(last.alias("last")).agg(F.count("*").alias("n")).collect()  # 256 rows at most
    width = found.select("symbol").distinct().count() + 1
    out, held = [[]], 0
    for r in sorted(sizes, key=lambda r: r["last"]):
        cost = r.n * width * 8  # a row of each table, as many states have transitions of their own or a distribution, few have both
        if out[-1] and held + cost > table_bytes:
            out.append([])
            held = 0
        out[-1].append(r["last"])
        held += cost
    return out


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", depth: int = 5, least_count: int = 32, least_gain: float = 16.0, token_share: float = 1e-6,
    table_bytes: int = 192 << 20,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score), one row per input row.

    Rows with crc32(doc_id as text) mod 7 = 2 are never learned from. Tokens are A-Z-lower-cased words and one end. The suffix tree
    grows with the corpus: contexts seen least_count times take part. For the base score, counts of tokens with token_share of all (so 1 / token_share at most) are
    broadcast and those of the others joined. depth is 1 to 7. An automaton beyond table_bytes is built, sent and used in parts, by the
    last byte of its contexts, one pass of the texts for each, so neither the driver nor a worker holds more as the corpus grows.

    Null and empty texts are the end alone. A null id is a training row. Repeated rows count and return each. With no training row the
    base score is 0 for each token and the tree is uniform. An empty table returns no row. Extra columns are ignored.
    """
    spark = docs.sparkSession
    rows = common.id_text(docs, id_col, text_col)
    counted = common.cut(corpus_counts(rows, depth))
    tokens = common.cut(counted.where("token is not null").groupBy("token").agg(F.sum("n").alias("c")))
    size, total = tokens.agg(F.count("*"), F.coalesce(F.sum("c"), F.lit(0))).first()
    often = tokens.where(F.col("c") >= F.lit(token_share * total)).toArrow()
    often = dict(zip(common.blobs(often.column(0)), np.log10(often.column(1).to_numpy() + 1.0).tolist(), strict=True))
    found = common.cut(contexts(counted.where("gram is not null").select("gram", "n"), depth, least_count, least_gain))
    parts = parts_of(found, table_bytes)
    known_last = np.zeros(256, bool)
    known_last[[c for part in parts for c in part]] = True

    def send(k: int, more: object) -> Broadcast:
        arrays = (found.where((F.col("size") == 0) | F.expr("cast(context & 255 as int)").isin(parts[k])) if len(parts) > 1 else found).toArrow()
        tree = Tree.build(*[arrays.column(c).to_numpy() for c in range(4)], depth)
        counted = None
        if len(parts) > 1:  # the first part takes the bytes that end no context as well
            counted = np.isin(np.arange(256), parts[k]) | (~known_last if k == 0 else False)
        return spark.sparkContext.broadcast((more, tree.code, tree.step, tree.logp, counted))

    sent = send(0, often)
    del often
    rare = pa.list_(pa.struct([("token", pa.string()), ("tf", pa.int64())]))
    cached: list = []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cached:
            often, code, step, logp, counted = sent.value
            cached.extend([often, Tree(code, step, logp, depth), counted])
        known, tree, follows = cached
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                ids = batch.column(0).to_pylist()
                blobs = common.blobs(batch.column(1))
                lines, n, part, hits, others = [], [], [], [], []
                get = known.get
                for x in blobs:
                    words = x.lower().split()
                    lines.append(b" ".join(words) + b"\n")
                    words.append(b"\n")
                    logs = list(map(get, words))
                    missing = Counter([w for w, v in zip(words, logs, strict=True) if v is None]) if None in logs else {}
                    n.append(len(words))
                    hits.append(len(words) - sum(missing.values()))
                    part.append(float(sum([v for v in logs if v is not None])))
                    others.append([{"token": w.decode(), "tf": k} for w, k in missing.items()])
                print_of = [xxhash.xxh64_intdigest(x) - (1 << 63) for x in blobs]
                yield common.batch_of(
                    doc_id=(batch.column(0), pa.int64()), print=(print_of, pa.int64()), held_out=([held_out(i) for i in ids], pa.bool_()), n_tokens=(n, pa.int64()),
                    hits=(hits, pa.int64()), part=(part, pa.float64()), score=(pa.array(tree.scores(lines, follows)), pa.float64()), others=(others, rare),
                )

    schema = "doc_id long, print long, held_out boolean, n_tokens long, hits long, part double, score double, others array<struct<token: string, tf: long>>"
    scored = common.cut(rows.mapInArrow(run, schema))
    sent.destroy()
    for k in range(1, len(parts)):
        scored = added(scored, rows, send(k, None), depth)
    single = scored.select("doc_id", "print", F.explode("others").alias("o")).select("doc_id", "print", "o.token", "o.tf")
    uncommon = tokens.where(F.col("c") < F.lit(token_share * total))
    met = single.join(uncommon, "token").groupBy("doc_id", "print").agg(F.sum(F.col("tf") * F.log10(F.col("c") + 1)).alias("more"), F.sum("tf").alias("known"))
    # Rows of equal id and text each brought their rare tokens; a share of the sum is each one's.
    copies = scored.groupBy("doc_id", "print").agg(F.count("*").alias("copies"))
    met = met.join(copies, met.doc_id.eqNullSafe(copies.doc_id) & (met["print"] == copies["print"])).select(
        met.doc_id.alias("d"), met["print"].alias("p"), (F.col("more") / F.col("copies")).alias("more"), F.expr("known div copies").alias("known")
    )
    joined = scored.drop("others").join(met, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left")
    scale = F.log10(F.lit(float(total + size + 1)))
    return joined.select(
        "doc_id", "held_out", "n_tokens", (F.col("hits") + F.coalesce("known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("part") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * scale).alias("base_score"), "score",
    )


def added(scored: DataFrame, rows: DataFrame, sent: Broadcast, depth: int) -> DataFrame:
    """scored with another part's scores added, written. Rows of equal id and text have one score."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, code, step, logp, counted = sent.value
        tree = Tree(code, step, logp, depth)
        for whole in batches:
            for a in range(0, whole.num_rows, 500):
                batch = whole.slice(a, 500)
                blobs = common.blobs(batch.column(1))
                yield common.batch_of(
                    i=(batch.column(0), pa.int64()), k=([xxhash.xxh64_intdigest(x) - (1 << 63) for x in blobs], pa.int64()),
                    more=(pa.array(tree.scores([line_of(x) for x in blobs], counted)), pa.float64()),
                )

    part = rows.mapInArrow(run, "i long, k long, more double").groupBy("i", "k").agg(F.first("more").alias("more"))
    joined = scored.join(part, F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("print") == F.col("k")))
    out = common.cut(joined.withColumn("score", F.col("score") + F.col("more")).select(scored.columns))
    sent.destroy()
    common.forget(scored.sparkSession, scored)
    return out


def op2_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(common.documents(spark, sf_dir))
