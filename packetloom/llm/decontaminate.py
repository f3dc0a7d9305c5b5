"""Benchmark decontamination by greedy string tiling.

Five-token seeds shared by a document and a benchmark item are joined through Karp-Rabin hashes; seeds that follow each other on a diagonal
are maximal matches (of matches alike but for their place in the document, those that no tiling can use are dropped), and the longest match that is still unmarked is marked, again and again. The share of an item's tokens under tiles
is its coverage, whatever the order in which its passages stand in the document.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bytes that are no part of a token: all ASCII but letters and digits; A-Z are lower-cased.
TABLE = bytes(32 if k < 128 and not chr(k).isalnum() else ord(chr(k).lower()) if k < 128 else k for k in range(256))


def tokens(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """Karp-Rabin hashes (mod 2^64) of all windows of n ids."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        out = out * BASE + ids[j : j + len(out)].astype(np.uint64) + np.uint64(1)
    return out


def tile(matches: list[tuple[int, int, int]], n_item: int, n_doc: int, least: int) -> tuple[int, int]:
    """(tokens, tiles) marked by greedy tiling of maximal matches (item position, document position, length)."""
    item, doc, room = bytearray(n_item), bytearray(n_doc), bytes(least)
    heap = [(-size, p, t) for p, t, size in matches]
    heapq.heapify(heap)
    covered = count = 0
    while heap and room in item:
        size, p, t = heapq.heappop(heap)
        size = -size
        free = [not (a or b) for a, b in zip(item[p : p + size], doc[t : t + size], strict=True)]
        if all(free):
            item[p : p + size] = doc[t : t + size] = b"\1" * size
            covered, count = covered + size, count + 1
            continue
        at = 0
        for is_free, run in groupby(free):
            k = len(list(run))
            if is_free and k >= least:
                heapq.heappush(heap, (-k, p + at, t + at))
            at += k
    return covered, count


def joined_runs(runs: np.ndarray) -> np.ndarray:
    """Runs (columns item, p, t, seeds) by item and diagonal, those that follow each other without a gap as one."""
    runs = runs[:, np.lexsort((runs[2], runs[2] - runs[1], runs[0]))]
    item, p, t, n = runs
    new = np.append(True, (np.diff(item) != 0) | (np.diff(t - p) != 0) | (t[1:] != t[:-1] + n[:-1]))
    first = np.flatnonzero(new)
    return np.stack([item[first], p[first], t[first], np.add.reduceat(n, first)])


class Seeds:
    """The seeds of a bounded block of benchmark items."""

    def __init__(self, items: list[tuple[int, bytes]], match: int, pairs: int = 1 << 20):
        self.match, self.pairs, self.vocabulary, self.items, lists = match, pairs, {}, [], []
        self.short: dict[int, dict[tuple[bytes, ...], list[int]]] = {}
        for item_id, text in items:
            words = tokens(text)
            if len(words) >= match:
                self.items.append(item_id)
                lists.append(np.array([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words], np.int64))
            elif words:
                self.short.setdefault(len(words), {}).setdefault(tuple(words), []).append(item_id)
        self.ids = lists
        self.sizes = np.array([len(x) for x in lists], np.int64)
        hashes = [rolling(x, match) for x in lists]
        every = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        order = np.argsort(every, kind="stable")
        self.table = every[order]
        self.owner = np.repeat(np.arange(len(lists)), [len(h) for h in hashes])[order] if hashes else order
        self.place = np.concatenate([np.arange(len(h)) for h in hashes])[order] if hashes else order

    def fewer(self, runs: np.ndarray) -> np.ndarray:
        """Runs of one item position and length are alike but for their place in the document: the first 2m of them are kept, m the
        item's tokens. No tiling misses the others: tiles marked before one of size s have s tokens or more and m - s in all, so they
        block under 2m of its places."""
        item, p, t, n = runs = runs[:, np.lexsort((runs[2], runs[3], runs[1], runs[0]))]
        new = np.append(True, (np.diff(item) != 0) | (np.diff(p) != 0) | (np.diff(n) != 0))
        first = np.flatnonzero(new)
        rank = np.arange(len(item)) - np.repeat(first, np.diff(np.append(first, len(item))))
        return runs[:, rank < 2 * self.sizes[item]]

    def runs(self, ids: np.ndarray) -> np.ndarray:
        """Maximal runs of seeds shared with a document (columns item, p, t, seeds), from its positions a chunk of pairs at a time, so a
        repetitive text takes no more memory than another."""
        known = np.append(0, np.cumsum(ids < 0))
        at = np.flatnonzero(known[self.match :] == known[: -self.match])
        hashes = rolling(ids, self.match)[at]
        low = np.searchsorted(self.table, hashes)
        n = np.searchsorted(self.table, hashes, "right") - low
        at, low, n = at[n > 0], low[n > 0], n[n > 0]
        ends, a, most = np.cumsum(n), 0, 1 << 20
        done, held, still = [], 0, np.zeros((4, 0), np.int64)
        while a < len(at):
            b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + self.pairs, "right")))
            part = n[a:b]
            k = np.repeat(low[a:b] - np.append(0, np.cumsum(part))[:-1], part) + np.arange(int(part.sum()))
            got = np.stack([self.owner[k], self.place[k], np.repeat(at[a:b], part), np.ones(len(k), np.int64)])
            got = joined_runs(np.concatenate([still, got], axis=1))
            goes_on = got[2] + got[3] == at[b - 1] + 1
            still, got = got[:, goes_on], got[:, ~goes_on]
            done.append(got)
            held += got.shape[1]
            if held > most:
                done = [self.fewer(np.concatenate(done, axis=1))]
                held = done[0].shape[1]
                most = max(most, 2 * held)
            a = b
        return self.fewer(np.concatenate([*done, still], axis=1))

    def coverage(self, words: list[bytes]) -> list[tuple[int, float, int]]:
        """(item, coverage, tiles) of each item that shares a seed with the document; items shorter than a seed are seeds themselves."""
        out = []
        for size, wanted in self.short.items():
            for found in wanted.keys() & set(zip(*(words[k:] for k in range(size)), strict=False)):
                out += [(i, 1.0, 1) for i in wanted[found]]
        if len(words) < self.match or not len(self.table):
            return out
        get = self.vocabulary.get
        ids = np.array([get(w, -1) for w in words], np.int64)
        runs = self.runs(ids)
        edges = np.flatnonzero(np.diff(runs[0])) + 1
        for part in np.split(runs, edges, axis=1) if runs.shape[1] else []:
            i = int(part[0, 0])
            own = self.ids[i]
            # hashes that agree by chance are dropped here: a match must agree in every id
            runs_of = [(p, t, k + self.match - 1) for p, t, k in zip(*part[1:].tolist(), strict=True)]
            sound = [(p, t, size) for p, t, size in runs_of if (own[p : p + size] == ids[t : t + size]).all()]
            covered, count = tile(sound, len(own), len(words), self.match)
            out.append((self.items[i], covered / len(own), count))
        return out


def block_count(benchmark: DataFrame, block_bytes: int, text_col: str) -> int:
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]
    return max(1, -(-size // block_bytes))


def block_of(benchmark: DataFrame, k: int, count: int, match: int, id_col: str, text_col: str) -> Broadcast:
    """One of `count` blocks of the benchmark, a stated query set, as a broadcast."""
    items = benchmark.select(F.col(id_col).cast("long").alias("item_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(count)) == k).collect()
    return benchmark.sparkSession.sparkContext.broadcast(Seeds(sorted((-1 if r.item_id is None else r.item_id, r.text.encode()) for r in rows), match))


def judged(sent: Broadcast, threshold: float) -> Callable[[bytes], tuple[int, int, int | None, float, int]]:
    """text -> (n_words, n_items at the threshold, best item, its coverage, its tiles) by one block."""

    def one(text: bytes) -> tuple[int, int, int | None, float, int]:
        words = tokens(text)
        got = sent.value.coverage(words)
        best = max(got, key=lambda x: (x[1], -x[0]), default=(None, 0.0, 0))
        return len(words), sum(c >= threshold for _, c, _ in got), *best

    return one


def text_key(column: str) -> Column:
    return F.md5(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def found_by_blocks(docs: DataFrame, benchmark: DataFrame, count: int, threshold: float, match: int, text_col: str, item_id_col: str, item_text_col: str) -> DataFrame:
    """(key, n_items, item_id, coverage, tiles) of the texts that share a seed with any item. The blocks are sent and searched one after
    the other, each in a pass of its own that writes its hits, and taken back before the next."""
    schema = "key string, n_items long, item_id long, coverage double, tiles long"
    narrow, passes = docs.select(text_key(text_col).alias("key"), F.col(text_col).cast("string").alias("text")), []
    for k in range(count):
        sent = block_of(benchmark, k, count, match, item_id_col, item_text_col)
        one = judged(sent, threshold)

        def run(batch: pa.RecordBatch, one: Callable = one) -> pa.RecordBatch:
            rows = [(key, *got[1:]) for key, got in zip(batch.column(0).to_pylist(), map(one, common.blobs(batch.column(1))), strict=True) if got[2] is not None]
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
            return common.batch_of(key=(cols[0], pa.string()), n_items=(cols[1], pa.int64()), item_id=(cols[2], pa.int64()), coverage=(cols[3], pa.float64()), tiles=(cols[4], pa.int64()))

        passes.append(common.cut(common.map_batches(narrow, run, schema).dropDuplicates(["key"])))
        sent.destroy()
    hits = passes[0]
    for more in passes[1:]:
        hits = hits.unionByName(more)
    best = F.max_by(F.struct("item_id", "coverage", "tiles"), F.struct("coverage", -F.col("item_id")))
    return hits.groupBy("key").agg(F.sum("n_items").alias("n_items"), best.alias("b")).select("key", "n_items", "b.*")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, match: int = 5, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20,
) -> DataFrame:
    """(doc_id, n_words, n_items, item_id, coverage, tiles, contaminated), one row per input row, in one map-only pass.

    Tokens are runs of letters, digits and bytes beyond ASCII, A-Z lower-cased. item_id is the item of most coverage (ties: the smallest
    id), null if none shares `match` tokens in a row; contaminated means coverage >= threshold. An item under `match` tokens matches where
    all of it stands in a row; empty and null items never match; equal items each count in n_items. A null item id reads as -1. Null and
    empty documents are clean. Very long and repetitive texts are taken in chunks of bounded memory. Repeated rows each return; an empty
    table or benchmark returns no row or clean rows. Extra columns are ignored. A benchmark beyond block_bytes is searched in blocks of
    about that size, one pass of docs for each, whose hits are joined by text.
    """
    rows, count = common.id_text(docs, id_col, text_col), block_count(benchmark, block_bytes, item_text_col)
    kinds = {"n_words": pa.int64(), "n_items": pa.int64(), "item_id": pa.int64(), "coverage": pa.float64(), "tiles": pa.int64()}
    schema = "doc_id long, n_words long, n_items long, item_id long, coverage double, tiles long"
    if count == 1:
        one = judged(block_of(benchmark, 0, 1, match, item_id_col, item_text_col), threshold)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            cols = list(zip(*map(one, common.blobs(batch.column(1))), strict=True))
            return common.batch_of(doc_id=(batch.column(0), pa.int64()), **{k: (list(v), t) for (k, t), v in zip(kinds.items(), cols, strict=True)})

        out = common.map_batches(rows, run, schema)
    else:
        found = found_by_blocks(rows, benchmark, count, threshold, match, "text", item_id_col, item_text_col)

        def sizes(batch: pa.RecordBatch) -> pa.RecordBatch:
            return common.batch_of(doc_id=(batch.column(0), pa.int64()), key=(batch.column(1), pa.string()), n_words=([len(tokens(x)) for x in common.blobs(batch.column(2))], pa.int64()))

        sized = common.map_batches(rows.select("doc_id", text_key("text").alias("key"), "text"), sizes, "doc_id long, key string, n_words long")
        out = sized.join(found, "key", "left").select("doc_id", "n_words", F.coalesce("n_items", F.lit(0)).alias("n_items"), "item_id", F.coalesce("coverage", F.lit(0.0)).alias("coverage"), F.coalesce("tiles", F.lit(0)).alias("tiles"))
    return out.withColumn("contaminated", F.col("coverage") >= threshold)


def without_contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.8, match: int = 5, text_col: str = "text", item_id_col: str = "item_id", item_text_col: str = "text", block_bytes: int = 16 << 20) -> DataFrame:
    """The rows of docs, all columns kept, that hold no benchmark item to the threshold; as decontaminate() in all else."""
    count = block_count(benchmark, block_bytes, item_text_col)
    if count > 1:
        found = found_by_blocks(docs, benchmark, count, threshold, match, text_col, item_id_col, item_text_col).where(F.col("coverage") >= threshold)
        return docs.join(found.select("key"), text_key(text_col) == F.col("key"), "left_anti")
    one = judged(block_of(benchmark, 0, 1, match, item_id_col, item_text_col), threshold)
    return common.change_rows(docs, text_col, lambda xs: [None if one(x.encode())[3] >= threshold else x for x in xs])


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(common.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
