"""Substring dedup: words under windows that occur elsewhere, found with compressed FM-indexes, one for each shard.

A window's minimizer (the least hash of its 12-word runs, leftmost first) depends on its words alone, so equal windows meet under equal
minimizers. A maximal run of windows with one minimizer is a segment. Copies of a segment collapse to one with a multiplicity; a segment
alone under its minimizer and without copies cannot share a window and goes no further. All others are dealt into shards of a bounded
size by minimizer. Each shard builds an FM-index (burrows-wheeler transform in a wavelet matrix of packed bits, with the multiplicities
and common prefixes in suffix order); then its segments are streamed through backward search, which gives the matching statistics: at
each position the longest match that occurs twice or more. Those of a window's length or more are reported. The segments of a minimizer
too frequent for one shard are halved by their windows' distance from it, again and again; each half has a longer minimizer, the words
that all its windows share, and is dealt and searched by that.

Words are compared by 64-bit hashes, segments by two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LOW = np.uint64((1 << 24) - 1)
GROUP = 1 << 18


class WordHash(dict):
    def __init__(self, most: int = 300_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
        got = self[word] = xxhash.xxh64_intdigest(word)
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(ids: np.ndarray, n: int) -> np.ndarray:
    """Well-mixed hashes of all runs of n ids."""
    out = np.zeros(max(0, len(ids) - n + 1), np.uint64)
    for j in range(n):
        out = out * np.uint64(0x9E3779B97F4A7C15) + ids[j : j + len(out)]
    out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def segments(ids: np.ndarray, sizes: np.ndarray, window: int, run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(minimizer, first window, windows) of each segment of texts laid end to end; a window lies within one text."""
    if len(ids) < window:
        return ids[:0], sizes[:0], sizes[:0]
    h = mixed(ids, run)
    least, span, r = (h & ~LOW) | np.arange(len(h), dtype=np.uint64), 1, window - run + 1
    while 2 * span <= r:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    if span < r:
        least = np.minimum(least[: len(least) - (r - span)], least[r - span :])
    at = (least & LOW).astype(np.int64)
    ends = np.repeat(np.cumsum(sizes), sizes)[: len(at)]
    text = np.repeat(np.arange(len(sizes)), sizes)[: len(at)]
    good = np.flatnonzero(np.arange(len(at)) + window <= ends)
    if not len(good):
        return ids[:0], sizes[:0], sizes[:0]
    new = np.append(True, (np.diff(at[good]) != 0) | (np.diff(text[good]) != 0))
    first = np.flatnonzero(new)
    return h[at[good[first]]], good[first], np.diff(np.append(first, len(good)))


class Wavelet:
    """Rank over a sequence of small numbers: a wavelet matrix, each level packed to one bit a symbol with counts for each 64."""

    def __init__(self, seq: np.ndarray, bits: int):
        self.bits, self.words, self.counts, self.zeros = bits, [], [], []
        for level in range(bits - 1, -1, -1):
            bit = ((seq >> level) & 1).astype(bool)
            packed = np.packbits(np.append(bit, np.zeros(-len(bit) % 64 + 64, bool)), bitorder="little").view(np.uint64)
            self.words.append(packed)
            self.counts.append(np.append(0, np.cumsum(np.bitwise_count(packed), dtype=np.int64))[:-1].astype(np.uint32))
            self.zeros.append(int(len(bit) - bit.sum()))
            seq = np.concatenate([seq[~bit], seq[bit]])

    def place(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where a prefix of length `at` ends within its symbol's run after the last level."""
        for level in range(self.bits):
            block = at >> 6
            ones = self.counts[level][block] + np.bitwise_count(self.words[level][block] & ((np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)))
            at = np.where((symbol >> (self.bits - 1 - level)) & 1, self.zeros[level] + ones, at - ones)
        return at


class FMIndex:
    """Matching statistics of word sequences over a set of segments with multiplicities, by backward search."""

    def __init__(self, parts: list[np.ndarray], times: np.ndarray):
        self.sizes = np.array([len(x) for x in parts])
        self.symbols, coded = np.unique(np.concatenate(parts), return_inverse=True)
        owner = np.repeat(np.arange(len(parts)), self.sizes)
        self.start = np.cumsum(self.sizes + 1) - self.sizes - 1
        self.text = np.zeros(int(self.sizes.sum()) + len(parts), np.int64)  # 0 ends each segment
        self.text[np.arange(len(coded)) + owner] = coded + 1
        self.n = n = len(self.text)
        rank = np.where(self.text > 0, self.text + len(parts), 0)
        rank[self.start + self.sizes] = np.arange(len(parts))  # ends differ, so no suffix is another's start
        ranks, step = [], 1
        while True:
            ranks.append(rank)
            key = rank * (n + len(self.symbols) + len(parts) + 2) + np.append(rank[step:] + 1, np.zeros(min(step, n), np.int64))[:n]
            order = np.argsort(key)
            sorted_key = key[order]
            new = np.append(0, np.cumsum(sorted_key[1:] != sorted_key[:-1]))
            rank = np.empty(n, np.int64)
            rank[order] = new
            step *= 2
            if new[-1] == n - 1:
                break
        self.lows = self._common_prefixes(order, ranks)
        self.weight = np.append(0, np.cumsum(np.repeat(times, self.sizes + 1)[order]))
        bwt = self.text[order - 1]
        self.first = np.append(0, np.cumsum(np.bincount(self.text, minlength=len(self.symbols) + 1)))[:-1]
        self.tree = Wavelet(bwt, max(1, int(len(self.symbols)).bit_length()))
        every = np.arange(len(self.symbols) + 1)
        self.shift = self.first - self.tree.place(every, np.zeros(len(every), np.int64))

    def _common_prefixes(self, order: np.ndarray, ranks: list[np.ndarray]) -> list[np.ndarray]:
        """Minima over 2^k neighbours of the lengths that suffixes share with the one before in order; -1 at both ends."""
        a, b, shared = order[:-1].copy(), order[1:].copy(), np.zeros(self.n - 1, np.int64)
        for k in range(len(ranks) - 1, -1, -1):
            same = ranks[k][a] == ranks[k][b]
            for x in (a, b, shared):
                x += same << k
        lows = [np.concatenate([[-1], shared, [-1]]).astype(np.int32)]
        while 2 << (len(lows) - 1) <= len(lows[0]):
            half = 1 << (len(lows) - 1)
            lows.append(np.minimum(lows[-1][:-half], lows[-1][half:]))
        return lows

    def back(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The suffix range of symbol + pattern, from that of the pattern."""
        got = self.tree.place(np.concatenate([symbol, symbol]), np.concatenate([low, high])) + np.tile(self.shift[symbol], 2)
        return got[: len(symbol)], got[len(symbol) :]

    def shorter(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The longest start of a pattern with more suffixes than its own range: that range and the start's length."""
        size = np.maximum(np.maximum(self.lows[0][low], self.lows[0][high]), 0)
        low, high = low.copy(), high.copy()
        for k in range(len(self.lows) - 1, -1, -1):
            row, span = self.lows[k], 1 << k
            at = low - span + 1
            low -= np.where((at >= 0) & (row[np.maximum(at, 0)] >= size), span, 0)
            high += np.where((high < len(row)) & (row[np.minimum(high, len(row) - 1)] >= size), span, 0)
        return low, high, size

    def repeats(self, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(segment, position, length): the matching statistics of the index's own segments that reach `least`.

        All segments step together, from their last word to the first: a word is put before the match if the result still occurs twice,
        else the match loses words at its end until one can be. A segment is done once no match of `least` can begin in what is left.
        """
        which, at, size = np.arange(len(self.sizes)), self.sizes.copy(), np.zeros(len(self.sizes), np.int64)
        low, high = np.zeros(len(which), np.int64), np.full(len(which), self.n)
        found: list[tuple[np.ndarray, ...]] = []
        live = which[self.sizes >= least]
        while len(live):
            a, b = self.back(self.text[self.start[live] + at[live] - 1], low[live], high[live])
            grows = self.weight[b] - self.weight[a] >= 2
            won, lost = live[grows], live[~grows]
            low[won], high[won] = a[grows], b[grows]
            at[won] -= 1
            size[won] += 1
            long = won[size[won] >= least]
            found.append((long, at[long], size[long]))
            at[lost[size[lost] == 0]] -= 1
            lost = lost[size[lost] > 0]
            low[lost], high[lost], size[lost] = self.shorter(low[lost], high[lost])
            live = live[(at[live] > 0) & (at[live] + size[live] >= least)]
        return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (which[:0],) * 3


def positions(docs: DataFrame, window: int, run: int) -> DataFrame:
    """(mini, seg, doc_id, print, start, n): every segment of every text, by minimizer and content hash.

    Texts shorter than the window, null and empty ones included, have none. Repeated rows each return theirs; null ids are kept. Of equal
    least hashes the leftmost is the minimizer. A very long text goes in slices that share a window less a word.
    """

    def group(held: list[tuple[int | None, int, np.ndarray, int]]) -> pa.RecordBatch:
        ids, sizes = np.concatenate([x[2] for x in held]), np.array([len(x[2]) for x in held])
        mini, start, n = segments(ids, sizes, window, run)
        raw = ids.tobytes()
        h = xxhash.xxh64_intdigest
        seg = np.array([h(raw[8 * a : 8 * b], 7) for a, b in zip(start.tolist(), (start + n + window - 1).tolist(), strict=True)], np.uint64)
        text = np.searchsorted(np.cumsum(sizes), start, "right")
        origin = np.cumsum(sizes) - sizes - np.array([x[3] for x in held])
        names = pa.array([x[0] for x in held], pa.int64()).take(pa.array(text))
        prints = np.array([x[1] for x in held], np.int64)[text]
        return common.batch_of(
            mini=(pa.array(mini.view(np.int64)), pa.int64()), seg=(pa.array(seg.view(np.int64)), pa.int64()), doc_id=(names, pa.int64()),
            print=(pa.array(prints), pa.int64()), start=(pa.array(start - origin[text]), pa.int64()), n=(pa.array(n.astype(np.int32)), pa.int32()),
        )

    def run_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        held, size = [], 0
        for batch in batches:
            for i, text in zip(batch.column(0).to_pylist(), common.blobs(batch.column(1)), strict=True):
                words = text.split()
                mark = print_of(text)
                for a in range(0, max(1, len(words) - window + 1), GROUP):  # slices of a very long text share a window less one word
                    part = words[a : a + GROUP + window - 1]
                    if len(part) >= window:
                        held.append((i, mark, hashes.of(part), a))
                        size += len(part)
                    if size > GROUP:
                        yield group(held)
                        held, size = [], 0
        if held:
            yield group(held)

    return docs.mapInArrow(run_all, "mini long, seg long, doc_id long, print long, start long, n int")


def print_of(text: bytes) -> int:
    return xxhash.xxh64_intdigest(text) - (1 << 63)


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, print, data): texts compressed for a shuffle, with the hash that tells rows of one id apart."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        zip_ = zstandard.ZstdCompressor(level=1)
        blobs = common.blobs(batch.column(1))
        return common.batch_of(doc_id=(batch.column(0), pa.int64()), print=([print_of(x) for x in blobs], pa.int64()), data=([zip_.compress(x) for x in blobs], pa.binary()))

    return common.map_batches(docs, run, "doc_id long, print long, data binary")


def contents(docs: DataFrame, wanted: DataFrame, window: int) -> DataFrame:
    """(mini, seg, times, data): the word hashes of the wanted segments (mini, seg, times, doc_id, print, start, n), one row each."""
    by_doc = wanted.groupBy("doc_id", "print").agg(F.collect_list(F.struct("mini", "seg", "times", "start", "n")).alias("parts")).withColumnsRenamed({"doc_id": "d", "print": "p"})
    joined = packed(docs).join(by_doc, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p"))).select("data", "parts")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hashes, unzip = WordHash(), zstandard.ZstdDecompressor()
        out: dict[str, list] = {"mini": [], "seg": [], "times": [], "data": []}
        for data, parts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = unzip.decompress(data).split()
            for x in parts:
                for k in ("mini", "seg", "times"):
                    out[k].append(x[k])
                out["data"].append(hashes.of(words[x["start"] : x["start"] + x["n"] + window - 1]).tobytes())
        return common.batch_of(**{k: (v, pa.binary() if k == "data" else pa.int64()) for k, v in out.items()})

    return common.map_batches(joined, run, "mini long, seg long, times long, data binary")


def flagged_positions(spots: DataFrame) -> DataFrame:
    """The positions whose segment may repeat, with times (its copies) and kinds (segments of its minimizer).

    A segment alone under its minimizer and seen once repeats in no window: most positions end here, after an aggregation of two longs.
    """
    counted = spots.groupBy("mini", "seg").agg(F.count("*").alias("times"))
    groups = counted.groupBy("mini").agg(F.count("*").alias("kinds"), F.sum("times").alias("all")).where("all > 1").drop("all")
    return spots.join(counted.join(groups, "mini"), ["mini", "seg"])


def searched(segs: DataFrame, shards: int, window: int) -> DataFrame:
    """(mini, seg, mask): which windows of the segments (mini, seg, times, data; repeated rows count once) occur twice or more, by the
    FM-index of the shard that their minimizer falls into."""

    def shard(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.drop_duplicates(["mini", "seg"]).sort_values(["mini", "seg"], ignore_index=True)
        which, at, _ = FMIndex([np.frombuffer(x, np.uint64) for x in rows["data"]], rows["times"].to_numpy()).repeats(window)
        mask = np.zeros(len(rows), np.int64)
        np.bitwise_or.at(mask, which, np.int64(1) << at)
        return rows[["mini", "seg"]].assign(mask=mask)[mask != 0]

    return segs.withColumn("shard", F.pmod(F.xxhash64("mini"), F.lit(shards))).groupBy("shard").applyInPandas(lambda rows: shard(rows), "mini long, seg long, mask long")


def halves(segs: DataFrame, window: int, run: int) -> DataFrame:
    """The windows of each segment (mini, seg, times, data, low, high, at) in two parts, by their distance from the minimizer's run.

    The windows whose distance is in [low, high) share all words but that many less one, so the shared words are a longer minimizer of
    theirs: each part's `mini` is their hash, `seg` that of its content; up_mini, up_seg and shift tell which windows of what it holds.
    `at`, the run's place in a segment, is found anew if it is negative.
    """

    def run_all(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[tuple] = []
        h = xxhash.xxh64_intdigest
        for mini, seg, times, data, low, high, at in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
            last = len(data) // 8 - window  # number of the last window
            if at < 0:
                found = mixed(np.frombuffer(data, np.uint64), run)
                at = int(np.argmax((found & ~LOW) == (np.uint64(mini % (1 << 64)) & ~LOW)))
            for a, b in ((low, (low + high) // 2), ((low + high) // 2, high)):
                first, stop = max(0, at - b + 1), min(last, at - a)
                if first <= stop:
                    core, part = data[8 * (at - a) : 8 * (at - b + 1 + window)], data[8 * first : 8 * (stop + window)]
                    out.append((h(core, 64 * a + b) - (1 << 63), h(part, 7) - (1 << 63), times, part, a, b, at - first, mini, seg, first))
        cols = list(zip(*out, strict=True)) if out else [[]] * 10
        names = ["mini", "seg", "times", "data", "low", "high", "at", "up_mini", "up_seg", "shift"]
        return common.batch_of(**{c: (x, pa.binary() if c == "data" else pa.int32() if c in ("low", "high", "at", "shift") else pa.int64()) for c, x in zip(names, cols, strict=True)})

    columns = segs.select("mini", "seg", "times", "data", "low", "high", "at")
    return common.map_batches(columns, run_all, "mini long, seg long, times long, data binary, low int, high int, at int, up_mini long, up_seg long, shift int")


def split_hot(known: DataFrame, window: int, run: int, minimizer_limit: int, shard_words: int, written: list[DataFrame]) -> DataFrame:
    """(mini, seg, mask) of the segments (mini, seg, times, data, low, high, at) of minimizers with too many for one shard: halved until
    their longer minimizers have few enough (a part of a single window is its own minimizer), each part searched in its shard."""
    parts = common.cut(halves(known, window, run))
    same = parts.groupBy("mini", "seg").agg(F.sum("times").alias("times"))
    groups = same.groupBy("mini").agg(F.count("*").alias("kinds"), F.sum("times").alias("all")).where("all > 1").drop("all")
    one = parts.drop("times", "up_mini", "up_seg", "shift").dropDuplicates(["mini", "seg"])
    flagged = common.cut(one.join(same.join(groups, "mini"), ["mini", "seg"]))
    written += [parts, flagged]
    many = (F.col("kinds") > minimizer_limit) & (F.col("high") - F.col("low") > 1)
    words = {r.many: r.words for r in flagged.groupBy(many.alias("many")).agg(F.sum(F.octet_length("data") / 8).cast("long").alias("words")).collect()}
    out = searched(flagged.where(~many), max(1, -(-words.get(False, 0) // shard_words)), window)
    if True in words:
        out = out.unionByName(split_hot(flagged.where(many), window, run, minimizer_limit, shard_words, written))
    met = parts.select("mini", "seg", "up_mini", "up_seg", "shift").join(out, ["mini", "seg"])
    return met.groupBy(F.col("up_mini").alias("mini"), F.col("up_seg").alias("seg")).agg(F.expr("bit_or(shiftleft(mask, shift))").alias("mask"))


def repeated_segments(docs: DataFrame, flagged: DataFrame, window: int, run: int, minimizer_limit: int, shard_words: int) -> DataFrame:
    """(mini, seg, mask), written: segments with windows that occur elsewhere, and which of their windows do."""
    first = flagged.groupBy("mini", "seg", "times", "kinds").agg(F.min(F.struct("doc_id", "print", "start", "n")).alias("at")).select("mini", "seg", "times", "kinds", "at.*")
    many = F.col("kinds") > minimizer_limit
    words = {r.many: r.words for r in first.groupBy(many.alias("many")).agg(F.sum(F.col("n") + window - 1).alias("words")).collect()}
    out = searched(contents(docs, first.where(~many), window), max(1, -(-words.get(False, 0) // shard_words)), window)
    written: list[DataFrame] = []
    if True in words:
        known = contents(docs, first.where(many), window).dropDuplicates(["mini", "seg"])
        whole = known.select("*", F.lit(0).alias("low"), F.lit(window - run + 1).alias("high"), F.lit(-1).alias("at"))
        out = out.unionByName(split_hot(whole, window, run, minimizer_limit, shard_words, written))
    out = common.cut(out)
    common.forget(docs.sparkSession, *written)
    return out


def remove_repeats(
    docs: DataFrame, window: int = 35, run: int = 12, id_col: str = "doc_id", text_col: str = "text", minimizer_limit: int = 1024, shard_words: int = 1 << 17, keep_text: bool = False, keep_spans: bool = False,
) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256), one row per input row; keep_text adds the kept words, one space apart, as `kept`,
    keep_spans the removed intervals of words (ends exclusive) as `spans`.

    A word goes if a window of `window` words that covers it also starts anywhere else, in its own text or another. Null and empty texts,
    and those shorter than the window, lose nothing. Repeated rows are texts of their own, so their windows repeat; null ids are ids like
    any other. An empty table returns no row. Extra columns are ignored. Very long texts are cut into slices that share a window less a word.
    """
    if not window - run < 63 or run > window:
        raise ValueError("a segment's windows must fit a 64-bit mask")
    rows = common.id_text(docs, id_col, text_col)
    spots = common.cut(positions(rows, window, run))
    flagged = common.cut(flagged_positions(spots))
    common.forget(docs.sparkSession, spots)
    masks = repeated_segments(rows, flagged, window, run, minimizer_limit, shard_words)
    hits = flagged.select("mini", "seg", "doc_id", "print", "start", "n").join(masks, ["mini", "seg"])
    # Repeated rows of one id and text bring each hit as often as there are rows; the set holds it once, so it is bounded by one text.
    hits = hits.groupBy("doc_id", "print").agg(F.collect_set(F.struct("start", "n", "mask")).alias("hits")).withColumnsRenamed({"doc_id": "d", "print": "p"})
    joined = packed(rows).join(hits, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("print") == F.col("p")), "left").select("doc_id", "data", "hits")

    def finish(batch: pa.RecordBatch) -> pa.RecordBatch:
        unzip = zstandard.ZstdDecompressor()
        total, gone, digest, kept, spans = [], [], [], [], []
        for data, hits in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            words = unzip.decompress(data).split()
            total.append(len(words))
            spans.append([])
            if hits:
                change = np.zeros(len(words) + 1, np.int64)
                for x in hits:
                    at = x["start"] + np.flatnonzero((x["mask"] >> np.arange(x["n"])) & 1)
                    change[at] += 1
                    change[at + window] -= 1
                keep = np.cumsum(change)[:-1] == 0
                words = [w for w, k in zip(words, keep.tolist(), strict=True) if k]
                edge = np.flatnonzero(np.diff(np.concatenate([[True], keep, [True]]).astype(np.int8))).reshape(-1, 2)
                spans[-1] = [{"start": a, "end": b} for a, b in edge.tolist()]
            text = b" ".join(words)
            gone.append(total[-1] - len(words))
            digest.append(hashlib.sha256(text).hexdigest())
            kept.append(text.decode() if keep_text else None)
        cols = {"doc_id": (batch.column(0), pa.int64()), "n_words": (total, pa.int64()), "n_removed": (gone, pa.int64()), "kept_sha256": (digest, pa.string())}
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        return common.batch_of(**cols, **({"kept": (kept, pa.string())} if keep_text else {}), **({"spans": (spans, kind)} if keep_spans else {}))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * keep_text + ", spans array<struct<start: long, end: long>>" * keep_spans
    return common.map_batches(joined, finish, schema)


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(common.documents(spark, sf_dir))
