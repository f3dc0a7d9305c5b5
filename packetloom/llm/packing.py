"""Best-fit packing by a grouping genetic algorithm.

Pieces of tokenised documents are dealt into blocks of a bounded size. For each block that best-fit alone does not pack into the fewest
sequences its volume allows, several islands, each a row group of its own, evolve packings: a crossover injects whole well-filled bins of one parent into the other, the other's bins that hold the same pieces are
dissolved, and the displaced pieces are put back best-fit by decreasing length. Between rounds each island's elite migrates to the next.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

VOCABULARY = "word_bpe_49k.json"


class PieceIds(dict):
    """Little-endian 32-bit ids of a splitter's piece (a run of letters, a digit, a run of marks), straight from the merge model."""

    def __init__(self, model: object, most: int):
        super().__init__()
        self.model, self.most = model, most
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in byte-level vocabularies
        odd = (k for k in range(256) if k not in plain)
        self.chars = {k: chr(k) for k in plain} | {k: chr(256 + n) for n, k in enumerate(odd)}

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= self.most:
            self.clear()
        shown = piece if piece.isascii() else "".join([self.chars[k] for k in piece.encode()])
        got = self[piece] = b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(shown)])
        return got


class WordIds(dict):
    """Little-endian 32-bit ids of a white-space-free word; words are encoded on first sight and forgotten when too many are held.

    The tokenizer's normaliser and splitter never join characters across ASCII white space, so a text's ids are its words' ids in turn.
    Texts (and in other texts, words) of printable Latin-1, which the normaliser only lower-cases, are split here and their pieces merged
    by the tokenizer's model; any other word takes the whole tokenizer.
    """

    # The vocabulary's splitter; the same for lower-case Latin-1.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    LATIN = re.compile(r"[\t-\r -~\xa1-\xff]*")
    LATIN_SPLIT = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\sa-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")

    def __init__(self, path: str, most: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.most = Tokenizer.from_file(path), most
        with open(path, encoding="utf-8") as f:
            head = json.load(f)
        splitters = [x.get("pattern", {}).get("Regex") for x in (head["pre_tokenizer"] or {}).get("pretokenizers", [])]
        normal = [x["type"] for x in (head["normalizer"] or {}).get("normalizers", [])]
        known = splitters == [self.SPLIT, None] and normal == ["NFC", "Replace", "Lowercase"]
        self.pieces = PieceIds(self.tokenizer.model, most) if known else None
        self.by_word = known

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, word: bytes) -> bytes:
        if len(self) >= self.most:
            self.clear()
        text = word.decode()
        got = self[word] = self.latin(text) if self.LATIN.fullmatch(text) else self.whole(text)
        return got

    def latin(self, text: str) -> bytes:
        """Ids of Latin-1 text: lower case is all the normaliser changes, and the splitter's classes are plain ranges."""
        pieces = self.pieces
        return b"".join([pieces[x] for x in self.LATIN_SPLIT.findall(text.lower())])

    def of(self, text: bytes, end_id: int) -> bytes:
        """Ids of a text, then the end id. Texts that may hold a special token's string, and other tokenizers' texts, are encoded whole."""
        line = text.decode()
        if not self.by_word or "<|" in line:
            ids = self.whole(line)
        else:
            ids = self.latin(line) if self.LATIN.fullmatch(line) else b"".join([self[w] for w in text.split()])
        return ids + end_id.to_bytes(4, "little")


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def pieces(docs: DataFrame, capacity: int, tokenizer: str | None, end_id: int, id_col: str, text_col: str, keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): each document's ids and the end id, cut at multiples of the capacity."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = word_ids(tokenizer or default_tokenizer())
        doc, start, size, crc, kept = [], [], [], [], []
        for i, text in zip(batch.column(0).to_pylist(), common.blobs(batch.column(1)), strict=True):
            ids = memoryview(words.of(text, end_id))
            for k in range(0, len(ids), 4 * capacity):
                part = ids[k : k + 4 * capacity]
                doc.append(i)
                start.append(k // 4)
                size.append(len(part) // 4)
                crc.append(zlib.crc32(part))
                if keep_ids:
                    kept.append(bytes(part))
        cols = {"doc_id": (doc, pa.int64()), "piece": ([x // capacity for x in start], pa.int32()), "start": (start, pa.int64()), "length": (size, pa.int64()), "ids_crc32": (crc, pa.int64())}
        return common.batch_of(**cols, **({"ids": (kept, pa.binary())} if keep_ids else {}))

    return common.map_batches(common.id_text(docs, id_col, text_col), run, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids)


class BestFit:
    """Open bins by free space; a bit mask over the free spaces finds the tightest bin that fits."""

    def __init__(self, capacity: int):
        self.capacity, self.mask = capacity, 0
        self.bins: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, bin_id: int, free: int) -> None:
        self.bins[free].append(bin_id)
        self.mask |= 1 << free

    def take(self, size: int) -> tuple[int, int] | None:
        """(bin, its free space) of the fullest bin with room for size; it leaves the open ones."""
        if not (high := self.mask >> size):
            return None
        free = size + (high & -high).bit_length() - 1
        got = self.bins[free].pop()
        if not self.bins[free]:
            self.mask ^= 1 << free
        return got, free


def place(sizes: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Puts the loose pieces into bins (numbers 0.. in `bins`, -1: none) best-fit by the given order, opening new ones; returns bins anew."""
    bins = bins.copy()
    held = bins >= 0
    names, bins[held] = np.unique(bins[held], return_inverse=True)
    n = len(names)
    free = capacity - np.bincount(bins[held], sizes[held], n).astype(np.int64)
    fit = BestFit(capacity)
    for k in np.flatnonzero(free > 0).tolist():
        fit.add(k, int(free[k]))
    for k, size in zip(loose.tolist(), sizes[loose].tolist(), strict=True):
        if got := fit.take(size):
            at, room = got
        else:
            at, room, n = n, capacity, n + 1
        bins[k] = at
        if room > size:
            fit.add(at, room - size)
    return bins


def fill(sizes: np.ndarray, bins: np.ndarray, loose: np.ndarray, capacity: int) -> np.ndarray:
    """Puts the loose pieces into new bins; returns bins anew. Each bin begins with the next piece of the given order that is left and
    takes, again and again, the one or two others that leave it the least room."""
    bins, n = bins.copy(), int(bins.max(initial=-1)) + 1
    left: list[list[int]] = [[] for _ in range(capacity + 1)]
    for k in loose[::-1].tolist():
        left[sizes[k]].append(k)
    have = mirror = 0  # bit masks of the sizes that are left, and of capacity minus them
    for size in np.unique(sizes[loose]).tolist():
        have |= 1 << size
        mirror |= 1 << (capacity - size)

    def take(size: int) -> None:
        nonlocal have, mirror
        bins[left[size].pop()] = n
        if not left[size]:
            have ^= 1 << size
            mirror ^= 1 << (capacity - size)

    for k in loose.tolist():
        if bins[k] >= 0:
            continue
        size = int(sizes[k])
        take(size)  # of equal sizes any will do
        room = capacity - size
        while room and (low := have & ((2 << room) - 1)):
            best = low.bit_length() - 1
            pick = (best,)
            for total in range(room, best, -1) if best < room < 2 * best else ():
                both = low & (mirror >> (capacity - total))  # sizes that another completes to this total
                if total % 2 == 0 and both >> (total // 2) & 1 and len(left[total // 2]) < 2:
                    both ^= 1 << (total // 2)
                if both:
                    pick = (both.bit_length() - 1, total - both.bit_length() + 1)
                    break
            for x in pick:
                take(x)
            room -= sum(pick)
        n += 1
    return bins


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> tuple[int, float]:
    """Fewer bins first, then fuller ones (mean squared fill)."""
    full = np.bincount(bins, sizes) / capacity
    return -len(full), float((full**2).mean())


def crossover(sizes: np.ndarray, giver: np.ndarray, taker: np.ndarray, capacity: int, rng: np.random.Generator) -> np.ndarray:
    """The taker with well-filled whole bins of the giver injected, bins that hold the same pieces dissolved, and the displaced pieces put
    back by decreasing length: best-fit into all bins, or the fullest new bins first and best-fit for the rest."""
    full = np.bincount(giver, sizes)
    good = np.flatnonzero(full >= np.quantile(full, rng.uniform(0.3, 0.9)))
    chosen = np.zeros(len(full), bool)
    chosen[good[rng.random(len(good)) < rng.uniform(0.2, 0.9)]] = True
    moved = chosen[giver]
    gone = np.zeros(taker.max() + 1, bool)
    gone[taker[moved]] = True
    least = np.bincount(taker, sizes)
    gone |= least <= np.quantile(least, rng.uniform(0.02, 0.3))  # the emptiest bins are dissolved as well
    child = np.where(gone[taker], -1, taker)
    child[moved] = giver[moved] + taker.max() + 1
    loose = np.flatnonzero(child < 0)
    loose = loose[np.lexsort((rng.random(len(loose)), -sizes[loose]))]
    if rng.random() < 0.5:
        return place(sizes, child, loose, capacity)
    child = fill(sizes, child, loose, capacity)
    weak = np.bincount(child, sizes, int(child.max()) + 1) < 0.9 * capacity  # numbers without a piece count as weak, to no effect
    loose = loose[weak[child[loose]]]
    child[loose] = -1
    return place(sizes, child, loose, capacity)


def evolve(sizes: np.ndarray, seeds: list[np.ndarray], capacity: int, generations: int, population: int, rng: np.random.Generator, start: Callable = place) -> np.ndarray:
    """The best packing (bin of each piece) after some generations from the seeds and starts of perturbed order.

    A packing that needs no more bins than the volume cannot be beaten and ends the search.
    """
    none, bound = np.full(len(sizes), -1), -(-int(sizes.sum()) // capacity)
    people = list(seeds)
    while len(people) < population:
        wobble = sizes * (1 + rng.normal(0, 0.05, len(sizes)) * (len(people) > len(seeds)))
        people.append(start(sizes, none, np.argsort(-wobble, kind="stable"), capacity))
    ranked = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(people)), key=lambda x: (x[0], -x[1]), reverse=True)
    for g in range(generations if len(ranked) > 1 else 0):
        if -ranked[0][0][0] <= bound:
            break
        a, b = rng.choice(len(ranked), 2, replace=False)
        child = crossover(sizes, ranked[a][2], ranked[b][2], capacity, rng)
        ranked = sorted([*ranked, (fitness(sizes, child, capacity), -g - 1, child)], key=lambda x: (x[0], -x[1]), reverse=True)[:population]
    return ranked[0][2]


def islands(dealt: DataFrame, capacity: int, n_islands: int, rounds: int, generations: int, population: int) -> DataFrame:
    """(block, item, bin, length): the best packing of each block of dealt (block, item, length).

    Every block has its best-fit packing. Where that needs as many bins as the volume does, no packing has fewer; all other blocks
    evolve on the islands, of which every other one starts from fullest-bin packings instead of best-fit ones.
    """

    def begin(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        sizes = rows["length"].to_numpy(np.int64)
        bins = place(sizes, np.full(len(sizes), -1), np.argsort(-sizes, kind="stable"), capacity)
        return pd.DataFrame({"block": key[0], "item": rows["item"], "length": rows["length"], "bin": bins, "open": bool((bins.max() + 1) * capacity - sizes.sum() >= capacity)})

    fitted = common.cut(dealt.groupBy("block").applyInPandas(begin, "block long, item long, length long, bin int, open boolean"))
    spread = fitted.where("open").withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(n_islands - 1))))
    state = spread.select("block", "island", "item", "length", F.when(F.col("island") % 2 == 0, F.array("bin")).otherwise(F.array().cast("array<int>")).alias("seeds"))

    def run(turn: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
        def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("item", ignore_index=True)
            sizes = rows["length"].to_numpy(np.int64)
            seeds = list(np.array(rows["seeds"].tolist(), np.int64).T) if len(rows["seeds"][0]) else []
            best = evolve(sizes, seeds, capacity, generations, population, np.random.default_rng([turn, int(key[0]), int(key[1])]), (place, fill)[int(key[1]) % 2])
            count, full = fitness(sizes, best, capacity)
            return pd.DataFrame({"block": key[0], "island": key[1], "item": rows["item"], "length": rows["length"], "bin": best, "count": count, "fill": full})

        return one

    schema = "block long, island int, item long, length long, bin int, count long, fill double"
    for turn in range(rounds):
        evolved = common.cut(state.groupBy("block", "island").applyInPandas(run(turn), schema))
        if turn + 1 < rounds:  # each island goes on from its own elite and its neighbour's
            there = evolved.withColumn("island", (F.col("island") + 1) % n_islands)
            state = evolved.unionByName(there).groupBy("block", "island", "item").agg(F.first("length").alias("length"), F.array_sort(F.collect_list(F.struct("count", "fill", "bin"))).alias("s"))
            state = state.select("block", "island", "item", "length", F.transform("s", lambda x: x["bin"]).alias("seeds"))
    best = evolved.groupBy("block", "island").agg(F.first("count").alias("count"), F.first("fill").alias("fill"))
    best = best.groupBy("block").agg(F.max_by("island", F.struct("count", "fill", -F.col("island"))).alias("island"))
    columns = ["block", "item", "length", "bin"]
    return fitted.where("not open").select(columns).unionByName(evolved.join(best, ["block", "island"]).select(columns))


def pack(
    docs: DataFrame, capacity: int = 4096, tokenizer: str | None = None, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text",
    block_pieces: int = 4096, block_bins: int = 64, n_islands: int = 4, rounds: int = 2, generations: int = 16, population: int = 8, keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset), one row per piece of each input row; keep_ids adds `ids`.

    Only documents over the capacity are cut. Blocks hold about block_pieces pieces, or more where those would fill fewer than block_bins
    sequences, and are dealt by hash, so a task's memory does not grow with the corpus and each block wastes about a bin. Null and empty
    texts are the end id alone. Repeated rows and null ids are packed like any other. An empty table returns no row; extra columns are
    ignored.
    """
    key = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids]
    cut = common.cut(pieces(docs, capacity, tokenizer, end_id, id_col, text_col, keep_ids))
    count, tokens = cut.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    blocks = max(1, min(-(-count // block_pieces), tokens // (capacity * block_bins)))
    home = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(blocks))
    # Rows that agree in every column are interchangeable: they are packed as one group of copies, told apart by number.
    same = cut.groupBy(*key).count()
    rows = same.select("*", F.explode(F.sequence(F.lit(1), F.col("count").cast("int"))).alias("copy")).drop("count")
    rows = rows.withColumn("block", F.pmod(home + F.col("copy") - 1, F.lit(blocks)))
    numbered = common.cut(rows.withColumn("item", F.row_number().over(Window.partitionBy("block").orderBy("doc_id", "piece", "ids_crc32", "copy")).cast("long")))
    common.forget(docs.sparkSession, cut)
    packed = islands(numbered.select("block", "item", "length"), capacity, n_islands, rounds, generations, population)
    within = Window.partitionBy("block", "bin").orderBy("item").rowsBetween(Window.unboundedPreceding, -1)
    placed = packed.withColumn("offset", F.coalesce(F.sum("length").over(within), F.lit(0)).cast("long")).drop("length")
    joined = numbered.join(placed, ["block", "item"])
    return joined.select(*key, (F.col("block") * (1 << 32) + F.col("bin")).alias("sequence_id"), "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) of pack(..., keep_ids=True): each sequence's ids, little-endian 32-bit, in order of offset.

    Offsets of one sequence differ, so there are no ties; a sequence's pieces alone are gathered (its capacity at most). An empty table
    returns no row; extra columns are ignored.
    """
    line = F.expr("aggregate(array_sort(collect_list(struct(offset, ids))), cast('' as binary), (a, x) -> concat(a, x.ids))")  # a sequence's pieces alone
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), line.alias("ids"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.documents(spark, sf_dir))
