"""SimHash near-duplicate classes by segment-popcount embedding.

Each 64-bit fingerprint is embedded as 32 popcounts, one for each 2-bit segment. A differing bit moves one popcount by at most one,
so the Manhattan distance of two embeddings never exceeds the Hamming distance: it is a lower bound to filter with. The range join
|a - b|_1 <= 2 runs on a grid: the 32 coordinates form four blocks, two moves touch two blocks at most, so two of the four blocks agree
exactly, and each of the six block pairs is a projection whose grid cells have side one. A cell with too many fingerprints for one
group is cut into finer cells in the same way: in some cell of each linked pair the shared blocks agree bit by bit, and of the other
bits, again in four blocks, two agree. After two cuts at most eight bits are free, so every cell is bounded. Within a cell the Manhattan
bound is applied over all coordinates and the survivors are verified by XOR and popcount.

Popcounts are kept in thermometer code (0: 00, 1: 01, 2: 11), in which the Manhattan distance is the popcount of an XOR.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: Masks of the six pairs of 16-bit blocks.
PAIRS = [(0xFFFF << (16 * i)) | (0xFFFF << (16 * j)) for i in range(4) for j in range(i)]
CHUNK = 1 << 16


def finer(mask: int) -> list[int]:
    """The mask with two of four equal blocks of the other bits, in all six ways."""
    free = [b for b in range(64) if not mask >> b & 1]
    blocks = [sum(1 << b for b in free[k * len(free) // 4 : (k + 1) * len(free) // 4]) for k in range(4)]
    return [mask | blocks[i] | blocks[j] for i in range(4) for j in range(i)]


#: Masks by level: six cells of a fingerprint, each with six finer ones, each with six finer ones.
LEVELS = [PAIRS, [m for p in PAIRS for m in finer(p)], [n for p in PAIRS for m in finer(p) for n in finer(m)]]


def signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> bytes:
    """The fingerprint as 8 bytes, most significant first; no word: zero. A bit is set if over half the shingles' hashes set it."""
    words = text.lower().split()  # bytes: lower() changes A-Z alone, split() takes runs of 0x20 and 0x09-0x0D
    if not words:
        return bytes(8)
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    size = np.fromiter(map(len, words), np.int64, len(words))
    stop = np.cumsum(size + 1) - 1
    start, last = (stop - size)[:n].tolist(), stop[-n:].tolist()
    digest, ones = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for k in range(0, n, CHUNK):
        got = b"".join([digest(line[a:b], seed) for a, b in zip(start[k : k + CHUNK], last[k : k + CHUNK], strict=True)])
        ones += np.unpackbits(np.frombuffer(got, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3) -> DataFrame:
    """(doc_id, fp long): one row per input row, in one map-only pass over whole texts."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = b"".join([fingerprint(x, shingle) for x in common.blobs(batch.column(1))])
        return common.batch_of(doc_id=(batch.column(0), pa.int64()), fp=(pa.array(np.frombuffer(got, ">u8").astype(np.uint64).view(np.int64)), pa.int64()))

    return common.map_batches(common.id_text(docs, id_col, text_col), run, "doc_id long, fp long")


def cells(nodes: DataFrame) -> DataFrame:
    """(pair, cell, fp): six grid cells of each distinct fingerprint."""
    odd = signed(0x5555555555555555)
    code = F.expr(f"((fp | shiftrightunsigned(fp, 1)) & {odd}L) | shiftleft(fp & shiftrightunsigned(fp, 1) & {odd}L, 1)")
    keys = F.array(*[F.struct(F.lit(k).alias("pair"), F.col("code").bitwiseAND(F.lit(signed(m))).alias("cell")) for k, m in enumerate(PAIRS)])
    return nodes.select("fp", code.alias("code")).select("fp", F.explode(keys).alias("k")).select("k.pair", "k.cell", "fp")


def thermometer(fp: np.ndarray) -> np.ndarray:
    odd, one = np.uint64(0x5555555555555555), np.uint64(1)
    high = fp & (fp >> one)
    return ((fp | (fp >> one)) & odd) | ((high & odd) << one)


def stars(key: np.ndarray, fp: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within groups of equal key (adjacent rows): (member, smallest linked member) of each group's local components."""
    code, n = thermometer(fp), len(fp)
    ends = np.append(np.flatnonzero(key[1:] != key[:-1]) + 1, n)
    left = np.repeat(ends, np.diff(np.append(0, ends))) - np.arange(n) - 1  # rows that follow in the same group
    a, b = [], []
    live, d = np.flatnonzero(left > 0), 1
    while len(live):
        near = live[np.bitwise_count(code[live] ^ code[live + d]) <= radius]
        near = near[np.bitwise_count(fp[near] ^ fp[near + d]) <= radius]
        a.append(near)
        b.append(near + d)
        d += 1
        live = live[left[live] >= d]
    if not a or not len(i := np.concatenate(a)):
        return fp[:0], fp[:0]
    j, label = np.concatenate(b), np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        before = label.copy()
        np.minimum.at(label, i, low)
        np.minimum.at(label, j, low)
        label = label[label]
        if (label == before).all():
            break
    moved = np.flatnonzero(label != np.arange(n))
    return fp[moved], fp[label[moved]]


def cell_links(grid: DataFrame, radius: int) -> DataFrame:
    """Verified links inside the cells of a bounded size, as stars. Rows arrive sorted by cell; a cell cut by a batch edge is carried over."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 3
        for batch in batches:
            now = [np.concatenate([h, np.asarray(batch.column(k)).astype(np.int64)]) for k, h in enumerate(held)]
            if not len(now[0]):
                continue
            same = (now[0] == now[0][-1]) & (now[1] == now[1][-1])
            held, now = [x[same] for x in now], [x[~same] for x in now]
            if len(now[0]):
                yield star_batch(now)
        if len(held[0]):
            yield star_batch(held)

    def star_batch(rows: list[np.ndarray]) -> pa.RecordBatch:
        key = np.cumsum(np.append(0, (np.diff(rows[0]) != 0) | (np.diff(rows[1]) != 0)))
        u, v = stars(key, rows[2].view(np.uint64), radius)
        return common.batch_of(u=(pa.array(u.view(np.int64)), pa.int64()), v=(pa.array(v.view(np.int64)), pa.int64()))

    dealt = grid.repartition("pair", "cell").sortWithinPartitions("pair", "cell")
    return dealt.select("pair", "cell", "fp").mapInArrow(run, "u long, v long")


def split(grid: DataFrame, level: int) -> DataFrame:
    """The finer cells (pair, cell, fp) of the rows of a grid of the level before."""
    masks = F.array(*[F.lit(signed(m)) for m in LEVELS[level]])
    parts = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda k: F.struct((F.col("pair") * 6 + k).alias("pair"), F.col("fp").bitwiseAND(F.get(masks, F.col("pair") * 6 + k)).alias("cell")))
    return grid.select("fp", F.explode(parts).alias("k")).select("k.pair", "k.cell", "fp")


def links(nodes: DataFrame, radius: int = 2, cell_limit: int = 4096) -> DataFrame:
    """(u, v), written: verified links of distinct fingerprints (fp), as stars of each cell's local components.

    Cells with over cell_limit fingerprints are cut into finer ones, at most twice; all are verified pair by pair in bounded memory. The
    grid's blocks are made for two differing bits, so radius is 2 at most.
    """
    if radius > 2:
        raise ValueError("the grid's blocks are made for two differing bits")
    grid, found, written = cells(nodes), None, []
    for level in range(len(LEVELS)):
        usual, heavy = grid, None
        if level + 1 < len(LEVELS):
            heavy = common.cut(grid.groupBy("pair", "cell").count().where(F.col("count") > cell_limit).select("pair", "cell"))
            written.append(heavy)
            if heavy.isEmpty():
                heavy = None
            else:
                usual = grid.join(heavy, ["pair", "cell"], "left_anti")
        part = cell_links(usual, radius)
        found = part if found is None else found.unionByName(part)
        if heavy is None:
            break
        grid = split(grid.join(heavy, ["pair", "cell"], "left_semi"), level + 1)
    out = common.cut(found.distinct())
    common.forget(nodes.sparkSession, *written)
    return out


def classes(prints: DataFrame, radius: int = 2, cell_limit: int = 4096) -> DataFrame:
    """(fp, root, component_id) for each distinct fingerprint of prints (doc_id, fp). Copies collapse to one node before any join."""
    nodes = common.cut(prints.groupBy("fp").agg(F.min("doc_id").alias("low")))
    found = links(nodes.select("fp"), radius, cell_limit)
    roots = common.components(found).withColumnRenamed("u", "fp")
    common.forget(prints.sparkSession, found)
    rooted = nodes.join(roots, "fp", "left").select("fp", "low", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    return rooted.join(least, "root").select("fp", "root", "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(doc_id, fp, fingerprint, component_id), one row per input row.

    Texts are lower-cased (A-Z) and cut at ASCII white space. Null and empty texts have fingerprint zero and are linked like any other.
    component_id is the smallest doc_id reachable over links of at most radius bits; null ids never win, and a class of null ids alone
    gets null. Repeated rows each return. An empty table returns no row. Extra columns are ignored. Very long texts are read whole, in
    chunks of shingles.
    """
    prints = common.cut(fingerprints(docs, id_col, text_col, shingle))
    found = common.cut(classes(prints, radius))
    text = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return prints.join(found, "fp").select("doc_id", "fp", text.alias("fingerprint"), "component_id")


def marked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, text, mark): mark is the text's hash."""
    mark = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), mark.alias("mark"))


def rows_kept(docs: DataFrame, first: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of docs for each (doc_id, mark) in the struct m of first."""
    hidden = "_"
    while any(c.lower().startswith(hidden) for c in docs.columns):
        hidden += "_"
    name, mark = F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    stay = first.select(F.coalesce(F.col("m.doc_id").cast("string"), F.lit("null")).alias(hidden + "i"), F.col("m.mark").alias(hidden + "m")).distinct()
    tagged = docs.withColumns({hidden + "i": name, hidden + "m": mark})
    kept = tagged.join(stay, [hidden + "i", hidden + "m"], "left_semi")
    once = F.row_number().over(Window.partitionBy(hidden + "i", hidden + "m").orderBy(hidden + "i"))
    return kept.withColumn(hidden + "n", once).where(F.col(hidden + "n") == 1).select(docs.columns)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """The rows of docs, all columns kept, without near duplicates: of each class the row of smallest id stays.

    Null ids come after all others; of repeated rows, or of rows with one id, one stays in each class (that of the smallest text hash).
    Null and empty texts are one class. An empty table stays empty.
    """
    narrow = marked(docs, id_col, text_col)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        got = b"".join([fingerprint(x, shingle) for x in common.blobs(batch.column(1))])
        return common.batch_of(doc_id=(batch.column(0), pa.int64()), mark=(batch.column(2), pa.int64()), fp=(pa.array(np.frombuffer(got, ">u8").astype(np.uint64).view(np.int64)), pa.int64()))

    prints = common.cut(common.map_batches(narrow, run, "doc_id long, mark long, fp long"))
    found = classes(prints, radius)  # rows with one root share a component; the root is the class
    first = prints.join(found, "fp").groupBy("root").agg(F.min(F.struct(F.isnull("doc_id").alias("none"), "doc_id", "mark")).alias("m"))
    return rows_kept(docs, first, id_col, text_col)


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")
