import inspect
import math
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from packetloom.llm import common, resemblance, simhash

UPPER = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}


def print_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    shingles = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes_of(prints):
    """Brute force: all pairs, union-find."""
    distinct = sorted(set(prints))
    up = {p: p for p in distinct}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 2:
                up[find(a)] = find(b)
    return {p: find(p) for p in distinct}


def check(got, rows):
    prints = {(i, t): print_of(t) for i, t in rows}
    root = classes_of(prints.values())
    least = {}
    for (i, _), p in prints.items():
        if i is not None:
            least[root[p]] = min(i, least.get(root[p], i))
    want = sorted(((i, f"{prints[i, t]:016x}", least.get(root[prints[i, t]])) for i, t in rows), key=repr)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want


def test_against_brute_force(docs, odd_docs):
    for df in (docs, odd_docs):
        check(simhash.near_duplicates(df).collect(), [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()])


def test_empty(no_docs):
    assert simhash.near_duplicates(no_docs).count() == 0
    assert simhash.one_of_each(no_docs).columns == no_docs.columns and simhash.one_of_each(no_docs).count() == 0


@pytest.fixture(scope="module")
def crowd(spark):
    """Fingerprints in chains and crowds around a few centres, with copies."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, 6, dtype=np.uint64)
    found = []
    for c in centres:
        at = int(c)
        for _ in range(60):
            found.append(at)
            at ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 5)), replace=False))
    found += found[:50]
    return [(k, simhash.signed(p)) for k, p in enumerate(found)]


def test_finer_cells_hold_every_linked_pair():
    for level in simhash.LEVELS:
        assert len({m.bit_count() for m in level}) == 1 and len(level) in (6, 36, 216)
    for i in range(64):
        for j in range(i + 1):
            gone = 1 << i | 1 << j  # the bits that differ
            pairs = [k for k, m in enumerate(simhash.LEVELS[0]) if not m & gone]
            assert pairs and all(any(not simhash.LEVELS[1][6 * k + a] & gone and any(not simhash.LEVELS[2][36 * k + 6 * a + b] & gone for b in range(6)) for a in range(6)) for k in pairs)
    assert 64 - simhash.LEVELS[2][0].bit_count() == 8


@pytest.mark.parametrize("limit", [4096, 3, 1])
def test_every_cell_size_gives_the_same_classes(spark, crowd, limit):
    got = {r.fp: r.component_id for r in simhash.classes(spark.createDataFrame(crowd, "doc_id long, fp long"), cell_limit=limit).collect()}
    prints = {i: p & (1 << 64) - 1 for i, p in crowd}
    root, least = classes_of(prints.values()), {}
    for i, p in prints.items():
        least[root[p]] = min(i, least.get(root[p], i))
    assert got == {simhash.signed(p): least[root[p]] for p in prints.values()}


def test_manhattan_distance_is_a_lower_bound():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 1 << 63, (2, 2000), dtype=np.uint64)
    counts = lambda x: np.unpackbits(x.view(np.uint8).reshape(-1, 8), axis=1).reshape(-1, 32, 2).sum(axis=2).astype(int)
    lower = np.abs(counts(a) - counts(b)).sum(axis=1)
    assert (np.bitwise_count(simhash.thermometer(a) ^ simhash.thermometer(b)) == lower).all() and (lower <= np.bitwise_count(a ^ b)).all()


def test_one_of_each(docs, odd_docs):
    assert simhash.one_of_each(docs).count() == simhash.near_duplicates(docs).select("component_id").distinct().count()
    kept = simhash.one_of_each(odd_docs)
    assert kept.columns == odd_docs.columns
    rows = [(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()]
    assert kept.count() == len(set(classes_of([print_of(t) for _, t in rows]).values()))
    assert kept.where("doc_id = 1").count() == 1 and kept.where("doc_id in (2, 3)").count() == 0


def test_components(spark):
    chain = [(k + 1, k) for k in range(100)] + [(500, 400), (500, 400), (7, 7), (None, 3)]
    got = {r.u: r.root for r in common.components(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {k: 0 for k in range(101)} | {500: 400, 400: 400}
    assert common.components(spark.createDataFrame([], "u long, v long")).count() == 0
    star = spark.range(1, 3000).select(F.col("id").alias("u"), F.lit(0).cast("long").alias("v"))
    assert common.components(star).where("root <> 0").count() == 0


def shingles_of(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def first_of_classes(rows):
    """Brute force over all pairs; of each class the smallest id."""
    sets = [shingles_of(t) for _, t in rows]
    root = list(range(len(rows)))
    for k, a in enumerate(sets):
        for j in range(k):
            both = len(a & sets[j])
            if a == sets[j] or both and both / (len(a) + len(sets[j]) - both) >= 0.8:
                x, y = root[k], root[j]
                root = [x if r == y else r for r in root]
    least = {}
    for r, (i, _) in zip(root, rows, strict=True):
        least[r] = min(least.get(r, math.inf), math.inf if i is None else i)
    return sorted(least.values())


def test_the_pipeline_drops_texts_of_similarity_eight_tenths(spark, docs, odd_docs, no_docs, sf_dir):
    rng = np.random.default_rng(5)
    made = []
    for k in range(30):  # a text and copies with ever more changed words: similarity from above 0.8 to below
        words = [f"w{x}" for x in rng.integers(0, 5000, 100)]
        for c in range(8):
            made.append((10 * k + c, " ".join(words)))
            words[10 * c + 5] = f"new{k}"
    for df in (docs, odd_docs, spark.createDataFrame(made, "doc_id long, text string")):
        kept = corpus_pipeline.drop_near_copies(spark, df, sf_dir)
        assert kept.columns == df.columns
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        assert sorted(math.inf if r.doc_id is None else r.doc_id for r in kept.collect()) == first_of_classes(rows)
    assert corpus_pipeline.drop_near_copies(spark, no_docs, sf_dir).count() == 0


def test_crowds_are_compared_in_blocks(spark):
    """A crowd of near copies with outliers under the threshold, in buckets of any size and blocks of any length, against brute force."""
    rng = np.random.default_rng(8)
    base = [f"b{k}" for k in range(120)]
    made = []
    for k in range(60):
        words = list(base)
        for at in rng.choice(120, int(rng.integers(1, 7)), replace=False):
            words[at] = f"x{rng.integers(0, 10**9)}"
        made.append((k, " ".join(words)))
    want = first_of_classes(made)
    assert 1 < len(want) < 50
    df = spark.createDataFrame(made, "doc_id long, text string")
    for limit, block in ((32, 1 << 17), (2, 2000), (2, 1 << 17)):
        assert sorted(r.doc_id for r in resemblance.one_of_each(df, bucket_limit=limit, block=block).collect()) == want


def test_linked_against_brute_force():
    rng = np.random.default_rng(9)
    for _ in range(50):
        sets = [np.unique(rng.integers(0, 12, rng.integers(1, 12)).astype(np.uint64)) for _ in range(8)]
        root = list(range(8))
        for i in range(8):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if len(a & b) / len(a | b) >= 0.6:
                    root = [min(root[i], root[j]) if r in (root[i], root[j]) else r for r in root]
        assert resemblance.linked(sets, 0.6, columns=4).tolist() == root


def test_bands_find_every_pair_of_similarity_eight_tenths():
    rng = np.random.default_rng(6)
    for _ in range(300):
        own = np.unique(rng.integers(0, 1 << 63, 108, np.uint64))
        a, b = own[:99], np.concatenate([own[:88], own[99:]])  # 88 of 108 at least
        assert (resemblance.bands(a) == resemblance.bands(b)).any()


def steps_of_near_dedup():
    return [n for n, f in vars(resemblance).items() if inspect.isfunction(f) and f.__module__ == resemblance.__name__ and f.__annotations__.get("return") == "DataFrame" and n != "one_of_each"]


@pytest.mark.parametrize("step", [None, *steps_of_near_dedup()])
def test_every_step_of_near_dedup_decides(spark, monkeypatch, step):
    """Without the rows of any one step, classes come apart: of two similar texts alone, or kept from being next to each other by some
    texts of sizes between theirs that are similar to neither, in small buckets and in large ones."""
    rng = np.random.default_rng(11)
    made = []
    for k, between in enumerate((0, 30, 260)):
        base = [f"b{k}.{x}" for x in range(300)]
        made += [base, base + [f"c{k}.{x}" for x in range(66)]]
        for j in range(between):
            words = base + [f"d{k}.{j}.{x}" for x in range(20)]
            for at in 6 * rng.choice(48, 6, replace=False) + 6:
                words[at] = f"e{k}.{j}.{at}"
            made.append(words)
    rows = [(k, " ".join(x)) for k, x in enumerate(made)]
    want = first_of_classes(rows)
    assert len(want) == len(rows) - 3
    if step:
        real = getattr(resemblance, step)
        monkeypatch.setattr(resemblance, step, lambda *a: real(*a).limit(0))
    kept = sorted(r.doc_id for r in resemblance.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"), bucket_limit=24).collect())
    assert (kept == want) == (step is None)
