"""Media, decontamination, secrets, substrings, packing, sharding, pipeline."""

import hashlib
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from packetloom.llm import decontaminate, media, packing, secrets, sharding, substring

rows_of = lambda df: [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def png(w=1):
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, 1, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(bytes(w + 1))) + chunk(b"IEND", b"")


def test_sniffing():
    image, sound = png(), media.to_wav(b"abc")
    import gzip
    import io
    import zipfile

    packed = gzip.compress(b"x" * 3000)
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("a.txt", "hello")
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00\x00\x00\x00\xff\xff\xff,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    for data, kind in ((image, "image/png"), (sound, "audio/wav"), (packed, "application/gzip"), (box.getvalue(), "application/zip"), (gif, "image/gif")):
        assert media.sniff(data)[0] == (kind, 0, len(data))
        held = b"junk" + data + b"more"
        assert (kind, 4, len(data)) in media.sniff(held)
        assert not [x for x in media.sniff(data[: len(data) // 2]) if x[1] == 0]  # a cut file is none
    broken = bytearray(image)
    broken[20] ^= 1
    assert media.sniff(bytes(broken)) == [] and media.sniff(b"") == [] and media.sniff(b"RIFF....JUNK GIF89a %PDF-") == []


def test_sniff_column(spark):
    df = spark.createDataFrame([("a", bytearray(png()), "image/png"), ("b", bytearray(b"xx" + png()), "image/png"), ("c", None, None), ("d", bytearray(media.to_wav(b"z")), "text/plain")], "id string, data binary, declared string").withColumn("parts", F.lit(1))
    got = {r.id: (r.media_type, r.corrected, [(p.type, p.offset) for p in r.parts]) for r in media.sniff_column(df, "id", "data", "declared").collect()}
    assert got == {"a": ("image/png", False, [("image/png", 0)]), "b": (media.OTHER, True, [("image/png", 2)]), "c": (media.OTHER, True, []), "d": ("audio/wav", True, [("audio/wav", 0)])}


def test_media_round_trip(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        rows = rows_of(df)
        want = sorted((-1 if i is None else i, hashlib.sha256((p := (t or "").encode()) + bytes(-len(p) % 64 or (0 if p else 64))).hexdigest()) for i, t in rows)
        got = media.media_features(df, keep_media=True).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.payload_sha256) for r in got) == want
        for r in got:
            back = media.wav_samples(bytes(r.media))
            assert (len(back), zlib.crc32(back[-64:]), hashlib.sha256(back).hexdigest()) == (r.payload_bytes, r.tail_crc32, r.payload_sha256)
            assert (len(r.media), hashlib.sha256(r.media).hexdigest()) == (r.media_bytes, r.media_sha256) and r.payload_bytes % 64 == 0 and back[: r.n_bytes].rstrip(b"\0") == back.rstrip(b"\0")
    assert media.media_features(no_docs).count() == 0


def brute_tiling(item, doc, least):
    """Greedy string tiling by trying every pair of positions."""
    mi, md, covered = [False] * len(item), [False] * len(doc), 0
    while True:
        best = None
        for p in range(len(item)):
            for t in range(len(doc)):
                k = 0
                while p + k < len(item) and t + k < len(doc) and item[p + k] == doc[t + k] and not mi[p + k] and not md[t + k]:
                    k += 1
                if k >= least and (best is None or (-k, p, t) < best):
                    best = (-k, p, t)
        if best is None:
            return covered
        k, p, t = -best[0], *best[1:]
        mi[p : p + k], md[t : t + k] = [True] * k, [True] * k
        covered += k


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from("abc"), min_size=3, max_size=18), st.lists(st.sampled_from("abc"), max_size=24))
def test_tiling_against_brute_force(item, doc):
    for pairs in (1, 7, 1 << 20):
        seeds = decontaminate.Seeds([(1, " ".join(item).encode())], 3, pairs)
        got = seeds.coverage([w.encode() for w in doc])
        assert round((got[0][1] if got else 0) * len(item)) == brute_tiling(item, doc, 3)


@settings(max_examples=40, deadline=None)
@given(st.lists(st.sampled_from("ab"), min_size=3, max_size=6), st.lists(st.sampled_from("aab"), min_size=60, max_size=90))
def test_tiling_of_repetitive_texts_against_brute_force(item, doc):
    got = decontaminate.Seeds([(1, " ".join(item).encode())], 3, 16).coverage([w.encode() for w in doc])
    assert round((got[0][1] if got else 0) * len(item)) == brute_tiling(item, doc, 3)


def test_repetitive_text_takes_bounded_memory():
    import tracemalloc

    seeds = decontaminate.Seeds([(1, b"word " * 400), (2, b"a b " * 200), (3, b"other " * 30)], 5)
    words = [b"word"] * 200_000 + [b"a", b"b"] * 100_000
    tracemalloc.start()
    assert sorted(seeds.coverage(words)) == [(1, 1.0, 1), (2, 1.0, 1)]
    assert tracemalloc.get_traced_memory()[1] < 600 << 20  # all pairs of seeds and places would take some gigabytes
    tracemalloc.stop()


def test_items_under_a_seed():
    seeds = decontaminate.Seeds([(1, b"forty two"), (2, b"yes"), (3, b"")], 5)
    assert sorted(seeds.coverage([b"it", b"is", b"forty", b"two"])) == [(1, 1.0, 1)] and seeds.coverage([b"forty", b"and", b"two"]) == [] and seeds.coverage([b"yes"]) == [(2, 1.0, 1)]


def test_reordered_passage(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    words = item.split()
    moved = " ".join(words[10:] + ["filler", "words"] + words[:10])
    half = " ".join(words[:10]) + " and nothing else"
    bench = spark.createDataFrame([(3, item), (4, None), (5, "too short"), (None, item)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "Intro, " + item.upper() + "!", "x"), (2, moved, "x"), (3, half, "x"), (4, None, "x"), (None, moved, "x"), (1, "clean", "x")], "doc_id long, text string, coverage string")
    for size in (16 << 20, 60):
        got = sorted(((r.doc_id, r.item_id, round(r.coverage, 2), r.contaminated) for r in decontaminate.decontaminate(docs, bench, block_bytes=size).collect()), key=repr)
        assert got == sorted([(1, -1, 1.0, True), (2, -1, 1.0, True), (3, -1, 0.5, False), (4, None, 0.0, False), (None, -1, 1.0, True), (1, None, 0.0, False)], key=repr)
        kept = decontaminate.without_contaminated(docs, bench, block_bytes=size)
        assert kept.columns == docs.columns and sorted(r.text or "" for r in kept.collect()) == sorted(["", half, "clean"])
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate.decontaminate(docs.limit(0), bench).count() == 0


def base(text):
    found = []
    for kind, (name, rule) in enumerate([("assign", secrets.ASSIGN.pattern), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")]):
        for m in re.finditer(rule, text, re.I | re.A if kind == 0 else 0):
            if len(m[2] if kind == 0 else m[0]) >= (8, 16, 32)[kind]:
                found.append((m.start(), kind, f"{name}:{m.start()}:{m.end()}"))
    return [x[2] for x in sorted(found)]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["token", "=", ":", " ", "'", '"', "secret", "api_key", "APIKEY", "passſword", "abcdef01", "AKIA", "AKIAAAAAAAAAAAAAAA", "0" * 33, "short", "é", "K"]), max_size=10).map("".join))
def test_base_spans(text):
    assert [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e, _ in secrets.base_spans(text)] == base(text)


def test_secrets_on_tables(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        rows = rows_of(df)
        got = secrets.find_secrets(df).collect()
        key = lambda x: (repr(x[0]), x[1])
        lines = sorted(((r.doc_id, ",".join(f"{x.kind}:{x.start}:{x.end}" for x in r.spans if x.kind != "format"), (r.n_assign, r.n_access, r.n_hex)) for r in got), key=key)
        want = sorted(((i, ",".join(b), tuple(sum(x.startswith(k) for x in b) for k in ("assign", "access", "hex"))) for i, b in ((i, base(t or "")) for i, t in rows)), key=key)
        assert lines == want
    assert secrets.find_secrets(no_docs).count() == 0
    clean = secrets.redacted(odd_docs)
    assert clean.columns == odd_docs.columns and clean.count() == odd_docs.count()
    ten = clean.where("doc_id = 10").first()
    assert ten.text == '[REDACTED]" [REDACTED]' and ten.n_chars == len(ten.text) and clean.where("doc_id = 1").first().text is None


def test_inferred_format_finds_what_the_patterns_miss(spark):
    rng = np.random.default_rng(0)
    code = lambda n: "".join(rng.choice(list("0123456789abcdef"), n))
    rows = [(k, f"the usual words about nothing password={code(24)} and more ordinary text") for k in range(200)]
    rows += [(900, f"key {code(24)} here"), (901, "a-very-ordinary-hyphenated-word-of-2024 here"), (902, "International_Organisation_Of_2_Things")]
    got = {r.doc_id: [s.kind for s in r.spans] for r in secrets.find_secrets(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[900] == ["format"] and got[901] == [] and got[902] == [] and got[0] == ["assign"]


def test_recall_and_precision_of_inferred_formats(docs):
    """Held-back credentials of labelled formats, put into texts without a keyword; and ordinary tokens, which must stay."""
    rng = np.random.default_rng(2)
    code = lambda chars, n: "".join(rng.choice(list(chars), n))
    upper, hexes = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "0123456789abcdef"
    labelled = [("0", code(hexes, 40)) for _ in range(150)] + [("0", code(hexes, 12)) for _ in range(150)] + [("1", "AKIA" + code(upper, 16)) for _ in range(150)]
    words = sorted({w for r in docs.collect() for w in (r.text or "").split() if w.isalpha() and len(w) > 5})
    scanner = secrets.Scanner(secrets.grammars(labelled + [(secrets.PLAIN, w) for w in words[:300]]), 5.5, 0.75)
    hidden = [code(hexes, 40) for _ in range(100)] + [code(hexes, 12) for _ in range(100)] + ["ASIA" + code(upper, 16) for _ in range(50)]
    assert np.mean([any(k == 3 for _, k, _ in scanner.spans(f"see {x[:20]}x{x[20:]} there")) for x in hidden[:100]] + [scanner.likely(x) for x in hidden]) > 0.9
    ordinary = [c[2] for r in docs.collect() for c in secrets.candidates(r.text or "", secrets.base_spans(r.text or ""))]
    assert np.mean([scanner.likely(x) for x in ordinary] or [0]) < 0.05 and np.mean([scanner.likely(w) for w in words]) < 0.02


def test_candidates_beyond_base_spans():
    inner = "prefix" + "0123456789abcdef" * 2 + "TAIL9"
    text = f"{inner} password={'a1' * 10} {'ab12' * 10}"
    found = secrets.candidates(text, secrets.base_spans(text))
    assert [x[2] for x in found] == [inner]
    long = " ".join(["x1" * 5 + " token=" + "z9" * 6] * 20_000)  # time in proportion to the text
    assert len(secrets.candidates(long, secrets.base_spans(long))) == 20_000


def test_signatures_without_an_end_take_linear_time():
    import time

    began = time.time()
    assert media.sniff(b"%PDF-" * 400_000 + b"%%EOF") == []
    assert time.time() - began < 20
    pdf = b"%PDF-1.4 body startxref 0 %%EOF"
    assert media.sniff(b"%PDF- " + pdf)[:2] == [("application/pdf", 0, 6 + len(pdf)), ("application/pdf", 6, len(pdf))]


def test_streamed_archives():
    import io
    import zipfile

    class Pipe(io.RawIOBase):
        def __init__(self):
            self.data = b""

        def writable(self):
            return True

        def write(self, b):
            self.data += bytes(b)
            return len(b)

    pipe = Pipe()
    with zipfile.ZipFile(pipe, "w") as z:  # not seekable: sizes come after the data
        z.writestr("a.txt", "hello " * 50)
        z.writestr("b.txt", "there")
    assert pipe.data[6] & 8
    assert media.sniff(b"xx" + pipe.data + b"yy")[0] == ("application/zip", 2, len(pipe.data))


def test_merged_states_are_fewer_and_probabilities_sum_to_one():
    a = secrets.Automaton([f"ab{k:06d}" for k in range(300)])
    assert a.states < 60
    for s in range(len(a.count)):
        assert a.stop[s] + sum(n for _, n in a.edge[s].values()) == a.count[s]


def removed(rows, window):
    words = [(t or "").encode() for _, t in rows]
    words = [re.findall(rb"[^\x20\x09-\x0D]+", w) for w in words]
    seen = Counter(tuple(w[k : k + window]) for w in words for k in range(len(w) - window + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = set()
        for k in range(len(w) - window + 1):
            if seen[tuple(w[k : k + window])] > 1:
                gone.update(range(k, k + window))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((-1 if i is None else i, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize(("window", "run", "limit", "shard"), [(35, 12, 1024, 1 << 20), (35, 12, 1, 1 << 20), (35, 12, 3, 2000), (8, 4, 1024, 5000)])
def test_substrings_against_brute_force(docs, odd_docs, window, run, limit, shard):
    for df in (docs, odd_docs):
        got = substring.remove_repeats(df, window, run, minimizer_limit=limit, shard_words=shard).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(rows_of(df), window)


def test_substrings_edges(spark, no_docs):
    assert substring.remove_repeats(no_docs).count() == 0
    shared, loop = " ".join(f"s{k}" for k in range(40)), " ".join(["a"] * 50)
    rows = [(1, loop), (2, "a b"), (3, f"x y {shared} z"), (4, f"{shared} {loop}")]
    df = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_text=True, keep_spans=True)
    got = {r.doc_id: (r.n_removed, r.kept, [(x.start, x.end) for x in r.spans]) for r in df.collect()}
    assert got == {1: (50, "", [(0, 50)]), 2: (0, "a b", []), 3: (40, "x y z", [(2, 42)]), 4: (90, "", [(0, 90)])}


def test_repeated_rows_take_time_in_proportion(spark):
    text = " ".join(f"w{k}" for k in range(300))
    same = [(1, text)] * 200 + [(None, text + " tail")] * 200 + [(2, "some other words")]
    for rows in (same, same[:1] + same[-1:]):
        got = substring.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in got) == removed(rows, 35)


words_lists = st.lists(st.lists(st.integers(0, 3), min_size=4, max_size=12), min_size=1, max_size=6)


@settings(max_examples=60, deadline=None)
@given(words_lists, st.integers(1, 5), st.randoms())
def test_matching_statistics_against_brute_force(parts, least, rng):
    times = [rng.choice([1, 1, 2]) for _ in parts]
    seen = Counter()
    for p, t in zip(parts, times, strict=True):
        for k in range(len(p)):
            for e in range(k + 1, len(p) + 1):
                seen[tuple(p[k:e])] += t
    want = set()
    for i, p in enumerate(parts):
        for k in range(len(p)):
            n = max([e - k for e in range(k + 1, len(p) + 1) if seen[tuple(p[k:e])] > 1], default=0)
            if n >= least:
                want.add((i, k, n))
    got = substring.FMIndex([np.array(p, np.uint64) for p in parts], np.array(times)).repeats(least)
    assert set(zip(*(x.tolist() for x in got), strict=True)) == want


def ids_of(text):
    t = packing.word_ids(packing.default_tokenizer()).tokenizer
    return t.encode(text or "", add_special_tokens=False).ids + [1]


def packed_well(got, rows, capacity):
    want = Counter()
    for i, t in rows:
        ids = ids_of(t)
        for k in range(0, len(ids), capacity):
            part = ids[k : k + capacity]
            want[i, k // capacity, k, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    bins = {}
    for r in got:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins), sum(r.length for r in got) / capacity


def test_packing(docs, odd_docs, no_docs):
    n, bound = packed_well(packing.pack(docs).collect(), rows_of(docs), 4096)
    assert n <= bound * 1.005 + 1
    packed_well(packing.pack(odd_docs, capacity=64, block_pieces=100).collect(), rows_of(odd_docs), 64)
    assert packing.pack(no_docs).count() == 0
    lines = packing.sequences(packing.pack(odd_docs, keep_ids=True)).collect()
    assert all(len(r.ids) == 4 * r.length <= 4 * 4096 for r in lines)
    assert Counter(np.concatenate([np.frombuffer(r.ids, "<u4") for r in lines]).tolist()) == Counter(k for _, t in rows_of(odd_docs) for k in ids_of(t))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(list("abXY019'.,!? \t\n\x0b\x1c\x85\xa0\xadßäÉµ²½ª×İœΣ\u0301\u2003中<|>") + ["'s", "'LL", "don't", "<|endoftext|>"]), max_size=12).map("".join))
def test_word_ids_equal_the_tokenizer(text):
    got = np.frombuffer(packing.word_ids(packing.default_tokenizer()).of(text.encode(), 1), "<u4").tolist()
    assert got == ids_of(text)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 50), min_size=2, max_size=60), st.integers(0, 1000))
def test_genetic_steps_keep_every_piece(sizes, seed):
    sizes, rng = np.array(sizes), np.random.default_rng(seed)
    first, filled = packing.evolve(sizes, [], 50, 0, 2, rng), packing.evolve(sizes, [], 50, 0, 2, rng, packing.fill)
    for bins in (first, filled, packing.crossover(sizes, first, packing.evolve(sizes, [], 50, 3, 3, rng), 50, rng), packing.crossover(sizes, filled, first, 50, rng)):
        assert (bins >= 0).all() and (np.bincount(bins, sizes) <= 50).all()


def test_evolution_beats_best_fit(spark):
    rng = np.random.default_rng(9)
    for low, high, least in ((1100, 1600, 0.07), (700, 1500, 0.02)):
        sizes = rng.integers(low, high, 2000)
        best_fit = packing.place(sizes, np.full(2000, -1), np.argsort(-sizes, kind="stable"), 4096).max() + 1
        evolved = packing.evolve(sizes, [], 4096, 24, 8, np.random.default_rng(1)).max() + 1
        assert evolved <= best_fit * (1 - least)
        dealt = spark.createDataFrame([(k % 2, k, int(x)) for k, x in enumerate(sizes)], "block long, item long, length long")
        found = packing.islands(dealt, 4096, 4, 2, 16, 8).toPandas()
        assert sorted(found["item"]) == list(range(2000))
        assert found.groupby(["block", "bin"])["length"].sum().max() <= 4096
        assert len(found.groupby(["block", "bin"])) <= best_fit * (1 - least)


def test_blocks_of_short_texts_fill_many_sequences(spark):
    got = packing.pack(spark.createDataFrame([(k, None) for k in range(3000)], "doc_id long, text string"), capacity=64, block_pieces=100).collect()
    assert len({r.sequence_id for r in got}) == -(-3000 // 64)


def test_sharding(docs, odd_docs, no_docs):
    for df in (docs, odd_docs):
        rows = df.select("doc_id", "text", "source").collect()
        got = sharding.interleave(df).collect()
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in got) == Counter((r.doc_id, len((r.text or "").encode()) + 8, zlib.crc32((r.text or "").encode())) for r in rows)
        sizes = Counter(r.shard for r in got)
        assert set(sizes) <= set(range(24)) and max(sizes.values()) - (min(sizes.values()) if len(sizes) == 24 else 0) <= 1
        for s in sizes:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sizes[s]))
        mix = Counter((r.source, r.shard) for r in got)
        total = Counter(r.source for r in got)
        assert all(abs(mix[k, s] - total[k] / 24) <= 2 for k in total for s in range(24))
    assert sharding.interleave(no_docs).count() == 0
    few, many = (sorted(sharding.interleave(odd_docs, slices=n).collect(), key=repr) for n in (1, 4096))
    assert few == many


def test_sharding_follows_the_seed(docs):
    a, b = ({r.doc_id: (r.shard, r.slot) for r in sharding.interleave(docs.repartition(n), seed=s).collect()} for n, s in ((3, "0"), (5, "0")))
    assert a == b != {r.doc_id: (r.shard, r.slot) for r in sharding.interleave(docs, seed="1").collect()}


def fm_free_stage_two(rows):
    """Brute force: of the classes of five-word-shingle similarity 0.8 the smallest id."""
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", t.translate({c: c + 32 for c in range(65, 91)}))
        return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()

    sets = [(i, shingles(t)) for i, t in sorted(rows.items())]
    root = {i: i for i, _ in sets}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if root[i] != root[j] and (a == b or (both and both / (len(a) + len(b) - both) >= 0.8)):
                x, y = root[i], root[j]
                root = {n: min(x, y) if r in (x, y) else r for n, r in root.items()}
    return {i: rows[i] for i, r in root.items() if i == r}


def test_pipeline(spark, sf_dir):
    """Stage by stage: the learnt scores are the operators' own; near copies, contamination, base secrets and tokens are brute force."""
    import corpus_pipeline

    from packetloom.llm import common, toxicity

    docs = common.documents(spark, sf_dir)
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    bad = {r.doc_id for r in toxicity.toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("predicted = 1").collect()}
    left = fm_free_stage_two({i: t for i, t in texts.items() if i not in bad})
    items = [decontaminate.tokens(r.text.encode()) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    grams = lambda w: {tuple(w[k : k + 5]) for k in range(len(w) - 4)}
    item_grams = [grams(x) for x in items]

    def leaked(text):
        words = decontaminate.tokens(text.encode())
        own = grams(words)
        return any(own & g and sum(1 for _ in own & g) >= 0.5 * len(g) and brute_tiling(x, words, 5) >= 0.8 * len(x) for x, g in zip(items, item_grams, strict=True))

    kept = {i: t for i, t in left.items() if not leaked(t)}
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in got} == set(kept)
    whole = Counter(r.doc_id for r in got)
    crc = lambda t: zlib.crc32(np.array(ids_of(t), "<u4").tobytes())
    seen = {r.doc_id: r.ids_crc32 for r in got if whole[r.doc_id] == 1}
    for i, n in seen.items():
        base_spans = [(s, e) for s, _, e, _ in secrets.base_spans(kept[i])]
        if base_spans or not secrets.candidates(kept[i], []):
            assert n == crc(secrets.redact(kept[i], base_spans)), i
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
