"""Language model, toxicity, URL filter."""

import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from packetloom.llm import suffix_tree, toxicity, urls

UPPER = {ord(a): ord(a) + 32 for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
words_of = lambda t: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(UPPER)) + ["\n"]


def held(i, mod, rest):
    return i is not None and zlib.crc32(str(i).encode()) % mod == rest


@pytest.mark.parametrize("share", [1e-6, 0.01])
def test_base_score(docs, odd_docs, share):
    for df in (docs, odd_docs):
        rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
        c = Counter(w for i, t in rows if not held(i, 7, 2) for w in words_of(t))
        n, v = sum(c.values()), len(c)
        want = sorted((-1 if i is None else i, len(w), sum(x in c for x in w), round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)) for i, w in ((i, words_of(t)) for i, t in rows))
        got = suffix_tree.score(df, token_share=share).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_tokens, r.n_known, round(r.base_score, 4)) for r in got) == want
        assert {r.train_tokens for r in got} == {n} and all(r.score < 0 and r.held_out == held(r.doc_id, 7, 2) for r in got)


def test_tree_against_brute_force():
    rng = np.random.default_rng(0)
    lines = [suffix_tree.line_of(bytes(rng.choice(list(b"ab c"), int(rng.integers(0, 60))).tolist())) for _ in range(60)]
    depth, counts = 3, Counter()
    for line in lines:
        t = bytes(depth - 1) + b"\n" + line
        counts.update(t[k - depth : k + 1] for k in range(depth, len(t)))
    w = suffix_tree.Windows(depth, most=50)
    w.add(lines)
    w.reduce()
    assert {int(k).to_bytes(depth + 1, "big"): int(n) for k, n in zip(w.keys[0], w.counts[0], strict=True)} == counts
    g = {}
    for t, n in counts.items():
        for k in range(depth + 1):
            g.setdefault(t[depth - k : depth], Counter())[t[depth]] += n
    kept = {h for h in g if not h or (sum(g[h].values()) >= 8 and zlib.crc32(h) % 3)}
    rows = [(len(h), int.from_bytes(h, "big"), s, n) for h in kept for s, n in g[h].items()]
    tree = suffix_tree.Tree.build(*map(np.array, zip(*rows, strict=True)), depth)

    def p(h, c):
        if not h:
            return (g[b""][c] + 1) / (sum(g[b""].values()) + 256)
        return (g[h][c] + len(g[h]) * p(h[1:], c)) / (sum(g[h].values()) + len(g[h])) if h in kept else p(h[1:], c)

    for chunk in (1, 7, 256):
        got = tree.scores(lines, chunk=chunk)
        for line, score in zip(lines, got, strict=True):
            t = bytes(depth - 1) + b"\n" + line
            assert math.isclose(score, sum(math.log10(p(t[k - depth : k], t[k])) for k in range(depth, len(t))), abs_tol=1e-3)


def test_next_symbols_sum_to_one(docs):
    lines = [suffix_tree.line_of((r.text or "").encode()) for r in docs.select("text").limit(20).collect()]
    w = suffix_tree.Windows(2)
    w.add(lines)
    w.reduce()
    key, n = w.keys[0], w.counts[0]
    low = suffix_tree.reduced(key & np.uint64(255), n)
    tree = suffix_tree.Tree.build(np.zeros(len(low[0]), int), np.zeros(len(low[0]), int), low[0].astype(int), low[1], 2)
    p = 10.0 ** tree.logp.astype(float)
    unseen = 256 - (p.shape[1] - 1)
    assert np.allclose(p[:, :-1].sum(axis=1) + unseen * p[:, -1], 1, atol=1e-5)


def test_model_beats_word_counts_on_held_out_texts(spark, sf_dir):
    d = sf_dir.replace("sf0.001", "sf0.1")
    got = suffix_tree.score(spark.read.parquet(f"{d}/documents.parquet")).where("held_out").toPandas()
    assert got.score.sum() > got.base_score.sum() and (got.score > got.base_score).mean() > 0.7


def test_contexts_do_not_vanish_as_the_corpus_grows(spark):
    rare, common = b"qu", b"th"
    seen = lambda t, n: (int.from_bytes(t, "big"), n)
    some = [seen(rare + b"i", 40), seen(common + b"e", 60), seen(b"aab", 50)]
    more = some[:1] + [seen(common + b"e", 60_000_000), seen(b"aab", 50_000_000)]
    for rows in (some, more):
        grams = spark.createDataFrame(rows, "gram long, n long")
        kept = {(r.size, r.context) for r in suffix_tree.contexts(grams, 2, 32, 16.0).collect()}
        assert (1, rare[1]) in kept


def test_parts_of_the_automaton_add_up(docs, odd_docs):
    for df in (docs, odd_docs):
        whole, split = (suffix_tree.score(df, table_bytes=b) for b in (1 << 30, 20_000))
        key = lambda r: (repr(r.doc_id), r.n_tokens, round(r.base_score, 6))
        a, b = (sorted(x.collect(), key=lambda r: (key(r), r.score)) for x in (whole, split))
        assert [key(r) for r in a] == [key(r) for r in b]
        assert all(math.isclose(x.score, y.score, rel_tol=1e-5, abs_tol=1e-4) for x, y in zip(a, b, strict=True))
    found = docs.sparkSession.createDataFrame([(1, k, 3, 40) for k in range(50)] + [(0, 0, 3, 99)], "size int, context long, symbol long, n long")
    assert len(suffix_tree.parts_of(found, 100)) > 3 and sum(suffix_tree.parts_of(found, 100), []) == list(range(50)) and len(suffix_tree.parts_of(found, 1 << 30)) == 1


def test_score_empty(no_docs):
    assert suffix_tree.score(no_docs).count() == 0


def test_no_training_rows(spark):
    held_id = next(i for i in range(100) if held(i, 7, 2))
    r = suffix_tree.score(spark.createDataFrame([(held_id, "a b")], "doc_id long, text string")).first()
    assert (r.train_tokens, r.n_known, r.base_score) == (0, 0, 0.0) and r.score < 0


def test_machine_learns_a_pair():
    rng = np.random.default_rng(1)
    terms = toxicity.Terms()
    fill = lambda: " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 20) % 300)
    texts, y = [], []
    for _ in range(3000):
        a, b = rng.random(2) < 0.5
        texts.append(fill() + " fool" * int(a) + " foreigners" * int(b))
        y.append(int(a and b))
    machine = toxicity.learn([terms.of(t) for t in texts], np.array(y), np.ones(len(y)))
    mean = lambda extra: np.mean([machine.score(terms.of(f"{fill()} {extra}")) for _ in range(50)])
    assert mean("fool foreigners") > 0.9 and max(mean("fool"), mean("foreigners"), mean("")) < 0.1
    assert (machine.v != 0).any()


def test_pairwise_term_against_brute_force():
    rng = np.random.default_rng(0)
    m = toxicity.Machine(0.3, rng.normal(size=1 << toxicity.BITS).astype(np.float32), rng.normal(size=(1 << toxicity.BITS, 3)).astype(np.float32))
    t = np.array([5, 77, 1234, 99999])
    z = 0.3 + sum(float(m.w[i]) for i in t) + sum(float(m.v[a] @ m.v[b]) for k, a in enumerate(t) for b in t[:k])
    assert math.isclose(m.score(t), 1 / (1 + math.exp(-z)), rel_tol=1e-4)


@pytest.mark.parametrize(("scale", "recall"), [("sf0.01", 0.9), ("sf0.1", 0.9)])
def test_held_out_toxicity(spark, sf_dir, scale, recall):
    """Of the held-out documents that hold a word typical of the toxic ones, by a count over all labels, which the machine never sees."""
    d = sf_dir.replace("sf0.001", scale)
    labels = spark.read.parquet(f"{d}/labels.parquet")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    rows = docs.join(labels, "doc_id").select("doc_id", "text", "toxic").collect()
    split = lambda t: set(t.lower().encode().translate(toxicity.TABLE).decode().split())
    seen = {y: Counter(w for r in rows if r.toxic == y for w in split(r.text)) for y in (0, 1)}
    typical = {w for w, n in seen[1].items() if n >= max(4, 0.03 * sum(r.toxic for r in rows)) and not seen[0][w]}
    marked = {r.doc_id for r in rows if len(typical & split(r.text)) >= 2}
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    plain = [r.doc_id for r in rows if not r.toxic and got[r.doc_id].held_out]
    toxic = [r.doc_id for r in rows if r.toxic and got[r.doc_id].held_out and r.doc_id in marked]
    assert np.mean([got[i].predicted for i in toxic]) >= recall and np.mean([got[i].predicted for i in plain]) < 0.01


def test_a_repeated_training_row_counts_once(spark):
    rows = [(k, "a fool " * (k % 2) + f"word{k}") for k in range(40)]
    rows += [(1, "a fool word1")] * 500 + [(1, "another text of that id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(40)], "doc_id long, toxic int")
    first = toxicity.fit(docs, labels, 100, "doc_id", "text")
    assert len(first.w) == 1 << toxicity.BITS and first.score(toxicity.Terms().of("fool")) > first.score(toxicity.Terms().of("word"))


def test_toxicity_edges(spark, odd_docs, no_docs, no_labels):
    got = toxicity.toxicity(odd_docs, no_labels).collect()
    assert len(got) == odd_docs.count() and {r.score for r in got} == {0.5}
    assert toxicity.toxicity(no_docs, no_labels).count() == 0
    one = spark.createDataFrame([(4, 1, None), (5, 1, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")
    assert {r.predicted for r in toxicity.toxicity(odd_docs, one).collect()} <= {0, 1}
    kept = toxicity.without_toxic(odd_docs, no_labels)
    assert kept.columns == odd_docs.columns and kept.count() == odd_docs.count()


def host_path(url):
    if url is None or "://" not in url:
        return "", ""
    m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S)
    return m[1].translate(UPPER), m[2]


def test_rules(spark, sf_dir):
    odd = [None, "", "no scheme", "http://COM/en/x", "http://a.com/en/", "http://acom/en/", "https://example.com/en/7?x", "https://x.example.com/en/71", "https://example.com/en/8", "http://net/de/", "http://a.example.net/de/85#f", "http://b.org/es", "http://b.org/es/", "a://b://c.org/es/", "x://h?/en/", "http://a.com:80/en/"]
    pages = [(r.page_id, r.url) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url").collect()]
    rows = pages + [(10_000 + k, u) for k, u in enumerate(odd)] + [(None, "http://a.com/en/"), (10_000, None)]
    got = urls.judge(spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, host string")).collect()
    seen = {}
    for i, u in rows:
        h, p = host_path(u)
        fits = [(len(rh + rp), rh + rp, kind) for kind, rh, rp in urls.RULES if (h == rh or h.endswith("." + rh)) and p.startswith(rp)]
        seen.setdefault(i, []).append((h, p, max(fits)[1:] if fits else (None, None)))
    assert len(got) == len(rows)
    for r in got:
        assert any((r.host, r.path, r.rule) == (h, p, rule) and r.verdict in ((kind,) if kind else ("allow", "block")) for h, p, (rule, kind) in seen[r.page_id]), r


def test_ratio_model():
    good, bad = [f"shop.example/item/{k}" for k in range(200)], [f"spam.example/win/{k}!!" for k in range(200)]
    m = urls.fit(good, bad)
    assert all(m.score(x) >= m.threshold for x in ("shop.example/item/999", "shop.example/item/a")) and m.score("spam.example/win/999!!") < m.threshold
    total = sum(math.exp(m.accepted.log_p("ite", chr(c))) for c in range(65536))
    assert math.isclose(total, 1, rel_tol=1e-6)
    assert urls.fit([], []).score("anything") == 0.0


def test_urls_empty(spark):
    assert urls.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0


def test_ratio_model_on_held_back_urls(spark, sf_dir):
    """Rules judge URLs; models learnt from half of those judged must agree with the rules on the other half."""
    d = sf_dir.replace("sf0.001", "sf0.1")
    rows = urls.judge(spark.read.parquet(f"{d}/pages.parquet")).where("rule is not null").select("page_id", "verdict").collect()
    url = {r.page_id: r.url for r in spark.read.parquet(f"{d}/pages.parquet").select("page_id", "url").collect()}
    by = {k: sorted({url[r.page_id] for r in rows if r.verdict == k}, key=lambda u: zlib.crc32(u.encode())) for k in ("allow", "block")}
    model = urls.fit(by["allow"][::2], by["block"][::2])
    right = [model.score(u) >= model.threshold for u in by["allow"][1::2]] + [model.score(u) < model.threshold for u in by["block"][1::2]]
    assert len(right) > 50 and np.mean(right) >= 0.9


def test_whole_urls_are_scored(spark):
    rows = [(k, f"http://example.com/en/7{k}?safe=yes") for k in range(60)] + [(100 + k, f"http://a.com/en/{k}?casino=win") for k in range(60)]
    rows += [(500, "http://other.info/x?casino=win"), (501, "http://other.info/x?safe=yes"), (502, None), (503, "no scheme"), (504, "http://a.com/en/" + "y" * 10_000)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[500].score < got[501].score and got[502].rule is None and got[503].host == "" and got[504].verdict == "block"
