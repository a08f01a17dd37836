"""Corpus operators against brute force, exact round trips and held-out labels, and their edge cases."""

import hashlib
import importlib.util
import re
import zlib
from collections import Counter, defaultdict
from html import unescape

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

from podium.llm import embed_dedup, html, lines, packing, sharding, simhash, topk, toxicity, urls, words
from podium.llm import bpe

DOCS = "doc_id long, text string, id string, word long, fp string, key string, block string"
ODD = [
    (1, None, "a", 1, None, "k", "b"), (2, "", "a", None, "x", None, "b"), (3, "Hello big wide world\nhello big wide world", None, 1, "x", "k", None),
    (4, "Hello big wide world", "a", 1, "x", "k", "b"), (4, "Hello big wide world", "a", 1, "x", "k", "b"), (None, "lonely words stand here", "a", 1, "x", "k", "b"),
    (5, "word " * 6000, "a", 1, "x", "k", "b"), (6, "a\x1cb İSTΣ it's x<|endoftext|>Y 12 日本語\u2028z", "a", 1, "x", "k", "b"), (7, " \t\n ", "a", 1, "x", "k", "b"),
]


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


# --- URL filters

RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def plain_rule(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
    path = rest[cut:]
    path = path[: min([path.find(c) for c in "?#" if c in path] or [len(path)])]
    fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, None))
    return host, path, best[1], best[2]


def test_url_rules_and_method(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(9001, None, None), (9002, "no scheme", ""), (9003, "HTTP://WWW.Example.COM/en/x?q#f", "<a href='//bad.net/es/'>"), (9004, "x://net", None), (9005, "a://b.net/es/1://c", None), (9005, "a://b.net/es/1://c", None), (None, "http://q.com?x/", None)], "page_id long, url string, html string")
    all_ = pages.unionByName(extra).withColumn("host", F.lit("clash"))
    got = urls.judge(all_).collect()
    want = Counter((r.page_id, *plain_rule(r.url)[:3]) for r in all_.collect())
    assert Counter((r.page_id, r.host, r.path, r.rule) for r in got) == want
    assert all(r.verdict == plain_rule("x://" + r.host + r.path)[3] for r in got if r.rule)
    assert urls.judge(all_.where("false")).count() == 0


def test_trust_and_distrust_follow_links(spark):
    links = [("a", "bad", 1), ("a", "ok", 1), ("b", "a", 3), ("ok", "b", 1)]
    hosts = sorted({h for x in links for h in x[:2]})
    seed = np.array([1.0 if h == "bad" else 0.0 for h in hosts])
    back = spark.createDataFrame([(d, s, n) for s, d, n in links], "src string, dst string, n long")
    raw = np.zeros((4, 4))
    for s, d, n in links:
        raw[hosts.index(s), hosts.index(d)] = n
    mb = raw / np.maximum(raw.sum(0), 1)
    r = seed.copy()
    for _ in range(8):
        r = seed + 0.85 * mb @ r
    got = {x.host: x.score for x in urls.propagate(spark.createDataFrame([("bad", 1.0)], "host string, seed double"), back, rounds=8, settled=1e-9).collect()}
    assert all(got.get(h, 0) == pytest.approx(r[i], abs=1e-4) for i, h in enumerate(hosts))


def plain_verdicts(pages, damping=urls.DAMPING, rounds=urls.ROUNDS):
    """Verdict by page, with dense matrices and the cut tried at every margin."""
    judged = [(*plain_rule(u), h or "") for u, h in pages]
    hosts = sorted({j[0] for j in judged if j[0]})
    at = {h: i for i, h in enumerate(hosts)}
    n, a, b = (np.zeros(len(hosts)) for _ in range(3))
    link = np.zeros((len(hosts), len(hosts)))
    for host, _, _, verdict, html in judged:
        if host:
            n[at[host]] += 1
            a[at[host]] += verdict == "allow"
            b[at[host]] += verdict == "block"
            for to in html.split("http://")[1:]:
                to = to.split('"')[0].split("/")[0]
                if to in at and to != host:
                    link[at[host], at[to]] += 1

    def spread(seed, m):
        m = m / np.maximum(m.sum(1, keepdims=True), 1)
        s = seed.copy()
        for _ in range(rounds):
            s = seed + damping * m.T @ s
        return s

    t, d = spread(a / n, link), spread(b / n, link.T)
    margin = lambda t, d: (d - t) / np.maximum(1, d + t)
    o = np.maximum(n - 1, 1)
    bm = margin(t - a / n + a / o, d - b / n + (b - 1) / o)
    am = margin(t - a / n + (a - 1) / o, d - b / n + b / o)
    marks = sorted({*bm[b > 0], *am[a > 0], 2.0})
    score = lambda c: (a[(a > 0) & (am <= c)].sum() / a.sum()) + (b[(b > 0) & (bm > c)].sum() / b.sum())
    best = max(score(c) for c in marks[:-1])
    low, high = [(c, e) for c, e in zip(marks, marks[1:]) if score(c) > best - 1e-9][-1]
    m = margin(t, d)
    return [(j[3] or ("block" if j[0] and m[at[j[0]]] > (low + high) / 2 else "allow"), t[at[j[0]]] if j[0] else 0, d[at[j[0]]] if j[0] else 0) for j in judged]


def test_verdicts_follow_the_links_between_hosts(spark):
    to = lambda *hosts: "".join(f'<a href="http://{h}/">x</a>' for h in hosts)
    pages = [
        ("http://a.com/1", to("b.org", "c.org")), ("http://a.com/2", to("b.org")), ("http://d.com/x", to("c.org", "a.com")), ("http://d.com/y", ""),
        ("http://bad.net/es/1", to("worse.net")), ("http://bad.net/es/2", ""), ("http://bad.net/en/3", ""), ("http://worse.net/fr/1", to("bad.net")), ("http://worse.net/fr/2", to("farm.org")),
        ("http://farm.org/1", to("bad.net", "worse.net")), ("http://farm.org/2", to("bad.net")), ("http://b.org/1", to("c.org")), ("http://c.org/1", to("b.org", "d.com")),
        ("http://lone.org/1", "<!-- " + to("bad.net") + " --><script>" + to("worse.net").replace("http", "ftp") + "</script>"), ("no url", to("bad.net")), (None, None),
    ]
    df = spark.createDataFrame([(i, u, h) for i, (u, h) in enumerate(pages)], "page_id long, url string, html string")
    want = plain_verdicts([(u, "" if u and "lone" in u else h) for u, h in pages])
    got = {r.page_id: r for r in urls.judge(df).collect()}
    assert [got[i].verdict for i in range(len(pages))] == [w[0] for w in want]
    assert [got[i].trust for i in range(len(pages))] == pytest.approx([w[1] for w in want], abs=2e-3)
    assert [got[i].distrust for i in range(len(pages))] == pytest.approx([w[2] for w in want], abs=2e-3)
    verdict = {u: got[i].verdict for i, (u, _) in enumerate(pages)}
    # pages without a rule: the link farm and the blocked host's own go, hosts that trusted ones link to stay
    assert verdict["http://farm.org/1"] == verdict["http://bad.net/en/3"] == "block"
    assert verdict["http://b.org/1"] == verdict["http://c.org/1"] == verdict["http://lone.org/1"] == verdict["no url"] == "allow"


# --- packing

def check_packing(rows, capacity=2048):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= capacity
    return len(by)


def test_packing_of_documents(docs, odd):
    for df in (docs, odd):
        rows = packing.packed_documents(df).collect()
        n = check_packing(rows)
        total = sum(r.length for r in rows)
        assert n <= -(-total // 2048) * 1.02 + 1
        tok, want = words.tokenizer(words.default_path()), Counter()
        for r in df.select("doc_id", "text").collect():
            ids = np.array([*tok.encode(r.text or "", add_special_tokens=False).ids, 0], "<u4")
            want.update((r.doc_id, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
        assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    assert packing.packed_documents(docs.where("false")).count() == 0


def test_sequences_carry_their_ids(odd):
    packed = packing.packed_documents(odd, with_ids=True)
    total = packed.agg(F.sum("length")).first()[0]
    assert sum(len(r.ids) for r in packing.sequences(packed).collect()) == total


@pytest.mark.parametrize("seed", range(6))
def test_bin_completion_is_optimal_on_small_cases(seed):
    rng = np.random.default_rng(seed)
    cap, items = 20, rng.integers(1, 21, rng.integers(1, 11)).tolist()
    counts = np.bincount(items, minlength=cap + 1)
    patterns, _ = packing.bin_completion(counts)
    used = Counter()
    for p, t in patterns:
        assert sum(x * k for x, k in p.items()) <= cap
        used.update({x: k * t for x, k in p.items()})
    assert used == Counter(items)
    best = len(items)

    def search(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(items):
            best = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + items[i] <= cap:
                search(i + 1, [*bins[:j], bins[j] + items[i], *bins[j + 1 :]])
        search(i + 1, [*bins, items[i]])

    search(0, [])
    assert sum(t for _, t in patterns) == best
    assert packing.least_bins(counts) <= best


def fewest_bins(items, cap, most):
    """The least number of bins, or ``most``, by depth first search."""
    items = sorted(items, reverse=True)
    rest = np.append(np.cumsum(items[::-1])[::-1], 0)
    best = most

    def search(i, bins):
        nonlocal best
        if i == len(items):
            best = min(best, len(bins))
            return
        free = sum(cap - b for b in bins if cap - b >= items[-1])
        if len(bins) + max(0, -(-int(rest[i] - free) // cap)) >= best:
            return
        for b in sorted(set(bins), reverse=True):
            if b + items[i] <= cap:
                k = bins.index(b)
                search(i + 1, [*bins[:k], b + items[i], *bins[k + 1 :]])
        if len(bins) + 1 < best:
            search(i + 1, [*bins, items[i]])

    search(0, [])
    return best


@pytest.mark.parametrize("cap", [50, 100, 150])
def test_bin_completion_on_harder_cases(cap):
    rng = np.random.default_rng(cap)
    proved = better = 0
    for k in range(12):
        low, high = ((cap // 5, cap // 2), (cap // 4, cap // 2), (cap // 7, cap // 3))[k % 3]
        items = rng.integers(low, high + 1, 24).tolist()
        counts = np.bincount(items, minlength=cap + 1)
        patterns, optimal = packing.bin_completion(counts)
        used, greedy = Counter(), sum(t for _, t in packing.best_fit(counts))
        for p, t in patterns:
            assert sum(x * n for x, n in p.items()) <= cap
            used.update({x: n * t for x, n in p.items()})
        bins = sum(t for _, t in patterns)
        assert used == Counter(items) and bins <= greedy
        if optimal:
            assert bins == fewest_bins(items, cap, greedy)
        proved, better = proved + optimal, better + (bins < greedy)
    assert proved >= 10


# --- vectors

VECS = "vec_id long, embedding array<float>, label int, id string, v string"


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(0)
    base = rng.normal(size=(400, 16))
    near = base[:60] + rng.normal(size=(60, 16)) * 0.05
    x = np.concatenate([base, near, base[:20], near[:5] * 3])
    rows = [(i, [float(np.float32(c)) for c in v], 0, "c", "c") for i, v in enumerate(x)]
    rows += [(1000, None, 0, "", ""), (1001, [float("nan")] * 16, 0, "", ""), (1002, [0.0] * 16, 0, "", ""), (1003, [None] + [1.0] * 15, 0, "", ""), (1050, [1.0, 2.0], 0, "", ""), (1051, [1.0, 2.0], 0, "", ""), (None, [1.0] * 16, 0, "", ""), (1052, [], 0, "", ""), (1053, [float("inf")] * 16, 0, "", "")]
    return spark.createDataFrame(rows, VECS), x.astype(np.float32).astype(float)


def test_top_k_is_exact(vectors, spark):
    df, x = vectors
    got = defaultdict(list)
    for r in topk.top_k(df.unionByName(df.where("vec_id = 7"))).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    ints = np.floor(256 * np.concatenate((x, x[7:8]))).astype(np.int64)  # row 7 is there twice
    ids = np.append(np.arange(len(x)), 7)
    for q in range(0, len(x), 50):
        s = ints @ ints[q]
        want = [(int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s)) if i != q][:5]
        assert got[q] == want
    assert got[1050] == [(1051, 256 * 256 + 512 * 512)] and set(got) == {*range(0, len(x), 50), 1050}
    assert topk.top_k(df.where("false")).count() == 0
    assert topk.top_k(df.where("vec_id = 50")).count() == 0


def test_embedding_links(vectors):
    df, x = vectors
    got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
    u = x / np.linalg.norm(x, axis=1)[:, None]
    link = u @ u.T >= 0.95
    comp = np.arange(len(x))
    while True:
        new = np.array([comp[link[i]].min() for i in range(len(x))])
        if (new == comp).all():
            break
        comp = new
    assert [got[i].n_links for i in range(len(x))] == (link.sum(1) - 1).tolist()
    assert [got[i].component_id for i in range(len(x))] == comp.tolist()
    assert got[1051].component_id == 1050 and got[1051].n_links == 1 and not got[1051].kept
    for i in (1000, 1001, 1002, 1003, 1052, 1053):
        assert got[i].n_links == 0 and got[i].kept and got[i].component_id == i
    assert got[None].component_id is None and len(got) == df.count()
    assert embed_dedup.near_duplicates(df.where("false")).count() == 0


def test_no_embedding_link_is_lost_with_many_cells(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "PER_CELL", 16)
    monkeypatch.setattr(embed_dedup, "BLOCK", 32)
    rng = np.random.default_rng(5)
    base = rng.normal(size=(600, 64))
    x = np.concatenate([base, base[:200] + rng.normal(size=(200, 64)) * 0.28])
    u = x / np.linalg.norm(x, axis=1)[:, None]
    want = int((u @ u.T >= 0.95).sum()) - len(x)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    assert want > 100 and embed_dedup.near_duplicates(df).agg(F.sum("n_links")).first()[0] == want
    flat = rng.normal(size=(700, 2))  # in two dimensions most cells border on others
    u = flat / np.linalg.norm(flat, axis=1)[:, None]
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(flat)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in embed_dedup.near_duplicates(df).collect()}
    assert [got[i] for i in range(700)] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()


def test_vectors_that_share_an_id(spark):
    rows = [(50, [1.0, 0.0, 0.0]), (50, [1.0, 0.01, 0.0]), (7, [0.0, 0.0, 1.0]), (3, [0.0, 0.1, 1.0]), (100, [0.0, 1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = Counter((r.vec_id, r.n_links, r.component_id, r.kept) for r in embed_dedup.near_duplicates(df).collect())
    assert got == Counter({(50, 1, 50, True): 2, (7, 1, 3, False): 1, (3, 1, 3, True): 1, (100, 0, 100, True): 1})
    found = defaultdict(list)
    for r in topk.top_k(df).orderBy("query_id", "rank", "vec_id").collect():
        found[r.query_id].append((r["rank"], r.vec_id, r.score))
    # two queries of one id: each has all other rows, the other of its id included
    assert sorted(found[50]) == sorted([(1, 50, 65536), (2, 3, 0), (3, 7, 0), (4, 100, 0)] + [(1, 50, 65536), (2, 100, 512), (3, 3, 50), (4, 7, 0)])
    assert sorted(v for _, v, _ in found[100]) == [3, 7, 50, 50]


# --- BPE

def test_bpe_round_trip(docs, odd):
    tok = words.tokenizer(words.default_path())
    for df in (docs, odd):
        want = Counter()
        for r in df.select("doc_id", "text").collect():
            ids = tok.encode(r.text or "", add_special_tokens=False).ids
            want[(r.doc_id, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest())] += 1
        assert Counter(map(tuple, bpe.round_trip_digests(df).collect())) == want
    encoded = bpe.encode(odd)
    texts = Counter((r.doc_id, tok.decode(tok.encode(r.text or "", add_special_tokens=False).ids, skip_special_tokens=False)) for r in odd.collect())
    assert Counter(map(tuple, bpe.decode(encoded).collect())) == texts
    assert bpe.round_trip_digests(docs.where("false")).count() == 0


def test_word_parts_encode_as_words():
    tok, one = words.tokenizer(words.default_path()), words.PartEncoder(words.default_path())
    rng = np.random.default_rng(2)
    letters = [chr(i) for i in [*range(33, 0x250), 0x300, 0x3A3, 0x4E00, 0x1F600, 0x2160, 0xB2]]
    some = ["".join(rng.choice(letters, rng.integers(1, 8))) for _ in range(3000)] + ["it's", "<|endoftext|>", "a<|startoftext|>b", "İa", "x²", "½y", "\x7f"]
    for w in some:
        if words.words(w) == [w]:
            assert [i for p in words.parts(w) for i in one(p)] == tok.encode(w, add_special_tokens=False).ids, w


# --- HTML

def test_distinct_words_are_parted_all_at_once():
    rng = np.random.default_rng(3)
    letters = [chr(c) for c in range(1, 0x300) if not (9 <= c <= 13 or c in (32, 0x85, 0xA0))] + list("'<|aAzZ09ÉéßİσΣ漢😀") * 3
    made = ["".join(rng.choice(letters, rng.integers(1, 9))) for _ in range(5000)] + ["<|x|>", "don't", "A1b", "\x1f", "a<", "|b", "×Ã"]
    for some in (made, made[-7:], ["plain"], []):
        want = [list(words.parts(w)) for w in some]
        counts, found = words.parts_of_all(pa.array(["left out", *some], pa.large_string())[1:])
        assert counts.tolist() == [len(x) for x in want] and found.to_pylist() == [p for x in want for p in x]


def test_digests_of_more_words_than_are_joined_at_a_time(spark):
    texts = ["Some more words, " * 60_000, None, "été n°1 " * 150_000, "", "last"]
    tok, want = words.tokenizer(words.default_path()), []
    for i, t in enumerate(texts):
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sum(len((t or "").split()) for t in texts) > bpe.JOINED_WORDS
    assert sorted(map(tuple, bpe.round_trip_digests(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)).collect())) == want


def test_html_text():
    page = """<html><head><title>no</title><style>p{}</style></head><body><nav><ul><li><a href=1>Home</a></li></ul></nav><div class="ad">Buy.</div>
    <article><h1>A &amp; B</h1><p>un<b>bro</b>ken &lt;i&gt; 1 < 2<br>next<script>var t="</p>";</script></p><p>Tiny.</p><div class="comments"><p>first!</p></div></article>
    <aside><p>See also</p></aside><form><p>Mail</p></form><footer>&copy; us</footer></body></html>"""
    assert html.main_text(page) == "A & B unbroken <i> 1 < 2 next Tiny."
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x") == ""
    assert html.main_text("plain text only") == "plain text only"


_W = "the council met on monday to talk about the new bridge over the river and its cost"


@pytest.mark.parametrize("page, want", [
    (f"<h1>Berlin</h1><p>{_W}</p><footer><a href=1>a</a> <a href=2>b</a></footer>", f"Berlin {_W}"),
    (f"<div class='content with-sidebar'><article><h1>T</h1><p>{_W}</p></article></div>", f"T {_W}"),
    (f"<div class='post tags-list'><h1>T x</h1><p>{_W}</p></div>", f"T x {_W}"),
    (f"<div class='no-sidebar'><h1>T</h1><p>{_W}</p></div>", f"T {_W}"),
    (f"<div class=sidebar-left><main><h1>T</h1><p>{_W}</p></main><div class=sidebar><p>{_W}</p></div></div>", f"T {_W}"),
    (f"<article><h1>T</h1><p class='ad'>Buy now.</p><p>{_W}</p><p class=cookie>We use cookies.</p></article>", f"T {_W}"),
    (f"<body class='single sidebar'><form id=aspnet><div id=wrapper><h1>T</h1><p>{_W}</p></div></form>", f"T {_W}"),
    (f"<article><h1>T</h1><p>{_W}<div class=related><p>{_W}</p></div><p>End.</p><section id=comments><article><p>{_W}</p></article></section></article>", f"T {_W} End."),
    (f"<div style='display:none'><p>{_W}</p></div><p>Seen text.</p>", "Seen text."),
    (f"<div class=postComments><p>{_W}</p></div><div class=entry-content><p>{_W}</p></div>", _W),
    (f"<header class=masthead><p>Site</p><ul><li><a href=1>x</a></li></ul></header><div><h2>Title two</h2><p>{_W}</p><p>{_W} <a href=1>more of it</a></p></div><div id=footer><p>All rights</p></div>", f"Title two {_W} {_W} more of it"),
    (f"<div><h1>Title</h1><div><a href=1>Jane Doe</a></div><p>{_W}</p></div>", f"Title {_W}"),
    (f"<article><h1>T</h1><p>{_W}</p><h2>Sources</h2><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul></article>", f"T {_W} Sources one two"),
    (f"<div><p>{_W}</p></div><h3>Popular</h3><ul><li><a href=1>one</a></li><li><a href=2>two</a></li></ul>", _W),
    (f"<article><p>{_W}</p><p>{'long ' * 60_000}</p></article>", f"{_W} {'long ' * 59_999}long"),
])
def test_html_layouts(page, want):
    assert html.main_text(page) == want


def test_html_against_known_articles():
    """Articles of the test pages, cut out by their tags alone."""
    pages = pq.read_table("/root/testdata/sf0.01/pages.parquet")["html"].to_pylist()
    plain = lambda s: " ".join(unescape(re.sub(r"<[^>]*>", "", s.replace("<br>", " "))).split())
    for page in pages:
        inner = re.sub(r"<(script|style)\b.*?</\1>", "", re.search(r"<article>(.*?)</article>", page, re.S)[1], flags=re.S)
        assert html.main_text(page) == " ".join(p for p in map(plain, re.split(r"</?(?:p|h1|ul|li)\b[^>]*>", inner)) if p)


def test_html_extraction(spark, sf):
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    extra = spark.createDataFrame([(None, None, None), (7001, "u", "<p>long</p>" * 3000)], "page_id long, url string, html string")
    rows = html.extract(pages.unionByName(extra).withColumn("text", F.lit(1))).collect()
    assert len(rows) == pages.count() + 2 and all(r.n_chars == len(r.text) for r in rows)
    assert {r.page_id: r.n_chars for r in rows}[7001] == 3000 * 5 - 1
    assert html.extract(pages.where("false")).count() == 0


# --- SimHash

def plain_fingerprint(text):
    w = "".join(c.lower() if c.isascii() else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    sh = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs)) if hs else 0


def plain_groups(fps):
    comp = {f: f for f in fps}
    def find(f):
        while comp[f] != f:
            f = comp[f]
        return f
    keys = list(comp)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 4:
                comp[find(a)] = find(b)
    return {f: find(f) for f in keys}


def test_simhash_groups(docs, odd):
    for df in (docs, odd):
        rows = [(r.doc_id, plain_fingerprint(r.text)) for r in df.collect()]
        root = plain_groups({f for _, f in rows})
        least = {}
        for i, f in rows:
            least[root[f]] = min((x for x in (least.get(root[f]), i) if x is not None), default=None)
        got = Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash.simhash_groups(df).collect())
        assert got == Counter((i, f"{f:016x}", least[root[f]]) for i, f in rows)
    assert simhash.simhash_groups(docs.where("false")).count() == 0


def test_simhash_links_in_a_dense_ball(spark, monkeypatch):
    monkeypatch.setattr(simhash, "CHUNK", 2_000)
    rng = np.random.default_rng(3)
    center = int(rng.integers(1 << 62))
    fps = {center ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(0, 5), replace=False)) for _ in range(150)} | {int(x) for x in rng.integers(0, 1 << 62, 150)}
    signed = [f - (1 << 64) if f >= 1 << 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    edges = simhash.links(df, len(fps)).collect()
    assert all(((e.src ^ e.dst) & (1 << 64) - 1).bit_count() <= 4 for e in edges)
    root = plain_groups(fps)
    mine = {f: f for f in fps}
    def find(f):
        while mine[f] != f:
            f = mine[f]
        return f
    for e in edges:
        mine[find(e.src & (1 << 64) - 1)] = find(e.dst & (1 << 64) - 1)
    assert len({find(f) for f in fps}) == len(set(root.values()))


# --- lines

def plain_removed(rows):
    last, seen, first, gone = 1 << 63, [], set(), set()
    for i, k, s in sorted(((i if i is not None else last - 1, k, frozenset(l.lower().split())) for i, t in rows for k, l in enumerate((t or "").split("\n"))), key=lambda x: x[:2]):
        if s and (i, k) not in first:
            first.add((i, k))
            if any(len(s & o) >= 0.8 * len(s | o) - 1e-9 for o in seen if 0.8 * len(s) - 1e-9 <= len(o) <= len(s) / 0.8 + 1e-9):
                gone.add((i, k))
            seen.append(s)
    return gone


def test_line_dedup(docs, odd, monkeypatch):
    for short, hot in ((64, lines.HOT_WORD), (2, lines.HOT_WORD), (64, 16)):  # long lists, and hot words, too
        monkeypatch.setattr(lines, "SHORT_LIST", short)
        monkeypatch.setattr(lines, "HOT_WORD", hot)
        for df in (docs, odd):
            want = plain_removed([(r.doc_id, r.text) for r in df.collect()])
            assert {(r.id, r.line) for r in lines.removed_lines(df).collect()} == want
    out = {(r.doc_id, r.text) for r in lines.line_dedup(odd).collect()}
    assert (3, "Hello big wide world") in out and (4, "") in out and (1, None) in out and (7, " \t\n ") in out
    assert lines.line_dedup(odd).columns == odd.columns and lines.line_dedup(odd).count() == odd.count()
    assert lines.line_dedup(odd.where("false")).count() == 0


def test_lower_case_by_bytes(docs):
    letters = [chr(c) for c in range(1, 0x250)] + list("\u2019\u2014\u2082\u20ac\u2126\u2160\u24b6\u03a3\u03c3\u0130\u1e9e\u3042\u6f22\uac00\uff21\U0001f600\U00010400")
    rng = np.random.default_rng(4)
    some = [*letters, *("".join(rng.choice(letters[:0x100] if i % 2 else letters, 9)) for i in range(400)), None, "", *(r.text for r in docs.select("text").collect())]
    for column in (pa.array(some), pa.array(some)[3:], pa.array([None, ""], pa.string())):
        assert lines._lower(column).to_pylist() == [(t or "").lower() for t in column.to_pylist()]


def test_line_dedup_of_rows_that_share_an_id(spark):
    rows = [
        (1, "one fish two fish red fish\nkeep this line of one"), (None, "one fish two fish red fish\nalone in the first null row"),
        (None, "unique text of the second null row\nanother line that nobody repeats"), (None, "a third null row says this\nalone in the first null row"),
        (5, "five has its own first line\none fish two fish red fish"), (5, "other words stand at the start here\nand again in the second place"), (5, "five has its own first line\nlast words"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((r.doc_id or 99, r.text) for r in lines.line_dedup(df).collect())
    nulls = [t for i, t in got if i == 99]
    assert len(got) == 7 and (1, rows[0][1]) in got
    assert rows[2][1] in nulls and sum("alone in the first null row" in t for t in nulls) == 1 and not any("fish" in t for t in nulls)
    fives = [t for i, t in got if i == 5]
    assert rows[5][1] in fives and sum("five has its own first line" in t for t in fives) == 1 and not any("fish" in t for t in fives)
    assert sum("last words" in t for t in fives) == 1 and sum("says this" in t for t in nulls) == 1


@pytest.mark.parametrize("hot", [lines.HOT_WORD, 4])
def test_line_dedup_of_near_copies(spark, monkeypatch, hot):
    monkeypatch.setattr(lines, "SHORT_LIST", 4)
    monkeypatch.setattr(lines, "HOT_WORD", hot)
    rng = np.random.default_rng(4)
    base = [f"w{i}" for i in range(30)]
    rows = []
    for d in range(120):
        w = list(base)
        for at in rng.choice(30, rng.integers(0, 9), replace=False):
            w[at] = f"x{rng.integers(40)}"
        rows.append((d, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {(r.id, r.line) for r in lines.removed_lines(df).collect()} == plain_removed(rows)


# --- sharding

def test_shards(docs, odd):
    for df, law, n in ((docs, "bytes", 40), (docs, "rows", 7), (odd, "bytes", 3), (odd, "rows", 4)):
        rows = sharding.shards(df, n_shards=n, law=law).collect()
        want = Counter((r.doc_id, len((r.text or "").encode()) + 16, zlib.crc32((r.text or "").encode())) for r in df.collect())
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == want
        by = defaultdict(list)
        for r in rows:
            by[r.shard].append(r)
        assert all(sorted(r.slot for r in g) == list(range(len(g))) for g in by.values()) and set(by) <= set(range(n))
        if law == "rows":
            sizes = [len(by[i]) for i in range(n)]
            assert max(sizes) - min(sizes) <= 1
        else:
            total = sum(r["size"] for r in rows)
            largest = max(r["size"] for r in rows)
            assert max(sum(r["size"] for r in g) for g in by.values()) <= total / n * 1.02 + largest
    assert sharding.shards(docs.where("false")).count() == 0


def test_shards_split_a_group_of_copies(spark):
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.lit("the same text everywhere").alias("text"))
    sizes = [r["count"] for r in sharding.shards(df, n_shards=10).groupBy("shard").count().collect()]
    assert len(sizes) == 10 and max(sizes) <= 1.3 * 300


# --- toxicity

def test_toxicity_on_held_out_labels(spark):
    root = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{root}/documents.parquet"), spark.read.parquet(f"{root}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.toxic).mean() > 0.97
    assert got.predicted[got.toxic == 1].mean() > 0.85 and got.predicted[got.toxic == 0].mean() < 0.02
    assert ((got.score >= 0) & (got.score <= 1)).all()


def test_toxicity_edges(spark, odd):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(odd, none).collect()
    assert len(rows) == len(ODD) and all(r.predicted == 0 and r.score < 0.01 for r in rows)
    assert {r.doc_id: r.held_out for r in rows} == {i: (i is not None and zlib.crc32(str(i).encode()) % 3 == 1) for i in {x[0] for x in ODD}}
    assert toxicity.toxicity(odd.where("false"), none).count() == 0
    carried = toxicity.toxicity(odd, none, carry=True)
    assert carried.columns == [*odd.columns, "_score"] and carried.count() == len(ODD)


def test_non_negative_risk_is_never_negative():
    rng = np.random.default_rng(0)
    for _ in range(20):
        assert toxicity._risk_step(rng.normal(size=30) * 5, rng.normal(size=50) * 5, 0.4)[2] >= 0


# --- any columns, rows that share an id

def test_columns_of_any_name_are_carried(spark):
    names = ["key", "gone", "id", "text", "c0", "_score", "_text", "row", "at", "fp", "s", "doc_id"]
    df = spark.createDataFrame([("k", 1, "i", f"line {i} of many words here\nsame line in all of them", "c", 0.5, None, 7, 3, "f", "s", i) for i in range(4)], "key string, gone int, id string, text string, c0 string, _score double, _text string, row int, at int, fp string, s string, doc_id long")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (lines.line_dedup(df), simhash.without_near_copies(df)):
        assert out.columns == names and out.dtypes == df.dtypes and all(r.key == "k" and r.gone == 1 and r.at == 3 for r in out.collect())
    scored = toxicity.toxicity(df, none, carry=True)
    assert scored.columns == [*names, "_score_"] and all(r._score_ < 0.01 and r["_score"] == 0.5 for r in scored.collect())


def test_near_copies_of_rows_that_share_an_id(spark):
    a, b = "one two three four five six seven eight", "quite another text stands in this second row"
    df = spark.createDataFrame([(2, a), (1, a), (1, b), (1, b), (None, b), (None, "alone"), (3, None), (4, "")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in simhash.without_near_copies(df).collect())
    assert got == Counter([(1, a), (1, b), (None, "alone"), (3, None)])
    assert simhash.without_near_copies(df.where("false")).count() == 0
    with pytest.raises(ValueError, match="odd"):
        simhash.links(df, 1, 3)


def test_split_words_like_python():
    rng = np.random.default_rng(8)
    letters = [*"abé日", *" \t\n\x0b\x1c\x1f\x85\xa0\u1680\u2003\u2028\u202f\u205f\u3000\u200b\u2080", "\U0001f600"]
    for _ in range(200):
        texts = [None if rng.random() < 0.1 else "".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(rng.integers(0, 6))]
        column = pa.array(["x", *texts, "y"], pa.string()).slice(1, len(texts))
        for controls, plain in ((False, words.words), (True, lambda t: (t or "").split())):
            split = words.Split(column, controls)
            got = [split.word(i).decode() for i in range(len(split.starts))]
            assert got == [w for t in texts for w in plain(t)] and split.sizes.tolist() == [len(plain(t)) for t in texts]
            number, first, _ = split.distinct()
            assert [got[first[k]] for k in number] == got and len(first) == len(set(got))
    long = words.Split(pa.array(["w" * 5000 + " " + "w" * 5001 + " " + "w" * 5000]))
    assert long.distinct()[0].tolist() == [0, 1, 0]


# --- pipeline

@pytest.mark.skipif(importlib.util.find_spec("corpus_pipeline") is None, reason="no pipeline")
def test_pipeline_against_plain_stages(spark, sf, docs):
    import corpus_pipeline

    labels = spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    scores = {r.doc_id: r.score for r in toxicity.toxicity(docs, labels).collect()}
    kept = {i: r.text for i, r in rows.items() if scores[i] < 0.7}
    gone = plain_removed(list(kept.items()))
    kept = {i: None if t is None else "\n".join(l for k, l in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in kept.items()}
    fps = {i: plain_fingerprint(t) for i, t in kept.items()}
    root = plain_groups(set(fps.values()))
    least = {}
    for i in sorted(kept):
        least.setdefault(root[fps[i]], i)
    kept = {i: t for i, t in kept.items() if least[root[fps[i]]] == i}
    tok, want = words.tokenizer(words.default_path()), Counter()
    for i, t in kept.items():
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.update((i, k // 2048, zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048))
    got = corpus_pipeline.run(spark, sf).collect()
    assert Counter((r.doc_id, r.piece, r.ids_crc32) for r in got) == want
    check_packing(got)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line dedup", "simhash near-dedup", "best-fit packing"]


def test_near_copies_join_texts_without_sorting_at_any_size(spark):
    df = spark.createDataFrame([(i, f"text {i} of a few words that differ {i * 7}") for i in range(20)], "doc_id long, text string")
    plan = simhash.without_near_copies(df)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan and "BroadcastHashJoin" not in plan
