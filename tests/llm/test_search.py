"""URL filter, ranked search and clustering against brute force, and on odd, repeated and empty rows."""

import collections
import hashlib
import math
import random
import re
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from spellwise.llm import clustering, common, lexical, urlfilter


# --- 11 ----------------------------------------------------------------------------------------------------------------
def parts_of(url):
    url = url or ""
    if "://" not in url:
        return "", ""
    rest = re.split(r"[?#]", url.split("://", 1)[1])[0]
    host, slash, path = rest.partition("/")
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), slash + path


def brute_filter(urls):
    """url -> host, path, rule, verdict, score."""
    out, labels = {}, {}
    for u in set(urls):
        host, path = parts_of(u)
        fits = [r for r in urlfilter.RULES if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        best = max(fits, key=lambda r: len(r[0] + r[1]), default=None)
        labels[u or ""] = best and best[2]
        out[u or ""] = (host, path, best and best[0] + best[1])
    held = {u for u in labels if hashlib.md5(u.encode()).hexdigest()[0] < urlfilter.HELD_OUT}
    grams = lambda u: [("\x02" * 4 + u + "\x03")[i : i + 5] for i in range(len(u) + 1)]
    counts = {what: collections.Counter(g[k:] for u in labels if labels[u] == what and u not in held for g in grams(u) for k in range(5)) for what in ("allow", "block")}
    alphabet = {g[-1] for u in labels for g in grams(u)}
    follow = {what: collections.defaultdict(dict) for what in counts}
    for what, c in counts.items():
        for g, n in c.items():
            follow[what][g[:-1]][g[-1]] = n

    def chance(what, gram):
        p = 1 / (len(alphabet) + 1)
        for k in range(4, -1, -1):
            seen = follow[what].get(gram[k:-1], {})
            if seen:
                n, kinds = sum(seen.values()), len(seen)
                p = (seen.get(gram[-1], 0) + kinds * p) / (n + kinds)
        return p

    models = all(any(labels[u] == what and u not in held for u in labels) for what in counts)
    score = {u: sum(math.log(chance("allow", g)) - math.log(chance("block", g)) for g in grams(u)) / (len(u) + 1) for u in labels} if models else {}
    bins = [SimpleNamespace(bin=math.floor(round(score[u], 6) * urlfilter.STEPS), good=labels[u] == "allow", bad=labels[u] == "block") for u in labels if models and labels[u] and u in held]
    good, bad = sum(b.good for b in bins), sum(b.bad for b in bins)
    least = 0
    if good and bad:
        steps = range(min(b.bin for b in bins), max(b.bin for b in bins) + 2)
        least = max(steps, key=lambda s: (sum(b.bad for b in bins if b.bin < s) * good + sum(b.good for b in bins if b.bin >= s) * bad, -abs(s), -s)) / urlfilter.STEPS
    for u, label in labels.items():
        verdict = label or ("allow" if not models or round(score[u], 6) >= least else "block")
        out[u] += (verdict, None if label or not models else round(score[u], 6))
    return out


URLS = [
    None, "", "no scheme", "http://", "https://Example.NET/en/x?q#f", "http://example.net/en", "http://anexample.net/en/", "http://a.b.example.net?x=/en/", "ftp://x://y.org/fr/z",
    "http://example.com/de/1", "http://EXAMPLE.com/DE/1", "http://shop.example.com/de/2", "http://org/fr/", "http://a.org/fr/ü\U0001f600", "http://a.org/frx", "x://Ünet/", "http://a.net", "http://a.net/\n1", "http://q.com/" + "ab/" * 20_000,
]


@pytest.fixture
def urls():
    rnd = random.Random(5)
    word = lambda n: "".join(rnd.choice("abcdefgh") for _ in range(n))
    made = [f"http{rnd.choice(['', 's'])}://{word(4)}.example.{rnd.choice(['com', 'net', 'org'])}/{rnd.choice(['en', 'de', 'fr'])}/{rnd.choice(['buy-', ''])}{word(5)}" for _ in range(300)]
    return URLS + made + made[:40] + [made[0]] * 500


@pytest.mark.parametrize("hot", [1000, 3])
def test_url_filter_against_brute_force(spark, urls, monkeypatch, hot):
    monkeypatch.setattr(urlfilter, "HOT", hot)
    pages = spark.createDataFrame([(i if i else None, u, "x", 1.0, "h", "k") for i, u in enumerate(urls)], "page_id long, url string, html string, score double, host string, `key` string").repartition(3)
    got = {r.page_id or 0: r for r in urlfilter.url_filter(pages).collect()}
    expected = brute_filter(urls)
    assert len(got) == len(urls)
    for i, u in enumerate(urls):
        host, path, rule, verdict, score = expected[u or ""]
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == (host, path, rule, verdict), u
        assert got[i].score is score is None or got[i].score == pytest.approx(score, abs=2e-6), u
    assert {expected[u][3] for u in expected if expected[u][2] is None} == {"allow", "block"}


def test_url_filter_without_models_or_rows(spark):
    pages = spark.createDataFrame([(1, "http://a.com/x"), (1, "http://a.com/x"), (None, None), (2, "http://b.net/")], "page_id long, url string")
    rows = sorted((r.page_id or 0, r.rule, r.verdict, r.score) for r in urlfilter.url_filter(pages).collect())
    assert rows == [(0, None, "allow", None), (1, None, "allow", None), (1, None, "allow", None), (2, "net/", "block", None)]
    assert urlfilter.url_filter(pages.where("false")).count() == 0


def test_url_filter_has_no_python_worker(spark, urls):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    plan = urlfilter.url_filter(pages)._jdf.queryExecution().toString()
    assert not any(w in plan for w in ("Python", "MapInArrow", "MapInPandas", "FlatMapGroups"))


# --- 12 ----------------------------------------------------------------------------------------------------------------
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute_search(docs, items, k):
    counts = [(i, collections.Counter(terms_of(t))) for i, t in docs]
    total, n = sum(sum(c.values()) for _, c in counts), sum(bool(c) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 100 - 25 + (25 * sum(c.values()) * n) // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms_of(text) if c[t])
            if s > 0:
                scored.append((-s, i is None, i or 0, i))
        out += [(item, r + 1, s[3], -s[0]) for r, s in enumerate(sorted(scored)[:k])]
    return out


@pytest.fixture
def corpus():
    rnd = random.Random(11)
    words = [f"w{int(rnd.paretovariate(0.6))}" for _ in range(400)] + ["Ünï", "日本", "É", "A1b"]
    docs = [(i, rnd.choice([" ", "-", ", "]).join(rnd.choice(words) for _ in range(rnd.choice([1, 5, 60, 400])))) for i in range(1500)]
    docs += [(None, docs[3][1]), (3, docs[3][1]), (2000, None), (2001, ""), (2002, " .,\n"), (2003, "w1 " * 200_000 + "rare")] + [(3000 + i, docs[7][1]) for i in range(60)]
    items = [(j, " ".join(rnd.choice(words) for _ in range(rnd.choice([1, 3, 30])))) for j in range(40)]
    return docs, items + [(100, None), (101, ""), (102, "nowhere"), (103, docs[7][1]), (104, "RARE w1 w1"), (None, "日本"), (105, "日本"), (105, "日本")]


@pytest.mark.parametrize("block", [500_000, 60])
def test_search_against_brute_force(spark, corpus, monkeypatch, block):
    docs, items = corpus
    monkeypatch.setattr(lexical, "BLOCK_TERMS", block)
    d = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, terms int, score string").repartition(3)
    q = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    key = lambda r: (r[0] is None, r[0] or 0, r[1])
    got = sorted((tuple(r) for r in lexical.ranked_search(d, q, k=20).collect()), key=key)
    assert got == sorted(brute_search(docs, list(dict.fromkeys(items)), 20), key=key)


def shards_of(texts, size):
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.large_string())], names=["doc_id", "text"])
    return [next(lexical._indexed(iter([batch.slice(a, size)]))) for a in range(0, len(texts), size)]


def test_max_score_leaves_postings_out(corpus):
    """Given the best scores of earlier shards, non-essential terms add no candidates, and results do not change."""
    texts, items = [t for _, t in corpus[0][:1500]], corpus[1]
    whole = shards_of(texts, 1500)[0]
    n, total = whole.column("n_docs")[0].as_py(), whole.column("n_terms")[0].as_py()
    terms = np.unique(np.concatenate([lexical.term_counts(np.frombuffer((t or "").encode(), np.uint8), np.array([0, len((t or "").encode())]))[1] for _, t in items]))
    row = {c: whole.column(c)[0].values.to_numpy() for c in ("ids", "lengths", "terms", "starts", "docs", "tfs")}
    shard = lexical.Shard(row, terms, n, total)
    weights = np.full(len(terms), 700)
    every = np.arange(len(terms))
    all_docs, all_scores = shard.search(every, weights, 1)
    least = int(np.sort(all_scores)[-20])
    docs, scores = shard.search(every, weights, least)
    assert sorted(zip(docs, scores, strict=True)) == sorted((d, s) for d, s in zip(all_docs, all_scores, strict=True) if s >= least)
    bounds = np.sort(weights * shard.most)[::-1]
    rest = np.append(np.cumsum(bounds[::-1])[::-1], 0)
    assert (rest >= least).sum() < (bounds > 0).sum()  # some terms were not essential


def test_search_of_nothing(spark, corpus):
    d = spark.createDataFrame(corpus[0][:5], "doc_id long, text string")
    q = spark.createDataFrame([(1, "w1")], "item_id long, text string")
    assert lexical.ranked_search(d.where("false"), q).count() == 0
    assert lexical.ranked_search(d, q.where("false")).count() == 0
    assert lexical.ranked_search(d.withColumn("text", F.lit(None).cast("string")), q).count() == 0


def test_lengths_beyond_64_bits():
    shard = shards_of(["a a a b"], 1)[0]
    row = {c: shard.column(c)[0].values.to_numpy() for c in ("ids", "lengths", "terms", "starts", "docs", "tfs")}
    n, total = 10**18, 10**19
    found = lexical.Shard(row, np.sort(row["terms"]), n, total)
    m = 75 + 25 * 4 * n // total
    assert sorted(found.impacts.tolist()) == sorted(10**9 * tf // (1000 * tf + 12 * m) for tf in (3, 1))


@pytest.mark.parametrize("row_bytes, most", [(4 << 20, 4), (None, 1)])
def test_row_groups_hold_few_large_rows(spark, row_bytes, most):
    """Spark reads and writes a row group at once, so shards of one task may not share one (None: the index itself)."""
    d = spark.range(6 * lexical.SHARD_DOCS).selectExpr("id AS doc_id", "concat('w', id % 50) AS text").coalesce(1)
    shards = common.written(lexical.index(d).coalesce(1), row_bytes) if row_bytes else lexical.index(d)
    files = [pq.ParquetFile(f.removeprefix("file://")).metadata for f in shards.inputFiles()]
    rows = [m.row_group(g).num_rows for m in files for g in range(m.num_row_groups)]
    assert sum(rows) == 6 and max(rows) <= most


# --- 13 ----------------------------------------------------------------------------------------------------------------
def brute_clusters(vectors, k=8, rounds=10):
    """Rows of (id, cluster, distance, inertia of the cluster, inertia, hash)."""
    kept = [(i, [math.floor(1024 * x) for x in v]) for i, v in vectors if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    start = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest(), r[1]))[:k]
    centroids = [v for _, v in start]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    nearest = lambda v: min((far(v, c), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, v in kept:
            groups[nearest(v)[1]].append(v)
        for j, own in groups.items():
            centroids[j] = [sum(c) // len(own) for c in zip(*own, strict=True)]
    found = [(i, *nearest(v)[::-1]) for i, v in kept]
    inertia = collections.Counter()
    for _, j, d in found:
        inertia[j] += d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, j, d, inertia[j], sum(inertia.values()), sha[j]) for i, j, d in found]


def test_clusters_against_brute_force(spark):
    rnd = random.Random(2)
    centres = [[rnd.gauss(0, 1) for _ in range(64)] for _ in range(5)]
    vectors = [(i, [c + rnd.gauss(0, 0.1) for c in rnd.choice(centres)]) for i in range(500)]
    vectors += [(600 + i, vectors[4][1]) for i in range(100)] + [(4, vectors[4][1]), (None, vectors[5][1])]
    odd = [(700, None), (701, [1.0] * 63), (702, [1.0] * 63 + [None]), (703, [float("nan")] + [0.0] * 63), (704, [float("inf")] * 64), (705, [])]
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in vectors + odd], "vec_id long, embedding array<double>, cluster int, distance string").repartition(3)
    key = lambda r: (r[0] is None, r[0] or 0)
    assert sorted((tuple(r) for r in clustering.centroid_clusters(df).collect()), key=key) == sorted(brute_clusters(vectors), key=key)


def test_clusters_of_few_rows(spark):
    rows = [(i, [float(i)] * 64) for i in range(3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in clustering.centroid_clusters(df).collect()) == sorted(brute_clusters(rows))
    assert clustering.centroid_clusters(df.where("false")).count() == 0
    with pytest.raises(Exception, match="64-bit"):
        clustering.centroid_clusters(df.withColumn("embedding", F.transform("embedding", lambda x: x * 1e9)))


@pytest.mark.parametrize("scale", [1, 100_000])
def test_balls_hold_what_lies_in_them_and_go_whole(scale):
    rnd = np.random.default_rng(1)
    centres = rnd.integers(-900, 900, (8, 64)) * scale
    x = (centres[rnd.integers(0, 8, 2000)] + rnd.integers(-30, 30, (2000, 64)) * scale).astype(np.int64)
    tree, order = clustering.Tree.build(x)
    assert (tree.x == x[order]).all() and sorted(order.tolist()) == list(range(2000))
    for i in range(len(tree.lo)):
        own = tree.x[tree.lo[i] : tree.hi[i]]
        assert (tree.sums[i] == own.sum(0)).all() and (np.linalg.norm(own - own.mean(0), axis=1) <= tree.radius[i] * (1 + 1e-12) + 1e-9).all()
    centroids = centres + 7
    exact = ((tree.x[:, None, :] - centroids[None]) ** 2).sum(2)
    cluster, far = tree.assigned(centroids)
    assert (cluster == exact.argmin(1)).all() and (far == exact.min(1)).all()
    counts, sums = tree.sums_by_centroid(centroids)
    assert all(counts[k] == (cluster == k).sum() and (sums[k] == tree.x[cluster == k].sum(0)).all() for k in range(8))
    assert sum(tree.count[balls].sum() for balls, _, whole in tree.split(centroids) if whole) > 1900
