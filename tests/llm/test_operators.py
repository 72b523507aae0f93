"""Each operator against brute force, and on odd, repeated and empty rows."""

import collections
import gzip
import hashlib
import itertools
import math
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from spellwise.llm import common, components, licenses, mixing, nbest, quality, queries, simhash, substring, tokenfile, topk, toxicity, warc
from tests import oracle

from .conftest import LONG, TEXTS

SF = "/root/testdata/sf0.001"


def documents(spark):
    return {r.doc_id: r for r in common.table(spark, SF, "documents").collect()}


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_sql(spark, name):
    df = queries.QUERIES[name](spark, SF)
    columns, rows = oracle.rows_of(df.columns, [tuple(r) for r in df.collect()])
    found = oracle.connect(SF).execute(queries.ORACLE_SQL[name])
    names, expected = oracle.rows_of([d[0] for d in found.description], found.fetchall())
    assert columns == names and oracle.same(rows, expected)


# --- 1 -----------------------------------------------------------------------------------------------------------------
def brute_top(vectors, queries_, k):
    out = []
    for q in queries_:
        scored = sorted((-sum(a * b for a, b in zip(vectors[q], v, strict=False)), i) for i, v in vectors.items() if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


def test_top_k_is_exact(spark):
    rnd = random.Random(3)
    vectors = {i: [rnd.gauss(0, 1) for _ in range(6)] for i in range(300)}
    vectors |= {i: vectors[7] for i in range(300, 340)}  # copies: ties go to the smaller id
    whole = {i: [math.floor(64 * x) for x in v] for i, v in vectors.items()}
    df = spark.createDataFrame([(i, v, 0) for i, v in vectors.items()], "vec_id long, embedding array<double>, score int")
    got = topk.top_k(df, F.col("vec_id") % 20 == 0, k=5)
    assert sorted(tuple(r) for r in got.collect()) == brute_top(whole, [i for i in vectors if i % 20 == 0], 5)


def test_top_k_bounds_leave_most_pairs_out(spark):
    """On the embeddings the search is exact and evaluates a small part of all pairs, in the order of their bounds."""
    whole = {r.vec_id: [math.floor(64 * c) for c in r.embedding] for r in common.table(spark, "/root/testdata/sf0.1", "embeddings").collect()}
    ids = np.array(sorted(whole), np.int64)
    x = np.array([whole[i] for i in ids.tolist()], float)
    sample = [(i, whole[i]) for i in ids[:: max(1, len(ids) // topk.PIVOT_SAMPLE)].tolist()]
    pivots = topk.Pivots([v for _, v in sample])
    far = pivots.distances(x)
    assert len(pivots.rows) > 40 and np.allclose(far[:50, 0], np.linalg.norm(x[:50] - pivots.rows[0], axis=1))
    near = pivots.embedded(x, far)
    assert (near[:200] @ near.T + 0.5 >= x[:200] @ x.T).all()
    q = np.flatnonzero(ids % 20 == 0)
    search = topk._Search(ids[q], x[q], far[q], np.full(len(q), topk._NONE), pivots, 20)
    for lo in range(0, len(ids), 700):
        search.feed(ids[lo : lo + 700], x[lo : lo + 700], far[lo : lo + 700])
    got = search.result().to_pydict()
    assert sorted(zip(got["query_id"], got["vec_id"], got["score"], strict=True)) == sorted((a, b, s) for a, _, b, s in brute_top(whole, ids[q].tolist(), 20))
    assert search.pairs == len(q) * len(ids) and search.evaluated < 0.5 * search.pairs


def test_top_k_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (0, [0.5, 0.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (None, [1.0, 1.0]), (5, [2.0]), (6, [1e5, 1e5]), (7, [])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") == 0, k=20).collect())
    assert got == [(0, 1, 6, 32 * 6400000), (0, 2, 5, 32 * 128), (0, 3, 7, 0)]
    assert topk.top_k(df.where("false"), F.col("vec_id") == 0).count() == 0


# --- 2 -----------------------------------------------------------------------------------------------------------------
def brute_base(t):
    words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    lines = [x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    at = collections.defaultdict(list)
    for i in range(len(words) - 7):
        at[tuple(words[i : i + 8])].append(i)
    covered = {j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(covered)


def test_quality_counts(spark, odd):
    docs = documents(spark)
    got = quality.quality(common.table(spark, SF, "documents")).collect()
    assert len(got) == len(docs)
    for r in got:
        base = brute_base(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 20 or 100 * base[4] > 30 * base[0]) and not (r.kept and r.base_failed)
    want = collections.Counter((i, *brute_base(t)) for i, t in TEXTS)
    assert collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in quality.quality(odd).collect()) == want


def test_quality_rejects_noise(spark):
    rnd = random.Random(1)
    words = "the of and to in is was for it with as his on be at by".split() + ["river", "stone", "window", "garden", "letter"]
    sound = [" ".join(rnd.choice(words) for _ in range(200)) for _ in range(60)]
    noise = [" ".join(rnd.choice(words) + "%$#*" for _ in range(200)), " ".join(rnd.choice(words) for _ in range(200)).upper()]
    df = spark.createDataFrame([(i, t, "en") for i, t in enumerate(sound + noise)], "doc_id long, text string, lang string")
    kept = {r.doc_id: r.kept for r in quality.quality(df).collect()}
    assert all(kept[i] for i in range(60)) and not kept[60] and not kept[61]


def test_quality_learns_common_words(spark):
    """Languages that no list names: common words come from the corpus; without any there is no word verdict."""
    rnd = random.Random(3)
    greek = [" ".join(rnd.choice("και το να του η της με που την από για είναι στο θα".split() + ["ποτάμι", "πέτρα", "κήπος"]) for _ in range(120)) for _ in range(30)]
    foreign = " ".join(rnd.choice("ποσειδώνας αθήνα κρήτη θάλασσα βουνό ουρανός".split()) for _ in range(120))
    bare = [" ".join("".join(rnd.choice("абвгдежзиклмнопрст") for _ in range(8)) for _ in range(60)) for _ in range(30)]
    english = [" ".join(rnd.choice("the of and to in is was for it with as his on be at by".split()) for _ in range(120)) for _ in range(30)]
    odd = " ".join(rnd.choice("river stone window garden letter".split()) for _ in range(120))
    rows = [(i, t, lang) for i, (t, lang) in enumerate([*((t, "el") for t in [*greek, foreign]), *((t, "xx") for t in bare), *((t, "en") for t in [*english, odd])])]
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert [i for i, _, _ in rows if not got[i].kept] == [30, 91]
    assert got[30].word_distance == 1 and all(got[i].word_distance is None for i in range(31, 61))


def test_quality_judges_by_own_reference_only(spark):
    """A language of 19 documents beside a large one, and the smallest of 70 languages: no verdict, and the own reference."""
    rnd = random.Random(5)
    say = lambda words, n: " ".join(rnd.choice(words.split()) for _ in range(n))
    rows = [(say("και το να του της με που την από για", 60), "el") for _ in range(19)] + [(say("και το να", 60), None)]
    rows += [(say("the of and to in is was for it with", 60), "en") for _ in range(40)]
    rows += [(say("the of and to in is", 60), f"l{k}") for k in range(69) for _ in range(21)] + [(say("и в не на я быть он с", 60), "zz") for _ in range(20)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string").repartition(4)
    got = {r.doc_id: r for r in quality.quality(df).collect()}
    assert all(got[i].class_distance is None and got[i].word_distance is None for i in range(20))
    assert all(got[len(rows) - 1 - i].class_distance < 0.1 for i in range(20))
    assert all(r.kept for r in got.values() if not r.base_failed) and sum(r.base_failed for r in got.values()) < len(rows) // 4


def brute_js(p, q):
    total = sum(p)
    p = [x / total for x in p]
    half = lambda u, v: sum(a * math.log2(2 * a / (a + b)) for a, b in zip(u, v, strict=True) if a > 0)
    return math.sqrt(min(1, max(0, (half(p, q) + half(q, p)) / 2)))


def brute_verdicts(docs):
    """kept and both distances of (id, text, lang) rows, by plain loops over the rules' own definitions."""
    hash_of = lambda w: int(common.span_hashes(np.frombuffer(w, np.uint8), np.array([0]), np.array([len(w)])).view(np.int64)[0])
    table = {}
    for i, t, lang in docs:
        raw = (t or "").encode()
        letters = re.findall(rb"[A-Za-z\x80-\xff]+", raw)
        kinds = [0] * 8
        for ch in t or "":
            kinds[0 if "a" <= ch <= "z" else 1 if "A" <= ch <= "Z" else 2 if "0" <= ch <= "9" else 3 if ch in " \t\n\v\f\r" else 4 if ch in "!\"'(),-.:;?" else 5 if ord(ch) < 128 else 6 if ord(ch) < 0x800 else 7] += 1
        table[i] = (lang, [w.lower() for w in letters], kinds, brute_base(t))
    bins = {}
    for lang in {v[0] for v in table.values() if v[0] is not None}:
        held = collections.Counter(w for v in table.values() if v[0] == lang and v[3][0] >= quality.MIN_WORDS for w in set(v[1]))
        best = sorted((w for w, n in held.items() if n > 1), key=lambda w: (-held[w], hash_of(w)))[: quality.COMMON_WORDS]
        bins[lang] = sorted(best, key=hash_of)
    words = {i: [Counter_[w] for w in bins.get(v[0], [])] + [0] * (quality.COMMON_WORDS - len(bins.get(v[0], []))) for i, v in table.items() for Counter_ in [collections.Counter(v[1])]}

    def references(ids):
        out = {}
        for lang in bins:
            own = [i for i in ids if table[i][0] == lang and table[i][3][0] >= quality.MIN_WORDS]
            if len(own) >= quality.MIN_REFERENCE_DOCS:
                kinds, common_ = [sum(c) for c in zip(*(table[i][2] for i in own), strict=True)], [sum(c) for c in zip(*(words[i] for i in own), strict=True)]
                covered = sum(any(words[i]) for i in own) >= quality.WORD_COVER * len(own)
                out[lang] = [k / sum(kinds) for k in kinds], [k / sum(common_) for k in common_] if covered else None
        return out

    first = references(table)
    sound = [i for i, v in table.items() if v[3][0] >= quality.MIN_WORDS and 100 * v[3][4] <= 30 * v[3][0]]
    final = references([i for i in sound if table[i][0] in first and brute_js(table[i][2], first[table[i][0]][0]) <= quality.FIRST_CLASS_DISTANCE])
    out = {}
    for i, (lang, _, kinds, base) in table.items():
        c = w = None
        if lang in final:
            c = brute_js(kinds, final[lang][0]) if sum(kinds) else 0.0
            if final[lang][1] is not None:
                w = brute_js(words[i], final[lang][1]) if sum(words[i]) else 1.0
        bad = c is not None and sum(kinds) >= quality.MIN_CHARS and c > quality.MAX_CLASS_DISTANCE + quality.CLASS_NOISE / math.sqrt(sum(kinds))
        bad |= w is not None and base[0] >= quality.MIN_WORDS and w > quality.MAX_WORD_DISTANCE
        out[i] = (not bad and not (base[0] < 20 or 100 * base[4] > 30 * base[0]), c, w)
    return out


def test_quality_verdicts_against_brute_force(spark):
    docs = [(r.doc_id, r.text, r.lang) for r in documents(spark).values()]
    want = brute_verdicts(docs)
    got = {r.doc_id: (r.kept, r.class_distance, r.word_distance) for r in quality.quality(common.table(spark, SF, "documents")).collect()}
    assert len({v[0] for v in want.values()}) == 2 and sum(v[1] is not None for v in want.values()) > 100
    for i, (kept, c, w) in want.items():
        assert got[i][0] == kept and got[i][1:] == (pytest.approx(c, abs=1e-9) if c is not None else None, pytest.approx(w, abs=1e-9) if w is not None else None)


def test_js_distance():
    p = np.array([[1, 1, 0], [0, 0, 2], [0, 0, 0]])
    got = quality.js_distance(p, np.array([[0.5, 0.5, 0]]))
    assert got[:, 0] == pytest.approx([0, 1, 0])


# --- 3 -----------------------------------------------------------------------------------------------------------------
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = toxicity.toxicity(common.table(spark, sf, "documents"), common.table(spark, sf, "labels"), keep=["doc_id"])
    rows = got.join(common.table(spark, sf, "labels"), "doc_id").where("held_out").agg(F.avg(F.when(F.col("toxic") == 1, F.col("predicted"))).alias("recall"), F.avg(F.when(F.col("toxic") == 0, F.col("predicted"))).alias("fpr")).first()
    assert rows.recall > 0.8 and rows.fpr < 0.02
    assert all((zlib.crc32(str(r.doc_id).encode()) % 4 == 2) == r.held_out for r in got.limit(500).collect())


def test_toxicity_scores_of_the_query(spark):
    """Each score is that of the fitted weights over the words, neighbours and skip-pairs of the whole text, found one by one."""
    labels = common.table(spark, SF, "labels")
    weights = toxicity.train(common.table(spark, SF, "documents"), labels, ~toxicity.held_out(F.col("doc_id")))
    value = dict(zip(weights.index.tolist(), weights.value.tolist(), strict=True))
    hashed = lambda word: common.span_hashes(np.frombuffer(word, np.uint8), np.array([0]), np.array([len(word)]))[0]
    top = lambda h: int(h) >> (64 - toxicity.BITS)
    kinds = [np.uint64(k) for k in toxicity._KINDS]
    docs = documents(spark)
    for r in queries.op3_toxicity(spark, SF).collect():
        low = (docs[r.doc_id].text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
        words = [hashed(w) for w in re.findall(rb"[a-z\x80-\xff]+", low)]
        with np.errstate(over="ignore"):
            found = {top(w * kinds[0]) for w in words}
            for gap in (1, 2):
                found |= {top(common.mix(np.array([a * kinds[gap] + b]))[0]) for a, b in zip(words, words[gap:], strict=False)}
        total = weights.intercept + sum(value.get(k, 0.0) for k in found)
        assert r.score == pytest.approx(1 / (1 + math.exp(-total)), rel=1e-5)
        assert r.predicted == (r.score >= 0.3) and r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)


def test_toxicity_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (9, None), (None, 1)], "doc_id long, toxic int")
    got = toxicity.toxicity(odd, labels).collect()
    assert collections.Counter(r.doc_id for r in got) == collections.Counter(i for i, _ in TEXTS)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    assert {r.row for r in got} == {"r"}
    assert toxicity.toxicity(none, labels.where("false")).count() == 0


def test_ftrl_equals_a_plain_loop():
    """The fitted weights are those of McMahan's update, coordinate by coordinate in plain Python."""
    rnd = random.Random(8)
    bias = 1 << toxicity.BITS
    examples = [(y, np.array(sorted({rnd.randrange(40) for _ in range(12)} | ({100 + rnd.randrange(3)} if y else set())) + [bias], np.int32)) for y in (1, 0) * 60]
    got = toxicity.fit(examples, 0.2)
    count = collections.Counter(k for _, i in examples for k in i.tolist())
    z, n = collections.defaultdict(float), collections.defaultdict(float)
    l1 = lambda k: 0.0 if k == bias else toxicity.L1

    def weight(k):
        if abs(z[k]) <= l1(k):
            return 0.0
        return -(z[k] - math.copysign(l1(k), z[k])) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(7)
    for _ in range(toxicity.EPOCHS):
        for e in order.permutation(len(examples)):
            y, own = examples[e][0], [k for k in examples[e][1].tolist() if count[k] * toxicity.EPOCHS > l1(k)]
            w = {k: weight(k) for k in own}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for k in own:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA * w[k]
                n[k] += g * g
    want = {k: weight(k) for k in list(z) if k != bias and weight(k)}
    assert got.index.tolist() == sorted(want) and got.value == pytest.approx([want[k] for k in sorted(want)])
    assert got.intercept == pytest.approx(weight(bias) + math.log(0.2 / 0.8)) and {100, 101, 102} & set(want)


def test_ftrl_is_sparse():
    rnd = np.random.default_rng(0)
    examples = [(y, np.append(np.unique(np.append(rnd.integers(1000, 2000, 30), [7] * y)), 1 << toxicity.BITS).astype(np.int64)) for y in [0, 1] * 200]
    w = toxicity.fit(examples, 0.5)
    assert 7 in w.index and len(w.index) < 100
    assert w.scores(np.array([0]), np.array([7]), 2).tolist()[0] > 0.5 > w.scores(np.array([0]), np.array([7]), 2).tolist()[1]


# --- 4 -----------------------------------------------------------------------------------------------------------------
@pytest.mark.parametrize("archive_bytes", [32 << 20, 1000])
def test_warc_transactions(spark, monkeypatch, tmp_path, archive_bytes):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", archive_bytes)
    big = "<p>" + "x\r\n\r\nWARC/1.1\r\n" * 40
    rows = [(5, "http://a/\n", big), (3, "http://b", big), (9, None, big), (1, "u", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (7, "u", "é" * 49), (8, "u", "é" * 50), (10, "u", "é" * 50), (None, "u", "z" * 200), (3, "http://b", big)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, capture string")
    got = warc.transactions(df, str(tmp_path / "w")).collect()
    assert len(got) == len(rows)
    want = collections.Counter()
    for p, _, h in rows:
        body = (h or "").encode()
        same = [q for q, _, g in rows if g == h and q is not None] if len(body) >= 100 else []
        first = min(same, default=p)
        want[p, len(body), hashlib.sha256(body).hexdigest(), "revisit" if first != p and p is not None else "response", first if first != p and p is not None else None] += 1
    assert collections.Counter((r.page_id, r.response.payload_bytes, r.response.payload_digest, r.response.kind, r.response.refers_to) for r in got) == want
    assert all((r.payload is None) == (r.response.kind == "revisit") and "page-id" in r.metadata.payload and r.request.http_head.startswith("GET") for r in got)
    assert {r.page_id: r.payload for r in got}[8] == "é" * 50
    archives = [p.read_bytes() for p in (tmp_path / "w").glob("part*") if p.stat().st_size]
    found = [h for a in archives for h, _ in warc.records_of(a)]
    assert all(gzip.decompress(a).startswith(b"WARC/1.1") and a[-1] == 0 for a in archives)
    named = [h["warc-record-id"] for h in found]
    assert len(named) == len(set(named)) == 3 * len(rows) + len(archives)
    answers = {h["warc-record-id"]: h["warc-payload-digest"] for h in found if h["warc-type"] == "response"}
    assert all(answers[h["warc-refers-to"]] == h["warc-payload-digest"] for h in found if h["warc-type"] == "revisit")
    assert warc.transactions(df.where("false")).count() == 0


# --- 5 -----------------------------------------------------------------------------------------------------------------
def brute_fingerprint(t):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().translate(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))))
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(fps):
    label = {i: i for i in range(len(fps))}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        if (fps[i][1] ^ fps[j][1]).bit_count() <= 3 and root(i) != root(j):
            label[max(root(i), root(j))] = min(root(i), root(j))
    least = {}
    for i, (d, _) in enumerate(fps):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return collections.Counter((d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(fps))


def test_simhash_against_brute_force(spark, odd, none):
    docs = [(i, t) for i, t in TEXTS if t != LONG] + [(r.doc_id + 100, r.text) for r in documents(spark).values()][:120]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute_components([(i, brute_fingerprint(t)) for i, t in docs])
    assert collections.Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want
    assert simhash.near_duplicates(odd).count() == len(TEXTS)
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize(("homes", "most"), [(2048, 3), (8, 3), (2048, 5), (8, 5)])
def test_links_keep_components(spark, monkeypatch, homes, most):
    """A dense cloud of fingerprints, also with cells so small that they are split; at 5 bits also with check words."""
    monkeypatch.setattr(simhash, "CELL_HOMES", homes)
    rnd = random.Random(5)
    fps = {rnd.getrandbits(64) for _ in range(200)}
    for centre in list(fps)[:4]:
        fps |= {centre ^ sum(1 << b for b in rnd.sample(range(64), rnd.randint(1, most + 1))) for _ in range(150)}
    fps = sorted(fps)
    signed = lambda f: f - (1 << 64) if f >> 63 else f
    checks = [(0, 0) if most == 3 else (rnd.choice([0, (1 << 20) - 1]), rnd.choice([0, 1, 7, 15])) for _ in fps]
    if most == 3:
        rows = spark.createDataFrame([(signed(f),) for f in fps], "fp long")
        number = {signed(f): i for i, f in enumerate(fps)}
    else:
        rows = spark.createDataFrame([(i, signed(f), *c) for i, (f, c) in enumerate(zip(fps, checks, strict=True))], "node long, fp long, c1 long, c2 long")
        number = {i: i for i in range(len(fps))}
    got = {number[r.node]: number[r.component] for r in components.components(simhash.links(rows, most)).collect()}
    label = list(range(len(fps)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in itertools.combinations(range(len(fps)), 2):
        apart = sum((a ^ b).bit_count() for a, b in zip(checks[i], checks[j], strict=True))
        if (fps[i] ^ fps[j]).bit_count() <= most and apart <= simhash.SHINGLE_BITS:
            label[root(i)] = root(j)
    groups, mine = collections.defaultdict(set), collections.defaultdict(set)
    for i in range(len(fps)):
        groups[root(i)].add(i)
        mine[got.get(i, i)].add(i)
    assert {frozenset(g) for g in groups.values()} == {frozenset(g) for g in mine.values()}
    for limit in simhash.TIERS if most == 5 else ():  # the edges of each tier connect as much as all its pairs
        near = [(i, j) for i, j in itertools.combinations(range(len(fps)), 2) if (fps[i] ^ fps[j]).bit_count() <= most and sum((a ^ b).bit_count() for a, b in zip(checks[i], checks[j], strict=True)) <= limit]
        kept = [(r.u, r.v) for r in simhash.links(rows, most).collect() if sum((a ^ b).bit_count() for a, b in zip(checks[r.u], checks[r.v], strict=True)) <= limit]
        assert united(near, len(fps)) == united(kept, len(fps))


def united(pairs, n):
    label = list(range(n))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in pairs:
        label[max(root(i), root(j))] = min(root(i), root(j))
    return [root(i) for i in range(n)]


def runs_of(text, k):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)})) if w]
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def jaccard(a, b):
    return len(a & b) / max(1, len(a | b))


def test_like_documents_finds_edited_copies(spark, odd, none):
    """Nine in ten planted pairs of 5-word Jaccard similarity 0.8 or more are linked; each member of a group is that near to another."""
    docs = [r for r in common.table(spark, "/root/testdata/sf0.1", "documents").collect() if r.text and 80 <= len(r.text.split()) <= 500][:900]
    rnd = random.Random(9)
    rows, pairs = [(r.doc_id, r.text) for r in docs], []
    for k, r in enumerate(docs):
        words = r.text.split(" ")
        for _ in range(rnd.randint(1, max(1, len(words) // 45))):
            words[rnd.randrange(len(words))] = rnd.choice(["alpha", "beta", "gamma"])
        edited = " ".join(words)
        if jaccard(runs_of(r.text, 5), runs_of(edited, 5)) >= 0.8:
            pairs.append((r.doc_id, 10_000_000 + k))
            rows.append((10_000_000 + k, edited))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in simhash.like_documents(df).collect()}
    assert len(pairs) >= 500 and sum(got[a] == got[b] for a, b in pairs) >= 0.9 * len(pairs)
    texts, groups = dict(rows), collections.defaultdict(list)
    for d, c in got.items():
        groups[c].append(d)
    for members in groups.values():
        if len(members) > 1:
            runs = {d: runs_of(texts[d], 5) for d in members}
            assert all(any(jaccard(runs[d], runs[e]) >= 0.8 for e in members if e != d) or not runs[d] for d in members)
    assert simhash.like_documents(odd).count() == len(TEXTS) and simhash.like_documents(none).count() == 0
    kept = [r.doc_id for r in simhash.one_of_each(odd).collect()]
    assert 1 in kept and 2 not in kept and None in kept and kept.count(8) == 2 and 3 in kept and 4 not in kept and 5 not in kept
    assert simhash.one_of_each(odd).columns == odd.columns


def test_similar_is_exact(spark):
    rnd = random.Random(3)
    sets = {i: sorted(rnd.sample(range(30), rnd.randint(1, 25))) for i in range(60)} | {60: []}
    pairs = [(i, j) for i in sets for j in sets if i < j] + [(j, 0) for j in range(1, 60)]
    rows = spark.createDataFrame([*sets.items(), *((i, None) for i in range(30))], "node long, runs array<long>")
    got = {(r.u, r.v) for r in simhash._similar(spark.createDataFrame(pairs, "u long, v long"), rows).collect()}
    assert got == {(i, j) for i, j in pairs if sets[i] and 5 * len({*sets[i]} & {*sets[j]}) >= 4 * len({*sets[i]} | {*sets[j]})}


def test_manhattan_bounds_hamming():
    rnd = np.random.default_rng(1)
    a, b = rnd.integers(0, 2**63, 5000).astype(np.uint64), rnd.integers(0, 2**63, 5000).astype(np.uint64)
    counts = [[(int(x) >> 2 * i & 1) + (int(x) >> 2 * i + 1 & 1) for i in range(32)] for x in a[:50]], [[(int(x) >> 2 * i & 1) + (int(x) >> 2 * i + 1 & 1) for i in range(32)] for x in b[:50]]
    want = [sum(abs(p - q) for p, q in zip(x, y, strict=True)) for x, y in zip(*counts, strict=True)]
    got = simhash.manhattan(a, b)
    assert got[:50].tolist() == want and (got <= np.bitwise_count(a ^ b)).all()


def test_components_of_chains(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, k) for k in range(1001, 1200)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(edges, "u long, v long").where("u IS NOT NULL")).collect()}
    assert all(got[i] == 0 for i in range(201)) and all(got[k] == 1000 for k in range(1000, 1200))


# --- 6 -----------------------------------------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def model():
    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        return f.read()


def all_paths(lattice, text):
    found = []

    def walk(i, score, ids):
        if i == len(text):
            found.append((score, ids))
        for k in range(1, min(len(lattice.score), len(text) - i) + 1):
            if lattice.score[k - 1, i] > -np.inf:
                walk(i + k, score + lattice.score[k - 1, i], ids + lattice._ids(0, [(i, k)]).tolist())

    walk(0, 0.0, [])
    return sorted(found, key=lambda f: -f[0])


@pytest.mark.parametrize("text", ["the cat is", "a", "a b", "é日x", "don't stop", "x  y"])
def test_n_best_is_exact(model, text):
    segmenter = nbest.Segmenter(model, 4)
    want = [s for s, _ in all_paths(nbest.Lattice(segmenter.pieces, [" " + text]), " " + text)][:4]
    ids, score, others = next(iter(segmenter.segment([text.encode()])))
    assert [score, *(score - loss for loss, _, _ in others)] == pytest.approx(want)
    for loss, n, swaps in others:
        other = nbest.apply_swaps(ids.tolist(), [{"token": t, "drop": d, "ids": i} for t, d, i in swaps])
        assert len(other) == n and nbest.decode(segmenter.pieces, np.array(other)) == text.encode()
        assert sum(segmenter.pieces.score_of[other]) == pytest.approx(score - loss)


def best_scores(pieces, text, n):
    """The n best scores of all segmentations, from the n best of each beginning of the text."""
    lattice = nbest.Lattice(pieces, [text])
    best = [[0.0], *([] for _ in text)]
    for i in range(len(text)):
        best[i] = sorted(best[i], reverse=True)[:n]
        for k in range(1, min(len(lattice.score), len(text) - i) + 1):
            if lattice.score[k - 1, i] > -np.inf:
                best[i + k] += [b + lattice.score[k - 1, i] for b in best[i]]
    return sorted(best[-1], reverse=True)[:n]


def test_n_best_of_the_documents(spark, model):
    """The four best scores of documents of the table, by plain dynamic programming over whole texts; each alternative is another segmentation of them."""
    pieces, docs = nbest._pieces(model), documents(spark)
    rows = sorted(queries.op6_sentencepiece_n_best(spark, SF).collect(), key=lambda r: len(docs[r.doc_id].text or ""))
    assert len(rows) == len(docs)
    for r in rows[:100]:
        text = docs[r.doc_id].text or ""
        if not text:
            assert r.ids == [] and r.n_tokens == 0
            continue
        assert [r.score, *(o.score for o in r.alternatives)] == pytest.approx(best_scores(pieces, " " + text, 4))
        seen = {tuple(r.ids)}
        for o in r.alternatives:
            other = nbest.apply_swaps(list(r.ids), [{"token": w.token, "drop": w.drop, "ids": list(w.ids)} for w in o.swaps])
            assert len(other) == o.n_tokens and nbest.decode(pieces, np.array(other)).decode() == text and tuple(other) not in seen
            seen.add(tuple(other))


def test_unspaced_scripts_fall_apart(model):
    """A long text without spaces takes seconds, and segments as the whole lattice does."""
    rnd = random.Random(4)
    chars = [chr(c) for c in range(0x4E00, 0x4E00 + 3000)]
    short = "".join(rnd.choice(chars[:400]) for _ in range(60)) + "日本語の文章です" + "été" * 5
    pieces = nbest._pieces(model)
    whole = nbest.Lattice(pieces, [" " + short])
    whole.forward()
    ids, score, _ = next(iter(nbest.Segmenter(model, 4).segment([short.encode()])))
    assert score == pytest.approx(float(whole.best[0])) and nbest.decode(pieces, ids).decode() == short
    long = "".join(rnd.choice(chars) for _ in range(300_000)).encode()
    begin = time.perf_counter()
    ids, _, others = next(iter(nbest.Segmenter(model, 4).segment([long])))
    assert nbest.decode(pieces, ids) == long and time.perf_counter() - begin < 15


def test_n_best_odd_rows(spark, odd, none):
    path = public_tokenizers.path("piece_bpe_32k.model")
    got = nbest.n_best(odd, path)
    rows = got.collect()
    assert collections.Counter(r.doc_id for r in rows) == collections.Counter(i for i, _ in TEXTS)
    assert all(r.round_trip == (r.doc_id != 7) and len(r.ids) == r.n_tokens for r in rows)
    texts = {r.doc_id: r.text for r in nbest.decoded(got, path).collect()}
    assert texts[6] == LONG and texts[3] == texts[4] == "" and texts[7] == TEXTS[6][1].replace("▁", " ")
    assert nbest.n_best(none, path).count() == 0


# --- 7 -----------------------------------------------------------------------------------------------------------------
def test_elias_fano():
    rnd = random.Random(2)
    for values in ([], [0], [5], [0, 0, 0], sorted(rnd.randrange(10**6) for _ in range(3000)), list(range(1000)), [10**12, 10**12, 10**13]):
        data = b"zz" + tokenfile.EliasFano.encode(np.array(values, np.uint64)).to_bytes()
        made, end = tokenfile.EliasFano.from_bytes(memoryview(data), 2)
        assert made.decode().tolist() == values and end == len(data)
        assert [made.select(i) for i in range(len(values))] == values
        with pytest.raises(IndexError):
            made.select(len(values))


def test_elias_fano_ranges():
    rnd = random.Random(3)
    for values in ([0], sorted(rnd.randrange(10**6) for _ in range(3000)), list(range(1000)), sorted([0] * 700 + [10**9 + k for k in range(700)])):
        made = tokenfile.EliasFano.from_bytes(memoryview(tokenfile.EliasFano.encode(np.array(values, np.uint64)).to_bytes()), 0)[0]
        for _ in range(60):
            lo = rnd.randint(0, len(values))
            hi = rnd.randint(lo, min(len(values), lo + 600))
            assert made.select_range(lo, hi).tolist() == values[lo:hi]
        with pytest.raises(IndexError):
            made.select_range(0, len(values) + 1)


def test_token_file_refuses_and_encodes_whole(spark, tmp_path):
    """Ids that do not fit raise; a tokenizer with another pre-tokenizer gets whole texts."""
    from tokenizers import Tokenizer

    df = spark.createDataFrame([(1, "Hello world, it's 42!"), (2, "a  b\n c")], "doc_id long, text string")
    with pytest.raises(ValueError):
        tokenfile.token_file(df, public_tokenizers.path("byte_bpe_50k.json"), width=1)
    with pytest.raises(ValueError):
        tokenfile.token_file(df, public_tokenizers.path("byte_bpe_50k.json"), end_id=70_000)
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    got = {r.doc_id: r.ids for r in tokenfile.token_file(df, path).collect()}
    assert got == {r.doc_id: [*tokenizer.encode(r.text, add_special_tokens=False).ids, 0] for r in df.collect()}


def test_token_file_of_the_documents(spark):
    """All documents against the library, text by text."""
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want, at = [], 0
    for i, r in sorted(documents(spark).items()):
        ids = [*tokenizer.encode(r.text or "", add_special_tokens=False).ids, 0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert sorted(tuple(r) for r in queries.op7_token_file(spark, SF).collect()) == want


@pytest.mark.parametrize("shard_ids", [1 << 20, 50])
def test_token_file(spark, odd, none, monkeypatch, tmp_path, shard_ids):
    from tokenizers import Tokenizer

    monkeypatch.setattr(tokenfile, "SHARD_IDS", shard_ids)
    path = public_tokenizers.path("byte_bpe_50k.json")
    tokenizer = Tokenizer.from_file(path)
    rows = sorted(TEXTS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    want, at = [], 0
    for i, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [0]
        want.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids))
        at += len(ids)
    got = tokenfile.token_file(odd, path, digest=True, folder=str(tmp_path / "f")).orderBy("start").collect()
    assert [tuple(r) for r in got] == [w[:4] for w in want]
    whole = tokenfile.read_shards(spark, str(tmp_path / "f")).orderBy("start").collect()
    assert [(r.doc_id, r.start, r.ids) for r in whole] == [(w[0], w[1], w[4]) for w in want]
    assert tokenfile.token_file(none, path).count() == 0


def test_encoder_asks_for_few_pieces_at_once(monkeypatch):
    """However many new pieces a slice has, the tokenizer gets few of them at a time; what is remembered may go at any slice."""
    rnd = random.Random(5)
    with open(public_tokenizers.path("byte_bpe_50k.json"), "rb") as f:
        encoder = tokenfile.Encoder(f.read())
    whole, asked = encoder.tokenizer, []

    class Counting:
        def encode_batch_fast(self, texts, **more):
            asked.append(len(texts))
            return whole.encode_batch_fast(texts, **more)

    encoder.tokenizer = Counting()
    monkeypatch.setattr(tokenfile, "CACHE_PIECES", 15_000)
    texts = ["".join(rnd.choice("abcdefghij é.7\n") for _ in range(rnd.randint(0, 400))) for _ in range(2000)]
    for part in (texts[:1500], texts[1000:], [], ["", ""], texts[:700]):
        data, offsets = np.frombuffer("".join(part).encode(), np.uint8), np.cumsum([0, *(len(t.encode()) for t in part)])
        ids, bounds = encoder.encode(data, offsets)
        got = [ids[a:b].tolist() for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
        assert got == [whole.encode(t, add_special_tokens=False).ids for t in part]
    assert sum(asked) > 30_000 and max(asked) <= 8192


# --- 8 -----------------------------------------------------------------------------------------------------------------
def made_up(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghijklmnoprstuvwé") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def test_repeated_passages(spark):
    rnd = random.Random(4)
    passage = made_up(rnd, 60)
    rows = [(i, made_up(rnd, 100) + " " + passage + " " + made_up(rnd, 100) if i in (3, 5, 9) else made_up(rnd, 200)) for i in range(20)]
    rows += [(30, rows[2][1]), (31, made_up(rnd, 50) + " " + passage + " " + made_up(rnd, 20) + " " + passage)]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string")
    got = {r.doc_id: r.spans for r in substring.repeated_passages(df).collect()}
    assert set(got) == {5, 9, 30, 31} and len(got[31]) == 2
    assert {s.first_doc_id for s in got[5] + got[9] + got[31]} == {3} and {s.first_doc_id for s in got[30]} == {2}
    texts = dict(rows)
    for i in (5, 9):
        (s,) = got[i]
        assert texts[i][s.start : s.start + s.chars].strip() == passage and s.words == 60
    cut = {r.doc_id: r.text for r in substring.without_repeats(df).collect()}
    assert len(cut) == len(rows) and all(cut[i] == t for i, t in rows if i not in got)
    assert passage in cut[3] and not any(passage in cut[i] for i in got)
    assert len(cut[30]) < 100


def test_passages_stand_whole_in_one_earlier_place(spark):
    """Chunks that occur earlier here and there make no passage; a passage is a stretch of one source; the source stays."""
    rnd = random.Random(8)
    rows = [(i, made_up(rnd, 70)) for i in range(40)]
    pieces = []  # one chunk of each document; the same chunks come out of their concatenation
    for _, text in rows:
        data = text.encode()
        ends = substring.chunk_ends(np.frombuffer(data, np.uint8), np.array([0, len(data)])).tolist()
        pieces.append(next(data[a:b].decode() for a, b in zip(ends[3:], ends[4:], strict=False) if 24 < b - a < 60))
    rows += [(50, "".join(pieces)), (60, f"{rows[1][1]} {rows[2][1]}"), (70, (made_up(rnd, 20) + " ") * 30)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    texts, got = dict(rows), {r.doc_id: r.spans for r in substring.repeated_passages(df).collect()}
    assert set(got) == {60, 70} and [s.first_doc_id for s in got[60]] == [1, 2]
    for i, spans in got.items():
        for s in spans:
            copy = texts[i][s.start : s.start + s.chars]
            assert copy in texts[s.first_doc_id] and (i == 70 or s.words >= substring.MIN_WORDS)
    cut = {r.doc_id: r.text for r in substring.without_repeats(df).collect()}
    assert cut[50] == texts[50] and len(cut[60]) < 150
    assert len(cut[70].split()) >= substring.MIN_WORDS and len(cut[70]) < len(texts[70]) / 5


def parts_word(text, at):
    return 0 < at < len(text) and not re.search(r"[\x20\x09-\x0D]", text[at - 1 : at + 1])


def is_subsequence(few, many):
    rest = iter(many)
    return all(w in rest for w in few)


def words_in(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_passages_against_brute_force(spark):
    """Every passage of the documents is the longest stretch of whole words around it that equals its first occurrence, which is earlier."""
    docs = documents(spark)
    got = substring.repeated_passages(common.table(spark, SF, "documents")).collect()
    assert len(got) > 10
    texts = {i: r.text or "" for i, r in docs.items()}
    for r in got:
        text, spans = texts[r.doc_id], sorted(r.spans, key=lambda s: s.start)
        for k, s in enumerate(spans):
            end = s.start + s.chars
            copy, source = text[s.start : end], texts[s.first_doc_id]
            assert s.first_doc_id <= r.doc_id and copy in source
            assert not parts_word(text, s.start) and not parts_word(text, end)
            assert s.words == len(re.findall(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]+", text[:end])) - len(re.findall(r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]+", text[: s.start]))
            if s.first_doc_id != r.doc_id:  # the next whole word on either side, where no other passage holds it, differs at some occurrence
                before = re.search(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*$", text[spans[k - 1].start + spans[k - 1].chars if k else 0 : s.start])
                if before:
                    assert any(not source[: m.start()].endswith(before[0]) for m in re.finditer(re.escape(copy), source))
                after = re.match(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+(?=[\x20\x09-\x0D]|$)", text[end : spans[k + 1].start] if k + 1 < len(spans) else text[end:])
                if after and (k + 1 == len(spans) or end + after.end() < spans[k + 1].start):
                    assert any(not source[m.end() :].startswith(after[0]) for m in re.finditer(re.escape(copy), source))
    cut = {r.doc_id: r.text for r in substring.without_repeats(common.table(spark, SF, "documents")).collect()}
    assert all(is_subsequence(words_in(cut[i]), words_in(t)) for i, t in texts.items())
    # all that documents of 15 words and more share with an earlier one, in runs of 40 words, is covered
    seen, missed, met = {}, 0, 0
    for i in sorted(texts):
        words = [(m.start(), m.end()) for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[i])]
        spans = next((r.spans for r in got if r.doc_id == i), [])
        covered = np.zeros(len(texts[i]) + 1, bool)
        for s in spans:
            covered[s.start : s.start + s.chars] = True
        for k in range(len(words) - 39):
            run = texts[i][words[k][0] : words[k + 39][1]]
            if seen.setdefault(run, i) != i:
                met += 1
                missed += not covered[words[k][0] : words[k + 39][1]].mean() > 0.9
    assert met > 100 and missed <= met // 100


def test_only_whole_words_go(spark):
    """What stays of a text are words of it in their order, also where copies part inside a word, meet, or have long words around."""
    rnd = random.Random(21)
    a, b, c, long = made_up(rnd, 40), made_up(rnd, 40), made_up(rnd, 40), "".join(rnd.choice("abcdef") for _ in range(600))
    rows = [(1, f"{a} They went home"), (2, f"Unlike {a} There is another story"), (3, f"x{a}y"), (4, b), (5, c), (6, f"start {b} {c} end"), (7, f"go\n{b}\n\n{c}on"), (8, f"{long}{a}{long}"), (9, f"z {long}{a}{long}"), (10, f"{b}{c}"), (11, f"pre{b}{c} post")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    texts = dict(rows)
    spans = {r.doc_id: r.spans for r in substring.repeated_passages(df).collect()}
    assert {2, 3, 6, 7} <= set(spans) and all(not parts_word(texts[i], p) for i, own in spans.items() for s in own for p in (s.start, s.start + s.chars))
    assert all(texts[i][s.start : s.start + s.chars] in texts[s.first_doc_id] for i, own in spans.items() for s in own)
    cut = {r.doc_id: r.text for r in substring.without_repeats(df).collect()}
    assert all(is_subsequence(words_in(cut[i]), words_in(t)) for i, t in rows)
    assert words_in(cut[2]) == "Unlike There is another story".split() and words_in(cut[6]) == ["start", "end"] and cut[1] == texts[1]


def test_repeats_are_found(spark):
    """Of planted passages of 51 to 80 words nine in ten are covered to nine tenths of their words."""
    rnd = random.Random(31)
    planted, rows = [made_up(rnd, rnd.randint(51, 80)) for _ in range(150)], []
    for k, p in enumerate(planted):
        rows += [(10 * k + j, f"{made_up(rnd, rnd.randint(0, 60))} {p} {made_up(rnd, rnd.randint(0, 60))}".strip()) for j in range(rnd.randint(2, 4))]
    cut = {r.doc_id: r.text for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    copies = [(i, planted[i // 10]) for i, _ in rows if i % 10]
    gone = [1 - sum((collections.Counter(words_in(cut[i])) & collections.Counter(words_in(p))).values()) / len(words_in(p)) for i, p in copies]
    assert sum(g >= 0.9 for g in gone) >= 0.9 * len(copies)
    assert all(cut[i] == t for i, t in rows if i % 10 == 0)


def test_rows_that_share_an_id(spark):
    """Each row of an id loses its own passages only."""
    rnd = random.Random(12)
    passage, a, b = made_up(rnd, 60), made_up(rnd, 80), made_up(rnd, 90)
    rows = [(1, passage), (2, a + " " + passage), (2, b), (2, a + " " + passage), (None, passage)]
    cut = [(r.doc_id, r.text) for r in substring.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted((i or 0, t.strip()) for i, t in cut) == sorted([(1, passage), (2, a), (2, b), (2, a), (0, passage)])
    emptied = spark.createDataFrame([(1, passage), (2, passage), (3, " "), (4, None), (5, "")], "doc_id long, text string")
    assert sorted(r.doc_id for r in substring.without_repeats(emptied, drop_emptied=True).collect()) == [1, 3, 4, 5]


def test_chunks_resist_insertions():
    rnd = random.Random(6)
    text = made_up(rnd, 3000).encode()
    changed = text[:5000] + b"something new " + text[5000:]

    def parts(t):
        data = np.frombuffer(t, np.uint8)
        ends = substring.chunk_ends(data, np.array([0, len(data)]))
        ends = ends[ends > 0]
        assert ends[-1] == len(t)
        return [t[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]

    a, b = parts(text), parts(changed)
    assert b"".join(a) == text and all(x.decode() for x in a)
    assert len(set(a) - set(b)) <= 3


def test_chunks_do_not_depend_on_the_row_before():
    rnd = random.Random(7)
    texts = [made_up(rnd, rnd.choice([1, 2, 40])).encode() for _ in range(300)]
    data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    ends = substring.chunk_ends(data, offsets)
    for t, a, b in zip(texts, offsets, offsets[1:], strict=False):
        alone = substring.chunk_ends(np.frombuffer(t, np.uint8), np.array([0, len(t)]))
        assert (ends[(ends > a) & (ends <= b)] - a).tolist() == alone[alone > 0].tolist()


def test_substring_odd_rows(spark, odd, none):
    cut = substring.without_repeats(odd)
    assert cut.columns == odd.columns and cut.count() == len(TEXTS)
    texts = {r.doc_id: r.text for r in cut.collect()}
    assert texts[3] is None and texts[4] == "" and texts[1] == TEXTS[0][1] and texts[8] == "the quick" and len(texts[6]) < len(LONG)
    assert substring.without_repeats(none).count() == 0 and substring.repeated_passages(none).count() == 0


# --- 9 -----------------------------------------------------------------------------------------------------------------
def test_mixing_meets_its_limits(spark):
    sizes = {"a": 1000, "b": 200, "c": 50, None: 10}
    rows = [(k * 10_000 + i, s, "w " * 10) for k, (s, n) in enumerate(sizes.items()) for i in range(n)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, max_repeats=3.0)
    times = {r.source: r.n for r in got.groupBy("source").agg(F.count("*").alias("n")).collect()}
    p = {s: n / 1260 for s, n in sizes.items()}
    a = 1 - math.log(3) / math.log(p["a"] / p[None])
    for s, n in sizes.items():
        assert abs(times[s] - n * (p["a"] / p[s]) ** (1 - a)) <= 1
    assert got.select("doc_id").distinct().count() == len(rows) and times["a"] == 1000 and times[None] == 30
    assert got.groupBy("doc_id", "epoch").count().where("count > 1").count() == 0
    target = 1.2
    w = mixing.find_exponent(spark.createDataFrame([(str(s), n) for s, n in sizes.items()], "s string, tokens long"), 1260, target, None, None)
    z = sum(q**w.exponent for q in p.values())
    assert -sum(q**w.exponent / z * math.log(q**w.exponent / z) for q in p.values()) == pytest.approx(target, abs=1e-6)


def test_mixing_keeps_to_a_budget(spark):
    rnd = random.Random(9)
    rows = [(i, f"s{i % 3}" if i % 4 else "big", "w " * rnd.randint(1, 400)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    got = mixing.mix(df, max_repeats=None, target_entropy=10.0, budget_tokens=300_000)  # out of reach: equal weights
    sums = got.groupBy("source").agg(F.sum(mixing.word_tokens(F.col("text"))).alias("n")).collect()
    assert all(75_000 - 400 <= r.n <= 75_000 for r in sums) and len(sums) == 4
    again = mixing.mix(df.repartition(7), max_repeats=None, target_entropy=10.0, budget_tokens=300_000)
    assert got.select("doc_id", "epoch", "block_key", "doc_key").exceptAll(again.select("doc_id", "epoch", "block_key", "doc_key")).count() == 0


@pytest.mark.parametrize("fan", [1024, 4])
def test_mixing_against_brute_force(spark, monkeypatch, fan):
    """The rows of the last epoch are those of a plain walk through blocks and documents in the order of their keys; rows that repeat an id go together."""
    monkeypatch.setattr(mixing, "FAN", fan)
    monkeypatch.setattr(mixing, "BLOCK_TOKENS", 500)
    rnd = random.Random(10)
    rows = [(i % 700 if i % 9 else None, f"s{i % 3}" if i % 4 else "big", "w " * rnd.randint(1, 40)) for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    budget = 30_000
    got = mixing.mix(df, max_repeats=None, target_entropy=10.0, budget_tokens=budget)
    drawn = collections.Counter((r.doc_id, r.source, r.text) for r in got.collect())
    size, by_id, held = collections.Counter(), collections.Counter(), collections.Counter(rows)
    for i, s, t in rows:
        size[s] += len(t.split())
        by_id[s, i] += len(t.split())
    hashed = lambda *c: F.xxhash64(F.lit(17), *c)
    keyed = df.select("doc_id", "source").distinct().withColumn("s", F.concat(F.lit("="), "source")).join(spark.createDataFrame([(s, -(-n // 500), int(budget / 4 / n + 1e-9)) for s, n in size.items()], "source string, blocks long, whole long"), "source")
    keyed = keyed.withColumn("block", F.pmod(hashed("s", "doc_id"), "blocks")).select("doc_id", "source", "whole", hashed("whole", "s", "block").alias("k"), hashed("whole", "doc_id").alias("d")).collect()
    times = {}
    for s in size:
        at, rest, over = 0, round((budget / 4 / size[s] - int(budget / 4 / size[s] + 1e-9)) * size[s]), False
        for r in sorted((r for r in keyed if r.source == s), key=lambda r: (r.k, r.d, r.doc_id is not None, r.doc_id or 0)):
            at += by_id[s, r.doc_id]
            over = over or at > rest
            times[s, r.doc_id] = r.whole + (not over)
    assert drawn == collections.Counter({row: n * times[row[1], row[0]] for row, n in held.items() if times[row[1], row[0]]})


def test_mixing_odd_rows(odd, none):
    got = mixing.mix(odd, max_repeats=1.0)
    assert got.count() == len(TEXTS) and got.columns == [*odd.columns, "epoch", "block_key", "doc_key"]
    assert mixing.mix(none).count() == 0


# --- 10 ----------------------------------------------------------------------------------------------------------------
def brute_scan(t):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (t or "").encode()))
    words = [w.decode() for w in words]
    at = [(i, label) for p, label in licenses.BASE_PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in at]
    return len(words), len(at), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in at}))


def test_license_scan(spark, odd, none):
    more = [(20, "MIT License mit license, CC-BY 4.0 apache\nlicense GNU General Public License cc by mit license"), (21, "the mit licensed; xmit license; cc by"), (22, "SPDX-License-Identifier: (MIT OR GPL-2.0-only WITH Classpath-exception-2.0) AND Apache-2.0\n# spdx-license-identifier: MIT AND")]
    df = odd.select("doc_id", "text").unionAll(spark.createDataFrame(more, "doc_id long, text string"))
    got = licenses.license_scan(df).collect()
    want = collections.Counter((i, *brute_scan(t)) for i, t in [*TEXTS, *more])
    assert collections.Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got) == want
    by = {r.doc_id: r for r in got}
    assert by[22].labels == "apache-2.0,gpl-2.0-only with classpath-exception-2.0,mit,permissive" and by[22].score == 1.0
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)
    assert licenses.license_scan(none).count() == 0


def test_license_expressions():
    assert licenses.evaluate("MIT OR GPL-2.0-only AND LGPL-2.1-only") == (["gpl-2.0-only", "lgpl-2.1-only", "mit"], True)
    assert licenses.evaluate("(MIT OR GPL-2.0-only) AND GPL-3.0-only")[1] is False
    for bad in ("", "MIT OR", "OR MIT", "MIT GPL", "(MIT", "MIT)", "()", "MIT WITH", "(MIT OR ISC) WITH X", "the", "MIT AND the", "MIT WITH the", "(MIT OR ISC) WITH LLVM-exception", "Classpath-exception-2.0"):
        assert licenses.evaluate(bad) is None
    assert licenses.evaluate("LicenseRef-own.1 OR DocumentRef-x:LicenseRef-y") == (["documentref-x:licenseref-y", "licenseref-own.1"], False)
    assert licenses.evaluate("GPL-2.0-or-later WITH Classpath-exception-2.0 OR BSD-3-Clause-Clear AND CC-BY-SA-4.0") == (["bsd-3-clause-clear", "cc-by-sa-4.0", "gpl-2.0-or-later with classpath-exception-2.0"], False)


def test_long_expressions_take_time_in_proportion():
    for unit in ("MIT OR ", "(", "GPL-2.0-only WITH Classpath-exception-2.0 AND "):
        begin = time.perf_counter()
        licenses.scan(("SPDX-License-Identifier: " + unit * (1_000_000 // len(unit)) + "MIT").encode())
        assert time.perf_counter() - begin < 4, unit


def test_license_tags():
    """A tag takes the longest expression after it; many tags on a line take time in proportion."""
    of = lambda t: licenses.scan(t)[5:]
    assert of(b"SPDX-License-Identifier: MIT This program is free") == ("mit,permissive", 1.0, ["mit"])
    assert of(b"x SPDX-License-Identifier: MIT. And then") == ("mit,permissive", 1.0, ["mit"])
    assert of(b"SPDX-License-Identifier: MIT SPDX-License-Identifier: GPL-2.0-only\nISC")[2] == ["mit", "gpl-2.0-only"]
    assert of(b"SPDX-License-Identifier: MIT OR SPDX-License-Identifier: (ISC, x)") == ("mit,permissive,spdx-malformed", 1.0, ["mit", "( isc"])
    assert of(b"SPDX-License-Identifier: the file is free") == ("spdx-malformed", 0.5, [""])
    assert of(b"SPDX-License-Identifier: MIT and the rest of prose") == ("mit,permissive", 1.0, ["mit"])
    assert of(b"SPDX-License-Identifier: DocumentRef-a.b:LicenseRef-c with prose")[2] == ["documentref-a.b:licenseref-c"]
    assert of(b"SPDX-License-Identifier:\nMIT") == ("spdx-malformed", 0.5, [""]) and of(b"spdx license identifier MIT") == ("", 0.0, [])
    begin = time.perf_counter()
    assert len(licenses.scan(b"SPDX-License-Identifier: MIT OR ISC " * 29_000)[-1]) == 29_000
    assert time.perf_counter() - begin < 3


def test_license_scan_of_the_documents(spark):
    """Base columns, labels and score against a search word by word; the documents hold no tags."""
    docs = documents(spark)
    for r in queries.op10_license_scan(spark, SF).collect():
        text = docs[r.doc_id].text
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == brute_scan(text)
        words = " " + " ".join(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), text or ""))) + " "
        more = {label for phrase, label in licenses.MORE_PHRASES.items() if f" {phrase} " in words}
        assert "spdx license identifier" not in words
        assert r.labels == ",".join(sorted(more | set(filter(None, r.base_labels.split(","))))) and r.score == (0.9 if r.n_base else 0.8 if more else 0.0)


# --- shared ------------------------------------------------------------------------------------------------------------
def test_span_hashes_tell_words_apart():
    words = [b"a", b"aa", b"ab", b"ba", b"\x00", b"\x00\x00", b"a\x00", b"", b"b"]
    data = np.frombuffer(b"".join(words), np.uint8)
    ends = np.cumsum([len(w) for w in words])
    hashes = common.span_hashes(data, ends - [len(w) for w in words], ends)
    assert len(set(hashes.tolist())) == len(words)


def test_shared_folder_needs_a_setting_on_a_cluster():
    class Conf:
        def get(self, *_):
            return None

    class Cluster:
        conf = Conf()

        class sparkContext:  # noqa: N801
            master = "spark://somewhere"

    with pytest.raises(ValueError):
        common.shared_folder(Cluster())


def test_like_documents_links_every_pair_that_is_alike(spark, monkeypatch):
    """The components are those of all pairs of a 5-word Jaccard similarity of 0.8 or more, in a family of many edits and beside it."""
    if hasattr(simhash, "ORDER_SETS"):
        monkeypatch.setattr(simhash, "ORDER_SETS", 50)  # the order of shingles is no part of the result
    rnd, words = random.Random(4), [f"w{k}" for k in range(400)]
    rows = []
    for family in range(60):
        base = [rnd.choice(words) for _ in range(rnd.randint(20, 120))]
        for _ in range(60 if family == 0 else rnd.randint(1, 4)):
            edited = [*base]
            for _ in range(rnd.randint(0, max(1, len(base) // 40))):
                edited[rnd.randrange(len(base))] = rnd.choice(words)
            rows.append((len(rows), " ".join([*words[:12], *edited][: rnd.randint(len(base), len(base) + 12)])))
    for _ in range(150):  # copies that are edited until the next edit would part them
        base = [rnd.choice(words) for _ in range(rnd.randint(60, 150))]
        last = edited = [*base]
        while jaccard(runs_of(" ".join(base), 5), runs_of(" ".join(edited), 5)) >= 0.8:
            last, edited = edited, [*edited]
            edited[rnd.randrange(len(base))] = rnd.choice(words)
        rows += [(len(rows), " ".join(base)), (len(rows) + 1, " ".join(last))]
    runs = {d: runs_of(t, 5) for d, t in rows}
    least = {d: d for d in runs}
    for a in runs:
        for b in range(a):
            if jaccard(runs[a], runs[b]) >= 0.8 and least[a] != least[b]:
                low, high = sorted((least[a], least[b]))
                least = {d: low if c == high else c for d, c in least.items()}
    assert len(set(least.values())) < len(rows) - 80
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r.component_id for r in simhash.like_documents(df).collect()}
    wrong = sum(got[d] != least[d] for d in least)
    assert wrong == 0, f"{wrong} of {len(rows)} documents"


def test_a_family_of_like_texts_is_not_paired_in_full(spark, monkeypatch):
    """Of k texts that are all alike only some of the k x k pairs are verified, and one that is alike to a few of them is linked still."""
    rnd = random.Random(12)
    base = [f"v{rnd.randrange(10**6)}" for _ in range(200)]
    rows = []
    for k in range(150):
        edited = [*base]
        edited[rnd.randrange(200)] = f"e{k}"
        rows.append((k, " ".join(edited)))
    first = rows[0][1].split()
    far = [*first[:20], *(f"f{k}" for k in range(20)), *first[40:]]  # alike to few of them at most
    rows += [(150, " ".join(far)), (151, " ".join(f"o{k}" for k in range(100)))]
    least = {d: d for d, _ in rows}
    runs = {d: runs_of(t, 5) for d, t in rows}
    for a in runs:
        for b in runs:
            if a < b and least[a] != least[b] and jaccard(runs[a], runs[b]) >= 0.8:
                low, high = sorted((least[a], least[b]))
                least = {d: low if c == high else c for d, c in least.items()}
    verified, whole = [], simhash._similar

    def counting(pairs, sets):
        verified.append(pairs.count())
        return whole(pairs, sets)

    monkeypatch.setattr(simhash, "_similar", counting)
    got = {r.doc_id: r.component_id for r in simhash.like_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == least and len(set(least.values())) in (2, 3)
    assert sum(verified) < 150 * 149 // 4


def test_what_the_same_unlike_texts_share_meets_once(spark, monkeypatch):
    """Shingles of one and the same sets, whose pairs are not alike, stand in the join across components once, not each."""
    shared = " ".join(f"s{k}" for k in range(200))
    rows = [(k, " ".join([*(f"{k}x{j}" for j in range(90)), shared])) for k in range(7)]
    met, write = [], common.written

    def writing(df, *args, **named):
        out = write(df, *args, **named)
        if {"run", "part"} <= {*out.columns}:
            met.append(out.count())
        return out

    monkeypatch.setattr(simhash, "ORDER_LAST", 1)  # as if they were not known to be frequent
    monkeypatch.setattr(common, "written", writing)
    got = {r.doc_id: r.component_id for r in simhash.like_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == {d: d for d, _ in rows}
    assert 0 < sum(met) < 100


def test_dedup_leaves_only_the_tables_that_its_result_reads(spark):
    rnd = random.Random(15)
    passage = made_up(rnd, 60)
    df = spark.createDataFrame([(i, f"{made_up(rnd, 40)} {passage if i % 3 else ''}") for i in range(12)] + [(20, passage), (21, passage)], "doc_id long, text string")
    before = {*common._FOLDERS}
    kept = simhash.one_of_each(df)
    assert len({*common._FOLDERS} - before) == 1 and {r.doc_id for r in kept.collect()} == {*range(12), 20}
    cut = substring.without_repeats(df)
    assert len({*common._FOLDERS} - before) == 2 and cut.count() == 14 and sum(passage in r.text for r in cut.collect()) == 1


def test_passages_stand_alike_without_counts(spark):
    """What is cut does not depend on whether words are counted."""
    rnd = random.Random(13)
    passage = made_up(rnd, 60)
    rows = [(i, f"{made_up(rnd, 80)} {passage if i % 3 else ''} {made_up(rnd, 80)}") for i in range(12)] + [(20, passage + " " + passage)]
    keyed = substring._keyed(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text")
    spans = [{(r.doc_id, s.start, s.chars, s.first_doc_id) for r in substring._passages(keyed, counted=c).collect() for s in r.spans} for c in (True, False)]
    assert spans[0] == spans[1] and len(spans[0]) >= 7
