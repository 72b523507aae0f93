"""One query for each operator, over its whole table, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import clustering, lexical, licenses, mixing, nbest, quality, simhash, substring, tokenfile, topk, toxicity, urlfilter, warc
from .common import table


def op1_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(table(spark, sf_dir, "documents"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), keep=["doc_id"])


def op4_warc_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    captures = warc.transactions(table(spark, sf_dir, "pages"))
    return captures.select("page_id", "response.payload_bytes", "response.payload_digest", F.col("response.kind").alias("record_type"), "response.refers_to")


def op5_simhash_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op6_sentencepiece_n_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nbest.n_best(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), n=4)


def op7_token_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.token_file(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), digest=True)


def op8_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.repeated_passages(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.explode("spans").alias("s")).select("doc_id", "s.first_doc_id", "s.start", "s.chars", "s.words")


def op9_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", mixing.word_tokens(F.col("text")).alias("n_tokens"))
    return mixing.mix(docs, max_repeats=1.5, tokens=F.col("n_tokens"))


def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("expressions")


def op11_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.url_filter(table(spark, sf_dir, "pages"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.ranked_search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=20)


def op13_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clustering.centroid_clusters(table(spark, sf_dir, "embeddings"), k=8, rounds=10)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_top_k": op1_exact_top_k,
    "op2_quality_rules": op2_quality_rules,
    "op3_toxicity": op3_toxicity,
    "op4_warc_transactions": op4_warc_transactions,
    "op5_simhash_near_duplicates": op5_simhash_near_duplicates,
    "op6_sentencepiece_n_best": op6_sentencepiece_n_best,
    "op7_token_file": op7_token_file,
    "op8_repeated_passages": op8_repeated_passages,
    "op9_source_mixing": op9_source_mixing,
    "op10_license_scan": op10_license_scan,
    "op11_url_filter": op11_url_filter,
    "op12_ranked_search": op12_ranked_search,
    "op13_centroid_clusters": op13_centroid_clusters,
}


def _url_filter_sql() -> str:
    """The models level by level: own and back are the weights of a context's own counts and of the next shorter context."""
    order = urlfilter.ORDER
    fits = lambda host, path: f"(host = '{host}' OR ends_with(host, '.{host}')) AND starts_with(path, '{path}')"
    longest = sorted(urlfilter.RULES, key=lambda r: -len(r[0]) - len(r[1]))
    rule = " ".join(f"WHEN {fits(h, p)} THEN '{h}{p}'" for h, p, _ in longest)
    verdict = " ".join(f"WHEN {fits(h, p)} THEN '{what}'" for h, p, what in longest)
    levels = "".join(
        f"""
        ), p{size} AS (
            SELECT w.gram, w.good_own + w.good_back * p.good AS good, w.bad_own + w.bad_back * p.bad AS bad
            FROM weighed w JOIN p{size - 1} p ON p.gram = substr(w.gram, 2) WHERE length(w.gram) = {size}"""
        for size in range(2, order + 2)
    )
    return rf"""
        WITH parts AS (
            SELECT page_id, coalesce(url, '') AS url,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ), named AS (
            SELECT *, CASE {rule} END AS rule, CASE {verdict} END AS ruled FROM parts
        ), urls AS MATERIALIZED (
            SELECT DISTINCT url, ruled AS label, substr(md5(url), 1, 1) < '{urlfilter.HELD_OUT}' AS held FROM named
        ), places AS MATERIALIZED (
            SELECT url, label, held, substr(padded, i, {order + 1}) AS gram
            FROM (SELECT *, repeat(chr(2), {order}) || url || chr(3) AS padded, unnest(range(1, length(url) + 2)) AS i FROM urls)
        ), grams AS MATERIALIZED (
            SELECT gram, count(*) FILTER (label = 'allow' AND NOT held) AS good, count(*) FILTER (label = 'block' AND NOT held) AS bad
            FROM places GROUP BY gram
        ), counts AS MATERIALIZED (
            SELECT substr(gram, i) AS gram, sum(good) AS good, sum(bad) AS bad
            FROM (SELECT *, unnest(range(1, {order + 2})) AS i FROM grams) GROUP BY 1
        ), contexts AS (
            SELECT left(gram, length(gram) - 1) AS before, sum(good) AS good_n, sum(bad) AS bad_n,
                count(*) FILTER (good > 0) AS good_kinds, count(*) FILTER (bad > 0) AS bad_kinds
            FROM counts GROUP BY 1
        ), weighed AS MATERIALIZED (
            SELECT gram, CASE WHEN good_n > 0 THEN good::DOUBLE / (good_n + good_kinds) ELSE 0 END AS good_own,
                CASE WHEN good_n > 0 THEN good_kinds::DOUBLE / (good_n + good_kinds) ELSE 1 END AS good_back,
                CASE WHEN bad_n > 0 THEN bad::DOUBLE / (bad_n + bad_kinds) ELSE 0 END AS bad_own,
                CASE WHEN bad_n > 0 THEN bad_kinds::DOUBLE / (bad_n + bad_kinds) ELSE 1 END AS bad_back
            FROM counts JOIN contexts ON before = left(gram, length(gram) - 1)
        ), p1 AS (
            SELECT gram, good_own + good_back * uniform AS good, bad_own + bad_back * uniform AS bad
            FROM weighed, (SELECT 1.0::DOUBLE / (count(*) + 1) AS uniform FROM weighed WHERE length(gram) = 1) WHERE length(gram) = 1{levels}
        ), ratios AS (
            SELECT gram, CAST(round((ln(good) - ln(bad)) * {urlfilter.UNITS}) AS BIGINT) AS ratio FROM p{order + 1}
        ), scored AS MATERIALIZED (
            SELECT url, any_value(label) AS label, round(sum(ratio)::DOUBLE / {urlfilter.UNITS} / (length(url) + 1), 6) AS score
            FROM places JOIN ratios USING (gram) WHERE label IS NULL OR held GROUP BY url
        ), bins AS (
            SELECT CAST(greatest(least(floor(score * {urlfilter.STEPS}), {urlfilter.STEPS * urlfilter.FARTHEST}), {-urlfilter.STEPS * urlfilter.FARTHEST}) AS BIGINT) AS bin,
                count(*) FILTER (label = 'allow') AS good, count(*) FILTER (label = 'block') AS bad
            FROM scored WHERE label IS NOT NULL GROUP BY 1
        ), steps AS (
            SELECT unnest(range(min(bin), max(bin) + 2)) AS step FROM bins
        ), worth AS (
            SELECT step, coalesce(sum(bad) FILTER (bin < step), 0) * (SELECT sum(good) FROM bins) + coalesce(sum(good) FILTER (bin >= step), 0) * (SELECT sum(bad) FROM bins) AS worth
            FROM steps, bins GROUP BY step
        ), least AS (
            SELECT step::DOUBLE / {urlfilter.STEPS} AS least FROM worth ORDER BY worth DESC, abs(step), step LIMIT 1
        )
        SELECT page_id, host, path, rule, coalesce(ruled, CASE WHEN score >= least THEN 'allow' ELSE 'block' END) AS verdict,
            CASE WHEN ruled IS NULL THEN score END AS score
        FROM named LEFT JOIN scored USING (url), least
    """


def _centroid_clusters_sql(k: int = 8, rounds: int = 10) -> str:
    """Two steps a round: the nearest centroid of each vector, then the floors of the means."""
    steps = ""
    for r in range(rounds + 1):
        steps += f"""
        ), a{r} AS MATERIALIZED (
            SELECT row, min({{'d': list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT, 'k': k}}) AS best
            FROM v, c{r} GROUP BY row"""
        if r < rounds:
            steps += f"""
        ), m{r} AS (
            SELECT best.k AS k, i, CAST((sum(v[i]) - ((sum(v[i]) % count(*)) + count(*)) % count(*)) / count(*) AS BIGINT) AS x
            FROM a{r} JOIN v USING (row), (SELECT unnest(range(1, 65)) AS i) GROUP BY 1, 2
        ), c{r + 1} AS MATERIALIZED (
            SELECT c.k, coalesce(m.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM m{r} GROUP BY k) m USING (k)"""
    return f"""
        WITH v AS MATERIALIZED (
            SELECT row_number() OVER () AS row, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * x::DOUBLE) AS BIGINT)) AS v
            FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
        ), c0 AS MATERIALIZED (
            SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
            FROM (SELECT sha256('3:' || vec_id) AS h, v FROM v ORDER BY h, v LIMIT {k}){steps}
        ), clusters AS (
            SELECT best.k AS k, CAST(sum(best.d) AS BIGINT) AS cluster_inertia FROM a{rounds} GROUP BY 1
        )
        SELECT vec_id, CAST(best.k AS INTEGER) AS cluster, best.d AS distance, cluster_inertia,
            CAST((SELECT sum(cluster_inertia) FROM clusters) AS BIGINT) AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
        FROM a{rounds} JOIN v USING (row) JOIN c{rounds} c ON c.k = best.k JOIN clusters ON clusters.k = best.k
    """


_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

ORACLE_SQL: dict[str, str] = {
    "op1_exact_top_k": """
        WITH parts AS (
            SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings
        ), usable AS (
            SELECT vec_id FROM parts GROUP BY vec_id HAVING bool_and(x IS NOT NULL AND isfinite(x))
        ), v AS (
            SELECT vec_id, i, CAST(floor(64 * x) AS BIGINT) AS c FROM parts JOIN usable USING (vec_id)
        ), scores AS (
            SELECT q.vec_id AS query_id, x.vec_id, CAST(sum(q.c * x.c) AS BIGINT) AS score
            FROM v q JOIN v x ON q.i = x.i AND q.vec_id <> x.vec_id
            WHERE q.vec_id % 20 = 0 GROUP BY q.vec_id, x.vec_id
        ), ranked AS (
            SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS "rank", vec_id, score
            FROM scores
        )
        SELECT query_id, "rank", vec_id, score FROM ranked WHERE "rank" <= 20
    """,
    "op4_warc_transactions": """
        WITH p AS (
            SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT payload_digest, min(page_id) AS first_page FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN first_page <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN first_page <> page_id THEN first_page END AS refers_to
        FROM p LEFT JOIN f USING (payload_digest)
    """,
    "op11_url_filter": _url_filter_sql(),
    "op12_ranked_search": f"""
        WITH d AS MATERIALIZED (
            SELECT row_number() OVER () AS row, doc_id, {_TERMS} AS terms FROM documents
        ), stats AS (
            SELECT count(*) FILTER (len(terms) > 0) AS all_docs, CAST(sum(len(terms)) AS BIGINT) AS all_terms FROM d
        ), q AS MATERIALIZED (
            SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY item_id, term
        ), tf AS MATERIALIZED (
            SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY row, term
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2 * any_value(all_docs) + 2)::DOUBLE / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf, stats GROUP BY term
        ), lengths AS (
            SELECT row, doc_id, 100 - 25 + (25 * len(terms) * all_docs) // all_terms AS m FROM d, stats
        ), scores AS (
            SELECT item_id, row, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m))) AS BIGINT) AS score
            FROM q JOIN weights USING (term) JOIN tf USING (term) JOIN lengths USING (row) GROUP BY item_id, row, doc_id
        ), ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS "rank" FROM scores WHERE score > 0
        )
        SELECT item_id, "rank", doc_id, score FROM ranked WHERE "rank" <= 20
    """,
    "op13_centroid_clusters": _centroid_clusters_sql(),
}
