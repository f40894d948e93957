"""The operators as named queries over the given tables, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from forgeboard.llm import (
    arrowfiles,
    bpe,
    divergence,
    jaccard,
    packing,
    phrases,
    quality,
    runs,
    sharding,
    tokens,
    topk,
    toxicity,
    urls,
)
from forgeboard.llm.frames import table
from forgeboard.session import shared_dir

Query = Callable[[SparkSession, str], DataFrame]


def op1_crf_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.learn(docs, table(spark, sf_dir, "labels")))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(table(spark, sf_dir, "documents"))


def op3_site_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_pivot_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(table(spark, sf_dir, "embeddings"))


def op5_distribution_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.judge(table(spark, sf_dir, "documents"))


def op6_minimum_slack_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op7_partition_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(table(spark, sf_dir, "documents"))


def op8_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_decode(table(spark, sf_dir, "documents"))


def op9_kd_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"))


def op10_arrow_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = arrowfiles.write(table(spark, sf_dir, "documents"), shared_dir(spark, "arrow-tokens"))
    return arrowfiles.read_documents(spark, manifest)


def op11_cover_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.periodic_runs(table(spark, sf_dir, "documents"), tails=True)


def op12_phrase_tries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages")).drop("n_tried")


QUERIES: dict[str, Query] = {
    "op1_crf_toxicity": op1_crf_toxicity,
    "op2_token_counts": op2_token_counts,
    "op3_site_quality": op3_site_quality,
    "op4_pivot_top_k": op4_pivot_top_k,
    "op5_distribution_divergence": op5_distribution_divergence,
    "op6_minimum_slack_packing": op6_minimum_slack_packing,
    "op7_partition_jaccard_join": op7_partition_jaccard_join,
    "op8_bpe_round_trip": op8_bpe_round_trip,
    "op9_kd_tree_shards": op9_kd_tree_shards,
    "op10_arrow_token_files": op10_arrow_token_files,
    "op11_cover_runs": op11_cover_runs,
    "op12_phrase_tries": op12_phrase_tries,
    "op13_url_rules": op13_url_rules,
}

ORACLE: dict[str, str] = {
    "op4_pivot_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e
            FROM embeddings
        ),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id,
                CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON c.vec_id <> q.vec_id
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id,
            CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
            vec_id, score
        FROM s
        QUALIFY rank <= 5
    """,
    "op12_phrase_tries": r"""
        WITH piece AS (
            SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ),
        words AS (
            SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda w: w <> '') AS w FROM piece
        ),
        totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
        grams AS (
            SELECT lang, size,
                unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(w[i : i + size - 1], ' '))) AS g
            FROM words, (VALUES (1), (2), (3), (4)) s(size)
            WHERE len(w) >= size
        ),
        held AS (
            SELECT lang, size, g, string_split(g, ' ') AS w, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30
        ),
        parts AS (
            SELECT lang, g, a, k, array_to_string(w[1:k], ' ') AS head, array_to_string(w[k + 1:], ' ') AS rest
            FROM held, (VALUES (1), (2), (3)) c(k)
            WHERE k < size
        ),
        best AS (
            SELECT p.lang, p.g, p.a, l.a AS l, r.a AS r,
                CAST(CAST(2000000 AS HUGEINT) * p.a // (CAST(l.a AS HUGEINT) + r.a) AS BIGINT) AS score
            FROM parts p
            JOIN held l ON l.lang = p.lang AND l.g = p.head
            JOIN held r ON r.lang = p.lang AND r.g = p.rest
            QUALIFY row_number() OVER (PARTITION BY p.lang, p.g ORDER BY score, k) = 1
        ),
        inner_ones AS (
            SELECT lang, array_to_string(w[i : i + n - 1], ' ') AS g, max(a) AS longer
            FROM held, (VALUES (2), (3)) s(n), (VALUES (1), (2), (3)) p(i)
            WHERE n < size AND i + n - 1 <= size
            GROUP BY ALL
        ),
        ranked AS (
            SELECT b.lang, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.g) AS rank,
                b.g AS phrase, a, l, r, score
            FROM best b LEFT JOIN inner_ones i ON i.lang = b.lang AND i.g = b.g
            WHERE i.longer IS NULL OR 100 * i.longer < 80 * a
        )
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
    "op13_url_rules": r"""
        WITH address AS (
            SELECT row_number() OVER () AS r, page_id,
                translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
                    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
            FROM pages
        ),
        site(rule, of, start, verdict) AS (VALUES
            ('com/', 'com', '/', 'allow'),
            ('example.com/en/', 'example.com', '/en/', 'block'),
            ('www.example.com/en/', 'www.example.com', '/en/', 'allow'),
            ('net/es/', 'net', '/es/', 'block'),
            ('net/fr/', 'net', '/fr/', 'block')
        ),
        pattern(name, expression, verdict) AS (VALUES
            ('||spam-*', '^([^/]*\.)?spam-', 'block'),
            ('||casino-*', '^([^/]*\.)?casino-', 'block'),
            ('||cheap-*', '^([^/]*\.)?cheap-', 'block'),
            ('-pills.', '-pills\.', 'block'),
            ('/wp-login.', '/wp-login\.', 'block'),
            ('/wp-admin/', '/wp-admin/', 'block'),
            ('/cgi-bin/', '/cgi-bin/', 'block'),
            ('/login^', '/login([^0-9A-Za-z_.%-]|$)', 'block'),
            ('/cart^', '/cart([^0-9A-Za-z_.%-]|$)', 'block'),
            ('/search^', '/search([^0-9A-Za-z_.%-]|$)', 'block'),
            ('/spam-report^', '/spam-report([^0-9A-Za-z_.%-]|$)', 'allow'),
            ('/help/search^', '/help/search([^0-9A-Za-z_.%-]|$)', 'allow')
        ),
        sites AS (
            SELECT r, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
            FROM address JOIN site ON (host = of OR ends_with(host, '.' || of)) AND starts_with(path, start)
            GROUP BY r
        ),
        patterns AS (
            SELECT r, name, verdict FROM address JOIN pattern ON regexp_matches(host || path, expression)
            QUALIFY row_number() OVER (PARTITION BY r ORDER BY length(name) DESC, verdict, name DESC) = 1
        )
        SELECT a.page_id, a.host, a.path, s.rule, coalesce(s.verdict, p.verdict, 'allow') AS verdict,
            CASE WHEN s.rule IS NULL THEN p.name END AS pattern
        FROM address a LEFT JOIN sites s ON s.r = a.r LEFT JOIN patterns p ON p.r = a.r
    """,
}
