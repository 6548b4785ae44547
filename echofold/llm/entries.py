"""Queries of the training-data operators and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..runtime import table
from . import decontaminate, html_extract, mixing, ordinal_quality, source_audit, toxicity, winnowing
from .kdtree_topk import top_k
from .minhash_forest import near_duplicates
from .mixing import MOST, UNIT
from .prefix_tokens import count_tokens
from .substring_dedup import repeat_digests
from .url_filter import RULE_SCHEMA, judge_urls

#: The rules of op8_url_filter.
URL_RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]

#: Production mix: at most so many passes over a source, towards this entropy (nats) of the sources.
MAX_REPETITION, TARGET_ENTROPY = 4.0, 2.9


def op1_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), size=2, percent=80)


def op2_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"), limit=4096)


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return ordinal_quality.grade(docs, ordinal_quality.train(docs, table(spark, sf_dir, "labels")))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeat_digests(table(spark, sf_dir, "documents"), length=50)


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(table(spark, sf_dir, "pages"), html_extract.trained())


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), repetition=MAX_REPETITION, entropy=TARGET_ENTROPY)


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), spark.createDataFrame(URL_RULES, RULE_SCHEMA))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.fingerprints(table(spark, sf_dir, "documents"))


def op12_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit(table(spark, sf_dir, "documents"))


QUERIES = {"op1_near_duplicates": op1_near_duplicates, "op2_topk": op2_topk, "op3_token_counts": op3_token_counts, "op4_quality": op4_quality, "op5_substring_dedup": op5_substring_dedup, "op6_html_extraction": op6_html_extraction, "op7_mixing": op7_mixing, "op8_url_filter": op8_url_filter, "op9_decontamination": op9_decontamination, "op10_toxicity": op10_toxicity, "op11_fingerprints": op11_fingerprints, "op12_source_audit": op12_source_audit}

ORACLES = {
    "op2_topk": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
            FROM embeddings
            WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
              AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                   CAST(list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e)
            WHERE q.vec_id % 50 = 0
        )
        SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
        FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        WHERE rank <= 5""",
    "op8_url_filter": r"""
        WITH rules(rule_host, rule_path, rule_verdict) AS (
            VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'),
                   ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
        ), u AS (
            SELECT row_number() OVER () AS r, page_id,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), p AS (
            SELECT r, page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM u
        ), hit AS (
            SELECT r, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule,
                   arg_max(rule_verdict, length(rule_host || rule_path)) AS v
            FROM p JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
            GROUP BY r
        )
        SELECT page_id, host, path, rule, coalesce(v, 'allow') AS verdict FROM p LEFT JOIN hit USING (r)""",
    "op1_near_duplicates": r"""
        WITH RECURSIVE w AS (
            SELECT doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), []) AS w
            FROM documents
        ), sh AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 2 THEN w ELSE list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]) END) AS s FROM w
        ), n AS (
            SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id
        ), common AS (
            SELECT a.doc_id AS l, b.doc_id AS r, count(*) AS k FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2
        ), link AS (
            SELECT l, r FROM common JOIN n x ON x.doc_id = l JOIN n y ON y.doc_id = r WHERE 100 * k >= 80 * (x.n + y.n - k)
        ), e AS (
            SELECT l AS u, r AS v FROM link UNION SELECT r, l FROM link
        ), reach(node, other) AS (
            SELECT DISTINCT u, u FROM e UNION SELECT reach.node, e.v FROM reach JOIN e ON e.u = reach.other
        ), c AS (
            SELECT node, min(other) AS component FROM reach GROUP BY node
        )
        SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, coalesce(component, d.doc_id) AS component_id, coalesce(component, d.doc_id) = d.doc_id AS kept
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.node = d.doc_id""",
    "op7_mixing": rf"""
        WITH RECURSIVE c AS (
            SELECT doc_id, source, CAST(greatest(1, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))) AS BIGINT) AS n FROM documents
        ), t AS (
            SELECT source, CAST(sum(n) AS BIGINT) AS tokens FROM c GROUP BY source
        ), b AS (
            SELECT CAST(sum(tokens) AS BIGINT) AS budget, list(tokens) AS tokens, list(CAST(tokens AS DOUBLE) / (SELECT max(tokens) FROM t)) AS share FROM t
        ), find(step, goal, low, high, budget, tokens, share) AS (  -- bisection: 0 the entropy, 1 and 2 the bounds of the repetition
            SELECT 0, goal, low, high, budget, tokens, share FROM b, (VALUES (0, 0::DOUBLE, {MOST}::DOUBLE), (1, 0::DOUBLE, 1::DOUBLE), (2, 1::DOUBLE, {MOST}::DOUBLE)) AS g(goal, low, high)
            UNION ALL
            SELECT step + 1, goal, CASE WHEN low_side THEN mid ELSE low END, CASE WHEN low_side THEN high ELSE mid END, budget, tokens, share
            FROM (
                SELECT *, CASE goal WHEN 0 THEN ln(z) - list_sum(list_transform(v, lambda x: CASE WHEN x > 0 THEN x * ln(x) ELSE 0 END)) / z > {TARGET_ENTROPY}::DOUBLE
                                    WHEN 1 THEN r > {MAX_REPETITION}::DOUBLE * (1 + 1e-9::DOUBLE) ELSE r <= {MAX_REPETITION}::DOUBLE * (1 + 1e-9::DOUBLE) END AS low_side
                FROM (SELECT *, list_sum(v) AS z, list_max(list_transform(range(1, len(v) + 1), lambda i: v[i] / tokens[i])) / list_sum(v) * budget AS r
                      FROM (SELECT *, (low + high) / 2 AS mid, list_transform(share, lambda x: pow(x, (low + high) / 2)) AS v FROM find WHERE step < 60))
            )
        ), a AS (
            SELECT round(CASE WHEN e < 1 THEN greatest(e, least) ELSE least(e, most) END, 6) AS a
            FROM (SELECT max(high) FILTER (WHERE goal = 0) AS e, max(high) FILTER (WHERE goal = 1) AS least, max(high) FILTER (WHERE goal = 2) AS most FROM find WHERE step = 60)
        ), v AS (
            SELECT source, t.tokens, budget, CAST(pow(CAST(t.tokens AS DOUBLE) / (SELECT max(tokens) FROM t), a) AS DECIMAL(38, 12)) AS v FROM t, a, b
        ), plan AS (
            SELECT source, tokens, budget, target, target // tokens AS full_passes, target % tokens AS room, CAST(target AS DOUBLE) / tokens AS passes
            FROM (SELECT source, tokens, budget, CAST(round(CAST(v AS DOUBLE) / CAST((SELECT sum(v) FROM v) AS DOUBLE) * budget) AS BIGINT) AS target FROM v)
        ), every AS (
            SELECT doc_id, c.source, n, pass_no, full_passes, room, passes, ceil(budget / 1048576::DOUBLE) AS n_blocks,
                   CAST('0x' || substr(md5('mix:' || pass_no || ':' || doc_id || ':0'), 1, 10) AS BIGINT) AS spot
            FROM (SELECT *, unnest(range(0, full_passes + 1)) AS pass_no FROM plan) p JOIN c ON c.source IS NOT DISTINCT FROM p.source
        ), summed AS (
            SELECT *, sum(n) OVER (PARTITION BY source, pass_no ORDER BY spot, doc_id RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM every
        )
        SELECT doc_id, source, n AS n_tokens, CAST(pass_no AS INTEGER) AS pass_no,
               CAST(least(floor((pass_no + spot / {UNIT}::DOUBLE) / passes * n_blocks), n_blocks - 1) AS INTEGER) AS block,
               CAST('0x' || substr(md5('mix:b' || pass_no || ':' || doc_id || ':0'), 1, 10) AS BIGINT) AS place
        FROM summed WHERE pass_no < full_passes OR upto <= room""",
    "op5_substring_dedup": r"""
        WITH w AS (
            SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents
        ), starts AS (
            SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50
        ), win AS (
            SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM starts
        ), lead AS (
            SELECT h, min(doc_id) AS d FROM win GROUP BY h
        ), gone AS (
            SELECT DISTINCT doc_id, p FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN lead USING (h) WHERE doc_id > d)
        ), pos AS (
            SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM w
        ), kept AS (
            SELECT pos.doc_id, string_agg(word, ' ' ORDER BY pos.p) AS t
            FROM pos LEFT JOIN gone ON gone.doc_id = pos.doc_id AND gone.p = pos.p WHERE gone.p IS NULL GROUP BY 1
        ), cut AS (
            SELECT doc_id, count(*) AS g FROM gone GROUP BY 1
        )
        SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
        FROM w LEFT JOIN cut ON cut.doc_id = w.doc_id LEFT JOIN kept ON kept.doc_id = w.doc_id""",
    "op12_source_audit": r"""
        WITH d AS (
            SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                   regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
            FROM documents
        ), occurrence AS (
            SELECT r, lang, source, unnest(terms) AS term FROM d
        ), kept AS (
            SELECT lang, term, count(*) AS n_lang FROM occurrence GROUP BY lang, term HAVING count(DISTINCT r) >= 10
        ), grp AS (
            SELECT DISTINCT lang, source FROM d
        ), c AS (
            SELECT lang, source, term, count(*) AS n FROM occurrence GROUP BY ALL
        ), dense AS (
            SELECT grp.lang, grp.source, kept.term, coalesce(n, 0) AS n, n_lang
            FROM grp JOIN kept USING (lang) LEFT JOIN c ON c.lang = grp.lang AND c.source = grp.source AND c.term = kept.term
        ), size_of AS (
            SELECT lang, source, sum(n) AS total, count(*) AS v, sum(n_lang) AS total_lang FROM dense GROUP BY lang, source
        ), p AS (
            SELECT lang, source, term, n,
                   CAST(1 + 1000000000::HUGEINT * (n + 2) // (total + 2 * v) AS BIGINT) AS p,
                   CAST(1 + 1000000000::HUGEINT * (n_lang + 2) // (total_lang + 2 * v) AS BIGINT) AS q
            FROM dense JOIN size_of USING (lang, source)
        ), far AS (
            SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value
            FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL
        ), part AS (
            SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
            FROM grp a JOIN grp b ON a.lang = b.lang AND a.source <> b.source
            LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source
            UNION ALL
            SELECT lang, source, 'term', term, (p - q) * (p - q) // (p + q) FROM p WHERE n > 0 AND p > q
        )
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM part)
        WHERE part = 'pair' OR rank <= 10""",
}
