"""The operators over their whole tables with production parameters, by query name."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetgauge.llm.chunked_bpe import chunk_reuse_encoding
from fleetgauge.llm.common import table
from fleetgauge.llm.hard_negatives import hard_negatives
from fleetgauge.llm.host_reputation import Rule, judged_pages
from fleetgauge.llm.nearest import nearest_by_inner_product
from fleetgauge.llm.ngram_join import ngram_components
from fleetgauge.llm.packing import harmonic_packing
from fleetgauge.llm.paragraph_sketch import document_fingerprints
from fleetgauge.llm.phrase_mining import collocations
from fleetgauge.llm.preferences import echoed_answers, preference_pairs
from fleetgauge.llm.quality import quality_scores
from fleetgauge.llm.secrets import secret_findings
from fleetgauge.llm.suffix_dedup import suffix_array_dedup
from fleetgauge.llm.warc import warc_round_trip

TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_components(table(spark, folder, "documents"))


def op2_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return document_fingerprints(table(spark, folder, "documents"))


def op3_preferences(spark: SparkSession, folder: str) -> DataFrame:
    return preference_pairs(*echoed_answers(table(spark, folder, "conversations")))


def op4_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc_round_trip(table(spark, folder, "pages"))


def op5_quality(spark: SparkSession, folder: str) -> DataFrame:
    return quality_scores(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op6_multiprobe(spark: SparkSession, folder: str) -> DataFrame:
    rows = table(spark, folder, "embeddings")
    return nearest_by_inner_product(rows, rows.filter("vec_id % 20 = 0"))


def op7_secrets(spark: SparkSession, folder: str) -> DataFrame:
    return secret_findings(table(spark, folder, "documents"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffix_array_dedup(table(spark, folder, "documents"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return harmonic_packing(table(spark, folder, "documents"), TOKENIZER)


def op10_chunked_bpe(spark: SparkSession, folder: str) -> DataFrame:
    return chunk_reuse_encoding(table(spark, folder, "documents"), TOKENIZER)


URL_RULES = (
    Rule("allow", "org", "/"),
    Rule("block", "example.org", "/es/"),
    Rule("block", "example.org", "/en/1"),
    Rule("allow", "com", "/fr/"),
    Rule("block", "com", "/de/"),
)
#: Names below which anybody may register.
OPEN_SUFFIXES = ("example.com", "example.net", "example.org")


def op11_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    return judged_pages(table(spark, folder, "pages"), URL_RULES, OPEN_SUFFIXES)


def op12_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, folder, "embeddings").withColumn("label", moved)
    return hard_negatives(rows, F.col("vec_id") % 50 == 0)


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations(table(spark, folder, "documents"))


QUERIES = {
    "op1_ngram_join": op1_ngram_join,
    "op2_fingerprints": op2_fingerprints,
    "op3_preferences": op3_preferences,
    "op4_warc": op4_warc,
    "op5_quality": op5_quality,
    "op6_multiprobe": op6_multiprobe,
    "op7_secrets": op7_secrets,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_packing": op9_packing,
    "op10_chunked_bpe": op10_chunked_bpe,
    "op11_url_filter": op11_url_filter,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_collocations": op13_collocations,
}

SQL = {
    "op3_preferences": """
        WITH turns AS (
            SELECT conv_id, turn, role, text,
                max(CASE WHEN role = 'assistant' THEN turn END) OVER (PARTITION BY conv_id) AS last_answer,
                min(turn) OVER (PARTITION BY conv_id) AS first_turn
            FROM conversations),
        openings AS (SELECT conv_id, min(text) AS opening FROM turns WHERE turn = first_turn GROUP BY conv_id),
        sides AS (
            SELECT conv_id AS pair_id, turn, role, coalesce(text, '') AS chosen,
                coalesce(CASE WHEN turn = last_answer AND role = 'assistant' THEN opening ELSE text END, '')
                    AS rejected
            FROM turns JOIN openings USING (conv_id)
            WHERE last_answer IS NULL OR turn <= last_answer),
        ends AS (
            SELECT pair_id, min(CASE WHEN chosen <> rejected THEN turn END) AS ended FROM sides GROUP BY pair_id),
        parts AS (
            SELECT pair_id, turn, role, 'prompt' AS part, chosen AS said FROM sides JOIN ends USING (pair_id)
            WHERE ended IS NULL OR turn < ended
            UNION ALL
            SELECT pair_id, turn, role, 'chosen', chosen FROM sides JOIN ends USING (pair_id) WHERE turn >= ended
            UNION ALL
            SELECT pair_id, turn, role, 'rejected', rejected FROM sides JOIN ends USING (pair_id)
            WHERE turn >= ended)
        SELECT pair_id, part, turn, CAST(1 AS INTEGER) AS copy, role, '<|' || role || '|>' || chr(10) AS header,
            said || chr(10) AS body, part <> 'prompt' AND role = 'assistant' AS trained
        FROM parts""",
    "op4_warc": """
        WITH sized AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes,
                sha1(coalesce(html, '')) AS payload_digest
            FROM pages),
        ranked AS (
            SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS largest FROM sized)
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN 'revisit' ELSE 'response' END
                AS record_type,
            CASE WHEN payload_bytes >= 1000 AND page_id < largest THEN largest END AS refers_to
        FROM ranked""",
    "op11_url_filter": """
        WITH cut AS (
            SELECT page_id, CASE WHEN instr(coalesce(url, ''), '://') > 0
                THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages),
        parts AS (
            SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS given,
                regexp_extract(substr(rest, length(regexp_extract(rest, '^[^/?#]*')) + 1), '^[^?#]*') AS path
            FROM cut),
        hosted AS (
            SELECT page_id, path, translate(given, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host
            FROM parts),
        rules(rule, ruled, rule_host, rule_path) AS (VALUES
            ('org/', 'allow', 'org', '/'), ('example.org/es/', 'block', 'example.org', '/es/'),
            ('example.org/en/1', 'block', 'example.org', '/en/1'), ('com/fr/', 'allow', 'com', '/fr/'),
            ('com/de/', 'block', 'com', '/de/')),
        marked AS (
            SELECT h.*, (SELECT max_by(struct_pack(rule := rule, ruled := ruled), length(rule)) FROM rules
                WHERE (h.host = rule_host OR ends_with(h.host, '.' || rule_host))
                    AND starts_with(h.path, rule_path)) AS hit
            FROM hosted h),
        named AS (
            SELECT *, regexp_replace(host, '^.*@|:[0-9]*$', '', 'g') AS name FROM marked),
        suffixed AS (
            SELECT *, CASE
                WHEN regexp_matches(name, '^[0-9.]+$') THEN name
                WHEN regexp_matches(name, '(^|[.])example[.](com|net|org)$') THEN regexp_extract(name, 'example[.][a-z]+$')
                WHEN regexp_matches(name, '(^|[.])(ac|co|com|edu|gov|net|org)[.][^.]{2}$')
                    THEN regexp_extract(name, '[^.]+[.][^.]+$')
                ELSE regexp_extract(name, '[^.]*$') END AS suffix
            FROM named),
        sited AS (
            SELECT *, CASE WHEN length(name) > length(suffix) + 1
                THEN regexp_extract(left(name, length(name) - length(suffix) - 1), '[^.]*$') || '.' || suffix
                ELSE suffix END AS domain
            FROM suffixed),
        hosts AS (
            SELECT host, domain, suffix, count(hit) AS n, count(*) FILTER (hit.ruled = 'allow') AS good
            FROM sited GROUP BY ALL),
        domains AS (SELECT domain, suffix, sum(n) AS n, sum(good) AS good FROM hosts GROUP BY ALL),
        tops AS (
            SELECT suffix, sum(n) AS n, sum(good) AS good,
                (sum(sum(good)) OVER () + 1.0) / (sum(sum(n)) OVER () + 2.0) AS m
            FROM domains GROUP BY ALL),
        top_weight AS (
            SELECT sum((good - n * m) * (good - n * m) / n - m * (1 - m)) AS a, sum(m * (1 - m) * (n - 1)) AS p
            FROM tops WHERE n > 0),
        top_mean AS (
            SELECT suffix, (good + w * m) / (n + w) AS m FROM tops, (SELECT CASE WHEN coalesce(p, 0) = 0 THEN 1.0
                ELSE 1 / least(greatest(a / p, 0.001), 0.5) - 1 END AS w FROM top_weight)),
        domain_prior AS (SELECT d.*, m FROM domains d JOIN top_mean USING (suffix)),
        domain_weight AS (
            SELECT sum((good - n * m) * (good - n * m) / n - m * (1 - m)) AS a, sum(m * (1 - m) * (n - 1)) AS p
            FROM domain_prior WHERE n > 0),
        domain_mean AS (
            SELECT domain, (good + w * m) / (n + w) AS m FROM domain_prior, (SELECT CASE WHEN coalesce(p, 0) = 0
                THEN 1.0 ELSE 1 / least(greatest(a / p, 0.001), 0.5) - 1 END AS w FROM domain_weight)),
        host_prior AS (SELECT h.*, m FROM hosts h JOIN domain_mean USING (domain)),
        host_weight AS (
            SELECT sum((good - n * m) * (good - n * m) / n - m * (1 - m)) AS a, sum(m * (1 - m) * (n - 1)) AS p
            FROM host_prior WHERE n > 0),
        host_mean AS (
            SELECT host, n + w AS size, (good + w * m) / (n + w) AS m FROM host_prior, (SELECT CASE
                WHEN coalesce(p, 0) = 0 THEN 1.0 ELSE 1 / least(greatest(a / p, 0.001), 0.5) - 1 END AS w
                FROM host_weight))
        SELECT page_id, host, path, hit.rule AS rule, CASE WHEN hit IS NOT NULL THEN hit.ruled
            WHEN m + 1.645 * sqrt(m * (1 - m) / (size + 1)) < 2.0 / 3 THEN 'block' ELSE 'allow' END AS verdict
        FROM sited JOIN host_mean USING (host)""",
    "op12_hard_negatives": """
        WITH rows_ AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
            FROM embeddings
            WHERE label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
            SELECT a.vec_id AS anchor_id, a.label AS own, b.vec_id, b.label,
                CAST(list_inner_product(a.v, b.v) AS BIGINT) AS score
            FROM rows_ a JOIN rows_ b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        positives AS (
            SELECT anchor_id, own, vec_id AS positive_id, score AS positive_score FROM scored WHERE label = own
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
        SELECT p.anchor_id, positive_id, CAST(row_number() OVER hard AS INTEGER) AS rank,
            s.vec_id AS negative_id, positive_score, s.score AS negative_score
        FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND s.label <> p.own
            AND 50 * positive_score <= 100 * s.score AND 100 * s.score <= 95 * positive_score
        WINDOW hard AS (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.vec_id)
        QUALIFY row_number() OVER hard <= 3""",
    "op13_collocations": r"""
        WITH texts AS (
            SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                'abcdefghijklmnopqrstuvwxyz') AS t
            FROM documents),
        pieces AS (SELECT lang, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM texts),
        words AS (
            SELECT lang, list_filter(regexp_split_to_array(piece, '[\x20\x09]+'), lambda x: x <> '') AS w
            FROM pieces),
        starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM words),
        grams AS (SELECT lang, w, i, unnest(range(1, least(5, len(w) - i + 1) + 1)) AS size FROM starts),
        known AS (
            SELECT lang, size, array_to_string(w[i:i + size - 1], ' ') AS phrase, any_value(w[i:i + size - 1]) AS w,
                count(*) AS a
            FROM grams GROUP BY lang, size, phrase HAVING count(*) >= 100),
        totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
        cuts AS (SELECT *, unnest(range(1, size)) AS k FROM known WHERE size > 1),
        scored AS (
            SELECT c.lang, c.phrase, c.size, c.k, c.a, x.a AS l, y.a AS r, n,
                (1000 * CAST(c.a AS HUGEINT) * n) // (CAST(x.a AS HUGEINT) * y.a) AS score
            FROM cuts c JOIN totals USING (lang)
            JOIN known x ON x.lang = c.lang AND x.phrase = array_to_string(c.w[1:c.k], ' ')
            JOIN known y ON y.lang = c.lang AND y.phrase = array_to_string(c.w[c.k + 1:], ' ')
            QUALIFY row_number() OVER (PARTITION BY c.lang, c.phrase ORDER BY score, c.k) = 1),
        held AS (
            SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer
            FROM (SELECT *, unnest(range(1, size - m + 2)) AS i
                FROM (SELECT *, unnest(range(2, size)) AS m FROM known WHERE size > 2))
            GROUP BY ALL)
        SELECT lang, row_number() OVER best AS rank, phrase, a, l, r, CAST(n AS BIGINT) AS n,
            CAST(score AS BIGINT) AS score
        FROM scored LEFT JOIN held USING (lang, phrase)
        WHERE longer IS NULL OR 100 * longer < 100 * a
        WINDOW best AS (PARTITION BY lang ORDER BY score DESC, a DESC, phrase)
        QUALIFY row_number() OVER best <= 2000""",
}
