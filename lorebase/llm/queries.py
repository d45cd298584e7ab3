"""The operators' queries over the test tables, and their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from . import byte_bpe, divergence, embeddings, exact, fill_middle, html_text, mixing, piece_count, quality, sharding, simhash, token_files, toxicity
from .common import table

#: Relative weights of the languages that op6 and the pipeline mix to.
TARGETS = {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.14}


def labelled_domains(docs: DataFrame, labels: DataFrame, most: int = 4000) -> DataFrame:
    """The labelled table of the mixture: at most `most` documents that `labels` covers, with their language as domain.

    They are the ones whose ids hash lowest. Only ids are joined and ranked, so that no text is shuffled.
    """
    ids = docs.filter("lang IS NOT NULL").select("doc_id").join(labels.select("doc_id").distinct(), "doc_id", "left_semi").distinct()
    chosen = F.broadcast(ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))  # at most `most` ids
    return docs.join(chosen, "doc_id", "left_semi").select("doc_id", "text", docs["lang"].alias("domain"))


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_bpe.encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, table(spark, sf_dir, "labels")))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.cluster(table(spark, sf_dir, "documents"))


def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.link(table(spark, sf_dir, "embeddings"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_count.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mix(docs, labelled_domains(docs, table(spark, sf_dir, "labels")), TARGETS)


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.duplicates(table(spark, sf_dir, "documents"))


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.write_and_read(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(table(spark, sf_dir, "documents"))


def op12_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), shards=8)


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_byte_bpe, op2_quality, op3_simhash, op4_embedding_dedup, op5_token_counts, op6_mixing, op7_exact_dedup, op8_token_files, op9_html_text, op10_toxicity, op11_fill_in_middle, op12_sharding, op13_source_divergence)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op13_source_divergence": r"""
            WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
            w AS (SELECT r, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS raw FROM d),
            t AS (SELECT r, lang, source, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM w),
            kept AS (SELECT lang, term FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
            c AS (SELECT lang, source, term, count(*)::HUGEINT AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
            g AS (SELECT DISTINCT lang, source FROM d),
            v AS (SELECT lang, count(*)::HUGEINT AS v FROM kept GROUP BY lang),
            total AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY ALL),
            dense AS (
              SELECT lang, source, term, coalesce(n, 0) AS n, 1 + 1000000000 * (coalesce(n, 0) + 1) // (coalesce(total, 0) + v) AS p
              FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN total USING (lang, source)),
            lang_total AS (SELECT lang, sum(n) AS total FROM c GROUP BY lang),
            whole AS (
              SELECT lang, term, 1 + 1000000000 * (sum(n) + 1) // (any_value(total) + any_value(v)) AS q
              FROM c JOIN lang_total USING (lang) JOIN v USING (lang) GROUP BY lang, term),
            sums AS (
              SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
              FROM dense a JOIN dense b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
            pairs AS (
              SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
              FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
              LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
            terms AS (
              SELECT lang, source, 'term' AS part, term AS item, (p - q) * (p - q) // q AS value
              FROM dense JOIN whole USING (lang, term) WHERE n > 0 AND p > q),
            ranked AS (
              SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank
              FROM (FROM pairs UNION ALL FROM terms))
            SELECT lang, source, part, item, value::BIGINT AS value, rank::INT AS rank FROM ranked WHERE part = 'pair' OR rank <= 200""",
        "op11_fill_in_middle": r"""
            WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d FROM documents),
            h AS (
              SELECT *, length(text) AS n, ('0x' || substr(d, 1, 8))::BIGINT AS h1, ('0x' || substr(d, 9, 8))::BIGINT AS h2,
                     ('0x' || substr(d, 17, 8))::BIGINT AS h3, ('0x' || substr(d, 25, 8))::BIGINT AS h4 FROM t),
            c AS (
              SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
                     CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain'
                          WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
            p AS (SELECT *, substr(text, 1, a) AS p, substr(text, a + 1, b - a) AS m, substr(text, b + 1) AS s FROM c)
            SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
                   sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
                   sha256(text) AS restored_sha256 FROM p""",
        "op7_exact_dedup": r"""
            WITH t AS (
              SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
              FROM documents),
            w AS (
              SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS keep_id,
                     count(*) OVER (PARTITION BY text_sha256) AS group_size,
                     row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) AS place
              FROM t)
            SELECT doc_id, keep_id, group_size, place = 1 AS kept, text_sha256 FROM w""",
    }
