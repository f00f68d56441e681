"""One query per operator, over the whole tables, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlight.llm import common, conversations, language_id, quality
from kinlight.llm.best_fit import pack
from kinlight.llm.decontamination import find_contained
from kinlight.llm.exact_dedup import exact_dedup
from kinlight.llm.html_text import extract
from kinlight.llm.mixing import mix
from kinlight.llm.sharding import assign_shards
from kinlight.llm.simhash import alike_links, near_duplicates
from kinlight.llm.substring_dedup import digest, remove_repeats
from kinlight.llm.token_counts import count_tokens
from kinlight.llm.whitening import whiten


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the document of equal text that stays."""
    found = exact_dedup(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component of near-duplicates."""
    return near_duplicates(common.table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op2_simhash_alike(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and its component, over links of near fingerprints and of texts whose
    sets of 5-word shingles have a Jaccard share of 0.8 or more."""
    docs = common.table(spark, sf_dir, "documents")
    return near_duplicates(docs, links=alike_links(docs)).select("doc_id", "fingerprint", "component_id")


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's quality score; labels of one fold are not learnt from."""
    docs = common.table(spark, sf_dir, "documents")
    forest = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.score(docs, forest).select("doc_id", "held_out", "score", "predicted")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard (0 to 7) and slot under the law of equal row counts."""
    placed = assign_shards(common.table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's language; documents of one fold are not learnt from."""
    docs, vocabulary = common.table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    return language_id.identify(docs, vocabulary, language_id.train(docs, vocabulary))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair of a document and a benchmark item that it holds."""
    return find_contained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 4,096 tokens."""
    return pack(common.table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without passages of 13 words that an earlier one has."""
    return digest(remove_repeats(common.table(spark, sf_dir, "documents")))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's main text."""
    return extract(common.table(spark, sf_dir, "pages"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens as byte_bpe_50k counts them."""
    return count_tokens(common.table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation's faults after damage, and its cheapest repair."""
    given = common.table(spark, sf_dir, "conversations")
    found = conversations.reports(conversations.damaged(given), given)
    return found.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every embedding's whitened coordinates on the first 16 components."""
    return whiten(common.table(spark, sf_dir, "embeddings"))


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's words in the mix of all sources."""
    return mix(common.table(spark, sf_dir, "documents")).taken()


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_simhash": op2_simhash,
    "op2_simhash_alike": op2_simhash_alike,
    "op3_quality": op3_quality,
    "op4_sharding": op4_sharding,
    "op5_language_id": op5_language_id,
    "op6_decontamination": op6_decontamination,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_substring_dedup": op8_substring_dedup,
    "op9_html_extraction": op9_html_extraction,
    "op10_token_counts": op10_token_counts,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_whitening": op12_whitening,
    "op13_source_mixing": op13_source_mixing,
}

ORACLE_SQL = {
    "op1_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
               doc_id = min(doc_id) OVER same AS kept, sha256(t) AS text_sha256
        FROM d WINDOW same AS (PARTITION BY t)
    """,
    "op6_decontamination": r"""
        WITH broken AS (
            SELECT doc_id AS id, 'd' AS kind, lower(coalesce(text, '')) AS t FROM documents WHERE doc_id IS NOT NULL
            UNION ALL
            SELECT item_id, 'i', lower(coalesce(text, '')) FROM benchmark WHERE item_id IS NOT NULL
        ), worded AS (
            SELECT id, kind, list_filter(regexp_split_to_array(t, '[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM broken
        ), widths AS (
            SELECT DISTINCT least(len(w), 5) AS k FROM worded WHERE kind = 'i' AND len(w) > 0
        ), item AS (
            SELECT DISTINCT id AS item_id, unnest(list_transform(range(1, len(w) - least(len(w), 5) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 5) - 1), ' '))) AS s
            FROM worded WHERE kind = 'i' AND len(w) > 0
        ), doc AS (
            SELECT DISTINCT id AS doc_id, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(list_slice(w, i, i + k - 1), ' '))) AS s
            FROM worded JOIN widths ON k <= len(w) WHERE kind = 'd'
        ), sizes AS (
            SELECT item_id, count(*) AS n FROM item GROUP BY item_id
        ), found AS (
            SELECT doc_id, item_id, count(*) AS f FROM doc JOIN item USING (s) GROUP BY doc_id, item_id
        )
        SELECT doc_id, item_id, n AS n_shingles, f AS n_found, f::DOUBLE / n AS containment
        FROM found JOIN sizes USING (item_id) WHERE f::DOUBLE / n >= 0.8
    """,
    "op8_substring_dedup": r"""
        WITH worded AS (
            SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
        ), windows AS (
            SELECT doc_id, i, array_to_string(list_slice(w, i, i + 12), ' ') AS s
            FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM worded WHERE len(w) >= 13)
        ), earliest AS (
            SELECT s, min(doc_id) AS first_id FROM windows GROUP BY s
        ), gone AS (
            SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS i FROM windows JOIN earliest USING (s) WHERE first_id < doc_id
        ), lost AS (
            SELECT doc_id, list(i) AS gone FROM gone GROUP BY doc_id
        )
        SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
               sha256(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_transform(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i)), lambda i: w[i]) END, ' ')) AS kept_sha256
        FROM worded LEFT JOIN lost USING (doc_id)
    """,
    "op11_conversation_repair": r"""
        WITH RECURSIVE given AS (
            SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
                   list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
                       string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''),
                       lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
                       lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END) AS inverse
            FROM conversations
        ), faulted AS (
            SELECT conv_id, turn, role, text, xor(inverse, 4294967295) % 20 AS fault FROM given
        ), damaged AS (
            SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role,
                   CASE fault WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
                   unnest(range(CASE WHEN fault = 3 THEN 2 ELSE 1 END)) AS copy
            FROM faulted WHERE fault <> 0
        ), ordered AS (
            SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(octet_length(encode(role)) || ':' || role || ':' || text), copy) AS i,
                   right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS ends
            FROM damaged
        ), marked AS (
            SELECT conv_id, i, turn, role, text, left(role, 1) AS initial, lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS following,
                   CASE WHEN ends = '' THEN 'blank' WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'duplicate'
                        WHEN ends NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'sound' END AS fault
            FROM ordered
        ), inserts(s, edits, t, rows) AS (
            VALUES (0, '', 0, []::VARCHAR[]), (0, 'I', 2, ['user:']), (0, 'II', 3, ['user:', 'assistant:']), (1, '', 1, []), (1, 'I', 2, ['user:']),
                   (1, 'II', 3, ['user:', 'assistant:']), (2, '', 2, []), (2, 'I', 3, ['assistant:']), (3, '', 3, []), (3, 'I', 2, ['user:'])
        ), moves(letter, s, initial, t, role, cost) AS (
            VALUES ('D', 0, NULL, 0, NULL, 3), ('D', 1, NULL, 1, NULL, 3), ('D', 2, NULL, 2, NULL, 3), ('D', 3, NULL, 3, NULL, 3),
                   ('R', 0, NULL, 2, 'user', 2), ('R', 1, NULL, 2, 'user', 2), ('R', 2, NULL, 3, 'assistant', 2), ('R', 3, NULL, 2, 'user', 2),
                   ('K', 0, 's', 1, NULL, 0), ('K', 0, 'u', 2, NULL, 0), ('K', 1, 'u', 2, NULL, 0), ('K', 2, 'a', 3, NULL, 0), ('K', 3, 'u', 2, NULL, 0)
        ), steps AS (
            SELECT inserts.s, m.t, m.letter, inserts.edits || m.letter AS edits, 2 * len(inserts.edits) + m.cost AS cost, inserts.rows, m.initial, m.role
            FROM inserts JOIN moves m ON m.s = inserts.t
        ), paths AS (
            SELECT conv_id, 0::BIGINT AS i, 0 AS s, 0::BIGINT AS cost, '' AS audit, []::VARCHAR[] AS kept FROM (SELECT DISTINCT conv_id FROM marked)
            UNION ALL
            SELECT conv_id, i, s, cost, audit, kept FROM (
                SELECT p.conv_id, m.i, x.t AS s, p.cost + x.cost + CASE WHEN m.fault = 'truncated' AND x.letter <> 'D' THEN 1 ELSE 0 END AS cost, p.audit || x.edits AS audit,
                       p.kept || x.rows || CASE WHEN x.letter = 'D' THEN []::VARCHAR[] ELSE [coalesce(x.role, m.role) || ':' || m.text] END AS kept,
                       row_number() OVER (PARTITION BY p.conv_id, x.t ORDER BY p.cost + x.cost + CASE WHEN m.fault = 'truncated' AND x.letter <> 'D' THEN 1 ELSE 0 END, p.audit || x.edits) AS nth
                FROM paths p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.i = p.i + 1
                JOIN steps x ON x.s = p.s AND (x.letter = 'D' OR m.fault IN ('sound', 'truncated')) AND (x.initial IS NULL OR x.initial = m.initial)
            ) WHERE nth = 1
        ), sizes AS (
            SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'blank') AS blank,
                   count(*) FILTER (fault = 'duplicate') AS duplicate, count(*) FILTER (fault = 'truncated') AS truncated,
                   count(*) FILTER (following IS NOT NULL AND initial || following NOT IN ('su', 'ua', 'au')) AS illegal
            FROM marked GROUP BY conv_id
        ), ended AS (
            SELECT p.conv_id, p.cost + 2 * len(x.edits) AS cost, p.audit || x.edits AS audit, p.kept || x.rows AS kept,
                   row_number() OVER (PARTITION BY p.conv_id ORDER BY p.cost + 2 * len(x.edits), p.audit || x.edits) AS nth
            FROM paths p JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM p.conv_id AND z.n = p.i JOIN inserts x ON x.s = p.s WHERE x.t IN (0, 3)
        )
        SELECT g.conv_id, coalesce(z.gaps, 0)::BIGINT AS gaps, coalesce(z.blank, 0) AS blank, coalesce(z.duplicate, 0) AS duplicate, coalesce(z.truncated, 0) AS truncated,
               coalesce(z.illegal, 0) AS illegal, coalesce(e.cost, 0)::BIGINT AS cost, coalesce(e.audit, '') AS audit, sha256(coalesce(array_to_string(e.kept, chr(10)), '')) AS repaired_sha256
        FROM (SELECT DISTINCT conv_id FROM conversations) g LEFT JOIN sizes z ON z.conv_id IS NOT DISTINCT FROM g.conv_id
        LEFT JOIN ended e ON e.conv_id IS NOT DISTINCT FROM g.conv_id AND e.nth = 1
    """,
}
