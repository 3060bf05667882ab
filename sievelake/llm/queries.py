"""Registered queries of the training-data operators: production parameters, whole tables, full results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.llm.block_dedup import exact_dedup
from sievelake.llm.common import table
from sievelake.llm.html_blocks import extract_main_text
from sievelake.llm.katz import score_katz
from sievelake.llm.mixing import mix_sources
from sievelake.llm.near_dedup import near_duplicate_classes
from sievelake.llm.packing import pack_sequences
from sievelake.llm.quality_rules import score_quality
from sievelake.llm.quotations import link_quotations
from sievelake.llm.secrets import scan_secrets
from sievelake.llm.toxicity import fit_toxicity, score_toxicity


def op1_block_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_sequences(table(spark, sf_dir, "documents")).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


#: Rows that the model learns from.
TRAINING = "crc32(cast(cast(doc_id as string) as binary)) % 7 != 2"


def op3_katz(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.coalesce(~F.expr(TRAINING), F.lit(True))
    scored = score_katz(table(spark, sf_dir, "documents"), TRAINING)
    return scored.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(table(spark, sf_dir, "documents"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["kind"] != "entropy")
    return found.select("doc_id", *[count(k) for k in ("assign", "access", "hex", "entropy")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicate_classes(table(spark, sf_dir, "documents"), shingle=3, percent=85)
    return found.select("doc_id", "n_shingles", "component_id", (F.col("doc_id") == F.col("component_id")).alias("kept"))


def op6_html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.array_join("failed", ",").alias("failed"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit_toxicity(docs, table(spark, sf_dir, "labels"))
    return score_toxicity(docs, model).select("doc_id", F.round("severity", 6).alias("severity"), "grade", F.col("rejected").alias("toxic"))


def op10_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotations(table(spark, sf_dir, "conversations"))


QUERIES = {f.__name__: f for f in (op1_block_dedup, op2_packing, op3_katz, op4_secrets, op5_near_dedup, op6_html_blocks, op7_mixing, op8_quality, op9_toxicity, op10_quotations)}

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

ORACLES = {
    "op1_block_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents)
        SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
               doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
        FROM d""",
    # inverted lists of shingles, then everything reachable over links
    "op5_near_dedup": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array({_LOWER}, '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents),
        g AS (SELECT doc_id, CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
            ELSE list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i : i + 2], ' '))) END AS shingles FROM d),
        s AS (SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM g),
        links AS (SELECT a.doc_id AS src, b.doc_id AS dst FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
        edges AS (SELECT src, dst FROM links UNION ALL SELECT dst, src FROM links),
        reach(node, seen) AS (SELECT src, dst FROM edges UNION SELECT r.node, e.dst FROM reach r JOIN edges e ON r.seen = e.src),
        least AS (SELECT node, min(seen) AS seen FROM reach GROUP BY node)
        SELECT doc_id, len(shingles) AS n_shingles, least(doc_id, coalesce(seen, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(seen, doc_id)) AS kept
        FROM g LEFT JOIN least ON node = doc_id""",
}
