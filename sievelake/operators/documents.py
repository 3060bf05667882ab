"""The docs table: normalisation, ids, sets, splits, chunks, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions.text import PYWS, char_chunks, py_words, sanitize_piece, word_chunks
from sievelake.operators.ranks import row_numbers

REQUIRED = ("doc_id", "dataset", "family_id", "text")


def normalize_docs(df: DataFrame, check_unique: bool = True) -> DataFrame:
    """Required columns checked, optional ones defaulted, counts derived; a repeated doc_id is an error (lists ten).

    meta_json stays as it is if it is a string; a struct or map becomes JSON; null becomes {}.
    """
    if missing := [c for c in REQUIRED if c not in df.columns]:
        raise ValueError(f"missing columns: {missing}")
    if check_unique and (twice := df.groupBy("doc_id").count().where("count > 1").select("doc_id").limit(10).collect()):
        raise ValueError(f"repeated doc_id: {[r[0] for r in twice]}")
    opt = lambda c, kind, default=None: (F.coalesce(F.col(c), F.lit(default)) if c in df.columns else F.lit(default)).cast(kind).alias(c)
    text = F.coalesce("text", F.lit(""))
    is_text = "meta_json" not in df.columns or df.schema["meta_json"].dataType.typeName() in ("string", "void", "null")
    meta = opt("meta_json", "string", "{}") if is_text else F.coalesce(F.to_json("meta_json"), F.lit("{}"))
    return df.select(
        *[F.col(c).cast("string").alias(c) for c in REQUIRED[:3]],
        text.alias("text"),
        opt("version_index", "int"),
        opt("variant_type", "string", "original"),
        opt("variant_level", "string"),
        opt("variant_seed", "int"),
        opt("source_doc_id", "string"),
        F.length(text).alias("num_chars"),
        F.size(py_words(text)).alias("num_words"),
        meta.alias("meta_json"),
    )


def family_id(dataset: Column, key: Column) -> Column:
    """dataset:key, sanitised."""
    return F.concat_ws(":", sanitize_piece(dataset), sanitize_piece(key))


def doc_id(family: Column, key: Column) -> Column:
    """family:key; the key is sanitised, the family is sanitised already."""
    return F.concat_ws(":", family, sanitize_piece(key))


def revision_key(version: Column) -> Column:
    return F.concat(F.lit("v"), version.cast("string"))


def build_ids(df: DataFrame, dataset: str, key: str, version: int = 1) -> DataFrame:
    """family_id = dataset:key and new_doc_id = dataset:key:v<version>, from sanitised pieces."""
    return df.withColumn("family_id", family_id(F.col(dataset), F.col(key))).withColumn("new_doc_id", doc_id(F.col("family_id"), revision_key(F.lit(version))))


def whole_chunks(docs: DataFrame) -> DataFrame:
    """A document as its one chunk, for methods that take it whole."""
    return docs.select(F.col("doc_id").alias("chunk_id"), "doc_id", "family_id", F.lit("").alias("dataset"), F.lit(0).alias("chunk_index"))


def concat_keep_first(sets: list[DataFrame], order: str) -> DataFrame:
    """UNION ALL in list order; of equal doc_ids the first set's first row by ``order`` stays."""
    if not sets:
        raise ValueError("no sets")
    every = sets[0].withColumn("set_no", F.lit(0))
    for i, s in enumerate(sets[1:], 1):
        every = every.unionByName(s.withColumn("set_no", F.lit(i)))
    # a grouped minimum, added up before the shuffle, so that a repeated id isn't one task's work
    first = every.groupBy("doc_id").agg(F.min_by(F.struct(*[c for c in every.columns if c != "doc_id"]), F.struct("set_no", order)).alias("row"))
    return first.select("doc_id", "row.*").select(*every.columns)


def build_chunks(docs: DataFrame, size: int = 50, overlap: int = 0, mode: str = "word") -> DataFrame:
    """chunk_id = doc_id::c{i}; documents without text give no chunk."""
    if mode not in ("word", "char"):
        raise ValueError(mode)
    cut = (word_chunks if mode == "word" else char_chunks)(F.col("text"), size, overlap)
    out = docs.select("doc_id", "family_id", "dataset", F.posexplode(cut).alias("chunk_index", "chunk_text"))
    return out.select(F.concat(F.col("doc_id"), F.lit("::c"), "chunk_index").alias("chunk_id"), "doc_id", "family_id", "dataset", "chunk_index", F.length("chunk_text").alias("chunk_len"), F.lit(f"{mode}{size}o{overlap}").alias("chunk_spec"), "chunk_text")


def split_families(docs: DataFrame, seed: int = 42, ratio: float = 0.5) -> DataFrame:
    """family_id, partition: families in order of md5(seed|family), the first round(n * ratio) confidential (half to even).

    Ranks are two-level (by the first two digits of the hash, then within), so no task ranks all families.
    """
    if not 0 < ratio < 1:
        raise ValueError("0 < ratio < 1")
    families = docs.select("family_id").distinct().withColumn("h", F.md5(F.concat(F.lit(f"{seed}|"), "family_id"))).withColumn("b", F.substring("h", 1, 2))
    per = families.groupBy("b").agg(F.count("*").alias("n"))
    base = per.select("b", (F.sum("n").over(W.orderBy("b")) - F.col("n")).alias("base"), F.sum("n").over(W.partitionBy()).alias("total"))  # 256 rows at most
    ranked = families.join(F.broadcast(base), "b").withColumn("rank", F.col("base") + F.row_number().over(W.partitionBy("b").orderBy("h", "family_id")))
    return ranked.select("family_id", F.when(F.col("rank") <= F.bround(F.col("total") * ratio), "confidential").otherwise("benign").alias("partition"))


def apply_split(docs: DataFrame, split: DataFrame, partition: str) -> DataFrame:
    if partition not in ("confidential", "benign"):
        raise ValueError(partition)
    return docs.join(split.where(F.col("partition") == partition), "family_id", "left_semi")


def version_rank(df: DataFrame, family: str, *order: str) -> DataFrame:
    """version_index = 1, 2, ... within the family, nulls last; a family may hold any share of the rows."""
    return row_numbers(df, family, [F.col(c).asc_nulls_last() for c in order], "version_index")


def eligible_families(df: DataFrame, family: str, least: int = 2) -> DataFrame:
    keep = df.groupBy(family).agg(F.max("version_index").alias("m")).where(F.col("m") >= least).select(family)
    return df.join(keep, family, "left_semi")


def latest_revision(df: DataFrame, family: str) -> DataFrame:
    last = df.groupBy(family).agg(F.max("version_index").alias("version_index"))
    return df.join(last, [family, "version_index"], "left_semi")


__all__ = ["PYWS", "apply_split", "build_chunks", "build_ids", "concat_keep_first", "eligible_families", "latest_revision", "normalize_docs", "split_families", "version_rank"]
