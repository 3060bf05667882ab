"""Docs from the source formats: keyphrase records, revision archives, parallel translations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import clean_space, nodes_text, paragraph_join, record_text, sanitize_piece
from sievelake.operators.documents import normalize_docs

# Language codes at the end of a work's id.
LANGUAGES = {
    "cs": "Czech", "de": "German", "es": "Spanish", "fa": "Persian", "fr": "French", "hu": "Hungarian", "it": "Italian", "ja": "Japanese",
    "nl": "Dutch", "no": "Norwegian", "pl": "Polish", "pt": "Portuguese", "ru": "Russian", "sv": "Swedish", "ta": "Tamil", "zh": "Chinese",
}


def _family(dataset: str, key: Column) -> Column:
    return F.concat_ws(":", F.lit(dataset), sanitize_piece(key))


def keyphrase_docs(records: DataFrame, dataset: str) -> DataFrame:
    """From name, title, abstract, fulltext, keywords: records without a name or text are left out; keywords go to meta_json."""
    name, text = clean_space(F.col("name")), record_text(F.col("title"), F.col("abstract"), F.col("fulltext"))
    meta = F.to_json(F.struct(name.alias("raw_name"), clean_space(F.col("title")).alias("title"), clean_space(F.col("keywords")).alias("keywords")))
    family = _family(dataset, name)
    kept = records.select(name.alias("name"), text.alias("text"), F.concat(family, F.lit(":orig")).alias("doc_id"), F.lit(dataset).alias("dataset"), family.alias("family_id"), meta.alias("meta_json"))
    return normalize_docs(kept.where("name <> '' AND text <> ''").drop("name"))


def revision_archive_docs(papers: DataFrame, dataset: str = "re3sci") -> DataFrame:
    """From paper_id, version, nodes: version 1 is the original, version 2 its revision."""
    family, later = _family(dataset, F.col("paper_id")), F.col("version") == 2
    return normalize_docs(
        papers.select(
            F.concat(family, F.lit(":v"), "version").alias("doc_id"), F.lit(dataset).alias("dataset"), family.alias("family_id"), nodes_text(F.col("nodes")).alias("text"), F.col("version").alias("version_index"),
            F.when(later, "revision").otherwise("original").alias("variant_type"), F.when(later, F.concat(family, F.lit(":v1"))).alias("source_doc_id"), F.to_json(F.struct(F.col("paper_id").alias("raw_name"))).alias("meta_json"),
        )
    )


def language_of(work_id: Column) -> Column:
    found = F.regexp_extract(work_id, "_([a-z]{2})$", 1)
    return F.when(found != "", found).otherwise("unknown")


def merge_volumes(works: DataFrame) -> DataFrame:
    """Volumes ``<base>_<n>_...`` of a base with several become one work ``<base>_<language>``: paragraphs in the order of n (then
    id), for the translators of the first volume. Other works stay as they are."""
    number = F.regexp_extract("work_id", "_(\\d+)_", 1)
    base = F.when(number != "", F.regexp_extract("work_id", "^(.*?)_\\d+_", 1))
    w = works.select("*", F.coalesce(base, F.lit("")).alias("base"), number.try_cast("int").alias("n"))
    counts = w.where("n IS NOT NULL").groupBy("base").agg((F.count("*") > 1).alias("several"))
    w = w.join(counts, "base", "left").withColumn("several", F.coalesce("several", F.lit(False)) & F.col("n").isNotNull())
    volume = F.struct("n", "work_id", "gt_paras", "source_paras", F.map_entries("translator_data").alias("t"))
    g = w.where("several").groupBy("base").agg(F.sort_array(F.collect_list(F.struct("n", "work_id"))).alias("order"), F.collect_list(volume).alias("v"))
    g = g.withColumn("v", F.array_sort("v", lambda a, b: F.when(a["n"] < b["n"], -1).when(a["n"] > b["n"], 1).when(a["work_id"] < b["work_id"], -1).otherwise(1)))
    join = lambda name: F.flatten(F.transform("v", lambda x: F.coalesce(x[name], F.array().cast("array<string>"))))
    of = lambda key: F.flatten(F.transform("v", lambda x: F.coalesce(F.try_element_at(F.map_from_entries(x["t"]), key)["translator_paras"], F.array().cast("array<string>"))))
    names = F.transform(F.get("v", F.lit(0))["t"], lambda e: e["key"])
    data = F.map_from_entries(F.transform(names, lambda k: F.struct(k.alias("key"), F.struct(of(k).alias("translator_paras")).alias("value"))))
    merged = g.select(F.concat_ws("_", "base", language_of(F.get("order", F.lit(0))["work_id"])).alias("work_id"), join("gt_paras").alias("gt_paras"), join("source_paras").alias("source_paras"), data.alias("translator_data"))
    return w.where("NOT several").select("work_id", "gt_paras", "source_paras", "translator_data").unionByName(merged)


def translation_docs(works: DataFrame, merge: bool = True, dataset: str = "par3") -> tuple[DataFrame, DataFrame]:
    """(machine translations as originals, human ones as variants numbered 1, 2, ... by translator); human ones without text
    are left out, and keep their number."""
    w = (merge_volumes(works) if merge else works).withColumn("lang", language_of(F.col("work_id")))
    named = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair]), F.col("lang")), F.col("lang"))
    meta = ["lang", named.alias("lang_name"), F.size("gt_paras").alias("n_paragraphs"), F.size("translator_data").alias("n_translators")]
    original = F.concat("work_id", F.lit("__gt"))
    gt = w.select(original.alias("doc_id"), F.lit(dataset).alias("dataset"), F.col("work_id").alias("family_id"), paragraph_join(F.col("gt_paras")).alias("text"), F.lit(0).alias("version_index"), F.to_json(F.struct(*meta, F.lit("machine_translation").alias("role"))).alias("meta_json"))
    each = w.select("work_id", "lang", "gt_paras", "translator_data", F.posexplode(F.sort_array(F.map_keys("translator_data"))).alias("at", "who"))
    text = paragraph_join(F.element_at("translator_data", F.col("who"))["translator_paras"])
    human = each.select(
        F.concat_ws("__", "work_id", "who").alias("doc_id"), F.lit(dataset).alias("dataset"), F.col("work_id").alias("family_id"), text.alias("text"), (F.col("at") + 1).alias("version_index"), F.lit("human_translation").alias("variant_type"),
        F.col("who").alias("variant_level"), original.alias("source_doc_id"), F.to_json(F.struct(*meta, F.col("who").alias("translator"), F.lit("human_translation").alias("role"))).alias("meta_json"),
    )
    return normalize_docs(gt), normalize_docs(human.where("text <> ''"))
