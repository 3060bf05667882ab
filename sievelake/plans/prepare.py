"""From source files to prepared sets, one function a data set, and from a prepared set to its variant sets."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators import datasets as DS
from sievelake.operators import revisions as V
from sievelake.operators import variants as M
from sievelake.sources import readers
from sievelake.sources.shared import Stored
from sievelake.sources.storage import save_prepared_set

RECORD = "name string, title string, abstract string, fulltext string, keywords string"


def save_keyphrase_set(spark: SparkSession, path: str, dataset: str, prepared_dir: str) -> str:
    return save_prepared_set(DS.keyphrase_docs(readers.read_records(spark, path, RECORD), dataset), prepared_dir, f"{dataset}_original")


def save_revision_archive_sets(spark: SparkSession, path: str, prepared_dir: str) -> None:
    docs = Stored(DS.revision_archive_docs(readers.read_paper_archive(spark, path)), "papers")
    for version in (1, 2):
        save_prepared_set(docs.df.where(F.col("version_index") == version), prepared_dir, f"re3_v{version}_only")
    docs.drop()


def save_translation_sets(spark: SparkSession, path: str, prepared_dir: str) -> None:
    """Machine and human translations and those of the first translator, with volumes merged and apart."""
    works = readers.read_works(spark, path)
    for suffix, merge in (("", True), ("_split", False)):
        machine, human = DS.translation_docs(works, merge)
        for name, docs in (("gt", machine), ("human", human), ("human_t1", human.where("variant_level = 'translator_1'"))):
            save_prepared_set(docs, prepared_dir, f"par3_{name}{suffix}")


def save_revision_sets(spark: SparkSession, export_dir: str, prepared_dir: str, splits: tuple[str, ...] = ("train", "dev", "test"), manual: DataFrame | None = None) -> None:
    """First, later and latest versions of papers, from a hub export with article_pairs, mapping and metadata."""
    tables = [readers.read_export(spark, f"{export_dir}/{name}", None if name == "metadata" else splits) for name in ("article_pairs", "mapping", "metadata")]
    docs = Stored(V.revision_docs(*tables, manual), "paper-versions")
    for name, part in zip(("v1_only", "revisions", "latest_only"), V.split_versions(docs.df)):
        save_prepared_set(part, prepared_dir, f"casimir_{name}_dedup")
    docs.drop()


def save_synonym_set(docs: DataFrame, prepared_dir: str, dataset: str, alpha: float, synonyms: Callable, seed: int = 42) -> str:
    return save_prepared_set(M.synonym_variants(docs, alpha, synonyms, seed), prepared_dir, M.synonym_set_name(dataset, alpha, seed))


def save_paraphrase_set(docs: DataFrame, prepared_dir: str, dataset: str, paraphrase: Callable, model: str, temperature: float = 0, seed: int = 42) -> str:
    """Each text is paraphrased once: the result is written before it is checked."""
    made = Stored(M.paraphrase_variants(docs, paraphrase, model, temperature, seed), "paraphrases")
    return save_prepared_set(made.df, prepared_dir, M.paraphrase_set_name(dataset, model, temperature, seed))


def save_controlled_set(docs: DataFrame, prepared_dir: str, dataset: str, paraphrase: Callable, settings: M.Controlled = M.Controlled()) -> str:
    made = Stored(M.controlled_variants(docs, paraphrase, settings), "paraphrases")
    return save_prepared_set(made.df, prepared_dir, M.controlled_set_name(dataset, settings))
