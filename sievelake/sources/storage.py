"""Tables and JSON in any store that Spark reads: prepared sets, caches of vectors, run artifacts.

Paths are names for Spark and Hadoop; nothing here opens a local file. One directory is one table; JSON files are small
(configurations, metrics) and written by the driver through the same file system.
"""

from __future__ import annotations

import json
from dataclasses import asdict, is_dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions.text import model_slug
from sievelake.operators.documents import concat_keep_first, normalize_docs


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def ensure_dir(spark: SparkSession, path: str) -> str:
    fs, p = _fs(spark, path)
    fs.mkdirs(p)
    return path


def listing(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder, sorted; a missing folder is empty."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def size_mb(spark: SparkSession, path: str) -> float:
    fs, p = _fs(spark, path)
    return fs.getContentSummary(p).getLength() / (1024 * 1024) if fs.exists(p) else 0.0


def save_json(spark: SparkSession, data: object, path: str) -> str:
    """Indented UTF-8 JSON; dataclasses as objects, anything else that JSON lacks as a string."""
    text = json.dumps(asdict(data) if is_dataclass(data) else data, ensure_ascii=False, indent=2, default=str)
    fs, p = _fs(spark, path)
    out = fs.create(p, True)
    out.write(bytearray(text.encode()))
    out.close()
    return path


def load_json(spark: SparkSession, path: str) -> object:
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return json.loads(spark.read.text(path, wholetext=True).first()[0])


def save_parquet(df: DataFrame, path: str, partition_by: tuple[str, ...] = ()) -> str:
    df.write.mode("overwrite").partitionBy(*partition_by).parquet(path)
    return path


# Prepared sets: one table of normalised docs each.


def _set_path(prepared_dir: str, name: str) -> str:
    return f"{prepared_dir.rstrip('/')}/{name}.parquet"


def save_prepared_set(docs: DataFrame, prepared_dir: str, name: str) -> str:
    return save_parquet(normalize_docs(docs), _set_path(prepared_dir, name))


def load_prepared_set(spark: SparkSession, prepared_dir: str, name: str) -> DataFrame:
    path = _set_path(prepared_dir, name)
    if not exists(spark, path):
        raise FileNotFoundError(path)
    return spark.read.parquet(path)


def list_prepared_sets(spark: SparkSession, prepared_dir: str) -> list[str]:
    return [n.removesuffix(".parquet") for n in listing(spark, prepared_dir) if n.endswith(".parquet")]


def concat_prepared_sets(spark: SparkSession, prepared_dir: str, names: list[str]) -> DataFrame:
    """UNION ALL in list order, the first set's row of each doc_id, normalised again."""
    if not names:
        raise ValueError("no sets")
    sets = [load_prepared_set(spark, prepared_dir, n) for n in names]
    return normalize_docs(concat_keep_first(sets, "text").drop("set_no"), check_unique=False)


# Caches: one folder per kind, model, cut and set, so that a lookup reads one folder; config.json is written last and says
# that the folder is whole.


def embedding_dir(artifacts_dir: str, model: str, chunk_slug: str, set_name: str, normalized: bool = True) -> str:
    return f"{artifacts_dir.rstrip('/')}/cache/{'embeddings' if normalized else 'embeddings_raw'}/{model_slug(model)}/{chunk_slug}/{set_name}"


def token_dir(artifacts_dir: str, model: str, tokens: int, is_query: bool, set_name: str) -> str:
    return f"{artifacts_dir.rstrip('/')}/cache/embeddings_tokens/{model_slug(model)}/tok{tokens}o0__{'q' if is_query else 'd'}/{set_name}"


def longctx_dir(artifacts_dir: str, model: str, set_name: str, long_doc: str, most: int, dtype: str) -> str:
    return f"{artifacts_dir.rstrip('/')}/cache/embeddings_longctx/{model_slug(model)}/{set_name}__{long_doc}__L{most}__{dtype}"


def is_cached(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/config.json")


def save_vectors(vectors: DataFrame, path: str, config: dict) -> dict:
    """The table and its config: the given values (spec, seconds), n_vectors and n_docs."""
    save_parquet(vectors, f"{path}/table")
    held = vectors.sparkSession.read.parquet(f"{path}/table").agg(F.count("*").alias("n_vectors"), F.count_distinct("doc_id").alias("n_docs")).first().asDict()
    config = {**config, **held}
    save_json(vectors.sparkSession, config, f"{path}/config.json")
    return config


def load_vectors(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    return spark.read.parquet(f"{path}/table"), load_json(spark, f"{path}/config.json")


def split_combined_cache(spark: SparkSession, combined: str, targets: dict[str, tuple[str, DataFrame]], overwrite: bool = False) -> dict[str, str]:
    """Cuts a cache of several sets into one for each: {set: (folder, its docs)}. A set that the cache doesn't wholly cover is
    left alone; seconds and overflows are shared out by documents. Returns what became of each set."""
    table, config = load_vectors(spark, combined)
    total = max(config["n_docs"], 1)
    said = {}
    for name, (path, docs) in targets.items():
        if is_cached(spark, path) and not overwrite:
            said[name] = "exists"
            continue
        ids = docs.select("doc_id").distinct()
        covered, wanted = ids.join(table, "doc_id", "left_semi").count(), ids.count()
        if covered < wanted:
            said[name] = f"covers {covered} of {wanted}"
            continue
        share = covered / total
        own = {"encode_sec": config.get("encode_sec", 0.0) * share, "n_overflow": round(config.get("n_overflow", 0) * share), "migrated_from": combined}
        save_vectors(table.join(ids, "doc_id", "left_semi"), path, {**config, **own})
        said[name] = f"ok ({covered} docs)"
    return said


def save_index(vectors: DataFrame, path: str, config: dict | None = None) -> dict:
    """Reference vectors (chunk columns, embedding) as the index: search over them is exact."""
    return save_vectors(vectors, path, {"kind": "exact", **(config or {})})


load_index = load_vectors


# Runs.


def save_run(path: str, artifacts: dict[str, DataFrame], config: dict | None, metrics: dict | None) -> None:
    """One table for each artifact that isn't None, config.json and metrics.json."""
    spark = next(iter(artifacts.values())).sparkSession
    for name, df in artifacts.items():
        save_parquet(df, f"{path}/{name}.parquet")
    for name, data in (("config", config), ("metrics", metrics)):
        if data is not None:
            save_json(spark, data, f"{path}/{name}.json")
