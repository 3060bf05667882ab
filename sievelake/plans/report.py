"""Reports over the metrics of runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The rows of the comparison, as label, method and what the run's folder must contain.
ROWS = (
    ("chunk + voting (Count-based)", "chunk_voting", "__cb"),
    ("chunk + voting (Score-weighted)", "chunk_voting", "__sw"),
    ("longcontext - qwen 0.6B (decoder)", "longctx", "qwen"),
    ("longcontext - ibm 97m (encoder)", "longctx", "granite"),
    ("embedding mean pooling", "embedding_pooled", None),
    ("colbertv2", "colbert", None),
    ("chunk(maxsim θ)", "chunk_maxsim", None),
    ("bm25 (full doc)", "bm25", "bm25__doc"),
    ("bm25 (keyword)", "bm25", "bm25__keyword"),
    ("ssdeep", "ssdeep", None),
    ("minhash+lsh", "minhash_lsh", None),
)

METRICS = """method string, dataset string, variant_sets array<string>, include_original_as_positive boolean,
detection struct<f1: double, precision: double, recall: double>, detection_best struct<best_f1: double, best_threshold: double>,
separability struct<roc_auc: double>, timing_sec struct<inference_total_sec: double>"""


def load_metrics(spark: SparkSession, artifacts_dir: str) -> DataFrame:
    """One row a run: names, scores and inference_sec of every ``runs/<run>/<config>/metrics.json``; none if there is no run."""
    from sievelake.sources.storage import exists

    out = ("method", "dataset", F.array_join("variant_sets", "|").alias("variant_sets"), F.col("include_original_as_positive").alias("inclorig"), "run_ident", "config", "detection.f1", "detection_best.best_f1", "detection_best.best_threshold", "separability.roc_auc", "detection.precision", "detection.recall", F.col("timing_sec.inference_total_sec").alias("inference_sec"))
    top = f"{artifacts_dir.rstrip('/')}/runs"
    pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{top}/*/*/metrics.json")
    found = pattern.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(pattern) if exists(spark, top) else []
    if not len(found):
        return spark.createDataFrame([], METRICS + ", run_ident string, config string").select(*out)
    m = spark.read.schema(METRICS).option("multiLine", True).json(f"{top}/*/*/metrics.json")
    parts = F.split("_metadata.file_path", "/")
    return m.withColumn("run_ident", F.element_at(parts, -3)).withColumn("config", F.element_at(parts, -2)).select(*out)


def pivot_table(metrics: DataFrame, value: str = "best_f1", rows: list[str] | None = None, cols: list[str] | None = None) -> DataFrame:
    """The best value of each method (row) and data set (column); in the given order, of which names without a run are left out."""
    if cols is not None:
        have = {r[0] for r in metrics.where(F.col("dataset").isin(*cols)).select("dataset").distinct().collect()}  # at most len(cols)
        cols = [c for c in cols if c in have]
    out = metrics.where("method IS NOT NULL AND dataset IS NOT NULL").groupBy("method").pivot("dataset", cols).agg(F.max(value))
    if rows is None:
        return out.orderBy("method")
    return out.where(F.col("method").isin(*rows)).orderBy(F.array_position(F.array(*map(F.lit, rows)), F.col("method")))


def comparison_table(metrics: DataFrame, value: str = "best_f1", rows=ROWS, cols: list[str] | None = None, field: str = "dataset") -> DataFrame:
    """label and a column for each value of ``field``: the best ``value`` of the runs of each row; null where there is none.

    Without ``cols`` the columns are the values that occur, in order.
    """
    spec = metrics.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(rows)], "at int, label string, row_method string, part string")
    runs = metrics.where(F.col(field).isNotNull()).select(F.col("method").alias("row_method"), F.lower("config").alias("config"), F.col(field).alias("field"), F.col(value).alias("value"))
    hit = (runs["row_method"] == spec["row_method"]) & (spec["part"].isNull() | F.col("config").contains(F.lower(spec["part"])))
    found = F.broadcast(spec).join(runs, hit, "left")  # one row a label of the report
    if cols is None:
        cols = [r[0] for r in metrics.where(F.col(field).isNotNull()).select(field).distinct().orderBy(field).collect()]  # the report's columns
    return found.groupBy("at", "label").pivot("field", cols).agg(F.max("value")).orderBy("at").drop("at")
