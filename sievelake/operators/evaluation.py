"""Evaluation of votes: manifest, decisions, attribution, errors by family, false positives, confusion matrix.

An evaluation row is a manifest row (query_doc_id, is_positive, target_family_id) with its thresholded votes and
pred_detected. Queries without a vote stay: they are never detected, whatever the threshold, but count as score 0 in
the sweep and the areas, so at a threshold of 0 or below ``detection`` and ``detection_best`` may differ.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.functions.text import safe_div
from sievelake.operators import retrieval as R
from sievelake.operators.votes import apply_threshold


def build_query_manifest(positive: DataFrame, benign: DataFrame) -> DataFrame:
    """query_doc_id, is_positive, target_family_id: positives have their own family as target, benign ones none."""
    one = lambda df, yes: df.select(F.col("doc_id").alias("query_doc_id"), F.lit(yes).alias("is_positive"), (F.col("family_id") if yes else F.lit(None).cast("string")).alias("target_family_id"))
    return one(positive, True).unionByName(one(benign, False))


def evaluate(manifest: DataFrame, votes: DataFrame, threshold: float, confidence_col: str = "confidence") -> DataFrame:
    """Evaluation rows at a threshold."""
    pred = apply_threshold(votes, threshold, confidence_col)
    return manifest.join(pred, "query_doc_id", "left").withColumn("pred_detected", F.coalesce("pred_detected", F.lit(False)))


def scores(manifest: DataFrame, votes: DataFrame, confidence_col: str = "confidence") -> DataFrame:
    """query_doc_id, is_positive, score: 0 for queries without a vote."""
    v = votes.select("query_doc_id", F.col(confidence_col).cast("double").alias("score"))
    return manifest.select("query_doc_id", "is_positive").join(v, "query_doc_id", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def evaluate_run(manifest: DataFrame, votes: DataFrame, threshold: float | None = None, confidence_col: str = "confidence") -> tuple[dict, DataFrame]:
    """(metrics, evaluation rows). No threshold: that of the best F1, or 0.5 where only one class occurs.

    Metrics are a few numbers for the driver: four jobs over tables of one row a query, one row each.
    """
    scored = scores(manifest, votes, confidence_col)
    best = R.best_f1(scored).first()
    top = dict(zip(("best_threshold", "best_f1", "best_precision", "best_recall"), (best["threshold"], best["f1"], best["precision"], best["recall"]) if best else (None,) * 4))
    if threshold is None:
        threshold = 0.5 if best is None else top["best_threshold"]
    rows = evaluate(manifest, votes, threshold, confidence_col)
    found = R.confusion(rows.select("is_positive", F.when(F.col("pred_detected"), 1.0).otherwise(0.0).alias("score")), 1.0).first().asDict()
    right = attribution(rows).first()
    areas = R.areas(scored).first() if best else {"average_precision": None, "roc_auc": None}
    total = sum(found[c] for c in ("tp", "fp", "tn", "fn"))
    metrics = {
        "threshold": float(threshold),
        "confidence_col": confidence_col,
        "detection": found,
        "detection_best": top,
        "attribution": {"family_acc_on_all_positive": right["rate_all"], "family_acc_on_detected_positive": right["rate_detected"]},
        "separability": {"pr_auc": areas["average_precision"], "roc_auc": areas["roc_auc"], "positive_ratio": (found["tp"] + found["fn"]) / total if total else 0.0},
    }
    return metrics, rows


def _attributed():
    return F.col("is_positive") & F.col("pred_detected") & F.coalesce(F.col("pred_family_id") == F.col("target_family_id"), F.lit(False))


def attribution(ev: DataFrame) -> DataFrame:
    """Positives whose predicted family is right, over all positives and over the detected ones."""
    c = ev.agg(F.count_if("is_positive").alias("n_positive"), F.count_if(F.col("is_positive") & F.col("pred_detected")).alias("n_detected"), F.count_if(_attributed()).alias("n_correct"))
    return c.withColumn("rate_all", safe_div(F.col("n_correct"), F.col("n_positive"))).withColumn("rate_detected", safe_div(F.col("n_correct"), F.col("n_detected")))


def errors_by_family(ev: DataFrame) -> DataFrame:
    """Per family: its positives, how many were detected and attributed, and negatives drawn to it; most positives first.

    A row counts for its target if positive, for the predicted family if a detected negative: one grouping, no outer join.
    """
    family = F.when(F.col("is_positive"), F.col("target_family_id")).otherwise(F.col("pred_family_id"))
    rows = ev.withColumn("family_id", family).where("family_id IS NOT NULL AND (is_positive OR pred_detected)")
    out = rows.groupBy("family_id").agg(
        F.count_if("is_positive").alias("n_positive_total"),
        F.count_if(F.col("is_positive") & F.col("pred_detected")).alias("n_positive_detected"),
        F.count_if(_attributed()).alias("n_attribution_correct"),
        F.count_if(~F.col("is_positive")).alias("n_false_attraction"),
    )
    out = out.withColumn("detection_rate", safe_div(F.col("n_positive_detected"), F.col("n_positive_total")))
    out = out.withColumn("attribution_rate", safe_div(F.col("n_attribution_correct"), F.col("n_positive_detected")))
    return out.orderBy(F.desc("n_positive_total"), F.desc("n_false_attraction"), "family_id")


def false_positives(ev: DataFrame) -> DataFrame:
    """Negatives that were detected, with what drew them; the highest confidence first. Columns that ``ev`` lacks are left out."""
    wanted = ("query_doc_id", "query_family_id", "pred_doc_id", "pred_family_id", "confidence", "best_votes", "n_chunks", "vote_entropy", "vote_gini", "vote_distribution_json")
    found = ev.where("NOT is_positive AND pred_detected").select(*[c for c in wanted if c in ev.columns])
    return found.orderBy(F.desc("confidence"), "query_doc_id")


def case_categories(ev: DataFrame) -> DataFrame:
    hit = F.coalesce("pred_detected", F.lit(False))
    return ev.withColumn("category", F.when(F.col("is_positive"), F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN")))


def confusion_matrix(ev: DataFrame) -> DataFrame:
    """actual (positive, negative, total), detected, passed, total."""
    actual = F.when(F.grouping("is_positive") == 1, "total").when(F.col("is_positive"), "positive").otherwise("negative")
    return ev.rollup("is_positive").agg(actual.alias("actual"), F.count_if("pred_detected").alias("detected"), F.count_if(~F.col("pred_detected")).alias("passed"), F.count("*").alias("total")).drop("is_positive")


def uncovered_families(docs: DataFrame, split: DataFrame) -> DataFrame:
    """Families of ``docs`` that the split lacks."""
    return docs.select("family_id").distinct().join(split, "family_id", "left_anti")
