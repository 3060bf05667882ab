"""Votes: one row per query document with its prediction, confidence and how the votes are spread.

Columns (VOTES_COLUMNS): query_doc_id, query_family_id, pred_doc_id, pred_family_id, n_chunks, n_votes, best_votes,
confidence, vote_entropy, vote_variance, vote_gini, vote_distribution_json. Ids are strings or any type that orders.
The distribution of a query holds one entry for each document (or family) that its hits name, at most its chunks times
the neighbours asked for, so an array a query is bounded by the query, not by the references.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

VOTES_COLUMNS = ("query_doc_id", "query_family_id", "pred_doc_id", "pred_family_id", "n_chunks", "n_votes", "best_votes", "confidence", "vote_entropy", "vote_variance", "vote_gini", "vote_distribution_json")


def spread(values: Column) -> tuple[Column, Column, Column]:
    """(entropy, variance, Gini index) of an array of votes.

    p = v / sum where the sum is positive, else v. Entropy: positive p only, over the logarithm of how many they are, 0
    for one or none. Variance is that of the population, 0 for none; Gini is 1 - sum of squares, so 1 for none.
    """
    add = lambda a, f=lambda x: x: F.aggregate(a, F.lit(0.0), lambda s, x: s + f(x))
    # what a lambda uses is bound first: written into it, sums would be taken again for every value
    bind = lambda x, f: F.get(F.transform(F.array(x), f), F.lit(0))
    n = F.greatest(F.size(values), F.lit(1))
    shares = lambda f: bind(add(values), lambda total: bind(F.transform(values, lambda v: F.when(total > 0, v / total).otherwise(v)), f))
    entropy = shares(lambda p: bind(F.filter(p, lambda x: x > 0), lambda up: F.when(F.size(up) <= 1, 0.0).otherwise(-add(up, lambda x: x * F.ln(x)) / F.ln(F.size(up)))))
    variance = shares(lambda p: bind(add(p) / n, lambda mean: add(p, lambda x: (x - mean) * (x - mean)) / n))
    return entropy, variance, shares(lambda p: 1 - add(p, lambda x: x * x))


def _json(entries: Column, name: str, value) -> Column:
    """A JSON object with the entries in order."""
    return F.coalesce(F.to_json(F.map_from_entries(F.transform(entries, lambda e: F.struct(e[name].cast("string"), value(e["v"]))))), F.lit("{}"))


def vote_by_document(retrieval: DataFrame, how: str = "count") -> DataFrame:
    """From query_doc_id, query_family_id, query_chunk_id, ref_doc_id, ref_family_id, score and rank.

    how: count of hits, weight (sum of scores) or maxsim (best score, which is the confidence itself). Confidence of the
    others is the best document's share, 0 where the total isn't positive. Ties go to the smaller document id.
    n_chunks counts chunks with a hit (those of rank 1). An empty retrieval gives no rows.
    """
    value = {"count": F.count("*").cast("double"), "weight": F.sum("score"), "maxsim": F.max("score")}[how]
    per = retrieval.groupBy("query_doc_id", "ref_doc_id").agg(
        value.alias("v"), F.count("*").cast("int").alias("hits"), F.count_if(F.col("rank") == 1).cast("int").alias("firsts"), F.min("query_family_id").alias("query_family_id"), F.min("ref_family_id").alias("ref_family_id")
    )
    entry = F.struct((-F.col("v")).alias("down"), "ref_doc_id", "ref_family_id", "hits", "v")
    q = per.groupBy("query_doc_id").agg(F.min("query_family_id").alias("query_family_id"), F.sum("firsts").cast("int").alias("n_chunks"), F.sum("hits").cast("int").alias("n_votes"), F.sort_array(F.collect_list(entry)).alias("d"))
    q = q.withColumn("values", F.transform("d", lambda e: e["v"])).withColumn("best", F.get("d", F.lit(0)))
    total = F.aggregate("values", F.lit(0.0), lambda s, x: s + x)
    confidence = F.col("best.v") if how == "maxsim" else F.when(total > 0, F.col("best.v") / total).otherwise(0.0)
    shown = {"count": lambda v: v.cast("bigint"), "weight": lambda v: v, "maxsim": lambda v: F.round(v, 6)}[how]
    entropy, variance, gini = spread(F.col("values"))
    return q.select(
        "query_doc_id", "query_family_id", F.col("best.ref_doc_id").alias("pred_doc_id"), F.col("best.ref_family_id").alias("pred_family_id"), "n_chunks", "n_votes", F.col("best.hits").alias("best_votes"),
        confidence.alias("confidence"), entropy.alias("vote_entropy"), variance.alias("vote_variance"), gini.alias("vote_gini"), _json(F.col("d"), "ref_doc_id", shown).alias("vote_distribution_json"),
    )


def family_votes(scored: DataFrame, queries: DataFrame, ties: str = "document", unmatched: int = 0, digits: int = 4, scale: float = 1.0) -> DataFrame:
    """The family of the best-scoring reference of each query; every query gets a row.

    scored: query_doc_id, ref_doc_id, ref_family_id, score (positive ones only); queries: doc_id, family_id, and
    n_chunks if it isn't 1. Of equal scores ``ties`` takes the smaller document id (document) or the greater family id
    (family); the document is the family's best one, the smaller id of equal ones. Without a match: nulls, confidence 0,
    ``unmatched`` votes, Gini 1. Confidence is the score over ``scale``; the distribution is by family, descending, with
    scores of ``digits`` digits.
    """
    best = F.min(F.struct((-F.col("score")).alias("down"), F.col("ref_doc_id").alias("doc")))
    per = scored.groupBy("query_doc_id", "ref_family_id").agg(best.alias("b")).select("query_doc_id", F.struct(F.col("b.down").alias("down"), F.col("b.doc").alias("doc"), F.col("ref_family_id").alias("family"), (-F.col("b.down").cast("double")).alias("v")).alias("e"))
    q = per.groupBy("query_doc_id").agg(F.sort_array(F.collect_list("e")).alias("d"))
    chunks = F.col("n_chunks").cast("int") if "n_chunks" in queries.columns else F.lit(1)
    every = queries.select(F.col("doc_id").alias("query_doc_id"), F.col("family_id").alias("query_family_id"), chunks.alias("n_chunks"))
    return votes_of_families(every.join(q, "query_doc_id", "left"), ties, unmatched, digits, scale)


def votes_of_families(found: DataFrame, ties: str = "document", unmatched: int = 0, digits: int = 4, scale: float = 1.0) -> DataFrame:
    """family_votes of query_doc_id, query_family_id, n_chunks and d: an entry (down, doc, family, v) for each family, v being the
    best score and down its negative, in the order of (down, doc); null or empty without a match."""
    if ties == "family":
        top = F.array_max(F.transform("d", lambda e: F.struct(e["v"].alias("v"), e["family"].alias("family"), e["doc"].alias("doc"))))
    else:
        top = F.get("d", F.lit(0))
    out = found.withColumn("best", top).withColumn("values", F.coalesce(F.transform("d", lambda e: e["v"]), F.array().cast("array<double>")))
    entropy, variance, gini = spread(F.col("values"))
    n = F.when(F.col("best").isNotNull(), 1).otherwise(unmatched)
    shown = (lambda v: v.cast("bigint")) if digits == 0 else (lambda v: F.round(v, digits))
    return out.select(
        "query_doc_id", "query_family_id", F.col("best.doc").alias("pred_doc_id"), F.col("best.family").alias("pred_family_id"), "n_chunks", n.alias("n_votes"), n.alias("best_votes"),
        (F.coalesce("best.v", F.lit(0.0)) / scale).alias("confidence"), entropy.alias("vote_entropy"), variance.alias("vote_variance"), gini.alias("vote_gini"), _json(F.col("d"), "family", shown).alias("vote_distribution_json"),
    )


def apply_threshold(votes: DataFrame, threshold: float, confidence_col: str = "confidence") -> DataFrame:
    """pred_detected where the confidence is at or above the threshold; otherwise the prediction becomes null."""
    hit = F.coalesce(F.col(confidence_col) >= threshold, F.lit(False))
    kept = {c: F.when(F.col("pred_detected"), F.col(c)) for c in ("pred_doc_id", "pred_family_id")}
    return votes.withColumn("pred_detected", hit).withColumns(kept)
