"""Toxicity grades by cumulative-link ordinal regression over sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k) with one weight vector for all thresholds theta_1 < theta_2 < ...; the severity
is the expected grade, the sum of these probabilities. Features are the words whose presence differs most between toxic
and other labelled texts (G-test) and that lean to the toxic ones, as log(1 + occurrences): words and beginnings of words.

Grades are the values that the labels hold: 0 for harmless, 1, 2, ... for degrees. There are as many thresholds as
the labels support, so binary labels give one, and a severity between 0 and 1; no grade is made up.

Fitting reads a bounded sample of labelled rows, at most ``max_rows`` (those with the least seeded hash of their id);
texts are tokenised by the executors, and only counts of the selected features reach the driver, where the model is
fitted. Scoring covers every text whole, in one pass, with at most ``max_features`` weights in the closure.

Defined results: null or empty text has no features and gets the base severity; rows with null labels are not
trained on; with no or one class of labels every severity is 0 and nothing is rejected; repeated ids take their
greatest label; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import Stored, col, pick

MAX_ROWS, MAX_FEATURES, LEAST_G = 20_000, 500, 11.0
#: Grades above 0 that labels may hold.
MOST_GRADES = 16
#: Rows with this probability of any toxicity or more are rejected.
REJECT_AT = 0.5

#: Lengths of the word beginnings that are features beside whole words; a beginning is written with a star.
PREFIXES = (4, 5, 6, 7, 8)

_WORD = re.compile(r"[^\W\d_]+")


def text_features(text: str) -> Counter:
    """Occurrences of words in lower case, and of their beginnings."""
    out: Counter = Counter()
    for w, c in Counter(_WORD.findall(text.lower())).items():
        out[w] += c
        for n in PREFIXES:
            if len(w) > n:
                out[w[:n] + "*"] += c
    return out


@dataclass
class OrdinalModel:
    weights: dict[str, float] = field(default_factory=dict)
    thresholds: tuple[float, ...] = ()
    _lengths: tuple[int, ...] | None = None

    def prefixes(self) -> tuple[int, ...]:
        """The lengths of the beginnings among the features."""
        if self._lengths is None:
            self._lengths = tuple(sorted({len(f) - 1 for f in self.weights if f.endswith("*")}))
        return self._lengths

    def probabilities(self, text: str) -> list[float]:
        """P(grade >= k) for k = 1, 2, ..."""
        if not self.thresholds:
            return [0.0]
        found: Counter = Counter()
        lengths = self.prefixes()
        for w, c in Counter(_WORD.findall(text.lower())).items():
            if w in self.weights:
                found[w] += c
            for n in lengths:
                if len(w) > n and (p := w[:n] + "*") in self.weights:
                    found[p] += c
        z = sum(self.weights[f] * math.log1p(c) for f, c in sorted(found.items()))
        return [1 / (1 + math.exp(-max(-50.0, min(50.0, z - t)))) for t in self.thresholds]


def fit_ordinal(x: np.ndarray, grade: np.ndarray, weight: np.ndarray, grades: int, l2: float = 1e-4, steps: int = 800, rate: float = 0.05) -> tuple[np.ndarray, np.ndarray]:
    """Weights and increasing thresholds by full-batch Adam over weighted rows; thresholds are a first one and positive steps."""
    n, d = x.shape
    total = float(weight.sum())
    rest = [float(weight[grade >= k].sum()) / total for k in range(1, grades)]
    start = [np.log((1 - p + 1e-6) / (p + 1e-6)) for p in rest]
    theta = np.concatenate([np.zeros(d), [start[0]], np.log(np.maximum(np.diff(start), 0.1))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, steps + 1):
        w, cuts = theta[:d], np.cumsum(np.concatenate([theta[d : d + 1], np.exp(theta[d + 1 :])]))
        z = x @ w.astype(x.dtype)
        above = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -50, 50)))  # P(y >= k), k = 1..
        edge = np.hstack([np.ones((n, 1)), above, np.zeros((n, 1))])
        p = np.maximum(edge[np.arange(n), grade] - edge[np.arange(n), grade + 1], 1e-9)
        slope = np.hstack([np.zeros((n, 1)), above * (1 - above), np.zeros((n, 1))])
        up, down = weight * slope[np.arange(n), grade] / p, weight * slope[np.arange(n), grade + 1] / p
        dz = up - down
        dcut = np.zeros(grades - 1)
        for k in range(1, grades):
            dcut[k - 1] = -up[grade == k].sum() + down[grade == k - 1].sum()
        dtheta = np.empty_like(theta)
        dtheta[:d] = x.T @ dz.astype(x.dtype) / total - l2 * w
        dtheta[d] = dcut.sum() / total
        for j in range(1, grades - 1):
            dtheta[d + j] = np.exp(theta[d + j]) * dcut[j:].sum() / total
        m, v = 0.9 * m + 0.1 * dtheta, 0.999 * v + 0.001 * dtheta**2
        theta = theta + rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return theta[:d], np.cumsum(np.concatenate([theta[d : d + 1], np.exp(theta[d + 1 :])]))


def fit_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", label_col: str = "toxic", max_rows: int = MAX_ROWS, max_features: int = MAX_FEATURES, seed: int = 5) -> OrdinalModel:
    docs = pick(docs, doc_id=id_col, text=text_col)
    known = pick(labels, label_id=label_id_col, toxic=label_col).where("label_id IS NOT NULL AND toxic IS NOT NULL").groupBy("label_id").agg(F.greatest(F.max(F.col("toxic")), F.lit(0)).cast("int").alias("toxic"))
    known = known.join(docs.select(F.col("doc_id").alias("label_id")), "label_id", "left_semi")  # labels without a document don't use up the bound
    sample = Stored(known.orderBy(F.xxhash64(F.lit(seed), "label_id"), "label_id").limit(max_rows), "toxicity-sample").df
    rows = docs.join(F.broadcast(sample), F.col("doc_id") == F.col("label_id")).select("doc_id", "toxic", "text")  # at most max_rows ids

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, words = [], []
            for y, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                own = text_features(text.as_py() or "").keys()
                toxic += [y] * len(own)
                words += own
            yield pa.RecordBatch.from_arrays([pa.array(toxic, pa.int32()), pa.array(words, pa.string())], names=["toxic", "word"])

    n_all, n_toxic, most = rows.agg(F.count("*"), F.count_if(F.col("toxic") > 0), F.coalesce(F.max("toxic"), F.lit(0))).first()
    if not 0 < n_toxic < n_all:
        return OrdinalModel()
    if most > MOST_GRADES:
        raise ValueError(f"grades above {MOST_GRADES}")
    df = rows.select("toxic", "text").mapInArrow(present, "toxic int, word string").groupBy("word").agg(F.count_if(F.col("toxic") > 0).alias("a"), F.count("*").alias("n"))
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    n_a, n_b = float(n_toxic), float(n_all - n_toxic)
    term = lambda x, e: F.when(x > 0, x * F.log(x / e)).otherwise(0.0)
    total, n = a + b, n_a + n_b
    g = 2 * (term(a, total * n_a / n) + term(b, total * n_b / n) + term(n_a - a, (n - total) * n_a / n) + term(n_b - b, (n - total) * n_b / n))
    leaning = F.col("a") / n_a > (F.col("n") - F.col("a")) / n_b
    top = df.withColumn("g", g).where((F.col("g") >= LEAST_G) & leaning).orderBy(F.col("g").desc(), "word").limit(max_features).collect()  # at most max_features rows
    if not top:
        return OrdinalModel()
    names = [r["word"] for r in top]
    place = {w: i for i, w in enumerate(names)}

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted((place[f], c) for f, c in text_features(t.as_py() or "").items() if f in place) for t in batch.column(1)]
            at = pa.array([[i for i, _ in f] for f in found], pa.list_(pa.int32()))
            n = pa.array([[c for _, c in f] for f in found], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), at, n], names=["toxic", "at", "n"])

    data = rows.select("toxic", "text").mapInArrow(featured, "toxic int, at array<int>, n array<int>").groupBy("toxic", "at", "n").count().orderBy("toxic", "at", "n").collect()  # bounded by max_rows
    counts = np.zeros((len(data), len(names)), np.float32)
    for r, row in enumerate(data):
        counts[r, row["at"]] = row["n"]
    grade, weight = np.array([row["toxic"] for row in data]), np.array([row["count"] for row in data])
    held = np.unique(grade)  # grades without a label have no threshold of their own
    weights, cuts = fit_ordinal(np.log1p(counts), np.searchsorted(held, grade), weight, len(held))
    steps = np.diff(held, prepend=held[0])[1:]
    thresholds = tuple(float(c) for c, n in zip(cuts, steps) for _ in range(n))
    return OrdinalModel({w: float(x) for w, x in zip(names, weights)}, thresholds)


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", reject_at: float = REJECT_AT) -> DataFrame:
    """rid, doc_id, severity, grade (the likeliest reached: grades with probability of 0.5 or more), rejected for every row."""
    rows = pick(docs, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            p = [model.probabilities(t.as_py() or "") for t in batch.column(2)]
            severity = pa.array([sum(x) for x in p], pa.float64())
            grade = pa.array([sum(q >= 0.5 for q in x) for x in p], pa.int32())
            rejected = pa.array([x[0] >= reject_at for x in p], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), severity, grade, rejected], names=["rid", "doc_id", "severity", "grade", "rejected"])

    id_type = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(score, f"rid bigint, doc_id {id_type}, severity double, grade int, rejected boolean")


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows and columns of ``docs`` whose texts are not rejected."""
    model = fit_toxicity(docs, labels, id_col, text_col, **options)
    mark = "__toxic_mark"

    @F.pandas_udf("boolean")
    def rejected(texts):
        return texts.map(lambda t: model.probabilities(t or "")[0] >= REJECT_AT)

    return docs.withColumn(mark, rejected(col(docs, text_col))).where(~F.col(mark)).drop(mark)
