"""Quality rules with adaptive thresholds, in DataFrame functions only.

Fixed base rules drop texts that are too short or mostly repetition. The rest of the verdict has no fixed cut-offs:
for each language and source, mergeable KLL quantile sketches of every measure give quartiles, and a text fails where
it lies outside the quartiles by more than ``spread`` times their distance. Sketches of sources with few rows are
merged into their language's, and those of rare languages into that of all rows, so every text has a threshold.

The measures of a text are made within its row (no shuffle of texts); sketches are partial aggregates, so a hot
source sends one sketch per task. Thresholds are a row per language and source and are joined back.

Defined results: null text has no words and fails the base rules; null languages and sources are groups of their own;
repeated rows give repeated results; an empty table gives an empty result; other columns are ignored. A sketch holds up
to about 200 values as they are; beyond it thins them out, partly at random, so limits are within its rank error (about
1.7 %) of the exact quartiles and may differ that much between runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import WORD_SPLIT, Stored, pick

# Fixed values of the base rules.
SYMBOLS = "[#*$%&|<>]"
REPEAT_WINDOW, LEAST_WORDS, MOST_REPEATED_PERCENT = 5, 10, 20

#: measure -> (least distance of quartiles taken, whether low values fail too)
MEASURES = {"symbols": (0.02, False), "word_length": (0.5, True), "dup_lines": (0.06, False), "repeats": (0.03, False)}
SPREAD = 6.0
LEAST_ROWS = 200


def _repeat_words(windows: Column) -> Column:
    """Words covered by windows whose value occurs twice or more, from array<struct<h, pos>> in order of h, pos."""
    prev = lambda i: F.get(windows, i - 1)["h"]
    following = lambda i: F.get(windows, i + 1)["h"]
    marked = F.transform(windows, lambda w, i: F.when(w["h"].eqNullSafe(prev(i)) | w["h"].eqNullSafe(following(i)), w["pos"]))
    return F.sort_array(F.filter(marked, lambda p: p.isNotNull()))


def text_measures(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words to ``df``; drops ``text``."""
    t = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    out = df.withColumn("words", F.filter(F.split(t, WORD_SPLIT), lambda w: w != "")).withColumn("lines", lines)
    out = out.withColumn("n_symbols", (F.length(t) - F.length(F.regexp_replace(t, SYMBOLS, ""))).cast("bigint"))
    out = out.withColumn("word_chars", F.length(F.regexp_replace(t, WORD_SPLIT, "")).cast("bigint")).drop(text)
    out = out.withColumn("n_words", F.size("words").cast("bigint")).withColumn("n_lines", F.size("lines").cast("bigint"))
    out = out.withColumn("n_dup_lines", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("bigint")).drop("lines")
    at = lambda i: F.xxhash64(*[F.get("words", i + k) for k in range(REPEAT_WINDOW)])
    starts = F.when(F.size("words") >= REPEAT_WINDOW, F.sequence(F.lit(0), F.size("words") - REPEAT_WINDOW)).otherwise(F.array().cast("array<int>"))
    out = out.withColumn("hashes", F.transform(starts, at)).drop("words")
    out = out.withColumn("repeated", F.size(F.array_distinct("hashes")) < F.size("hashes"))
    pairs = F.sort_array(F.transform("hashes", lambda h, i: F.struct(h.alias("h"), i.alias("pos"))))
    out = out.withColumn("windows", F.when(F.col("repeated"), pairs)).drop("hashes")
    out = out.withColumn("marks", F.when(F.col("repeated"), _repeat_words(F.col("windows")))).drop("windows")
    last = F.size("marks") - 1
    gaps = F.transform("marks", lambda p, i: F.when(i == last, F.lit(REPEAT_WINDOW)).otherwise(F.least(F.lit(REPEAT_WINDOW), F.get("marks", i + 1) - p)))
    covered = F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g)
    return out.withColumn("n_repeat_words", F.when(F.col("repeated"), covered).otherwise(0).cast("bigint")).drop("marks", "repeated")


def _thresholds(sketches: DataFrame, keys: list[str], spread: float) -> DataFrame:
    out = sketches
    for m, (least, _) in MEASURES.items():
        q = lambda p: F.kll_sketch_get_quantile_double(F.col(m), F.lit(p))  # noqa: B023, E731
        reach = spread * F.greatest(q(0.75) - q(0.25), F.lit(least))
        out = out.withColumn(f"{m}_lo", q(0.25) - reach).withColumn(f"{m}_hi", q(0.75) + reach)
    return out.select(*keys, *[f"{m}_{e}" for m in MEASURES for e in ("lo", "hi")])


def score_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", spread: float = SPREAD, least_rows: int = LEAST_ROWS) -> DataFrame:
    """doc_id, lang, source, the counts, base_failed, kept and failed (the measures that failed) for every row."""
    rows = text_measures(pick(df, doc_id=id_col, lang=lang_col, source=source_col, text=text_col))
    words = F.greatest(F.col("n_words"), F.lit(1))
    rows = rows.withColumn("symbols", F.col("n_symbols") / words).withColumn("word_length", F.col("word_chars") / words)
    rows = rows.withColumn("dup_lines", F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).withColumn("repeats", F.col("n_repeat_words") / words)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words"))
    rows = Stored(rows.withColumn("base_failed", failed), "measures").df

    sketched = rows.where("NOT base_failed").groupBy("lang", "source").agg(F.count("*").alias("n"), *[F.kll_sketch_agg_double(m).alias(m) for m in MEASURES])
    by_source = Stored(sketched, "sketches").df
    merged = [F.kll_merge_agg_double(m).alias(m) for m in MEASURES]
    by_lang = by_source.groupBy("lang").agg(F.sum("n").alias("n"), *merged)
    overall = by_source.agg(*merged)
    fine = _thresholds(by_source.where(F.col("n") >= least_rows), ["lang", "source"], spread)
    mid = _thresholds(by_lang.where(F.col("n") >= least_rows), ["lang"], spread)
    top = overall
    groups = rows.select("lang", "source").distinct()
    names = [f"{m}_{e}" for m in MEASURES for e in ("lo", "hi")]
    mid = mid.select(F.col("lang").alias("mid_lang"), *[F.col(c).alias(f"mid_{c}") for c in names])
    fine = fine.select(F.col("lang").alias("fine_lang"), F.col("source").alias("fine_source"), *[F.col(c).alias(f"fine_{c}") for c in names])
    top = _thresholds(top, [], spread).select(*[F.col(c).alias(f"top_{c}") for c in names])
    limits = groups.join(fine, groups.lang.eqNullSafe(fine.fine_lang) & groups.source.eqNullSafe(fine.fine_source), "left")
    limits = limits.join(mid, limits.lang.eqNullSafe(mid.mid_lang), "left").join(F.broadcast(top))  # top is one row
    limits = limits.select(F.col("lang").alias("limit_lang"), F.col("source").alias("limit_source"), *[F.coalesce(f"fine_{c}", f"mid_{c}", f"top_{c}").alias(c) for c in names])

    out = rows.join(limits, rows.lang.eqNullSafe(limits.limit_lang) & rows.source.eqNullSafe(limits.limit_source), "left")
    bad = [F.when((F.col(m) > F.col(f"{m}_hi")) | (F.col(m) < F.col(f"{m}_lo") if low else F.lit(False)), F.lit(m)) for m, (_, low) in MEASURES.items()]
    out = out.withColumn("failed", F.filter(F.array(*bad), lambda x: x.isNotNull()))
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return out.select("doc_id", "lang", "source", "n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), "failed")
