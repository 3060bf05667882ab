"""Registered queries of the leak-detection engine, with the SQL they are held against. Whole tables, no limits."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.functions import text as T
from sievelake.operators import documents as D
from sievelake.operators import encoders, evaluation as E
from sievelake.operators import lexical as L
from sievelake.operators import retrieval as R
from sievelake.operators import votes as V
from sievelake.operators.components import connected_components

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents in the docs schema: a family per text, keyed by its hash."""
    d = _read(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("source").alias("dataset"), F.substring(F.md5("text"), 1, 12).alias("family_id"), "text")


def _r(c, digits: int = 6):
    return F.round(c, digits)


# Python's white space as an SQL pattern, and words by it.
_WS = "[\\x09-\\x0d\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
_WORDS = f"list_filter(regexp_split_to_array(coalesce(text, ''), '{_WS}+'), lambda w: w <> '')"
_DOCS = f"docs AS (SELECT doc_id::VARCHAR AS doc_id, source AS dataset, substr(md5(text), 1, 12) AS family_id, text, {_WORDS} AS words FROM documents)"


@query(f"WITH {_DOCS} SELECT doc_id, dataset, family_id, coalesce(text, '') AS text, NULL::INTEGER AS version_index, 'original' AS variant_type, NULL::VARCHAR AS variant_level, NULL::INTEGER AS variant_seed, NULL::VARCHAR AS source_doc_id, length(coalesce(text, ''))::INTEGER AS num_chars, len(words)::INTEGER AS num_words, '{{}}' AS meta_json FROM docs")
def normalize_docs(spark, sf_dir):
    return D.normalize_docs(_docs(spark, sf_dir))


@query("""WITH p AS (SELECT doc_id, regexp_replace(replace(trim(lower(source || ' ' || lang)), ' ', '_'), '[^a-zA-Z0-9_@.:-]', '', 'g') AS a FROM documents)
SELECT doc_id, a || ':' || doc_id AS family_id, a || ':' || doc_id || ':v1' AS new_doc_id FROM p""")
def sanitize_ids(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", F.concat_ws(" ", "source", "lang").alias("ds"), F.col("doc_id").cast("string").alias("key"))
    return D.build_ids(d, "ds", "key").select("doc_id", "family_id", "new_doc_id")


@query(f"WITH {_DOCS} SELECT dataset, count(*) AS n_docs, count(DISTINCT family_id) AS n_families, sum(len(words))::BIGINT AS n_words, sum(length(text))::BIGINT AS n_chars FROM docs GROUP BY dataset")
def list_dataset_stats(spark, sf_dir):
    d = D.normalize_docs(_docs(spark, sf_dir))
    return d.groupBy("dataset").agg(F.count("*").alias("n_docs"), F.countDistinct("family_id").alias("n_families"), F.sum("num_words").alias("n_words"), F.sum("num_chars").cast("bigint").alias("n_chars"))


@query("""WITH u AS (SELECT md5(text) AS doc_id, 0 AS set_no, doc_id AS row_no, lang FROM documents WHERE lang = 'en' UNION ALL SELECT md5(text), 1, doc_id, lang FROM documents)
SELECT doc_id, set_no, row_no, lang FROM u QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY set_no, row_no) = 1""")
def concat_keep_first(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.md5("text").alias("doc_id"), F.col("doc_id").alias("row_no"), "lang")
    return D.concat_keep_first([d.where("lang = 'en'"), d], "row_no").select("doc_id", "set_no", "row_no", "lang")


def _word_chunk_sql(size: int, overlap: int) -> str:
    step = size - overlap
    return f"""WITH {_DOCS}, n AS (SELECT *, len(words) AS n FROM docs WHERE len(words) > 0),
    c AS (SELECT *, unnest(range(0, CASE WHEN n <= {size} THEN 1 ELSE ceil((n - {size}) / {step}.0)::BIGINT + 1 END)) AS i FROM n),
    t AS (SELECT *, array_to_string(words[i * {step} + 1 : i * {step} + {size}], ' ') AS chunk_text FROM c)
    SELECT doc_id || '::c' || i AS chunk_id, doc_id, family_id, dataset, i::INTEGER AS chunk_index, length(chunk_text)::INTEGER AS chunk_len, 'word{size}o{overlap}' AS chunk_spec, chunk_text FROM t"""


@query(_word_chunk_sql(50, 0))
def chunk_word(spark, sf_dir):
    return D.build_chunks(_docs(spark, sf_dir), 50, 0)


@query(_word_chunk_sql(50, 10))
def chunk_word_overlap(spark, sf_dir):
    return D.build_chunks(_docs(spark, sf_dir), 50, 10)


@query(f"""WITH {_DOCS}, b AS (SELECT * REPLACE (regexp_replace(text, '^{_WS}+|{_WS}+$', '', 'g') AS text) FROM docs), n AS (SELECT *, length(text) AS n FROM b WHERE length(text) > 0),
c AS (SELECT *, unnest(range(0, CASE WHEN n <= 300 THEN 1 ELSE ceil((n - 300) / 300.0)::BIGINT + 1 END)) AS j FROM n),
t AS (SELECT *, regexp_replace(substr(text, j * 300 + 1, 300), '^{_WS}+|{_WS}+$', '', 'g') AS chunk_text FROM c),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY j) - 1 AS i FROM t WHERE chunk_text <> '')
SELECT doc_id || '::c' || i AS chunk_id, doc_id, family_id, dataset, i::INTEGER AS chunk_index, length(chunk_text)::INTEGER AS chunk_len, 'char300o0' AS chunk_spec, chunk_text FROM k""")
def chunk_char(spark, sf_dir):
    return D.build_chunks(_docs(spark, sf_dir), 300, 0, "char")


_SPLIT = f"""{_DOCS}, fam AS (SELECT DISTINCT family_id FROM docs),
split AS (SELECT family_id, CASE WHEN row_number() OVER (ORDER BY md5('42|' || family_id), family_id) <= round_even((SELECT count(*) FROM fam) * 0.5, 0) THEN 'confidential' ELSE 'benign' END AS partition FROM fam)"""


@query(f"WITH {_SPLIT} SELECT family_id, partition FROM split")
def split_families_hash(spark, sf_dir):
    return D.split_families(_docs(spark, sf_dir))


@query(f"WITH {_SPLIT} SELECT doc_id, family_id FROM docs WHERE family_id IN (SELECT family_id FROM split WHERE partition = 'confidential')")
def apply_split_reference(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return D.apply_split(d, D.split_families(d), "confidential").select("doc_id", "family_id")


@query(f"WITH {_SPLIT} SELECT doc_id AS query_doc_id, partition = 'confidential' AS is_positive, CASE WHEN partition = 'confidential' THEN family_id END AS target_family_id FROM docs JOIN split USING (family_id)")
def query_manifest(spark, sf_dir):
    d = _docs(spark, sf_dir)
    s = D.split_families(d)
    one = lambda part, positive: D.apply_split(d, s, part).select(F.col("doc_id").alias("query_doc_id"), F.lit(positive).alias("is_positive"), F.col("family_id").alias("target_family_id") if positive else F.lit(None).cast("string").alias("target_family_id"))
    return one("confidential", True).unionByName(one("benign", False))


# Vectors: queries are every row whose id is divisible by 50, against all rows but itself; documents are runs of five, and
# a document's family is the least label of its vectors.
_FAMILIES = "fam AS (SELECT vec_id // 5 AS doc, 'f' || min(label) AS family FROM embeddings GROUP BY 1)"
_RETRIEVAL = f"""{_FAMILIES}, r AS (SELECT q.vec_id AS query_id, 'd' || (q.vec_id // 5) AS query_doc_id, a.family AS query_family_id, e.vec_id AS ref_id, 'd' || (e.vec_id // 5) AS ref_doc_id, b.family AS ref_family_id,
    list_dot_product(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q JOIN embeddings e ON q.vec_id % 50 = 0 AND e.vec_id <> q.vec_id JOIN fam a ON a.doc = q.vec_id // 5 JOIN fam b ON b.doc = e.vec_id // 5),
ret AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, ref_id) AS rank FROM r QUALIFY rank <= 5)"""


def _vectors(spark, sf_dir):
    """vec_id, embedding, doc_id, family_id."""
    e = _read(spark, sf_dir, "embeddings").withColumn("doc", F.expr("vec_id div 5"))
    families = e.groupBy("doc").agg(F.concat(F.lit("f"), F.min("label")).alias("family_id"))
    return e.join(families, "doc").select("vec_id", "embedding", F.concat(F.lit("d"), "doc").alias("doc_id"), "family_id")


def _retrieval(spark, sf_dir):
    side = lambda df, name, vec: df.select(F.col("vec_id").alias(f"{name}_id"), F.col("doc_id").alias(f"{name}_doc_id"), F.col("family_id").alias(f"{name}_family_id"), F.col("embedding").alias(vec))
    e = _vectors(spark, sf_dir)
    return R.top_k(side(e.where("vec_id % 50 = 0"), "query", "qv"), side(e, "ref", "rv"), 5, but_self=True).withColumn("query_chunk_id", F.col("query_id"))


@query(f"WITH {_RETRIEVAL} SELECT query_id, query_doc_id, query_family_id, ref_id, ref_doc_id, ref_family_id, round(score, 6) AS score, rank::INTEGER AS rank FROM ret")
def topk_retrieval(spark, sf_dir):
    return _retrieval(spark, sf_dir).withColumn("score", _r("score")).drop("query_chunk_id")


def _vote_sql(value: str, confidence: str, shown: str = "") -> str:
    return f"""WITH {_RETRIEVAL}, per AS (SELECT query_doc_id, query_family_id, ref_doc_id, ref_family_id, {value} AS v, count(*) AS hits FROM ret GROUP BY ALL),
    chunks AS (SELECT query_doc_id, count(DISTINCT query_id) AS n_chunks FROM ret GROUP BY 1),
    t AS (SELECT *, sum(v) OVER w AS total, row_number() OVER (PARTITION BY query_doc_id ORDER BY v DESC, ref_doc_id) AS rn FROM per WINDOW w AS (PARTITION BY query_doc_id)),
    p AS (SELECT *, CASE WHEN total > 0 THEN v / total ELSE v END AS p FROM t JOIN chunks USING (query_doc_id))
    SELECT query_doc_id, query_family_id, max(ref_doc_id) FILTER (WHERE rn = 1) AS pred_doc_id, max(ref_family_id) FILTER (WHERE rn = 1) AS pred_family_id, n_chunks::INTEGER AS n_chunks, sum(hits)::INTEGER AS n_votes, (max(hits) FILTER (WHERE rn = 1))::INTEGER AS best_votes,
      round({confidence}, 6) AS confidence,
      round(CASE WHEN count(*) FILTER (WHERE p > 0) <= 1 THEN 0 ELSE -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) / ln(count(*) FILTER (WHERE p > 0)) END, 6) AS vote_entropy,
      round(var_pop(p), 6) AS vote_variance, round(1 - sum(p * p), 6) AS vote_gini{shown} FROM p GROUP BY ALL"""


_STATS = ("confidence", "vote_entropy", "vote_variance", "vote_gini")
_COUNT_VOTES = _vote_sql("count(*)::DOUBLE", "max(v) FILTER (WHERE rn = 1) / max(total)", """, '{' || string_agg('"' || ref_doc_id || '":' || v::BIGINT, ',' ORDER BY v DESC, ref_doc_id) || '}' AS vote_distribution_json""")


def _rounded(votes):
    return votes.withColumns({c: _r(c) for c in _STATS})


@query(_COUNT_VOTES)
def vote_count(spark, sf_dir):
    return _rounded(V.vote_by_document(_retrieval(spark, sf_dir), "count"))


@query(_vote_sql("sum(score)", "CASE WHEN max(total) > 0 THEN max(v) FILTER (WHERE rn = 1) / max(total) ELSE 0 END"))
def vote_score_weight(spark, sf_dir):
    return _rounded(V.vote_by_document(_retrieval(spark, sf_dir), "weight")).drop("vote_distribution_json")


@query(_vote_sql("max(score)", "max(v) FILTER (WHERE rn = 1)"))
def vote_maxsim(spark, sf_dir):
    return _rounded(V.vote_by_document(_retrieval(spark, sf_dir), "maxsim")).drop("vote_distribution_json")


_POOL = """e AS (SELECT vec_id // 5 AS doc, generate_subscripts(embedding, 1) AS pos, unnest(embedding)::DOUBLE AS x FROM embeddings),
m AS (SELECT doc, pos, avg(x) AS m FROM e GROUP BY ALL), n AS (SELECT doc, sqrt(sum(m * m)) + 1e-12 AS norm FROM m GROUP BY doc)"""


@query(f"WITH {_POOL} SELECT doc, (pos - 1)::INTEGER AS pos, round(m / norm, 6) AS x FROM m JOIN n USING (doc)")
def mean_pool_vectors(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("doc"), "embedding")
    return R.mean_pool(e, "doc", "embedding").select("doc", F.posexplode("vector").alias("pos", "x")).withColumn("x", _r("x"))


# Labelled scores with ties: share of distinct words, for every labelled document.
_SCORED = f"""{_DOCS}, scored AS (SELECT l.doc_id, l.quality = 0 AS is_positive, round(1 - len(list_distinct(words)) / greatest(len(words), 1)::DOUBLE, 2) AS score
FROM labels l JOIN docs ON l.doc_id::VARCHAR = docs.doc_id)"""


def _scored(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", T.py_words(F.col("text")).alias("w"))
    score = F.round(1 - F.size(F.array_distinct("w")) / F.greatest(F.size("w"), F.lit(1)).cast("double"), 2)
    return _read(spark, sf_dir, "labels").join(d, "doc_id").select("doc_id", (F.col("quality") == 0).alias("is_positive"), score.alias("score"))


_CONF = "count(*) FILTER (WHERE is_positive AND score >= 0.5) AS tp, count(*) FILTER (WHERE NOT is_positive AND score >= 0.5) AS fp, count(*) FILTER (WHERE NOT is_positive AND score < 0.5) AS tn, count(*) FILTER (WHERE is_positive AND score < 0.5) AS fn"


@query(f"""WITH {_SCORED}, c AS (SELECT {_CONF} FROM scored), q AS (SELECT *, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall FROM c)
SELECT tp, fp, tn, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(coalesce(2 * precision * recall / nullif(precision + recall, 0), 0), 6) AS f1, round(coalesce((tp + tn) / nullif(tp + fp + tn + fn, 0), 0), 6) AS accuracy FROM q""")
def detection_metrics(spark, sf_dir):
    c = R.confusion(_scored(spark, sf_dir), 0.5)
    return c.select("tp", "fp", "tn", "fn", *[_r(x).alias(x) for x in ("precision", "recall", "f1", "accuracy")])


@query(f"WITH {_SCORED} SELECT doc_id, CASE WHEN is_positive THEN CASE WHEN score >= 0.5 THEN 'TP' ELSE 'FN' END ELSE CASE WHEN score >= 0.5 THEN 'FP' ELSE 'TN' END END AS category FROM scored")
def case_categories(spark, sf_dir):
    hit = F.col("score") >= 0.5
    return _scored(spark, sf_dir).select("doc_id", F.when(F.col("is_positive"), F.when(hit, "TP").otherwise("FN")).otherwise(F.when(hit, "FP").otherwise("TN")).alias("category"))


_CURVE = f"""{_SCORED}, g AS (SELECT score, count(*) FILTER (WHERE is_positive) AS p, count(*) FILTER (WHERE NOT is_positive) AS n FROM scored GROUP BY score),
cum AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM g)"""


@query(f"WITH {_CURVE} SELECT score AS threshold, round(2 * tp / (tp + fp + ps), 6) AS f1, round(tp / (tp + fp), 6) AS precision, round(tp / ps, 6) AS recall FROM cum ORDER BY round(2 * tp / (tp + fp + ps), 12) DESC, score LIMIT 1")
def best_f1_sweep(spark, sf_dir):
    return R.best_f1(_scored(spark, sf_dir)).withColumns({c: _r(c) for c in ("f1", "precision", "recall")})


@query(f"WITH {_CURVE} SELECT round(sum(p / ps * tp / (tp + fp)), 6) AS average_precision, round(sum(p * (ns - fp + n / 2) / ps / ns), 6) AS roc_auc FROM cum")
def average_precision_roc_auc(spark, sf_dir):
    return R.areas(_scored(spark, sf_dir)).select(_r("average_precision").alias("average_precision"), _r("roc_auc").alias("roc_auc"))


_SHINGLES = f"{_DOCS}, s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i : i + 4], ' ')) END) AS s FROM docs)"


@query(f"WITH {_SHINGLES} SELECT doc_id, count(*) AS n_shingles, min(md5(s)) AS first_md5 FROM s GROUP BY doc_id")
def word_shingles(spark, sf_dir):
    s = _docs(spark, sf_dir).select("doc_id", F.explode(T.shingles(F.col("text"), 5)).alias("s"))
    return s.groupBy("doc_id").agg(F.count("*").alias("n_shingles"), F.min(F.md5("s")).alias("first_md5"))


# MinHash: 128 slots, and for a threshold of 0.2 28 bands of 2.
_SLOTS, _LSH_BANDS, _LSH_ROWS = 128, 28, 2


def _sign(spark, sf_dir, name="documents", key="doc_id", prefix=""):
    d = _read(spark, sf_dir, name)
    return L.minhash_signatures(d.select(F.concat(F.lit(prefix), key).alias("id") if prefix else F.col(key).alias("id"), "text"), _SLOTS)


@query(f"""WITH {_SHINGLES}, h AS (SELECT doc_id, ('0x' || substr(md5(s), 1, 7))::BIGINT AS x FROM s)
SELECT doc_id::BIGINT AS id, (i - 1)::INTEGER AS slot, min((x * (i * 40503 + 12345) + i * 7919) % 2147483647) AS h FROM h, range(1, {_SLOTS + 1}) t(i) GROUP BY ALL""")
def minhash_signature(spark, sf_dir):
    return _sign(spark, sf_dir).select("id", F.posexplode("sig").alias("slot", "h"))


# Evaluation: queries are the documents that have a query vector; families with even numbers are the confidential ones.
_EVAL = f"""v AS ({_COUNT_VOTES}), {_FAMILIES},
man AS (SELECT 'd' || doc AS query_doc_id, substr(family, 2)::INT % 2 = 0 AS is_positive, CASE WHEN substr(family, 2)::INT % 2 = 0 THEN family END AS target_family_id FROM fam WHERE doc IN (SELECT vec_id // 5 FROM embeddings WHERE vec_id % 25 = 0)),
scored AS (SELECT query_doc_id, is_positive, target_family_id, coalesce(confidence, 0) AS score FROM man LEFT JOIN v USING (query_doc_id))"""


def _ev_sql(threshold: str = "0.4") -> str:
    hit = f"coalesce(v.confidence >= {threshold}, false)"
    return f"""{_EVAL}, ev AS (SELECT man.query_doc_id, is_positive, target_family_id, confidence, n_chunks, best_votes, query_family_id, {hit} AS pred_detected, CASE WHEN {hit} THEN pred_doc_id END AS pred_doc_id, CASE WHEN {hit} THEN pred_family_id END AS pred_family_id FROM man LEFT JOIN v USING (query_doc_id))"""


def _manifest_votes(spark, sf_dir):
    """Queries are documents with a vector whose id is divisible by 25; every other one of them has no vote."""
    e = _vectors(spark, sf_dir).where("vec_id % 25 = 0").select("doc_id", "family_id").distinct()
    even = F.substring("family_id", 2, 9).cast("int") % 2 == 0
    return E.build_query_manifest(e.where(even), e.where(~even)), _rounded(V.vote_by_document(_retrieval(spark, sf_dir)))


def _eval(spark, sf_dir):
    return E.evaluate(*_manifest_votes(spark, sf_dir), 0.4)


@query(f"WITH {_ev_sql()} SELECT query_doc_id, is_positive, target_family_id, pred_doc_id, pred_family_id, confidence, pred_detected FROM ev")
def apply_threshold(spark, sf_dir):
    return _eval(spark, sf_dir).select("query_doc_id", "is_positive", "target_family_id", "pred_doc_id", "pred_family_id", "confidence", "pred_detected")


@query(f"""WITH {_ev_sql()}, c AS (SELECT count(*) FILTER (WHERE is_positive) AS n_positive, count(*) FILTER (WHERE is_positive AND pred_detected) AS n_detected,
count(*) FILTER (WHERE is_positive AND pred_detected AND pred_family_id = target_family_id) AS n_correct FROM ev)
SELECT *, round(coalesce(n_correct / nullif(n_positive, 0), 0), 6) AS rate_all, round(coalesce(n_correct / nullif(n_detected, 0), 0), 6) AS rate_detected FROM c""")
def attribution_metrics(spark, sf_dir):
    return E.attribution(_eval(spark, sf_dir)).withColumn("rate_all", _r("rate_all")).withColumn("rate_detected", _r("rate_detected"))


@query(f"""WITH {_ev_sql()}, p AS (SELECT target_family_id AS family_id, count(*) AS n, count(*) FILTER (WHERE pred_detected) AS d, count(*) FILTER (WHERE pred_detected AND pred_family_id = target_family_id) AS a FROM ev WHERE is_positive GROUP BY 1),
f AS (SELECT pred_family_id AS family_id, count(*) AS x FROM ev WHERE NOT is_positive AND pred_detected GROUP BY 1)
SELECT family_id, coalesce(n, 0) AS n_positive_total, coalesce(d, 0) AS n_positive_detected, coalesce(a, 0) AS n_attribution_correct, coalesce(x, 0) AS n_false_attraction,
round(coalesce(d / nullif(n, 0), 0), 6) AS detection_rate, round(coalesce(a / nullif(d, 0), 0), 6) AS attribution_rate FROM p FULL JOIN f USING (family_id)""")
def errors_by_family(spark, sf_dir):
    return E.errors_by_family(_eval(spark, sf_dir)).withColumn("detection_rate", _r("detection_rate")).withColumn("attribution_rate", _r("attribution_rate"))


@query(f"WITH {_ev_sql()} SELECT query_doc_id, query_family_id, pred_doc_id, pred_family_id, confidence, best_votes, n_chunks FROM ev WHERE NOT is_positive AND pred_detected")
def false_positive_pairs(spark, sf_dir):
    return E.false_positives(_eval(spark, sf_dir)).drop("vote_entropy", "vote_gini", "vote_distribution_json")


@query(f"""WITH {_ev_sql()}, t AS (SELECT CASE WHEN is_positive THEN 'positive' ELSE 'negative' END AS actual, pred_detected FROM ev UNION ALL SELECT 'total', pred_detected FROM ev)
SELECT actual, count(*) FILTER (WHERE pred_detected) AS detected, count(*) FILTER (WHERE NOT pred_detected) AS passed, count(*) AS total FROM t GROUP BY actual""")
def confusion_matrix(spark, sf_dir):
    return E.confusion_matrix(_eval(spark, sf_dir))


_BEST = """g AS (SELECT score, count(*) FILTER (WHERE is_positive) AS p, count(*) FILTER (WHERE NOT is_positive) AS n FROM scored GROUP BY score),
cum AS (SELECT *, sum(p) OVER (ORDER BY score DESC) AS tp, sum(n) OVER (ORDER BY score DESC) AS fp, sum(p) OVER () AS ps, sum(n) OVER () AS ns FROM g),
best AS (SELECT score AS t, 2 * tp / (tp + fp + ps) AS f1 FROM cum ORDER BY round(2 * tp / (tp + fp + ps), 12) DESC, score LIMIT 1)"""


@query(f"""WITH {_EVAL}, {_BEST}, ev AS (SELECT is_positive, target_family_id, coalesce(v.confidence >= t, false) AS hit, pred_family_id FROM best, man LEFT JOIN v USING (query_doc_id)),
c AS (SELECT count(*) FILTER (WHERE is_positive AND hit) AS tp, count(*) FILTER (WHERE NOT is_positive AND hit) AS fp, count(*) FILTER (WHERE NOT is_positive AND NOT hit) AS tn, count(*) FILTER (WHERE is_positive AND NOT hit) AS fn, count(*) FILTER (WHERE is_positive AND hit AND pred_family_id = target_family_id) AS ok FROM ev),
a AS (SELECT sum(p / ps * tp / (tp + fp)) AS ap, sum(p * (ns - fp + n / 2) / ps / ns) AS auc FROM cum)
SELECT t AS threshold, tp, fp, tn, fn, round(f1, 6) AS best_f1, round(ok / (tp + fn), 6) AS family_acc_on_all_positive, round(coalesce(ok / nullif(tp, 0), 0), 6) AS family_acc_on_detected_positive, round(ap, 6) AS pr_auc, round(auc, 6) AS roc_auc, round((tp + fn) / (tp + fp + tn + fn), 6) AS positive_ratio FROM best, c, a""")
def evaluate_run(spark, sf_dir):
    m, _ = E.evaluate_run(*_manifest_votes(spark, sf_dir))
    flat = {"threshold": m["threshold"]} | {k: m["detection"][k] for k in ("tp", "fp", "tn", "fn")} | {"best_f1": m["detection_best"]["best_f1"]} | m["attribution"] | m["separability"]
    return spark.createDataFrame([tuple(round(x, 6) if isinstance(x, float) else x for x in flat.values())], list(flat))


@query(f"WITH {_SPLIT}, part AS (SELECT family_id FROM docs WHERE dataset = 'src0') SELECT DISTINCT family_id FROM docs WHERE family_id NOT IN (SELECT family_id FROM part)")
def family_coverage_gap(spark, sf_dir):
    d = _docs(spark, sf_dir)
    return E.uncovered_families(d, D.split_families(d.where("dataset = 'src0'")))


_BANDS = f"""{_SHINGLES}, every AS (SELECT 'q' || doc_id AS id, s FROM s UNION SELECT 'r' || item_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END)
  FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
h AS (SELECT id, ('0x' || substr(md5(s), 1, 7))::BIGINT AS x FROM every),
sg AS (SELECT id, (i - 1)::INTEGER AS slot, min((x * (i * 40503 + 12345) + i * 7919) % 2147483647) AS h FROM h, range(1, {_SLOTS + 1}) t(i) GROUP BY ALL),
bd AS (SELECT id, slot // {_LSH_ROWS} AS band, string_agg(h::VARCHAR, '-' ORDER BY slot) AS key FROM sg WHERE slot < {_LSH_ROWS * _LSH_BANDS} GROUP BY ALL)"""


@query(f"WITH {_BANDS} SELECT DISTINCT substr(q.id, 2)::BIGINT AS query_id, substr(r.id, 2)::BIGINT AS ref_id FROM bd q JOIN bd r USING (band, key) WHERE q.id[1] = 'q' AND r.id[1] = 'r'")
def lsh_candidates(spark, sf_dir):
    return L.band_candidates(_sign(spark, sf_dir), _sign(spark, sf_dir, "benchmark", "item_id"), _LSH_BANDS, _LSH_ROWS)


# Lexical methods: documents are the queries, benchmark items the references, in families of four.
def _refs_queries(spark, sf_dir):
    b, d = _read(spark, sf_dir, "benchmark"), _read(spark, sf_dir, "documents")
    refs = b.select(F.concat(F.lit("r"), "item_id").alias("doc_id"), F.concat(F.lit("f"), F.expr("item_id div 4")).alias("family_id"), "text")
    return refs, d.select(F.concat(F.lit("q"), "doc_id").alias("doc_id"), F.col("source").alias("family_id"), "text")


def _family_sql(order: str, unmatched: int, scale: str = "1") -> str:
    """Votes from sc (query_doc_id, ref_doc_id, score)."""
    return f"""fs AS (SELECT query_doc_id, 'f' || (substr(ref_doc_id, 2)::BIGINT // 4) AS family, max(score) AS score, min_by(ref_doc_id, (-score, ref_doc_id)) AS ref FROM sc GROUP BY ALL),
p AS (SELECT *, score / sum(score) OVER (PARTITION BY query_doc_id) AS p, row_number() OVER (PARTITION BY query_doc_id ORDER BY score DESC, {order}) AS rn FROM fs),
v AS (SELECT query_doc_id, max(ref) FILTER (WHERE rn = 1) AS pred_doc_id, max(family) FILTER (WHERE rn = 1) AS pred_family_id, max(score) AS confidence, CASE WHEN count(*) <= 1 THEN 0 ELSE -sum(p * ln(p)) / ln(count(*)) END AS vote_entropy, var_pop(p) AS vote_variance, 1 - sum(p * p) AS vote_gini FROM p GROUP BY 1)
SELECT 'q' || doc_id AS query_doc_id, source AS query_family_id, pred_doc_id, pred_family_id, 1 AS n_chunks, CASE WHEN v.query_doc_id IS NULL THEN {unmatched} ELSE 1 END AS n_votes, CASE WHEN v.query_doc_id IS NULL THEN {unmatched} ELSE 1 END AS best_votes,
round(coalesce(confidence, 0) / {scale}, 6) AS confidence, round(coalesce(vote_entropy, 0), 6) AS vote_entropy, round(coalesce(vote_variance, 0), 6) AS vote_variance, round(coalesce(vote_gini, 1), 6) AS vote_gini FROM documents d LEFT JOIN v ON v.query_doc_id = 'q' || d.doc_id"""


_STOP = ", ".join(f"'{w}'" for w in L.STOP_WORDS)
_TOKENS = f"list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\\p{{L}}\\p{{N}}_]+'), lambda w: length(w) > 1 AND w NOT IN ({_STOP}))"
_BM25 = f"""tok AS (SELECT 'r' || item_id AS ref_id, unnest({_TOKENS}) AS term FROM benchmark),
post AS (SELECT ref_id, term, count(*) AS tf FROM tok GROUP BY ALL), dl AS (SELECT ref_id, sum(tf) AS dl FROM post GROUP BY ref_id),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term), st AS (SELECT (SELECT count(*) FROM benchmark) AS n, (SELECT sum(dl) FROM dl) AS len),
w AS (SELECT ref_id, term, ln(1 + (n - df + 0.5) / (df + 0.5)) * tf / (tf + 1.5 * (0.25 + 0.75 * dl / (len / n))) AS w FROM post JOIN dl USING (ref_id) JOIN df USING (term), st),
qt AS (SELECT 'q' || doc_id AS query_id, unnest({_TOKENS}) AS term FROM documents),
qc AS (SELECT query_id, term, count(*) AS qtf FROM qt GROUP BY ALL),
every AS (SELECT query_id, ref_id, round(sum(qtf * w), 12) AS score FROM qc JOIN w USING (term) GROUP BY ALL),
sc AS (SELECT query_id AS query_doc_id, ref_id AS ref_doc_id, score FROM every QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ref_id) <= 200)"""


@query(f"WITH {_BM25}, {_family_sql('ref', 1)}")
def bm25_votes(spark, sf_dir):
    return _rounded(L.bm25_votes(*_refs_queries(spark, sf_dir))).drop("vote_distribution_json")


def bm25_keyword_votes(spark, sf_dir):
    """Stems have no SQL: tests hold them against plain Python. The families' keyphrases are their texts' first line each."""
    refs, queries = _refs_queries(spark, sf_dir)
    phrases = refs.groupBy("family_id").agg(F.array_join(F.sort_array(F.collect_list(F.substring_index("text", ".", 1))), " ").alias("keyphrases"))
    return _rounded(L.bm25_votes(refs, queries, "keyword", phrases))


def fuzzy_hash_votes(spark, sf_dir):
    """Digests have no SQL: tests hold the join on keys against all pairs."""
    return _rounded(L.fuzzy_hash_votes(*_refs_queries(spark, sf_dir)))


QUERIES |= {f.__name__: f for f in (bm25_keyword_votes, fuzzy_hash_votes)}


@query(f"""WITH {_BANDS}, cand AS (SELECT DISTINCT q.id AS qid, r.id AS rid FROM bd q JOIN bd r USING (band, key) WHERE q.id[1] = 'q' AND r.id[1] = 'r'),
sc AS (SELECT qid AS query_doc_id, rid AS ref_doc_id, count(*) / {_SLOTS} AS score FROM cand JOIN sg a ON a.id = qid JOIN sg b ON b.id = rid AND b.slot = a.slot AND b.h = a.h GROUP BY ALL), {_family_sql('family DESC', 0)}""")
def minhash_votes(spark, sf_dir):
    return _rounded(L.minhash_lsh_votes(*_refs_queries(spark, sf_dir), _SLOTS)).drop("vote_distribution_json")


# Pairs of consecutive turns stand for originals and variants.
_PAIRS = """pr AS (SELECT a.conv_id, a.turn, regexp_extract_all(lower(a.text), '[a-z0-9]+') AS r, regexp_extract_all(lower(b.text), '[a-z0-9]+') AS h
FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND b.turn = a.turn + 1)"""


def _pairs(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations")
    a = c.select("conv_id", "turn", T.quality_tokens(F.col("text")).alias("r"))
    b = c.select("conv_id", (F.col("turn") - 1).alias("turn"), T.quality_tokens(F.col("text")).alias("h"))
    return a.join(b, ["conv_id", "turn"])


def _grams(name: str, n: int) -> str:
    return f"list_distinct(CASE WHEN len({name}) >= {n} THEN list_transform(range(1, len({name}) - {n - 2}), lambda i: array_to_string({name}[i : i + {n - 1}], ' ')) ELSE [] END)"


@query(f"WITH {_PAIRS}, g AS (SELECT conv_id, turn, {', '.join(f'{_grams(c, n)} AS {c}{n}' for c in 'rh' for n in (1, 2, 3))} FROM pr) SELECT conv_id, turn, {', '.join(f'round(coalesce(len(list_intersect(r{n}, h{n})) / nullif(len(h{n}), 0), 0), 6) AS overlap_{n}' for n in (1, 2, 3))}, round(coalesce(len(list_intersect(r1, h1)) / nullif(len(list_distinct(list_concat(r1, h1))), 0), 0), 6) AS jaccard FROM g")
def lexical_overlap(spark, sf_dir):
    p = _pairs(spark, sf_dir)
    r, h = F.col("r"), F.col("h")
    return p.select("conv_id", "turn", *[_r(T.ngram_overlap(r, h, n)).alias(f"overlap_{n}") for n in (1, 2, 3)], _r(T.jaccard(r, h)).alias("jaccard"))


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)::INTEGER AS version_index FROM conversations QUALIFY max(version_index) OVER (PARTITION BY conv_id) >= 2".replace("QUALIFY max(version_index) OVER (PARTITION BY conv_id) >= 2", "QUALIFY count(*) OVER (PARTITION BY conv_id) >= 2"))
def version_rank_eligible(spark, sf_dir):
    v = D.version_rank(_read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return D.eligible_families(v, "conv_id").select("conv_id", "turn", "role", "version_index")


@query("SELECT conv_id, turn, role, text FROM conversations QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1")
def latest_revision(spark, sf_dir):
    v = D.version_rank(_read(spark, sf_dir, "conversations"), "conv_id", "turn", "role", "text")
    return D.latest_revision(v, "conv_id").select("conv_id", "turn", "role", "text")


# Entity resolution: documents are joined to the first with the same prefix fingerprint or the same text.
@query("""WITH f AS (SELECT doc_id, substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 200) AS fp FROM documents),
a AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS first FROM f WHERE length(fp) >= 18)
SELECT doc_id AS src, first AS dst FROM a WHERE doc_id <> first""")
def fingerprint_edges(spark, sf_dir):
    f = _read(spark, sf_dir, "documents").select("doc_id", F.substring(F.regexp_replace(F.lower("text"), "[^a-z0-9]", ""), 1, 200).alias("fp")).where(F.length("fp") >= 18)
    first = f.groupBy("fp").agg(F.min("doc_id").alias("dst"))
    return f.join(first, "fp").where("doc_id <> dst").select(F.col("doc_id").alias("src"), "dst")


@query("""WITH RECURSIVE f AS (SELECT doc_id, substr(regexp_replace(lower(text), '[^a-z0-9]', '', 'g'), 1, 200) AS fp FROM documents),
a AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY fp) AS first FROM f WHERE length(fp) >= 18),
e AS (SELECT doc_id AS s, first AS d FROM a WHERE doc_id <> first),
b AS (SELECT s, d FROM e UNION SELECT d, s FROM e),
r(node, seen) AS (SELECT s, s FROM b UNION SELECT r.node, b.d FROM r JOIN b ON r.seen = b.s)
SELECT node, min(seen) AS component FROM r GROUP BY node""")
def connected_components_query(spark, sf_dir):
    return connected_components(fingerprint_edges(spark, sf_dir))


def _gram_sql(c: str) -> str:
    return f"SELECT conv_id, turn, n, g, count(*) AS c FROM (SELECT conv_id, turn, n, unnest(CASE WHEN len({c}) >= n THEN list_transform(range(1, len({c}) - n + 2), lambda i: array_to_string({c}[i : i + n - 1], ' ')) ELSE [] END) AS g FROM pr, range(1, 5) t(n)) GROUP BY ALL"


@query(f"""WITH {_PAIRS}, ch AS ({_gram_sql("h")}), cr AS ({_gram_sql("r")}),
per AS (SELECT conv_id, turn, n, sum(least(ch.c, coalesce(cr.c, 0))) AS o, sum(ch.c) AS t FROM ch LEFT JOIN cr USING (conv_id, turn, n, g) GROUP BY ALL),
geo AS (SELECT conv_id, turn, exp(avg(ln((o + 1) / (t + 1)))) AS geo FROM per GROUP BY ALL)
SELECT conv_id, turn, round(coalesce(geo, 0) * CASE WHEN len(h) = 0 THEN 0 WHEN len(h) >= len(r) THEN 1 ELSE exp(1 - len(r) / len(h)) END, 6) AS self_bleu FROM pr LEFT JOIN geo USING (conv_id, turn)""")
def self_bleu_pairs(spark, sf_dir):
    return L.self_bleu(_pairs(spark, sf_dir), "conv_id", "turn").withColumn("self_bleu", _r("self_bleu"))


@query("""WITH a AS (SELECT doc_id, regexp_replace(lower(regexp_replace(coalesce(text, ''), '''', '', 'g')), '[^a-z0-9 <>=,.:-]', ' ', 'g') AS t FROM documents),
b AS (SELECT doc_id, trim(regexp_replace(regexp_replace(t, ' *, *', ' , ', 'g'), ' +', ' ', 'g')) AS cleaned FROM a)
SELECT doc_id, cleaned, trim(regexp_replace(regexp_replace(cleaned, '\\s+,', ',', 'g'), ',\\s*', ', ', 'g')) AS joined FROM b""")
def clean_variant_text(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select("doc_id", T.clean_variant_source(F.col("text")).alias("cleaned"))
    return d.withColumn("joined", T.join_commas(F.col("cleaned")))


@query(f"""WITH {_DOCS}, c AS (SELECT doc_id, dataset, array_to_string(words, ' ') AS body FROM docs)
SELECT doc_id, concat_ws(E'\\n\\n', nullif(dataset, ''), E'Abstract\\n' || doc_id, nullif(body, '')) AS text FROM c""")
def record_to_text(spark, sf_dir):
    return _docs(spark, sf_dir).select("doc_id", T.record_text(F.col("dataset"), F.col("doc_id"), F.col("text")).alias("text"))


@query(f"""WITH w AS (SELECT doc_id, unnest({_WORDS.replace("text", "lower(text)")}) AS w FROM documents), h AS (SELECT doc_id, ('0x' || substr(md5(w), 1, 7))::BIGINT AS x FROM w),
s AS (SELECT doc_id, (x % 64)::INTEGER AS slot, sum(1 - 2 * ((x // 64) % 2)) AS v FROM h GROUP BY ALL HAVING v <> 0)
SELECT doc_id, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 6) AS value FROM s""")
def hashed_word_embedding(spark, sf_dir):
    return encoders.hashed_words(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id").withColumn("value", _r("value"))


@query(f"""WITH {_POOL}, u AS (SELECT doc, pos, m / norm AS x FROM m JOIN n USING (doc)),
sc AS (SELECT q.doc AS query_doc_id, r.doc AS ref_doc_id, sum(q.x * r.x) AS score FROM u q JOIN u r ON q.pos = r.pos AND q.doc % 50 = 0 AND r.doc <> q.doc GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY query_doc_id ORDER BY round(score, 12) DESC, ref_doc_id) AS rn, count(*) OVER (PARTITION BY query_doc_id) AS n FROM sc)
SELECT query_doc_id, ref_doc_id AS pred_doc_id, least(n, 50)::INTEGER AS n_votes, round(score, 6) AS confidence FROM k WHERE rn = 1""")
def embedding_pooled_votes(spark, sf_dir):
    e = _read(spark, sf_dir, "embeddings").select(F.expr("vec_id div 5").alias("doc_id"), F.lit("f").alias("family_id"), F.col("embedding").alias("vector"))
    pooled = R.pool_by_doc(e)
    return R.doc_vector_maxsim(pooled, pooled.where("doc_id % 50 = 0"), but_self=True).select("query_doc_id", "pred_doc_id", "n_votes", _r("confidence").alias("confidence"))


@query(f"""WITH {_RETRIEVAL}, c AS (SELECT query_doc_id, ref_doc_id, count(*) AS hits FROM ret GROUP BY ALL),
s AS (SELECT * FROM c QUALIFY row_number() OVER (PARTITION BY query_doc_id ORDER BY hits DESC, ref_doc_id) <= 32),
d AS (SELECT query_doc_id, ref_doc_id, q.vec_id, max(list_dot_product(q.embedding::DOUBLE[], r.embedding::DOUBLE[])) AS m FROM s JOIN embeddings q ON 'd' || (q.vec_id // 5) = query_doc_id JOIN embeddings r ON 'd' || (r.vec_id // 5) = ref_doc_id GROUP BY ALL)
SELECT query_doc_id, ref_doc_id, round(avg(m), 6) AS score FROM d GROUP BY ALL""")
def token_bag_maxsim(spark, sf_dir):
    bags = _read(spark, sf_dir, "embeddings").select(F.concat(F.lit("d"), F.expr("vec_id div 5")).alias("doc"), "vec_id", F.col("embedding").alias("v"))
    return R.mean_max_similarity(R.shortlist(_retrieval(spark, sf_dir)), bags).withColumn("score", _r("score"))


from sievelake.plans import catalogue_sets  # noqa: E402, F401  registers its queries here
