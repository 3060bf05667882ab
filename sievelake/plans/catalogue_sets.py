"""More registered queries: text of papers, sets and splits, encoders, reports. Imported by the catalogue."""

from __future__ import annotations

from pyspark.sql import functions as F

from sievelake.functions import text as T
from sievelake.operators import datasets as DS
from sievelake.operators import documents as D
from sievelake.operators import encoders as X
from sievelake.operators import retrieval as R
from sievelake.operators import revisions as V
from sievelake.operators import votes as VT
from sievelake.plans import report
from sievelake.plans import runs as P
from sievelake.plans.catalogue import _DOCS, _SPLIT, _WS, _docs, _r, _read, query
from sievelake.sources.shared import Stored



def _strip(x: str) -> str:
    return f"regexp_replace({x}, '^{_WS}+|{_WS}+$', '', 'g')"


def _clean(x: str) -> str:
    return f"trim(regexp_replace({x}, '{_WS}+', ' ', 'g'))"


@query(f"SELECT doc_id, array_to_string(list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10)) AS text FROM documents")
def paragraph_join(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.paragraph_join(F.split(F.coalesce("text", F.lit("")), "\n")).alias("text"))


# Messages stand for a paper's sentences: every third one opens, or goes on with, the abstract.
_KINDS = "CASE WHEN turn = 0 THEN 'title' WHEN turn % 3 = 0 OR role = 'system' THEN 'p' ELSE 'abstract' END"


@query(f"""WITH s AS (SELECT conv_id, turn, role, text AS raw, {_KINDS} AS kind, {_clean("coalesce(text, '')")} AS text FROM conversations),
t AS (SELECT *, lag(kind) OVER (PARTITION BY conv_id ORDER BY turn, role, raw) AS last FROM s WHERE text <> '')
SELECT conv_id, string_agg(CASE WHEN kind = 'abstract' AND last IS DISTINCT FROM 'abstract' THEN 'Abstract' || chr(10) || text ELSE text END, chr(10) || chr(10) ORDER BY turn, role, raw) AS text FROM t GROUP BY conv_id""")
def compose_text(spark, sf_dir):
    c = _read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", "text", F.expr(_KINDS).alias("kind")).alias("s"))
    g = c.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("s"))
    return g.select("conv_id", T.compose_sentences(F.col("s")).alias("text")).where("text <> ''")


@query(f"""WITH s AS (SELECT conv_id, turn, role, text AS raw, CASE WHEN turn = 0 THEN 'article-title' WHEN turn = 1 THEN 'abstract' WHEN turn % 3 = 2 THEN 'fig' ELSE 'p' END AS ntype, {_strip("coalesce(text, '')")} AS content FROM conversations)
SELECT conv_id, coalesce(string_agg(CASE WHEN ntype = 'abstract' THEN 'Abstract' || chr(10) || content ELSE content END, chr(10) || chr(10) ORDER BY turn, role, raw) FILTER (WHERE ntype <> 'fig' AND content <> ''), '') AS text FROM s GROUP BY conv_id""")
def nodes_text(spark, sf_dir):
    kind = F.expr("CASE WHEN turn = 0 THEN 'article-title' WHEN turn = 1 THEN 'abstract' WHEN turn % 3 = 2 THEN 'fig' ELSE 'p' END")
    c = _read(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", "role", F.col("text").alias("content"), kind.alias("ntype")).alias("n"))
    return c.groupBy("conv_id").agg(F.sort_array(F.collect_list("n")).alias("n")).select("conv_id", T.nodes_text(F.col("n")).alias("text"))


@query("SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN [lang, source] ELSE [source, lang] END AS listed FROM documents")
def parse_lists(spark, sf_dir):
    """Python lists for even ids, JSON lists for odd ones, each with a blank entry."""
    d = _read(spark, sf_dir, "documents")
    python = F.concat(F.lit("['"), "lang", F.lit("', ' ', '"), "source", F.lit("']"))
    js = F.concat(F.lit('["'), "source", F.lit('", "", "'), "lang", F.lit('"]'))
    return d.select("doc_id", T.listlike(F.when(F.col("doc_id") % 2 == 0, python).otherwise(js)).alias("listed"))


@query("SELECT doc_id, source || '::<NA>::' || n_chars || '::' || substr(md5(text), 1, 16) AS made FROM documents")
def surrogate_ids(spark, sf_dir):
    d = _read(spark, sf_dir, "documents")
    return d.select("doc_id", T.surrogate_id([F.col("source"), F.lit(None), F.col("n_chars")], F.col("text")).alias("made"))


@query("SELECT DISTINCT role, CASE lower(trim(role)) WHEN 'article-title' THEN 'title' WHEN 'paragraph' THEN 'p' ELSE lower(trim(role)) END AS kind FROM conversations")
def sentence_types(spark, sf_dir):
    return _read(spark, sf_dir, "conversations").select("role", T.sentence_type(F.col("role")).alias("kind")).distinct()


_SPLIT_SETS = f"""{_SPLIT}, v AS (SELECT 'v' || doc_id AS doc_id, family_id FROM docs),
u AS (SELECT doc_id, family_id, 0 AS is_variant FROM docs UNION ALL SELECT doc_id, family_id, 1 FROM v)"""


def _sets(spark, sf_dir):
    d = D.normalize_docs(_docs(spark, sf_dir))
    variants = d.withColumn("source_doc_id", F.col("doc_id")).withColumn("doc_id", F.concat(F.lit("v"), "doc_id")).withColumn("text", F.reverse("text"))
    return P.build_query_sets(d, variants, D.split_families(d), include_original=True)


@query(f"""WITH {_SPLIT_SETS} SELECT 'reference' AS part, doc_id FROM u JOIN split USING (family_id) WHERE partition = 'confidential' AND is_variant = 0
UNION ALL SELECT CASE partition WHEN 'confidential' THEN 'positive' ELSE 'benign' END, doc_id FROM u JOIN split USING (family_id)""")
def query_sets(spark, sf_dir):
    s = _sets(spark, sf_dir)
    one = lambda df, name: df.select(F.lit(name).alias("part"), "doc_id")
    return one(s.reference, "reference").unionByName(one(s.positive, "positive")).unionByName(one(s.benign, "benign"))


@query(f"WITH {_SPLIT} SELECT 'documents' AS dataset, 42 AS seed, count(*) AS n_families, count(*) FILTER (WHERE partition = 'confidential') AS n_confidential, count(*) FILTER (WHERE partition = 'benign') AS n_benign FROM split")
def split_summary(spark, sf_dir):
    return P.split_summary(D.split_families(_docs(spark, sf_dir)).withColumn("dataset", F.lit("documents")).withColumn("seed", F.lit(42)))


@query(f"""WITH {_DOCS}, n AS (SELECT *, len(words) AS n FROM docs WHERE len(words) > 0),
c AS (SELECT *, unnest(range(0, CASE WHEN n <= 64 THEN 1 ELSE ceil((n - 64) / 56.0)::BIGINT + 1 END)) AS i FROM n),
t AS (SELECT *, array_to_string(words[i * 56 + 1 : i * 56 + 64], ' ') AS chunk_text FROM c)
SELECT doc_id || '::c' || i AS chunk_id, doc_id, family_id, dataset, i::INTEGER AS chunk_index, length(chunk_text)::INTEGER AS chunk_len, 'token64o8' AS chunk_spec, chunk_text FROM t""")
def chunk_token(spark, sf_dir):
    """Words stand for tokens, so that SQL can cut them too."""
    return X.token_chunks(_docs(spark, sf_dir), X.WordTokenizer.new(), 64, 8)


def _vector_sql(rows: str, key: str, words: str) -> str:
    return f"""WITH {_DOCS}, {rows}, w AS (SELECT {key}, unnest({words}) AS w FROM x), h AS (SELECT {key}, ('0x' || substr(md5(w), 1, 7))::BIGINT AS x FROM w),
    s AS (SELECT {key}, (x % 64)::INTEGER AS slot, sum(1 - 2 * ((x // 64) % 2)) AS v FROM h GROUP BY ALL HAVING v <> 0)
    SELECT {key}, slot, round(v / sqrt(sum(v * v) OVER (PARTITION BY {key})), 4) AS value FROM s"""


def _slots(df, key, vec):
    return df.select(key, F.posexplode(vec).alias("slot", "value")).where("value <> 0").withColumn("value", F.round(F.col("value").cast("double"), 4))


@query(_vector_sql("""n AS (SELECT *, len(words) AS n FROM docs WHERE len(words) > 0), c AS (SELECT *, unnest(range(0, CASE WHEN n <= 50 THEN 1 ELSE ceil((n - 50) / 50.0)::BIGINT + 1 END)) AS i FROM n),
x AS (SELECT doc_id || '::c' || i AS chunk_id, words[i * 50 + 1 : i * 50 + 50] AS own FROM c)""", "chunk_id", "list_transform(own, lambda w: lower(w))"))
def chunk_vectors(spark, sf_dir):
    return _slots(X.encode_chunks(D.build_chunks(_docs(spark, sf_dir), 50), X.HashEncoder(64)), "chunk_id", "embedding")


@query(_vector_sql("x AS (SELECT doc_id, words[1:126] AS own FROM docs)", "doc_id", "list_transform(own, lambda w: lower(w))"))
def long_context_vectors(spark, sf_dir):
    return _slots(X.long_context_vectors(_docs(spark, sf_dir), X.HashEncoder(64), X.WordTokenizer.new(), 128, "truncate"), "doc_id", "vector")


# Chunk methods end to end: chunks of documents whose id is divisible by 50 against all other chunks, the nearest of each.
_NEAREST = f"""{_DOCS}, n AS (SELECT *, len(words) AS n FROM docs WHERE len(words) > 0), c AS (SELECT *, unnest(range(0, CASE WHEN n <= 50 THEN 1 ELSE ceil((n - 50) / 50.0)::BIGINT + 1 END)) AS i FROM n),
x AS (SELECT doc_id, family_id, doc_id || '::c' || i AS chunk_id, words[i * 50 + 1 : i * 50 + 50] AS own FROM c),
w AS (SELECT doc_id, family_id, chunk_id, unnest(list_transform(own, lambda w: lower(w))) AS w FROM x), h AS (SELECT doc_id, family_id, chunk_id, ('0x' || substr(md5(w), 1, 7))::BIGINT AS x FROM w),
s AS (SELECT doc_id, family_id, chunk_id, x % 64 AS slot, sum(1 - 2 * ((x // 64) % 2)) AS v FROM h GROUP BY ALL HAVING v <> 0),
u AS (SELECT doc_id, family_id, chunk_id, slot, v / sqrt(sum(v * v) OVER (PARTITION BY chunk_id)) AS v FROM s),
sc AS (SELECT q.doc_id AS q, q.family_id AS qf, q.chunk_id AS qc, r.doc_id AS r, r.family_id AS rf, r.chunk_id AS rc, round(sum(q.v * r.v), 12) AS score FROM u q JOIN u r ON q.slot = r.slot AND q.doc_id::BIGINT % 50 = 0 AND q.chunk_id <> r.chunk_id GROUP BY ALL),
near AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY qc ORDER BY score DESC, rc) = 1)"""


def _nearest(spark, sf_dir):
    chunks = D.build_chunks(_docs(spark, sf_dir), 50)
    # whole numbers, brought to norm 1 in double precision where they are compared, so that equal vectors tie as in SQL
    v = X.encode_chunks(chunks.select("chunk_id", "doc_id", "family_id", "chunk_text"), X.HashEncoder(64, normalize=False))
    v = Stored(v.where(F.exists("embedding", lambda x: x != 0)), "chunk-vectors").df
    q, r = v.where("doc_id % 50 = 0"), v
    side = lambda df, name, vec: df.select(F.col("chunk_id").alias(f"{name}_id"), F.col("doc_id").alias(f"{name}_doc_id"), F.col("family_id").alias(f"{name}_family_id"), F.col("embedding").alias(vec))
    return R.top_k(side(q, "query", "qv"), side(r, "ref", "rv"), 1, but_self=True, cosine=True)


@query(f"""WITH {_NEAREST}, per AS (SELECT q, qf, r, rf, count(*) AS v FROM near GROUP BY ALL), t AS (SELECT *, sum(v) OVER (PARTITION BY q) AS total, row_number() OVER (PARTITION BY q ORDER BY v DESC, r) AS k FROM per)
SELECT q AS query_doc_id, qf AS query_family_id, r AS pred_doc_id, rf AS pred_family_id, total::INTEGER AS n_votes, v::INTEGER AS best_votes, round(v / total, 6) AS confidence FROM t WHERE k = 1""")
def chunk_voting(spark, sf_dir):
    v = VT.vote_by_document(_nearest(spark, sf_dir))
    return v.select("query_doc_id", "query_family_id", "pred_doc_id", "pred_family_id", "n_votes", "best_votes", _r("confidence").alias("confidence"))


@query(f"""WITH {_NEAREST}, per AS (SELECT q, r, rf, max(score) AS v FROM near GROUP BY ALL)
SELECT q AS query_doc_id, r AS pred_doc_id, rf AS pred_family_id, round(v, 6) AS confidence FROM per QUALIFY row_number() OVER (PARTITION BY q ORDER BY v DESC, r) = 1""")
def chunk_maxsim(spark, sf_dir):
    return VT.vote_by_document(_nearest(spark, sf_dir), "maxsim").select("query_doc_id", "pred_doc_id", "pred_family_id", _r("confidence").alias("confidence"))


@query("""WITH d AS (SELECT lang AS method, source AS dataset, n_chars AS best_f1 FROM documents) SELECT * FROM (PIVOT d ON dataset USING max(best_f1) GROUP BY method)""")
def metrics_pivot(spark, sf_dir):
    """Languages stand for methods, sources for data sets."""
    return report.pivot_table(_read(spark, sf_dir, "documents").select(F.col("lang").alias("method"), F.col("source").alias("dataset"), F.col("n_chars").alias("best_f1")))


@query("""WITH d AS (SELECT lang AS method, source AS dataset, 'run__' || upper(source) AS config, n_chars::DOUBLE AS best_f1 FROM documents),
spec(label, m, part) AS (VALUES ('English', 'en', NULL), ('German, some', 'de', 'SRC1'), ('none', 'xx', NULL)),
x AS (SELECT label, dataset, best_f1 FROM spec LEFT JOIN d ON method = m AND (part IS NULL OR contains(lower(config), lower(part))))
SELECT label, max(best_f1) FILTER (WHERE dataset = 'src1') AS src1, max(best_f1) FILTER (WHERE dataset = 'src2') AS src2 FROM x GROUP BY label""")
def comparison_table(spark, sf_dir):
    m = _read(spark, sf_dir, "documents").select(F.col("lang").alias("method"), F.col("source").alias("dataset"), F.concat(F.lit("run__"), F.upper("source")).alias("config"), F.col("n_chars").cast("double").alias("best_f1"))
    return report.comparison_table(m, rows=(("English", "en", None), ("German, some", "de", "SRC1"), ("none", "xx", None)), cols=["src1", "src2"])


_FP = "substr(regexp_replace(lower(strip_accents(array_to_string(list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x) <> '' AND lower(trim(x)) <> 'abstract' AND NOT regexp_matches(lower(x), 'under review|anonymous author|conference paper at|paper under|double-blind|affiliationaddress|address email|extended abstract track|^editors:')), ' '))), '[^a-z0-9]', '', 'g'), 1, 200)"
_FPS = f"f AS (SELECT doc_id AS id, {_FP} AS fp FROM documents), d AS (SELECT fp, min(id) AS id FROM f WHERE length(fp) >= 18 GROUP BY fp)"


@query(f"SELECT doc_id, {_FP} AS fingerprint FROM documents")
def prefix_fingerprint(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.prefix_fingerprint(F.col("text")).alias("fingerprint"))


@query(f"""WITH {_FPS} SELECT a.id AS src, b.id AS dst, round(1 - levenshtein(a.fp, b.fp) / greatest(length(a.fp), length(b.fp)), 6) AS similarity FROM d a JOIN d b ON substr(a.fp, 1, 18) = substr(b.fp, 1, 18) AND a.id < b.id
WHERE 1 - levenshtein(a.fp, b.fp) / greatest(length(a.fp), length(b.fp)) >= 0.82 UNION ALL SELECT d.id, f.id, 1.0 FROM f JOIN d USING (fp) WHERE f.id <> d.id""")
def prefix_levenshtein_pairs(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "text")
    return V.similar_prefixes(d).withColumn("similarity", _r("similarity"))


# Papers: a document is a version, its source's row of the mapping lists it, metadata names a forum for every other one.
@query("""WITH m AS (SELECT doc_id::VARCHAR AS version_id, CASE WHEN n_chars % 2 = 0 THEN lang ELSE source END AS forum_id, CASE WHEN n_chars % 3 > 0 THEN n_chars END AS ts FROM documents),
r AS (SELECT *, row_number() OVER (PARTITION BY forum_id ORDER BY ts NULLS LAST, version_id) AS k FROM m)
SELECT 'casimir:' || forum_id || ':v' || k AS doc_id, 'casimir:' || forum_id AS family_id, k::INTEGER AS version_index, CASE WHEN k > 1 THEN 'revision' ELSE 'original' END AS variant_type, CASE WHEN k > 1 THEN 'casimir:' || forum_id || ':v1' END AS source_doc_id FROM r""")
def version_docs(spark, sf_dir):
    d = _read(spark, sf_dir, "documents").withColumn("id", F.col("doc_id").cast("string"))
    texts = d.select(F.col("id").alias("version_id"), F.concat(F.lit("x"), "id").alias("text"), F.lit(1).alias("num_sent_rows"))
    mapping = d.groupBy(F.col("source").alias("id_forum")).agg(F.sort_array(F.collect_list("id")).alias("references"))
    metadata = d.select("id", F.when(F.col("n_chars") % 2 == 0, F.col("lang")).otherwise(" ").alias("forum"), F.when(F.col("n_chars") % 3 > 0, F.col("n_chars")).alias("cdate"))
    none = spark.createDataFrame([], "forum_id string, cluster_id string")
    return V.assemble_docs(V.version_meta(texts, mapping, metadata), none, spark.createDataFrame([], "forum_id string, split string")).select("doc_id", "family_id", "version_index", "variant_type", "source_doc_id")


@query(f"""WITH {_DOCS} SELECT 'set:' || doc_id || ':orig' AS doc_id, 'set:' || doc_id AS family_id, concat_ws(chr(10) || chr(10), nullif(dataset, ''), 'Abstract' || chr(10) || family_id, nullif(array_to_string(words, ' '), '')) AS text,
'{{"raw_name":"' || doc_id || '","title":"' || dataset || '","keywords":"a;b"}}' AS meta_json FROM docs""")
def keyphrase_docs(spark, sf_dir):
    d = _docs(spark, sf_dir).select(F.col("doc_id").alias("name"), F.col("dataset").alias("title"), F.col("family_id").alias("abstract"), F.col("text").alias("fulltext"), F.lit(" a;b ").alias("keywords"))
    return DS.keyphrase_docs(d, "set").select("doc_id", "family_id", "text", "meta_json")
