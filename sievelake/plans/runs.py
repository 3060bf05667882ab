"""Runs: split, query sets, method, votes, evaluation and what is kept of them.

A method is a function (reference docs, query docs) -> (votes, timing); METHOD_BUILDERS make one and its tag from a
RunConfig, and any other function of that shape can be run with run_method. Plans are lazy, so seconds are those of
writing a stage's table: votes are written once, and everything after reads them.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievelake.operators import documents as D
from sievelake.operators import encoders as X
from sievelake.operators import evaluation as E
from sievelake.operators import lexical as L
from sievelake.operators import retrieval as R
from sievelake.operators import votes as V
from sievelake.plans.config import CHUNK_METHODS, RunConfig
from sievelake.sources import storage as S
from sievelake.sources.shared import Stored

#: Families that the order of a seeded generator may be asked for: they go to the driver.
MOST_SHUFFLED = 1_000_000
REF_TOKENS, QUERY_TOKENS = 500, 90


@dataclass
class Elapsed:
    sec: float = 0.0


@contextmanager
def timer():
    """Seconds of the block; put an action in it."""
    held, began = Elapsed(), time.perf_counter()
    try:
        yield held
    finally:
        held.sec = time.perf_counter() - began


def throughput(n: int, seconds: float) -> float:
    return n / seconds if seconds > 0 else 0.0


def prorated_seconds(per_set: DataFrame, used: DataFrame) -> DataFrame:
    """sec: of each set's seconds the share of its documents that ``used`` (doc_id) names, added up. per_set: set_name, doc_id, sec."""
    hit = used.select("doc_id").distinct().withColumn("used", F.lit(1))
    shares = per_set.join(hit, "doc_id", "left").groupBy("set_name").agg(F.max("sec").alias("sec"), (F.count("used") / F.count("*")).alias("share"))
    return shares.agg(F.coalesce(F.sum(F.col("sec") * F.col("share")), F.lit(0.0)).alias("sec"))


def combined_source(sources: list[str]) -> str:
    """cached, live or mixed."""
    return sources[0] if len(set(sources)) == 1 else "mixed"


# Splits and query sets.


def shuffled_split(docs: DataFrame, seed: int = 42, ratio: float = 0.5) -> DataFrame:
    """family_id, partition in the order of a seeded generator over sorted families: on the driver, so for few families only;
    split_families does without."""
    import numpy as np

    families = [r[0] for r in docs.select("family_id").distinct().orderBy("family_id").limit(MOST_SHUFFLED + 1).collect()]
    if len(families) > MOST_SHUFFLED:
        raise ValueError("too many families for the driver; use split_families")
    names = np.array(families, dtype=object)
    np.random.default_rng(seed).shuffle(names)
    cut = round(len(names) * ratio)
    rows = [(str(f), "confidential" if i < cut else "benign") for i, f in enumerate(names)]
    return docs.sparkSession.createDataFrame(rows, "family_id string, partition string")


def make_split(spark: SparkSession, prepared_dir: str, splits_dir: str, dataset: str, original_set: str, seed: int = 42, ratio: float = 0.5, overwrite: bool = False, shuffled: bool = False) -> DataFrame:
    """family_id, partition, dataset, seed of the original set's families; read again if it was made before with this seed and ratio."""
    if not 0 < ratio < 1:
        raise ValueError("0 < ratio < 1")
    path = f"{splits_dir.rstrip('/')}/{original_set}__s{seed}__r{ratio}{'__shuffled' * shuffled}.parquet"
    if overwrite or not S.exists(spark, path):
        docs = S.load_prepared_set(spark, prepared_dir, original_set)
        split = shuffled_split(docs, seed, ratio) if shuffled else D.split_families(docs, seed, ratio)
        S.save_parquet(split.withColumn("dataset", F.lit(dataset)).withColumn("seed", F.lit(seed)), path)
    return spark.read.parquet(path)


def split_summary(split: DataFrame) -> DataFrame:
    """dataset, seed, n_families, n_confidential, n_benign: one row, nulls and zeros for an empty split."""
    part = lambda p: F.count_if(F.col("partition") == p).alias(f"n_{p}")
    return split.agg(F.min("dataset").alias("dataset"), F.min("seed").alias("seed"), F.count("*").alias("n_families"), part("confidential"), part("benign"))


@dataclass(frozen=True)
class QuerySets:
    """reference: confidential originals. positive: their variants (and themselves, if asked for). benign: all the rest."""

    reference: DataFrame
    positive: DataFrame
    benign: DataFrame

    @property
    def queries(self) -> DataFrame:
        return self.positive.unionByName(self.benign)


def _check_coverage(docs: DataFrame, split: DataFrame, name: str, strict: bool) -> None:
    missing = E.uncovered_families(docs, split).orderBy("family_id").limit(5).collect()
    if missing:
        said = f"{name}: families that the split lacks, such as {[r[0] for r in missing]}"
        if strict:
            raise ValueError(said)
        import warnings

        warnings.warn(said, stacklevel=3)


def build_query_sets(originals: DataFrame, variants: DataFrame | None, split: DataFrame, include_original: bool = False, strict: bool = False) -> QuerySets:
    """Of a doc_id that occurs twice the first stays: variants before originals among positives, originals first among benign
    ones. Families that the split lacks are in no set: a warning, or an error if ``strict``."""
    _check_coverage(originals, split, "originals", strict)
    if variants is None:
        variants = originals.limit(0)
    else:
        _check_coverage(variants, split, "variants", strict)
    part = lambda df, p: D.apply_split(df, split, p)
    first = lambda sets: D.concat_keep_first(sets, "text").drop("set_no")
    positives = [part(variants, "confidential")] + [part(originals, "confidential")] * include_original
    return QuerySets(part(originals, "confidential"), first(positives), first([part(originals, "benign"), part(variants, "benign")]))


def run_query_sets(spark: SparkSession, cfg: RunConfig, strict: bool = False) -> tuple[DataFrame, QuerySets]:
    split = make_split(spark, cfg.prepared_dir, cfg.splits_dir, cfg.dataset, cfg.originals, cfg.split_seed, cfg.split_ratio)
    variants = S.concat_prepared_sets(spark, cfg.prepared_dir, list(cfg.variants)) if cfg.variants else None
    return split, build_query_sets(S.load_prepared_set(spark, cfg.prepared_dir, cfg.originals), variants, split, cfg.include_original_as_positive, strict)


# Methods.


def encoder_of(cfg: RunConfig) -> X.Encoder:
    """``encoder`` of method_params, else the hashing encoder for its names, else a sentence-transformers model."""
    if "encoder" in cfg.method_params:
        return cfg.method_params["encoder"]
    spec = cfg.embed_spec
    if spec.model_name.startswith("hashed-words-"):
        return X.HashEncoder(int(spec.model_name.rsplit("-", 1)[1]), spec.normalize_embeddings)
    return X.sentence_encoder(spec.model_name, cfg.method_params["dim"], spec.device, spec.normalize_embeddings, spec.batch_size)


def chunks_of(docs: DataFrame, cfg: RunConfig) -> DataFrame:
    spec = cfg.chunk_spec
    if spec.mode == "token":
        return X.token_chunks(docs, cfg.method_params.get("tokenizer"), spec.size, spec.overlap)
    return D.build_chunks(docs, spec.size, spec.overlap, spec.mode)


def get_or_embed(spark: SparkSession, cfg: RunConfig, set_name: str) -> tuple[DataFrame, dict, str]:
    """(chunk vectors of a whole prepared set, config, cached or live): made once, whatever the split."""
    encoder = encoder_of(cfg)
    path = S.embedding_dir(cfg.artifacts_dir, encoder.name, cfg.chunk_spec.slug(), set_name, cfg.embed_spec.normalize_embeddings)
    if S.is_cached(spark, path):
        return *S.load_vectors(spark, path), "cached"
    with timer() as cut:
        chunks = Stored(chunks_of(S.load_prepared_set(spark, cfg.prepared_dir, set_name), cfg), "chunks")
    with timer() as embed:
        made = Stored(X.encode_chunks(chunks.df, encoder), "chunk-vectors")
    config = S.save_vectors(made.df, path, {"model": encoder.name, "dim": encoder.dim, "chunk_sec": cut.sec, "embed_sec": embed.sec})
    chunks.drop()
    made.drop()
    return spark.read.parquet(f"{path}/table"), config, "live"


def search_chunks(refs: DataFrame, queries: DataFrame, k: int = 1) -> DataFrame:
    """The retrieval table: of each query chunk the k best reference chunks. Chunk tables with embedding; all vectors of one length."""
    q = queries.select(F.col("chunk_id").alias("query_id"), F.col("chunk_id").alias("query_chunk_id"), F.col("doc_id").alias("query_doc_id"), F.col("family_id").alias("query_family_id"), F.col("chunk_index").alias("query_chunk_index"), F.col("embedding").alias("qv"))
    r = refs.select(F.col("chunk_id").alias("ref_id"), F.col("chunk_id").alias("ref_chunk_id"), F.col("doc_id").alias("ref_doc_id"), F.col("family_id").alias("ref_family_id"), F.col("dataset").alias("ref_dataset"), F.col("chunk_index").alias("ref_chunk_index"), F.col("embedding").alias("rv"))
    return R.top_k(q, r, k).drop("query_id", "ref_id")


def set_vectors(spark: SparkSession, cfg: RunConfig, path: str, make: Callable[[DataFrame], DataFrame], set_name: str) -> tuple[DataFrame, dict, str]:
    """(table, config, cached or live) of a whole prepared set, made once whatever the split; ``make`` takes its docs."""
    if S.is_cached(spark, path):
        return *S.load_vectors(spark, path), "cached"
    with timer() as t:
        made = Stored(make(S.load_prepared_set(spark, cfg.prepared_dir, set_name)), "set-vectors")
    over = made.df.agg(F.count_if("overflow").alias("n")).first()["n"] if "overflow" in made.df.columns else 0
    config = S.save_vectors(made.df, path, {"encode_sec": t.sec, "n_overflow": over})
    made.drop()
    return spark.read.parquet(f"{path}/table"), config, "live"


def _union_of_sets(spark: SparkSession, cfg: RunConfig, path_of: Callable[[str], str], make: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, list[tuple[str, DataFrame, dict, str]]]:
    """The run's sets one after another, the first row of each doc_id (or chunk_id) standing; and each by itself."""
    held = [(name, *set_vectors(spark, cfg, path_of(name), make, name)) for name in (cfg.originals, *cfg.variants)]
    key = "chunk_id" if "chunk_id" in held[0][1].columns else "doc_id"
    every = held[0][1]
    for _, table, _, _ in held[1:]:
        every = every.unionByName(table.join(every.select(key), key, "left_anti"))
    return every, held


def pooled_votes(refs: DataFrame, queries: DataFrame, cfg: RunConfig, k: int = 50) -> DataFrame:
    """Votes by the mean of each document's chunk vectors, which must not be normalised before."""
    vectors = lambda docs: R.pool_by_doc(X.encode_chunks(chunks_of(docs, cfg), encoder_of(cfg)).withColumnRenamed("embedding", "vector"))
    return R.doc_vector_maxsim(vectors(refs), vectors(queries), k)


def longctx_votes(refs: DataFrame, queries: DataFrame, encoder: X.Encoder, tokenizer: X.Tokenizer, long_doc: str = "truncate", most: int = 32768, k: int = 50) -> DataFrame:
    """Votes by one vector a document. Queries that ``exclude`` leaves out get no row, so evaluation scores them 0."""
    vectors = lambda docs: X.long_context_vectors(docs, encoder, tokenizer, most, long_doc)
    return R.doc_vector_maxsim(vectors(refs), vectors(queries), k)


def longctx_method(spark: SparkSession, cfg: RunConfig, encoder: X.Encoder, tokenizer: X.Tokenizer, long_doc: str, most: int, dtype: str = "float32", k: int = 50):
    """longctx_votes over vectors of whole prepared sets that are kept from run to run, picked by document.

    A set's seconds count by the share of its documents that a side uses; searching counts as inference, encoding of
    queries too.
    """

    def method(refs: DataFrame, queries: DataFrame) -> tuple[DataFrame, dict]:
        make = lambda docs: X.long_context_vectors(docs, encoder, tokenizer, most, long_doc)
        every, held = _union_of_sets(spark, cfg, lambda name: S.longctx_dir(cfg.artifacts_dir, encoder.name, name, long_doc, most, dtype), make)
        pick = lambda docs: docs.select("doc_id", "family_id").join(every.select("doc_id", "vector"), "doc_id")
        with timer() as search:
            votes = Stored(R.doc_vector_maxsim(pick(refs), pick(queries), k), "votes").df
        per_set = None
        for name, table, config, _ in held:
            one = table.select(F.lit(name).alias("set_name"), "doc_id", F.lit(float(config["encode_sec"])).alias("sec"))
            per_set = one if per_set is None else per_set.unionByName(one)
        ref_sec, query_sec = (prorated_seconds(per_set, docs).first()["sec"] for docs in (refs, queries))
        timing = {
            "long_doc": long_doc, "model_name": encoder.name, "max_seq_length": most, "embed_source": combined_source([h[3] for h in held]), "n_overflow_sets": sum(h[2]["n_overflow"] for h in held),
            "ref_encode_sec": ref_sec, "query_encode_sec": query_sec, "search_sec": search.sec, "build_sec": ref_sec, "inference_total_sec": query_sec + search.sec,
        }
        return votes, timing

    return method


def token_bag_votes(refs: DataFrame, queries: DataFrame, encoder: X.TokenEncoder, tokenizer: X.Tokenizer, shortlist: int = 32) -> DataFrame:
    """Votes by late interaction, from texts: see bag_votes."""
    r, q = (Stored(X.token_vectors(d, encoder, tokenizer, n, asked), "token-vectors").df for d, n, asked in ((refs, REF_TOKENS, False), (queries, QUERY_TOKENS, True)))
    return bag_votes(refs, queries, r, q, shortlist)


def bag_votes(refs: DataFrame, queries: DataFrame, r: DataFrame, q: DataFrame, shortlist: int = 32) -> DataFrame:
    """Votes from token vectors by chunk (chunk_id, doc_id, tokens) of references and queries.

    Stage one: each query chunk names the reference chunk of the best mean of maxima, and a query's ``shortlist`` most
    named documents stay. Stage two: the same mean over the documents' whole bags, exactly. Query documents without a
    token get no row. Bags stay one row a chunk, so no document's bag is gathered.
    """
    named = R.block_top(
        q.select(F.col("chunk_id").alias("query_id"), F.col("doc_id").alias("query_doc_id"), F.col("tokens").alias("qt")), r.select(F.col("chunk_id").alias("ref_id"), F.col("doc_id").alias("ref_doc_id"), F.col("tokens").alias("rt")),
        R.mean_of_maxima, 1, ("qt",), ("rt",), block_rows=256,
    )
    scored = R.bag_similarity(R.shortlist(named, shortlist), q, r)
    families = refs.select(F.col("doc_id").alias("ref_doc_id"), F.col("family_id").alias("ref_family_id"))
    asked = queries.select("doc_id", "family_id").join(q.groupBy("doc_id").agg(F.count("*").alias("n_chunks")), "doc_id")
    return V.family_votes(scored.join(families, "ref_doc_id"), asked, "family")


def token_bag_method(spark: SparkSession, cfg: RunConfig, encoder: X.TokenEncoder, tokenizer: X.Tokenizer, shortlist: int = 32):
    """bag_votes over token vectors of whole prepared sets that are kept from run to run, references' and queries' apart."""

    def method(refs: DataFrame, queries: DataFrame) -> tuple[DataFrame, dict]:
        seconds, tables = {}, []
        for docs, n, asked in ((refs, REF_TOKENS, False), (queries, QUERY_TOKENS, True)):
            make = lambda d, n=n, asked=asked: X.token_vectors(d, encoder, tokenizer, n, asked)
            every, held = _union_of_sets(spark, cfg, lambda name, n=n, asked=asked: S.token_dir(cfg.artifacts_dir, encoder.name, n, asked, name), make)
            seconds[asked] = sum(h[2]["encode_sec"] for h in held)
            tables.append(every.join(docs.select("doc_id"), "doc_id", "left_semi"))
        with timer() as t:
            votes = Stored(bag_votes(refs, queries, *tables, shortlist), "votes").df
        return votes, {"inference_total_sec": seconds[True] + t.sec, "build_sec": seconds[False], "shortlist_k": shortlist}

    return method


def _plain(votes: Callable[[DataFrame, DataFrame], DataFrame], **said):
    def method(refs: DataFrame, queries: DataFrame) -> tuple[DataFrame, dict]:
        with timer() as t:
            out = Stored(votes(refs, queries), "votes").df
        return out, {"inference_total_sec": t.sec, "build_sec": 0.0, **said}

    return method


def _bm25(spark: SparkSession, cfg: RunConfig):
    scope = cfg.method_params.get("scope", "doc")
    phrases = L.keyphrases_by_family(S.load_prepared_set(spark, cfg.prepared_dir, cfg.originals)) if scope == "keyword" else None
    return _plain(lambda r, q: L.bm25_votes(r, q, scope, phrases), scope=scope), f"bm25__{scope}"


def _minhash(spark: SparkSession, cfg: RunConfig):
    p = {"num_perm": 128, "threshold": 0.2, "shingle_k": 5} | cfg.method_params
    return _plain(lambda r, q: L.minhash_lsh_votes(r, q, p["num_perm"], p["threshold"], p["shingle_k"]), **p), f"minhash_lsh__p{p['num_perm']}__t{p['threshold']}__k{p['shingle_k']}"


def _longctx(spark: SparkSession, cfg: RunConfig):
    p = {"long_doc": "truncate", "max_seq_length": 32768, "tokenizer": X.WordTokenizer.new()} | cfg.method_params
    encoder = encoder_of(cfg)
    return longctx_method(spark, cfg, encoder, p["tokenizer"], p["long_doc"], p["max_seq_length"]), f"{encoder.name}__{p['long_doc']}__L{p['max_seq_length']}"


def _colbert(spark: SparkSession, cfg: RunConfig):
    p = {"shortlist_k": 32, "tokenizer": X.WordTokenizer.new(), "encoder": X.HashEncoder()} | cfg.method_params
    return token_bag_method(spark, cfg, p["encoder"], p["tokenizer"], p["shortlist_k"]), "colbertv2__b2mean"


METHOD_BUILDERS: dict[str, Callable[[SparkSession, RunConfig], tuple[Callable, str]]] = {
    "longctx": _longctx,
    "bm25": _bm25,
    "embedding_pooled": lambda spark, cfg: (_plain(lambda r, q: pooled_votes(r, q, cfg)), f"{encoder_of(cfg).name}__{cfg.chunk_spec.slug()}__pooled"),
    "ssdeep": lambda spark, cfg: (_plain(L.fuzzy_hash_votes), "ssdeep"),
    "minhash_lsh": _minhash,
    "colbert": _colbert,
}


# Running.


def _named(cfg: RunConfig) -> dict:
    return {"dataset": cfg.dataset, "method": cfg.method, "variant_sets": list(cfg.variants), "include_original_as_positive": cfg.include_original_as_positive}


def run_method(spark: SparkSession, cfg: RunConfig, method: Callable, tag: str = "") -> dict:
    """Runs a method and keeps votes, query_manifest, per_query_eval and metrics."""
    _, sets = run_query_sets(spark, cfg)
    manifest = E.build_query_manifest(sets.positive, sets.benign)
    path = cfg.method_dir(tag)
    votes, timing = method(sets.reference, sets.queries)
    S.save_run(path, {"votes": votes, "query_manifest": manifest}, None, None)
    metrics, rows = E.evaluate_run(spark.read.parquet(f"{path}/query_manifest.parquet"), spark.read.parquet(f"{path}/votes.parquet"))
    n_positive, n_benign = sets.positive.count(), sets.benign.count()
    counts = {"n_ref_docs": sets.reference.count(), "n_query_docs": n_positive + n_benign, "n_positive": n_positive, "n_benign": n_benign}
    metrics |= _named(cfg) | {"timing_sec": timing, "counts": counts}
    S.save_run(path, {"per_query_eval": rows}, None, metrics)
    return metrics


@dataclass
class Embedded:
    refs: DataFrame
    queries: DataFrame
    seconds: dict = field(default_factory=dict)


def embed_sets(spark: SparkSession, cfg: RunConfig, sets: QuerySets) -> Embedded:
    """Reference chunks from the original set, query chunks from it and each variant set, by document; vectors come from the cache.

    A set's seconds count as queries' where it is a variant set: those of the original set are the references'.
    """
    ids = sets.queries.select("doc_id").distinct()
    original, config, source = get_or_embed(spark, cfg, cfg.originals)
    refs = original.join(sets.reference.select("doc_id"), "doc_id", "left_semi")
    queries, sources = original.join(ids, "doc_id", "left_semi"), [source]
    seconds = {"chunk_sec": config["chunk_sec"], "embed_ref_sec": config["embed_sec"], "embed_query_sec": 0.0}
    for name in cfg.variants:
        more, config, source = get_or_embed(spark, cfg, name)
        queries = queries.unionByName(more.join(ids, "doc_id", "left_semi"))
        sources.append(source)
        seconds["chunk_sec"] += config["chunk_sec"]
        seconds["embed_query_sec"] += config["embed_sec"]
    return Embedded(refs, queries, seconds | {"embed_source": combined_source(sources)})


def run_chunks(spark: SparkSession, cfg: RunConfig) -> dict:
    """Chunk voting or chunk maximum similarity; keeps every table on the way. Inference is query vectors, search and votes."""
    path, read = cfg.run_dir(), spark.read.parquet
    serial = {k: v for k, v in cfg.as_serializable().items() if k != "method_params"}
    with timer() as total:
        split, sets = run_query_sets(spark, cfg)
        manifest = E.build_query_manifest(sets.positive, sets.benign)
        S.save_run(path, {"splits_used": split, "query_manifest": manifest}, serial, None)
        held = embed_sets(spark, cfg, sets)
        S.save_run(path, {"ref_chunks": held.refs.drop("embedding")}, None, None)
        with timer() as index:
            S.save_index(held.refs, f"{path}/index", {"dim": encoder_of(cfg).dim})
        refs, index_config = S.load_index(spark, f"{path}/index")
        with timer() as search:
            found = Stored(search_chunks(refs, held.queries, cfg.top_k), "retrieval").df
        if cfg.save_retrieval:
            S.save_run(path, {"retrieval_topk": found}, None, None)
        with timer() as vote:
            S.save_run(path, {"votes": V.vote_by_document(found, "maxsim" if cfg.method == "chunk_maxsim" else "weight" if cfg.use_score_weight else "count")}, None, None)
        votes = read(f"{path}/votes.parquet")
        metrics, rows = E.evaluate_run(read(f"{path}/query_manifest.parquet"), votes)
        S.save_run(path, {"per_query_eval": rows}, None, None)
        rows = read(f"{path}/per_query_eval.parquet")
        S.save_run(path, {"errors_by_family": E.errors_by_family(rows), "fp_pairs": E.false_positives(rows)}, None, None)
    inference = held.seconds["embed_query_sec"] + search.sec + vote.sec
    counts = {"n_ref_docs": sets.reference.count(), "n_ref_chunks": index_config["n_vectors"], "n_query_docs": manifest.count(), "n_query_chunks": held.queries.count(), "n_queries": votes.count()}
    speed = {"queries_per_sec": throughput(counts["n_queries"], inference), "query_chunks_embed_per_sec": throughput(counts["n_query_chunks"], held.seconds["embed_query_sec"]), "query_chunks_search_per_sec": throughput(counts["n_query_chunks"], search.sec)}
    timing = held.seconds | {"index_build_sec": index.sec, "retrieval_sec": search.sec, "voting_sec": vote.sec, "inference_total_sec": inference, "total_sec": total.sec}
    sizes = {"size_mb": S.size_mb(spark, f"{path}/index"), "n_vectors": index_config["n_vectors"], "dim": index_config["dim"]}
    metrics |= _named(cfg) | {"timing_sec": timing, "counts": counts, "throughput": speed, "index": sizes}
    S.save_json(spark, metrics, f"{path}/metrics.json")
    return metrics


def run(spark: SparkSession, cfg: RunConfig) -> dict:
    """The one entry: metrics of a run; its tables are in the run's folder."""
    if cfg.method in CHUNK_METHODS:
        return run_chunks(spark, cfg)
    if cfg.method not in METHOD_BUILDERS:
        raise NotImplementedError(cfg.method)
    method, tag = METHOD_BUILDERS[cfg.method](spark, cfg)
    return run_method(spark, cfg, method, tag)
