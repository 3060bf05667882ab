"""Top-k retrieval, pooling, bag similarity and the confusion and curve tables of evaluation."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.functions.text import dot, safe_div
from sievelake.operators.votes import vote_by_document
from sievelake.sources.shared import Stored

#: Rows of a block of vectors: one task scores a block of queries against a block of references.
BLOCK_ROWS = 4096
#: Bytes of query vectors that a worker holds at once; more queries take further passes over the references.
PASS_BYTES = 32 << 20
#: Query rows multiplied with a block of references at once.
TILE_ROWS = 1024
#: Scores are compared by this many digits, so that equal vectors tie wherever they stand in a block.
DIGITS = 12


def _matrix(c: pa.ChunkedArray | pa.Array, cosine: bool) -> np.ndarray:
    c = c.combine_chunks() if isinstance(c, pa.ChunkedArray) else c
    m = np.asarray(c.flatten().to_numpy(zero_copy_only=False), float).reshape(len(c), -1)
    return m / np.linalg.norm(m, axis=1, keepdims=True) if cosine else m


def _first_of_equal(vectors: np.ndarray, k: int) -> np.ndarray:
    """Rows that are among the first k of equal vectors."""
    _, code = np.unique(np.ascontiguousarray(vectors).view(np.dtype((np.void, vectors.dtype.itemsize * vectors.shape[1]))).ravel(), return_inverse=True)
    order = np.argsort(code, kind="stable")
    starts = np.flatnonzero(np.diff(code[order], prepend=-1))
    return np.sort(order[np.arange(len(order)) - np.repeat(starts, np.diff(starts, append=len(order))) < k])


class _Nearest:
    """The k best references of each query row, kept while references pass by in blocks.

    Products are taken in single precision; whatever these can't rule out, by a bound on their error, is scored again in double
    precision, so results are those of the double product. Of equal vectors in a block only the k first ids can be among the best.
    """

    def __init__(self, q: np.ndarray, k: int):
        self.q, self.k, self.small = q, k, q.astype(np.float32)
        self.norm, self.floor = np.linalg.norm(q, axis=1), np.full(len(q), -np.inf)  # a k-th best is no less than its floor
        self.found: list[pa.Table] = []
        self.waiting = 0

    def add(self, block: pa.Table, r: np.ndarray) -> None:
        by_id = pc.sort_indices(block["ref_id"]).to_numpy()
        by_id = by_id[_first_of_equal(r[by_id], self.k)]
        block, r = block.take(pa.array(by_id)), r[by_id]
        with np.errstate(over="ignore", invalid="ignore"):
            small, slack = r.astype(np.float32), (r.shape[1] + 2) * 2.0**-23 * self.norm * np.linalg.norm(r, axis=1).max() + 10.0**-DIGITS
        slack = np.where(np.isfinite(slack) & (slack < 1e30), slack, np.inf)
        for a in range(0, len(self.q), TILE_ROWS):
            with np.errstate(over="ignore", invalid="ignore"):
                s = self.small[a : a + TILE_ROWS] @ small.T
            if np.isinf(slack[a : a + TILE_ROWS]).any():
                s = np.nan_to_num(s, nan=-np.inf)
            at = np.flatnonzero(s.max(axis=1) >= self.floor[a : a + TILE_ROWS] - 2 * slack[a : a + TILE_ROWS])
            if not len(at):
                continue
            s, at = s[at], at + a
            if s.shape[1] >= self.k:
                self.floor[at] = np.maximum(self.floor[at], np.partition(s, -self.k, axis=1)[:, -self.k])
            row, col = np.nonzero(s >= (self.floor[at] - 2 * slack[at])[:, None])
            row = at[row]
            score = np.concatenate([np.einsum("ij,ij->i", self.q[row[i : i + 65536]], r[col[i : i + 65536]]) for i in range(0, len(row), 65536)])
            self.found.append(block.take(pa.array(col)).append_column("score", pa.array(np.round(score, DIGITS))).append_column("at", pa.array(row)))
            self.waiting += len(row)
            if self.waiting > max(1 << 18, 4 * self.k * len(self.q)):
                self.best()

    def best(self) -> pa.Table:
        """What is found so far: the k best of each query (row ``at``), in their order."""
        t = pa.concat_tables(self.found)
        t = t.take(pc.sort_indices(t, [("at", "ascending"), ("score", "descending"), ("ref_id", "ascending")]))
        at = t["at"].to_numpy()
        starts = np.flatnonzero(np.diff(at, prepend=-1))
        rank = np.arange(len(at)) - np.repeat(starts, np.diff(starts, append=len(at)))
        self.found, self.waiting = [t.filter(pa.array(rank < self.k))], 0
        return self.found[0]


def block_top(queries: DataFrame, refs: DataFrame, score: Callable[[pa.Table, pa.Table], np.ndarray], k: int, q_only: tuple[str, ...] = (), r_only: tuple[str, ...] = (), positive: bool = False, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Every query against every reference, in blocks: the k best references of each query, score and rank 1, 2, ...

    queries: query_id and further columns; refs: ref_id and further ones; ``q_only`` and ``r_only`` are columns that
    ``score`` needs and the result leaves out. Both sides are dealt into blocks of about ``block_rows`` rows by a hash;
    a pair of blocks is one task, gives ``score`` both as tables and takes a matrix, and passes on k rows a query. So
    tasks and what moves follow the number of rows, no key is hot and neither side is broadcast. ``positive`` keeps
    scores above 0 only. Ties go to the smaller reference id.
    """
    q_blocks, r_blocks = (max(1, -(-df.count() // block_rows)) for df in (queries, refs))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(q_blocks)).cast("int")).withColumn("rb", every(r_blocks))
    r = refs.withColumn("rb", F.pmod(F.xxhash64("ref_id"), F.lit(r_blocks)).cast("int")).withColumn("qb", every(q_blocks))
    q_names = [c for c in queries.columns if c not in q_only]
    r_names = [c for c in refs.columns if c not in r_only]
    names = [*q_names, *r_names, "score"]

    def best(own: pa.Table, held: pa.Table) -> pa.Table:
        if len(own) and len(held):
            held = held.take(pa.array(np.argsort(held["ref_id"].to_numpy(zero_copy_only=False), kind="stable")))
            scores = np.round(score(own, held), DIGITS)
            place = np.argsort(-scores, axis=1, kind="stable")[:, :k]
            value = np.take_along_axis(scores, place, 1).ravel()
            keep = value > 0 if positive else np.ones(len(value), bool)
            q_at, r_at = np.repeat(np.arange(len(own)), place.shape[1])[keep], place.ravel()[keep]
        else:
            q_at, r_at, value, keep = (np.zeros(0, np.int64),) * 2 + (np.zeros(0), slice(None))
        return pa.table([*(own[c].take(pa.array(q_at)) for c in q_names), *(held[c].take(pa.array(r_at)) for c in r_names), pa.array(value[keep], pa.float64())], names=names)

    fields = [*(queries.schema[c] for c in q_names), *(refs.schema[c] for c in r_names)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"
    found = q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInArrow(best, schema)
    ranked = found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "ref_id")))
    return ranked.where(F.col("rank") <= k)


def top_k(queries: DataFrame, refs: DataFrame, k: int = 5, but_self: bool = False, block_rows: int = BLOCK_ROWS, cosine: bool = False) -> DataFrame:
    """Exact inner-product top-k over vectors qv and rv of one length: query and reference columns without them, score and rank.

    Queries are held by the workers, as many as fit ``PASS_BYTES`` at once; references pass by once for each such part and are
    never copied or shuffled, so disk follows the results. ``cosine`` brings vectors, none of which may be 0, to norm 1 first.
    ``but_self`` leaves out the reference whose id is the query's. An empty side gives no rows. Ties go to the smaller id.
    """
    spark, most = queries.sparkSession, k + but_self
    first = queries.select(F.size("qv").alias("n")).first()
    passes = max(1, -(-queries.count() * max(first[0], 1) * 8 // PASS_BYTES)) if first else 0
    q_names, r_names = [c for c in queries.columns if c != "qv"], [c for c in refs.columns if c != "rv"]
    fields = [*(queries.schema[c] for c in q_names), *(refs.schema[c] for c in r_names)]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", score double"

    def one(part: DataFrame) -> DataFrame:
        held = spark.sparkContext.broadcast(part.select(*q_names, "qv").toArrow())

        def run(batches):
            own, near = held.value, None
            for batch in batches:
                for a in range(0, len(batch) if len(own) else 0, block_rows):
                    block = pa.Table.from_batches([batch.slice(a, block_rows)])
                    near = near or _Nearest(_matrix(own["qv"], cosine), most)
                    near.add(block.select(r_names), _matrix(block["rv"], cosine))
            if near:
                best = near.best()
                columns = [*(own[c].take(best["at"]) for c in q_names), *(best[c] for c in r_names), best["score"]]
                yield from pa.table(columns, names=[*q_names, *r_names, "score"]).combine_chunks().to_batches(10000)

        return refs.select(*r_names, "rv").mapInArrow(run, schema)

    parts = [queries.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == i) if passes > 1 else queries for i in range(passes)] or [queries.limit(0)]
    found = one(parts[0])
    for part in parts[1:]:
        found = found.unionByName(one(part))
    found = found.where("query_id <> ref_id") if but_self else found
    return found.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "ref_id"))).where(F.col("rank") <= k)


def mean_pool(chunks: DataFrame, doc: str, vec: str) -> DataFrame:
    """Element-wise mean of a document's chunk vectors, L2-normalised, as (doc, vector); partial sums per position."""
    e = chunks.select(doc, F.posexplode(vec).alias("pos", "x")).groupBy(doc, "pos").agg(F.avg(F.col("x").cast("double")).alias("m"))
    out = e.groupBy(doc).agg(F.transform(F.sort_array(F.collect_list(F.struct("pos", "m"))), lambda s: s["m"]).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)) + 1e-12
    return out.withColumn("norm", norm).select(doc, F.transform("v", lambda x: x / F.col("norm")).alias("vector"))


def pool_by_doc(chunks: DataFrame) -> DataFrame:
    """doc_id, family_id, vector from (doc_id, family_id, vector) of chunks: their mean, L2-normalised."""
    families = chunks.groupBy("doc_id").agg(F.min("family_id").alias("family_id"))
    return families.join(mean_pool(chunks, "doc_id", "vector"), "doc_id")


def doc_vector_maxsim(refs: DataFrame, queries: DataFrame, k: int = 50, but_self: bool = False) -> DataFrame:
    """Votes from one vector a document (doc_id, family_id, vector): the best of the top k; an empty side gives no votes."""
    side = lambda df, name, vec: df.select(F.col("doc_id").alias(f"{name}_id"), F.col("doc_id").alias(f"{name}_doc_id"), F.col("family_id").alias(f"{name}_family_id"), F.col("vector").alias(vec))
    q, r = Stored(side(queries, "query", "qv"), "query-vectors").df, Stored(side(refs, "ref", "rv"), "reference-vectors").df  # counted, then read
    return vote_by_document(top_k(q, r, k, but_self), "maxsim")


def confusion(scored: DataFrame, t: float) -> DataFrame:
    """tp, fp, tn, fn, precision, recall, f1, accuracy; a null score is 0 and never detected."""
    hit, pos = F.coalesce(F.col("score") >= t, F.lit(False)), F.col("is_positive")
    n = lambda c: F.count_if(c)
    c = scored.agg(n(pos & hit).alias("tp"), n(~pos & hit).alias("fp"), n(~pos & ~hit).alias("tn"), n(pos & ~hit).alias("fn"))
    c = c.withColumn("precision", safe_div(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", safe_div(F.col("tp"), F.col("tp") + F.col("fn")))
    c = c.withColumn("f1", safe_div(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    return c.withColumn("accuracy", safe_div(F.col("tp") + F.col("tn"), F.col("tp") + F.col("fp") + F.col("tn") + F.col("fn")))


def curve(scored: DataFrame, buckets: int = 64) -> DataFrame:
    """score, p, n (rows at the score), tp, fp (rows at or above), positives, negatives.

    Rows are grouped by score, scores are cut into ranges at approximate quantiles, and running sums are taken within a
    range on top of the sums of the ranges above it, so no task orders all scores.
    """
    g = scored.groupBy(F.coalesce("score", F.lit(0.0)).alias("score")).agg(F.count_if("is_positive").alias("p"), F.count_if(~F.col("is_positive")).alias("n"))
    cuts = sorted(set(g.approxQuantile("score", [i / buckets for i in range(1, buckets)], 0.005)))  # fewer than ``buckets`` numbers
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c > F.col("score"))) if cuts else F.lit(0)
    g = g.withColumn("range", above)
    before = W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    every = W.partitionBy()
    sums = g.groupBy("range").agg(F.sum("p").alias("rp"), F.sum("n").alias("rn"))  # one row a range
    sums = sums.select("range", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in ("rp", "rn")], F.sum("rp").over(every).alias("positives"), F.sum("rn").over(every).alias("negatives"))
    down = W.partitionBy("range").orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, 0)
    out = g.join(F.broadcast(sums), "range")
    return out.select("score", "p", "n", (F.sum("p").over(down) + F.col("rp0")).alias("tp"), (F.sum("n").over(down) + F.col("rn0")).alias("fp"), "positives", "negatives")


def best_f1(scored: DataFrame) -> DataFrame:
    """threshold, f1, precision, recall at the lowest threshold of the best F1; no row unless both classes occur."""
    f1 = safe_div(2 * F.col("tp"), F.col("tp") + F.col("fp") + F.col("positives"))
    found = curve(scored).where("positives > 0 AND negatives > 0").withColumn("f1", f1).orderBy(F.round("f1", 12).desc(), "score").limit(1)
    return found.select(F.col("score").alias("threshold"), "f1", safe_div(F.col("tp"), F.col("tp") + F.col("fp")).alias("precision"), safe_div(F.col("tp"), F.col("positives")).alias("recall"))


def areas(scored: DataFrame) -> DataFrame:
    """average_precision and roc_auc (ties count half)."""
    ap = F.sum(F.col("p") / F.col("positives") * F.col("tp") / (F.col("tp") + F.col("fp")))
    auc = F.sum(F.col("p") * (F.col("negatives") - F.col("fp") + F.col("n") / 2) / F.col("positives") / F.col("negatives"))
    return curve(scored).agg(ap.alias("average_precision"), auc.alias("roc_auc"))


def shortlist(retrieval: DataFrame, k: int = 32) -> DataFrame:
    """The k reference documents with most hits of each query document; ties go to the smaller id."""
    hits = retrieval.groupBy("query_doc_id", "ref_doc_id").agg(F.count("*").alias("hits"))
    order = W.partitionBy("query_doc_id").orderBy(F.col("hits").desc(), "ref_doc_id")
    return hits.withColumn("rn", F.row_number().over(order)).where(F.col("rn") <= k).select("query_doc_id", "ref_doc_id")


def mean_of_maxima(q: pa.Table, r: pa.Table) -> np.ndarray:
    """For block_top: the mean over the query's vectors (qt) of the best inner product with the reference's (rt); 0 if either is empty."""
    bag = lambda x: np.asarray(x, float).reshape(len(x), -1)
    held = [bag(x) for x in r["rt"].to_pylist()]
    full = [i for i, x in enumerate(held) if len(x)]
    out = np.zeros((len(q), len(r)))
    if not full:
        return out
    every, starts = np.concatenate([held[i] for i in full]), np.cumsum([0, *(len(held[i]) for i in full[:-1])])
    for i, x in enumerate(q["qt"].to_pylist()):
        if x:
            out[i, full] = np.maximum.reduceat(bag(x) @ every.T, starts, axis=1).mean(axis=0)
    return out


def mean_max_similarity(pairs: DataFrame, bags: DataFrame, ref_bags: DataFrame | None = None) -> DataFrame:
    """For pairs of documents: mean over the query's vectors of the best inner product with the reference's. bags: doc, vec_id, v
    of the queries, and of the references too unless they come by themselves."""
    q = bags.select(F.col("doc").alias("query_doc_id"), F.col("vec_id").alias("query_id"), F.col("v").alias("qv"))
    r = (bags if ref_bags is None else ref_bags).select(F.col("doc").alias("ref_doc_id"), F.col("v").alias("rv"))
    scored = pairs.join(q, "query_doc_id").join(r, "ref_doc_id").withColumn("s", dot(F.col("qv"), F.col("rv")))
    best = scored.groupBy("query_doc_id", "ref_doc_id", "query_id").agg(F.max("s").alias("s"))
    return best.groupBy("query_doc_id", "ref_doc_id").agg(F.avg("s").alias("score"))


def bag_similarity(pairs: DataFrame, q: DataFrame, r: DataFrame) -> DataFrame:
    """query_doc_id, ref_doc_id, score of pairs of documents: mean over all the query's vectors of the best inner product with any
    of the reference's, from bags by chunk (doc_id, chunk_id, tokens). Pairs with an empty side have no row.

    A row holds one chunk of either side and becomes one best value for each query vector, so products never leave the
    task that makes them; best values are joined by grouped maxima.
    """
    mine = q.select(F.col("doc_id").alias("query_doc_id"), F.col("chunk_id").alias("q_chunk"), F.col("tokens").alias("qt"))
    theirs = r.select(F.col("doc_id").alias("ref_doc_id"), F.col("tokens").alias("rt"))
    met = pairs.select("query_doc_id", "ref_doc_id").join(mine, "query_doc_id").join(theirs, "ref_doc_id").where((F.size("qt") > 0) & (F.size("rt") > 0))
    met = met.select("query_doc_id", "ref_doc_id", "q_chunk", "qt", "rt")

    def best(batches):
        bag = lambda x: np.asarray(x, float)
        for batch in batches:
            out = [(bag(a) @ bag(b).T).max(axis=1) for a, b in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.list_(pa.float64()))], names=["query_doc_id", "ref_doc_id", "q_chunk", "best"])

    keys = ", ".join(f"{c} {met.schema[c].dataType.simpleString()}" for c in ("query_doc_id", "ref_doc_id", "q_chunk"))
    rows = met.mapInArrow(best, f"{keys}, best array<double>").select("query_doc_id", "ref_doc_id", "q_chunk", F.posexplode("best").alias("at", "s"))
    each = rows.groupBy("query_doc_id", "ref_doc_id", "q_chunk", "at").agg(F.max("s").alias("s"))
    return each.groupBy("query_doc_id", "ref_doc_id").agg(F.avg("s").alias("score"))
