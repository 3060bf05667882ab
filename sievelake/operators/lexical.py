"""Lexical detection: BM25, MinHash banding, fuzzy hashes, pair metrics. Methods give votes by family."""

from __future__ import annotations

from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType

from sievelake.functions import fuzzy_hash, stemming
from sievelake.functions.text import hash28, jaccard, ngram_overlap, ngrams, norm_edit_distance, quality_tokens, shingles, strip
from sievelake.operators.retrieval import DIGITS
from sievelake.operators.votes import family_votes, votes_of_families
from sievelake.sources.shared import Stored

PRIME = 2147483647
# Fixed value: the English stop words of the index.
STOP_WORDS = tuple("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())


_STOPPED = frozenset(STOP_WORDS)
#: Postings of references that a worker holds at once; more of them take further passes over the queries.
INDEX_ENTRIES = 1_000_000


def _words() -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[\\p{L}\\p{N}_]+"), F.lit(0))


def bm25_words(df: DataFrame, key: str) -> DataFrame:
    """key, term of each word of two characters or more in ``text``, lower-cased, without English stop words."""
    return df.select(key, F.explode(_words()).alias("term")).where((F.length("term") > 1) & ~F.col("term").isin(*STOP_WORDS))


_stem = lru_cache(1 << 18)(stemming.stem)


@F.pandas_udf(StringType())
def stem_words(words: pd.Series) -> pd.Series:
    return words.map(stemming.stem)


def _terms(df: DataFrame, key: str, stemmed: bool) -> DataFrame:
    """key, term, tf. Stems are made of the distinct words only."""
    counts = bm25_words(df, key).groupBy(key, "term").agg(F.count("*").alias("tf"))
    if not stemmed:
        return counts
    stems = counts.select("term").distinct().withColumn("stem", stem_words("term"))
    return counts.join(stems, "term").groupBy(key, F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def bm25_weights(refs: DataFrame, k1: float = 1.5, b: float = 0.75, stemmed: bool = False) -> DataFrame:
    """ref_id, term, w of refs (ref_id, text): Lucene's idf ln(1 + (N - df + 0.5) / (df + 0.5)) times the saturated count."""
    postings = _terms(refs, "ref_id", stemmed)
    dl = postings.groupBy("ref_id").agg(F.sum("tf").alias("dl"))
    df = postings.groupBy("term").agg(F.count("*").alias("df"))
    n, total = refs.count(), dl.agg(F.coalesce(F.sum("dl"), F.lit(0))).first()[0]  # two numbers
    idf = F.ln(1 + (n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    w = postings.join(dl, "ref_id").join(df, "term")
    return w.select("ref_id", "term", (idf * F.col("tf") / (F.col("tf") + k1 * (1 - b + b * F.col("dl") * n / max(total, 1)))).alias("w"))


class _Index:
    """Postings of references, (ref_id, ref_family_id, term, w) as a table: columns of a score matrix are references by id."""

    def __init__(self, t: pa.Table, top: int, stemmed: bool):
        self.top, self.stemmed, self.codes = top, stemmed, {}
        t = t.take(pc.sort_indices(t, [("term", "ascending"), ("ref_id", "ascending")]))
        self.terms = pc.unique(t["term"])
        self.starts = np.searchsorted(pc.index_in(t["term"], self.terms).to_numpy(), np.arange(len(self.terms) + 1))
        refs = t.group_by("ref_id").aggregate([("ref_family_id", "min")]).sort_by("ref_id")
        self.ids, self.families = refs["ref_id"].combine_chunks(), refs["ref_family_id_min"].combine_chunks()
        self.family = pc.fill_null(self.families.dictionary_encode(null_encoding="encode").indices, -1).to_numpy(zero_copy_only=False)
        self.owner, self.weight = pc.index_in(t["ref_id"], self.ids).to_numpy(), t["w"].to_numpy()

    def _code(self, words: pa.Array) -> np.ndarray:
        if self.stemmed:
            words = pa.array([_stem(w) if len(w) > 1 and w not in _STOPPED else None for w in words.to_pylist()], pa.string())
        return pc.fill_null(pc.index_in(words, self.terms, skip_nulls=True), -1).to_numpy(zero_copy_only=False)

    def search(self, lists: pa.ListArray, by_family: bool) -> pa.ListArray:
        """The best references of each list of words with a positive score, or each family's best among these, best first."""
        words, n, r = lists.flatten().dictionary_encode(), len(lists), len(self.ids)
        code = self._code(words.dictionary)[words.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, int)
        row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
        key, tf = np.unique(row[code >= 0] * max(1, len(self.terms)) + code[code >= 0], return_counts=True)
        row, code = np.divmod(key, max(1, len(self.terms)))
        size, ends = self.starts[code + 1] - self.starts[code], np.searchsorted(row, np.arange(n + 1))
        step, found = max(1, min(n, (1 << 21) // max(1, r))), []
        for a in range(0, n if r else 0, step):
            scores = np.zeros((min(step, n - a), r))
            for i, own in enumerate(scores, a):
                at, m = slice(ends[i], ends[i + 1]), size[ends[i] : ends[i + 1]]
                post = np.repeat(self.starts[code[at]] - (np.cumsum(m) - m), m) + np.arange(m.sum())
                own += np.bincount(self.owner[post], self.weight[post] * np.repeat(tf[at], m), r)
            scores = np.round(scores, DIGITS)
            place = np.argsort(-scores, axis=1, kind="stable")[:, : self.top]
            value = np.take_along_axis(scores, place, 1).ravel()
            q, col, value = (x[value > 0] for x in (np.repeat(np.arange(len(scores)), place.shape[1]), place.ravel(), value))
            if by_family:
                first = np.sort(np.unique(q * (r + 1) + self.family[col], return_index=True)[1])
                q, col, value = q[first], col[first], value[first]
            found.append((q + a, col, value))
        q, col, value = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        entries = pa.StructArray.from_arrays([pa.array(-value), self.ids.take(pa.array(col)), self.families.take(pa.array(col)), pa.array(value)], names=["down", "doc", "family", "v"])
        return pa.ListArray.from_arrays(pa.array(np.searchsorted(q, np.arange(n + 1)).astype(np.int32)), entries)


def bm25_found(refs: DataFrame, queries: DataFrame, k1: float = 1.5, b: float = 0.75, top: int = 200, stemmed: bool = False) -> list[DataFrame]:
    """The columns of queries but the text, and d, an array of (down, doc, family, v): each query's ``top`` references with a
    positive score v, down its negative, by (down, doc). refs: ref_id, ref_family_id, text; queries: text and further columns.

    Workers hold the references' postings and queries pass by, with no shuffle and no join on terms. If there are more than
    ``INDEX_ENTRIES`` postings, references are dealt into parts by a hash, with a frame for each of them. If one holds all, it
    holds only each family's best entry among the ``top``. Repeated query terms count each time.
    """
    weights = bm25_weights(refs.select("ref_id", "text"), k1, b, stemmed).join(refs.select("ref_id", "ref_family_id"), "ref_id")
    held = Stored(weights.select("ref_id", "ref_family_id", "term", "w"), "bm25-references").df
    parts = max(1, -(-held.count() // INDEX_ENTRIES))
    kept = [c for c in queries.columns if c != "text"]
    types = {c: refs.schema[c].dataType.simpleString() for c in ("ref_id", "ref_family_id")}
    schema = ", ".join(f"`{c}` {queries.schema[c].dataType.simpleString()}" for c in kept) + f", d array<struct<down:double,doc:{types['ref_id']},family:{types['ref_family_id']},v:double>>"

    def one(part: DataFrame) -> DataFrame:
        sent = queries.sparkSession.sparkContext.broadcast(part.toArrow())

        def run(batches):
            index = _Index(sent.value, top, stemmed)
            for batch in batches:
                for a in range(0, len(batch), 1024):
                    own = batch.slice(a, 1024)
                    yield pa.RecordBatch.from_arrays([*own.columns[:-1], index.search(own.column(len(kept)), parts == 1)], names=[*kept, "d"])

        return queries.select(*kept, _words().alias("words")).mapInArrow(run, schema)

    return [one(held.where(F.pmod(F.xxhash64("ref_id"), F.lit(parts)) == i)) for i in range(parts)]


def _scored(found: DataFrame) -> DataFrame:
    return found.select(F.col("query_id").alias("query_doc_id"), F.col("ref_id").alias("ref_doc_id"), "ref_family_id", "score")


def bm25_votes(refs: DataFrame, queries: DataFrame, scope: str = "doc", keyphrases: DataFrame | None = None, k1: float = 1.5, b: float = 0.75, top: int = 200) -> DataFrame:
    """Votes of docs (doc_id, family_id, text). Confidence is the raw score of the best family.

    scope doc indexes whole texts; keyword indexes each family's gold keyphrases (family_id, keyphrases; families without
    them get an empty text) and stems both sides.
    """
    r = refs.select(F.col("doc_id").alias("ref_id"), F.col("family_id").alias("ref_family_id"), "text")
    if scope == "keyword":
        if keyphrases is None:
            raise ValueError("scope keyword needs keyphrases by family")
        r = r.join(keyphrases.select(F.col("family_id").alias("ref_family_id"), "keyphrases"), "ref_family_id", "left").withColumn("text", F.coalesce("keyphrases", F.lit(""))).drop("keyphrases")
    elif scope != "doc":
        raise ValueError(scope)
    chunks = F.col("n_chunks").cast("int") if "n_chunks" in queries.columns else F.lit(1)
    q = queries.select(F.col("doc_id").alias("query_doc_id"), F.col("family_id").alias("query_family_id"), chunks.alias("n_chunks"), "text")
    parts = bm25_found(r, q, k1, b, top, scope == "keyword")
    if len(parts) == 1:
        return votes_of_families(parts[0], "document", unmatched=1)
    entries = reduce(DataFrame.unionByName, (p.select("query_doc_id", F.explode("d").alias("e")) for p in parts))
    best = W.partitionBy("query_doc_id").orderBy("e.down", "e.doc")
    found = entries.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)
    return family_votes(found.select("query_doc_id", F.col("e.doc").alias("ref_doc_id"), F.col("e.family").alias("ref_family_id"), F.col("e.v").alias("score")), queries, "document", unmatched=1)


def keyphrases_by_family(docs: DataFrame) -> DataFrame:
    """family_id, keyphrases from the ``keywords`` of meta_json, semicolons as blanks; none at all is an error."""
    words = F.coalesce(F.get_json_object("meta_json", "$.keywords"), F.lit(""))
    out = docs.groupBy("family_id").agg(F.max(F.replace(words, F.lit(";"), F.lit(" "))).alias("keyphrases"))
    if out.where("keyphrases <> ''").isEmpty():
        raise ValueError("no keyphrases in meta_json")
    return out


def minhash_signatures(df: DataFrame, slots: int = 128, k: int = 5) -> DataFrame:
    """id, sig of rows with a word: minima of (a * x + b) mod a prime over the shingles' hashes, a and b by rule from the
    slot. One row in, one row out, no shuffle; x is below 2**28, so products stay below 2**63."""
    a, b = np.arange(1, slots + 1) * 40503 + 12345, np.arange(1, slots + 1) * 7919

    def sign(batches):
        for batch in batches:
            x = batch.column(1).flatten().to_numpy(zero_copy_only=False)
            starts = batch.column(1).offsets.to_numpy()[:-1] - batch.column(1).offsets[0].as_py()
            sigs = [np.minimum.reduceat((x * m + n) % PRIME, starts) for m, n in zip(a, b)] if len(batch) else []
            flat = pa.array(np.stack(sigs, axis=1).ravel() if sigs else np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(batch) + 1, dtype=np.int32) * slots), flat)], names=["id", "sig"])

    hashed = df.select("id", F.transform(shingles(F.col("text"), k), hash28).alias("x")).where(F.size("x") > 0)
    return hashed.mapInArrow(sign, f"id {df.schema['id'].dataType.simpleString()}, sig array<bigint>")


def lsh_shape(threshold: float, slots: int) -> tuple[int, int]:
    """(bands, rows) whose candidates fit the threshold best: the least sum of false positive and false negative areas."""
    grid = np.linspace(0, 1, 2001)

    def cost(bands: int, rows: int) -> float:
        p = 1 - (1 - grid**rows) ** bands
        return float((p * (grid < threshold)).mean() + ((1 - p) * (grid >= threshold)).mean())

    return min(((b, r) for b in range(1, slots + 1) for r in range(1, slots // b + 1)), key=lambda s: cost(*s))


def band_candidates(queries: DataFrame, refs: DataFrame, bands: int, rows: int) -> DataFrame:
    """(query_id, ref_id) that share a band of ``rows`` slots, of the first ``bands`` bands."""

    def cut(df: DataFrame, name: str) -> DataFrame:
        keys = F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda i: F.xxhash64(i, F.slice("sig", i * rows + 1, rows)))
        return df.select(F.col("id").alias(name), F.posexplode(keys).alias("band", "key"))

    return cut(queries, "query_id").join(cut(refs, "ref_id"), ["band", "key"]).select("query_id", "ref_id").distinct()


def equal_slots(pairs: DataFrame, queries: DataFrame, refs: DataFrame) -> DataFrame:
    """Pairs with the Jaccard similarity that their signatures estimate."""
    q, r = (df.select(F.col("id").alias(f"{side}_id"), F.col("sig").alias(side)) for df, side in ((queries, "query"), (refs, "ref")))
    both = pairs.join(q, "query_id").join(r, "ref_id")
    same = F.size(F.filter(F.zip_with("query", "ref", lambda a, b: a == b), lambda x: x))
    return both.select("query_id", "ref_id", (same / F.size("query")).alias("score"))


def minhash_lsh_votes(refs: DataFrame, queries: DataFrame, slots: int = 128, threshold: float = 0.2, k: int = 5) -> DataFrame:
    """Votes by estimated Jaccard similarity of k-word shingles among band candidates; no candidate: 0 votes."""
    sign = lambda df: minhash_signatures(df.select(F.col("doc_id").alias("id"), strip(F.col("text")).alias("text")), slots, k)
    q, r = sign(queries), sign(refs)
    scored = equal_slots(band_candidates(q, r, *lsh_shape(threshold, slots)), q, r).where("score > 0")
    families = refs.select(F.col("doc_id").alias("ref_id"), F.col("family_id").alias("ref_family_id"))
    return family_votes(_scored(scored.join(families, "ref_id")), queries, "family")


@F.pandas_udf(StringType())
def fuzzy_digest(text: pd.Series) -> pd.Series:
    return text.map(fuzzy_hash.digest)


@F.pandas_udf(ArrayType(StringType()))
def fuzzy_keys(digests: pd.Series) -> pd.Series:
    return digests.map(fuzzy_hash.keys)


@F.pandas_udf(IntegerType())
def fuzzy_score(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([fuzzy_hash.compare(x, y) for x, y in zip(a, b)])


def fuzzy_hash_scores(refs: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, ref_id, score (1 to 100) of all pairs of (id, text) that score: they share a block size and seven characters,
    or the whole pieces, so a join on those keys loses none. Equal digests of a side are compared once."""

    def digests(df: DataFrame, name: str) -> DataFrame:
        text = strip(F.col("text"))
        return df.select(F.col("id").alias(f"{name}_id"), F.when(text != "", text).alias("text")).where("text IS NOT NULL").select(f"{name}_id", fuzzy_digest("text").alias(name))

    q, r = digests(queries, "query"), digests(refs, "ref")
    keyed = lambda df, name: df.select(name).distinct().select(name, F.explode(fuzzy_keys(name)).alias("key"))
    pairs = keyed(q, "query").join(keyed(r, "ref"), "key").select("query", "ref").distinct()
    scored = pairs.withColumn("score", fuzzy_score("query", "ref")).where("score > 0")
    return scored.join(q, "query").join(r, "ref").select("query_id", "ref_id", "score")


def fuzzy_hash_votes(refs: DataFrame, queries: DataFrame) -> DataFrame:
    """Votes by fuzzy hash; confidence is the score over 100."""
    by_id = lambda df: df.select(F.col("doc_id").alias("id"), "text")
    families = refs.select(F.col("doc_id").alias("ref_id"), F.col("family_id").alias("ref_family_id"))
    return family_votes(_scored(fuzzy_hash_scores(by_id(refs), by_id(queries)).join(families, "ref_id")), queries, "document", unmatched=1, digits=0, scale=100.0)


def pairwise_lexical(originals: DataFrame, variants: DataFrame) -> DataFrame:
    """doc_id, source_doc_id, family_id, variant_type, variant_level and six metrics of each variant against its original;
    variants without one are left out. doc_id is unique."""
    o = originals.select(F.col("doc_id").alias("source_doc_id"), quality_tokens(F.col("text")).alias("r"))
    keys = ("doc_id", "source_doc_id", "family_id", "variant_type", "variant_level")
    pairs = variants.select(*keys, quality_tokens(F.col("text")).alias("h")).join(o, "source_doc_id")
    r, h = F.col("r"), F.col("h")
    metrics = [ngram_overlap(r, h, n).alias(f"ngram_overlap_{n}") for n in (1, 2, 3)]
    out = pairs.select(*keys, *metrics, norm_edit_distance(r, h).alias("norm_edit_distance"), jaccard(r, h).alias("jaccard_tokens"))
    return out.join(self_bleu(pairs.select("doc_id", "r", "h"), "doc_id"), "doc_id").select(*keys, *[f"ngram_overlap_{n}" for n in (1, 2, 3)], "self_bleu", "norm_edit_distance", "jaccard_tokens")


def self_bleu(pairs: DataFrame, *key: str, most: int = 4) -> DataFrame:
    """key, self_bleu of the tokens ``h`` against ``r``: clipped counts plus one, up to ``most``-grams, brevity penalty. The key is unique."""
    count = lambda c, n, of_h: F.transform(ngrams(F.col(c), n), lambda g: F.struct(F.lit(n).alias("n"), g.alias("g"), F.lit(of_h).alias("h"), F.lit(1 - of_h).alias("r")))
    every = F.concat(*[count(c, n, of_h) for c, of_h in (("h", 1), ("r", 0)) for n in range(1, most + 1)])
    grams = pairs.select(*key, F.inline(every)).groupBy(*key, "n", "g").agg(F.sum("h").alias("h"), F.sum("r").alias("r"))
    per = grams.groupBy(*key, "n").agg(F.sum(F.least("h", "r")).alias("both"), F.sum("h").alias("all")).where("all > 0")
    mean = per.groupBy(*key).agg(F.exp(F.avg(F.ln((F.col("both") + 1) / (F.col("all") + 1)))).alias("mean"))
    nr, nh = F.size("r"), F.size("h")
    brevity = F.when(nh == 0, 0.0).when(nh >= nr, 1.0).otherwise(F.exp(1 - F.try_divide(nr, nh)))
    return pairs.select(*key, brevity.alias("brevity")).join(mean, list(key), "left").select(*key, (F.col("brevity") * F.coalesce("mean", F.lit(0.0))).alias("self_bleu"))
