"""Near-duplicate classes by b-bit MinHash.

1. One pass over the texts gives each document's set of word shingles as 64-bit hashes, a 128-bit fingerprint of the
   set, ``bands * rows`` minima, a key for each band of minima, and the low ``bits`` bits of all minima packed as
   bit planes.
2. Documents with one and the same set form a class at once; only one member of each goes on.
3. Members of a band's bucket are compared with the bucket's hub: first the member that meets most others over all
   bands, then, in buckets still open, members drawn at random for each bucket. Each round is linear in the bucket
   and joins groups around one text or with dense links. Pairs whose collision-corrected similarity,
   estimated by counting equal bits of the planes, is too far below the threshold are left out; the others are
   confirmed on full sets.
4. What remains of a bucket, members in different components, is compared in blocks: those outside the largest
   component against all, BLOCK by BLOCK members for each key of the join. Semi-joins on signatures leave the members
   that have any partner, and these are confirmed on full sets inside a join that gives links only. No bucket or
   partner is capped, and no key of a join holds more than a block of either side.
5. Confirmed links are joined to components by star contraction.

A pair at the threshold shares some band with probability 1 - (1 - t^rows)^bands; for 0.85, 6 and 24 that is
0.99999. The estimate's margin is five standard errors.

Defined results: null or blank texts have an empty set and link with nothing; repeated rows link with each other; an
empty table gives an empty result; other columns are ignored; null ids rank above none (the least id not null is the
class id).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import Stored, pick, settled
from sievelake.operators.components import connected_components

BANDS, ROWS, BITS = 24, 6, 4
#: Rounds of comparison with hubs before the rest of the buckets is joined: the best connected member, then members
#: drawn anew in every bucket, which join densely linked groups by a few comparisons a member.
HUB_ROUNDS = 3
#: Members of a bucket that one key of a join holds; larger buckets, and hubs with more partners, are dealt in parts.
BLOCK = 256
#: Members of buckets whose ids may be sent to every task (8 bytes each); beyond it the texts are joined by shuffle.
BROADCAST_ROWS = 1_000_000

_M1, _M2, _M3 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _M3
    x = (x ^ (x >> np.uint64(29))) * _M1
    return x ^ (x >> np.uint64(32))


class _WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingle_hashes(text: str, k: int, cache: _WordHash) -> np.ndarray:
    """The distinct k-word shingles of a text, sorted, as hashes; with fewer words the whole sequence is one."""
    words = text.encode().lower().split()  # bytes: A-Z only, ASCII white space only
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(cache.__getitem__, words), np.uint64, len(words))
    width = min(k, len(h))
    acc = np.full(len(h) - width + 1, width, np.uint64)
    for i in range(width):
        acc = _mix(acc * _M2 + h[i : len(h) - width + 1 + i])
    return np.unique(acc)


class MinHasher:
    def __init__(self, bands: int, rows: int, bits: int, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.bits, self.k = bands, rows, bits, bands * rows
        self.a = rng.integers(0, 1 << 63, self.k, np.uint64) * np.uint64(2) + np.uint64(1)
        self.b = rng.integers(0, 1 << 63, self.k, np.uint64)
        self.longs = -(-self.k // 64)

    def minima(self, shingles: np.ndarray) -> np.ndarray:
        out = np.full(self.k, 0xFFFFFFFF, np.uint64)
        for i in range(0, len(shingles), 512):
            part = shingles[i : i + 512]
            out = np.minimum(out, ((self.a[:, None] * part[None, :] + self.b[:, None]) >> np.uint64(32)).min(axis=1))
        return out

    def keys(self, minima: np.ndarray) -> np.ndarray:
        rows = minima.reshape(self.bands, self.rows)
        acc = np.arange(self.bands, dtype=np.uint64)
        for j in range(self.rows):
            acc = _mix(acc * _M2 + rows[:, j])
        return acc.view(np.int64)

    def planes(self, minima: np.ndarray) -> np.ndarray:
        """bits x longs: plane j holds bit j of every minimum."""
        low = (_mix(minima)[None, :] >> np.arange(self.bits, dtype=np.uint64)[:, None]) & np.uint64(1)
        padded = np.zeros((self.bits, self.longs * 64), np.uint8)
        padded[:, : self.k] = low
        return np.packbits(padded, axis=1, bitorder="little").view(np.int64).reshape(-1)


def differing_slots(a: Column, b: Column, bits: int, longs: int) -> Column:
    """Slots whose retained bits differ: per 64 slots, the bit count of the OR over planes of XOR."""
    words = []
    for w in range(longs):
        xors = [F.get(a, F.lit(j * longs + w)).bitwiseXOR(F.get(b, F.lit(j * longs + w))) for j in range(bits)]
        words.append(F.bit_count(reduce(lambda x, y: x.bitwiseOR(y), xors)))
    return reduce(lambda x, y: x + y, words)


def most_differing(threshold: float, k: int, bits: int, deviations: float = 5.0) -> int:
    """Slots that may differ for the corrected estimate (m - c) / (1 - c), c = 2^-bits, to be within reach of the threshold."""
    c = 2.0**-bits
    match = c + (1 - c) * threshold
    return math.ceil(k * (1 - match) + deviations * math.sqrt(k * match * (1 - match)))


def _spread_join(rows: DataFrame, pairs: DataFrame, key: str, by: str, table: DataFrame) -> DataFrame:
    """rows joined with table on ``key``. Keys that ``pairs`` has more than BLOCK times are dealt by a hash of ``by`` and their
    rows of ``table`` repeated for each share, so a popular key isn't one task's work."""
    heavy = pairs.groupBy(key).agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("shares")).where("shares > 1")
    heavy = Stored(heavy, "popular").df
    if heavy.count() <= BROADCAST_ROWS:
        heavy = F.broadcast(heavy)
    shares = F.coalesce("shares", F.lit(1))
    dealt = rows.join(heavy, key, "left").withColumn("share", F.pmod(F.xxhash64(by), shares).cast("int")).drop("shares")
    repeated = table.join(heavy, key, "left").withColumn("share", F.explode(F.sequence(F.lit(0), shares - 1))).drop("shares")
    return dealt.join(repeated, [key, "share"]).drop("share")


def near_duplicate_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS, bits: int = BITS) -> DataFrame:
    """rid, doc_id, n_shingles, component_id for every row. Linked: 100 * intersection >= percent * union of the shingle sets."""
    docs = pick(settled(df), doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    hasher = MinHasher(bands, rows, bits)
    id_type = docs.schema["doc_id"].dataType.simpleString()

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        longs = pa.list_(pa.int64())
        for batch in batches:
            cache, out = _WordHash(), []
            for text in batch.column(2):
                s = shingle_hashes(text.as_py() or "", shingle, cache)
                if len(s) == 0:
                    out.append((0, 0, 0, None, None))
                    continue
                f = xxhash.xxh3_128_intdigest(s.tobytes())
                m = hasher.minima(s)
                out.append((len(s), (f >> 64) - (1 << 63), (f & (1 << 64) - 1) - (1 << 63), hasher.planes(m), hasher.keys(m)))
            n, hi, lo, sig, keys = zip(*out) if out else ((),) * 5
            arrays = [batch.column(0), batch.column(1), pa.array(n, pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(sig, longs), pa.array(keys, longs)]
            yield pa.RecordBatch.from_arrays(arrays, names=["rid", "doc_id", "n", "hi", "lo", "sig", "keys"])

    signed = Stored(docs.mapInArrow(sign, f"rid bigint, doc_id {id_type}, n bigint, hi bigint, lo bigint, sig array<bigint>, keys array<bigint>"), "signatures").df
    full = signed.where("n > 0")
    classes = Stored(full.groupBy("n", "hi", "lo").agg(F.min("rid").alias("rep"), F.min("doc_id").alias("least")), "set-classes").df
    reps = full.join(classes.select(F.col("rep").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("rep"), "n", "sig", "keys")

    members = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    company = members.groupBy("band", "key").agg(F.count("*").alias("m")).where("m > 1")
    buckets = Stored(members.join(company, ["band", "key"]), "buckets").df
    meets = Stored(buckets.groupBy("rep").agg(F.sum("m").alias("meets")), "meets").df
    known = Stored(reps.join(meets, "rep").select("rep", "n", "sig", "keys", "meets"), "members").df

    # the full sets of documents that share any bucket
    wanted = known.select(F.col("rep").alias("rid"))
    wanted = F.broadcast(wanted) if wanted.count() <= BROADCAST_ROWS else wanted

    def full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cache = _WordHash()
            sets = [shingle_hashes(t.as_py() or "", shingle, cache).view(np.int64) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["rid", "s"])

    sets = Stored(docs.select("rid", "text").join(wanted, "rid", "left_semi").mapInArrow(full_sets, "rid bigint, s array<bigint>"), "shingle-sets").df

    limit = most_differing(percent / 100, bands * rows, bits)

    def near(a: str, b: str) -> Column:
        na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
        sizes = 100 * F.least(na, nb) >= percent * F.greatest(na, nb)
        return sizes & (differing_slots(F.col(f"{a}.sig"), F.col(f"{b}.sig"), bits, hasher.longs) <= limit)

    def confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = (v.values.to_numpy() for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= percent * (len(x) + len(y) - both))
            kept = batch.filter(pa.array(ok, pa.bool_()))
            yield pa.RecordBatch.from_arrays([kept.column(0), kept.column(1)], names=["src", "dst"])

    def links(pairs: DataFrame, label: str) -> DataFrame:
        """Confirmed (src, dst) of stored pairs; dst may be a hub."""
        with_sets = pairs.join(sets.select(F.col("rid").alias("src"), F.col("s").alias("s1")), "src")
        with_sets = _spread_join(with_sets, pairs, "dst", "src", sets.select(F.col("rid").alias("dst"), F.col("s").alias("s2")))
        return Stored(with_sets.select("src", "dst", "s1", "s2").mapInArrow(confirm, "src bigint, dst bigint"), label).df

    def placed(found: DataFrame | None) -> DataFrame:
        """Rows of buckets with members in more than one component so far."""
        if found is None:
            return buckets.select("band", "key", "rep", F.col("rep").alias("component"))
        comps = connected_components(found).select(F.col("node").alias("rep"), "component")
        now = buckets.select("band", "key", "rep").join(comps, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
        now = Stored(now, "placed").df
        mixed = now.groupBy("band", "key").agg(F.min("component").alias("c1"), F.max("component").alias("c2")).where("c1 < c2").select("band", "key")
        return Stored(now.join(mixed, ["band", "key"]), "open-buckets").df

    found = None
    rest = placed(None)
    for turn in range(HUB_ROUNDS):
        rank = F.col("meets") if turn == 0 else F.xxhash64(F.lit(turn), "band", "rep")
        ranked = rest.join(known.select("rep", "meets"), "rep").groupBy("band", "key").agg(F.max(F.struct(rank.alias("x"), (-F.col("rep")).alias("r"), F.col("component").alias("hub_component"))).alias("h"))
        hubs = ranked.select("band", "key", (-F.col("h.r")).alias("hub"), "h.hub_component")
        tried = rest.join(hubs, ["band", "key"]).where("component != hub_component").select("rep", "hub").distinct()
        tried = Stored(tried, "tried").df
        mine = known.select("rep", F.struct("n", "sig").alias("a"))
        theirs = known.select(F.col("rep").alias("hub"), F.struct("n", "sig").alias("b"))
        met = _spread_join(tried.join(mine, "rep"), tried, "hub", "rep", theirs)
        passed = Stored(met.where(near("a", "b")).select(F.col("rep").alias("src"), F.col("hub").alias("dst")), "passed").df
        confirmed = links(passed, "hub-links")
        found = confirmed if found is None else found.unionByName(confirmed)
        rest = placed(found)

    # what is left, in blocks: members outside a bucket's largest component against all of it, BLOCK by BLOCK members a key
    sizes = rest.groupBy("band", "key", "component").agg(F.count("*").alias("c")).groupBy("band", "key").agg(F.sum("c").alias("m"), F.max_by("component", "c").alias("largest"), F.max("c").alias("c"))
    sizes = sizes.select("band", "key", "largest", F.ceil(F.col("m") / BLOCK).cast("int").alias("all_parts"), F.ceil((F.col("m") - F.col("c")) / BLOCK).cast("int").alias("own_parts"))
    placed_rows = Stored(rest.join(sizes, ["band", "key"]).join(known.select("rep", "n", "sig"), "rep"), "rest-rows").df
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    part = lambda n: F.pmod(F.xxhash64("rep"), F.col(n)).cast("int")
    left = placed_rows.where("component != largest").withColumn("i", part("own_parts")).withColumn("j", each("all_parts"))
    right = placed_rows.withColumn("j", part("all_parts")).withColumn("i", each("own_parts"))
    meet = ["band", "key", "i", "j"]
    left, right = (d.select(*meet, "rep", "component", "largest", "n", "sig") for d in (left, right))
    a, b = left.alias("a"), right.alias("b")
    same = reduce(lambda x, y: x & y, [F.col(f"a.{c}") == F.col(f"b.{c}") for c in meet])
    other = (F.col("a.component") != F.col("b.component")) & ((F.col("b.component") == F.col("b.largest")) | (F.col("a.rep") < F.col("b.rep")))
    # on signatures alone, and as semi-joins: rows that have any partner left, never pairs
    sides = [Stored(x.join(y, same & other & near("a", "b"), "left_semi"), "rest-near").df for x, y in ((a, b), (b, a))]
    a, b = (d.join(sets.select(F.col("rid").alias("rep"), "s"), "rep").alias(n) for d, n in zip(sides, "ab"))
    both = F.size(F.array_intersect(F.col("a.s"), F.col("b.s")))
    linked = F.when(other & near("a", "b"), 100 * both >= percent * (F.col("a.n") + F.col("b.n") - both)).otherwise(False)
    second = Stored(a.join(b, same & linked).select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst")).distinct(), "rest-links").df
    first = found

    parts = Stored(connected_components(first.unionByName(second)).select(F.col("node").alias("rep"), "component"), "components").df
    heads = classes.join(parts, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    least = heads.groupBy("component").agg(F.min("least").alias("component_id"))
    named = Stored(heads.join(least, "component").select("n", "hi", "lo", "component", "component_id"), "named-classes").df
    out = full.select("rid", "doc_id", "n", "hi", "lo").join(named, ["n", "hi", "lo"])
    linked = out.select("rid", "doc_id", F.col("n").alias("n_shingles"), "component_id", "component")
    alone = signed.where("n = 0").select("rid", "doc_id", F.lit(0).cast("bigint").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.col("rid").alias("component"))
    return linked.unionByName(alone)


def drop_near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The input's rows and columns, one row of each class: the one with the least id, of equal ids the first as read."""
    rid = "__near_dedup_rid"
    df = settled(df)
    found = Stored(near_duplicate_classes(df, id_col, text_col, **options), "near-classes").df
    keep = found.groupBy("component", F.col("n_shingles") == 0).agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "rid")).alias("k")).select(F.col("k.rid").alias(rid))
    return df.withColumn(rid, F.monotonically_increasing_id()).join(keep, rid, "left_semi").drop(rid)
