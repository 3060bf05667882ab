"""The mix against plain Python: targets by filling up, documents end to end, blocks by the golden-ratio schedule."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from sievelake.llm import mixing

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, rid bigint, size string, block int, `a.b` int"


def last_null(sources):
    return sorted(sources, key=lambda s: (s is None, s))


def plain_targets(sizes, weights=(1, 2, 3), most=3):
    """Each source's weight of all words; what exceeds ``most`` times a source is shared again until nothing does."""
    names = last_null(sizes)
    weight = {s: float(weights[i % len(weights)]) for i, s in enumerate(names)}
    target, left, free = {}, float(sum(sizes.values())), set(names)
    while free:
        share = {s: left * weight[s] / sum(weight[x] for x in free) for s in free}
        full = {s for s in free if share[s] > most * sizes[s]}
        if not full:
            return target | share
        for s in full:
            target[s] = float(most * sizes[s])
            left -= target[s]
        free -= full
    return target


def plain_mix(rows, hashes, block_words=128, min_blocks=64, most=3):
    """rows: [(rid, source, words)]; hashes: rid -> seeded hash. -> (targets, {rid: taken})."""
    sizes = Counter()
    for _, s, n in rows:
        sizes[s] += n
    targets = plain_targets(sizes)
    names = last_null(sizes)
    blocks = {s: max(-(-sizes[s] // block_words), min(sizes[s], min_blocks)) for s in names}
    quota = {s: min(round_half_up(targets[s] * blocks[s] / sizes[s]), blocks[s] * most) if sizes[s] else 0 for s in names}
    slots = sum(quota.values())
    edges, at = [], 0
    for s in names:
        edges.append((at, at + quota[s], s))
        at += quota[s]
    uses, rank = defaultdict(Counter), Counter()

    def use(s):
        uses[s][rank[s] % blocks[s]] += 1
        rank[s] += 1

    for k in range(slots):
        turn = k // mixing.RUN * mixing.PHI_RUN + k % mixing.RUN * mixing.PHI
        t = min(int((turn - math.floor(turn)) * slots), slots - 1)
        s = next(s for lo, hi, s in edges if lo <= t < hi)
        if rank[s] < quota[s]:
            use(s)
    for s in names:
        while rank[s] < quota[s]:
            use(s)
    buckets = max(mixing.LEAST_BUCKETS, -(-len(rows) // mixing.RANKED_TOGETHER) * 4)
    taken = Counter()
    for s in names:
        begin = 0
        for rid, _, n in sorted((r for r in rows if r[1] == s), key=lambda r: (hashes[r[0]] % buckets, hashes[r[0]], r[0])):
            for b in range(blocks[s]):
                lo, hi = b * sizes[s] // blocks[s], (b + 1) * sizes[s] // blocks[s]
                taken[rid] += max(0, min(hi, begin + n) - max(lo, begin)) * uses[s][b]
            begin += n
    return targets, taken


def round_half_up(x):
    return math.floor(x + 0.5)


def hashes_of(spark, rids):
    df = spark.createDataFrame([(r,) for r in rids], "rid bigint").withColumn("at", F.xxhash64(F.lit(11), "rid"))
    return {r.rid: r["at"] for r in df.collect()}


def check(spark, df):
    got = mixing.mix_sources(df).collect()
    rows = [(r.rid, r.source, r["size"]) for r in got]
    targets, taken = plain_mix(rows, hashes_of(spark, [r.rid for r in got]))
    assert all(r.taken == taken[r.rid] and abs(r.target - targets[r.source]) < 1e-6 * max(1, r.target) for r in got)
    assert all(r.taken <= 3 * r["size"] for r in got)
    return got


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(4)
    rows = [(i, " ".join("w" * rng.randint(1, 5) for _ in range(rng.randint(0, 400))) + rng.choice(["", " \n\tend"]), rng.choice(["a", "a", "a", "b", "c", None]), 7, "x", 1, 1) for i in range(150)]
    rows += [(200, None, "b", 7, "x", 1, 1), (201, "", "empty", 7, "x", 1, 1), (202, "one", "tiny", 7, "x", 1, 1), (3, rows[3][1], rows[3][2], 7, "x", 1, 1)]
    return spark.createDataFrame(rows, SCHEMA)


def test_against_plain(spark, docs):
    got = check(spark, docs)
    assert len(got) == 154 and Counter(r.doc_id for r in got)[3] == 2
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert all(r["size"] == len(WORD.findall(texts[r.doc_id] or "")) for r in got)


def test_documents_against_plain(spark):
    check(spark, spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))


def test_mixed_rows_keep_their_white_space(spark, docs):
    taken = {r.rid: r for r in mixing.mix_sources(docs).collect()}
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    originals = [r.text for r in docs.collect() if r.text]
    rows = mixed.collect()
    assert sum(len(WORD.findall(r.text or "")) for r in rows) == sum(r.taken for r in taken.values())
    for r in rows:
        assert any(o == r.text or o.startswith(r.text) and o[len(r.text) :][:1].isspace() for o in originals)


def test_rows_in_any_partitions(docs):
    """Inputs that aren't plain scans are settled first, so documents keep their own words."""
    rows = mixing.mixed_documents(docs.repartition(5)).collect()
    own = {r.doc_id: r.text for r in docs.collect()}
    assert rows and all((own[r.doc_id] or "").startswith(r.text) for r in rows)


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix_sources(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
