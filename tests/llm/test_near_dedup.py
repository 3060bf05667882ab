"""Near-duplicate classes against all pairs, with blocks small enough that buckets and hubs are dealt in parts."""

import random
from collections import Counter

import pytest

from sievelake.llm import near_dedup


def plain_classes(data, shingle, percent):
    sets = []
    for i, t in data:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[j : j + shingle]) for j in range(max(1, len(w) - shingle + 1))) if w else frozenset()))
    parent = list(range(len(sets)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links = 0
    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)) and 100 * len(x & y) >= percent * len(x | y):
                links += 1
                parent[max(find(a), find(b))] = min(find(a), find(b))
    least: dict = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(least.get(find(k), i), i)
    return [(i, len(s), least[find(k)]) for k, (i, s) in enumerate(sets)], links


def check(spark, data, shingle, percent):
    df = spark.createDataFrame(data, "doc_id bigint, text string")
    got = Counter((r.doc_id, r.n_shingles, r.component_id) for r in near_dedup.near_duplicate_classes(df, shingle=shingle, percent=percent).collect())
    want, links = plain_classes(data, shingle, percent)
    assert got == Counter(want)
    return links


@pytest.mark.parametrize("broadcast", [10**6, 0])
def test_hot_groups_in_parts(spark, monkeypatch, broadcast):
    """Chains around one text: neighbours link, ends don't, and all share buckets."""
    rng = random.Random(8)
    vocabulary = [f"w{i}" for i in range(400)]
    base = [rng.choice(vocabulary) for _ in range(120)]
    data = []
    for i in range(90):
        text = list(base)
        for _ in range(rng.choice((1, 2, 3, 5, 8))):
            text[rng.randrange(len(text))] = rng.choice(vocabulary)
        data.append((i, " ".join(text)))
        base = text if i % 10 == 0 else base
    data += [(100 + i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60)))) for i in range(40)]
    data += [(200, data[3][1]), (201, data[3][1].upper()), (202, None), (203, " ")]
    monkeypatch.setattr(near_dedup, "BLOCK", 4)
    monkeypatch.setattr(near_dedup, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(near_dedup, "HUB_ROUNDS", 1)
    assert check(spark, data, 3, 85) > 20


def test_documents_against_all_pairs(spark):
    data = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    check(spark, data, 3, 85)
