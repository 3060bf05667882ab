"""Katz back-off of order 3 against dictionaries, with and without words too frequent for one part."""

import math
from collections import Counter

import numpy as np
import pytest

from sievelake.llm.katz import GT_MOST, Unigrams, good_turing, score_katz


def plain_katz(data, is_train):
    """(doc_id, n_tokens, n_known, train_tokens, base, score), all histories checked to add up to one."""
    seqs = [(i, ["<s>", *(t or "").encode().lower().split(), "</s>"]) for i, t in data]
    learned = [s for i, s in seqs if i is not None and is_train(i)]
    one = Counter(w for s in learned for w in s[1:])
    two, three = (Counter(p for s in learned for p in zip(*(s[k:] for k in range(n)))) for n in (2, 3))
    n, v = sum(one.values()), len(one)
    uni = Unigrams.of({0: v, -1: n, **Counter(one.values())})
    p1 = lambda g: float(uni.p(np.array([one[g[0]]]))[0])
    if n:
        assert abs(sum(p1((w,)) for w in one) + uni.unknown - 1) < 1e-9 and uni.unknown > 0

    def model(counts, low):
        d = good_turing(Counter(counts.values()))
        by: dict = {}
        for g, c in counts.items():
            by.setdefault(g[:-1], {})[g[-1]] = c
        p, alpha = {}, {}
        for h, own in by.items():
            value = {w: (d[c] if c <= GT_MOST else 1) * c for w, c in own.items()}
            count, lo = sum(own.values()), sum(low((*h[1:], w)) for w in own)
            scale = min(1, (count - 0.5) / sum(value.values()))
            alpha[h] = (1 - sum(value.values()) * scale / count) / (1 - lo)
            p |= {(*h, w): x * scale / count for w, x in value.items()}
            assert alpha[h] > 0 and abs(sum(p[*h, w] for w in own) + alpha[h] * (1 - lo) - 1) < 1e-9
        return lambda g: p[g] if g in p else alpha.get(g[:-1], 1.0) * low(g[1:])

    p2 = model(two, p1)
    p3 = model(three, p2)
    for i, s in seqs:
        score = math.log10(p2((s[0], s[1]))) + sum(math.log10(p3(g)) for g in zip(s, s[1:], s[2:]))
        yield i, len(s) - 1, sum(one[w] > 0 for w in s[1:]), n, sum(math.log10((one[w] + 1) / (n + v + 1)) for w in s[1:]), score


def same(got, want):
    key = lambda r: (repr(r[0]), r[1], round(r[5], 3))
    assert len(got) == len(want)
    for g, w in zip(sorted(map(tuple, got), key=key), sorted(want, key=key)):
        assert g[:4] == w[:4] and abs(g[4] - w[4]) < 1e-5 and abs(g[5] - w[5]) < 1e-4, (g, w)


@pytest.mark.parametrize(("hot", "deal"), [(1 << 22, False), (60, False), (0, False), (60, True)])
def test_documents(spark, hot, deal):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("doc_id % 2 = 0")
    data = [(r.doc_id, r.text) for r in docs.collect()]
    df = docs.repartition(7) if deal else docs
    same(score_katz(df, "doc_id % 3 != 0", chunk_bytes=30_000, hot=hot).collect(), list(plain_katz(data, lambda i: i % 3)))


def test_odd_rows(spark):
    schema = "doc_id bigint, text string, train boolean, part int, chunk string, `a.b` int"
    rows = [(1, "A a a a a a a b", None, 1, "x", 1), (2, None, None, 1, "x", 1), (2, None, None, 1, "x", 1), (3, "", None, 1, "x", 1), (None, "a b", None, 1, "x", 1), (4, " a\tB c \n", None, 1, "x", 1), (5, "é É", None, 1, "x", 1)]
    df = spark.createDataFrame(rows, schema)
    for hot in (1 << 22, 0):
        same(score_katz(df, "doc_id < 4", hot=hot).collect(), list(plain_katz([r[:2] for r in rows], lambda i: i < 4)))
    assert score_katz(spark.createDataFrame([], schema), "doc_id < 4").collect() == []
    assert {(r.score, r.n_known, r.train_tokens) for r in score_katz(df, "doc_id > 9").collect()} == {(0.0, 0, 0)}


def test_string_ids(spark):
    got = score_katz(spark.createDataFrame([("x", "a b"), ("y", "a")], "name string, body string"), "name = 'x'", id_col="name", text_col="body").collect()
    assert {(r.doc_id, r.n_tokens, r.n_known) for r in got} == {("x", 3, 3), ("y", 2, 2)}
