"""Prepared sets, splits, query sets, methods, runs and reports over them; votes and evaluation against plain Python."""

import json
import math
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sievelake.operators import documents as D
from sievelake.operators import encoders as X
from sievelake.operators import evaluation as E
from sievelake.operators import lexical as L
from sievelake.operators import retrieval as R
from sievelake.operators import votes as V
from sievelake.plans import report
from sievelake.plans import runs as P
from sievelake.plans.config import ChunkSpec, EmbedSpec, RunConfig
from sievelake.sources import storage as S

DOC = "doc_id string, dataset string, family_id string, text string, source_doc_id string, variant_type string, meta_json string"


def article(seed, n=150):
    rng = random.Random(seed)
    return " ".join(rng.choice(f"topic{seed} note{seed} river stone house light water green under over the of and road hill bridge tower garden market winter summer".split()) + rng.choice(["", "", str(rng.randint(0, 50))]) for _ in range(n))


@pytest.fixture(scope="module")
def prepared(spark, tmp_path_factory):
    """20 families in two sets, originals and lightly edited variants."""
    root = str(tmp_path_factory.mktemp("run"))
    originals, variants = [], []
    for i in range(20):
        text = article(i)
        words = text.split()
        words[10:14] = ["quite", "other", "words", "here"]
        originals.append((f"semeval:p{i}:orig", "semeval", f"semeval:p{i}", text, None, "original", json.dumps({"keywords": f"topic{i};note{i}"})))
        variants.append((f"semeval:p{i}:v", "semeval", f"semeval:p{i}", " ".join(words), f"semeval:p{i}:orig", "eda", None))
    S.save_prepared_set(spark.createDataFrame(originals, DOC), f"{root}/prepared", "semeval_original")
    S.save_prepared_set(spark.createDataFrame(variants, DOC), f"{root}/prepared", "variants")
    return root


def config(root, **kw):
    return RunConfig("semeval", f"{root}/prepared", f"{root}/splits", f"{root}/artifacts", variant_sets=("variants",), **kw)


def test_prepared_sets(spark, prepared):
    d = f"{prepared}/prepared"
    assert S.list_prepared_sets(spark, d) == ["semeval_original", "variants"] and S.list_prepared_sets(spark, f"{prepared}/none") == []
    both = S.concat_prepared_sets(spark, d, ["variants", "semeval_original", "variants"])
    assert both.count() == 40 and both.columns[:4] == ["doc_id", "dataset", "family_id", "text"]
    with pytest.raises(ValueError):
        S.concat_prepared_sets(spark, d, [])
    with pytest.raises(FileNotFoundError):
        S.load_prepared_set(spark, d, "gone")
    with pytest.raises(ValueError, match="repeated doc_id"):
        D.normalize_docs(both.unionByName(both))
    with pytest.raises(ValueError, match="missing columns"):
        D.normalize_docs(both.drop("text"))


def test_normalize_meta(spark):
    row = spark.createDataFrame([("a", "d", "f", None)], "doc_id string, dataset string, family_id string, text string")
    got = D.normalize_docs(row.withColumn("meta_json", F.struct(F.lit(1).alias("x")))).first()
    assert (got.text, got.num_chars, got.num_words, got.meta_json, got.variant_type) == ("", 0, 0, '{"x":1}', "original")
    assert D.normalize_docs(row).first().meta_json == "{}"


def test_json_round_trip(spark, tmp_path):
    path = f"{tmp_path}/x/config.json"
    S.save_json(spark, {"é": [1, None], "spec": ChunkSpec(), "n": 1.5}, path)
    assert S.load_json(spark, path) == {"é": [1, None], "spec": "ChunkSpec(mode='word', size=50, overlap=0)", "n": 1.5}
    assert S.exists(spark, path) and S.size_mb(spark, path) > 0 and S.listing(spark, S.ensure_dir(spark, f"{tmp_path}/y")) == []


def test_split(spark, prepared):
    args = (spark, f"{prepared}/prepared", f"{prepared}/splits2", "semeval", "semeval_original")
    one = P.make_split(*args)
    assert P.split_summary(one).first().asDict() == {"dataset": "semeval", "seed": 42, "n_families": 20, "n_confidential": 10, "n_benign": 10}
    assert P.make_split(*args).collect() == one.collect()
    assert P.split_summary(P.make_split(*args, ratio=0.3)).first().n_confidential == 6
    shuffled = P.make_split(*args, shuffled=True)
    assert P.split_summary(shuffled).first().n_confidential == 10
    with pytest.raises(ValueError):
        P.make_split(*args, ratio=1.0)
    assert P.split_summary(one.limit(0)).first().asDict() == {"dataset": None, "seed": None, "n_families": 0, "n_confidential": 0, "n_benign": 0}


def test_query_sets(spark):
    docs = lambda rows: D.normalize_docs(spark.createDataFrame(rows, "doc_id string, dataset string, family_id string, text string"), check_unique=False)
    originals = docs([("a", "d", "A", "one"), ("b", "d", "B", "two"), ("x", "d", "X", "lost")])
    variants = docs([("a2", "d", "A", "v"), ("a", "d", "A", "same id"), ("b2", "d", "B", "w")])
    split = spark.createDataFrame([("A", "confidential"), ("B", "benign")], "family_id string, partition string")
    with pytest.warns(UserWarning, match="X"):
        sets = P.build_query_sets(originals, variants, split, include_original=True)
    ids = lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    assert (ids(sets.reference), ids(sets.positive), ids(sets.benign)) == ([("a", "one")], [("a", "same id"), ("a2", "v")], [("b", "two"), ("b2", "w")])
    with pytest.raises(ValueError, match="X"):
        P.build_query_sets(originals, variants, split, strict=True)
    with pytest.warns(UserWarning):
        assert P.build_query_sets(originals, None, split).positive.count() == 0


def stats(values):
    total = sum(values)
    p = [v / total for v in values] if total > 0 else list(values)
    pos = [x for x in p if x > 0]
    mean = sum(p) / len(p) if p else 0
    return (0.0 if len(pos) <= 1 else -sum(x * math.log(x) for x in pos) / math.log(len(pos)), sum((x - mean) ** 2 for x in p) / len(p) if p else 0.0, 1 - sum(x * x for x in p))


@pytest.mark.parametrize("how", ["count", "weight", "maxsim"])
def test_votes(spark, how):
    rng = random.Random(7)
    rows = [(f"q{i % 5}", f"F{i % 5}", f"q{i % 5}::c{i}", r := f"r{rng.randint(0, 4)}", f"fam-{r}", rng.choice([-0.5, 0.25, 0.5, 1.0]), k) for i in range(30) for k in (1, 2)]
    rows += [("neg", "F", "neg::c0", "r1", "fam-r1", -0.5, 1), ("neg", "F", "neg::c0", "r2", "fam-r2", -0.25, 2)]
    df = spark.createDataFrame(rows, "query_doc_id string, query_family_id string, query_chunk_id string, ref_doc_id string, ref_family_id string, score double, rank int")
    got = {r.query_doc_id: r for r in V.vote_by_document(df, how).collect()}
    assert tuple(V.vote_by_document(df, how).columns) == V.VOTES_COLUMNS
    by = defaultdict(lambda: defaultdict(list))
    for q, _, _, r, _, s, _ in rows:
        by[q][r].append(s)
    for q, refs in by.items():
        agg = {r: {"count": float(len(s)), "weight": sum(s), "maxsim": max(s)}[how] for r, s in refs.items()}
        order = sorted(agg, key=lambda r: (-agg[r], r))
        total = sum(agg.values())
        want = agg[order[0]] if how == "maxsim" else agg[order[0]] / total if total > 0 else 0.0
        row, n = got[q], sum(map(len, refs.values()))
        assert (row.pred_doc_id, row.pred_family_id, row.n_votes, row.best_votes, row.n_chunks) == (order[0], f"fam-{order[0]}", n, len(refs[order[0]]), len({x[2] for x in rows if x[0] == q}))
        assert row.confidence == pytest.approx(want) and (row.vote_entropy, row.vote_variance, row.vote_gini) == pytest.approx(stats([agg[r] for r in order]))
        assert list(json.loads(row.vote_distribution_json)) == order
    assert V.vote_by_document(df.limit(0), how).count() == 0


@pytest.mark.parametrize(("ties", "want"), [("document", ("r1", "A")), ("family", ("r2", "B"))])
def test_family_votes(spark, ties, want):
    scored = spark.createDataFrame([("q1", "r1", "A", 0.5), ("q1", "r2", "B", 0.5), ("q1", "r3", "B", 0.5), ("q1", "r4", "A", 0.1)], "query_doc_id string, ref_doc_id string, ref_family_id string, score double")
    queries = spark.createDataFrame([("q1", "Q"), ("q2", "Q")], "doc_id string, family_id string")
    got = {r.query_doc_id: r for r in V.family_votes(scored, queries, ties, unmatched=1).collect()}
    assert (got["q1"].pred_doc_id, got["q1"].pred_family_id) == want
    assert (got["q1"].vote_entropy, got["q1"].vote_variance, got["q1"].vote_gini) == pytest.approx((1.0, 0.0, 0.5))
    q2 = got["q2"]
    assert (q2.pred_doc_id, q2.n_votes, q2.confidence, q2.vote_gini, q2.vote_entropy, q2.vote_variance, q2.vote_distribution_json) == (None, 1, 0.0, 1.0, 0.0, 0.0, "{}")


def evaluation(spark, rows, threshold=None):
    """rows: query, is_positive, target, confidence or None for no vote, predicted family."""
    manifest = spark.createDataFrame([r[:3] for r in rows], "query_doc_id string, is_positive boolean, target_family_id string")
    votes = spark.createDataFrame([(r[0], "d" + (r[4] or ""), r[4], r[3]) for r in rows if r[3] is not None], "query_doc_id string, pred_doc_id string, pred_family_id string, confidence double")
    return E.evaluate_run(manifest, votes, threshold)


def test_evaluate(spark):
    rows = [("a", True, "A", 0.9, "A"), ("b", True, "B", 0.4, "A"), ("c", True, "C", None, None), ("d", False, None, 0.9, "A"), ("e", False, None, 0.1, "B")]
    assert evaluation(spark, rows)[0]["threshold"] == 0.0  # all of them: 3 of 5 are right, an F1 of 0.75
    metrics, ev = evaluation(spark, rows, 0.4)
    assert metrics["threshold"] == 0.4 and metrics["detection_best"]["best_f1"] == pytest.approx(0.75)
    d = metrics["detection"]
    assert (d["tp"], d["fp"], d["tn"], d["fn"]) == (2, 1, 1, 1) and d["accuracy"] == pytest.approx(0.6)
    assert metrics["attribution"] == pytest.approx({"family_acc_on_all_positive": 1 / 3, "family_acc_on_detected_positive": 0.5})
    assert metrics["separability"]["positive_ratio"] == 0.6 and metrics["separability"]["roc_auc"] == pytest.approx((1.5 + 1 + 0) / 6)
    assert [(r.family_id, r.n_positive_total, r.n_false_attraction, r.attribution_rate) for r in E.errors_by_family(ev).collect()] == [("A", 1, 1, 1.0), ("B", 1, 0, 0.0), ("C", 1, 0, 0.0)]
    assert [(r.query_doc_id, r.pred_family_id) for r in E.false_positives(ev).collect()] == [("d", "A")]
    assert {r.query_doc_id: r.category for r in E.case_categories(ev).collect()} == {"a": "TP", "b": "TP", "c": "FN", "d": "FP", "e": "TN"}
    assert {r.actual: (r.detected, r.passed, r.total) for r in E.confusion_matrix(ev).collect()} == {"positive": (2, 1, 3), "negative": (1, 1, 2), "total": (3, 2, 5)}


def test_evaluate_edges(spark):
    one_class, _ = evaluation(spark, [("a", True, "A", 0.6, "A"), ("b", True, "B", 0.5, "B"), ("c", True, "C", None, None)])
    assert one_class["threshold"] == 0.5 and one_class["detection_best"]["best_f1"] is None and one_class["separability"]["roc_auc"] is None
    assert one_class["detection"]["tp"] == 2 and one_class["detection"]["precision"] == 1.0
    at_zero, ev = evaluation(spark, [("a", True, "A", None, None), ("b", False, None, 0.0, "B"), ("c", True, "C", 0.0, "C")])
    assert at_zero["threshold"] == 0.0 and at_zero["detection_best"]["best_recall"] == 1.0 and at_zero["detection"]["recall"] == 0.5  # an absent vote isn't detected
    none, ev = evaluation(spark, [("a", True, "A", 0.2, "A"), ("b", False, None, 0.1, "B")], threshold=0.9)
    assert none["detection"]["f1"] == 0.0 and E.false_positives(ev).count() == 0 and {r.pred_family_id for r in ev.collect()} == {None}


def test_curve_in_ranges(spark):
    rng = random.Random(3)
    rows = [(rng.random() < 0.5, round(rng.random(), 2)) for _ in range(2000)]
    scored = spark.createDataFrame(rows, "is_positive boolean, score double")
    for r in R.curve(scored).collect():
        assert (r.tp, r.fp) == (sum(p for p, s in rows if s >= r.score), sum(not p for p, s in rows if s >= r.score))


def test_top_k_in_blocks(spark):
    rng = random.Random(5)
    vec = lambda: [rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(4)]
    q, r = ([(f"{p}{i:03}", vec()) for i in range(n)] for p, n in (("q", 23), ("r", 57)))
    dfs = spark.createDataFrame(q, "query_id string, qv array<double>"), spark.createDataFrame(r, "ref_id string, rv array<double>")
    got = defaultdict(list)
    for x in sorted(R.top_k(*dfs, 4, block_rows=10).collect(), key=lambda x: x.rank):
        got[x.query_id].append(x.ref_id)
    for i, v in q:
        assert got[i] == sorted((ri for ri, _ in r), key=lambda k: (-sum(a * b for a, b in zip(v, dict(r)[k])), k))[:4]
    assert R.top_k(dfs[0], dfs[1].limit(0), 4).count() == 0 == R.top_k(dfs[0].limit(0), dfs[1], 4).count()
    same = dfs[0].select(F.col("query_id").alias("ref_id"), F.col("qv").alias("rv"))
    assert R.top_k(dfs[0], same, 3, but_self=True).where("query_id = ref_id").count() == 0


def test_top_k_in_passes_with_copies(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(4)
    base = rng.integers(-3, 4, (40, 8)).astype(float)
    base[:, 0] += 9  # no vector is 0
    vectors = {f"v{i:03}": base[0 if i % 2 else i % 40] for i in range(200)}  # half of them copies of one vector
    df = spark.createDataFrame([(k, [float(x) for x in v]) for k, v in vectors.items()], "id string, v array<float>").repartition(3)
    q, r = df.where("substr(id, 4) IN ('0', '5')").select(F.col("id").alias("query_id"), F.col("v").alias("qv")), df.select(F.col("id").alias("ref_id"), F.col("v").alias("rv"))
    monkeypatch.setattr(R, "PASS_BYTES", 8 * 8 * 11)
    found = R.top_k(q, r, 3, but_self=True, block_rows=16, cosine=True)
    got = {}
    for x in sorted(found.collect(), key=lambda x: x.rank):
        got.setdefault(x.query_id, []).append((x.ref_id, x.score))
    unit = lambda v: v / np.linalg.norm(v)
    for name in (k for k in vectors if k[-1] in "05"):
        every = sorted((-round(float(unit(vectors[name]) @ unit(v)), 12), k) for k, v in vectors.items() if k != name)[:3]
        assert [k for k, _ in got[name]] == [k for _, k in every] and all(abs(s + e[0]) < 1e-9 for (_, s), e in zip(got[name], every))
    plan = found._jdf.queryExecution().toString()  # references are neither multiplied nor shuffled
    assert len(got) == 40 and "Explode" not in plan and "explode" not in plan and "CoGroup" not in plan


def test_bags_against_plain(spark):
    rng = random.Random(2)
    bag = lambda n: [[rng.choice([-1.0, 0.0, 0.5, 1.0]) for _ in range(3)] for _ in range(n)]
    q, r = ([(f"{p}{i // 2}", f"{p}{i // 2}::c{i % 2}", bag(rng.randint(0, 4))) for i in range(8)] for p in "qr")
    schema = "doc_id string, chunk_id string, tokens array<array<double>>"
    whole = lambda rows, doc: [v for d, _, b in rows if d == doc for v in b]
    pairs = [(a, b) for a in ("q0", "q1", "q2", "q3") for b in ("r0", "r3")]
    got = {(x.query_doc_id, x.ref_doc_id): x.score for x in R.bag_similarity(spark.createDataFrame(pairs, "query_doc_id string, ref_doc_id string"), *(spark.createDataFrame(x, schema) for x in (q, r))).collect()}
    for a, b in pairs:
        x, y = whole(q, a), whole(r, b)
        if x and y:
            best = [max(sum(i * j for i, j in zip(u, v)) for v in y) for u in x]
            assert got[a, b] == pytest.approx(sum(best) / len(best))
        else:
            assert (a, b) not in got


def test_bm25_against_plain(spark):
    rng = random.Random(9)
    texts = lambda n: [" ".join(rng.choice("apple pear the of tree fruit Garden garden é river a".split()) for _ in range(rng.randint(0, 20))) for _ in range(n)]
    refs, queries = ([(f"{p}{i}", f"F{i % 3}", t) for i, t in enumerate(texts(n))] for p, n in (("r", 9), ("q", 7)))
    schema = "doc_id string, family_id string, text string"
    got = {r.query_doc_id: r for r in L.bm25_votes(spark.createDataFrame(refs, schema), spark.createDataFrame([*queries, ("none", "F", None)], schema)).collect()}
    toks = lambda t: [w for w in t.lower().split() if len(w) > 1 and w not in L.STOP_WORDS]
    docs = {i: toks(t) for i, _, t in refs}
    avg = sum(map(len, docs.values())) / len(refs)
    idf = lambda w: (lambda df: math.log(1 + (len(refs) - df + 0.5) / (df + 0.5)))(sum(w in d for d in docs.values()))
    for q, _, t in queries:
        score = {i: sum(idf(w) * d.count(w) / (d.count(w) + 1.5 * (0.25 + 0.75 * len(d) / avg)) for w in toks(t) if w in d) for i, d in docs.items()}
        best = max(score.values())
        assert got[q].confidence == pytest.approx(best)
        if best > 0:
            assert score[got[q].pred_doc_id] == pytest.approx(best) and got[q].n_votes == 1
    assert got["none"].pred_doc_id is None and got["none"].n_votes == 1


@pytest.mark.parametrize("scope", ["doc", "keyword"])
def test_bm25_is_one_pass_over_queries_and_parts_agree(spark, monkeypatch, scope):
    rng = random.Random(5)
    texts = lambda n: [" ".join(rng.choice("running runs apple apples pear their theirs fruit Garden gardens é river a x the".split()) for _ in range(rng.randint(0, 12))) for _ in range(n)]
    refs, queries = ([(f"{p}{i}", f"F{i % 4}", t) for i, t in enumerate(texts(n))] for p, n in (("r", 23), ("q", 40)))
    dfs = [spark.createDataFrame(x, "doc_id string, family_id string, text string") for x in (refs, [*queries, ("none", "F", None)])]
    phrases = dfs[0].groupBy("family_id").agg(F.array_join(F.sort_array(F.collect_list("text")), " ").alias("keyphrases"))
    once = L.bm25_votes(*dfs, scope, phrases, top=7)
    plan = once._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    shown = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.drop("pred_doc_id", "pred_family_id").collect())
    want, named = shown(once), {r.query_doc_id: (r.pred_doc_id, r.pred_family_id) for r in once.collect()}
    monkeypatch.setattr(L, "INDEX_ENTRIES", 20)
    parts = L.bm25_votes(*dfs, scope, phrases, top=7)
    assert shown(parts) == want and {r.query_doc_id: (r.pred_doc_id, r.pred_family_id) for r in parts.collect()} == named
    assert len(want) == 41 and sum(v[0] is not None for v in named.values()) > 30


def test_fuzzy_hash_join_loses_nothing(spark):
    from sievelake.functions import fuzzy_hash as H

    rng = random.Random(11)
    base = [article(i, 400) for i in range(6)]
    near = lambda t: t[: (a := rng.randint(0, len(t) - 200))] + "changed words" + t[a + rng.randint(0, 150) :]
    refs = [(f"r{i}", f"F{i}", t) for i, t in enumerate([*base, "", None, "tiny"])]
    queries = [(f"q{i}", f"F{i}", near(base[i % 6])) for i in range(12)] + [("qt", "F", "tiny"), ("qn", "F", " ")]
    schema = "doc_id string, family_id string, text string"
    dfs = [spark.createDataFrame(x, schema) for x in (refs, queries)]
    got = {(r.query_id, r.ref_id): r.score for r in L.fuzzy_hash_scores(*(d.withColumnRenamed("doc_id", "id") for d in dfs)).collect()}
    want = {(q, r): s for q, _, t in queries for r, _, u in refs if (s := H.compare(H.digest((t or "").strip()), H.digest((u or "").strip()))) > 0}
    assert got == want and len(want) >= 12 and got["qt", "r8"] == 100
    votes = {r.query_doc_id: r for r in L.fuzzy_hash_votes(*dfs).collect()}
    assert votes["q0"].pred_family_id == "F0" and votes["q0"].confidence == want["q0", "r0"] / 100 and votes["qn"].confidence == 0.0


def test_stems():
    from sievelake.functions.stemming import stem

    pairs = "caresses caress ponies poni running run generalizations general hoping hope hopping hop relational relat happily happili skies sky dying die consistently consist knives knive crying cri by by say say cries cri inning inning proceeds proceed agreed agre plastered plaster motoring motor controlling control roll roll vietnamization vietnam operators oper sensibilities sensibl electricity electr hopefulness hope"
    words = pairs.split()
    assert [stem(w) for w in words[::2]] == words[1::2]


def test_pair_metrics(spark):
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return row[-1]

    o = [("o1", "The cat sat on the mat"), ("o2", ""), ("o3", "x " * 30 + "end")]
    v = [("v1", "o1", "a cat sat at THE mat today"), ("v2", "o2", ""), ("v3", "o3", "x end"), ("v4", "gone", "y"), ("v5", "o1", "ßß")]
    originals = spark.createDataFrame(o, "doc_id string, text string")
    variants = spark.createDataFrame([(a, b, "f", "eda", "1", t) for a, b, t in v], "doc_id string, source_doc_id string, family_id string, variant_type string, variant_level string, text string")
    got = {r.doc_id: r for r in L.pairwise_lexical(originals, variants).collect()}
    assert set(got) == {"v1", "v2", "v3", "v5"}
    for a, b, t in v:
        if a in got:
            x, y = dict(o)[b].lower().split(), [w for w in t.lower().split() if w.isascii()]
            assert got[a].norm_edit_distance == pytest.approx(distance(x, y) / max(len(x), len(y), 1))
    assert got["v1"].ngram_overlap_1 == pytest.approx(4 / 7) and got["v1"].jaccard_tokens == pytest.approx(4 / 8) and got["v2"].self_bleu == 0.0


@pytest.mark.parametrize(("method", "params"), [("bm25", {}), ("bm25", {"scope": "keyword"}), ("minhash_lsh", {}), ("ssdeep", {}), ("embedding_pooled", {}), ("longctx", {"long_doc": "mean_pool", "max_seq_length": 62}), ("colbert", {"shortlist_k": 4}), ("chunk_voting", {}), ("chunk_maxsim", {})])
def test_run(spark, prepared, method, params):
    cfg = config(prepared, method=method, method_params=params, top_k=2)
    metrics = P.run(spark, cfg)
    assert metrics["method"] == method and metrics["counts"]["n_query_docs"] == 40 and metrics["timing_sec"]["inference_total_sec"] > 0
    assert metrics["detection_best"]["best_f1"] > (0.5 if method == "ssdeep" else 0.8)
    path = cfg.run_dir() if method.startswith("chunk") else next(f"{prepared}/artifacts/runs/{cfg.run_ident()}/{n}" for n in S.listing(spark, f"{prepared}/artifacts/runs/{cfg.run_ident()}"))
    kept = S.listing(spark, path)
    assert {"votes.parquet", "query_manifest.parquet", "per_query_eval.parquet", "metrics.json"} <= set(kept)
    assert tuple(spark.read.parquet(f"{path}/votes.parquet").columns) == V.VOTES_COLUMNS
    if method == "chunk_maxsim":  # the second chunk run finds its vectors in the cache
        assert metrics["timing_sec"]["embed_source"] == "cached" and metrics["index"]["dim"] == 64
        assert {"config.json", "splits_used.parquet", "ref_chunks.parquet", "retrieval_topk.parquet", "errors_by_family.parquet", "fp_pairs.parquet", "index"} <= set(kept)


def test_set_vectors_are_kept(spark, prepared):
    cfg = config(prepared, method="longctx", method_params={"long_doc": "mean_pool", "max_seq_length": 62})
    again = P.run(spark, cfg)
    assert again["timing_sec"]["embed_source"] == "cached" and again["timing_sec"]["n_overflow_sets"] == 40
    _, sets = P.run_query_sets(spark, cfg)
    plain = P.longctx_votes(sets.reference, sets.queries, X.HashEncoder(64), X.WordTokenizer.new(), "mean_pool", 62)
    kept = spark.read.parquet(f"{prepared}/artifacts/runs/{cfg.run_ident()}/hashed-words-64__mean_pool__l62/votes.parquet")
    key = lambda df: {r.query_doc_id: (r.pred_family_id, round(r.confidence, 6)) for r in df.collect()}
    assert key(plain) == key(kept)
    bags = P.token_bag_votes(sets.reference, sets.queries, X.HashEncoder(), X.WordTokenizer.new(), 4)
    cfg = config(prepared, method="colbert", method_params={"shortlist_k": 4})
    assert key(bags) == key(spark.read.parquet(f"{prepared}/artifacts/runs/{cfg.run_ident()}/colbertv2__b2mean/votes.parquet"))


def test_prepare(spark, tmp_path):
    import zipfile

    from sievelake.operators import variants as M
    from sievelake.plans import prepare as Z

    out = f"{tmp_path}/prepared"
    (tmp_path / "r.jsonl").write_text(json.dumps({"name": "a", "fulltext": "the big cat"}))
    Z.save_keyphrase_set(spark, f"{tmp_path}/r.jsonl", "semeval", out)
    docs = S.load_prepared_set(spark, out, "semeval_original")
    Z.save_synonym_set(docs, out, "semeval", 0.1, M.table_synonyms({"big": ["large"]}))
    Z.save_paraphrase_set(docs, out, "semeval", str.upper, "gpt-5.4")
    Z.save_controlled_set(docs, out, "semeval", str.title)
    with zipfile.ZipFile(tmp_path / "p.zip", "w") as z:
        for v in (1, 2):
            z.writestr(f"x/docs/p/v{v}.json", json.dumps({"nodes": [{"ntype": "p", "content": f"t{v}"}]}))
    Z.save_revision_archive_sets(spark, f"{tmp_path}/p.zip", out)
    (tmp_path / "w.json").write_text(json.dumps({"work_id": "w_fr", "gt_paras": ["g"], "source_paras": [], "translator_data": {"translator_1": {"translator_paras": ["t"]}}}))
    Z.save_translation_sets(spark, f"{tmp_path}/w.json", out)
    pairs = spark.createDataFrame([("v1", "s1", "One.", "p", "v2", "s2", "Two.", "p")], "id_version_1 string, `id-sentence-1` string, `text-sentence-1` string, `type-sentence-1` string, id_version_2 string, `id-sentence-2` string, `text-sentence-2` string, `type-sentence-2` string")
    pairs.write.parquet(f"{tmp_path}/hub/article_pairs/train")
    spark.createDataFrame([("F", ["v1", "v2"])], "id_forum string, references array<string>").write.parquet(f"{tmp_path}/hub/mapping/train")
    spark.createDataFrame([("v1", "F", 2.0, None), ("v2", "F", 1.0, None)], "id string, forum string, cdate double, content string").write.parquet(f"{tmp_path}/hub/metadata")
    Z.save_revision_sets(spark, f"{tmp_path}/hub", out, ("train",))
    texts = {n: sorted(r.text for r in S.load_prepared_set(spark, out, n).collect()) for n in S.list_prepared_sets(spark, out)}
    assert texts == {
        "semeval_original": ["the big cat"], "semeval_original_eda_sr_a10_s42": ["the large cat"], "semeval_original_gpt_para_54_t0_s42": ["THE BIG CAT"], "semeval_original_dipper_lex60_order60_s42": ["The Big Cat"],
        "re3_v1_only": ["t1"], "re3_v2_only": ["t2"], **{f"par3_{n}{s}": [t] for s in ("", "_split") for n, t in (("gt", "g"), ("human", "t"), ("human_t1", "t"))},
        "casimir_v1_only_dedup": ["Two."], "casimir_revisions_dedup": ["One."], "casimir_latest_only_dedup": ["One."],
    }


def test_reports(spark, prepared):
    m = report.load_metrics(spark, f"{prepared}/artifacts").cache()
    assert m.count() >= 9 and {r.variant_sets for r in m.collect()} == {"variants"} and {r.inclorig for r in m.collect()} == {True}
    assert report.load_metrics(spark, f"{prepared}/nothing").count() == 0
    rows = [("bm25", "x", "bm25__doc", 0.5), ("bm25", "x", "bm25__keyword", 0.7), ("bm25", "y", "bm25__doc", 0.4), ("ssdeep", "x", "default", 0.1), ("chunk_voting", "y", "A__CB", 0.9)]
    df = spark.createDataFrame(rows, "method string, dataset string, config string, best_f1 double")
    assert [tuple(r) for r in report.pivot_table(df).collect()] == [("bm25", 0.7, 0.4), ("chunk_voting", None, 0.9), ("ssdeep", 0.1, None)]
    assert [tuple(r) for r in report.pivot_table(df, rows=["ssdeep", "gone", "bm25"], cols=["y", "z", "x"]).collect()] == [("ssdeep", None, 0.1), ("bm25", 0.4, 0.7)]
    table = {r.label: (r.x, r.y) for r in report.comparison_table(df).collect()}
    assert list(table) == [label for label, _, _ in report.ROWS]
    assert (table["bm25 (full doc)"], table["bm25 (keyword)"], table["chunk + voting (Count-based)"], table["colbertv2"]) == ((0.5, 0.4), (0.7, None), (None, 0.9), (None, None))


def test_config():
    cfg = RunConfig("semeval")
    assert cfg.run_ident() == "chunk_voting__semeval_original__s42__inclorig" and cfg.config_slug() == "hashed-words-64__word50o0__exact__top1__cb"
    other = RunConfig("re3sci", variant_sets=("a", "b"), include_original_as_positive=False, embed_spec=EmbedSpec("org/model"), use_score_weight=True)
    assert other.run_ident("bm25").startswith("bm25__re3_v1_only__s42__var") and "org__model" in other.config_slug() and other.config_slug().endswith("__sw")
    assert other.as_serializable()["_resolved"]["variant_sets"] == ["a", "b"]
    for bad in ({"dataset": "x"}, {"dataset": "semeval", "method": "x"}):
        with pytest.raises(ValueError):
            RunConfig(**bad)
    with pytest.raises(ValueError):
        ChunkSpec("word", 5, 5)


def test_encoders(spark):
    docs = spark.createDataFrame([("a", "f", "d", "one two three four five six seven"), ("b", "f", "d", None), ("c", "f", "d", "x y")], "doc_id string, family_id string, dataset string, text string")
    chunks = X.token_chunks(docs, X.WordTokenizer.new(), 3, 1)
    assert [(r.chunk_id, r.chunk_text, r.chunk_spec) for r in chunks.orderBy("chunk_id").collect()] == [("a::c0", "one two three", "token3o1"), ("a::c1", "three four five", "token3o1"), ("a::c2", "five six seven", "token3o1"), ("c::c0", "x y", "token3o1")]
    with pytest.raises(ValueError):
        X.token_chunks(docs, None, 3)
    enc = X.HashEncoder(16)
    slots = {(r.doc_id, r.slot): r.value for r in X.hashed_words(docs.where("text IS NOT NULL"), "doc_id", dim=16).collect()}
    for r in X.encode_column(docs, enc, "text").collect():
        assert [slots.get((r.doc_id, i), 0.0) for i in range(16)] == pytest.approx(list(r.embedding), abs=1e-6)
    long = {m: {r.doc_id: r for r in X.long_context_vectors(docs, enc, X.WordTokenizer.new(), 6, m).collect()} for m in ("truncate", "mean_pool", "exclude")}
    assert set(long["exclude"]) == {"b", "c"} and long["truncate"]["a"].overflow and not long["truncate"]["c"].overflow
    assert list(long["truncate"]["a"].vector) == pytest.approx(enc.encode(["one two three four"])[0].tolist(), abs=1e-6)
    with pytest.raises(RuntimeError):
        X.resolve_device(None)
    assert X.resolve_device("cpu") == "cpu" and X.resolve_device(None, lambda: True) == "cuda"
    lazy = X.Lazy("test-lazy", 16, lambda: enc)
    assert X.encode_column(docs, lazy, "text").count() == 3


def test_split_combined_cache(spark, tmp_path):
    vec = spark.createDataFrame([(f"d{i}", "f", [1.0]) for i in range(4)], "doc_id string, family_id string, vector array<double>")
    S.save_vectors(vec, f"{tmp_path}/all", {"encode_sec": 8.0, "n_overflow": 2})
    sets = {"half": (f"{tmp_path}/half", vec.where("doc_id < 'd2'")), "more": (f"{tmp_path}/more", vec.select("doc_id").union(spark.createDataFrame([("z",)], "doc_id string")))}
    assert S.split_combined_cache(spark, f"{tmp_path}/all", sets) == {"half": "ok (2 docs)", "more": "covers 4 of 5"}
    table, held = S.load_vectors(spark, f"{tmp_path}/half")
    assert table.count() == 2 and (held["encode_sec"], held["n_overflow"], held["n_docs"]) == (4.0, 1, 2)
    assert S.split_combined_cache(spark, f"{tmp_path}/all", sets)["half"] == "exists"


def test_small_helpers(spark):
    per_set = spark.createDataFrame([("a", "1", 4.0), ("a", "2", 4.0), ("b", "3", 6.0)], "set_name string, doc_id string, sec double")
    assert P.prorated_seconds(per_set, spark.createDataFrame([("1",), ("9",)], "doc_id string")).first().sec == 2.0
    assert P.combined_source(["live", "cached"]) == "mixed" and P.combined_source(["live"]) == "live"
    assert P.throughput(4, 0) == 0.0 and P.throughput(4, 2) == 2.0
    ids = D.build_ids(spark.createDataFrame([("My Set", "K/1")], "d string, k string"), "d", "k", 3).first()
    assert (ids.family_id, ids.new_doc_id) == ("my_set:k1", "my_set:k1:v3")
    whole = D.whole_chunks(spark.createDataFrame([("a", "f")], "doc_id string, family_id string")).first()
    assert tuple(whole) == ("a", "a", "f", "", 0)
