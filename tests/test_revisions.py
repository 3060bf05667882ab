"""Papers and versions, source readers, docs of the data sets."""

import json
import zipfile

import pytest
from pyspark.sql import functions as F

from sievelake.functions import text as T
from sievelake.operators import datasets as DS
from sievelake.operators import revisions as V
from sievelake.sources import readers


def one(spark, value, kind, f):
    return spark.createDataFrame([(value,)], f"x {kind}").select(f(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(("text", "want"), [("['a', ' b  c']", ["a", "b c"]), ('["x", " "]', ["x"]), ("x", []), (None, []), ("", []), ("[1, 2]", ["1", "2"]), ("[broken", [])])
def test_listlike(spark, text, want):
    assert one(spark, text, "string", T.listlike) == want


def test_fingerprint(spark):
    assert one(spark, "Under review as a paper\nAbstract\n\nÉtude of the ﬂow: part 1\nEditors: x", "string", T.prefix_fingerprint) == "etudeoftheflowpart1"
    assert one(spark, "a" * 300, "string", T.prefix_fingerprint) == "a" * 200
    assert one(spark, None, "string", T.prefix_fingerprint) == ""


def test_text_helpers(spark):
    assert one(spark, '{"paperhash": " a  b "}', "string", T.paperhash) == "a b"
    assert one(spark, "broken", "string", T.paperhash) == "" and one(spark, None, "string", T.paperhash) == ""
    assert [one(spark, x, "string", T.sentence_type) for x in ("Article-Title", "paragraph", " List ", None)] == ["title", "p", "list", ""]
    assert one(spark, [" a ", None, "  ", "b\n"], "array<string>", T.paragraph_join) == "a\nb"
    nodes = [("abstract", " x "), ("ref", "r"), ("p", "y"), ("abstract", "z"), ("p", None)]
    assert one(spark, nodes, "array<struct<ntype: string, content: string>>", T.nodes_text) == "Abstract\nx\n\ny\n\nAbstract\nz"
    sents = [("title", "T"), ("abstract", "a"), ("abstract", "b"), ("p", "c"), ("abstract", "d"), ("p", " ")]
    assert one(spark, sents, "array<struct<kind: string, text: string>>", T.compose_sentences) == "T\n\nAbstract\na\n\nb\n\nc\n\nAbstract\nd"
    assert one(spark, 'It ended. "Why?" He left at 5 p.m. today\nand slept! (So.)', "string", T.sentences) == ["It ended.", '"Why?"', "He left at 5 p.m. today and slept!", "(So.)"]
    assert T.model_slug("a/b:c@d") == "a__b_c_d" and T.sanitize(" A b/c! ") == "a_bc"


PAIRS = "id_version_1 string, `id-sentence-1` string, `text-sentence-1` string, `type-sentence-1` string, `page-sentence-1` string, `num_sentence-sentence-1` int, id_version_2 string, `id-sentence-2` string, `text-sentence-2` string, `type-sentence-2` string, `sentence-pair-index` int"


@pytest.fixture(scope="module")
def pairs(spark):
    rows = [
        ("v1", "s2", "Second  sentence.", "paragraph", "1", 2, "w1", "t1", "A title", "article-title", 1),
        ("v1", "s1", "First sentence.", "p", "1", 1, "w1", "", "Body text", "p", 2),
        ("v1", "s1", "First sentence.", "p", "1", 1, "w1", "", "Body text", "p", 3),
        ("v1", None, "Abstract", "abstract", "0", 0, "w1", "t9", "skip", "list", 4),
        ("v1", None, "We show it.", "abstract", "0", 0, None, "x", "lost", "p", 5),
        ("", "s5", "no version", "p", "0", 0, "v1", "s3", "No place known.", "p", 6),
    ]
    return spark.createDataFrame(rows, PAIRS)


def test_version_texts(pairs):
    got = {r.version_id: (r.text, r.num_sent_rows) for r in V.version_texts(pairs).collect()}
    assert got == {"v1": ("Abstract\nWe show it.\n\nFirst sentence.\n\nSecond sentence.\n\nNo place known.", 4), "w1": ("A title\n\nBody text", 2)}
    ids = {r.sentence_id for r in V.version_sentences(pairs).where("version_id = 'w1'").collect()}
    assert len(ids) == 2 and any(i.startswith("w1::<NA>::<NA>::<NA>::<NA>::") for i in ids)


MAPPING = "row int, id_forum string, references string, split string"
META = "id string, forum string, cdate double, tcdate double, pdate double, content string"


@pytest.fixture(scope="module")
def tables(spark):
    long = "A study of how rivers carve their beds over time, with many figures and a long list of measured places. "
    texts = spark.createDataFrame([("v1", long, 3), ("v2", long.replace("many", "some"), 3), ("v3", "Something else entirely, about the stars and how they burn in the night.", 2), ("v4", long + "x", 1), ("lone", "A short note on nothing much at all, with no forum of its own.", 1)], "version_id string, text string, num_sent_rows int")
    mapping = spark.createDataFrame([(0, "F1", "['v2', 'v1']", "train"), (1, "F2", '["v3"]', "test"), (2, "F3", "['v4', 'v1']", "train"), (3, "F4", "[]", "train"), (4, " ", "['q']", None)], MAPPING)
    meta = spark.createDataFrame([("v1", "F1", 5.0, 9.0, None, '{"paperhash": "h1"}'), ("v2", "F1", None, 7.0, None, None), ("v3", "F2", float("nan"), None, 3.0, '{"paperhash": "h2"}'), ("v4", "F3", 1.0, None, None, '{"paperhash": "h2"}')], META)
    return texts, mapping, meta


def test_links_and_signals(tables):
    texts, mapping, meta = tables
    got = {r.version_id: (r.forum_id, r.version_ts) for r in V.version_meta(texts, mapping, meta).collect()}
    assert got == {"v1": ("F1", 5.0), "v2": ("F1", 7.0), "v3": ("F2", None), "v4": ("F3", 1.0), "lone": ("lone", None)}
    assert {r.version_id: r.forum_from_mapping for r in V.mapping_forums(mapping).collect()} == {"F1": "F1", "v2": "F1", "v1": "F1", "F2": "F2", "v3": "F2", "F3": "F3", "v4": "F3", "F4": "F4", "q": ""}
    s = {r.forum_id: r for r in V.forum_signals(texts, mapping, meta).collect()}
    assert s["F1"].text.startswith("A study of how rivers") and "some" in s["F1"].text and (s["F1"].date, s["F1"].paperhash, s["F1"].split) == (7, "h1", "train")
    assert (s["F2"].date, s["F4"].text, s["F4"].date) == (3, None, None)


def test_merge_and_assemble(spark, tables):
    texts, mapping, meta = tables
    signals = V.forum_signals(texts, mapping, meta)
    clusters = {r.forum_id: r.cluster_id for r in V.merge_forums(signals).collect()}
    assert clusters == {"F1": "F3", "F2": "F3", "F3": "F3"}  # F1 ~ F3 by text, F2 = F3 by paperhash, F3 has the earliest date
    alone = signals.withColumn("paperhash", F.lit(None).cast("string"))
    assert {r.forum_id: r.cluster_id for r in V.merge_forums(alone).collect()} == {"F1": "F3", "F2": "F2", "F3": "F3"}
    manual = spark.createDataFrame([("F2", "F1"), ("F1", "gone")], "a string, b string")
    assert {r.cluster_id for r in V.merge_forums(alone, manual).collect()} == {"F3"}
    docs = {r.doc_id: r for r in V.assemble_docs(V.version_meta(texts, mapping, meta), V.merge_forums(alone), signals.select("forum_id", "split")).collect()}
    assert set(docs) == {"casimir:f3:v1", "casimir:f3:v2", "casimir:f3:v3", "casimir:f2:v1", "casimir:lone:v1"}
    second = docs["casimir:f3:v2"]
    assert (second.variant_type, second.source_doc_id, json.loads(second.meta_json)["raw_version_id"]) == ("revision", "casimir:f3:v1", "v1")
    assert json.loads(docs["casimir:lone:v1"].meta_json) == {"forum_id": "lone", "cluster_id": "lone", "raw_version_id": "lone", "split": None, "version_ts": None, "num_sent_rows": 1}
    df = V.assemble_docs(V.version_meta(texts, mapping, meta), V.merge_forums(alone), signals.select("forum_id", "split"))
    first, later, latest = (sorted(r.doc_id for r in d.collect()) for d in V.split_versions(df))
    assert (first, later, latest) == (["casimir:f3:v1"], ["casimir:f3:v2", "casimir:f3:v3"], ["casimir:f3:v3"])


def test_near_pairs_against_plain_distances():
    import random

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return row[-1]

    rng = random.Random(3)
    base = "".join(rng.choice("etaoin") for _ in range(200))
    texts = []
    for _ in range(45):
        t = list(base[: rng.choice([18, 63, 64, 65, 128, 129, 180, 200, 200])])
        for _ in range(rng.randint(0, 30)):
            at = rng.randrange(len(t))
            t[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "t"])
        texts.append("".join(t)[:200])
    want = {(i, j, d) for i, x in enumerate(texts) for j, y in enumerate(texts) if x and y and 1 - (d := distance(x, y)) / max(len(x), len(y)) >= 0.82}
    got = [set(zip(*(v.tolist() for v in V.near_pairs(texts, texts, 0.82, once)))) for once in (False, True)]
    assert got[0] == want and got[1] == {(i, j, d) for i, j, d in want if texts[i] < texts[j]} and len(want) > 100


def test_similar_prefixes_against_all_pairs(spark, monkeypatch):
    import random

    rng = random.Random(2)
    base = "".join(rng.choice("abcdefgh") for _ in range(150))
    texts = []
    for i in range(60):
        t = list(base)
        for _ in range(rng.randint(0, 45)):
            t[rng.randrange(18, 150)] = rng.choice("abcdefgh")
        texts.append((f"f{i:02}", "".join(t[: rng.randint(100, 150)])))
    texts += [("g1", "short"), ("g2", texts[3][1]), ("g3", None)]
    monkeypatch.setattr(V, "BLOCK_PART", 7)
    df = spark.createDataFrame(texts, "id string, text string")
    got = {frozenset((r.src, r.dst)) for r in V.similar_prefixes(df).collect()}

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            corner, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                corner, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, corner + (x != y))
        return row[-1]

    real = [(i, t) for i, t in texts if t and len(t) >= 18 and i != "g2"]
    want = {frozenset((a, b)) for k, (a, x) in enumerate(real) for b, y in real[k + 1 :] if 1 - distance(x, y) / max(len(x), len(y)) >= 0.82}
    want |= {frozenset(("f03", "g2"))}
    assert got == want and len(want) > 20


def test_revision_docs_whole(spark, pairs):
    mapping = spark.createDataFrame([(0, "v1", "['w1']", "train")], MAPPING)
    meta = spark.createDataFrame([("v1", "v1", 1.0, None, None, None)], META)
    got = {r.doc_id: r.variant_type for r in V.revision_docs(pairs, mapping, meta).collect()}
    assert got == {"casimir:v1:v1": "original", "casimir:v1:v2": "revision"}


RECORD = "name string, title string, abstract string, fulltext string, keywords string"


@pytest.mark.parametrize("form", ["array", "lines"])
def test_keyphrase_docs(spark, tmp_path, form):
    records = [{"name": "P 1", "title": " A  title", "abstract": "Short.", "fulltext": "Body\nhere", "keywords": "x;y"}, {"name": "P2", "title": None, "abstract": "", "fulltext": "Only"}, {"name": "", "fulltext": "no name"}, {"name": "P3"}]
    path = tmp_path / "records.json"
    path.write_text(json.dumps(records) if form == "array" else "\n\n".join(map(json.dumps, records)))
    got = {r.doc_id: r for r in DS.keyphrase_docs(readers.read_records(spark, str(path), RECORD), "semeval").collect()}
    assert {k: r.text for k, r in got.items()} == {"semeval:p_1:orig": "A title\n\nAbstract\nShort.\n\nBody here", "semeval:p2:orig": "Only"}
    assert json.loads(got["semeval:p_1:orig"].meta_json) == {"raw_name": "P 1", "title": "A title", "keywords": "x;y"}


def test_paper_archive(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        for paper, version, text in (("p1", 1, "one"), ("p1", 2, "two"), ("p2", 2, "only two")):
            z.writestr(f"data/docs/{paper}/v{version}.json", json.dumps({"nodes": [{"ntype": "title", "content": text}, {"ntype": "fig", "content": "f"}]}))
        z.writestr("data/docs/p1/v3.json", "{}")
    got = {r.doc_id: (r.text, r.variant_type, r.source_doc_id) for r in DS.revision_archive_docs(readers.read_paper_archive(spark, str(tmp_path / "a.zip"))).collect()}
    assert got == {"re3sci:p1:v1": ("one", "original", None), "re3sci:p1:v2": ("two", "revision", "re3sci:p1:v1"), "re3sci:p2:v2": ("only two", "revision", "re3sci:p2:v1")}


def test_translations(spark, tmp_path):
    t = lambda *p: {"translator_paras": list(p)}
    works = [
        {"work_id": "book_2_ru", "gt_paras": ["g2"], "source_paras": ["s2"], "translator_data": {"translator_1": t("b"), "translator_9": t("z")}},
        {"work_id": "book_1_ru", "gt_paras": [" g1 ", ""], "source_paras": ["s1"], "translator_data": {"translator_1": t("a"), "translator_2": t(" ")}},
        {"work_id": "solo_1_de", "gt_paras": ["x"], "source_paras": [], "translator_data": {"translator_1": t("y")}},
        {"work_id": "plain", "gt_paras": ["p"], "source_paras": [], "translator_data": {}},
    ]
    (tmp_path / "works.json").write_text("\n".join(map(json.dumps, works)))
    w = readers.read_works(spark, str(tmp_path / "works.json"))
    gt, human = DS.translation_docs(w)
    assert {r.doc_id: r.text for r in gt.collect()} == {"book_ru__gt": "g1\ng2", "solo_1_de__gt": "x", "plain__gt": "p"}
    rows = {r.doc_id: (r.text, r.version_index, r.source_doc_id, json.loads(r.meta_json)["lang_name"]) for r in human.collect()}
    assert rows == {"book_ru__translator_1": ("a\nb", 1, "book_ru__gt", "Russian"), "solo_1_de__translator_1": ("y", 1, "solo_1_de__gt", "German")}
    assert DS.translation_docs(w, merge=False)[0].count() == 4


def test_export(spark, tmp_path):
    spark.createDataFrame([(1, "a")], "x int, y string").write.parquet(f"{tmp_path}/train")
    spark.createDataFrame([(2,)], "x int").write.parquet(f"{tmp_path}/dev")
    assert {tuple(r) for r in readers.read_export(spark, str(tmp_path), ("train", "dev")).collect()} == {(1, "a", "train"), (2, None, "dev")}
    assert readers.read_export(spark, f"{tmp_path}/dev").count() == 1
