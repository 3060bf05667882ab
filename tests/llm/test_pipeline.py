"""The corpus pipeline on the smallest tables: each stage against plain Python on what the one before kept."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F
from sievelake.llm import packing, toxicity
from sievelake.llm.common import Stored, table
from test_mixing import hashes_of, plain_mix
from test_near_dedup import plain_classes
from test_toxicity import plain_probabilities

SF = "/root/testdata/sf0.001"


def rows(df):
    return [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]


def test_stages(spark):
    start = table(spark, SF, "documents")
    stages, docs, kept = dict(corpus_pipeline.STAGES), start, {}
    assert list(stages) == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    for name, stage in stages.items():
        docs = Stored(stage(spark, docs, SF), f"test-{name}").df
        kept[name] = docs
        if name != "packing":
            assert docs.columns == start.columns

    model = toxicity.fit_toxicity(start, table(spark, SF, "labels"))
    clean = [r for r in rows(start) if plain_probabilities(model, r[1])[0] < 0.5]
    assert Counter(rows(kept["toxicity"])) == Counter(clean)

    groups: dict = {}
    for r in clean:
        groups.setdefault((r[1] or "").encode().lower(), []).append(r)
    single = [max(g, key=lambda r: r[0]) for g in groups.values()]
    assert Counter(rows(kept["exact_dedup"])) == Counter(single)

    classes, _ = plain_classes([r[:2] for r in single], 5, 80)
    heads = {c for _, n, c in classes if n} | {i for i, n, _ in classes if not n}
    blank = [i for i, n, _ in classes if not n]
    far = [r for r in single if r[0] in heads and (r[0] not in blank or r[0] == min(blank))]
    assert Counter(rows(kept["near_dedup"])) == Counter(far)

    read = [(r.rid, r.doc_id, r.source, len((r.text or "").encode().split()), r.text) for r in kept["near_dedup"].withColumn("rid", F.monotonically_increasing_id()).collect()]
    _, taken = plain_mix([(rid, s, n) for rid, _, s, n, _ in read], hashes_of(spark, [r[0] for r in read]))
    want: Counter = Counter()
    for rid, i, _, n, text in read:
        if n:
            want[i, text] += taken[rid] // n
            if taken[rid] % n:
                want[i, taken[rid] % n] += 1
    got: Counter = Counter()
    whole = {i: t for _, i, _, _, t in read}
    for r in kept["mixing"].collect():
        assert r.n_chars == len(r.text) and whole[r.doc_id].startswith(r.text)
        got[r.doc_id, r.text if r.text == whole[r.doc_id] else len(r.text.encode().split())] += 1
    assert got == +want

    own = packing.Encoder(*packing.default_paths()).own
    pieces = kept["packing"].collect()
    tokens = sorted(len(own.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in kept["mixing"].collect())
    assert sorted(r.doc_tokens for r in pieces if r.start == 0) == tokens and sum(r.length for r in pieces) == sum(tokens)
    fill: dict = {}
    for r in sorted(pieces, key=lambda r: (r.sequence_id, r.offset)):
        assert fill.get(r.sequence_id, 0) == r.offset
        fill[r.sequence_id] = r.offset + r.length
    assert max(fill.values()) <= 2048
