"""Quality rules against plain Python: counts, limits from exact quantiles (sketches of few values hold them all), verdicts."""

import math
import random
import re
from collections import defaultdict

from sievelake.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_words string, words string, top_symbols_hi int"


def counts(text):
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    at = defaultdict(list)
    for i in range(len(w) - 4):
        at[tuple(w[i : i + 5])].append(i)
    repeated = len({j for v in at.values() if len(v) > 1 for i in v for j in range(i, i + 5)})
    return {"n_words": len(w), "word_chars": sum(map(len, w)), "n_symbols": len(re.findall("[#*$%&|<>]", text)), "n_lines": len(lines), "n_dup_lines": len(lines) - len(set(lines)), "n_repeat_words": repeated}


def measures(c):
    n = max(c["n_words"], 1)
    return {"symbols": c["n_symbols"] / n, "word_length": c["word_chars"] / n, "dup_lines": c["n_dup_lines"] / max(c["n_lines"], 1), "repeats": c["n_repeat_words"] / n}


def limits(values):
    q = lambda p: sorted(values)[max(0, math.ceil(p * len(values)) - 1)]
    return q(0.25), q(0.75)


def test_against_plain(spark):
    rng = random.Random(12)
    rows = []
    for i in range(170):
        source = "big" if i < 120 else f"small{i % 5}"
        lang = "en" if i < 140 else ("de" if i < 165 else None)
        lines = [" ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(3, 12))) for _ in range(rng.randint(1, 8))]
        if i % 11 == 0:
            lines += lines[:1] * 6
        if i % 13 == 0:
            lines.append("# * $ | < > & % " * 12)
        if i % 17 == 0:
            lines.append("x" * 400)
        rows.append((i, "\n".join(lines), lang, source, "x", "y", 1))
    rows += [(500, None, "en", "big", "x", "y", 1), (501, "", "zz", None, "x", "y", 1), (502, "too short", "en", "big", "x", "y", 1), (3, rows[3][1], "en", "big", "x", "y", 1), (504, "É a b " * 30, "de", "big", "x", "y", 1)]
    got = Q.score_quality(spark.createDataFrame(rows, SCHEMA), least_rows=30).collect()
    assert len(got) == len(rows)

    found = [(i, lang, source, c := counts(text or ""), measures(c)) for i, text, lang, source, *_ in rows]
    base = lambda c: c["n_words"] < 10 or 100 * c["n_repeat_words"] > 20 * c["n_words"]
    by = {"fine": defaultdict(list), "mid": defaultdict(list), "top": defaultdict(list)}
    for i, lang, source, c, m in found:
        if not base(c):
            by["fine"][lang, source].append(m)
            by["mid"][lang].append(m)
            by["top"][()].append(m)
    want, rejected = set(), 0
    for i, lang, source, c, m in found:
        group = next(g for g in (by["fine"][lang, source], by["mid"][lang], by["top"][()]) if len(g) >= 30)
        bad = []
        for name, (least, low) in Q.MEASURES.items():
            a, b = limits([x[name] for x in group])
            reach = Q.SPREAD * max(b - a, least)
            if m[name] > b + reach or low and m[name] < a - reach:
                bad.append(name)
        rejected += bool(bad) and not base(c)
        want.add((i, *c.values(), base(c), not base(c) and not bad, tuple(bad)))
    names = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    assert {(r.doc_id, *(r[n] for n in names), tuple(r.failed)) for r in got} == want
    assert rejected > 5


def test_empty(spark):
    assert Q.score_quality(spark.createDataFrame([], SCHEMA)).collect() == []
