"""Secret scan: pattern matches plus a sliding-window entropy pass over candidate strings.

Base kinds (assign, access, hex) come from fixed patterns. The entropy kind slides a window over each candidate
string and keeps Shannon entropy per character class (hexadecimal of either case, letters of one case with digits,
letters and digits, base64) by incremental counts: one character leaves and one enters, each changing the sum of
c*log2(c) by a table look-up.
Windows above their class's threshold are merged into spans, and spans within a base span are not repeated. Filler
words and runs of the alphabet are cut out of a candidate and what stands before and after them is scanned alone;
candidates and pieces that are harmless as a whole are passed over. One pass over each text, no shuffle; memory is one Arrow batch.

Defined results: null or empty text has no spans; positions are code points, end exclusive; repeated rows give
repeated results; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from sievelake.llm.common import pick

# The base patterns, their least lengths, and the order of kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_ASSIGNED = 6
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
WINDOW = 20
#: Bits a character that a window of WINDOW characters must exceed, by class; "onecase" needs a digit, so that words
#: in letters alone stay "alnum".
THRESHOLDS = {"hex": 3.0, "onecase": 3.4, "alnum": 3.7, "base64": 3.8}
#: Fillers, cut out wherever they stand; an alphabet or digits in order are cut as far as the order goes.
FILLER = re.compile(r"EXAMPLE|example|SAMPLE|sample|placeholder|abcdefghij|ABCDEFGHIJ|0123456789")
#: Candidates, or pieces of them, that look random but are known to be harmless as a whole: UUIDs, the secret key of
#: Amazon's manuals, and runs of words of one form joined by marks: words without a digit or an inner capital, words in
#: capitals, numbers. Cutting at the marks keeps the test linear, however many marks there are.
ALLOWED = (
    re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"),
    re.compile(r"wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"),
)
MARKS = re.compile(r"[-_/+=]+")
PLAIN = (re.compile(r"[A-Za-z][a-z]*"), re.compile(r"[A-Z]+"), re.compile(r"[0-9]+"))

_CLOG = [0.0] + [c * math.log2(c) for c in range(1, WINDOW + 1)]
_DIGIT, _LOWER, _UPPER = frozenset("0123456789"), frozenset("abcdefghijklmnopqrstuvwxyz"), frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HEX = frozenset("0123456789abcdefABCDEF")


def harmless(word: str) -> bool:
    words = [w for w in MARKS.split(word) if w]
    return any(p.fullmatch(word) for p in ALLOWED) or any(all(p.fullmatch(w) for w in words) for p in PLAIN)


def window_spans(s: str, window: int = WINDOW, thresholds: dict[str, float] | None = None) -> list[tuple[int, int]]:
    """Merged spans of the windows whose entropy is above the threshold of the narrowest class that holds them."""
    limits = thresholds or THRESHOLDS
    clog = _CLOG if window == WINDOW else [0.0] + [c * math.log2(c) for c in range(1, window + 1)]
    counts: dict[str, int] = {}
    total, not_hex, lower, upper, digits, base = 0.0, 0, 0, 0, 0, math.log2(window)
    spans: list[tuple[int, int]] = []
    for i, ch in enumerate(s):
        c = counts.get(ch, 0)
        total += clog[c + 1] - clog[c]
        counts[ch] = c + 1
        not_hex += ch not in _HEX
        lower += ch in _LOWER
        upper += ch in _UPPER
        digits += ch in _DIGIT
        if i >= window - 1:
            if not not_hex:
                kind = "hex"
            elif lower + upper + digits < window:
                kind = "base64"
            else:
                kind = "onecase" if digits and not (lower and upper) else "alnum"
            if base - total / window > limits[kind]:
                start = i - window + 1
                if spans and start <= spans[-1][1]:
                    spans[-1] = (spans[-1][0], i + 1)
                else:
                    spans.append((start, i + 1))
            out = s[i - window + 1]
            c = counts[out]
            total += clog[c - 1] - clog[c]
            counts[out] = c - 1
            not_hex -= out not in _HEX
            lower -= out in _LOWER
            upper -= out in _UPPER
            digits -= out in _DIGIT
    return spans


def pieces(word: str) -> Iterator[tuple[int, str]]:
    """(start, piece) of the candidate before, between and after fillers, if a window fits in."""
    at, m = 0, FILLER.search(word)
    while m:
        end = m.end()
        if m[0][:2] in ("ab", "AB", "01"):
            while end < len(word) and ord(word[end]) == ord(word[end - 1]) + 1:
                end += 1
        if m.start() - at >= WINDOW:
            yield at, word[at : m.start()]
        at, m = end, FILLER.search(word, end)
    if len(word) - at >= WINDOW:
        yield at, word[at:]


def find_secrets(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST_ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    base = sorted(found)
    starts = [a for a, _, _ in base]
    furthest = list(accumulate((b for _, _, b in base), max))
    for m in CANDIDATE.finditer(text):
        word = m.group()
        if harmless(word):
            continue
        for at, piece in pieces(word):
            if harmless(piece):
                continue
            for a, b in window_spans(piece):
                a, b = a + at + m.start(), b + at + m.start()
                before = bisect_right(starts, a)
                inside = before and furthest[before - 1] >= b
                around = any(y <= b for _, _, y in base[bisect_left(starts, a) : bisect_right(starts, b)])
                if not inside and not around:
                    found.append((a, 3, b))
    return sorted(found)


def scan_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and spans: array<struct<kind, start, end>>, for every row."""
    docs = pick(df, doc_id=id_col, text=text_col)
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in find_secrets(t or "")] for t in map(pa.StringScalar.as_py, batch.column(1))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, span)], names=["doc_id", "spans"])

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"doc_id {id_type}, spans array<struct<kind: string, start: bigint, end: bigint>>")
