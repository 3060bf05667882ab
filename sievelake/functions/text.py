"""Text functions as Column expressions: Python-compatible white space, chunks, shingles, lexical similarity."""

from __future__ import annotations

import re
import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed value: the code points that Python's str.split() treats as white space.
PYWS = "[\\x09-\\x0d\\x1c-\\x20\\x85\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def py_words(text: Column) -> Column:
    return F.filter(F.split(F.coalesce(text, F.lit("")), PYWS + "+"), lambda w: w != "")


def bound(value: Column, use) -> Column:
    """use(value) with ``value`` evaluated once a row: inside a higher-order function it would be evaluated for each element."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def strip(text: Column) -> Column:
    """The text without white space at its ends; null becomes empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"^{PYWS}+|{PYWS}+$", "")


def clean_space(text: Column) -> Column:
    """Words joined by single spaces; null becomes empty."""
    return F.array_join(py_words(text), " ")


def window_starts(n: Column, size: int, overlap: int) -> Column:
    """Starts of sliding windows of ``size`` with ``overlap``; the last window is the first to reach the end."""
    if size < 1 or not 0 <= overlap < size:
        raise ValueError("size > 0 and 0 <= overlap < size")
    step = size - overlap
    count = F.when(n <= size, F.lit(1)).otherwise(F.ceil((n - size) / F.lit(step)) + 1)
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count.cast("int") - 1), lambda i: i * step)).otherwise(F.array().cast("array<int>"))


def word_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    return bound(py_words(text), lambda words: F.transform(window_starts(F.size(words), size, overlap), lambda at: F.array_join(F.slice(words, at + 1, size), " ")))


def char_chunks(text: Column, size: int, overlap: int = 0) -> Column:
    """Slices of the code points of the stripped text, stripped again; blank ones are dropped before they are numbered."""

    def cut(t: Column) -> Column:
        slices = F.transform(window_starts(F.length(t), size, overlap), lambda at: strip(F.substring(t, at + 1, F.lit(size))))
        return F.filter(slices, lambda c: c != "")

    return bound(strip(text), cut)


def ngrams(words: Column, n: int) -> Column:
    return F.when(F.size(words) >= n, F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))).otherwise(F.array().cast("array<string>"))


def shingles(text: Column, k: int) -> Column:
    """Distinct k-word shingles; a shorter text is one shingle, an empty one has none."""

    def cut(words: Column) -> Column:
        whole = F.when(F.size(words) > 0, F.array(F.array_join(words, " "))).otherwise(F.array().cast("array<string>"))
        return F.when(F.size(words) < k, whole).otherwise(F.array_distinct(ngrams(words, k)))

    return bound(py_words(text), cut)


def quality_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))


def safe_div(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    return safe_div(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def ngram_overlap(ref: Column, hyp: Column, n: int) -> Column:
    """Share of the hypothesis' distinct n-grams that the reference has."""
    r, h = F.array_distinct(ngrams(ref, n)), F.array_distinct(ngrams(hyp, n))
    return safe_div(F.size(F.array_intersect(r, h)), F.size(h))


def sanitize_piece(text: Column) -> Column:
    trimmed = F.regexp_replace(F.lower(text), f"^{PYWS}+|{PYWS}+$", "")
    return F.regexp_replace(F.replace(trimmed, F.lit(" "), F.lit("_")), "[^a-zA-Z0-9_@.\\-:]", "")


def hash28(text: Column) -> Column:
    """The first 28 bits of MD5: the same in every engine."""
    return F.conv(F.substring(F.md5(text), 1, 7), 16, 10).cast("bigint")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def clean_variant_source(text: Column) -> Column:
    """Lower case without apostrophes; letters, digits and ``<>=,.:-`` stay, commas stand alone, single spaces."""
    t = F.regexp_replace(F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), "'", "")), "[^a-z0-9 <>=,.:\\-]", " ")
    return F.trim(F.regexp_replace(F.regexp_replace(t, " *, *", " , "), " +", " "))


def join_commas(text: Column) -> Column:
    """A comma follows its word at once, and one space follows it."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, "\\s+,", ","), ",\\s*", ", "))


def record_text(title: Column, abstract: Column, body: Column) -> Column:
    """Title, the abstract under its heading and the body, blank lines between; empty fields are left out."""
    part = lambda c, head="": F.when(clean_space(c) != "", F.concat(F.lit(head), clean_space(c)))
    return F.concat_ws("\n\n", part(title), part(abstract, "Abstract\n"), part(body))


# Header lines of papers that say nothing about the paper, node types that make up a body, and the names
# of sentence types.
BOILERPLATE = "(?i)under review|anonymous author|conference paper at|paper under|double-blind|affiliationaddress|address email|extended abstract track|^editors:"
BODY_NODES = ("article-title", "abstract", "title", "p", "list")
SENTENCE_TYPES = {"title": "title", "article-title": "title", "abstract": "abstract", "paragraph": "p", "p": "p"}


def paragraph_join(paragraphs: Column) -> Column:
    """Paragraphs stripped, blank or null ones left out, one a line."""
    return F.array_join(F.filter(F.transform(paragraphs, strip), lambda p: p != ""), "\n")


def sentence_type(raw: Column) -> Column:
    key = F.lower(clean_space(raw))
    known = F.create_map(*[F.lit(x) for pair in SENTENCE_TYPES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, key), key)


def listlike(raw: Column) -> Column:
    """Strings of a JSON or Python list in a string, cleaned, blank ones left out; anything else gives an empty list.

    A Python list differs from a JSON one by single quotes, which are turned where the text is no JSON list.
    """
    text = strip(raw)
    read = lambda t: F.from_json(t, "array<string>")
    parsed = F.when(~text.startswith("["), F.lit(None)).when(F.json_array_length(text).isNotNull(), read(text)).otherwise(read(F.regexp_replace(text, "'", '"')))
    return clean_list(parsed)


def clean_list(values: Column) -> Column:
    """Strings cleaned, blank and null ones left out; null gives an empty list."""
    kept = F.filter(F.transform(values, clean_space), lambda x: x != "")
    return F.coalesce(kept, F.array().cast("array<string>"))


def paperhash(content: Column) -> Column:
    """The paperhash of a JSON object, cleaned; empty where there is none."""
    return clean_space(F.get_json_object(content, "$.paperhash"))


def surrogate_id(parts: list[Column], text: Column) -> Column:
    """The parts and the first 16 digits of the text's MD5, joined by ``::``; a missing part reads ``<NA>``."""
    return F.concat_ws("::", *[F.coalesce(p.cast("string"), F.lit("<NA>")) for p in parts], F.substring(F.md5(text), 1, 16))


@F.pandas_udf(StringType())
def ascii_fold(text):  # a compatibility decomposition, which no built-in function has
    return text.str.normalize("NFKD").str.encode("ascii", "ignore").str.decode("ascii")


_BOILERPLATE = re.compile(BOILERPLATE.removeprefix("(?i)"), re.IGNORECASE | re.ASCII)
_BOILER_WORDS = tuple(x.removeprefix("^") for x in BOILERPLATE.removeprefix("(?i)").split("|"))


def opening_letters(text: str, n: int) -> str:
    """prefix_fingerprint of one text: lines, and a line's letters, are taken one by one, so those after the n-th letter aren't read."""
    out = ""
    for line in text.split("\n"):
        low = line.lower()
        if low.strip() in ("", "abstract") or any(w in low for w in _BOILER_WORDS) and _BOILERPLATE.search(line):
            continue
        for a in range(0, len(line), 4 * n):
            out += re.sub("[^a-z0-9]", "", unicodedata.normalize("NFKD", line[a : a + 4 * n]).encode("ascii", "ignore").decode().lower())
            if len(out) >= n:
                return out[:n]
    return out


def prefix_fingerprint(text: Column, n: int = 200) -> Column:
    """The first n of the letters a-z and digits of a text's folded lines, but for boilerplate and a lone "Abstract"."""
    return F.pandas_udf(lambda texts: texts.map(lambda t: opening_letters(t or "", n)), "string")(text)


def compose_sentences(sentences: Column) -> Column:
    """Text of ordered (kind, text) structs: a title unless it repeats the entry before, one "Abstract" heading for each run
    of abstract sentences, a blank line after each entry."""
    start = F.struct(F.array().cast("array<string>").alias("lines"), F.lit("").alias("last"))

    def step(held: Column, s: Column) -> Column:
        text = clean_space(s["text"])
        # entries are followed by a blank line, so a title is compared with what stands before that line as a whole
        repeated = F.get(held["lines"], F.size(held["lines"]) - 1) == text
        head = F.when((s["kind"] == "abstract") & (held["last"] != "abstract"), F.array(F.lit("Abstract"))).otherwise(F.array().cast("array<string>"))
        added = F.when((s["kind"] == "title") & F.coalesce(repeated, F.lit(False)), F.array().cast("array<string>")).otherwise(F.concat(head, F.array(text, F.lit(""))))
        last = F.when(s["kind"].isin("title", "abstract"), s["kind"]).otherwise(F.lit("p"))
        return F.when(text == "", held).otherwise(F.struct(F.concat(held["lines"], added).alias("lines"), last.alias("last")))

    return strip(F.array_join(F.aggregate(sentences, start, step)["lines"], "\n"))


def nodes_text(nodes: Column) -> Column:
    """Text of a paper's (ntype, content) nodes in order; every abstract gets its heading."""
    kept = F.filter(nodes, lambda n: n["ntype"].isin(*BODY_NODES) & (strip(n["content"]) != ""))
    entry = lambda n: F.concat(F.when(n["ntype"] == "abstract", F.lit("Abstract\n")).otherwise(F.lit("")), strip(n["content"]))
    return F.array_join(F.transform(kept, entry), "\n\n")


def sentences(text: Column) -> Column:
    """Sentences by a plain rule: an end mark, closing quotes or brackets, white space, then a capital, digit or opening mark.

    New lines count as blanks, as trained splitters have it; abbreviations before a capital do end a sentence here.
    """
    flat = F.regexp_replace(F.coalesce(text, F.lit("")), "[\n\r]", " ")
    cut = F.split(flat, "(?<=[.!?…][\"')\\]]{0,3})\\s+(?=[\"'(\\[]{0,2}[\\p{Lu}\\p{N}])")
    return F.filter(F.transform(cut, strip), lambda x: x != "")


def norm_edit_distance(a: Column, b: Column) -> Column:
    """Levenshtein distance of two token lists over the longer one's length; 0 if both are empty.

    Each distinct token of the pair becomes one code point from a private plane on, so the built-in distance of strings
    counts tokens; tokens are numbered by their place among the pair's distinct ones.
    """

    def code(tokens: Column, known: Column) -> Column:
        # surrogates are left out: 0x4E00.. up to 0xD7FF holds 35,327 tokens, beyond it planes 1 and up follow
        point = F.transform(tokens, lambda t: F.array_position(known, t))
        return F.array_join(F.transform(point, lambda i: F.decode(F.unhex(F.lpad(F.hex(F.when(i < 35000, i + 0x4E00).otherwise(i + 0x10000)), 8, "0")), "UTF-32")), "")

    def both(known: Column) -> Column:
        return F.levenshtein(code(a, known), code(b, known))

    longest = F.greatest(F.size(a), F.size(b))
    return safe_div(bound(F.array_distinct(F.concat(a, b)), both), longest)


def model_slug(name: str) -> str:
    return name.replace("/", "__").translate({ord(":"): "_", ord("@"): "_"})


def sanitize(text: str) -> str:
    """sanitize_piece for a string of the driver."""
    import re

    return re.sub(r"[^a-zA-Z0-9_@.\-:]", "", text.strip().lower().replace(" ", "_"))
