"""Sequence packing: first-fit decreasing with a tournament tree of bin capacities, in randomised groups.

Texts become token ids once, in the scan's own tasks; only (row, start, length) cross the network afterwards.
Rows are dealt into groups by a seeded hash of a per-row number, so that groups have about ``group_docs`` documents
whatever ids repeat. Within a group the pieces are placed longest first, each into the first bin with room, found
by descending a tournament tree whose nodes hold the largest free capacity below them. Pieces as long as a sequence
are whole sequences themselves.

Defined results: null text counts as empty and still has its end id; an empty table gives an empty result; repeated
rows are packed separately; other columns are ignored; a null id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import pick

SEQUENCE_TOKENS = 2048
END_ID = 1
GROUP_DOCS = 4096
SPECIAL = "<|endoftext|>"
#: Text encoded at a time.
SLICE_BYTES = 8 << 20


class Encoder:
    """texts -> ids as little-endian 32-bit arrays, with the ids of the tokenizer file's own library.

    The byte-level pre-tokenizer never joins across a single space that stands between two other characters, so
    plain texts are cut there and each distinct unit of a batch is encoded once, all in a single call, by the same
    vocabulary given as ranks. Texts with other white space are encoded whole by the ranks, and a text that holds
    the special string goes to the tokenizer itself.
    """

    def __init__(self, tokenizer_path: str, ranks_path: str):
        import base64

        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(tokenizer_path)
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.widths = np.zeros(max(ranks.values()) + 1, np.int64)
        for token, i in ranks.items():
            self.widths[i] = len(token)
        self.ranks = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def whole(self, text: str) -> np.ndarray:
        if SPECIAL in text:
            return np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4")
        return self.ranks.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False) if text else np.zeros(0, "<u4")

    def plain(self, texts: pa.Array) -> list[np.ndarray]:
        parts = pc.split_pattern(texts, " ")
        offsets, coded = parts.offsets.to_numpy(), parts.flatten().dictionary_encode()
        units, at = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        joined = " " + " ".join(units)
        ids = self.whole(joined)
        starts = np.flatnonzero(np.frombuffer(joined.encode(), np.uint8) == 32)
        token_starts = np.concatenate([[0], np.cumsum(self.widths[ids])])
        cuts = np.append(np.searchsorted(token_starts, starts), len(ids))
        counts = np.diff(cuts)[at]
        counts[offsets[:-1]] = 0  # a text's first unit has no space before it
        ends = np.cumsum(counts)
        flat = ids[np.repeat(cuts[:-1][at] - ends + counts, counts) + np.arange(ends[-1])]
        bounds = np.concatenate([[0], ends])[offsets]
        heads = [self.whole(units[i]) for i in at[offsets[:-1]]]
        return [np.concatenate([h, flat[a:b]]) for h, a, b in zip(heads, bounds, bounds[1:])]

    def encode_batch(self, texts: pa.Array) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty. Slices of about SLICE_BYTES bound the memory."""
        texts = pc.fill_null(texts, "")
        sizes = np.cumsum(pc.binary_length(texts).to_numpy())
        begin = 0
        while begin < len(texts):
            end = max(begin + 1, int(np.searchsorted(sizes, (sizes[begin - 1] if begin else 0) + SLICE_BYTES)))
            part = texts.slice(begin, end - begin)
            odd = pc.or_(pc.equal(part, ""), pc.match_substring_regex(part, _NOT_PLAIN))
            plain = part.filter(pc.invert(odd))
            made = iter(self.plain(plain) if len(plain) else ())
            for i, is_odd in enumerate(odd.to_pylist()):
                yield self.whole(part[i].as_py()) if is_odd else next(made)
            begin = end


#: A space beside other white space or at an end, rarer white space, or the special string.
_NOT_PLAIN = r"^ | $|  |\n | \n|[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|<\|endoftext\|>"
_ENCODERS: dict[tuple, Encoder] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def _pieces(paths: tuple[str, str] | None, size: int, end_id: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = paths or default_paths()
        enc = _ENCODERS.setdefault(key, None) or Encoder(*key)
        _ENCODERS[key] = enc
        end = np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            texts = batch.column(2)
            for rid, doc_id, coded in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), enc.encode_batch(texts)):
                ids = coded.tobytes() + end
                total = len(ids) // 4
                for start in range(0, total, size):
                    piece = ids[4 * start : 4 * (start + size)]
                    rows.append((rid, doc_id, start, len(piece) // 4, zlib.crc32(piece), total, piece if keep_ids else None))
            yield rows, batch.column(1).type

    return run


_OUT = ("rid", "doc_id", "start", "length", "ids_crc32", "doc_tokens")


def tokenised_pieces(df: DataFrame, id_col: str, text_col: str, sequence_tokens: int, end_id: int, paths: tuple[str, str] | None, with_ids: bool = False) -> DataFrame:
    """One row per piece: rid, doc_id, start, length, ids_crc32, doc_tokens, and the ids themselves if asked for."""
    docs = pick(df, doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    cut = _pieces(paths, sequence_tokens, end_id, with_ids)
    names = [*_OUT, "ids"] if with_ids else list(_OUT)

    def run(batches):
        for rows, id_type in cut(batches):
            types = [pa.int64(), id_type, *[pa.int64()] * 4, pa.binary()][: len(names)]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)

    id_type = docs.schema["doc_id"].dataType.simpleString()
    return docs.mapInArrow(run, f"rid bigint, doc_id {id_type}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint" + ", ids binary" * with_ids)


class TournamentTree:
    """Free capacity of bins in opening order; ``first_fit`` finds the first bin with room in log steps."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.best = [capacity] * (2 * self.leaves)

    def first_fit(self, need: int) -> int:
        best, at = self.best, 1
        while at < self.leaves:
            at *= 2
            if best[at] < need:
                at += 1
        best[at] -= need
        found = at - self.leaves
        at //= 2
        while at:
            top = max(best[2 * at], best[2 * at + 1])
            if best[at] == top:
                break
            best[at] = top
            at //= 2
        return found


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) for each piece; pieces of equal length keep their order."""
    order = np.argsort(-lengths, kind="stable")
    tree = TournamentTree(max(1, len(lengths)), capacity)
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    fill: dict[int, int] = {}
    for i, need in zip(order.tolist(), lengths[order].tolist()):
        b = tree.first_fit(need)
        bins[i], offsets[i] = b, fill.get(b, 0)
        fill[b] = fill.get(b, 0) + need
    return bins, offsets


def pack_sequences(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    sequence_tokens: int = SEQUENCE_TOKENS,
    end_id: int = END_ID,
    group_docs: int = GROUP_DOCS,
    seed: int = 17,
    paths: tuple[str, str] | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """Pieces with their sequence_id and offset. Groups: about ``group_docs`` rows each, dealt at random by ``seed``.

    ``paths``: the tokenizer's file and the same vocabulary as ranks. ``with_ids`` adds each piece's ids.
    """
    groups = max(1, -(-df.count() // group_docs))
    pieces = tokenised_pieces(df, id_col, text_col, sequence_tokens, end_id, paths, with_ids)
    dealt = pieces.withColumn("grp", F.pmod(F.xxhash64(F.lit(seed), "rid"), F.lit(groups)))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema) + ", sequence_id bigint, offset bigint"

    def place(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["rid", "start"], kind="stable")
        bins, offsets = first_fit_decreasing(pdf["length"].to_numpy(), sequence_tokens)
        base = int(pdf["grp"].iloc[0]) << 32
        return pdf.drop(columns="grp").assign(sequence_id=base + bins, offset=offsets)

    return dealt.groupBy("grp").applyInPandas(place, schema)
