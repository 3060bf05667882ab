"""Katz back-off language model over words, counted, stored and evaluated in partitions.

P(w | h) = d(c) c(h w) / c(h) for n-grams seen in training, else alpha(h) P(w | h'), with h' the shorter history. Orders
1 to 3, no n-gram is left out; d is Good-Turing's discount up to count ``GT_MOST`` and alpha makes each history's
probabilities add up to one. Order 1 gives its discounted mass to one unknown word. Where the discounts leave a
history nothing, half a count is set aside (``left_over``), so every alpha is positive and what it divides by is too:
order 1 keeps mass for the unknown word, order 2 for unseen successors, and neither is ever part of the sum taken off.

How it runs. A chunk is a run of documents in one scan task.
  1. Chunks send their distinct words with counts to parts dealt by a hash; a part numbers its words, the frequent
     ones lowest, and answers each chunk with numbers and training counts. From here on words are integers.
  2. Chunks send every token with its two predecessors to the part of its *middle* word w2. All trigrams over w2 and
     all bigrams from w2 meet there, so counts, discounts, back-off weights and probabilities of both orders need no
     further join. Parts write what they hold once, as counts and the documents of each trigram, without words.
  3. Counts of counts go to the driver (GT_MOST + 1 numbers for each order), then parts turn counts into
     probabilities and add them up by document; a document's sums are added over parts.

Frequent words. A word with more than ``hot`` occurrences is never gathered in one part. As a middle word its tokens
are dealt by w1 as well; where w1 is hot too, by w3, and where all three are, by chunk. So no part gets more than
``hot`` tokens for one key. What such parts count is partial: it is added up by plain grouped sums (partial
aggregation, no group in one row), probabilities are computed there, and joined back to the parts that asked.

Blocks number min(chunks x parts, tokens) and carry a few bytes a token, so the data moved stays in proportion.
Lost executors cost a recomputation from the files or from the tables in the shared folder.

Defined results: null text counts as empty and has the end token only; rows with a null training flag are held out;
repeated rows count as often as they come; an empty table gives an empty result; without training rows every token is
unknown, of probability one; other columns are ignored. Inputs that are not plain scans are written once first, as
chunks are read twice.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import Stored, pick, release, settled

GT_MOST, CHUNK_BYTES, HOT_TOKENS = 5, 6 << 20, 4 << 20
#: Tokens that no word can equal, as words hold no white space.
START, END = "\x0b", "\t"
#: Sums of log probabilities travel as integers of this scale, so that they add up alike in any order.
SCALE = 1 << 24
CLOSED, HALF_OPEN, OPEN, HEAD, COUNTS, BIGRAMS, TRIGRAMS = range(7)


def pack(*arrays: np.ndarray) -> bytes:
    """Non-negative integers as byte planes, compressed; see unpack."""
    import zstandard

    head, body = [len(arrays)], []
    for a in arrays:
        a = np.ascontiguousarray(a, "<i8")
        width = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
        head += [len(a), width]
        body.append(a.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return zstandard.ZstdCompressor(level=1).compress(np.array(head, "<i8").tobytes() + b"".join(body))


def unpack(data: bytes) -> list[np.ndarray]:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data)
    count = int(np.frombuffer(raw, "<i8", 1)[0])
    head = np.frombuffer(raw, "<i8", 2 * count, 8).tolist()
    at, out = 8 + 16 * count, []
    for n, width in zip(head[::2], head[1::2]):
        a = np.zeros((n, 8), np.uint8)
        a[:, :width] = np.frombuffer(raw, np.uint8, n * width, at).reshape(width, n).T
        out.append(a.reshape(-1).view("<i8") if n else np.zeros(0, np.int64))
        at += n * width
    return out


def small(a: np.ndarray) -> np.ndarray:
    """The same integers in four bytes each, where they fit."""
    return a.astype(np.int32) if len(a) == 0 or -(1 << 31) <= int(a.min()) and int(a.max()) < 1 << 31 else a


def dense(*columns: np.ndarray) -> np.ndarray:
    """One integer per row that orders rows by the columns, first column first."""
    out, size = np.zeros(len(columns[0]), np.int64), 1
    for c in columns:
        distinct = np.unique(c)
        if size * max(1, len(distinct)) >= 1 << 62:
            known, out = np.unique(out, return_inverse=True)
            size = len(known)
        out *= max(1, len(distinct))
        out += np.searchsorted(distinct, c)  # less memory than the inverse of unique
        size *= max(1, len(distinct))
    return out


def mix(*columns: np.ndarray) -> np.ndarray:
    """64-bit hash of rows of integers."""
    h = np.full(len(columns[0]), 0x9E3779B97F4A7C15, np.uint64)
    for c in columns:
        h = (h ^ c.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        h ^= h >> np.uint64(32)
    return h


@dataclass
class Chunk:
    """Token ids of a run of documents (each START, words, END); ids are places in ``words``, which are distinct."""

    number: int
    docs: pa.Array
    lengths: np.ndarray
    train: np.ndarray
    ids: np.ndarray
    words: pa.Array


def to_chunk(number: int, docs: pa.Array, train: np.ndarray, texts: pa.Array) -> Chunk:
    cut = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat, sizes = cut.flatten(), np.diff(cut.offsets.to_numpy())
    blank = pc.equal(flat, "").to_numpy(zero_copy_only=False)  # white space at the ends of a text
    if blank.any():
        sizes = np.bincount(np.repeat(np.arange(len(sizes)), sizes)[~blank], minlength=len(sizes))
        flat = flat.filter(pa.array(~blank))
    coded = flat.dictionary_encode()
    words = pa.concat_arrays([coded.dictionary, pa.array([START, END], flat.type)])
    lengths = sizes.astype(np.int64) + 2
    ends = np.cumsum(lengths)
    ids = np.full(int(ends[-1]), -1, np.int64)
    ids[ends - lengths], ids[ends - 1] = len(words) - 2, len(words) - 1
    ids[ids < 0] = coded.indices.to_numpy()
    return Chunk(number, docs, lengths, train, ids, words)


def read_chunks(batches: Iterator[pa.RecordBatch], chunk_bytes: int) -> Iterator[Chunk]:
    """Batches of (doc_id, train, text). The same rows in the same task always make the same chunks."""
    from pyspark import TaskContext

    context = TaskContext.get()
    number = (context.partitionId() if context else 0) << 20
    held: list[pa.RecordBatch] = []
    size = 0

    def close() -> Chunk:
        docs, train, texts = (pa.concat_arrays([b.column(i) for b in held]) for i in range(3))
        return to_chunk(number, docs, train.to_numpy(zero_copy_only=False).astype(bool), pc.fill_null(texts, ""))

    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column(2)), 0).to_numpy())
        begin = 0
        while begin < batch.num_rows:
            before = int(sizes[begin - 1]) if begin else 0
            end = min(batch.num_rows, int(np.searchsorted(sizes, before + chunk_bytes - size)) + 1)
            held.append(batch.slice(begin, end - begin))
            size += int(sizes[end - 1]) - before
            begin = end
            if size >= chunk_bytes:
                yield close()
                number, held, size = number + 1, [], 0
    if held:
        yield close()


def _table(names: list[str], types: list[pa.DataType], **columns) -> pa.Table:
    """Columns that are not given are null; a scalar goes to every row."""
    n = max((len(c) for c in columns.values() if not np.isscalar(c)), default=0)
    get = lambda k, t: pa.nulls(n, t) if k not in columns else pa.array([columns[k]] * n if np.isscalar(columns[k]) else columns[k], t)
    return pa.table([get(k, t) for k, t in zip(names, types)], names=names)


# Step 1: words become integers.


def _dealt(chunk: Chunk, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """(the words' places by part, a chunk's frequent words first, where each part begins): the order of word blocks and of the
    answers to them."""
    part = np.fromiter((zlib.crc32(w.encode()) for w in chunk.words.to_pylist()), np.int64, len(chunk.words)) % parts
    by = np.lexsort((-np.bincount(chunk.ids, minlength=len(part)), part))
    return by, np.searchsorted(part[by], np.arange(parts + 1))


def _word_blocks(docs: DataFrame, parts: int, chunk_bytes: int) -> DataFrame:
    names, types = ["part", "chunk", "items", "sizes"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()]

    def run(batches):
        import zstandard

        for chunk in read_chunks(batches, chunk_bytes):
            by, bounds = _dealt(chunk, parts)
            in_train = np.repeat(chunk.train, chunk.lengths)
            every, train = (np.bincount(x, minlength=len(by))[by] for x in (chunk.ids, chunk.ids[in_train]))
            items = chunk.words.take(pa.array(by)).cast(pa.large_string())
            sizes = pc.binary_length(items).to_numpy()
            offsets = np.concatenate([[0], np.cumsum(sizes)])
            data = items.buffers()[2].to_pybytes()
            some = np.flatnonzero(np.diff(bounds))
            packed = [zstandard.ZstdCompressor(level=1).compress(data[offsets[bounds[p]] : offsets[bounds[p + 1]]]) for p in some]
            counts = [pack(sizes[bounds[p] : bounds[p + 1]], train[bounds[p] : bounds[p + 1]], every[bounds[p] : bounds[p + 1]]) for p in some]
            yield from _table(names, types, part=some, chunk=np.full(len(some), chunk.number), items=packed, sizes=counts).to_batches()

    return docs.mapInArrow(run, "part int, chunk bigint, items binary, sizes binary")


def _number_words(blocks: DataFrame, parts: int, hot: int) -> DataFrame:
    """Answers (part, chunk, answer: numbers, training counts, hot flags) and, with null part, (r, n): n training words of count r,
    0 for all, -1 for their tokens."""
    names, types = ["part", "chunk", "answer", "r", "n"], [pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.int64()]

    def run(table: pa.Table) -> pa.Table:
        import zstandard

        part = table["part"][0].as_py()
        held = [unpack(s.as_py()) for s in table["sizes"]]
        items = []
        for (sizes, _, _), z in zip(held, table["items"]):
            offsets = pa.py_buffer(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64))
            items.append(pa.LargeStringArray.from_buffers(len(sizes), offsets, pa.py_buffer(zstandard.ZstdDecompressor().decompress(z.as_py()))))
        coded = pa.concat_arrays(items).dictionary_encode()
        code = coded.indices.to_numpy()
        train, every = (np.bincount(code, np.concatenate([h[k] for h in held])).astype(np.int64) for k in (1, 2))
        number = np.empty(len(train), np.int64)
        number[np.argsort(-every, kind="stable")] = np.arange(len(train)) * parts + part
        is_hot = (every > hot).astype(np.int64)
        cuts = np.cumsum([0, *(len(h[0]) for h in held)])
        answers = [pack(number[c], train[c], is_hot[c]) for c in (code[a:b] for a, b in zip(cuts, cuts[1:]))]
        real = train[pc.not_equal(coded.dictionary, START).to_numpy(zero_copy_only=False)]
        r = [0, -1, *range(1, GT_MOST + 2)]
        n = [int((real > 0).sum()), int(real.sum()), *(int((real == k).sum()) for k in range(1, GT_MOST + 2))]
        return pa.concat_tables([_table(names, types, part=np.full(len(answers), part), chunk=table["chunk"].to_numpy(), answer=answers), _table(names, types, r=r, n=n)])

    return blocks.groupBy("part").applyInArrow(run, "part int, chunk bigint, answer binary, r bigint, n bigint")


# The model's numbers.


def good_turing(n: dict[int, int], most: int = GT_MOST) -> np.ndarray:
    """Discounts for counts 0..most from counts of counts; where they are irregular, (r - 1/2) / r. Place 0 is unused."""
    out = np.ones(most + 1)
    common = (most + 1) * n.get(most + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, most + 1):
        d = -1.0
        if n.get(r) and common < 1:
            d = ((r + 1) * n.get(r + 1, 0) / n[r] / r - common) / (1 - common)
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


def left_over(discounted: np.ndarray, count: np.ndarray) -> np.ndarray:
    """What discounted counts are multiplied by, so that half a count at least is left of each history's ``count``."""
    most = np.maximum(count - 0.5, 0)
    return np.where(discounted > most, most / np.maximum(discounted, 1e-300), 1.0)


@dataclass
class Unigrams:
    """P1 by training count: discounted counts over N; ``unknown`` is the mass left for the unknown word."""

    tokens: int
    types: int
    discounts: np.ndarray
    scale: float
    unknown: float

    @classmethod
    def of(cls, n: dict[int, int]) -> Unigrams:
        tokens, d = n.get(-1, 0), good_turing(n)
        kept = tokens - sum((1 - d[r]) * r * n.get(r, 0) for r in range(1, GT_MOST + 1))
        scale = float(left_over(np.array([kept]), np.array([tokens]))[0])
        return cls(tokens, n.get(0, 0), d, scale, 1 - kept * scale / tokens if tokens else 1.0)

    def p(self, c: np.ndarray) -> np.ndarray:
        d = np.where(c <= GT_MOST, self.discounts[np.minimum(c, GT_MOST)], 1.0)
        return np.where(c > 0, d * c * self.scale / max(self.tokens, 1), self.unknown)


def level(c: np.ndarray, group: np.ndarray, lower: np.ndarray, d: np.ndarray, counted: np.ndarray | None = None) -> np.ndarray:
    """Probabilities of n-grams from training counts, the number of their history and the lower order's probabilities.

    ``counted`` says which rows belong in sums over a history (each of its n-grams once); all do by default.
    """
    size = int(group.max()) + 1 if len(group) else 0
    seen = c > 0 if counted is None else (c > 0) & counted
    value = np.where(c <= GT_MOST, d[np.minimum(c, GT_MOST)], 1.0) * c
    add = lambda x: np.bincount(group[seen], x[seen], size)
    count, hi, lo = add(c), add(value), add(lower)
    scale = left_over(hi, count)
    alpha = np.where(count > 0, (1 - hi * scale / np.maximum(count, 1)) / (1 - lo), 1.0)
    return np.where(c > 0, value * (scale / np.maximum(count, 1))[group], alpha[group] * lower)


# Step 2: tokens meet in the part of their middle word.


def _held(id_type: pa.DataType) -> tuple[list[str], list[pa.DataType]]:
    names = ["kind", "part", "w1", "w2", "w3", "c", "x", "docs", "data"]
    return names, [pa.int32(), pa.int32(), *[pa.int64()] * 5, pa.list_(id_type), pa.binary()]


def _streams(docs: DataFrame, id_type: pa.DataType, parts: int, chunk_bytes: int) -> DataFrame:
    """(chunk, docs, data: lengths, training flags, token ids): an id is the word's place in its part times parts plus the part, so
    frequent words have small ids, which pack well."""
    names, types = ["chunk", "docs", "data"], [pa.int64(), pa.list_(id_type), pa.binary()]

    def run(batches):
        for c in read_chunks(batches, chunk_bytes):
            by, bounds = _dealt(c, parts)
            part = np.repeat(np.arange(parts), np.diff(bounds))
            place = np.empty(len(by), np.int64)
            place[by] = (np.arange(len(by)) - bounds[part]) * parts + part
            data = pack(c.lengths, c.train.astype(np.int64), place[c.ids])
            yield from _table(names, types, chunk=[c.number], docs=[c.docs.to_pylist()], data=[data]).to_batches()

    return docs.mapInArrow(run, f"chunk bigint, docs {_list_sql(docs)}, data binary")


def _list_sql(docs: DataFrame) -> str:
    return f"array<{docs.schema['doc_id'].dataType.simpleString()}>"


def _deal_tokens(streams: DataFrame, answers: DataFrame, id_type: pa.DataType, parts: int, uni: Unigrams) -> DataFrame:
    """Blocks of tokens by part, and a HEAD row for each chunk: document ids, n_tokens, n_known, base."""
    names, types = _held(id_type)
    total = float(uni.tokens + uni.types + 1)

    def run(stream: pa.Table, answer: pa.Table) -> pa.Table:
        if not len(stream):
            return _table(names, types)
        chunk = stream["chunk"][0].as_py()
        lengths, train, ids = unpack(stream["data"][0].as_py())
        answer = answer.sort_by("part")
        told = [unpack(a.as_py()) for a in answer["answer"]]
        begin = np.zeros(parts, np.int64)
        begin[answer["part"].to_numpy()] = np.cumsum([0, *(len(t[0]) for t in told[:-1])])
        ids = begin[ids % parts] + ids // parts
        number, count, is_hot = (np.concatenate([t[k] for t in told]) for k in range(3))
        is_hot = is_hot > 0
        first = np.cumsum(lengths) - lengths
        doc = np.repeat(np.arange(len(lengths)), lengths)
        token = np.ones(len(ids), bool)
        token[first] = False
        base = np.add.reduceat(np.where(token, np.log10((count[ids] + 1) / total), 0), first)
        known = np.add.reduceat(token & (count[ids] > 0), first)
        head = pack(lengths - 1, known.astype(np.int64), np.rint(-base * SCALE).astype(np.int64))

        at = np.flatnonzero(token)
        none = ~token[at - 1]
        l3, l2, l1 = ids[at], ids[at - 1], np.where(none, 0, ids[at - 2])
        w1 = np.where(none, 0, number[l1] + 1)
        hot1, hot2, hot3 = none | is_hot[l1], is_hot[l2], is_hot[l3]
        mode = np.where(hot2, np.where(hot1, OPEN, HALF_OPEN), CLOSED)
        part = mix(number)[l2]
        some = np.flatnonzero(hot2)
        if len(some):
            w2, w3, spread = number[l2[some]], np.where(hot1[some], number[l3[some]] + 1, 0), np.where(hot1 & hot3, chunk + 1, 0)[some]
            part[some] = mix(w1[some], w2, w3, spread)
        part = (part % np.uint64(parts)).astype(np.int64)
        rank = np.empty(len(number), np.int64)
        rank[np.argsort(number)] = np.arange(len(number))
        box, n = part * 3 + mode, len(number)
        order = np.argsort((box * n + rank[l2]) * n + rank[l3] if 3 * parts * n * n < 1 << 62 else dense(box, rank[l2], rank[l3]))
        box, w1, l2, l3 = box[order], w1[order], l2[order], l3[order]
        w2, w3 = number[l2], number[l3]
        doc = doc[at][order]
        tag = doc * 2 + train[doc]
        starts = np.flatnonzero(np.diff(box, prepend=-1))
        step = np.where(np.diff(w2, prepend=-1) == 0, np.diff(w3, prepend=0), w3)  # w3 rises within a w2
        data = []
        for a, b in zip(starts, [*starts[1:], len(box)]):
            step[a] = w3[a]
            words = np.unique(l3[a:b])
            words = words[np.argsort(number[words])]
            data.append(pack(np.diff(w2[a:b], prepend=0), step[a:b], w1[a:b], tag[a:b], count[words]))
        blocks = _table(names, types, kind=box[starts] % 3, part=box[starts] // 3, x=np.full(len(starts), chunk), data=data)
        return pa.concat_tables([blocks, _table(names, types, kind=[HEAD], part=[chunk % parts], x=[chunk], docs=[stream["docs"][0].as_py()], data=[head])])

    return streams.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(run, _held_sql(streams))


def _held_sql(df: DataFrame) -> str:
    return f"kind int, part int, w1 bigint, w2 bigint, w3 bigint, c bigint, x bigint, docs {df.schema['docs'].dataType.simpleString()}, data binary"


def _runs(code: np.ndarray) -> np.ndarray:
    """Where runs of equal values begin."""
    return np.flatnonzero(np.diff(code, prepend=code[0] - 1)) if len(code) else np.zeros(0, np.int64)


def _sizes(starts: np.ndarray, end: int) -> np.ndarray:
    return np.diff(starts, append=end)


def _gather(blocks: DataFrame, id_type: pa.DataType) -> DataFrame:
    """What a part holds, by kind: a packed table of each mode, HEAD rows passed on, COUNTS (order c: x n-grams of count w1),
    and the partial counts of open bigrams and trigrams."""
    names, types = _held(id_type)

    def run(table: pa.Table) -> pa.Table:
        part = table["part"][0].as_py()
        kinds = table["kind"].to_numpy()
        out = [table.filter(pa.array(kinds == HEAD))]
        stats = np.zeros((4, GT_MOST + 2), np.int64)

        def count(order: int, c: np.ndarray) -> None:
            stats[order] += np.bincount(c[c <= GT_MOST + 1], minlength=GT_MOST + 2)

        for mode in (CLOSED, HALF_OPEN, OPEN):
            own = table.filter(pa.array(kinds == mode))
            if not len(own):
                continue
            columns: list[list[np.ndarray]] = [[] for _ in range(6)]
            chunks, at = np.unique(own["x"].to_numpy(), return_inverse=True)
            for place, data in zip(at, own["data"]):
                w2, step, w1, tag, counts = unpack(data.as_py())
                fresh = w2 > 0
                fresh[0] = True
                w2, total = np.cumsum(w2), np.cumsum(step)
                w3 = total - (total - step)[fresh][np.cumsum(fresh) - 1]  # sums within runs of one w2
                c1 = counts[np.unique(w3, return_inverse=True)[1]]
                for held, x in zip(columns, (w2, w3, w1, tag, c1, np.full(len(w2), place))):
                    held.append(small(x))
            del own
            w1, w3, w2 = np.concatenate(columns[2]), np.concatenate(columns[1]), np.concatenate(columns[0])
            del columns[:3]
            code = dense(w2, w3, w1)
            order = np.argsort(code)
            starts = _runs(code[order])
            del code
            tag, c1, chunk = (np.concatenate(c) for c in columns)
            columns.clear()
            c3 = np.add.reduceat(tag[order] & 1, starts)
            tri = order[starts]
            t1, t2, t3 = w1[tri], w2[tri], w3[tri]
            bi = np.flatnonzero((np.diff(t2, prepend=-1) != 0) | (np.diff(t3, prepend=-1) != 0))
            words = _runs(t2[bi])
            history = np.unique(dense(t2, t1), return_inverse=True)[1]
            lowest = np.minimum.reduceat(history, bi[words])
            local = history - np.repeat(lowest, _sizes(bi[words], len(tri)))
            c23 = np.add.reduceat(c3, bi)
            if mode == CLOSED:
                count(2, c23)
                own_words = [np.zeros(0, np.int64)] * 3
            else:
                own_words = [t1, t2[bi], t3[bi]]
                out.append(_table(names, types, kind=np.full(len(bi), BIGRAMS), part=np.full(len(bi), part), w2=t2[bi], w3=t3[bi], c=c23, x=c1[tri][bi]))
            if mode == OPEN:
                three = t1 > 0
                out.append(_table(names, types, kind=np.full(int(three.sum()), TRIGRAMS), part=np.full(int(three.sum()), part), w1=t1[three], w2=t2[three], w3=t3[three], c=c3[three]))
            else:
                count(3, c3[t1 > 0])
            data = pack(_sizes(words, len(bi)), _sizes(bi, len(tri)), c1[tri][bi], local, (t1 == 0).astype(np.int64), c3, _sizes(starts, len(order)), chunk[order], tag[order] >> 1, chunks, *own_words)
            out.append(_table(names, types, kind=[mode], part=[part], data=[data]))
        some = np.argwhere(stats[:, 1:])
        out.append(_table(names, types, kind=np.full(len(some), COUNTS), part=np.full(len(some), part), c=some[:, 0], w1=some[:, 1] + 1, x=[stats[o, r + 1] for o, r in some]))
        return pa.concat_tables(out)

    return blocks.groupBy("part").applyInArrow(run, _held_sql(blocks))


# Step 3: counts become probabilities.

_SUMS = "chunk bigint, data binary"


def _sum_up(data: bytes, d2: np.ndarray, d3: np.ndarray, uni: Unigrams, told=None) -> pa.Table:
    """Sums of -log10 P by chunk and document of one packed table; ``told`` has the probabilities of open n-grams."""
    per_word, per_bigram, c1, local, none, c3, k, chunk, doc, chunks, t1, b2, b3 = unpack(data)
    bigram = np.repeat(np.arange(len(per_bigram)), per_bigram)
    word = np.repeat(np.arange(len(per_word)), per_word)
    three = none == 0
    if told is None:
        p2 = level(np.bincount(bigram, c3, len(c1)).astype(np.int64), word, uni.p(c1), d2)
    else:
        p2 = told.two(b2, b3)
    p = p2[bigram]
    if told is None or not told.three:
        starts = np.cumsum(per_bigram) - per_bigram
        per = np.maximum.reduceat(local, starts[np.cumsum(per_word) - per_word]) + 1
        history = local + (np.cumsum(per) - per)[word[bigram]]
        p[three] = level(c3[three], history[three], p[three], d3)
    else:
        p[three] = told.all(t1[three], b2[bigram][three], b3[bigram][three])
    cost = np.repeat(np.rint(np.maximum(-np.log10(p), 0) * SCALE), k)
    width = int(doc.max()) + 1
    key = chunk * width + doc
    if len(chunks) * width <= 8 * len(key):
        sums = np.bincount(key, cost, len(chunks) * width)
        keys = np.flatnonzero(np.bincount(key, minlength=len(sums)))
        sums = sums[keys]
    else:
        keys, inverse = np.unique(key, return_inverse=True)
        sums = np.bincount(inverse, cost)
    cuts = np.searchsorted(keys // width, np.arange(len(chunks) + 1))
    packed = [pack(np.diff(keys[a:b] % width, prepend=0), sums[a:b].astype(np.int64)) for a, b in zip(cuts, cuts[1:])]
    return _table(["chunk", "data"], [pa.int64(), pa.binary()], chunk=chunks, data=packed)


class _Told:
    """Probabilities that were computed for open n-grams: bigrams have w1 = -1."""

    def __init__(self, answers: pa.Table, three: bool):
        self.three = three
        columns = [answers[c].to_numpy() for c in ("w1", "w2", "w3", "p")]
        pairs = columns[0] < 0
        self.pairs, self.rest = [c[pairs] for c in columns], [c[~pairs] for c in columns]

    @staticmethod
    def _look(known: list[np.ndarray], p: np.ndarray, asked: list[np.ndarray]) -> np.ndarray:
        code = dense(*(np.concatenate([a, b]) for a, b in zip(known, asked)))
        by = np.argsort(code[: len(p)])
        return p[by[np.searchsorted(code[: len(p)][by], code[len(p) :])]]

    def two(self, w2, w3):
        return self._look(self.pairs[1:3], self.pairs[3], [w2, w3])

    def all(self, w1, w2, w3):
        return self._look(self.rest[:3], self.rest[3], [w1, w2, w3]) if len(w1) else np.zeros(0)


def _cases(c: Column, d: np.ndarray, other: Column) -> Column:
    for r in range(1, len(d)):
        other = F.when(c == r, F.lit(float(d[r]))).otherwise(other)
    return other


def _open_level(counted: DataFrame, keys: list[str], history: list[str], d: np.ndarray, few: bool) -> DataFrame:
    """keys, p from keys, c and the lower order's probability ``low``: level() over rows, histories summed up by partial aggregation."""
    value = _cases(F.col("c"), d, F.lit(1.0)) * F.col("c")
    sums = counted.where("c > 0").groupBy(*history).agg(F.sum(value).alias("hi"), F.sum("c").alias("n"), F.sum("low").alias("lo"))
    most = F.col("n") - 0.5
    scale = F.when(F.col("hi") > most, most / F.col("hi")).otherwise(1.0)
    sums = sums.select(*history, scale.alias("scale"), "n", ((1 - F.col("hi") * scale / F.col("n")) / (1 - F.col("lo"))).alias("alpha"))
    p = F.when(F.col("c") > 0, value * F.col("scale") / F.col("n")).otherwise(F.coalesce("alpha", F.lit(1.0)) * F.col("low"))
    return counted.join(F.broadcast(sums) if few else sums, history, "left").select(*keys, p.alias("p"))


def _open_answers(held: DataFrame, two: DataFrame, three: DataFrame, d2: np.ndarray, d3: np.ndarray, uni: Unigrams, few: bool) -> DataFrame:
    """part, w1 (-1 for bigrams), w2, w3, p for every open n-gram that a part holds."""
    every = F.when(F.col("x") > 0, _cases(F.col("x"), uni.discounts, F.lit(1.0)) * F.col("x") * (uni.scale / max(uni.tokens, 1))).otherwise(F.lit(float(uni.unknown)))
    p2 = Stored(_open_level(two.withColumn("low", every), ["w2", "w3"], ["w2"], d2, few), "katz-open-2").df
    low = three.join(p2.withColumnRenamed("p", "low"), ["w2", "w3"])
    p3 = _open_level(low, ["w1", "w2", "w3"], ["w1", "w2"], d3, False)
    asked2 = held.where(F.col("kind") == BIGRAMS).select("part", "w2", "w3").distinct().join(p2, ["w2", "w3"]).select("part", F.lit(-1).cast("bigint").alias("w1"), "w2", "w3", "p")
    asked3 = held.where(F.col("kind") == TRIGRAMS).select("part", "w1", "w2", "w3").join(p3, ["w1", "w2", "w3"]).select("part", "w1", "w2", "w3", "p")
    return asked2.unionByName(asked3)


def _counts_of(df: DataFrame) -> dict[int, int]:
    rows = df.where(F.col("c").between(1, GT_MOST + 1)).groupBy("c").count().collect()  # GT_MOST + 1 rows at most
    return {r["c"]: r["count"] for r in rows}


def score_katz(df: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES, hot: int = HOT_TOKENS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score for every row; ``train`` is an SQL condition on ``df``.

    base_score is the sum of log10((c + 1) / (N + V + 1)), score the sum of log10 P; both to about 1e-7.
    """
    spark = df.sparkSession
    flag = F.coalesce(F.expr(train), F.lit(False)).alias("train")
    docs = pick(settled(df.withColumn("train flag of katz", flag)), doc_id=id_col, train="train flag of katz", text=text_col)
    scans = docs._jdf.queryExecution().toRdd().getNumPartitions()
    parts = max(8, 4 * scans, int(spark.conf.get("spark.sql.shuffle.partitions")))
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(docs.schema["doc_id"].dataType)
    answers = Stored(_number_words(_word_blocks(docs, parts, chunk_bytes), parts, hot), "katz-words").df
    uni = Unigrams.of({r["r"]: r["n"] for r in answers.where("part IS NULL").groupBy("r").agg(F.sum("n").alias("n")).collect()})  # GT_MOST + 3 rows
    told = answers.where("part IS NOT NULL").select("part", "chunk", "answer")
    release(spark)
    held = Stored(_gather(_deal_tokens(_streams(docs, id_type, parts, chunk_bytes), told, id_type, parts, uni), id_type), "katz-held", ("kind",)).df
    release(spark)
    n = {(r["c"], r["w1"]): r["x"] for r in held.where(F.col("kind") == COUNTS).groupBy("c", "w1").agg(F.sum("x").alias("x")).collect()}  # 2 * (GT_MOST + 1) rows
    n2, n3 = ({r: n.get((order, r), 0) for r in range(1, GT_MOST + 2)} for order in (2, 3))
    is_open = not held.where(F.col("kind") == BIGRAMS).isEmpty()
    if is_open:
        two = Stored(held.where(F.col("kind") == BIGRAMS).groupBy("w2", "w3").agg(F.sum("c").alias("c"), F.first("x").alias("x")), "katz-open-counts").df
        three = Stored(held.where(F.col("kind") == TRIGRAMS).groupBy("w1", "w2", "w3").agg(F.sum("c").alias("c")), "katz-open-counts").df
        for own, more in ((n2, _counts_of(two)), (n3, _counts_of(three))):
            for r, x in more.items():
                own[r] += x
    d2, d3 = good_turing(n2), good_turing(n3)

    def close(batches):
        for batch in batches:
            for data in batch.column(0):
                yield from _sum_up(data.as_py(), d2, d3, uni).to_batches()

    def close_open(own: pa.Table, answer: pa.Table) -> pa.Table:
        done = [_sum_up(row["data"], d2, d3, uni, _Told(answer, row["kind"] == OPEN)) for row in own.select(["kind", "data"]).to_pylist()]
        return pa.concat_tables(done) if done else _table(["chunk", "data"], [pa.int64(), pa.binary()])

    sums = held.where(F.col("kind") == CLOSED).select("data").mapInArrow(close, _SUMS)
    if is_open:
        few = uni.tokens / max(hot, 1) < 1_000_000  # hot words, each with one history row, are tokens / hot at most
        open_answers = _open_answers(held, two, three, d2, d3, uni, few)
        own = held.where(F.col("kind").isin(HALF_OPEN, OPEN)).select((F.col("part") + 0).alias("at"), "kind", "data")
        sums = sums.unionByName(own.groupBy("at").cogroup(open_answers.groupBy("part")).applyInArrow(close_open, _SUMS))
    heads = held.where(F.col("kind") == HEAD).select(F.col("x").alias("chunk"), "docs", "data")
    tokens = uni.tokens
    names, types = ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"], [id_type, *[pa.int64()] * 3, pa.float64(), pa.float64()]

    def finish(rows: pa.Table) -> pa.Table:
        is_head = pc.is_valid(rows["docs"])
        head, rest = rows.filter(is_head), rows.filter(pc.invert(is_head))
        docs = head["docs"].combine_chunks().flatten()
        n_tokens, n_known, base = unpack(head["data"][0].as_py())
        cost = np.zeros(len(n_tokens))
        for data in rest["data"]:
            doc, own = unpack(data.as_py())
            cost[np.cumsum(doc)] += own
        # 0.0 - x, so that nothing is -0.0
        return pa.table([docs.cast(id_type), pa.array(n_tokens), pa.array(n_known), pa.array(np.full(len(docs), tokens)), pa.array(0.0 - base / SCALE), pa.array(0.0 - cost / SCALE)], names=names)

    every = heads.unionByName(sums.select("chunk", F.lit(None).cast(heads.schema["docs"].dataType).alias("docs"), "data"))
    id_sql = docs.schema["doc_id"].dataType.simpleString()
    return every.groupBy("chunk").applyInArrow(finish, f"doc_id {id_sql}, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double")
