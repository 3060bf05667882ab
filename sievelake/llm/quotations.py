"""Quotation linking: conversations in reply order, with quoted passages replaced by links.

Lines that begin with '>' marks are quoted, at the level of the number of marks; an attribution line just before a
quote ("... wrote:") belongs to it. Passages are runs of lines of one level between blank lines. A passage's key is
the SHA-256 of its text in lower case with single spaces, so it survives re-wrapping.

Every message's own passages are indexed by key: their first message in the conversation, and the first of the two
least conversations anywhere, one of which is not the quoting one. One row per key and conversation is all that joins
see, so a passage common to many messages does not multiply. A quoted passage is linked to the first own occurrence in
its conversation before the quoting message, else to the first in another conversation.

Lines and sentences are indexed besides, by 16 bytes of their own SHA-256. A quoted passage that is no whole passage of
any message is linked by its longest part that is a line, sentence or passage of one: in its conversation if there is
such a part, else elsewhere. Parts of less than LEAST_PART characters count only where they are all of the quote.

A message replies to the message of its longest linked passage of the lowest level; one without links
replies to the message before it.

Reply order. A message that replies to one of its own conversation by a link starts a branch, one level deeper than what
it quotes; messages after it without such a link stay in its branch. Messages are ordered by level, then position, so
each comes after what it answers and a conversation is read breadth first. Levels come from doubling: every round a
branch looks as far up again as it has so far, so rounds are the logarithm of the nesting.

A conversation may hold a third of all rows, or have one turn number throughout, so rows are ranked by ranges of
conversation and order, and no conversation is gathered into one row or task. Replies come after what they answer, since a link always points to
an earlier position or another conversation.

Defined results: null text is empty; null conversation ids form one conversation; null turns come last; equal turns are
ordered by role and text; turns in strings are ordered by their number, those that are none after all numbers; repeated
rows stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.llm.common import Stored, pick, settled
from sievelake.operators.ranks import row_numbers

_MARKS = re.compile(r"[ \t]*((?:>[ \t]?)+)")
_SENTENCE_END = re.compile(r"(?<=[.!?…])\s+|(?<=[.!?…][\"'”’»)\]])\s+|(?<=[。！？])")
LEAST_PART = 8
_ATTRIBUTION = re.compile(r"\b(?:wrote|writes|said|schrieb|a écrit|escribió)\s*:$", re.IGNORECASE)


def split_quotes(text: str) -> tuple[str, list[tuple[int, str]]]:
    """(own text without quotes, [(level, passage)]); own passages have level 0."""
    own, passages = split_lines(text)
    return own, [(level, " ".join(lines)) for level, lines in passages]


def split_lines(text: str) -> tuple[str, list[tuple[int, list[str]]]]:
    """As split_quotes, each passage as its lines, white space made single."""
    own: list[str] = []
    passages: list[tuple[int, list[str]]] = []
    run: list[str] = []
    level = 0

    def end() -> None:
        if run:
            passages.append((level, [" ".join(line.split()) for line in run]))
        run.clear()

    lines = text.split("\n")
    for i, line in enumerate(lines):
        m = _MARKS.match(line)
        at, body = (m[1].count(">"), line[m.end() :]) if m else (0, line)
        if not m and (said := line.rstrip()).endswith(":") and _ATTRIBUTION.search(said):
            after = next((x for x in lines[i + 1 : i + 3] if x.strip()), "")
            if _MARKS.match(after):
                continue
        if at != level or not body.strip():
            end()
            level = at
        if at == 0:
            own.append(line)
        if body.strip():
            run.append(body)
    end()
    if len(own) == len(lines):
        return text, passages
    kept = re.sub(r"\n{3,}", "\n\n", "\n".join(own)).strip("\n")
    return kept, passages


def passage_key(passage: str) -> bytes:
    return hashlib.sha256(" ".join(passage.lower().split()).encode()).digest()


def part_keys(lines: list[str]) -> list[bytes]:
    """Keys of the passage and of its lines and sentences, longest first."""
    whole = " ".join(lines)
    parts = [p for p in (*lines, *_SENTENCE_END.split(whole)) if len(p) >= LEAST_PART]
    return [passage_key(p)[:16] for p in dict.fromkeys((whole, *sorted(parts, key=len, reverse=True)))]


def link_quotations(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, position, turn, role, text (own), parent_conv, parent_position, n_quotes, n_linked, reply_level, reply_order
    (0, 1, ... within the conversation) for every message."""
    rows = pick(settled(df), conv_id=conv_col, turn=turn_col, role=role_col, text=text_col).withColumn("rid", F.monotonically_increasing_id())
    schema = rows.schema
    kinds = {c: schema[c].dataType.simpleString() for c in ("conv_id", "turn", "role")}

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = pa.list_(pa.struct([("level", pa.int32()), ("key", pa.binary()), ("size", pa.int64()), ("parts", pa.list_(pa.binary()))]))
        for batch in batches:
            own, found = [], []
            for t in batch.column(3):
                text, passages = split_lines(t.as_py() or "")
                own.append(text)
                found.append([{"level": lv, "key": passage_key(p := " ".join(lines)), "size": len(p), "parts": part_keys(lines)} for lv, lines in passages])
            arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array(own, pa.string()), batch.column(4), pa.array(found, part)]
            yield pa.RecordBatch.from_arrays(arrays, names=["conv_id", "turn", "role", "text", "rid", "passages"])

    parsed = rows.mapInArrow(parse, f"conv_id {kinds['conv_id']}, turn {kinds['turn']}, role {kinds['role']}, text string, rid bigint, passages array<struct<level: int, key: binary, size: bigint, parts: array<binary>>>")
    number = F.expr("try_cast(turn AS double)") if kinds["turn"] == "string" else F.col("turn").cast("double")
    parsed = Stored(parsed.withColumn("number", F.when(~F.isnan(number), number)), "messages").df
    order = [F.col("number").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc_nulls_last(), F.col("text").asc(), F.col("rid").asc()]
    placed = row_numbers(parsed, "conv_id", order, "position", "run").withColumn("position", F.col("position").cast("bigint") - 1)
    placed = Stored(placed.select("rid", "conv_id", "turn", "role", "text", "run", "position", "passages"), "placed").df

    # one row for each key of a passage: its own has rank 0, its parts follow from the longest on
    passages = placed.select("rid", "conv_id", "position", F.posexplode("passages").alias("number", "p"))
    pieces = passages.select("rid", "conv_id", "position", "number", "p.level", "p.size", F.posexplode(F.concat(F.array("p.key"), "p.parts")).alias("rank", "key"))
    quoted = Stored(pieces.where("level > 0"), "quoted").df
    wanted = quoted.select("key").distinct()
    own = pieces.where("level = 0").select("conv_id", "position", "key").join(wanted, "key", "left_semi")
    here = Stored(own.groupBy("conv_id", "key").agg(F.min("position").alias("at")), "own-passages").df
    # the two least conversations of a key; the window is cut to two rows before its shuffle
    least = here.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("conv_id"))).where("n <= 2")
    place = F.struct(F.col("conv_id").alias("conv"), F.col("at").alias("at"))
    anywhere = least.groupBy("key").agg(F.max(F.when(F.col("n") == 1, place)).alias("first"), F.max(F.when(F.col("n") == 2, place)).alias("second"))
    local = here.select(F.col("conv_id").alias("c"), F.col("key").alias("k"), "at")
    links = quoted.join(local, quoted.conv_id.eqNullSafe(local.c) & (quoted.key == local.k) & (local.at < quoted.position), "left").join(anywhere, "key", "left")
    other = F.when(~F.col("first.conv").eqNullSafe(F.col("conv_id")), F.col("first")).otherwise(F.col("second"))
    target = F.when(F.col("at").isNotNull(), F.struct(F.col("conv_id").alias("conv"), F.col("at").alias("at"))).otherwise(other)
    links = links.select("rid", "number", "level", "size", (F.col("rank") > 0).alias("part"), F.col("at").isNull().alias("away"), "rank", target.alias("to"))
    nearest = F.min(F.when(F.col("to").isNotNull(), F.struct("part", "away", "rank", "to"))).alias("nearest")
    links = links.groupBy("rid", "number", "level", "size").agg(nearest).select("rid", "level", "size", "nearest.to")
    best = F.max(F.when(F.col("to").isNotNull(), F.struct((-F.col("level")).alias("level"), "size", F.col("to.conv").alias("conv"), F.col("to.at").alias("at"))))
    chosen = links.groupBy("rid").agg(best.alias("best"), F.count("*").alias("n_quotes"), F.count("to").alias("n_linked"))
    linked = F.col("best").isNotNull()
    out = placed.join(chosen, "rid", "left").select(
        "conv_id",
        "position",
        "turn",
        "role",
        "text",
        "run",
        F.when(linked, F.col("best.conv")).when(F.col("position") > 0, F.col("conv_id")).alias("parent_conv"),
        F.when(linked, F.col("best.at")).when(F.col("position") > 0, F.col("position") - 1).alias("parent_position"),
        F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        (linked & F.col("best.conv").eqNullSafe(F.col("conv_id"))).alias("branches"),
    )
    return reply_order(Stored(out, "linked").df).drop("run", "branches")


def reply_order(linked: DataFrame) -> DataFrame:
    """Adds reply_level and reply_order to conv_id, position, run (of positions), parent_position, branches."""
    inside = W.partitionBy("conv_id", "run").orderBy("position").rowsBetween(W.unboundedPreceding, 0)
    start = F.when(F.col("branches"), F.col("position"))
    if linked.where("branches").isEmpty():
        rows = linked.withColumn("reply_level", F.lit(0).cast("bigint"))
    else:
        # a message's branch begins at the last start up to it: in its run, else in the runs before
        last = linked.groupBy("conv_id", "run").agg(F.max(start).alias("last"))
        before = F.max("last").over(W.partitionBy("conv_id").orderBy("run").rowsBetween(W.unboundedPreceding, -1))
        last = last.select(F.col("conv_id").alias("c"), F.col("run").alias("r"), before.alias("before"))
        rows = linked.join(last, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("run") == F.col("r"))).drop("c", "r")
        rows = Stored(rows.withColumn("branch", F.coalesce(F.max(start).over(inside), "before", F.lit(0).cast("bigint"))).drop("before"), "branches").df
        # edges: a branch and the branch of what it answers; 0 is the conversation's own
        asked = rows.where("branches").select(F.col("conv_id").alias("c"), F.col("position").alias("node"), F.col("parent_position").alias("at"))
        edges = asked.join(rows.select("conv_id", "position", F.col("branch").alias("up")), F.col("c").eqNullSafe(F.col("conv_id")) & (F.col("at") == F.col("position")))
        held = Stored(edges.select("c", "node", "up", F.lit(1).cast("bigint").alias("level")), "levels")
        while not held.df.where("up > 0").isEmpty():
            far = held.df.select(F.col("c").alias("d"), F.col("node").alias("from"), F.col("up").alias("further"), F.col("level").alias("more"))
            step = held.df.join(far, F.col("c").eqNullSafe(F.col("d")) & (F.col("up") == F.col("from")), "left")
            after = Stored(step.select("c", "node", F.coalesce("further", F.lit(0).cast("bigint")).alias("up"), (F.col("level") + F.coalesce("more", F.lit(0))).alias("level")), "levels")
            held.drop()
            held = after
        levels = held.df.select("c", "node", F.col("level").alias("reply_level"))
        rows = rows.join(levels, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("branch") == F.col("node")), "left").drop("c", "node", "branch")
        rows = Stored(rows.withColumn("reply_level", F.coalesce("reply_level", F.lit(0).cast("bigint"))), "levelled").df
    cells = rows.groupBy("conv_id", "reply_level", "run").agg(F.count("*").alias("n"))
    base = F.sum("n").over(W.partitionBy("conv_id").orderBy("reply_level", "run")) - F.col("n")
    cells = cells.select(F.col("conv_id").alias("c"), F.col("reply_level").alias("l"), F.col("run").alias("r"), base.alias("base"))
    rank = F.row_number().over(W.partitionBy("conv_id", "reply_level", "run").orderBy("position")) - 1
    out = rows.withColumn("rank", rank).join(cells, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("reply_level") == F.col("l")) & (F.col("run") == F.col("r")))
    return out.withColumn("reply_order", F.col("base") + F.col("rank")).drop("rank", "c", "l", "r", "base")
