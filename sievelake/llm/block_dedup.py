"""Exact dedup by deterministic block naming.

Texts are cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered; the number is
the block's *name*. Adjacent pairs of names are then sorted and numbered in turn, level by level, until each
document has a single name. Two documents have the same (level, name) exactly if their texts are equal: names are
given to the blocks and pairs themselves, so no hash collision can join different texts.

Scale: block bytes cross the network once (distinct, with map-side combine). Occurrences travel as a 64-bit routing
hash; where different blocks share a hash, which the naming step detects on the blocks themselves, those
occurrences are joined on their bytes instead. Every level halves the rows. Hot blocks and hot groups are met by
partial aggregation and by joins between two shuffles, which adaptive execution may split.

Numbering sorts each hash partition of the distinct values and takes partition and row number, so that a task that
is run again gives the same names.

Defined results: null text counts as empty; empty texts form one group; repeated rows are separate members, and
of rows that tie on the id exactly one is kept; a null id ranks below all others; an empty table gives an empty
result; columns other than the two named are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sievelake.llm.common import Stored, pick, settled

BLOCK_BYTES = 2048


def _cut(block_bytes: int, with_block: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rids, ids, texts = (batch.column(i) for i in range(3))
            out: dict[str, list] = {k: [] for k in ("rid", "doc_id", "sha", "n", "pos", "block")}
            held = 0
            for rid, doc_id, text in zip(rids, ids, texts):
                raw = (text.as_py() or "").encode().lower()  # bytes.lower() changes A-Z only
                sha = hashlib.sha256(raw).hexdigest()
                n = max(1, -(-len(raw) // block_bytes))
                rid, doc_id = rid.as_py(), doc_id.as_py()
                for pos in range(n):
                    out["rid"].append(rid)
                    out["doc_id"].append(doc_id if pos == 0 else None)
                    out["sha"].append(sha if pos == 0 else None)
                    out["n"].append(n)
                    out["pos"].append(pos)
                    out["block"].append(raw[pos * block_bytes : (pos + 1) * block_bytes])
                held += len(raw)
                if held > 8 << 20:
                    yield _batch(out, ids.type, with_block)
                    out, held = {k: [] for k in out}, 0
            yield _batch(out, ids.type, with_block)

    return run


#: What routes a block to its namesakes; blocks that clash are told apart by their bytes.
ROUTE = F.xxhash64


def _batch(out: dict[str, list], id_type: pa.DataType, with_block: bool) -> pa.RecordBatch:
    types = {"rid": pa.int64(), "doc_id": id_type, "sha": pa.string(), "n": pa.int32(), "pos": pa.int32(), "block": pa.binary()}
    names = list(types) if with_block else ["block"]
    return pa.RecordBatch.from_arrays([pa.array(out[k], types[k]) for k in names], names=names)


def _number(distinct: DataFrame, keys: list[str]) -> DataFrame:
    """Integer names of distinct rows: sorted within hash partitions, numbered by partition and row."""
    return distinct.sortWithinPartitions(*keys).withColumn("name", F.monotonically_increasing_id())


def block_identities(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per input row: rid, doc_id, sha (of the lower-cased text), level, name. Equal (level, name): equal texts."""
    if block_bytes < 1:
        raise ValueError("block_bytes must be positive")
    docs = pick(settled(df), doc_id=id_col, text=text_col).select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text")
    id_type = docs.schema["doc_id"].dataType.simpleString()
    every = f"rid bigint, doc_id {id_type}, sha string, n int, pos int, block binary"
    route = ROUTE("block").alias("h")

    blocks = docs.mapInArrow(_cut(block_bytes, False), "block binary").select(route, "block").distinct()
    named = Stored(_number(blocks, ["block"]).select("h", "name"), "blocks")
    shared = Stored(named.df.groupBy("h").count().where("count > 1").select("h"), "shared-routes")

    cut = docs.mapInArrow(_cut(block_bytes, True), every).select("rid", "doc_id", "sha", "n", "pos", route, "block")
    occ = Stored(cut.drop("block"), "occurrences")
    if shared.df.isEmpty():
        first = occ.df.join(named.df, "h")
    else:  # different blocks under one routing hash: name those by their bytes, and join on bytes
        apart = Stored(_number(blocks.join(shared.df, "h", "left_semi").repartition("h", "block"), ["h", "block"]).withColumn("name", -1 - F.col("name")), "blocks-apart")
        alone = named.df.join(shared.df, "h", "left_anti")
        clash = cut.join(shared.df, "h", "left_semi").join(apart.df, ["h", "block"]).drop("block")
        first = occ.df.join(shared.df, "h", "left_anti").join(alone, "h").unionByName(clash)
    level = Stored(first.select("rid", "n", "pos", "name"), "level")
    done, k = [], 0
    while True:
        done.append(level.df.where("n = 1").select("rid", F.lit(k).alias("level"), "name"))
        active = level.df.where("n > 1")
        if active.isEmpty():
            break
        pairs = active.groupBy("rid", F.expr("pos div 2").cast("int").alias("pos"), "n").agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-(1 << 62))).alias("b"),
        )
        pairs = pairs.select("rid", F.expr("cast((n + 1) div 2 as int)").alias("n"), "pos", "a", "b")
        held = Stored(pairs, "pairs")
        names = Stored(_number(held.df.select("a", "b").distinct(), ["a", "b"]), "pair-names")
        level = Stored(held.df.join(names.df, ["a", "b"]).select("rid", "n", "pos", "name"), "level")
        held.drop()
        k += 1
    ident = done[0]
    for d in done[1:]:
        ident = ident.unionByName(d)
    heads = occ.df.where("pos = 0").select("rid", "doc_id", "sha")
    return heads.join(ident, "rid")


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """rid, doc_id, keep_id, group_size, kept, text_sha256 for each row; the largest id of each group stays."""
    ident = Stored(block_identities(df, id_col, text_col, block_bytes), "identities").df
    groups = ident.groupBy("level", "name").agg(F.max(F.struct("doc_id", (-F.col("rid")).alias("r"))).alias("keep"), F.count("*").alias("group_size"))
    groups = Stored(groups.select("level", "name", F.col("keep.doc_id").alias("keep_id"), (-F.col("keep.r")).alias("keep_rid"), "group_size"), "groups").df
    return ident.join(groups, ["level", "name"]).select("rid", "doc_id", "keep_id", "group_size", (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The input's rows and columns without exact copies."""
    rid = "__block_dedup_rid"
    df = settled(df)
    kept = exact_dedup(df, id_col, text_col).where("kept").select(F.col("rid").alias(rid))
    return df.withColumn(rid, F.monotonically_increasing_id()).join(kept, rid, "left_semi").drop(rid)
