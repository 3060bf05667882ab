"""Mixing sources to target weights by a low-discrepancy schedule, in DataFrame functions only.

1. Each source gets a target: its weight's share of all words, at most ``max_repeat`` times its own size, the excess
   reshared by weight until no target is above (solved in closed form over the per-source sums).
2. Each source's documents are put in a seeded random order and laid end to end; that line is cut into blocks of equal
   numbers of words (equal to within one word; about ``block_words``, fewer in small sources so that each has at
   least ``min_blocks``).
3. The golden-ratio points frac(k * phi) are mapped through the cumulative shares of slots, which deals slots to
   sources evenly at every prefix of the schedule. Slots are ranked within their source; a source's quota is the
   number of its blocks that reach its target, and slot r takes block r mod blocks, so no block is used more than
   ``max_repeat`` times.
4. Slots are joined to blocks, and blocks to the pieces of documents in them.

Scale: a source may hold a third of all rows, so neither the order nor the ranks are computed per source in one
task. Both are two-level prefix sums: totals per (source, random bucket) or (source, run of slots), a small cumulative
table, and windows within a bucket. Only per-source tables (one row per source) and bucket totals are broadcast or
windowed as a whole.

Defined results: null text has size 0; null is a source of its own, last in order; sources without words have target
0; repeated rows are separate documents; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sievelake.llm.common import WORD_SPLIT, Stored, col, pick, settled

#: The conjugate golden ratio, and the fraction of 2^20 times it. Slot k = a * 2^20 + b is at
#: frac(a * PHI_RUN + b * PHI), so that doubles stay exact enough for any schedule below 2^40 slots.
PHI, PHI_RUN = 0.6180339887498949, 0.607787409740351
RUN = 1 << 20
#: Slots ranked, and rows laid end to end, in one window at most, about.
RANKED_TOGETHER = 1 << 16
#: Buckets of each source at least, so that a source with a third of few rows is still dealt to many tasks.
LEAST_BUCKETS = 512


def word_count(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.filter(F.split(text, WORD_SPLIT), lambda w: w != "")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], max_repeat: int) -> DataFrame:
    """source, source_size, target, from one row per source. Null sources come last in the order of weights."""
    order = W.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    t = sizes.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * max_repeat / weight).alias("full_at"), F.sum("source_size").over(W.partitionBy()).alias("total"))
    by = W.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after = by.rowsBetween(W.unboundedPreceding, -1), by.rowsBetween(0, W.unboundedFollowing)
    t = t.withColumn("level", (F.col("total") - F.coalesce(F.sum(F.col("source_size") * max_repeat).over(before), F.lit(0))) / F.sum("weight").over(after))
    # the first source, by where it fills up, that the level does not fill: all from it on share the level
    free = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("full_at", "level"))).over(W.partitionBy())["level"]
    return t.select("source", "source_size", F.coalesce(F.least(F.col("source_size") * max_repeat, F.col("weight") * free), F.col("source_size") * F.lit(float(max_repeat))).cast("double").alias("target"))


def mix_sources(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: tuple[int, ...] = (1, 2, 3),
    max_repeat: int = 3,
    block_words: int = 128,
    min_blocks: int = 64,
    seed: int = 11,
) -> DataFrame:
    """rid, doc_id, source, size, source_size, target, taken.

    ``rid`` numbers the rows of ``df`` as read. ``taken`` counts repeats: taken div size whole passes, then the
    document's first taken mod size words, since blocks are taken in order.
    """
    docs = pick(settled(df), doc_id=id_col, text=text_col, source=source_col)
    docs = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "source", word_count(F.col("text")).cast("bigint").alias("size"))
    sized = Stored(docs.withColumn("at", F.xxhash64(F.lit(seed), "rid")), "sizes").df
    buckets = max(LEAST_BUCKETS, -(-sized.count() // RANKED_TOGETHER) * 4)
    sized = sized.withColumn("bucket", F.pmod("at", F.lit(buckets)))

    # sources, targets, blocks and quotas: one row per source
    per_source = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, max_repeat)
    blocks = F.greatest(F.ceil(F.col("source_size") / block_words), F.least("source_size", F.lit(min_blocks))).cast("bigint")
    quota = F.when(F.col("source_size") > 0, F.least(F.round(F.col("target") * F.col("blocks") / F.col("source_size")), F.col("blocks") * max_repeat)).otherwise(0).cast("bigint")
    per_source = per_source.withColumn("blocks", blocks).withColumn("quota", quota)
    cumulated = W.orderBy(F.col("source").asc_nulls_last())
    per_source = per_source.withColumn("hi", F.sum("quota").over(cumulated)).withColumn("slots", F.sum("quota").over(W.partitionBy())).withColumn("source_no", F.row_number().over(cumulated))
    per_source = Stored(per_source, "sources").df

    # documents laid end to end in shuffled order: start of bucket, then start within bucket
    totals = sized.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    starts = totals.select("source", "bucket", (F.sum("words").over(W.partitionBy("source").orderBy("bucket")) - F.col("words")).alias("base"))
    inside = W.partitionBy("source", "bucket").orderBy("at", "rid")
    line = sized.withColumn("begin", F.sum("size").over(inside) - F.col("size"))
    line = line.join(starts, line.source.eqNullSafe(starts.source) & (line.bucket == starts.bucket)).select("rid", "doc_id", line.source, "size", (F.col("begin") + F.col("base")).alias("begin"))
    line = line.join(per_source, line.source.eqNullSafe(per_source.source)).drop(per_source.source)
    line = Stored(line.select("rid", "doc_id", "source", "source_no", "size", "source_size", "target", "blocks", "begin"), "line").df

    # the schedule: golden-ratio points through the cumulative quotas, ranked within the source by runs of slots
    uses = schedule(per_source).groupBy("source_no", "block").agg(F.count("*").alias("uses"))

    # pieces of documents in blocks; block b of a source covers words [b*size div blocks, (b+1)*size div blocks)
    first = F.expr("((begin + 1) * blocks - 1) div source_size")
    last = F.expr("((begin + size) * blocks - 1) div source_size")
    cut = line.where("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    lo = F.greatest("begin", F.expr("(block * source_size) div blocks"))
    hi = F.least(F.col("begin") + F.col("size"), F.expr("((block + 1) * source_size) div blocks"))
    pieces = cut.select("rid", "source_no", "block", (lo - F.col("begin")).alias("lo"), (hi - F.col("begin")).alias("hi")).where("hi > lo")
    used = pieces.join(uses, ["source_no", "block"])
    most = used.groupBy("rid").agg(F.sum((F.col("hi") - F.col("lo")) * F.col("uses")).alias("taken"))
    out = line.join(most, "rid", "left").withColumn("taken", F.coalesce("taken", F.lit(0)).cast("bigint"))
    return out.select("rid", "doc_id", "source", "size", "source_size", "target", "taken")


def schedule(per_source: DataFrame) -> DataFrame:
    """slot, source_no, rank, block: which block comes at which slot. Sources short of their quota get the last slots."""
    spark = per_source.sparkSession
    slots, sources = per_source.agg(F.coalesce(F.sum("quota"), F.lit(0)), F.count("*")).first()
    cells = max(1024, sources)
    width = max(1, -(-slots // cells))
    spread = per_source.where("quota > 0").select("source_no", "quota", "blocks", "hi", (F.col("hi") - F.col("quota")).alias("lo"))
    spread = spread.withColumn("cell", F.explode(F.sequence(F.expr(f"lo div {width}"), F.expr(f"(hi - 1) div {width}"))))
    k = F.col("slot")
    turn = F.expr(f"slot div {RUN}") * F.lit(PHI_RUN) + (k % RUN) * F.lit(PHI)
    points = spark.range(slots).withColumnRenamed("id", "slot")
    points = points.withColumn("t", F.least(F.floor((turn - F.floor(turn)) * slots), F.lit(slots - 1)).cast("bigint")).withColumn("cell", F.expr(f"t div {width}"))
    dealt = points.join(spread, "cell").where("t >= lo AND t < hi").select("slot", "source_no", "quota", "blocks", F.expr(f"slot div {RANKED_TOGETHER}").alias("run"))
    per_run = dealt.groupBy("source_no", "run").agg(F.count("*").alias("n"))
    base = per_run.select("source_no", "run", (F.sum("n").over(W.partitionBy("source_no").orderBy("run")) - F.col("n")).alias("base"))
    inside = F.row_number().over(W.partitionBy("source_no", "run").orderBy("slot")) - 1
    ranked = dealt.withColumn("inside", inside).join(base, ["source_no", "run"]).withColumn("rank", F.col("base") + F.col("inside")).where("rank < quota")
    ranked = ranked.select("slot", "source_no", "rank", "blocks")
    got = per_run.groupBy("source_no").agg(F.sum("n").alias("got"))
    short = per_source.join(got, "source_no", "left").withColumn("got", F.coalesce("got", F.lit(0))).where("got < quota")
    top_up = short.select("source_no", "blocks", F.explode(F.sequence("got", F.col("quota") - 1)).alias("rank"))
    top_up = top_up.select((F.lit(slots) + F.col("rank")).alias("slot"), "source_no", "rank", "blocks")
    return ranked.unionByName(top_up).select("slot", "source_no", "rank", F.pmod("rank", "blocks").alias("block"))


def mixed_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """The rows of ``df`` as the mix takes them: once for each whole pass, and once with the first words of a part."""
    rid = "__mix_rid"
    df = settled(df)
    mixed = mix_sources(df, id_col, text_col, source_col, **options).where("taken > 0")
    takes = mixed.select(F.col("rid").alias(rid), F.expr("taken div size").alias("__mix_whole"), (F.col("taken") % F.col("size")).alias("__mix_part"))
    rows = df.withColumn(rid, F.monotonically_increasing_id()).join(takes, rid)
    passes = F.concat(F.array_repeat(F.lit(False), F.col("__mix_whole").cast("int")), F.array_repeat(F.lit(True), (F.col("__mix_part") > 0).cast("int")))
    rows = rows.withColumn("__mix_cut", F.explode(passes))
    text = F.when(F.col("__mix_cut"), first_words(col(df, text_col), F.col("__mix_part").cast("int"))).otherwise(col(df, text_col))
    return rows.select(*[text.alias(c) if c == text_col else col(df, c) for c in df.columns])


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its n-th word, white space as it was.

    Pieces between runs of white space and the runs themselves are as many but for one, so the length of the first pieces
    plus that of the first runs is where the cut comes.
    """
    pieces = F.split(text, WORD_SPLIT)
    runs = F.regexp_extract_all(text, F.lit(WORD_SPLIT), F.lit(0))
    lead = (F.get(pieces, F.lit(0)) == "").cast("int")  # white space before the first word
    length = lambda a, k: F.aggregate(F.slice(a, 1, k), F.lit(0), lambda s, x: s + F.length(x))
    return F.substring(text, F.lit(1), length(pieces, n + lead) + length(runs, n + lead - 1))
