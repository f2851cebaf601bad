"""What every filter removes in every order: an audit of five filters over all 120 orders.

Whether a text repeats is settled by a counting Bloom filter first. Every text puts two counters of one block up by one; the
tasks' partial counters are merged by addition, and a text with a counter of one is unique for certain. Only the others, all
true repeats and about one unique text in seventy, are shuffled and grouped by their full text to find the smallest id. Each
row then is a mask of the filters it fails, and all figures of all orders follow from the counts of the 32 masks by addition.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import same, words
from caseloom.session import materialize

FILTERS = "ABCDE"
#: Counters of a block, which is a bitmap of 4 KB once counters are reduced to "more than one".
BLOCK = 1 << 15
#: Counters per text, and the most blocks: 128 MB of bitmaps. Beyond 67 million texts the sketch fills up and clears fewer
#: of the unique texts; what it does not clear is shuffled, so results stay exact.
PER_TEXT, MOST_BLOCKS = 16, 1 << 15


def failures(text: Column) -> Column:
    """Bits 0 to 3: filters A to D that a text fails."""
    count, distinct = F.size("__words"), F.size(F.array_distinct("__words"))
    capitals = F.length(F.regexp_replace(text, "[^A-Z]+", ""))
    failed = [count < 200, 100 * distinct < 50 * count, 100 * capitals > 3 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def flags(docs: DataFrame, id: str, text: str, part: str) -> DataFrame:
    """Per row ``doc_id, part, mask`` (A to D), a hash and a digest of the whole text; the text itself is left behind."""
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(part).cast("string"), F.lit("")).alias("part"), body.alias("__body"))
    rows = rows.withColumn("__words", words(F.col("__body")))
    return rows.select(
        "doc_id", "part", failures(F.col("__body")).alias("mask"), F.xxhash64("__body").alias("hash"),
        F.unhex(F.sha2("__body", 256)).alias("sha"),
    )


def place(hash: Column, blocks: int) -> tuple[Column, Column, Column]:
    """The block of a text and its two counters there."""
    low, high = hash.bitwiseAND(F.lit(BLOCK - 1)), F.shiftright(hash, 15).bitwiseAND(F.lit(BLOCK - 1))
    return F.pmod(F.shiftright(hash, 30), F.lit(blocks)), low, high


def blocks_for(rows: int) -> int:
    return max(1, min(MOST_BLOCKS, -(-rows * PER_TEXT // BLOCK)))


def sketch(hashes: DataFrame, blocks: int) -> DataFrame:
    """``block, repeated``: the counting Bloom filter of all texts, each counter reduced to whether it is above one.

    Counters are rows ``(block, counter)`` summed per task first, so copies of a text cost one row per task. A text whose
    two counters coincide counts there once.
    """
    block, low, high = place(F.col("hash"), blocks)
    each = hashes.select(block.alias("block"), F.explode(F.array_distinct(F.array(low, high))).alias("counter"))
    merged = each.groupBy("block", "counter").agg(F.count("*").alias("count"))
    return merged.where("count > 1").groupBy("block").agg(F.bitmap_construct_agg(F.col("counter")).alias("repeated"))


def possible_repeats(rows: DataFrame, repeated: DataFrame, blocks: int, hash: str = "hash") -> DataFrame:
    """The rows whose counters are both above one: every row whose text occurs twice, and few others.

    The bitmaps have at most ``MOST_BLOCKS`` times 4 KB and are broadcast, so that no text moves to be looked up.
    """
    block, low, high = place(F.col(hash), blocks)

    def is_set(bit: Column) -> Column:
        byte = F.conv(F.hex(F.substring("__repeated", (bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, (bit % 8).cast("int")) == 1

    marks = repeated.select(F.col("block").alias("__block"), F.col("repeated").alias("__repeated"))
    met = rows.join(F.broadcast(marks), block == F.col("__block"))
    return met.where(is_set(low) & is_set(high)).drop("__block", "__repeated")


def first_copies(docs: DataFrame, repeated: DataFrame, blocks: int, id: str, text: str) -> DataFrame:
    """``doc_id, sha`` of the smallest id of every text that may repeat, found by grouping whole texts."""
    rows = docs.select(F.col(id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("body"))
    rows = rows.withColumn("hash", F.xxhash64("body"))
    found = possible_repeats(rows, repeated, blocks).groupBy("body").agg(F.min("doc_id").alias("doc_id"))
    return found.select("doc_id", F.unhex(F.sha2("body", 256)).alias("sha"))


def mask_counts(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """``part, mask, rows, good, toxic``: how many rows fail exactly the filters of a mask, at most 32 rows a part."""
    marked = materialize(flags(docs, id, text, part))
    blocks = blocks_for(marked.count())
    repeated = materialize(sketch(marked.select("hash"), blocks))
    firsts = materialize(first_copies(docs, repeated, blocks, id, text)).toDF("__id", "__sha")
    possible = possible_repeats(marked, repeated, blocks).drop("hash")
    # A NULL id is no smaller than any other: it is first only where its text has no other id.
    again = possible.join(firsts, same(possible, firsts, {"doc_id": "__id", "sha": "__sha"}), "left_anti")
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("__labelled"))
    known = known.agg(F.max(F.expr("quality <=> 1")).alias("good"), F.max(F.expr("toxic <=> 1")).alias("toxic"))

    def counted(rows: DataFrame) -> DataFrame:
        met = rows.join(known, F.col("doc_id") == F.col("__labelled"), "left").groupBy("part", "mask")
        return met.agg(F.count("*").alias("rows"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))

    # Rows that repeat move from their mask to the one with E: a subtraction and an addition.
    moved = materialize(counted(again))
    sums = [F.sum(c).alias(c) for c in ("rows", "good", "toxic")]
    left = moved.select("part", "mask", *[(-F.col(c)).alias(c) for c in ("rows", "good", "toxic")])
    joined = counted(marked.drop("hash", "sha")).unionByName(left)
    return joined.unionByName(moved.withColumn("mask", F.col("mask") + 16)).groupBy("part", "mask").agg(*sums)


def audit(docs: DataFrame, labels: DataFrame, id: str = "doc_id", text: str = "text", part: str = "lang") -> DataFrame:
    """Per part, order of the filters and step: ``kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A: under 200 words; B: distinct words under half; C: over 3 % of the code points in A-Z; D: one of ``#$%&*|``; E: the
    text of a row with a smaller id, in any part. NULL texts are empty, NULL parts the empty part; rows that repeat id and
    text are no copies of each other; a NULL id is no smaller than another. Labels of an id are combined: good if one says
    quality 1, toxic if one says so. ``shapley`` sums, over all orders, the rows that the filter removes there: a row that
    fails k filters is removed by each of them in 120 / k orders. An empty table gives no rows.
    """
    counts = mask_counts(docs, labels, id, text, part).groupBy("part")
    counts = counts.agg(F.collect_list(F.struct("mask", "rows", "good", "toxic")).alias("masks"))  # 32 at most
    orders = F.array(*[F.lit("".join(o)) for o in permutations(FILTERS)])
    steps = counts.select("part", "masks", F.explode(orders).alias("filter_order"))
    steps = steps.select("*", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))).alias("step"))

    def bits(letters: Column) -> Column:
        return sum((F.when(F.contains(letters, F.lit(f)), 1 << i).otherwise(0) for i, f in enumerate(FILTERS)), F.lit(0))

    steps = steps.withColumn("earlier", bits(F.substring("filter_order", F.lit(1), F.col("step") - 1)))
    steps = steps.withColumn("own", bits(F.substring("filter_order", F.col("step"), F.lit(1))))

    def total(condition: str, value: str = "m.rows") -> Column:
        return F.expr(f"aggregate(masks, 0L, (s, m) -> s + IF({condition}, {value}, 0L))")

    fails, before = "m.mask & own <> 0", "m.mask & earlier <> 0"
    return steps.select(
        "part", "filter_order", "step",
        total("m.mask & (own | earlier) = 0").alias("kept"),
        total(f"{fails} AND NOT ({before})").alias("removed"),
        total(f"{fails} AND {before}").alias("redundant"),
        total("m.mask = own").alias("unique_fails"),
        total(f"{fails} AND NOT ({before})", "m.good").alias("good_lost"),
        total(f"{fails} AND NOT ({before})", "m.toxic").alias("toxic_lost"),
        total(fails, "m.rows * CAST(120 / bit_count(m.mask) AS BIGINT)").alias("shapley"),
    )
