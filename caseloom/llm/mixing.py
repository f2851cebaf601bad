"""Mixing sources to target weights by systematic sampling.

Every source gets a target share of all words. A document's expected copies are the same throughout its source, target
over size; their prefix sum plus one offset per source crosses integers, and the document is emitted once per crossing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import WORD, columns, fresh, one_of_each, positions, same, text_digest
from caseloom.session import materialize

#: Most copies of a document on average, and so the highest target of a source as a multiple of its size.
MOST = 3
CYCLE = 3
#: Offsets are multiples of 2 ** -20, so that their sum with a prefix sum is exact for billions of documents.
STEPS = 1 << 20


def offset(source: Column, seed: int) -> Column:
    """The random offset of a source in [0, 1), fixed by the seed."""
    key = F.concat(F.coalesce(F.concat(F.lit("s"), source), F.lit("n")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(key), 1, 5), 16, 10).cast("long") / F.lit(STEPS)


def source_targets(sources: DataFrame, most: int = MOST, cycle: int = CYCLE) -> DataFrame:
    """Add ``target`` to ``(source, source_size)``, one row per source, NULL a source of its own.

    Sources in code point order, NULL last, weigh 1 … ``cycle``, repeating. Targets share the sum of all sizes by weight,
    stop at ``most`` times the size, and what is above goes to the others by weight until none is above. Each round is one
    sum over the table. Sources without words get 0.
    """
    ranked = positions(sources, [], [F.col("source").asc_nulls_last()], "rank")
    weighed = materialize(ranked.select("source", "source_size", (F.col("rank") % cycle + 1).alias("weight")))
    total, free = weighed.agg(F.sum("source_size"), F.sum("weight")).first()
    level, full = (total or 0) / (free or 1), 0
    while True:
        above = F.col("source_size") * most < F.col("weight") * F.lit(level)
        capped, free, now = weighed.agg(
            F.sum(F.when(above, F.col("source_size") * most)), F.sum(F.when(~above, F.col("weight"))), F.count_if(above)
        ).first()
        if now == full or not free:
            break
        level, full = (total - capped) / free, now
    target = F.least((F.col("source_size") * most).cast("double"), F.col("weight") * F.lit(float(level)))
    return weighed.select("source", "source_size", target.alias("target"))


def mix(
    docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1, digest: bool = False
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, source, size, source_size, target, copies, taken``.

    Within a source documents stand by size, largest first, then by id. The copies before any point then differ from
    their expectation by less than one, so the words taken differ from the target by less than the longest document.
    ``copies`` is at most ``MOST``. NULL texts have size 0; NULL sources form one source; equal rows count one by one.
    An empty table gives no rows. Other columns are not read. With ``digest`` rows have ``sha``, the SHA-256 of their text,
    which also orders rows of the same source, size and id.
    """
    size = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    sha = [text_digest(text).alias("sha")] if digest else []
    rows = materialize(docs.select(F.col(id).alias("doc_id"), F.col(source).alias("source"), size.alias("size"), *sha))
    targets = source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    targets = targets.withColumnRenamed("source", "__source")
    last = ["sha"] if digest else []
    placed = positions(rows, ["source"], [F.col("size").desc(), F.col("doc_id").asc(), *map(F.col, last)], "__place")
    # One row per source on the right: hot sources are split by adaptive execution on the left.
    joined = placed.join(targets, placed["source"].eqNullSafe(targets["__source"]))
    each = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    shift = offset(F.col("source"), seed)
    copies = F.floor((F.col("__place") + 1) * each + shift) - F.floor(F.col("__place") * each + shift)
    return joined.select("doc_id", "source", "size", "source_size", "target", *last, copies.alias("copies")).withColumn(
        "taken", F.col("copies") * F.col("size")
    )


def emit(docs: DataFrame, id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 1) -> DataFrame:
    """The mixed table: the rows of ``docs``, each as often as ``mix`` takes it.

    Rows that share id, source and text are one document: the one that ``one_of_each`` names is emitted as often as all of
    them together. Other texts of the same id are documents of their own.
    """
    taken = mix(docs, id, text, source, seed, digest=True).groupBy("doc_id", "source", "sha")
    taken = materialize(taken.agg(F.sum("copies").alias("copies"), F.count("*").alias("rows")))
    sha, copy = fresh(docs.columns, "sha"), fresh(docs.columns, "copy")
    hashed = docs.withColumn(sha, text_digest(text))
    if not taken.where("rows > 1").isEmpty():
        hashed = one_of_each(hashed, [id, source, sha])
    chosen = taken.where("copies > 0").toDF("__id", "__source", "__sha", "__copies", "__rows").hint("merge")
    met = hashed.join(chosen, same(hashed, chosen, {id: "__id", source: "__source", sha: "__sha"}))
    times = F.explode(F.sequence(F.lit(1).cast("long"), chosen["__copies"])).alias(copy)
    return met.select(*columns(hashed)[: len(docs.columns)], times).drop(copy)
