"""Chapter lookup on code rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caseloom.functions.codes import CHAPTERS, INCOMPLETE, UNCLASSIFIED, code_prefix
from caseloom.sources.constants import constant_table


def add_chapter(df: DataFrame, code: str, out: str = "title") -> DataFrame:
    """Add the chapter title of a code column.

    The range lookup is a broadcast hash join on the first letter (a fixed table of some thirty rows, one per chapter and
    letter) with the range test as the rest of the condition, so a row is compared with one or two ranges.
    """
    rows = [
        (chr(letter), low, high, name)
        for low, high, name in CHAPTERS
        for letter in range(ord(low[0]), ord(high[0]) + 1)
    ]
    ranges = constant_table(df.sparkSession, ["_letter", "_low", "_high", "_name"], rows)
    keyed = df.withColumn("_prefix", code_prefix(F.col(code)))
    inside = (F.substring("_prefix", 1, 1) == F.col("_letter")) & F.col("_prefix").between(
        F.col("_low"), F.col("_high")
    )
    inside = inside & (F.length("_prefix") == 3)
    title = F.when(F.length("_prefix") < 3, F.lit(INCOMPLETE)).otherwise(F.coalesce("_name", F.lit(UNCLASSIFIED)))
    present = F.col(code).isNotNull() & (F.col(code) != "")
    joined = keyed.join(F.broadcast(ranges), inside, "left")
    return joined.select(*df.columns, F.when(present, title).alias(out))
