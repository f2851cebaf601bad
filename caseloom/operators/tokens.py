"""Word tokens: counting, vocabulary, fixed-length encoding, masks and batch padding."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.functions.slots import slot_lookup, slot_table
from caseloom.operators.joins import BROADCAST_BYTES, lookup_join, spread_join, table_bytes
from caseloom.operators.ranks import prefix_sums, running_totals, text_bucket
from caseloom.session import materialize

# Array length, and the longest vocabulary that is held on the driver (markers included).
MAX_LENGTH = 512
MAX_VOCABULARY = 30_522

# Ids of the markers; words start after them.
PAD, UNKNOWN, START, END = 0, 1, 2, 3
MARKERS = 2
FIRST_WORD = 4

# A token is a run of letters and digits, or one other visible character.
TOKEN = r"[\p{L}\p{N}]+|[^\s\p{L}\p{N}]"


def tokens(text: Column) -> Column:
    """Lower-case tokens of the whole text; NULL gives an empty array."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def token_count(text: Column) -> Column:
    """Number of tokens without markers; NULL and blank texts have none."""
    return F.regexp_count(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN))


@dataclass(frozen=True)
class Vocabulary:
    """Words with their ids. At most ``MAX_VOCABULARY`` entries, so it may live on the driver and in the plan."""

    words: dict[str, int]

    def ids(self, words: Column) -> Column:
        """Ids of an array of tokens, ``UNKNOWN`` for words outside the vocabulary."""
        table = slot_table(self.words)

        def look_up(word: Column) -> Column:
            return F.coalesce(slot_lookup(self.words, word, table).cast("int"), F.lit(UNKNOWN))

        return F.transform(words, look_up)


def vocabulary_frame(df: DataFrame, text: str, size: int | None = None) -> DataFrame:
    """``(token, occurrences, token_id)``: all tokens, the most frequent first, ties in text order, ids from ``FIRST_WORD``.

    Counting is combined before the shuffle. A token's number is the number of tokens that occur more often, from a table
    with one row per count, plus its place among those of its count, which is ranked inside ranges of tokens. A caller who
    wants a vocabulary of a certain ``size``, markers included, gets its beginning.
    """
    counted = df.select(F.explode(tokens(F.col(text))).alias("token")).groupBy("token").agg(
        F.count("*").alias("occurrences")
    )
    counted = materialize(counted)
    placed = prefix_sums(
        text_bucket(counted, "token"), ["occurrences"], "_bucket", ["token"], {"_inside": F.lit(1).cast("long")}
    )
    rarer = counted.select((-F.col("occurrences")).alias("_less"))
    offsets = running_totals(rarer, "_less", {"rows": F.lit(1).cast("long")})
    offsets = offsets.select((-F.col("_less")).cast("long").alias("occurrences"), F.col("before_rows").alias("_before"))
    numbered = lookup_join(placed, offsets, ["occurrences"], ["token"], "inner")
    token_id = F.col("_before") + F.col("_inside") + FIRST_WORD
    numbered = numbered.select("token", "occurrences", token_id.alias("token_id"))
    return numbered if size is None else numbered.where(F.col("token_id") < size)


def fit_vocabulary(df: DataFrame, text: str, size: int = MAX_VOCABULARY) -> Vocabulary:
    """A vocabulary of a chosen size that lives on the driver; words beyond it become ``UNKNOWN``."""
    if size > MAX_VOCABULARY:
        raise ValueError(f"a vocabulary on the driver has at most {MAX_VOCABULARY} entries")
    rows = vocabulary_frame(df, text, size).select("token", "token_id").collect()  # at most MAX_VOCABULARY rows
    return Vocabulary({row.token: row.token_id for row in rows})


def looked_up(kept: DataFrame, vocabulary: DataFrame, spread_by: list[str], broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Add ``token_id`` to rows with a ``token``. The most frequent words, as many as may be broadcast, are found without a
    shuffle; only the tokens that are left meet the other words in a shuffle join."""
    size = table_bytes(vocabulary)
    if size <= broadcast_bytes:
        return kept.join(F.broadcast(vocabulary), "token", "left")
    rare = F.col("token_id") >= FIRST_WORD + int(vocabulary.count() * broadcast_bytes / size)
    tried = kept.join(F.broadcast(vocabulary.where(~rare)), "token", "left")
    tried = materialize(tried.withColumn("token", F.when(F.col("token_id").isNull(), F.col("token"))))
    left = tried.where("token IS NOT NULL").drop("token_id")
    found = spread_join(left, vocabulary.where(rare), ["token"], spread_by)
    return tried.where("token IS NULL").unionByName(found)


def table_ids(
    df: DataFrame, key: str, text: str, vocabulary: DataFrame, max_length: int = MAX_LENGTH, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """``(key, ids)`` with start and end marker, cut to ``max_length``, from a vocabulary table of any size.

    The tokens that are kept, at most ``max_length`` a text, meet the vocabulary, whose ids are those of
    ``vocabulary_frame``, and go back to their text by its unique key, position and id in one number. Tokens that the table
    does not hold become ``UNKNOWN``.
    """
    cut = F.slice(tokens(F.col(text)), 1, max_length - MARKERS)
    kept = df.select(F.col(key), F.posexplode_outer(cut).alias("_pos", "token"))
    found = looked_up(kept, vocabulary.select("token", "token_id"), [key, "_pos"], broadcast_bytes)
    token_id = F.coalesce("token_id", F.lit(UNKNOWN)).cast("int").cast("long")
    placed = F.when(F.col("_pos").isNotNull(), F.shiftleft(F.col("_pos").cast("long"), 32) + token_id)
    listed = found.groupBy(key).agg(F.sort_array(F.collect_list(placed)).alias("_listed"))
    inside = F.transform("_listed", lambda p: p.bitwiseAND(F.lit((1 << 32) - 1)).cast("int"))
    return listed.select(key, F.concat(F.array(F.lit(START)), inside, F.array(F.lit(END))).alias("ids"))


def content_ids(words: Column, vocabulary: Vocabulary, max_length: int = MAX_LENGTH) -> Column:
    """Ids with start and end marker, cut so that the whole fits into ``max_length``."""
    return F.concat(
        F.array(F.lit(START)), vocabulary.ids(F.slice(words, 1, max_length - MARKERS)), F.array(F.lit(END))
    )


def pad(values: Column, size: Column, filler: Column) -> Column:
    return F.concat(values, F.array_repeat(filler, size - F.size(values)))


def attention_mask(length: Column, size: int = MAX_LENGTH) -> Column:
    """1 for each of the first ``length`` positions, 0 for padding, as bytes."""
    one, zero = F.lit(1).cast("byte"), F.lit(0).cast("byte")
    return F.concat(F.array_repeat(one, length), F.array_repeat(zero, F.lit(size) - length))


def encode(df: DataFrame, text: str, vocabulary: Vocabulary, max_length: int = MAX_LENGTH) -> DataFrame:
    """Add ``input_ids`` and ``attention_mask``, both of length ``max_length``. A projection: no shuffle."""
    ids = df.withColumn("_ids", content_ids(tokens(F.col(text)), vocabulary, max_length))
    return ids.withColumns(
        {
            "input_ids": pad(F.col("_ids"), F.lit(max_length), F.lit(PAD)),
            "attention_mask": attention_mask(F.size("_ids"), max_length),
        }
    ).drop("_ids")


def pad_batches(df: DataFrame, ids: str, batch: str, spread_by: list[str], out: str = "padded") -> DataFrame:
    """Pad every id array to the longest of its batch.

    The longest length is combined map-side and joined back, so that a batch of any size stays spread over tasks.
    """
    longest = df.groupBy(batch).agg(F.max(F.size(ids)).alias("_size"))
    joined = spread_join(df, longest, [batch], spread_by)
    size = F.coalesce("_size", F.size(ids))
    return joined.withColumn(out, pad(F.col(ids), size, F.lit(PAD))).select(*df.columns, out)


def map_batches(
    df: DataFrame, function: Callable[[pd.DataFrame], pd.DataFrame], schema: str, columns: list[str] | None = None
) -> DataFrame:
    """Apply a user's own batch function, such as a subword tokenizer, with a declared output schema.

    Runs in Arrow batches on the executors; prefer column expressions where they can say the same.
    """
    source = df.select(*columns) if columns else df

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield function(batch)

    return source.mapInPandas(run, schema)
