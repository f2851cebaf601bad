"""Quotation linking: which message a quote comes from, and conversations in reply order without the quotes.

Lines that begin with ``>`` are quoted, once per sign. Adjacent lines of one level form a passage. Passages, their paragraphs
and their lines are normalised and hashed, and joined to the first message of the conversation that has them as own text: its
whole body, a paragraph or a line. The message that the outermost passage comes from is the one replied to. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.common import positions, same
from caseloom.session import materialize

PARAGRAPHS = r"\n[ \t]*\n"
QUOTED = r"^(?:[ \t]*>)+"
#: A line that introduces a quote and is none of the author's text.
INTRODUCED = r"(?:^|\n)[^\n]*\b(?:wrote|writes|schrieb|a écrit|escribió)[ \t]*:\s*$"
PART = 256


def normalised(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def hashes(units: Column) -> Column:
    """``(hash, chars)`` of the normalised units that are not blank."""
    texts = F.filter(F.transform(units, normalised), lambda t: t != "")
    return F.transform(texts, lambda t: F.struct(F.md5(t).alias("hash"), F.length(t).alias("chars")))


def parse(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``conv_id, turn, role, content, passages``: own text without quotes, and passages as ``(level, text)``.

    Only projections over arrays held in one row: a passage begins where the level changes.
    """
    lines = messages.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.col(role).alias("role"),
        F.split(F.coalesce(F.col(text), F.lit("")), "\r?\n").alias("lines"),
    )
    levels = F.transform("lines", lambda x: F.length(F.regexp_replace(F.regexp_extract(x, QUOTED, 0), "[ \t]", "")))
    bare = F.transform("lines", lambda x: F.regexp_replace(x, QUOTED + " ?", ""))
    levelled = lines.select("conv_id", "turn", "role", levels.alias("levels"), bare.alias("lines"))
    starts = F.filter(
        F.sequence(F.lit(0), F.size("lines") - 1),
        lambda i: (i == 0) | (F.get("levels", i) != F.get("levels", i - 1)),
    )
    started = levelled.withColumn("starts", starts)
    passages = F.transform(
        "starts",
        lambda at, k: F.struct(
            F.get("levels", at).alias("level"),
            F.array_join(F.slice("lines", at + 1, F.coalesce(F.get("starts", k + 1), F.size("lines")) - at), "\n").alias("text"),
        ),
    )
    cut = started.select("conv_id", "turn", "role", passages.alias("passages"))
    own = F.transform(
        F.filter(
            F.transform(
                "passages",
                lambda p, k: F.when(
                    (p["level"] == 0) & F.get("passages", k + 1).isNotNull(), F.regexp_replace(p["text"], INTRODUCED, "")
                ).when(p["level"] == 0, p["text"]),
            ),
            lambda t: t.isNotNull(),
        ),
        lambda t: F.regexp_replace(t, r"^\s+|\s+$", ""),
    )
    content = F.array_join(F.filter(own, lambda t: t != ""), "\n")
    quoted = F.filter("passages", lambda p: p["level"] > 0)
    return cut.select("conv_id", "turn", "role", content.alias("content"), quoted.alias("passages"))


def link(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, passage, level, source_turn``: the earlier message that each quoted passage comes from.

    Of what is found, the whole passage goes before a paragraph and that before a line, a longer one before a shorter one, a
    later message before an earlier one. Texts that are said again and again count for the message that said them first, so the right side of the
    join has one row per text and no group of equal lines is multiplied.
    """
    content = F.col("content")
    units = F.array_distinct(
        F.concat(F.array(content), F.split(content, PARAGRAPHS), F.split(content, "\n"))
    )
    said = parsed.select("conv_id", "turn", F.explode(hashes(units)).alias("unit"))
    first = said.groupBy("conv_id", F.col("unit.hash").alias("hash")).agg(F.min("turn").alias("source_turn"))
    first = first.toDF("__conv", "__hash", "source_turn")
    quotes = parsed.select("conv_id", "turn", F.posexplode("passages").alias("passage", "p"))
    paragraphs = F.split("p.text", PARAGRAPHS)

    def ranked(rank: int, units: Column) -> Column:
        return F.transform(hashes(units), lambda h: F.struct(F.lit(rank).alias("rank"), h.alias("unit")))

    several = F.when(F.size(paragraphs) > 1, paragraphs).otherwise(F.array().cast("array<string>"))  # one is the whole passage
    looked = F.concat(ranked(2, F.array("p.text")), ranked(1, several), ranked(0, F.split("p.text", "\n")))
    asked = quotes.select("conv_id", "turn", "passage", F.col("p.level").alias("level"), F.inline(looked))
    asked = asked.select("conv_id", "turn", "passage", "level", "rank", F.col("unit.chars").alias("chars"), F.col("unit.hash").alias("hash"))
    met = asked.join(first, same(asked, first, {"conv_id": "__conv", "hash": "__hash"})).where("source_turn < turn")
    best = F.max(F.struct("rank", "chars", "source_turn")).getField("source_turn")
    return met.groupBy("conv_id", "turn", "passage", "level").agg(best.alias("source_turn"))


def threads(links: DataFrame) -> DataFrame:
    """``conv_id, turn, parent_turn, thread, depth`` of the messages that reply to another.

    The parent is the source of the outermost passage, the first of them. Roots are found by pointer jumping: every round
    doubles the way that is looked up, so rounds grow with the logarithm of the longest chain; each round is written.
    """
    outer = F.min(F.struct("level", "passage", "source_turn")).getField("source_turn")
    parents = materialize(links.groupBy("conv_id", "turn").agg(outer.alias("parent_turn")))
    ways = parents.select("conv_id", "turn", "parent_turn", F.col("parent_turn").alias("thread"), F.lit(1).cast("long").alias("depth"))
    while True:
        up = ways.select(F.col("conv_id").alias("__conv"), F.col("turn").alias("__turn"), F.col("thread").alias("__thread"), F.col("depth").alias("__depth"))
        met = ways.join(up, same(ways, up, {"conv_id": "__conv", "thread": "__turn"}), "left")
        stepped = materialize(
            met.select(
                "conv_id", "turn", "parent_turn", F.coalesce("__thread", "thread").alias("thread"),
                (F.col("depth") + F.coalesce("__depth", F.lit(0))).alias("depth"), F.col("__thread").isNotNull().alias("moved"),
            )
        )
        ways = stepped.drop("moved")
        if stepped.where("moved").isEmpty():
            return ways


def reply_order(messages: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Per message: ``conv_id, position, turn, role, parent_turn, thread, depth, n_quotes, content``.

    ``thread`` is the turn of the message at the root, the message's own if it replies to none. ``position`` numbers the
    messages of a conversation from 0, thread after thread and by turn within one, so that a reply always follows what it
    replies to. Messages without quotes keep their text but for white space at both ends; NULL texts are empty. NULL turns
    stand last and link to nothing; a NULL conversation is one of its own. Rows that share conversation and turn share their
    links. An empty table gives no rows. Other columns are not read.
    """
    parsed = materialize(parse(messages, conv, turn, role, text))
    linked = threads(link(parsed)).toDF("__conv", "__turn", "parent_turn", "thread", "depth")
    met = parsed.join(linked, same(parsed, linked, {"conv_id": "__conv", "turn": "__turn"}), "left")
    placed = met.select(
        "conv_id", "turn", "role", "parent_turn", F.coalesce("thread", "turn").alias("thread"),
        F.coalesce("depth", F.lit(0).cast("long")).alias("depth"), F.size("passages").cast("long").alias("n_quotes"), "content",
    )
    order = [F.col("thread").asc_nulls_last(), F.col("turn").asc_nulls_last(), F.col("role").asc(), F.col("content").asc()]
    return positions(placed, ["conv_id"], order, "position")


def conversations(ordered: DataFrame, part: int = PART) -> DataFrame:
    """``conv_id, part, messages, formatted`` from ``reply_order``: rows of at most ``part`` messages, in order.

    Most conversations are one row; long ones go on in further parts, so no row and no task holds an unbounded one.
    """
    message = F.struct("position", "role", "content", "turn", "parent_turn", "thread", "depth", "n_quotes")
    grouped = ordered.groupBy("conv_id", F.floor(F.col("position") / part).alias("part"))
    listed = grouped.agg(F.sort_array(F.collect_list(message)).alias("messages"))
    turns = F.transform(
        "messages",
        lambda m: F.concat(F.lit("<|im_start|>"), F.coalesce(m["role"], F.lit("")), F.lit("\n"), m["content"], F.lit("<|im_end|>")),
    )
    return listed.withColumn("formatted", F.array_join(turns, "\n"))


def links_text(messages: Column) -> Column:
    """Turn, parent, thread, depth and number of quotes of every message, ``-`` for NULL, as one text."""
    fields = ("turn", "parent_turn", "thread", "depth", "n_quotes")
    each = F.transform(messages, lambda m: F.concat_ws("/", *[F.coalesce(m[f].cast("string"), F.lit("-")) for f in fields]))
    return F.array_join(each, " ")
