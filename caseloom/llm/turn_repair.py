"""Repair of conversation structure by the cheapest edits.

A conversation is legal when the initials of its roles read ``(s?(ua)+)?``. Rows are kept, given another role or deleted, and
empty rows are inserted; the cheapest way wins, and among equals the audit (one letter an edit) that is least in ASCII.

Cost and audit are one integer. A path through the rows passes one edge per row; an edge weighs its cost, shifted above all
letters, plus the letters of its step in the row's own slot of fixed width, padded with zeros at the end. A step ends with
the only letter that is not an insertion, so no step is the start of another and slots compare as the audits do. The least
path of a directed acyclic graph with integer weights is then the answer, and nothing but ``<`` on integers decides.

Long conversations are cut into blocks. A block gives the least path between any two of the four states; within a block the
paths that leave one state are ranked by their letters, and blocks of blocks are joined in the same way, cost above one rank
per block. So no task holds more than a block, whatever a conversation's length; the way back down names each block's states.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import groupby, pairwise

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from caseloom.llm.common import arrow_map, positions, same
from caseloom.session import materialize

START, SYSTEM, USER, ASSISTANT = STATES = range(4)
INITIALS = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
#: The role that can be inserted or given after a state.
NEXT = {START: USER, SYSTEM: USER, ASSISTANT: USER, USER: ASSISTANT}
LEGAL = ("su", "ua", "au")
RETAG, DELETE, INSERT, CUT_OFF = 1, 2, 5, 5
#: Insertions that end a conversation in each state.
ENDING = {START: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
#: Digits of letters in ASCII order; zero is padding.
DIGITS = {"D": 1, "I": 2, "K": 3, "R": 4}
STEP, SLOT, RANK = 3, 9, 2
#: Rows in a block, and blocks in a block of blocks.
BLOCK = 256
BLANK, REPEATED, TRUNCATED = "b", "r", "t"


def code(letters: str) -> int:
    """The slot of a step: three bits a letter, padded with zeros at the end."""
    digits = [DIGITS[c] for c in letters] + [0] * (STEP - len(letters))
    return digits[0] << 6 | digits[1] << 3 | digits[2]


def letters(slot: int) -> str:
    return "".join(" DIKR"[slot >> shift & 7] for shift in (6, 3, 0)).strip()


@lru_cache(None)
def steps(initial: str, fault: str) -> tuple[tuple[int, int, int, int], ...]:
    """The edges of a row, ``(from, to, cost, slot)``: up to two insertions, as more could be left out, then its own edit."""
    found: dict[tuple[int, int], int] = {}
    for begin in STATES:
        state, inserted = begin, ""
        for _ in range(STEP):
            cost, extra = INSERT * len(inserted), CUT_OFF if fault == TRUNCATED else 0
            edits = [("D", state, DELETE)]
            if fault not in (BLANK, REPEATED):
                role = INITIALS.get(initial)
                if role is not None and (role == NEXT[state] or (role == SYSTEM and state == START)):
                    edits.append(("K", role, extra))
                edits.append(("R", NEXT[state], RETAG + extra))
            for letter, end, price in edits:
                weight = (cost + price) << SLOT | code(inserted + letter)
                if weight < found.get((begin, end), weight + 1):
                    found[begin, end] = weight
            state, inserted = NEXT[state], inserted + "I"
    return tuple((s, t, w >> SLOT, w & ((1 << SLOT) - 1)) for (s, t), w in found.items())


def lightest(layers: list, bits: int, begin: int) -> dict[int, int]:
    """The least weight from ``begin`` to each state behind all layers: cost above one slot of ``bits`` per layer."""
    width = bits * len(layers)
    weights, shift = {begin: 0}, width
    for edges in layers:
        shift -= bits
        reached: dict[int, int] = {}
        for s, t, cost, slot in edges:
            if s in weights:
                weight = weights[s] + (cost << width) + (slot << shift)
                if t not in reached or weight < reached[t]:
                    reached[t] = weight
        weights = reached
    return weights


def summary(layers: list, bits: int) -> list[int]:
    """Of every pair of states the cost and, among the paths from the same state, the rank by slots; -1 without a path."""
    width, out = bits * len(layers), []
    for begin in STATES:
        found = lightest(layers, bits, begin)
        ranks = {t: i for i, t in enumerate(sorted(found, key=lambda t: found[t] & ((1 << width) - 1)))}
        out += [(found[t] >> width) << RANK | ranks[t] if t in found else -1 for t in STATES]
    return out


def edges(summed: list[int]) -> list[tuple[int, int, int, int]]:
    """A block as a layer: its pairs of states with cost and rank."""
    return [(i // 4, i % 4, v >> RANK, v & ((1 << RANK) - 1)) for i, v in enumerate(summed) if v >= 0]


def route(layers: list, bits: int, begin: int, end: int) -> list[tuple[int, int, int]]:
    """The least path between two states, one ``(from, to, slot)`` per layer: a state and a slot name one edge."""
    weight, shift, state, path = lightest(layers, bits, begin)[end], bits * len(layers), begin, []
    for found in layers:
        shift -= bits
        slot = weight >> shift & ((1 << bits) - 1)
        after = next(t for s, t, _, other in found if s == state and other == slot)
        path.append((state, after, slot))
        state = after
    return path


def in_groups(df: DataFrame, keys: int, order: int, make: Callable, schema: str) -> DataFrame:
    """``make(key, rows)`` per group of the first ``keys`` columns, its rows sorted by the next ``order`` columns."""
    names = [f"`{c}`" for c in df.columns]
    dealt = df.repartition(*names[:keys]).sortWithinPartitions(*names[: keys + order])
    kind = to_arrow_schema(StructType.fromDDL(schema))

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(kind)], schema=kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[c.to_pylist() for c in b.columns], strict=True))
        out = []
        for key, group in groupby(rows, key=lambda row: row[:keys]):
            out += make(key, list(group))
            if len(out) > 4096:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    return arrow_map(dealt, run, schema)


def damage(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """``conv_id, turn, role, text, copy``: rows dropped, emptied, cut off, repeated or given to the user by a checksum.

    The checksum is crc32 of ``conv_id:turn`` modulo 20; NULL counts as one space there, in roles and in texts.
    """
    rows = conversations.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    )
    spelled = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    harm = F.crc32(F.concat(spelled[0], F.lit(":"), spelled[1])) % 20
    rows = rows.withColumn("harm", harm).where("harm <> 0")
    kept = F.when(F.col("harm") == 1, "").when(F.col("harm") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.sequence(F.lit(0), F.when(F.col("harm") == 3, 1).otherwise(0))
    named = F.when(F.col("harm") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", named.alias("role"), kept.alias("text"), F.explode(copies).alias("copy"))


def observe(rows: DataFrame) -> DataFrame:
    """Number each conversation's rows by turn (NULL first, then role, digest of the text, copy) and name their first fault.

    ``pos, initial, fault`` are added: blank, repeated (role and text stand earlier) or truncated.
    """
    order = [F.col("turn").asc_nulls_first(), F.col("role"), F.sha2("text", 256), F.col("copy")]
    placed = materialize(positions(rows, ["conv_id"], order, "pos"))
    firsts = placed.groupBy("conv_id", "role", "text").agg(F.min("pos").alias("__pos"))
    firsts = firsts.select(F.col("conv_id").alias("__conv"), "__pos")
    met = placed.join(firsts, same(placed, firsts, {"conv_id": "__conv", "pos": "__pos"}), "left")
    fault = (
        F.when(~F.col("text").rlike(r"[^\x20\x09-\x0D]"), BLANK)
        .when(F.col("__pos").isNull(), REPEATED)
        .when(~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z"), TRUNCATED)
        .otherwise("")
    )
    return materialize(met.select(*placed.columns, F.substring("role", 1, 1).alias("initial"), fault.alias("fault")))


def summaries(observed: DataFrame, kind: str, block: int) -> DataFrame:
    """``conv_id, block, summary, first, last, illegal`` of every block of rows."""

    def make(key: tuple, rows: list[tuple]) -> list[tuple]:
        initials = [r[3] for r in rows]
        wrong = sum(a + b not in LEGAL for a, b in pairwise(initials))
        return [(*key, summary([steps(r[3], r[4]) for r in rows], SLOT), initials[0], initials[-1], wrong)]

    narrow = observed.select("conv_id", F.expr(f"pos div {block}").alias("block"), "pos", "initial", "fault")
    return materialize(in_groups(narrow, 2, 1, make, SUMMARY.format(kind=kind)))


SUMMARY = "conv_id {kind}, block long, summary array<long>, first string, last string, illegal long"


def joined(blocks: DataFrame, kind: str, block: int) -> DataFrame:
    """Blocks of blocks, summed up like blocks."""

    def make(key: tuple, rows: list[tuple]) -> list[tuple]:
        wrong = sum(r[6] for r in rows) + sum(a[5] + b[4] not in LEGAL for a, b in pairwise(rows))
        return [(*key, summary([edges(r[3]) for r in rows], RANK), rows[0][4], rows[-1][5], wrong)]

    parents = blocks.select("conv_id", F.expr(f"block div {block}").alias("parent"), "block", "summary", "first", "last", "illegal")
    return materialize(in_groups(parents, 2, 1, make, SUMMARY.format(kind=kind)))


def descended(blocks: DataFrame, chosen: DataFrame, kind: str, block: int) -> DataFrame:
    """``conv_id, block, begin, end``: the states of every block on the least path, given those of the blocks above."""

    def make(key: tuple, rows: list[tuple]) -> list[tuple]:
        path = route([edges(r[3]) for r in rows], RANK, *rows[0][4:])
        return [(key[0], r[2], begin, end) for r, (begin, end, _) in zip(rows, path, strict=True)]

    chosen = chosen.toDF("__conv", "__block", "begin", "end")
    parents = blocks.select("conv_id", F.expr(f"block div {block}").alias("parent"), "block", "summary")
    met = parents.join(chosen, same(parents, chosen, {"conv_id": "__conv", "parent": "__block"}))
    met = met.select("conv_id", "parent", "block", "summary", "begin", "end")
    return materialize(in_groups(met, 2, 1, make, f"conv_id {kind}, block long, begin int, end int"))


def final_state(summed: Column) -> Column:
    """``(cost, rank, state)`` of the least path from the start, insertions at the end included."""
    ways = [
        F.when(
            F.get(summed, F.lit(t)) >= 0,
            F.struct(
                (F.shiftright(F.get(summed, F.lit(t)), RANK) + INSERT * ENDING[t]).alias("cost"),
                F.get(summed, F.lit(t)).bitwiseAND(F.lit((1 << RANK) - 1)).alias("rank"),
                F.lit(t).alias("state"),
            ),
        )
        for t in STATES
    ]
    return F.array_min(F.array(*ways))


def repair(observed: DataFrame, block: int = BLOCK) -> tuple[DataFrame, DataFrame]:
    """Edits of the rows of ``observe``, and what they come to.

    ``conv_id, pos, audit, roles``: the letters of a row's step and the initials they leave, ``-`` where a row is deleted;
    insertions after the last row stand at a position of their own. ``conv_id, cost, illegal``: one row per conversation.
    """
    kind = observed.schema["conv_id"].dataType.simpleString()
    levels = [summaries(observed, kind, block)]
    while not levels[-1].where("block > 0").isEmpty():
        levels.append(joined(levels[-1], kind, block))
    best = levels[-1].select("conv_id", "illegal", final_state(F.col("summary")).alias("best"))
    verdicts = materialize(best.select("conv_id", "best.cost", "illegal", "best.state"))
    chosen = verdicts.select("conv_id", F.lit(0).cast("long").alias("block"), F.lit(START).alias("begin"), F.col("state").alias("end"))
    for level in levels[-2::-1]:
        chosen = descended(level, chosen, kind, block)

    def make(key: tuple, rows: list[tuple]) -> list[tuple]:
        out = []
        for r, (begin, _, slot) in zip(rows, route([steps(r[3], r[4]) for r in rows], SLOT, *rows[0][5:]), strict=True):
            audit, state, roles = letters(slot), begin, ""
            for letter in audit:
                if letter != "D":
                    state = SYSTEM if letter == "K" and r[3] == "s" else NEXT[state]
                roles += "-" if letter == "D" else " sua"[state]
            out.append((key[0], r[2], audit, roles))
        return out

    narrow = observed.select("conv_id", F.expr(f"pos div {block}").alias("block"), "pos", "initial", "fault")
    ends = chosen.toDF("__conv", "__block", "begin", "end")
    met = narrow.join(ends, same(narrow, ends, {"conv_id": "__conv", "block": "__block"})).drop("__conv", "__block")
    edited = in_groups(met, 2, 1, make, f"conv_id {kind}, pos long, audit string, roles string")
    last = F.when(F.col("state") == SYSTEM, "ua").when(F.col("state") == USER, "a")
    added = verdicts.where(F.col("state").isin(SYSTEM, USER))
    added = added.select("conv_id", F.lit((1 << 63) - 1).alias("pos"), F.repeat(F.lit("I"), F.length(last)).alias("audit"), last.alias("roles"))
    return materialize(edited.unionByName(added)), verdicts.drop("state")


def repaired(observed: DataFrame, edits: DataFrame) -> DataFrame:
    """``conv_id, pos, sub, role, text``: the repaired conversations, inserted rows with empty texts."""
    edits = edits.withColumnsRenamed({"conv_id": "__conv", "pos": "__pos"})
    met = edits.join(observed, same(edits, observed, {"__conv": "conv_id", "__pos": "pos"}), "left")
    lines = met.select("__conv", "__pos", "audit", "roles", "role", "text", F.explode(F.sequence(F.lit(1), F.length("audit"))).alias("sub"))
    letter, initial = F.substring("audit", F.col("sub"), F.lit(1)), F.substring("roles", F.col("sub"), F.lit(1))
    given = F.when(initial == "u", "user").otherwise("assistant")
    return lines.where(initial != "-").select(
        F.col("__conv").alias("conv_id"), F.col("__pos").alias("pos"), "sub",
        F.when(letter == "K", F.col("role")).otherwise(given).alias("role"),
        F.when(letter == "I", "").otherwise(F.col("text")).alias("text"),
    )


def digests(lines: DataFrame) -> DataFrame:
    """``conv_id, sha256`` of each conversation's ``role:text`` lines, joined by newlines.

    A digest reads its conversation from the first line to the last, so the lines of one conversation pass one task; they
    are streamed, and the task holds one batch.
    """
    kind = lines.schema["conv_id"].dataType.simpleString()
    narrow = lines.select("conv_id", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    dealt = narrow.repartition("conv_id").sortWithinPartitions("conv_id", "pos", "sub")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, digest = None, None
        for batch in batches:
            ids, found = [], []
            for conv, line in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if digest is None or conv != current:
                    if digest is not None:
                        ids.append(current)
                        found.append(digest.hexdigest())
                    current, digest = conv, hashlib.sha256(line.encode())
                else:
                    digest.update(b"\n" + line.encode())
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(found, pa.string())], names=NAMES)
            last = batch.schema.field(0).type
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([current], last), pa.array([digest.hexdigest()])], names=NAMES)

    return arrow_map(dealt, run, f"conv_id {kind}, sha256 string")


NAMES = ["conv_id", "sha256"]


def report(
    conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", block: int = BLOCK
) -> DataFrame:
    """Damage conversations, repair them, and return one row per original ``conv_id``, NULL being a conversation of its own.

    ``gaps`` are turns missing between the least and the greatest; ``blank, duplicate, truncated`` count first faults;
    ``illegal`` counts neighbours whose role initials are not su, ua or au; ``cost, audit, repaired_sha256`` are those of the
    cheapest repair. A conversation without rows after damage has zeros, an empty audit and the digest of the empty text.
    Repeated rows are rows; rows of one turn stand by role and digest of the text. Other columns are not read. An empty
    table gives no rows.
    """
    observed = observe(damage(conversations, conv, turn, role, text))
    edits, verdicts = repair(observed, block)
    whole = (F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn")).cast("long")
    faults = observed.groupBy("conv_id").agg(
        F.coalesce(whole, F.lit(0)).alias("gaps"), F.count_if(F.col("fault") == BLANK).alias("blank"),
        F.count_if(F.col("fault") == REPEATED).alias("duplicate"), F.count_if(F.col("fault") == TRUNCATED).alias("truncated"),
    )

    def in_order(name: str, of: str) -> Column:
        listed = F.array_sort(F.collect_list(F.struct(F.col(name), F.col(of))))
        return F.array_join(F.transform(listed, lambda x: x[of]), "").alias(of)

    audits = edits.groupBy("conv_id", F.expr(f"pos div {block}").alias("part")).agg(in_order("pos", "audit"))
    audits = audits.groupBy("conv_id").agg(in_order("part", "audit"))
    out = conversations.select(F.col(conv).alias("conv_id")).distinct()
    for found in (faults, verdicts, audits, digests(repaired(observed, edits))):
        found = found.withColumnRenamed("conv_id", "__conv")
        out = out.join(found, same(out, found, {"conv_id": "__conv"}), "left").drop("__conv")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    empty = hashlib.sha256(b"").hexdigest()
    return out.select(
        "conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("sha256", F.lit(empty)).alias("repaired_sha256"),
    )
