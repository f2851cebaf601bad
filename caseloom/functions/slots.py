"""Constant lookup tables inside column expressions."""

from __future__ import annotations

import json
import zlib
from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def slot_lookup(entries: Mapping[str, int], word: Column, table: Column) -> Column:
    """Value of ``word`` in a table made by ``slot_table`` from the same entries; NULL when it has none."""
    slots = slot_count(entries)
    slot = F.element_at(table, (F.pmod(F.crc32(word), F.lit(slots)) + 1).cast("int"))
    return F.try_element_at(slot, word)


def slot_count(entries: Mapping[str, int]) -> int:
    return max(64, len(entries) // 4)


def slot_table(entries: Mapping[str, int]) -> Column:
    """The entries as a constant array of small maps, indexed by a hash of the word.

    Spark's map access compares key by key; with the hash as array index a lookup costs a few comparisons for tables of
    any size, and works inside array lambdas, without a join or a Python worker. Keep the entries bounded: the table is
    part of the plan.
    """
    slots: list[dict[str, int]] = [{} for _ in range(slot_count(entries))]
    for word, value in entries.items():
        slots[zlib.crc32(word.encode()) % len(slots)][word] = value
    return F.from_json(F.lit(json.dumps(slots, ensure_ascii=False)), "array<map<string,bigint>>")
