"""Conversation repair against a search that knows neither blocks, slots nor weights."""

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from test_copies import assert_same

from caseloom.llm import turn_repair

LEGAL = re.compile(r"(s?(ua)+)?")
SPACE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        harm = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if harm == 0:
            continue
        text = "" if harm == 1 else re.sub("[.!?]", "", text) if harm == 2 else text
        out += [(conv, turn, "user" if harm == 4 else role, text)] * (2 if harm == 3 else 1)
    return out


def faults(rows):
    """rows (role, text) in order"""
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(SPACE)
        fault = "b" if not bare else "r" if (role, text) in seen else "" if bare[-1] in ".!?" else "t"
        seen.add((role, text))
        out.append(fault)
    return out


def cheapest(rows, found):
    """(cost, audit, lines) over all edits: a memo over suffixes and the role before them, comparing tuples."""

    @lru_cache(None)
    def best(i, last, began):
        ways = []
        if i == len(rows):
            if last in ("", "a"):
                ways.append((0, "", ()))
        else:
            role, text = rows[i]
            cost, audit, lines = best(i + 1, last, began)
            ways.append((2 + cost, "D" + audit, lines))
            if found[i] in ("", "t"):
                extra = 5 if found[i] == "t" else 0
                for price, letter, name in ((0, "K", role), (1, "R", "user"), (1, "R", "assistant")):
                    if (name[:1] == "s" and last == "") or (name and last + name[:1] in ("u", "su", "ua", "au")):
                        cost, audit, lines = best(i + 1, name[:1], False)
                        ways.append((price + extra + cost, letter + audit, (f"{name}:{text}", *lines)))
        if began != 2:
            name = "assistant" if last == "u" else "user"
            cost, audit, lines = best(i, name[0], began + 1)
            ways.append((5 + cost, "I" + audit, (f"{name}:", *lines)))
        return min(ways, default=(10**9, "", ()))

    return best(0, "", 0)


def brute(rows):
    conversations = {conv: [] for conv, *_ in rows}
    for row in damaged(rows):
        conversations[row[0]].append(row[1:])
    out = []
    for conv, held in conversations.items():
        held.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).hexdigest()))
        turns = [t for t, *_ in held if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        pairs = [(r, t) for _, r, t in held]
        found = faults(pairs)
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(pairs, pairs[1:]))
        cost, audit, lines = cheapest(tuple(pairs), tuple(found))
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *[found.count(f) for f in "brt"], illegal, cost, audit, sha))
    return out


SCHEMA = "conv_id long, turn long, role string, text string, pos long, audit string, block long"


def made(pick, conversations, longest):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "u"]
    rows = []
    for conv in range(conversations):
        for turn in range(pick.randint(1, longest)):
            usual = ("user", "assistant")[turn % 2] if turn or pick.random() < 0.7 else "system"
            role = usual if pick.random() < 0.5 else pick.choice(roles)
            text = pick.choice(["Yes.", "no", "", None, " \n", "What?", f"It is {pick.randint(0, 99)}.", "é!\t", "…", "a. "])
            place = None if pick.random() < 0.1 else turn + pick.randint(0, 2)
            rows += [(None if conv == 3 else conv, place, role, text)] * (2 if pick.random() < 0.1 else 1)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(*r, None, None, None) for r in rows], SCHEMA)


@pytest.mark.parametrize("block, longest", [(256, 9), (3, 40), (2, 70)])
def test_equals_brute_force(spark, block, longest):
    """Blocks of 2 and 3 rows: several levels of blocks give the same path."""
    rows = made(random.Random(block), 60, longest)
    found = turn_repair.report(frame(spark, rows).repartition(5), block=block)
    assert found.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert_same(found.collect(), brute(rows))


def test_given_conversations(spark, folder):
    rows = spark.read.parquet(f"{folder}/conversations.parquet").select("conv_id", "turn", "role", "text")
    assert_same(turn_repair.report(rows).collect(), brute([tuple(r) for r in rows.collect()]))


def test_repaired_rows_are_legal_and_digested(spark):
    rows = made(random.Random(9), 40, 12)
    observed = turn_repair.observe(turn_repair.damage(frame(spark, rows)))
    edits, verdicts = turn_repair.repair(observed, 4)
    lines = turn_repair.repaired(observed, edits)
    read = {}
    for r in sorted(lines.collect(), key=lambda r: (r.pos, r.sub)):
        read.setdefault(r.conv_id, []).append(f"{r.role}:{r.text}")
    assert all(LEGAL.fullmatch("".join(line[:1] for line in held)) for held in read.values())
    digests = {c: hashlib.sha256("\n".join(held).encode()).hexdigest() for c, held in read.items()}
    assert digests == {r.conv_id: r.sha256 for r in turn_repair.digests(lines).collect()}
    assert verdicts.count() == observed.select("conv_id").distinct().count()


def test_every_edit_of_small_conversations(spark):
    """All sequences of four initials and faults: the integer minimum is the least of the enumerated audits."""
    pick = random.Random(5)
    for _ in range(300):
        size = pick.randint(0, 6)
        rows = [(pick.choice(["user", "assistant", "system", "x"]), str(i)) for i in range(size)]
        marks = [pick.choice(["", "", "t", "b", "r"]) for _ in rows]
        layers = [turn_repair.steps(r[:1], f) for (r, _), f in zip(rows, marks, strict=True)]
        ways = []
        for state, weight in turn_repair.lightest(layers, turn_repair.SLOT, turn_repair.START).items():
            width = turn_repair.SLOT * size
            audit = "".join(turn_repair.letters(weight >> turn_repair.SLOT * (size - 1 - i) & 511) for i in range(size))
            end = turn_repair.ENDING[state]
            ways.append(((weight >> width) + 5 * end, audit + "I" * end))
        assert min(ways) == cheapest(tuple(rows), tuple(marks))[:2]


def test_empty_and_lost_conversations(spark):
    nothing = frame(spark, []).where("false")
    assert turn_repair.report(nothing).count() == 0
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    rows = [(lost, 0, "user", "Hello.")]
    empty = hashlib.sha256(b"").hexdigest()
    assert_same(turn_repair.report(frame(spark, rows)).collect(), [(lost, 0, 0, 0, 0, 0, 0, "", empty)])
