import random
import re

import duckdb
import pyarrow as pa
from oracle import differences
from test_copies import assert_same

from caseloom.llm import quotes, sql

COLUMNS = ["conv_id", "position", "turn", "role", "parent_turn", "thread", "depth", "n_quotes", "content"]


def norm(text):
    return re.sub(r"\s+", " ", text).strip(" ").lower()


def brute(rows):
    """rows (conv, turn, role, text) -> the columns of reply_order"""
    parsed = []
    for conv, turn, role, text in rows:
        passages = []
        for line in re.split("\r?\n", text or ""):
            sign = re.match(r"(?:[ \t]*>)+", line)
            level = sign.group().count(">") if sign else 0
            bare = re.sub(r"^(?:[ \t]*>)+ ?", "", line)
            if passages and passages[-1][0] == level:
                passages[-1][1].append(bare)
            else:
                passages.append((level, [bare]))
        own = []
        for k, (level, lines) in enumerate(passages):
            if level:
                continue
            body = "\n".join(lines)
            if k + 1 < len(passages):
                body = re.sub(r"(?:^|\n)[^\n]*\b(?:wrote|writes|schrieb)[ \t]*:\s*$", "", body)
            own.append(body.strip(" \t\n\x0b\x0c\r"))
        content = "\n".join(o for o in own if o)
        parsed.append((conv, turn, role, content, [(level, "\n".join(lines)) for level, lines in passages if level]))
    first = {}
    for conv, turn, _, content, _ in parsed:
        for unit in [content, *re.split(r"\n[ \t]*\n", content), *content.split("\n")]:
            if norm(unit) and turn is not None:
                first[conv, norm(unit)] = min(turn, first.get((conv, norm(unit)), turn))
    parent = {}
    for conv, turn, _, _, found in parsed:
        for k, (level, text) in enumerate(found):
            paragraphs = re.split(r"\n[ \t]*\n", text)
            units = [(2, text), *((1, p) for p in paragraphs if len(paragraphs) > 1), *((0, x) for x in text.split("\n"))]
            options = [(rank, len(norm(x)), first.get((conv, norm(x)))) for rank, x in units if norm(x)]
            options = [o for o in options if o[2] is not None and turn is not None and o[2] < turn]
            if options:
                link = (level, k, max(options)[2])
                parent[conv, turn] = min(parent.get((conv, turn), link), link)
    out = []
    for conv, turn, role, content, found in parsed:
        at, depth = turn, 0
        while (conv, at) in parent:
            at, depth = parent[conv, at][2], depth + 1
        mine = parent.get((conv, turn))
        out.append([conv, None, turn, role, mine[2] if mine else None, at, depth, len(found), content])
    key = lambda r: tuple((v is None, v if v is not None else 0) for v in (r[5], r[2]))
    for conv in {r[0] for r in out}:
        for i, r in enumerate(sorted((r for r in out if r[0] == conv), key=lambda r: (key(r), r[3] is not None, r[3] or "", r[8]))):
            r[1] = i
    return [tuple(r) for r in out]


def frame(spark, rows):
    extra = "level int, passages string, position long, part long, place long"
    return spark.createDataFrame([(*r, *(None,) * 5) for r in rows], f"conv_id long, turn long, role string, text string, {extra}")


def test_odd_messages(spark):
    rows = [
        (1, 0, "user", "Hello there friend\n\nHow are you?"),
        (1, 1, "assistant", "On Monday, user wrote:\n> Hello there friend\n> \n> How are you?\n\nFine, thanks"),
        (1, 2, "user", "> Fine,  THANKS\n>> How are you?\nGood to hear"),
        (1, 3, "assistant", ">> Fine, thanks\r\n> Good to hear\r\nyes"),
        (1, 4, "user", "> > not there\n> How are you?\nlate reply"),
        (1, 4, "user", "> > not there\n> How are you?\nlate reply"),
        (None, 0, "user", None), (None, 1, None, "> \nfoo"), (None, 2, "u", "> foo"),
        (2, None, "x", "> a"), (2, 1, "u", "a"), (2, 5, None, ">a\n" * 3000 + "end"), (3, 0, "u", ""), (3, 1, "u", "> same turn later\n"), (3, 2, "u", "same turn later"),
        (4, 0, "u", "long " * 40000), (4, 1, "u", "> " + "long " * 40000),
    ]
    found = quotes.reply_order(frame(spark, rows))
    assert_same(found.select(*COLUMNS).collect(), brute(rows))
    connection = duckdb.connect()
    data = pa.table({c: [r[i] for r in rows] for i, c in enumerate(["conv_id", "turn", "role", "text"])})
    connection.register("conversations", data)
    assert not differences(found, connection, sql.QUOTES)
    assert quotes.reply_order(frame(spark, rows).where("false")).count() == 0


def test_random_threads(spark):
    pick, rows = random.Random(4), []
    for conv in range(12):
        said = []
        for turn in range(40):
            text = [f"line {conv} {turn} a", "thanks", f"line {turn} b"][: pick.randint(1, 3)]
            quoted = []
            if said and pick.random() < 0.7:
                other = pick.choice(said)
                quoted = [f"> {x}" for x in other] + ([f">> {x}" for x in pick.choice(said)] if pick.random() < 0.4 else [])
            said.append(text)
            rows.append((conv, turn, pick.choice(["user", "assistant"]), "\n".join([*quoted, *text])))
    ordered = quotes.reply_order(frame(spark, rows)).cache()
    assert_same(ordered.select(*COLUMNS).collect(), brute(rows))
    place = {(r.conv_id, r.turn): r.position for r in ordered.collect()}
    assert all(place[r.conv_id, r.parent_turn] < r.position for r in ordered.where("parent_turn is not null").collect())
    parts = quotes.conversations(ordered, part=16).collect()
    assert {len(p.messages) for p in parts} == {16, 8} and not any(">" in m.content for p in parts for m in p.messages)


def test_long_chains(spark):
    rows = [(1, i, "u", (f"> m{i - 1}\n" if i else "") + f"m{i}") for i in range(200)]
    found = {r.turn: (r.thread, r.depth) for r in quotes.reply_order(frame(spark, rows)).collect()}
    assert found == {i: (0, i) for i in range(200)}


def test_conversations_without_quotes_keep_their_order(spark, folder):
    messages = spark.read.parquet(f"{folder}/conversations.parquet")
    rows = [tuple(r) for r in messages.select("conv_id", "turn", "role", "text").collect()]
    assert_same(quotes.reply_order(messages).select(*COLUMNS).collect(), brute(rows))
