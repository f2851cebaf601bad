"""Replies that quote some paragraphs of a message, re-wrapped by the mail client."""

import random
import textwrap

import duckdb
import pyarrow as pa
from oracle import differences
from test_copies import assert_same
from test_quotes import COLUMNS, brute

from caseloom.llm import queries, quotes, sql


def ordered(spark, rows):
    found = quotes.reply_order(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    return {r.turn: (r.parent_turn, r.thread, r.depth, r.position, r.content) for r in found.collect()}


FIRST = "The first paragraph goes\non over two lines.\n\nThe second one\nis not quoted.\n\nThe third closes\nthe message."


def test_two_of_three_paragraphs_rewrapped(spark):
    rows = [
        (1, 0, "user", FIRST),
        (1, 1, "user", "Something else"),
        (1, 2, "assistant", "> The first\n> paragraph goes on over two lines.\n>\n> The third closes the\n> message.\nAgreed"),
        (1, 3, "user", "> Agreed\nThanks"),
    ]
    found = ordered(spark, rows)
    assert {t: r[:4] for t, r in found.items()} == {0: (None, 0, 0, 0), 1: (None, 1, 0, 3), 2: (0, 0, 1, 1), 3: (2, 0, 2, 2)}
    assert found[2][4] == "Agreed"


def test_ranks_whole_then_paragraph_then_line(spark):
    long = "A line that is longer than both of the paragraphs taken together, and much longer at that."
    rows = [
        (1, 0, "u", "one two\n\nmore"),
        (1, 1, "u", f"{long}\nand so on"),
        (1, 2, "u", f"> one\n> two\n> \n> {long}\n> not said\nparagraph before line"),
        (1, 3, "u", "one two three four"),
        (1, 4, "u", f"one two\n\n{long}"),
        (1, 5, "u", f"> one\n> two\n>\n> {long}\nwhole before paragraph"),
    ]
    found = ordered(spark, rows)
    assert found[2][0] == 0 and found[5][0] == 4


def mail(pick, conversations, turns):
    """Messages of paragraphs; replies quote some of them, re-wrapped, at one or two levels, in whole or in part."""
    rows = []
    for conv in range(conversations):
        said = []
        for turn in range(turns):
            own = [" ".join(f"w{pick.randrange(400)}" for _ in range(pick.randint(4, 24))) for _ in range(pick.randint(1, 3))]
            lines = []
            if said and pick.random() < 0.8:
                for level in range(pick.randint(1, 2)):
                    chosen = pick.choice(said)
                    some = [p for p in chosen if pick.random() < 0.7] or chosen
                    width, sign = pick.choice([18, 30, 60]), ">" * (level + 1)
                    quoted = f"\n{sign}\n".join("\n".join(f"{sign} {x}" for x in textwrap.wrap(p, width)) for p in some)
                    lines.append(("On Monday, they wrote:\n" if pick.random() < 0.5 else "") + quoted)
            lines.append("\n\n".join("\n".join(textwrap.wrap(p, 40)) for p in own))
            said.append(own)
            rows.append((conv, turn, pick.choice(["user", "assistant", None]), "\n".join(lines)))
    return rows


def test_rewrapped_partial_and_nested_quotes_through_sql(spark, tmp_path):
    """Operator, brute force and SQL agree on every message, and the query with its SQL on the formatted chat."""
    rows = mail(random.Random(8), 8, 30)
    data = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    found = quotes.reply_order(data)
    assert_same(found.select(*COLUMNS).collect(), brute(rows))
    assert found.where("parent_turn IS NOT NULL").count() > 100
    connection = duckdb.connect()
    connection.register("conversations", pa.table({c: [r[i] for r in rows] for i, c in enumerate(data.columns)}))
    assert not differences(found, connection, sql.QUOTES)
    data.write.parquet(str(tmp_path / "conversations.parquet"))
    chat = queries.op2_quotation_linking(spark, str(tmp_path))
    assert not differences(chat, connection, sql.CHAT)
    assert all("\n>" not in r.formatted for r in chat.collect()) and chat.count() == 8


def test_partial_quote_of_the_sql(spark):
    """The reply to two of three paragraphs: parent 0, thread 0, depth 1, also in SQL."""
    text = "> The first\n> paragraph goes on over two lines.\n>\n> The third closes the\n> message.\nAgreed"
    rows = [(1, 0, "user", FIRST), (1, 1, "user", "Something else"), (1, 2, "assistant", text)]
    connection = duckdb.connect()
    connection.register("conversations", pa.table({c: [r[i] for r in rows] for i, c in enumerate(["conv_id", "turn", "role", "text"])}))
    found = connection.execute(f"SELECT parent_turn, thread, depth FROM ({sql.QUOTES}) WHERE turn = 2").fetchall()
    assert found == [(0, 0, 1)]
