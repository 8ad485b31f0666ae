"""Formatted conversations against plain Python: merging, escapes, masks, reading back, hard rows."""

import hashlib
import itertools
import os
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from notefold.llm import queries
from notefold.llm.chat import digests, escaped, format_conversations, read_turns, unescaped
from tests.conftest import SMALL

SCHEMA = "conv_id long, turn long, role string, text string, blocks int, mask string, turns int"
ROWS = [
    (1, 0, "system", "be brief"), (1, 2, "assistant", "one"), (1, 1, "user", "hello\nthere"), (1, 3, "assistant", "two"), (1, 4, "assistant", ""), (1, 5, "user", None),
    (2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "[INST][\\INST][\\\\INST]<s></s><\\s>\\[ROLE]\\\\[TURN]"), (3, 0, None, ""), (4, None, "tool[ROLE]</s>", "x"), (4, None, "tool[ROLE]</s>", "x"),
    (None, 0, "user", "a"), (None, 0, "assistant", "b"), (5, 1, "assistant", "é日\U0001f600\x00 $1 \\"), (5, 1, "assistant", "a"), (6, 0, "Assistant", "no loss"), (7, 0, "assistant", "[" * 9 + "\\" * 9 + "INST]"), (8, 0, "user", "[IN" + "ST] [inst] [/ROLE] <s/>" * 9000),
]


def escape(t):
    return re.sub(r"([\[<]\\*)(?=/?INST\]|ROLE\]|TURN\]|/?s>)", lambda m: m[1] + "\\", t)


def plain(rows):
    """(formatted text, turns, text under the loss) of one conversation."""
    rows = sorted((-1 if t is None else t, r or "", x or "") for _, t, r, x in rows)
    out = []
    for role, own in itertools.groupby(rows, lambda r: r[1]):
        body = "[TURN]".join(escape(x) for *_, x in own)
        out.append(f"<s>{body}</s>" if role == "assistant" else f"[INST]{escape(role)}[ROLE]{body}[/INST]")
    return "".join(out), [r[1:] for r in rows], "".join(x for _, r, x in rows if r == "assistant")


@pytest.fixture(scope="module")
def talks(spark):
    return spark.createDataFrame([(*r, 1, "m", 2) for r in ROWS], SCHEMA)


def test_formatted_and_read_back(talks):
    groups = [[r for r in ROWS if r[0] == c] for c in range(1, 9)] + [[r] for r in ROWS if r[0] is None]
    want = sorted(((g[0][0], *plain(g)) for g in groups), key=repr)
    made = format_conversations(talks)
    got = made.withColumn("turns", read_turns(F.col("formatted"))).collect()
    assert sorted(((r.conv_id, r.formatted) for r in got), key=repr) == [w[:2] for w in want]
    texts = {(c, f): (t, loss) for c, f, t, loss in want}
    for r in got:
        turns, loss = texts[r.conv_id, r.formatted]
        assert [tuple(t) for t in r.turns] == turns
        at, seen = 0, []
        for m in r["mask"]:  # read by places alone
            at += m.skip
            seen += [re.sub(r"([\[<]\\*)\\(?=/?INST\]|ROLE\]|TURN\]|/?s>)", r"\1", r.formatted[at : at + m.length])] if m.loss else []
            at += m.length
        assert "".join(seen) == loss
        assert at <= len(r.formatted) and len(r["mask"]) == len(turns)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    wanted = [(c, len(t), sha("".join(f"{r}\n{x}\n" for r, x in t)), len(loss), sha(loss), len(f)) for c, f, t, loss in want]
    assert sorted((tuple(r)[:6] for r in digests(made).collect()), key=repr) == sorted(wanted, key=repr)


def test_escapes_are_reversible(spark):
    parts = ["[", "<", "\\", "INST]", "/INST]", "s>", "/s>", "ROLE]", "TURN]", "x"]
    texts = ["".join(p) for n in range(5) for p in itertools.product(parts, repeat=n)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", escaped(F.col("t")).alias("e")).withColumn("back", unescaped(F.col("e")))
    assert rows.where("t <> back").count() == 0
    assert rows.where(F.col("e").rlike(r"\[/?INST\]|\[(ROLE|TURN)\]|</?s>")).count() == 0
    assert rows.select("e").distinct().count() == len(texts)


def test_long_conversations_and_none(spark, talks):
    many = spark.range(20_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 5 < 3, "user").otherwise("assistant").alias("role"), F.concat(F.lit("[INST] "), F.col("id").cast("string")).alias("text"))
    (r,) = digests(format_conversations(many)).collect()
    assert (r.n_turns, r.n_blocks) == (20_000, 8_000)
    assert r.loss_chars == sum(len(f"[INST] {k}") for k in range(20_000) if k % 5 >= 3)
    assert format_conversations(talks.where(F.lit(False))).count() == 0


def test_query_is_native_and_equals_sql(spark):
    df = queries.op11_chat_formatting(spark, SMALL)
    plan = df._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan) and "SinglePartition" not in plan
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{os.path.join(SMALL, 'conversations.parquet')}'")
    want = con.execute(queries.OP11_SQL)
    names = [c[0] for c in want.description]
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(want.fetchall())
