import hashlib
import random

import duckdb
import pytest

from flowlens.llm import chat as op
from flowlens.llm.queries import SQL, op12_chat_format

CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<|", "<|end|>\n", "\n<</SYS>>\n\n", " [/INST]", " </s>", "<s>[INST] ", "\\", "\n", " ", "é", "😀", "x"]
SCHEMA = "conv_id long, turn long, role string, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def wanted(rows):
    convs = {}
    for c, t, r, x in rows:
        convs.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in convs.items():
        turns.sort()
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, _, r, x in turns)), len(loss), sha(loss))
    return out


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in op.digests(op.format_conversations(df)).collect()}


def test_hostile_texts_come_back(spark):
    """Texts made of control strings, backslashes and end marks, under any order of roles."""
    r = random.Random(2)
    roles = ["user", "assistant", "system", "tool", "", None, "a|>\n b", "end", "é %"]
    rows = [(c, t, r.choice(roles), "".join(r.choice(CONTROLS) for _ in range(r.randrange(9)))) for c in range(150) for t in range(r.randrange(1, 7))]
    rows += [(None, 0, "user", "no id"), (500, None, "assistant", None), (500, 1, None, None), (501, 0, "user", ""), (502, 3, "assistant", "same"), (502, 3, "assistant", "same"), (503, -5, "user", "y" * 300_000)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as part", "2 as body", "3 as first").repartition(5)
    assert got(df) == wanted(rows)


def test_long_conversation_is_many_rows(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"turn {t} </s>") for t in range(1000)]
    parts = op.format_conversations(spark.createDataFrame(rows, SCHEMA))
    assert parts.count() == -(-1000 // op.PART_TURNS) and got(spark.createDataFrame(rows, SCHEMA)) == wanted(rows)


def test_text_and_mask(spark):
    rows = [(1, 0, "system", "be kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "yes"), (1, 3, "tool", "7"), (1, 4, "assistant", "a\\</s>")]
    (p,) = op.format_conversations(spark.createDataFrame(rows, SCHEMA)).collect()
    assert p.formatted == "<<SYS>>\nbe kind\n<</SYS>>\n\n<s>[INST] hi \\[INST] [/INST] yes </s><|tool|>\n7\n<|end|>\n a\\\\</s> </s>"
    assert [p.formatted[s.start : s.start + s.chars] for s in p.spans] == ["yes", "a\\\\</s>"]
    assert [(t.role, t.text) for t in p.turns] == [r[2:] for r in rows]


@pytest.mark.parametrize("text", ["junk", "<s>[INST] open", "<s>[INST] a [/INST]tail", " a <s> b </s>"])
def test_parser_rejects(spark, text):
    """What the grammar does not allow reads back without a text."""
    from pyspark.sql import functions as F

    turns = spark.createDataFrame([(text,)], "t string").select(op.parsed(F.col("t")).alias("x")).first().x
    assert turns[-1].text is None and sum(t.chars for t in turns) == len(text)


def test_empty(spark):
    assert op.digests(op.format_conversations(spark.createDataFrame([], SCHEMA))).count() == 0


def test_as_sql(spark):
    d = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"create view conversations as select * from '{d}/conversations.parquet'")
    cols = "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars".split()
    out = sorted(tuple(r) for r in op12_chat_format(spark, d).select(cols).collect())
    assert out == sorted(c.sql(f"select {', '.join(cols)} from ({SQL['op12_chat_format']})").fetchall())
    assert out[0][0] == -1 and out[0][1] == 2 and out[0][3] == len("</s>[INST] ok [/INST]")
