"""Operator 12: conversations as training text, checked by reading the text back with a deterministic grammar."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound

#: Strings that steer a model or this grammar; inside texts they are never left bare (fixed values).
CONTROL = r"<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>|<\|"
#: Marks around a turn's text by role; any other role is named in a header (fixed values).
MARKS = {"user": ("<s>[INST] ", " [/INST]"), "assistant": (" ", " </s>"), "system": ("<<SYS>>\n", "\n<</SYS>>\n\n")}
OTHER_END = "\n<|end|>\n"
_HEADER = r"<\|[A-Za-z0-9.*_+%-]*\|>\n"
#: One turn of the grammar; a text ends at the first end mark of its role. \G makes each turn start where the last one ended.
_TURN = r"(?s)\G(?:<s>\[INST\] .*? \[/INST\]|<<SYS>>\n.*?\n<</SYS>>\n\n|" + _HEADER + r".*?\n<\|end\|>\n| .*? </s>)"
#: Turns are formatted in parts by their number, so that a long conversation is many rows.
PART_TURNS = 64


def escaped(text: Column) -> Column:
    """A backslash before every control string; backslashes that stand there already stay."""
    return F.regexp_replace(text, f"({CONTROL})", r"\\$1")


def unescaped(text: Column) -> Column:
    """Takes one backslash from before every control string."""
    return F.regexp_replace(text, rf"\\({CONTROL})", "$1")


def rendered(role: Column, body: Column) -> Column:
    """The text of one turn between its marks."""
    out = F.concat(F.lit("<|"), F.url_encode(role), F.lit("|>\n"), body, F.lit(OTHER_END))
    for name, (before, after) in MARKS.items():
        out = F.when(role == name, F.concat(F.lit(before), body, F.lit(after))).otherwise(out)
    return out


def parsed(formatted: Column) -> Column:
    """The turns of a formatted text: array of (start, chars, role, body_start, body_chars, text).

    start and body_start are code points from the beginning, body_chars those of the text as it stands there. text is what was
    meant, null where a bare control string stands inside, which the grammar does not allow. If the grammar does not reach
    the end of the text, a last turn without role and text holds the rest.
    """
    pieces = F.regexp_extract_all(formatted, F.lit(_TURN), F.lit(0))
    header = lambda p: F.regexp_extract(p, "^" + _HEADER, 0)
    starts = {"user": "<s>", "system": "<<SYS>>\n", "assistant": " "}

    def by_role(p: Column, other: Column, known) -> Column:
        out = other
        for name, mark in starts.items():
            out = F.when(p.startswith(mark), known(name)).otherwise(out)
        return out

    def turn(p: Column) -> Column:
        before = by_role(p, F.char_length(header(p)), lambda r: F.lit(len(MARKS[r][0])))
        after = by_role(p, F.lit(len(OTHER_END)), lambda r: F.lit(len(MARKS[r][1])))
        role = by_role(p, F.url_decode(F.regexp_extract(p, r"^<\|([^|]*)\|>", 1)), F.lit)
        return F.struct(F.char_length(p).alias("chars"), role.alias("role"), before.alias("before"), F.substring(p, before + 1, F.char_length(p) - before - after).alias("body"))

    read = lambda t: F.struct(t["chars"].alias("chars"), t["role"].alias("role"), t["before"].alias("before"), F.char_length(t["body"]).alias("body_chars"),
        F.when(~t["body"].rlike(rf"(?<!\\)(?:{CONTROL})"), unescaped(t["body"])).alias("text"))
    turns = F.transform(F.transform(pieces, turn), read)
    rest = F.char_length(formatted) - F.aggregate(pieces, F.lit(0), lambda n, p: n + F.char_length(p))
    tail = F.when(rest > 0, F.array(F.struct(rest.alias("chars"), F.lit(None).cast("string").alias("role"), F.lit(0).alias("before"), F.lit(0).alias("body_chars"), F.lit(None).cast("string").alias("text"))))
    every = F.concat(turns, F.coalesce(tail, F.array().cast("array<struct<chars:int,role:string,before:int,body_chars:int,text:string>>")))
    placed = lambda done, t: F.struct((done["at"] + t["chars"]).alias("at"), F.concat(done["turns"], F.array(F.struct(done["at"].alias("start"), t["chars"].alias("chars"), t["role"].alias("role"),
        (done["at"] + t["before"]).alias("body_start"), t["body_chars"].alias("body_chars"), t["text"].alias("text")))).alias("turns"))
    none = F.array().cast("array<struct<start:int,chars:int,role:string,body_start:int,body_chars:int,text:string>>")
    return F.aggregate(every, F.struct(F.lit(0).alias("at"), none.alias("turns")), placed)["turns"]


def meant(turns: Column) -> Column:
    """Roles and texts of parsed turns, to compare with the source."""
    return F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))


def format_conversations(rows: DataFrame) -> DataFrame:
    """Conversations (conv_id, turn, role, text) as text: one row for each part, (conv_id, part, formatted, turns, spans, rounds).

    A part holds the turns whose number lies in one range of PART_TURNS, in order of turn, role, text; the parts of a conversation
    after one another are its text. `turns` is what a deterministic parser reads back (see `parsed`), `spans` the code points (start, chars) under the
    loss mask, that is the assistants' texts alone. First every text stands as it is and is read back; turns that do not come back equal
    get their control strings escaped. Then the whole part is read back; if it differs from the source, all its turns are escaped, which
    always reads back equal (every control string then has a backslash before it, and end marks have none); `rounds` is how often it was written. A
    part that still differed would stop the job: nothing is dropped.

    Null text or role: empty. Bytes that are no UTF-8 become U+FFFD first. A null turn comes before all others, in a part of its own (null); a null conv_id is a conversation.
    Repeated rows and rows that share a turn number are turns each, in the same part. An empty table gives no row; extra columns are ignored. No Python runs in the job.
    """
    clean = lambda c: F.make_valid_utf8(F.coalesce(F.col(c).cast("string"), F.lit("")))
    x = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), clean("role").alias("role"), clean("text").alias("text"))
    alone = meant(parsed(rendered(F.col("role"), F.col("text")))) == F.array(F.struct("role", "text"))
    x = x.withColumn("body", F.when(alone, F.col("text")).otherwise(escaped(F.col("text"))))
    part = F.floor(F.col("turn") / PART_TURNS).cast("long").alias("part")
    parts = x.groupBy("conv_id", part).agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text", "body"))).alias("source"))
    text = lambda body: F.array_join(F.transform("source", lambda t: rendered(t["role"], body(t))), "")
    parts = bound(parts, first=text(lambda t: t["body"]))
    parts = bound(parts, first_turns=parsed(F.col("first")))
    wanted = F.transform("source", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    parts = parts.withColumn("same", meant(F.col("first_turns")) == wanted)
    parts = bound(parts, formatted=F.when(F.col("same"), F.col("first")).otherwise(text(lambda t: escaped(t["text"]))))
    parts = bound(parts, turns=F.when(F.col("same"), F.col("first_turns")).otherwise(parsed(F.col("formatted"))))
    checked = F.when(meant(F.col("turns")) == wanted, F.col("turns")).otherwise(F.raise_error(F.concat(F.lit("conversation does not read back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    spans = F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: F.struct(t["body_start"].alias("start"), t["body_chars"].alias("chars")))
    return parts.select("conv_id", "part", "formatted", checked.alias("turns"), spans.alias("spans"), F.when(F.col("same"), 1).otherwise(2).alias("rounds"))


def masked(formatted: Column, spans: Column) -> Column:
    """The texts under the loss mask, one after another, unescaped."""
    return F.array_join(F.transform(spans, lambda s: unescaped(F.substring(formatted, s["start"] + 1, s["chars"]))), "")


def digests(parts: DataFrame) -> DataFrame:
    """One row a conversation, read back from its formatted parts: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    A digest needs all text of its conversation in one row, so a conversation's text must stay below 2 GB here; the parts themselves have no such bound.
    """
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    p = parts.select("conv_id", F.struct("part", said.alias("said"), masked(F.col("formatted"), F.col("spans")).alias("loss")).alias("p"), F.size("turns").cast("long").alias("n"), F.char_length("formatted").cast("long").alias("chars"))
    p = p.groupBy("conv_id").agg(F.sort_array(F.collect_list("p")).alias("p"), F.sum("n").alias("n_turns"), F.sum("chars").alias("formatted_chars"))
    digest = lambda field: F.sha2(F.array_join(F.transform("p", lambda x: x[field]), ""), 256)
    loss = F.aggregate("p", F.lit(0).cast("long"), lambda n, x: n + F.char_length(x["loss"]))
    return p.select("conv_id", "n_turns", digest("said").alias("turns_sha256"), loss.alias("loss_chars"), digest("loss").alias("loss_sha256"), "formatted_chars")
