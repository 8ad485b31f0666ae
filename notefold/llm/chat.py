r"""Conversations as one training text each, with a mask of what counts for the loss; expressions of Spark only.

The turns of a conversation are collected, sorted and cut where the role
changes, so adjacent turns of one role are one block:

    [INST]role[ROLE]text[TURN]text[/INST]      any other role
    <s>text[TURN]text</s>                      the assistant

A control string that a text or a role holds itself gets a backslash after its
first character; one that has backslashes there already gets one more.  What
stands in a formatted text without a backslash is therefore markup, and reading
takes one backslash away from the rest.

The mask has an entry for each turn, in order: `skip` code points of markup,
then `length` code points of escaped text, and whether these count for the loss.

Every step goes over a conversation once: neighbours are looked up by place,
blocks are slices, and no list or text grows item by item.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ASSISTANT = "assistant"
# The control strings of the template.
OPEN, ROLE, CLOSE = "[INST]", "[ROLE]", "[/INST]"
OPEN_ASSISTANT, CLOSE_ASSISTANT = "<s>", "</s>"
NEXT = "[TURN]"

#: A control string from its first character to its last backslash, with what makes it one behind.
_CONTROL = r"(?=/?INST\]|ROLE\]|TURN\]|/?s>)"
_BLOCK = r"(?s)(<s>.*?</s>|\[INST\].*?\[/INST\])"
_TEXT = r"(?s)(?:<s>|\[ROLE\]|\[TURN\])(.*?)(?=\[TURN\]|\[/INST\]|</s>)"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<]\\*+)" + _CONTROL, r"$1\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([\[<]\\*)\\" + _CONTROL, "$1")


def _bound(value: Column, use) -> Column:
    """use(value) with value worked out once a row, as the variable of a function."""
    return F.element_at(F.transform(F.array(value), use), 1)


def merged_turns(turns: Column) -> Column:
    """Turns (role, text) as blocks (role, texts): adjacent turns of one role are one block."""

    def blocks(t: Column) -> Column:
        places = F.sequence(F.lit(0), F.size(t) - 1)
        first = F.filter(places, lambda i: (i == 0) | (F.get(t, i)["role"] != F.get(t, i - 1)["role"]))

        def cut(starts: Column) -> Column:
            def block(s: Column, k: Column) -> Column:
                end = F.coalesce(F.get(starts, k + 1), F.size(t))
                return F.struct(F.get(t, s)["role"].alias("role"), F.transform(F.slice(t, s + 1, end - s), lambda x: x["text"]).alias("texts"))

            return F.transform(starts, block)

        return _bound(first, cut)

    return _bound(turns, blocks)


def formatted_blocks(blocks: Column) -> Column:
    """The formatted text of blocks (role, texts)."""

    def one(b: Column) -> Column:
        own = F.array_join(F.transform(b["texts"], escaped), NEXT)
        other = F.concat(F.lit(OPEN), escaped(b["role"]), F.lit(ROLE), own, F.lit(CLOSE))
        return F.when(b["role"] == ASSISTANT, F.concat(F.lit(OPEN_ASSISTANT), own, F.lit(CLOSE_ASSISTANT))).otherwise(other)

    return F.array_join(F.transform(blocks, one), "")


def loss_mask(blocks: Column) -> Column:
    """An entry (skip, length, loss) for each turn: markup before its text, and its text as it is written."""

    def of(bs: Column) -> Column:
        def one(b: Column, k: Column) -> Column:
            mine = b["role"] == ASSISTANT
            opened = F.when(mine, len(OPEN_ASSISTANT)).otherwise(F.length(escaped(b["role"])) + len(OPEN) + len(ROLE))
            closed = F.when(k == 0, 0).when(F.get(bs, k - 1)["role"] == ASSISTANT, len(CLOSE_ASSISTANT)).otherwise(len(CLOSE))
            return F.transform(b["texts"], lambda t, i: F.struct(F.when(i == 0, opened + closed).otherwise(len(NEXT)).cast("long").alias("skip"), F.length(escaped(t)).cast("long").alias("length"), mine.alias("loss")))

        return F.flatten(F.transform(bs, one))

    return _bound(blocks, of)


def read_turns(formatted: Column) -> Column:
    """Turns (role, text) of a formatted text, in order, as they were before adjacent ones were merged."""

    def turns(block: Column) -> Column:
        role = F.when(F.startswith(block, F.lit(OPEN_ASSISTANT)), ASSISTANT).otherwise(unescaped(F.regexp_extract(block, r"(?s)^\[INST\](.*?)\[ROLE\]", 1)))
        return _bound(role, lambda r: F.transform(F.regexp_extract_all(block, F.lit(_TEXT), F.lit(1)), lambda t: F.struct(r.alias("role"), unescaped(t).alias("text"))))

    return F.flatten(F.transform(F.regexp_extract_all(formatted, F.lit(_BLOCK), F.lit(1)), turns))


def masked_text(formatted: Column, mask: Column) -> Column:
    """The text under a mask, with its escapes taken back; null where the mask does not fit the text."""
    written = F.regexp_extract_all(formatted, F.lit(_TEXT), F.lit(1))

    def read(w: Column) -> Column:
        fits = (F.size(w) == F.size(mask)) & F.forall(F.zip_with(w, mask, lambda t, m: F.length(t) == m["length"]), lambda x: F.coalesce(x, F.lit(False)))
        return F.when(fits, F.array_join(F.zip_with(w, mask, lambda t, m: F.when(m["loss"], unescaped(t)).otherwise("")), ""))

    return _bound(written, read)


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conv_id, n_blocks, formatted, mask: one row a conversation of rows (conv_id, turn, role, text).

    Turns go by `turn`, ties by role, then text; a null turn comes first.  A
    null text or role is an empty one.  Rows that repeat are turns each.  A row
    with a null conv_id belongs to no other: it is a conversation of one turn,
    so rows without an id never meet in one task.  No rows give no rows; other
    columns are ignored.  A conversation is one text and so has to fit in one
    (2 GB); the shuffle moves each row once, to the task of its conversation.
    """
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), turn.alias("t"))
    named = rows.where("conv_id is not null").groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    whole = named.unionByName(rows.where("conv_id is null").select("conv_id", F.array("t").alias("turns")))
    blocks = whole.select("conv_id", merged_turns(F.col("turns")).alias("blocks"))
    return blocks.select("conv_id", F.size("blocks").cast("long").alias("n_blocks"), formatted_blocks(F.col("blocks")).alias("formatted"), loss_mask(F.col("blocks")).alias("mask"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_blocks of formatted conversations, read back from their texts and masks."""
    read = formatted.select("conv_id", "n_blocks", "formatted", read_turns(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("mask")).alias("loss"))
    each = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(each, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"), "n_blocks",
    )
