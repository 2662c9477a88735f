"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all preceding turns are its context and only that reply is
trainable. Turns after the last reply (or a conversation without replies) make one more example with nothing
trainable, so that no turn is lost. The template is

    <turn:ROLE>\\n TEXT </turn>\\n          (without the spaces)

and inside roles and texts the characters \\ < > are written \\b \\l \\g, so that markup in a text can never be
read as markup of the template; unescape() gives the text back exactly.

Everything is built-in DataFrame functions. A conversation is the unit of work: its last example holds all its
turns, so by the definition of the output one task must hold one conversation.

Cases: null role or text counts as empty; turns order by (turn, role, text), null turn first, so ties and
repeated rows have one order; rows with a null id are one conversation; a very long text is never cut; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HEAD, MID, END = "<turn:", ">\n", "</turn>\n"


def escape(c: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("<", "\\l"), (">", "\\g")):
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column) -> Column:
    for plain, code in ((">", "\\g"), ("<", "\\l"), ("\\", "\\b")):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def format_examples(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", trained_role: str = "assistant") -> DataFrame:
    """conv_id, example (from 0), formatted, loss_start (code points, from 0), loss_length (0: nothing is trained), is_last.

    The context of an example is its formatted text up to loss_start.
    """
    rows = turns.select(
        F.col(id_col).alias("conv_id"),
        F.struct(F.col(turn_col).alias("turn"), F.coalesce(role_col, F.lit("")).alias("role"), F.coalesce(text_col, F.lit("")).alias("text")).alias("t"),
    )
    made = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts")).select(
        "conv_id",
        F.transform("ts", lambda t: F.struct((t["role"] == trained_role).alias("trained"), F.concat(F.lit(HEAD), escape(t["role"]), F.lit(MID)).alias("head"), escape(t["text"]).alias("body"))).alias("ts"),
    )
    # where each example ends: at every reply, and at the last turn if that is no reply
    ends = F.filter(F.sequence(F.lit(1), F.size("ts")), lambda i: F.element_at("ts", i)["trained"] | (i == F.size("ts")))
    one = made.select("conv_id", "ts", F.posexplode(ends).alias("example", "end"), F.size("ts").alias("n"))
    last = F.element_at("ts", F.col("end"))
    return one.select(
        "conv_id",
        "example",
        F.concat(F.concat_ws("", F.transform(F.slice("ts", F.lit(1), F.col("end") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END)))), last["head"]).alias("before"),
        last["body"].alias("body"),
        last["trained"].alias("trained"),
        (F.col("end") == F.col("n")).alias("is_last"),
    ).select(
        "conv_id",
        "example",
        F.concat("before", "body", F.lit(END)).alias("formatted"),
        F.char_length("before").cast("long").alias("loss_start"),
        F.when(F.col("trained"), F.char_length("body")).otherwise(0).cast("long").alias("loss_length"),
        "is_last",
    )


def parse_turns(formatted: Column) -> Column:
    """The turns of a formatted example: array of (role, text), unescaped."""
    blocks = F.split(formatted, END)
    turns = F.slice(blocks, F.lit(1), F.size(blocks) - 1)
    return F.transform(turns, lambda b: F.struct(
        unescape(F.substring_index(F.substr(b, F.lit(len(HEAD) + 1)), MID, 1)).alias("role"),
        unescape(F.substr(b, F.locate(MID, b) + len(MID))).alias("text"),
    ))


def loss_text(formatted: Column, start: Column, length: Column) -> Column:
    """What the mask covers, unescaped."""
    return unescape(F.substr(formatted, (start + 1).cast("int"), length.cast("int")))


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from the formatted examples alone: n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples."""
    part = examples.select(
        "conv_id", "example", "is_last",
        F.char_length("formatted").cast("long").alias("chars"),
        loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("loss"),
        F.when(F.col("is_last"), parse_turns(F.col("formatted"))).alias("turns"),
    )
    whole = part.groupBy("conv_id").agg(
        F.max_by("turns", "example").alias("turns"),
        F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").alias("formatted_chars"),
        F.count("*").alias("n_examples"),
    )
    said = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    loss = F.concat_ws("", F.transform("losses", lambda x: x["loss"]))
    return whole.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        "formatted_chars",
        "n_examples",
    )
