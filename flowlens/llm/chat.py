"""Chat formatting with prefix-target expansion, in DataFrame functions alone.

A turn is written as ``<turn:role>text</turn>`` and a line feed. Inside roles and texts the four
characters that can occur in a mark are written with a backslash and a letter, so no text can
look like a mark and the escape can be undone by plain replacement:

    \\ -> \\b    < -> \\l    > -> \\g    : -> \\c

Every assistant turn becomes an example: all turns before it are the context, and only its text
is trainable. Turns behind the last assistant turn, or a conversation without one, give one
more example without a trainable part, so that nothing of the input is lost.

A conversation's turns meet in one row, as its examples hold them all anyway; a prefix is built
only for the row it belongs to.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ESCAPES = [("\\", "\\b"), ("<", "\\l"), (">", "\\g"), (":", "\\c")]
HEAD, HEAD_END, TAIL = "<turn:", ">", "</turn>\n"
ASSISTANT = "assistant"


def escaped(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def conversations(
    rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, parts): each part has the formatted turn, its escaped text's length and its role.

    Turns are sorted by number, then role and text, null numbers first; null roles and texts
    are empty. Repeated rows are turns of their own; a null id is a conversation of its own.
    """
    one = F.struct(
        F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"),
        F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    met = rows.groupBy(F.col(conv_id).alias("conv_id")).agg(F.sort_array(F.collect_list(one)).alias("turns"))
    part = lambda t: F.struct(
        F.concat(F.lit(HEAD), escaped(t["role"]), F.lit(HEAD_END), escaped(t["text"]), F.lit(TAIL)).alias("formatted"),
        F.length(escaped(t["text"])).alias("chars"), (t["role"] == ASSISTANT).alias("trained"),
    )
    return met.select("conv_id", F.transform("turns", part).alias("parts"))


def examples(
    rows: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, last): one row per example.

    ``loss_start`` and ``loss_end`` delimit the trainable characters of ``formatted`` (code points,
    from 0, end exclusive); they are equal where nothing is trainable. ``last`` marks the
    example that holds the whole conversation.
    """
    found = conversations(rows, conv_id=conv_id, turn=turn, role=role, text=text)
    n = F.size("parts")
    ends = F.filter(F.sequence(F.lit(1), n), lambda i: F.element_at("parts", i)["trained"] | (i == n))
    cut = found.select("conv_id", "parts", n.alias("n"), F.posexplode(ends).alias("example", "upto"))
    whole = F.array_join(F.transform(F.slice("parts", F.lit(1), F.col("upto")), lambda p: p["formatted"]), "")
    made = cut.withColumn("formatted", whole).withColumn("target", F.element_at("parts", F.col("upto")))
    end = F.length("formatted") - len(TAIL)
    start = F.when(F.col("target.trained"), end - F.col("target.chars")).otherwise(end)
    return made.select(
        "conv_id", "example", "formatted", start.alias("loss_start"), end.alias("loss_end"),
        (F.col("upto") == F.col("n")).alias("last"),
    )


def read_back(made: DataFrame) -> DataFrame:
    """Per conversation what its examples say: n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars (of all its examples). Turns come from the longest example, the trainable
    text from every example's loss span."""
    loss = unescaped(F.expr("substring(formatted, loss_start + 1, loss_end - loss_start)"))
    marks = F.slice(F.split("formatted", TAIL, -1), 1, F.size(F.split("formatted", TAIL, -1)) - 1)
    role = lambda t: unescaped(F.substring_index(F.substring(t, len(HEAD) + 1, 2**31 - 1), HEAD_END, 1))
    text = lambda t: unescaped(F.substring_index(t, HEAD_END, -1))
    turns = F.when(F.col("last"), F.struct(
        F.size(marks).cast("long").alias("n"),
        F.sha2(F.array_join(F.transform(marks, lambda t: F.concat(role(t), F.lit("\n"), text(t), F.lit("\n"))), ""), 256).alias("sha"),
    ))
    told = made.select("conv_id", "example", loss.alias("loss"), F.length("formatted").alias("chars"), turns.alias("turns"))
    met = told.groupBy("conv_id").agg(
        F.max("turns").alias("turns"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"),
        F.sum("chars").cast("long").alias("formatted_chars"),
    )
    joined = F.array_join(F.transform("losses", lambda x: x["loss"]), "")
    return met.select(
        "conv_id", F.col("turns.n").alias("n_turns"), F.col("turns.sha").alias("turns_sha256"),
        F.length(joined).cast("long").alias("loss_chars"), F.sha2(joined, 256).alias("loss_sha256"), "formatted_chars",
    )
