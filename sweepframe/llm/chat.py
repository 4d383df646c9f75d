"""Chat formatting by prefix-target expansion: every assistant turn becomes its own example.

An example holds all turns before, then the reply; only the reply's text is trainable. Turns are
marked `<|im_start|>role\\n ... <|im_end|>\\n`. In texts and roles a `<` that is followed by any
number of backslashes and a `|` gets one backslash more, so no text can form a mark and the step
can be undone. In roles, backslashes (as `\\s`) and newlines (as `\\n`) are escaped first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Fixed values of the template.
START, END = "<|im_start|>", "<|im_end|>\n"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def _role(role: Column) -> Column:
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\s")), F.lit("\n"), F.lit("\\n")))


def _role_back(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("\\n"), F.lit("\n")), F.lit("\\s"), F.lit("\\"))


def expand(turns: DataFrame) -> DataFrame:
    """Examples of turns(conv_id, turn, role, text): conv_id, loose, example, formatted, loss_start, loss_end.

    One row per assistant turn, in order; loss_start and loss_end bound the reply in code points. A
    conversation that doesn't end with the assistant has a last row with all its turns and no loss.
    Turns go by turn, ties by role and text; repeated rows are turns of their own; nulls in role or
    text are empty, a null turn comes first. A row without conv_id belongs to no other and is a
    conversation of one turn; `loose` tells such rows apart and is null elsewhere. A conversation is
    put together in one row, as its last example holds all of it anyway."""
    row = F.struct("turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    loose = F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id())
    convs = turns.select(F.col("conv_id").cast("long").alias("conv_id"), loose.alias("loose"), "turn", "role", "text").groupBy("conv_id", "loose").agg(F.array_sort(F.collect_list(row)).alias("t"))
    marked = F.transform("t", lambda x: F.struct((x["role"] == "assistant").alias("reply"), F.concat(F.lit(START), _role(x["role"]), F.lit("\n")).alias("head"), escape(x["text"]).alias("body")))
    convs = convs.select("conv_id", "loose", marked.alias("m"))
    each = convs.select("conv_id", "loose", "m", F.posexplode("m").alias("at", "own")).filter(F.col("own.reply") | (F.col("at") == F.size("m") - 1))
    prior = F.array_join(F.transform(F.slice("m", 1, F.col("at")), lambda x: F.concat(x["head"], x["body"], F.lit(END))), "")
    each = each.select("conv_id", "loose", "own", "at", F.concat(prior, F.col("own.head")).alias("context"))
    start = F.when(F.col("own.reply"), F.length("context").cast("long"))
    return each.select(
        "conv_id", "loose", F.col("at").alias("example"), F.concat("context", "own.body", F.lit(END)).alias("formatted"),
        start.alias("loss_start"), (start + F.length("own.body")).alias("loss_end"))


def parse(formatted: Column) -> Column:
    """The turns (role, text) of a formatted example."""
    chunks = F.slice(F.split(formatted, r"<\|im_start\|>", -1), 2, 1 << 30)
    return F.transform(chunks, lambda c: F.struct(_role_back(F.substring_index(c, "\n", 1)).alias("role"), unescape(_between(c)).alias("text")))


def _between(chunk: Column) -> Column:
    head = F.length(F.substring_index(chunk, "\n", 1)) + 2
    return F.substring(chunk, head, F.length(chunk) - head + 1 - len(END))


def digest(turns: DataFrame) -> DataFrame:
    """What the written examples hold, by conversation: the contract's columns."""
    out = common.written(expand(turns), "chat")
    loss = unescape(F.substring("formatted", (F.col("loss_start") + 1).cast("int"), (F.col("loss_end") - F.col("loss_start")).cast("int")))
    rows = out.select("conv_id", "loose", "example", "formatted", loss.alias("loss"))
    by = rows.groupBy("conv_id", "loose").agg(
        F.max_by("formatted", "example").alias("full"), F.array_sort(F.collect_list(F.struct("example", "loss"))).alias("l"),
        F.sum(F.length("formatted")).cast("long").alias("formatted_chars"))
    learned = F.array_join(F.transform("l", lambda x: F.coalesce(x["loss"], F.lit(""))), "")
    by = by.select("conv_id", parse(F.col("full")).alias("t"), learned.alias("loss"), "formatted_chars")
    said = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return by.select(
        "conv_id", F.size("t").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
