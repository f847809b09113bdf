"""Chat formatting by prefix-target expansion, in SQL functions only.

Every assistant turn becomes an example of its own: all turns up to it, of which only that
reply's text is trained on. A conversation that ends on another role (or has no assistant)
also yields one untrained example with all its turns, so that nothing is lost.

Template, per turn: <|im_start|>ROLE \\n TEXT <|im_end|> \\n. Inside roles and texts a backslash
is doubled and "<|" becomes "<\\|" (in roles a newline becomes "\\n" as two characters), so the
control strings can't occur there and the writing is reversible.

Null roles and texts count as empty. Turns are ordered by turn number, ties by role and then
text (nulls first); repeated rows stay as turns of their own. A null conversation id is a
conversation like any other. An empty table gives an empty result, and columns other than the
four named ones are ignored. A conversation is the unit of work: its examples are made from one
sorted array of its turns, and their total length is what the expansion asks for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The control strings of the chat template.
START, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Pairs that begin with a backslash are read from the left, as they were written."""
    undo = lambda part: F.replace(part, F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(text, r"\\\\", -1), undo), "\\")


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    undo = lambda part: F.replace(F.replace(part, F.lit("\\n"), F.lit("\n")), F.lit("\\|"), F.lit("|"))
    return F.array_join(F.transform(F.split(role, r"\\\\", -1), undo), "\\")


def format_conversations(
    df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """Examples: conv_col, example_no (from 1), n_turns, formatted, trainable, loss_start, loss_end, is_last.

    loss_start and loss_end are code point offsets (from 0, end excluded) into formatted of the
    escaped reply; both are null where trainable is false. is_last marks each conversation's
    longest example, which holds all its turns.
    """
    rows = df.select(
        F.col(conv_col).alias("_conv"),
        F.struct(
            F.col(turn_col).alias("turn"),
            F.coalesce(F.col(role_col), F.lit("")).alias("role"),
            F.coalesce(F.col(text_col), F.lit("")).alias("text"),
        ).alias("_turn"),
    )
    turns = rows.groupBy("_conv").agg(F.sort_array(F.collect_list("_turn")).alias("_turns"))
    parts = turns.select(
        "_conv",
        F.transform("_turns", lambda t: t["role"] == TRAINED_ROLE).alias("_trained"),
        F.transform("_turns", lambda t: F.concat(F.lit(START), escape_role(t["role"]), F.lit("\n"))).alias("_heads"),
        F.transform("_turns", lambda t: escape(t["text"])).alias("_bodies"),
        F.size("_turns").alias("_n"),
    )
    tail = F.lit(END + "\n")
    made = parts.select(
        "_conv",
        "_trained",
        "_n",
        F.transform("_heads", lambda h: F.char_length(h)).alias("_head_chars"),
        F.transform("_bodies", lambda b: F.char_length(b)).alias("_body_chars"),
        F.zip_with("_heads", "_bodies", lambda h, b: F.concat(h, b, tail)).alias("_parts"),
        F.filter(
            F.sequence(F.lit(1), F.col("_n")), lambda i: (i == F.col("_n")) | F.element_at("_trained", i)
        ).alias("_targets"),
    )
    one = made.withColumn("_at", F.explode_outer("_targets")).withColumn(
        "_formatted", F.array_join(F.slice("_parts", F.lit(1), F.col("_at")), "")
    )
    trainable = F.element_at("_trained", F.col("_at"))
    end = F.char_length("_formatted") - len(END + "\n")
    return one.select(
        F.col("_conv").alias(conv_col),
        F.array_position("_targets", F.col("_at")).cast("int").alias("example_no"),
        F.col("_at").alias("n_turns"),
        F.col("_formatted").alias("formatted"),
        trainable.alias("trainable"),
        F.when(trainable, end - F.element_at("_body_chars", F.col("_at"))).alias("loss_start"),
        F.when(trainable, end).alias("loss_end"),
        (F.col("_at") == F.col("_n")).alias("is_last"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of one formatted example: array of (role, text), unescaped."""
    cut = F.split(formatted, r"<\|im_start\|>", -1)
    pieces = F.slice(cut, F.lit(2), F.greatest(F.size(cut) - 1, F.lit(0)))

    def turn(piece: Column) -> Column:
        role_chars = F.instr(piece, "\n") - 1
        text_chars = F.char_length(piece) - role_chars - 1 - len(END + "\n")
        return F.struct(
            unescape_role(F.substring(piece, F.lit(1), role_chars)).alias("role"),
            unescape(F.substring(piece, role_chars + 2, text_chars)).alias("text"),
        )

    return F.transform(pieces, turn)


def read_loss(formatted: Column, start: Column, end: Column) -> Column:
    """The unescaped text under the loss mask."""
    return unescape(F.substring(formatted, start + 1, end - start))
