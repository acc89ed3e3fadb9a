r"""Chat formatting by prefix-target expansion, in DataFrame operations only.

Every assistant turn becomes an example of its own: all turns before it are the context, and only its text is under
the loss. A conversation is rendered once; an example is a prefix of that rendering, held as the positions of its
end and of its trainable span, so the output grows with the turns and not with their square. ``example_text`` cuts
the text of an example out of the rendering. Turns after the last assistant turn belong to no such prefix; a last
example without a trainable span carries them (so does the only example of a conversation without assistant turns).

A turn is rendered as ``### ROLE``, a line feed, TEXT, ``</turn>``, a line feed. Inside role and text a backslash
becomes ``\b``, ``###`` becomes ``\h``, ``</turn>`` becomes ``\t``, and in roles a line feed becomes ``\n``. Every
backslash of a rendering thus begins one of these, control strings stand only where turns begin and end, and
unescaping (``\n``, ``\h``, ``\t``, then ``\b``) gives the input back.

Rows: turns are ordered by number (null first), equal numbers by role and text, and repeated rows stay. A null text
or role is empty. Rows whose conversation id is null form one conversation. Positions count code points from 0.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._columns import let

MARK, END = "### ", "</turn>\n"


def escape(text: Column, role: bool = False) -> Column:
    out = F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\b")), F.lit("###"), F.lit("\\h")), F.lit("</turn>"), F.lit("\\t"))
    return F.replace(out, F.lit("\n"), F.lit("\\n")) if role else out


def unescape(text: Column, role: bool = False) -> Column:
    out = F.replace(text, F.lit("\\n"), F.lit("\n")) if role else text
    return F.replace(F.replace(F.replace(out, F.lit("\\h"), F.lit("###")), F.lit("\\t"), F.lit("</turn>")), F.lit("\\b"), F.lit("\\"))


def render(conversations: DataFrame, *, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target: str = "assistant") -> DataFrame:
    """One row per conversation: ``conv_id``, ``rendered`` and ``examples``.

    ``examples`` lists (target_turn, end, target_start, target_end) in order. The text of an example is the first
    ``end`` characters of ``rendered``; its trainable span is [target_start, target_end), the text of the turn with
    ordinal ``target_turn`` (from 1). A last example without a trainable span has 0, -1 and -1 there.
    """
    col = lambda c: F.col(f"`{c}`")
    turns = conversations.select(
        col(id_col).alias("conv_id"), col(turn_col).alias("turn"), F.coalesce(col(role_col).cast("string"), F.lit("")).alias("role"), F.coalesce(col(text_col).cast("string"), F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    laid = (
        turns.withColumn("body", escape(F.col("text")))
        .withColumn("piece", F.concat(F.lit(MARK), escape(F.col("role"), True), F.lit("\n"), F.col("body"), F.lit(END)))
        .withColumn("end", F.sum(F.length("piece").cast("long")).over(order.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("ordinal", F.row_number().over(order))
    )
    stop = F.col("end") - len(END)
    span = F.struct(F.col("ordinal").alias("target_turn"), F.col("end").alias("end"), (stop - F.length("body")).alias("target_start"), stop.alias("target_end"))
    none = F.struct(F.lit(0).alias("target_turn"), F.col("total").alias("end"), F.lit(-1).cast("long").alias("target_start"), F.lit(-1).cast("long").alias("target_end"))
    return (
        laid.groupBy("conv_id")
        .agg(
            F.sort_array(F.collect_list(F.struct("ordinal", "piece"))).alias("pieces"),
            F.sort_array(F.collect_list(F.when(F.col("role") == target, span))).alias("spans"),
            F.max("end").alias("total"),
            F.coalesce(F.max(F.when(F.col("role") == target, F.col("end"))), F.lit(-1).cast("long")).alias("covered"),
        )
        .select(
            "conv_id",
            F.array_join(F.transform("pieces", lambda p: p.piece), "").alias("rendered"),
            F.when(F.col("covered") < F.col("total"), F.concat("spans", F.array(none))).otherwise(F.col("spans")).alias("examples"),
        )
    )


def expand(rendered: DataFrame) -> DataFrame:
    """One row per example: its position in the conversation from 1, how many there are, the rendering they share, and
    the example's end and span in it."""
    some = rendered.select("conv_id", "rendered", F.size("examples").alias("n_examples"), F.posexplode("examples").alias("at", "x"))
    return some.select("conv_id", (F.col("at") + 1).alias("example"), "n_examples", "rendered", "x.*")


def example_text(rendered: Column, end: Column) -> Column:
    """The whole text of an example: context and reply."""
    return F.substr(rendered, F.lit(1), end.cast("int"))


def read_back(rendered: DataFrame) -> DataFrame:
    """``conv_id``, ``turns`` (array of role and text), ``targets`` (texts under the loss, in order) and
    ``formatted_chars`` (code points of all examples), taken from the expanded examples alone: every example is cut out
    of its rendering and its trainable span out of the example. The last one always reaches the end of its rendering,
    so all turns are read from it.

    A conversation's examples lie where its rendering does, so nothing is shuffled a second time, and of the examples'
    texts only the last one outlives its row.
    """
    example = expand(rendered).withColumn("text", example_text(F.col("rendered"), F.col("end")))
    target = unescape(F.substr("text", (F.col("target_start") + 1).cast("int"), (F.col("target_end") - F.col("target_start")).cast("int")))
    cut = example.select(
        "conv_id",
        F.length("text").cast("long").alias("chars"),
        F.when(F.col("target_start") >= 0, F.struct("example", target.alias("text"))).alias("target"),
        F.when(F.col("example") == F.col("n_examples"), F.col("text")).alias("whole"),
    )
    read = cut.groupBy("conv_id").agg(F.sort_array(F.collect_list("target")).alias("targets"), F.max("whole").alias("whole"), F.sum("chars").alias("formatted_chars"))
    turn = lambda p: F.struct(
        unescape(F.substr(F.substring_index(p, "\n", 1), F.lit(len(MARK) + 1)), True).alias("role"), unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text")
    )
    turns = let(F.split("whole", END), lambda pieces: F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn))
    return read.select("conv_id", turns.alias("turns"), F.transform("targets", lambda t: t.text).alias("targets"), "formatted_chars")
