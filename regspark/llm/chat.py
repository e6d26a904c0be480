"""Chat formatting with prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are the
context, and only its text is under the loss mask. A conversation of n turns has
up to n examples, whose texts written out would grow with the square of n. So
the output has each formatted turn once, as a segment with its place in the
conversation, and an example is a range of places: the context is what lies
before its target. ``written_out`` joins the two into texts where that is wanted.

The template writes a turn as a start mark, its role, a line break, its text, an
end mark and a line break. In texts and roles one backslash is put between
``<`` and ``|`` (one more where there already are some), so no mark can arise
inside a text, and taking one out again restores it exactly.

Native throughout. Places are running sums over a conversation; its turns are
cut into runs of ``RUN`` turns, summed by run first, so that no task orders more
than a run, however long a conversation is. Only a digest of a whole
conversation brings its text together, from the texts of its runs.

Turns are ordered by turn, nulls first; those of equal turn by role, then text.
Null role and null text are empty. Rows with a null conversation form one
conversation. Repeated rows are turns of their own; other columns are ignored;
an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# The marks of the template.
START, END = "<|im_start|>", "<|im_end|>"
RUN = 256


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(\\*)\|", r"<$1\\|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escaped_role(role: Column) -> Column:
    """A role on one line, without marks."""
    role = F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    return F.replace(role, F.lit("<"), F.lit("%3C"))


def unescaped_role(role: Column) -> Column:
    role = F.replace(F.replace(role, F.lit("%3C"), F.lit("<")), F.lit("%0A"), F.lit("\n"))
    return F.replace(role, F.lit("%25"), F.lit("%"))


def segments(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
             text_col: str = "text") -> DataFrame:
    """One row per turn: conv_id, run, place, role, segment, start, text_start, end.

    ``place`` numbers the turns of a conversation. Places in text are code points
    from the start of the formatted conversation; ``text_start`` is where the
    turn's own text begins, which ends one end mark and line break before ``end``.
    """
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
        F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    head = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"))
    rows = rows.select(
        "conv_id", "turn", "role", "text", F.floor(F.col("turn") / RUN).alias("run"),
        F.concat(head, escaped(F.col("text")), F.lit(END + "\n")).alias("segment"), F.length(head).alias("head"))
    size = F.length("segment").cast("long")
    runs = rows.groupBy("conv_id", "run").agg(F.sum(size).alias("chars"), F.count("*").alias("turns"))
    before = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("run")).rowsBetween(Window.unboundedPreceding, -1)
    runs = runs.select("conv_id", "run", F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"),
                       F.coalesce(F.sum("turns").over(before), F.lit(0)).alias("turns_before"))
    order = Window.partitionBy("conv_id", "run").orderBy(F.asc_nulls_first("turn"), "role", "text")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumns({"end": F.sum(size).over(upto), "place": F.row_number().over(order)}).alias("t")
    runs = runs.alias("r")
    same = F.col("t.conv_id").eqNullSafe(F.col("r.conv_id")) & F.col("t.run").eqNullSafe(F.col("r.run"))
    rows = rows.join(runs, same).select(
        "t.conv_id", "t.run", (F.col("place") + F.col("turns_before")).alias("place"), "role", "segment", "head",
        (F.col("end") + F.col("chars_before")).alias("end"))
    start = F.col("end") - F.length("segment")
    return rows.select("conv_id", "run", "place", "role", "segment", start.alias("start"),
                       (start + F.col("head")).alias("text_start"), "end")


def examples(segments: DataFrame, *, target_role: str = "assistant") -> DataFrame:
    """One row per turn of ``target_role``: the ranges of its context and of its loss.

    An example is the text [0, example_end) of the formatted conversation; the
    loss mask covers [loss_start, loss_end).
    """
    return segments.where(F.col("role") == target_role).select(
        "conv_id", "place", F.col("start").alias("context_end"), F.col("text_start").alias("loss_start"),
        (F.col("end") - len(END) - 1).alias("loss_end"), F.col("end").alias("example_end"))


def written_out(examples: DataFrame, segments: DataFrame) -> DataFrame:
    """Examples with their whole text, for conversations short enough to repeat."""
    e, s = examples.alias("e"), segments.alias("s")
    joined = e.join(s, F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("s.place") <= F.col("e.place")))
    text = F.array_join(F.array_sort(F.collect_list(F.struct("s.place", "s.segment")))["segment"], "")
    return joined.groupBy("e.conv_id", "e.place", "loss_start", "loss_end").agg(text.alias("text"))


def read_back(segment: Column) -> tuple[Column, Column]:
    """Role and text of a formatted turn."""
    line = F.instr(segment, "\n")
    role = F.substr(segment, F.lit(len(START) + 1), line - len(START) - 1)
    text = F.substr(segment, line + 1, F.length(segment) - line - len(END) - 1)
    return unescaped_role(role), unescaped(text)


def digests(segments: DataFrame, examples: DataFrame) -> DataFrame:
    """What the formatted output says of each conversation, read back from it.

    n_turns and the digest of roles and texts, the number and digest of the code
    points under the loss masks (a segment's part that an example trains on), and
    ``formatted_chars``, the code points of all its examples.
    """
    s, e = segments.alias("s"), examples.alias("e")
    both = s.join(e, F.col("s.conv_id").eqNullSafe(F.col("e.conv_id")) & (F.col("s.place") == F.col("e.place")), "left")
    role, text = read_back(F.col("segment"))
    trained = F.when(F.col("loss_start").isNotNull(), unescaped(F.substr(
        F.col("segment"), (F.col("loss_start") - F.col("s.start") + 1).cast("int"),
        (F.col("loss_end") - F.col("loss_start")).cast("int")))).otherwise("")
    turns = both.select(F.col("s.conv_id"), "run", F.col("s.place"), F.concat(role, F.lit("\n"), text, F.lit("\n")).alias("turn"),
                        trained.alias("loss"), F.coalesce("example_end", F.lit(0)).alias("example_end"))

    def joined(order, *names):
        ordered = F.array_sort(F.collect_list(F.struct(order, *names)))
        return [F.array_join(ordered[n], "").alias(n) for n in names]

    by_run = turns.groupBy("conv_id", "run").agg(
        F.min("place").alias("first"), F.count("*").alias("n_turns"), F.sum("example_end").alias("formatted_chars"),
        *joined("place", "turn", "loss"))
    return by_run.groupBy("conv_id").agg(
        F.sum("n_turns").alias("n_turns"), F.sum("formatted_chars").alias("formatted_chars"),
        *joined("first", "turn", "loss")).select(
        "conv_id", "n_turns", F.sha2(F.col("turn").cast("binary"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars")
