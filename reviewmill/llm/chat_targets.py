r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context and only its text is
trainable. A turn is written as ``### role: text</turn>`` and a line feed. Inside roles and texts ``\`` becomes
``\\``, ``###`` becomes ``\3``, ``</turn>`` becomes ``\t`` and, in roles, ``:`` becomes ``\c``; so no control
string is left in a text and the writing can be undone.

Every example is written in full, with all of its context: ``text`` holds everything up to the end of its target,
and ``loss_start`` and ``loss_end`` bound the trainable text in it. The examples of a conversation of n turns hold
n * n / 2 turns, which is the size of the output. :func:`examples` first finds what each example adds to the one
before it; :func:`full_examples` puts the context before that. ``BLOCK`` examples of a conversation are written
together, by any task: they get the text of all earlier blocks once. Turns after the last assistant turn make a last
row without a target.

Places in a conversation are counted in two steps, within ``SPAN`` turn numbers and over the spans' sums, so
a conversation with a third of all rows is worked on by many tasks. Only DataFrame functions are used.

Defined cases: a null role or text is empty; turns are ordered by turn (null first), role, text, and repeated
rows are turns of their own; a null conversation id is a conversation; a conversation without assistant turns
has one row without a target; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewmill.llm.shared import saved

# Fixed values of the template.
OPEN, MIDDLE, CLOSE = "### ", ": ", "</turn>\n"
TARGET_ROLE = "assistant"
#: Turn numbers counted together.
SPAN = 256
#: Examples of a conversation that are written together.
BLOCK = 64


def escape(text: Column) -> Column:
    for plain, written in (("\\", "\\\\"), ("###", "\\3"), ("</turn>", "\\t")):
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescape(text: Column, more: tuple = ()) -> Column:
    r"""Between doubled backslashes, which the split takes from left to right, every ``\`` begins a code."""

    def decode(part: Column) -> Column:
        for written, plain in (("\\3", "###"), ("\\t", "</turn>"), *more):
            part = F.replace(part, F.lit(written), F.lit(plain))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), decode), "\\")


def examples(turns: DataFrame) -> DataFrame:
    """``conv_id, example, target, target_turn, text, context_chars, loss_start, loss_end`` from ``conv_id, turn, role, text``."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("said")
    ).select(
        "*",
        F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("ckey"),
        F.floor(F.coalesce("turn", F.lit(-1)) / SPAN).alias("span"),
        (F.col("role") == TARGET_ROLE).alias("target"),
        F.concat(
            F.lit(OPEN), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(MIDDLE), escape(F.col("said")), F.lit(CLOSE)
        ).alias("piece"),
    ).withColumn("chars", F.length("piece").cast("long"))
    order = ["turn", "role", "said"]
    here = Window.partitionBy("ckey", "span").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("targets_in", F.coalesce(F.sum(F.col("target").cast("long")).over(here), F.lit(0)))
    rows = rows.withColumn("chars_in", F.coalesce(F.sum("chars").over(here), F.lit(0)))
    rows = rows.withColumn("nr", F.row_number().over(Window.partitionBy("ckey", "span").orderBy(*order)))
    spans = rows.groupBy("ckey", "span").agg(F.sum(F.col("target").cast("long")).alias("targets"), F.sum("chars").alias("all_chars"))
    past = Window.partitionBy("ckey").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    spans = spans.select(
        "ckey",
        "span",
        F.coalesce(F.sum("targets").over(past), F.lit(0)).alias("targets_before"),
        F.coalesce(F.sum("all_chars").over(past), F.lit(0)).alias("chars_before"),
    )
    rows = rows.join(spans, ["ckey", "span"])
    placed = rows.select(
        "ckey", "conv_id", "turn", "target", "piece", "chars", "span", "nr",
        (F.col("targets_in") + F.col("targets_before")).alias("example"),
        (F.col("chars_in") + F.col("chars_before")).alias("at"),
        F.length(F.concat(F.lit(OPEN + MIDDLE), F.replace(escape(F.col("role")), F.lit(":"), F.lit("\\c")))).alias("head"),
    )
    parts = F.sort_array(F.collect_list(F.struct("span", "nr", "piece")))
    loss = F.col("target")
    return placed.groupBy("ckey", "example").agg(
        F.first("conv_id").alias("conv_id"),
        F.max("target").alias("target"),
        F.max(F.when(loss, F.col("turn"))).alias("target_turn"),
        F.array_join(F.transform(parts, lambda x: x["piece"]), "").alias("text"),
        F.min("at").alias("context_chars"),
        F.max(F.when(loss, F.col("at") + F.col("head"))).alias("loss_start"),
        F.max(F.when(loss, F.col("at") + F.col("chars") - len(CLOSE))).alias("loss_end"),
    ).select("conv_id", "example", "target", "target_turn", "text", "context_chars", "loss_start", "loss_end")


def full_examples(parts: DataFrame) -> DataFrame:
    """``conv_id, example, target, target_turn, text, loss_start, loss_end, last`` with the whole context in ``text``.

    ``last`` marks the last row of a conversation, which holds all its turns. The result is as large as the examples
    are. The text of a block goes to each later block of its conversation, so no task needs more than its blocks do.
    """
    rows = parts.withColumn("ckey", F.coalesce(F.col("conv_id").cast("string"), F.lit(""))).withColumn("block", F.floor(F.col("example") / BLOCK))
    ends = rows.groupBy("ckey").agg(F.max("block").alias("last_block"))
    gathered = lambda at: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(at, "text"))), lambda x: x["text"]), "")
    blocks = rows.groupBy("ckey", "block").agg(gathered("example").alias("text")).join(ends, "ckey").where(F.col("block") < F.col("last_block"))
    sent = blocks.select("ckey", F.explode(F.sequence(F.col("block") + 1, F.col("last_block"))).alias("to"), F.col("block").alias("of"), "text")
    contexts = sent.groupBy("ckey", F.col("to").alias("block")).agg(gathered("of").alias("context"))
    order = Window.partitionBy("ckey", "block").orderBy("example")
    near = F.array_join(F.collect_list("text").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)), "")
    rows = rows.withColumn("near", near).withColumn("follows", F.lead("example").over(order).isNotNull())
    rows = rows.join(contexts, ["ckey", "block"], "left").join(ends.select("ckey", F.col("last_block").alias("block"), F.lit(True).alias("ends")), ["ckey", "block"], "left")
    return rows.select(
        "conv_id", "example", "target", "target_turn", F.concat(F.coalesce("context", F.lit("")), "near").alias("text"), "loss_start", "loss_end",
        (F.col("ends").isNotNull() & ~F.col("follows")).alias("last"),
    )


def read_back(full: DataFrame) -> DataFrame:
    """Turns and trainable texts per conversation, from the full examples alone.

    Turns are read from a conversation's last row and trainable texts from each example. A digest over a whole
    conversation needs that conversation in one row; nothing else is gathered.
    """
    pieces = F.filter(F.split("text", CLOSE), lambda x: x != "")
    turn = F.transform(
        pieces,
        lambda x: F.struct(
            unescape(F.substring_index(F.substr(x, F.lit(len(OPEN) + 1)), MIDDLE, 1), (("\\c", ":"),)).alias("role"),
            unescape(F.substr(x, F.length(F.substring_index(x, MIDDLE, 1)) + len(MIDDLE) + 1)).alias("said"),
        ),
    )
    size = (F.col("loss_end") - F.col("loss_start")).cast("int")
    loss = F.when(F.col("target"), unescape(F.substr("text", F.col("loss_start").cast("int") + 1, size)))
    rows = full.select(
        "conv_id", "example", "target", F.when(F.col("last"), turn).alias("turns"), loss.alias("loss"),
        F.when(F.col("last"), F.length("text")).cast("long").alias("chars"), F.length("text").cast("long").alias("whole"),
    )
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["said"], F.lit("\n"))), "")
    rows = rows.select("conv_id", "example", "target", "loss", "chars", "whole", lines.alias("lines"), F.when(F.col("turns").isNotNull(), F.size("turns")).alias("n"))
    gathered = rows.groupBy("conv_id").agg(
        F.sum("n").cast("long").alias("n_turns"),
        F.max("lines").alias("lines"),
        F.sort_array(F.collect_list(F.struct("example", F.coalesce("loss", F.lit("")).alias("loss")))).alias("all"),
        F.sum("chars").alias("formatted_chars"),
        F.sum(F.col("target").cast("long")).alias("n_examples"),
        F.coalesce(F.sum(F.when(F.col("target"), F.col("whole"))), F.lit(0)).alias("example_chars"),
        F.sum(F.length(F.coalesce("loss", F.lit("")))).cast("long").alias("loss_chars"),
    )
    losses = F.array_join(F.transform("all", lambda x: x["loss"]), "")
    return gathered.select(
        "conv_id", "n_turns", F.sha2("lines", 256).alias("turns_sha256"), "loss_chars", F.sha2(losses, 256).alias("loss_sha256"),
        "formatted_chars", "n_examples", "example_chars",
    )


def digests(turns: DataFrame) -> DataFrame:
    """The examples are written in full, then read back."""
    return read_back(saved(full_examples(saved(examples(turns)))))


SQL = r"""
with c as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
           union all select -7, 0, 'user', '\### Assistant: </turn> ok'
           union all select -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e as (select *, '### ' || replace(replace(replace(replace(role, '\', '\\'), '###', '\3'), '</turn>', '\t'), ':', '\c') || ': '
                || replace(replace(replace(text, '\', '\\'), '###', '\3'), '</turn>', '\t') || '</turn>' || chr(10) as piece from c),
w as (select *, sum(length(piece)) over (partition by conv_id order by turn nulls first, role, text
                                         rows between unbounded preceding and current row) as upto from e)
select conv_id, count(*) as n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, text)) as turns_sha256,
       coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn nulls first, role, text) filter (role = 'assistant'), '')) as loss_sha256,
       sum(length(piece))::bigint as formatted_chars,
       count(*) filter (role = 'assistant') as n_examples,
       coalesce(sum(upto) filter (role = 'assistant'), 0)::bigint as example_chars
from w group by conv_id
"""
