"""Chat formatting by prefix-target expansion (native DataFrame functions only).

Every assistant turn becomes an example of its own: all preceding turns are its context, and only that reply is
trainable. A conversation that doesn't end with an assistant turn gets one more example without a trainable span, so that
no turn is lost. A turn is rendered as ``<|im_start|>role\\ntext<|im_end|>\\n``.

Control strings inside texts are escaped reversibly: between the opening character of a control string and its rest, one
``~`` is put before any that stand there already, and one is taken away when a text is read back. Roles are URL-encoded.

An example holds its whole context, so a conversation is one row while it is rendered; that is the bound of the method.

Defined cases: null text and null role are empty; null conv_id is a conversation of its own; turns with equal numbers are
ordered by role and text; an empty table gives no examples; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The template and the control strings that texts may not hold.
START, END = "<|im_start|>", "<|im_end|>"
TURN_END = END + "\n"
CONTROL = r"(\|im_start\|>|\|im_end\|>|/?s>|/?INST\])"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])(~*)" + CONTROL, "$1~$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])~(~*)" + CONTROL, "$1$2$3")


def expand(conversations: DataFrame) -> DataFrame:
    """(conv_id, example, formatted, loss_start, loss_end, last): offsets are code points of ``formatted``, the end exclusive."""
    turn = F.struct("turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), F.coalesce(F.col("text"), F.lit("")).alias("text"))
    return (
        conversations.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list(turn)).alias("t"))
        .withColumn("heads", F.transform("t", lambda x: F.concat(F.lit(START), F.url_encode(x["role"]), F.lit("\n"))))
        .withColumn("bodies", F.transform("t", lambda x: escaped(x["text"])))
        .withColumn("ends", F.expr("filter(sequence(0, size(t) - 1), i -> t[i].role = 'assistant' OR i = size(t) - 1)"))
        .withColumn("trainable", F.expr("transform(ends, i -> t[i].role = 'assistant')"))
        .withColumn("rendered", F.expr("transform(heads, (h, i) -> concat(h, bodies[i]))"))
        .withColumn("own", F.expr("transform(ends, i -> struct(heads[i] AS head, bodies[i] AS body))"))
        .select("conv_id", "rendered", F.expr("size(ends)").alias("n"), F.posexplode(F.arrays_zip("ends", "trainable", "own")).alias("example", "e"))  # one copy of the turns for each example
        .withColumn("context", F.expr("concat(array_join(transform(slice(rendered, 1, e.ends), r -> concat(r, '<|im_end|>\n')), ''), e.own.head)"))
        .withColumn("body", F.col("e.own.body"))
        .select(
            "conv_id",
            "example",
            F.concat("context", "body", F.lit(TURN_END)).alias("formatted"),
            F.when(F.col("e.trainable"), F.length("context")).otherwise(0).alias("loss_start"),
            F.when(F.col("e.trainable"), F.length("context") + F.length("body")).otherwise(0).alias("loss_end"),
            (F.col("example") == F.col("n") - 1).alias("last"),
        )
    )


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """What a trainer sees under the loss mask of an example, unescaped."""
    return unescaped(F.substring(formatted, start + 1, end - start))


def read_turns(formatted: Column) -> Column:
    """array<struct<role, text>>: the turns of an example, read back from its text."""
    pieces = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.size(F.split(formatted, r"<\|im_start\|>")))
    role = lambda p: F.url_decode(F.substring_index(p, "\n", 1))
    body = lambda p: F.substring(p, F.instr(p, "\n") + 1, F.length(p) - F.instr(p, "\n") - len(TURN_END))
    return F.transform(pieces, lambda p: F.struct(role(p).alias("role"), unescaped(body(p)).alias("text")))


def digests(examples: DataFrame) -> DataFrame:
    """One row per conversation, read back from its examples."""
    turns = read_turns(F.col("formatted"))
    return (
        examples.withColumn("loss", F.when(F.col("loss_end") > F.col("loss_start"), loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_end"))).otherwise(F.lit("")))
        .withColumn("turns", F.when(F.col("last"), turns))
        .withColumn("joined", F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""))
        .select("conv_id", "example", "loss", F.length("formatted").cast("long").alias("chars"), F.size("turns").cast("long").alias("n"), F.sha2("joined", 256).alias("turns_sha256"), "last")
        .groupBy("conv_id")
        .agg(
            F.max(F.when(F.col("last"), F.col("n"))).alias("n_turns"),
            F.max("turns_sha256").alias("turns_sha256"),
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("example", "loss"))), lambda x: x["loss"]), "").alias("loss"),
            F.sum("chars").alias("formatted_chars"),
        )
        .select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
    )
