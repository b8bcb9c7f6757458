"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A log holds events (conv_id, seq, kind, message_id, role, text). Kinds: ``message`` (a whole message), ``delta`` (text to append),
``edit`` (replaces the text), ``regenerate`` (starts the text anew and drops messages begun after this one
and before it). Events of a conversation are ordered by sequence and folded into final messages, and those are
rendered with a template that marks turns. Texts and roles are escaped reversibly: a backslash is doubled, and ``<|``
becomes ``<\\|``, so no text can hold a control string. A rendered conversation is one string and a loss mask: for each turn, the stretch that counts.

Scaling: one shuffle, by conversation; the fold of each message, the effect of regenerations and the rendering all use it. A conversation is one output string, so its rows
must meet; nothing else is gathered.

Edge cases: null texts and roles are empty; null conversation ids form one conversation; null sequences come first. Ties in sequence are
ordered by role, then text. Repeated rows are repeated turns. Events without message_id are whole messages. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, MIDDLE, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """conv_id, seq, role, text of the messages that stand at the end of the log; seq is where a message began."""
    alone = F.col("message_id").isNull()
    kind = F.when(alone, F.lit("message")).otherwise(F.col("kind"))
    named = events.select("conv_id", "seq", kind.alias("kind"), "message_id", F.when(alone, F.monotonically_increasing_id()).alias("row"), "role", F.coalesce("text", F.lit("")).alias("text"))
    resets = F.col("kind").isin("message", "edit", "regenerate")
    log = F.array_sort(F.collect_list(F.struct("seq", resets.alias("resets"), "kind", "role", "text")))
    told = named.repartition("conv_id").groupBy("conv_id", "message_id", "row").agg(log.alias("log"), F.max(F.when(resets, F.col("seq"))).alias("from_seq"), F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).alias("again"))
    last = F.filter("log", lambda e: F.col("from_seq").isNull() | (e["seq"] > F.col("from_seq")) | ((e["seq"] == F.col("from_seq")) & e["resets"]))
    role = F.get(F.filter(F.col("log"), lambda e: e["role"].isNotNull()), F.lit(0))["role"]
    messages = told.select("conv_id", F.element_at("log", 1)["seq"].alias("seq"), "again", role.alias("role"), F.array_join(F.transform(last, lambda e: e["text"]), "").alias("text"))
    earlier = Window.partitionBy("conv_id").orderBy("seq").rangeBetween(Window.unboundedPreceding, -1)
    stands = F.coalesce(F.max("again").over(earlier) <= F.col("seq"), F.lit(True))
    return messages.withColumn("stands", stands).where("stands").select("conv_id", "seq", "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss: for each turn (first, length) of the characters that count, from the end of its start mark; null where none do."""
    turn = F.struct("seq", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    line = lambda t: F.concat(F.lit(START), escape(t["role"]), F.lit(MIDDLE), escape(t["text"]), F.lit(END))
    first = lambda t: F.char_length(escape(t["role"])) + len(MIDDLE)
    counts = lambda t: F.when(t["role"] == "assistant", F.struct(first(t).alias("first"), F.char_length(escape(t["text"])).alias("length")))
    return turns.select("conv_id", F.array_join(F.transform("turns", line), "").alias("formatted"), F.transform("turns", counts).alias("loss"))


def turns_of(formatted: Column) -> Column:
    """The stretches of a formatted string between start marks."""
    parts = F.split(formatted, r"<\|im_start\|>")
    return F.slice(parts, 2, F.size(parts) - 1)


def read_back(formatted: Column) -> Column:
    """The turns (role, text) of a formatted string."""
    return F.transform(turns_of(formatted), lambda t: F.struct(
        unescape(F.substring_index(t, MIDDLE, 1)).alias("role"),
        unescape(F.element_at(F.split(F.substring_index(t, END, 1), r"<\|im_sep\|>", 2), 2)).alias("text"),
    ))


def loss_text(formatted: Column, loss: Column) -> Column:
    """All text of a formatted string under its loss mask, unescaped."""
    parts = F.zip_with(turns_of(formatted), loss, lambda t, m: F.coalesce(F.substring(t, m["first"] + 1, m["length"]), F.lit("")))
    return F.array_join(F.transform(parts, unescape), "")


def digests(rendered: DataFrame) -> DataFrame:
    """What a rendered conversation says, read back from its string and mask."""
    read = rendered.select("conv_id", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss")).alias("said"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.char_length("said").cast("long").alias("loss_chars"),
        F.sha2("said", 256).alias("loss_sha256"),
        "formatted_chars",
    )
