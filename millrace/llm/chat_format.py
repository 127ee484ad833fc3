"""Prefix-target expansion of conversations into training examples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Marks of the template. "<" and ">" never occur inside an escaped text, so a mark can't be forged by one.
OPEN, AFTER_ROLE, CLOSE = "<turn:", ">\n", "</turn>\n"
TURN = r"<turn:([^<>]*)>\n([^<]*)</turn>\n"


def escape(text: Column) -> Column:
    r"""``\`` to ``\s``, ``<`` to ``\l``, ``>`` to ``\g``: reversible, and free of marks."""
    out = F.replace(text, F.lit("\\"), F.lit("\\s"))
    return F.replace(F.replace(out, F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    out = F.replace(F.replace(text, F.lit("\\g"), F.lit(">")), F.lit("\\l"), F.lit("<"))
    return F.replace(out, F.lit("\\s"), F.lit("\\"))


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted text as ``array<struct<role, text>>``."""
    roles = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1))
    texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape(r).alias("role"), unescape(t).alias("text")))


def loss_text(formatted: Column, start: Column, end: Column) -> Column:
    """What the loss mask of an example covers, unescaped."""
    return unescape(F.substring(formatted, start + 1, end - start))


def prefix_targets(conversations: DataFrame, trainable: str = "assistant") -> DataFrame:
    """One example for every turn of role ``trainable``, with all turns before it as context.

    Takes ``conv_id, turn, role, text`` (other columns are ignored) and returns ``conv_id, example`` (from 0),
    ``n_turns`` (turns in the example), ``text``, ``loss_start, loss_end`` (code points of ``text``, end exclusive;
    the reply alone, without its marks). Turns after the last trainable one, or of a conversation without any,
    come as one more example whose loss span is empty, so that no turn is lost.

    Null roles and texts are empty ones. Turns are in order of ``turn``, nulls first, then role and text; repeated
    rows are turns of their own. A null ``conv_id`` is a conversation like any other. An empty table gives no rows.
    One shuffle, on ``conv_id``. A conversation is one row here, as its last example is one text anyhow.
    """
    turn = F.struct(
        F.col("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    convs = conversations.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    heads = F.transform("turns", lambda t: F.concat(F.lit(OPEN), escape(t["role"]), F.lit(AFTER_ROLE)))
    bodies = F.transform("turns", lambda t: escape(t["text"]))
    trained = F.transform("turns", lambda t: t["role"] == trainable)
    convs = convs.select("conv_id", F.size("turns").alias("n"), heads.alias("heads"), bodies.alias("bodies"), trained.alias("trained"))
    ends = F.filter(F.sequence(F.lit(1), F.col("n")), lambda i: F.get("trained", i - 1) | (i == F.col("n")))
    cut = convs.select("*", F.posexplode(ends).alias("example", "n_turns"))

    last = F.col("n_turns") - 1
    parts = F.zip_with("heads", "bodies", lambda h, b: F.concat(h, b, F.lit(CLOSE)))
    context = F.array_join(F.slice(parts, F.lit(1), last), "")
    cut = cut.select(
        "conv_id",
        "example",
        "n_turns",
        context.alias("context"),
        F.get("heads", last).alias("head"),
        F.get("bodies", last).alias("body"),
        F.get("trained", last).alias("has_target"),
    )
    start = F.length("context") + F.length("head")
    end = start + F.when(F.col("has_target"), F.length("body")).otherwise(0)
    return cut.select(
        "conv_id",
        "example",
        "n_turns",
        F.concat("context", "head", "body", F.lit(CLOSE)).alias("text"),
        start.alias("loss_start"),
        end.alias("loss_end"),
    )


def conversation_digests(examples: DataFrame) -> DataFrame:
    """Conversations read back from their examples: turns, trained text and size."""
    loss = F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("loss"))
    back = examples.groupBy("conv_id").agg(
        F.max_by("text", "n_turns").alias("whole"),
        F.array_sort(F.collect_list(loss)).alias("losses"),
        F.sum(F.length("text")).alias("formatted_chars"),
        F.count(F.lit(1)).alias("n_examples"),
    )
    back = back.select("*", read_turns(F.col("whole")).alias("turns"), F.array_join("losses.loss", "").alias("trained"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("trained").cast("bigint").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("bigint"),
        F.col("n_examples").cast("bigint"),
    )
