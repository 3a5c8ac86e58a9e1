"""Chat logs folded into final messages and rendered with a template, in Spark expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Marks of the template. Each begins with "<" or "[", and after either an escaped text has "\".
OPEN, TEXT, CLOSE = "<s>[ROLE]", "[TEXT]", "</s>"

#: What an event does to its message: it opens it, adds to it, replaces it, or empties it.
KINDS = ("open", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    """Put a backslash after each "<" and "[", so that no mark can occur in the text."""
    return F.regexp_replace(text, r"([<\[])", r"$1\\")


def unescape(text: Column) -> Column:
    """Undo `escape`: drop the one backslash that follows each "<" and "["."""
    return F.regexp_replace(text, r"([<\[])\\", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, msg, role, text) of a log (conv_id, msg, seq, kind, role, text).

    Events of a message apply in order of ``seq``: ``delta`` appends, ``edit`` replaces all so
    far, ``regenerate`` empties it; the role is the first that an ``open`` event names. Events
    that repeat (the same seq, kind and text, as after a second delivery) count once; others with
    equal seq apply in order of kind and text. Null roles and texts are empty, events of unknown
    kind are ignored, null seq come first. A message without an ``open`` event has an empty role.
    """
    event = F.struct("seq", "kind", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"))
    log = F.array_sort(F.collect_set(event))
    reset = F.transform(F.col("log"), lambda e: e["kind"].isin("edit", "regenerate").cast("int"))
    folded = (
        events.where(F.col("kind").isin(*KINDS))
        .groupBy("conv_id", "msg")
        .agg(log.alias("log"))
        .withColumn("back", F.array_position(F.reverse(reset), 1))
        .withColumn("last", F.when(F.col("back") > 0, F.size("log") - F.col("back") + 1).otherwise(1))
    )
    live = F.filter(
        F.col("log"),
        lambda e, i: (i + 1 >= F.col("last")) & e["kind"].isin("delta", "edit"),
    )
    opened = F.filter(F.col("log"), lambda e: e["kind"] == "open")
    return folded.select(
        "conv_id",
        "msg",
        F.coalesce(F.try_element_at(opened, F.lit(1))["role"], F.lit("")).alias("role"),
        F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"),
    )


def render(messages: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, and the loss mask as spans (start, length).

    A message becomes ``<s>[ROLE]role[TEXT]text</s>`` with both parts escaped; the mask covers the
    escaped texts of ``learn_role``, in code points from 0. A conversation without messages has
    no row; null conv_id form one conversation. A conversation is one value, so its text must fit
    one row (2 GB); the folding and escaping before work per message.
    """
    order = Window.partitionBy("conv_id").orderBy("msg").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    pieces = messages.select(
        "conv_id",
        "msg",
        (F.col("role") == learn_role).alias("learn"),
        F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        escape(F.col("text")).alias("body"),
    ).withColumn("piece", F.concat("head", "body", F.lit(CLOSE)))
    placed = pieces.withColumn("start", F.sum(F.length("piece").cast("long")).over(order) - F.length("piece") + F.length("head"))
    part = F.struct("msg", "piece", "learn", "start", F.length("body").alias("length"))
    parts = F.array_sort(F.collect_list(part))
    return (
        placed.groupBy("conv_id")
        .agg(parts.alias("parts"))
        .select(
            "conv_id",
            F.array_join(F.transform("parts", lambda p: p["piece"]), "").alias("formatted"),
            F.transform(
                F.filter("parts", lambda p: p["learn"]), lambda p: F.struct(p["start"].alias("start"), p["length"].alias("length"))
            ).alias("loss"),
        )
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, the turns (role, text) and the text under the loss mask, from `render`'s output alone."""
    closed = F.split(F.col("formatted"), CLOSE, -1)
    messages = F.slice(closed, F.lit(1), F.size(closed) - 1)
    return rendered.select(
        "conv_id",
        "formatted",
        F.transform(
            messages,
            lambda m: F.struct(
                unescape(F.substring_index(F.substring(m, len(OPEN) + 1, 2**31 - 1), TEXT, 1)).alias("role"),
                unescape(F.element_at(F.split(m, r"\[TEXT\]", 2), 2)).alias("text"),
            ),
        ).alias("turns"),
        F.array_join(
            F.transform(
                "loss",
                lambda s: unescape(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))),
            ),
            "",
        ).alias("learned"),
    )


def replay(turns: DataFrame) -> DataFrame:
    """A table of turns (conv_id, turn, role, text) as the event log it could have come from.

    Message numbers follow (turn, role, text); rows that repeat are messages of their own. A text
    arrives in two deltas; one of the assistant after a first try that is regenerated, others
    after a draft that is edited.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    half = F.floor(F.length("text") / 2).cast("int")
    front, back = F.substring(F.col("text"), F.lit(1), half), F.substring(F.col("text"), half + 1, F.length("text"))
    retry = F.when(F.col("role") == "assistant", "regenerate").otherwise("edit")

    def event(step: int, kind: Column | str, text: Column) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(F.lit(step).alias("step"), kind.alias("kind"), text.alias("text"))

    steps = F.array(
        event(0, "open", F.lit("")), event(1, "delta", back), event(2, retry, F.lit("")), event(3, "delta", front), event(4, "delta", back)
    )
    return (
        turns.select(
            "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        )
        .withColumn("msg", F.row_number().over(order) - 1)
        .withColumn("e", F.explode(steps))
        .select("conv_id", "msg", (F.col("msg").cast("long") * 5 + F.col("e.step")).alias("seq"), "e.kind", "role", "e.text")
    )


def format_log(events: DataFrame, learn_role: str = "assistant") -> DataFrame:
    """Fold a log of chat events and render its conversations; see `fold` and `render`."""
    return render(fold(events), learn_role)
