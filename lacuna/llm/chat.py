"""Chat formatting by event-sourced reconstruction, with SQL functions only.

Logs of events are partitioned by conversation once, sorted by sequence and folded into
final messages; then each conversation is rendered with a template that marks turns and
a mask that says which characters count for the loss.

The template writes ``<|im_start|>role``, a line feed, the text, ``<|im_end|>`` and a line
feed for each turn. Inside roles and texts a backslash is doubled and the string ``<|``
is broken by one backslash, so a marker in the output is always the template's own and
reading back restores every text exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"
KINDS = ("message", "delta", "edit", "regenerate")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit("<|")), F.lit("\\\\"), F.lit("\\"))


def escape_role(role: Column) -> Column:
    """As ``escape``; line feeds, which would end the role, become ``<``, backslash, ``n``."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<\\n"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<\\n"), F.lit("\n")))


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, position, role, text) of logs (conv_id, seq, message_id, kind, role, text).

    ``message`` and ``edit`` set a message's text, ``delta`` appends to it, ``regenerate``
    sets it anew (deltas may follow) and drops the conversation's messages that began
    between it and its message's begin. A message keeps its first place and its last
    given role. Null texts are empty, a null kind is a message, a null sequence sorts
    first; equal sequences go by kind, then text. Unknown kinds count as messages.
    """
    conv = Window.partitionBy("conv_id")
    message = Window.partitionBy("conv_id", "message_id")
    kind = F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("message")
    rows = events.select(
        "conv_id",
        F.coalesce(F.col("seq").cast("long"), F.lit(-(2**62))).alias("seq"),
        "message_id",
        F.array_position(F.array(*map(F.lit, KINDS)), kind).cast("int").alias("rank"),
        kind.alias("kind"),
        F.col("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    )
    rows = rows.withColumns(
        {
            "began": F.min("seq").over(message),
            "reset": F.max(F.when(F.col("kind") != "delta", F.col("seq"))).over(message),
            "last_reset": F.max(F.when(F.col("kind") != "delta", F.struct("seq", "rank", "text"))).over(message),
        }
    )
    later = conv.orderBy("seq").rangeBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("cut_from", F.min(F.when(F.col("kind") == "regenerate", F.col("began"))).over(later))
    kept = (
        rows.groupBy("conv_id", "message_id")
        .agg(
            F.min("began").alias("began"),
            F.min(F.when(F.col("seq") == F.col("began"), F.col("cut_from"))).alias("cut_from"),
            F.max_by("role", F.when(F.col("role").isNotNull(), F.struct("seq", "rank"))).alias("role"),
            F.max("last_reset.text").alias("head"),
            F.array_sort(F.collect_list(F.when((F.col("kind") == "delta") & (F.col("reset").isNull() | (F.col("seq") >= F.col("reset"))), F.struct("seq", "text")))).alias("deltas"),
        )
        .where(F.col("cut_from").isNull() | (F.col("cut_from") >= F.col("began")))
    )
    text = F.concat(F.coalesce("head", F.lit("")), F.array_join(F.transform("deltas", lambda d: d["text"]), ""))
    order = conv.orderBy("began", "message_id")
    return kept.select("conv_id", F.row_number().over(order).alias("position"), F.coalesce("role", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, formatted and mask of messages (conv_id, position, role, text).

    The mask has (start, end, loss) of each turn's text in code points of ``formatted``,
    in order; ``loss`` is true for turns of ``loss_role``.
    """
    head = F.concat(F.lit(OPEN), escape_role(F.coalesce("role", F.lit(""))), F.lit("\n"))
    rows = messages.select("conv_id", "position", (F.coalesce("role", F.lit("")) == loss_role).alias("loss"), head.alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    before = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    size = F.length("head") + F.length("body") + F.lit(len(CLOSE))
    start = F.coalesce(F.sum(size.cast("long")).over(before), F.lit(0).cast("long")) + F.length("head")
    rows = rows.withColumn("start", start)
    turn = F.struct("position", F.concat("head", "body", F.lit(CLOSE)).alias("turn"), F.struct("start", (F.col("start") + F.length("body")).alias("end"), "loss").alias("span"))
    turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    return turns.select("conv_id", F.array_join(F.col("turns.turn"), "").alias("formatted"), F.col("turns.span").alias("mask"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Logs folded and rendered: one row per conversation; an empty log gives no rows."""
    return render(fold_events(events), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text) and loss_text, both recovered from formatted and mask alone.

    A turn's begin follows from the end of the mask's entry before it, so each turn is
    cut out once and the work stays linear in the length of the conversation.
    """
    close = CLOSE.replace("|", "\\|").replace("\n", "\\n")
    parts = formatted.withColumn("__raw", F.split("formatted", close)).withColumn("__raw", F.slice("__raw", 1, F.greatest(F.size("__raw") - 1, F.lit(0))))

    def turn(x):
        line = F.substr(x, F.lit(len(OPEN) + 1))
        cut = F.position(F.lit("\n"), line)
        return F.struct(unescape_role(F.substring_index(line, "\n", 1)).alias("role"), unescape(F.substr(line, cut + 1)).alias("text"))

    def under_mask(x, i):
        span = F.get("mask", i)
        begin = F.when(i == 0, F.lit(0).cast("long")).otherwise(F.get("mask", i - 1)["end"] + len(CLOSE))
        cut = F.substr(x, (span["start"] - begin + 1).cast("int"), (span["end"] - span["start"]).cast("int"))
        return F.when(span["loss"], unescape(cut)).otherwise(F.lit(""))

    return parts.withColumns({"turns": F.transform("__raw", turn), "loss_text": F.array_join(F.transform("__raw", under_mask), "")}).drop("__raw")


def row_events(rows: DataFrame) -> DataFrame:
    """Conversation rows (conv_id, turn, role, text) as logs: each row is a message of its own.

    Rows go by turn, null turns first; rows with equal turns by role and text, and equal
    rows stay as often as they occur.
    """
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    seq = F.row_number().over(order).cast("long")
    return rows.select("conv_id", "turn", "role", "text").select("conv_id", seq.alias("seq"), seq.alias("message_id"), F.lit("message").alias("kind"), "role", "text")
