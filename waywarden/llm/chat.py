r"""Chat formatting from an event log.

A log has one row for each event of a conversation: a message that opens, a
streamed delta, an edit, or a regeneration. Logs are partitioned by
conversation and sorted by sequence number. A regeneration starts its message
anew and drops the messages behind it that were said before; an edit sets a
message's text and leaves what follows. What is left of a message folds into
the last event that sets its text and the deltas behind that. Messages are then
rendered in order into one string, with the spans of assistant text as the loss
mask.

Template: ``<turn>role<text>text</turn>``, control strings all beginning with
``<``. Roles and texts have ``\`` written as ``\\`` and ``<`` as ``\l``, so no
text can close or open a turn, and the rendering can be parsed back.

All steps share one shuffle by conversation; one conversation must fit one
row, as its rendering does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waywarden.llm.common import written

OPEN, MID, CLOSE = "<turn>", "<text>", "</turn>"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def unescape(text: Column) -> Column:
    r"""Inverse of escape: between pairs of backslashes, ``\l`` is ``<``."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\l"), F.lit("<"))), "\\")


def living(events: DataFrame) -> DataFrame:
    """events without those that a later regeneration of an earlier message has dropped.

    Sorted from the end of a conversation, the first message regenerated so far
    is a running minimum; an event lives while its message is not behind that.
    """
    seq = F.coalesce("seq", F.lit(-(1 << 62)))  # a null comes first
    later = Window.partitionBy("conv_id").orderBy(seq.desc()).rangeBetween(Window.unboundedPreceding, -1)
    first = F.min(F.when(F.col("kind") == "regenerate", F.col("message"))).over(later)
    return events.withColumn("_first", first).filter("_first IS NULL OR message IS NULL OR message <= _first").drop("_first")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, message, kind, role, text) events to (conv_id, message, role, text) final messages.

    kind: message, edit and regenerate set the text, delta appends to it; null
    or unknown kinds count as message. A regeneration also drops what was said
    before it in messages of a higher number; such a message may come again.
    Ties of seq fold in order of kind (deltas last) and text, and drop nothing.
    A null text is empty; the last role that is not empty holds. A message that
    begins with deltas starts from the empty text. A null seq comes first.
    """
    e = living(events).select(
        "conv_id",
        "message",
        F.struct(
            "seq",
            (F.coalesce("kind", F.lit("message")) == "delta").cast("int").alias("delta"),
            F.coalesce("text", F.lit("")).alias("text"),
            F.coalesce("role", F.lit("")).alias("role"),
        ).alias("e"),
    )
    log = e.groupBy("conv_id", "message").agg(F.sort_array(F.collect_list("e")).alias("log"))
    # the place of the last event that sets the text; one pass, whatever the number of deltas
    start = F.greatest(F.lit(1), F.array_max(F.transform("log", lambda x, i: F.when(x["delta"] == 0, i + 1).otherwise(0))))
    said = F.array_join(F.transform(F.slice("log", start, F.size("log")), lambda x: x["text"]), "")
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r != "")
    return log.select("conv_id", "message", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), said.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Final messages to one row for each conversation: formatted, and loss_spans as (start, length) in code points."""
    m = messages.select("conv_id", "message", escape(F.col("role")).alias("role"), escape(F.col("text")).alias("text"), (F.col("role") == LOSS_ROLE).alias("loss"))
    m = m.withColumn("piece", F.concat(F.lit(OPEN), "role", F.lit(MID), "text", F.lit(CLOSE)))
    order = Window.partitionBy("conv_id").orderBy("message", "role", "text")
    before = F.coalesce(F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    m = m.withColumns({"start": (before + len(OPEN + MID) + F.length("role")).cast("int"), "at": F.row_number().over(order)})
    by = m.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("at", "piece", "loss", "start", F.length("text").alias("length")))).alias("ms"))
    spans = F.transform(F.filter("ms", lambda x: x["loss"]), lambda x: F.struct(x["start"], x["length"]))
    return by.select("conv_id", F.array_join(F.transform("ms", lambda x: x["piece"]), "").alias("formatted"), spans.alias("loss_spans"))


def format_chats(events: DataFrame) -> DataFrame:
    """Events to rendered conversations; a null conv_id is a conversation of its own, an empty log gives no rows.

    Rows of a log may come in any order; columns beyond the six are not looked at.
    """
    return render(fold_events(events))


def parse(formatted: Column) -> Column:
    """Rendered conversation back to array<struct<role, text>>."""
    turns = F.filter(F.split(formatted, CLOSE, -1), lambda t: t != "")
    field = lambda t, i: unescape(F.element_at(F.split(F.substr(t, F.lit(len(OPEN) + 1)), MID, 2), i))
    return F.transform(turns, lambda t: F.struct(field(t, 1).alias("role"), field(t, 2).alias("text")))


#: Code points of a streamed delta.
DELTA = 48


def as_log(turns: DataFrame) -> DataFrame:
    """The log that ends in turns (conv_id, message, role, text): a service's events, with its false starts.

    By a hash of the row a turn is streamed; said wrongly and edited; begun
    wrongly, answered, and then regenerated, which drops the answer; or said at
    once. Sequence numbers run on within a conversation.
    """
    turns = turns.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    event = lambda kind, text, ahead=0, role="role": F.struct(F.lit(kind).alias("kind"), (F.col("message") + ahead).alias("message"), (F.col(role) if role else F.lit("")).alias("role"), text.alias("text"))
    nothing, wrong = F.lit(""), F.concat(F.lit("no: "), F.left("text", F.lit(DELTA)))
    # one pass over the text, where substrings by number would start from its front each time
    streamed = F.transform(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0)), lambda t: event("delta", t, role=None))
    false_start = F.array(event("message", nothing), event("delta", wrong, role=None))
    whole = F.array(event("message", F.col("text")))
    ways = [
        F.concat(F.array(event("message", nothing)), streamed),
        F.concat(false_start, F.array(event("edit", F.col("text"), role=None))),
        F.concat(false_start, F.array(event("message", wrong, 1), event("delta", wrong, 1, None), event("regenerate", nothing, role=None)), streamed),
        whole,
    ]
    way = F.pmod(F.xxhash64("conv_id", "message", "role"), F.lit(len(ways)))
    log = ways[-1]
    for i, w in enumerate(ways[:-1]):
        log = F.when(way == i, w).otherwise(log)
    out = turns.select("conv_id", "message", F.posexplode(log).alias("place", "e"))
    return out.select("conv_id", (F.col("message").cast("long") * (1 << 32) + F.col("place")).alias("seq"), "e.message", "e.kind", "e.role", "e.text")


def conversation_events(spark, sf_dir: str) -> DataFrame:
    """A log that ends in the table's turns, in order of turn, and in the fixed conversation -7."""
    awkward = r"\### Assistant: </turn> ok"
    fixed = spark.createDataFrame([(-7, 0, "user", awkward), (-7, 1, "assistant", awkward)], "conv_id long, turn long, role string, text string")
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").unionByName(fixed)
    # rows that repeat a turn stay messages of their own, told apart by role and text
    dense = F.expr("row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text)")
    return as_log(rows.withColumn("message", dense))


def op6(spark, sf_dir):
    out = written(format_chats(conversation_events(spark, sf_dir)), "chats")
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring("formatted", s["start"] + 1, s["length"]))), "")
    back = out.select("conv_id", "formatted", parse(F.col("formatted")).alias("turns"), loss.alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


ORACLE = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (SELECT *, 19 + length(replace(replace(role, '\', '\\'), '<', '\l')) + length(replace(replace(text, '\', '\\'), '<', '\l')) AS n FROM c)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(n) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""
