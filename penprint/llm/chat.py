"""Chat formatting from event logs, in DataFrame functions only.

A log holds one event a row: (conv_id, seq, message, kind, role, text).
``message`` numbers the messages of a conversation in the order they are
shown, ``seq`` the events in the order they happened. Kinds:

* ``open`` begins a message with its role;
* ``delta`` adds streamed text to the end of the message;
* ``edit`` replaces the message's text; later deltas add to it;
* ``regenerate`` throws the message's text away, and with it all that was
  logged so far of the messages behind it, which answered the old text.

``reconstruct`` partitions the log by conversation, sorts it and folds it: an
event counts if no later regeneration covers it and no later edit of its
message does. One exchange by conversation serves every step; windows and
groups within it spill to disk. ``render`` writes a conversation as one text
and the loss mask as spans of code points; ``read_back`` reads turns and
masked texts out of what was rendered. A rendered conversation is one row, so
a single one must fit in a row (2 GB); conversations spread over all tasks.

Template: ``<|start|>`` role ``<|text|>`` text ``<|end|>`` for each message. In
roles and texts every backslash is doubled, and one is put behind the first
character of every control string (``CONTROL``), so no control string of the
template or of common chat formats occurs in them; reading takes both back.

Defined cases: null texts and roles are empty; a null conversation id is a
conversation of its own, a null message number comes first; an event that is
delivered again (same conversation and seq) counts once, the least by
(message, kind, role, text); the last of several openings gives the role; a
message without an opening, and events of unknown kinds, are left out; a
conversation without messages gives no row; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, TEXT, END = "<|start|>", "<|text|>", "<|end|>"
# What chat formats use as control strings; "<|" begins every mark of this template.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
TRAINED_ROLE = "assistant"
# Code points of one streamed delta in the log made from whole turns.
DELTA = 400


def escape(text: Column) -> Column:
    """The text without control strings."""
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(c[0] + "\\" + c[1:])), CONTROL, doubled)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def log_of_turns(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                 text: str = "text") -> DataFrame:
    """An event log that leads to these turns, for tables that hold finished turns only.

    Rows of a conversation are put in order of (turn, role, text) and numbered. By a checksum of
    conversation and number, a turn is streamed plainly, breaks off and is regenerated, is streamed short
    and edited, or is edited in the middle of its stream.
    """
    rows = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"),
                        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", F.row_number().over(in_order).cast("bigint").alias("message"), "role", "text")

    def events(kind: str, texts: Column) -> Column:
        return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))

    pieces = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{DELTA}}}"), F.lit(0))
    half = F.ceil(F.size("pieces") / 2).cast("int")
    begun = F.slice("pieces", F.lit(1), half)
    rest = F.slice("pieces", half + 1, F.greatest(F.size("pieces") - half, F.lit(0)))
    nothing = F.array(F.lit(""))
    way = F.crc32(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("message").cast("string")).cast("binary")) % 4
    course = (F.when(way == 1, F.concat(events("delta", begun), events("regenerate", nothing), events("delta", F.col("pieces"))))
              .when(way == 2, F.concat(events("delta", begun), events("edit", F.array("text"))))
              .when(way == 3, F.concat(events("delta", F.reverse(begun)), events("edit", F.array(F.array_join(begun, ""))),
                                       events("delta", rest)))
              .otherwise(events("delta", F.col("pieces"))))
    log = rows.withColumn("pieces", pieces).select(
        "conv_id", "message", "role", F.posexplode(F.concat(events("open", nothing), course)).alias("place", "event"))
    happened = Window.partitionBy("conv_id").orderBy("message", "place")
    return log.select("conv_id", F.row_number().over(happened).cast("bigint").alias("seq"), "message", "event.kind",
                      F.when(F.col("event.kind") == "open", F.col("role")).alias("role"), "event.text")


def reconstruct(log: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the messages that the log leaves."""
    events = log.select("conv_id", "seq", "message", "kind", "role", F.coalesce("text", F.lit("")).alias("text"))
    delivered = Window.partitionBy("conv_id").orderBy("seq", "message", "kind", "role", "text")
    events = (events.withColumn("again", F.lag(F.struct("seq")).over(delivered).eqNullSafe(F.struct("seq")))
              .where("not again"))
    upto = Window.partitionBy("conv_id").orderBy("message")
    of_message = Window.partitionBy("conv_id", "message")
    regenerated = F.when(F.col("kind") == "regenerate", F.col("seq"))
    events = events.select(
        "conv_id", "seq", "message", "kind", "role", "text",
        F.max(regenerated).over(upto.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("cut"),
        F.max(regenerated).over(upto.rangeBetween(Window.unboundedPreceding, -1)).alias("cut_before"),
        F.max(F.when(F.col("kind") == "edit", F.col("seq"))).over(of_message).alias("edited"))

    def after(place: str) -> Column:
        return F.col(place).isNull() | (F.col("seq") > F.col(place))

    opened = (F.col("kind") == "open") & after("cut_before")
    written = (F.col("kind").isin("delta", "edit") & after("cut")
               & (F.col("edited").isNull() | (F.col("seq") >= F.col("edited"))))
    live = events.where(opened | written)
    text = F.when(F.col("kind") != "open", F.struct("seq", "text"))
    role = F.when(F.col("kind") == "open", F.struct("seq", F.coalesce("role", F.lit("")).alias("role")))
    folded = live.groupBy("conv_id", "message").agg(F.max(role).alias("opening"), F.collect_list(text).alias("texts"))
    return folded.where("opening is not null").select(
        "conv_id", "message", "opening.role",
        F.array_join(F.transform(F.array_sort("texts"), lambda t: t["text"]), "").alias("text"))


def render(messages: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """(conv_id, formatted, loss): the whole text and, for each message, the (start, length) of its trained code points."""
    parts = messages.select(
        "conv_id", "message", F.concat(F.lit(START), escape(F.col("role")), F.lit(TEXT)).alias("head"),
        escape(F.col("text")).alias("body"), (F.col("role") == trained_role).alias("trained"))
    size = F.length("head") + F.length("body") + len(END)
    before = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(
        "conv_id", "message", F.concat("head", "body", F.lit(END)).alias("piece"),
        (F.coalesce(F.sum(size.cast("bigint")).over(before), F.lit(0)) + F.length("head")).alias("start"),
        F.when(F.col("trained"), F.length("body")).otherwise(F.lit(0)).cast("bigint").alias("length"))
    whole = parts.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("message", "piece", "start", "length"))).alias("pieces"))
    return whole.select("conv_id", F.array_join(F.transform("pieces", lambda p: p["piece"]), "").alias("formatted"),
                        F.transform("pieces", lambda p: F.struct(p["start"], p["length"])).alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted_chars, position, role, text, loss_text) of every turn, read out of text and loss mask."""
    turns = formatted.select("conv_id", "loss", F.length("formatted").cast("bigint").alias("formatted_chars"),
                             F.posexplode(F.split("formatted", END.replace("|", r"\|"))).alias("position", "piece"))
    before = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.select(
        "conv_id", "formatted_chars", "position", "piece", F.get("loss", F.col("position")).alias("loss"),
        F.coalesce(F.sum((F.length("piece") + len(END)).cast("bigint")).over(before), F.lit(0)).alias("at"))
    # Every turn ends with a mark, so the last piece is the empty rest.
    turns = turns.where("piece != ''")
    head = F.substring_index("piece", TEXT, 1)
    body = F.substr("piece", F.length(head) + len(TEXT) + 1)
    masked = F.substr("piece", (F.col("loss.start") - F.col("at") + 1).cast("int"), F.col("loss.length").cast("int"))
    return turns.select("conv_id", "formatted_chars", "position",
                        unescape(F.substr(head, F.lit(len(START) + 1))).alias("role"),
                        unescape(body).alias("text"), unescape(masked).alias("loss_text"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation: number and sha256 of the turns and of the trained texts read back, and the formatted length."""
    read = read_back(formatted).groupBy("conv_id", "formatted_chars").agg(
        F.count(F.lit(1)).alias("n_turns"),
        F.array_sort(F.collect_list(F.struct("position", F.concat("role", F.lit("\n"), "text", F.lit("\n")).alias("turn"),
                                             "loss_text"))).alias("turns"))
    whole = read.select("conv_id", "n_turns", "formatted_chars",
                        F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("turns"),
                        F.array_join(F.transform("turns", lambda t: t["loss_text"]), "").alias("loss"))
    return whole.select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                        F.length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                        "formatted_chars")


def formatted_conversations(turns: DataFrame) -> DataFrame:
    """Conversations folded from the log of these turns, rendered, read back and summed up."""
    return digests(render(reconstruct(log_of_turns(turns))))
