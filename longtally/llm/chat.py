"""Chat transcripts from event logs: streamed deltas, edits and regenerations folded into messages, then rendered.

A log has one row per event: ``conv_id``, ``seq`` (any orderable type), ``event``, ``message`` (any
orderable type; messages of a conversation follow each other by it), ``role`` and ``text``:

* ``open`` starts a message, or starts it anew, with ``role``;
* ``delta`` appends ``text`` to the message;
* ``edit`` replaces all of its text so far by ``text``; later messages stay;
* ``regenerate`` drops its text so far, and drops all later messages opened before.

Folding needs no loop over events. What counts of a message is the text since its last reset (open, edit or
regenerate), and a message stays if it was opened after the last regeneration of every earlier one. Events
are folded by message first, on the map side too; then one exchange by conversation serves what earlier
messages drop, the running positions and the final rows, and a log already partitioned by conversation is not
shuffled at all. A conversation becomes one row, so it is bounded by what a row can hold.

The template is ``<|im_start|>role``, a newline, the text, ``<|im_end|>`` and a newline for every message.
Control strings inside roles and texts are broken by a backslash after their first character, and
backslashes are doubled, so nothing inside a message can be read as a mark and everything can be undone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

START, END = "<|im_start|>", "<|im_end|>\n"
#: Strings that tokenizers of chat models read as marks.
CONTROLS = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]")
#: Code points of one delta in ``log_of``.
PIECE = 512


def escaped(text: Column) -> Column:
    """``text`` without any control string; ``unescaped`` gives it back. Null becomes empty."""
    out = F.replace(F.coalesce(text, F.lit("")), F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(control[0] + "\\" + control[1:]))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def reconstruct(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text) of the messages that stand at the end of each log.

    Events that are delivered again (equal in all columns) count once. A message that is not open when its
    log ends, never opened or dropped, gives no row, though its regenerations still drop later ones. Unknown
    events are passed over. Null texts are empty, a null role is kept, null conversations and messages are
    ones of their own. Events of one ``seq`` are taken in the order open, regenerate, edit, delta, then by text.
    Columns beyond those of the log are dropped; an empty log gives no rows.
    """
    rank = F.when(F.col("event") == "open", 0).when(F.col("event") == "regenerate", 1).when(F.col("event") == "edit", 2).when(F.col("event") == "delta", 3)
    at = F.struct(F.col("seq").alias("seq"), rank.alias("rank"), F.coalesce("text", F.lit("")).alias("text"))
    log = events.select("conv_id", "message", at.alias("at"), "role").where("at.rank IS NOT NULL")
    last = lambda *kinds: F.max(F.when(F.col("at.rank").isin(*kinds), F.col("at")))
    folded = log.groupBy("conv_id", "message").agg(
        last(0).alias("opened"), last(0, 1, 2).alias("reset"), last(1).alias("again"),
        F.max_by("role", F.when(F.col("at.rank") == 0, F.struct("at", "role"))).alias("role"),
        F.collect_set(F.when(F.col("at.rank") >= 2, F.col("at"))).alias("pieces"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    stands = F.col("opened").isNotNull() & (F.col("dropped").isNull() | (F.col("opened") > F.col("dropped")))
    kept = folded.withColumn("dropped", F.max("again").over(earlier)).where(stands)
    pieces = F.sort_array(F.filter("pieces", lambda p: p >= F.col("reset")))
    return kept.select("conv_id", "message", "role", F.array_join(F.transform(pieces, lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame, learn: tuple = ("assistant",)) -> DataFrame:
    """(conv_id, formatted, loss_spans) of every conversation in ``messages`` (conv_id, message, role, text).

    ``loss_spans`` holds [start, end) in code points of ``formatted`` for the text of every message whose role is in
    ``learn``; a training loss is taken there only. Messages stand by ``message``, ties by role and text, all
    repeated rows included; a null role or text is rendered as empty.
    """
    head = F.concat(F.lit(START), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    turns = messages.select("conv_id", "message", "role", head.alias("head"), escaped(F.col("text")).alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    order = Window.partitionBy("conv_id").orderBy("message", "head", "body").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(size).over(order), F.lit(0)) + F.length("head"))
    span = F.struct(F.col("start").alias("start"), (F.col("start") + F.length("body")).alias("end"))
    whole = turns.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("start", F.concat("head", "body", F.lit(END)).alias("turn")))).alias("turns"),
        F.sort_array(F.collect_list(F.when(F.col("role").isin(*learn), span))).alias("loss_spans"),
    )
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), "loss_spans")


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds ``turns`` (array of role and text) and ``loss_text`` (all text under the loss mask) from what ``render`` wrote.

    A conversation without messages has no turns. Columns of these names are replaced, all others stay.
    """
    body = lambda turn: F.substr(turn, F.lit(len(START) + 1))
    # The role ends at the first newline that no backslash stands before.
    role = lambda turn: F.regexp_extract(body(turn), r"(?s)^([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n", 1)
    turn = lambda t: F.struct(
        unescaped(role(t)).alias("role"), unescaped(F.substr(body(t), F.length(role(t)) + 2)).alias("text")
    )
    parts = F.filter(F.split("formatted", F.lit(r"<\|im_end\|>\n")), lambda t: t != "")
    marked = F.transform("loss_spans", lambda s: F.substr("formatted", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return formatted.withColumn("turns", F.transform(parts, turn)).withColumn("loss_text", unescaped(F.array_join(marked, "")))


def log_of(conversations: DataFrame) -> DataFrame:
    """An event log from finished conversations (conv_id, turn, role, text), as a chat service would have written it.

    Texts arrive in deltas of ``PIECE`` code points. Some messages begin with a draft (their first words), which is
    then edited or regenerated; which ones, a hash of conversation and turn says. Rows of one turn are messages of
    their own, by role and text, equal rows too. The log is partitioned by conversation.
    """
    copy = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    rows = conversations.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.repartition("conv_id").withColumn("copy", copy)
    kind = F.pmod(F.xxhash64("conv_id", "turn"), F.lit(4))
    event = lambda name, text: F.struct(F.lit(name).alias("event"), text.alias("text"))
    draft, nothing = F.substring_index("text", " ", 4), F.lit(None).cast("string")
    pieces = F.transform(F.regexp_extract_all("text", F.lit(r"(?s).{1,%d}" % PIECE), F.lit(0)), lambda t: event("delta", t))
    steps = F.concat(
        F.array(event("open", nothing)),
        F.when(kind == 0, F.array(event("delta", draft), event("regenerate", nothing)))
        .when(kind == 1, F.array(event("delta", draft), event("edit", F.lit(""))))
        .otherwise(F.array().cast("array<struct<event:string,text:string>>")),
        pieces,
    )
    message = F.struct("turn", "copy")
    log = rows.select("conv_id", message.alias("message"), "role", F.posexplode(steps).alias("step", "e"))
    return log.select(
        "conv_id", F.struct("message", "step").alias("seq"), "e.event", "message", F.when(F.col("step") == 0, F.col("role")).alias("role"), "e.text"
    )
