"""Chat formatting from event logs. Only DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
# Code points of a streamed delta, and the numbers that the events of a turn may take.
CHUNK = 256
LOG_STEP = 1 << 32


def escape(text: Column) -> Column:
    """One more backslash between every "<" and "|", so that no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """A role on one line: backslashes doubled and line breaks written as backslash n."""
    return escape(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\")
    return F.array_join(F.transform(parts, lambda x: F.replace(x, F.lit("\\n"), F.lit("\n"))), "\\")


def fold_events(events: DataFrame) -> DataFrame:
    """Final messages of event logs: conv_id, first_seq, message, role, text.

    ``events`` has conv_id, seq, message (an id of any type that sorts), kind, role, text.
    Events of a message apply in the order of seq (ties: kind, role, text): ``message`` and
    ``edit`` set its text, ``regenerate`` starts it anew, ``delta`` appends, ``delete`` takes
    it away until something follows; other kinds and null kinds are ignored. A null text is
    empty, the role is the last one given (else empty). Null ids are ids like any other. Messages
    of one conversation are folded apart; a conversation must fit in a row only where it is
    rendered, as its formatted text does anyway.
    """
    known = events.select("conv_id", "seq", "message", "kind", "role", "text").filter(
        F.col("kind").isin("message", "edit", "regenerate", "delta", "delete")
    )
    event = F.struct("seq", "kind", "role", "text")
    logs = known.groupBy("conv_id", "message").agg(F.array_sort(F.collect_list(event)).alias("log"))
    starts = F.transform(F.col("log"), lambda e: e["kind"] != "delta")
    begin = F.greatest(F.size("log") - F.array_position(F.reverse(starts), True) + 1, F.lit(1))
    begin = F.when(F.array_contains(starts, True), begin).otherwise(F.lit(1)).cast("int")
    since = logs.withColumn("since", F.slice("log", begin, F.size("log")))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r.isNotNull())
    text = F.array_join(F.transform("since", lambda e: F.coalesce(e["text"], F.lit(""))), "")
    return since.filter(F.col("since")[0]["kind"] != "delete").select(
        "conv_id",
        F.col("log")[0]["seq"].alias("first_seq"),
        "message",
        F.coalesce(F.get(roles, F.size(roles) - 1), F.lit("")).alias("role"),
        text.alias("text"),
    )


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """One formatted text a conversation: conv_id, formatted, loss_spans.

    Turns stand in the order of first_seq, then message, role and text. ``loss_spans`` are
    (start, chars) in code points of the escaped texts of ``loss_role``, without the marks.
    """
    body = escape(F.col("text"))
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select(
        "conv_id",
        "first_seq",
        "message",
        "role",
        F.concat(head, body, F.lit(END + "\n")).alias("piece"),
        F.length(head).alias("lead"),
        F.length(body).alias("chars"),
    )
    order = Window.partitionBy("conv_id").orderBy("first_seq", "message", "role", "piece")
    running = order.rowsBetween(Window.unboundedPreceding, -1)
    placed = parts.withColumns(
        {
            "place": F.row_number().over(order),
            "start": F.coalesce(F.sum(F.length("piece")).over(running), F.lit(0)) + F.col("lead"),
        }
    )
    turns = placed.groupBy("conv_id").agg(
        F.array_sort(F.collect_list(F.struct("place", "piece", "role", "start", "chars"))).alias("turns")
    )
    masked = F.filter("turns", lambda t: t["role"] == loss_role)
    return turns.select(
        "conv_id",
        F.array_join("turns.piece", "").alias("formatted"),
        F.transform(masked, lambda t: F.struct(t["start"].alias("start"), t["chars"].alias("chars"))).alias(
            "loss_spans"
        ),
    )


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold event logs into final messages and render them; see ``fold_events`` and ``render``."""
    return render(fold_events(events), loss_role)


def turns_to_events(conversations: DataFrame) -> DataFrame:
    """Finished turns (conv_id, turn, role, text) as events, one message for each row; equal
    turn numbers and repeated rows stay messages of their own, ordered by role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return conversations.select("conv_id", "turn", "role", "text").select(
        "conv_id",
        F.row_number().over(order).cast("long").alias("seq"),
        F.row_number().over(order).cast("long").alias("message"),
        F.lit("message").alias("kind"),
        "role",
        "text",
    )


def turns_to_log(conversations: DataFrame, loss_role: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """Finished turns as the log of events that a chat would have written, which folds back to them: an answer
    (``loss_role``) is begun, thrown away and streamed anew in deltas of ``chunk`` code points, any other turn is sent
    with half of its text and edited. The first event of a message names the role. Null and empty texts, repeated
    rows and equal turn numbers are kept as by ``turns_to_events``."""
    number, text = F.col("seq"), F.coalesce(F.col("text"), F.lit(""))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{int(chunk)}}}"), F.lit(0))

    def event(kind: str, said: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), said.alias("said"))

    streamed = F.concat(
        F.array(event("delta", F.reverse(F.substring(text, 1, chunk))), event("regenerate", F.lit(None).cast("string"))),
        F.transform(pieces, lambda piece: event("delta", piece)),
    )
    half = F.substring(text, F.lit(1), (F.length(text) / 2).cast("int"))
    edited = F.array(event("message", half), event("edit", F.col("text")))
    answered = F.coalesce(F.col("role") == loss_role, F.lit(False))
    log = F.posexplode(F.when(answered, streamed).otherwise(edited)).alias("at", "event")
    return turns_to_events(conversations).select("conv_id", number, "message", "role", log).select(
        "conv_id",
        (number * LOG_STEP + F.col("at")).alias("seq"),
        "message",
        F.col("event.kind").alias("kind"),
        F.when(F.col("at") == 0, F.col("role")).alias("role"),
        F.col("event.said").alias("text"),
    )


def read_back(chats: DataFrame) -> DataFrame:
    """What a reader of the output sees: conv_id, formatted_chars, turns (role, text) and the
    texts under the loss mask, all unescaped."""
    pieces = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda _, i: i > 0)
    tail = len(END) + 1

    def turn(piece):
        role = F.substring_index(piece, "\n", 1)
        lead = F.length(role) + 1
        text = F.substring(piece, lead + 1, F.length(piece) - lead - tail)
        return F.struct(unescape_role(role).alias("role"), unescape(text).alias("text"))

    return chats.select(
        "conv_id",
        F.length("formatted").cast("long").alias("formatted_chars"),
        F.transform(pieces, turn).alias("turns"),
        F.transform(
            "loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"].cast("int") + 1, s["chars"]))
        ).alias("loss_texts"),
    )


def chat_digests(chats: DataFrame) -> DataFrame:
    """Digests of what is read back from the formatted text, a row for each conversation."""
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    loss = F.array_join("loss_texts", "")
    return read_back(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )
