"""Incoming message events: two layouts of a JSON payload to one row each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

#: The event type of the newer layout and the commands on stored memory.
RECEIVE = "im.message.receive_v1"
UNKNOWN_USER = "unknown_user"
VERBS = ("删除记忆", "清空记忆")
TARGETS = {"1": "1", "2": "2", "12": "12", "21": "12"}


def field(path: str) -> Column:
    return F.get_json_object("payload", f"$.{path}")


def filled(*paths: str) -> Column:
    return F.coalesce(*[F.nullif(field(p), F.lit("")) for p in paths])


def memory_command(text: Column) -> Column:
    """help, 1, 2 or 12 for a command on stored memory, else null. Spaces and the width
    of the colon do not matter."""
    compact = F.replace(F.replace(F.trim(text), F.lit("："), F.lit(":")), F.lit(" "), F.lit(""))
    out = F.when(compact.isin(*VERBS), "help")
    for target, meaning in TARGETS.items():
        out = out.when(compact.isin(*[v + colon + target for v in VERBS for colon in ("", ":")]), meaning)
    return out


def parse(payloads: DataFrame, token: str | None = None) -> DataFrame:
    """payloads (payload string, ...) with status, msg_type, message_id, user_id, text and
    command. status: invalid, encrypted, challenge, refused (a token that is not the given
    one), other, not_text, empty, command or message. Broken JSON is invalid."""
    new = F.coalesce(field("header.event_type") == RECEIVE, F.lit(False))
    old = ~new & F.coalesce(field("event.type") == "message", F.lit(False))
    kind = F.when(new, field("event.message.message_type")).when(old, F.coalesce(filled("event.msg_type", "event.message_type"), F.lit("text")))
    message = F.when(new, field("event.message.message_id")).when(old, filled("event.open_message_id", "event.message_id"))
    sender = field("event.sender.sender_id.open_id")
    user = F.when(new, sender).when(old, F.coalesce(filled("event.open_id", "event.user_open_id"), F.nullif(sender, F.lit(""))))
    body = F.when(new, T.message_text(field("event.message.content"))).when(old, F.coalesce(filled("event.text"), T.message_text(field("event.content"))))
    given = filled("token", "header.token")
    challenge, encrypted = field("challenge").isNotNull(), field("encrypt").isNotNull()
    right = F.lit(token)
    refused = F.when(challenge, ~F.coalesce(field("token").eqNullSafe(right), F.lit(False))).otherwise(F.coalesce(given != right, F.lit(False))) if token is not None else F.lit(False)
    valid = F.coalesce(F.get_json_object("payload", "$").startswith("{"), F.lit(False))
    text = F.when(new | old, F.coalesce(T.sanitize_message(body), F.lit("")))
    rows = payloads.withColumns(
        {"msg_type": kind, "message_id": F.when(new | old, F.coalesce(message, F.lit(""))), "user_id": F.when(new | old, F.coalesce(user, F.lit(UNKNOWN_USER))), "text": text}
    ).withColumn("command", F.when(F.col("msg_type") == "text", memory_command(F.col("text"))))
    status = (
        F.when(~valid, "invalid").when(encrypted, "encrypted").when(refused, "refused").when(challenge, "challenge").when(F.col("msg_type").isNull(), "other")
        .when(F.col("msg_type") != "text", "not_text").when(F.col("text") == "", "empty").when(F.col("command").isNotNull(), "command").otherwise("message")
    )
    return rows.withColumn("status", status)
