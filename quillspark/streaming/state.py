"""Streaming forms of the keyed operators."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quillspark.config import DEFAULT


def dedupe(stream: DataFrame, key: str, at: str, ttl: str = "10 minutes") -> DataFrame:
    """Drops events whose key was seen within the watermark; blank keys always pass."""
    marked = stream.withColumn(key, F.when(F.trim(F.col(key)) == "", None).otherwise(F.col(key)))
    unique = F.coalesce(F.col(key), F.expr("uuid()"))
    return marked.withColumn("__key", unique).withWatermark(at, ttl).dropDuplicatesWithinWatermark(["__key"]).drop("__key")


def event_counts(stream: DataFrame, at: str, window: str, late: str, *keys: str) -> DataFrame:
    """Events by time window and keys, closed by the watermark."""
    return stream.withWatermark(at, late).groupBy(F.window(at, window), *keys).agg(F.count("*").alias("n"))


def ttl_dedupe(stream: DataFrame, ttl: int = DEFAULT.dedupe_ttl_seconds, late: str = "10 minutes") -> DataFrame:
    """stream (key, at timestamp, id) with accepted, as memory.ttl_dedupe decides: a key is
    accepted again only more than ttl seconds after its last accepted event. Events come
    in the order of at, but for such as share a micro-batch; the state of a key ends once
    the watermark has passed its time. Blank keys are always accepted and keep no state."""
    blank = F.coalesce(F.trim("key"), F.lit("")) == ""
    keyed = stream.where(~blank).select("key", "at", F.col("id").cast("string").alias("id")).withWatermark("at", late)

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        last = state.get[0] if state.exists else None
        accepted = []
        for at in (int(t.timestamp()) for t in rows["at"]):
            accepted.append(last is None or at - last > ttl)
            last = at if accepted[-1] else last
        state.update((last,))
        state.setTimeoutTimestamp(max((last + ttl + 1) * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame({"key": key[0], "at": rows["at"], "id": rows["id"], "accepted": accepted})

    run.__annotations__ = {}
    out = keyed.groupBy("key").applyInPandasWithState(run, "key string, at timestamp, id string, accepted boolean", "last long", "append", GroupStateTimeout.EventTimeTimeout)
    return out.unionByName(stream.where(blank).select("key", "at", F.col("id").cast("string").alias("id"), F.lit(True).alias("accepted")))


def sessions(stream: DataFrame, most: int = DEFAULT.session_messages) -> DataFrame:
    """stream (user, seq long, role, text, reset boolean) with history: the user's last
    `most` messages before each one, as JSON [[role, text], ...]. A reset empties them and
    is not kept itself. Messages of one micro-batch count in the order of seq."""

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values("seq")
        kept = json.loads(state.get[0]) if state.exists else []
        before = []
        for role, text, reset in zip(rows["role"], rows["text"], rows["reset"]):
            before.append(json.dumps(kept, ensure_ascii=False))
            kept = [] if reset else [*kept, [role, text]][-most:]
        state.update((json.dumps(kept, ensure_ascii=False),))
        yield pd.DataFrame({"user": key[0], "seq": rows["seq"], "role": rows["role"], "text": rows["text"], "history": before})

    run.__annotations__ = {}
    known = stream.select(F.col("user").cast("string").alias("user"), "seq", "role", "text", F.coalesce("reset", F.lit(False)).alias("reset"))
    return known.groupBy("user").applyInPandasWithState(run, "user string, seq long, role string, text string, history string", "kept string", "append", GroupStateTimeout.NoTimeout)
