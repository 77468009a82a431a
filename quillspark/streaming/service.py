"""The message service as one streaming query: payloads in, replies and stored memory out.

Payloads arrive as lines of files that are added to a folder; the file source keeps in its checkpoint which
it has taken. Parsed messages pass the time-bounded dedupe, which is state in the checkpoint too. Each
micro-batch then goes through three steps that a second try does not repeat: commands on stored
memory, replies (appended once by batch), and turns (upserted by the id of the message). After a restart
each message has one reply."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from quillspark.operators import keyed, memory, webhook
from quillspark.streaming import sinks, state

#: What commands answer.
HELP = "可删除的记忆：1 用户图谱，2 对话记忆，12 全部。"
CLEARED = {"1": "已删除用户图谱。", "2": "已删除对话记忆。", "12": "已删除全部记忆。"}
REPLY = "message_id string, user_id string, reply string"
TURN = "message_id string, user string, at timestamp, query string, answer string"
EDGE = "user string, relation string, target string, evidence array<string>"
#: Answers (message_id, user_id, text, ...) with answer; a failed call has none.
Answer = Callable[[DataFrame], DataFrame]


def payloads(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """(payload, at): the lines of files under folder as a stream; at is the file's time."""
    rows = spark.readStream.option("maxFilesPerTrigger", files).format("text").load(folder)
    return rows.select(F.col("value").alias("payload"), F.col("_metadata.file_modification_time").alias("at")).where("trim(payload) <> ''")


def accepted(stream: DataFrame, token: str | None = None, ttl: int = 600, late: str = "10 minutes") -> DataFrame:
    """(message_id, user_id, text, command, status, at) of the messages and commands that were not there
    within ttl seconds before; a message without an id always counts."""
    rows = webhook.parse(stream, token).where("status in ('message', 'command')")
    body = F.to_json(F.struct("message_id", "user_id", "text", "command", "status"))
    fresh = state.ttl_dedupe(rows.select(F.col("message_id").alias("key"), "at", body.alias("id")), ttl, late).where("accepted")
    fields = F.from_json("id", "message_id string, user_id string, text string, command string, status string")
    return fresh.select(fields.alias("m"), "at").select("m.*", "at")


@dataclass(frozen=True)
class Stores:
    """Where replies (a log), turns and user edges (keyed tables) lie."""

    replies: str
    turns: str
    edges: str

    def tables(self, spark: SparkSession) -> tuple[keyed.Table, keyed.Table]:
        return keyed.table(spark, self.turns, ["message_id"], TURN), keyed.table(spark, self.edges, ["user", "relation", "target"], EDGE)


def run(stream: DataFrame, stores: Stores, answer: Answer, checkpoint: str, token: str | None = None, writer: str = "service") -> StreamingQuery:
    """Starts the service on a stream of payloads; it ends with what is there now."""
    spark = stream.sparkSession

    def commands(batch: DataFrame, _: int) -> None:
        asked = batch.where("status = 'command' and command <> 'help'")
        turns, edges = stores.tables(spark)
        for table, codes in ((edges, ("1", "12")), (turns, ("2", "12"))):
            # a second time there is nothing left to delete
            table.delete(asked.where(F.col("command").isin(*codes)).select(F.col("user_id").alias("user")).distinct())

    def replies(batch: DataFrame, number: int) -> None:
        meant = F.when(F.col("command") == "help", HELP)
        for code, text in CLEARED.items():
            meant = meant.when(F.col("command") == code, text)
        done = batch.where("status = 'command'").select("message_id", "user_id", meant.alias("reply"))
        said = answer(batch.where("status = 'message'"))
        talk = said.select("message_id", "user_id", F.coalesce(F.nullif(F.trim("answer"), F.lit("")), F.lit(memory.DEFAULT_REPLY)).alias("reply"))
        sinks.append_once(done.unionByName(talk), stores.replies, writer, number)

    def turns(batch: DataFrame, number: int) -> None:
        # the answers that were sent, read back, so a model that answers otherwise next time does no harm
        sent = sinks.read_log(spark, stores.replies, REPLY).where((F.col("writer") == writer) & (F.col("batch") == number))
        asked = batch.where("status = 'message' and message_id <> ''").select("message_id", F.col("user_id").alias("user"), F.col("at"), F.col("text").alias("query"))
        rows = asked.join(sent.select("message_id", F.col("reply").alias("answer")), "message_id").dropDuplicates(["message_id"])
        stores.tables(spark)[0].upsert(rows, writer=writer, batch=number)

    return sinks.effects(accepted(stream, token), checkpoint, commands, replies, turns)


def evaluate(spark: SparkSession, stores: Stores, log: str, checkpoint: str, writer: str = "evaluation") -> StreamingQuery:
    """A query of its own that scores each batch of replies once and appends the records to a log."""
    stream = spark.readStream.schema(f"{REPLY}, writer string, batch long").option("basePath", stores.replies).option("recursiveFileLookup", "false").parquet(f"{stores.replies}/*/*")

    def score(batch: DataFrame, number: int) -> None:
        turns = stores.tables(spark)[0].read(spark).select("message_id", "query")
        rows = batch.join(turns, "message_id").select(F.col("message_id").alias("id"), "query", F.col("reply").alias("answer"), F.col("query").alias("context"))
        scores = memory.eval_scores(rows)
        records = rows.join(scores, "id").withColumn("context_precision", F.lit(0.0))
        sinks.append_once(memory.log_record(records), log, writer, number)

    return sinks.effects(stream, checkpoint, score)
