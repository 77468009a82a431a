"""Further registered queries: ingestion, stored graph, profiles, reports and evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import assist, graph, ingest, memory, store
from quillspark.plans.queries import EDGE_ROWS, NAMES, register, triples, writes
from quillspark.sources.readers import table


@register("token_length", r"SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\x{4e00}-\x{9fff}]|[A-Za-z0-9_]+|[^\sA-Za-z0-9_\x{4e00}-\x{9fff}]')) AS n_tokens FROM documents")
def token_length(spark, d):
    return ingest.token_lengths(table(spark, d, "documents")).select("doc_id", "n_tokens")


@register(
    "chunk_context",
    """WITH last AS (SELECT lang, source, arg_max(text, doc_id) AS document FROM documents GROUP BY ALL),
chunks AS (SELECT doc_id, lang, CASE WHEN doc_id % 10 = 0 THEN 'elsewhere' ELSE source END AS source, text FROM documents)
SELECT doc_id, sha256(coalesce(document, '')) AS document, sha256(CASE WHEN doc_id % 3 = 0 THEN coalesce(text, '') ELSE 'context ' || coalesce(text, '') END) AS indexed FROM chunks LEFT JOIN last ON chunks.lang = last.lang AND chunks.source = last.source""",
)
def chunk_context(spark, d):
    rows = table(spark, d, "documents")
    chapters = rows.select("lang", "source", F.col("doc_id").alias("ord"), F.col("text").alias("content"))
    chunks = rows.select("doc_id", "lang", F.when(F.col("doc_id") % 10 == 0, "elsewhere").otherwise(F.col("source")).alias("source"), "text")
    out = ingest.with_context(chunks, chapters, ["lang", "source"])
    enriched = F.when(F.col("doc_id") % 3 == 0, "").otherwise(F.concat(F.lit("context "), F.coalesce("text", F.lit(""))))
    return out.select("doc_id", F.sha2("document", 256).alias("document"), F.sha2(ingest.index_text(enriched, F.col("text")), 256).alias("indexed"))


@register(
    "edge_context",
    f"""WITH {EDGE_ROWS}, nodes AS (SELECT c_custkey AS id, 'n' || c_nationkey AS type FROM customer)
SELECT coalesce(a.type, '未知') AS src_type, coalesce(b.type, '未知') AS dst_type, count(*) AS edges FROM triples LEFT JOIN nodes a ON src = a.id LEFT JOIN nodes b ON dst = b.id GROUP BY ALL""",
)
def edge_context(spark, d):
    nodes = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), F.concat(F.lit("n"), "c_nationkey").alias("type"), F.lit("").alias("description"), F.lit(0).alias("seq"))
    out = ingest.with_ends(triples(spark, d).select("src", "dst"), nodes)
    return out.groupBy("src_type", "dst_type").agg(F.count("*").alias("edges"))


@register(
    "extraction_totals",
    f"""SELECT count(*) FILTER (doc_id % 50 <> 0) AS succeeded, count(*) FILTER (doc_id % 50 = 0) AS failed, CAST(sum(len({NAMES})) FILTER (doc_id % 50 <> 0) AS BIGINT) AS nodes,
CAST(sum(greatest(len({NAMES}) - 1, 0)) FILTER (doc_id % 50 <> 0) AS BIGINT) AS edges, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) FILTER (doc_id % 50 = 0) AS failures FROM documents""",
)
def extraction_totals(spark, d):
    rows = assist.extract(table(spark, d, "documents").select(F.col("doc_id").alias("chunk"), "text"))
    out = ingest.extraction_totals(rows.withColumn("status", F.when(F.col("chunk") % 50 == 0, "error").otherwise("ok")))
    return out.withColumn("failures", F.array_join(F.col("failures").cast("array<string>"), ","))


@register(
    "target_resolution",
    """WITH t AS (SELECT DISTINCT CAST(floor(value) AS BIGINT) AS target FROM events),
r AS (SELECT target, CASE WHEN target IN (SELECT p_partkey FROM part) THEN 'entity' WHEN target IN (SELECT c_custkey FROM customer) THEN 'memory' ELSE 'created' END AS kind FROM t)
SELECT kind, count(*) AS targets, CASE WHEN kind = 'created' THEN count(DISTINCT target) ELSE 0 END AS added FROM r GROUP BY kind""",
)
def target_resolution(spark, d):
    ids = lambda name, key: table(spark, d, name).select(F.col(key).cast("long").alias("id"))
    targets = table(spark, d, "events").select(F.floor("value").cast("long").alias("target")).distinct()
    out, added = ingest.resolve_targets(targets, ids("part", "p_partkey"), ids("customer", "c_custkey"))
    return out.join(added.select(F.col("id").alias("target"), F.lit(1).alias("new")), "target", "left").groupBy("kind").agg(F.count("*").alias("targets"), F.count("new").alias("added"))


@register("entity_multi_get", "SELECT p_partkey AS id, p_size AS size FROM part WHERE p_partkey IN (SELECT CAST(floor(value) AS BIGINT) FROM events)")
def entity_multi_get(spark, d):
    ids = table(spark, d, "events").select(F.floor("value").cast("long").alias("id"))
    return ingest.multi_get(table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("id"), F.col("p_size").alias("size")), ids)


@register(
    "described_entities",
    f"WITH {EDGE_ROWS} SELECT src AS id, count(DISTINCT description) AS descriptions FROM triples WHERE description <> 'F' GROUP BY src",
)
def described_entities(spark, d):
    t = triples(spark, d)
    nodes = graph.merge_nodes(t.select(F.col("src").alias("id"), F.lit("customer").alias("type"), F.when(F.col("description") != "F", F.col("description")).alias("description"), "seq"))
    known = nodes.withColumn("all_descriptions", F.array_compact("all_descriptions"))
    return ingest.described(known).select("id", F.size("all_descriptions").cast("long").alias("descriptions"))


def places(spark: SparkSession, d: str) -> DataFrame:
    """A hierarchy of two levels: customers in nations, nations in regions."""
    low = table(spark, d, "customer").select(F.lit(0).alias("level"), F.concat(F.lit("n"), "c_nationkey").alias("community_id"), F.col("c_custkey").cast("string").alias("member"))
    high = table(spark, d, "nation").select(F.lit(1).alias("level"), F.concat(F.lit("r"), "n_regionkey").alias("community_id"), F.concat(F.lit("n"), "n_nationkey").alias("member"))
    return low.unionByName(high)


PLACES = "places AS (SELECT 0 AS level, 'n' || c_nationkey AS community_id, c_custkey::VARCHAR AS member FROM customer UNION ALL SELECT 1, 'r' || n_regionkey, 'n' || n_nationkey FROM nation)"


@register("level_stats", f"WITH {PLACES} SELECT level, count(*) AS communities, max(n) AS largest FROM (SELECT level, community_id, count(*) AS n FROM places GROUP BY ALL) GROUP BY level")
def level_stats(spark, d):
    return ingest.level_stats(places(spark, d))


@register("community_numbers", f"WITH {PLACES} SELECT level, community_id, row_number() OVER (PARTITION BY level ORDER BY first) - 1 AS number FROM (SELECT level, community_id, min(member) AS first FROM places GROUP BY ALL)")
def community_numbers(spark, d):
    return ingest.numbered(places(spark, d))


@register("summary_counts", "SELECT count(*) FILTER (turn % 3 = 2 AND trim(text) <> '') AS valid, count(*) FILTER (turn % 3 <> 2 OR trim(text) = '' OR text IS NULL) AS failed FROM conversations")
def summary_counts(spark, d):
    summary = F.when(F.col("turn") % 3 == 0, " ").when(F.col("turn") % 3 == 1, F.concat(F.lit("生成失败: "), F.coalesce("text", F.lit("")))).otherwise(F.col("text"))
    return ingest.summary_counts(table(spark, d, "conversations").select(summary.alias("summary")))


@register("kv_profile", "SELECT user_id AS user, string_agg(event_type || ': ' || last, chr(10) ORDER BY event_type) AS profile FROM (SELECT user_id, event_type, arg_max(event_id, event_id)::VARCHAR AS last FROM events GROUP BY ALL) GROUP BY user_id")
def kv_profile(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").alias("user"), F.col("event_type").alias("key"), F.col("event_id").alias("value"), F.col("event_id").alias("seq"))
    return memory.profile_text(memory.kv_upsert(e))


@register(
    "graph_upsert",
    f"WITH {EDGE_ROWS}, firsts AS (SELECT src, relation, dst, chunk, min(seq) AS s FROM triples GROUP BY ALL) SELECT src, relation, dst, description, evidence FROM (SELECT src, relation, dst, arg_max(description, seq) AS description FROM triples GROUP BY ALL) JOIN (SELECT src, relation, dst, string_agg(chunk::VARCHAR, ',' ORDER BY s) AS evidence FROM firsts GROUP BY ALL) USING (src, relation, dst)",
)
def graph_upsert(spark, d):
    """The later half of the triples merged into the stored edges of the earlier half."""
    t = triples(spark, d)
    half = t.agg(F.avg("chunk").alias("half"))  # one row
    parts = t.crossJoin(F.broadcast(half))
    old, new = (graph.merge_edges(parts.where(x)) for x in ("chunk <= half", "chunk > half"))
    out = store.upsert_edges(old, new)
    return out.withColumn("evidence", F.array_join(F.col("source_chunk_ids").cast("array<string>"), ",")).drop("source_chunk_ids")


@register("edges_deleted", "SELECT count(DISTINCT (user_id, event_type, CAST(floor(value) AS BIGINT))) FILTER (user_id % 2 = 1) AS kept, count(DISTINCT (user_id, event_type, CAST(floor(value) AS BIGINT))) FILTER (user_id % 2 = 0) AS deleted FROM events")
def edges_deleted(spark, d):
    w = memory.user_edges(writes(spark, d))
    kept, gone = memory.delete_keys(w, w.where("user % 2 = 0").select("user").distinct(), ["user"])
    return kept.agg(F.count("*").alias("kept")).withColumn("deleted", F.lit(gone).cast("long"))


@register("vector_free_rows", "SELECT vec_id, label FROM embeddings")
def vector_free_rows(spark, d):
    e = table(spark, d, "embeddings")
    return e.select(*store.scalars(e))


@register("answer_text", "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'thought' ELSE trim(coalesce(text, '')) END AS answer FROM conversations")
def answer_text(spark, d):
    text = F.coalesce("text", F.lit(""))
    parts = F.to_json(F.array(F.struct(F.lit("text").alias("type"), text.alias("text"))))
    whole = F.to_json(F.struct(text.alias("content")))
    thought = F.to_json(F.struct(F.lit("").alias("content"), F.lit(" thought ").alias("reasoning_content")))
    kind = F.col("turn") % 4
    content = F.when(kind == 0, parts).when(kind == 1, F.when(F.trim(text) == "", "").otherwise(whole)).when(kind == 2, text).otherwise(thought)
    return table(spark, d, "conversations").select("conv_id", "turn", T.answer_text(content).alias("answer"))


@register("event_ids", "SELECT event_id, 'evt_' || substr(sha256(event_id::VARCHAR || chr(31) || event_type), 1, 8) AS memory_id FROM events")
def event_ids(spark, d):
    return table(spark, d, "events").select("event_id", T.event_id(F.col("event_id").cast("string"), F.col("event_type")).alias("memory_id"))


@register("context_blocks", "SELECT conv_id, count(*) FILTER (trim(text) <> '') AS blocks FROM conversations GROUP BY conv_id")
def context_blocks(spark, d):
    joined = table(spark, d, "conversations").groupBy("conv_id").agg(T.join_ordered(F.col("turn"), F.coalesce("text", F.lit("")), "\n---\n").alias("context"))
    return joined.select("conv_id", F.size(T.contexts(F.col("context"))).cast("long").alias("blocks"))


X = r"list_distinct(regexp_extract_all(lower(coalesce({}, '')), '[\x{{4e00}}-\x{{9fff}}]|[a-z0-9_]+'))"


@register(
    "context_precision",
    f"""WITH t AS (SELECT conv_id, turn, text AS answer, lag(text) OVER w AS c1, lead(text) OVER w AS c2 FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
v AS (SELECT conv_id, turn, CASE WHEN len(list_intersect({X.format('answer')}, {X.format('c1')})) >= 0.5 * greatest(len({X.format('answer')}), 1) THEN 1 ELSE 0 END AS a, CASE WHEN len(list_intersect({X.format('answer')}, {X.format('c2')})) >= 0.5 * greatest(len({X.format('answer')}), 1) THEN 1 ELSE 0 END AS b FROM t)
SELECT conv_id, turn, CASE WHEN a + b = 0 THEN 0.0 ELSE round((a + b * (a + b) / 2.0) / (a + b), 6) END AS context_precision FROM v""",
)
def context_precision(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = table(spark, d, "conversations").select(F.struct("conv_id", "turn").alias("id"), F.col("text").alias("answer"), F.array(F.lag("text").over(w), F.lead("text").over(w)).alias("contexts"))
    return memory.context_precision(rows).select("id.conv_id", "id.turn", "context_precision")


@register("message_lists", "SELECT conv_id, turn, least(turn, 4) + 2 AS messages, 'system' AS first, 'user' AS last FROM (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS turn FROM conversations)")
def message_lists(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("conv_id").orderBy("turn")
    c = table(spark, d, "conversations")
    turns = c.select("conv_id", (F.row_number().over(w) - 1).cast("long").alias("turn"), F.collect_list(F.struct("role", "text")).over(w.rowsBetween(-4, -1)).alias("history"), F.col("text").alias("query"))
    out = memory.message_list(turns, "answer from the context")
    return out.select("conv_id", "turn", F.size("messages").cast("long").alias("messages"), F.get("messages", F.lit(0))["role"].alias("first"), F.element_at("messages", -1)["role"].alias("last"))
