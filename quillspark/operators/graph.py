"""Property graph: merges, projection, expansion, communities."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillspark.config import DEFAULT
from quillspark.operators import assist, leiden
from quillspark.sources.staging import cut


def ordered_distinct(order: str, value: str):
    """Aggregate: distinct values in order of their first appearance."""
    return F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(value).alias("v")))), lambda s: s["v"]))


def merge_edges(triples: DataFrame) -> DataFrame:
    """triples (src, relation, dst, description, chunk, seq): one edge for each (src,
    relation, dst), the last description, the evidence in order."""
    return triples.groupBy("src", "relation", "dst").agg(F.max_by("description", "seq").alias("description"), ordered_distinct("seq", "chunk").alias("source_chunk_ids"))


def merge_nodes(mentions: DataFrame) -> DataFrame:
    """mentions (id, type, description, seq): the first type, all descriptions in order."""
    return mentions.groupBy("id").agg(F.min_by("type", "seq").alias("type"), ordered_distinct("seq", "description").alias("all_descriptions"))


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, weight, relations): directed typed edges folded; loops, null ends and edges made by
    memory drop."""
    kept = edges.where("src is not null and dst is not null and src <> dst")
    if "created_by" in edges.columns:
        kept = kept.where(F.coalesce("created_by", F.lit("")) != "Agent_Memory")
    return kept.groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").alias("weight"), F.array_sort(F.collect_set("relation")).alias("relations"))


def contract(edges: DataFrame, members: DataFrame) -> DataFrame:
    """Edges (a, b, weight) between communities of members (node, community): doubled
    weights summed, edges inside a community gone."""
    m = members.select("node", "community")
    both = edges.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b").where("ca <> cb")
    return both.groupBy(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b")).agg(F.sum(F.col("weight") * 2).alias("weight"))


def induced(edges: DataFrame, members: DataFrame, *more: str) -> DataFrame:
    """(community, a, b, weight, more columns): the edges with both ends in one community."""
    m = members.select("node", "community")
    return edges.join(m.toDF("a", "ca"), "a").join(m.toDF("b", "cb"), "b").where("ca = cb").select(F.col("ca").alias("community"), "a", "b", "weight", *more)


def evidence(edges: DataFrame, seeds: DataFrame, cap: int = DEFAULT.graph_chunk_cap) -> DataFrame:
    """(chunk, score, freq): evidence of all paths of one or two edges from the seeds
    (id, score), either way along an edge, no edge twice in a path. Edges made by memory
    or without evidence were filtered before. Seeds are few and broadcast by size."""
    e = edges.where("size(source_chunk_ids) > 0").withColumn("eid", F.xxhash64("src", "relation", "dst"))
    if "created_by" in edges.columns:
        e = e.where(F.coalesce("created_by", F.lit("")) != "Agent_Memory")
    both = e.select("eid", F.col("src").alias("u"), F.col("dst").alias("v"), "source_chunk_ids").unionByName(e.select("eid", F.col("dst").alias("u"), F.col("src").alias("v"), "source_chunk_ids"))
    one = seeds.select(F.col("id").alias("u"), "score").join(both, "u").select("score", "eid", F.col("v").alias("w"), F.col("source_chunk_ids").alias("c1"))
    two = one.join(both.select(F.col("u").alias("w"), F.col("eid").alias("eid2"), F.col("source_chunk_ids").alias("c2")), "w").where("eid <> eid2")
    chunks = one.select("score", F.explode("c1").alias("chunk")).unionByName(two.select("score", F.explode(F.concat("c1", "c2")).alias("chunk")))
    found = chunks.groupBy("chunk").agg(F.max("score").alias("score"), F.count("*").alias("freq"))
    return found.orderBy(F.desc("score"), F.desc("freq"), "chunk").limit(cap)


def searchable(summaries: DataFrame, closed: int = 3) -> DataFrame:
    """summaries (level, ...) below the `closed` highest levels."""
    top = summaries.agg((F.max("level") + 1).alias("levels"))
    return summaries.crossJoin(F.broadcast(top)).where(F.col("level") < F.col("levels") - closed).drop("levels")  # one row


def sliced(rows: DataFrame, size: int, bucket: int = 50_000) -> DataFrame:
    """rows (node, community, n) with slice: every community of n nodes in slices of at
    most size. Nodes are numbered within hash buckets of about `bucket` nodes, to which the
    totals of the buckets before are added, so no task numbers a whole large community."""
    b = F.pmod(F.xxhash64("node"), F.ceil(F.col("n") / bucket)).alias("b")
    rows = rows.select("*", b)
    before = F.coalesce(F.sum("c").over(Window.partitionBy("community").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    totals = rows.groupBy("community", "b").agg(F.count("*").alias("c")).select("community", "b", before.alias("before"))
    numbered = rows.withColumn("i", F.row_number().over(Window.partitionBy("community", "b").orderBy("node")) - 1).join(totals, ["community", "b"])
    return numbered.withColumn("slice", F.floor((F.col("before") + F.col("i")) / size)).drop("b", "i", "before")


def _within(inside: DataFrame, nodes: DataFrame) -> DataFrame:
    """The edges (parent, a, b, weight) of inside with both ends in one parent of nodes (parent, node)."""
    end = lambda c: nodes.select(F.col("node").alias(c), F.col("parent").alias(f"p{c}"))
    return inside.select("a", "b", "weight").join(end("a"), "a").join(end("b"), "b").where("pa = pb").select(F.col("pa").alias("parent"), "a", "b", "weight")


def _parts(inside: DataFrame, few: DataFrame, large: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(few, large) with the connected parts of large parents as parents of their own: those of at most GROUP
    rows go to few, small ones several together. They keep the total of their parent, whose division
    never joins two of them."""
    e = _within(inside, large)
    at = leiden.connected(e.select("a", "b"), large.select("node"))
    size = e.select(F.col("a").alias("node")).join(at, "node").groupBy("part").agg(F.count("*").alias("n"))
    sizes = large.select("parent", "node", "resolution", "total", "rows").join(at, "node").join(size, "part")
    bin_rows = leiden.GROUP // 8
    own = F.when(F.col("n") > bin_rows, F.concat(F.lit("part "), "part")).otherwise(F.concat(F.lit("bin "), F.pmod(F.xxhash64("part"), F.ceil(F.col("rows") / bin_rows)).cast("string")))
    named = cut(sizes.withColumn("parent", F.concat("parent", own)))
    whole = F.col("n") > leiden.GROUP
    return few.unionByName(named.where(~whole).select("parent", "node", "resolution", "total")), cut(named.where(whole).select("parent", "node", "resolution", "total"))


def partition(edges: DataFrame, nodes: DataFrame, max_size: int, step: float, max_resolution: float) -> DataFrame:
    """(node, community) of nodes (node) and edges (a, b, weight): Leiden communities of at most
    max_size nodes, each named by its smallest node. What is larger is divided again, apart
    from all else, with a resolution raised by step (twice step where a division did nothing) up
    to max_resolution, and after that cut in slices. A node without edges stays alone.

    Sets with few edges are divided to the end as groups, in parallel; larger ones by all tasks."""
    both = edges.where("a <> b").select("a", "b", F.col("weight").cast("double").alias("weight"))
    both = cut(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight")))
    nodes = nodes.select("node").distinct()
    ends = both.select(F.col("a").alias("node")).distinct()
    done = nodes.join(ends, "node", "left_anti").select("node", F.col("node").alias("community"))
    work = cut(nodes.join(ends, "node", "left_semi").select(F.lit("").alias("parent"), "node", F.lit(1.0).alias("resolution")))
    inside = cut(both.select(F.lit("").alias("parent"), "a", "b", "weight"))
    while True:
        rows = inside.groupBy("parent").agg(F.count("*").alias("rows"), F.sum("weight").alias("total"))
        placed = work.join(rows, "parent", "left").withColumn("parent", F.concat("parent", F.lit("/")))
        small = F.coalesce("rows", F.lit(0)) <= leiden.GROUP
        large = cut(placed.where(~small))
        few = placed.where(small).select("parent", "node", "resolution", F.lit(0.0).alias("total"))
        if not large.isEmpty():
            few, large = _parts(inside, few, large)
        few = cut(few)
        done = done.unionByName(leiden.divide_groups(_within(inside, few), few, max_size, step, max_resolution))
        work = large
        if work.isEmpty():
            return cut(done)
        inside = cut(_within(inside, work))
        degree = inside.groupBy("parent", F.col("a").alias("node")).agg(F.sum("weight").alias("k"))
        placed = cut(work.join(degree, ["parent", "node"]).withColumn("id", F.xxhash64("node")))
        links = cut(inside.select(F.xxhash64("a").alias("a"), F.xxhash64("b").alias("b"), "weight"))
        found = leiden.leiden(links, placed.select("id", "k", (F.col("resolution") / F.col("total")).alias("g")))
        named = placed.join(found, "id").select("parent", "node", "resolution", "label", "k", "total")
        sizes = named.groupBy("label").agg(F.count("*").alias("n"), F.min("node").alias("community"))
        # the nodes of a parent, unless it is a connected part of a larger one
        wholes = named.groupBy("parent").agg(F.when(F.sum("k") * (1 + 1e-9) >= F.max("total"), F.count("*")).otherwise(0).alias("whole"))
        named = cut(named.join(sizes, "label").join(wholes, "parent"))
        large, spent = F.col("n") > max_size, F.col("resolution") >= max_resolution
        slices = sliced(named.where(large & spent).select("node", "community", "n"), max_size)
        heads = slices.groupBy("community", "slice").agg(F.min("node").alias("head"))
        cuts = slices.join(heads, ["community", "slice"]).select("node", F.col("head").alias("community"))
        place = named.select("node", "label", "n", "community")
        between = inside.join(place.select(F.col("node").alias("a"), "label", "n", "community"), "a").join(place.select(F.col("node").alias("b"), F.col("label").alias("lb")), "b").where("label = lb")
        fine = leiden.split_groups(between.where(~large), named.where(~large))
        done = done.unionByName(fine).unionByName(cuts)
        raised = F.col("resolution") + F.lit(step) * F.when(F.col("n") == F.col("whole"), 2).otherwise(1)
        inside = cut(between.where(large).select(F.col("community").alias("parent"), "a", "b", "weight"))
        work = named.where(large & ~spent).select(F.col("community").alias("parent"), "node", raised.alias("resolution"))


#: Largest community, step and highest resolution of level 0 and of the levels above.
LEVELS = ((800, 0.2, 3.0), (500, 0.01, 1.5))


def hierarchy(edges: DataFrame, nodes: DataFrame, levels: tuple = LEVELS) -> DataFrame:
    """(level, community_id, member): level 0 holds the nodes, every further level the
    communities below it, contracted. It ends with one community or where the number of
    nodes no longer falls; a graph of one node is one community, an empty one has none."""
    edges = edges.where("a is not null and b is not null").select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), F.col("weight").cast("double").alias("weight"))
    nodes = cut(nodes.where("node is not null").select(F.col("node").cast("string").alias("node")).distinct())
    out = nodes.select(F.lit(0).alias("level"), F.col("node").alias("community_id"), F.col("node").alias("member")).limit(0)
    level, count = 0, nodes.count()
    while count:
        size, step, highest = levels[min(level, len(levels) - 1)]
        parts = partition(edges, nodes, size, step, highest) if count > 1 else nodes.select("node", F.col("node").alias("community"))
        # a community is named by its smallest node, whose own level is taken off the name
        root = F.regexp_replace("community", "^C_\\d+_", "") if level else F.col("community")
        parts = cut(parts.select("node", F.concat(F.lit(f"C_{level}_"), root).alias("community")))
        out = out.unionByName(parts.select(F.lit(level).alias("level"), F.col("community").alias("community_id"), F.col("node").alias("member")))
        heads = parts.select(F.col("community").alias("node")).distinct()
        fewer = heads.count()
        if fewer <= 1 or fewer >= count:
            break
        edges, nodes, level, count = cut(contract(edges, parts)), heads, level + 1, fewer
    return out


def summaries(hierarchy: DataFrame, nodes: DataFrame, edges: DataFrame, model=assist.models.rules) -> DataFrame:
    """(community_id, level, summary), bottom-up: level 0 reads its entities (node, type,
    description) and the edges (a, b, weight, relations) inside, a further level the
    summaries of its members. Communities are bounded, so are their inputs."""
    tree = cut(hierarchy)
    levels = tree.agg(F.max("level")).first()[0]  # one row
    keys = tree.where("level = 0").select("community_id", F.col("member").alias("node"))
    named = nodes.select(F.col("node").cast("string").alias("node"), F.concat_ws(" ", F.col("node").cast("string"), F.coalesce("type", F.lit(assist.UNKNOWN_TYPE)), F.coalesce("description", F.lit(""))).alias("line"))
    ties = induced(edges.select(F.col("a").cast("string").alias("a"), F.col("b").cast("string").alias("b"), "weight", "relations"), keys.withColumnRenamed("community_id", "community"), "relations")
    ties = ties.select(F.col("community").alias("community_id"), F.concat_ws(" ", "a", F.array_join("relations", ","), "b").alias("line"))
    lines = keys.join(named, "node", "left").select("community_id", F.lit(0).alias("o"), F.coalesce("line", "node").alias("line")).unionByName(ties.select("community_id", F.lit(1).alias("o"), "line"))
    out = None
    for level in range((levels if levels is not None else -1) + 1):
        if level:
            below = out.select(F.col("community_id").alias("member"), F.concat_ws(" ", "community_id", "summary").alias("line"))
            lines = tree.where(F.col("level") == level).join(below, "member", "left").select("community_id", F.lit(0).alias("o"), F.coalesce("line", F.concat_ws(" ", "member", F.lit(""))).alias("line"))
        content = lines.groupBy("community_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("o", "line"))), lambda s: s["line"]).alias("content"))
        made = cut(assist.summarize(content, model).withColumn("level", F.lit(level)))
        out = made if out is None else out.unionByName(made)
    if out is None:
        return tree.select("community_id", "level", F.lit("").alias("summary"))
    return out.select("community_id", "level", "summary")


def community_tables(hierarchy: DataFrame, summaries: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, level, summary) and vertical edges (src, relation, dst) to be written:
    entities belong to communities of level 0, those are sub-communities of the next."""
    nodes = summaries.select(F.col("community_id").alias("id"), "level", "summary")
    relation = F.when(F.col("level") == 0, "BELONGS_TO").otherwise("SUBCOMMUNITY_OF")
    return nodes, hierarchy.select(F.col("member").alias("src"), relation.alias("relation"), F.col("community_id").alias("dst"))
