"""Property graphs of issues and of blocks: nodes, edges, neighbours, expansion, paths, statistics, export."""

from __future__ import annotations

from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loregraph.functions import text as tx
from loregraph.operators.store import settled

#: Issues of a label that are paired within one cell; a label of more is dealt to several blocks.
LABEL_BLOCK = 1024


#: What an issue refers to: kind of the node, column, relation.
REFERS = (("assignee", "assignee", "assigned_to"), ("status", "status", "has_status"), ("type", "issue_type", "has_type"), ("day", "event_day", "updated_on"))


def _referred(row: Column | None = None) -> Column:
    """An array of (node_id, node_type, label, relation): what one issue refers to, without nulls; of ``row``, or of the columns."""
    col = F.col if row is None else lambda c: row[c]

    def one(kind: str, value: Column, relation: str) -> Column:
        return F.struct(F.concat(F.lit(f"{kind}:"), F.lower(value)).alias("node_id"), F.lit(kind).alias("node_type"), value.alias("label"), F.lit(relation).alias("relation"))

    labels = F.transform(F.coalesce(col("labels"), F.array().cast("array<string>")), lambda x: one("label", x, "has_label"))
    return F.filter(F.concat(F.array(*[one(kind, col(c), relation) for kind, c, relation in REFERS]), labels), lambda x: x["node_id"].isNotNull())


def issue_nodes(issues: DataFrame) -> DataFrame:
    """node_id, node_type, label; of several spellings of a label the one of the last issue by ``seen`` stays."""
    last = F.struct("seen", "label")
    own = issues.select(F.concat(F.lit("issue:"), F.col("key")).alias("node_id"), F.col("summary").alias("label"), "seen")
    own = own.groupBy("node_id").agg(F.max_by("label", last).alias("label")).select("node_id", F.lit("issue").alias("node_type"), "label")
    # spellings are few beside the issues, and a number by spelling needs no sort
    rows = issues.select("seen", F.inline(_referred())).groupBy("node_id", "node_type", "label").agg(F.max("seen").alias("seen"))
    return own.unionByName(rows.groupBy("node_id").agg(F.max_by(F.struct("node_type", "label"), last).alias("x")).select("node_id", "x.*"))


def issue_edges(issues: DataFrame) -> DataFrame:
    """src_id, dst_id, relation, weight of an issue's own data; each edge once, and no two with the same ends: a node's kind tells the relation."""
    # an issue is shuffled in one row, its edges never
    rows = issues.groupBy(F.concat(F.lit("issue:"), F.col("key")).alias("src_id")).agg(F.collect_list(F.struct(*[c for _, c, _ in REFERS], "labels")).alias("rows"))
    ends = F.transform(F.flatten(F.transform("rows", _referred)), lambda x: F.struct(x["node_id"].alias("dst_id"), x["relation"].alias("relation")))
    return rows.select("src_id", F.inline(F.array_distinct(ends)), F.lit(1.0).alias("weight"))


def label_rows(issues: DataFrame) -> DataFrame:
    """(key, label): the labels of each issue, lower-cased and trimmed, each once."""
    rows = issues.select("key", F.explode("labels").alias("label"))
    return rows.select("key", F.trim(F.lower("label")).alias("label")).where("label != ''").distinct()


def label_sets(issues: DataFrame) -> DataFrame:
    """(key, labels): the labels of each issue in one row, lower-cased and trimmed, each once, in order."""
    own = F.filter(F.transform(F.coalesce("labels", F.array().cast("array<string>")), lambda x: F.trim(F.lower(x))), lambda x: x != "")
    return issues.groupBy("key").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list(own)))).alias("labels"))


def label_cells(rows: DataFrame, block: int = LABEL_BLOCK) -> DataFrame:
    """(label, l, r, side, key and further columns): ``rows`` (key, label, ...) dealt to cells, so that every two issues of a label meet in one cell.

    The issues of a label are dealt to blocks of about ``block`` by a hash of their key, and each pair of
    blocks is a cell. A row stands once in the cell of its block with itself, on one side (0) of the cells with later blocks,
    and on the other (1) of those with earlier ones.
    """
    # labels that need several blocks are fewer than the rows by the size of a block, so they go to every task; two labels of one hash only get more blocks
    counts = rows.groupBy(F.xxhash64("label").alias("code")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > block)
    counts = F.broadcast(counts.select("code", F.ceil(F.col("n") / block).cast("int").alias("blocks")))
    placed = rows.withColumn("code", F.xxhash64("label")).join(counts, "code", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int"))
    cell = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: F.struct(F.least(o, "own").alias("l"), F.greatest(o, "own").alias("r"), (o < F.col("own")).cast("int").alias("side")))
    return placed.select("label", F.inline(cell), *[c for c in rows.columns if c != "label"])


def related_label_edges(issues: DataFrame, max_label_degree: int | None = None, block: int = LABEL_BLOCK) -> DataFrame:
    """Edges both ways between issues that share labels; the weight is how many.

    The definition pairs all issues of a label, so the edges of a label grow with the square of its
    issues, whoever makes them; no task has to make all of them, since a label's issues
    are dealt to blocks and pairs of blocks are joined apart (``label_cells``). The codes (64-bit hashes) of an issue's labels go with
    each of its rows, so that two issues become an edge at the first label that both have, and pairs are not shuffled. ``max_label_degree``
    leaves out labels of more issues than that, where a caller wants to bound the result itself.
    """
    sets = label_sets(issues)
    if max_label_degree:
        rows = sets.select("key", F.explode("labels").alias("label"))
        small = rows.groupBy("label").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= max_label_degree).select("label")
        sets = rows.join(small, "label", "left_semi").groupBy("key").agg(F.array_sort(F.collect_list("label")).alias("labels"))
    rows = sets.select("key", F.transform("labels", lambda x: F.xxhash64(x)).alias("codes"), F.explode("labels").alias("label"))
    cells = label_cells(rows, block)
    # two issues whose other labels have no bit in common share this label alone; the codes of others are held against each other
    own, none = F.xxhash64("label"), F.lit(0).cast("long")
    bits = F.reduce("codes", none, lambda m, x: m.bitwiseOR(F.when(x == own, none).otherwise(F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(x, F.lit(64)).cast("int")))))
    # both sides are the same rows in the same columns, so that they are shuffled once
    left, right = (cells.select("label", "l", "r", *[F.col(c).alias(f"{c}_{end}") for c in ("side", "key", "codes")], bits.alias(f"bits_{end}")) for end in "ab")
    pairs = left.join(right, ["label", "l", "r"]).where("key_a != key_b AND (l = r OR side_a != side_b)")
    alone, common = F.col("bits_a").bitwiseAND(F.col("bits_b")) == 0, F.array_intersect("codes_a", "codes_b")
    pairs = pairs.where(alone | (F.array_min(common) == F.xxhash64("label")))
    return pairs.select(
        F.concat(F.lit("issue:"), "key_a").alias("src_id"), F.concat(F.lit("issue:"), "key_b").alias("dst_id"), F.lit("related_label").alias("relation"),
        F.when(alone, 1).otherwise(F.size(common)).cast("double").alias("weight"),
    )


def related_to(issues: DataFrame, seeds: DataFrame) -> DataFrame:
    """The related_label edges that go out from the seeds (key): each seed meets the issues of its labels, other pairs are not made.

    Seeds are few, such as the hits of a search: their labels go to every task.
    """
    few = F.broadcast(seeds.select("key").distinct())
    own = label_rows(issues.join(few, "key", "left_semi")).withColumnRenamed("key", "seed")
    pairs = label_rows(issues).join(F.broadcast(own), "label").where("seed != key").groupBy("seed", "key").agg(F.count(F.lit(1)).cast("double").alias("weight"))
    return pairs.select(F.concat(F.lit("issue:"), "seed").alias("src_id"), F.concat(F.lit("issue:"), "key").alias("dst_id"), F.lit("related_label").alias("relation"), "weight")


def neighbors(edges: DataFrame, nodes: DataFrame, node_id: str, relations: list[str] | None = None, limit: int | None = 25) -> DataFrame:
    """Outgoing neighbours that are nodes: node_id, node_type, relation, weight; heaviest first."""
    rows = edges.where(F.col("src_id") == node_id)
    if relations:
        rows = rows.where(F.col("relation").isin(*relations))
    rows = rows.join(nodes, rows.dst_id == nodes.node_id).select("node_id", "node_type", "relation", "weight")
    return rows.orderBy(F.desc("weight"), "node_id", "relation").limit(limit) if limit else rows


def block_neighbors(edges: DataFrame, block_id: str, relations: list[str] | None = None, limit: int | None = 25) -> DataFrame:
    """Outgoing neighbours of a block, also those without a node."""
    rows = edges.where(F.col("src_id") == block_id)
    if relations:
        rows = rows.where(F.col("relation").isin(*relations))
    rows = rows.select(F.col("dst_id").alias("node_id"), F.lit("block").alias("node_type"), "relation", "weight")
    return rows.orderBy(F.desc("weight"), "node_id", "relation").limit(limit) if limit else rows


def expand(edges: DataFrame, seeds: DataFrame, relations: list[str], per_seed: int = 5) -> DataFrame:
    """node_id, rank: the heaviest neighbours of each seed (node_id, rank), first seed first, each once and no seed."""
    # seeds are few, and an edge table dealt by them would go to as few tasks
    rows = edges.where(F.col("relation").isin(*relations)).join(F.broadcast(seeds.select(F.col("node_id").alias("src_id"), "rank")), "src_id")
    order = W.partitionBy("src_id").orderBy(F.desc("weight"), "dst_id")
    rows = rows.withColumn("r", F.row_number().over(order)).where(F.col("r") <= per_seed)
    rows = rows.join(F.broadcast(seeds.select(F.col("node_id").alias("dst_id"))), "dst_id", "left_anti")
    return rows.groupBy(F.col("dst_id").alias("node_id")).agg(F.min(F.struct("rank", "r")).alias("first")).select("node_id", "first.rank", "first.r")


def block_graph(blocks: DataFrame, relations: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges): a node per block, an edge from each child to its parent, and the stored relations."""
    nodes = blocks.select(F.col("block_id").alias("node_id"), F.col("block_type").alias("node_type"), F.substring("content", 1, 120).alias("label"))
    edges = blocks.where("parent_id IS NOT NULL").select(
        F.col("block_id").alias("src_id"), F.col("parent_id").alias("dst_id"), F.lit("parent_of").alias("relation"), F.lit(1.0).alias("weight")
    )
    if relations is not None:
        edges = edges.unionByName(relations.select("src_id", "dst_id", "relation", "weight"))
    return nodes, edges.dropDuplicates(["src_id", "dst_id", "relation"])


def source_subgraph(blocks: DataFrame, relations: DataFrame, source_id: str, limit: int | None = 400) -> tuple[DataFrame, DataFrame]:
    """Nodes of a source and the edges with both ends among them."""
    own = blocks.where(F.col("source_id") == source_id)
    if limit:
        own = own.orderBy("order_index", "block_id").limit(limit)
    nodes, edges = block_graph(own, relations)
    ids = nodes.select("node_id")
    edges = edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    return nodes, edges


def filtered(nodes: DataFrame, edges: DataFrame, text: str = "", types: list[str] | None = None, relations: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes that match a text and their neighbours, of the given types, and the edges of the given relations among them."""
    if text:
        hit = nodes.where(F.lower("label").contains(text.lower()) | F.lower("node_id").contains(text.lower())).select("node_id")
        near = edges.join(hit.withColumnRenamed("node_id", "src_id"), "src_id").select(F.col("dst_id").alias("node_id"))
        back = edges.join(hit.withColumnRenamed("node_id", "dst_id"), "dst_id").select(F.col("src_id").alias("node_id"))
        nodes = nodes.join(hit.union(near).union(back).distinct(), "node_id", "left_semi")
    if types:
        nodes = nodes.where(F.col("node_type").isin(*types))
    if relations:
        edges = edges.where(F.col("relation").isin(*relations))
    ids = nodes.select("node_id")
    edges = edges.join(ids.withColumnRenamed("node_id", "src_id"), "src_id", "left_semi").join(ids.withColumnRenamed("node_id", "dst_id"), "dst_id", "left_semi")
    return nodes, edges


def distances(edges: DataFrame, source: str, max_hops: int | None = None) -> DataFrame:
    """node_id, hops: nodes that ``source`` reaches over directed edges, and how far they are; all, or within ``max_hops``.

    One join per hop, whose result is written; a node enters the frontier once.
    """
    spark = edges.sparkSession
    steps = settled(edges.select("src_id", "dst_id").distinct())
    seen = spark.createDataFrame([(source, 0)], "node_id string, hops int")
    frontier = seen
    for hop in count(1) if max_hops is None else range(1, max_hops + 1):
        near = frontier.select(F.col("node_id").alias("src_id")).join(steps, "src_id").select(F.col("dst_id").alias("node_id")).distinct()
        frontier = settled(near.join(seen, "node_id", "left_anti").select("node_id", F.lit(hop).alias("hops")))
        if not frontier.take(1):
            break
        seen = settled(seen.unionByName(frontier))
    return seen


def shortest_path(edges: DataFrame, source: str, target: str, max_hops: int | None = None) -> list[str]:
    """Nodes of one shortest directed path, the least ids where there are several; empty if there is none (within ``max_hops``)."""
    far = distances(edges, source, max_hops)
    end = far.where(F.col("node_id") == target).first()
    if end is None:
        return []
    path = [target]
    for hop in range(end["hops"] - 1, -1, -1):
        before = edges.where(F.col("dst_id") == path[-1]).select(F.col("src_id").alias("node_id")).join(far.where(F.col("hops") == hop), "node_id")
        path.append(before.agg(F.min("node_id")).first()[0])
    return path[::-1]


def incident(edges: DataFrame, node_id: str) -> DataFrame:
    return edges.where((F.col("src_id") == node_id) | (F.col("dst_id") == node_id))


def _simple(edges: DataFrame, simple: bool) -> DataFrame:
    return edges.select("src_id", "dst_id") if simple else edges.select("src_id", "dst_id").distinct()


def degrees(edges: DataFrame, simple: bool = False) -> DataFrame:
    """node_id, degree (in and out; an edge between two nodes counts once whatever its relation), size from 4 to 22.

    ``simple`` says that no two edges have the same ends, as those of ``issue_edges`` never have; else they are told apart first.
    """
    ends = _simple(edges, simple).select(F.explode(F.array("src_id", "dst_id")).alias("node_id")).groupBy("node_id").agg(F.count(F.lit(1)).alias("degree"))
    return ends.withColumn("size", F.greatest(F.lit(4), F.least(F.lit(22), F.col("degree") + 3)).cast("long"))


def statistics(nodes: DataFrame, edges: DataFrame, simple: bool = False) -> DataFrame:
    """One row: nodes, edges (parallel ones count once; ``simple`` as for ``degrees``), density."""
    n = nodes.agg(F.count(F.lit(1)).alias("nodes"))
    m = _simple(edges, simple).agg(F.count(F.lit(1)).alias("edges"))
    density = F.when(F.col("nodes") > 1, F.col("edges") / (F.col("nodes") * (F.col("nodes") - 1))).otherwise(F.lit(0.0))
    return n.crossJoin(m).withColumn("density", density)  # one row each


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def cypher(nodes: DataFrame, edges: DataFrame, limit_nodes: int | None = 200, limit_edges: int | None = 600) -> DataFrame:
    """(part, ord..., line): MERGE lines of nodes, then of edges."""
    n = nodes.orderBy("node_id").limit(limit_nodes) if limit_nodes else nodes
    e = edges.orderBy("relation", "src_id", "dst_id").limit(limit_edges) if limit_edges else edges

    def quoted(c: str) -> Column:
        return F.replace(F.col(c), F.lit("'"), F.lit("\\'"))

    name = tx.cypher_name
    node_line = F.concat(
        F.lit("MERGE ("), name(F.col("node_id")), F.lit(":"), F.initcap("node_type"), F.lit(" {id: '"), quoted("node_id"), F.lit("'}) SET "),
        name(F.col("node_id")), F.lit(".name = '"), quoted("label"), F.lit("';"),
    )
    edge_line = F.concat(
        F.lit("MATCH ("), name(F.col("src_id")), F.lit(" {id: '"), F.col("src_id"), F.lit("'}), ("), name(F.col("dst_id")), F.lit(" {id: '"), F.col("dst_id"),
        F.lit("'}) MERGE ("), name(F.col("src_id")), F.lit(")-[:"), F.replace(F.upper("relation"), F.lit("-"), F.lit("_")), F.lit(" {weight: "),
        F.format_string("%.1f", F.col("weight")), F.lit("}]->("), name(F.col("dst_id")), F.lit(");"),
    )
    return n.select(F.lit(1).alias("part"), F.col("node_id").alias("sort_key"), node_line.alias("line")).unionByName(
        e.select(F.lit(2).alias("part"), F.concat_ws("|", "relation", "src_id", "dst_id").alias("sort_key"), edge_line.alias("line"))
    )


def children(blocks: DataFrame, parent_id: str) -> DataFrame:
    return blocks.where(F.col("parent_id") == parent_id).orderBy("order_index", "block_id")


def relations_of(relations: DataFrame, block_ids: list[str], both_ends: bool = False) -> DataFrame:
    found = F.col("src_id").isin(*block_ids)
    return relations.where(found | F.col("dst_id").isin(*block_ids) if both_ends else found)
