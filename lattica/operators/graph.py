"""Graphs around a centre, grown level by level with joins.

A level joins the frontier with the edge table, groups the edges, and takes new nodes in the order frontier, line, name until the
cap is reached. What a level finds is a small table in the shared folder; only counts reach the driver, and a frontier has at most
as many rows as the cap.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.functions import exprs as X
from lattica.sources.shared import keep

MAX_NODES, GROUP_THRESHOLD = 150, 24
EXTERNAL = "(external)"


@dataclass
class Graph:
    """nodes (id, depth, label, kind, dir, external), edges (source, target, count); truncated: the cap was met."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


@dataclass(frozen=True)
class Folders:
    """Direct neighbours of the centre, if a side has more than `threshold` of them, stand as one node a folder; folders whose node
    id is in `opened` give their members. root: what folder names are cut by."""

    threshold: int = GROUP_THRESHOLD
    opened: tuple[str, ...] = ()
    root: str = ""


def _level(frontier: DataFrame, edges: DataFrame, outward: bool) -> DataFrame:
    """Edges of the frontier (id, rank): (source, target, to, count, line, rank). A node that calls itself counts once as its caller."""
    near, far = ("src", "dst") if outward else ("dst", "src")
    j = edges.join(F.broadcast(frontier), edges[near] == frontier["id"])
    g = j.groupBy("id", "rank", F.col(far).alias("to")).agg(F.sum("count").alias("count"), F.min("line").alias("line"))
    source, target = ("id", "to") if outward else ("to", "id")
    count = F.col("count") if outward else F.when(F.col("to") == F.col("id"), F.lit(1).cast("long")).otherwise(F.col("count"))
    return g.select(F.col(source).alias("source"), F.col(target).alias("target"), "to", count.alias("count"), "line", "rank")


def _fold(step: DataFrame, nodes: DataFrame, centre: str, outward: bool, folders: Folders) -> DataFrame:
    """step with the members of folders that are not opened as one row a folder, if there are more rows than the threshold."""
    if step.count() <= folders.threshold:
        return step
    side = f"grp:{'callees' if outward else 'callers'}:{centre}:"
    place = F.coalesce(X.dir_of(F.concat("dir", F.lit("/x")), folders.root), F.lit(EXTERNAL))
    at = step.join(nodes.select(F.col("id").alias("to"), "dir"), "to", "left").withColumn("gid", F.concat(F.lit(side), place))
    shut = ~F.col("gid").isin(*folders.opened)
    parts = at.where(shut).groupBy("gid").agg(F.sum("count").alias("count"), F.min("line").alias("line"), F.min("rank").alias("rank"), F.count("*").alias("members"))
    source, target = (F.lit(centre), F.col("gid")) if outward else (F.col("gid"), F.lit(centre))
    groups = parts.select(source.alias("source"), target.alias("target"), F.col("gid").alias("to"), "count", "line", "rank", "members")
    return at.where(~shut).select(*step.columns).unionByName(groups, allowMissingColumns=True)


def build(edges: DataFrame, nodes: DataFrame, centre: str, mode: str = "callees", depth: int = 1, max_nodes: int = MAX_NODES, through: tuple[str, ...] = ("function", "method"), first_callers: DataFrame | None = None, folders: Folders | None = None, total: str = "sum") -> Graph:
    """Callees, callers or both of centre, down to depth; edges (src, dst, count, line), nodes (id, label, kind, dir).

    The first discovery fixes a node's depth, positive for callees and negative for callers; callees are gone through if they are
    new and of the kinds in `through`, callers if they were no callers yet, also when they are among the callees. Targets without a
    node are external leaves. An edge found from both sides has its counts summed (total='max': counted once). first_callers: edges
    that lead to the centre in place of its calls, such as references of something that cannot be called.
    """
    spark = edges.sparkSession
    seen = spark.createDataFrame([(centre, 0)], "id string, depth int")
    found, names, count, truncated = [], [], 1, max_nodes <= 1
    for outward in [True, False] if mode == "both" else [mode == "callees"]:
        frontier, callers = spark.createDataFrame([(centre, 0)], "id string, rank int"), spark.createDataFrame([(centre,)], "id string")
        for level in range(1, depth + 1):
            step = keep(_level(frontier, first_callers if first_callers is not None and not outward and level == 1 else edges, outward), "level")
            if folders and level == 1:
                step = _fold(step, nodes, centre, outward, folders)
                if "members" in step.columns:
                    step = keep(step, "level")
                    names.append(step.where("members is not null").select(F.col("to").alias("id"), F.col("members")))
            first = step.join(F.broadcast(seen), step["to"] == seen["id"], "left_anti").groupBy("to").agg(F.min(F.struct("rank", "line", "to")).alias("o"))
            top = keep(first.orderBy("o").limit(max(0, max_nodes - count) + 1).select(F.col("to").alias("id"), "o"), "nodes")
            n = top.count()
            taken = top.orderBy("o").limit(max_nodes - count) if n > max_nodes - count else top
            n, truncated = min(n, max_nodes - count), truncated or n > max_nodes - count
            count += n
            truncated |= count >= max_nodes
            seen = seen.unionByName(taken.select("id", F.lit(level if outward else -level).alias("depth")))
            found.append(step.join(F.broadcast(seen.select(F.col("id").alias("to"))), "to", "left_semi").select("source", "target", "count"))
            if outward:
                fresh = taken
            else:
                met = step.join(F.broadcast(seen.select(F.col("id").alias("to"))), "to", "left_semi").groupBy(F.col("to").alias("id")).agg(F.min(F.struct("rank", "line", "to")).alias("o"))
                fresh = keep(met.join(F.broadcast(callers), "id", "left_anti"), "callers")
                callers = callers.unionByName(fresh.select("id"))
            order = F.row_number().over(Window.orderBy("o")).alias("rank")  # at most as many rows as the cap
            frontier = fresh.join(nodes.where(F.col("kind").isin(*through)).select("id"), "id", "left_semi").select("id", order)
            if level < depth and not fresh.limit(1).count():
                break
    return Graph(_described(seen, nodes, names), _totals(found, spark, total), truncated)


def _totals(found: list[DataFrame], spark, total: str = "sum") -> DataFrame:
    out = found[0] if found else spark.createDataFrame([], "source string, target string, count long")
    for f in found[1:]:
        out = out.unionByName(f)
    return out.groupBy("source", "target").agg((F.sum if total == "sum" else F.max)("count").alias("count"))


def _described(seen: DataFrame, nodes: DataFrame, groups: list[DataFrame]) -> DataFrame:
    """seen (id, depth) with label, kind and dir; what has no node is a group or external."""
    info = nodes.join(F.broadcast(seen), "id").drop("depth")
    full = F.broadcast(seen).join(info, "id", "left")
    members = F.lit(None).cast("long")
    if groups:
        every = groups[0]
        for g in groups[1:]:
            every = every.unionByName(g)
        full, members = full.join(F.broadcast(every), "id", "left"), F.col("members")
    group = F.regexp_extract("id", r"^grp:\w+:.*:([^:]*)$", 1)
    label = F.when(members.isNotNull(), F.concat(group, F.lit("/ ("), members.cast("string"), F.lit(")"))).otherwise(F.coalesce("label", F.regexp_replace("id", "^ext:", "")))
    kind = F.when(members.isNotNull(), "group").otherwise(F.coalesce("kind", F.lit("external")))
    return full.select("id", "depth", label.alias("label"), kind.alias("kind"), F.when(members.isNotNull(), group).otherwise(F.col("dir")).alias("dir"), (members.isNull() & (F.col("label").isNull() | F.col("id").startswith("ext:"))).alias("external"))


def expandable(graph: Graph, edges: DataFrame) -> DataFrame:
    """(id, callees, callers, folder): callees at the end of the graph that call something, callers at its end that are called, and
    folders. The centre never is."""
    shown = graph.nodes.select("id", "depth", "kind")
    out, in_ = graph.edges.select(F.col("source").alias("id")), graph.edges.select(F.col("target").alias("id"))
    down = shown.where("depth > 0 and kind in ('function', 'method')").join(out, "id", "left_anti").select("id")
    up = shown.where("depth < 0 and kind <> 'group'").join(in_, "id", "left_anti").select("id")
    more_out = edges.join(F.broadcast(down), F.col("src") == F.col("id"), "left_semi").select(F.col("src").alias("id")).distinct().withColumn("callees", F.lit(True))
    more_in = edges.join(F.broadcast(up), F.col("dst") == F.col("id"), "left_semi").select(F.col("dst").alias("id")).distinct().withColumn("callers", F.lit(True))
    return shown.select("id", (F.col("kind") == "group").alias("folder")).join(more_out, "id", "left").join(more_in, "id", "left").na.fill(False).select("id", "callees", "callers", "folder")


def expand(graph: Graph, edges: DataFrame, nodes: DataFrame, opened: dict[str, str], max_nodes: int = MAX_NODES) -> Graph:
    """The graph with the neighbours of opened nodes (id to 'callees' or 'callers') added one level below them, as far as the cap of all
    nodes allows; nodes that only another opened one brings are opened too. Counts of edges add up."""
    spark, left = edges.sparkSession, dict(opened)
    seen, shown, found, truncated = graph.nodes.select("id", "depth"), graph.edges, [], graph.truncated
    count = seen.count()
    while left and count < max_nodes:
        depths = {r.id: r.depth for r in seen.where(F.col("id").isin(*left)).collect()}  # at most the opened nodes
        now = [x for x in left if x in depths]
        if not now:
            break
        for x in now:
            outward = left.pop(x) == "callees"
            step = keep(_level(spark.createDataFrame([(x, 0)], "id string, rank int"), edges, outward), "level")
            fresh = step.join(F.broadcast(seen), step["to"] == seen["id"], "left_anti").select("line", "to").distinct()
            taken = keep(fresh.orderBy("line", "to").limit(max(0, max_nodes - count)).select(F.col("to").alias("id")), "nodes")
            n = taken.count()
            truncated, count = truncated or fresh.count() > n or count + n >= max_nodes, count + n
            level = abs(depths[x]) + 1
            seen = seen.unionByName(taken.withColumn("depth", F.lit(level if outward else -level)))
            found.append(step.join(F.broadcast(seen.select(F.col("id").alias("to"))), "to", "left_semi").select("source", "target", "count"))
            if count >= max_nodes:
                break
    return Graph(graph.nodes.unionByName(_described(seen.join(graph.nodes.select("id"), "id", "left_anti"), nodes, [])), _totals([shown, *found], spark), truncated)


def folded(graph: Graph, centre: str, root: str = "", threshold: int = GROUP_THRESHOLD, opened: tuple[str, ...] = ()) -> DataFrame:
    """Neighbours at depth 1 by directory: (side, dir, size, count, grouped); grouped where a side has more than threshold of them."""
    side = F.when(F.col("source") == centre, "callees").otherwise("callers")
    to = F.when(F.col("source") == centre, F.col("target")).otherwise(F.col("source"))
    e = graph.edges.where((F.col("source") == centre) | (F.col("target") == centre)).select(side.alias("side"), to.alias("id"), "count")
    n = e.join(graph.nodes.select("id", "dir"), "id").withColumn("dir", F.coalesce(X.dir_of(F.concat(F.col("dir"), F.lit("/x")), root), F.lit(EXTERNAL)))
    g = n.groupBy("side", "dir").agg(F.count("*").alias("size"), F.sum("count").alias("count"))
    many = g.groupBy("side").agg((F.sum("size") > threshold).alias("grouped"))
    return g.join(F.broadcast(many), "side").select("side", "dir", "size", "count", (F.col("grouped") & ~F.col("dir").isin(*opened)).alias("grouped"))


def class_edges(store) -> tuple[DataFrame, DataFrame]:
    """Edges from derived to base classes and their nodes; bases that nothing defines are external."""
    b = store._base_edges(store.bases)
    e = b.select(F.col("symbol_id").cast("string").alias("src"), F.coalesce(F.col("base_id").cast("string"), F.concat(F.lit("ext:"), "base")).alias("dst"), F.lit(1).cast("long").alias("count"), F.lit(0).alias("line"))
    n = store.symbols.select(F.col("id").cast("string").alias("id"), F.col("name").alias("label"), F.lit("class").alias("kind"), F.col("path").alias("dir"))
    return e, n


def include_edges(store) -> tuple[DataFrame, DataFrame]:
    """Edges between files by resolved includes; unresolved ones lead to external nodes, of kind 'system' if they stand in <>."""
    i = store.resolved_includes(store.includes.withColumnRenamed("path", "inc").withColumn("path", F.col("inc")))
    f = store.files.select(F.col("id").alias("file_id"), F.col("path").alias("own"))
    e = i.join(f, "file_id").select(F.concat(F.lit("file:"), "own").alias("src"), F.coalesce(F.concat(F.lit("file:"), "resolved"), F.concat(F.lit("ext:"), "path")).alias("dst"), F.lit(1).cast("long").alias("count"), "line")
    n = store.files.select(F.concat(F.lit("file:"), "path").alias("id"), X.base_name(F.col("path")).alias("label"), F.lit("file").alias("kind"), X.dir_of(F.col("path")).alias("dir"))
    lost = i.where("resolved is null").groupBy("path").agg(F.max("is_system").alias("system"))
    outside = lost.select(F.concat(F.lit("ext:"), "path").alias("id"), F.col("path").alias("label"), F.when(F.col("system"), "system").otherwise("external").alias("kind"), F.lit(None).cast("string").alias("dir"))
    return e, n.unionByName(outside)


def outline(graph: Graph, centre: str, depth: int) -> DataFrame:
    """Paths from the centre, no node twice on one: (path, level, node)."""
    spark = graph.edges.sparkSession
    now = spark.createDataFrame([(centre, [centre])], "node string, path array<string>")
    out = now.withColumn("level", F.lit(0))
    for level in range(1, depth + 1):
        now = now.join(graph.edges.select("source", "target"), F.col("node") == F.col("source")).where(~F.array_contains("path", F.col("target"))).select(F.col("target").alias("node"), F.concat("path", F.array("target")).alias("path"))
        out = out.unionByName(now.withColumn("level", F.lit(level)))
    return out
