"""The import graph: edges are (src, dst) rows, repeated ones kept; nodes are (id, ...).

Traversals are loops of joins over a frontier, each round written out (``keep``), so that
cyclic graphs end and lineage stays short. A graph of at most ``SMALL_GRAPH`` edges, counted
before, is walked on the driver instead, where a round costs no job; results are the same.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.sources.shared import shared_root

#: Edges up to which a graph may be walked on the driver.
SMALL_GRAPH = 100_000


def on_driver(edges: DataFrame) -> list[tuple] | None:
    """The edges with a target, if there are at most SMALL_GRAPH."""
    if SMALL_GRAPH <= 0:
        return None
    rows = edges.select("src", "dst").filter("dst IS NOT NULL").limit(SMALL_GRAPH + 1).collect()
    return None if len(rows) > SMALL_GRAPH else [tuple(r) for r in rows]


def neighbours(pairs: list[tuple]) -> dict:
    out: dict = {}
    for a, b in pairs:
        out.setdefault(a, []).append(b)
    return out


def walked(adjacent: dict, starts, depth: int | None = None) -> dict:
    """Least number of steps to each node that the starts reach, themselves at 0."""
    found, frontier = dict.fromkeys(starts, 0), list(starts)
    level = 0
    while frontier and (depth is None or level < depth):
        level += 1
        reached = {b for a in frontier for b in adjacent.get(a, ()) if b not in found}
        found |= dict.fromkeys(reached, level)
        frontier = list(reached)
    return found


def strong_components(adjacent: dict) -> list[list]:
    """Strongly connected components by path-based search, without recursion."""
    order: dict = {}
    done: set = set()
    open_, bounds, out = [], [], []
    for root in adjacent:
        if root in order:
            continue
        stack = [(root, iter(adjacent.get(root, ())))]
        order[root] = len(order)
        open_.append(root), bounds.append(root)
        while stack:
            node, rest = stack[-1]
            for nxt in rest:
                if nxt not in order:
                    order[nxt] = len(order)
                    open_.append(nxt), bounds.append(nxt)
                    stack.append((nxt, iter(adjacent.get(nxt, ()))))
                    break
                if nxt not in done:
                    while order[bounds[-1]] > order[nxt]:
                        bounds.pop()
            else:
                stack.pop()
                if bounds[-1] == node:
                    bounds.pop()
                    part = [open_.pop()]
                    while part[-1] != node:
                        part.append(open_.pop())
                    done.update(part)
                    out.append(part)
    return out


def keep(df: DataFrame) -> DataFrame:
    """df as a checkpoint in the shared folder."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_root(df.sparkSession))
    return df.checkpoint()


def direct(edges: DataFrame, node) -> DataFrame:
    """A node's edges in the order of their lines."""
    order = [c for c in ("line_number", "dst") if c in edges.columns]
    return edges.filter(F.col("src") == node).orderBy(*order)


def dependents(edges: DataFrame, node) -> DataFrame:
    return edges.filter(F.col("dst") == node).select(F.col("src").alias("id")).distinct().orderBy("id")


def transitive(edges: DataFrame, start, depth: int | None = None) -> DataFrame:
    """(id, depth): nodes reachable from ``start``, itself included at 0, with the least number of steps."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    if (few := on_driver(edges)) is not None:
        return spark.createDataFrame(list(walked(neighbours(few), [start], depth).items()), f"id {kind}, depth int")
    pairs = edges.select("src", "dst").filter("dst IS NOT NULL").distinct()
    found = spark.createDataFrame([(start, 0)], f"id {kind}, depth int")
    frontier, level = found, 0
    while depth is None or level < depth:
        level += 1
        step = frontier.join(pairs, frontier["id"] == pairs["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = keep(step.join(found, "id", "left_anti").withColumn("depth", F.lit(level)))
        if frontier.isEmpty():
            break
        found = keep(found.union(frontier))
    return found


def closure(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(id): ``starts`` and all that they reach; cycles end."""
    if (few := on_driver(edges)) is not None:
        # Only starts with an edge lead on; the others are in the answer as they are.
        adjacent = neighbours(few)
        sources = edges.sparkSession.createDataFrame([(a,) for a in adjacent], f"id {edges.schema['src'].dataType.simpleString()}")
        first = [r[0] for r in starts.select("id").join(sources, "id", "left_semi").distinct().collect()]
        reached = edges.sparkSession.createDataFrame([(x,) for x in walked(adjacent, first)], sources.schema)
        return starts.select("id").union(reached).distinct()
    pairs = edges.select("src", "dst").filter("dst IS NOT NULL").distinct()
    found = keep(starts.select("id").distinct())
    frontier = found
    while True:
        step = frontier.join(pairs, frontier["id"] == pairs["src"]).select(F.col("dst").alias("id")).distinct()
        frontier = keep(step.join(found, "id", "left_anti"))
        if frontier.isEmpty():
            return found
        found = keep(found.union(frontier))


def hotspots(edges: DataFrame, least: int = 2, limit: int | None = None, descending: bool = True) -> DataFrame:
    """(id, importers): edge rows for each target, so that repeated imports of one file count each time."""
    counted = edges.filter("dst IS NOT NULL").groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("importers")).filter(F.col("importers") >= least)
    rows = counted.orderBy(F.desc("importers") if descending else F.asc("importers"), "id")
    return rows if limit is None else rows.limit(limit)


def unused(nodes: DataFrame, edges: DataFrame, exports: DataFrame | None = None) -> DataFrame:
    """(id) of nodes that no edge reaches, directly or by re-exports of what an edge reaches."""
    used = edges.filter("dst IS NOT NULL").select(F.col("dst").alias("id")).distinct()
    if exports is not None:
        used = closure(exports, used)
    return nodes.select("id").join(used, "id", "left_anti").orderBy("id")


def labels(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, island): the least node of each connected component, edges taken both ways; single nodes are islands.

    Every node takes its least neighbour as parent and edges are contracted, round by round.
    """
    if (few := on_driver(edges)) is not None:
        kind = edges.schema["src"].dataType.simpleString()
        least: dict = {}
        both = neighbours(few + [(b, a) for a, b in few])
        for node in sorted(both):
            if node not in least:
                least |= dict.fromkeys(walked(both, [node]), node)
        known = edges.sparkSession.createDataFrame(list(least.items()), f"id {kind}, __least {kind}")
        return nodes.select("id").distinct().join(known, "id", "left").select("id", F.coalesce("__least", "id").alias("island"))
    pairs = edges.filter("dst IS NOT NULL AND src <> dst").select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    out = nodes.select("id", F.col("id").alias("island")).distinct()
    pairs = keep(pairs)
    while not pairs.isEmpty():
        both = pairs.union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = keep(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("v"), F.least("a", "m").alias("up")))
        out = keep(out.join(up, out["island"] == up["v"], "left").select("id", F.coalesce("up", "island").alias("island")))
        left, right = up.select(F.col("v").alias("a"), F.col("up").alias("ua")), up.select(F.col("v").alias("b"), F.col("up").alias("ub"))
        pairs = keep(pairs.join(left, "a").join(right, "b").filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct())
    return out


def islands(nodes: DataFrame, edges: DataFrame, least: int = 1, most: int | None = None) -> DataFrame:
    """(island, size), the largest first."""
    sizes = labels(nodes, edges).groupBy("island").agg(F.count("*").alias("size")).filter(F.col("size") >= least)
    if most is not None:
        sizes = sizes.filter(F.col("size") <= most)
    return sizes.orderBy(F.desc("size"), "island")


def default_most(n_files: int) -> int:
    """The largest island shown by default: half of the files, 500 at most."""
    return min(500, n_files // 2)


def cyclic(edges: DataFrame) -> DataFrame:
    """(id, component): the nodes on some cycle, named by the least node of their strongly connected component.

    Nodes without incoming or without outgoing edges are stripped first; the rest is
    coloured by the least node that reaches it and split by reaching back, until all
    nodes are told apart.
    """
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    if (few := on_driver(edges)) is not None:
        loop = {a for a, b in few if a == b}
        rows = [(x, min(part)) for part in strong_components(neighbours(few)) if len(part) > 1 or part[0] in loop for x in part]
        return spark.createDataFrame(rows, f"id {kind}, component {kind}")
    loops = edges.filter("src = dst").select(F.col("src").alias("id")).distinct()
    live = keep(edges.filter("dst IS NOT NULL AND src <> dst").select("src", "dst").distinct())
    done = spark.createDataFrame([], f"id {kind}, component {kind}")
    while True:
        before = -1
        while (n := live.count()) != before:
            before = n
            ins, outs = live.select(F.col("dst").alias("src")).distinct(), live.select(F.col("src").alias("dst")).distinct()
            live = keep(live.join(ins, "src", "left_semi").join(outs, "dst", "left_semi").select("src", "dst"))
        if not before:
            break
        color = keep(live.select(F.col("src").alias("id")).distinct().withColumn("color", F.col("id")))
        while True:
            sent = live.join(color, live["src"] == color["id"]).groupBy(F.col("dst").alias("id")).agg(F.min("color").alias("got"))
            after = keep(color.join(sent, "id", "left").select("id", F.least("color", F.coalesce("got", "color")).alias("new"), "color"))
            changed = not after.filter("new <> color").isEmpty()
            color = after.select("id", F.col("new").alias("color"))
            if not changed:
                break
        # Within a colour, what reaches the colour's own node is one component with it.
        same = live.join(color.select(F.col("id").alias("src"), F.col("color").alias("cs")), "src").join(color.select(F.col("id").alias("dst"), F.col("color").alias("cd")), "dst").filter("cs = cd")
        back = keep(same.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
        members = closure(back, color.filter("id = color").select("id"))
        found = keep(color.join(members, "id").select("id", F.col("color").alias("component")))
        done = keep(done.union(found))
        live = keep(live.join(found.select(F.col("id").alias("src")), "src", "left_anti").join(found.select(F.col("id").alias("dst")), "dst", "left_anti").select("src", "dst"))
    sizes = done.groupBy("component").count().filter("count > 1").select("component")
    whole = done.join(sizes, "component", "left_semi").select("id", "component")
    return whole.union(loops.join(whole, "id", "left_anti").select("id", F.col("id").alias("component")))


def back_edges(adjacent: dict, order: list) -> Iterator[list]:
    """Cycles that a depth-first search meets: from each edge to a node on the path, the path's part from that node."""
    seen: set = set()
    for root in order:
        if root in seen:
            continue
        path, on_path, stack = [root], {root}, [iter(adjacent.get(root, ()))]
        seen.add(root)
        while stack:
            for nxt in stack[-1]:
                if nxt in on_path:
                    yield path[path.index(nxt) :]
                elif nxt not in seen:
                    seen.add(nxt)
                    path.append(nxt)
                    on_path.add(nxt)
                    stack.append(iter(adjacent.get(nxt, ())))
                    break
            else:
                stack.pop()
                on_path.discard(path.pop())


def cycles(edges: DataFrame) -> DataFrame:
    """(cycle_no, length, nodes): the cycles that a depth-first search in order of node and edge reports.

    Only strongly connected components hold cycles, so each is one group, searched by itself;
    repeated edges report their cycle again.
    """
    kind = edges.schema["src"].dataType.simpleString()
    on = cyclic(edges)
    inner = (
        edges.join(on.select(F.col("id").alias("src"), "component"), "src")
        .join(on.select(F.col("id").alias("dst"), F.col("component").alias("c2")), "dst").filter("component = c2").select("component", "src", "dst")
    )

    def search(key, rows):
        adjacent: dict = {}
        for a, b in sorted(zip(rows.column("src").to_pylist(), rows.column("dst").to_pylist())):
            adjacent.setdefault(a, []).append(b)
        found = list(back_edges(adjacent, sorted(adjacent)))
        return pa.table([pa.array([key[0].as_py()] * len(found), rows.schema.field("component").type), pa.array([len(x) for x in found], pa.int32()), pa.array(found, pa.list_(rows.schema.field("src").type))], ["component", "length", "nodes"])

    return inner.groupBy("component").applyInArrow(search, f"component {kind}, length int, nodes array<{kind}>")


def internal_edges(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(source, imported_path, target, resolved) of the internal imports; target is null where unresolved."""
    source = files.select(F.col("file_id"), F.col("path").alias("source"))
    target = files.select(F.col("file_id").alias("resolved_file_id"), F.col("path").alias("target"))
    return (
        dependencies.filter("import_type = 'internal'").join(source, "file_id").join(target, "resolved_file_id", "left")
        .select("source", "imported_path", "target", F.col("target").isNotNull().alias("resolved"))
    )


def dependency_info(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """Dependencies whose imported_path is the target's path where resolved."""
    target = files.select(F.col("file_id").alias("resolved_file_id"), F.col("path").alias("__target"))
    return dependencies.join(target, "resolved_file_id", "left").withColumn("imported_path", F.coalesce("__target", "imported_path")).drop("__target")


# Path suffix to the name under which resolution is counted.
SUFFIX_LANGUAGES = (
    ("Python", (".py",)), ("Go", (".go",)), ("TypeScript", (".ts",)), ("Rust", (".rs",)), ("JavaScript", (".js", ".jsx")), ("PHP", (".php",)),
    ("Java", (".java",)), ("Kotlin", (".kt",)), ("Ruby", (".rb",)), ("C", (".c", ".h")), ("C++", (".cpp", ".cc", ".hpp")), ("C#", (".cs",)), ("Zig", (".zig",)),
)


def suffix_language(path: Column) -> Column:
    lower, out = F.lower(path), None
    for name, ends in SUFFIX_LANGUAGES:
        hit = F.lit(False)
        for e in ends:
            hit = hit | lower.endswith(e)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return out.otherwise("Other")


def resolution_stats(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(language, total, resolved, rate in percent) of the internal imports."""
    rows = dependencies.filter("import_type = 'internal'").join(files.select("file_id", "path"), "file_id")
    out = rows.groupBy(suffix_language(F.col("path")).alias("language")).agg(F.count("*").alias("total"), F.sum(F.col("resolved_file_id").isNotNull().cast("long")).alias("resolved"))
    return out.withColumn("rate", F.col("resolved") / F.col("total") * 100).orderBy("language")


def counts_by_type(dependencies: DataFrame) -> DataFrame:
    return dependencies.groupBy("import_type").agg(F.count("*").alias("n"))


def summary(nodes: DataFrame, edges: DataFrame, exports: DataFrame | None = None, least: int = 2) -> dict[str, int]:
    """Counts of cycles, hotspots, unused nodes and islands of two or more."""
    return {
        "cycles": cycles(edges).count(), "hotspots": hotspots(edges, least).count(),
        "unused": unused(nodes, edges, exports).count(), "islands": islands(nodes, edges, 2).count(),
    }


def replaced(dependencies: DataFrame, fresh: DataFrame) -> DataFrame:
    """The edge table with the rows of all files in ``fresh`` put in place of their old ones."""
    return dependencies.join(fresh.select("file_id").distinct(), "file_id", "left_anti").unionByName(fresh)
