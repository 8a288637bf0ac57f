"""Dependency cycles: strongly connected components by forward and backward colouring.

Each round trims nodes without incoming or outgoing edges, spreads the least node name forward as a colour until it settles, and takes, for each colour,
what reaches its root backward within the colour: that is one component. Its nodes go, and the next round works on the rest. All
steps are joins and aggregations on narrow rows, written to the shared folder between steps.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodeglass.schema import edge_label
from lodeglass.storage import discard, materialize


def cycle_edges(edges: DataFrame, edge_mode: str = "runtime", include_hierarchy: bool = False) -> DataFrame:
    """The edges that count: runtime ones or all, without those of the module hierarchy unless included."""
    if edge_mode not in ("runtime", "all"):
        raise ValueError(f"edge mode must be runtime or all, not {edge_mode!r}")
    out = edges if edge_mode == "all" else edges.where("is_runtime")
    return out if include_hierarchy else out.where("not is_hier")


def _trim(edges: DataFrame) -> DataFrame:
    """Without edges that lie on no cycle because an end has no further edge; repeated while it helps."""
    n = edges.count()
    while n:
        now = edges.join(edges.select(F.col("target").alias("source")).distinct(), "source", "left_semi").join(edges.select(F.col("source").alias("target")).distinct(), "target", "left_semi")
        now = materialize(now.select("source", "target"), "scc")
        left = now.count()
        if left == n:
            break
        edges, n = now, left
    return edges


def _settle(labels: DataFrame, edges: DataFrame, seeds_only: bool) -> DataFrame:
    """Spreads the least label along edges (source to target) until nothing changes. Labels (node, colour)."""
    now = None
    while True:
        sent = edges.join(labels, F.col("source") == F.col("node")).groupBy(F.col("target").alias("node")).agg(F.min("colour").alias("new"))
        joined = labels.join(sent, "node", "full" if seeds_only else "left")
        least = F.least(F.coalesce("colour", "new"), F.coalesce("new", "colour"))
        last, now = now, materialize(joined.select("node", least.alias("colour"), (F.col("colour").isNull() | (least < F.col("colour"))).alias("moved")), "scc")
        labels = now.select("node", "colour")
        if last is not None:
            discard(last)
        if now.where("moved").isEmpty():
            return labels


def strongly_connected(edges: DataFrame, node_filter: DataFrame | None = None) -> DataFrame:
    """(node, component) of the nodes on cycles: components of two or more nodes, and nodes with an edge to themselves. component is the
    least node. `node_filter` (node) restricts the graph before cycles are sought."""
    pairs = edges.select("source", "target").distinct()
    if node_filter is not None:
        keep = node_filter.select("node").distinct()
        pairs = pairs.join(keep.select(F.col("node").alias("source")), "source", "left_semi").join(keep.select(F.col("node").alias("target")), "target", "left_semi").select("source", "target")
    pairs = materialize(pairs, "scc")
    found = [pairs.where("source = target").select(F.col("source").alias("node"), F.col("source").alias("component"))]
    rest = _trim(pairs.where("source != target"))
    while not rest.isEmpty():
        nodes = rest.select(F.col("source").alias("node")).union(rest.select("target")).distinct()
        colours = _settle(nodes.select("node", F.col("node").alias("colour")), rest, False)
        same = rest.join(colours.select(F.col("node").alias("source"), F.col("colour").alias("a")), "source").join(colours.select(F.col("node").alias("target"), F.col("colour").alias("b")), "target")
        inner = materialize(same.where("a = b").select(F.col("target").alias("source"), F.col("source").alias("target")), "scc")  # turned round
        roots = colours.where("node = colour")
        reached = materialize(_settle(roots, inner, True), "scc")
        sizes = reached.groupBy("colour").agg(F.count("*").alias("n")).where("n > 1")
        found.append(materialize(reached.join(sizes, "colour", "left_semi").select("node", F.col("colour").alias("component")), "scc"))
        gone = reached.select("node")
        rest = rest.join(gone.select(F.col("node").alias("source")), "source", "left_anti").join(gone.select(F.col("node").alias("target")), "target", "left_anti").select("source", "target")
        rest = _trim(materialize(rest, "scc"))
    out = found[0]
    for f in found[1:]:
        out = out.union(f)
    return out.groupBy("node").agg(F.min("component").alias("component"))


def cycles(edges: DataFrame, edge_mode: str = "runtime", include_hierarchy: bool = False, node_filter: DataFrame | None = None, containing: str | None = None) -> DataFrame:
    """(node, component), for one file's component if `containing` names it."""
    out = strongly_connected(cycle_edges(edges, edge_mode, include_hierarchy), node_filter)
    if containing is not None:
        out = materialize(out, "scc")
        out = out.join(out.where(F.col("node") == containing).select("component"), "component", "left_semi").select("node", "component")
    return out


def explain_edges(components: DataFrame, edges: DataFrame, edge_mode: str = "runtime", include_hierarchy: bool = False) -> DataFrame:
    """component, source, target, kind of the edges inside components, ordered."""
    kept = cycle_edges(edges, edge_mode, include_hierarchy)
    a = components.select(F.col("node").alias("source"), "component")
    b = components.select(F.col("node").alias("target"), F.col("component").alias("other"))
    return kept.join(a, "source").join(b, "target").where("component = other").select("component", "source", "target", edge_label().alias("kind")).orderBy("component", "source", "target", "kind")
