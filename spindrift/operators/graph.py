"""Graphs as edge tables (a < b): components, bridges, assembly and balls of hops."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spindrift.errors import GraphIntegrityError
from spindrift.operators import geometry
from spindrift.tables import removed, settled


#: Edges up to which components and bridges are found on the driver, as arrays (some 100 bytes each); beyond, by joins.
LOCAL_EDGES = 5_000_000


def symmetric(edges: DataFrame) -> DataFrame:
    """src, dst: every edge both ways."""
    return edges.select(F.col("a").alias("src"), F.col("b").alias("dst")).union(edges.select(F.col("b").alias("src"), F.col("a").alias("dst")))


def neighbours(edges: DataFrame, node: int) -> DataFrame:
    return symmetric(edges).where(F.col("src") == node).select(F.col("dst").alias("node_id"))


def degrees(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, degree; 0 for nodes without edges."""
    counted = symmetric(edges).groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("degree"))
    return nodes.select("node_id").join(counted, "node_id", "left").na.fill(0, ["degree"])


def degree_summary(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return degrees(nodes, edges).agg(F.count("*").alias("nodes"), F.sum("degree").alias("ends"), F.avg("degree").alias("mean_degree"), F.max("degree").alias("max_degree"), F.count_if(F.col("degree") == 0).alias("isolated"))


def few(edges: DataFrame) -> bool:
    """Whether there are as few edges as the driver takes; no more than those are counted."""
    return edges.limit(LOCAL_EDGES + 1).count() <= LOCAL_EDGES


def arrays(df: DataFrame, *names: str) -> list[np.ndarray]:
    got = df.select(*names).toArrow()
    return [got[c].to_numpy() for c in names]


def least_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For nodes 0 to n - 1 the least node that edges (a, b) lead to."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        # Roots hang on to smaller roots, then every node looks up its root.
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label != label[label]).any():
            label = label[label]
    return label


def _placed(ids: np.ndarray, *ends: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Numbers of ends among sorted ids, and which edges have both ends there."""
    at = [np.searchsorted(ids, e).clip(max=max(len(ids) - 1, 0)) for e in ends]
    known = np.logical_and.reduce([ids[k] == e for k, e in zip(at, ends, strict=True)]) if len(ids) else np.zeros(len(ends[0]), bool)
    return [k[known] for k in at], known


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node_id, component: the least node that edges lead to."""
    if not few(edges):
        return components_by_joins(nodes, edges)
    ids = np.unique(arrays(nodes, "node_id")[0])
    (a, b), _ = _placed(ids, *arrays(edges, "a", "b"))
    label = ids[least_labels(len(ids), a, b)] if len(ids) else ids
    made = nodes.sparkSession.createDataFrame(pa.table({"node_id": pa.array(ids, pa.int64()), "component": pa.array(label, pa.int64())}))
    return settled(made, "components")


def components_by_joins(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The same for any number of edges: minimum labels with pointer jumping."""
    both = settled(symmetric(edges), "both")
    labels = held = settled(nodes.select("node_id", F.col("node_id").alias("component")), "labels")
    while True:
        near = both.join(labels.withColumnRenamed("node_id", "dst"), "dst").groupBy(F.col("src").alias("node_id")).agg(F.min("component").alias("near"))
        low = labels.join(near, "node_id", "left").select("node_id", "component", F.least("component", "near").alias("near"))
        jump = labels.select(F.col("node_id").alias("near"), F.col("component").alias("far"))
        new = settled(low.join(jump, "near").select("node_id", F.least("near", "far").alias("next"), (F.least("near", "far") < F.col("component")).alias("moved")), "labels")
        removed(held)
        held, labels = new, new.select("node_id", F.col("next").alias("component"))
        if new.where("moved").isEmpty():
            removed(both)
            return labels


def bridges(nodes: DataFrame, kept: DataFrame, candidates: DataFrame) -> DataFrame:
    """Of candidates (a, b, metres), those of the minimum spanning forest over the components of kept.

    Each round every component takes its shortest way out (by metres, a, b); with that order of ties, the
    result is the one of adding the shortest edges first.
    """
    of = components(nodes, kept.select("a", "b"))
    side = lambda k: of.select(F.col("node_id").alias(k), F.col("component").alias(f"c{k}"))
    ways = settled(candidates.join(side("a"), "a").join(side("b"), "b").where("ca <> cb").select("a", "b", "metres", "ca", "cb"), "ways")
    if not few(ways):
        return bridges_by_joins(ways)
    a, b, metres, ca, cb = arrays(ways, "a", "b", "metres", "ca", "cb")
    order = np.lexsort((b, a, metres))
    a, b, metres, ca, cb = (x[order] for x in (a, b, metres, ca, cb))
    taken = shortest_ways(ca, cb)
    made = pa.table({"a": pa.array(a[taken], pa.int64()), "b": pa.array(b[taken], pa.int64()), "metres": pa.array(metres[taken], pa.float64())})
    return settled(nodes.sparkSession.createDataFrame(made), "taken")


def shortest_ways(ca: np.ndarray, cb: np.ndarray) -> np.ndarray:
    """Which edges between components ca and cb, the shortest first, the spanning forest takes."""
    ids, ends = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    x, y = ends[: len(ca)], ends[len(ca) :]
    left, taken = np.arange(len(ca)), []
    label = np.arange(len(ids))
    while True:
        apart = label[x[left]] != label[y[left]]
        left = left[apart]
        if not len(left):
            return np.sort(np.concatenate(taken)) if taken else left
        best = np.full(len(ids), -1)
        back = left[::-1]  # of repeated places the last one written stays: the shortest
        for end in (label[y[back]], label[x[back]]):
            fresh = np.full(len(ids), -1)
            fresh[end] = back
            best = np.where((best < 0) | ((fresh >= 0) & (fresh < best)), fresh, best)
        new = np.unique(best[best >= 0])
        taken.append(new)
        label = least_labels(len(ids), label[x[new]], label[y[new]])[label]


def bridges_by_joins(ways: DataFrame) -> DataFrame:
    """The same for any number of ways (a, b, metres, ca, cb): a round joins what is left of them with the components' new names."""
    taken = ways.select("a", "b", "metres").limit(0)
    while True:
        ends = ways.select("a", "b", "metres", "ca", "cb", F.explode(F.array("ca", "cb")).alias("c"))
        new = settled(ends.groupBy("c").agg(F.min(F.struct("metres", "a", "b", "ca", "cb")).alias("e")).select("e.*").distinct(), "bridges")
        if new.isEmpty():
            return taken
        taken = settled(taken.union(new.select("a", "b", "metres")), "taken")
        every = ways.select(F.explode(F.array("ca", "cb")).alias("node_id")).distinct()
        of = components(every, new.select(F.col("ca").alias("a"), F.col("cb").alias("b")))
        name = lambda k: of.select(F.col("node_id").alias(k), F.col("component").alias(f"n{k}"))  # noqa: B023, E731
        left = ways.join(name("ca"), "ca").join(name("cb"), "cb").where("nca <> ncb")
        ways = settled(left.select("a", "b", "metres", F.col("nca").alias("ca"), F.col("ncb").alias("cb")), "ways")


def check_integrity(nodes: DataFrame, edges: DataFrame) -> None:
    isolated = degrees(nodes, edges).where("degree = 0").count()
    if isolated:
        raise GraphIntegrityError(f"{isolated} nodes have no edge")
    sizes = components(nodes, edges).groupBy("component").count()
    row = sizes.agg(F.count("*").alias("n"), F.min("count").alias("least")).first()
    if row["n"] > 1:
        raise GraphIntegrityError(f"the graph has {row['n']} components; the smallest has {row['least']} nodes")


@dataclass
class Assembled:
    """edges, and what was cut (reconnected ones apart), pruned and added as bridges; all (a, b, metres)."""

    edges: DataFrame
    cut: DataFrame
    reconnected: DataFrame
    pruned: DataFrame
    bridged: DataFrame


def assemble(nodes: DataFrame, max_edge_km: float = geometry.MAX_EDGE_KM, alpha: float | None = None) -> Assembled:
    """Triangulate, cut long edges, put back the fewest shortest that keep the graph whole, prune and bridge if asked, check."""
    measured = settled(geometry.edge_lengths(geometry.delaunay_edges(nodes), nodes), "delaunay")
    kept, cut = geometry.cut_long(measured, max_edge_km)
    back = bridges(nodes, kept, cut) if max_edge_km else cut
    kept, pruned, bridged = kept.union(back), measured.limit(0), measured.limit(0)
    if alpha is not None:
        marked = settled(geometry.prune_long(kept, geometry.local_scale(nodes), alpha), "pruned")
        pruned = marked.where("pruned").drop("pruned")
        kept = marked.where("not pruned").drop("pruned")
        bridged = bridges(nodes, kept, pruned)
        kept = kept.union(bridged)
    check_integrity(nodes, kept)
    return Assembled(kept, cut, back, pruned, bridged)


def ball(sources: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """source, node_id, hop: every node within radius hops of each source, at its least hop.

    A frontier moves over all sources at once, a table for each hop. A neighbour of hop k is at k - 1, k or k + 1, as edges
    go both ways, so a hop takes one join with the edges and leaves out the last two frontiers.
    """
    both = symmetric(edges)
    frontier = settled(sources.select(F.col("node_id").alias("source"), "node_id").distinct().withColumn("hop", F.lit(0)), "frontier")
    hops = [frontier]
    for hop in range(1, radius + 1):
        frontier = settled(next_hop(both, *hops[-2:]).withColumn("hop", F.lit(hop)), "frontier")
        if frontier.isEmpty():
            break
        hops.append(frontier)
    return reduce(DataFrame.union, hops)


def next_hop(both: DataFrame, *last: DataFrame) -> DataFrame:
    """source, node_id one hop from the last frontier, in none of the last ones."""
    frontier = last[-1]
    steps = frontier.join(both, frontier.node_id == both.src).select("source", F.col("dst").alias("node_id"))
    return steps.join(reduce(DataFrame.union, last).select("source", "node_id"), ["source", "node_id"], "left_anti").distinct()


def hop_distances(nodes: DataFrame, edges: DataFrame, radius: int) -> DataFrame:
    """a, b, hops of all pairs up to the radius."""
    return ball(nodes, edges, radius).select(F.col("source").alias("a"), F.col("node_id").alias("b"), F.col("hop").alias("hops"))


def induced(nodes: DataFrame, measured: DataFrame, x: int, y: int, half_x: int, half_y: int, metres: float) -> DataFrame:
    """Edges up to a length with both ends in a box around a point."""
    inside = nodes.where((F.abs(F.col("easting") - x) < half_x) & (F.abs(F.col("northing") - y) < half_y)).select("node_id")
    out = measured.where(F.col("metres") <= metres)
    for end in ("a", "b"):
        out = out.join(inside.withColumnRenamed("node_id", end), end, "left_semi")
    return out
