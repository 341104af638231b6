"""Lengths, cuts, local scales and the lift from locations to nodes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.operators.triangulation import location_edges
from spindrift.tables import settled

NEIGHBOURS, ALPHA, MAX_EDGE_KM = 6, 3.0, 50.0


def edge_lengths(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """edges with metres between their ends."""
    end = lambda k: nodes.select(F.col("node_id").alias(k), F.col("easting").alias(f"{k}x"), F.col("northing").alias(f"{k}y"))
    joined = edges.join(end("a"), "a").join(end("b"), "b")
    return joined.withColumn("metres", F.hypot((F.col("ax") - F.col("bx")).cast("double"), (F.col("ay") - F.col("by")).cast("double"))).select(*edges.columns, "metres")


def cut_long(measured: DataFrame, km: float = MAX_EDGE_KM) -> tuple[DataFrame, DataFrame]:
    """Edges up to the length, and those over it; km=0 cuts none."""
    far = F.col("metres") > km * 1000 if km else F.lit(False)
    return measured.where(~far), measured.where(far)


def lifted(between: DataFrame, nodes: DataFrame) -> DataFrame:
    """Node edges (a < b): ends of location edges with all nodes of the locations, and nodes of one location with each other."""
    member = nodes.select("node_id", F.col("easting").alias("x"), F.col("northing").alias("y"))
    at = lambda k: member.select(F.col("node_id").alias(k), F.col("x").alias(f"{k}x"), F.col("y").alias(f"{k}y"))
    across = between.join(at("a"), ["ax", "ay"]).join(at("b"), ["bx", "by"]).select("a", "b")
    right = member.withColumnRenamed("node_id", "b")
    within = member.withColumnRenamed("node_id", "a").join(right, ["x", "y"]).where("a < b").select("a", "b")
    return across.union(within).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def delaunay_edges(nodes: DataFrame) -> DataFrame:
    """a, b (a < b) of the triangulation of the nodes' places."""
    return lifted(location_edges(nodes.select(F.col("easting").alias("x"), F.col("northing").alias("y"))), nodes)


def local_scale(nodes: DataFrame, neighbours: int = NEIGHBOURS) -> DataFrame:
    """node_id, scale: median metres to the nearest other nodes (all others, if there are fewer).

    Places are looked up in a grid: the nearest ones are certain once as many as needed lie within one cell's
    width; places without that look again in a grid of twice the width.
    """
    spots = nodes.groupBy(F.col("easting").alias("x"), F.col("northing").alias("y")).agg(F.count("*").alias("m"))
    spots = settled(spots, "spots")
    s = spots.agg(F.sum("m").alias("n"), F.count("*").alias("places"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.min("y").alias("y0"), F.max("y").alias("y1")).first()
    n = s["n"] or 0
    k = min(neighbours, n - 1)
    if k < 1:
        return nodes.select("node_id", F.lit(0.0).alias("scale"))
    side = max(s["x1"] - s["x0"], s["y1"] - s["y0"]) + 1
    width = max(1, int(side / max(1.0, (s["places"] / k) ** 0.5)))
    todo, done = spots, None
    while True:
        cells = lambda df: df.withColumn("cx", F.expr(f"floor(x / {width})")).withColumn("cy", F.expr(f"floor(y / {width})"))  # noqa: B023, E731
        around = cells(todo)
        for c in ("cx", "cy"):
            around = around.withColumn(c, F.explode(F.sequence(F.col(c) - 1, F.col(c) + 1)))
        other = cells(spots).select("cx", "cy", F.col("x").alias("ox"), F.col("y").alias("oy"), F.least("m", F.lit(k)).alias("om"))
        pairs = around.join(other, ["cx", "cy"]).withColumn("d", F.hypot((F.col("x") - F.col("ox")).cast("double"), (F.col("y") - F.col("oy")).cast("double")))
        near = pairs.withColumn("om", F.when(F.col("d") == 0, F.least(F.col("m") - 1, F.lit(k))).otherwise(F.col("om"))).withColumn("r", F.row_number().over(Window.partitionBy("x", "y").orderBy("d", "ox", "oy"))).where(F.col("r") <= k + 1)
        lists = near.groupBy("x", "y", "m").agg(F.array_sort(F.collect_list(F.struct("d", "ox", "oy", "om"))).alias("l"))
        lists = lists.withColumn("d", F.slice(F.flatten(F.transform("l", lambda e: F.array_repeat(e["d"], e["om"].cast("int")))), 1, k))
        certain = (F.size("d") == k) & (F.element_at("d", k) <= width) if width < side else F.lit(True)
        seen = settled(lists.withColumn("certain", certain), "near")
        middle = (F.element_at("d", (k + 1) // 2) + F.element_at("d", k // 2 + 1)) / 2
        part = seen.where("certain").select("x", "y", middle.alias("scale"))
        done = part if done is None else done.union(part)
        todo = seen.where(~F.col("certain")).select("x", "y", "m")
        if todo.isEmpty():
            break
        width *= 2
    return nodes.join(done, (nodes.easting == done.x) & (nodes.northing == done.y)).select("node_id", "scale")


def prune_long(measured: DataFrame, scales: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """measured edges with `pruned`: longer than alpha times the larger local scale of their ends."""
    at = lambda k: scales.select(F.col("node_id").alias(k), F.col("scale").alias(f"{k}s"))
    return measured.join(at("a"), "a").join(at("b"), "b").withColumn("pruned", F.col("metres") > alpha * F.greatest("as", "bs")).select(*measured.columns, "pruned")
