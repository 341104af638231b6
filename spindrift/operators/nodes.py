"""Node tables: dense ids, cumulative priors, population joins and code lookups."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spindrift.functions import codes
from spindrift.tables import settled


def _offsets(totals: DataFrame, key: str, value: str) -> DataFrame:
    """key, before: the sum of value over smaller keys; one row for each partition, summed on the driver."""
    rows = sorted((r[key], r[value]) for r in totals.collect())
    before = [0, *accumulate(v for _, v in rows)]
    return totals.sparkSession.createDataFrame([(k, b) for (k, _), b in zip(rows, before, strict=False)], f"{key} int, before long")


def running(df: DataFrame, order: list[str], value: str, out: str) -> DataFrame:
    """df with the sum of value over all rows up to each, in order: range partitions, sums within them, offsets of whole partitions."""
    laid = settled(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__part", F.spark_partition_id()), "ranges")
    starts = _offsets(laid.groupBy("__part").agg(F.sum(value).alias("n")), "__part", "n")
    within = Window.partitionBy("__part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return laid.withColumn("__sum", F.sum(value).over(within)).join(F.broadcast(starts), "__part").withColumn(out, F.col("__sum") + F.col("before")).drop("__part", "__sum", "before")


def numbered(df: DataFrame, order: list[str], out: str = "node_id") -> DataFrame:
    """df with a dense id from 0 in the order of the columns."""
    counted = running(df.withColumn("__one", F.lit(1).cast("long")), order, "__one", "__n")
    return counted.withColumn(out, F.col("__n") - 1).drop("__one", "__n").select(out, *df.columns)


def cumulative_prior(nodes: DataFrame) -> DataFrame:
    """node_id, prior, prior_cum."""
    return running(nodes.select("node_id", "prior"), ["node_id"], "prior", "prior_cum")


def population_prior(nodes: DataFrame, by_code: DataFrame | None, by_area: DataFrame | None) -> DataFrame:
    """nodes with prior and its origin: a figure of the code, else an even share of its area's, else 0; 1 at least.

    by_code and by_area are (key, value); one of them has to be given.
    """
    if by_code is None and by_area is None:
        raise ValueError("a population source is needed; a uniform prior has to be asked for")
    out = nodes.withColumn("own", F.lit(None).cast("long")).withColumn("share", F.lit(None).cast("long"))
    if by_code is not None:
        out = out.drop("own").join(by_code.select(F.col("key").alias("code"), F.col("value").alias("own")), "code", "left")
    if by_area is not None:
        sizes = nodes.groupBy("area").agg(F.count("*").alias("n"))
        shares = sizes.join(by_area.withColumnRenamed("key", "area"), "area").select("area", F.expr("value div n").alias("share"))
        out = out.drop("share").join(shares, "area", "left")
    origin = F.when(F.col("own").isNotNull(), "code").when(F.col("share").isNotNull(), "area").otherwise("none")
    return out.withColumn("origin", origin).withColumn("prior", F.greatest(F.coalesce("own", "share", F.lit(0)), F.lit(1)).cast("long")).select(*nodes.columns, "prior", "origin")


def prior_coverage(weighted: DataFrame) -> DataFrame:
    """One row: nodes by origin of their prior, and all."""
    return weighted.agg(F.count_if(F.col("origin") == "code").alias("from_code"), F.count_if(F.col("origin") == "area").alias("from_area"), F.count_if(F.col("origin") == "none").alias("unmatched"), F.count("*").alias("total"))


def looked_up(df: DataFrame, column: str, nodes: DataFrame, excluded: DataFrame) -> DataFrame:
    """df with code (canonical), node_id and status: ok, invalid, large_user or unknown."""
    keyed = df.withColumn("code", codes.canonical(F.col(column)))
    found = keyed.join(nodes.select("code", "node_id"), "code", "left").join(excluded.select("code", F.lit(True).alias("__large")), "code", "left")
    status = F.when(F.col("code").isNull(), "invalid").when(F.col("node_id").isNotNull(), "ok").when(F.col("__large"), "large_user").otherwise("unknown")
    return found.withColumn("status", status).select(*df.columns, "code", "node_id", "status")


def outward_population(nodes: DataFrame) -> DataFrame:
    """outward, members, population of each district."""
    return nodes.groupBy(codes.outward(F.col("code")).alias("outward")).agg(F.count("*").alias("members"), F.sum("prior").alias("population"))


def grid_density(nodes: DataFrame, size: int = 5000, columns: int = 140, rows: int = 260) -> DataFrame:
    """cell_x, cell_y, population of each occupied cell."""
    cx, cy = codes.cell(F.col("easting"), F.col("northing"), size, columns, rows)
    return nodes.groupBy(cx.cast("long").alias("cell_x"), cy.cast("long").alias("cell_y")).agg(F.sum("prior").alias("population"))
