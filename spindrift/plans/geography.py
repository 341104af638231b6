"""A geography made from the provided tables by integer arithmetic, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.operators.mechanism import PlaceGraph
from spindrift.operators.nodes import numbered
from spindrift.tables import settled

ABC = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
WIDTH = 50


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def code_of(k: Column) -> Column:
    part = lambda by, mod: ((k - k % by) / by).cast("long") % mod
    letter = lambda n: F.substring(F.lit(ABC), (n + 1).cast("int"), F.lit(1))
    return F.concat(letter(part(26000, 26)), letter(part(1000, 26)), part(676000, 10).cast("string"), F.lit(" "), part(100, 10).cast("string"), letter(part(10, 10)), letter(k % 10))


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """k, code, easting, northing, area, grp, prior, large: a place for each customer; each 50th shares its predecessor's spot."""
    c, o = table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders")
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    counts = o.groupBy(F.col("o_custkey").alias("k")).agg(F.count("*").alias("orders"))
    k = F.col("c_custkey")
    spot = F.when(k % 50 == 0, k - 1).otherwise(k)
    rows = c.join(F.broadcast(n), c.c_nationkey == n.n_nationkey).select(
        k.alias("k"), code_of(k).alias("code"), ((spot * 7919) % 700000).alias("easting"), ((spot * 104729) % 1300000).alias("northing"), F.col("n_name").alias("area"), F.col("r_name").alias("grp"), (k % 97 == 0).alias("large")
    )
    return rows.join(counts, "k", "left").withColumn("prior", F.greatest(F.lit(1).cast("long"), F.coalesce("orders", F.lit(0)))).drop("orders")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settled(numbered(places(spark, sf_dir).where("not large").drop("large"), ["code"]), "nodes")


def lattice(nodes_df: DataFrame) -> DataFrame:
    """Edges to the next node of a row and to the one below, WIDTH nodes a row."""
    i, last = F.col("node_id"), F.lit(nodes_df.count())
    step = F.explode(F.array_compact(F.array(F.when((i % WIDTH < WIDTH - 1) & (i + 1 < last), i + 1), F.when(i + WIDTH < last, i + WIDTH))))
    return nodes_df.select(i.alias("a"), step.alias("b"))


def graph(spark: SparkSession, sf_dir: str) -> PlaceGraph:
    at = nodes(spark, sf_dir)
    return PlaceGraph(at, settled(lattice(at), "edges"), places(spark, sf_dir).where("large").select("code"))


def raw_directory(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The places as rows of a directory, all cells text, some of them due to be dropped."""
    k = F.col("k")
    return places(spark, sf_dir).select(
        k.alias("row_no"),
        F.when(k % 13 == 0, F.concat(F.lit("bt"), F.substring("code", 3, 6))).otherwise(F.lower(F.replace(F.col("code"), F.lit(" "), F.lit("")))).alias("pcds"),
        F.when(k % 11 == 0, "202001").otherwise("").alias("doterm"),
        F.when(k % 17 == 0, "").when(k % 19 == 0, "0").otherwise(F.col("easting").cast("string")).alias("east1m"),
        F.lpad(F.col("northing").cast("string"), 7, "0").alias("north1m"),
        F.when(F.col("large"), "1").otherwise("0").alias("usrtypind"),
        F.col("area").alias("oa21cd"),
        F.lit("51.5").alias("lat"),
        F.lit("-0.1").alias("long"),
        F.col("grp").alias("ruc21ind"),
    )


#: SQL of the same relations: base (places), nodes, edges, sym (both ways).
SQL = f"""RECURSIVE spots AS (SELECT c_custkey AS k, c_nationkey, CASE WHEN c_custkey % 50 = 0 THEN c_custkey - 1 ELSE c_custkey END AS s FROM customer),
base AS (SELECT k, substr('{ABC}', ((k // 26000) % 26 + 1)::INT, 1) || substr('{ABC}', ((k // 1000) % 26 + 1)::INT, 1) || ((k // 676000) % 10)::VARCHAR || ' ' || ((k // 100) % 10)::VARCHAR || substr('{ABC}', ((k // 10) % 10 + 1)::INT, 1) || substr('{ABC}', (k % 10 + 1)::INT, 1) AS code,
    (s * 7919) % 700000 AS easting, (s * 104729) % 1300000 AS northing, n_name AS area, r_name AS grp, k % 97 = 0 AS large, greatest(1, coalesce(o.n, 0))::BIGINT AS prior
    FROM spots JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey LEFT JOIN (SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1) o ON o_custkey = k),
nodes AS MATERIALIZED (SELECT row_number() OVER (ORDER BY code) - 1 AS node_id, * EXCLUDE (large) FROM base WHERE NOT large),
edges AS MATERIALIZED (SELECT node_id AS a, node_id + 1 AS b FROM nodes WHERE node_id % {WIDTH} < {WIDTH - 1} AND node_id + 1 < (SELECT count(*) FROM nodes) UNION ALL SELECT node_id, node_id + {WIDTH} FROM nodes WHERE node_id + {WIDTH} < (SELECT count(*) FROM nodes)),
sym AS MATERIALIZED (SELECT a AS src, b AS dst FROM edges UNION ALL SELECT b, a FROM edges),
raw AS (SELECT k AS row_no, CASE WHEN k % 13 = 0 THEN 'bt' || substr(code, 3, 6) ELSE lower(replace(code, ' ', '')) END AS pcds, CASE WHEN k % 11 = 0 THEN '202001' ELSE '' END AS doterm,
    CASE WHEN k % 17 = 0 THEN '' WHEN k % 19 = 0 THEN '0' ELSE easting::VARCHAR END AS east1m, lpad(northing::VARCHAR, 7, '0') AS north1m, CASE WHEN large THEN '1' ELSE '0' END AS usrtypind, area AS oa21cd, grp AS ruc21ind FROM base),
canon AS (SELECT *, upper(regexp_replace(pcds, '\\s', '', 'g')) AS squeezed FROM raw),
spelt AS (SELECT *, CASE WHEN length(squeezed) BETWEEN 5 AND 7 THEN left(squeezed, length(squeezed) - 3) || ' ' || right(squeezed, 3) END AS code FROM canon),
dropped AS (SELECT *, CASE WHEN doterm <> '' THEN 'terminated' WHEN usrtypind = '1' THEN 'large_user' WHEN east1m = '' OR north1m = '' THEN 'no_grid_reference'
    WHEN NOT (east1m::BIGINT > 0 AND east1m::BIGINT < 700000 AND north1m::BIGINT > 0 AND north1m::BIGINT < 1300000) THEN 'outside_national_grid' END AS reason FROM spelt)"""
