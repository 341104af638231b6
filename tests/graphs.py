"""Small graphs."""

from spindrift.operators.mechanism import PlaceGraph


def path(spark, n, prior=lambda i: 1, step=100, code=lambda i: f"A{i:03d} 1AA", excluded=(), edges=None):
    nodes = spark.createDataFrame([(i, code(i), prior(i), i * step, 0) for i in range(n)], "node_id long, code string, prior long, easting long, northing long")
    edges = spark.createDataFrame(edges if edges is not None else [(i, i + 1) for i in range(n - 1)], "a long, b long")
    return PlaceGraph(nodes, edges, spark.createDataFrame([(e,) for e in excluded], "code string"))
