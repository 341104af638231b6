"""Graph-metric location privacy as Spark DataFrame operators."""
