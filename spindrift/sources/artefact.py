"""Stored graphs (Parquet tables and a metadata file), provenance and manifests."""

from __future__ import annotations

import json
import os
import platform
import re
from dataclasses import asdict, dataclass, field
from datetime import datetime, timezone
from importlib.metadata import version

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.errors import ArtefactVersionError
from spindrift.operators.mechanism import HopMechanism, PlaceGraph

SCHEMA_VERSION, ALGORITHM_VERSION = 1, 1
#: The statements that the directory's licence asks for.
ATTRIBUTION = (
    "Contains OS data (c) Crown copyright and database right {year}",
    "Contains Royal Mail data (c) Royal Mail copyright and database right {year}",
    "Source: Office for National Statistics licensed under the Open Government Licence v.3.0",
)


def attribution(year: int) -> list[str]:
    return [line.format(year=year) for line in ATTRIBUTION]


def source_year(path: str) -> int:
    """The first 20xx of a file's name, else this year."""
    found = re.search(r"20\d\d", os.path.basename(path))
    return int(found[0]) if found else datetime.now(timezone.utc).year


@dataclass
class PopulationSource:
    name: str
    role: str
    sha256: str


@dataclass
class Provenance:
    """Where a graph came from, and with which versions it was built."""

    source: str = ""
    source_sha256: str = ""
    prior: str = "uniform"
    gb_only: bool = False
    max_edge_km: float | None = None
    prune_alpha: float | None = None
    populations: list[PopulationSource] = field(default_factory=list)
    versions: dict[str, str] = field(default_factory=lambda: build_versions())

    @staticmethod
    def from_metadata(data: dict) -> Provenance:
        return Provenance(**{**data, "populations": [PopulationSource(**p) for p in data.get("populations", [])]})


def build_versions() -> dict[str, str]:
    return {"python": platform.python_version(), **{p: version(p) for p in ("pyspark", "numpy", "pyarrow")}}


def _files(spark: SparkSession, path: str):
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    hadoop, fs = _files(spark, path)
    return fs.exists(hadoop)


def write_text(spark: SparkSession, path: str, text: str) -> None:
    hadoop, fs = _files(spark, path)
    out = fs.create(hadoop, False)
    out.write(bytearray(text.encode()))
    out.close()


def save_graph(graph: PlaceGraph, path: str, provenance: Provenance) -> dict:
    """Writes a graph with coordinates to a folder that does not exist; returns its metadata."""
    spark = graph.nodes.sparkSession
    if not {"easting", "northing"} <= set(graph.nodes.columns):
        raise ValueError("a graph is stored with coordinates")
    hadoop, fs = _files(spark, path)
    if fs.exists(hadoop):
        raise FileExistsError(path)
    graph.nodes.select("node_id", "code", F.col("prior").cast("long"), "easting", "northing").write.parquet(f"{path}/nodes")
    graph.edges.select("a", "b").write.parquet(f"{path}/edges")
    graph.excluded.select("code").write.parquet(f"{path}/excluded")
    meta = {"schema_version": SCHEMA_VERSION, "algorithm_version": ALGORITHM_VERSION, "provenance": asdict(provenance)}
    write_text(spark, f"{path}/metadata.json", json.dumps(meta, indent=1, sort_keys=True))
    return meta


def load_graph(spark: SparkSession, path: str) -> PlaceGraph:
    text = "\n".join(r["value"] for r in spark.read.text(f"{path}/metadata.json", wholetext=True).collect())
    meta = json.loads(text)
    if meta.get("schema_version") != SCHEMA_VERSION:
        raise ArtefactVersionError(f"the graph has schema version {meta.get('schema_version')}, this code reads {SCHEMA_VERSION}")
    read = lambda name: spark.read.parquet(f"{path}/{name}")
    return PlaceGraph(read("nodes"), read("edges"), read("excluded"), meta)


def digest(graph: PlaceGraph) -> str:
    """A fingerprint of nodes and edges that does not depend on files or partitions."""
    part = lambda df, cols: df.agg(F.coalesce(F.bit_xor(F.xxhash64(*cols)), F.lit(0)), F.count("*")).first()
    return ":".join(f"{v:x}" for df, cols in ((graph.nodes, ("node_id", "code", "prior")), (graph.edges, ("a", "b"))) for v in (x & (2**64 - 1) for x in part(df, cols)))


def release_manifest(mechanism: HopMechanism, released: DataFrame, code_col: str, out_col: str, policy: str, kept_source: bool, rows_in: int) -> DataFrame:
    """One row on a release: settings, rows, distinct spellings, the largest teleport probability of its codes (null without any)
    beside the ceiling that was asked for, and where the graph came from."""
    m, meta = mechanism, mechanism.graph.meta
    done = released.agg(F.count("*").alias("rows_out"), F.count(out_col).alias("rows_perturbed"), F.count_distinct(code_col).alias("distinct_codes"))
    return done.select(
        F.lit(m.epsilon).alias("epsilon"), F.lit(m.radius).alias("radius"), F.lit(m.max_teleport).alias("max_teleport"), F.lit(m.largest_teleport(released.where(F.col(out_col).isNotNull()), code_col)).cast("double").alias("largest_teleport"), F.lit(meta.get("provenance", {}).get("prior", "unknown")).alias("prior"), F.lit(policy).alias("on_error"),
        F.lit(rows_in).alias("rows_in"), "rows_out", "rows_perturbed", (F.lit(rows_in) - F.col("rows_perturbed")).alias("rows_failed"), "distinct_codes", F.lit(out_col).alias("out_col"), F.lit(kept_source).alias("source_kept"), F.lit(digest(m.graph)).alias("graph_digest"), F.lit(json.dumps(meta.get("provenance", {}), sort_keys=True)).alias("graph_provenance"),
    )


def file_digest(spark: SparkSession, path: str) -> str:
    """SHA-256 of a file's bytes, of any store that Spark reads; the bytes stream through the driver."""
    hadoop, fs = _files(spark, path)
    digest = spark._jvm.java.security.MessageDigest.getInstance("SHA-256")
    source = spark._jvm.java.security.DigestInputStream(fs.open(hadoop), digest)
    try:
        source.transferTo(spark._jvm.java.io.OutputStream.nullOutputStream())
    finally:
        source.close()
    return bytes(digest.digest()).hex()
