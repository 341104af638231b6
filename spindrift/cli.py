"""Commands: keygen, build, perturb, report, calibrate, evaluate."""

from __future__ import annotations

import argparse
import json
import os
import sys
from dataclasses import asdict

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spindrift.functions import codes
from spindrift.functions.exact import Key
from spindrift.operators import graph as graphs
from spindrift.operators import measures, nodes
from spindrift.operators.mechanism import POLICIES, HopMechanism, PlaceGraph
from spindrift.sources import artefact, directory

USAGE, ROWS_FAILED = 2, 3
KEY_VARIABLE = "SPINDRIFT_KEY"


class UsageError(Exception):
    """Told without a trace, with exit code 2."""


def session() -> SparkSession:
    return SparkSession.builder.appName("spindrift").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def load_key(path: str | None) -> Key:
    return Key.from_file(path) if path else Key.from_env(KEY_VARIABLE)


def keygen(args: argparse.Namespace) -> int:
    try:
        handle = os.open(args.out, os.O_WRONLY | os.O_CREAT | os.O_EXCL, 0o400)
    except FileExistsError:
        raise UsageError("the key file exists") from None
    with os.fdopen(handle, "wb") as f:
        f.write(os.urandom(32))
    return 0


def build(args: argparse.Namespace) -> int:
    populations = [*args.oa_populations, *args.code_populations]
    if bool(populations) == args.uniform_prior:
        raise UsageError("give population files, or --uniform-prior")
    spark = session()
    if artefact.exists(spark, args.out):
        raise UsageError("the output exists")
    read = directory.read_directory(spark, args.directory, args.gb_only)
    if args.uniform_prior:
        weighted = read.nodes.withColumn("prior", F.lit(1).cast("long")).withColumn("origin", F.lit("none"))
    else:
        by_code = directory.read_pairs(spark, args.code_populations, codes.population_code(F.col("raw"))) if args.code_populations else None
        by_area = directory.read_pairs(spark, args.oa_populations) if args.oa_populations else None
        weighted = nodes.population_prior(read.nodes, by_code, by_area)
    made = graphs.assemble(read.nodes, args.max_edge_km, args.prune_alpha)
    graph = PlaceGraph(weighted.drop("origin", "area"), made.edges.select("a", "b"), read.excluded)
    sources = [artefact.PopulationSource(os.path.basename(p), role, artefact.file_digest(spark, p)) for role, paths in (("area", args.oa_populations), ("code", args.code_populations)) for p in paths]
    came = artefact.Provenance(os.path.basename(args.directory), artefact.file_digest(spark, args.directory), "uniform" if args.uniform_prior else "population", args.gb_only, args.max_edge_km, args.prune_alpha, sources)
    artefact.save_graph(graph, args.out, came)
    stored = artefact.load_graph(spark, args.out)
    ends = graphs.degree_summary(stored.nodes, stored.edges).first()
    manifest = {
        "nodes": ends["nodes"], "edges": ends["ends"] // 2, "mean_degree": ends["mean_degree"], "rows_read": read.rows_read, "dropped": read.dropped, "cut": made.cut.count(), "reconnected": made.reconnected.count(), "pruned": made.pruned.count(), "bridges": made.bridged.count(),
        "prior_coverage": nodes.prior_coverage(weighted).first().asDict(), "provenance": asdict(came), "graph_digest": artefact.digest(stored), "attribution": artefact.attribution(artefact.source_year(args.directory)),
    }
    artefact.write_text(spark, args.out.rstrip("/") + ".manifest.json", json.dumps(manifest, indent=1))
    return 0


def perturb(args: argparse.Namespace) -> int:
    if os.path.normpath(args.source) == os.path.normpath(args.out):
        raise UsageError("the output would replace the input")
    key, spark = load_key(args.key_file), session()
    if artefact.exists(spark, args.out):
        raise UsageError("the output exists")
    rows = directory.read_records(spark, args.source)
    for c in (args.code_col, args.subject_col):
        if c not in rows.columns:
            raise UsageError(f"there is no column {c}")
    if args.out_col in rows.columns and args.out_col != args.code_col:
        raise UsageError(f"column {args.out_col} exists")
    if rows.isEmpty():
        raise UsageError("the input has no rows")
    n = rows.count()
    mechanism = HopMechanism(artefact.load_graph(spark, args.graph), args.epsilon, args.radius)
    out = mechanism.perturb_frame(rows, args.code_col, args.subject_col, key, "__out" if args.out_col == args.code_col else args.out_col, args.on_error)
    if args.out_col == args.code_col:
        out = out.withColumn("__true", F.col(args.code_col)).drop(args.code_col).withColumnRenamed("__out", args.out_col).withColumnRenamed("__true", args.code_col + "_true")
    true = args.code_col if args.out_col != args.code_col else args.code_col + "_true"
    out = out.persist()
    manifest = artefact.release_manifest(mechanism, out, true, args.out_col, args.on_error, args.keep_source, n).first().asDict()
    shown = out if args.keep_source else out.drop(true)
    directory.write_records(shown.select(*(c for c in shown.columns if c != args.out_col), args.out_col), args.out)
    artefact.write_text(spark, args.out.rstrip("/") + ".manifest.json", json.dumps(manifest, indent=1))
    out.unpersist()
    return ROWS_FAILED if manifest["rows_failed"] else 0


def _shown(data: dict, as_json: bool) -> int:
    print(json.dumps(data) if as_json else "\n".join(f"{k}: {v}" for k, v in data.items()))
    return 0


def report(args: argparse.Namespace) -> int:
    if (args.code is None) == (args.sample is None):
        raise UsageError("give --code or --sample")
    spark = session()
    mechanism = HopMechanism(artefact.load_graph(spark, args.graph), args.epsilon, args.radius)
    if args.code is not None:
        one = spark.createDataFrame([(mechanism.graph.index_of(args.code),)], "node_id long")
        data = measures.displacement(mechanism, one).first().asDict()
        del data["source"]
    else:
        data = measures.sample_report(mechanism, measures.sample_places(mechanism.graph, args.sample, args.seed)).first().asDict()
    return _shown({"epsilon": args.epsilon, "radius": mechanism.radius, **data}, args.json)


def calibrate(args: argparse.Namespace) -> int:
    return _shown(asdict(measures.calibrate(artefact.load_graph(session(), args.graph), args.target, args.value, args.sample, args.seed)), args.json)


def evaluate(args: argparse.Namespace) -> int:
    spark = session()
    mechanism = HopMechanism(artefact.load_graph(spark, args.graph), args.epsilon)
    raw = directory.text_scan(spark, args.directory).withColumn("row_no", F.monotonically_increasing_id())
    extra = directory.aligned(mechanism.graph.nodes, raw, ["ruc21ind", "ctry26cd", "lsoa21cd"])
    groups = extra.select("node_id", codes.settlement(F.col("ruc21ind"), F.col("ctry26cd")).alias("group"))
    sample, notes = measures.stratified_sample(groups, args.per_group, args.seed)
    rows = measures.group_summary(mechanism, sample, extra.select("node_id", F.col("lsoa21cd").alias("area")))
    return _shown({"epsilon": args.epsilon, "radius": mechanism.radius, "groups": [r.asDict() for r in rows.orderBy("group").collect()], "notes": notes}, args.json)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="spindrift")
    top.add_argument("--version", action="version", version="0.1.0")
    sub = top.add_subparsers(dest="command", required=True)

    def command(f, *options: tuple) -> None:
        p = sub.add_parser(f.__name__)
        p.set_defaults(run=f)
        for names, kw in options:
            p.add_argument(*names.split(), **kw)

    graph, epsilon, seed, as_json = ("--graph", {"required": True}), ("--epsilon", {"type": float, "required": True}), ("--seed", {"type": int, "default": 0}), ("--json", {"action": "store_true"})
    command(keygen, ("--out", {"required": True}))
    command(build, ("--directory", {"required": True}), ("--out", {"required": True}), ("--oa-populations", {"action": "append", "default": []}), ("--code-populations", {"action": "append", "default": []}), ("--uniform-prior", {"action": "store_true"}), ("--gb-only", {"action": "store_true"}), ("--max-edge-km", {"type": float, "default": 50.0}), ("--prune-alpha", {"type": float}))
    command(perturb, ("source", {}), ("--out", {"required": True}), graph, epsilon, ("--code-col", {"required": True}), ("--subject-col", {"required": True}), ("--out-col", {"default": "place_dp"}), ("--radius", {"type": int}), ("--on-error", {"choices": POLICIES, "default": "error"}), ("--keep-source", {"action": "store_true"}), ("--key-file", {}))
    command(report, graph, epsilon, ("--radius", {"type": int}), ("--code", {}), ("--sample", {"type": int}), seed, as_json)
    command(calibrate, graph, ("--target", {"required": True}), ("--value", {"type": float, "required": True}), ("--sample", {"type": int, "default": 16}), seed, as_json)
    command(evaluate, graph, ("--directory", {"required": True}), epsilon, ("--per-group", {"type": int, "default": 25}), seed, as_json)
    return top


def main(argv: list[str] | None = None) -> int:
    argv = sys.argv[1:] if argv is None else argv
    if any(a == "--key" or a.startswith("--key=") for a in argv):
        print("a key is given as a file or in the environment, never on the command line", file=sys.stderr)
        return USAGE
    args = parser().parse_args(argv)
    try:
        return args.run(args)
    except (UsageError, ValueError, KeyError, TypeError) as e:
        print(str(e).strip("'\""), file=sys.stderr)
        return USAGE


if __name__ == "__main__":
    sys.exit(main())
