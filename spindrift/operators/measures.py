"""What a mechanism costs and discloses: displacement, utility, calibration, comparison and attacks."""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from spindrift.errors import UnknownTarget
from spindrift.functions import codes
from spindrift.functions.exact import Key
from spindrift.operators.mechanism import HopMechanism, PlaceGraph, ball_quantiles, measured_together
from spindrift.operators.nodes import numbered
from spindrift.tables import settled

#: Fixed values of the solvers.
MIN_EPSILON, MAX_EPSILON, STEPS, MATCH_STEPS = 0.05, 50.0, 20, 18


def sampled_ids(n: int, size: int, seed: int) -> list[int]:
    """The same draw as numpy's, on the driver: as many ids as asked for."""
    return np.random.default_rng(seed).choice(n, size=min(size, n), replace=False).tolist()


def sample_places(graph: PlaceGraph, size: int, seed: int) -> DataFrame:
    """node_id and code of a fixed sample."""
    ids = graph.nodes.sparkSession.createDataFrame([(i,) for i in sampled_ids(graph.n_nodes(), size, seed)], "node_id long")
    return graph.nodes.join(F.broadcast(ids), "node_id").select("node_id", "code")


def stratified_sample(groups: DataFrame, per_group: int, seed: int) -> tuple[DataFrame, list[str]]:
    """node_id, group of up to per_group nodes of each group (in sorted order, one stream of draws), and notes on small groups."""
    rng, picks, notes = np.random.default_rng(seed), [], []
    sizes = {r["group"]: r["n"] for r in groups.where("group <> 'unclassified'").groupBy("group").agg(F.count("*").alias("n")).collect()}
    # Places of a group are numbered in ranges, not in one task: their number among all less that of the group's first.
    every = numbered(groups.select("node_id", "group"), ["group", "node_id"], "place")
    ranked = every.join(every.groupBy("group").agg(F.min("place").alias("first")), "group").select("node_id", "group", (F.col("place") - F.col("first")).cast("int").alias("r"))
    for g in sorted(sizes):
        if sizes[g] < per_group:
            notes.append(f"{g} has {sizes[g]} of {per_group}")
        picks += [(g, int(r)) for r in rng.choice(sizes[g], size=min(per_group, sizes[g]), replace=False)]
    chosen = groups.sparkSession.createDataFrame(picks, "group string, r int")
    return ranked.join(F.broadcast(chosen), ["group", "r"]).select("node_id", "group"), notes


def placed_ball(graph: PlaceGraph, codes_df: DataFrame, radius: int) -> DataFrame:
    """source, node_id, hop, prior and km from the source of all nodes within radius hops, expanded once and settled."""
    at = graph.nodes.select("node_id", F.col("easting").alias("x"), F.col("northing").alias("y"))
    from_ = graph.nodes.select(F.col("node_id").alias("source"), F.col("easting").alias("sx"), F.col("northing").alias("sy"))
    far = F.hypot((F.col("x") - F.col("sx")).cast("double"), (F.col("y") - F.col("sy")).cast("double")) / 1000
    reach = graph.ball(codes_df, radius).join(graph.beside(at), "node_id").join(graph.beside(from_), "source")
    return settled(reach.select("source", "node_id", "hop", "prior", far.alias("km")), "placed")


def displacement(mechanism: HopMechanism, codes_df: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """source, mean_km, median_km, p95_km of outputs below the radius; self_probability, teleport_probability, ball_size.

    placed: a ball of codes_df that was expanded before, to the largest radius that is asked for. Without one, graphs that fit
    into workers are measured there.
    """
    if placed is None and mechanism.graph.fits:
        return mechanism.measured(codes_df)
    placed = placed if placed is not None else placed_ball(mechanism.graph, codes_df, mechanism.radius - 1)
    near = placed.where(F.col("hop") < mechanism.radius).withColumn("w", F.col("prior") * mechanism.factor())
    mean = near.groupBy("source").agg((F.sum(F.col("km") * F.col("w")) / F.sum("w")).alias("mean_km"), F.sum("w").alias("__ball"), F.sum("prior").alias("__prior"), F.count("*").alias("ball_size"), F.max(F.when(F.col("hop") == 0, F.col("prior"))).alias("__own"))
    quantiles = ball_quantiles(near, ["source"], "km", "w", {"median_km": 0.5, "p95_km": 0.95})
    tail = (F.lit(mechanism.total_prior) - F.col("__prior")) * math.exp(-mechanism.epsilon / 2 * mechanism.radius)
    total = F.col("__ball") + tail
    return mean.join(quantiles, "source").select("source", "mean_km", "median_km", "p95_km", (F.col("__own") / total).alias("self_probability"), (tail / total).alias("teleport_probability"), "ball_size")


def sample_report(mechanism: HopMechanism, codes_df: DataFrame) -> DataFrame:
    """One row over a sample: median, p95 and max of the median displacements, largest self and teleport probability."""
    return displacement(mechanism, codes_df).agg(
        F.count("*").alias("places"), F.expr("percentile(median_km, 0.5)").alias("median_km"), F.expr("percentile(median_km, 0.95)").alias("p95_km"), F.max("median_km").alias("max_km"), F.max("self_probability").alias("max_self_probability"), F.max("teleport_probability").alias("max_teleport_probability")
    )


def area_preservation(mechanism: HopMechanism, codes_df: DataFrame, areas: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """source, area_preserved: chance that an output below the radius has the source's area (0 if it has none). areas: node_id, area.

    placed: a ball of codes_df that was expanded before.
    """
    graph = mechanism.graph
    of = graph.beside(areas.select(F.col("node_id").alias("source"), F.col("area").alias("home")))
    ball = mechanism.balls(codes_df) if placed is None else placed.where(F.col("hop") < mechanism.radius)
    weight = F.col("prior") * mechanism.factor()
    per = ball.join(graph.beside(areas.select("node_id", "area")), "node_id", "left").join(of, "source", "left").groupBy("source").agg(
        F.sum(F.when(F.col("area") == F.col("home"), weight).otherwise(0.0)).alias("same"), F.sum(weight).alias("near"), F.sum("prior").alias("prior")
    )
    tail = (F.lit(mechanism.total_prior) - F.col("prior")) * math.exp(-mechanism.epsilon / 2 * mechanism.radius)
    return per.select("source", (F.col("same") / (F.col("near") + tail)).alias("area_preserved"))


def group_summary(mechanism: HopMechanism, sample: DataFrame, areas: DataFrame, placed: DataFrame | None = None) -> DataFrame:
    """group, count, median_km, p95_km, area_preserved, median_self_probability. sample: node_id, group.

    One ball of the sample serves all measures, in the worker that expands it where the graph fits; placed: one that was
    expanded before.
    """
    if placed is None and mechanism.graph.fits:
        of = mechanism.measured(sample, areas)
    else:
        placed = placed if placed is not None else placed_ball(mechanism.graph, sample, mechanism.radius - 1)
        of = displacement(mechanism, sample, placed).join(area_preservation(mechanism, sample, areas, placed), "source")
    return _by_group(of, sample, "group")


def _by_group(of: DataFrame, sample: DataFrame, *by: str) -> DataFrame:
    rows = of.join(sample.withColumnRenamed("node_id", "source"), "source")
    return rows.groupBy(*by).agg(F.count("*").alias("count"), F.expr("percentile(median_km, 0.5)").alias("median_km"), F.expr("percentile(p95_km, 0.95)").alias("p95_km"), F.expr("percentile(area_preserved, 0.5)").alias("area_preserved"), F.expr("percentile(self_probability, 0.5)").alias("median_self_probability"))


@dataclass(frozen=True)
class Calibration:
    target: str
    requested: float
    epsilon: float
    achieved: float
    spread: float
    sample_size: int
    reached: bool


def _medians(rows: DataFrame) -> tuple[float, float]:
    r = rows.agg(F.expr("percentile(median_km, 0.5)"), F.expr("percentile(median_km, 0.95)")).first()
    return float(r[0]), float(r[1])


def _self(rows: DataFrame) -> tuple[float, float]:
    r = rows.agg(F.max("self_probability"), F.expr("percentile(self_probability, 0.5)")).first()
    return float(r[0]), float(r[1])


#: Name: measure of a displacement table, and whether it rises with epsilon. More can be added.
TARGETS: dict[str, tuple[Callable[[DataFrame], tuple[float, float]], bool]] = {"median-displacement-km": (_medians, False), "max-self-probability": (_self, True)}


def calibrate(graph: PlaceGraph, target: str, value: float, sample_size: int = 16, seed: int = 0, progress: Callable[[int, int], None] | None = None, most_epsilon: float = MAX_EPSILON, steps: int = STEPS) -> Calibration:
    """The epsilon that meets a target on a sample, by geometric bisection; of the last bracket, the end that meets it.

    Where the graph fits into workers, they expand and measure the balls at each step; otherwise hops are expanded once, to
    the radius of the least epsilon or until no node is left, and reused by all steps.
    """
    if target not in TARGETS:
        raise UnknownTarget(f"targets are {', '.join(sorted(TARGETS))}")
    measure, rising = TARGETS[target]
    sample = sample_places(graph, sample_size, seed)
    widest = HopMechanism(graph, MIN_EPSILON)
    placed = None if graph.fits else placed_ball(graph, sample, widest.radius - 1)
    at = lambda e: measure(displacement(HopMechanism(graph, e), sample, placed))
    low, high = MIN_EPSILON, most_epsilon
    ends = sorted((at(low)[0], at(high)[0]))
    for k in range(steps):
        if progress:
            progress(k + 1, steps)
        middle = math.sqrt(low * high)
        got = at(middle)[0]
        low, high = (low, middle) if (got > value if rising else got < value) else (middle, high)
    epsilon = low if rising else high
    got, spread = at(epsilon)
    return Calibration(target, value, epsilon, got, spread, sample.count(), ends[0] <= value <= ends[1])


def truncation_error(graph: PlaceGraph, codes_df: DataFrame | None = None) -> DataFrame:
    """source, outward, district_size, truncation_km: mean distance to the members of the district, by prior, the source
    included; sources that are alone in theirs are left out."""
    all_nodes = graph.nodes.withColumn("outward", codes.outward(F.col("code")))
    one = all_nodes if codes_df is None else all_nodes.join(codes_df.select("node_id"), "node_id", "left_semi")
    member = all_nodes.select("outward", F.col("prior").alias("w"), F.col("easting").alias("mx"), F.col("northing").alias("my"))
    pairs = one.select(F.col("node_id").alias("source"), "outward", "easting", "northing").join(member, "outward")
    far = F.hypot((F.col("easting") - F.col("mx")).cast("double"), (F.col("northing") - F.col("my")).cast("double")) / 1000
    return pairs.groupBy("source", "outward").agg(F.count("*").alias("district_size"), (F.sum(far * F.col("w")) / F.sum("w")).alias("truncation_km")).where("district_size > 1")


def equivalent_epsilon(graph: PlaceGraph, code: str, steps: int = MATCH_STEPS) -> tuple[float, float]:
    """The epsilon whose median displacement of one code matches its truncation error, and that error."""
    node = graph.index_of(code)
    one = graph.nodes.where(F.col("node_id") == node).select("node_id")
    row = truncation_error(graph, one).first()
    if row is None:
        raise ValueError("the code is alone in its district")
    placed = None if graph.fits else placed_ball(graph, one, HopMechanism(graph, MIN_EPSILON).radius - 1)
    low, high = MIN_EPSILON, MAX_EPSILON
    for _ in range(steps):
        middle = math.sqrt(low * high)
        got = displacement(HopMechanism(graph, middle), one, placed).first()["median_km"]
        low, high = (low, middle) if got < row["truncation_km"] else (middle, high)
    return high, row["truncation_km"]


def equivalent_epsilons(graph: PlaceGraph, groups: DataFrame, per_group: int, seed: int, steps: int = MATCH_STEPS) -> tuple[DataFrame, list[str]]:
    """node_id, group, epsilon, truncation_km of a stratified sample, without codes that are alone in their district, and
    notes on small groups. All places take their steps of bisection together, on one expansion."""
    sample, notes = stratified_sample(groups, per_group, seed)
    sample = settled(sample, "sample")
    spark, wanted = sample.sparkSession, truncation_error(graph, sample).select(F.col("source").alias("node_id"), "truncation_km")
    rows = {r["node_id"]: [r["group"], r["truncation_km"], MIN_EPSILON, MAX_EPSILON] for r in sample.join(wanted, "node_id").collect()}  # as many as were asked for
    placed = placed_ball(graph, sample, HopMechanism(graph, MIN_EPSILON).radius - 1)
    for _ in range(steps):
        middle = spark.createDataFrame([(k, math.sqrt(r[2] * r[3])) for k, r in rows.items()], "source long, epsilon double")
        radii = {e: HopMechanism(graph, e).radius for e in {math.sqrt(r[2] * r[3]) for r in rows.values()}}
        at = middle.join(spark.createDataFrame(list(radii.items()), "epsilon double, radius int"), "epsilon")
        near = placed.join(F.broadcast(at), "source").where(F.col("hop") < F.col("radius")).withColumn("w", F.col("prior") * F.exp(-F.col("hop") * F.col("epsilon") / 2))
        for r in ball_quantiles(near, ["source"], "km", "w", {"median_km": 0.5}).collect():
            group, wanted_km, low, high = rows[r["source"]]
            half = math.sqrt(low * high)
            rows[r["source"]] = [group, wanted_km, *((low, half) if r["median_km"] < wanted_km else (half, high))]
    return spark.createDataFrame([(k, g, high, km) for k, (g, km, _, high) in rows.items()], "node_id long, group string, epsilon double, truncation_km double"), notes


def epsilon_table(graph: PlaceGraph, sample: DataFrame, areas: DataFrame, epsilons: list[float], radius: int | None = None) -> DataFrame:
    """epsilon and group_summary of one sample for each; one ball, as wide as any asks for, serves all: in the worker that expands
    it, or as a table where the graph does not fit into workers."""
    made = [HopMechanism(graph, e, radius) for e in epsilons]
    if graph.fits:
        of = settled(measured_together(made, sample, areas), "measured")
        rows = _by_group(of, sample, "epsilon", "group")
        return rows.select(*(c for c in rows.columns if c != "epsilon"), "epsilon")
    placed = placed_ball(graph, sample, max(m.radius for m in made) - 1)
    return reduce(DataFrame.union, [group_summary(m, sample, areas, placed).withColumn("epsilon", F.lit(m.epsilon)) for m in made])


def exposure_percentiles(mechanism: HopMechanism, sample: DataFrame) -> DataFrame:
    """group, p10, p25, p50, p75, p90 of self-probabilities. sample: node_id, group."""
    rows = mechanism.report(sample).join(sample.withColumnRenamed("node_id", "source"), "source")
    return rows.groupBy("group").agg(*(F.expr(f"percentile(self_probability, {p / 100})").alias(f"p{p}") for p in (10, 25, 50, 75, 90)))


# -- attacks ------------------------------------------------------------------------------------


def posterior(mechanism: HopMechanism, outputs: DataFrame) -> DataFrame:
    """output, candidate, probability of each candidate within the radius, given one output. outputs: node_id."""
    if mechanism.graph.fits:
        return mechanism.posteriors(outputs, mechanism.totals(mechanism.graph.within(outputs, mechanism.radius - 1)).select("source", "total"))
    seen = mechanism.balls(outputs).withColumnRenamed("source", "output").withColumnRenamed("node_id", "candidate")
    seen = settled(seen, "seen")
    totals = mechanism.totals(seen.select(F.col("candidate").alias("node_id")).distinct()).select(F.col("source").alias("candidate"), "total")
    weight = seen.join(totals, "candidate").withColumn("w", F.col("prior") * mechanism.factor() / F.col("total"))
    return weight.select("output", "candidate", (F.col("w") / F.sum("w").over(Window.partitionBy("output"))).alias("probability"))


def posterior_after(mechanism: HopMechanism, outputs: list[int], independent: bool, candidate_radius: int) -> DataFrame:
    """candidate, probability after a list of outputs: log prior and log likelihoods added up, around the first output.

    Keyed releases of one value repeat, so of them only different outputs count.
    """
    spark: SparkSession = mechanism.graph.nodes.sparkSession
    told = outputs if independent else list(dict.fromkeys(outputs))
    first = spark.createDataFrame([(told[0],)], "node_id long")
    near = settled(mechanism.graph.ball(first, candidate_radius).select("node_id"), "near")
    times = spark.createDataFrame([(o, told.count(o)) for o in dict.fromkeys(told)], "output long, times int")
    totals = mechanism.totals(near).select(F.col("source").alias("candidate"), "total")
    # Hops are the same both ways, so the balls of the outputs, as many as were told, hold those of the candidates.
    hops = mechanism.balls(times.select(F.col("output").alias("node_id"))).select(F.col("source").alias("output"), F.col("node_id").alias("candidate"), "hop")
    prior = mechanism.graph.nodes.select(F.col("node_id").alias("candidate"), F.log(F.col("prior").cast("double")).alias("lp"))
    to = mechanism.graph.nodes.select(F.col("node_id").alias("output"), "prior")
    pairs = totals.withColumn("o", F.explode(F.array(*(F.lit(o) for o in dict.fromkeys(told))))).withColumnRenamed("o", "output").join(F.broadcast(times.join(to, "output")), "output").join(hops, ["candidate", "output"], "left")
    like = F.col("times") * (F.log(F.col("prior").cast("double")) - F.coalesce("hop", F.lit(mechanism.radius)) * (mechanism.epsilon / 2) - F.log("total"))
    scores = settled(pairs.groupBy("candidate").agg(F.sum(like).alias("ll")).join(prior, "candidate").select("candidate", (F.col("ll") + F.col("lp")).alias("s")), "scores")
    most = scores.agg(F.max("s")).first()[0]
    scaled = scores.withColumn("e", F.exp(F.col("s") - F.lit(most)))
    total = scaled.agg(F.sum("e")).first()[0]
    return scaled.select("candidate", (F.col("e") / F.lit(total)).alias("probability"))


def attack(after: DataFrame, truth: int) -> DataFrame:
    """One row: candidates, top_guess, top_probability, truth_considered, truth_rank and truth_probability (null if not considered)."""
    hit = F.col("candidate") == truth
    found = after.agg(F.max(F.when(hit, F.col("probability")))).first()[0]  # one number
    p = F.lit(found).cast("double")
    before = (F.col("probability") > p) | ((F.col("probability") == p) & (F.col("candidate") < truth))
    top = F.min(F.struct(-F.col("probability"), F.col("candidate").alias("c")))["c"]
    return after.agg(
        F.count("*").alias("candidates"), top.alias("top_guess"), F.max("probability").alias("top_probability"), F.lit(found is not None).alias("truth_considered"), F.when(p.isNotNull(), (F.count_if(before) + 1).cast("int")).alias("truth_rank"), p.alias("truth_probability")
    )


def independent_releases(mechanism: HopMechanism, code: str, count: int, seed: int) -> list[int]:
    """Outputs of one code under fresh keys."""
    rng, name, dist = np.random.default_rng(seed), codes.canonical_text(code), mechanism.distribution_of(code)
    return [dist.sample(Key.from_bytes(rng.bytes(32)), b"subject", name.encode()) for _ in range(count)]


def keyed_releases(mechanism: HopMechanism, code: str, count: int, key: Key) -> list[int]:
    """Outputs of one code under one key: one value, count times."""
    return [mechanism.distribution_of(code).sample(key, b"subject", codes.canonical_text(code).encode())] * count


def scenario_summary(results: DataFrame) -> DataFrame:
    """scenario, runs, exact, median_rank, median_probability of attack rows."""
    return results.groupBy("scenario").agg(F.count("*").alias("runs"), F.count_if(F.col("truth_rank") == 1).alias("exact"), F.expr("percentile(truth_rank, 0.5)").alias("median_rank"), F.expr("percentile(truth_probability, 0.5)").alias("median_probability"))
