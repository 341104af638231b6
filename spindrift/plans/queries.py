"""Queries over the derived geography, each with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import codes, exact
from spindrift.functions.exact import Key
from spindrift.operators import geometry, graph, measures, nodes
from spindrift.operators.mechanism import HopMechanism, hmac_sha256_hex, weighted_quantiles
from spindrift.plans import geography as geo
from spindrift.sources import directory
from spindrift.tables import settled

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
#: The mechanism derives its radius from epsilon and the priors, in the queries and in SQL; BALL is that of the plain balls.
EPSILON, BALL = 1.0, 6
TEST_KEY = bytes(range(32))


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH {geo.SQL} {sql}"
        return f

    return register


def mechanism(spark: SparkSession, sf_dir: str, epsilon: float = EPSILON) -> HopMechanism:
    return HopMechanism(geo.graph(spark, sf_dir), epsilon)


def ball_sql(radius: int, sources: str = "nodes") -> str:
    """SQL of reach(source, node_id, hop) within radius hops."""
    return f"""walk AS (SELECT node_id AS source, node_id, 0 AS hop FROM {sources} UNION SELECT w.source, s.dst, w.hop + 1 FROM walk w JOIN sym s ON w.node_id = s.src WHERE w.hop < {radius}),
reach AS MATERIALIZED (SELECT source, node_id, min(hop) AS hop FROM walk GROUP BY ALL)"""


def radius_sql(epsilon: float) -> str:
    return f"greatest(1, ceil(2 * ln(sum(prior)::DOUBLE / (min(prior)::DOUBLE / (1 - exp(-{epsilon / 2})) * 1e-6)) / {epsilon}))::INT"


def totals_sql(epsilon: float = EPSILON, sources: str = "nodes") -> str:
    """SQL of rad(radius), reach, near (with prior and weight) and totals(source, ball_size, tail_prior, ball_weight, tail_weight, total).

    The places stand in a lattice of 50 columns by their ids, so hops are the differences of rows and columns: no walk
    over edges, which is how the operators find them.
    """
    return f"""rad AS MATERIALIZED (SELECT {radius_sql(epsilon)} AS radius FROM nodes),
reach AS MATERIALIZED (SELECT s.node_id AS source, t.node_id AS node_id, abs(s.node_id // 50 - t.node_id // 50) + abs(s.node_id % 50 - t.node_id % 50) AS hop FROM {sources} s, nodes t WHERE abs(s.node_id // 50 - t.node_id // 50) + abs(s.node_id % 50 - t.node_id % 50) < (SELECT radius FROM rad)),
near AS MATERIALIZED (SELECT r.*, prior, easting AS x, northing AS y, area, prior * exp(-{epsilon / 2} * hop) AS w FROM reach r JOIN nodes USING (node_id)),
half AS (SELECT source, count(*) AS ball_size, (SELECT sum(prior) FROM nodes) - sum(prior) AS tail_prior, sum(w) AS ball_weight, exp(-{epsilon / 2} * (SELECT radius FROM rad)) AS least FROM near GROUP BY source),
totals AS MATERIALIZED (SELECT *, tail_prior * least AS tail_weight, ball_weight + tail_prior * least AS total FROM half)"""


def displacement_sql(epsilon: float = EPSILON) -> str:
    return f"""{totals_sql(epsilon)}, far AS (SELECT n.*, sqrt((n.x - s.easting)::DOUBLE ** 2 + (n.y - s.northing)::DOUBLE ** 2) / 1000 AS km FROM near n JOIN nodes s ON n.source = s.node_id),
ran AS MATERIALIZED (SELECT *, sum(w) OVER (PARTITION BY source ORDER BY km, node_id ROWS UNBOUNDED PRECEDING) AS run, sum(w) OVER (PARTITION BY source) AS allw FROM far),
disp AS MATERIALIZED (SELECT source, sum(km * w) / sum(w) AS mean_km, min(km) FILTER (run >= 0.5 * allw * (1 - 1e-12)) AS median_km, min(km) FILTER (run >= 0.95 * allw * (1 - 1e-12)) AS p95_km FROM ran GROUP BY source),
own AS MATERIALIZED (SELECT t.*, d.mean_km, d.median_km, d.p95_km, n.prior / total AS self_probability, tail_weight / total AS teleport_probability, n.area, n.grp FROM totals t JOIN disp d USING (source) JOIN nodes n ON n.node_id = t.source)"""


def r9(name: str) -> F.Column:
    return F.round(name, 9).alias(name)


def all_nodes(m: HopMechanism) -> DataFrame:
    return m.graph.nodes.select("node_id")


# -- codes and the directory --------------------------------------------------------------------


@query("SELECT row_no, code FROM spelt WHERE code IS NOT NULL")
def canonical_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.raw_directory(spark, sf_dir).select("row_no", codes.canonical(F.col("pcds")).alias("code")).where("code is not null")


@query("SELECT k, length(upper(replace(c, ' ', ''))) BETWEEN 5 AND 7 AS valid FROM (SELECT k, repeat(code, (k % 3)::INT) AS c FROM base)")
def invalid_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    spelt = geo.places(spark, sf_dir).select("k", codes.canonical(F.repeat("code", (F.col("k") % 3).cast("int"))).alias("c"))
    return spelt.select("k", F.col("c").isNotNull().alias("valid"))


@query("SELECT coalesce(reason, 'kept') AS reason, count(*) AS n FROM dropped GROUP BY 1")
def drop_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = directory.classified(geo.raw_directory(spark, sf_dir))
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT code, east1m::BIGINT AS easting, north1m::BIGINT AS northing, oa21cd AS area FROM dropped WHERE reason IS NULL")
def usable_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = directory.classified(geo.raw_directory(spark, sf_dir)).where("reason is null")
    return rows.select("code", F.col("east1m").cast("long").alias("easting"), F.col("north1m").cast("long").alias("northing"), F.col("oa21cd").alias("area"))


@query("SELECT CASE WHEN reason IS NULL OR reason <> 'terminated' THEN CASE WHEN starts_with(code, 'BT') THEN 'northern_ireland' ELSE coalesce(reason, 'kept') END ELSE reason END AS reason, count(*) AS n FROM dropped GROUP BY 1")
def drop_reason_counts_gb_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = directory.classified(geo.raw_directory(spark, sf_dir), gb_only=True)
    return rows.groupBy(F.coalesce("reason", F.lit("kept")).alias("reason")).agg(F.count("*").alias("n"))


@query("SELECT DISTINCT code FROM dropped WHERE reason = 'large_user'")
def excluded_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.classified(geo.raw_directory(spark, sf_dir)).where("reason = 'large_user'").select("code").distinct()


@query("SELECT node_id, code FROM nodes")
def node_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.nodes(spark, sf_dir).select("node_id", "code")


@query("SELECT node_id, prior, (sum(prior) OVER (ORDER BY node_id))::BIGINT AS prior_cum FROM nodes")
def prior_cumulative(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.cumulative_prior(geo.nodes(spark, sf_dir)).select("node_id", "prior", "prior_cum")


_POPULATION = """by_code AS (SELECT code, prior * 3 AS value FROM nodes WHERE grp = 'ASIA'), by_area AS (SELECT n_name AS area, count(*) AS value FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name <> 'EUROPE' GROUP BY 1),
weighted AS (SELECT node_id, CASE WHEN c.value IS NOT NULL THEN 'code' WHEN a.value IS NOT NULL THEN 'area' ELSE 'none' END AS origin, greatest(coalesce(c.value, a.value // s.n, 0), 1)::BIGINT AS prior
    FROM nodes LEFT JOIN by_code c USING (code) LEFT JOIN by_area a USING (area) LEFT JOIN (SELECT area, count(*) AS n FROM nodes GROUP BY area) s USING (area))"""


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = geo.nodes(spark, sf_dir)
    by_code = at.where("grp = 'ASIA'").select(F.col("code").alias("key"), (F.col("prior") * 3).alias("value"))
    n = geo.table(spark, sf_dir, "nation").join(geo.table(spark, sf_dir, "region").where("r_name <> 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    of = geo.table(spark, sf_dir, "orders").join(geo.table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey"))
    by_area = of.groupBy(F.col("n_name").alias("key")).agg(F.count("*").alias("value"))
    return nodes.population_prior(at.drop("prior"), by_code, by_area)


@query(f", {_POPULATION} SELECT node_id, prior, origin FROM weighted")
def prior_two_level(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _weighted(spark, sf_dir).select("node_id", "prior", "origin")


@query(f", {_POPULATION} SELECT count(*) FILTER (origin = 'code') AS from_code, count(*) FILTER (origin = 'area') AS from_area, count(*) FILTER (origin = 'none') AS unmatched, count(*) AS total FROM weighted")
def prior_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.prior_coverage(_weighted(spark, sf_dir))


@query("SELECT row_no, CASE WHEN s.code IS NULL THEN 'invalid' WHEN n.node_id IS NOT NULL THEN 'ok' WHEN e.code IS NOT NULL THEN 'large_user' ELSE 'unknown' END AS status, node_id FROM spelt s LEFT JOIN nodes n USING (code) LEFT JOIN (SELECT code FROM base WHERE large) e ON s.code = e.code")
def code_lookup_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geo.graph(spark, sf_dir)
    return nodes.looked_up(geo.raw_directory(spark, sf_dir), "pcds", g.nodes, g.excluded).select("row_no", "status", "node_id")


@query("SELECT node_id, coalesce(l.oa, '') AS oa21cd FROM nodes LEFT JOIN (SELECT code, max_by(oa21cd, row_no) AS oa FROM spelt GROUP BY code) l USING (code)")
def aligned_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return directory.aligned(geo.nodes(spark, sf_dir), geo.raw_directory(spark, sf_dir), ["oa21cd"]).select("node_id", "oa21cd")


@query("SELECT k, CASE WHEN trim(i) = '' OR starts_with(c, 'N') THEN 'unclassified' WHEN left(i, 1) IN ('1', '2', 'U') THEN 'urban' ELSE 'rural' END AS grp FROM (SELECT k, CASE k % 6 WHEN 0 THEN '' WHEN 1 THEN '1' WHEN 2 THEN '2a' WHEN 3 THEN 'UN1' WHEN 4 THEN 'RLF' ELSE '7' END AS i, CASE WHEN k % 5 = 0 THEN 'N92' ELSE 'E92' END AS c FROM base)")
def settlement_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("k")
    i = F.when(k % 6 == 0, "").when(k % 6 == 1, "1").when(k % 6 == 2, "2a").when(k % 6 == 3, "UN1").when(k % 6 == 4, "RLF").otherwise("7")
    return geo.places(spark, sf_dir).select("k", codes.settlement(i, F.when(k % 5 == 0, "N92").otherwise("E92")).alias("grp"))


# -- geometry and graphs ------------------------------------------------------------------------

_LENGTHS = "measured AS MATERIALIZED (SELECT a, b, sqrt((p.easting - q.easting)::DOUBLE ** 2 + (p.northing - q.northing)::DOUBLE ** 2) AS metres FROM edges JOIN nodes p ON a = p.node_id JOIN nodes q ON b = q.node_id)"


def _measured(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = geo.nodes(spark, sf_dir)
    return at, geometry.edge_lengths(geo.lattice(at), at)


@query(f", {_LENGTHS} SELECT a, b, round(metres, 6) AS metres FROM measured")
def edge_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(spark, sf_dir)[1].select("a", "b", F.round("metres", 6).alias("metres"))


@query(f", {_LENGTHS} SELECT a, b, metres > 300000 AS cut FROM measured")
def long_edge_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, cut = geometry.cut_long(_measured(spark, sf_dir)[1], 300)
    return kept.select("a", "b", F.lit(False).alias("cut")).union(cut.select("a", "b", F.lit(True).alias("cut")))


@query(", d AS (SELECT node_id, count(src) AS degree FROM nodes LEFT JOIN sym ON src = node_id GROUP BY node_id) SELECT count(*) AS nodes, sum(degree)::BIGINT AS ends, avg(degree) AS mean_degree, max(degree) AS max_degree, count(*) FILTER (degree = 0) AS isolated FROM d")
def degree_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = geo.nodes(spark, sf_dir)
    return graph.degree_summary(at, geo.lattice(at))


@query("SELECT DISTINCT least(p.node_id, q.node_id) AS a, greatest(p.node_id, q.node_id) AS b FROM edges JOIN nodes i ON a = i.node_id JOIN nodes j ON b = j.node_id JOIN nodes p ON (p.easting, p.northing) = (i.easting, i.northing) JOIN nodes q ON (q.easting, q.northing) = (j.easting, j.northing) WHERE p.node_id <> q.node_id UNION SELECT p.node_id, q.node_id FROM nodes p JOIN nodes q ON (p.easting, p.northing) = (q.easting, q.northing) AND p.node_id < q.node_id")
def colocated_lift(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = geo.nodes(spark, sf_dir)
    spot = lambda k: at.select(F.col("node_id").alias(k), F.col("easting").alias(f"{k}x"), F.col("northing").alias(f"{k}y"))
    between = geo.lattice(at).join(spot("a"), "a").join(spot("b"), "b").select("ax", "ay", "bx", "by").distinct()
    return geometry.lifted(between, at).where("a <> b")


_SCALE = """gaps AS (SELECT p.node_id, sqrt((p.easting - q.easting)::DOUBLE ** 2 + (p.northing - q.northing)::DOUBLE ** 2) AS d FROM nodes p JOIN nodes q ON p.node_id <> q.node_id),
nearest AS (SELECT node_id, d FROM gaps QUALIFY row_number() OVER (PARTITION BY node_id ORDER BY d) <= 6), scales AS MATERIALIZED (SELECT node_id, quantile_cont(d, 0.5) AS scale FROM nearest GROUP BY node_id)"""


@query(f", {_SCALE} SELECT node_id, round(scale, 6) AS scale FROM scales")
def knn_local_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.local_scale(geo.nodes(spark, sf_dir)).select("node_id", F.round("scale", 6).alias("scale"))


@query(f", {_SCALE}, {_LENGTHS} SELECT a, b, metres > 3.0 * greatest(s.scale, t.scale) AS pruned FROM measured JOIN scales s ON a = s.node_id JOIN scales t ON b = t.node_id")
def adaptive_prune(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, measured = _measured(spark, sf_dir)
    return geometry.prune_long(measured, geometry.local_scale(at)).select("a", "b", "pruned")


def _short(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    at, measured = _measured(spark, sf_dir)
    return (at, *geometry.cut_long(settled(measured, "measured"), 300))


@query(f""", {_LENGTHS}, short AS MATERIALIZED (SELECT a AS src, b AS dst FROM measured WHERE metres <= 300000 UNION ALL SELECT b, a FROM measured WHERE metres <= 300000),
flood AS (SELECT node_id, node_id AS seed FROM nodes UNION SELECT s.dst, f.seed FROM flood f JOIN short s ON f.node_id = s.src) SELECT node_id, min(seed) AS component FROM flood GROUP BY node_id""")
def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, kept, _ = _short(spark, sf_dir)
    return graph.components(at, kept)


@query()
def bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    at, kept, cut = _short(spark, sf_dir)
    return graph.bridges(at, kept, cut).select("a", "b", F.round("metres", 6).alias("metres"))


@query()
def delaunay_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.delaunay_edges(geo.nodes(spark, sf_dir))


@query()
def assembled_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = graph.assemble(geo.nodes(spark, sf_dir), alpha=geometry.ALPHA)
    kind = lambda df, name: df.select("a", "b", F.round("metres", 6).alias("metres"), F.lit(name).alias("kind"))
    return kind(made.edges, "edge").union(kind(made.cut, "cut")).union(kind(made.reconnected, "reconnected")).union(kind(made.pruned, "pruned")).union(kind(made.bridged, "bridge"))


@query(f", {_LENGTHS}, inside AS (SELECT node_id FROM nodes WHERE abs(easting - 350000) < 200000 AND abs(northing - 650000) < 400000) SELECT a, b FROM measured WHERE metres <= 300000 AND a IN (SELECT node_id FROM inside) AND b IN (SELECT node_id FROM inside)")
def induced_subgraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.induced(*_measured(spark, sf_dir), 350000, 650000, 200000, 400000, 300000).select("a", "b")


# -- balls and the mechanism --------------------------------------------------------------------


@query(f", {ball_sql(BALL)} SELECT source, hop, count(*) AS nodes FROM reach GROUP BY ALL")
def ball_shells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geo.graph(spark, sf_dir)
    return graph.ball(g.nodes, g.edges, BALL).groupBy("source", "hop").agg(F.count("*").alias("nodes"))


@query(f", {totals_sql()} SELECT source, hop, sum(prior)::BIGINT AS prior FROM near GROUP BY ALL")
def shell_priors(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    return m.shells(all_nodes(m)).select("source", "hop", "prior")


@query(f", {ball_sql(3)} SELECT source AS a, node_id AS b, hop AS hops FROM reach")
def hop_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geo.graph(spark, sf_dir)
    return graph.hop_distances(g.nodes, g.edges, 3)


_FIRST = "one AS (SELECT min(node_id) AS node_id FROM nodes)"


@query(f", {_FIRST}, {totals_sql(sources='one')} SELECT n.node_id AS node_id, hop, round(n.prior * exp(-{EPSILON / 2} * coalesce(hop, (SELECT radius FROM rad))) / total, 9) AS probability FROM nodes n CROSS JOIN totals t LEFT JOIN reach r ON r.node_id = n.node_id")
def distribution_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    one = m.graph.nodes.agg(F.min("node_id").alias("node_id"))
    return m.distribution(one).select("node_id", "hop", r9("probability"))


@query(f", {totals_sql()} SELECT source, ball_size, round(tail_weight / total, 9) AS teleport_probability, round(n.prior / total, 9) AS self_probability FROM totals JOIN nodes n ON n.node_id = source")
def self_teleport(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    return m.report(all_nodes(m)).select("source", "ball_size", r9("teleport_probability"), r9("self_probability"))


@query(f", {totals_sql()} SELECT a, b, round(p.prior * exp(-{EPSILON / 2}) / t.total, 9) AS probability FROM edges JOIN totals t ON t.source = a JOIN nodes p ON p.node_id = b")
def probability_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    return m.edge_probabilities().select("a", "b", r9("probability"))


_EPSILONS = (0.3, 0.5, 1.0, 2.0)
_EPSILON_SQL = "e(epsilon) AS (VALUES " + ", ".join(f"({e}::DOUBLE)" for e in _EPSILONS) + "), s AS (SELECT sum(prior)::DOUBLE AS total, min(prior)::DOUBLE AS least FROM nodes)"


def _by_epsilon(spark: SparkSession, sf_dir: str, f: Callable[..., float], kind: str, out: str) -> DataFrame:
    s = geo.nodes(spark, sf_dir).agg(F.sum("prior").alias("t"), F.min("prior").alias("l")).first()
    return spark.createDataFrame([(e, f(epsilon=e, total_prior=s["t"], min_prior=s["l"])) for e in _EPSILONS], f"epsilon double, {out} {kind}")


@query(f", {_EPSILON_SQL} SELECT epsilon, greatest(1, ceil(2 * ln(total / (least / (1 - exp(-epsilon / 2)) * 1e-6)) / epsilon))::INT AS radius FROM e, s")
def radius_by_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_epsilon(spark, sf_dir, exact.radius_for, "int", "radius")


@query(f", {_EPSILON_SQL} SELECT epsilon, round(total * exp(-epsilon / 2 * {BALL}) / (least / (1 - exp(-epsilon / 2))), 6) AS bound FROM e, s")
def teleport_bound(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_epsilon(spark, sf_dir, lambda **k: round(exact.teleport_bound(**k, radius=BALL), 6), "double", "bound")


_PADS = [bytes(b ^ x for b in TEST_KEY.ljust(64, b"\0")).hex() for x in (0x5C, 0x36)]


@query(f"SELECT node_id, sha256(unhex('{_PADS[0]}') || unhex(sha256(unhex('{_PADS[1]}') || encode(code)))) AS mac FROM nodes")
def hmac_hex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geo.nodes(spark, sf_dir).select("node_id", hmac_sha256_hex(TEST_KEY, F.encode("code", "UTF-8")).alias("mac"))


def _released(spark: SparkSession, sf_dir: str, policy: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    people = geo.table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").cast("string").alias("subject"), geo.code_of(F.col("o_custkey")).alias("code"))
    return m.perturb_frame(people, "code", "subject", Key.from_bytes(TEST_KEY), on_error=policy)


@query()
def perturb_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _released(spark, sf_dir, "null")


@query()
def perturb_drop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _released(spark, sf_dir, "drop").drop("code")


@query("SELECT count(*) AS rows_in, count(n.code) AS rows_out, count(*) - count(n.code) AS rows_failed, count(DISTINCT b.code) AS distinct_codes FROM orders JOIN base b ON b.k = o_custkey LEFT JOIN nodes n ON n.code = b.code")
def perturb_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _released(spark, sf_dir, "null").agg(F.count("*").alias("rows_in"), F.count("place_dp").alias("rows_out"), F.count_if(F.col("place_dp").isNull()).alias("rows_failed"), F.count_distinct("code").alias("distinct_codes"))


# -- measures -----------------------------------------------------------------------------------


@query(f", {displacement_sql()} SELECT source, round(mean_km, 6) AS mean_km, round(median_km, 6) AS median_km, round(p95_km, 6) AS p95_km, round(self_probability, 9) AS self_probability, round(teleport_probability, 9) AS teleport_probability, ball_size FROM own")
def displacement_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    return measures.displacement(m, all_nodes(m)).select("source", *(F.round(c, 6).alias(c) for c in ("mean_km", "median_km", "p95_km")), r9("self_probability"), r9("teleport_probability"), "ball_size")


@query(", ran AS (SELECT area, easting, sum(prior) OVER (PARTITION BY area ORDER BY easting, node_id ROWS UNBOUNDED PRECEDING) AS run, sum(prior) OVER (PARTITION BY area) AS allw FROM nodes) SELECT area, (min(easting) FILTER (run >= 0.1 * allw))::DOUBLE AS p10, (min(easting) FILTER (run >= 0.5 * allw))::DOUBLE AS p50, (min(easting) FILTER (run >= 0.9 * allw))::DOUBLE AS p90 FROM ran GROUP BY area")
def weighted_quantile_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = geo.nodes(spark, sf_dir).select("area", F.col("easting").cast("double").alias("easting"), "prior")
    return weighted_quantiles(at, ["area"], "easting", "prior", {"p10": 0.1, "p50": 0.5, "p90": 0.9})


@query(f", {displacement_sql()} SELECT count(*) AS places, round(quantile_cont(median_km, 0.5), 6) AS median_km, round(quantile_cont(median_km, 0.95), 6) AS p95_km, round(max(median_km), 6) AS max_km, round(max(self_probability), 9) AS max_self_probability, round(max(teleport_probability), 9) AS max_teleport_probability FROM own")
def sample_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    return measures.sample_report(m, all_nodes(m)).select("places", *(F.round(c, 6).alias(c) for c in ("median_km", "p95_km", "max_km")), r9("max_self_probability"), r9("max_teleport_probability"))


def _kept_sql() -> str:
    return "kept AS MATERIALIZED (SELECT n.source, sum(CASE WHEN n.area = s.area THEN w ELSE 0 END) / any_value(t.total) AS area_preserved FROM near n JOIN nodes s ON s.node_id = n.source JOIN totals t ON t.source = n.source GROUP BY n.source)"


@query(f", {totals_sql()}, {_kept_sql()} SELECT source, round(area_preserved, 9) AS area_preserved FROM kept")
def area_preservation(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    return measures.area_preservation(m, all_nodes(m), m.graph.nodes.select("node_id", "area")).select("source", r9("area_preserved"))


def _summary_sql(epsilon: float, extra: str = "") -> str:
    return f'{displacement_sql(epsilon)}, {_kept_sql()} SELECT {extra}grp AS "group", count(*) AS "count", round(quantile_cont(median_km, 0.5), 6) AS median_km, round(quantile_cont(p95_km, 0.95), 6) AS p95_km, round(quantile_cont(area_preserved, 0.5), 9) AS area_preserved, round(quantile_cont(self_probability, 0.5), 9) AS median_self_probability FROM own JOIN kept USING (source) GROUP BY grp'


def _rounded_summary(df: DataFrame, *more: str) -> DataFrame:
    return df.select(*more, "group", "count", F.round("median_km", 6).alias("median_km"), F.round("p95_km", 6).alias("p95_km"), r9("area_preserved"), r9("median_self_probability"))


@query(f", {_summary_sql(EPSILON)}")
def group_utility(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    return _rounded_summary(measures.group_summary(m, m.graph.nodes.select("node_id", F.col("grp").alias("group")), m.graph.nodes.select("node_id", "area")))


@query()
def epsilon_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = geo.graph(spark, sf_dir)
    sample = g.nodes.select("node_id", F.col("grp").alias("group"))
    return _rounded_summary(measures.epsilon_table(g, sample, g.nodes.select("node_id", "area"), list(_EPSILONS)), "epsilon")


ORACLES["epsilon_translation"] = " UNION ALL ".join(f"SELECT * FROM (WITH {geo.SQL}, {_summary_sql(e, f'{e}::DOUBLE AS epsilon, ')})" for e in _EPSILONS)


@query("SELECT split_part(code, ' ', 1) AS outward, count(*) AS members, sum(prior)::BIGINT AS population FROM nodes GROUP BY 1")
def outward_population(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.outward_population(geo.nodes(spark, sf_dir))


@query(", o AS (SELECT *, split_part(code, ' ', 1) AS outward FROM nodes) SELECT s.node_id AS source, s.outward AS outward, count(*) AS district_size, round(sum(sqrt((s.easting - m.easting)::DOUBLE ** 2 + (s.northing - m.northing)::DOUBLE ** 2) / 1000 * m.prior) / sum(m.prior), 6) AS truncation_km FROM o s JOIN o m ON s.outward = m.outward GROUP BY ALL HAVING count(*) > 1")
def truncation_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return measures.truncation_error(geo.graph(spark, sf_dir)).withColumn("truncation_km", F.round("truncation_km", 6))


@query("SELECT least(greatest(easting // 5000, 0), 139) AS cell_x, least(greatest(northing // 5000, 0), 259) AS cell_y, sum(prior)::BIGINT AS population FROM nodes GROUP BY 1, 2")
def grid_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nodes.grid_density(geo.nodes(spark, sf_dir))


@query(f', {totals_sql()}, p AS (SELECT grp, n.prior / total AS p FROM totals JOIN nodes n ON n.node_id = source) SELECT grp AS "group", ' + ", ".join(f"round(quantile_cont(p, {q / 100}), 9) AS p{q}" for q in (10, 25, 50, 75, 90)) + " FROM p GROUP BY grp")
def exposure_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    rows = measures.exposure_percentiles(m, m.graph.nodes.select("node_id", F.col("grp").alias("group")))
    return rows.select("group", *(r9(f"p{q}") for q in (10, 25, 50, 75, 90)))


@query()
def calibrated_epsilon(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = measures.calibrate(geo.graph(spark, sf_dir), "max-self-probability", 0.2)
    return spark.createDataFrame([(got.target, got.epsilon, got.achieved, got.spread, got.sample_size, got.reached)], "target string, epsilon double, achieved double, spread double, sample_size int, reached boolean")


@query(f""", {totals_sql()}, back AS (SELECT r.source AS output, r.node_id AS candidate, r.prior * exp(-{EPSILON / 2} * hop) / t.total AS w FROM near r JOIN totals t ON t.source = r.node_id)
SELECT output, candidate, round(w / sum(w) OVER (PARTITION BY output), 9) AS probability FROM back""")
def posterior(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    return measures.posterior(m, all_nodes(m)).select("output", "candidate", r9("probability"))


#: Hops around the first output that an attacker looks at, and releases of a scenario.
WITHIN, RELEASES = 10, 20
_TOLD = [0, 1, 50, 1]
_AFTER = f"""{totals_sql()}, told(output, times) AS (VALUES (0, 1), (1, 2), (50, 1)), near0 AS (SELECT node_id FROM reach WHERE source = 0 AND hop <= {WITHIN}),
pairs AS (SELECT c.node_id AS candidate, o.output, times * (ln(n.prior) - {EPSILON / 2} * coalesce(r.hop, (SELECT radius FROM rad)) - ln(t.total)) AS ll FROM near0 c CROSS JOIN told o JOIN nodes n ON n.node_id = o.output JOIN totals t ON t.source = c.node_id LEFT JOIN reach r ON r.source = c.node_id AND r.node_id = o.output),
scores AS (SELECT candidate, sum(ll) + ln(any_value(n.prior)) AS s FROM pairs JOIN nodes n ON n.node_id = candidate GROUP BY candidate),
after AS MATERIALIZED (SELECT candidate, exp(s - (SELECT max(s) FROM scores)) / (SELECT sum(exp(s - (SELECT max(s) FROM scores))) FROM scores) AS probability FROM scores)"""


@query(f", {_AFTER} SELECT candidate, round(probability, 9) AS probability FROM after")
def posterior_after(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    return measures.posterior_after(m, _TOLD, True, WITHIN).select("candidate", r9("probability"))


@query(f""", {_AFTER}, ranked AS (SELECT *, row_number() OVER (ORDER BY probability DESC, candidate) AS r FROM after) SELECT count(*) AS candidates, max(candidate) FILTER (r = 1) AS top_guess, round(max(probability), 9) AS top_probability, bool_or(candidate = 1) AS truth_considered, (max(r) FILTER (candidate = 1))::INT AS truth_rank, round(max(probability) FILTER (candidate = 1), 9) AS truth_probability FROM ranked""")
def attack_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mechanism(spark, sf_dir)
    return measures.attack(measures.posterior_after(m, _TOLD, True, WITHIN), 1).withColumns({c: F.round(c, 9) for c in ("top_probability", "truth_probability")})


@query()
def attack_scenarios(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = HopMechanism(geo.graph(spark, sf_dir), 2.0)
    out = []
    for r in measures.sample_places(m.graph, 4, 0).orderBy("node_id").collect():
        free, keyed = measures.independent_releases(m, r["code"], RELEASES, 0), measures.keyed_releases(m, r["code"], RELEASES, Key.from_bytes(TEST_KEY))
        for name, outputs, independent in (("one", free[:1], True), ("independent", free, True), ("keyed", keyed, False)):
            out.append(measures.attack(measures.posterior_after(m, outputs, independent, WITHIN), r["node_id"]).withColumn("scenario", F.lit(name)))
    return measures.scenario_summary(reduce(DataFrame.union, out))
