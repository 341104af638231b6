import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift import errors
from spindrift.functions import codes
from spindrift.operators import geometry, graph, measures, nodes, triangulation
from spindrift.operators.mechanism import HopMechanism
from spindrift.sources import artefact, directory
from tests.graphs import path

pytestmark = pytest.mark.filterwarnings("ignore::spindrift.errors.RadiusTooSmall")


def places(spark, points):
    return spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(points)], "node_id long, easting long, northing long")


def is_delaunay(points, triangles):
    for t in triangles:
        if max(t) < len(points):
            if any(triangulation._inside(*(points[k] for k in t), p) for p in points):
                return False
    return True


@pytest.mark.parametrize("seed", range(6))
def test_triangles_have_empty_circles(seed):
    rng = random.Random(seed)
    points = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(80)})
    t = triangulation.triangles(points)
    assert is_delaunay(points, t)
    edges = {tuple(sorted((a, b))) for c in t for a, b in ((c[0], c[1]), (c[1], c[2]), (c[2], c[0])) if max(a, b) < len(points)}
    assert {k for e in edges for k in e} == set(range(len(points)))


def test_tiles_give_the_edges_of_one_kernel(spark, monkeypatch):
    rng = random.Random(9)
    points = [(rng.randrange(100_000), rng.randrange(100_000)) for _ in range(400)]
    want = {(r.a, r.b) for r in geometry.delaunay_edges(places(spark, points)).collect()}
    monkeypatch.setattr(triangulation, "TILE_POINTS", 30)
    assert {(r.a, r.b) for r in geometry.delaunay_edges(places(spark, points)).collect()} == want


def test_tiles_of_a_grid_do_not_cross(spark, monkeypatch):
    monkeypatch.setattr(triangulation, "TILE_POINTS", 30)
    found = geometry.location_edges(spark.createDataFrame([(x * 10, y * 10) for x in range(24) for y in range(24)], "x long, y long")).collect()
    # Rows, columns and one diagonal of each square: of two, tiles that see other points could take both.
    assert sorted(abs(r.ax - r.bx) + abs(r.ay - r.by) for r in found) == [10] * (2 * 24 * 23) + [20] * 23 * 23


def test_no_kernel_takes_all_points(spark, monkeypatch):
    rng = random.Random(5)
    points = {(rng.randrange(100_000), rng.randrange(100_000)) for _ in range(6000)}
    rounds, settled = [], triangulation.settled

    def watched(df, name):
        out = settled(df, name)
        rounds.append(out.where("kind > 0").selectExpr("ax", "ay").distinct().count() if "kind" in out.columns else len(points))
        return out

    monkeypatch.setattr(triangulation, "settled", watched)
    monkeypatch.setattr(triangulation, "TILE_POINTS", 100)
    n = geometry.location_edges(spark.createDataFrame(sorted(points), "x long, y long")).count()
    hull = 3 * len(points) - 3 - n
    assert 3 < hull < 100
    # Rounds of 8, 4 and 2 tiles across leave fewer and fewer points; the last one has what two tiles' borders left.
    left = rounds[1:]
    assert left == sorted(left, reverse=True) and left[-1] == 0 and left[-2] < 0.15 * len(points)


def test_smallest_collinear_and_colocated(spark):
    edges = lambda pts: {(r.a, r.b) for r in geometry.delaunay_edges(places(spark, pts)).collect()}
    assert edges([(0, 0), (10, 0), (0, 10)]) == {(0, 1), (0, 2), (1, 2)}
    assert edges([(0, 0), (10, 0), (20, 0), (30, 0)]) == {(0, 1), (1, 2), (2, 3)}
    got = edges([(0, 0), (10, 0), (0, 10), (0, 0)])
    assert got == {(0, 1), (0, 2), (1, 2), (0, 3), (1, 3), (2, 3)}


def test_assembly_reconnects_what_the_cut_parts(spark):
    points = [(0, 0), (1000, 0), (0, 1000), (200_000, 0), (201_000, 0), (200_000, 1000)]
    at = places(spark, points)
    made = graph.assemble(at, 50)
    assert made.reconnected.count() == 1 and made.cut.count() >= 2
    assert graph.components(at, made.edges).select("component").distinct().count() == 1
    with pytest.raises(errors.GraphIntegrityError):
        graph.check_integrity(at, made.edges.where("metres < 50000"))
    with pytest.raises(errors.GraphIntegrityError):
        graph.check_integrity(at, made.edges.where("a <> 0 and b <> 0"))


def test_pruned_clusters_are_bridged(spark):
    rng = random.Random(0)
    points = [(rng.randrange(300), rng.randrange(300)) for _ in range(12)] + [(5000 + rng.randrange(300), rng.randrange(300)) for _ in range(12)]
    at = places(spark, points)
    made = graph.assemble(at, 0, alpha=3.0)
    assert made.pruned.count() > 0 and made.bridged.count() >= 1
    assert graph.components(at, made.edges).select("component").distinct().count() == 1


def test_bridges_are_the_minimum_spanning_forest(spark):
    rng = random.Random(4)
    at = places(spark, [(k, 0) for k in range(30)])
    kept = spark.createDataFrame([(k, k + 1) for k in range(0, 30, 3)], "a long, b long")
    cand = sorted({(a, b): rng.randrange(20) / 2 for a, b in ((rng.randrange(30), rng.randrange(30)) for _ in range(120)) if a < b}.items())
    got = {(r.a, r.b) for r in graph.bridges(at, kept, spark.createDataFrame([(a, b, m) for (a, b), m in cand], "a long, b long, metres double")).collect()}
    root = list(range(30))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for r in kept.collect():
        root[find(r.a)] = find(r.b)
    want = set()
    for (a, b), _ in sorted(cand, key=lambda e: (e[1], e[0])):
        if find(a) != find(b):
            root[find(a)] = find(b)
            want.add((a, b))
    assert got == want


def test_local_scale_with_colocated_places(spark):
    rng = random.Random(2)
    points = [(rng.randrange(5000), rng.randrange(5000)) for _ in range(60)] + [(10, 10)] * 9 + [(90_000, 90_000)]
    got = {r.node_id: r.scale for r in geometry.local_scale(places(spark, points)).collect()}
    for k, (x, y) in enumerate(points):
        near = sorted(np.hypot(x - u, y - v) for j, (u, v) in enumerate(points) if j != k)[:6]
        assert abs(got[k] - np.median(near)) < 1e-6
    two = {r.node_id: r.scale for r in geometry.local_scale(places(spark, [(0, 0), (3, 4)])).collect()}
    assert two == {0: 5.0, 1: 5.0}


# -- codes, directories, priors -----------------------------------------------------------------


def test_codes(spark):
    raw = [" ls2 9jt ", "LS29JT", "ls2 9jt", "", "ABC", "A", "LS29JTXXX", None, "a1 1aa"]
    got = [r[0] for r in spark.createDataFrame([(i, r) for i, r in enumerate(raw)], "i int, r string").orderBy("i").select(codes.canonical(F.col("r"))).collect()]
    assert got == ["LS2 9JT"] * 3 + [None] * 5 + ["A1 1AA"]
    for r, want in zip(raw, got, strict=True):
        if r is not None and want is None:
            with pytest.raises(errors.InvalidPlaceCode):
                codes.canonical_text(r)
        elif r is not None:
            assert codes.canonical_text(r) == want
    parts = spark.createDataFrame([("AB12 3GQA",), ("AB12 3GQ",)], "r string").select(codes.population_code(F.col("r")).alias("c")).collect()
    assert [r.c for r in parts] == ["AB12 3GQ"] * 2


HEADER = "pcds,doterm,east1m,north1m,usrtypind,oa21cd,lat,long,lsoa21cd,ruc21ind,ctry26cd"


def gb(code, e, n, lat, long, **kw):
    d = {"doterm": "", "usrtypind": "0", "oa21cd": "E1", "lsoa21cd": "L1", "ruc21ind": "UN1", "ctry26cd": "E92"} | kw
    return f'"{code}",{d["doterm"]},{e},{n},{d["usrtypind"]},{d["oa21cd"]},{lat},{long},{d["lsoa21cd"]},{d["ruc21ind"]},{d["ctry26cd"]}'


LEEDS = (428000, 433000, 53.792, -1.5764)


def file(tmp_path, rows, header=HEADER, name="ONSPD_AUG_2026.csv"):
    (tmp_path / name).write_bytes(b"\xef\xbb\xbf" + "\n".join([header, *rows, ""]).encode())
    return str(tmp_path / name)


def leeds(code, k=0, **kw):
    e, n, lat, long = LEEDS
    return gb(code, e + 60 * k, f"0{n + 30 * (k * k % 13)}", lat, long, **kw)


def test_directory(spark, tmp_path):
    rows = [leeds("LS2 9JT"), leeds("ls1 1aa", 1), leeds("LS3 1AA", 2, doterm="201907"), leeds("LS4 1AA", 3, usrtypind="1"), gb("LS5 1AA", "", "", "", ""), gb("LS6 1AA", 0, 0, 53, -1), gb("LS7 1AA", 999999, 5, 53, -1), gb("BT1 1DA", 333759, 374365, 54.599803, -5.931046)]
    d = directory.read_directory(spark, file(tmp_path, rows))
    got = {r.code: (r.node_id, r.easting, r.northing) for r in d.nodes.collect()}
    assert [c for c, _ in sorted(got.items(), key=lambda x: x[1])] == ["BT1 1DA", "LS1 1AA", "LS2 9JT"]
    assert abs(got["BT1 1DA"][1] - 146196) < 200 and abs(got["BT1 1DA"][2] - 529842) < 200
    assert got["LS2 9JT"][1:] == (428000, 433000)
    assert d.rows_read == 8 and d.dropped == {"terminated": 1, "large_user": 1, "no_grid_reference": 1, "outside_national_grid": 2}
    assert [r.code for r in d.excluded.collect()] == ["LS4 1AA"]
    assert directory.read_directory(spark, file(tmp_path, rows, name="b.csv"), gb_only=True).dropped["northern_ireland"] == 1
    with pytest.raises(errors.DirectorySchemaError, match="east1m, north1m"):
        directory.read_directory(spark, file(tmp_path, rows, HEADER.replace("east1m,north1m", "oseast1m,osnrth1m"), "c.csv"))
    with pytest.raises(errors.DirectorySchemaError, match="contradict"):
        directory.read_directory(spark, file(tmp_path, [gb("LS1 1AA", 100000, 100000, 53.817875, -1.574508)], name="d.csv"))
    with pytest.raises(errors.InvalidPlaceCode):
        directory.read_directory(spark, file(tmp_path, [leeds("X", doterm="201901")], name="e.csv"))


def test_priors(spark, tmp_path):
    (tmp_path / "a.csv").write_text("GEOGRAPHY_CODE,OBS_VALUE\nE1,60\nE1,41\n,7\nE3\n")
    (tmp_path / "p.csv").write_text("Postcode,UsualResidentPopulation\nAB12 3GQA,5\nAB12 3GQB,7\n")
    by_area = directory.read_pairs(spark, [str(tmp_path / "a.csv")])
    by_code = directory.read_pairs(spark, [str(tmp_path / "p.csv")], codes.population_code(F.col("raw")))
    at = spark.createDataFrame([(0, "AB12 3GQ", "E1"), (1, "B1 1AA", "E1"), (2, "C1 1AA", "E2")], "node_id long, code string, area string")
    w = nodes.population_prior(at, by_code, by_area)
    assert {r.node_id: (r.prior, r.origin) for r in w.collect()} == {0: (12, "code"), 1: (50, "area"), 2: (1, "none")}
    assert nodes.prior_coverage(w).first().asDict() == {"from_code": 1, "from_area": 1, "unmatched": 1, "total": 3}
    with pytest.raises(ValueError):
        nodes.population_prior(at, None, None)


def test_numbers_over_partitions(spark):
    df = spark.range(5000).selectExpr("lpad(cast((id * 7919) % 5000 as string), 5, '0') AS code", "id % 7 AS v").repartition(13)
    rows = nodes.numbered(df, ["code"]).orderBy("code").collect()
    assert [r.node_id for r in rows] == list(range(5000))
    run = nodes.running(df, ["code"], "v", "s").orderBy("code").collect()
    assert [r.s for r in run] == np.cumsum([r.v for r in rows]).tolist()


def test_releases_and_addresses(spark):
    f = spark.createDataFrame([("1", "ONS Postcode Directory (May 2026) for the UK", 5), ("2", "ONS Postcode Directory (August 2026) for the UK", 9), ("3", "ONS Postcode Directory (August 2026) User Guide", 11)], "id string, title string, created long")
    assert directory.choose_latest(f).first().id == "2"
    with pytest.raises(errors.NoRelease):
        directory.choose_latest(f.where("id = '3'"))
    assert directory.checked_url("https://www.arcgis.com/x")
    for bad in ("http://www.arcgis.com/x", "https://evil.com/x", "https://www.arcgis.com@evil.com/"):
        with pytest.raises(ValueError):
            directory.checked_url(bad)


# -- artefacts and measures ---------------------------------------------------------------------


def test_artefact_round_trip(spark, tmp_path):
    g = path(spark, 20, lambda i: i + 1, excluded=["ZZ9 9ZZ"])
    artefact.save_graph(g, f"{tmp_path}/g", artefact.Provenance(source="x", populations=[artefact.PopulationSource("a", "area", "0")]))
    back = artefact.load_graph(spark, f"{tmp_path}/g")
    assert artefact.digest(back) == artefact.digest(g)
    assert artefact.Provenance.from_metadata(back.meta["provenance"]).populations[0].role == "area"
    with pytest.raises(FileExistsError):
        artefact.save_graph(g, f"{tmp_path}/g", artefact.Provenance())
    meta = json.loads((tmp_path / "g/metadata.json").read_text())
    (tmp_path / "g/metadata.json").write_text(json.dumps(meta | {"schema_version": 99}))
    (tmp_path / "g/.metadata.json.crc").unlink(missing_ok=True)
    with pytest.raises(errors.ArtefactVersionError):
        artefact.load_graph(spark, f"{tmp_path}/g")
    assert artefact.source_year("ONSPD_AUG_2026.csv") == 2026 and "2026" in artefact.attribution(2026)[0]


def test_calibration_meets_its_target(spark):
    g = path(spark, 40, step=1000)
    got = measures.calibrate(g, "max-self-probability", 0.3, sample_size=4, steps=7)
    assert got.reached and got.achieved <= 0.3 and got.achieved > 0.2
    far = measures.calibrate(g, "median-displacement-km", 5000.0, sample_size=2, steps=2)
    assert not far.reached
    with pytest.raises(errors.UnknownTarget):
        measures.calibrate(g, "nothing", 1)


def test_comparison_with_truncation(spark):
    g = path(spark, 40, step=1000, code=lambda i: f"A{1 + i // 20} {i % 10}{'AB'[i // 10 % 2]}A")
    epsilon, km = measures.equivalent_epsilon(g, "A1 0AA", steps=6)
    assert 0.05 < epsilon < 50 and abs(km - np.mean(np.arange(20))) < 1e-9
    lone = path(spark, 3, step=1000, code=lambda i: f"{'ABC'[i]}1 1AA")
    with pytest.raises(ValueError, match="alone"):
        measures.equivalent_epsilon(lone, "A1 1AA")


def test_attacks_learn_from_independent_releases_alone(spark):
    m = HopMechanism(path(spark, 60, step=500), 2.0, 8)
    many = measures.independent_releases(m, "A030 1AA", 20, 0)
    strong = measures.attack(measures.posterior_after(m, many, True, 10), 30).first()
    from spindrift.functions.exact import Key

    keyed = measures.keyed_releases(m, "A030 1AA", 20, Key.from_bytes(bytes(32)))
    weak = measures.attack(measures.posterior_after(m, keyed, False, 10), 30).first()
    once = measures.attack(measures.posterior_after(m, keyed[:1], True, 10), 30).first()
    assert strong.truth_probability > weak.truth_probability
    assert abs(weak.truth_probability - once.truth_probability) < 1e-12
    away = measures.attack(measures.posterior_after(m, [0], True, 2), 50).first()
    assert not away.truth_considered and away.truth_rank is None


def test_stratified_samples_share_one_stream(spark):
    groups = spark.createDataFrame([(i, "urban" if i < 12 else "rural" if i < 17 else "unclassified") for i in range(24)], "node_id long, `group` string")
    sample, notes = measures.stratified_sample(groups, 8, 0)
    rng = np.random.default_rng(0)
    want = {("rural", 12 + int(k)) for k in rng.choice(5, 5, replace=False)} | {("urban", int(k)) for k in rng.choice(12, 8, replace=False)}
    assert {(r.group, r.node_id) for r in sample.collect()} == want
    assert notes == ["rural has 5 of 8"]


def test_quoted_line_breaks_stay_in_their_cell(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,place\n1,"one\ntwo ""three"""\n2,"four, five"\n')
    got = directory.read_records(spark, f"{tmp_path}/a.csv").collect()
    assert [(r.id, r.place) for r in got] == [("1", 'one\ntwo "three"'), ("2", "four, five")]
    (tmp_path / "b.csv").write_text('id,place\n1,"a ""b"" c"\n')
    assert directory.read_records(spark, f"{tmp_path}/b.csv").first().place == 'a "b" c'


def test_messages_of_key_errors_have_no_quotes():
    from spindrift.errors import LargeUserCode, UnknownPlaceCode

    assert str(UnknownPlaceCode("no such code")) == "no such code"
    assert str(LargeUserCode("one organisation")) == "one organisation"
    assert isinstance(UnknownPlaceCode("x"), KeyError)


def test_induced_edges_and_neighbours(spark):
    from spindrift.operators import geometry, graph

    nodes = spark.createDataFrame([(0, 0, 0), (1, 10, 0), (2, 20, 0), (3, 10, 90), (4, 10, 40)], "node_id long, easting long, northing long")
    edges = spark.createDataFrame([(0, 1), (1, 2), (1, 3), (1, 4), (0, 2)], "a long, b long")
    measured = geometry.edge_lengths(edges, nodes)
    got = graph.induced(nodes, measured, 10, 0, 11, 50, 15.0).select("a", "b").collect()
    assert sorted(map(tuple, got)) == [(0, 1), (1, 2)]
    assert sorted(r.node_id for r in graph.neighbours(edges, 1).collect()) == [0, 2, 3, 4]


def test_quantiles_of_a_group_over_many_parts(spark):
    import numpy as np

    from spindrift.operators.mechanism import ball_quantiles, weighted_quantiles

    rng = np.random.default_rng(4)
    rows = [("hot" if k % 10 else f"g{k % 70}", float(rng.integers(0, 400)), int(rng.integers(0, 9))) for k in range(6000)] + [("none", 3.0, 0)]
    df = spark.createDataFrame(rows, "g string, v double, w long")
    q = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 1.0}
    got = {r.g: tuple(r)[1:] for r in weighted_quantiles(df, ["g"], "v", "w", q).collect()}
    for g in {r[0] for r in rows}:
        mine = sorted((v, w) for h, v, w in rows if h == g)
        total = sum(w for _, w in mine)
        run = np.cumsum([w for _, w in mine])
        assert got[g] == tuple(mine[int(np.argmax(run >= x * total))][0] if total else 0.0 for x in q.values())
    assert got == {r.g: tuple(r)[1:] for r in ball_quantiles(df, ["g"], "v", "w", q).collect()}


def test_equivalents_of_a_sample_are_those_of_single_codes(spark):
    from pyspark.sql import functions as F

    from spindrift.operators import measures
    from tests.graphs import path

    g = path(spark, 60, code=lambda i: f"B{i // 6:02d} {i % 6}AA", step=700)
    groups = g.nodes.select("node_id", F.when(F.col("node_id") < 30, "urban").otherwise("rural").alias("group"))
    got, notes = measures.equivalent_epsilons(g, groups, 2, 0)
    rows = got.join(g.nodes.select("node_id", "code"), "node_id").collect()
    assert len(rows) == 4 and notes == []
    for r in rows[:2]:
        assert np.allclose(measures.equivalent_epsilon(g, r.code), (r.epsilon, r.truncation_km), rtol=1e-9)


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    from spindrift import tables

    class Asked:
        class conf:
            get = staticmethod(lambda name, other: other)

        class sparkContext:
            master, applicationId = "spark://somewhere:7077", "app"

    with pytest.raises(ValueError, match="checkpoint"):
        tables.shared_folder(Asked)


def test_bridges_and_components_by_arrays_and_by_joins(spark, monkeypatch):
    rng = np.random.default_rng(12)
    for n, m, k in ((1, 0, 0), (40, 15, 60), (300, 150, 500)):
        at = spark.createDataFrame([(i * 3,) for i in range(n)], "node_id long")
        ends = lambda size: [tuple(int(x) * 3 for x in sorted(rng.choice(n, 2, replace=False))) for _ in range(size)]  # noqa: B023, E731
        kept = spark.createDataFrame(ends(m), "a long, b long")
        cand = sorted({(int(rng.integers(1, 9)) * 1.0, *e) for e in ends(k)})
        # Shortest first, by union and find.
        root = {i * 3: i * 3 for i in range(n)}

        def top(x):
            while root[x] != x:  # noqa: B023
                x = root[x]  # noqa: B023
            return x

        for r in kept.collect():
            x, y = sorted((top(r.a), top(r.b)))
            root[y] = x
        of = {x: top(x) for x in root}
        want = set()
        for metres, a, b in cand:
            x, y = sorted((top(a), top(b)))
            if x != y:
                root[y] = x
                want.add((a, b, metres))
        ways = spark.createDataFrame([(a, b, metres) for metres, a, b in cand], "a long, b long, metres double")
        counted, components = [], graph.components
        with monkeypatch.context() as patch:
            patch.setattr(graph, "components", lambda *x: counted.append(1) or components(*x))
            got = {tuple(r) for r in graph.bridges(at, kept, ways).select("a", "b", "metres").collect()}
            assert got == want and len(counted) == 1  # components of the graph once, not in each round
        assert {r.node_id: r.component for r in graph.components(at, kept).collect()} == of
        if n < 300:
            with monkeypatch.context() as patch:
                patch.setattr(graph, "LOCAL_EDGES", -1)
                assert {tuple(r) for r in graph.bridges(at, kept, ways).select("a", "b", "metres").collect()} == want
                assert {r.node_id: r.component for r in graph.components(at, kept).collect()} == of
