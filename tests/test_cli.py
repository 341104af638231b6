import json
import os
import stat

import pytest

from spindrift import cli
from spindrift.functions.exact import Key
from spindrift.operators.mechanism import HopMechanism
from spindrift.sources import artefact
from spindrift.streaming.release import release_stream
from tests.graphs import path
from tests.test_graph import file, leeds

pytestmark = pytest.mark.filterwarnings("ignore::spindrift.errors.RadiusTooSmall")


@pytest.fixture
def built(spark, tmp_path):
    rows = [leeds(f"LS{k} 1AA", k, ruc21ind="UN1" if k < 6 else "RLN1", lsoa21cd=f"L{k // 3}") for k in range(1, 10)] + [leeds("LS9 9ZZ", 3, usrtypind="1")]
    source = file(tmp_path, rows)
    assert cli.main(["build", "--directory", source, "--out", f"{tmp_path}/g", "--uniform-prior"]) == 0
    return tmp_path, source


def test_commands(spark, built, capsys):
    tmp, source = built
    m = json.loads((tmp / "g.manifest.json").read_text())
    assert m["nodes"] == 9 and m["dropped"] == {"large_user": 1} and "2026" in m["attribution"][0]
    assert cli.main(["build", "--directory", source, "--out", f"{tmp}/g", "--uniform-prior"]) == 2
    assert cli.main(["build", "--directory", source, "--out", f"{tmp}/h"]) == 2
    assert cli.main(["keygen", "--out", f"{tmp}/key"]) == 0
    assert stat.S_IMODE(os.stat(f"{tmp}/key").st_mode) == 0o400 and len((tmp / "key").read_bytes()) == 32
    assert cli.main(["keygen", "--out", f"{tmp}/key"]) == 2
    (tmp / "people.csv").write_text("id,place,age\np1,LS1 1AA,41\np2,ls41aa,62\np3,LS9 9ZZ,19\n")
    common = ["--graph", f"{tmp}/g", "--epsilon", "1", "--code-col", "place", "--subject-col", "id", "--key-file", f"{tmp}/key"]
    assert cli.main(["perturb", f"{tmp}/people.csv", "--out", f"{tmp}/out.parquet", *common]) == 2
    assert "LS9" not in capsys.readouterr().err
    assert cli.main(["perturb", f"{tmp}/people.csv", "--out", f"{tmp}/out.parquet", *common, "--on-error", "null"]) == 3
    out = spark.read.parquet(f"{tmp}/out.parquet")
    assert out.columns == ["id", "age", "place_dp"] and out.where("place_dp is null").count() == 1
    assert json.loads((tmp / "out.parquet.manifest.json").read_text())["rows_failed"] == 1
    assert cli.main(["perturb", f"{tmp}/people.csv", "--out", f"{tmp}/out2.csv", *common, "--on-error", "drop", "--keep-source"]) == 3
    assert spark.read.csv(f"{tmp}/out2.csv", header=True).count() == 2
    assert cli.main(["perturb", f"{tmp}/people.csv", "--out", f"{tmp}/people.csv", *common]) == 2
    capsys.readouterr()
    assert cli.main(["perturb", "--key", "00ff", "x"]) == 2
    assert "00ff" not in capsys.readouterr().err
    assert cli.main(["report", "--graph", f"{tmp}/g", "--epsilon", "1", "--code", "LS4 1AA", "--json"]) == 0
    assert 0 < json.loads(capsys.readouterr().out)["self_probability"] < 1
    assert cli.main(["report", "--graph", f"{tmp}/g", "--epsilon", "1"]) == 2
    assert cli.main(["report", "--graph", f"{tmp}/g", "--epsilon", "1", "--sample", "4", "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["places"] == 4
    assert cli.main(["evaluate", "--graph", f"{tmp}/g", "--directory", source, "--epsilon", "1", "--per-group", "3", "--json"]) == 0
    assert [g["group"] for g in json.loads(capsys.readouterr().out)["groups"]] == ["rural", "urban"]
    assert cli.main(["calibrate", "--graph", f"{tmp}/g", "--target", "nothing", "--value", "1"]) == 2


def test_streams_release_like_batches(spark, tmp_path):
    m = HopMechanism(path(spark, 12), 1.0)
    key = Key.from_bytes(bytes(range(32)))
    rows = spark.createDataFrame([(f"p{k}", f"A{k % 12:03d} 1AA") for k in range(40)], "who string, place string")
    rows.repartition(3).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    release_stream(stream, m, "place", "who", key, f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r.who, r.place_dp) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {(r.who, r.place_dp) for r in m.perturb_frame(rows, "place", "who", key).collect()}


def test_manifest_of_a_release(spark):
    m = HopMechanism(path(spark, 6), 1.0)
    rows = spark.createDataFrame([("a", "A000 1AA"), ("b", "a0001aa")], "who string, place string")
    out = m.perturb_frame(rows, "place", "who", Key.from_bytes(bytes(32)))
    got = artefact.release_manifest(m, out, "place", "place_dp", "error", False, 2).first()
    assert got.distinct_codes == 2 and got.rows_failed == 0 and got.graph_digest
    one = m.graph.nodes.where("node_id = 0").select("node_id")
    assert got.largest_teleport == m.report(one).first().teleport_probability
    assert json.loads(got.graph_provenance) == {}
    assert artefact.release_manifest(m, out.limit(0), "place", "place_dp", "error", False, 0).first().largest_teleport is None
