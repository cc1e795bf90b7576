import json
import uuid

import pytest
from pyspark.sql import functions as F

from rippleflow import cli, schemas
from tests.build_facts import APP, NUNIT, sample

PARTS = (APP, NUNIT)


def written(spark, root, edit=None, tfm=".NETCoreApp,Version=v8.0", content=""):
    """A build in a folder: facts (edited by table name), modules, and files."""
    b, _ = sample()
    for k, v in b.frames(spark).items():
        v = (edit or {}).get(k, lambda x: x)(v)
        v.write.parquet(f"{root}/facts/{k}")
    spark.createDataFrame([(a, i, tfm, str(uuid.uuid5(uuid.NAMESPACE_DNS, a + content))) for i, a in enumerate(PARTS)], schemas.MODULE_FACT).write.parquet(f"{root}/facts/modules")
    (root / "bin").mkdir()
    for a in PARTS:
        (root / "bin" / f"{a}.dll").write_bytes((a + content).encode())
        (root / "bin" / f"{a}.pdb").write_bytes(b"pdb")
    (root / "bin" / "native.dll").write_bytes(b"no module")
    return ["--input", str(root / "bin"), "--facts", str(root / "facts")]


@pytest.fixture(scope="module")
def builds(spark, tmp_path_factory):
    old = written(spark, tmp_path_factory.mktemp("old"))
    wider = lambda f: f.unionByName(spark.createDataFrame([(APP, "Garden.Bed", "depth", "System.Double", 1, None)], schemas.FIELD_FACT))
    pours = lambda c: c.withColumn("operand", F.when(F.col("fqn").contains("Garden.Panel::Show"), "Garden.IPlan::Other/1").otherwise(F.col("operand")))
    new = written(spark, tmp_path_factory.mktemp("new"), {"fields": wider, "instructions": pours}, content="2")
    later = written(spark, tmp_path_factory.mktemp("later"), tfm=".NETCoreApp,Version=v9.0")
    manifest = str(tmp_path_factory.mktemp("m") / "manifest")
    assert cli.main(["snapshot", *old, "-o", manifest], spark) == 0
    return old, new, later, manifest


def said(capsys):
    return json.loads(capsys.readouterr().out.strip().splitlines()[-1])


def test_snapshot_then_analyze(spark, builds, capsys):
    old, _, _, manifest = builds
    assert cli.main(["analyze", *old, "--manifest", manifest, "--test-framework", "nunit"], spark) == 3
    got = said(capsys)
    assert got["runEverything"] is False and got["rule"] == "5" and got["tests"] == [] and {a["name"] for a in got["assemblies"]} == set(PARTS)
    assert cli.main(["analyze", *old, "--test-framework", "NUnit", "--format", "filter-lines"], spark) == 0
    assert capsys.readouterr().out.strip() == "RUN_EVERYTHING"
    assert cli.main(["snapshot", "--input", "/nowhere/none", "--facts", old[3], "-o", "/nowhere/x"], spark) == 1


def test_a_type_and_a_method_change_together(spark, builds, capsys):
    old, new, _, manifest = builds
    assert cli.main(["analyze", *new, "--manifest", manifest, "--test-framework", "nunit"], spark) == 0
    got = said(capsys)
    assert {(c["fqn"], c["kind"]) for c in got["changes"]} == {("Garden.Bed::<type>", "type"), ("System.Void Garden.Panel::Show()", "changed")}
    assert {t["display_name"] for t in got["tests"]} == {"Dry.PlantingSpec.Plants", "Dry.PanelSpec.Shows"} and len(got["filters"]) == 1
    # the same from a JSON manifest, and from two directories
    assert cli.main(["snapshot", *old, "-o", f"{manifest}.json"], spark) == 0
    assert cli.main(["analyze", *new, "--manifest", f"{manifest}.json", "--test-framework", "nunit"], spark) == 0
    assert said(capsys) == got
    assert cli.main(["analyze", "--current", new[1], "--facts", new[3], "--baseline", old[1], "--baseline-facts", old[3], "--test-framework", "nunit"], spark) == 0
    assert said(capsys)["tests"] == got["tests"]


def test_another_framework_of_the_build(spark, builds, capsys):
    _, _, later, manifest = builds
    assert cli.main(["analyze", *later, "--manifest", manifest, "--test-framework", "nunit"], spark) == 0
    got = said(capsys)
    assert got["runEverything"] and got["rule"] == "2"


def test_graphs_are_cached(spark, builds, capsys, tmp_path, monkeypatch):
    _, new, _, manifest = builds
    go = ["analyze", *new, "--manifest", manifest, "--test-framework", "nunit", "--cache", str(tmp_path / "cache")]
    assert cli.main(go, spark) == 0
    fresh = said(capsys)
    monkeypatch.setattr(cli.A, "graph_of", lambda *a: 1 / 0)  # not called again
    assert cli.main(go, spark) == 0
    assert said(capsys) == fresh and not fresh["runEverything"]


def test_unchanged_assemblies_are_not_hashed_again(spark, builds):
    old, _, _, manifest = builds
    f = cli.facts(spark, old[3])
    first = cli.snapshot(spark, [old[1]], [], [], f)
    again = cli.snapshot(spark, [old[1]], [], [], {**f, "members": f["members"].where("false"), "types": f["types"].where("false")}, first)
    rows = lambda s: sorted(tuple(r) for r in s.method.collect())
    assert rows(first) == rows(again) and any(r[2].endswith("::<type>") for r in rows(first))
    assert {r.name for r in first.assembly.collect()} == set(PARTS) and first.tfm == ".NETCoreApp,Version=v8.0"
