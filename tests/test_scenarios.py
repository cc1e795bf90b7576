import pytest
from pyspark.sql import functions as F

from rippleflow import schemas
from rippleflow.operators import canon, graph, ranges, rules
from rippleflow.plans import analyze as A
from rippleflow.storage import stored
from tests.build_facts import APP, MSTEST, NUNIT, TUNIT, XUNIT, sample

ALL = (APP, NUNIT, XUNIT, TUNIT, MSTEST)


@pytest.fixture(scope="module")
def build(spark):
    b, names = sample()
    facts = {k: stored(v) for k, v in b.frames(spark).items()}
    scope = spark.createDataFrame([(a,) for a in ALL], "name string")
    graphs = {}

    def graph_for(framework):
        if framework not in graphs:
            graphs[framework] = A.graph_of(framework, facts, scope)
        return graphs[framework]

    return names, facts, graph_for


def run(spark, build, framework, changes, pins=None, **over):
    """A verdict on changes (short name or full name, kind) of the application and its tests."""
    names, _, graph_for = build
    asm = spark.createDataFrame([(a, "", "new", True) for a in ALL], schemas.ASSEMBLY)
    old = spark.createDataFrame([(a, "", "old" if changes else "new", True) for a in ALL], schemas.ASSEMBLY)
    rows = [(APP, 1, names.get(n, n), k) for n, k in changes]
    none = spark.createDataFrame([], schemas.CONTENT_FILE)
    before = spark.createDataFrame([(a, t, n, "1") for a, t, n, k in rows if k != "added"] or [], schemas.METHOD)
    after = spark.createDataFrame([(a, t, n, "2") for a, t, n, k in rows if k != "removed"] or [], schemas.METHOD)
    baseline = A.Snapshot("net8", "s", old, before, over.pop("content", none), over.pop("version", 4))
    current = A.Snapshot(over.pop("tfm", "net8"), over.pop("scope", "s"), over.pop("assembly", asm), after, none)
    if over.pop("no_baseline", False):
        baseline = None
    return A.analyze(spark, baseline, current, over.pop("graph", lambda: graph_for(framework)), framework, pins=pins, **over)


def names_of(result):
    return {r.display_name.rsplit(".", 2)[-2] + "." + r.display_name.rsplit(".", 1)[-1] for r in result.selection.collect()} if result.selection is not None else set()


DRIP, PLANT, PANEL = {"DripSpec.Drips", "DripSpec.Forecasts"}, {"PlantingSpec.Plants"}, {"PanelSpec.Shows"}

#: What is edited (by short name, or in full, and how), and exactly which specifications it selects.
EDITS = {
    "nunit": [
        ("a method two features share", [("round", "changed")], DRIP - {"DripSpec.Forecasts"} | PLANT | PANEL),
        ("a method behind an interface", [("next", "changed")], DRIP - {"DripSpec.Forecasts"} | PANEL),
        ("code a lambda calls", [("pour", "changed")], DRIP - {"DripSpec.Forecasts"} | PANEL),
        ("code an awaiting method calls", [("rain", "changed")], {"DripSpec.Forecasts"}),
        ("a method nobody calls", [("idle", "added")], set()),
        ("the shape of a type that a field has", [("Garden.Bed::<type>", "changed")], PLANT),
        ("a getter of a type that a field has", [("soil", "changed")], PLANT),
        ("an action of the panel", [("show", "changed")], PANEL),
        ("a member that is gone", [("System.Void Garden.Planting::Weed()", "removed")], PLANT),
        ("a specification", [("drips", "changed")], {"DripSpec.Drips"}),
        ("a new specification", [("drips", "added")], {"DripSpec.Drips"}),
        ("the shape of a base class", [("Dry.Spec::<type>", "changed")], DRIP),
        ("what runs before each of a class", [("fill", "changed")], DRIP),
        ("what runs before an assembly", [("open", "changed")], DRIP | PLANT | PANEL | {"MirrorSpec.Mirrors"}),
        ("rows of another class", [("days", "changed")], {"DripSpec.Forecasts"}),
    ],
    "xunit": [
        ("a constructor, and of what derives", [("uncoil", "changed")], {"HoseSpec.Sprays", "LongHoseSpec.Reaches"}),
        ("what builds a shared fixture", [("glaze", "changed")], {"GlassSpec.Warms"}),
        ("rows by name", [("drops", "changed")], {"RainSpec.Falls"}),
    ],
    "tunit": [
        ("a hook of a class", [("sow", "changed")], {"SeedSpec.Sprouts"}),
        ("a hook of an assembly", [("rise", "changed")], {"SeedSpec.Sprouts", "LeafSpec.Greens"}),
        ("a hook of all", [("shine", "changed")], {"SeedSpec.Sprouts", "LeafSpec.Greens"}),
        ("rows by method", [("seeds", "changed")], {"SeedSpec.Sprouts"}),
    ],
    "mstest": [
        ("what runs before each", [("shovel", "changed")], {"SnowSpec.Melts"}),
        ("what runs before the assembly", [("winter", "changed")], {"SnowSpec.Melts", "FrostSpec.Bites"}),
        ("rows of a property", [("nights", "changed")], {"FrostSpec.Bites"}),
        ("two edits at once", [("shovel", "changed"), ("nights", "changed")], {"SnowSpec.Melts", "FrostSpec.Bites"}),
    ],
}


@pytest.mark.parametrize("framework, changes, expected", [pytest.param(k, c, e, id=f"{k}: {n}") for k, rows in EDITS.items() for n, c, e in rows])
def test_edit(spark, build, framework, changes, expected):
    got = run(spark, build, framework, changes)
    assert not got.run_everything, got.reason
    assert names_of(got) == expected, got.rule


def snapshot_of(facts, content=None):
    """A snapshot of facts alone: an assembly's content is the hash of its rows."""
    rows = canon.hash_members(*(facts[k] for k in ("types", "members", "instructions", "interfaces", "fields", "attributes")))
    text = F.array_join(F.sort_array(F.collect_list(F.concat("fqn", "hash"))), "")
    asm = rows.groupBy("assembly").agg(F.sha2(text, 256).alias("content_hash")).select(F.col("assembly").alias("name"), F.lit("").alias("mvid"), "content_hash", F.lit(True).alias("methods_analyzed"))
    return A.Snapshot("net8", "s", stored(asm), stored(rows.select("assembly", "token", "fqn", "hash")), content)


def test_edits_that_only_facts_show(spark, build):
    names, facts, graph_for = build
    none = spark.createDataFrame([], schemas.CONTENT_FILE)
    base = snapshot_of(facts, none)

    def go(framework, content=none, **edited):
        return A.analyze(spark, base, snapshot_of(facts | edited, content), lambda: graph_for(framework), framework)

    # a build of the same source with other no-ops, as after an edited comment
    code = facts["instructions"]
    idle = go("nunit", instructions=code.unionByName(code.where("offset = 0").withColumns({"offset": F.lit(-1), "opcode": F.lit("nop")})))
    assert not idle.run_everything and idle.rule == "5"
    # an attribute on an action, and another row of arguments on a specification
    marked = facts["attributes"].unionByName(spark.createDataFrame([(APP, "member", names["show"], "Web.RouteAttribute", ["s:/bed"], [], [], None)], schemas.ATTRIBUTE_FACT))
    assert names_of(go("nunit", attributes=marked)) == PANEL
    rows = facts["attributes"].withColumn("args", F.when(F.col("attribute").endswith(".ArgumentsAttribute"), F.array(F.lit("i:5"))).otherwise(F.col("args")))
    assert names_of(go("tunit", attributes=rows)) == {"LeafSpec.Greens"}
    # a type's shape beside a method: both count
    both = go("nunit", attributes=marked, fields=spark.createDataFrame([(APP, "Garden.Bed", "depth", "System.Double", 1, None)], schemas.FIELD_FACT))
    assert names_of(both) == PANEL | PLANT and {r.kind for r in both.changes.collect()} == {"changed", "type"}
    # a file of settings
    everything(go("nunit", content=spark.createDataFrame([("beds.json", "h")], schemas.CONTENT_FILE)), "4")


def test_classification(spark, build):
    _, facts, graph_for = build
    x = {r.display_name: r.parameterized for r in graph_for("xunit").tests.collect()}
    assert x == {"Wet.HoseSpec.Sprays": False, "Wet.LongHoseSpec.Reaches": False, "Wet.GlassSpec.Warms": False, "Wet.RainSpec.Falls": True}
    assert {r.display_name for r in graph_for("mstest").tests.where("parameterized").collect()} == set()
    life = {r.method_key: r.scope for r in graph_for("tunit").lifecycle.collect()}
    assert life == {"Warm.SeedSpec::Sow/0": 1, "Warm.Sun::Rise/0": 2, "Warm.Sun::Shine/0": 3}
    assert {r.framework for r in graph_for("nunit").frameworks.collect()} == {"nunit", "xunit", "tunit", "mstest"}
    with pytest.raises(ValueError):
        rules.rule_table(spark, "other")


def everything(result, rule):
    assert result.run_everything and result.rule == rule, (result.rule, result.reason)


def test_ladder(spark, build, tmp_path):
    one = [("next", "changed")]
    ranges_ = lambda *p: spark.createDataFrame([(x, 1, 9, i) for i, x in enumerate(p)], "path string, start_line int, end_line int, order int")
    everything(run(spark, build, "nunit", one, changed=ranges_("a.cs", "src/appsettings.json")), "0")
    everything(run(spark, build, "nunit", one, changed=ranges_("a.cs"), globs=["*.cs"]), "0")
    everything(run(spark, build, "nunit", one, no_baseline=True), "1")
    everything(run(spark, build, "nunit", one, tfm="net9"), "2")
    everything(run(spark, build, "nunit", one, scope="other"), "3")
    files = spark.createDataFrame([("x.json", "h")], schemas.CONTENT_FILE)
    everything(run(spark, build, "nunit", one, content=files), "4")
    none = run(spark, build, "nunit", [])
    assert not none.run_everything and none.rule == "5" and A.report(none, "nunit") == (None, 3)
    fewer = spark.createDataFrame([(APP, "", "new", True)], schemas.ASSEMBLY)
    everything(run(spark, build, "nunit", one, assembly=fewer), "6")
    opaque = spark.createDataFrame([(a, "", "new", a != APP) for a in ALL], schemas.ASSEMBLY)
    everything(run(spark, build, "nunit", one, assembly=opaque), "7")
    same = spark.createDataFrame([(a, "", "newer", True) for a in ALL], schemas.ASSEMBLY)
    everything(run(spark, build, "nunit", [], assembly=same), "8")
    _, _, graph_for = build
    g = graph_for("nunit")
    bare = A.Graph(g.edges, g.tests.where("false"), g.lifecycle, g.below, g.type_members, g.provider_links, g.frameworks)
    got = run(spark, build, "nunit", one, graph=lambda: bare)
    everything(got, "9")
    assert "mstest" in got.reason
    broken = run(spark, build, "nunit", one, graph=lambda: 1 / 0)
    everything(broken, "X")
    fine = run(spark, build, "nunit", one, pins=["*Plants"])
    assert "PlantingSpec.Plants" in names_of(fine) and len(fine.warnings) == 3
    table, code = A.report(fine, "nunit", assembly="garden.specsn")
    assert code == 0 and table.first().assembly == NUNIT
    old = run(spark, build, "nunit", one, version=3)
    assert not old.run_everything


def test_by_lines(spark, build):
    names, facts, _ = build
    points = spark.createDataFrame(
        [(APP, names["next"], "/src/DripPlan.cs", 10, 20, False), (APP, names["lambda"], "/src/DripPlan.cs", 15, 16, False), (APP, names["rain"], "/src/Sky.cs", 5, 5, False), (APP, names["rain"], "/src/Sky.cs", 90, 99, True)], schemas.SEQUENCE_POINT
    )
    go = lambda *r, **k: run(spark, build, "nunit", [], no_baseline=True, changed=spark.createDataFrame(list(r), schemas.CHANGED_RANGE), points=k.get("points", points), types=facts["types"], members=facts["members"])
    got = go(("repo/src/DripPlan.cs", 15, 15))
    assert got.rule == "L6" and {r.fqn for r in got.changes.collect()} == {names["next"]} and "DripSpec.Drips" in names_of(got)
    assert go(("src/Sky.cs", 50, 60)).rule == "L3" and go(("src/Sky.cs", 95, 95)).rule == "L3"
    everything(go(("a/view.sql", 1, 2)), "L1")
    everything(go(("a/b.cs", 1, 2), points=points.where("false")), "L2")
    everything(go(("a/b.cs", 1, 2), ("a/view.sql", 1, 2), points=points.where("false")), "L1")  # asked first
    lost = go(("src/Sky.cs", 5, 5), ("x/Other.cs", 1, 1))
    assert lost.rule == "L6" and any("Other.cs" in w for w in lost.warnings)


def test_members_in_ranges(spark, build):
    _, facts, _ = build
    got = ranges.owners(spark.createDataFrame([(APP, build[0]["step"]), (APP, "System.Void Un::known()")], "assembly string, fqn string"), facts["types"], facts["members"])
    assert {r.fqn for r in got.collect()} == {build[0]["fetch"], "System.Void Un::known()"}


def test_hashes(spark, build):
    names, facts, _ = build
    args = [facts[k] for k in ("types", "members", "instructions", "interfaces", "fields", "attributes")]
    one = {r.fqn: r["hash"] for r in canon.hash_members(*args).collect()}
    assert one == {r.fqn: r["hash"] for r in canon.hash_members(*args).collect()}
    code = facts["instructions"].withColumn("operand", F.when((F.col("fqn") == names["lambda"]), "x").otherwise(F.col("operand")))
    two = {r.fqn: r["hash"] for r in canon.hash_members(args[0], args[1], code, *args[3:]).collect()}
    assert {k for k in one if one[k] != two[k]} == {names["next"]}  # a lambda's edit changes its owner alone
    assert "Garden.Water::<type>" in one and not any("<>c" in k or "d__" in k for k in one)
    nops = facts["instructions"].unionByName(facts["instructions"].where(F.col("fqn") == names["next"]).withColumns({"offset": F.lit(-1), "opcode": F.lit("nop")}))
    assert one == {r.fqn: r["hash"] for r in canon.hash_members(args[0], args[1], nops, *args[3:]).collect()}


def test_canonical_lines(spark):
    i = lambda o, op, kind=None, operand=None, jumps=None: ("A", "F", o, op, kind, operand, None, None, None, None, [], jumps)
    rows = [i(0, "nop"), i(1, "ldstr", "s", "a\nb"), i(2, "br", "@", None, [5]), i(3, "nop"), i(4, "switch", "@[]", None, [0, 3, 7]), i(5, "nop"), i(6, "ret"), i(7, "nop")]
    got = canon.instruction_lines(spark.createDataFrame(rows, schemas.INSTRUCTION_FACT)).first().lines
    assert got == "ldstr s:a\\nb\nbr @3\nswitch @[0,2,-1,]\nret \n"


def test_edges_go_where_they_should(spark, build):
    _, facts, graph_for = build
    e = {(r.callee, r.caller) for r in graph_for("nunit").edges.collect()}
    assert ("Garden.Water::Pour/1", "Garden.DripPlan::Next/1") in e  # a lambda acts as its owner
    assert ("Garden.Sky::Rain/1", "Garden.DripPlan::Fetch/0") in e  # and so does a state machine
    assert ("Garden.DripPlan::Next/1", "Garden.IPlan::Next/1") in e
    assert ("Garden.Panel::Show/0", "Garden.Clock::Start/0") in e
    assert not any(c == "TN:Garden.Sky" for c, _ in e) and all(a != b for a, b in e)
    assert graph.merged([graph_for("nunit").edges, graph_for("nunit").edges]).count() == len(e)
