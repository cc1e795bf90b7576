import random

from pyspark.sql import functions as F

from rippleflow import schemas
from rippleflow.operators import emit, graph, reach, select


def edges(spark, *pairs):
    return spark.createDataFrame([(a, b, "call") for a, b in pairs], schemas.EDGE)


def nodes(spark, *names):
    return spark.createDataFrame([(n,) for n in names], "node string")


def test_chains_and_cycles(spark):
    e = edges(spark, ("a", "b"), ("b", "c"), ("c", "a"), ("a", "d"), ("d", "c"), ("c", "e"), ("x", "x"))
    got = {r.node: (r.depth, r.chain) for r in reach.reach(e, nodes(spark, "a", "a", "x")).collect()}
    assert got == {"a": (0, ["a"]), "x": (0, ["x"]), "b": (1, ["a", "b"]), "d": (1, ["a", "d"]), "c": (2, ["a", "b", "c"]), "e": (3, ["a", "b", "c", "e"])}
    assert reach.reach(e, nodes(spark)).count() == 0
    assert {r.node for r in reach.reach(e, nodes(spark, "a"), most=1).collect()} == {"a", "b", "d"}


def test_large_graph_against_brute_force(spark):
    """80,000 edges, one node with a third of them, duplicate edges."""
    rnd = random.Random(8)
    pairs = [(f"n{rnd.randrange(20_000)}", f"n{rnd.randrange(20_000)}") for _ in range(50_000)] + [("hub", f"n{i}") for i in range(27_000)] + [("n5", "hub")] * 3_000
    out = {}
    for a, b in pairs:
        out.setdefault(a, set()).add(b)
    chains = {"n3": ["n3"], "n5": ["n5"]}
    level = dict(chains)
    while level:
        new = {}
        for n, chain in level.items():
            for m in out.get(n, ()):
                if m not in chains and (m not in new or [*chain, m] < new[m]):
                    new[m] = [*chain, m]
        chains |= new
        level = new
    got = {r.node: r.chain for r in reach.reach(edges(spark, *pairs).repartition(5), nodes(spark, "n3", "n5")).collect()}
    assert len(got) > 27_000 and got == chains


def test_reach_against_brute_force(spark):
    rnd = random.Random(3)
    pairs = {(f"n{rnd.randrange(40)}", f"n{rnd.randrange(40)}") for _ in range(60)}
    level, seen = {"n1", "n2"}, {"n1": 0, "n2": 0}
    while level:
        level = {b for a, b in pairs if a in level and b not in seen}
        seen |= {b: max(seen.values()) + 1 for b in level}
    got = {r.node: r.depth for r in reach.reach(edges(spark, *pairs), nodes(spark, "n1", "n2"), chains=False).collect()}
    assert got == seen
    # more seeds never reach less
    more = {r.node for r in reach.reach(edges(spark, *pairs), nodes(spark, "n1", "n2", "n3"), chains=False).collect()}
    assert set(got) <= more


def test_closure(spark):
    pairs = spark.createDataFrame([(f"t{i}", f"t{i + 1}") for i in range(10)], "a string, b string")
    got = {(r.a, r.b): r.depth for r in reach.closure(pairs, 4).collect()}
    assert got == {(f"t{i}", f"t{j}"): j - i for i in range(11) for j in range(i + 1, min(i + 4, 10) + 1)}
    loop = spark.createDataFrame([("p", "q"), ("q", "r"), ("r", "p"), ("p", "p")], "a string, b string")
    assert {(r.a, r.b, r.depth) for r in reach.closure(loop, 64).collect()} == {("p", "q", 1), ("q", "r", 1), ("r", "p", 1), ("p", "r", 2), ("q", "p", 2), ("r", "q", 2)}


def test_closure_writes_each_pair_once(spark, monkeypatch):
    """A binary tree whose root all others reach: no round writes or makes again what is known."""
    paths = []
    monkeypatch.setattr(reach, "shared_dir", lambda s, f=reach.shared_dir: paths.append(f(s)) or paths[-1])
    want = {(f"c{i}", f"c{i >> d}"): d for i in range(1, 300) for d in range(1, i.bit_length() + 1)}
    out = reach.closure(spark.createDataFrame([(f"c{i}", f"c{i // 2}") for i in range(1, 300)], "a string, b string"), 64)
    assert {(r.a, r.b): r.depth for r in out.collect()} == want
    assert spark.read.parquet(*paths).count() == len(want)


def test_closure_against_brute_force(spark):
    """Cycles, several ways to a name, and a bound that is no power of two."""
    rnd = random.Random(11)
    pairs = {(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(45)} | {(f"l{i}", f"l{i + 1}") for i in range(12)}
    out = {a: {b for x, b in pairs if x == a} for a, _ in pairs}
    for most in (1, 3, 6, 64):
        want = {}
        for a in out:
            level, seen = {a}, {a}
            for depth in range(1, most + 1):
                level = {b for x in level for b in out.get(x, ())} - seen
                seen |= level
                want |= {(a, b): depth for b in level}
        rows = reach.closure(spark.createDataFrame(sorted(pairs), "a string, b string"), most).collect()
        assert len(rows) == len(want) and {(r.a, r.b): r.depth for r in rows} == want


def test_closure_to_some_ends(spark, monkeypatch):
    """The closure's rows that lead to the ends, and no others are written; cycles and a bound too."""
    rnd = random.Random(5)
    pairs = spark.createDataFrame(sorted({(f"n{rnd.randrange(30)}", f"n{rnd.randrange(30)}") for _ in range(60)} | {(f"l{i}", f"l{i + 1}") for i in range(9)}), "a string, b string")
    ends = spark.createDataFrame([("n3",), ("n7",), ("l9",), ("l9",), ("none",)], "b string")
    for most in (3, 64):
        want = sorted(tuple(r) for r in reach.closure(pairs, most).where("b in ('n3', 'n7', 'l9')").collect())
        paths = []
        with monkeypatch.context() as m:
            m.setattr(reach, "shared_dir", lambda s, f=reach.shared_dir: paths.append(f(s)) or paths[-1])
            assert sorted(tuple(r) for r in reach.closure_to(pairs, ends, most).collect()) == want
        assert spark.read.parquet(*paths).count() == len(want)


def test_descendants_of_some_bases(spark):
    tree = spark.createDataFrame([(f"C{i}", f"C{i // 2}") for i in range(1, 64)], schemas.BASE_TYPE)
    some = spark.createDataFrame([("C5",), ("C9",), ("C63",), (None,)], "type string")
    every = sorted(tuple(r) for r in select.descendants(tree).where("base in ('C5', 'C9', 'C63')").collect())
    assert sorted(tuple(r) for r in select.descendants(tree, some).collect()) == every and len(every) == 23
    assert select.descendants(tree, some.where("false")).count() == 0


def test_members_of_equal_keys_give_an_edge_once(spark):
    types = spark.createDataFrame([("Owl", "Bird"), ("Bird", "")], "type string, base string")
    rows = [(t, "Hoots", 0, True, False, False) for t in ("Owl", "Bird", "Nests") for _ in range(3)]
    members = spark.createDataFrame(rows, "type string, name string, params int, is_virtual boolean, is_static boolean, is_ctor boolean")
    faces = spark.createDataFrame([("Owl", "Nests")], "type string, interface string")
    none = spark.createDataFrame([], "member_key string, overridden_key string")
    got = sorted(tuple(r) for r in graph.polymorphism_edges(types, members, faces, none).collect())
    assert got == [("Owl::Hoots/0", "Bird::Hoots/0", "virtual"), ("Owl::Hoots/0", "Nests::Hoots/0", "interface")]


# a mill with two classes of tests in the north, and a barn with one in the south
WHEEL, STONE, OWL, SLUICE = "Mill.Wheel::Turns/0", "Mill.Stone::Grinds/0", "Barn.Owl::Hoots/0", "Mill.Sluice::Open/0"
TESTS = [
    (WHEEL, "Mill.Wheel.Turns", "North", "Mill.Wheel", False, "Mill", "Wheel"),
    (STONE, "Mill.Stone.Grinds", "North", "Mill.Stone", True, "Mill", "Stone"),
    (OWL, "Barn.Owl.Hoots", "South", "Barn.Owl", False, "Barn", "Owl"),
    (OWL, "Mill.Wheel.Turns", "South", "Barn.Owl", False, "Barn", "Owl"),
]


def chosen(spark, edge_list, seed_list, hooks=(), bases=(), types=(), providers=()):
    """Selected tests of the first three by name."""
    seeded = spark.createDataFrame([(s, None) for s in seed_list] + [(f"TN:{t}", t) for t in types], "node string, type string")
    walked = reach.reach(edges(spark, *edge_list), seeded.select("node"))
    out = select.select_tests(
        walked, seeded, spark.createDataFrame(TESTS[:3], schemas.TEST), spark.createDataFrame(list(hooks), schemas.LIFECYCLE), select.descendants(spark.createDataFrame(list(bases), schemas.BASE_TYPE)), spark.createDataFrame(list(providers), "provider_key string, test_key string")
    )
    return {r.display_name: r for r in out.collect()}


def test_how_far_a_hook_counts(spark):
    """The river feeds the sluice, a hook of the wheel's class: alone, with its assembly (without case), or for all."""
    far = {s: set(chosen(spark, [("River::Rise/0", SLUICE)], ["River::Rise/0"], [(SLUICE, s, "Mill.Wheel", "NORTH")])) for s in (schemas.SCOPE_FIXTURE, schemas.SCOPE_ASSEMBLY, schemas.SCOPE_GLOBAL)}
    assert far[schemas.SCOPE_FIXTURE] == {"Mill.Wheel.Turns"}
    assert far[schemas.SCOPE_ASSEMBLY] == far[schemas.SCOPE_FIXTURE] | {"Mill.Stone.Grinds"}
    assert far[schemas.SCOPE_GLOBAL] == far[schemas.SCOPE_ASSEMBLY] | {"Barn.Owl.Hoots"}
    assert chosen(spark, [("River::Rise/0", SLUICE)], ["River::Rise/0"]) == {}  # no hook, no test


def test_classes_below(spark):
    tree = [("Barn.Owl", "Barn.Bird"), ("Barn.Bird", "Mill.Wheel"), ("Mill.Wheel", "Object")]
    assert set(chosen(spark, [("River::Rise/0", SLUICE)], ["River::Rise/0"], [(SLUICE, 1, "Mill.Wheel", "North")], tree)) == {"Mill.Wheel.Turns", "Barn.Owl.Hoots"}
    got = chosen(spark, [], [], bases=tree, types=["Barn.Bird"])
    assert set(got) == {"Barn.Owl.Hoots"} and "inherits" in got["Barn.Owl.Hoots"].reason


def test_reasons(spark):
    got = chosen(spark, [("Grain::Sack/2", "Flour::Mix/0"), ("Flour::Mix/0", STONE), ("Grain::Sack/2", SLUICE)], ["Grain::Sack/2", WHEEL], [(SLUICE, 1, "Mill.Stone", "North")])
    assert got["Mill.Wheel.Turns"].reason == "the test itself changed (Mill.Wheel.Turns)"
    assert got["Mill.Stone.Grinds"].chain == ["Grain::Sack/2", SLUICE] and "lifecycle" in got["Mill.Stone.Grinds"].reason  # nearer than by the flour
    got = chosen(spark, [("Grain::Sack/2", "Flour::Mix/0"), ("Flour::Mix/0", STONE)], ["Grain::Sack/2"])
    assert got["Mill.Stone.Grinds"].reason == "Grain.Sack reaches this test in 2 hop(s)"
    got = chosen(spark, [("Night::Hours/0", OWL)], ["Night::Hours/0"], providers=[("Night::Hours/0", OWL)])
    assert got["Barn.Owl.Hoots"].reason == "data provider changed: Night.Hours"


def test_equal_names_in_two_assemblies_stay_two(spark):
    hits = spark.createDataFrame(TESTS, schemas.TEST).withColumns({"phase": F.lit(1), "why": select._rank(F.lit(0), 0, F.col("key"), F.array("key"), F.lit("r"))})
    assert select.first_reason(hits).count() == 4


def test_seeds(spark):
    changes = spark.createDataFrame([("A", "System.Void T::m(A,B)", "changed"), ("A", "U::<type>", "type"), ("A", "System.Void V::old()", "removed")], schemas.METHOD_CHANGE)
    members = spark.createDataFrame([("U", "U::a/0"), ("V", "V::b/1"), ("T", "T::m/2")], schemas.TYPE_MEMBER)
    got = {tuple(r) for r in select.seeds(changes, members).collect()}
    assert got == {("T::m/2", None), ("TN:U", "U"), ("U::a/0", "U"), ("V::old/0", None), ("TN:V", "V"), ("V::b/1", "V")}


def test_pins(spark):
    tests = spark.createDataFrame(TESTS[:3], schemas.TEST)
    pins = select.always_run(tests, ["*.gr?nds", "*.*.?????", "mill.*"])
    assert {(r.display_name, r.reason) for r in pins.collect()} == {("Mill.Stone.Grinds", "always run: *.gr?nds"), ("Mill.Wheel.Turns", "always run: *.*.?????"), ("Barn.Owl.Hoots", "always run: *.*.?????")}
    assert select.with_pins(pins.where("display_name = 'Mill.Stone.Grinds'"), pins).count() == 3


def selection(spark, tests):
    return spark.createDataFrame(tests, schemas.TEST).withColumns({"reason": F.lit("r"), "chain": F.array(F.lit("k"))})


def test_filters(spark):
    s = selection(spark, TESTS[:3])
    got = {r.assembly: r for r in emit.filters(s, "VsTest").collect()}
    assert got["North"].filter == "FullyQualifiedName~Mill.Stone.Grinds|FullyQualifiedName=Mill.Wheel.Turns" and got["North"].test_count == 2
    got = {r.assembly: r.filter for r in emit.filters(s, "TreeNode").collect()}
    assert got == {"North": "/North/*/(Stone|Wheel)/(Grinds*|Turns)", "South": "/South/*/(Owl)/(Hoots)"}
    many = selection(spark, [(f"k{i}", f"N.C.T{i}", "A", "N.C", False, "N", "C") for i in range(5)])
    row = emit.filters(many, "VsTest", spark.createDataFrame([("a", "/out/a.dll")], "name string, dll string"), 3).first()
    assert (row.run_whole_assembly, row.filter, row.test_count, row.dll) == (True, "", 5, "/out/a.dll")
    assert emit.filter_lines(emit.filters(many, "VsTest", max_clauses=3)).first().line == "A\tVsTest\t"


def test_exit_codes_and_settings(spark):
    rows = emit.filters(selection(spark, TESTS[:3]), "TreeNode").collect()
    assert emit.one_filter(rows, False) == ("", 2) and emit.one_filter(rows[:1], False)[1] == 0 and emit.one_filter([], True) == ("", 0)
    assert (emit.exit_code(False, 0), emit.exit_code(True, 0), emit.exit_code(False, 2)) == (3, 0, 0)
    text = emit.run_settings(emit.filters(selection(spark, [("k", "N.C.T<int>", "A", "N.C", False, "N", "C")]), "VsTest")).first().content
    assert "<TestCaseFilter>FullyQualifiedName\\=" not in text and "FullyQualifiedName=N.C.T&lt;int&gt;" in text
    assert emit.explained(selection(spark, TESTS[:1])).first().via is None
