import pytest
from pyspark.sql import functions as F

from rippleflow.functions import scalars as S


def rows(spark, data, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(data, schema).select(*cols).collect()]


@pytest.mark.parametrize(
    "path, glob, expected",
    [
        ("src/appsettings.json", "**/appsettings*.json", True),
        ("appsettings.Development.json", "**/appsettings*.json", True),
        ("a/b/Migrations/x.cs", "**/Migrations/**", True),
        ("a\\b\\c.razor", "**/*.razor", True),
        ("a/b.cs", "*.cs", False),
        ("b.CS", "*.cs", True),
        ("ab.cs", "a?.cs", True),
        ("a/.cs", "a?.cs", False),
        ("x+y.cs", "x+y.cs", True),
        ("xxy.cs", "x+y.cs", False),
    ],
)
def test_glob(spark, path, glob, expected):
    assert rows(spark, [(path,)], "p string", S.glob_match(F.col("p"), glob)) == [(expected,)]


@pytest.mark.parametrize(
    "raw, expected",
    [
        ("<M>b__3_0", "<M>b__#_0"),
        ("T/<M>d__12::MoveNext", "T/<M>d__#::MoveNext"),
        ("<>c__DisplayClass4_0", "<>c__DisplayClass#_0"),
        ("<>9__7_1", "<>9__#_1"),
        ("<M>g__Local|4_0", "<M>g__Local|#_0"),
        ("Plain3_0", "Plain3_0"),
    ],
)
def test_normalize(spark, raw, expected):
    assert rows(spark, [(raw,)], "x string", S.normalize_ordinals(F.col("x"))) == [(expected,)]


@pytest.mark.parametrize(
    "name, member, type_",
    [("<Run>b__0_1", "Run", None), ("<Run>g__In|0_1", "Run", None), ("<Run>d__3", None, "Run"), ("Run", None, None), ("<>c", None, None), ("<>c__DisplayClass1_0", None, None)],
)
def test_owner(spark, name, member, type_):
    assert rows(spark, [(name,)], "x string", S.owner_of_member(F.col("x")), S.owner_of_type(F.col("x"))) == [(member, type_)]


@pytest.mark.parametrize(
    "fqn, key",
    [
        ("Mill.Sack Mill.Stone::Grind(Mill.Pair`2<Mill.Grain,Mill.Pair`2<Mill.Oat,Mill.Rye>>,System.Double,Mill.Grain)", "Mill.Stone::Grind/3"),
        ("Mill.Wheel::<type>", "TN:Mill.Wheel"),
        ("System.Void T::.ctor()", "T::.ctor/0"),
        ("System.Void modreq(System.Runtime.CompilerServices.IsExternalInit) N.C::set_Name(System.String)", "N.C::set_Name/1"),
        ("System.Void T::M(System.Int32[,],System.String)", "T::M/2"),
        ("no key", None),
        ("System.Void T/<M>d__4::MoveNext()", "T/<M>d__#::MoveNext/0"),
    ],
)
def test_key_of_fqn(spark, fqn, key):
    assert rows(spark, [(fqn,)], "x string", S.key_of_fqn(F.col("x"))) == [(key,)]


@pytest.mark.parametrize(
    "document, path, expected",
    [
        ("/build/src/A/B.cs", "src/A/B.cs", True),
        ("/build/src/A/B.cs", "repo/src/a/b.cs", True),
        ("C:\\build\\src\\A\\B.cs", "A/B.cs", True),
        ("/build/src/XA/B.cs", "q/A/B.cs", False),
        ("/build/src/A/B.cs", "", False),
        ("/build/src/A/B.cs", "x/y/A/B.cs", False),
    ],
)
def test_path_matches(spark, document, path, expected):
    assert rows(spark, [(document, path)], "d string, p string", S.path_matches(F.col("d"), F.col("p"))) == [(expected,)]


def test_escapes_and_names(spark):
    got = rows(
        spark, [("N.T+I.M(x|y)", True, "T::M/2", "TN:A.B", "<a&'\">")], "d string, p boolean, k string, t string, x string",
        S.escape_filter(F.col("d")), S.leaf_name(F.col("d"), F.col("p")), S.pretty_key(F.col("k")), S.pretty_key(F.col("t")), S.escape_xml(F.col("x")), S.member_name(F.col("k")), S.display_name(F.lit("A/B"), F.lit("M")),
    )
    assert got == [("N.T+I.M\\(x\\|y\\)", "M(x|y)*", "T.M", "[type A.B]", "&lt;a&amp;&apos;&quot;&gt;", "M", "A+B.M")]


def test_versions_and_scope(spark):
    assert rows(spark, [(".NETCoreApp,Version=v8.0",), ("odd",)], "t string", S.version_of(F.col("t"))) == [([8, 0],), ([0, 0],)]
    assert S.scope_text([], []) == "pdb-adjacent"
    assert S.scope_text(["A*"], ["B"]) != S.scope_text([], ["B"])
    scoped = rows(spark, [("App", False), ("App.Tests", False), ("Lib", True)], "n string, s boolean", S.in_scope(F.col("n"), F.col("s"), ["app*"], ["*.tests"]), S.in_scope(F.col("n"), F.col("s"), [], ["App"]))
    assert scoped == [(True, False), (False, False), (False, True)]
    assert S.first_few(list("abcdefg")) == "a, b, c, d, e +2 more"
