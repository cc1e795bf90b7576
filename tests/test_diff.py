import pytest

from rippleflow.operators import diff

A = "name string, mvid string, content_hash string, methods_analyzed boolean"
M = "assembly string, token int, fqn string, hash string"


def assemblies(spark, *rows):
    return spark.createDataFrame([(n, m, h, True) for n, m, h in rows], A)


def test_four_ways(spark):
    old = assemblies(spark, ("A", "m1", ""), ("B", "m2", ""), ("C", "m3", ""))
    new = assemblies(spark, ("a", "M1", ""), ("B", "m2x", ""), ("D", "m4", ""))
    assert {(r.name, r.status) for r in diff.diff_assemblies(old, new).collect()} == {("a", "unchanged"), ("B", "changed"), ("C", "removed"), ("D", "added")}


def test_identity_known_on_one_side_is_a_change(spark):
    assert diff.diff_assemblies(assemblies(spark, ("A", "m1", "h")), assemblies(spark, ("A", "m1", ""))).first().status == "changed"


def test_duplicate_names_fail(spark):
    with pytest.raises(Exception, match="duplicate assembly"):
        diff.diff_assemblies(assemblies(spark, ("A", "1", ""), ("a", "2", "")), assemblies(spark, ("A", "1", ""))).collect()


def test_methods(spark):
    old = spark.createDataFrame([("A", 1, "T::same", "h"), ("A", 2, "T::edited", "h"), ("A", 3, "T::gone", "h"), ("A", 4, "T::<type>", "h"), ("A", 5, "U::<type>", "h"), ("Q", 6, "T::quiet", "h")], M)
    new = spark.createDataFrame([("a", 1, "T::same", "h"), ("a", 2, "T::edited", "H"), ("a", 4, "T::<type>", "x"), ("N", 7, "V::m", "h"), ("N", 8, "V::<type>", "h"), ("Q", 6, "T::quiet", "z")], M)
    state = spark.createDataFrame([("a", "changed"), ("N", "added"), ("Q", "unchanged")], "name string, status string")
    assert {tuple(r) for r in diff.diff_methods(old, new, state).collect()} == {
        ("a", "T::edited", "changed"), ("a", "T::gone", "removed"), ("a", "T::<type>", "type"), ("a", "U::<type>", "removed"), ("N", "V::m", "added"), ("N", "V::<type>", "type"),
    }


def test_content_files(spark):
    kind = "name string, hash string"
    old = spark.createDataFrame([("appsettings.json", "h1"), ("same.config", "h"), ("gone.json", "h")], kind)
    new = spark.createDataFrame([("AppSettings.json", "h2"), ("same.config", "h"), ("new.json", "h")], kind)
    rows, warned = diff.diff_content(old, new)
    assert {tuple(r) for r in rows.collect()} == {("AppSettings.json", "changed"), ("gone.json", "removed"), ("new.json", "added")} and not warned
    rows, warned = diff.diff_content(old, new, version=3)
    assert rows.count() == 0 and warned
    assert diff.diff_content(old, new.where("false"), version=3)[1] is False


def test_untraceable_and_reuse(spark):
    current = spark.createDataFrame([("App", "", "h1", True), ("Pkg", "", "h2", False), ("New", "", "", True)], A)
    names = spark.createDataFrame([("app",), ("PKG",), ("pkg",), ("Absent",)], "name string")
    assert {r.name.lower() for r in diff.untraceable(names, current).collect()} == {"pkg", "absent"}
    old_methods = spark.createDataFrame([("APP", 1, "T::m", "h"), ("New", 2, "T::n", "h")], M)
    carried, left = diff.reuse(current.selectExpr("*", "methods_analyzed AS in_scope"), spark.createDataFrame([("APP", "", "h1", True), ("New", "", "", True)], A), old_methods)
    assert [tuple(r) for r in carried.collect()] == [("App", 1, "T::m", "h")] and [r.name for r in left.collect()] == ["New"]


def test_same_snapshot_has_no_difference(spark):
    a = assemblies(spark, ("A", "1", "x"), ("B", "2", ""))
    assert {r.status for r in diff.diff_assemblies(a, a).collect()} == {"unchanged"}
