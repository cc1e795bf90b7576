"""Test frameworks as rule tables: attribute and interface names by role.

Attributes match by their open name or by a base within eight steps; an attribute whose bases
are unknown matches nothing. Adding a framework adds rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import display_name, method_key
from ..schemas import SCOPE_ASSEMBLY, SCOPE_FIXTURE, SCOPE_GLOBAL, SCOPE_NONE
from .reach import closure

ATTRIBUTE_DEPTH, CLASS_DEPTH = 8, 16
TEST, HOOK, PARAMETERS, SOURCE, SOURCE_CLASS, SETUP_FIXTURE, EVERY = "test", "hook", "parameters", "source", "source_class", "setup_fixture", "every"

# The frameworks' own names.
_MS = "Microsoft.VisualStudio.TestTools.UnitTesting."
MARKERS = [
    ("nunit.framework", "nunit"),
    ("xunit.core", "xunit"),
    ("xunit.v3.core", "xunit"),
    ("TUnit.Core", "tunit"),
    ("Microsoft.VisualStudio.TestPlatform.TestFramework", "mstest"),
]
DIALECT = {"nunit": "VsTest", "xunit": "VsTest", "tunit": "TreeNode", "mstest": "VsTest"}
#: framework -> role -> (attribute names, lifecycle scope)
RULES: dict[str, list[tuple[str, int, list[str]]]] = {
    "nunit": [
        (TEST, 0, [f"NUnit.Framework.{n}Attribute" for n in ("Test", "TestCase", "TestCaseSource", "Theory")]),
        (PARAMETERS, 0, [f"NUnit.Framework.{n}Attribute" for n in ("TestCase", "TestCaseSource", "Theory")]),
        (SOURCE, 0, ["NUnit.Framework.TestCaseSourceAttribute"]),
        (HOOK, SCOPE_FIXTURE, [f"NUnit.Framework.{n}Attribute" for n in ("SetUp", "OneTimeSetUp", "TearDown", "OneTimeTearDown")]),
        (SETUP_FIXTURE, SCOPE_ASSEMBLY, ["NUnit.Framework.SetUpFixtureAttribute"]),
    ],
    "xunit": [
        (TEST, 0, ["Xunit.FactAttribute", "Xunit.TheoryAttribute"]),
        (PARAMETERS, 0, ["Xunit.TheoryAttribute"]),
        (SOURCE, 0, ["Xunit.MemberDataAttribute"]),
        (SOURCE_CLASS, 0, ["Xunit.ClassDataAttribute"]),
    ],
    "tunit": [
        (TEST, 0, ["TUnit.Core.TestAttribute", "TUnit.Core.BaseTestAttribute"]),
        (PARAMETERS, 0, [f"TUnit.Core.{n}" for n in ("ArgumentsAttribute", "ArgumentsAttribute`1", "MethodDataSourceAttribute", "MethodDataSourceAttribute`1", "InstanceMethodDataSourceAttribute", "ClassDataSourceAttribute", "MatrixAttribute", "MatrixDataSourceAttribute", "CombinedDataSourcesAttribute", "DataSourceGeneratorAttribute`1", "AsyncDataSourceGeneratorAttribute`1", "UntypedDataSourceGeneratorAttribute", "AsyncUntypedDataSourceGeneratorAttribute")]),
        (SOURCE, 0, ["TUnit.Core.MethodDataSourceAttribute", "TUnit.Core.MethodDataSourceAttribute`1", "TUnit.Core.InstanceMethodDataSourceAttribute"]),
        (SOURCE_CLASS, 0, ["TUnit.Core.ClassDataSourceAttribute", *(f"TUnit.Core.ClassDataSourceAttribute`{i}" for i in range(1, 6))]),
        (HOOK, SCOPE_FIXTURE, ["TUnit.Core.HookAttribute"]),
        (EVERY, SCOPE_GLOBAL, ["TUnit.Core.BeforeEveryAttribute", "TUnit.Core.AfterEveryAttribute"]),
    ],
    "mstest": [
        (TEST, 0, [_MS + "TestMethodAttribute"]),
        (HOOK, SCOPE_FIXTURE, [_MS + n + "Attribute" for n in ("TestInitialize", "TestCleanup", "ClassInitialize", "ClassCleanup")]),
        (HOOK, SCOPE_ASSEMBLY, [_MS + n + "Attribute" for n in ("AssemblyInitialize", "AssemblyCleanup")]),
        (HOOK, SCOPE_GLOBAL, [_MS + n + "Attribute" for n in ("GlobalTestInitialize", "GlobalTestCleanup")]),
        (SOURCE, 0, [_MS + "DynamicDataAttribute"]),
    ],
}
FIXTURE_INTERFACES = ["Xunit.IClassFixture`1", "Xunit.ICollectionFixture`1"]
SHAPED_HOOKS = ["Dispose", "DisposeAsync", "InitializeAsync"]


def marker_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(MARKERS, "marker string, framework string")


def rule_table(spark: SparkSession, framework: str) -> DataFrame:
    """(name, role, scope) of a framework, found without case."""
    rules = next((r for f, r in RULES.items() if f == framework.lower()), None)
    if rules is None:
        raise ValueError(f"unknown test framework {framework!r}; known: {', '.join(RULES)}")
    return spark.createDataFrame([(n, role, scope) for role, scope, names in rules for n in names], "name string, role string, scope int")


def matched(attributes: DataFrame, bases: DataFrame, rules: DataFrame) -> DataFrame:
    """Attribute facts with role and scope of each rule they match, by own or base name."""
    up = closure(bases.where("base <> ''"), ATTRIBUTE_DEPTH, "attribute", "base").select("attribute", F.col("base").alias("name"))
    own = attributes.select("attribute", F.col("attribute").alias("name")).distinct()
    hits = own.unionByName(up).join(F.broadcast(rules), "name").select("attribute", "role", "scope").distinct()  # a fixed table
    return attributes.join(hits, "attribute")


def _first_string(args: Column) -> Column:
    """Arguments are rendered 's:text', 't:type' or 'i:number'."""
    return F.when(F.get(args, F.lit(0)).startswith("s:"), F.substring(F.get(args, F.lit(0)), 3, 1 << 20))


def _tagged(arg: Column, tag: str) -> Column:
    return F.when(arg.startswith(tag + ":"), F.substring(arg, 3, 1 << 20))


def classify(framework: str, members: DataFrame, types: DataFrame, attributes: DataFrame, attribute_bases: DataFrame, interfaces: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(tests, lifecycle, provider_refs, fixtures) of a framework's tests in a build."""
    framework = framework.lower()
    rules = rule_table(members.sparkSession, framework)
    hit = matched(attributes, attribute_bases, rules)
    on_member = hit.where("owner_kind = 'member'").withColumnRenamed("owner", "fqn")
    role = lambda *r: on_member.where(F.col("role").isin(*r))
    mine = members.join(types.select("type", "simple_name", "namespace"), "type").withColumn("key", method_key(F.col("type"), F.col("name"), F.col("params")))
    parameterized = role(PARAMETERS).select("assembly", "fqn").distinct().withColumn("parameterized", F.lit(True))
    tests = mine.join(role(TEST).select("assembly", "fqn").distinct(), ["assembly", "fqn"], "left_semi").join(parameterized, ["assembly", "fqn"], "left")
    tests = tests.select(
        "key", display_name(F.col("type"), F.col("name")).alias("display_name"), "assembly", F.col("type").alias("declaring_type"), F.coalesce("parameterized", F.lit(False)).alias("parameterized"), "namespace", F.col("simple_name").alias("class_name")
    ).distinct()
    # lifecycle: the widest scope of a method's hooks
    if framework == "xunit":
        up = closure(types.where("base <> ''").select("type", "base"), CLASS_DEPTH, "type", "base").select("type", "base")
        classes = tests.select(F.col("declaring_type").alias("base")).distinct()
        with_tests = classes.select(F.col("base").alias("type")).unionByName(up.join(classes, "base").select("type")).distinct()
        shaped = (~F.col("is_static")) & (F.col("is_ctor") | F.col("name").isin(*SHAPED_HOOKS))
        hooks = mine.where(shaped).join(with_tests, "type", "left_semi").withColumn("scope", F.lit(SCOPE_FIXTURE))
    else:
        scope = F.col("scope")
        if framework == "tunit":
            arg = F.get(F.col("args"), F.lit(0))
            number = _tagged(arg, "i").cast("int")
            scope = F.when(F.size("args") == 0, SCOPE_FIXTURE).when(number >= 3, SCOPE_GLOBAL).when(number == 2, SCOPE_ASSEMBLY).when(number.isNotNull(), SCOPE_FIXTURE).otherwise(SCOPE_ASSEMBLY)
        scoped = role(HOOK).select("assembly", "fqn", "attribute", scope.alias("scope")).unionByName(role(EVERY).select("assembly", "fqn", "attribute", "scope"))
        widest = scoped.groupBy("assembly", "fqn").agg(F.max("scope").alias("scope"))
        hooks = mine.join(widest, ["assembly", "fqn"])
        setup = hit.where((F.col("owner_kind") == "type") & (F.col("role") == SETUP_FIXTURE)).select(F.col("owner").alias("type")).distinct().withColumn("wide", F.lit(True))
        hooks = hooks.join(setup, "type", "left").withColumn("scope", F.when(F.col("wide"), SCOPE_ASSEMBLY).otherwise(F.col("scope")))
    lifecycle = hooks.where(F.col("scope") > SCOPE_NONE).select(F.col("key").alias("method_key"), "scope", F.col("type").alias("declaring_type"), "assembly").distinct()
    # data sources
    one, two = F.get(F.col("args"), F.lit(0)), F.get(F.col("args"), F.lit(1))
    named_type = F.get(F.filter("named", lambda n: n.startswith("MemberType=t:")), F.lit(0))
    by_member = (
        F.when(_tagged(one, "s").isNotNull() & (F.lit(framework != "tunit") | (F.size("args") == 1)), F.struct(F.coalesce(F.substring(named_type, 14, 1 << 20) if framework == "xunit" else F.lit(None).cast("string"), _tagged(two, "t") if framework == "mstest" else F.lit(None).cast("string"), F.col("type")).alias("type"), _tagged(one, "s").alias("member")))
        .when(F.lit(framework in ("nunit", "tunit")) & _tagged(one, "t").isNotNull() & (F.lit(framework == "nunit") | _tagged(two, "s").isNotNull()), F.struct(_tagged(one, "t").alias("type"), F.coalesce(_tagged(two, "s"), F.lit("*")).alias("member")))
    )
    by_class = F.when(F.size("type_args") > 0, F.get(F.col("type_args"), F.lit(0))).when(_tagged(one, "t").isNotNull(), _tagged(one, "t"))
    used = role(SOURCE, SOURCE_CLASS).select("assembly", "fqn", "role", "args", "named", "type_args")
    used = used.join(mine.select("assembly", "fqn", "type", "key"), ["assembly", "fqn"]).join(tests.select("key").distinct(), "key", "left_semi")
    ref = F.when(F.col("role") == SOURCE, by_member).otherwise(F.when(by_class.isNotNull(), F.struct(by_class.alias("type"), F.lit("*").alias("member"))))
    refs = used.select(F.col("key").alias("test_key"), ref.alias("ref")).where("ref is not null").select("ref.type", "ref.member", "test_key").distinct()
    built = interfaces.where(F.col("interface").isin(*FIXTURE_INTERFACES) & (F.size("interface_args") == 1)) if framework == "xunit" else interfaces.where("false")
    fixtures = built.select("type", F.get("interface_args", F.lit(0)).alias("fixture")).distinct()
    return tests, lifecycle, refs, fixtures
