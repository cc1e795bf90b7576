"""A garden as facts: beds that are watered by plan, and specifications in four test frameworks."""

from __future__ import annotations

import re

from rippleflow import schemas

APP, NUNIT, XUNIT, TUNIT, MSTEST = "Garden", "Garden.SpecsN", "Garden.SpecsX", "Garden.SpecsU", "Garden.SpecsM"
MS = "Microsoft.VisualStudio.TestTools.UnitTesting."


class Build:
    def __init__(self):
        self.types, self.members, self.code, self.attrs, self.faces, self.overrides, self.refs, self.fields = [], [], [], [], [], [], [], []
        self.token = 0

    def type(self, asm, name, base="System.Object", faces=(), attrs=(), entry=None, declaring=None, interface=False):
        simple = name.rsplit("/", 1)[-1].rsplit(".", 1)[-1] if "/" not in name else name.rsplit("/", 1)[-1]
        self.types.append((asm, name, simple, declaring, base, "", interface, 0, 0, entry, name.rsplit(".", 1)[0]))
        for f in faces:
            m = re.match(r"(.*?)<(.*)>$", f)
            self.faces.append((asm, name, m[1] if m else f, m[2].split(",") if m else []))
        for a in attrs:
            self.attr(asm, "type", name, a)
        return self

    def attr(self, asm, kind, owner, a):
        name, args, named, targs = (a, [], [], []) if isinstance(a, str) else (*a, [], [], [])[:4]
        self.attrs.append((asm, kind, owner, name, list(args), list(named), list(targs), None))

    def method(self, type_, name, args="", calls=(), attrs=(), virtual=False, static=False, returns="System.Void"):
        asm = next(t[0] for t in self.types if t[1] == type_)
        n = 0 if not args else args.count(",") + 1
        fqn = f"{returns} {type_}::{name}({args})"
        self.token += 1
        self.members.append((asm, type_, name, n, fqn, returns, static, virtual, name in (".ctor", ".cctor"), 0, 0, self.token))
        for a in attrs:
            self.attr(asm, "member", fqn, a)
        for i, c in enumerate(calls):
            kind, target = c.split(" ", 1)
            targs = re.findall(r"<<(.*?)>>", target)
            target = re.sub(r"<<.*?>>", "", target)
            t, _, rest = target.partition("::")
            m, _, k = rest.partition("/")
            scope = next((x[0] for x in self.types if x[1] == t), "System.Runtime")
            self.code.append((asm, fqn, i, "call", kind, target, t, m, int(k or 0), scope, targs, None))
        return fqn

    def frames(self, spark):
        make = lambda rows, schema: spark.createDataFrame(rows, schema)
        return {
            "types": make(self.types, schemas.TYPE_FACT), "members": make(self.members, schemas.MEMBER_FACT), "instructions": make(self.code, schemas.INSTRUCTION_FACT), "attributes": make(self.attrs, schemas.ATTRIBUTE_FACT),
            "attribute_bases": make([("TUnit.Core.BeforeAttribute", "TUnit.Core.HookAttribute"), ("TUnit.Core.BeforeEveryAttribute", "TUnit.Core.HookAttribute"), ("My.SlowTestAttribute", "Xunit.FactAttribute"), ("Loop", "Loop2"), ("Loop2", "Loop")], schemas.ATTRIBUTE_BASE),
            "interfaces": make(self.faces, schemas.INTERFACE_FACT), "overrides": make(self.overrides, schemas.OVERRIDE_FACT), "fields": make(self.fields, schemas.FIELD_FACT), "references": make(self.refs, "name string, ref string"),
        }


def sample() -> tuple[Build, dict[str, str]]:
    """The build, and full names of members by short name."""
    b, f = Build(), {}
    # the garden: a plan tells when water comes next, and a panel shows it
    for name, more in {"Water": {}, "Bed": {}, "IPlan": {"base": "", "interface": True}, "DripPlan": {"faces": ["Garden.IPlan"]}, "Planting": {}, "Clock": {}, "Sky": {}}.items():
        b.type(APP, f"Garden.{name}", **more)
    b.type(APP, "Garden.DripPlan/<>c", declaring="Garden.DripPlan").type(APP, "Garden.DripPlan/<Fetch>d__7", declaring="Garden.DripPlan")
    f["round"] = b.method("Garden.Clock", "Round")
    f["start"] = b.method("Garden.Clock", "Start", static=True)
    f["rain"] = b.method("Garden.Sky", "Rain", "System.Double")
    f["pour"] = b.method("Garden.Water", "Pour", "System.Double")
    f["soil"] = b.method("Garden.Bed", "get_Soil")
    b.method("Garden.IPlan", "Next", "System.Double", virtual=True)
    f["next"] = b.method("Garden.DripPlan", "Next", "System.Double", ["m Garden.Clock::Round/0"], virtual=True)
    f["idle"] = b.method("Garden.DripPlan", "Idle")
    f["fetch"] = b.method("Garden.DripPlan", "Fetch", virtual=True)
    f["lambda"] = b.method("Garden.DripPlan/<>c", "<Next>b__5_0", calls=["m Garden.Water::Pour/1"])
    f["step"] = b.method("Garden.DripPlan/<Fetch>d__7", "MoveNext", calls=["m Garden.Sky::Rain/1"])
    b.method("Garden.DripPlan/<>c", ".ctor")
    f["plant"] = b.method("Garden.Planting", "Plant", calls=["m Garden.Clock::Round/0", "f Garden.Bed"])
    b.type(APP, "Garden.Panel", base="Microsoft.AspNetCore.Mvc.ControllerBase", entry="Garden.Clock::Start/0")
    f["show"] = b.method("Garden.Panel", "Show", calls=["m Garden.IPlan::Next/1"])
    # NUnit: three classes of specifications, one of them derived, and a set-up for the whole assembly
    N = "NUnit.Framework."
    b.type(NUNIT, "Dry.Spec").type(NUNIT, "Dry.DripSpec", base="Dry.Spec").type(NUNIT, "Dry.PlantingSpec").type(NUNIT, "Dry.PanelSpec").type(NUNIT, "Dry.MirrorSpec").type(NUNIT, "Dry.Weather").type(NUNIT, "Dry.Shed", attrs=[N + "SetUpFixtureAttribute"])
    f["drips"] = b.method("Dry.DripSpec", "Drips", calls=["m Garden.DripPlan::Next/1"], attrs=[N + "TestAttribute"])
    b.method("Dry.DripSpec", "Forecasts", "System.Double", calls=["m Garden.DripPlan::Fetch/0"], attrs=[(N + "TestCaseSourceAttribute", ["t:Dry.Weather", "s:Days"])])
    f["days"] = b.method("Dry.Weather", "get_Days", static=True)
    f["fill"] = b.method("Dry.DripSpec", "Fill", attrs=[N + "SetUpAttribute"])
    f["open"] = b.method("Dry.Shed", "Open", attrs=[N + "OneTimeSetUpAttribute"])
    b.method("Dry.PlantingSpec", "Plants", calls=["m Garden.Planting::Plant/0"], attrs=[N + "TestAttribute"])
    b.method("Dry.PanelSpec", "Shows", calls=["m Garden.Clock::Start/0"], attrs=[N + "TestAttribute"])
    b.method("Dry.MirrorSpec", "Mirrors", calls=["t Garden.Sky"], attrs=[N + "TestAttribute"])
    # xUnit: a constructor, a derived class, a shared greenhouse, rows by name
    b.type(XUNIT, "Wet.HoseSpec").type(XUNIT, "Wet.LongHoseSpec", base="Wet.HoseSpec").type(XUNIT, "Wet.GlassSpec", faces=["Xunit.IClassFixture`1<Wet.Greenhouse>"]).type(XUNIT, "Wet.Greenhouse").type(XUNIT, "Wet.RainSpec")
    f["uncoil"] = b.method("Wet.HoseSpec", ".ctor")
    b.method("Wet.HoseSpec", "Sprays", attrs=["Xunit.FactAttribute"])
    b.method("Wet.LongHoseSpec", "Reaches", attrs=["My.SlowTestAttribute"])
    b.method("Wet.GlassSpec", ".ctor")
    b.method("Wet.GlassSpec", "Warms", attrs=["Xunit.FactAttribute"])
    f["glaze"] = b.method("Wet.Greenhouse", ".ctor")
    f["drops"] = b.method("Wet.RainSpec", "Drops", static=True)
    b.method("Wet.RainSpec", "Falls", "System.Double", attrs=["Xunit.TheoryAttribute", ("Xunit.MemberDataAttribute", ["s:Drops"])])
    # TUnit: hooks of a class, of an assembly and of all tests; rows by method and by attribute
    U = "TUnit.Core."
    b.type(TUNIT, "Warm.SeedSpec").type(TUNIT, "Warm.LeafSpec").type(TUNIT, "Warm.Sun")
    f["sow"] = b.method("Warm.SeedSpec", "Sow", attrs=[(U + "BeforeAttribute", ["i:0"])])
    f["seeds"] = b.method("Warm.SeedSpec", "Seeds", static=True)
    b.method("Warm.SeedSpec", "Sprouts", "System.Int32", attrs=[U + "TestAttribute", (U + "MethodDataSourceAttribute", ["s:Seeds"])])
    f["greens"] = b.method("Warm.LeafSpec", "Greens", "System.Int32", attrs=[U + "TestAttribute", (U + "ArgumentsAttribute", ["i:4"])])
    f["rise"] = b.method("Warm.Sun", "Rise", attrs=[(U + "BeforeAttribute", ["i:2"])])
    f["shine"] = b.method("Warm.Sun", "Shine", attrs=[(U + "BeforeEveryAttribute", ["i:0"])])
    # MSTest
    b.type(MSTEST, "Cold.SnowSpec").type(MSTEST, "Cold.FrostSpec")
    f["shovel"] = b.method("Cold.SnowSpec", "Shovel", attrs=[MS + "TestInitializeAttribute"])
    f["winter"] = b.method("Cold.SnowSpec", "Winter", static=True, attrs=[MS + "AssemblyInitializeAttribute"])
    b.method("Cold.SnowSpec", "Melts", attrs=[MS + "TestMethodAttribute"])
    f["nights"] = b.method("Cold.FrostSpec", "get_Nights", static=True)
    b.method("Cold.FrostSpec", "Bites", "System.Int32", attrs=[MS + "TestMethodAttribute", (MS + "DynamicDataAttribute", ["s:Nights"])])
    for asm, ref in ((NUNIT, "nunit.framework"), (XUNIT, "xunit.core"), (TUNIT, "TUnit.Core"), (MSTEST, "Microsoft.VisualStudio.TestPlatform.TestFramework"), (NUNIT, APP)):
        b.refs.append((asm, ref))
    return b, f
