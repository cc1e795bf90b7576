import hashlib
import os
import struct
import time

import pytest

from rippleflow import schemas
from rippleflow.sources import cache, changes, listing, manifest, pe, solution


def ranges(spark, *lines):
    return [tuple(r) for r in changes.of_lines(spark, list(lines)).collect()]


def test_plain_list(spark):
    got = ranges(spark, "a/b.cs", "a/b.cs:12", "a/b.cs:12-34", "", "# note", "C:/d.cs", "e.cs:0", "f.cs:9-3")
    whole = schemas.WHOLE_FILE
    assert got == [("a/b.cs", 1, whole), ("a/b.cs", 12, 12), ("a/b.cs", 12, 34), ("C:/d.cs", 1, whole), ("e.cs:0", 1, whole), ("f.cs:9-3", 1, whole)]


def test_unified_diff(spark):
    got = ranges(spark, "--- a/x.cs", "+++ b/x.cs\t2024-01-01", "@@ -10,0 +11,3 @@ class X", "+code", "@@ -5 +5 @@", "--- a/y.cs", "+++ /dev/null", "@@ -1,3 +0,0 @@", "--- a/z.cs", "+++ b/z.cs", "@@ -10,3 +9,0 @@")
    assert sorted(got) == [("b/x.cs", 5, 5), ("b/x.cs", 11, 13), ("b/z.cs", 9, 9)]


def test_lines_of_files(spark, tmp_path):
    (tmp_path / "d.txt").write_text("+++ b/x.cs\n\n@@ -1 +2,2 @@\n")
    assert [tuple(r) for r in changes.parse(changes.lines(spark, str(tmp_path / "d.txt"))).collect()] == [("b/x.cs", 2, 3)]


def test_manifest_round_trip(spark, tmp_path):
    a = spark.createDataFrame([("App", "m", "H", True), ("Pkg", "", "h", False)], schemas.ASSEMBLY)
    m = spark.createDataFrame([("App", 1, "T::b", "x"), ("App", 2, "T::a", "y")], schemas.METHOD)
    c = spark.createDataFrame([("x.json", "h")], schemas.CONTENT_FILE)
    manifest.save(manifest.nested(spark, "net8.0", "pdb-adjacent", a, m, c), str(tmp_path / "m"))
    got = manifest.relations(manifest.load(spark, str(tmp_path / "m")))
    assert {tuple(r) for r in got["assembly"].collect()} == {tuple(r) for r in a.collect()}
    assert {tuple(r) for r in got["method"].collect()} == {tuple(r) for r in m.collect()}
    assert [tuple(r) for r in got["content_file"].collect()] == [("x.json", "h")]
    assert tuple(got["snapshot"].first()) == (4, "net8.0", "pdb-adjacent")
    (tmp_path / "bad.json").write_text("{ not json")
    with pytest.raises(Exception):
        manifest.load(spark, str(tmp_path / "bad.json")).collect()


def test_copies(spark, tmp_path):
    for d, name, at in (("one", "A.dll", 100), ("two", "a.DLL", 200), ("one", "B.dll", 100), ("two", "B.dll", 100), ("one", "x.json", 1)):
        (tmp_path / d).mkdir(exist_ok=True)
        p = tmp_path / d / name
        p.write_bytes(f"{d}{name}".encode())
        os.utime(p, (at, at))
    (tmp_path / "one" / "A.pdb").write_bytes(b"pdb")
    dirs = [str(tmp_path / "one"), str(tmp_path / "two")]
    files = listing.scan(spark, dirs, "*")
    dlls = files.where("lower(file) like '%.dll'")
    assert {(r.file, r.dir_index) for r in listing.newest(dlls).collect()} == {("a.DLL", 1), ("B.dll", 0)}
    assert {(r.file, r.dir_index) for r in listing.first(dlls).collect()} == {("A.dll", 0), ("B.dll", 0)}
    assert [tuple(r) for r in listing.content_files(files).collect()] == [("x.json", hashlib.sha256(b"onex.json").hexdigest().upper())]
    scoped = listing.scoped(listing.with_symbols(files), [], []).where("in_scope")
    assert {r.file for r in scoped.collect()} >= {"A.dll"} and "B.dll" not in {r.file for r in scoped.collect()}
    with pytest.raises(ValueError):
        listing.scan(spark, [], "*")


def fake_pe(stamp: int, debug: bytes) -> bytes:
    data = bytearray(1024)
    data[:2], data[60:64], data[128:132] = b"MZ", struct.pack("<I", 128), b"PE\0\0"
    struct.pack_into("<HHIIIHH", data, 132, 0x14C, 1, stamp, 0, 0, 224, 0)
    optional = 152
    struct.pack_into("<H", data, optional, 0x10B)
    struct.pack_into("<I", data, optional + 64, stamp * 3)
    struct.pack_into("<II", data, optional + 96 + 48, 0x2000, 28)
    table = optional + 224
    data[table : table + 8] = b".text\0\0\0"
    struct.pack_into("<IIII", data, table + 8, 256, 0x2000, 256, 512)
    struct.pack_into("<II", data, 512 + 16, len(debug), 0)
    struct.pack_into("<I", data, 512 + 24, 640)
    data[640 : 640 + len(debug)] = debug
    data[800:816] = b"MVID" * 4
    return bytes(data)


def test_content_hash_is_blind_to_rebuilds(spark):
    one, two = fake_pe(1, b"aaaa"), fake_pe(2, b"bbbb")
    assert one != two and pe.content_hash(one) == pe.content_hash(two)
    changed = bytearray(two)
    changed[900] = 1
    assert pe.content_hash(bytes(changed)) != pe.content_hash(one)
    other = two[:800] + b"mvid" * 4 + two[816:]
    assert pe.content_hash(other, b"mvid" * 4) == pe.content_hash(one, b"MVID" * 4)
    for odd in (b"", b"MZ", b"no pe", one[:140]):
        assert len(pe.content_hash(odd)) == 64
    df = spark.createDataFrame([("a", bytearray(one)), ("b", None)], "path string, content binary")
    assert {r.path: r.content_hash for r in pe.hashed(df).collect()} == {"a": pe.content_hash(one), "b": ""}


def tree(root, files):
    for name, text in files.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_solutions(tmp_path):
    tree(
        tmp_path,
        {
            "S.slnx": '<Solution><Folder Name="/x/"><Project Path="A/A.csproj"/></Folder><Project Path="B\\B.csproj"/></Solution>',
            "S.sln": 'Project("{G}") = "A", "A\\A.csproj", "{1}"\nEndProject\nProject("{G}") = "docs", "docs", "{2}"\n',
            "A/A.csproj": '<Project><PropertyGroup><AssemblyName>$(X)</AssemblyName><AssemblyName>My.A</AssemblyName></PropertyGroup><ItemGroup><ProjectReference Include="..\\B\\B.csproj"/><ProjectReference Include="none.csproj"/></ItemGroup></Project>',
            "B/B.csproj": '<Project><ItemGroup><ProjectReference Include="../A/A.csproj"/></ItemGroup></Project>',
            "A/bin/Release/net8.0/My.A.dll": "", "A/bin/Release/net6.0/My.A.dll": "", "B/bin/Release/net8.0/B.dll": "",
        },
    )
    a, b = str(tmp_path / "A/A.csproj"), str(tmp_path / "B/B.csproj")
    assert solution.project_paths(str(tmp_path / "S.slnx")) == [a, b] and solution.project_paths(str(tmp_path / "S.sln")) == [a]
    assert solution.project_closure([a]) == [a, b] and solution.assembly_name(a) == "My.A" and solution.assembly_name(b) == "B"
    got = solution.load(str(tmp_path / "S.slnx"))
    assert [p.directory for p in got.projects] == [str(tmp_path / "A/bin/Release/net8.0"), str(tmp_path / "B/bin/Release/net8.0")]
    assert len(got.warnings) == 1 and got.include == ["B", "My.A"] and got.directories == sorted(p.directory for p in got.projects)
    forced = solution.load(a, framework="net6.0")
    assert any("net6.0" in w for w in forced.warnings)
    assert any("no Debug build output" in w for w in solution.load(a, "Debug").warnings)
    with pytest.raises(FileNotFoundError):
        solution.load(str(tmp_path / "none.sln"))


def test_artifacts_layout(tmp_path):
    tree(tmp_path, {"src/P/P.csproj": "<Project/>", "artifacts/bin/P/release_net8.0/P.dll": ""})
    assert solution.output_candidates(str(tmp_path / "src/P/P.csproj"), "Release") == [str(tmp_path / "artifacts/bin/P/release_net8.0")]
    assert solution.project_references(str(tmp_path / "none.csproj")) == []


def test_cache(spark, tmp_path):
    root = f"file://{tmp_path}/cache"
    df = spark.createDataFrame([(1,)], "x int")
    assert cache.load(spark, root, "K") is None
    cache.save(df, root, "K")
    cache.save(spark.createDataFrame([(2,)], "x int"), root, "K")
    assert [r.x for r in cache.load(spark, root, "K").collect()] == [1]
    assert cache.prune(spark, root) == 0
    time.sleep(0.01)
    assert cache.prune(spark, root, days=0) == 1 and cache.load(spark, root, "K") is None
    a = spark.createDataFrame([("A", "1", "", True), ("B", "2", "", True), ("C", "3", "", False)], schemas.ASSEMBLY)
    key = cache.whole_key(a, "s", "nunit").first().key
    assert key == cache.whole_key(a, "s", "NUnit").first().key != cache.whole_key(a, "s", "xunit").first().key
    closure = spark.createDataFrame([("A", "B")], "name string, ref string")
    before = {r.name: r.key for r in cache.part_keys(a, closure, "s", "nunit").collect()}
    moved = a.replace({"2": "9"}, subset=["mvid"])
    after = {r.name: r.key for r in cache.part_keys(moved, closure, "s", "nunit").collect()}
    assert before["c"] == after["c"] and before["a"] != after["a"] and before["b"] != after["b"]
