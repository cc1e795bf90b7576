"""Solutions and projects to output directories.

File trees are small and are resolved on the driver; the choice of a common framework is
relational (choose_tfm), so that many projects and candidates can be resolved at once.
"""

from __future__ import annotations

import os
import re
import xml.etree.ElementTree as ET
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import tfm_of

_CLASSIC = re.compile(r'^\s*Project\("[^"]*"\)\s*=\s*"[^"]*",\s*"([^"]+)"', re.M)
ANCESTORS = 8


def is_solution(path: str) -> bool:
    return os.path.splitext(path)[1].lower() in (".sln", ".slnx")


def _resolved(base: str, ref: str) -> str:
    return os.path.normpath(os.path.join(base, ref.replace("\\", os.sep)))


def _xml(path: str) -> ET.Element | None:
    try:
        return ET.parse(path).getroot()
    except (OSError, ET.ParseError):
        return None


def _named(root: ET.Element, name: str) -> list[ET.Element]:
    return [e for e in root.iter() if isinstance(e.tag, str) and e.tag.rpartition("}")[2] == name]


def project_paths(solution: str) -> list[str]:
    """Projects of a solution of either format, resolved, in order."""
    base = os.path.dirname(os.path.abspath(solution))
    if solution.lower().endswith(".slnx"):
        root = ET.parse(solution).getroot()
        refs = [e.get("Path", "") for e in _named(root, "Project")]
    else:
        with open(solution, encoding="utf-8-sig") as f:
            refs = _CLASSIC.findall(f.read())
    return [_resolved(base, r) for r in refs if r.lower().endswith("proj")]


def project_references(project: str) -> list[str]:
    """Projects that a project refers to, resolved, those that exist; none if it cannot be read."""
    root = _xml(project)
    if root is None:
        return []
    base = os.path.dirname(os.path.abspath(project))
    found = [_resolved(base, e.get("Include", "")) for e in _named(root, "ProjectReference") if e.get("Include")]
    return [p for p in found if os.path.exists(p)]


def assembly_name(project: str) -> str:
    """The first plain AssemblyName, else the file's stem."""
    root = _xml(project)
    for e in _named(root, "AssemblyName") if root is not None else []:
        text = (e.text or "").strip()
        if text and "$" not in text:
            return text
    return os.path.splitext(os.path.basename(project))[0]


def project_closure(projects: list[str]) -> list[str]:
    """Projects and all they refer to, breadth first, each once (without case)."""
    out, seen, queue = [], set(), list(projects)
    while queue:
        p = queue.pop(0)
        if p.lower() in seen:
            continue
        seen.add(p.lower())
        out.append(p)
        queue += project_references(p)
    return out


def artifacts_root(project: str) -> str | None:
    """The nearest ancestor that holds artifacts/bin."""
    d = os.path.dirname(os.path.abspath(project))
    for _ in range(ANCESTORS):
        if os.path.isdir(os.path.join(d, "artifacts", "bin")):
            return os.path.join(d, "artifacts", "bin")
        if os.path.dirname(d) == d:
            return None
        d = os.path.dirname(d)
    return None


def _has_dll(d: str) -> bool:
    return os.path.isdir(d) and any(n.lower().endswith(".dll") for n in os.listdir(d))


def output_candidates(project: str, configuration: str) -> list[str]:
    """Directories that can hold a project's build: bin/<configuration>[/<tfm>], and the artifacts layout."""
    out, name = [], os.path.splitext(os.path.basename(project))[0]
    config = os.path.join(os.path.dirname(os.path.abspath(project)), "bin", configuration)
    if os.path.isdir(config):
        inner = sorted(os.path.join(config, n) for n in os.listdir(config) if os.path.isdir(os.path.join(config, n)))
        out += [d for d in inner if _has_dll(d)] or [config]
    root = artifacts_root(project)
    if root and os.path.isdir(os.path.join(root, name)):
        out += [os.path.join(root, name, n) for n in sorted(os.listdir(os.path.join(root, name))) if n.lower().startswith(configuration.lower())]
    return sorted(d for d in out if _has_dll(d))


def choose_tfm(candidates: DataFrame) -> DataFrame:
    """(tfm, common): the framework that all projects have (column project, directory), the least
    without case; else the one that most have, ties going to the least. An empty table has none."""
    pairs = candidates.select("project", tfm_of(F.col("directory")).alias("tfm")).distinct()
    total = pairs.select(F.countDistinct("project").alias("total"))
    counts = pairs.groupBy("tfm").agg(F.count("*").alias("n"))
    ranked = counts.crossJoin(F.broadcast(total))  # one row
    best = ranked.agg(F.min_by(F.struct("tfm", (F.col("n") == F.col("total")).alias("common")), F.struct((F.col("n") == F.col("total")).cast("int") * -1, F.when(F.col("n") == F.col("total"), 0).otherwise(-F.col("n")), F.lower("tfm"), "tfm")).alias("b"))
    return best.where("b is not null").select("b.tfm", "b.common")


def dominant_tfm(attributes: DataFrame) -> DataFrame:
    """(tfm): of the target framework names (order, tfm) that are .NETCoreApp, the one of the highest
    version, the first on ties; '' if there is none."""
    from ..functions.scalars import version_of

    own = attributes.where(F.col("tfm").startswith(".NETCoreApp"))
    best = F.max_by("tfm", F.struct(version_of(F.col("tfm")), -F.col("order")))
    return own.agg(F.coalesce(best, F.lit("")).alias("tfm"))


@dataclass
class Project:
    path: str
    assembly: str
    directory: str | None


@dataclass
class Load:
    projects: list[Project]
    warnings: list[str] = field(default_factory=list)

    @property
    def directories(self) -> list[str]:
        return sorted({p.directory for p in self.projects if p.directory})

    @property
    def include(self) -> list[str]:
        return sorted({p.assembly for p in self.projects}, key=str.lower)


def resolve(projects: list[str], configuration: str = "Release", framework: str | None = None) -> Load:
    """Each project's output directory under one framework, and what is doubtful about it."""
    options = {p: output_candidates(p, configuration) for p in projects}
    load = Load([])
    tfms = {p: {os.path.basename(d): d for d in ds} for p, ds in options.items() if ds}
    chosen = framework
    if chosen is None and tfms:
        common = set.intersection(*(set(t) for t in tfms.values()))
        names = [t for ts in tfms.values() for t in ts]
        if common:
            chosen = min(common, key=lambda t: (t.lower(), t))
            if any(len(t) > 1 for t in tfms.values()):
                load.warnings.append(f"several target frameworks were built; {chosen} is used")
        else:
            chosen = min(set(names), key=lambda t: (-names.count(t), t.lower(), t))
            load.warnings.append(f"the projects have no target framework in common; {chosen}, which most have, is used")
    for p in projects:
        directory = tfms.get(p, {}).get(chosen or "") or (options[p][0] if options[p] else None)
        if directory is None:
            load.warnings.append(f"{p} has no {configuration} build output")
        elif chosen and os.path.basename(directory).lower() != chosen.lower():
            load.warnings.append(f"{p} was not built for {chosen}; {directory} is used")
        load.projects.append(Project(p, assembly_name(p), directory))
    if len({os.path.basename(p.directory) for p in load.projects if p.directory}) > 1:
        load.warnings.append("the outputs span more than one target framework")
    return load


def load(path: str, configuration: str = "Release", framework: str | None = None) -> Load:
    """A solution's or a project's outputs; a project brings all it refers to."""
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    projects = project_paths(path) if is_solution(path) else project_closure([os.path.abspath(path)])
    if not projects:
        raise ValueError(f"{path} names no projects")
    return resolve(projects, configuration, framework)
