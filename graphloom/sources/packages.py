"""What repositories publish and depend on, read from their package manifests.

``files`` are (repo, path, content). The paths are filtered by built-in
functions; Python reads one manifest at a time in Arrow batches, since TOML, INI
and Python syntax have no built-in form. Everything after that (which file is
the evidence, what is internal to a repository) is grouping and joining.
"""

from __future__ import annotations

import ast
import configparser
import fnmatch
import json
import re
import tomllib
import xml.etree.ElementTree as ET
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as T

#: (published, ecosystem, name, guessed)
Claim = tuple[bool, str, str, bool]
CLAIMS = "repo string, path string, published boolean, ecosystem string, name string, guessed boolean, problem string"

# Sections and elements of the formats, and words that aren't packages.
NPM_SECTIONS = ("dependencies", "devDependencies", "peerDependencies", "optionalDependencies")
CARGO_SECTIONS = ("dependencies", "dev-dependencies", "build-dependencies")
GRADLE_WORDS = ("implementation", "api", "compile", "compileOnly", "runtimeOnly", "testImplementation", "testCompileOnly", "annotationProcessor", "kapt")
SETTINGS = ("settings.gradle", "settings.gradle.kts")

_NAME = re.compile(r"[A-Za-z0-9_.\-]+")
_READ_ELSEWHERE = re.compile(r"(?:file|attr)\s*:", re.I)
_CHECKOUT = re.compile(r"\s*(?:(?:-e|--editable)[\s=]+)?(?:git|hg|svn|bzr)\+(?P<url>[^\s#]*)(?:#(?P<options>\S*))?")
_GRADLE_NEED = re.compile(rf"""\b(?:{"|".join(GRADLE_WORDS)})\b[\s(]+['"]([^'":\s]+):([^'":\s]+)""")
_GRADLE_GROUP = re.compile(r"""^\s*group\s*=?\s*['"]([^'"]+)['"]""", re.M)


def _publish(ecosystem: str, name) -> Iterator[Claim]:
    if name:
        yield True, ecosystem, name.strip(), False


def _need(ecosystem: str, names: Iterable[str], guessed: bool = False) -> Iterator[Claim]:
    for name in names:
        if name:
            yield False, ecosystem, name.strip(), guessed


def _specs(specs: Iterable) -> Iterator[Claim]:
    """Python requirements that begin with a name; entries that aren't text are references to other groups."""
    found = (_NAME.match(s) for s in specs or () if isinstance(s, str))
    return _need("pypi", [m.group() for m in found if m])


def _listed(value) -> list[str]:
    """Requirements of a setup() argument: a list, or one to a line."""
    rows = value.splitlines() if isinstance(value, str) else value if isinstance(value, (list, tuple)) else ()
    rows = [r.strip() for r in rows if isinstance(r, str)]
    return [r for r in rows if r and r[0] != "#" and not _READ_ELSEWHERE.match(r)]


def _artifact(group, artifact) -> str:
    both = f"{group or ''}:{artifact or ''}"
    return both.strip(":") if artifact and "${" not in both else ""


def checkout(line: str) -> tuple[str, bool] | None:
    """(name, guessed) of a requirement that is a version-control URL; None for another line."""
    m = _CHECKOUT.match(line)
    if m is None:
        return None
    for option in (m["options"] or "").split("&"):
        egg = _NAME.match(option.removeprefix("egg=")) if option.startswith("egg=") else None
        if egg:
            return egg.group(), False
    path = m["url"].partition("://")[2].partition("/")[2] if "://" in m["url"] else m["url"]
    last = path.rpartition("/")[2].partition("@")[0].rpartition(":")[2]
    return last.removesuffix(".git"), True


def _npm(text: str, stem: str, root: str) -> Iterator[Claim]:
    doc = json.loads(text)
    yield from _publish("npm", doc.get("name"))
    for section in NPM_SECTIONS:
        yield from _need("npm", doc.get(section) or ())


def _go(text: str, stem: str, root: str) -> Iterator[Claim]:
    inside, named = False, False
    for line in text.splitlines():
        words = line.partition("//")[0].split()
        if inside:
            inside = not line.startswith(")")
            if inside and len(words) > 1:
                yield from _need("go", words[:1])
        elif re.match(r"require\s*\(", line):
            inside = True
        elif line.startswith("require") and len(words) > 2:
            yield from _need("go", words[1:2])
        elif line.startswith("module") and len(words) > 1 and not named:
            named = True
            yield from _publish("go", words[1])


def _pyproject(text: str, stem: str, root: str) -> Iterator[Claim]:
    doc = tomllib.loads(text)
    project, poetry = doc.get("project") or {}, (doc.get("tool") or {}).get("poetry") or {}
    yield from _publish("pypi", project.get("name") or poetry.get("name"))
    yield from _specs(project.get("dependencies"))
    for table in (project.get("optional-dependencies"), doc.get("dependency-groups")):
        for specs in (table or {}).values():
            yield from _specs(specs)
    yield from _need("pypi", [n for n in poetry.get("dependencies") or {} if n.lower() != "python"])
    for group in (poetry.get("group") or {}).values():
        yield from _need("pypi", (group or {}).get("dependencies") or ())


class _Setup(ast.NodeVisitor):
    """Literal arguments of the first setup() that has keywords; nothing is executed."""

    def __init__(self, tree: ast.Module):
        self.known, self.arguments = {}, None
        for s in tree.body:
            if isinstance(s, ast.Assign) and len(s.targets) == 1 and isinstance(s.targets[0], ast.Name):
                self._keep(self.known, s.targets[0].id, s.value)
        self.visit(tree)

    def _keep(self, into: dict, name: str, value: ast.expr) -> None:
        try:
            into[name] = self.known[value.id] if isinstance(value, ast.Name) and value.id in self.known else ast.literal_eval(value)
        except (ValueError, TypeError):
            pass  # computed: not declared

    def visit_Call(self, call: ast.Call) -> None:
        if self.arguments is None and call.keywords and ast.unparse(call.func) in ("setup", "setuptools.setup", "distutils.core.setup"):
            self.arguments = {}
            for k in call.keywords:
                if k.arg:
                    self._keep(self.arguments, k.arg, k.value)
        self.generic_visit(call)


def _setup_py(text: str, stem: str, root: str) -> Iterator[Claim]:
    said = _Setup(ast.parse(text)).arguments or {}
    yield from _publish("pypi", said["name"] if isinstance(said.get("name"), str) else None)
    extras = said.get("extras_require")
    for value in (said.get("install_requires"), *(extras.values() if isinstance(extras, dict) else ())):
        yield from _specs(_listed(value))


def _setup_cfg(text: str, stem: str, root: str) -> Iterator[Claim]:
    cfg = configparser.ConfigParser(interpolation=None, default_section="\0")
    cfg.read_string(text)
    name = cfg.get("metadata", "name", fallback="")
    yield from _publish("pypi", "" if _READ_ELSEWHERE.match(name) else name)
    extras = cfg["options.extras_require"].values() if cfg.has_section("options.extras_require") else ()
    for value in (cfg.get("options", "install_requires", fallback=""), *extras):
        yield from _specs(_listed(value))


def _requirements(text: str, stem: str, root: str) -> Iterator[Claim]:
    for line in text.splitlines():
        told = checkout(line)
        if told:
            yield from _need("pypi", [told[0]], told[1])
        elif line.strip()[:1] not in ("#", "-"):
            yield from _specs([line.strip()])


def _tag(e: ET.Element) -> str:
    return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""


def _children(e: ET.Element | None) -> dict[str, ET.Element]:
    return {_tag(c): c for c in reversed(e if e is not None else ())}


def _said(e: ET.Element | None, name: str) -> str:
    child = _children(e).get(name)
    return (child.text or "").strip() if child is not None else ""


def _pom(text: str, stem: str, root: str) -> Iterator[Claim]:
    top = ET.fromstring(text)
    group = _said(top, "groupId") or _said(_children(top).get("parent"), "groupId")
    yield from _publish("maven", _artifact(group, _said(top, "artifactId")))
    yield from _need("maven", [_artifact(_said(e, "groupId"), _said(e, "artifactId")) for e in top.iter() if _tag(e) == "dependency"])


def _gradle(text: str, stem: str, root: str) -> Iterator[Claim]:
    yield from _need("maven", [_artifact(*m.groups()) for m in _GRADLE_NEED.finditer(text)])
    group = _GRADLE_GROUP.search(text)
    yield from _publish("maven", _artifact(group[1], root) if group and root else "")


def _catalog(text: str, stem: str, root: str) -> Iterator[Claim]:
    for entry in (tomllib.loads(text).get("libraries") or {}).values():
        if isinstance(entry, dict):
            module = entry.get("module")
            parts = module.split(":", 1) if isinstance(module, str) else [entry.get("group"), entry.get("name")]
            if len(parts) == 2 and all(isinstance(p, str) for p in parts):
                yield from _need("maven", [_artifact(*parts)])


def _cargo(text: str, stem: str, root: str) -> Iterator[Claim]:
    doc = tomllib.loads(text)
    name = (doc.get("package") or {}).get("name")
    yield from _publish("cargo", name if isinstance(name, str) else None)
    for section in (*(doc.get(s) for s in CARGO_SECTIONS), (doc.get("workspace") or {}).get("dependencies")):
        yield from _need("cargo", section or ())


def _references(top: ET.Element, tag: str) -> Iterator[Claim]:
    names = (e.get("Include") or e.get("Update") or "" for e in top.iter() if _tag(e) == tag)
    return _need("nuget", [n for n in names if "$(" not in n])


def _csproj(text: str, stem: str, root: str) -> Iterator[Claim]:
    top = ET.fromstring(text)
    named = ((e.text or "").strip() for e in top.iter() if _tag(e) in ("PackageId", "AssemblyName"))
    yield from _publish("nuget", next(filter(None, named), stem))
    yield from _references(top, "PackageReference")


def _central(text: str, stem: str, root: str) -> Iterator[Claim]:
    yield from _references(ET.fromstring(text), "PackageVersion")


READERS = {
    "package.json": _npm, "go.mod": _go, "pyproject.toml": _pyproject, "setup.py": _setup_py, "setup.cfg": _setup_cfg,
    "requirements*.txt": _requirements, "pom.xml": _pom, "build.gradle": _gradle, "build.gradle.kts": _gradle,
    "libs.versions.toml": _catalog, "Cargo.toml": _cargo, "*.csproj": _csproj, "Directory.Packages.props": _central,
}
_UNREADABLE = (ValueError, SyntaxError, RecursionError, configparser.Error, AttributeError, TypeError)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in CLAIMS.split(", ")]
    for batch in batches:
        out = []
        for repo, path, content, root in zip(batch["repo"], batch["path"], batch["content"], batch["root"]):
            base = path.rpartition("/")[2]
            reader = next(r for glob, r in READERS.items() if fnmatch.fnmatchcase(base, glob))
            try:
                for claim in reader(content or "", base.rpartition(".")[0], root or ""):
                    out.append((repo, path, *claim, None))
            except _UNREADABLE as e:  # what was read before the fault stays
                out.append((repo, path, None, None, None, None, f"{type(e).__name__}: {e}"))
        yield pd.DataFrame(out, columns=columns)


def claims(files: DataFrame) -> DataFrame:
    """Every claim of every manifest, and a row with ``problem`` for each that can't be read to its end."""
    base, folder = F.substring_index("path", "/", -1), F.regexp_replace("path", r"[^/]*\z", "")
    wanted = files.filter(T.path_matches(F.col("path"), list(READERS))).select("repo", "path", "content", folder.alias("folder"))
    root = F.regexp_extract("content", r"""rootProject\.name\s*=\s*['"]([^'"]+)['"]""", 1)
    roots = files.filter(base.isin(*SETTINGS)).select("repo", folder.alias("folder"), "path", root.alias("root")).groupBy("repo", "folder").agg(F.min_by("root", "path").alias("root"))
    gradle = F.substring_index("path", "/", -1).startswith("build.gradle")
    built = wanted.filter(gradle).join(roots, ["repo", "folder"], "left")
    every = wanted.filter(~gradle).withColumn("root", F.lit("")).unionByName(built)
    return every.select("repo", "path", "content", "root").mapInPandas(_read, CLAIMS)


def _named(found: DataFrame, published: bool) -> DataFrame:
    return found.filter(F.col("published") == published).withColumn("name", T.package_name(F.col("ecosystem"), F.col("name"))).filter("name <> ''")


def publishes(found: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, evidence): the first file, by path, that declares each package."""
    return _named(found, True).groupBy("repo", "ecosystem", "name").agg(F.min("path").alias("evidence"))


def depends(found: DataFrame) -> DataFrame:
    """(repo, ecosystem, name, evidence, inferred); declared names outrank guessed ones, a repository's own packages go."""
    sure = F.min(F.when(~F.col("guessed"), F.col("path")))
    out = _named(found, False).groupBy("repo", "ecosystem", "name").agg(F.coalesce(sure, F.min("path")).alias("evidence"), sure.isNull().alias("inferred"))
    return out.join(publishes(found), ["repo", "ecosystem", "name"], "left_anti")
