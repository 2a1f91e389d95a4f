import pytest

from graphloom.sources import packages as P

FILES = {
    "package.json": '{"name": "@org/web", "dependencies": {"react": "1"}, "devDependencies": {"jest": "2", "@org/web": "1"}}',
    "svc/go.mod": "module corp.example/svc\n\nrequire corp.example/one v1\nrequire (\n\tcorp.example/two v2 // indirect\n)\n",
    "py/pyproject.toml": '[project]\nname = "My_Lib"\ndependencies = ["requests>=2"]\n[dependency-groups]\ndev = ["pytest", {include-group = "x"}]\n[tool.poetry.dependencies]\npython = "3"\nflask = "1"\n',
    "old/setup.py": 'from setuptools import setup\nNAME = "old-lib"\nlog.setup(name="no")\nsetup(name=NAME, install_requires=["six>1"], version=get(), extras_require={"a": "attrs\\n#no"})',
    "old/setup.cfg": "[metadata]\nname = attr: x.y\n[options]\ninstall_requires =\n    click>1\n    file: no.txt\n",
    "requirements-dev.txt": "# note\n-r other.txt\nnumpy==1\ngit+https://h.example/team/guess.git@main\n-e git+ssh://git@h.example/t/x.git#egg=told\n",
    "zz/requirements.txt": "guess\n",
    "j/pom.xml": '<project xmlns="m"><parent><groupId>g</groupId></parent><artifactId>a</artifactId><dependencies><dependency><groupId>o</groupId><artifactId>d</artifactId></dependency><dependency><groupId>${x}</groupId><artifactId>e</artifactId></dependency></dependencies></project>',
    "k/build.gradle.kts": 'group = "gg"\ndependencies { implementation("o.k:lib:1")\n kapt "o.p:proc:2" }',
    "k/settings.gradle.kts": 'rootProject.name = "app"',
    "k/libs.versions.toml": '[libraries]\na = {module = "m.n:x"}\nb = {group = "m.q", name = "y"}\nc = "plain"\n',
    "r/Cargo.toml": '[package]\nname = "crate"\n[dependencies]\nserde = "1"\n[workspace.dependencies]\ntokio = "1"\n',
    "n/My.App.csproj": '<Project><ItemGroup><PackageReference Include="Json.Net" /><PackageReference Update="$(V)" /></ItemGroup></Project>',
    "n/Directory.Packages.props": '<Project><ItemGroup><PackageVersion Include="Central" /></ItemGroup></Project>',
    "bad/package.json": "{",
    "README.md": "setup.py",
}


def test_every_format(spark):
    found = P.claims(spark.createDataFrame([("r", p, c) for p, c in FILES.items()] + [("s", "package.json", None)], "repo string, path string, content string")).cache()
    given = {(r.ecosystem, r.name): r.evidence for r in P.publishes(found).collect()}
    assert set(given) == {
        ("npm", "@org/web"), ("go", "corp.example/svc"), ("pypi", "my-lib"), ("pypi", "old-lib"), ("maven", "g:a"), ("maven", "gg:app"), ("cargo", "crate"), ("nuget", "my.app")
    }
    needs = {(r.ecosystem, r.name): (r.evidence, r.inferred) for r in P.depends(found).collect()}
    assert {e: sorted(n for x, n in needs if x == e) for e in ("npm", "go", "maven", "cargo", "nuget")} == {
        "npm": ["jest", "react"], "go": ["corp.example/one", "corp.example/two"], "maven": ["m.n:x", "m.q:y", "o.k:lib", "o.p:proc", "o:d"], "cargo": ["serde", "tokio"], "nuget": ["central", "json.net"],
    }
    assert sorted(n for x, n in needs if x == "pypi") == ["attrs", "click", "flask", "guess", "numpy", "pytest", "requests", "six", "told"]
    assert needs["pypi", "guess"] == ("zz/requirements.txt", False)  # declared outranks guessed
    assert sorted((r.repo, r.path) for r in found.filter("problem is not null").collect()) == [("r", "bad/package.json"), ("s", "package.json")]


@pytest.mark.parametrize(
    ("line", "want"),
    [("git+https://h/o/r.git@v1#egg=n&x=1", ("n", False)), ("-e hg+https://h/o/r", ("r", True)), ("git+ssh://git@h/o/r.git", ("r", True)), ("git+https://h.example", ("", True)), ("gitpython", None)],
)
def test_checkout(line, want):
    assert P.checkout(line) == want
