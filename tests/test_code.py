import json
import shutil
import time

import pytest
from pyspark.sql import functions as F

from corvine.operators import graph, imports, profile, questions, results, symbols, syntax
from corvine.plans.search import Query, TimedOut, TooBroad, of_kind, rows, search
from corvine.sources.store import Index
from corvine.streaming import watch

SOURCES = {
    "Rust": ("pub struct A<T> {\n    x: T,\n}\n\nimpl A {\n    fn new() -> Self {\n        let y = 1;\n        y\n    }\n}\n\nfn free() {}\n// struct B;\n", {("Struct", "A", 1, 3), ("Function", "new", 6, 9), ("Method", "new", 6, 9), ("Variable", "y", 7, 7), ("Function", "free", 12, 12)}),
    "Python": ("X = 1\nclass A:\n    def m(self):\n        z = 1\nasync def f(): pass\ng = lambda: 1\n", {("Constant", "X", 1, 1), ("Class", "A", 2, 4), ("Method", "m", 3, 4), ("Variable", "z", 4, 4), ("Function", "f", 5, 5), ("Function", "g", 6, 6)}),
    "Go": ("type S struct {\n\tx int\n}\n\nfunc (s S) M() {}\nfunc F() {\n}\n", {("Struct", "S", 1, 3), ("Method", "M", 5, 5), ("Function", "F", 6, 7)}),
    "TypeScript": ("export class A {\n  run(x: number): void {\n  }\n}\nconst f = (a) => a;\nexport const N = 3;\ninterface I {}\n", {("Class", "A", 1, 4), ("Method", "run", 2, 3), ("Function", "f", 5, 5), ("Constant", "N", 6, 6), ("Interface", "I", 7, 7)}),
    "Java": ("class A {\n  private int n = 1;\n  public void go() {\n  }\n}\n", {("Class", "A", 1, 5), ("Variable", "n", 2, 2), ("Method", "go", 3, 4)}),
    "Ruby": ("module M\n  class A\n    def go\n      1\n    end\n  end\nend\n", {("Module", "M", 1, 7), ("Class", "A", 2, 6), ("Method", "go", 3, 5)}),
    "C": ("struct P {\n  int x;\n};\nint add(int a, int b) {\n  return a + b;\n}\n#define N 3\n", {("Struct", "P", 1, 3), ("Variable", "x", 2, 2), ("Function", "add", 4, 6), ("Macro", "N", 7, 7)}),
}


@pytest.mark.parametrize("language", sorted(SOURCES))
def test_declarations(language):
    text, want = SOURCES[language]
    assert want <= set(symbols.extract(language, text))
    assert not any(name == "B" for _, name, _, _ in symbols.extract(language, text))


@pytest.mark.parametrize("language", [*symbols.DECLARATIONS, "Python"])
@pytest.mark.parametrize("text", ["", "\n\n", "{{{{", "}}}", "\x00é\u2028", "class", "def f(:\n", '"""', "x" * 5000])
def test_odd_sources_do_not_break_scanners(language, text):
    assert isinstance(symbols.extract(language, text), list)


def test_search_by_symbol_keyword_and_text(files):
    f = files({"a.rs": SOURCES["Rust"][0], "b.py": SOURCES["Python"][0], "c.rs": "// A is fine\n", "d.rs": None})
    assert {(r["path"], r["kind"]) for r in rows(f, Query("new", symbols=True)).collect()} == {("a.rs", "Function"), ("a.rs", "Method")}
    assert {r["path"] for r in rows(f, Query("struct", symbols=True)).collect()} == {"a.rs"}
    assert {r["symbol"] for r in rows(f, Query("struct", symbols=True, language="rust")).collect()} == {"A"}
    assert {r["path"] for r in rows(f, Query("A", force=True, scan_short=True)).collect()} == {"a.rs", "b.py", "c.rs"}
    assert rows(f, Query("A", force=True)).count() == 0
    with pytest.raises(TooBroad):
        rows(f, Query("ab"))
    with pytest.raises(ValueError):
        Query("a", regex=True, contains=True)
    spans = rows(f, Query(r"let y", symbols=True, regex=True))
    assert {r["symbol"] for r in spans.collect()} == {"new", "y"}
    assert {r["preview"] for r in rows(f, Query("new", symbols=True, expand=True)).collect()} == {"    fn new() -> Self {\n        let y = 1;\n        y\n    }"}
    page = search(f, Query("let", limit=1))
    assert page.total == 1 and not page.has_more
    assert of_kind(f, "class").count() == 1


def test_merged_queries_keep_the_first(files):
    f = files({"a.py": "foo\nbar foo\n", "b.py": "bar\n"})
    merged, total = results.merged([(rows(f, Query("foo")), True), (rows(f, Query("bar")), True), (rows(f, Query("foo")), False)])
    assert total == 6 and sorted((r["path"], r["start_line"], r["query_no"]) for r in merged.collect()) == [("a.py", 1, 0), ("a.py", 2, 0), ("b.py", 1, 1)]


@pytest.mark.parametrize("language, path, text, want", [
    ("Rust", "src/a.rs", "use crate::models::Type;\nuse std::io;\nmod b;\n", [("crate::models::Type", "src/models/Type.rs"), ("b", "src/a/b.rs")]),
    ("TypeScript", "web/x.ts", "import { A } from '../lib/a';\nimport fs from 'fs';\nconst b = require('./b.js');\n", [("../lib/a", "lib/a.tsx"), ("./b.js", "web/b.js")]),
    ("Python", "p/q/m.py", "from ..x import y\nimport os, requests\nfrom . import z\n", [("..x", "p/x.py"), (".", "p/q.py")]),
    ("C", "src/a.c", '#include "b.h"\n#include <stdio.h>\n', [("b.h", "src/b.h")]),
    ("PHP", "a/b.php", "<?php\nuse App\\Http\\K;\nrequire_once 'c.php';\n", [("App\\Http\\K", "App/Http/K.php"), ("c.php", "a/c.php")]),
    ("Ruby", "lib/a.rb", "require 'json'\nrequire_relative 'b/c'\n", [("b/c", "lib/b/c.rb")]),
    ("Zig", "src/m.zig", 'const s = @import("std");\nconst a = @import("./a.zig");\n', [("./a.zig", "src/a.zig")]),
    ("CSharp", "a.cs", "using System.IO;\nusing My.App;\n", [("My.App", "My/App.cs")]),
    ("Go", "cmd/m.go", 'import (\n\t"fmt"\n\t"ex.org/p/util"\n)\n', [("ex.org/p/util", "util.go")]),
    ("Java", "A.java", "import java.util.List;\nimport org.me.B;\n", [("org.me.B", "src/main/java/org/me/B.java")]),
    ("Vue", "a.vue", "<template/>\n<script>\nimport B from './B.vue'\n</script>\n", [("./B.vue", "B.vue")]),
])
def test_imports(files, language, path, text, want):
    project = imports.Project(prefixes={"Go": {"ex.org/p": ""}, "Java": {"org.me": "src/main/java"}})
    found = imports.imports(files({path: text}), project).orderBy("line_number").collect()
    assert [(r["imported_path"], r["candidates"][0]) for r in found] == want


def test_resolution_prefers_the_first_candidate(files):
    f = files({"a.ts": "import x from './b'\nimport y from './zz'\nexport * from './b'\nexport {p as q} from './c'", "b.ts": "", "b.tsx": "", "c/index.ts": ""})
    by_id = {r["file_id"]: r["path"] for r in f.collect()}
    got = imports.resolved(imports.imports(f), f).orderBy("line_number").collect()
    assert [(r["imported_path"], by_id.get(r["resolved_file_id"])) for r in got] == [("./b", "b.tsx"), ("./zz", None)]
    out = imports.resolved(imports.exports(f), f, "resolved_source_id").orderBy("line_number").collect()
    assert [(r["exported_symbol"], by_id[r["resolved_source_id"]]) for r in out] == [(None, "b.tsx"), ("p", "c/index.ts")]


def test_path_lookup(files):
    f = files({"x/models.py": "", "y/models.py": "", "z/data_models.py": "", "app/a_b.php": "", "a/tsconfig.json": "{}", "tsconfig.json": "", "a/b/c.ts": "", "d.ts": ""})
    assert imports.find_file(f, "./z/data_models.py")[0][1] == "z/data_models.py"
    with pytest.raises(ValueError):
        imports.find_file(f, "models.py")
    assert imports.lookup_path("/home/me/p/src/a.py") == "src/a.py" and imports.lookup_path("../../a.py") == "a.py" and imports.lookup_path("/q/r.py") == "r.py"
    names = f.sparkSession.createDataFrame([("models.py",), ("DATA_MODELS.py",)], "name string")
    assert [r["name"] for r in imports.by_suffix(names, f).collect()] == ["DATA_MODELS.py"]
    assert imports.by_suffix(names.filter("name = 'models.py'"), f.filter("path LIKE 'z%'"), aligned=False).count() == 1
    assert imports.by_variants(["App\\a_b"], f.withColumn("path", F.replace("path", F.lit("app/"), F.lit("")))).count() == 1
    nearest = {r["path"]: r["config"] for r in imports.nearest_config(f).collect()}
    assert nearest["a/b/c.ts"] == "a/tsconfig.json" and nearest["d.ts"] == "tsconfig.json"
    assert imports.tsconfig_aliases('{"compilerOptions": {"baseUrl": ".", /* c */ "paths": {"@app/*": ["src/*"],}}} // x', "web") == {"@app/*": "web/src/*"}


@pytest.fixture
def graph_of(spark):
    def make(pairs):
        return spark.createDataFrame(pairs, "src long, dst long")

    return make


@pytest.fixture(params=[0, 100_000], ids=["joins", "driver"])
def way(request, monkeypatch):
    monkeypatch.setattr(graph, "SMALL_GRAPH", request.param)


def test_graph_walks(spark, graph_of, way):
    edges = graph_of([(1, 2), (2, 3), (3, 1), (3, 4), (1, 4), (1, 4), (6, None), (7, 7)])
    nodes = spark.createDataFrame([(i,) for i in range(1, 9)], "id long")
    assert sorted(map(tuple, graph.transitive(edges, 1).collect())) == [(1, 0), (2, 1), (3, 2), (4, 1)]
    assert [tuple(r) for r in graph.transitive(edges, 1, 0).collect()] == [(1, 0)]
    assert [tuple(r) for r in graph.hotspots(edges).collect()] == [(4, 3)]
    assert [r[0] for r in graph.unused(nodes, edges).collect()] == [5, 6, 8]
    assert [tuple(r) for r in graph.islands(nodes, edges).collect()] == [(1, 4), (5, 1), (6, 1), (7, 1), (8, 1)]
    assert sorted(map(tuple, graph.cyclic(edges).collect())) == [(1, 1), (2, 1), (3, 1), (7, 7)]
    assert [r["nodes"] for r in graph.cycles(edges).collect()] == [[1, 2, 3]] or graph.cycles(edges).count() == 2
    assert graph.summary(nodes, edges) == {"cycles": graph.cycles(edges).count(), "hotspots": 1, "unused": 3, "islands": 1}


def test_components_of_nested_cycles(graph_of, way):
    edges = graph_of([(1, 2), (2, 1), (2, 3), (3, 4), (4, 3), (5, 6), (6, 7), (7, 5), (7, 3)])
    assert sorted(map(tuple, graph.cyclic(edges).collect())) == [(1, 1), (2, 1), (3, 3), (4, 3), (5, 5), (6, 5), (7, 5)]


def test_empty_graphs(spark, graph_of, way):
    edges, nodes = graph_of([]), spark.createDataFrame([], "id long")
    for out in (graph.cyclic(edges), graph.cycles(edges), graph.islands(nodes, edges), graph.unused(nodes, edges), graph.hotspots(edges)):
        assert out.count() == 0


def test_profile(files):
    f = files({"package.json": '{"dependencies": {"react": "1", "express": "2"}}', "src/a.ts": "x\ny\n", "src/a.test.ts": "x\n", "pk/x/package.json": "{}", "pk/y/Cargo.toml": "", "index.ts": "x", "README.md": ""})
    assert profile.frameworks(f) == ["React", "Express"] and profile.monorepo(f) == (True, 2) and profile.project_type(f) == "React application"
    assert [r["path"] for r in profile.entry_points(f).collect()] == ["index.ts"]
    assert {r["path"] for r in profile.config_files(f).collect()} == {"package.json", "README.md"}
    assert profile.test_layout(f).first()["tests"] == 1
    assert profile.context(f)["dominant"] is None
    assert {r["folder"]: r["files"] for r in profile.tree(f, 1).collect()} == {".": 7, "src": 2, "pk": 2}


def test_questions(files):
    f = files({"a.md": "intro index\n# Index build\nrun it\n# Other\nnone\n# Search index\nindex index\n"})
    found = questions.sections(f, "how to index").orderBy("section").collect()
    assert [(r["section"], r["title"], r["score"]) for r in found] == [(1, "Index build", 11), (3, "Search index", 12)]
    assert questions.sections(f, "how to").count() == 0
    groups = f.select("path")
    assert questions.evaluate(groups, 0, "x")["score"] == pytest.approx(0.2)
    assert questions.evaluate(groups, 1, "python tests")["issues"] == [("file type", 0.3)]
    assert questions.evaluate(groups, 5, "x")["success"] and questions.hint(0, 0).startswith("Nothing") and questions.hint(20, 20) is None
    assert questions.parse_command('query "a b" --lang rust --limit 5 --glob *.rs')["glob"] == ["*.rs"]


def test_index_is_refreshed_by_content(spark, files, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    assert index.status("main")[0] == "stale" and index.problems() == ["no manifest"]
    first = index.build(files({"a.py": "import os\nfrom .b import c\nclass A: pass\n", "b.py": "c = 1\n", "n.txt": "x"}), commit="1")
    assert first["files"] == 2 and index.problems() == [] and index.status("main", "1") == ("fresh", None)
    assert index.table("dependencies").filter("resolved_file_id IS NOT NULL").count() == 1
    same = index.build(files({"a.py": "import os\nfrom .b import c\nclass A: pass\n", "b.py": "c = 1\n"}), commit="2")
    assert same["snapshot"] == first["snapshot"] and index.status("main", "1")[0] == "stale" and index.status("dev")[0] == "stale"
    assert index.status("main", "2", {"a.py": same["indexed_at"] + 5}) == ("stale", "files have changed") and index.status("main", "2", {"a.py": 1.0})[0] == "fresh"
    index.build(files({"a.py": "class B: pass\n", "b.py": "c = 1\n"}), commit="3")
    assert {r["symbol"] for r in index.table("symbols").collect()} == {"B", "c"} and index.table("dependencies").count() == 0
    index.compact(spark.createDataFrame([("b.py",)], "path string"))
    assert {r["path"] for r in index.table("files").collect()} == {"b.py"} and {r["symbol"] for r in index.table("symbols").collect()} == {"c"}
    index.clear()
    assert index.manifest() is None


def test_refreshing_equals_building_anew(spark, files, tmp_path):
    """Added, removed and changed files, and a new project file, change the edges of unchanged files too."""
    states = [
        {"p/a.py": "from .b import x\n", "web/x.ts": "import y from '@app/y'\nexport * from './z'\n", "web/y.ts": ""},
        {"p/a.py": "from .b import x\n", "p/b.py": "x = 1\n", "web/x.ts": "import y from '@app/y'\nexport * from './z'\n", "web/y.ts": "", "web/z.ts": "let q = 1\n"},
        {"p/a.py": "from .b import x\n", "web/x.ts": "import y from '@app/y'\nexport * from './z'\n", "web/y.ts": "", "tsconfig.json": '{"compilerOptions": {"paths": {"@app/*": ["web/*"]}}}'},
    ]
    grown = Index(spark, str(tmp_path / "grown"))
    keys = {"files": ["path", "file_hash"], "postings": ["trigram", "file_id", "line_no"], "symbols": ["path", "symbol", "kind"], "dependencies": ["path", "imported_path", "resolved_file_id"], "exports": ["path", "source_path", "resolved_source_id"]}
    for i, state in enumerate(states):
        options = {"languages": ["Python", "TypeScript", "Unknown"]}
        grown.build(files(state), commit=str(i), **options)
        new = Index(spark, str(tmp_path / f"new{i}"))
        new.build(files(state), **options)
        for name, columns in keys.items():
            got, want = ([tuple(r) for r in x.table(name).select(*columns).orderBy(*columns).collect()] for x in (grown, new))
            assert got == want, (i, name)
    assert grown.table("dependencies").filter("imported_path = '@app/y' AND resolved_file_id IS NOT NULL").count() == 1


def test_branches_stats_and_rebuilding_of_postings(spark, files, tmp_path):
    index = Index(spark, str(tmp_path / "index"))
    index.build(files({"b.py": "x = 1\ny = 2\n", "a.rs": "fn a() {}\n"}), "main", "1")
    held = index.table("files")
    index.build(files({"b.py": "x = 1\ny = 2\n"}), "dev", "2")
    assert held.count() == 2 and index.branch_total("main") == 2 and index.branch_total("dev") == 1 and index.branch_total("none") == 0
    assert sorted((r["branch"], r["commit"], r["path"]) for r in index.branch_files().collect()) == [("dev", "2", "b.py"), ("main", "1", "a.rs"), ("main", "1", "b.py")]
    assert [r["path"] for r in index.list_files("main").collect()] == ["a.rs", "b.py"] and index.list_files().columns == ["path", "language", "indexed_at"]
    stats = index.stats("main")
    assert stats["total_files"] == 2 and stats["lines_by_language"] == {"Python": 2, "Rust": 1} and stats["commit"] == "1" and stats["last_updated"] <= index.stats("dev")["last_updated"]
    assert index.symbol_stats("main")["symbols"] == 3 and index.status("main", "1") == ("fresh", None)
    # A reader of the branch's last snapshot is not disturbed by the next build, only by the one after it.
    index.build(files({"b.py": "x = 3\n"}), "main", "3")
    assert held.count() == 2
    snapshot = index.manifest("main")["snapshot"]
    shutil.rmtree(tmp_path / "index" / snapshot / "postings")
    assert index.problems("main") == ["postings is missing"]
    f = index.table("files", "main")
    assert {r["path"] for r in rows(f, Query("x = 3", contains=True), index.table("postings", "main")).collect()} == {"b.py"} and index.problems("main") == []
    (tmp_path / "index" / ".manifest-torn").write_text("{")
    assert index.manifest("main")["commit"] == "3"


def test_guards_count_candidates(files, monkeypatch):
    from corvine.plans import search as planner

    f = files({**{f"t{i}.py": "def func():\n    pass\n" for i in range(6)}, "src/a.rs": "fn func() {}\n"})
    for name, most in (("syntax", 5), ("syntax with glob", 5), ("keyword", 5), ("symbols", 5)):
        monkeypatch.setitem(planner.MOST, name, most)
    for query in (Query("func", symbols=True), Query("def", symbols=True), Query("func", kind="function")):
        with pytest.raises(TooBroad):
            rows(f, query)
    assert rows(f, Query("func", symbols=True, include=("src/*",))).count() == 1 and rows(f, Query("func", symbols=True, force=True)).count() == 7
    monkeypatch.setattr(planner, "MANY_FILES", 5)
    with pytest.raises(TooBroad):
        rows(f, Query("fun"))
    assert rows(f, Query("fun", force=True)).count() == 0 and rows(f, Query("func")).count() == 7
    pattern = "(function_definition name: (identifier) @n)"
    with pytest.raises(TooBroad):  # excluding is not enough
        planner.syntax(f, pattern, Query("func", exclude=("**/target/**",)))
    with pytest.raises(TooBroad):
        planner.syntax(f, pattern, Query("func", include=("t*.py",)))
    assert planner.syntax(f, pattern, Query("func", include=("t[12].py",))).count() == 2 and planner.syntax(f, "FunctionDef", Query("func", force=True)).count() == 6
    monkeypatch.setitem(planner.MOST, "syntax", 6)
    with pytest.raises(TooBroad):
        planner.syntax(f, pattern, Query("func"))


def test_registered_symbol_search_takes_any_number_of_files(spark, monkeypatch):
    """The guards are for callers who may narrow a query; this one is asked for every row at any size."""
    import __spark_entry__
    from compare import differences
    from corvine.plans import search as planner

    monkeypatch.setattr(planner, "MANY_FILES", 5)
    monkeypatch.setitem(planner.MOST, "symbols", 5)
    made = __spark_entry__.queries()["search_symbols"](spark, __spark_entry__.SMOKE)
    assert made.count() > 5 and differences(made, __spark_entry__.SMOKE, __spark_entry__.oracle_sql()["search_symbols"]) == ""


def test_a_query_may_run_out_of_time(spark, files):
    slow = files({"a.py": "x = 1\n"}).withColumn("content", F.udf(lambda t: (time.sleep(20), t)[1], "string")("content"))
    began = time.perf_counter()
    with pytest.raises(TimedOut):
        search(slow, Query("x =", contains=True), timeout=2)
    assert time.perf_counter() - began < 15
    assert search(files({"a.py": "x = 1\n"}), Query("x =", contains=True), timeout=60).total == 1


@pytest.mark.parametrize("pattern, want", [
    ("(function_definition name: (identifier) @name) @fn", [("fn", 7, "def run"), ("name", 7, "run"), ("fn", 10, "async def"), ("name", 10, "go")]),
    ("(class_definition (block (function_definition name: (identifier) @m)))", [("m", 7, "run")]),
    ("(call function: (attribute attribute: (identifier) @a))", [("a", 8, "join")]),
    ("(function_definition)", []),
    ('((function_definition name: (identifier) @n) (#match? @n "^g"))', [("n", 10, "go")]),
    ('(function_definition name: (identifier) @n (#not-eq? @n "go"))', [("n", 7, "run")]),
    ("[(import_statement) (import_from_statement)] @i", [("i", 1, "import os"), ("i", 2, "from a.b")]),
    ("(decorated_definition definition: (class_definition name: (identifier) @c))", [("c", 5, "A")]),
    ("(assignment left: (_) @l right: (integer))", [("l", 6, "x")]),
])
def test_patterns_over_syntax_trees(pattern, want):
    source = "import os\nfrom a.b import c\n\n@deco\nclass A(B):\n    x = 1\n    def run(self, y):\n        return os.path.join(y)\n\nasync def go(): pass\nrun(3)\n"
    got = [(c, n.start, n.text) for c, n in syntax.captures(syntax.compiled(pattern), source)]
    assert [(c, line) for c, line, _ in got] == [(c, line) for c, line, _ in want] and all(t.startswith(w) for (_, _, t), (_, _, w) in zip(got, want))


@pytest.mark.parametrize("pattern", ["", "(", "fn", "(a (#eq? @x))", "(a (#odd? @x \"y\"))", '("if" @x)'])
def test_broken_patterns_are_refused(pattern):
    with pytest.raises(ValueError):
        syntax.compiled(pattern)


def test_json_prompts_listings_and_background_jobs(spark, files):
    f = files({"src/a.rs": "fn x() {}\nfn x2() {}\n", "b/Cargo.toml": "", "Cargo.toml": "", "src/main.rs": "fn main() {}\n"})
    found = rows(f, Query("fn", force=True, scan_short=True))
    assert json.loads(results.paths_json(found).first()[0]) == [{"path": "src/a.rs", "line": 1}, {"path": "src/main.rs", "line": 1}] and json.loads(results.count_json(found))["count"] == 3
    text = profile.prompt_context(f)
    assert "Project: Rust application" in text and "Rust 2 files" in text
    listing = watch.Listing(spark.createDataFrame([("a", 1), ("b", 1), ("c", 1)], "path string, modified long"))
    after = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1)], "path string, modified long")
    assert sorted(map(tuple, listing.changes(after).collect())) == [("b", "modified"), ("c", "removed"), ("d", "created")] and listing.changes(after).count() == 0
    job, seen = watch.Background(), []
    assert job.start(f, lambda part: seen.extend(r["path"] for r in part.select("path").collect()), 3) and job.wait(120)["state"] == "done" and len(seen) == 4
    assert job.start(f, lambda part: 1 / 0, 2) and job.wait(120)["state"] == "failed"
    gem = files({"my-gem.gemspec": "Gem::Specification.new do |s|\n  s.name = 'my-gem'\nend\n", "a.rb": ""})
    assert imports.project_of(gem).prefixes["Ruby"] == {"my-gem": "", "my_gem": "", "my/gem": ""}


def test_bundled_expectations_of_counts(files):
    """Shapes of declarations that keyword queries count: eleven structs; thirteen and eleven classes."""
    rust = (
        "pub struct A {\n    x: f64,\n}\nstruct B { a: u8 }\npub struct C<T> {\n    v: T,\n}\npub struct D(pub u8, u8);\nstruct E(i32);\npub struct F;\nstruct G<T, U> {\n    a: T,\n    b: U,\n}\n"
        "pub struct H<'a> {\n    d: &'a str,\n}\nstruct I<'a, 'b: 'a> {\n    d: &'b [&'a str],\n}\n#[derive(Debug)]\npub(crate) struct J {}\nstruct K<T>\nwhere\n    T: Copy,\n{\n    t: T,\n}\n// struct L;\nconst S: &str = \"struct M;\";\n"
    )
    python = "class A: pass\nclass B(A):\n    class C:\n        class D: pass\n    def f(self):\n        class E: pass\n@deco\nclass F(metaclass=M): pass\nclass G(A, B): pass\nclass H[T]: pass\nif x:\n    class I: pass\nclass J(Exception):\n    pass\nclass K: pass\nclass L: pass\nclass N: pass\n# class O\ns = 'class P: pass'\n"
    java = "class A {}\npublic class B {\n  class C {}\n  static class D {\n    class E {}\n  }\n}\nabstract class F<T> {}\nfinal class G extends F<String> {}\nclass H implements I {\n  void m() {\n    class J {}\n  }\n}\nsealed class K permits L {}\nnon-sealed class L extends K {}\n// class X {}\ninterface I {}\n"
    f = files({"s.rs": rust, "c.py": python, "c.java": java})
    structs = rows(f, Query("struct", symbols=True, language="rust")).collect()
    assert len(structs) == 11 and {r["kind"] for r in structs} == {"Struct"}
    classes = rows(f, Query("class", symbols=True)).collect()
    assert {r["kind"] for r in classes} == {"Class"} and [sum(r["path"] == p for r in classes) for p in ("c.py", "c.java")] == [13, 11]


def test_watching(spark, tmp_path):
    source, seen = tmp_path / "src", []
    source.mkdir()
    (source / "a.py").write_text("x = 1")
    (source / ".b.py").write_text("x")
    (source / "c.txt").write_text("x")
    for _ in range(2):
        watch.watch(watch.changed_files(spark, str(source)), lambda b: seen.extend(r["path"].rsplit("/", 1)[1] for r in b.collect()), str(tmp_path / "cp"), once=True).awaitTermination(120)
    assert seen == ["a.py"]
    with pytest.raises(ValueError):
        watch.checked_debounce(2)
