"""Imports and re-exports of source files: extraction, classification and resolution to files.

Extraction is a function of (language, text); resolution explodes each import into candidate
paths in order of preference and joins them with the file table, so nothing probes a disk.
"""

from __future__ import annotations

import ast
import posixpath
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.operators.symbols import scripts

DEPENDENCY = "file_id bigint, path string, language string, line_number int, imported_path string, import_type string, imported_symbols array<string>, candidates array<string>"
EXPORT = "file_id bigint, path string, line_number int, exported_symbol string, source_path string, candidates array<string>"

# Names of standard libraries.
PYTHON_STDLIB = frozenset(
    "os sys io re json csv xml html http urllib collections itertools functools operator pathlib glob tempfile shutil pickle shelve sqlite3 "
    "zlib gzip time datetime calendar logging argparse configparser typing dataclasses enum abc contextlib weakref threading multiprocessing "
    "subprocess queue asyncio socket email base64 hashlib hmac secrets uuid math random statistics decimal fractions unittest doctest pdb trace timeit".split()
)
NODE_STDLIB = frozenset(
    "fs path os crypto util events stream buffer http https net tls url querystring dns child_process cluster worker_threads readline zlib "
    "assert console module process timers vm string_decoder dgram v8 perf_hooks".split()
)
GO_STDLIB = frozenset(
    "fmt io os path strings bytes bufio errors context sync time encoding/json encoding/xml encoding/csv net/http net/url net crypto crypto/tls "
    "crypto/sha256 database/sql log math regexp strconv sort reflect runtime testing flag filepath unicode html text/template".split()
)
C_STDLIB = frozenset(
    "stdio.h stdlib.h string.h math.h time.h ctype.h assert.h errno.h limits.h float.h stddef.h stdint.h stdbool.h stdarg.h setjmp.h signal.h "
    "locale.h wchar.h wctype.h complex.h fenv.h inttypes.h iso646.h tgmath.h threads.h".split()
)
JVM_STDLIB = ("java.", "javax.", "org.w3c.dom", "org.xml.sax")
KOTLIN_STDLIB = ("java.", "javax.", "kotlin.", "android.", "androidx.")
CSHARP_STDLIB = ("System", "Microsoft.AspNetCore", "Microsoft.EntityFrameworkCore", "Microsoft.Extensions", "Microsoft.Win32")
PHP_STDLIB = (
    "Psr\\ Exception Error DateTime DateTimeImmutable DateTimeInterface DateInterval DatePeriod PDO Closure Generator ArrayIterator IteratorAggregate "
    "Traversable Iterator Countable Serializable JsonSerializable Spl SimpleXMLElement DOM XMLReader XMLWriter"
).split()
RUBY_STDLIB = frozenset(
    "json yaml set time date csv uri net/http open-uri fileutils pathname tempfile logger optparse ostruct securerandom digest base64 "
    "erb forwardable singleton benchmark bigdecimal socket stringio strscan timeout zlib psych pp English".split()
)
JS_ENDINGS = (".tsx", ".ts", ".jsx", ".js", ".mjs", ".cjs", "/index.tsx", "/index.ts", "/index.jsx", "/index.js")


@dataclass(frozen=True)
class Project:
    """What project files say: names that make an import internal, and where they lead.

    ``aliases`` maps tsconfig patterns (``@app/*``) to paths, ``prefixes`` a language's own
    module or package prefix to the folder it stands for.
    """

    aliases: dict[str, str] = field(default_factory=dict)
    prefixes: dict[str, dict[str, str]] = field(default_factory=dict)

    def folder(self, language: str, name: str) -> tuple[str, str] | None:
        """The longest prefix of the name, with its folder."""
        found = [(p, d) for p, d in self.prefixes.get(language, {}).items() if name.startswith(p)]
        return max(found, key=lambda x: len(x[0])) if found else None


def classify(language: str, name: str, quoted: bool = False, project: Project = Project()) -> str:
    """internal, stdlib or external."""
    if project.folder(language, name):
        return "internal"
    relative = name.startswith(("./", "../"))
    if language == "Rust":
        return "stdlib" if name.startswith(("std::", "core::", "alloc::")) else "internal" if name.startswith(("crate::", "super::", "self::")) or "::" not in name else "external"
    if language in ("TypeScript", "JavaScript", "Vue", "Svelte"):
        if relative or name.startswith("/") or _alias(name, project.aliases):
            return "internal"
        return "stdlib" if name.removeprefix("node:") in NODE_STDLIB else "external"
    if language == "Python":
        return "internal" if name.startswith(".") else "stdlib" if name.split(".")[0] in PYTHON_STDLIB else "external"
    if language == "Go":
        own = [p.split("/")[0] for p in project.prefixes.get("Go", {})]
        first = name.split("/")[0]
        if relative or ("." in first and first in own):
            return "internal"
        if name in GO_STDLIB:
            return "stdlib"
        return "external" if "." in first or name.count("/") > 1 else "stdlib"
    if language == "Java":
        return "stdlib" if name.startswith(JVM_STDLIB) else "external"
    if language == "Kotlin":
        return "stdlib" if name.startswith(KOTLIN_STDLIB) else "external"
    if language in ("C", "Cpp"):
        return "internal" if quoted else "stdlib" if name in C_STDLIB or "." not in name else "external"
    if language == "CSharp":
        return "stdlib" if any(name == p or name.startswith(f"{p}.") for p in CSHARP_STDLIB) else "internal"
    if language == "PHP":
        return "internal" if quoted else "stdlib" if name.startswith(tuple(PHP_STDLIB)) else "external" if "\\" not in name else "internal"
    if language == "Ruby":
        return "internal" if quoted or relative else "stdlib" if name in RUBY_STDLIB else "external"
    if language == "Zig":
        return "stdlib" if name in ("std", "builtin", "root") else "internal" if relative or name.endswith(".zig") else "external"
    return "external"


def _alias(name: str, aliases: dict[str, str]) -> str | None:
    for pattern, target in aliases.items():
        if pattern.endswith("/*"):
            if name.startswith(pattern[:-1]):
                return posixpath.join(target.removesuffix("*"), name[len(pattern) - 1 :])
        elif name == pattern:
            return target
    return None


def _statements(language: str, text: str) -> list[tuple[int, str, list[str], bool]]:
    """(line, name, symbols, quoted or relative) of each import statement."""
    out: list[tuple[int, str, list[str], bool]] = []

    def each(pattern: str, source: str = text):
        for m in re.finditer(pattern, source, re.M):
            yield source.count("\n", 0, m.start()) + 1 + len(m[0][: len(m[0]) - len(m[0].lstrip())].split("\n")) - 1, m

    if language == "Rust":
        for line, m in each(r"^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;]+);"):
            for path, names in _rust_uses(re.sub(r"\s+", " ", m[1]).strip()):
                out.append((line, path, names, False))
        for line, m in each(r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;"):
            out.append((line, m[1], [], False))
        for line, m in each(r"^\s*extern\s+crate\s+(\w+)"):
            out.append((line, m[1] + "::", [], False))
    elif language in ("TypeScript", "JavaScript"):
        for line, m in each(r"^\s*import\s+(?:type\s+)?(?:([^'\"();]+?)\s+from\s+)?['\"]([^'\"]+)['\"]"):
            out.append((line, m[2], [x.split(" as ")[0].strip() for x in re.sub(r"[{}]", ",", m[1] or "").split(",") if x.strip()], False))
        for line, m in each(r"\b(?:require|import)\(\s*['\"]([^'\"]+)['\"]\s*\)"):
            out.append((line, m[1], [], False))
    elif language in ("Vue", "Svelte"):
        for before, part in scripts(text):
            out += [(line + before, *rest) for line, *rest in _statements("TypeScript", part)]
    elif language == "Python":
        out += _python_imports(text)
    elif language == "Go":
        for line, m in each(r'^\s*import\s+(?:[\w.]+\s+)?"([^"]+)"'):
            out.append((line, m[1], [], False))
        for block in re.finditer(r"^import\s*\((.*?)^\)", text, re.M | re.S):
            base = text.count("\n", 0, block.start(1))
            out += [(line + base, m[1], [], False) for line, m in each(r'^\s*(?:[\w.]+\s+)?"([^"]+)"', block[1])]
    elif language in ("Java", "Kotlin"):
        for line, m in each(r"^\s*import\s+(?:static\s+)?([\w.*]+)(?:\s+as\s+\w+)?"):
            out.append((line, m[1], [], False))
    elif language in ("C", "Cpp"):
        for line, m in each(r'^\s*#\s*include\s*([<"])([^>"]+)[>"]'):
            out.append((line, m[2], [], m[1] == '"'))
    elif language == "CSharp":
        for line, m in each(r"^\s*(?:global\s+)?using\s+(?:static\s+)?(?:\w+\s*=\s*)?([\w.]+)\s*;"):
            out.append((line, m[1], [], False))
    elif language == "PHP":
        for line, m in each(r"^\s*use\s+(?:function\s+|const\s+)?([\w\\]+)(\\\{[^}]*\})?[^;(]*;"):
            if m[2]:
                out += [(line, f"{m[1]}\\{x.split(' as ')[0].strip()}", [], False) for x in m[2][2:-1].split(",") if x.strip()]
            else:
                out.append((line, m[1].lstrip("\\"), [], False))
        for line, m in each(r"\b(?:require|include)(?:_once)?\s*\(?\s*(?:__DIR__\s*\.\s*)?['\"]([^'\"]+)['\"]"):
            out.append((line, m[1], [], True))
    elif language == "Ruby":
        for line, m in each(r"^\s*(require|require_relative|load)\s*\(?\s*['\"]([^'\"]+)['\"]"):
            out.append((line, m[2], [], m[1] == "require_relative"))
    elif language == "Zig":
        for line, m in each(r'@import\(\s*"([^"]+)"\s*\)'):
            out.append((line, m[1], [], False))
    return out


def _rust_uses(text: str) -> list[tuple[str, list[str]]]:
    if "{" not in text:
        return [(text.split(" as ")[0].strip(), [])]
    prefix, _, inner = text.partition("{")
    inner = inner[: inner.rfind("}")]
    if "{" in inner:
        return [(prefix.removesuffix("::"), re.findall(r"\w+", inner))]
    return [(prefix.removesuffix("::"), [x.split(" as ")[0].strip() for x in inner.split(",") if x.strip()])]


def _python_imports(text: str) -> list[tuple[int, str, list[str], bool]]:
    out: list[tuple[int, str, list[str], bool]] = []
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        for m in re.finditer(r"^\s*(?:from\s+([.\w]+)\s+import\s+([^\n#]+)|import\s+([^\n#]+))", text, re.M):
            line = text.count("\n", 0, m.start(1) if m[1] else m.start(3)) + 1
            names = [x.split(" as ")[0].strip(" ()\\") for x in (m[2] or m[3]).split(",")]
            out += [(line, m[1], names, False)] if m[1] else [(line, n, [], False) for n in names]
        return out
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(node.lineno, a.name, [], False) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append((node.lineno, "." * node.level + (node.module or ""), [a.name for a in node.names], False))
    return sorted(out, key=lambda x: (x[0], x[1]))


def _joined(folder: str, name: str) -> str:
    return posixpath.normpath(posixpath.join(folder, name)).removeprefix("./")


def candidates(language: str, path: str, name: str, quoted: bool = False, project: Project = Project()) -> list[str]:
    """Paths that an internal import may mean, the preferred first."""
    folder = posixpath.dirname(path)
    if language == "Rust":
        parts = name.split("::")
        if parts[0] == "crate":
            at = path.rfind("src/")
            base, parts = (path[: at + 3] if at >= 0 else "src"), parts[1:]
        else:
            own = posixpath.basename(path) in ("mod.rs", "lib.rs", "main.rs")
            base = folder if own else path.removesuffix(".rs")
            while parts and parts[0] in ("super", "self"):
                base = posixpath.dirname(base) if parts[0] == "super" else base
                parts = parts[1:]
        out = []
        # The last parts may name items of the module before them.
        for n in range(len(parts), 0, -1):
            stem = _joined(base, "/".join(parts[:n]))
            out += [f"{stem}.rs", f"{stem}/mod.rs"]
        return out
    if language in ("TypeScript", "JavaScript", "Vue", "Svelte"):
        target = _alias(name, project.aliases) or (name.lstrip("/") if name.startswith("/") else _joined(folder, name))
        target = posixpath.normpath(target)
        known = posixpath.splitext(target)[1] in (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte", ".mts", ".cts")
        bare = [re.sub(r"\.(m|c)?jsx?$", "", target) + e for e in (".ts", ".tsx")] if re.search(r"\.(m|c)?jsx?$", target) else []
        return ([target, *bare] if known else []) + [target + e for e in JS_ENDINGS]
    if language == "Python":
        level = len(name) - len(name.lstrip("."))
        base = folder
        for _ in range(level - 1):
            base = posixpath.dirname(base)
        stem = name.lstrip(".").replace(".", "/")
        found = project.folder("Python", name) if not level else None
        stem = _joined(base if level else (found[1] if found else ""), stem) if stem else base
        return [f"{stem}.py", f"{stem}/__init__.py"]
    if language == "Go":
        found = project.folder("Go", name)
        target = _joined(found[1], name[len(found[0]) :].lstrip("/")) if found else _joined(folder, name)
        return [f"{target}.go", f"{target}/{posixpath.basename(target)}.go", f"{target}/main.go"]
    if language in ("Java", "Kotlin"):
        stem = name.removesuffix(".*").replace(".", "/")
        ending = ".java" if language == "Java" else ".kt"
        found = project.folder(language, name)
        roots = [found[1]] if found and found[1] else []
        return [_joined(r, stem + ending) for r in (*roots, "src/main/java", "src/main/kotlin", "src", "")]
    if language in ("C", "Cpp"):
        return [_joined(folder, name), _joined("include", name), _joined("", name)]
    if language == "CSharp":
        return [name.replace(".", "/") + ".cs"]
    if language == "PHP":
        if quoted:
            return [_joined(folder, name.lstrip("/")), name.lstrip("/")]
        found = project.folder("PHP", name)
        stem = _joined(found[1], name[len(found[0]) :].lstrip("\\").replace("\\", "/")) if found else name.replace("\\", "/")
        first, _, rest = stem.partition("/")
        return list(dict.fromkeys([f"{stem}.php", f"{first.lower()}/{rest}.php", f"{stem.lower()}.php"]))
    if language == "Ruby":
        stem = name.removesuffix(".rb")
        return [f"{_joined(folder, stem)}.rb", f"lib/{stem}.rb", f"{stem}.rb"]
    if language == "Zig":
        return [_joined(folder, name if name.endswith(".zig") else f"{name}.zig")]
    return []


def imports(files: DataFrame, project: Project = Project(), internal_only: bool = True) -> DataFrame:
    """The files' imports (DEPENDENCY); by default only internal ones, which are what the graph holds."""

    def rows(batches):
        for batch in batches:
            out: list[dict] = []
            for file_id, path, language, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "language", "content"))):
                for line, name, symbols, quoted in _statements(language, content or ""):
                    kind = classify(language, name, quoted, project)
                    if kind == "internal" or not internal_only:
                        out.append({"file_id": file_id, "path": path, "language": language, "line_number": line, "imported_path": name, "import_type": kind, "imported_symbols": symbols, "candidates": candidates(language, path, name, quoted, project) if kind == "internal" else []})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("language", pa.string()), ("line_number", pa.int32()), ("imported_path", pa.string()), ("import_type", pa.string()), ("imported_symbols", pa.list_(pa.string())), ("candidates", pa.list_(pa.string()))]))

    return files.select("file_id", "path", "language", "content").mapInArrow(rows, DEPENDENCY)


def exports(files: DataFrame, project: Project = Project()) -> DataFrame:
    """Re-exports ``export ... from`` of script files (EXPORT); a null symbol is everything."""

    def rows(batches):
        pattern = re.compile(r"^\s*export\s+(?:type\s+)?(\*(?:\s+as\s+\w+)?|\{[^}]*\})\s*from\s*['\"]([^'\"]+)['\"]", re.M)
        for batch in batches:
            out: list[dict] = []
            for file_id, path, language, content in zip(*(batch.column(c).to_pylist() for c in ("file_id", "path", "language", "content"))):
                text = content or ""
                for m in pattern.finditer(text) if language in ("TypeScript", "JavaScript", "Vue", "Svelte") else ():
                    names = [None] if m[1][0] == "*" else [x.split(" as ")[0].strip() for x in m[1][1:-1].split(",") if x.strip()]
                    for name in names:
                        out.append({"file_id": file_id, "path": path, "line_number": text.count("\n", 0, m.start(1)) + 1, "exported_symbol": name, "source_path": m[2], "candidates": candidates(language, path, m[2], False, project)})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("file_id", pa.int64()), ("path", pa.string()), ("line_number", pa.int32()), ("exported_symbol", pa.string()), ("source_path", pa.string()), ("candidates", pa.list_(pa.string()))]))

    return files.select("file_id", "path", "language", "content").mapInArrow(rows, EXPORT)


def resolved(rows: DataFrame, files: DataFrame, column: str = "resolved_file_id", keep: bool = False) -> DataFrame:
    """Rows with the file of their first candidate that exists; null where none does. ``keep`` leaves the candidates there."""
    numbered = rows.withColumn("__row", F.struct("file_id", "line_number", *[c for c in ("imported_path", "source_path", "exported_symbol") if c in rows.columns]))
    wanted = numbered.select("__row", F.posexplode("candidates").alias("__order", "__path"))
    hits = wanted.join(files.select(F.col("path").alias("__path"), F.col("file_id").alias(column)), "__path").groupBy("__row").agg(F.min_by(column, "__order").alias(column))
    return numbered.join(hits, "__row", "left").drop("__row", *(() if keep else ("candidates",)))


def by_suffix(names: DataFrame, files: DataFrame, aligned: bool = False) -> DataFrame:
    """(name, file_id) for names that are the suffix of exactly one path, without regard to ASCII case.

    Any suffix of the text counts: paths are exploded into all of theirs, as many rows as
    they have characters, and joined by equality. ``aligned`` suffixes begin at a path
    component, which makes far fewer.
    """
    path = F.lower("path")
    if aligned:
        parts = F.split(path, "/")
        suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    else:
        suffixes = F.transform(F.sequence(F.lit(1), F.char_length(path)), lambda i: F.substring(path, i, F.char_length(path)))
    every = files.select("file_id", F.explode(suffixes).alias("__suffix"))
    hits = names.withColumn("__suffix", F.lower("name")).join(every, "__suffix").groupBy("name").agg(F.count("*").alias("n"), F.min("file_id").alias("file_id"))
    return hits.filter("n = 1").select("name", "file_id")


def path_variants(name: str) -> list[str]:
    """Shorter and shorter suffixes of an import path with likely endings, in order of preference."""
    parts = [x for x in re.sub(r"\\|::", "/", name).strip("\"'").split("/") if x]
    out = []
    for i in range(len(parts)):
        suffix = "/".join(parts[i:])
        out.append(suffix if suffix.endswith(".php") else f"{suffix}.php")
        if "." not in suffix:
            out += [f"{suffix}{e}" for e in (".rs", ".ts", ".js", ".py")]
    return out


def resolution_cache(dependencies: DataFrame, files: DataFrame) -> DataFrame:
    """(imported_path, file_id) for every distinct imported path that one of its variants resolves.

    As ``by_variants``, but the variants are made in Spark, for any number of paths.
    """

    def variants(batches):
        for batch in batches:
            found = [(name, i, v) for name in batch.column("imported_path").to_pylist() if name for i, v in enumerate(path_variants(name))]
            columns = zip(*found) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.string()))], ["imported_path", "place", "path"])

    wanted = dependencies.select("imported_path").distinct().mapInArrow(variants, "imported_path string, place int, path string")
    return wanted.join(files.select("path", "file_id"), "path").groupBy("imported_path").agg(F.min_by("file_id", "place").alias("file_id"))


def by_variants(names: list[str], files: DataFrame) -> DataFrame:
    """(name, file_id): the file of each name's first variant that is a path."""
    rows = [(n, i, v) for n in names for i, v in enumerate(path_variants(n))]
    variants = files.sparkSession.createDataFrame(rows, "name string, place int, path string")
    return variants.join(files.select("path", "file_id"), "path").groupBy("name").agg(F.min_by("file_id", "place").alias("file_id"))


# Folders at which an absolute path begins to be of interest, in order.
MARKERS = ("services", "src", "app", "lib", "packages", "modules")


def lookup_path(path: str) -> str:
    """A path as asked for, without ./ and ../ and, if absolute, from a marker folder (or the file name) on."""
    path = re.sub(r"^(?:\./)+|^(?:\.\./)+", "", path)
    path = re.sub(r"^(?:\.\./)+", "", path)
    if path.startswith(("/", "\\")):
        for marker in MARKERS:
            if marker in path:
                return path[path.index(marker) :]
        return posixpath.basename(path)
    return path


def find_file(files: DataFrame, asked: str) -> list[tuple[int, str]]:
    """The file of a path as asked for: the exact one, else the only one with that suffix; several are an error that lists them."""
    wanted = lookup_path(asked)
    exact = files.filter(F.col("path") == wanted).select("file_id", "path").limit(1).collect()
    found = exact or files.filter(F.lower("path").endswith(wanted.lower())).select("file_id", "path").orderBy("path").limit(20).collect()
    if len(found) > 1:
        raise ValueError(f"{asked!r} may be any of {', '.join(r['path'] for r in found)}")
    return [tuple(r) for r in found]


def nearest_config(files: DataFrame, name: str = "tsconfig.json") -> DataFrame:
    """(path, config): the deepest config file in the folders above each file."""
    folder = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    parts = F.split(folder, "/")
    above = F.array_union(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/")))
    configs = files.filter((F.col("path") == name) | F.col("path").endswith(f"/{name}")).select(folder.alias("__folder"), F.col("path").alias("config"))
    return files.select("path", F.explode(above).alias("__folder")).join(configs, "__folder").groupBy("path").agg(F.max_by("config", F.length("__folder")).alias("config"))


def tsconfig_aliases(text: str, folder: str = "") -> dict[str, str]:
    """Path aliases of a tsconfig file, which may have comments and trailing commas."""
    import json

    plain = re.sub(r'("(?:\\.|[^"\\])*")|//[^\n]*|/\*.*?\*/', lambda m: m[1] or "", text, flags=re.S)
    options = json.loads(re.sub(r",(\s*[}\]])", r"\1", plain)).get("compilerOptions", {})
    base = _joined(folder, options.get("baseUrl", "."))
    return {k: _joined(base, v[0]) if not v[0].endswith("*") else _joined(base, v[0][:-1]) + "/*" for k, v in options.get("paths", {}).items() if v}


def project_of(files: DataFrame) -> Project:
    """A project's aliases and prefixes from its manifests, which are few and small."""
    wanted = F.regexp_extract("path", r"([^/]*)$", 1).isin("tsconfig.json", "go.mod", "composer.json", "pyproject.toml", "setup.py", "pom.xml", "build.gradle", "build.gradle.kts") | F.col("path").endswith(".gemspec")
    aliases: dict[str, str] = {}
    prefixes: dict[str, dict[str, str]] = {}
    for path, text in files.filter(wanted).select("path", "content").orderBy("path").toLocalIterator():
        folder, name = posixpath.dirname(path), posixpath.basename(path)
        if name == "tsconfig.json":
            aliases |= tsconfig_aliases(text, folder)
        elif name == "go.mod" and (m := re.search(r"^module\s+(\S+)", text, re.M)):
            prefixes.setdefault("Go", {})[m[1]] = folder
        elif name == "composer.json":
            import json

            for k, v in json.loads(text).get("autoload", {}).get("psr-4", {}).items():
                prefixes.setdefault("PHP", {})[k] = _joined(folder, v if isinstance(v, str) else v[0])
        elif name in ("pyproject.toml", "setup.py") and (m := re.search(r"^\s*name\s*=\s*['\"]([\w-]+)['\"]", text, re.M)):
            prefixes.setdefault("Python", {})[m[1].replace("-", "_")] = folder
        elif name.endswith(".gemspec") and (m := re.search(r"\.name\s*=\s*['\"]([\w-]+)['\"]", text)):
            # A gem is required by its name, with - or _ or /.
            for gem in {m[1], m[1].replace("-", "_"), m[1].replace("-", "/")}:
                prefixes.setdefault("Ruby", {})[gem] = folder
        elif name == "pom.xml" and (m := re.search(r"<groupId>([^<]+)</groupId>", text)):
            prefixes.setdefault("Java", {})[m[1]] = _joined(folder, "src/main/java")
            prefixes.setdefault("Kotlin", {})[m[1]] = _joined(folder, "src/main/kotlin")
        elif name.startswith("build.gradle") and (m := re.search(r"^\s*group\s*=?\s*['\"]([^'\"]+)['\"]", text, re.M)):
            prefixes.setdefault("Java", {})[m[1]] = _joined(folder, "src/main/java")
            prefixes.setdefault("Kotlin", {})[m[1]] = _joined(folder, "src/main/kotlin")
    return Project(aliases, prefixes)
