"""Definitions in source files: (path, language, kind, symbol, start_line, end_line, preview) rows.

Python files are parsed with the standard library's parser. Other languages are scanned
for declarations by a table of patterns on code with comments and strings blanked out;
a declaration's span ends with its brackets (or Ruby's matching ``end``). A scanner knows
less than a parser: declarations split over lines in unusual ways may be missed, and a
broken Python file is scanned like the others.
"""

from __future__ import annotations

import ast
import bisect
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.functions.languages import KEYWORD_KINDS, is_keyword
from corvine.operators import syntax
from corvine.operators.comments import SYNTAX

SCHEMA = "path string, language string, kind string, symbol string, start_line int, end_line int, preview string"
PREVIEW_LINES = 7

_NAME = r"([A-Za-z_$][\w$]*)"
_JS = (
    ("Class", rf"\bclass\s+{_NAME}"), ("Interface", rf"\binterface\s+{_NAME}"), ("Enum", rf"\benum\s+{_NAME}"),
    ("Type", rf"^\s*(?:export\s+)?(?:declare\s+)?type\s+{_NAME}\s*(?:<[^=]*>)?\s*="),
    ("Function", rf"\bfunction\s*\*?\s*{_NAME}\s*[(<]"),
    ("Function", rf"\b(?:const|let|var)\s+{_NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>"),
    ("Constant", rf"\bconst\s+{_NAME}\b(?!\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>)"),
    ("Variable", rf"\b(?:let|var)\s+{_NAME}\b(?!\s*(?::[^=]+)?=\s*(?:async\s*)?(?:\([^)]*\)|[\w$]+)\s*(?::[^=]+)?=>)"),
)
_JS_METHOD = rf"^\s*(?:(?:public|private|protected|static|async|readonly|override|abstract|get|set)\s+)*\*?#?{_NAME}\s*(?:<[^>]*>)?\([^;]*\)\s*(?::[^{{;]+)?\{{"
_JVM_MODS = r"(?:(?:public|private|protected|internal|static|final|abstract|sealed|virtual|override|async|partial|readonly|synchronized|native|extern|unsafe|new|default)\s+)*"
_TYPE = r"[A-Za-z_][\w.<>,?\[\]\s&*:]*?"
#: Language to its declarations (kind, pattern whose first group is the name) and to the kinds whose blocks hold methods.
DECLARATIONS = {
    "Rust": (
        ("Function", r"\bfn\s+(?:r#)?(\w+)"), ("Struct", r"\bstruct\s+(\w+)"), ("Enum", r"\benum\s+(\w+)"), ("Trait", r"\btrait\s+(\w+)"),
        ("Constant", r"^\s*(?:pub(?:\([^)]*\))?\s+)?const\s+(?!fn\b|unsafe\b|async\b)(\w+)\s*:"), ("Variable", r"\bstatic\s+(?:mut\s+)?(\w+)\s*:"),
        ("Variable", r"\blet\s+(?:mut\s+)?(\w+)\s*[:=;]"), ("Module", r"^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)"),
        ("Type", r"^\s*(?:pub(?:\([^)]*\))?\s+)?type\s+(\w+)"), ("Macro", r"\bmacro_rules!\s*(\w+)"), ("Attribute", r"#\[proc_macro_attribute\].*?fn\s+(\w+)"),
    ),
    "TypeScript": _JS, "JavaScript": _JS, "Vue": _JS[-4:], "Svelte": (*_JS[-4:], ("Variable", r"^\s*\$:\s*([A-Za-z_$][\w$]*)\s*=")),
    "Go": (
        ("Function", r"^func\s+(\w+)\s*[(\[]"), ("Method", r"^func\s*\([^)]*\)\s*(\w+)\s*[(\[]"), ("Struct", r"^\s*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+struct\b"),
        ("Interface", r"^\s*(?:type\s+)?(\w+)(?:\[[^\]]*\])?\s+interface\b"), ("Constant", r"^\s*const\s+(\w+)"), ("Variable", r"^\s*var\s+(\w+)"),
    ),
    "Java": (
        ("Class", r"\bclass\s+(\w+)"), ("Attribute", r"@interface\s+(\w+)"), ("Interface", r"(?<!@)\binterface\s+(\w+)"), ("Enum", r"\benum\s+(\w+)"),
        ("Variable", rf"^\s*{_JVM_MODS}(?!return\b|package\b|import\b|throw\b|new\b|else\b){_TYPE}\s+(\w+)\s*(?:=[^=]|;)"),
    ),
    "C": (
        ("Function", rf"^(?!\s*(?:return|else|typedef)\b){_TYPE}[\s*]+(\w+)\s*\([^;{{}}]*\)\s*\{{"), ("Struct", r"\bstruct\s+(\w+)\s*\{"), ("Enum", r"\benum\s+(\w+)\s*\{"),
        ("Type", r"\bunion\s+(\w+)\s*\{"), ("Type", r"\btypedef\b[^;{}]*?\b(\w+)\s*;"), ("Type", r"^\}\s*(\w+)\s*;"),
        ("Variable", rf"^\s*(?!return\b|typedef\b|goto\b|else\b|#){_TYPE}[\s*]+(\w+)\s*(?:\[[^\]]*\])?\s*(?:=[^=]|;)"), ("Macro", r"^\s*#\s*define\s+(\w+)"),
    ),
    "Cpp": (
        ("Function", rf"^(?!\s*(?:return|else|typedef|if|for|while|switch)\b){_TYPE}[\s*&]+(\w+)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:noexcept\s*)?\{{"),
        ("Method", r"\b\w+::(~?\w+)\s*\([^;{}]*\)\s*(?:const\s*)?(?::[^{;]*)?\{"), ("Class", r"(?<!enum )\bclass\s+(\w+)\s*(?:final\s*)?[:{]"), ("Struct", r"(?<!enum )\bstruct\s+(\w+)\s*(?:final\s*)?[:{]"),
        ("Namespace", r"\bnamespace\s+([\w:]+)\s*\{"), ("Enum", r"\benum\s+(?:class\s+|struct\s+)?(\w+)"), ("Type", r"\busing\s+(\w+)\s*="), ("Type", r"\btypedef\b[^;{}]*?\b(\w+)\s*;"),
        ("Variable", rf"^\s*(?!return\b|using\b|typedef\b|namespace\b|else\b|#){_TYPE}[\s*&]+(\w+)\s*(?:\[[^\]]*\])?\s*(?:=[^=]|;)"),
    ),
    "CSharp": (
        ("Namespace", r"\bnamespace\s+([\w.]+)"), ("Class", r"\bclass\s+(\w+)"), ("Interface", r"\binterface\s+(\w+)"), ("Struct", r"\bstruct\s+(\w+)"), ("Enum", r"\benum\s+(\w+)"),
        ("Type", r"\brecord\s+(?:class\s+|struct\s+)?(\w+)"), ("Type", r"\bdelegate\s+[\w<>\[\],.?\s]+?\s(\w+)\s*[(<]"), ("Event", r"\bevent\s+[\w<>.?]+\s+(\w+)"),
        ("Property", r"\b(this)\s*\["), ("Attribute", r"\bclass\s+(\w+)\s*:\s*(?:\w+\.)*Attribute\b"),
        ("Variable", rf"^\s*{_JVM_MODS}(?!return\b|using\b|throw\b|namespace\b|new\b|else\b){_TYPE}\s+(\w+)\s*(?:=[^=>]|;|\{{\s*(?:get|set|init)\b)"),
    ),
    "PHP": (
        ("Function", r"\bfunction\s+&?(\w+)\s*\("), ("Class", r"\bclass\s+(\w+)"), ("Interface", r"\binterface\s+(\w+)"), ("Trait", r"\btrait\s+(\w+)"), ("Enum", r"\benum\s+(\w+)"),
        ("Namespace", r"^\s*namespace\s+([\w\\]+)"), ("Constant", r"\bconst\s+(?:\w+\s+)?(\w+)\s*="), ("Attribute", r"#\[Attribute[^\]]*\].*?class\s+(\w+)"),
        ("Variable", r"^\s*(?:(?:public|private|protected|static|readonly|var)\s+)+(?:[?\w\\|]+\s+)?\$(\w+)"), ("Variable", r"^\s*\$(\w+)\s*=[^=]"),
    ),
    "Ruby": (
        ("Module", r"^\s*module\s+([\w:]+)"), ("Class", r"^\s*class\s+([A-Z][\w:]*)"), ("Method", r"^\s*def\s+(?:self\.)?([\w?!=]+)"), ("Constant", r"^\s*([A-Z][A-Z0-9_]*)\s*=[^=~]"),
        ("Variable", r"^\s*(@{0,2}[a-z_]\w*)\s*(?:\|\|)?=[^=~]"), ("Property", r"^\s*attr_(?:reader|writer|accessor)\s+:(\w+)"),
    ),
    "Kotlin": (
        ("Class", r"(?<!annotation )\bclass\s+(\w+)"), ("Class", r"\bobject\s+(\w+)"), ("Interface", r"\binterface\s+(\w+)"), ("Attribute", r"\bannotation\s+class\s+(\w+)"),
        ("Constant", r"\bval\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"), ("Variable", r"\bvar\s+(?:<[^>]*>\s*)?(?:\w+\.)?(\w+)"),
    ),
    "Zig": (
        ("Function", r"\bfn\s+(\w+)\s*\("), ("Function", r"^\s*test\s+\"([^\"]*)\""), ("Struct", r"\bconst\s+(\w+)\s*=\s*(?:packed\s+|extern\s+)?struct\b"), ("Enum", r"\bconst\s+(\w+)\s*=\s*enum\b"),
        ("Constant", r"\bconst\s+(\w+)\s*(?::[^=]+)?="), ("Variable", r"\bvar\s+(\w+)\s*[:=]"),
    ),
}
_MEMBER = rf"^\s*(?:@\w+(?:\([^)]*\))?\s*)*{_JVM_MODS}(?:<[^>]*>\s*)?(?:{_TYPE}\s+)?(\w+)\s*\([^;{{}}]*\)\s*(?:throws\s+[\w.,\s]+)?(?:where\s[^{{]*)?(?:\{{|=>|;)"
#: Language to (pattern of what opens a block with methods, pattern of a method in it).
METHODS = {
    **dict.fromkeys(("TypeScript", "JavaScript"), (r"\b(?:class|interface)\b[^;{]*\{", _JS_METHOD)),
    "Rust": (r"\bimpl\b[^;{]*\{", r"\bfn\s+(?:r#)?(\w+)"),
    "Java": (r"\b(?:class|interface|enum|record)\b[^;{]*\{", _MEMBER),
    "CSharp": (r"\b(?:class|interface|struct|record)\b[^;{]*\{", _MEMBER),
    "Cpp": (r"\b(?:class|struct)\b[^;{(]*\{", rf"^\s*(?:(?:virtual|static|inline|explicit|constexpr)\s+)*(?:{_TYPE}[\s*&]+)?(~?\w+)\s*\([^;{{}}]*\)\s*(?:const\s*)?(?:override\s*)?(?:noexcept\s*)?(?::[^{{;]*)?\{{"),
    "PHP": (r"\b(?:class|interface|trait|enum)\b[^;{]*\{", r"\bfunction\s+&?(\w+)\s*\("),
    "Kotlin": (r"\b(?:class|object|interface)\b[^;{]*\{", r"\bfun\s+(?:<[^>]*>\s*)?(?:[\w.<>?]+\.)?(\w+)\s*\("),
}
_NOT_NAMES = frozenset("if for while switch catch return else do try new throw function with using lock foreach sizeof when synchronized super this".split())
_NAMES = {"Rust": {"new", "with", "function", "super"}}
_RUBY_OPENS = re.compile(r"^\s*(?:class|module|def|if|unless|while|until|case|begin|for)\b|\bdo\b(?:\s*\|[^|]*\|)?\s*$")


def blanked(language: str, text: str) -> str:
    """The text with comments and the insides of strings as spaces, line breaks kept."""
    syntax = SYNTAX.get(language)
    if syntax is None:
        return text
    strings = [rf"{re.escape(a)}.*?{re.escape(b)}" for a, b in syntax.raw]
    quotes = [rf"{q}(?:\\.|[^{q}\\\n])*{q}" for q in syntax.quotes if not (q == "'" and language in ("Rust", "C", "Cpp", "Java", "Go", "CSharp", "Kotlin", "Zig"))]
    comments = [rf"{re.escape(m)}(?!\[)[^\n]*" if m == "#" else rf"{re.escape(m)}[^\n]*" for m in syntax.marks] + [r"/\*.*?\*/"] * syntax.blocks
    pattern = re.compile("|".join([*strings, *comments, *quotes]), re.S)

    def blank(m: re.Match) -> str:
        inner = re.sub(r"[^\n]", " ", m[0])
        return m[0][0] + inner[1:-1] + m[0][-1] if m[0][0] in "\"'`" and len(m[0]) > 1 else inner

    return pattern.sub(blank, text)


def block_end(code: str, start: int) -> int:
    """Where the declaration at ``start`` ends: its closing bracket, or the ; or line's end before any bracket opens."""
    depth, i = 0, start
    while i < len(code):
        c = code[i]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth <= 0 and c == "}":
                return i
            if depth < 0:
                return max(start, i - 1)
        elif c == ";" and depth == 0:
            return i
        elif c == "\n" and depth == 0 and not re.match(r"\s*(?:\{|where\b|throws\b|:|extends\b|implements\b|->|=>|=|\.)", code[i + 1 :]) and code[start:i].rstrip()[-1:] not in "=,>(":
            return i
        i += 1
    return len(code) - 1


def scripts(text: str) -> Iterator[tuple[int, str]]:
    """(lines before, text) of each <script> block of a component file."""
    for m in re.finditer(r"<script[^>]*>(.*?)</script>", text, re.S):
        yield text.count("\n", 0, m.start(1)), m[1]


def scan(language: str, text: str) -> list[tuple[str, str, int, int]]:
    """(kind, name, start_line, end_line) of the declarations found by the tables."""
    if language in ("Vue", "Svelte"):
        return [(k, n, a + before, b + before) for before, part in scripts(text) for k, n, a, b in _scan(language, part)]
    return _scan(language, text)


def _scan(language: str, text: str) -> list[tuple[str, str, int, int]]:
    code = blanked("JavaScript" if language in ("Vue", "Svelte") else language, text)
    breaks = [-1, *(m.start() for m in re.finditer("\n", code))]
    out: set[tuple[str, str, int, int]] = set()

    def line_at(at: int) -> int:
        return bisect.bisect_left(breaks, at)

    def add(kind: str, m: re.Match, limit: int | None = None) -> None:
        name = m[1]
        if name in _NOT_NAMES and name not in _NAMES.get(language, ()):
            return
        begin = m.start() + len(m[0]) - len(m[0].lstrip())
        start = line_at(m.start(1))
        end = _ruby_end(code, breaks, line_at(begin)) if language == "Ruby" and kind in ("Class", "Module", "Method") else line_at(block_end(code, begin))
        out.add((kind, name, min(start, line_at(begin)), max(end, start)))

    source = text if language in ("C", "Zig") else code
    for kind, pattern in DECLARATIONS.get(language, ()):
        for m in re.finditer(pattern, source if kind in ("Macro",) or '"' in pattern else code, re.M):
            add(kind, m)
    if language in METHODS:
        opens, method = METHODS[language]
        spans = [(m.end(), block_end(code, m.start())) for m in re.finditer(opens, code)]
        for a, b in spans:
            for m in re.compile(method, re.M).finditer(code, a, b):
                before = code[a : m.start(1)]
                if before.count("{") == before.count("}"):
                    add("Method", m)
                    if language == "PHP":
                        out -= {("Function", *x[1:]) for x in out if x[0] == "Method"}
    return sorted(out, key=lambda s: (s[2], s[3], s[0], s[1]))


def _ruby_end(code: str, breaks: list[int], start: int) -> int:
    depth = 0
    lines = code.split("\n")
    for no in range(start, len(lines) + 1):
        line = lines[no - 1]
        if re.search(r"^\s*def\s.*=\s*\S|;\s*end\s*$", line):
            pass
        elif _RUBY_OPENS.search(line):
            depth += 1
        if re.search(r"^\s*end\b", line):
            depth -= 1
        if depth <= 0:
            return no
    return len(lines)


def python_symbols(text: str) -> list[tuple[str, str, int, int]]:
    """Definitions of a Python file; raises SyntaxError where it does not parse."""
    out: list[tuple[str, str, int, int]] = []

    def named(target: ast.expr) -> Iterator[str]:
        if isinstance(target, ast.Name):
            yield target.id
        elif isinstance(target, (ast.Tuple, ast.List)):
            for x in target.elts:
                yield from named(x)

    def visit(node: ast.AST, where: str) -> None:
        for child in ast.iter_child_nodes(node):
            inner = where
            if isinstance(child, ast.ClassDef):
                out.append(("Class", child.name, child.lineno, child.end_lineno))
                inner = "class"
            elif isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef)):
                out.append(("Method" if where == "class" else "Function", child.name, child.lineno, child.end_lineno))
                inner = "function"
            elif isinstance(child, (ast.Assign, ast.AnnAssign)):
                targets = child.targets if isinstance(child, ast.Assign) else [child.target]
                for name in (n for t in targets for n in named(t)):
                    if isinstance(child.value, ast.Lambda):
                        kind = "Function"
                    elif where == "module" and re.fullmatch(r"[A-Z][A-Z0-9_]*", name):
                        kind = "Constant"
                    else:
                        kind = "Variable"
                    out.append((kind, name, child.lineno, child.end_lineno))
            visit(child, inner)

    visit(ast.parse(text), "module")
    return sorted(out, key=lambda s: (s[2], s[3], s[0], s[1]))


PYTHON_FALLBACK = (("Class", r"^\s*class\s+(\w+)"), ("Function", r"^\s*(?:async\s+)?def\s+(\w+)"))


def extract(language: str, text: str) -> list[tuple[str, str, int, int]]:
    if language != "Python":
        return scan(language, text)
    try:
        return python_symbols(text)
    except (SyntaxError, ValueError, RecursionError):
        found = [(k, m[1], text.count("\n", 0, m.start(1)) + 1) for k, p in PYTHON_FALLBACK for m in re.finditer(p, text, re.M)]
        return sorted(((k, n, a, a) for k, n, a in found), key=lambda s: (s[2], s[0], s[1]))


def symbols(files: DataFrame) -> DataFrame:
    """All definitions of the files; files of languages without a scanner give none."""

    def rows(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content"))):
                text = content or ""
                split = text.split("\n")
                for kind, name, start, end in extract(language, text) if language in DECLARATIONS or language == "Python" else ():
                    preview = "\n".join(x.removesuffix("\r") for x in split[start - 1 : start - 1 + PREVIEW_LINES])
                    for c, v in zip(columns, (path, language, kind, name, start, end, preview)):
                        c.append(v)
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")])

    return files.select("path", "language", "content").mapInArrow(rows, SCHEMA)


def of_kind(rows: DataFrame, kind: str) -> DataFrame:
    """Rows of a kind; functions are listed with methods."""
    return rows.filter(F.col("kind").isin("Function", "Method") if kind == "Function" else F.col("kind") == kind)


def by_keyword(rows: DataFrame, keyword: str) -> DataFrame:
    """Rows of the kinds that a keyword lists; all rows for one that names no kind."""
    kinds = KEYWORD_KINDS.get(keyword)
    if kinds is None:
        return rows
    return rows.filter(F.col("kind").isin(*kinds, *(("Method",) if "Function" in kinds else ())))


def named(rows: DataFrame, pattern: str, contains: bool = False, language: str | None = None) -> DataFrame:
    """Rows whose name equals (or contains) the pattern; a keyword of the language does not filter names."""
    if is_keyword(pattern, language):
        return rows
    return rows.filter(F.col("symbol").contains(pattern) if contains else F.col("symbol") == pattern)


def spanning(rows: DataFrame, lines: DataFrame) -> DataFrame:
    """Rows whose span holds one of the lines (path, line_no): a semi-join on path and range."""
    hit = lines.select(F.col("path").alias("__path"), F.col("line_no").alias("__line"))
    return rows.join(hit, (F.col("path") == F.col("__path")) & F.col("__line").between(F.col("start_line"), F.col("end_line")), "left_semi")


def python_nodes(files: DataFrame, node_type: str) -> DataFrame:
    """Syntax-tree search in Python files: one row for each node of a type of the standard ``ast`` module, such as ``Call``.

    For S-expressions see ``python_matches``; other languages' trees need grammar libraries that are not available here.
    """

    def rows(batches):
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content"))):
                try:
                    tree = ast.parse(content or "")
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for node in ast.walk(tree):
                    if type(node).__name__ == node_type and hasattr(node, "lineno"):
                        kind = {"ClassDef": "Class", "FunctionDef": "Function", "AsyncFunctionDef": "Function"}.get(node_type, "ast_match")
                        for c, v in zip(columns, (path, language, kind, getattr(node, "name", None), node.lineno, node.end_lineno, ast.get_source_segment(content, node))):
                            c.append(v)
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")])

    return files.filter("language = 'Python'").select("path", "language", "content").mapInArrow(rows, SCHEMA)


def python_matches(files: DataFrame, pattern: str) -> DataFrame:
    """Matches of an S-expression in Python files: one row for each capture, its text as preview, its name as symbol where it has one."""
    syntax.compiled(pattern)
    names = {"class_definition": "Class", "function_definition": "Function"}

    def rows(batches):
        patterns = syntax.compiled(pattern)
        for batch in batches:
            columns: list[list] = [[] for _ in range(7)]
            for path, language, content in zip(*(batch.column(c).to_pylist() for c in ("path", "language", "content"))):
                try:
                    found = list(syntax.captures(patterns, content or ""))
                except (SyntaxError, ValueError, RecursionError):
                    continue
                for _, node in found:
                    name = next((c.text for label, c in node.children if label == "name"), node.text if node.kind == "identifier" else None)
                    for c, v in zip(columns, (path, language, names.get(node.kind, "ast_match"), name, node.start, node.end, node.text)):
                        c.append(v)
            types = (pa.string(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], [x.split()[0] for x in SCHEMA.split(", ")])

    return files.filter("language = 'Python'").select("path", "language", "content").mapInArrow(rows, SCHEMA)


def cache_stats(cache: DataFrame) -> DataFrame:
    """(files, symbols, bytes) of a table of stored symbols: distinct paths, rows, and bytes of what is shown of them."""
    return cache.groupBy("path").agg(F.count("*").alias("n"), F.sum(F.octet_length("symbol") + F.octet_length("preview")).alias("b")).agg(
        F.count("*").alias("files"), F.coalesce(F.sum("n"), F.lit(0)).alias("symbols"), F.coalesce(F.sum("b"), F.lit(0)).alias("bytes")
    )


def cached(files: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of a cache (with file_hash) that still hold, and the files that must be parsed again."""
    now = files.select("path", F.sha2("content", 256).alias("file_hash"))
    known = cache.select("path", "file_hash").distinct()
    return cache.join(now, ["path", "file_hash"], "left_semi"), files.withColumn("file_hash", F.sha2("content", 256)).join(known, ["path", "file_hash"], "left_anti")
