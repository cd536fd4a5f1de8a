"""Languages by file extension, their aliases, keywords and symbol kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Extension to language; extensions are case-sensitive (h is C, H is Cpp).
EXTENSIONS = {
    "rs": "Rust", "py": "Python", "js": "JavaScript", "mjs": "JavaScript", "cjs": "JavaScript", "jsx": "JavaScript",
    "ts": "TypeScript", "mts": "TypeScript", "cts": "TypeScript", "tsx": "TypeScript", "vue": "Vue", "svelte": "Svelte",
    "go": "Go", "java": "Java", "php": "PHP", "c": "C", "h": "C", "cpp": "Cpp", "cc": "Cpp", "cxx": "Cpp", "hpp": "Cpp",
    "hxx": "Cpp", "C": "Cpp", "H": "Cpp", "cs": "CSharp", "rb": "Ruby", "rake": "Ruby", "gemspec": "Ruby", "kt": "Kotlin",
    "kts": "Kotlin", "swift": "Swift", "zig": "Zig",
}
UNSUPPORTED = ("Swift", "Unknown")

# Names that a language may be asked for by.
ALIASES = {
    "rust": "Rust", "rs": "Rust", "python": "Python", "py": "Python", "javascript": "JavaScript", "js": "JavaScript",
    "typescript": "TypeScript", "ts": "TypeScript", "vue": "Vue", "svelte": "Svelte", "go": "Go", "java": "Java", "php": "PHP",
    "c": "C", "cpp": "Cpp", "c++": "Cpp", "csharp": "CSharp", "cs": "CSharp", "c#": "CSharp", "ruby": "Ruby", "rb": "Ruby",
    "kotlin": "Kotlin", "kt": "Kotlin", "zig": "Zig",
}

# Declaration keywords of each language.
KEYWORDS = {
    "Rust": ("fn", "struct", "enum", "trait", "impl", "mod", "const", "static", "type", "macro"),
    "PHP": ("class", "function", "trait", "interface", "enum"),
    "Python": ("class", "def", "async"),
    "TypeScript": ("class", "function", "interface", "type", "enum", "const", "let", "var"),
    "JavaScript": ("class", "function", "interface", "type", "enum", "const", "let", "var"),
    "Go": ("func", "struct", "interface", "type", "const", "var"),
    "Java": ("class", "interface", "enum", "@interface"),
    "C": ("struct", "enum", "union", "typedef"),
    "Cpp": ("class", "struct", "enum", "union", "typedef", "namespace", "template"),
    "CSharp": ("class", "struct", "interface", "enum", "delegate", "record", "namespace"),
    "Ruby": ("class", "module", "def"),
    "Kotlin": ("class", "fun", "interface", "object", "enum", "annotation"),
    "Zig": ("fn", "struct", "enum", "const", "var", "type"),
    "Swift": ("class", "struct", "enum", "protocol", "func", "var", "let"),
    "Vue": ("function", "const", "let", "var"),
    "Svelte": ("function", "const", "let", "var"),
}
# Keywords that switch a search to listing definitions when no language is given.
ALL_KEYWORDS = frozenset(
    "fn function def func class struct enum interface trait type record mod module namespace const static let var "
    "impl async object annotation protocol union typedef delegate template @interface".split()
)
#: Kinds that a keyword lists. namespace and record list what any language calls so.
KEYWORD_KINDS = {
    "class": ("Class",), "struct": ("Struct",), "enum": ("Enum",), "interface": ("Interface",), "trait": ("Trait",), "type": ("Type",),
    "record": ("Struct", "Type"), "function": ("Function",), "fn": ("Function",), "def": ("Function",), "func": ("Function",),
    "const": ("Constant",), "static": ("Constant",), "var": ("Variable",), "let": ("Variable",),
    "mod": ("Module",), "module": ("Module",), "namespace": ("Module", "Namespace"),
}
KINDS = (
    "Function Class Struct Enum Interface Trait Constant Variable Method Module Namespace Type Macro Property Event Import Export Attribute"
).split()


def language_of(path: Column) -> Column:
    """The language of a path by its extension; Unknown without a known one."""
    ext = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    table = F.create_map(*[F.lit(x) for pair in EXTENSIONS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, ext), F.lit("Unknown"))


def resolve_language(name: str) -> str:
    try:
        return ALIASES[name.lower()]
    except KeyError:
        raise ValueError(f"unknown language {name!r}; known: {', '.join(sorted(ALIASES))}") from None


def resolve_kind(name: str) -> str:
    """Function for function, FUNCTION and so on; text that is no kind stays as it is."""
    told = name[:1].upper() + name[1:].lower()
    return told if told in KINDS else name


def is_keyword(pattern: str, language: str | None = None) -> bool:
    return pattern in (KEYWORDS.get(language, ()) if language else ALL_KEYWORDS)
