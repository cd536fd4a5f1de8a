"""Whether a pattern stands in code, or only in comments and strings of its line.

One scanner serves all languages; a language gives its line-comment marks, whether it has
block comments, and its string delimiters. As in a line-based tool, a mark counts wherever
it stands on the line (an address's // begins a comment) and no state passes between lines.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Syntax:
    marks: tuple[str, ...]
    blocks: bool
    #: Delimiters in which no escapes count, tried first: (open, close).
    raw: tuple[tuple[str, str], ...]
    quotes: str


_C = Syntax(("//",), True, (), '"')
# Comment marks and string delimiters.
SYNTAX = {
    "Rust": Syntax(("//",), True, (('r##"', '"##'), ('r#"', '"#'), ('r"', '"')), '"'),
    "C": _C, "Cpp": Syntax(("//",), True, (('R"(', ')"'),), '"'), "Java": _C,
    "Go": Syntax(("//",), True, (("`", "`"),), '"'),
    "CSharp": Syntax(("//",), True, (('@"', '"'),), '"'),
    "Kotlin": Syntax(("//",), True, (('"""', '"""'),), '"'),
    **dict.fromkeys(("JavaScript", "TypeScript", "Vue", "Svelte"), Syntax(("//",), True, (), "\"'`")),
    "Python": Syntax(("#",), False, (('"""', '"""'), ("'''", "'''")), "\"'"),
    "Ruby": Syntax(("#",), False, (), "\"'"),
    "PHP": Syntax(("//", "#"), True, (), "\"'"),
    "Zig": Syntax(("//",), False, (), '"'),
}


def in_comment(syntax: Syntax, line: str, at: int) -> bool:
    if any(0 <= line.find(mark) <= at for mark in syntax.marks):
        return True
    begin = line.find("/*") if syntax.blocks else -1
    if not 0 <= begin <= at:
        return False
    end = line.find("*/", begin)
    return end < 0 or at < end + 2


def in_string(syntax: Syntax, line: str, at: int) -> bool:
    for open_, close in syntax.raw:
        begin = line.find(open_)
        if 0 <= begin <= at:
            end = line.find(close, begin + len(open_))
            if end >= 0 and at < end + len(close):
                return True
    inside, escaped = "", False
    for c in line[:at]:
        if escaped:
            escaped = False
        elif inside and c == "\\":
            escaped = True
        elif c in syntax.quotes and inside in ("", c):
            inside = "" if inside else c
    return bool(inside)


def stands_in_code(language: str, line: str, pattern: str) -> bool:
    """Whether some occurrence of the pattern in the line is neither in a comment nor in a string."""
    syntax = SYNTAX.get(language)
    at = line.find(pattern)
    while at >= 0:
        if syntax is None or not (in_comment(syntax, line, at) or in_string(syntax, line, at)):
            return True
        at = line.find(pattern, at + 1)
    return False


def code_occurrence(language: Column, line: Column, pattern: str) -> Column:
    @F.pandas_udf("boolean")
    def found(languages: pd.Series, lines: pd.Series) -> pd.Series:
        return pd.Series([stands_in_code(a, b, pattern) for a, b in zip(languages, lines)], dtype=bool)

    return found(language, line)


def without_comment_files(files: DataFrame, lines: DataFrame, pattern: str) -> DataFrame:
    """The files but those that hold the pattern in comments and strings only. Files without the pattern stay."""
    holding = lines.filter(F.col("line").contains(pattern))
    in_code = holding.groupBy("file_id").agg(F.bool_or(code_occurrence(F.col("language"), F.col("line"), pattern)).alias("in_code"))
    return files.join(in_code.filter("NOT in_code"), "file_id", "left_anti")
