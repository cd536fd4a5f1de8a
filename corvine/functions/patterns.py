"""Patterns: word and regular-expression matches, globs, and literals that a regex needs."""

from __future__ import annotations

import re
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F


def quoted(text: str) -> str:
    """A Java regex that matches the text and nothing else."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def word_match(line: Column, pattern: str) -> Column:
    """Whether the pattern stands in the line between word boundaries (Unicode)."""
    return line.contains(pattern) & line.rlike(rf"(?U)\b{quoted(pattern)}\b")


def checked(pattern: str) -> str:
    """The pattern in Java's dialect; lookaround and back-references, which linear-time engines lack, are refused."""
    if re.search(r"(?<!\\)(?:\\\\)*(\(\?(?:[=!]|<[=!])|\\[1-9]|\\k<)", pattern):
        raise ValueError("lookaround and back-references are not supported")
    return f"(?U){pattern}"


def regex_match(line: Column, pattern: str) -> Column:
    """Whether the regex matches somewhere in the line; the literals that a match needs are tested first."""
    return holds_literals(line, pattern) & line.rlike(checked(pattern))


def holds_literals(text: Column, pattern: str) -> Column:
    """Whether a text has all the literals that one of a regex's branches needs."""
    branches = literal_branches(pattern)
    if not all(branches):
        return F.lit(True)
    return reduce(or_, (reduce(and_, (text.contains(x) for x in literals)) for literals in branches))


def required_literals(pattern: str, least: int = 3) -> list[str]:
    """Literals of at least ``least`` bytes that every match contains.

    Only runs of plain characters outside groups, classes and alternatives count, and a
    character before an optional quantifier ends the run before it. Inline flags give none.
    """
    if "|" in pattern or "(?" in pattern:
        return []
    runs, run, i, depth = [], "", 0, 0

    def end() -> None:
        nonlocal run
        if len(run.encode()) >= least:
            runs.append(run)
        run = ""

    while i < len(pattern):
        c = pattern[i]
        taken = None
        if c == "\\" and i + 1 < len(pattern):
            taken = pattern[i + 1] if not pattern[i + 1].isalnum() else None
            i += 1
            if taken is None:
                end()
                # What an escape takes as argument is no literal.
                if pattern[i] in "pPxu" and i + 1 < len(pattern):
                    i = pattern.find("}", i) if pattern[i + 1] == "{" else i + {"x": 2, "u": 4}.get(pattern[i], 1)
        elif c == "[":
            end()
            i += 1 + (pattern[i + 1 : i + 2] == "^")
            i += pattern[i : i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                i += 1 + (pattern[i] == "\\")
        elif c == "(":
            end()
            depth += 1
        elif c == ")":
            end()
            depth -= 1
        elif c in ".^$*+?{":
            end()
            if c == "{":
                i = max(i, pattern.find("}", i))
        else:
            taken = c
        if taken is not None and depth == 0:
            following = pattern[i + 1 : i + 2]
            if following and following in "?*{+":
                end()
                if following == "+":
                    run = taken
                    end()
            else:
                run += taken
        i += 1
    end()
    return runs


def _split_top(pattern: str) -> list[str]:
    """A pattern cut at the ``|`` outside groups, classes and escapes."""
    parts, start, depth, i = [], 0, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i += 1 + (pattern[i + 1 : i + 2] == "^")
            i += pattern[i : i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                i += 1 + (pattern[i] == "\\")
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c == "|" and depth == 0:
            parts.append(pattern[start:i])
            start = i + 1
        i += 1
    return [*parts, pattern[start:]]


def _first_group(pattern: str) -> tuple[int, int] | None:
    """Where the first group outside classes and escapes opens, and closes."""
    opened, depth, i = None, 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            i += 1
        elif c == "[":
            i += 1 + (pattern[i + 1 : i + 2] == "^")
            i += pattern[i : i + 1] == "]"
            while i < len(pattern) and pattern[i] != "]":
                i += 1 + (pattern[i] == "\\")
        elif c == "(":
            opened, depth = (i if not depth else opened), depth + 1
        elif c == ")":
            depth -= 1
            if not depth:
                return opened, i
        i += 1
    return None


def literal_branches(pattern: str, least: int = 3, most: int = 64) -> list[list[str]]:
    """For each alternative of a regex, literals that its every match contains; an empty list for one that needs none.

    Alternatives are those at the top and those of plain groups without a quantifier, which are
    multiplied out up to ``most`` branches; beyond that a group counts as needing nothing.
    """
    if "\\Q" in pattern or re.search(r"\(\?(?!:)", pattern):
        return [[]]
    done, open_ = [], _split_top(pattern)
    while open_:
        branch = open_.pop(0)
        group = _first_group(branch)
        if group is None or len(done) + len(open_) >= most:
            done.append(required_literals(branch, least))
            continue
        a, b = group
        inner = branch[a + 1 : b].removeprefix("?:")
        head, tail = branch[:a], branch[b + 1 :]
        if tail[:1] in ("?", "*", "{", "+"):
            # What a repeated group holds is not counted on; a class in its place ends the literals around it.
            done_tail = re.sub(r"^(?:[?*+]|\{[^}]*\})[?+]?", "", tail)
            open_.insert(0, f"{head}[x]{done_tail}")
        else:
            parts = _split_top(inner)
            if len(done) + len(open_) + len(parts) > most:
                open_.insert(0, f"{head}[x]{tail}")
            else:
                open_ = [f"{head}{x}{tail}" for x in parts] + open_
    return done


def glob_regex(glob: str, strict: bool = False) -> str:
    """A whole-path regex for a glob with *, **, ?, [...] and {a,b}; ``*`` crosses / unless strict."""
    glob = glob.removeprefix("./")
    out, i, open_ = "", 0, 0
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**/", i) and (i == 0 or glob[i - 1] == "/"):
            out += "(?:.*/)?"
            i += 2
        elif glob.startswith("**", i):
            out += ".*"
            i += 1
        elif c == "*":
            out += "[^/]*" if strict else ".*"
        elif c == "?":
            out += "[^/]" if strict else "."
        elif c == "[":
            end = glob.find("]", i + 2)
            if end < 0:
                raise ValueError(f"unclosed class in glob {glob!r}")
            inner = glob[i + 1 : end].replace("\\", "\\\\").replace("[", "\\[")
            out += "[" + ("^" + inner[1:] if inner[0] in "!^" else inner) + "]"
            i = end
        elif c == "{":
            out += "(?:"
            open_ += 1
        elif c == "}" and open_:
            out += ")"
            open_ -= 1
        elif c == "," and open_:
            out += "|"
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out += quoted(glob[i])
        else:
            out += c if c.isalnum() or c in "_/" else quoted(c)
        i += 1
    if open_:
        raise ValueError(f"unclosed alternative in glob {glob!r}")
    return f"(?s)^{out}$"


def glob_match(path: Column, globs: list[str], strict: bool = False) -> Column:
    """Whether any glob matches; invalid ones are left out, and with none the answer is no."""
    found = F.lit(False)
    for g in globs:
        try:
            found = found | path.rlike(glob_regex(g, strict))
        except ValueError:
            continue
    return found


def truncated(text: Column, most: int = 100) -> Column:
    """Text of over ``most`` bytes is cut at its last white space within that many characters, or there, and marked."""
    head = F.substring(text, 1, most)
    broken = F.regexp_extract(head, r"(?s)^(.*)\s", 1)
    return F.when(F.octet_length(text) <= most, text).otherwise(F.concat(F.when(head.rlike(r"\s"), broken).otherwise(head), F.lit("…")))


def human_size(size: int) -> str:
    for unit, shift in (("TB", 40), ("GB", 30), ("MB", 20), ("KB", 10)):
        if size >= 1 << shift:
            return f"{size / (1 << shift):.2f} {unit}"
    return f"{size} bytes"
