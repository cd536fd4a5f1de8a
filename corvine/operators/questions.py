"""Deterministic parts of answering questions: documentation sections, judging results, hints, command strings."""

from __future__ import annotations

import argparse
import shlex

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvine.sources.corpus import lines

# Words of a question that say nothing about its subject.
STOP_WORDS = frozenset(
    "the a an and or but in on at to for of with by from is are was were be been being have has had do does did will would should could may might "
    "can what how where when why which who".split()
)


def keywords(question: str) -> list[str]:
    return [w for w in question.lower().split() if w not in STOP_WORDS and len(w.encode()) > 2]


def sections(files: DataFrame, question: str, least: int = 2, most: int = 3) -> DataFrame:
    """(path, section, title, score, text): the first sections of each file that score at least ``least``.

    A section runs from a heading (#) to the next. A heading scores 10 for each keyword it
    holds, every line one for each; the text runs from the first hit on.
    """
    words = keywords(question)
    if not words:
        return files.sparkSession.createDataFrame([], "path string, section int, title string, score int, text string")
    rows = lines(files).withColumn("heading", F.col("line").startswith("#"))
    hits = sum((F.lower("line").contains(w).cast("int") for w in words), F.lit(0))
    rows = rows.withColumn("hits", hits).withColumn("section", F.sum(F.col("heading").cast("int")).over(W.partitionBy("file_id").orderBy("line_no")).cast("int"))
    first_hit = F.min(F.when(F.col("hits") > 0, F.col("line_no"))).over(W.partitionBy("file_id", "section"))
    scored = rows.withColumn("from_line", first_hit).groupBy("file_id", "path", "section").agg(
        F.sum(F.col("hits") + F.when(F.col("heading"), 10 * F.col("hits")).otherwise(0)).cast("int").alias("score"),
        F.max(F.when(F.col("heading"), F.trim(F.regexp_replace("line", "^#+", "")))).alias("title"),
        F.sort_array(F.collect_list(F.when(F.col("line_no") >= F.col("from_line"), F.struct("line_no", "line")))).alias("kept"),
    )
    kept = scored.filter(F.col("score") >= least).withColumn("rank", F.row_number().over(W.partitionBy("file_id").orderBy("section"))).filter(F.col("rank") <= most)
    return kept.select("path", "section", F.coalesce("title", F.lit("")).alias("title"), "score", F.trim(F.array_join(F.transform("kept", lambda x: x["line"]), "\n")).alias("text"))


# Words of a question that name a language or a kind of folder, and what results should then have.
EXTENSION_HINTS = {
    "rust": ("rs",), "python": ("py",), "typescript": ("ts", "tsx"), "javascript": ("js", "jsx"), "java": ("java",), "go": ("go",),
    "c++": ("cpp", "cc", "cxx", "hpp", "h"), "c#": ("cs",), "ruby": ("rb",), "php": ("php",),
}
FOLDER_HINTS = {
    "test": ("test", "tests", "spec", "__tests__"), "source": ("src", "lib", "app"), "config": ("config", "conf", "settings"),
    "util": ("util", "utils", "helper", "helpers"), "api": ("api", "endpoint", "route"), "model": ("model", "models", "entity", "entities"),
}


def evaluate(groups: DataFrame, total: int, question: str, least: int = 1, most: int = 100, strictness: float = 0.5, n_queries: int = 1, confidence: float = 0.0, has_context: bool = False) -> dict:
    """{success, score, issues} of a result: 1 less deductions for none, too many, few, unlikely file types and folders."""
    issues: list[tuple[str, float]] = []
    if total == 0 and n_queries == 0:
        issues += [("empty", 0.2)] if confidence < 0.9 else []
    elif total == 0:
        issues.append(("empty", 0.6 if has_context else 0.8))
    elif total > most:
        issues.append(("too many", min(0.8, total / most - 1)))
    elif total < least:
        issues.append(("few", 0.3))
    asked = question.lower()
    exts = [e for e in EXTENSION_HINTS if e in asked]
    dirs = [d for d in FOLDER_HINTS if d in asked]
    lower = F.lower("path")
    row = groups.agg(
        F.count("*").alias("n"),
        *[F.bool_or(F.regexp_extract(lower, r"\.([^./]+)$", 1).isin(*EXTENSION_HINTS[e])).alias(f"e{i}") for i, e in enumerate(exts)],
        *[F.bool_or(F.array_max(F.array(*[lower.contains(x) for x in FOLDER_HINTS[d]]))).alias(f"d{i}") for i, d in enumerate(dirs)],
    ).first()
    if row["n"]:
        issues += [("file type", 0.3) for i in range(len(exts)) if not row[f"e{i}"]]
        issues += [("folder", 0.2) for i in range(len(dirs)) if not row[f"d{i}"] and row["n"] > 3]
    score = min(1.0, max(0.0, 1 - sum(x for _, x in issues)))
    return {"success": score >= 0.4 + 0.2 * strictness, "score": score, "issues": issues}


def hint(count: int, total: int, has_more: bool = False, symbols: bool = False, paths: bool = False, syntax: bool = False, regex: bool = False, language: bool = False, glob: bool = False, exact: bool = False) -> str | None:
    """A line on how to read or refine a result; the first rule that holds."""
    rules = (
        (count == 0, "Nothing found: check the spelling, drop filters, or try a part of the word."),
        (total >= 500, f"{total} results: too broad; add a kind, a language or a glob."),
        (has_more, f"{count} of {total} results shown; more with an offset."),
        (symbols and count == 1, "One definition."),
        (symbols and 2 <= count <= 10, f"{count} definitions, usages not counted."),
        (101 <= total < 500, f"{total} results: a kind, a language or a glob would narrow them."),
        (count >= 100 and not symbols, f"{count} lines, definitions and usages alike; search symbols for definitions only."),
        (paths, f"{count} files, without their content."),
        (syntax, f"{count} syntax-tree matches."),
        (regex and count >= 100, f"{count} regex matches; plain text would be more precise."),
        (language and count <= 5, f"{count} results in this language only."),
        (glob and count <= 10, f"{count} results under this glob only."),
        (exact and count <= 5, f"{count} exact names; names that contain the word are left out."),
    )
    return next((text for holds, text in rules if holds), None)


def parse_command(command: str) -> dict:
    """Search options from a command string such as ``query "foo" --lang rust --limit 5``."""
    parser = argparse.ArgumentParser(exit_on_error=False, add_help=False)
    parser.add_argument("pattern")
    for name in ("symbols", "regex", "exact", "contains", "expand", "paths", "count", "force", "all", "dependencies", "ast"):
        parser.add_argument(f"--{name}", action="store_true")
    for name in ("lang", "kind", "file"):
        parser.add_argument(f"--{name}")
    for name in ("limit", "offset"):
        parser.add_argument(f"--{name}", type=int)
    for name in ("glob", "exclude"):
        parser.add_argument(f"--{name}", action="append", default=[])
    words = shlex.split(command)
    while words and words[0] in ("query", "search"):
        words = words[1:]
    return vars(parser.parse_args(words))
