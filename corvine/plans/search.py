"""The search planner: from a pattern and options to one lazy frame of match rows, and its page.

Access path: a declaration keyword with symbols or a kind lists definitions; a regex or a
plain pattern scans lines, or goes through postings when an index is given. Filters by
language, glob and path come before anything is parsed.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.languages import is_keyword, resolve_kind, resolve_language
from corvine.functions.patterns import glob_match, holds_literals, regex_match, word_match
from corvine.operators import comments, results, symbols, trigram
from corvine.sources.corpus import lines

#: Files beyond which patterns of under four characters are refused without ``force``; characters that a pattern needs.
MANY_FILES, SHORTEST = 20_000, 3
# Candidates beyond which a query is refused without ``force``, by what it has to parse.
MOST = {"syntax": 100, "syntax with glob": 10_000, "keyword": 20_000, "symbols": 50_000}


class TooBroad(ValueError):
    """The query would return more than is useful; narrow it or force it."""


@dataclass(frozen=True)
class Query:
    pattern: str
    regex: bool = False
    contains: bool = False
    symbols: bool = False
    kind: str | None = None
    exact: bool = False
    language: str | None = None
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    path_part: str | None = None
    paths_only: bool = False
    expand: bool = False
    force: bool = False
    #: Scan lines for patterns of one or two bytes, which the index cannot find.
    scan_short: bool = False
    offset: int = 0
    limit: int | None = 100
    strict_globs: bool = False

    def __post_init__(self):
        if not self.pattern:
            raise ValueError("an empty pattern")
        if self.regex and self.contains:
            raise ValueError("regex and contains exclude each other")
        if self.exact and self.contains:
            raise ValueError("exact and contains exclude each other")


def filtered(files: DataFrame, query: Query) -> DataFrame:
    if query.language:
        files = files.filter(F.col("language") == resolve_language(query.language))
    if query.include:
        files = files.filter(glob_match(F.col("path"), list(query.include), query.strict_globs))
    if query.exclude:
        files = files.filter(~glob_match(F.col("path"), list(query.exclude), query.strict_globs))
    if query.path_part:
        files = files.filter(F.col("path").contains(query.path_part))
    return files


def matching_lines(files: DataFrame, query: Query, postings: DataFrame | None = None) -> DataFrame:
    # What every matching line holds, its file holds: files without it are not cut into lines.
    files = files.filter(holds_literals(F.col("content"), query.pattern) if query.regex else F.col("content").contains(query.pattern))
    every = lines(files)
    if query.regex:
        source = trigram.regex_candidates(every, postings, query.pattern) if postings is not None else every
        return source.filter(regex_match(F.col("line"), query.pattern))
    if len(query.pattern.encode()) < SHORTEST and not query.scan_short:
        return every.filter(F.lit(False))
    if postings is not None:
        every = every.join(trigram.candidates(postings, query.pattern), ["file_id", "line_no"], "left_semi")
    return every.filter(F.col("line").contains(query.pattern) if query.contains or query.symbols else word_match(F.col("line"), query.pattern))


def guard(files: DataFrame, query: Query) -> None:
    """Refuse queries that are too broad before anything is searched. Counts stop at the threshold."""
    language = resolve_language(query.language) if query.language else None
    if query.force or is_keyword(query.pattern, language):
        return
    if not query.regex and len(query.pattern) < SHORTEST:
        raise TooBroad(f"patterns of fewer than {SHORTEST} characters need force")
    if not query.regex and len(query.pattern) < 4 and files.limit(MANY_FILES + 1).count() > MANY_FILES:
        raise TooBroad(f"a pattern of {len(query.pattern)} characters over more than {MANY_FILES} files needs force")


def guard_candidates(candidates: DataFrame, query: Query, what: str) -> None:
    """Refuse to parse too many candidates (lines for symbols; files for keywords and syntax trees)."""
    if query.force:
        return
    most = MOST[what] - (what == "syntax")  # without a glob the threshold itself is too many
    if candidates.limit(most + 1).count() > most:
        raise TooBroad(f"more than {most} candidates of a {what} query; add a language or a glob, or force it")


def rows(files: DataFrame, query: Query, postings: DataFrame | None = None, symbol_table: DataFrame | None = None, checked: bool = True) -> DataFrame:
    """All match rows of a query, before paging."""
    chosen = filtered(files, query)
    if checked:
        guard(files, query)
    language = resolve_language(query.language) if query.language else None
    if query.symbols or query.kind:
        keyword = is_keyword(query.pattern)
        if keyword:
            candidates = chosen
        else:
            hit_lines = matching_lines(chosen, query, postings)
        if checked:
            guard_candidates(chosen if keyword else hit_lines, query, "keyword" if keyword else "symbols")
        if not keyword:
            candidates = chosen.join(hit_lines.select("file_id").distinct(), "file_id", "left_semi")
            if not query.regex:
                candidates = comments.without_comment_files(candidates, lines(candidates), query.pattern)
        found = symbol_table.join(candidates.select("path"), "path", "left_semi").select(*[c.split()[0] for c in symbols.SCHEMA.split(", ")]) if symbol_table is not None else symbols.symbols(candidates)
        if keyword:
            found = symbols.by_keyword(found, query.pattern)
        elif query.regex:
            found = symbols.spanning(found, hit_lines)
        else:
            found = symbols.named(found, query.pattern, query.contains, language)
        if query.kind:
            found = symbols.of_kind(found, resolve_kind(query.kind))
        if query.exact and query.symbols:
            found = found.filter(F.col("symbol") == query.pattern)
        out = results.expanded(found, files) if query.expand else found
    else:
        out = results.text_matches(matching_lines(chosen, query, postings), F.lit(True))
    return results.first_per_path(out) if query.paths_only else out


class TimedOut(TimeoutError):
    """The query took too long; narrow it or allow more time."""


def search(files: DataFrame, query: Query, timeout: float | None = 30.0, **sources) -> results.Page:
    """The page that a query asks for. Its jobs are cancelled after ``timeout`` seconds; None waits."""
    with time_limit(files.sparkSession, timeout):
        return results.page(rows(files, query, **sources), query.offset, query.limit)


@contextmanager
def time_limit(spark: SparkSession, seconds: float | None) -> Iterator[None]:
    """Cancels the jobs started within the block by this thread when the time is over, and raises TimedOut."""
    if seconds is None:
        yield
        return
    tag, over = f"corvine-{uuid.uuid4().hex}", threading.Event()

    def stop() -> None:
        over.set()
        spark.sparkContext.cancelJobsWithTag(tag)

    timer = threading.Timer(seconds, stop)
    timer.daemon = True
    spark.addTag(tag)
    spark.sparkContext.addJobTag(tag)
    timer.start()
    try:
        yield
    except Exception as error:
        if over.is_set():
            raise TimedOut(f"the query took more than {seconds} s") from error
        raise
    finally:
        timer.cancel()
        spark.removeTag(tag)
        spark.sparkContext.removeJobTag(tag)
    if over.is_set():
        raise TimedOut(f"the query took more than {seconds} s")


def syntax(files: DataFrame, pattern: str, query: Query) -> DataFrame:
    """Syntax-tree matches in the Python files that a query's filters leave; without a glob few files are allowed."""
    chosen = filtered(files, query).filter("language = 'Python'")
    guard_candidates(chosen, query, "syntax with glob" if query.include else "syntax")
    return symbols.python_matches(chosen, pattern) if pattern.lstrip().startswith("(") else symbols.python_nodes(chosen, pattern)


def of_kind(files: DataFrame, kind: str) -> DataFrame:
    """All definitions of a kind."""
    return symbols.of_kind(symbols.symbols(files), resolve_kind(kind))
