"""Order, pages, groups, context and counts of match rows.

A match row is (path, language, kind, symbol, start_line, end_line, preview).
"""

from __future__ import annotations

import json
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.sources.corpus import line_array

ORDER = ("path", "start_line", "end_line", "kind", "symbol")
MATCH = ("kind", "symbol", "start_line", "end_line", "preview")


def text_matches(lines: DataFrame, matched: Column) -> DataFrame:
    """One match row for each line that matches; the preview is the line."""
    return lines.filter(matched).select(
        "path", "language", F.lit("Match").alias("kind"), F.lit(None).cast("string").alias("symbol"),
        F.col("line_no").alias("start_line"), F.col("line_no").alias("end_line"), F.col("line").alias("preview"),
    )


def ordered(rows: DataFrame) -> DataFrame:
    return rows.orderBy(*ORDER)


def first_per_path(rows: DataFrame) -> DataFrame:
    """The first match row of every path; a partial aggregate, without a window."""
    first = F.min_by(F.struct(*rows.columns), F.struct("start_line", "end_line", "kind", "symbol"))
    return rows.groupBy("path").agg(first.alias("r")).select("r.*")


@dataclass
class Page:
    """A page of rows with its place among all of them."""

    rows: DataFrame
    total: int
    offset: int
    limit: int | None
    count: int = field(init=False)
    has_more: bool = field(init=False)

    def __post_init__(self):
        left = max(0, self.total - self.offset)
        self.count = left if self.limit is None else min(left, self.limit)
        self.has_more = self.total > self.offset + self.count


def page(rows: DataFrame, offset: int = 0, limit: int | None = 100) -> Page:
    """Sorted rows from ``offset``, at most ``limit``; the total is counted before."""
    some = ordered(rows)
    if offset:
        some = some.offset(offset)
    if limit is not None:
        some = some.limit(limit)
    return Page(some, rows.count(), offset, limit)


def resolve_limit(limit: int | None, all_: bool = False, count: bool = False, paths: bool = False, default: int = 100) -> int | None:
    """None (unlimited) for all, count, limit 0, and paths without a limit; else the limit or the default."""
    if all_ or count or limit == 0 or (paths and limit is None):
        return None
    return default if limit is None else limit


def grouped(rows: DataFrame) -> DataFrame:
    """(path, matches): a file's match rows in order."""
    entry = F.struct(*[F.col(c) for c in ("start_line", "end_line", "kind", "symbol", "preview")])
    return rows.groupBy("path").agg(F.sort_array(F.collect_list(entry)).alias("matches"))


def with_context(rows: DataFrame, files: DataFrame, before: int = 3, after: int = 3) -> DataFrame:
    """Match rows with the lines before and after their first line."""
    all_lines = files.select("path", line_array(F.col("content")).alias("__lines"))
    start = F.col("start_line")
    low = F.greatest(F.lit(1), start - before)
    return rows.join(all_lines, "path").select(
        *rows.columns,
        F.slice("__lines", low, start - low).alias("context_before"),
        F.when(start < F.size("__lines"), F.slice("__lines", start + 1, F.lit(after))).otherwise(F.array().cast("array<string>")).alias("context_after"),
    )


def at_offset(files: DataFrame, path: str, offset: int, around: int = 3) -> DataFrame:
    """(line_no, line) around the line that holds a byte offset of a file."""
    one = files.filter(F.col("path") == path.removeprefix("./"))
    head = F.expr(f"CAST(substring(encode(content, 'UTF-8'), 1, {offset}) AS string)")
    line_no = F.size(F.split(head, "\n", -1))
    every = one.select(F.posexplode(line_array(F.col("content"))).alias("pos", "line"), line_no.alias("at"))
    return every.filter(F.abs(F.col("pos") + 1 - F.col("at")) <= around).select((F.col("pos") + 1).alias("line_no"), "line")


def expanded(rows: DataFrame, files: DataFrame) -> DataFrame:
    """Match rows whose preview is the whole span where it has more than one line."""
    all_lines = files.select("path", line_array(F.col("content")).alias("__lines"))
    body = F.array_join(F.slice("__lines", F.col("start_line"), F.col("end_line") - F.col("start_line") + 1), "\n")
    joined = rows.join(all_lines, "path", "left")
    return joined.withColumn("preview", F.when(F.col("start_line") < F.col("end_line"), F.coalesce(body, F.col("preview"))).otherwise(F.col("preview"))).drop("__lines")


def occurrences(rows: DataFrame) -> DataFrame:
    """(total, files): rows and distinct paths; paths are made distinct before they meet."""
    return rows.groupBy("path").count().agg(F.coalesce(F.sum("count"), F.lit(0)).alias("total"), F.count("*").alias("files"))


def with_imports(groups: DataFrame, dependencies: DataFrame) -> DataFrame:
    """File groups with the file's imports, in line order, attached once for each file."""
    listed = dependencies.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line_number", "imported_path", "import_type"))).alias("dependencies"))
    return groups.join(listed, "path", "left")


def as_json(rows: DataFrame) -> DataFrame:
    """One JSON text a row, without null fields."""
    return rows.select(F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "true"}).alias("value"))


def paths_json(rows: DataFrame) -> DataFrame:
    """One JSON text: an array of {path, line} of the first match in each file, by path. For results that fit one row."""
    first = rows.groupBy("path").agg(F.min("start_line").alias("line"))
    return first.agg(F.to_json(F.sort_array(F.collect_list(F.struct("path", "line")))).alias("value"))


def count_json(rows: DataFrame) -> str:
    """{"count": n, "timing_ms": t} of counting the rows."""
    began = time.perf_counter()
    n = rows.count()
    return json.dumps({"count": n, "timing_ms": int((time.perf_counter() - began) * 1000)})


def merged(queries: list[tuple[DataFrame, bool]]) -> tuple[DataFrame | None, int]:
    """Rows of the queries marked for merging, in order of the queries, once for each (path, start, end); and the sum of all counts."""
    total, parts = 0, []
    for i, (rows, merge) in enumerate(queries):
        total += rows.count()
        if merge:
            parts.append(rows.withColumn("query_no", F.lit(i)))
    if not parts:
        return None, total
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p, allowMissingColumns=True)
    return united(every), total


def united(every: DataFrame) -> DataFrame:
    """Rows with query_no, the first query's row for each (path, start_line, end_line)."""
    key = ["path", "start_line", "end_line"]
    first = F.min_by(F.struct(*every.columns), F.struct("query_no", "kind", "symbol"))
    return every.groupBy(*key).agg(first.alias("r")).select("r.*")
