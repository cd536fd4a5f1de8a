"""Corpora: files with path, language and content; and their lines.

A corpus is a DataFrame of (file_id bigint, path string, language string, content string),
read from a directory tree or made from any table.
"""

from __future__ import annotations

import os
import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.languages import EXTENSIONS, UNSUPPORTED, language_of
from corvine.functions.patterns import glob_match, glob_regex

MOST_BYTES = 10 << 20


def normal_path(path: Column) -> Column:
    return F.regexp_replace(path, r"^(\./)+", "")


class IgnoreRules:
    """Rules of .gitignore and .ignore files, later and deeper ones first; hidden names are always ignored."""

    def __init__(self, rules: tuple[tuple[str, re.Pattern, bool, bool], ...] = ()):
        self.rules = rules

    def below(self, folder: Path, relative: str) -> IgnoreRules:
        rules = list(self.rules)
        for name in (".gitignore", ".ignore"):
            if (folder / name).is_file():
                for line in (folder / name).read_text(errors="replace").splitlines():
                    line = line.rstrip()
                    if not line or line.startswith("#"):
                        continue
                    keep, line = line.startswith("!"), line.removeprefix("!")
                    only_dirs, line = line.endswith("/"), line.rstrip("/")
                    anchored = "/" in line
                    pattern = glob_regex(line.lstrip("/") if anchored else f"**/{line}", strict=True)
                    rules.append((relative, re.compile(_unquoted(pattern)), only_dirs, keep))
        return IgnoreRules(tuple(rules))

    def ignores(self, relative: str, is_dir: bool) -> bool:
        if relative.rsplit("/", 1)[-1].startswith("."):
            return True
        for base, pattern, only_dirs, keep in reversed(self.rules):
            if only_dirs and not is_dir:
                continue
            inner = relative[len(base) :].lstrip("/") if relative.startswith(base) else None
            if inner is not None and pattern.match(inner):
                return not keep
        return False


def _unquoted(pattern: str) -> str:
    return re.sub(r"\\Q(.*?)\\E", lambda m: re.escape(m[1]), pattern)


def walk(root: str | os.PathLike, languages: list[str] | None = None, most_bytes: int = MOST_BYTES, follow_links: bool = False) -> list[str]:
    """Relative paths of the files to index: supported, not ignored and not too large."""
    wanted = {e for e, name in EXTENSIONS.items() if name not in UNSUPPORTED and (not languages or name in languages)}
    out: list[str] = []

    def visit(folder: Path, relative: str, rules: IgnoreRules) -> None:
        rules = rules.below(folder, relative)
        for entry in sorted(os.scandir(folder), key=lambda e: e.name):
            name = f"{relative}/{entry.name}" if relative else entry.name
            is_dir = entry.is_dir(follow_symlinks=follow_links)
            if rules.ignores(name, is_dir):
                continue
            if is_dir:
                visit(Path(entry.path), name, rules)
            elif entry.is_file(follow_symlinks=follow_links) and entry.name.rpartition(".")[2] in wanted and "." in entry.name and entry.stat().st_size <= most_bytes:
                out.append(name)

    visit(Path(root), "", IgnoreRules())
    return out


def from_directory(spark: SparkSession, root: str, **options) -> DataFrame:
    """The tree's files, read by Spark's binary source; files that are not UTF-8 are left out."""
    root = os.path.abspath(root)
    paths = walk(root, **options)
    if not paths:
        return spark.createDataFrame([], "file_id bigint, path string, language string, content string")
    prefix = len(f"file:{root}/") + 1
    read = spark.read.format("binaryFile").load([f"file://{root}/{p}" for p in paths])
    text = read.select(
        F.substring(F.regexp_replace("path", "^file:/+", "file:/"), prefix, 1 << 30).alias("path"),
        F.col("content").alias("raw"),
    ).filter(F.expr("is_valid_utf8(CAST(raw AS string))"))
    return numbered(text.select("path", F.col("raw").cast("string").alias("content")))


def numbered(files: DataFrame) -> DataFrame:
    """file_id by hash of the normalised path, and the language of each path."""
    path = normal_path(F.col("path"))
    return files.select(F.xxhash64(path).alias("file_id"), path.alias("path"), language_of(path).alias("language"), "content")


def from_documents(documents: DataFrame) -> DataFrame:
    """Documents as files ``source/doc_id.lang`` whose language is ``lang``."""
    path = F.concat_ws("/", "source", F.concat_ws(".", "doc_id", "lang"))
    return documents.select(F.col("doc_id").alias("file_id"), path.alias("path"), F.col("lang").alias("language"), F.col("text").alias("content"))


def line_array(content: Column) -> Column:
    """The lines of a text: \\n or \\r\\n ends one, and a last empty one does not count."""
    text = F.coalesce(content, F.lit(""))
    length = F.char_length(text)
    whole = F.when(text.endswith("\r\n"), F.substring(text, F.lit(1), length - 2)).when(text.endswith("\n"), F.substring(text, F.lit(1), length - 1)).otherwise(text)
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(whole, "\r?\n", -1))


def lines(files: DataFrame) -> DataFrame:
    """(file_id, path, language, line_no, line), line_no from 1."""
    return files.select("file_id", "path", "language", F.posexplode(line_array(F.col("content"))).alias("pos", "line")).select(
        "file_id", "path", "language", (F.col("pos") + 1).alias("line_no"), "line"
    )


def indexable(files: DataFrame, languages: list[str] | None = None, include: list[str] | None = None, exclude: list[str] | None = None, most_bytes: int = MOST_BYTES) -> DataFrame:
    """Files of a supported (or listed) language, below a size, matching the globs."""
    keep = F.octet_length("content") <= most_bytes
    keep = keep & (F.col("language").isin(*languages) if languages else ~F.col("language").isin(*UNSUPPORTED))
    if include:
        keep = keep & glob_match(F.col("path"), include)
    if exclude:
        keep = keep & ~glob_match(F.col("path"), exclude)
    return files.filter(keep)


def content_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def by_path(files: DataFrame, path: str) -> DataFrame:
    return files.filter(F.col("path") == path.removeprefix("./"))


def byte_range(files: DataFrame, path: str, offset: int, length: int) -> DataFrame:
    """(path, bytes) of part of a file."""
    return by_path(files, path).select("path", F.substring(F.encode("content", "UTF-8"), offset + 1, length).alias("bytes"))
