"""A stored index: Parquet snapshots of files, postings, symbols, dependencies and exports, and manifests.

A snapshot is written to a new folder and becomes a branch's current one when a manifest
names it. Manifests are numbered JSON files, each written beside and then renamed to a new
name, so none is ever torn or replaced; the highest number counts. What no branch
names any more is deleted one change later, so that readers of the last state are not disturbed.

Refreshing merges by content hash: only changed files are read and parsed again. Imports keep
the paths that they may mean and are resolved anew against all files each time, so that
added and removed files change the edges of unchanged ones as a full build would.
"""

from __future__ import annotations

import hashlib
import json
import re
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.operators import imports, symbols, trigram
from corvine.operators.profile import line_counts
from corvine.sources.corpus import content_hash, indexable, lines

VERSION = 3
TABLES = ("files", "postings", "symbols", "dependencies", "exports")


class Index:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, name: str):
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        return path, path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        path, fs = self._path(".")
        if not fs.exists(path):
            return []
        names = (s.getPath().getName() for s in fs.listStatus(path))
        return sorted(int(m[1]) for n in names if (m := re.fullmatch(r"manifest-(\d+)\.json", n)))

    def _state(self) -> dict | None:
        numbers = self._numbers()
        if not numbers:
            return None
        path, fs = self._path(f"manifest-{numbers[-1]:09d}.json")
        stream = fs.open(path)
        try:
            return json.loads(bytes(stream.readAllBytes()))
        finally:
            stream.close()

    def _publish(self, branch: str, entry: dict) -> dict:
        old = self._state() or {"version": VERSION, "branches": {}}
        state = {"version": VERSION, "current": branch, "branches": old["branches"] | {branch: entry}}
        used = {b["snapshot"] for b in state["branches"].values()}
        state["unused"] = sorted({b["snapshot"] for b in old["branches"].values()} - used)
        number = (self._numbers() or [0])[-1] + 1
        part, fs = self._path(f".manifest-{uuid.uuid4().hex}")
        stream = fs.create(part, False)
        try:
            stream.write(bytearray(json.dumps(state).encode()))
        finally:
            stream.close()
        if not fs.rename(part, self._path(f"manifest-{number:09d}.json")[0]):
            raise RuntimeError(f"another writer has changed the index at {self.root}")
        for name in old.get("unused", []):
            if name not in used:
                fs.delete(self._path(name)[0], True)
        for n in self._numbers()[:-2]:
            fs.delete(self._path(f"manifest-{n:09d}.json")[0], False)
        return entry

    def manifest(self, branch: str | None = None) -> dict | None:
        """A branch's entry (the one indexed last by default): snapshot, branch, commit, indexed_at, files and lines."""
        state = self._state()
        return state and state["branches"].get(branch or state["current"])

    def table(self, name: str, branch: str | None = None) -> DataFrame:
        manifest = self.manifest(branch)
        if manifest is None:
            raise ValueError(f"no index of {branch or 'any branch'} at {self.root}")
        if name == "postings":
            self.ensure_postings(branch)
        found = self.spark.read.parquet(f"{self.root}/{manifest['snapshot']}/{name}")
        return trigram.flat(found) if name == "postings" else found

    def ensure_postings(self, branch: str | None = None) -> bool:
        """Build the postings anew from the stored contents where they are missing. Returns whether they were."""
        snapshot = self.manifest(branch)["snapshot"]
        path, fs = self._path(f"{snapshot}/postings/_SUCCESS")
        if fs.exists(path):
            return False
        trigram.write_postings(lines(self.table("files", branch)), f"{self.root}/{snapshot}/postings")
        return True

    def build(self, files: DataFrame, branch: str = "main", commit: str | None = None, **filters) -> dict:
        """Index the files for a branch; those whose content is known keep their rows. Returns the branch's manifest."""
        old = self.manifest(branch) or self.manifest()
        base = old["branch"] if old else None
        wanted = line_counts(indexable(files, **filters)).withColumn("file_hash", content_hash(F.col("content")))
        key = ["file_id", "path", "file_hash"]
        if old:
            known = self.table("files", base).select(*key)
            if wanted.select(*key).join(known, key, "full_outer").count() == known.count() == wanted.join(known, key, "left_semi").count():
                return self._publish(branch, old | {"branch": branch, "commit": commit, "indexed_at": time.time()})
        snapshot = f"snapshot-{uuid.uuid4().hex[:12]}"
        folder = f"{self.root}/{snapshot}"
        wanted.withColumn("indexed_at", F.lit(time.time())).write.partitionBy("language").parquet(f"{folder}/files")
        stored = self.spark.read.parquet(f"{folder}/files")
        project = imports.project_of(stored)
        told = hashlib.sha256(repr(project).encode()).hexdigest()
        fresh = stored.join(known, key, "left_anti") if old else stored
        # Where project files say something new, all imports may mean something else.
        reread = fresh if old and old["project"] == told else stored
        made = {
            "symbols": (symbols.symbols(fresh).join(fresh.select("path", "file_hash"), "path"), fresh, ["path", "file_hash"]),
            "dependencies": (imports.imports(reread, project), reread, ["file_id", "path"]),
            "exports": (imports.exports(reread, project), reread, ["file_id", "path"]),
            "postings": (trigram.stored(lines(fresh)), fresh, ["file_id"]),
        }
        for name, (rows, parsed, by) in made.items():
            if old:
                still = stored.select(*by).join(parsed.select(*by), by, "left_anti")
                kept = self.table(name, base).join(still, by, "left_semi")
                rows = rows.unionByName(trigram.listed(kept) if name == "postings" else kept.select(*rows.columns))
            if name in ("dependencies", "exports"):
                rows = imports.resolved(rows, stored, "resolved_file_id" if name == "dependencies" else "resolved_source_id", keep=True)
            if name == "postings":
                trigram.write(rows, f"{folder}/{name}")
            else:
                rows.write.parquet(f"{folder}/{name}")
        row = stored.agg(F.count("*").alias("files"), F.sum("line_count").alias("lines")).first()
        return self._publish(branch, {"snapshot": snapshot, "branch": branch, "commit": commit, "indexed_at": time.time(), "project": told, "files": row["files"], "lines": row["lines"] or 0})

    def list_files(self, branch: str | None = None) -> DataFrame:
        """(path, language, indexed_at), by path."""
        return self.table("files", branch).select("path", "language", F.timestamp_seconds("indexed_at").alias("indexed_at")).orderBy("path")

    def branch_files(self) -> DataFrame:
        """(branch, commit, file_id, path, file_hash) of every branch's files."""
        state = self._state() or {"branches": {}}
        branches = self.spark.createDataFrame([(b["branch"], b["commit"], b["snapshot"]) for b in state["branches"].values()], "branch string, commit string, snapshot string")
        snapshots = sorted({b["snapshot"] for b in state["branches"].values()})
        parts = [self.spark.read.parquet(f"{self.root}/{s}/files").select(F.lit(s).alias("snapshot"), "file_id", "path", "file_hash") for s in snapshots]
        if not parts:
            return self.spark.createDataFrame([], "branch string, commit string, file_id bigint, path string, file_hash string")
        return branches.join(reduce(DataFrame.unionByName, parts), "snapshot").drop("snapshot")

    def branch_total(self, branch: str) -> int:
        """Distinct files of a branch; 0 for one that is not indexed."""
        return self.branch_files().filter(F.col("branch") == branch).select("file_id").distinct().count()

    def stats(self, branch: str | None = None) -> dict:
        """Totals of a branch, files and lines by language, bytes of content, and when it was indexed."""
        manifest = self.manifest(branch)
        rows = self.table("files", branch).groupBy("language").agg(F.count_distinct("file_id").alias("files"), F.sum("line_count").alias("lines"), F.sum(F.octet_length("content")).alias("bytes")).collect()
        return {
            "branch": manifest["branch"], "commit": manifest["commit"], "last_updated": manifest["indexed_at"], "total_files": sum(r["files"] for r in rows), "total_bytes": sum(r["bytes"] or 0 for r in rows),
            "files_by_language": {r["language"]: r["files"] for r in rows}, "lines_by_language": {r["language"]: r["lines"] for r in rows},
        }

    def symbol_stats(self, branch: str | None = None) -> dict:
        return symbols.cache_stats(self.table("symbols", branch)).first().asDict()

    def status(self, branch: str, commit: str | None = None, modified: float | dict[str, float] | None = None) -> tuple[str, str | None]:
        """(fresh or stale, why): another branch, another commit, or files modified after indexing.

        ``modified`` is the latest time, or the times of some paths, of which at most ten are looked at.
        """
        manifest = self.manifest(branch)
        if manifest is None:
            return "stale", f"branch {branch} is not indexed" if self._state() else "there is no index"
        if commit and manifest["commit"] != commit:
            return "stale", "the commit has changed"
        latest = max([modified[p] for p in sorted(modified)[:10]], default=None) if isinstance(modified, dict) else modified
        if latest and latest > manifest["indexed_at"]:
            return "stale", "files have changed"
        return "fresh", None

    def problems(self, branch: str | None = None) -> list[str]:
        """What is wrong with the stored index: its version, missing tables, and columns that they lack; nothing if it is whole."""
        state, manifest = self._state(), self.manifest(branch)
        if manifest is None:
            return ["no manifest"]
        found = [] if state.get("version") == VERSION else [f"version {state.get('version')}, not {VERSION}"]
        needed = {"files": "file_id path language content file_hash", "postings": "trigram file_ids line_nos", "symbols": "path kind symbol file_hash", "dependencies": "file_id imported_path resolved_file_id", "exports": "file_id source_path"}
        for name in TABLES:
            path, fs = self._path(f"{manifest['snapshot']}/{name}/_SUCCESS")
            if not fs.exists(path):
                found.append(f"{name} is missing")
            elif lacking := set(needed[name].split()) - set(self.spark.read.parquet(f"{self.root}/{manifest['snapshot']}/{name}").columns):
                found.append(f"{name} lacks {', '.join(sorted(lacking))}")
        return found

    def compact(self, present: DataFrame, branch: str | None = None) -> dict:
        """Drop what belongs to files that are not in ``present`` (path)."""
        manifest = self.manifest(branch)
        files = self.table("files", branch).join(present.select("path"), "path", "left_semi")
        return self.build(files.select("file_id", "path", "language", "content"), manifest["branch"], manifest["commit"])

    def by_hash(self, file_hash: str, branch: str | None = None) -> DataFrame:
        return self.table("files", branch).filter(F.col("file_hash") == file_hash).limit(1)

    def clear(self) -> None:
        path, fs = self._path(".")
        fs.delete(path, True)


def git_state(root: str) -> dict | None:
    """Branch, commit and whether there are changes, of a work tree; None outside one."""
    import subprocess

    def git(*args: str) -> str:
        return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, timeout=30).stdout.strip()

    try:
        return {"branch": git("rev-parse", "--abbrev-ref", "HEAD"), "commit": git("rev-parse", "HEAD"), "dirty": bool(git("status", "--porcelain"))}
    except (OSError, subprocess.SubprocessError):
        return None
