"""What a corpus is made of: counts by language, folders, project kind, tests, frameworks.

All are predicates and counts over the file table; only small results reach the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvine.sources.corpus import line_array


def line_counts(files: DataFrame) -> DataFrame:
    return files.withColumn("line_count", F.size(line_array(F.col("content"))))


def index_stats(files: DataFrame) -> DataFrame:
    """(language, files, lines, bytes)."""
    return line_counts(files).groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"), F.sum(F.octet_length("content")).alias("bytes"))


def distribution(files: DataFrame) -> DataFrame:
    """(language, files, percent) of all files."""
    counted = files.groupBy("language").agg(F.count("*").alias("files"))
    return counted.withColumn("percent", F.col("files") * 100.0 / F.sum("files").over(W.partitionBy()))


def dominant(files: DataFrame, over: float = 60.0) -> str | None:
    row = distribution(files).orderBy(F.desc("percent")).first()
    return row["language"] if row and row["percent"] > over else None


def top_folders(files: DataFrame, most: int = 10) -> DataFrame:
    """(folder, files): first path segments, hidden ones left out, the most frequent first; a name in the root counts as a segment."""
    first = F.split("path", "/")[0]
    return files.select(first.alias("folder")).filter(~F.col("folder").startswith(".") & (F.col("folder") != "")).groupBy("folder").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "folder").limit(most)


def common_prefixes(files: DataFrame, least: int = 3, most: int = 10, shallowest: int = 2) -> DataFrame:
    """(prefix, files): paths cut after three and four segments that are frequent; hidden and vendored ones left out."""
    parts = F.split("path", "/")
    cut = F.array(*[F.when(F.size(parts) > d, F.array_join(F.slice(parts, 1, d + 1), "/")) for d in range(shallowest, 4)])
    noise = F.col("prefix").rlike(r"/\.|/node_modules|/vendor|/target")
    rows = files.select(F.explode(cut).alias("prefix")).filter(F.col("prefix").isNotNull() & ~noise)
    return rows.groupBy("prefix").agg(F.count("*").alias("files")).filter(F.col("files") >= least).orderBy(F.desc("files"), "prefix").limit(most).withColumn("prefix", F.concat("prefix", F.lit("/")))


# Files that mark a package, entry points, and configuration files.
PACKAGE_FILES = ("package.json", "cargo.toml", "go.mod", "composer.json", "pom.xml", "build.gradle", "gemfile")
ENTRY_POINTS = {
    "src/main.rs": "Rust binary", "src/lib.rs": "Rust library", "main.rs": "Rust binary", "index.ts": "TypeScript", "index.js": "JavaScript",
    "main.ts": "TypeScript", "server.ts": "TypeScript server", "app.ts": "TypeScript app", "src/index.ts": "TypeScript", "main.py": "Python",
    "__main__.py": "Python module", "app.py": "Python app", "manage.py": "Django", "main.go": "Go",
}
CONFIG_FILES = {
    **dict.fromkeys(("Cargo.toml", "package.json", "pyproject.toml", "go.mod", "pom.xml", "build.gradle"), "Project Manifest"),
    **dict.fromkeys((".gitignore", ".gitattributes"), "Version Control"),
    **dict.fromkeys(("rustfmt.toml", ".prettierrc"), "Code Formatting"), ".eslintrc": "Code Linting", "tsconfig.json": "TypeScript Config",
    **dict.fromkeys(("README.md", "CONTRIBUTING.md", "LICENSE"), "Documentation"),
}


def monorepo(files: DataFrame) -> tuple[bool, int | None]:
    """Whether two or more package files lie below the root, and how many; names are compared without case."""
    lower = F.lower("path")
    is_package = F.lit(False)
    for name in PACKAGE_FILES:
        is_package = is_package | lower.endswith(name)
    n = files.filter(is_package & (F.size(F.split("path", "/")) > 2)).count()
    return (True, n) if n >= 2 else (False, None)


def entry_points(files: DataFrame) -> DataFrame:
    """(path, what, lines) of the root's usual entry points."""
    known = F.create_map(*[F.lit(x) for pair in ENTRY_POINTS.items() for x in pair])
    return line_counts(files.filter(F.col("path").isin(*ENTRY_POINTS))).select("path", known[F.col("path")].alias("what"), F.col("line_count").alias("lines")).orderBy("path")


def config_files(files: DataFrame) -> DataFrame:
    known = F.create_map(*[F.lit(x) for pair in CONFIG_FILES.items() for x in pair])
    return files.filter(F.col("path").isin(*CONFIG_FILES)).select("path", known[F.col("path")].alias("category")).orderBy("category", "path")


def test_layout(files: DataFrame) -> DataFrame:
    """(tests, sources, test_lines, source_lines, ratio): files that look like tests against the others."""
    is_test = F.col("path").rlike(r"(?i)(^|/)(tests?|__tests__|spec)/|(_test|_spec|\.test|\.spec|Test)\.[^./]+$|(^|/)test_[^/]*$")
    return line_counts(files).agg(
        F.sum(is_test.cast("long")).alias("tests"), F.sum((~is_test).cast("long")).alias("sources"),
        F.sum(F.when(is_test, F.col("line_count")).otherwise(0)).alias("test_lines"), F.sum(F.when(~is_test, F.col("line_count")).otherwise(0)).alias("source_lines"),
    ).withColumn("ratio", F.try_divide("tests", "sources"))


# Framework to the manifest names and to what their content must match.
FRAMEWORKS = {
    "Next.js": ("package.json", r'"next"\s*:'), "React": ("package.json", r'"react"\s*:'), "Vue": ("package.json", r'"vue"\s*:'), "Svelte": ("package.json", r'"svelte"\s*:'),
    "Angular": ("package.json", r'"@angular/core"\s*:'), "Express": ("package.json", r'"express"\s*:'), "NestJS": ("package.json", r'"@nestjs/core"\s*:'),
    "Django": ("requirements.txt|pyproject.toml|setup.py", r"(?i)\bdjango\b"), "Flask": ("requirements.txt|pyproject.toml|setup.py", r"(?i)\bflask\b"),
    "FastAPI": ("requirements.txt|pyproject.toml|setup.py", r"(?i)\bfastapi\b"), "Actix": ("Cargo.toml", r"(?m)^actix-web\b"), "Axum": ("Cargo.toml", r"(?m)^axum\b"),
    "Rocket": ("Cargo.toml", r"(?m)^rocket\b"), "Gin": ("go.mod", r"gin-gonic/gin"), "Echo": ("go.mod", r"labstack/echo"), "Laravel": ("composer.json", r'"laravel/framework"'),
    "Symfony": ("composer.json", r'"symfony/'), "Rails": ("Gemfile", r"\brails\b"), "Sinatra": ("Gemfile", r"\bsinatra\b"), "Spring": ("pom.xml|build.gradle", r"springframework"),
    "Ktor": ("build.gradle|build.gradle.kts", r"io\.ktor"), "ASP.NET Core": ("*.csproj", r"Microsoft\.AspNetCore|Sdk\.Web"),
}


def frameworks(files: DataFrame) -> list[str]:
    """Frameworks that the corpus's manifests name."""
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    found = [
        F.coalesce(F.bool_or((name.endswith(".csproj") if where == "*.csproj" else name.isin(*where.split("|"))) & F.col("content").rlike(what)), F.lit(False)).alias(f"f{i}")
        for i, (where, what) in enumerate(FRAMEWORKS.values())
    ]
    row = files.agg(*found).first()
    return [f for i, f in enumerate(FRAMEWORKS) if row[f"f{i}"]]


def project_type(files: DataFrame) -> str:
    """A word for what the root's manifests and entry points say the project is."""
    wanted = ("Cargo.toml", "package.json", "pyproject.toml", "setup.py", "requirements.txt", "go.mod", "pom.xml", "build.gradle", "composer.json", "Gemfile", "src/main.rs", "src/lib.rs", "manage.py", "app.py", "main.py", "__main__.py", "main.go")
    there = {r["path"] for r in files.filter(F.col("path").isin(*wanted)).select("path").collect()}
    if "Cargo.toml" in there:
        binary, library = "src/main.rs" in there, "src/lib.rs" in there
        return "Rust application and library" if binary and library else "Rust application" if binary else "Rust library"
    if "package.json" in there:
        return next((f"{f} application" for f in frameworks(files) if f in ("Next.js", "React", "Vue", "Svelte", "Angular", "Express", "NestJS")), "JavaScript project")
    if there & {"pyproject.toml", "setup.py", "requirements.txt"}:
        return "Django application" if "manage.py" in there else "Flask application" if "app.py" in there else "Python command-line tool" if there & {"main.py", "__main__.py"} else "Python project"
    for name, kind in (("go.mod", "Go project"), ("pom.xml", "Java project"), ("build.gradle", "Java project"), ("composer.json", "PHP project"), ("Gemfile", "Ruby project")):
        if name in there:
            return kind
    return "unknown"


def tree(files: DataFrame, depth: int = 3, excluded: tuple[str, ...] = ("node_modules", "target", "vendor", "dist", "build")) -> DataFrame:
    """(folder, depth, files, lines) of the folders down to a depth, each with all below it."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(depth))), lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    kept = line_counts(files).filter(~F.exists(parts, lambda p: p.isin(*excluded) | p.startswith(".")))
    rows = kept.select(F.explode(above).alias("folder"), "line_count")
    out = rows.groupBy("folder").agg(F.count("*").alias("files"), F.sum("line_count").cast("long").alias("lines"))
    return out.select("folder", F.when(F.col("folder") == ".", 0).otherwise(F.size(F.split("folder", "/"))).alias("depth"), "files", "lines").orderBy("folder")


def duplicates(files: DataFrame) -> DataFrame:
    """(hash, copies, first_path) of contents that several files have."""
    return files.groupBy(F.sha2("content", 256).alias("hash")).agg(F.count("*").alias("copies"), F.min("path").alias("first_path")).filter("copies > 1")


def prompt_context(files: DataFrame) -> str:
    """The corpus in a few lines of text, as context of a question to a language model."""
    languages = sorted(distribution(files).collect(), key=lambda r: (-r["files"], r["language"]))
    out = [f"Project: {project_type(files)}", "Languages: " + ", ".join(f"{r['language']} {r['files']} files ({r['percent']:.1f}%)" for r in languages)]
    main = dominant(files)
    if main:
        out.append(f"Mainly: {main}")
    if folders := top_folders(files).collect():
        out.append("Top folders: " + ", ".join(f"{r['folder']}/ ({r['files']})" for r in folders))
    if prefixes := common_prefixes(files).collect():
        out.append("Common paths: " + ", ".join(r["prefix"] for r in prefixes))
    several, n = monorepo(files)
    if several:
        out.append(f"Monorepo of {n} packages")
    if used := frameworks(files):
        out.append("Frameworks: " + ", ".join(used))
    return "\n".join(out)


def context(files: DataFrame) -> dict:
    """The parts above as one dictionary, for display or JSON."""
    return {
        "project_type": project_type(files), "languages": {r["language"]: r["files"] for r in distribution(files).collect()}, "dominant": dominant(files),
        "folders": [r["folder"] for r in top_folders(files).collect()], "prefixes": [r["prefix"] for r in common_prefixes(files).collect()],
        "monorepo": monorepo(files)[0], "frameworks": frameworks(files), "entry_points": [r["path"] for r in entry_points(files).collect()],
        "config_files": [r["path"] for r in config_files(files).collect()], "tests": test_layout(files).first().asDict(),
    }
