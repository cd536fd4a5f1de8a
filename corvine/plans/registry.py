"""Registered queries over the driver tables, with DuckDB SQL for each that SQL expresses.

Documents are files ``source/doc_id.lang``; pages are files named by their URL. Graph
queries run on two graphs: a tree of customers, nations and regions, and the function
n -> (n * n + 2) % 25 on nation keys, once with one edge repeated.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvine.functions.patterns import truncated
from corvine.operators import comments, graph, imports, profile, questions, results, symbols, trigram
from corvine.plans import samples
from corvine.plans.search import Query, rows, syntax
from corvine.sources.corpus import content_hash, from_documents, line_array, lines
from corvine.sources.shared import exists, shared_dir
from corvine.streaming.watch import quiet_gaps, quiet_gaps_by_window

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def registered(sql: str | None = None):
    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_documents(table(spark, sf_dir, "documents"))


_FILES = "files AS (SELECT doc_id AS file_id, source || '/' || doc_id || '.' || lang AS path, lang AS language, text AS content FROM documents)"
_LINES = f"""{_FILES},
arrays AS (SELECT file_id, path, language, CASE WHEN a[-1] = '' THEN a[:-2] ELSE a END AS a
           FROM (SELECT file_id, path, language, regexp_split_to_array(coalesce(content, ''), '\\r?\\n') AS a FROM files)),
lines AS (SELECT file_id, path, language, unnest(range(1, len(a) + 1))::INT AS line_no, unnest(a) AS line FROM arrays)"""


def _word(word: str) -> str:
    return f"regexp_matches(line, '(^|[^\\p{{L}}\\p{{M}}\\p{{N}}_]){word}($|[^\\p{{L}}\\p{{M}}\\p{{N}}_])')"


_MATCH = "path, language, line_no AS start_line, line AS preview"


def _text(frame: DataFrame) -> DataFrame:
    return frame.select("path", "language", "start_line", "preview")


@registered(f"WITH {_LINES} SELECT {_MATCH} FROM lines WHERE contains(line, 'tion th')")
def search_contains(spark, sf_dir):
    return _text(rows(corpus(spark, sf_dir), Query("tion th", contains=True)))


@registered(f"WITH {_LINES} SELECT {_MATCH} FROM lines WHERE {_word('que')}")
def search_word(spark, sf_dir):
    return _text(rows(corpus(spark, sf_dir), Query("que", force=True)))


@registered(f"WITH {_LINES} SELECT {_MATCH} FROM lines WHERE regexp_matches(line, 'th[aeiou]{{1,2}}n[a-z]*')")
def search_regex(spark, sf_dir):
    return _text(rows(corpus(spark, sf_dir), Query("th[aeiou]{1,2}n[a-z]*", regex=True)))


@registered(f"WITH {_LINES} SELECT {_MATCH} FROM lines WHERE language = 'de' AND path LIKE 'src1%/%.de' AND NOT path LIKE 'src19/%' AND contains(path, '7') AND {_word('und')}")
def search_filters(spark, sf_dir):
    files = corpus(spark, sf_dir).filter("language = 'de'")
    return _text(rows(files, Query("und", include=("src1*/*.de",), exclude=("src19/**",), path_part="7", force=True)))


@registered(f"WITH {_LINES} SELECT {_MATCH} FROM lines WHERE {_word('the')} ORDER BY path, line_no LIMIT 50 OFFSET 20")
def search_page(spark, sf_dir):
    return _text(results.ordered(rows(corpus(spark, sf_dir), Query("the", force=True))).offset(20).limit(50))


@registered(f"WITH {_LINES} SELECT path, min(line_no) AS start_line FROM lines WHERE {_word('und')} GROUP BY path")
def paths_only(spark, sf_dir):
    return rows(corpus(spark, sf_dir), Query("und", paths_only=True, force=True)).select("path", "start_line")


@registered(f"WITH {_LINES} SELECT count(*) AS total, count(DISTINCT path) AS files FROM lines WHERE {_word('the')}")
def count_occurrences(spark, sf_dir):
    return results.occurrences(rows(corpus(spark, sf_dir), Query("the", force=True)))


@registered(f"WITH {_LINES} SELECT path, count(*) AS n, string_agg(line_no::VARCHAR, ',' ORDER BY line_no) AS line_nos FROM lines WHERE {_word('the')} GROUP BY path")
def grouped_matches(spark, sf_dir):
    groups = results.grouped(rows(corpus(spark, sf_dir), Query("the", force=True)))
    return groups.select("path", F.size("matches").cast("long").alias("n"), F.array_join(F.transform("matches", lambda m: m["start_line"].cast("string")), ",").alias("line_nos"))


@registered(f"""WITH {_LINES}, hit AS (SELECT path, line_no AS start_line FROM lines WHERE {_word('thing')})
SELECT h.path AS path, start_line,
       coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no < start_line), '') AS context_before,
       coalesce(string_agg(line, chr(10) ORDER BY line_no) FILTER (line_no > start_line), '') AS context_after
FROM hit h JOIN lines l ON l.path = h.path AND line_no BETWEEN start_line - 3 AND start_line + 3 GROUP BY 1, 2""")
def context_lines(spark, sf_dir):
    files = corpus(spark, sf_dir)
    found = results.with_context(rows(files, Query("thing")), files)
    return found.select("path", "start_line", F.array_join("context_before", "\n").alias("context_before"), F.array_join("context_after", "\n").alias("context_after"))


@registered(f"""WITH {_LINES} SELECT path, line_no AS start_line,
  CASE WHEN strlen(line) <= 100 THEN line WHEN regexp_matches(line[:100], '\\s') THEN regexp_extract(line[:100], '(?s)^(.*)\\s', 1) || '…' ELSE line[:100] || '…' END AS preview
FROM lines WHERE {_word('(estionthe|thing)')}""")
def previews(spark, sf_dir):
    found = rows(corpus(spark, sf_dir), Query(r"\b(?:estionthe|thing)\b", regex=True))
    return found.select("path", "start_line", truncated(F.col("preview")).alias("preview"))


_indexes: dict[tuple[str, str], str] = {}


def stored_postings(spark, sf_dir) -> DataFrame:
    """The trigram index of the documents, built where it is missing: once a session and folder."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes or not exists(spark, f"{_indexes[key]}/_SUCCESS"):
        path = f"{shared_dir(spark)}/postings"
        trigram.write_postings(lines(corpus(spark, sf_dir)), path)
        _indexes[key] = path
    return spark.read.schema(trigram.STORED).parquet(_indexes[key])


@registered(f"""WITH {_LINES}, hexed AS (SELECT file_id, line_no, hex(encode(line)) AS h FROM lines WHERE strlen(line) >= 3),
grams AS (SELECT DISTINCT file_id, line_no, h[i:i + 5] AS g FROM (SELECT *, unnest(range(1, len(h) - 4, 2)) AS i FROM hexed))
SELECT count(DISTINCT g) AS trigrams, count(*) AS postings FROM grams""")
def index_build(spark, sf_dir):
    """Builds (or finds) the stored index and counts what is in it."""
    return trigram.index_summary(stored_postings(spark, sf_dir))


@registered(f"WITH {_LINES} SELECT path, language, line_no, line FROM lines WHERE contains(line, 'tion th')")
def trigram_search(spark, sf_dir):
    return trigram.search(lines(corpus(spark, sf_dir)), stored_postings(spark, sf_dir), "tion th").select("path", "language", "line_no", "line")


@registered(f"""WITH {_LINES}, hexed AS (SELECT file_id, line_no, hex(encode(line)) AS h FROM lines WHERE strlen(line) >= 3),
grams AS (SELECT DISTINCT file_id, line_no, h[i:i + 5] AS g FROM (SELECT *, unnest(range(1, len(h) - 4, 2)) AS i FROM hexed))
SELECT ('0x' || g)::INT AS trigram, count(*) AS lines FROM grams GROUP BY 1""")
def trigram_stats(spark, sf_dir):
    """Lines of each byte trigram, those with characters of several bytes too."""
    return trigram.postings(lines(corpus(spark, sf_dir))).groupBy("trigram").agg(F.count("*").alias("lines"))


@registered(f"WITH {_LINES} SELECT path, line_no FROM lines WHERE regexp_matches(line, '(estion|ation)t?h[a-z]* [a-z]+')")
def regex_index_search(spark, sf_dir):
    """By the union of the two branches' trigrams."""
    pattern = "(estion|ation)t?h[a-z]* [a-z]+"
    return rows(corpus(spark, sf_dir), Query(pattern, regex=True), stored_postings(spark, sf_dir)).select("path", F.col("start_line").alias("line_no"))


@registered(f"""WITH {_LINES} SELECT language, count(DISTINCT file_id) AS files, count(line_no) AS lines, sum(DISTINCT 0) + max(b) AS bytes
FROM files LEFT JOIN (SELECT file_id, line_no FROM lines) USING (file_id) JOIN (SELECT lang AS language, sum(strlen(text))::BIGINT AS b FROM documents GROUP BY 1) USING (language) GROUP BY 1""")
def index_stats(spark, sf_dir):
    return profile.index_stats(corpus(spark, sf_dir))


@registered("SELECT lang AS language, count(*) AS files, count(*) * 100.0::DOUBLE / sum(count(*)) OVER () AS percent FROM documents GROUP BY 1")
def lang_distribution(spark, sf_dir):
    return profile.distribution(corpus(spark, sf_dir))


@registered("SELECT source AS folder, count(*) AS files FROM documents GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def top_dirs(spark, sf_dir):
    return profile.top_folders(corpus(spark, sf_dir))


_PAGE_FILES = "pf AS (SELECT page_id AS file_id, regexp_replace(url, '^https?://', '') AS path, html AS content FROM pages)"


def pages(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.col("page_id").alias("file_id"), F.regexp_replace("url", "^https?://", "").alias("path"), F.lit("Unknown").alias("language"), F.col("html").alias("content"))


@registered(f"""WITH {_PAGE_FILES}, cut AS (
  SELECT unnest([CASE WHEN len(s) > 1 THEN array_to_string(s[:2], '/') END, CASE WHEN len(s) > 2 THEN array_to_string(s[:3], '/') END, CASE WHEN len(s) > 3 THEN array_to_string(s[:4], '/') END]) AS prefix
  FROM (SELECT string_split(path, '/') AS s FROM pf))
SELECT prefix || '/' AS prefix, count(*) AS files FROM cut WHERE prefix IS NOT NULL AND NOT regexp_matches(prefix, '/\\.|/node_modules|/vendor|/target')
GROUP BY 1 HAVING count(*) >= 3 ORDER BY 2 DESC, 1 LIMIT 10""")
def common_prefixes(spark, sf_dir):
    return profile.common_prefixes(pages(spark, sf_dir), shallowest=1)


@registered("WITH g AS (SELECT text, count(*) AS copies, min(source || '/' || doc_id || '.' || lang) AS first_path FROM documents WHERE text IS NOT NULL GROUP BY 1 HAVING count(*) > 1) SELECT sha256(text) AS hash, copies, first_path FROM g")
def duplicate_files(spark, sf_dir):
    return profile.duplicates(corpus(spark, sf_dir).filter("content IS NOT NULL"))


@registered(f"""WITH {_LINES}, f AS (SELECT source AS folder, 1 AS depth, count(*) AS files FROM documents GROUP BY 1 UNION ALL SELECT '.', 0, count(*) FROM documents)
SELECT folder, depth, f.files AS files, (SELECT count(*) FROM lines WHERE folder = '.' OR split_part(path, '/', 1) = folder) AS lines FROM f""")
def folder_tree(spark, sf_dir):
    return profile.tree(corpus(spark, sf_dir))


@registered(f"WITH {_FILES} SELECT path, language, sha256(content) AS file_hash FROM files WHERE content IS NOT NULL")
def file_hashes(spark, sf_dir):
    return corpus(spark, sf_dir).filter("content IS NOT NULL").select("path", "language", content_hash(F.col("content")).alias("file_hash"))


@registered("""SELECT CASE WHEN b.file_hash IS NULL THEN 'removed' WHEN a.file_hash IS NULL THEN 'added' WHEN a.file_hash <> b.file_hash THEN 'changed' ELSE 'same' END AS state, count(*) AS n
FROM (SELECT doc_id, sha256(text) AS file_hash FROM documents) a FULL JOIN (SELECT item_id AS doc_id, sha256(text) AS file_hash FROM benchmark) b USING (doc_id) GROUP BY 1""")
def incremental_states(spark, sf_dir):
    old = table(spark, sf_dir, "documents").select("doc_id", content_hash(F.col("text")).alias("a"))
    new = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"), content_hash(F.col("text")).alias("b"))
    state = F.when(F.col("b").isNull(), "removed").when(F.col("a").isNull(), "added").when(F.col("a") != F.col("b"), "changed").otherwise("same")
    return old.join(new, "doc_id", "full_outer").groupBy(state.alias("state")).agg(F.count("*").alias("n"))


_TREE = """tree AS (SELECT 'c' || c_custkey AS src, 'n' || c_nationkey AS dst FROM customer UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation),
tree_nodes AS (SELECT 'c' || c_custkey AS id FROM customer UNION ALL SELECT 'n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey FROM region)"""
_FUNC = """func AS (SELECT n_nationkey::BIGINT AS src, (n_nationkey * n_nationkey + 2) % 25::BIGINT AS dst FROM nation),
dup AS (SELECT * FROM func UNION ALL SELECT * FROM func WHERE src = 3)"""


def tree_edges(spark, sf_dir):
    c, n = table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation")
    return c.select(F.concat(F.lit("c"), "c_custkey").alias("src"), F.concat(F.lit("n"), "c_nationkey").alias("dst")).unionByName(
        n.select(F.concat(F.lit("n"), "n_nationkey").alias("src"), F.concat(F.lit("r"), "n_regionkey").alias("dst"))
    )


def tree_nodes(spark, sf_dir):
    parts = (("customer", "c"), ("nation", "n"), ("region", "r"))
    key = {"customer": "c_custkey", "nation": "n_nationkey", "region": "r_regionkey"}
    frames = [table(spark, sf_dir, t).select(F.concat(F.lit(p), key[t]).alias("id")) for t, p in parts]
    return frames[0].unionByName(frames[1]).unionByName(frames[2])


def func_edges(spark, sf_dir):
    key = F.col("n_nationkey").cast("long")
    return table(spark, sf_dir, "nation").select(key.alias("src"), ((key * key + 2) % 25).alias("dst"))


def func_nodes(spark, sf_dir):
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("id"))


def dup_edges(spark, sf_dir):
    edges = func_edges(spark, sf_dir)
    return edges.unionByName(edges.filter("src = 3"))


@registered(f"WITH {_TREE} SELECT src, dst FROM tree WHERE src = 'n7'")
def deps_direct(spark, sf_dir):
    return graph.direct(tree_edges(spark, sf_dir), "n7")


@registered(f"WITH {_TREE} SELECT DISTINCT src AS id FROM tree WHERE dst = 'n7'")
def deps_reverse(spark, sf_dir):
    return graph.dependents(tree_edges(spark, sf_dir), "n7")


@registered(f"""WITH RECURSIVE {_FUNC}, walk AS (SELECT 5::BIGINT AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN func ON src = id WHERE depth < 30)
SELECT id, min(depth) AS depth FROM walk GROUP BY 1""")
def deps_transitive(spark, sf_dir):
    return graph.transitive(func_edges(spark, sf_dir), 5)


@registered(f"""WITH RECURSIVE {_TREE}, walk AS (SELECT 'c1' AS id, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN tree ON src = id WHERE depth < 1)
SELECT id, min(depth) AS depth FROM walk GROUP BY 1""")
def deps_transitive_depth(spark, sf_dir):
    return graph.transitive(tree_edges(spark, sf_dir), "c1", depth=1)


@registered(f"WITH {_FUNC} SELECT dst AS id, count(*) AS importers FROM dup GROUP BY 1 HAVING count(*) >= 2")
def hotspots(spark, sf_dir):
    return graph.hotspots(dup_edges(spark, sf_dir))


@registered(f"WITH {_FUNC} SELECT dst AS id, count(*) AS importers FROM dup GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2, 1 LIMIT 3")
def hotspots_page(spark, sf_dir):
    return graph.hotspots(dup_edges(spark, sf_dir), limit=3, descending=False)


@registered(f"WITH {_FUNC} SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey NOT IN (SELECT dst FROM func)")
def unused_files(spark, sf_dir):
    return graph.unused(func_nodes(spark, sf_dir), func_edges(spark, sf_dir))


_EXPORTS = "exports AS (SELECT n_nationkey::BIGINT AS src, ((n_nationkey + 1) % 25)::BIGINT AS dst FROM nation WHERE n_nationkey % 5 < 3)"


@registered(f"""WITH RECURSIVE {_FUNC}, {_EXPORTS}, used AS (SELECT DISTINCT dst AS id FROM func UNION SELECT e.dst FROM used JOIN exports e ON e.src = used.id)
SELECT n_nationkey::BIGINT AS id FROM nation WHERE n_nationkey NOT IN (SELECT id FROM used)""")
def unused_with_exports(spark, sf_dir):
    key = F.col("id")
    barrel = func_nodes(spark, sf_dir).filter(key % 5 < 3).select(key.alias("src"), ((key + 1) % 25).alias("dst"))
    return graph.unused(func_nodes(spark, sf_dir), func_edges(spark, sf_dir), barrel)


@registered(f"""WITH RECURSIVE {_TREE}, both_ways AS (SELECT src, dst FROM tree UNION SELECT dst, src FROM tree),
reach AS (SELECT 'r' || r_regionkey AS top, 'r' || r_regionkey AS id FROM region UNION SELECT top, dst FROM reach JOIN both_ways ON src = id),
lab AS (SELECT top, min(id) AS island, count(*) AS size FROM reach GROUP BY 1) SELECT island, size FROM lab""")
def islands(spark, sf_dir):
    return graph.islands(tree_nodes(spark, sf_dir), tree_edges(spark, sf_dir))


@registered(f"""WITH RECURSIVE {_FUNC}, reach AS (SELECT src AS a, dst AS b FROM func UNION SELECT reach.a, func.dst FROM reach JOIN func ON func.src = reach.b)
SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a IN (SELECT a FROM reach WHERE a = b) GROUP BY 1""")
def cycles_scc(spark, sf_dir):
    return graph.cyclic(func_edges(spark, sf_dir))


@registered(f"""WITH RECURSIVE {_FUNC}, reach AS (SELECT src AS a, dst AS b FROM func UNION SELECT reach.a, func.dst FROM reach JOIN func ON func.src = reach.b)
SELECT component, count(*)::INT AS length, string_agg(id::VARCHAR, ',' ORDER BY id) AS nodes FROM (
  SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM reach x JOIN reach y ON x.a = y.b AND x.b = y.a WHERE x.a IN (SELECT a FROM reach WHERE a = b) GROUP BY 1) GROUP BY 1""")
def cycles(spark, sf_dir):
    return graph.cycles(func_edges(spark, sf_dir)).select("component", "length", F.array_join(F.array_sort("nodes").cast("array<string>"), ",").alias("nodes"))


def _by_joins(name: str) -> None:
    """A graph query again, with the walk as a loop of joins that graphs of over SMALL_GRAPH edges take."""
    query = QUERIES[name]

    def joined(spark, sf_dir):
        most, graph.SMALL_GRAPH = graph.SMALL_GRAPH, 0
        try:
            return query(spark, sf_dir)
        finally:
            graph.SMALL_GRAPH = most

    QUERIES[f"{name}_by_joins"], ORACLE_SQL[f"{name}_by_joins"] = joined, ORACLE_SQL[name]


for _name in ("deps_transitive", "unused_with_exports", "islands", "cycles_scc", "cycles"):
    _by_joins(_name)


_DEPS = """df AS (SELECT s_suppkey AS file_id, 'pkg' || s_nationkey || '/f' || s_suppkey || ['.py', '.rs', '.TS', '.vue'][s_suppkey % 4 + 1] AS path FROM supplier),
dd AS (SELECT l_suppkey AS file_id, 'm' || l_partkey AS imported_path, CASE WHEN l_quantity > 25 THEN l_suppkey % 7 + 1 END AS resolved_file_id,
              CASE WHEN l_returnflag = 'N' THEN 'internal' WHEN l_returnflag = 'A' THEN 'stdlib' ELSE 'external' END AS import_type FROM lineitem)"""


def dependency_files(spark, sf_dir):
    end = F.element_at(F.array(*[F.lit(x) for x in (".py", ".rs", ".TS", ".vue")]), (F.col("s_suppkey") % 4 + 1).cast("int"))
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("file_id"), F.concat(F.lit("pkg"), "s_nationkey", F.lit("/f"), "s_suppkey", end).alias("path"))


def dependency_rows(spark, sf_dir):
    kind = F.when(F.col("l_returnflag") == "N", "internal").when(F.col("l_returnflag") == "A", "stdlib").otherwise("external")
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_suppkey").alias("file_id"), F.concat(F.lit("m"), "l_partkey").alias("imported_path"),
        F.when(F.col("l_quantity") > 25, F.col("l_suppkey") % 7 + 1).alias("resolved_file_id"), kind.alias("import_type"),
    )


@registered(f"""WITH {_DEPS} SELECT s.path AS source, imported_path, t.path AS target, t.path IS NOT NULL AS resolved
FROM dd JOIN df s USING (file_id) LEFT JOIN df t ON t.file_id = dd.resolved_file_id WHERE import_type = 'internal'""")
def internal_deps(spark, sf_dir):
    return graph.internal_edges(dependency_rows(spark, sf_dir), dependency_files(spark, sf_dir))


@registered(f"""WITH {_DEPS} SELECT language, count(*) AS total, sum(CASE WHEN resolved_file_id IS NOT NULL THEN 1 ELSE 0 END)::BIGINT AS resolved,
  sum(CASE WHEN resolved_file_id IS NOT NULL THEN 1 ELSE 0 END) / count(*)::DOUBLE * 100 AS rate
FROM (SELECT dd.*, CASE WHEN path ILIKE '%.py' THEN 'Python' WHEN path ILIKE '%.ts' THEN 'TypeScript' WHEN path ILIKE '%.rs' THEN 'Rust' ELSE 'Other' END AS language
      FROM dd JOIN df USING (file_id) WHERE import_type = 'internal') GROUP BY 1""")
def resolution_stats(spark, sf_dir):
    return graph.resolution_stats(dependency_rows(spark, sf_dir), dependency_files(spark, sf_dir))


@registered(f"WITH {_DEPS} SELECT import_type, count(*) AS n FROM dd GROUP BY 1")
def dependency_counts(spark, sf_dir):
    return graph.counts_by_type(dependency_rows(spark, sf_dir))


@registered(f"""WITH {_DEPS} SELECT dd.file_id AS file_id, coalesce(path, imported_path) AS imported_path, import_type, count(*) AS n FROM dd LEFT JOIN df ON df.file_id = resolved_file_id GROUP BY 1, 2, 3""")
def dependency_info(spark, sf_dir):
    return graph.dependency_info(dependency_rows(spark, sf_dir), dependency_files(spark, sf_dir)).groupBy("file_id", "imported_path", "import_type").agg(F.count("*").alias("n"))


@registered(f"""WITH {_DEPS}, names AS (SELECT DISTINCT 'f' || s_suppkey || '.PY' AS name FROM supplier UNION ALL SELECT 'f1.py')
SELECT name, min(file_id) AS file_id FROM (SELECT DISTINCT name FROM names) JOIN df ON path ILIKE '%' || name GROUP BY 1 HAVING count(*) = 1""")
def suffix_lookup(spark, sf_dir):
    """By raw suffixes: a name may begin within a path component."""
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey", F.lit(".PY")).alias("name")).union(spark.createDataFrame([("f1.py",)], "name string")).distinct()
    return imports.by_suffix(names, dependency_files(spark, sf_dir))


@registered(f"""WITH {_DEPS}, names AS (SELECT DISTINCT 'f' || s_suppkey || '.PY' AS name FROM supplier UNION ALL SELECT 'f1.py')
SELECT name, min(file_id) AS file_id FROM (SELECT DISTINCT name FROM names) JOIN df ON path ILIKE '%/' || name OR path ILIKE name GROUP BY 1 HAVING count(*) = 1""")
def suffix_lookup_aligned(spark, sf_dir):
    names = table(spark, sf_dir, "supplier").select(F.concat(F.lit("f"), "s_suppkey", F.lit(".PY")).alias("name")).union(spark.createDataFrame([("f1.py",)], "name string")).distinct()
    return imports.by_suffix(names, dependency_files(spark, sf_dir), aligned=True)


@registered(f"""WITH {_DEPS}, w AS (SELECT DISTINCT imported_path FROM (SELECT 'pkg' || s_nationkey || '/f' || (s_suppkey + 1) AS imported_path FROM supplier)),
v AS (SELECT imported_path, e.place AS place, imported_path || e.ending AS path FROM w, (VALUES (0, '.php'), (1, '.rs'), (2, '.ts'), (3, '.js'), (4, '.py')) e(place, ending))
SELECT imported_path, arg_min(file_id, place) AS file_id FROM v JOIN df USING (path) GROUP BY 1""")
def resolution_cache(spark, sf_dir):
    asked = table(spark, sf_dir, "supplier").select(F.concat(F.lit("pkg"), "s_nationkey", F.lit("/f"), (F.col("s_suppkey") + 1).cast("string")).alias("imported_path"))
    return imports.resolution_cache(asked, dependency_files(spark, sf_dir))


@registered(f"""WITH {_LINES}, spans AS (SELECT path, line_no AS start_line, line_no + 3 AS end_line FROM lines),
hit AS (SELECT path, line_no FROM lines WHERE contains(line, 'thing'))
SELECT path, start_line, end_line FROM spans s WHERE EXISTS (SELECT 1 FROM hit h WHERE h.path = s.path AND h.line_no BETWEEN start_line AND end_line)""")
def span_overlap(spark, sf_dir):
    every = lines(corpus(spark, sf_dir))
    spans = every.select("path", F.col("line_no").alias("start_line"), (F.col("line_no") + 3).alias("end_line"))
    return symbols.spanning(spans, every.filter(F.col("line").contains("thing")))


@registered(f"""WITH {_LINES}, q AS (SELECT path, line_no, 0 AS query_no FROM lines WHERE {_word('que')} UNION ALL SELECT path, line_no, 1 FROM lines WHERE {_word('und')} UNION ALL SELECT path, line_no, 2 FROM lines WHERE contains(line, 'que '))
SELECT path, line_no AS start_line, min(query_no) AS query_no FROM q GROUP BY 1, 2""")
def multi_query_merge(spark, sf_dir):
    files = corpus(spark, sf_dir)
    asked = (Query("que", force=True), Query("und", force=True), Query("que ", contains=True))
    parts = [rows(files, q).withColumn("query_no", F.lit(i)) for i, q in enumerate(asked)]
    return results.united(parts[0].unionByName(parts[1]).unionByName(parts[2])).select("path", "start_line", "query_no")


_DOCS = """cf AS (SELECT conv_id AS file_id, 'conv/' || conv_id AS path, string_agg(CASE WHEN role = 'user' THEN '# ' ELSE '' END || replace(text, chr(10), ' '), chr(10) ORDER BY turn, text) AS content
FROM conversations WHERE text IS NOT NULL AND turn IS NOT NULL GROUP BY conv_id)"""


def conversation_files(spark, sf_dir):
    turn = F.struct("turn", "text", F.concat(F.when(F.col("role") == "user", "# ").otherwise(""), F.replace("text", F.lit("\n"), F.lit(" "))).alias("line"))
    kept = table(spark, sf_dir, "conversations").filter("text IS NOT NULL AND turn IS NOT NULL")
    return kept.groupBy(F.col("conv_id").alias("file_id")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(turn)), lambda t: t["line"]), "\n").alias("content")).select(
        "file_id", F.concat(F.lit("conv/"), "file_id").alias("path"), F.lit("Unknown").alias("language"), "content"
    )


@registered(f"""WITH {_DOCS}, l AS (SELECT file_id, path, unnest(range(1, len(a) + 1)) AS line_no, unnest(a) AS line FROM (SELECT file_id, path, string_split(content, chr(10)) AS a FROM cf)),
h AS (SELECT *, contains(lower(line), 'thing')::INT + contains(lower(line), 'eration')::INT AS hits, sum(starts_with(line, '#')::INT) OVER (PARTITION BY file_id ORDER BY line_no) AS section FROM l),
s AS (SELECT file_id, path, section, sum(hits + CASE WHEN starts_with(line, '#') THEN 10 * hits ELSE 0 END) AS score FROM h GROUP BY 1, 2, 3 HAVING sum(hits + CASE WHEN starts_with(line, '#') THEN 10 * hits ELSE 0 END) >= 2)
SELECT path, section::INT AS section, score::INT AS score FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY section) AS r FROM s) WHERE r <= 3""")
def doc_section_search(spark, sf_dir):
    return questions.sections(conversation_files(spark, sf_dir), "where is the thing of eration").select("path", "section", "score")


_SESSIONS = """WITH g AS (SELECT user_id AS key, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events WHERE ts IS NOT NULL),
r AS (SELECT *, sum(b) OVER (PARTITION BY key ORDER BY ts ROWS UNBOUNDED PRECEDING) AS run FROM g)"""


@registered(f'{_SESSIONS} SELECT key, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS events FROM r GROUP BY key, run')
def session_debounce(spark, sf_dir):
    return quiet_gaps(table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts"), "1 hour")


@registered(f"{_SESSIONS} SELECT key, min(ts) AS start, max(ts) AS last, count(*) AS events FROM r GROUP BY key, run")
def session_windows(spark, sf_dir):
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), F.col("ts").cast("timestamp").alias("ts"))
    out = quiet_gaps_by_window(events, 3600)
    return out.select("key", F.col("start").cast("timestamp_ntz").alias("start"), F.col("last").cast("timestamp_ntz").alias("last"), "events")


@registered(f"WITH {_LINES}, a AS (SELECT path, list(line ORDER BY line_no) AS a FROM lines GROUP BY 1) SELECT path, array_to_string(a[2:8], chr(10)) AS preview, array_to_string(a[2:4], chr(10)) AS body FROM a WHERE len(a) >= 4")
def span_previews(spark, sf_dir):
    a = corpus(spark, sf_dir).select("path", line_array(F.col("content")).alias("a")).filter(F.size("a") >= 4)
    spans = a.select("path", F.lit("Unknown").alias("language"), F.lit("Function").alias("kind"), F.lit("f").alias("symbol"), F.lit(2).alias("start_line"), F.lit(4).alias("end_line"), F.array_join(F.slice("a", 2, symbols.PREVIEW_LINES), "\n").alias("preview"))
    whole = results.expanded(spans, corpus(spark, sf_dir)).select("path", F.col("preview").alias("body"))
    return spans.select("path", "preview").join(whole, "path")


# What is left of a line before its first # without strings, closed or not.
_STRINGS = r"""\"(\\.|[^\"\\])*(\"|$)|'(\\.|[^'\\])*('|$)""".replace("'", "''")
_COMMENT = f"contains(regexp_replace(split_part(line, '#', 1), '{_STRINGS}', ' ', 'g'), 'tion')"


@registered(f"WITH {_LINES} SELECT path, line_no, {_COMMENT} AS in_code FROM lines WHERE contains(line, 'tion')")
def comment_filter(spark, sf_dir):
    every = lines(corpus(spark, sf_dir)).filter("contains(line, 'tion')")
    return every.select("path", "line_no", comments.code_occurrence(F.lit("Python"), F.col("line"), "tion").alias("in_code"))


_CODE = """SELECT doc_id, source || '/m' || doc_id || '.py' AS path FROM documents"""


def python_files(spark, sf_dir):
    """A small module for each document: a class with a method, a constant, and an import of another module."""
    d = table(spark, sf_dir, "documents")
    text = F.concat(
        F.lit("import os\nfrom .m"), (F.col("doc_id") + 20).cast("string"), F.lit(" import run\n\nLIMIT = 3\n\n\nclass C"), F.col("doc_id").cast("string"),
        F.lit(":\n    def run(self):\n        # run in a comment\n        return LIMIT\n"),
    )
    return d.select(F.col("doc_id").alias("file_id"), F.concat("source", F.lit("/m"), "doc_id", F.lit(".py")).alias("path"), F.lit("Python").alias("language"), text.alias("content"))


@registered(f"""WITH f AS ({_CODE})
SELECT path, 'Constant' AS kind, 'LIMIT' AS symbol, 4 AS start_line, 4 AS end_line FROM f
UNION ALL SELECT path, 'Class', 'C' || doc_id, 7, 10 FROM f UNION ALL SELECT path, 'Method', 'run', 8, 10 FROM f""")
def symbols_python(spark, sf_dir):
    return symbols.symbols(python_files(spark, sf_dir)).select("path", "kind", "symbol", "start_line", "end_line")


@registered(f"WITH f AS ({_CODE}) SELECT path, 'Method' AS kind, 'run' AS symbol, 8 AS start_line FROM f WHERE path LIKE 'src1/%'")
def search_symbols(spark, sf_dir):
    return rows(python_files(spark, sf_dir), Query("run", symbols=True, kind="function", language="py", include=("src1/*",), force=True)).select("path", "kind", "symbol", "start_line")


@registered(f"WITH f AS ({_CODE}) SELECT path, 'Class' AS kind, 'C' || doc_id AS symbol FROM f")
def search_keyword(spark, sf_dir):
    return rows(python_files(spark, sf_dir), Query("class", symbols=True, force=True)).select("path", "kind", "symbol")


@registered(f"WITH f AS ({_CODE}) SELECT a.path AS path, 2 AS line_number, '.m' || (a.doc_id + 20) AS imported_path, b.path AS target FROM f a LEFT JOIN f b ON b.path = split_part(a.path, '/', 1) || '/m' || (a.doc_id + 20) || '.py'")
def imports_python(spark, sf_dir):
    files = python_files(spark, sf_dir)
    found = imports.resolved(imports.imports(files), files)
    target = files.select(F.col("file_id").alias("resolved_file_id"), F.col("path").alias("target"))
    return found.join(target, "resolved_file_id", "left").select("path", "line_number", "imported_path", "target")


@registered(f"WITH f AS ({_CODE}) SELECT path, 'Method' AS what, 'run' AS symbol, 8 AS start_line, 8 AS end_line FROM f UNION ALL SELECT path, 'Class', 'C' || doc_id, 7, 10 FROM f")
def syntax_captures(spark, sf_dir):
    """An S-expression with two captures."""
    found = syntax(python_files(spark, sf_dir), "(class_definition (block (function_definition name: (identifier) @method))) @class", Query("run", force=True))
    return found.select("path", F.when(F.col("kind") == "Class", "Class").otherwise("Method").alias("what"), "symbol", "start_line", "end_line")


@registered(f"WITH f AS ({_CODE}) SELECT path, 'Class' AS kind, 7 AS start_line FROM f")
def syntax_search(spark, sf_dir):
    return symbols.python_nodes(python_files(spark, sf_dir), "ClassDef").select("path", "kind", "start_line")


@registered(f"WITH f AS ({_CODE}) SELECT count(DISTINCT path) AS files, 3 * count(*) AS symbols FROM f")
def symbol_cache_stats(spark, sf_dir):
    return symbols.cache_stats(symbols.symbols(python_files(spark, sf_dir))).select("files", "symbols")


def _language_queries() -> None:
    """symbols_<language> and imports_<language> over a made source of that language for each document."""
    for language in samples.SAMPLES:

        def found(spark, sf_dir, language=language):
            return symbols.symbols(samples.sources(table(spark, sf_dir, "documents"), language)).select("path", "kind", "symbol", "start_line", "end_line")

        def imported(spark, sf_dir, language=language):
            return imports.imports(samples.sources(table(spark, sf_dir, "documents"), language), internal_only=False).select("path", "line_number", "imported_path", "import_type")

        for what, function in (("symbols", found), ("imports", imported)):
            QUERIES[f"{what}_{language.lower()}"] = function
            ORACLE_SQL[f"{what}_{language.lower()}"] = samples.expected_sql(language, what)


_language_queries()
