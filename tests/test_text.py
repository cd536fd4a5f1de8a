import re
import time

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corvine.functions import languages, patterns
from corvine.operators import comments, results, trigram
from corvine.plans import registry
from corvine.sources import corpus


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_lines_follow_the_rules_for_endings(files):
    f = files({"a.py": "x\r\ny\n", "b.py": "x\n\ny", "c.py": "", "d.py": None, "e.py": "\n"})
    got = [r[1:] for r in sorted((r["path"], r["line_no"], r["line"]) for r in corpus.lines(f).collect())]
    assert got == [(1, "x"), (2, "y"), (1, "x"), (2, ""), (3, "y"), (1, "")]


def test_language_by_extension_is_case_sensitive(files):
    f = files({"a.h": "", "b.H": "", "src/c.rs": "", "d": "", ".rs": "", "e.TS": ""})
    assert dict((r["path"], r["language"]) for r in f.collect()) == {"a.h": "C", "b.H": "Cpp", "src/c.rs": "Rust", "d": "Unknown", ".rs": "Unknown", "e.TS": "Unknown"}


def test_names_of_languages_and_kinds():
    assert languages.resolve_language("C#") == "CSharp" and languages.resolve_kind("FUNCTION") == "Function" and languages.resolve_kind("odd") == "odd"
    with pytest.raises(ValueError):
        languages.resolve_language("cobol")
    assert languages.is_keyword("fn") and not languages.is_keyword("fun") and languages.is_keyword("fun", "Kotlin")


@pytest.mark.parametrize("pattern, line, found", [
    ("na", "naïve", False), ("na", "na, ja", True), ("foo(", "foo(bar)", True), ("foo(", "foo( bar", False), ("a\\Eb", "x a\\Eb y", True), ("und", "Hund und", True), ("und", "Hund", False),
])
def test_word_match(spark, pattern, line, found):
    df = spark.createDataFrame([(line,)], "line string")
    assert df.select(patterns.word_match(F.col("line"), pattern)).first()[0] is found


@pytest.mark.parametrize("pattern, needs", [
    ("colou?r", ["colo"]), ("(foo|ab)", []), ("[abcdef]", []), (r"\Afoo", ["foo"]), ("fn test_\\d+", ["fn test_"]), ("a.*bcd", ["bcd"]), ("(?i)abc", []), ("abc{2}def", ["def"]), (r"foo\.bar", ["foo.bar"]), ("xyz+", []), (r"\x41bcd", ["bcd"]),
])
def test_required_literals(pattern, needs):
    assert patterns.required_literals(pattern) == needs


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"[abc.?*+\[\](){}|\\d]{1,8}", fullmatch=True), st.text("abcd", max_size=12))
def test_required_literals_are_in_every_match(pattern, text):
    try:
        found = re.search(pattern, text)
        literals = patterns.required_literals(pattern, 1)
    except (re.error, ValueError, OverflowError):
        return
    if found:
        assert all(x in text for x in literals)


@settings(max_examples=300, deadline=None)
@given(st.from_regex(r"(\(?[abc.?*+|\[\]]{1,4}\)?[?*+]?){1,3}", fullmatch=True), st.text("abcd", max_size=12))
def test_a_branch_has_its_literals_in_every_match(pattern, text):
    try:
        found = re.search(pattern, text)
        branches = patterns.literal_branches(pattern, 1)
    except (re.error, ValueError, OverflowError):
        return
    if found:
        assert any(all(x in text for x in literals) for literals in branches)


@pytest.mark.parametrize("pattern, branches", [
    ("(async|await)", [["async"], ["await"]]), ("foo(bar|baz)qux", [["foobarqux"], ["foobazqux"]]), ("abc|d", [["abc"], []]), ("(?:ab|cd)+efg", [["efg"]]), ("x(abc(de|fg)h)y", [["xabcdehy"], ["xabcfghy"]]), ("(foo|bar)?baz", [["baz"]]), ("(?i)foo|bar", [[]]),
])
def test_branches_of_regexes(pattern, branches):
    assert patterns.literal_branches(pattern) == branches


def test_long_lines_take_linear_time(spark):
    line = "".join(map(chr, range(97, 123))) * 40_000
    every = spark.createDataFrame([(1, 1, line), (1, 2, None), (2, 1, "é"), (2, 2, "ab")], "file_id long, line_no int, line string")
    began = time.perf_counter()
    got = trigram.postings(every).collect()
    assert time.perf_counter() - began < 10 and {(r["file_id"], r["line_no"]) for r in got} == {(1, 1)} and sorted(r["trigram"] for r in got) == trigram.packed(line[:100])


def test_lookaround_is_refused():
    for p in ("(?=a)", "(?<!a)b", r"(a)\1"):
        with pytest.raises(ValueError):
            patterns.checked(p)
    assert patterns.checked(r"\\1(?:a)") == r"(?U)\\1(?:a)"


@pytest.mark.parametrize("glob, path, strict, match", [
    ("src/*.rs", "src/a/b.rs", False, True), ("src/*.rs", "src/a/b.rs", True, False), ("**/b.rs", "b.rs", True, True), ("./src/**/b.rs", "src/x/y/b.rs", True, True),
    ("*.{rs,py}", "a.py", False, True), ("[!a].rs", "b.rs", True, True), ("[!a].rs", "a.rs", True, False), ("a?.rs", "ab.rs", True, True), ("a+b.rs", "a+b.rs", True, True),
])
def test_globs(spark, glob, path, strict, match):
    df = spark.createDataFrame([(path,)], "path string")
    assert df.select(patterns.glob_match(F.col("path"), [glob, "[broken"], strict)).first()[0] is match


def test_truncation_by_bytes(spark):
    texts = ["short", "w " * 60, "x" * 101, "é" * 60]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in df.select(patterns.truncated(F.col("t"))).collect()] == ["short", ("w " * 50)[:-1] + "…", "x" * 100 + "…", "é" * 60 + "…"]


@settings(max_examples=15, deadline=None)
@given(st.text(st.sampled_from("ab你é "), max_size=9))
def test_trigrams_are_bytes(spark, text):
    got = spark.createDataFrame([(text,)], "t string").select(trigram.trigrams(F.col("t"))).first()[0]
    assert sorted(got) == trigram.packed(text)


def test_index_and_scan_agree(files, spark, tmp_path):
    every = corpus.lines(files({"a.rs": "fn hello()\nhell o\n你好吗", "b.rs": "say hello\n", "c.rs": "helo elloh"}))
    trigram.write_postings(every, str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    for pattern in ("hello", "你好", "ell", "zzz", "hel"):
        assert rows(trigram.search(every, index, pattern).select("path", "line_no")) == rows(every.filter(F.col("line").contains(pattern)).select("path", "line_no"))
    assert trigram.search(every, index, "he").count() == 0
    assert {r[0] for r in trigram.candidate_files(index, [["hello"], ["helo"]]).collect()} == {r[0] for r in every.select("file_id").collect()}


@settings(max_examples=40, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("ab你é "), max_size=12)), max_size=12), st.integers(1, 5), st.sampled_from([1, 40, 100, 8 << 20]))
def test_blocks_keep_every_posting(lines, cut, block):
    """Over any cut into batches and blocks: each line's trigrams once, and trigrams in order within a block."""
    made = [pa.RecordBatch.from_pydict({"file_id": pa.array(range(i, i + len(part)), pa.int64()), "line_no": pa.array([7] * len(part), pa.int32()), "line": pa.array(part, pa.string())}) for i in range(0, len(lines), cut) if (part := lines[i : i + cut])]
    most, trigram.BLOCK = trigram.BLOCK, block
    try:
        blocks = [[x.to_pylist() for x in (pa.array(a), b, c)] for a, b, c in trigram._postings(made)]
    finally:
        trigram.BLOCK = most
    assert all(a == sorted(a) for a, _, _ in blocks)
    assert sorted((f, t) for a, b, _ in blocks for t, f in zip(a, b)) == [(i, t) for i, x in enumerate(lines) for t in trigram.packed(x or "")]
    stored = [r for a, b, c in blocks for r in trigram._listed(np.array(a, np.int32), pa.array(b), pa.array(c)).to_pylist()]
    assert [(r["trigram"], f, n) for r in stored for f, n in zip(r["file_ids"], r["line_nos"], strict=True)] == [x for a, b, c in blocks for x in zip(a, b, c)]


def test_the_index_is_stored_without_a_sort(spark, files, tmp_path):
    """A row for each trigram of a block instead of one for each posting, which Spark had to sort and spill."""
    every = corpus.lines(files({f"a{i}.rs": f"fn hello() {i}\nhello again\n" for i in range(50)}))
    assert not re.search("Sort|Exchange", trigram.stored(every)._jdf.queryExecution().executedPlan().toString())
    trigram.write_postings(every, str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    want = trigram.postings(every)
    assert index.count() * 5 < want.count() and rows(trigram.flat(index)) == rows(want)
    assert trigram.index_summary(index).collect() == trigram.index_summary(want).collect()
    assert rows(trigram.flat(trigram.listed(want))) == rows(want)


def test_lookups_filter_the_stored_rows(spark, files, tmp_path):
    """The trigrams are looked up in the scan, before lists are unpacked; an index of single postings gives the same."""
    every = corpus.lines(files({"a.rs": "ration thing\nstation\n\nnation thus", "b.rs": "question thing\n"}))
    trigram.write_postings(every, str(tmp_path / "p"))
    index, pattern = spark.read.parquet(str(tmp_path / "p")), "(estion|ation) th[a-z]+"
    found = trigram.regex_candidates(every, index, pattern)
    assert rows(found) == rows(trigram.regex_candidates(every, trigram.postings(every), pattern))
    assert found.filter(patterns.regex_match(F.col("line"), pattern)).count() == 3
    plan = trigram.candidates(index, "ation")._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PushedFilters: \[[^\]]*In\(trigram", plan)


def test_an_index_is_counted_by_its_lists(spark, files, tmp_path):
    """Entries are counted without a row for each, in stored and in single postings, and in none."""
    every = corpus.lines(files({"a.rs": "abcab\nabc\n", "b.rs": "xabc\n", "c.rs": "é", "d.rs": "ab"}))
    trigram.write_postings(every, str(tmp_path / "p"))
    index = spark.read.parquet(str(tmp_path / "p"))
    made = trigram.index_summary(index)
    assert "Generate" not in made._jdf.queryExecution().executedPlan().toString()
    assert tuple(made.first()) == tuple(trigram.index_summary(trigram.postings(every)).first()) == (4, 6)
    assert tuple(trigram.index_summary(index.limit(0)).first()) == (0, 0)


@pytest.mark.parametrize("language, line, pattern, code", [
    ("Rust", 'let u = "http://foo"; foo()', "foo", False), ("Rust", "foo(); // foo", "foo", True), ("Rust", "// foo", "foo", False), ("Rust", 'r#"foo"#', "foo", False),
    ("Rust", "/* foo */ bar", "bar", True), ("Python", "x = 1  # foo", "foo", False), ("Python", "'''foo''' + foo", "foo", True), ("JavaScript", "`foo`", "foo", False),
    ("PHP", "# foo", "foo", False), ("Zig", "/* foo */", "foo", True), ("Unknown", "// foo", "foo", True),
])
def test_code_occurrence(language, line, pattern, code):
    assert comments.stands_in_code(language, line, pattern) is code


def test_files_with_the_pattern_in_comments_only_go(files):
    f = files({"a.rs": "// foo\n", "b.rs": "// foo\nfoo();\n", "c.rs": "bar\n"})
    assert [r["path"] for r in comments.without_comment_files(f, corpus.lines(f), "foo").orderBy("path").collect()] == ["b.rs", "c.rs"]


def test_pages_and_limits(files):
    every = corpus.lines(files({"a.py": "x\n" * 5, "b.py": "x\n" * 3}))
    found = results.text_matches(every, F.col("line") == "x")
    page = results.page(found, offset=4, limit=2)
    assert (page.total, page.count, page.has_more) == (8, 2, True)
    assert [(r["path"], r["start_line"]) for r in page.rows.collect()] == [("a.py", 5), ("b.py", 1)]
    assert results.page(found, offset=20).rows.count() == 0 and not results.page(found, offset=20).has_more
    assert [results.resolve_limit(*a) for a in ((None,), (5,), (0,), (None, True), (None, False, False, True))] == [100, 5, None, None, None]


def test_context_at_the_edges(files):
    f = files({"a.py": "1\n2\n3\n4\n5\n"})
    found = results.with_context(results.text_matches(corpus.lines(f), F.col("line").isin("1", "3", "5")), f, 2, 2).orderBy("start_line")
    assert [(r["context_before"], r["context_after"]) for r in found.collect()] == [([], ["2", "3"]), (["1", "2"], ["4", "5"]), (["3", "4"], [])]
    assert [r["line_no"] for r in results.at_offset(f, "./a.py", 4, 1).collect()] == [2, 3, 4]


def test_walk_honours_ignore_rules(spark, tmp_path):
    for name, text in {"a.py": "x", "build/b.py": "x", "keep/c.rs": "x", "keep/d.log": "x", ".hidden/e.py": "x", "keep/f.py": "x", ".gitignore": "build/\n*.py\n!a.py\n"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    (tmp_path / "bad.rs").write_bytes(b"\xff\xfe")
    assert corpus.walk(tmp_path) == ["a.py", "bad.rs", "keep/c.rs"]
    assert [r["path"] for r in corpus.from_directory(spark, str(tmp_path)).orderBy("path").collect()] == ["a.py", "keep/c.rs"]


def test_trigram_counts_cover_lines_of_multibyte_text(spark, tmp_path):
    texts = ["plain line\nnaïve café\n你好", "naïve\r\nab\n", "🙂🙂", None]
    spark.createDataFrame([(i, t, "en", "src0") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    want = {}
    for t in texts:
        for line in (t or "").replace("\r\n", "\n").split("\n"):
            data = line.encode()
            for g in {int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)}:
                want[g] = want.get(g, 0) + 1
    assert {r["trigram"]: r["lines"] for r in registry.trigram_stats(spark, str(tmp_path)).collect()} == want
