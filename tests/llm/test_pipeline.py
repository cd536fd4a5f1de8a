"""The pipeline as a whole, against plain versions of its stages."""

import re

import corpus_pipeline
from pyspark.sql import functions as F
from test_operators import near_brute

SF = "/root/testdata/sf0.001"


def test_stages_keep_what_they_should(spark, tmp_path):
    documents = spark.read.parquet(f"{SF}/documents.parquet")
    docs, seen = documents, {}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs
        if name != "mixing":
            assert docs.columns == documents.columns
        if name == "language_id":
            assert {r["doc_id"] for r in docs.collect()} == {r["doc_id"] for r in before.collect() if re.search(r"[^\W\d_]", r["text"] or "")}
        if name == "near_dedup":
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            assert {r["doc_id"] for r in docs.collect()} == {d for d, n, c in near_brute(rows) if d == c}
    assert seen["secret_scan"].count() == seen["decontamination"].count() == seen["mixing"].count()
    assert seen["secret_scan"].filter("text LIKE '%[SECRET]%'").count() > 0
    assert seen["secret_scan"].filter("n_chars <> char_length(text)").count() == 0
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "secret_scan", "mixing"] and corpus_pipeline.ORACLE_SQL is None


def test_language_id_rejects_by_score_and_passes_what_it_cannot_judge(spark, monkeypatch):
    documents = spark.read.parquet(f"{SF}/documents.parquet").limit(50)
    odd = spark.createDataFrame([(1, "é"), (2, "12 .. 3"), (3, None)], "doc_id long, text string")
    frame = documents.unionByName(odd, allowMissingColumns=True)
    unlabelled = corpus_pipeline.identify_language(spark, frame.withColumn("lang", F.lit(None).cast("string")), SF)
    assert unlabelled.columns == frame.columns and unlabelled.count() == 51
    # The same text under two labels: neither language is likelier than the other.
    even = spark.createDataFrame([(i, "one two three", lang) for i, lang in enumerate(["de", "en", "es"])], "doc_id long, text string, lang string")
    assert corpus_pipeline.identify_language(spark, even, SF).count() == 0


def test_odd_documents_go_through_all_stages(spark, tmp_path):
    """Null columns, one id on several texts, repeated rows, clashing names, empty and very long texts; then an empty table."""
    documents = spark.read.parquet(f"{SF}/documents.parquet")

    def words(a, n=80):
        return " ".join(f"the {a}{chr(97 + i % 26)}{a} of" for i in range(n))

    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    rows = [
        (None, words("lone"), None, None), (None, words("other"), "en", None), (70_001, words("third"), None, "s"), (70_001, words("fourth"), "en", "s"),  # unlike each other
        (70_002, words("copy"), "en", "s"), (70_003, words("copy"), "en", None), (70_003, words("copy"), "en", None), (None, words("copy"), "en", "s"),
        (70_004, None, "en", "s"), (70_005, "", None, None), (70_006, "12 34 ..", "en", "s"), (70_007, words("long", 40_000), "en", "s"),
        (70_008, item, "en", "s"), (70_009, words("cut") + "\n" + item, "en", "s"), (70_010, words("key") + " password = 'Zx81Kq0pLm29Rt5V' ", "en", "s"),
    ]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    extra = {n: F.lit(f"my {n}") for n in ("score", "lang_pred", "slot", "position", "secret_spans", "digest", "n", "kind", "data", "reach")}
    frame = documents.unionByName(odd, allowMissingColumns=True).withColumns(extra)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, frame if name == "language_id" else docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "mixing":
            assert docs.columns == frame.columns
    got = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for row in rows[:4]:
        assert got.count(row[:2]) == 1
    assert [d for d, t in got if t == words("copy")] == [70_002] and {d for d, _ in got if d and d > 70_003} == {70_007, 70_009, 70_010}
    by = dict(got)
    assert by[70_007] == rows[11][1] and by[70_009].startswith(words("cut")) and len(by[70_009]) < len(rows[13][1]) and "[SECRET]" in by[70_010]
    assert docs.filter("score <> 'my score' OR n <> 'my n' OR data <> 'my data'").count() == 0 and docs.select("position").distinct().count() == docs.count()
    empty = frame.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_a_benchmark_over_the_bound_of_one_broadcast(spark, tmp_path, monkeypatch):
    from corvine.llm import decontaminate

    frame = spark.read.parquet(f"{SF}/documents.parquet")
    once = sorted(map(tuple, corpus_pipeline.remove_benchmark(spark, frame, SF).select("doc_id", "text").collect()))
    monkeypatch.setattr(decontaminate.cleaned, "__defaults__", (0.5, decontaminate.SIZE, 400))
    assert sorted(map(tuple, corpus_pipeline.remove_benchmark(spark, frame, SF).select("doc_id", "text").collect())) == once
