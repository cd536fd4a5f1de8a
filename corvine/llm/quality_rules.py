"""Quality rules: a threshold table compiled into one Spark projection.

Measures of a text's length, symbols, stop words and lines become columns of built-in
expressions, and each row of the threshold table becomes one comparison on them; no
user function and no shuffle is involved.

Words are runs of what is not a space or one of \\t \\n \\v \\f \\r. Repeated words are
those inside three-word windows that occur twice or more in the text: the windows'
64-bit hashes are sorted with their positions, so equal windows become neighbours. Up to
``PACKED`` words a position is packed into the low bits of its hash, which leaves 51 or
more and sorts faster; a text is misjudged by some words with a chance of 4e-9 at most
then, and of 1e-6 at six million words.

Defined results: a null or empty text has no words and fails ``base``; repeated rows
are each judged; other columns do not matter; a null doc_id passes through.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import fenced, table

BLANKS = "' \\t\\n\\u000B\\f\\r'"
# Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "a al an and as at au aux be but by con da das de del dem den der des die du el ein eine en er es est et for from "
    "ha hat have he her his i ich il im in is ist it je la las le les lo los mit ne not of on or para pas por pour que qui "
    "sa se sich sie son su sur that the this to un una und une von was which with y zu"
).split()


#: Words of a text up to which hash and position share one number.
PACKED = 4096


@dataclass(frozen=True)
class Threshold:
    """A text passes if ``low <= measure <= high``."""

    measure: str
    low: float = float("-inf")
    high: float = float("inf")

    def passes(self) -> Column:
        terms = [f"{self.measure} >= {self.low!r}D"] * (self.low != float("-inf")) + [f"{self.measure} <= {self.high!r}D"] * (self.high != float("inf"))
        return F.expr(" AND ".join(terms) or "true")


TABLE = (
    Threshold("n_words", low=50, high=100_000),
    Threshold("mean_word_chars", low=2, high=12),
    Threshold("symbols_per_word", high=0.1),
    Threshold("stop_word_share", low=0.02),
    Threshold("dup_line_share", high=0.3),
    Threshold("bullet_line_share", high=0.9),
    Threshold("ellipsis_line_share", high=0.3),
)


def measured(documents: DataFrame) -> DataFrame:
    """doc_id with all counts and ratios that a threshold may name."""
    split = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", "text",
        F.expr(f"if(trim(BOTH {BLANKS} FROM text) = '', array(), split(trim(BOTH {BLANKS} FROM text), '[\\\\x20\\\\x09-\\\\x0D]+'))").alias("words"),
        F.expr("filter(split(text, '\\\\n'), l -> l RLIKE '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
    )
    hashed = split.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.expr("char_length(array_join(words, ''))").cast("long").alias("word_chars"),
        F.expr("regexp_count(text, '[#*$%&|<>]')").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("size(filter(lines, l -> l RLIKE '^[\\\\x20\\\\x09]*[-*\\u2022]'))").alias("n_bullets"),
        F.expr("size(filter(lines, l -> l RLIKE '(\\\\.\\\\.\\\\.|\\u2026)[\\\\x20\\\\x09-\\\\x0D]*$'))").alias("n_ellipses"),
        F.expr(f"regexp_count(text, '(?i)(?<![^\\\\x20\\\\x09-\\\\x0D])({'|'.join(STOP_WORDS)})(?![^\\\\x20\\\\x09-\\\\x0D.,])')").alias("n_stop"),
        F.expr("CAST(ceil(log2(size(words) + 2)) AS INT)").alias("bits"),
        F.expr("if(size(words) < 3, array(), transform(slice(words, 3, size(words)), (w, i) -> xxhash64(w, words[i], words[i + 1])))").alias("hashes"),
    )
    low = "shiftleft(1L, bits) - 1L"
    packed = f"sort_array(transform(hashes, (h, i) -> (h & ~({low})) | CAST(i AS BIGINT)))"
    pairs = "sort_array(transform(hashes, (h, i) -> named_struct('h', h, 'i', CAST(i AS BIGINT))))"
    equal_packed = f"zip_with(p, slice(p, 2, size(p)), (a, b) -> if(shiftright(a, bits) = shiftright(b, bits), array(a & ({low}), b & ({low})), NULL))"
    equal_pairs = "zip_with(p, slice(p, 2, size(p)), (a, b) -> if(a.h = b.h, array(a.i, b.i), NULL))"
    twice = hashed.withColumn(
        "hashes",
        F.expr(f"""array_sort(array_distinct(flatten(if(size(hashes) <= {PACKED},
          get(transform(array({packed}), p -> filter({equal_packed}, x -> x IS NOT NULL)), 0),
          get(transform(array({pairs}), p -> filter({equal_pairs}, x -> x IS NOT NULL)), 0)))))"""),
    )
    covered = F.expr("aggregate(zip_with(hashes, slice(hashes, 2, size(hashes)), (a, b) -> if(b IS NULL, 3L, least(3L, b - a))), 0L, (s, x) -> s + x)")
    counted = twice.withColumn("n_repeat_words", fenced(covered)).drop("hashes", "bits")

    def per(count: str, of: str) -> Column:
        return F.coalesce(F.try_divide(F.col(count).cast("double"), F.col(of)), F.lit(0.0))

    return counted.withColumns({
        "mean_word_chars": per("word_chars", "n_words"), "symbols_per_word": per("n_symbols", "n_words"), "stop_word_share": per("n_stop", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"), "bullet_line_share": per("n_bullets", "n_lines"), "ellipsis_line_share": per("n_ellipses", "n_lines"),
    })


def judged(documents: DataFrame, thresholds: tuple[Threshold, ...] = TABLE) -> DataFrame:
    """The measures, ``base_failed`` and ``kept``."""
    kept = F.lit(True)
    for t in thresholds:
        kept = kept & t.passes()
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return measured(documents).withColumn("base_failed", base).withColumn("kept", ~F.col("base_failed") & kept)


def query(spark, sf_dir: str) -> DataFrame:
    return judged(table(spark, sf_dir, "documents")).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


_STOP = "|".join(STOP_WORDS)
SQL = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
win AS (SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS t FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, t) AS c FROM win) WHERE c > 1),
covered AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest(range(i, i + 3)) AS k FROM twice) GROUP BY r),
m AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines,
         len(list_filter(l, lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullets,
         len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS n_ellipses,
         len(list_filter(w, lambda x: regexp_matches(x, '^(?i)({_STOP})($|[.,])'))) AS n_stop
  FROM d LEFT JOIN covered USING (r))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_words <= 100000
         AND word_chars / n_words BETWEEN 2 AND 12 AND n_symbols / n_words <= 0.1 AND n_stop / n_words >= 0.02
         AND coalesce(n_dup_lines / n_lines, 0) <= 0.3 AND coalesce(n_bullets / n_lines, 0) <= 0.9
         AND coalesce(n_ellipses / n_lines, 0) <= 0.3 AS kept
FROM m
"""
