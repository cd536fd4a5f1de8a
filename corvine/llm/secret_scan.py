"""Secret scans: fixed patterns, and Markov models of random strings against ordinary identifiers.

Three patterns find assigned values, access keys and hexadecimal runs. Beside them,
every long token is scored by two first-order Markov models of characters, one of
random strings and one of identifiers, both trained from labelled samples; a token
whose log-likelihood ratio reaches a threshold is a span of kind ``random``. Everything
is built-in expressions: a pattern's matches and the text between them give the
offsets by running sums.

The training sample is bounded: whole texts of about ``sample_documents`` documents,
drawn by hash, give the values that the patterns find (random) and the words (identifiers),
joined by ``GENERATED`` digests as further random strings; only 96 x 96 counts for each
label reach the driver. Scanning covers every whole text.

Defined results: null text is empty; offsets are code points, ends exclusive; spans of
kind ``random`` that overlap a pattern's span are left out; repeated rows are each
scanned; other columns are carried along by ``redacted``. Span lists grow with a text's
own matches only.
"""

from __future__ import annotations

import json
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import fenced, table

KINDS = ("assign", "access", "hex", "random")
# The patterns of the three kinds, and each match's least length.
PATTERNS = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]+",
}
#: Cheap tests that every text with a match of that kind passes.
NEEDED = {
    "assign": r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{12}""",
    "access": r"AKIA[A-Z0-9]{14}",
    "hex": r"[0-9a-f]{16}",
    "random": r"[A-Za-z0-9+/_=-]{16}",
}
#: Runs that can hold no match of at least the least length are stepped over by these equivalents.
SEARCH = {"assign": PATTERNS["assign"], "access": r"AKIA[A-Z0-9]{14,}", "hex": r"[0-9a-f]{16,}", "random": r"[A-Za-z0-9+/_=-]{16,}"}
LEAST_VALUE = 12
THRESHOLD = 12.0
GENERATED = 400
MASK = "[SECRET]"
#: Beyond every offset; characters of the blocks that a text is cut into for redaction.
FAR, BLOCK = f"{1 << 60}L", 4096


def literal(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def running(values: str, combine: str = "{0} + {1}", start: str = "0L", block: int = 256) -> str:
    """SQL for the running sums of an array of bigint (or what ``combine`` makes of two), in two levels so that long arrays stay cheap."""
    none = "CAST(array() AS array<bigint>)"
    sum_ = combine.format("u.t", "x")
    inside = f"aggregate(p, named_struct('t', s.t, 'o', {none}), (u, x) -> named_struct('t', {sum_}, 'o', concat(u.o, array({sum_}))))"
    return f"""
      flatten(aggregate(
        transform(sequence(0, greatest(0, CAST(ceil(size({values}) / {block}D) AS INT) - 1)), c -> slice({values}, c * {block} + 1, {block})),
        named_struct('t', {start}, 'out', CAST(array() AS array<array<bigint>>)),
        (s, p) -> get(transform(array({inside}), q -> named_struct('t', q.t, 'out', concat(s.out, array(q.o)))), 0),
        s -> s.out))"""


def neighbours(text: str, of: str) -> str:
    """SQL for an array of ``of``, in terms of a and b, over the characters of a text and their successors, in time linear in its length."""
    return f"get(transform(array(split({text}, '')), c -> zip_with(slice(c, 1, char_length({text}) - 1), slice(c, 2, char_length({text}) - 1), (a, b) -> {of})), 0)"


def _lists(kind: str) -> list[Column]:
    """Per kind: lengths of what lies before each match and of the match, in turn; and the tested lengths or the tokens."""
    p, test = literal(SEARCH[kind]), f"text RLIKE {literal(NEEDED[kind])}"
    lengths = f"""if({test}, flatten(zip_with(split(text, {p}, -1), regexp_extract_all(text, {p}, 0),
        (a, b) -> array(CAST(char_length(a) AS bigint), CAST(coalesce(char_length(b), 0) AS bigint)))), CAST(array() AS array<bigint>))"""
    out = [F.expr(lengths).alias(f"{kind}_lengths")]
    if kind == "assign":
        out.append(F.expr(f"if({test}, transform(regexp_extract_all(text, {p}, 2), v -> CAST(char_length(v) AS double)), CAST(array() AS array<double>))").alias("assign_score"))
    if kind == "random":
        out.append(F.expr(f"if({test}, regexp_extract_all(text, {p}, 0), CAST(array() AS array<string>))").alias("tokens"))
    return out


def counts_of(samples: DataFrame) -> dict[int, dict[tuple[int, int], int]]:
    """Character bigrams of (token, label) rows, by label; characters outside 32..126 do not count."""
    pairs = samples.filter("char_length(token) >= 2").select("label", F.explode(F.expr(neighbours("token", "concat(a, b)"))).alias("pair"))
    counts: dict[int, dict[tuple[int, int], int]] = {0: {}, 1: {}}
    rows = pairs.filter(r"pair RLIKE '^[\\x20-\\x7E]{2}$'").groupBy("label", "pair").count()
    for label, pair, n in rows.collect():  # at most 2 x 95 x 95 rows
        counts[label][ord(pair[0]) - 32, ord(pair[1]) - 32] = n
    return counts


def ratios(counts: dict[int, dict[tuple[int, int], int]], strength: float = 8.0) -> list[float]:
    """log P(b | a, random) - log P(b | a, identifier) at 96 * a + b; each row is smoothed by its model's own character frequencies."""
    logs = {}
    for label, pairs in counts.items():
        after, single, total = [0] * 96, [0] * 96, 0
        for (a, b), n in pairs.items():
            after[a] += n
            single[b] += n
            total += n
        rate = [(x + 0.5) / (total + 48) for x in single]
        logs[label] = [math.log((pairs.get((a, b), 0) + strength * rate[b]) / (after[a] + strength)) for a in range(96) for b in range(96)]
    return [r - i for r, i in zip(logs[1], logs[0])]


def labelled(documents: DataFrame, sample_documents: int = 4000) -> DataFrame:
    """(token, label): 1 for random strings, 0 for identifiers."""
    share = min(1.0, sample_documents / max(1, documents.count()))
    sample = documents.filter("text is not null").filter(F.pmod(F.xxhash64("text", F.lit(7)), F.lit(1_000_000)) < share * 1e6).select("text")
    values = [f"filter(regexp_extract_all(text, {literal(SEARCH['assign'])}, 2), v -> char_length(v) >= {LEAST_VALUE})"] + [f"regexp_extract_all(text, {literal(SEARCH[k])}, 0)" for k in ("access", "hex")]
    found = sample.select(F.explode(F.expr(f"concat({', '.join(values)})")).alias("token"), F.lit(1).alias("label"))
    words = sample.select(F.explode(F.expr(r"regexp_extract_all(text, '(?<![A-Za-z0-9+/_=-])[A-Za-z][A-Za-z]{3,}(?:[_-][A-Za-z]+)*(?![A-Za-z0-9+/_=-])', 0)")).alias("token"), F.lit(0).alias("label"))
    made = documents.sparkSession.range(GENERATED).select(
        F.explode(F.array(F.sha2(F.col("id").cast("string"), 256), F.base64(F.unhex(F.sha2(F.concat(F.lit("b"), F.col("id").cast("string")), 256))))).alias("token"), F.lit(1).alias("label")
    )
    return found.unionByName(words).unionByName(made)


def scanned(documents: DataFrame, table_: list[float], threshold: float = THRESHOLD) -> DataFrame:
    """The documents' columns (text as it is) with ``secret_spans``: array of (start, kind number, end), sorted."""
    base = documents.drop("secret_spans")
    own = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(base.columns)]
    rows = base.select(*own, F.coalesce(F.col("text"), F.lit("")).alias("text"))
    keep = [f"c{i}" for i in range(len(own))]
    listed = rows.select(*keep, *[c for k in KINDS for c in _lists(k)])
    weights = f"from_json('{json.dumps(table_)}', 'array<double>')"
    summed = listed.select(
        *keep, "assign_score", "tokens",
        *[F.expr(f"if(size({k}_lengths) = 0, CAST(array() AS array<bigint>), {running(f'{k}_lengths')})").alias(f"{k}_at") for k in KINDS],
    )
    ratio = f"get({weights}, (ascii(a) - 32) * 96 + ascii(b) - 32)"
    scored = summed.withColumn("random_score", F.expr(f"transform(tokens, t -> aggregate({neighbours('t', ratio)}, 0D, (s, x) -> s + x))"))

    def spans(no: int, kind: str, keeps: str) -> str:
        at = f"{kind}_at"
        every = f"transform(sequence(0, greatest(0, CAST(size({at}) / 2 AS INT) - 2)), i -> named_struct('start', {at}[2 * i], 'kind', {no}, 'end', {at}[2 * i + 1], 'i', i))"
        return f"if(size({at}) < 4, array(), transform(filter({every}, x -> {keeps}), x -> named_struct('start', x.start, 'kind', x.kind, 'end', x.end)))"

    fixed = scored.select(
        *keep,
        F.expr(f"concat({spans(0, 'assign', f'assign_score[x.i] >= {LEAST_VALUE}')}, {spans(1, 'access', 'true')}, {spans(2, 'hex', 'true')})").alias("base"),
        F.expr(spans(3, "random", f"random_score[x.i] >= {threshold!r}D")).alias("more"),
    )
    # By start: how far patterns reach up to each span, and where the next pattern's span starts.
    both = fixed.select(*keep, "more", F.expr("array_sort(concat(base, more))").alias("both"))
    both = both.withColumn("ends", F.expr("transform(both, x -> if(x.kind < 3, x.end, 0L))")).withColumn("starts", F.expr(f"transform(reverse(both), x -> if(x.kind < 3, x.start, {FAR}))"))
    # Fenced, since a column that a lambda names once is else put into it, to be computed for each element.
    both = both.withColumn("reach", fenced(F.expr(f"if(size(more) = 0, NULL, {running('ends', 'greatest({0}, {1})')})")))
    both = both.withColumn("ahead", fenced(F.expr(f"if(size(more) = 0, NULL, reverse({running('starts', 'least({0}, {1})', FAR)}))")))
    both = both.withColumn("secret_spans", fenced(F.expr("if(size(more) = 0, both, filter(both, (x, i) -> x.kind < 3 OR (reach[i] <= x.start AND ahead[i] >= x.end)))")))
    return both.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(base.columns)], "secret_spans")


def joined(spans: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({spans}, s -> concat(element_at(array({names}), s.kind + 1), ':', s.start, ':', s.end)), ',')"


def report(documents: DataFrame, table_: list[float]) -> DataFrame:
    """The digest columns: counts per kind, base_sha256 and spans."""
    found = scanned(documents.select("doc_id", "text"), table_)
    counts = [F.expr(f"CAST(size(filter(secret_spans, s -> s.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.expr(f"sha2({joined('filter(secret_spans, s -> s.kind < 3)')}, 256)").alias("base_sha256"), F.expr(joined("secret_spans")).alias("spans"))


def redacted(documents: DataFrame, table_: list[float]) -> DataFrame:
    """The documents with every span replaced by MASK; ``n_chars``, if there, is counted anew for changed texts."""
    found = scanned(documents, table_)
    # What lies between runs of overlapping spans, from blocks of the text: no piece is looked for from the text's start.
    def within(a: str, b: str) -> str:
        head = f"substring(__blocks[CAST({a} / {BLOCK} AS INT)], CAST({a} % {BLOCK} + 1 AS INT), CAST(least({b} - {a}, {BLOCK}) AS INT))"
        middle = f"array_join(slice(__blocks, CAST({a} / {BLOCK} AS INT) + 2, greatest(0, CAST({b} / {BLOCK} AS INT) - CAST({a} / {BLOCK} AS INT) - 1)), '')"
        tail = f"if(CAST({b} / {BLOCK} AS INT) > CAST({a} / {BLOCK} AS INT), substring(get(__blocks, CAST({b} / {BLOCK} AS INT)), 1, CAST({b} % {BLOCK} AS INT)), '')"
        return f"if({a} >= {b}, '', concat({head}, {middle}, coalesce({tail}, '')))"

    cut = found.withColumn("__ends", F.expr("secret_spans.end"))
    cut = cut.withColumn("__reach", fenced(F.expr(f"if(size(secret_spans) = 0, NULL, concat(array(0L), {running('__ends', 'greatest({0}, {1})')}))")))
    cut = cut.withColumn("__blocks", fenced(F.expr(f"if(size(secret_spans) = 0, NULL, regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0))")))
    gaps = "filter(transform(secret_spans, (x, i) -> named_struct('a', __reach[i], 'b', x.start)), g -> g.b >= g.a)"
    last = "named_struct('a', element_at(__reach, -1), 'b', CAST(char_length(text) AS bigint))"
    out = cut.withColumn("__text", F.expr(f"if(size(secret_spans) = 0, text, array_join(transform(concat({gaps}, array({last})), g -> {within('g.a', 'g.b')}), '{MASK}'))"))
    chars = F.when(F.size("secret_spans") == 0, F.col("n_chars")).otherwise(F.char_length("__text").cast(documents.schema["n_chars"].dataType)).alias("n_chars") if "n_chars" in documents.columns else None
    return out.select(*[F.col("__text").alias("text") if c == "text" else chars if c == "n_chars" else F.col(f"`{c}`") for c in documents.columns])


def trained(documents: DataFrame) -> list[float]:
    return ratios(counts_of(labelled(documents)))


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents")
    return report(documents, trained(documents)).drop("n_random")
