"""Benchmark decontamination: find the benchmark's word windows in training texts.

The benchmark's items become windows of ``size`` consecutive words (a shorter item is
one window). The windows' hashes are broadcast as a sorted table; every document's
token windows are looked up in it and each hit is verified word by word. What is hit
can be reported, cut out as spans, or used to drop documents.

The broadcast is bounded: at most ``chunk`` windows go out at once. A larger benchmark
is scanned in several passes over the documents, whose spans are then united per
document, so no window is left out.

Defined results: null text has no words; a document without words is never hit; a
benchmark item that is null or has no words has no window; equal windows of several
items count for each; repeated rows of documents are each reported; other columns
are carried by ``cleaned`` and ignored by ``report``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import PUNCT, Words, raw_texts, shared_dir, slices, table, text_slices, windows, written

SIZE = 10
#: Windows that one broadcast table holds at most (about 500 bytes each, with their words).
CHUNK = 100_000

FOUND = "n_words long, n_hit long, item_ids array<string>, spans array<struct<start:long,end:long>>"


def item_windows(items: list[tuple[object, str | None]], size: int) -> Iterator[tuple[tuple[bytes, ...], str]]:
    for item_id, text in items:
        words = Words([(text or "").encode()], PUNCT)
        found = [words.word(i) for i in range(len(words.hashes))]
        for i in range(max(1, len(found) - size + 1) if found else 0):
            yield tuple(found[i : i + size]), str(item_id)


class Windows:
    """Windows of one broadcast, by length: sorted hashes, the words for verification, and the items."""

    def __init__(self, pairs: list[tuple[tuple[bytes, ...], str]]):
        items: dict[tuple[bytes, ...], set[str]] = {}
        for words, item in pairs:
            items.setdefault(words, set()).add(item)
        self.by_length = {}
        for n in sorted({len(w) for w in items}):
            keys = [w for w in items if len(w) == n]
            joined = Words([b" ".join(w) for w in keys], PUNCT)
            hashes = windows(joined.hashes, n)[joined.first[:-1]]
            order = np.argsort(hashes, kind="stable")
            self.by_length[n] = (hashes[order], [keys[i] for i in order], [sorted(items[keys[i]]) for i in order])

    def scan(self, words: Words) -> dict[int, tuple[np.ndarray, set[str]]]:
        """For each text that is hit: which of its words are, and the items."""
        hits: dict[int, tuple[np.ndarray, set[str]]] = {}
        for n, (hashes, keys, items) in self.by_length.items():
            if len(words.hashes) < n:
                continue
            found = windows(words.hashes, n)
            at = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
            for i in np.flatnonzero(hashes[at] == found).tolist():
                text = int(np.searchsorted(words.first, i, "right")) - 1
                if i + n > words.first[text + 1]:
                    continue
                key = tuple(words.word(k) for k in range(i, i + n))
                j = int(at[i])
                while j < len(keys) and hashes[j] == found[i]:
                    if keys[j] == key:
                        a, b = int(words.first[text]), int(words.first[text + 1])
                        flags, ids = hits.setdefault(text, (np.zeros(b - a, bool), set()))
                        flags[i - a : i - a + n] = True
                        ids.update(items[j])
                    j += 1
        return hits


def broadcasts(benchmark: DataFrame, size: int, chunk: int) -> Iterator[Windows]:
    """The benchmark's windows, at most ``chunk`` of them at a time; one table without windows if there are none."""
    held: list = []
    first = True
    for row in benchmark.select("item_id", "text").toLocalIterator():
        for pair in item_windows([tuple(row)], size):
            if len(held) >= chunk:
                yield Windows(held)
                held, first = [], False
            held.append(pair)
    if held or first:
        yield Windows(held)


def runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0])))).tolist()
    return list(zip(edges[0::2], edges[1::2]))


def flagged(starts: np.ndarray, ends: np.ndarray, spans: list[dict]) -> np.ndarray:
    """Which words of a text lie in one of the spans."""
    flags = np.zeros(len(starts), bool)
    for s in spans:
        flags |= (starts >= s["start"]) & (ends <= s["end"])
    return flags


def _scan(df: DataFrame, table_: Windows) -> DataFrame:
    """df's columns with FOUND: spans are byte ranges of the text's UTF-8, from a hit run's first word to its last."""
    fields = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("item_ids", pa.list_(pa.string())), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    def scan(batches):
        for batch in batches:
            n_words, n_hit, ids, spans = [], [], [], []
            for _, part in text_slices(batch.column("text")):
                words = Words(part, PUNCT)
                hits = table_.scan(words)
                n_words += np.diff(words.first).tolist()
                for i in range(len(part)):
                    if i not in hits:
                        n_hit.append(0), ids.append([]), spans.append([])
                        continue
                    flags, found = hits[i]
                    a, at = int(words.first[i]), int(words.text_starts[i])
                    n_hit.append(int(flags.sum()))
                    ids.append(sorted(found))
                    spans.append([{"start": int(words.starts[a + x]) - at, "end": int(words.ends[a + y - 1]) - at} for x, y in runs(flags)])
            new = [pa.array(x, f.type) for x, f in zip((n_words, n_hit, ids, spans), fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], schema=pa.schema([*batch.schema, *fields]))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(scan, f"{own}, {FOUND}")


def found(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, chunk: int = CHUNK) -> DataFrame:
    """doc_id and text with FOUND. ``benchmark`` has (item_id, text)."""
    base = documents.select("doc_id", "text")
    tables = broadcasts(benchmark, size, chunk)
    known, more = next(tables), next(tables, None)
    if more is None:
        return _scan(base, known)
    judged = _with_hits(base, chain([known, more], tables))

    def unite(batches):
        for batch in batches:
            counts, spans = [], []
            found_spans = batch.column(3).to_pylist()
            for first, part in text_slices(batch.column(1)):
                words = Words(part, PUNCT)
                for i in range(len(part)):
                    a, b, at = int(words.first[i]), int(words.first[i + 1]), words.text_starts[i]
                    starts, ends = words.starts[a:b] - at, words.ends[a:b] - at
                    flags = flagged(starts, ends, found_spans[first + i] or [])
                    counts.append((b - a, int(flags.sum())))
                    spans.append([{"start": int(starts[x]), "end": int(ends[y - 1])} for x, y in runs(flags)])
            items = pa.array([x or [] for x in batch.column(2).to_pylist()], pa.list_(pa.string()))
            columns = [pa.array([c[k] for c in counts], pa.int64()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns, items, pa.array(spans, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))], ["doc_id", "text", "n_words", "n_hit", "item_ids", "spans"])

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return judged.mapInArrow(unite, f"{own}, {FOUND}")


def _with_hits(documents: DataFrame, tables: Iterator[Windows]) -> DataFrame:
    """The documents with __items and __spans, the hits of all passes; null where there are none.

    What is hit depends on the text alone, so each pass writes the hits of the texts that have any, under
    the text's digest, and these few rows are joined to the documents.
    """
    digest = F.sha2(F.col("text"), 256)
    texts, folder = documents.select("text"), shared_dir(documents.sparkSession)
    passes: list[DataFrame] = []
    for known in tables:
        hits = _scan(texts, known).filter("n_hit > 0").select(digest.alias("__digest"), "item_ids", "spans")
        passes.append(written(hits, folder, f"hits{len(passes)}"))
    united = reduce(DataFrame.unionByName, passes).groupBy("__digest").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("item_ids")))).alias("__items"), F.array_distinct(F.flatten(F.collect_set("spans"))).alias("__spans")
    )
    return documents.join(united, digest == F.col("__digest"), "left").select(*[F.col(f"`{c}`") for c in documents.columns], "__items", "__spans")


def report(documents: DataFrame, benchmark: DataFrame, size: int = SIZE, chunk: int = CHUNK) -> DataFrame:
    """The digest columns: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    return found(documents, benchmark, size, chunk).select(
        "doc_id", "n_words", "n_hit", F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def cleaned(documents: DataFrame, benchmark: DataFrame, most_hit: float = 0.5, size: int = SIZE, chunk: int = CHUNK) -> DataFrame:
    """The documents without benchmark text, with the columns they came with.

    A document of which more than ``most_hit`` of the words are hit goes; from the
    others the hit spans are cut, and ``n_chars``, if there, is counted anew. A benchmark
    of more than ``chunk`` windows is scanned in several passes, each written out before
    the next; documents are judged by the hits of all passes together.
    """
    tables = broadcasts(benchmark, size, chunk)
    known, more = next(tables), next(tables, None)
    if more is None:
        return documents.mapInArrow(_cleaner(documents.columns, most_hit, known), documents.schema)

    judged = _with_hits(documents, chain([known, more], tables)).drop("__items")
    return judged.mapInArrow(_cleaner(documents.columns, most_hit), documents.schema)


def _cleaner(names: list[str], most_hit: float, known: Windows | None = None):
    """Drops and cuts by the hits of ``known``, or else by the spans in a column behind the documents' own."""
    where = names.index("text")
    chars = names.index("n_chars") if "n_chars" in names else None

    def scan(words: Words, spans: list[list[dict] | None] | None) -> dict[int, np.ndarray]:
        if spans is None:
            return {i: flags for i, (flags, _) in known.scan(words).items()}
        hits = {}
        for i, found in enumerate(spans):
            if found:
                a, b, at = int(words.first[i]), int(words.first[i + 1]), words.text_starts[i]
                hits[i] = flagged(words.starts[a:b] - at, words.ends[a:b] - at, found)
        return hits

    def clean(batches):
        for batch in batches:
            texts, keep, changed = raw_texts(batch.column(where)), [], {}
            spans = None if known else batch.column(len(names)).to_pylist()
            for first, part in slices(texts):
                words = Words(part, PUNCT)
                hits = scan(words, spans and spans[first : first + len(part)])
                for i, text in enumerate(part):
                    if i in hits:
                        flags, a, at = hits[i], int(words.first[i]), int(words.text_starts[i])
                        if flags.sum() > most_hit * len(flags):
                            continue
                        left, kept = 0, []
                        for x, y in runs(flags):
                            kept.append(text[left : int(words.starts[a + x]) - at])
                            left = int(words.ends[a + y - 1]) - at
                        changed[first + i] = b"".join([*kept, text[left:]]).decode()
                    keep.append(first + i)
            columns = list(batch.columns)[: len(names)]
            if changed:
                old = columns[where].to_pylist()
                columns[where] = pa.array([changed.get(i, t) for i, t in enumerate(old)], columns[where].type)
                if chars is not None:
                    counts = columns[chars].to_pylist()
                    columns[chars] = pa.array([len(changed[i]) if i in changed else c for i, c in enumerate(counts)], columns[chars].type)
            schema = pa.schema(list(batch.schema)[: len(names)])
            yield pa.RecordBatch.from_arrays(columns, schema=schema).take(pa.array(keep, pa.int64()))

    return clean


def query(spark, sf_dir: str) -> DataFrame:
    return report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"""
SQL = f"""
WITH iw AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM iw WHERE len(w) > 0)),
dw AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
lens AS (SELECT DISTINCT n FROM win),
pos AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lens WHERE len(w) >= n)),
hit AS (SELECT r, pos.n AS n, i, item_id FROM pos JOIN win ON pos.n = win.n AND pos.t = win.t),
words AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS k FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS ids FROM (SELECT DISTINCT r, item_id::VARCHAR AS x FROM hit) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""
