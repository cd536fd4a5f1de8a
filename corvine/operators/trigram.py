"""Byte-trigram postings: an inverted index of lines, and candidate lines for literals.

A stored index is cut by documents: each task writes the postings of its own lines, block
by block, with one row for each trigram of a block. Blocks are put in trigram order as they
are made, so building needs neither a shuffle nor a sort in Spark that would spill, no
trigram is a hot key, and a lookup prunes row groups and pages by their least and greatest
trigram.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.functions.patterns import literal_branches

POSTING = "trigram int, file_id bigint, line_no int"
#: Postings as they are stored: a trigram's lines within a block, as two arrays of one length.
STORED = "trigram int, file_ids array<bigint>, line_nos array<int>"
#: Bytes of lines whose trigrams are made distinct at once, and what an empty line counts for.
BLOCK, LINE = 8 << 20, 16
#: Rows of flat postings that are listed by trigram at once.
ROWS = 4 << 20
#: Rows of a stored page: small beside a block's trigrams, so that lookups skip most pages.
PAGE_ROWS = 256


def packed(text: str) -> list[int]:
    """The distinct byte trigrams of a text as big-endian integers."""
    data = text.encode()
    return sorted({int.from_bytes(data[i : i + 3], "big") for i in range(len(data) - 2)})


def trigrams(text: Column) -> Column:
    """The distinct byte trigrams of a column as integers; none for fewer than three bytes. For short texts: see ``postings`` for lines."""
    size = F.octet_length(text)
    return F.when(size >= 3, F.array_distinct(F.get(F.transform(F.array(F.encode(text, "UTF-8")), _each), 0))).otherwise(F.array().cast("array<int>"))


def _each(data: Column) -> Column:
    # ``data`` is bound once; cutting three bytes out of binary costs the same at any place.
    return F.transform(F.sequence(F.lit(1), F.greatest(F.octet_length(data) - 2, F.lit(1))), lambda i: F.conv(F.hex(F.substring(data, i, F.lit(3))), 16, 10).cast("int"))


def _distinct(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(line, trigram) pairs of binary lines, once each, in order of trigrams and then of lines."""
    lines = lines.fill_null(b"")
    ends = np.frombuffer(lines.buffers()[1], np.int32)[lines.offset : lines.offset + len(lines) + 1]
    if ends[-1] - ends[0] < 3:
        return np.empty(0, np.uint32), np.empty(0, np.int32)
    data = np.frombuffer(lines.buffers()[2], np.uint8)[ends[0] : ends[-1]].astype(np.uint32)
    line = np.repeat(np.arange(len(lines), dtype=np.uint32), np.diff(ends))
    within = line[2:] == line[:-2]
    grams = (data[:-2] << 16) | (data[1:-1] << 8) | data[2:]
    pairs = (grams[within].astype(np.uint64) << 32) | line[2:][within]
    del data, line, within, grams
    pairs.sort()
    if len(pairs):
        pairs = pairs[np.concatenate(([True], pairs[1:] != pairs[:-1]))]
    return pairs.astype(np.uint32), (pairs >> 32).astype(np.int32)


def _blocks(batches) -> Iterator[pa.Table]:
    """The lines of all batches, cut into tables of up to BLOCK bytes, or one longer line."""
    held, room = [], BLOCK
    for batch in batches:
        batch = batch.set_column(batch.schema.get_field_index("line"), "line", batch.column("line").cast(pa.binary()))
        ends = np.cumsum(np.asarray(pc.binary_length(batch.column("line")).fill_null(0), np.int64) + LINE)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(int(np.searchsorted(ends, before + room, "right")), first + (not held))
            if last > first:
                held.append(batch.slice(first, last - first))
                room -= ends[last - 1] - before
            if last < batch.num_rows:
                yield pa.Table.from_batches(held)
                held, room = [], BLOCK
            first = last
    if held:
        yield pa.Table.from_batches(held)


def _postings(batches) -> Iterator[tuple[np.ndarray, pa.Array, pa.Array]]:
    """(trigrams, file_ids, line_nos) of each block's postings, in trigram order."""
    for block in _blocks(batches):
        line, trigram = _distinct(block["line"].combine_chunks())
        if len(line):
            yield trigram, *(block[c].combine_chunks().take(pa.array(line)) for c in ("file_id", "line_no"))


def _listed(trigram: np.ndarray, file_ids: pa.Array, line_nos: pa.Array) -> pa.RecordBatch:
    """Stored rows of postings in trigram order."""
    first = np.flatnonzero(np.concatenate(([True], trigram[1:] != trigram[:-1])))
    cuts = pa.array(np.append(first, len(trigram)).astype(np.int32))
    return pa.RecordBatch.from_arrays([pa.array(trigram[first]), *(pa.ListArray.from_arrays(cuts, x) for x in (file_ids, line_nos))], ["trigram", "file_ids", "line_nos"])


def postings(lines: DataFrame) -> DataFrame:
    """(trigram, file_id, line_no), once for each; distinct within a line, so no shuffle is needed. Null lines have none."""

    def rows(batches):
        for trigram, file_ids, line_nos in _postings(batches):
            yield pa.RecordBatch.from_arrays([pa.array(trigram), file_ids, line_nos], ["trigram", "file_id", "line_no"])

    return lines.select("file_id", "line_no", "line").mapInArrow(rows, POSTING)


def stored(lines: DataFrame) -> DataFrame:
    """The postings of lines as stored rows, block by block in trigram order: no shuffle, and nothing for Spark to sort."""

    def rows(batches):
        for found in _postings(batches):
            yield _listed(*found)

    return lines.select("file_id", "line_no", "line").mapInArrow(rows, STORED)


def listed(flat_postings: DataFrame) -> DataFrame:
    """Postings, one a row, as stored rows."""

    def rows(batches):
        held, count = [], 0

        def block():
            every = pa.Table.from_batches(held).combine_chunks()
            trigram = np.asarray(every["trigram"].combine_chunks())
            order = np.argsort(trigram, kind="stable")
            return _listed(trigram[order], *(every[c].combine_chunks().take(pa.array(order)) for c in ("file_id", "line_no")))

        for batch in batches:
            held.append(batch)
            count += batch.num_rows
            if count >= ROWS:
                yield block()
                held, count = [], 0
        if count:
            yield block()

    return flat_postings.select("trigram", "file_id", "line_no").mapInArrow(rows, STORED)


def flat(index: DataFrame) -> DataFrame:
    """(trigram, file_id, line_no) of an index, stored or flat."""
    if "file_ids" not in index.columns:
        return index
    return index.select("trigram", F.inline(F.arrays_zip("file_ids", "line_nos"))).toDF("trigram", "file_id", "line_no")


def write(rows: DataFrame, path: str, mode: str = "error") -> None:
    """Stored rows as Parquet, with pages that lookups can skip."""
    rows.write.mode(mode).option("parquet.page.row.count.limit", PAGE_ROWS).parquet(path)


def write_postings(lines: DataFrame, path: str) -> None:
    """Postings as Parquet, each block of a part in trigram order."""
    write(stored(lines), path, "overwrite")


def candidates(index: DataFrame, pattern: str) -> DataFrame:
    """(file_id, line_no) of the lines that hold every trigram of the pattern; none for fewer than three bytes."""
    return candidates_of_all(index, [pattern])


def candidates_of_all(index: DataFrame, literals: list[str]) -> DataFrame:
    """Lines that hold every trigram of every literal."""
    wanted = sorted({t for x in literals for t in packed(x)})
    if not wanted:
        return flat(index).select("file_id", "line_no").filter(F.lit(False))
    hits = flat(index.filter(F.col("trigram").isin(wanted)))
    return hits.groupBy("file_id", "line_no").agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).drop("n")


def search(lines: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    """Lines with the pattern as substring, by way of the index; the same rows as a scan."""
    return lines.join(candidates(index, pattern), ["file_id", "line_no"], "left_semi").filter(F.col("line").contains(pattern))


def candidate_files(index: DataFrame, branches: list[list[str]]) -> DataFrame:
    """file_id of the files with a line that may match one of a regex's branches, each given by the literals it needs."""
    found = [candidates_of_all(index, literals).select("file_id") for literals in branches]
    return reduce(DataFrame.union, found).distinct()


def regex_candidates(lines: DataFrame, index: DataFrame, pattern: str) -> DataFrame:
    """Lines that may match a regex: those with all the literals that one of its branches needs; all lines if a branch needs none."""
    branches = literal_branches(pattern)
    if not all(branches):
        return lines
    found = reduce(DataFrame.union, [candidates_of_all(index, literals) for literals in branches])
    return lines.join(found if len(branches) == 1 else found.distinct(), ["file_id", "line_no"], "left_semi")


def index_summary(index: DataFrame) -> DataFrame:
    """(trigrams, postings): distinct trigrams and all entries of an index."""
    size = F.size("line_nos") if "line_nos" in index.columns else F.lit(1)
    return index.groupBy("trigram").agg(F.sum(size).alias("n")).agg(F.count("*").alias("trigrams"), F.coalesce(F.sum("n"), F.lit(0)).alias("postings"))
