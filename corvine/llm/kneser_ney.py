"""LM scoring with an interpolated modified Kneser-Ney bigram model.

Tokens are the lower-cased words of a text and one end mark; a start mark is the first
token's context. Spark counts bigrams: each task combines those of some texts, sends
them in sorted, packed blocks to hash buckets, and every bucket writes its part of the
model, a sorted array of 64-bit bigram names beside their counts. A second exchange sums
what each word needs as context (its count, and how many followers were seen once,
twice, and more often) and as continuation (how many words it followed). Scoring tasks
map these files into memory, so workers of one machine share one copy in the page cache,
and look up all tokens of some texts at once.

Buckets follow a bigram's context, so a context's sums are complete where they are made;
the contexts in ``spread`` (frequent in a bounded sample of ``sample_documents`` rows, which
decides nothing but the placement) are dealt by the whole bigram and their sums added in
the second exchange. Every count covers all training texts; nothing is pruned.

P(w | v) = max(c(vw) - D(c(vw)), 0) / c(v) + g(v) P(w),
P(w) = max(k(w) - D'(k(w)), 0) / K + g' / (V + 1), with k(w) the number of words before w,
K their sum, and the three discounts D from the counts of counts of each order.

Defined results: null text is empty and has one token, its end; a null doc_id is held out;
repeated rows are counted and scored each; an empty training set gives every token the
uniform probability of one unseen word; other columns are ignored. Word names are 56-bit
hashes: of V distinct words about V * V / 2**57 pairs share one (7e-6 of a pair at a million).
"""

from __future__ import annotations

import os
import tempfile
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import BLANK, Words, freed, mixed, shared_dir, table, text_slices

START, END = np.uint64(1), np.uint64(2)
#: Text bytes whose bigrams a task combines at once.
COMBINED = 16 << 20
#: Text bytes for each bucket.
PER_BUCKET = 8 << 20
LEAST_BUCKETS = 32


def tokens_of(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Word names of all texts, each followed by END, and where each text's tokens begin (with the end)."""
    words = Words(texts, BLANK)
    names = np.maximum(words.hashes >> np.uint64(8), np.uint64(3))
    first = words.first + np.arange(len(words.first))
    out = np.full(len(names) + len(texts), END)
    inside = np.ones(len(out), bool)
    inside[first[1:] - 1] = False
    out[inside] = names
    return out, first


def contexts_of(tokens: np.ndarray, first: np.ndarray) -> np.ndarray:
    before = np.empty_like(tokens)
    before[1:] = tokens[:-1]
    before[first[:-1]] = START
    return before


def bigram_names(before: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    return mixed(before * np.uint64(0x9E3779B97F4A7C15) + mixed(tokens))


def buckets_of(before: np.ndarray, names: np.ndarray, spread: np.ndarray, buckets: int) -> np.ndarray:
    by = mixed(before)
    if len(spread):
        at = np.minimum(np.searchsorted(spread, before), len(spread) - 1)
        by = np.where(spread[at] == before, names, by)
    return (by % np.uint64(buckets)).astype(np.int64)


def pack(*columns: np.ndarray) -> bytes:
    """Word names as seven bytes each and counts compressed; the first column is sorted and sent as distinct values with lengths."""
    names, rest = columns[0], columns[1:]
    edge = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.empty(0, np.int64)
    runs = np.diff(np.concatenate((edge, [len(names)]))).astype(np.uint32)
    parts = [_seven(names[edge]), _squeezed(runs)]
    parts += [_seven(c) if c.dtype == np.uint64 else _squeezed(c.astype(np.int64)) for c in rest]
    return np.array([len(names), len(edge), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unpack(data: bytes, kinds: str) -> list[np.ndarray]:
    """kinds: one letter for each column after the first, w for word names and n for counts."""
    head = 8 * (4 + len(kinds))
    n, distinct, *sizes = np.frombuffer(data[:head], np.int64).tolist()
    parts, at = [], head
    for s in sizes:
        parts.append(data[at : at + s])
        at += s
    runs = _loose(parts[1], np.uint32, distinct)
    out = [np.repeat(_from_seven(parts[0]), runs)]
    return out + [_from_seven(p) if k == "w" else _loose(p, np.int64, n) for k, p in zip(kinds, parts[2:])]


def _seven(x: np.ndarray) -> bytes:
    return x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :7].tobytes()


def _from_seven(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 7, 8), np.uint8)
    out[:, :7] = np.frombuffer(data, np.uint8).reshape(-1, 7)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _squeezed(x: np.ndarray) -> bytes:
    return pa.compress(x.tobytes(), codec="zstd", asbytes=True) if len(x) else b""


def _loose(data: bytes, kind, n: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind) if n else np.empty(0, kind)


def summed(names: np.ndarray, *counts: np.ndarray) -> list[np.ndarray]:
    """Distinct names in order, with each count summed."""
    order = np.argsort(names, kind="stable")
    names = names[order]
    edge = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.empty(0, np.int64)
    return [names[edge], *[np.add.reduceat(c[order], edge) if len(edge) else c[:0] for c in counts]]


class Store:
    """Arrays in files of a folder that all executors reach; others than local ones are fetched once per worker and mapped."""

    def __init__(self, uri: str):
        self.uri, self.held = uri, {}

    def _local(self) -> str | None:
        return self.uri.removeprefix("file://") if self.uri.startswith(("file://", "/")) else None

    def save(self, name: str, array: np.ndarray) -> None:
        local = self._local()
        if local:
            os.makedirs(local, exist_ok=True)
            part = f"{local}/.{name}-{uuid.uuid4().hex}"
            array.tofile(part)
            os.replace(part, f"{local}/{name}")
        else:
            from pyarrow import fs

            files, path = fs.FileSystem.from_uri(self.uri)
            files.create_dir(path, recursive=True)
            part = f"{path}/.{name}-{uuid.uuid4().hex}"
            with files.open_output_stream(part) as out:
                out.write(array.tobytes())
            files.move(part, f"{path}/{name}")

    def load(self, name: str, kind) -> np.ndarray:
        if name not in self.held:
            local = self._local()
            if local is None:
                from pyarrow import fs

                files, path = fs.FileSystem.from_uri(self.uri)
                if not hasattr(self, "fetched"):
                    self.fetched = tempfile.TemporaryDirectory(prefix="corvine-model-")
                local = self.fetched.name
                with files.open_input_stream(f"{path}/{name}") as src, open(f"{local}/{name}", "wb") as out:
                    while block := src.read(1 << 22):
                        out.write(block)
            full = f"{local}/{name}"
            self.held[name] = np.memmap(full, kind, "r") if os.path.getsize(full) else np.empty(0, kind)
        return self.held[name]

    def __getstate__(self):
        return {"uri": self.uri, "held": {}}


def discounts(n: list[int]) -> np.ndarray:
    """D(0..3) from how many counts are 1, 2, 3 and 4 (Chen and Goodman); 0 < D(i) < i even where those are missing."""
    n1, n2, n3, n4 = (max(1, x) for x in n)
    y = n1 / (n1 + 2 * n2)
    raw = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0.0, *(min(max(d, 0.1), i - 0.1) for i, d in enumerate(raw, 1))])


@dataclass
class Model:
    store: Store
    #: Names of the parts that have entries.
    made: set[str]
    buckets: int
    word_buckets: int
    spread: np.ndarray
    pair_counts: list[int]
    word_counts: list[int]
    pairs: int
    texts: int
    tokens: int
    words: int

    def look_up_words(self, names: np.ndarray) -> np.ndarray:
        """[word, (count, followers seen once, twice, more, continuations)]; zeros for unknown ones."""
        out = np.zeros((len(names), 5), np.int64)
        where = (mixed(names) % np.uint64(self.word_buckets)).astype(np.int64)
        for b, rows in _by_bucket(where):
            if f"words-{b}" in self.made:
                keys = self.store.load(f"words-{b}", np.uint64)
                at = np.minimum(np.searchsorted(keys, names[rows]), len(keys) - 1)
                hit = keys[at] == names[rows]
                out[rows[hit]] = self.store.load(f"sums-{b}", np.int64).reshape(-1, 5)[at[hit]]
        return out

    def look_up_pairs(self, before: np.ndarray, names: np.ndarray) -> np.ndarray:
        out = np.zeros(len(names), np.int64)
        for b, rows in _by_bucket(buckets_of(before, names, self.spread, self.buckets)):
            if f"pairs-{b}" in self.made:
                keys = self.store.load(f"pairs-{b}", np.uint64)
                at = np.minimum(np.searchsorted(keys, names[rows]), len(keys) - 1)
                hit = keys[at] == names[rows]
                rows, at = rows[hit], at[hit]
                out[rows] = self.store.load(f"counts-{b}", np.uint8)[at]
                full = rows[out[rows] == 255]
                if len(full):
                    big = self.store.load(f"large-{b}", np.int64).reshape(-1, 2)
                    out[full] = big[np.searchsorted(big[:, 0].view(np.uint64), names[full]), 1]
        return out

    def score(self, tokens: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, base score, model score (log10)."""
        words, index = np.unique(np.append(tokens, START), return_inverse=True)
        info = self.look_up_words(words)
        before = contexts_of(tokens, first)
        names = bigram_names(before, tokens)
        c = self.look_up_pairs(before, names)
        d2, d1 = discounts(self.pair_counts), discounts(self.word_counts[:4])
        k = info[:, 4]
        reserve = (d1[1:] * [self.word_counts[0], self.word_counts[1], self.word_counts[4]]).sum()
        low = (np.maximum(k - d1[np.minimum(k, 3)], 0) + (reserve / (self.words + 1) if self.pairs else 0)) / max(1, self.pairs) if self.pairs else np.ones(len(k))
        context = np.empty(len(tokens), np.int64)
        context[1:] = index[: len(tokens) - 1]
        context[first[:-1]] = index[-1]
        count = info[context, 0]
        back = (info[context, 1:4] * d2[1:]).sum(1)
        p_low = low[index[:-1]]
        p = np.where(count > 0, (np.maximum(c - d2[np.minimum(c, 3)], 0) + back * p_low) / np.maximum(count, 1), p_low)
        own = np.where(tokens == END, self.texts, info[index[:-1], 0])
        base = np.log10((own + 0.1) / (self.tokens + 0.1 * (self.words + 1)))
        at = first[:-1]
        return np.add.reduceat((own > 0).astype(np.int64), at), np.add.reduceat(base, at), np.add.reduceat(np.log10(p), at)


def _by_bucket(where: np.ndarray):
    order = np.argsort(where, kind="stable")
    edge = np.flatnonzero(np.concatenate(([True], where[order][1:] != where[order][:-1]))) if len(where) else []
    for a, b in zip(edge, [*edge[1:], len(where)]):
        yield int(where[order[a]]), order[a:b]


def train(texts: DataFrame, folder: str, sample_documents: int = 2000) -> Model:
    """Count the column ``text`` of all rows and write the model below ``folder``."""
    n, size = texts.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    buckets = max(LEAST_BUCKETS, -(-(size or 0) // PER_BUCKET))
    word_buckets = max(LEAST_BUCKETS, buckets // 4)
    store = Store(f"{folder}/model")

    words = texts.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < 1e6 * min(1.0, sample_documents / max(1, n)))
    counts: dict[int, int] = {}
    for batch in words.mapInArrow(_word_counts, "name long, n long").groupBy("name").agg(F.sum("n").alias("n")).orderBy(F.desc("n")).limit(4096).collect():
        counts[batch["name"]] = batch["n"]
    total = sum(counts.values())
    spread = np.array(sorted([int(START)] + [w for w, c in counts.items() if c * buckets * 8 > total]), np.uint64)

    def count(batches):
        def block(held: list[tuple[np.ndarray, np.ndarray]]):
            before, after = (np.concatenate(x) for x in zip(*held))
            names = bigram_names(before, after)
            order = np.argsort(names, kind="stable")
            names = names[order]
            edge = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
            n = np.diff(np.concatenate((edge, [len(names)])))
            before, after, names = before[order[edge]], after[order[edge]], names[edge]
            where = buckets_of(before, names, spread, buckets)
            order = np.lexsort((before, where))
            ids, data = [], []
            for b, rows in _by_bucket(where[order]):
                rows = order[rows]
                ids.append(b), data.append(pack(before[rows], after[rows], n[rows]))
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(data, pa.binary())], ["bucket", "data"])

        held, size = [], 0
        for batch in batches:
            for _, part in text_slices(batch.column("text")):
                tokens, first = tokens_of(part)
                held.append((contexts_of(tokens, first), tokens))
                size += sum(map(len, part)) + 8 * len(part)
                if size > COMBINED:
                    yield block(held)
                    held, size = [], 0
        if held:
            yield block(held)

    def merge(key, rows):
        bucket = key[0].as_py()
        columns = [np.concatenate(x) for x in zip(*(unpack(d, "wn") for d in rows.column("data").to_pylist()))]
        before, after, n = columns
        names = bigram_names(before, after)
        order = np.argsort(names, kind="stable")
        names = names[order]
        edge = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1])))
        n = np.add.reduceat(n[order], edge)
        names, before, after = names[edge], before[order[edge]], after[order[edge]]
        store.save(f"pairs-{bucket}", names)
        store.save(f"counts-{bucket}", np.minimum(n, 255).astype(np.uint8))
        large = n >= 255
        store.save(f"large-{bucket}", np.stack((names[large].view(np.int64), n[large]), 1))
        context = summed(before, n, *((n == i).astype(np.int64) for i in (1, 2)), (n > 2).astype(np.int64))
        follows = summed(after, np.ones(len(after), np.int64))
        ids, kinds, data = [-1], ["pairs"], [np.array([bucket, *((n == i).sum() for i in (1, 2, 3, 4)), len(n)], np.int64).tobytes()]
        for kind, (w, *sums) in (("context", context), ("follows", follows)):
            where = (mixed(w) % np.uint64(word_buckets)).astype(np.int64)
            for b, some in _by_bucket(where):
                ids.append(b), kinds.append(kind), data.append(pack(w[some], *(s[some] for s in sums)))
        return pa.table([pa.array(ids, pa.int64()), pa.array(kinds), pa.array(data, pa.binary())], ["bucket", "kind", "data"])

    def finish(key, rows):
        bucket = key[0].as_py()
        if bucket < 0:
            return rows.select(["kind", "data"])
        found = {"context": [], "follows": []}
        for kind, data in zip(rows.column("kind").to_pylist(), rows.column("data").to_pylist()):
            w, *sums = unpack(data, "nnnn" if kind == "context" else "n")
            found[kind].append((w, np.stack(sums, 1)))
        names = np.concatenate([w for x in found.values() for w, _ in x])
        sums = np.zeros((len(names), 5), np.int64)
        at = 0
        for kind, columns in (("context", slice(0, 4)), ("follows", slice(4, 5))):
            for w, s in found[kind]:
                sums[at : at + len(w), columns] = s
                at += len(w)
        names, *columns = summed(names, *sums.T)
        sums = np.stack(columns, 1)
        # An end mark is no context: its own count is that of the texts.
        store.save(f"words-{bucket}", names)
        store.save(f"sums-{bucket}", np.ascontiguousarray(sums))
        k, real = sums[:, 4], names > START
        out = [bucket, *((k == i).sum() for i in (1, 2, 3, 4)), (k > 2).sum(), sums[real, 0].sum(), (real & ((sums[:, 0] > 0) | (k > 0))).sum()]
        return pa.table([pa.array(["words"]), pa.array([np.array(out, np.int64).tobytes()], pa.binary())], ["kind", "data"])

    blocks = texts.select("text").mapInArrow(count, "bucket long, data binary")
    merged = blocks.groupBy("bucket").applyInArrow(merge, "bucket long, kind string, data binary")
    found = merged.groupBy("bucket").applyInArrow(finish, "kind string, data binary").collect()  # one small row a bucket
    freed(texts.sparkSession)
    of = {kind: [np.frombuffer(r["data"], np.int64) for r in found if r["kind"] == kind] for kind in ("pairs", "words")}
    made = {f"{kind}-{x[0]}" for kind, rows in of.items() for x in rows}
    pair, word = (sum((x[1:] for x in of[kind]), np.zeros(size, np.int64)).tolist() for kind, size in (("pairs", 5), ("words", 7)))
    return Model(store, made, buckets, word_buckets, spread, pair[:4], word[:5], pair[4], n, word[5] + n, word[6])


def _word_counts(batches):
    for batch in batches:
        for _, part in text_slices(batch.column("text")):
            names, n = np.unique(tokens_of(part)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(names.view(np.int64)), pa.array(n)], ["name", "n"])


def scored(documents: DataFrame, model: Model) -> DataFrame:
    """The documents' columns but text, with n_tokens, n_known, base_score and score."""
    rest = [c for c in documents.columns if c not in ("text", "n_tokens", "n_known", "base_score", "score")]
    base = documents.select(*[F.col(f"`{c}`") for c in rest], "text")
    fields = pa.schema([("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])

    def score(batches):
        for batch in batches:
            columns = [[], [], [], []]
            for _, part in text_slices(batch.column(len(rest))):
                tokens, first = tokens_of(part)
                for c, x in zip(columns, (np.diff(first), *model.score(tokens, first))):
                    c.append(x)
            new = [pa.array(np.concatenate(c) if c else [], f.type) for c, f in zip(columns, fields)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(rest)], *new], schema=pa.schema([*[batch.schema.field(i) for i in range(len(rest))], *fields]))

    own = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in base.schema if f.name != "text")
    return base.mapInArrow(score, f"{own}n_tokens long, n_known long, base_score double, score double")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(10)) == 0, F.lit(True))


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text")
    model = train(documents.filter(~F.col("held_out")), shared_dir(spark))
    return scored(documents, model).withColumn("train_tokens", F.lit(model.tokens).cast("long"))
