"""MinHash near-dedup by a chosen-path set similarity join.

A document's set is its distinct word shingles. Documents with equal sets are one class
(by digest of the sorted set); classes are joined with each other:

1. Every class gets ``COORDINATES`` minwise tokens. ``TREES`` independent trees start with
   ``ROOTS`` selected coordinates each; a class goes to one node for each, named by the
   minwise token it has there.
2. A node with more than ``SMALL`` classes branches: its name selects two more coordinates,
   and each class goes to the child named by its token at each. Nodes with one class end.
   A child that kept most of its parent is *dense*: branching would not take it apart, so
   it is treated as small.
3. Small nodes are compared exhaustively by their minwise tokens, those with more than
   ``LEAF`` classes in pairs of blocks. Classes with enough equal
   tokens form clusters; a cluster found in several leaves is taken once.
4. Within clusters every pair is decided on the full sets, and links that join two
   parts are kept. Connected components of these links give the result.

A pair at similarity 0.75 shares a root's token with chance 0.75 and stays together over
a branching with 1 - 0.25**2; over 16 roots and six levels, 6e-6 of such pairs are missed,
and far fewer of more similar ones. 72 of 128 equal tokens are asked for at leaves, five
standard deviations below what such a pair has.

Counting precedes every regrouping, groups that reach one task have about 2 * BLOCK
classes at most, and tables are written to the shared folder between steps, so lost executors
cost no more than the current step.

Defined results: null or empty texts, and those without words, have an empty set, are
linked with nothing and are their own component; a text shorter than a shingle has its
whole word sequence as one; rows that repeat a doc_id are judged each by its text;
a null doc_id has the smallest other doc_id of its component as component, if any; the
query does not mark it as kept, ``deduplicated`` keeps one row of each component, a null
doc_id where there is no other. Columns other than doc_id and text are carried by ``deduplicated``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import BLANK, Words, dropped, mixed, raw_texts, shared_dir, slices, table, text_slices, windows, written

SHINGLE = 5
#: Links have 100 * intersection >= SIMILARITY * union.
SIMILARITY = 75
TREES, ROOTS, COORDINATES = 8, 2, 128
#: Classes of a node above which it branches; above which it is cut into blocks; and of a block.
SMALL, LEAF, BLOCK = 4096, 1024, 768
#: A child with more than this share of its parent is dense.
DENSE = 0.7
DEEPEST = 40
#: Equal minwise tokens, of COORDINATES, that a pair at a leaf must have.
EQUAL_TOKENS = 72

_MULTIPLIERS = mixed(np.arange(1, COORDINATES + 1, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def shingle_sets(texts: list[bytes], size: int = SHINGLE) -> list[np.ndarray]:
    """Each text's sorted distinct shingle hashes."""
    words = Words(texts, BLANK)
    every = windows(words.hashes, size)
    first, out = words.first.tolist(), []
    for a, b in zip(first, first[1:]):
        n = b - a
        if n >= size:
            out.append(np.unique(every[a : b - size + 1]))
        elif n:
            out.append(mixed(windows(words.hashes[a:b], n) + np.uint64(n)))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def minwise(sets: list[np.ndarray]) -> np.ndarray:
    """[set, coordinate]: the least hash of each non-empty set under each coordinate's multiplier."""
    values = np.concatenate(sets)
    at = np.cumsum([0, *map(len, sets[:-1])])
    out = np.empty((len(sets), COORDINATES), np.uint64)
    held = np.empty_like(values)
    for j, m in enumerate(_MULTIPLIERS):
        np.multiply(values, m, out=held)
        out[:, j] = np.minimum.reduceat(held, at)
    return out


def text_key(text: bytes) -> int:
    """Tells texts of one doc_id, or of none, apart."""
    return xxhash.xxh3_64_intdigest(text) - (1 << 63)


def signatures(documents: DataFrame) -> DataFrame:
    """doc_id, text_key, n, digest, roots (node names) and tokens (16 bits for each coordinate) of every row."""
    kind = documents.schema["doc_id"].dataType.simpleString()

    def sign(batches):
        for batch in batches:
            keys, n, digest, roots, tokens = [], [], [], [], []
            for _, part in text_slices(batch.column("text")):
                sets = shingle_sets(part)
                keys += map(text_key, part)
                n += map(len, sets)
                full = [s for s in sets if len(s)]
                found = minwise(full) if full else np.empty((0, COORDINATES), np.uint64)
                names = mixed(found[:, : TREES * ROOTS] + np.arange(1, TREES * ROOTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64).tolist()
                short = (mixed(found) & np.uint64(0xFFFF)).astype("<u2")
                k = 0
                for s in sets:
                    if len(s):
                        digest.append(xxhash.xxh3_128_digest(s)), roots.append(names[k]), tokens.append(short[k].tobytes())
                        k += 1
                    else:
                        digest.append(None), roots.append(None), tokens.append(None)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(keys, pa.int64()), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(roots, pa.list_(pa.int64())), pa.array(tokens, pa.binary())],
                ["doc_id", "text_key", "n", "digest", "roots", "tokens"],
            )

    return documents.select("doc_id", "text").mapInArrow(sign, f"doc_id {kind}, text_key long, n long, digest binary, roots array<long>, tokens binary")


def groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Whole groups of rows sorted by ``key``: a table and where its groups begin, with the end."""
    held: list[pa.RecordBatch] = []

    def cut(whole: pa.Table):
        keys = whole.column(key).to_numpy()
        return np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held)
        at = cut(whole)
        if len(at) > 2:
            yield whole.slice(0, at[-2]), at[:-1]
            held = whole.slice(at[-2]).combine_chunks().to_batches()
    if held:
        whole = pa.Table.from_batches(held)
        yield whole, cut(whole)


class Parts:
    """Union-find over 0..n-1."""

    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = i = self.up[self.up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.root(i), self.root(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def close_pairs(tokens: np.ndarray, sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of rows whose sizes and tokens allow a link."""
    for i in range(len(tokens) - 1):
        fits = 100 * np.minimum(sizes[i + 1 :], sizes[i]) >= SIMILARITY * np.maximum(sizes[i + 1 :], sizes[i])
        near = np.flatnonzero(fits) + i + 1
        if len(near):
            for j in near[(tokens[near] == tokens[i]).sum(1) >= EQUAL_TOKENS].tolist():
                yield i, j


def clusters(leaves: DataFrame) -> DataFrame:
    """(cluster, digest) of the classes that are close to another one in a leaf; equal clusters once."""

    def find(batches):
        for whole, at in groups(batches, "node"):
            tokens = np.frombuffer(b"".join(whole.column("tokens").to_pylist()), "<u2").reshape(-1, COORDINATES)
            sizes, digests = whole.column("n").to_numpy(), whole.column("digest").to_pylist()
            names, members = [], []

            def emit(ids: list[bytes]) -> None:
                ids = sorted(set(ids))
                if len(ids) > 1:
                    names.extend([xxhash.xxh3_64_intdigest(b"".join(ids)) - (1 << 63)] * len(ids))
                    members.extend(ids)

            length = np.diff(at)
            two = at[:-1][length == 2]
            fits = 100 * np.minimum(sizes[two], sizes[two + 1]) >= SIMILARITY * np.maximum(sizes[two], sizes[two + 1])
            for i in two[fits & ((tokens[two] == tokens[two + 1]).sum(1) >= EQUAL_TOKENS)].tolist():
                emit([digests[i], digests[i + 1]])
            for a, b in zip(at[:-1][length > 2].tolist(), at[1:][length > 2].tolist()):
                parts = Parts(b - a)
                for i, j in close_pairs(tokens[a:b], sizes[a:b]):
                    parts.join(i, j)
                by: dict[int, list[bytes]] = {}
                for i in range(b - a):
                    by.setdefault(parts.root(i), []).append(digests[a + i])
                for ids in by.values():
                    emit(ids)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(members, pa.binary())], ["cluster", "digest"])

    dealt = leaves.select("node", "digest", "n", "tokens").repartition("node").sortWithinPartitions("node")
    return dealt.mapInArrow(find, "cluster long, digest binary").distinct()


def links_within(sets: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links that connect what is connected by pairs at or above the similarity; decided on the full sets."""
    n = len(sets)
    sizes = np.array([len(s) for s in sets])
    if n == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))]] * 2)
    else:
        owner = np.repeat(np.arange(n), sizes)
        values, column, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        wanted = np.flatnonzero(counts > 1)
        place = np.full(len(values), -1)
        place[wanted] = np.arange(len(wanted))
        column = place[column]
        common = np.zeros((n, n))
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        for a in range(0, len(wanted), 4096):
            lo, hi = np.searchsorted(column, (a, a + 4096))
            block = np.zeros((n, 4096), np.float32)
            block[owner[lo:hi], column[lo:hi] - a] = 1
            common += block @ block.T
    parts, out = Parts(n), []
    for i in range(n - 1):
        for j in range(i + 1, n):
            both = int(common[i, j])
            if 100 * both >= SIMILARITY * (int(sizes[i]) + int(sizes[j]) - both) and parts.join(i, j):
                out.append((i, j))
    return out


def verified(found: DataFrame, classes: DataFrame, documents: DataFrame) -> DataFrame:
    """Links (a, b) between digests, from the clusters ``found`` and the full sets of their documents.

    Texts travel compressed, a third of their sets' size, and become sets again where a cluster is decided.
    """
    kind = documents.schema["doc_id"].dataType.simpleString()

    def squeeze(batches):
        for batch in batches:
            texts = raw_texts(batch.column("text"))
            data = [pa.compress(t, codec="zstd", asbytes=True) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(text_key, texts), pa.int64()), pa.array(map(len, texts), pa.int64()), pa.array(data, pa.binary())], ["doc_id", "text_key", "size", "data"])

    texts = documents.select("doc_id", "text").mapInArrow(squeeze, f"doc_id {kind}, text_key long, size long, data binary")
    wanted = found.join(classes.select("digest", "place.*"), "digest")

    def decide(batches):
        for whole, at in groups(batches, "cluster"):
            digests, sizes, data = (whole.column(c) for c in ("digest", "size", "data"))
            left, right = [], []
            for a, b in zip(at.tolist(), at[1:].tolist()):
                raw = [pa.decompress(data[i].as_py(), sizes[i].as_py(), codec="zstd", asbytes=True) if sizes[i].as_py() else b"" for i in range(a, b)]
                members: dict[bytes, np.ndarray] = {}
                for first, part in slices(raw):
                    for i, s in enumerate(shingle_sets(part), a + first):
                        # Another text of the same doc_id is not meant; a repeated row counts once.
                        if len(s) and (d := digests[i].as_py()) not in members and xxhash.xxh3_128_digest(s) == d:
                            members[d] = s
                order = sorted(members)
                for i, j in links_within([members[d] for d in order]) if len(order) > 1 else ():
                    left.append(order[i]), right.append(order[j])
            yield pa.RecordBatch.from_arrays([pa.array(left, pa.binary()), pa.array(right, pa.binary())], ["a", "b"])

    at_place = wanted["doc_id"].eqNullSafe(texts["doc_id"]) & (wanted["text_key"] == texts["text_key"])
    dealt = wanted.join(texts, at_place).select("cluster", "digest", "size", "data").repartition("cluster").sortWithinPartitions("cluster")
    return dealt.mapInArrow(decide, "a binary, b binary").distinct()


def components(links: DataFrame, folder: str) -> DataFrame:
    """(digest, label) of every class with a link; label is a digest of its component.

    Each round joins every vertex to its least neighbour and contracts the links. Digests
    are random, so the number of rounds grows with the logarithm of a component's size.
    """
    spark, labels, round_ = links.sparkSession, None, 0
    while not links.isEmpty():
        both = links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        up = written(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("v"), F.least("a", "b").alias("up")), folder, f"up{round_}")
        contracted = (
            links.join(up.select(F.col("v").alias("a"), F.col("up").alias("ua")), "a")
            .join(up.select(F.col("v").alias("b"), F.col("up").alias("ub")), "b")
            .filter("ua <> ub").select(F.least("ua", "ub").alias("a"), F.greatest("ua", "ub").alias("b")).distinct()
        )
        links = written(contracted, folder, f"links{round_ + 1}")
        if labels is None:
            labels = up.select(F.col("v").alias("digest"), F.col("up").alias("label"))
        else:
            labels = labels.join(up, labels["label"] == up["v"], "left").select("digest", F.coalesce("up", "label").alias("label"))
        labels = written(labels, folder, f"labels{round_}")
        if round_:
            dropped(spark, folder, f"links{round_}", f"labels{round_ - 1}", f"up{round_ - 1}")
        round_ += 1
    return labels if labels is not None else spark.createDataFrame([], "digest binary, label binary")


def leaves_of(classes: DataFrame, folder: str) -> DataFrame:
    """(node, digest, n, tokens) of all nodes to compare exhaustively."""
    spark = classes.sparkSession
    parts: list[DataFrame] = []
    rows = classes.select("digest", F.explode("roots").alias("node"), F.lit(None).cast("long").alias("above"))
    tokens = classes.select("digest", "n", "tokens")
    coordinates = COORDINATES - TREES * ROOTS
    for depth in range(DEEPEST + 1):
        sizes = rows.groupBy("node").agg(F.count("*").alias("size")).filter("size > 1")
        live = rows.join(sizes, "node")
        if depth == 0:
            live = live.join(tokens, "digest")
        whole = (F.col("size") <= SMALL) | (F.col("size") > DENSE * F.coalesce("above", F.col("size") * 2)) | F.lit(depth == DEEPEST)
        live = written(live.select("node", "digest", "n", "tokens", "size", whole.alias("whole")), folder, f"level{depth}")
        parts.append(live.filter(f"size <= {LEAF}").select("node", "digest", "n", "tokens"))
        # Pairs of blocks: every class of the node meets every other one in some pair.
        blocks = F.ceil(F.col("size") / BLOCK)
        own = F.pmod(F.xxhash64("digest", F.lit(depth)), blocks)
        parts.append(
            live.filter(f"size > {LEAF} AND whole").withColumn("blocks", blocks).withColumn("own", own)
            .select(F.explode(F.expr("transform(sequence(0, blocks - 1), o -> xxhash64(node, least(own, o), greatest(own, o), 'pair'))")).alias("node"), "digest", "n", "tokens")
        )
        large = live.filter("NOT whole")
        if large.isEmpty():
            break
        first = F.pmod(F.xxhash64("node", F.lit("first")), F.lit(coordinates))
        second = F.pmod(first + 1 + F.pmod(F.xxhash64("node", F.lit("second")), F.lit(coordinates - 1)), F.lit(coordinates))
        child = [F.xxhash64("node", j, F.expr(f"substring(tokens, CAST(2 * ({j} + {TREES * ROOTS}) + 1 AS INT), 2)")) for j in ("j1", "j2")]
        rows = large.withColumns({"j1": first, "j2": second}).select(F.explode(F.array(*child)).alias("node"), "digest", "n", "tokens", F.col("size").alias("above"))
    return reduce(DataFrame.union, parts)


def classified(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles, digest and component_id of every row of ``documents``."""
    spark = documents.sparkSession
    folder = shared_dir(spark)
    signed = written(signatures(documents), folder, "signed")
    classes = written(
        signed.filter("digest is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"), F.min(F.struct("doc_id", "text_key")).alias("place"), *[F.first(c).alias(c) for c in ("n", "roots", "tokens")]),
        folder, "classes",
    )
    found = written(clusters(leaves_of(classes, folder)), folder, "clusters")
    dropped(spark, folder, *[f"level{i}" for i in range(DEEPEST + 1)])
    links = written(verified(found, classes, documents), folder, "links0")
    labels = components(links, folder)
    least = labels.join(classes.select("digest", "rep"), "digest").groupBy("label").agg(F.min("rep").alias("least"))
    linked = labels.join(least, "label").select("digest", "least")
    of_class = classes.select("digest", "rep").join(linked, "digest", "left").select("digest", F.coalesce("least", "rep").alias("component_id"))
    return signed.select("doc_id", "n", "digest").join(of_class, "digest", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), "digest", F.coalesce("component_id", "doc_id").alias("component_id")
    )


def deduplicated(documents: DataFrame) -> DataFrame:
    """The documents that stay: of each component one row, that with the smallest doc_id.

    Null doc_ids come last; among equal ones a digest of the row decides. Every row is judged
    by its own text, whatever other rows share its doc_id. Rows without words all stay, but
    rows alike in every column count once.
    """
    text, others = F.col("text"), [F.col(f"`{c}`") for c in documents.columns if c not in ("doc_id", "text")]
    row = F.concat(F.to_json(F.struct(text.isNull().alias("null"), F.struct(F.lit(0), *others).alias("others"))), F.coalesce(text, F.lit("")))
    # Names rows by content, in the order of preference: a component's least name is the row to keep.
    name = F.struct(F.col("doc_id").isNull().alias("last"), F.col("doc_id").alias("id"), F.unhex(F.sha2(row, 256)).alias("row"))
    kept = classified(documents.select(name.alias("doc_id"), "text")).filter("doc_id = component_id").select(F.col("doc_id").alias("__kept")).distinct()
    named = documents.withColumn("__name", name)
    return named.join(kept, F.col("__name") == F.col("__kept"), "left_semi").dropDuplicates(["__name"]).drop("__name")


def query(spark, sf_dir: str) -> DataFrame:
    return classified(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)).alias("kept"))


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w
  FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
common AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)),
edge AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT doc_id AS a, doc_id AS b FROM w UNION SELECT reach.a, edge.b FROM reach JOIN edge ON reach.b = edge.a)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1) USING (doc_id)
"""
