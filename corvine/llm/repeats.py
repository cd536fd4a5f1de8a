"""Exact repeated-substring removal by prefix-free parsing.

Every byte covered by a ``LENGTH``-byte string that starts at two or more places of the
corpus goes. Rolling-hash triggers parse each text into phrases. The first trigger inside
a string, its *anchor*, depends on the string's bytes alone, so equal strings agree on it;
a string is a suffix of the phrase before its anchor followed by the parse from there on.
The strings with one anchor are a *block* of a text; the ``CORE`` bytes from the anchor on,
which lie in all of them, are its key.

1. Distinct blocks of a key are counted by a 128-bit digest of their bytes. Of a block that
   occurs twice every string repeats. A key with one distinct block needs no more.
2. Where blocks of a key differ, one block of each kind is sent to the key's bucket. There the
   *suffix array of the parse* (what follows the anchors, sorted, with the common prefixes
   of neighbours) and the *suffix array of the dictionary* (what precedes the anchors, as
   phrase suffixes sorted from the anchor backwards) are built from the bytes. For each
   length of phrase suffix, the suffixes that are equal and the places of the parse that are
   equal for the rest of LENGTH are runs of the two arrays; strings in the same run of
   both are neighbours in corpus order with a common prefix of LENGTH bytes: repeats.
3. Keys with more than ``HOT`` distinct blocks do not meet in one bucket: their single strings
   are counted by 128-bit digest, each in a bucket of its own digest.

Buckets hold all suffixes that share a key, so no neighbours are torn apart; buckets
among each other are not in lexicographic order, which nothing here asks for.

Triggers come in three nested densities, the rarest that lies early enough in the string
being used. A string without any is a block of its own; long runs with a period of up to
``PERIOD`` bytes are known to repeat without being hashed string by string, save one period.

Texts are first written as compressed *chunks*, and each step adds a shuffle of packed
arrays: what a chunk knows about a bucket, and the answer. A digest occurs once a chunk
at most, however many documents have it, so frequent passages combine before any shuffle.
Nothing is taken as repeated that agrees in fewer than 128 bits of a digest or its bytes.

Defined results: null text is empty and stays null; matches never cross texts; texts
shorter than LENGTH lose nothing; repeated rows are texts of their own and so repeat
each other; doc_id is not looked at, so null and repeated ones make no difference; other
columns are carried by ``deduplicated``.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import chunk_batch, freed, mixed, raw_texts, shared_dir, stored_chunks, table, with_answers, written

LENGTH = 200
#: Bytes of a trigger, and of the text from its start that key it.
TRIGGER, CORE = 8, 64
#: Zero bits of a trigger's hash, rarest first.
BITS = (6, 5, 3)
#: Longest period of runs without triggers that are not hashed string by string.
PERIOD = 128
#: Starts without triggers in a row that are looked at for a period.
LONG_RUN = 256
#: Distinct blocks of a key that one bucket compares.
HOT = 50_000
#: Bytes of text for each bucket, and whose strings are parsed at once.
PER_BUCKET, SEGMENT = 16 << 20, 4 << 20
LEAST_BUCKETS = 32
#: What a bucket answers on a block: it occurs elsewhere; it stands for its kind among different ones of its key; there are many of those.
SEVERAL, STANDS, MANY = 1, 2, 4


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one number."""
    two = data[:-1].astype(np.uint16) | (data[1:].astype(np.uint16) << np.uint16(8))
    four = two[:-2].astype(np.uint32) | (two[2:].astype(np.uint32) << np.uint32(16))
    return four[:-4].astype(np.uint64) | (four[4:].astype(np.uint64) << np.uint64(32))


@dataclass
class Blocks:
    """Blocks of some joined texts: anchor, first and last start, key; and runs (first, last start) that repeat within their text."""

    anchor: np.ndarray
    low: np.ndarray
    high: np.ndarray
    key: np.ndarray
    known: np.ndarray


def periodic(data: np.ndarray, own: np.ndarray, length: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Of the sorted starts ``own``, those to hash; and runs of starts that equal another start within one run of a period."""
    runs: list[tuple[int, int]] = []
    if not len(own):
        return own, runs
    edge = np.flatnonzero(np.diff(own) > 1) + 1
    skipped = np.zeros(len(own), bool)
    for a, b in zip(np.concatenate(([0], edge)).tolist(), np.concatenate((edge, [len(own)])).tolist()):
        if b - a < LONG_RUN:
            continue
        first, last = int(own[a]), int(own[b - 1])
        part = data[first : last + length]
        done = np.zeros(b - a, bool)
        for p in range(1, PERIOD + 1):
            # Starts s with s and s + p both among own and the bytes between alike: unlike pairs break a run.
            unlike = np.flatnonzero(part[:-p] != part[p:])
            cut = np.concatenate(([-1], unlike, [len(part) - p]))
            long = np.flatnonzero(np.diff(cut) > length)
            for i in long.tolist():
                s, e = int(cut[i]) + 1, int(cut[i + 1]) - length  # string s .. e equals the one p further
                if e - s >= p and not done[s : e + p + 1].all():
                    runs.append((first + s, first + e + p))
                    done[s : e + p + 1] = True
                    skipped[a + s + p : a + e + p + 1] = True
            if len(done) - done.sum() < LONG_RUN:
                break
    return own[~skipped], runs


def blocks_of(data: np.ndarray, valid_to: np.ndarray, starts: np.ndarray, length: int) -> Blocks:
    """Blocks of the strings that start in ``data``; text i has bytes from starts[i], its strings start up to valid_to[i]."""
    reach = length - CORE
    none = np.empty(0, np.int64)
    if len(data) < length or not (valid_to >= starts).any():
        return Blocks(none, none, none, none.astype(np.uint64), none.reshape(0, 2))
    eight = eights(data)
    h = (eight * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS[0])
    densest = np.flatnonzero(h & np.uint64((1 << BITS[-1]) - 1) == 0)
    levels = [densest[h[densest] & np.uint64((1 << b) - 1) == 0] for b in BITS]
    del h
    # The rarest triggers: each anchors the starts up to ``reach`` before it, back to the trigger before.
    rare = levels[0]
    before = np.concatenate(([-1], rare[:-1]))
    text = np.searchsorted(starts, rare, "right") - 1
    low = np.maximum(np.maximum(before + 1, rare - reach), starts[text])
    high = np.minimum(rare, valid_to[text])
    some = low <= high
    anchors, lows, highs = [rare[some]], [low[some]], [high[some]]
    # Starts that none of them anchors.
    edges = np.concatenate((rare, [len(data) + reach]))
    a, b = np.concatenate(([0], rare + 1)), np.maximum(edges - reach, 0)
    size = np.maximum(b - a, 0)
    left = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(a, size)
    if len(left):
        text = np.maximum(np.searchsorted(starts, left, "right") - 1, 0)
        left = left[(left >= starts[text]) & (left <= valid_to[text])]
    for triggers in levels[1:]:
        if not len(left) or not len(triggers):
            continue
        i = np.searchsorted(triggers, left)
        ahead = triggers[np.minimum(i, len(triggers) - 1)]
        early = (i < len(triggers)) & (ahead - left <= reach)
        s, t = left[early], ahead[early]
        if len(s):
            edge = np.flatnonzero(np.concatenate(([True], (t[1:] != t[:-1]) | (s[1:] != s[:-1] + 1))))
            anchors.append(t[edge]), lows.append(s[edge]), highs.append(s[np.concatenate((edge[1:], [len(s)])) - 1])
        left = left[~early]
    left, known = periodic(data, left, length)
    anchors.append(left), lows.append(left), highs.append(left)
    anchor, low, high = np.concatenate(anchors), np.concatenate(lows), np.concatenate(highs)
    key = np.zeros(len(anchor), np.uint64)
    for k in range(0, CORE, 8):
        key = mixed(key + eight[anchor + k])
    return Blocks(anchor, low, high, key, np.array(known, np.int64).reshape(-1, 2))


class Chunk:
    """The texts of a chunk, joined with one byte between, and their blocks with digests."""

    def __init__(self, texts: list[bytes], length: int):
        self.raw = b"\0".join(texts) + b"\0"
        self.length = length
        self.sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.starts = np.concatenate(([0], np.cumsum(self.sizes + 1)))[: len(texts)]
        data = np.frombuffer(self.raw, np.uint8)
        valid_to = self.starts + self.sizes - length
        found: list[Blocks] = []
        for at in range(0, len(data), SEGMENT):
            some = slice(*np.searchsorted(self.starts, (at, min(at + SEGMENT, len(data)))))
            some = slice(max(some.start - 1, 0), some.stop)
            starts, to = np.maximum(self.starts[some] - at, 0), np.minimum(valid_to[some] - at, SEGMENT - 1)
            part = blocks_of(data[at : at + SEGMENT + length], to, starts, length)
            found.append(Blocks(part.anchor + at, part.low + at, part.high + at, part.key, part.known + at))
        self.anchor, self.low, self.high, self.key, self.known = (np.concatenate([getattr(f, n) for f in found]) if found else None for n in ("anchor", "low", "high", "key", "known"))
        self.whole = digests(self.raw, self.low, self.high + length)
        self.data = data


def digests(raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """[part, 2]: 128-bit digests of parts of ``raw``."""
    name = xxhash.xxh3_128_digest
    return np.frombuffer(b"".join([name(raw[a:b]) for a, b in zip(starts.tolist(), ends.tolist())]), np.uint64).reshape(-1, 2)


class Dealt:
    """The distinct digests of some things, in order of the buckets that their keys go to."""

    def __init__(self, key: np.ndarray, whole: np.ndarray, buckets: int):
        bucket = mixed(key) % np.uint64(buckets)
        order = np.lexsort((whole[:, 1], whole[:, 0], bucket))
        sorted_ = whole[order]
        new = np.flatnonzero(np.concatenate(([True], (sorted_[1:] != sorted_[:-1]).any(1)))) if len(order) else np.empty(0, np.int64)
        counts = np.diff(np.concatenate((new, [len(order)])))
        #: One thing of each digest, whether there are several, and the digest of each thing.
        self.first, self.several = order[new], counts > 1
        self.entry = np.empty(len(order), np.int64)
        self.entry[order] = np.repeat(np.arange(len(new)), counts)
        bucket = bucket[self.first]
        edge = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1]))) if len(bucket) else np.empty(0, np.int64)
        self.buckets = [(int(bucket[a]), slice(int(a), int(b))) for a, b in zip(edge, [*edge[1:], len(bucket)])]

    def codes(self, answers: dict[int, bytes]) -> np.ndarray:
        out = np.zeros(len(self.first), np.uint8)
        for b, rows in self.buckets:
            if b in answers:
                out[rows] = np.frombuffer(pa.decompress(answers[b], rows.stop - rows.start, codec="zstd", asbytes=True), np.uint8)
        return out


def packed(*arrays: np.ndarray) -> bytes:
    parts = [a.tobytes() for a in arrays]
    return np.array([len(parts), *map(len, parts)], np.int64).tobytes() + b"".join(parts)


def unpacked(data: bytes, *kinds) -> list[np.ndarray]:
    n = int(np.frombuffer(data[:8], np.int64)[0])
    sizes, at, out = np.frombuffer(data[8 : 8 + 8 * n], np.int64).tolist(), 8 + 8 * n, []
    for size, kind in zip(sizes, kinds):
        out.append(np.frombuffer(data[at : at + size], kind))
        at += size
    return out


ROWS = pa.schema([("kind", pa.string()), ("bucket", pa.int64()), ("chunk", pa.int64()), ("data", pa.binary())])
ROWS_SQL = "kind string, bucket long, chunk long, data binary"


def _rows(rows: list[tuple]) -> list[pa.Array]:
    return [pa.array(list(c), f.type) for c, f in zip(zip(*rows) if rows else [()] * len(ROWS), ROWS)]


def settled(rows: pa.Table, hot: int) -> list[tuple]:
    """Answers for each chunk's digests in a bucket, by all chunks' digests there."""
    parts = [unpacked(d, np.uint64, np.uint64, bool) for d in rows.column("data").to_pylist()]
    key, whole, several = (np.concatenate(x) for x in zip(*parts))
    whole = whole.reshape(-1, 2)
    order = np.lexsort((whole[:, 1], whole[:, 0]))
    sorted_ = whole[order]
    edge = np.flatnonzero(np.concatenate(([True], (sorted_[1:] != sorted_[:-1]).any(1))))
    n = np.add.reduceat(1 + several[order].astype(np.int64), edge)
    codes = np.zeros(len(key), np.uint8)
    codes[order] = np.repeat((n > 1).astype(np.uint8) * np.uint8(SEVERAL), np.diff(np.concatenate((edge, [len(order)]))))
    first = order[edge]
    _, which, kinds = np.unique(key[first], return_inverse=True, return_counts=True)
    kinds = kinds[which]
    codes[first] |= ((kinds > 1) * STANDS | (kinds > hot) * MANY).astype(np.uint8)
    at, out = 0, []
    for (k, _, _), chunk, kind, bucket in zip(parts, *(rows.column(c).to_pylist() for c in ("chunk", "kind", "bucket"))):
        mine = codes[at : at + len(k)]
        at += len(k)
        if mine.any():
            out.append((kind, bucket, chunk, pa.compress(mine.tobytes(), codec="zstd", asbytes=True)))
    return out


def _order(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of bytes in order, and the common prefix of each with the one before (0 for the first)."""
    order = np.argsort(np.ascontiguousarray(rows).view(f"S{rows.shape[1]}").ravel(), kind="stable")
    sorted_ = rows[order]
    unlike = sorted_[1:] != sorted_[:-1]
    return order, np.concatenate(([0], np.where(unlike.any(1), unlike.argmax(1), rows.shape[1])))


def combined(key: np.ndarray, least: np.ndarray, most: np.ndarray, left: np.ndarray, right: np.ndarray, length: int) -> np.ndarray:
    """[block, l]: whether the string that starts l bytes before the block's anchor is among the other blocks too.

    ``left`` has the bytes before the anchor, nearest first, ``right`` those from it on; l runs from ``least`` to ``most``.
    """
    n = len(key)
    named = key.byteswap().view(np.uint8).reshape(-1, 8)
    parse, parse_lcp = _order(np.concatenate((named, right), axis=1))
    dictionary, dictionary_lcp = _order(np.concatenate((named, left), axis=1))
    hits = np.zeros((n, left.shape[1] + 1), bool)
    after, before = np.empty(n, np.int64), np.empty(n, np.int64)
    for l in range(left.shape[1] + 1):  # noqa: E741
        some = np.flatnonzero((least <= l) & (l <= most))
        if len(some) < 2:
            continue
        after[parse] = np.cumsum(parse_lcp < 8 + length - l)
        before[dictionary] = np.cumsum(dictionary_lcp < 8 + l)
        both = after[some] * (n + 1) + before[some]
        order = np.argsort(both)
        same = both[order[1:]] == both[order[:-1]]
        hits[some[order[np.concatenate((same, [False])) | np.concatenate(([False], same))]], l] = True
    return hits


def sent(chunk: Chunk, chosen: np.ndarray) -> bytes:
    """The blocks ``chosen``: key, least and most bytes before the anchor, the bytes before (backwards) and from it on."""
    anchor, length = chunk.anchor[chosen], chunk.length
    least, most = anchor - chunk.high[chosen], anchor - chunk.low[chosen]
    raw, left, right = chunk.raw, [], []
    for a, lo, hi in zip(anchor.tolist(), least.tolist(), most.tolist()):
        left.append(raw[a - hi : a][::-1]), right.append(raw[a : a + length - lo])
    text = b"".join(left) + b"".join(right)
    squeezed = np.frombuffer(pa.compress(text, codec="zstd", asbytes=True), np.uint8)
    return packed(chunk.key[chosen], least.astype(np.uint8), most.astype(np.uint8), np.array([len(text)]), squeezed)


def compared(rows: pa.Table, length: int) -> list[tuple]:
    """For each chunk's blocks in a bucket, which of their strings occur in other blocks, one bit each."""
    parts, texts = [], []
    for d in rows.column("data").to_pylist():
        key, least, most, (size,), squeezed = unpacked(d, np.uint64, np.uint8, np.uint8, np.int64, np.uint8)
        parts.append((key, least.astype(np.int64), most.astype(np.int64)))
        texts.append(np.frombuffer(pa.decompress(squeezed.tobytes(), int(size), codec="zstd", asbytes=True), np.uint8))
    key, least, most = (np.concatenate(x) for x in zip(*parts))
    lefts = np.concatenate([t[: p[2].sum()] for t, p in zip(texts, parts)])
    rights = np.concatenate([t[p[2].sum() :] for t, p in zip(texts, parts)])
    del texts
    left_at, right_at = np.concatenate(([0], np.cumsum(most))), np.concatenate(([0], np.cumsum(length - least)))
    width = length - CORE
    hits = np.zeros((len(key), width + 1), bool)
    order = np.argsort(key, kind="stable")
    edge = np.concatenate(([0], np.flatnonzero(np.diff(key[order])) + 1, [len(key)]))
    columns = np.arange(length)
    a = 0
    while a < len(edge) - 1:  # whole keys, some ten thousand blocks at once
        b = max(a + 1, int(np.searchsorted(edge, edge[a] + 20_000, "right")) - 1)
        some = order[edge[a] : edge[b]]
        at_right = np.minimum(right_at[some][:, None] + columns, len(rights) - 1)
        right = np.where(columns < (length - least[some])[:, None], rights[at_right], 0).astype(np.uint8)
        at_left = np.minimum(left_at[some][:, None] + columns[:width], max(len(lefts) - 1, 0))
        left = np.where(columns[:width] < most[some][:, None], lefts[at_left] if len(lefts) else 0, 0).astype(np.uint8)
        hits[some] = combined(key[some], least[some], most[some], left, right, length)
        a = b
    inside = (np.arange(width + 1) >= least[:, None]) & (np.arange(width + 1) <= most[:, None])
    at, out = 0, []
    for (k, _, _), chunk, kind, bucket in zip(parts, *(rows.column(c).to_pylist() for c in ("chunk", "kind", "bucket"))):
        mine = hits[at : at + len(k)][inside[at : at + len(k)]]
        at += len(k)
        if mine.any():
            out.append((kind, bucket, chunk, pa.compress(np.packbits(mine).tobytes(), codec="zstd", asbytes=True)))
    return out


def _strings(chunk: Chunk, dealt: Dealt, chosen: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, Dealt]:
    """Owner (entry), start and digests of all strings of the entries ``chosen``."""
    block = dealt.first[chosen]
    size = chunk.high[block] - chunk.low[block] + 1
    start = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size) + np.repeat(chunk.low[block], size)
    whole = digests(chunk.raw, start, start + chunk.length)
    return np.repeat(chosen, size), start, Dealt(whole[:, 0], whole, buckets)


def spans_of(chunk: Chunk, dealt: Dealt, answers: dict[str, dict[int, bytes]], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal byte ranges of the joined texts that are covered by strings which occur elsewhere."""
    codes = dealt.codes(answers.get("blocks", {}))
    whole = (codes[dealt.entry] & SEVERAL) > 0
    low, high = [chunk.low[whole], chunk.known[:, 0]], [chunk.high[whole], chunk.known[:, 1]]
    for b, data in answers.get("contexts", {}).items():
        rows = next(r for x, r in dealt.buckets if x == b)
        chosen = np.flatnonzero((codes[rows] & (STANDS | MANY)) == STANDS) + rows.start
        block = dealt.first[chosen]
        size = chunk.high[block] - chunk.low[block] + 1
        total = int(size.sum())
        bits = np.unpackbits(np.frombuffer(pa.decompress(data, -(-total // 8), codec="zstd", asbytes=True), np.uint8), count=total).astype(bool)
        back = np.arange(total) - np.repeat(np.cumsum(size) - size, size)
        start = (np.repeat(chunk.high[block], size) - back)[bits]
        low.append(start), high.append(start)
    if answers.get("strings"):
        _, start, strings = _strings(chunk, dealt, np.flatnonzero(codes & MANY), buckets)
        start = start[(strings.codes(answers["strings"])[strings.entry] & SEVERAL) > 0]
        low.append(start), high.append(start)
    low, high = np.concatenate(low), np.concatenate(high)
    if not len(low):
        return low, high
    order = np.argsort(low, kind="stable")
    low, high = low[order], np.maximum.accumulate(high[order] + chunk.length)
    new = np.flatnonzero(np.concatenate(([True], low[1:] > high[:-1])))
    return low[new], high[np.concatenate((new[1:], [len(low)])) - 1]


def deduplicated(documents: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """The documents with the text that is left, and n_bytes, n_removed, removed (byte ranges) and kept_sha256.

    Characters of which a part is removed are replaced in ``text``; the digest is of the bytes.
    """
    spark = documents.sparkSession
    folder = shared_dir(spark)
    base = documents.drop("n_bytes", "n_removed", "removed", "kept_sha256")
    where = base.columns.index("text")
    chunks, size = stored_chunks(base, folder)
    buckets = max(LEAST_BUCKETS, -(-size // PER_BUCKET))

    def parsed(data: bytes) -> tuple[pa.RecordBatch, Chunk, Dealt]:
        batch = chunk_batch(data)
        chunk = Chunk(raw_texts(batch.column(where)), length)
        return batch, chunk, Dealt(chunk.key, chunk.whole, buckets)

    def name(batches):
        for batch in batches:
            for id_, data in zip(batch.column("chunk").to_pylist(), batch.column("data")):
                _, chunk, dealt = parsed(data.as_py())
                key, whole = chunk.key[dealt.first], chunk.whole[dealt.first]
                rows = [("blocks", b, id_, packed(key[r], whole[r], dealt.several[r])) for b, r in dealt.buckets]
                yield pa.RecordBatch.from_arrays(_rows(rows), schema=ROWS)

    def answer(key, rows):
        found = compared(rows, length) if key[0].as_py() == "contexts" else settled(rows, hot)
        return pa.table(_rows(found), schema=ROWS)

    def answered(rows: DataFrame) -> DataFrame:
        return rows.groupBy("kind", "bucket").applyInArrow(answer, ROWS_SQL)

    blocks = written(answered(chunks.select("chunk", "data").mapInArrow(name, ROWS_SQL)), folder, "blocks")
    freed(spark)

    def ask(batches):
        for batch in batches:
            for id_, data, found in zip(batch.column("chunk").to_pylist(), batch.column("data"), batch.column("answers").to_pylist()):
                _, chunk, dealt = parsed(data.as_py())
                codes = dealt.codes({x["bucket"]: x["data"] for x in found})
                rows = []
                for b, r in dealt.buckets:
                    chosen = np.flatnonzero((codes[r] & (STANDS | MANY)) == STANDS) + r.start
                    if len(chosen):
                        rows.append(("contexts", b, id_, sent(chunk, dealt.first[chosen])))
                many = np.flatnonzero(codes & MANY)
                if len(many):
                    owner, start, strings = _strings(chunk, dealt, many, buckets)
                    # A block that occurs elsewhere brings each of its strings twice.
                    several = strings.several | ((codes[owner[strings.first]] & SEVERAL) > 0) | ((codes[owner] & SEVERAL > 0)[strings.first])
                    whole = digests(chunk.raw, start[strings.first], start[strings.first] + length)
                    rows += [("strings", b, id_, packed(whole[r, 0].copy(), whole[r].copy(), several[r])) for b, r in strings.buckets]
                yield pa.RecordBatch.from_arrays(_rows(rows), schema=ROWS)

    odd = with_answers(chunks, blocks, "inner")
    more = written(answered(odd.mapInArrow(ask, ROWS_SQL)), folder, "more")
    freed(spark)
    fields = pa.schema([("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept_sha256", pa.string())])

    def remove(batches):
        for rows in batches:
            for data, found in zip(rows.column("data"), rows.column("answers").to_pylist()):
                batch, chunk, dealt = parsed(data.as_py())
                answers: dict[str, dict[int, bytes]] = {}
                for x in found or ():
                    answers.setdefault(x["kind"], {})[x["bucket"]] = x["data"]
                low, high = spans_of(chunk, dealt, answers, buckets)
                at = np.searchsorted(low, np.concatenate((chunk.starts, [len(chunk.raw)]))).tolist()
                valid = batch.column(where).is_valid().to_pylist()
                texts, made = [], [[], [], [], []]
                low, high = low.tolist(), high.tolist()
                for i, (start, size) in enumerate(zip(chunk.starts.tolist(), chunk.sizes.tolist())):
                    left, parts, spans = start, [], []
                    for a, b in zip(low[at[i] : at[i + 1]], high[at[i] : at[i + 1]]):
                        parts.append(chunk.raw[left:a]), spans.append({"start": a - start, "end": b - start})
                        left = b
                    out = b"".join([*parts, chunk.raw[left : start + size]])
                    texts.append(out.decode(errors="replace") if valid[i] else None)
                    for c, x in zip(made, (size, size - len(out), spans, hashlib.sha256(out).hexdigest())):
                        c.append(x)
                columns = list(batch.columns)
                columns[where] = pa.array(texts, columns[where].type)
                yield pa.RecordBatch.from_arrays([*columns, *(pa.array(c, f.type) for c, f in zip(made, fields))], schema=pa.schema([*batch.schema, *fields]))

    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    return with_answers(chunks, blocks.unionByName(more), "left").mapInArrow(remove, f"{own}, n_bytes long, n_removed long, removed array<struct<start:long,end:long>>, kept_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(documents).select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), "kept_sha256")


SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(h[2 * i + 1:2 * i + 400]) AS k FROM (SELECT r, h, unnest(range(0, len(h) // 2 - 199)) AS i FROM d WHERE len(h) >= 400)),
hit AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY k) AS c FROM w) WHERE c > 1),
mark AS (SELECT r, i, CASE WHEN i - lag(i) OVER (PARTITION BY r ORDER BY i) <= 200 THEN 0 ELSE 1 END AS begins FROM hit),
span AS (SELECT r, min(i) AS a, max(i) + 200 AS b FROM (SELECT r, i, sum(begins) OVER (PARTITION BY r ORDER BY i) AS g FROM mark) GROUP BY r, g),
piece AS (
  SELECT r, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS s, a AS e FROM span
  UNION ALL SELECT r, max(b), 1000000000 FROM span GROUP BY r),
kept AS (SELECT r, string_agg(h[2 * s + 1:2 * e], '' ORDER BY s) AS left_ FROM piece JOIN d USING (r) GROUP BY r),
spans AS (SELECT r, sum(b - a)::BIGINT AS n_removed, count(*) AS n_spans FROM span GROUP BY r)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(left_, h))) AS kept_sha256
FROM d LEFT JOIN spans USING (r) LEFT JOIN kept USING (r)
"""
