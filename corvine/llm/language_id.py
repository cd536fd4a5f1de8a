"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. The
probability of a word is the sum, over all ways to cut it into pieces, of the product
of the pieces' probabilities; the forward algorithm adds them up from left to right,
and expectation-maximisation fits the pieces with the matching backward pass. A text
scores the sum of its words' log-probabilities, and Bayes' rule over the languages
gives the prediction and its probability.

Fitting uses a sample of the labelled rows of at most about ``per_language`` documents
for each language (whole texts, chosen by hash of the row); only counts of its distinct
words reach the driver. Scoring covers every whole text. Words that occur often are
scored once per worker, in blocks of words of about equal length.

Defined results: null text, and text without a letter, is ``und`` with score 0; with no
labelled rows everything is ``und``; words of any length are scored over all their segmentations; ties go to the language first in order; repeated
rows are each predicted; other columns are carried along unread.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvine.llm.common import BLANK, Words, mixed, raw_texts, table, text_slices

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
UNKNOWN = "und"
#: Words whose scores a worker remembers.
REMEMBERED = 100_000
#: Bytes of words that are scored at once; longer ones go on from run to run of so many.
BLOCK = 256 << 10
#: Bytes of words that are learned from at once, on the driver.
LEARNED = 64 << 10
#: Steps between divisions of the masses by their size.
RESCALE = 16
#: Words longer than this are learned from in runs of about so many bytes (scored they are whole).
LONGEST = 64


def vocabulary(path: str = VOCABULARY) -> list[bytes]:
    """The pieces of a sentencepiece model as bytes, with every single byte among them; a space begins a word."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = {bytes([b]) for b in range(256)}
    for i in range(model.get_piece_size()):
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)):
            pieces.add(model.id_to_piece(i).replace("▁", " ").encode())
    return sorted(p for p in pieces if p)


class Pieces:
    """An open-addressing table from the rolling hash of each piece, and of each prefix of one, to the piece's number."""

    def __init__(self, pieces: list[bytes]):
        self.n, self.longest = len(pieces), max(map(len, pieces))
        number = {p: i for i, p in enumerate(pieces)}
        prefixes = sorted({p[:k] for p in pieces for k in range(1, len(p) + 1)})
        self.bits = max(8, (8 * len(prefixes)).bit_length())
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.ids = np.full(1 << self.bits, -1, np.int32)
        self.most = 0
        keys = np.zeros(len(prefixes), np.uint64)
        sizes = np.array([len(p) for p in prefixes])
        for k in range(sizes.max()):
            some = np.flatnonzero(sizes > k)
            keys[some] = self.step(keys[some], np.array([prefixes[i][k] for i in some.tolist()], np.uint8))
        for prefix, key in zip(prefixes, keys):
            at, tries = int(key >> np.uint64(64 - self.bits)), 0
            while self.keys[at]:
                at, tries = (at + 1) & ((1 << self.bits) - 1), tries + 1
            self.keys[at], self.ids[at] = key, number.get(prefix, -1)
            self.most = max(self.most, tries)

    @staticmethod
    def step(key: np.ndarray, byte: np.ndarray) -> np.ndarray:
        """The hash of a string from that of the string without its last byte."""
        return mixed(key + byte.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are in the table, as indices, and where in the table."""
        at = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        there = self.keys[at]
        hit = there == keys
        left = np.flatnonzero(~hit & (there != 0))
        for _ in range(self.most):
            if not len(left):
                break
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)
            there = self.keys[at[left]]
            same = there == keys[left]
            hit[left[same]] = True
            left = left[~same & (there != 0)]
        hit = np.flatnonzero(hit)
        return hit, at[hit]



class Lattice:
    """All pieces inside some words, none of them empty.

    Words stand in order of falling length (``order``). A word of n bytes has n + 1 nodes, from
    ``first`` on; a piece leads from a node to a later one. Pieces are sorted by how deep in
    their word they end, then by word, so that one step serves all words at once. Every node
    has a piece that ends there, since single bytes are pieces.
    """

    def __init__(self, pieces: Pieces, words: list[bytes]):
        self.longest = pieces.longest
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        self.order = np.argsort(-sizes, kind="stable")
        self.sizes = sizes[self.order]
        data = np.frombuffer(b"".join([words[i] for i in self.order.tolist()]), np.uint8)
        starts = np.concatenate(([0], np.cumsum(self.sizes)))[:-1]
        self.first = starts + np.arange(len(words))
        self.nodes = len(data) + len(words)
        owner = np.repeat(np.arange(len(words)), self.sizes)
        at, key = np.arange(len(data)), np.zeros(len(data), np.uint64)
        ends = np.repeat(starts + self.sizes, self.sizes)
        found = []
        for k in range(1, pieces.longest + 1):
            key = pieces.step(key, data[at + k - 1])
            hit, where = pieces.find(key)
            at, key, ids = at[hit], key[hit], pieces.ids[where]
            whole = ids >= 0
            found.append((at[whole], np.full(int(whole.sum()), k), ids[whole]))
            more = at + k < ends[at]
            at, key = at[more], key[more]
        at, size, piece = (np.concatenate(x) for x in zip(*found))
        depth, word = at - starts[owner[at]] + size, owner[at]
        order = np.lexsort((word, depth))
        depth, word = depth[order], word[order]
        self.source, self.piece = (at + owner[at])[order], piece[order]
        self.target = self.source + size[order]
        self.heads = np.flatnonzero(np.concatenate(([True], (depth[1:] != depth[:-1]) | (word[1:] != word[:-1]))))
        #: Where the pieces, and the heads, of each depth begin.
        self.bounds = np.searchsorted(depth, np.arange(self.sizes[0] + 2)).tolist()
        self.head_bounds = np.searchsorted(self.heads, self.bounds).tolist()

    def forward(self, p: np.ndarray, scaled: bool = True, given: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Mass of all segmentations up to each node, [node, language], and the logarithm of each word's scale.

        p is [piece, language]. ``scaled`` masses are divided now and then, from the last nodes that
        a piece can begin at on, by the mass at a node. ``given`` are the masses at the first nodes of a single word.
        """
        alpha, logs = np.zeros((self.nodes, p.shape[1])), np.zeros((len(self.sizes), p.shape[1]))
        alpha[self.first] = 1
        begin = 1
        if given is not None:
            alpha[: len(given)] = given
            begin = len(given)
        alive = len(self.sizes)
        for depth in range(begin, int(self.sizes[0]) + 1):
            a, b, heads = self.bounds[depth], self.bounds[depth + 1], self.heads[self.head_bounds[depth] : self.head_bounds[depth + 1]]
            alpha[self.target[heads]] = np.add.reduceat(alpha[self.source[a:b]] * p[self.piece[a:b]], heads - a)
            if scaled and depth % RESCALE == 0:
                while self.sizes[alive - 1] < depth:
                    alive -= 1
                here = self.first[:alive] + depth
                by = alpha[here]
                logs[:alive] += np.log(by)
                for back in range(min(self.longest, depth + 1)):
                    alpha[here - back] /= by
        return alpha, logs


def by_size(words: list[bytes], size: int) -> Iterable[list[int]]:
    """Indices of words of about one length, in runs of about ``size`` bytes."""
    some, held = [], 0
    for i in sorted(range(len(words)), key=lambda i: len(words[i])):
        if some and held + len(words[i]) > size:
            yield some
            some, held = [], 0
        some.append(i)
        held += len(words[i])
    if some:
        yield some


def parts(word: bytes) -> list[bytes]:
    """A word cut into runs of whole characters of about ``LONGEST`` bytes."""
    cuts = [0]
    for at in range(LONGEST, len(word), LONGEST):
        while at < len(word) and word[at] & 0xC0 == 0x80:
            at += 1
        cuts.append(at)
    return [word[a:b] for a, b in zip(cuts, [*cuts[1:], len(word)]) if a < b]


class Model:
    def __init__(self, pieces: list[bytes], languages: list[str], p: np.ndarray, prior: np.ndarray):
        self.pieces, self.languages, self.p, self.prior = Pieces(pieces), languages, p, prior

    def log_words(self, words: list[bytes]) -> np.ndarray:
        """Log-probability of each word (with its leading space) in each language."""
        out = np.zeros((len(words), len(self.languages)))
        short = [i for i, w in enumerate(words) if len(w) <= BLOCK]
        for some in by_size([words[i] for i in short], BLOCK):
            lattice = Lattice(self.pieces, [words[short[i]] for i in some])
            alpha, logs = lattice.forward(self.p)
            out[[short[some[i]] for i in lattice.order.tolist()]] = np.log(alpha[lattice.first + lattice.sizes]) + logs
        for i, word in enumerate(words):
            if len(word) > BLOCK:
                out[i] = self._log_long(word)
        return out

    def _log_long(self, word: bytes) -> np.ndarray:
        """A word in runs of BLOCK bytes; the masses at the last nodes of a run are the first of the next."""
        state, total = np.ones((1, len(self.languages))), 0.0
        for at in range(0, len(word), BLOCK):
            back = min(self.pieces.longest - 1, at)
            alpha, logs = Lattice(self.pieces, [word[at - back : at + BLOCK]]).forward(self.p, given=state[len(state) - back - 1 :])
            by = alpha[-1].copy()
            state, total = alpha[-self.pieces.longest :] / by, total + logs[0] + np.log(by)
        return total


def fit(pieces: list[bytes], counts: dict[str, dict[bytes, int]], documents: dict[str, int], rounds: int = 3, smoothing: float = 0.1) -> Model:
    """Expectation-maximisation over word counts per language.

    ``smoothing`` pseudo-counts keep every piece possible. Starts from probabilities that
    fall with a piece's length, alike for all languages.
    """
    languages = sorted(counts)
    table_ = Pieces(pieces)
    lengths = np.array([len(x) for x in pieces])
    start = np.exp(-1.0 * lengths)
    p = np.repeat((start / start.sum())[:, None], max(1, len(languages)), 1)
    place: dict[bytes, int] = {}
    told = [(k, place.setdefault(part, len(place)), n) for k, language in enumerate(languages) for word, n in counts[language].items() for part in parts(word)]
    words, weights = list(place), np.zeros((len(place), len(languages)))
    for k, i, n in told:
        weights[i, k] += n
    del place, told
    groups = list(by_size(words, LEARNED))
    for _ in range(rounds if words else 0):
        expected = np.full(p.shape, smoothing)
        for some in groups:
            # Made anew in each round: the pieces of all words at once would fill the driver's memory.
            lattice = Lattice(table_, [words[i] for i in some])
            weight = weights[np.array(some)[lattice.order]]
            alpha, _ = lattice.forward(p, scaled=False)
            beta = np.zeros_like(alpha)
            last = lattice.first + lattice.sizes
            beta[last] = weight / np.maximum(alpha[last], 1e-300)
            for depth in range(int(lattice.sizes[0]), 0, -1):
                # Within a depth no two pieces begin at one node.
                some = slice(lattice.bounds[depth], lattice.bounds[depth + 1])
                beta[lattice.source[some]] += p[lattice.piece[some]] * beta[lattice.target[some]]
            gain = alpha[lattice.source] * p[lattice.piece] * beta[lattice.target]
            for k in range(p.shape[1]):
                expected[:, k] += np.bincount(lattice.piece, gain[:, k], len(p))
        p = expected / expected.sum(0)
    total = sum(documents.values()) or 1
    prior = np.log([max(documents.get(x, 0), 1) / total for x in languages]) if languages else np.zeros(0)
    return Model(pieces, languages, p, prior)


def learn(labelled: DataFrame, per_language: int = 400, path: str = VOCABULARY) -> Model:
    """Fit on rows (text, lang); rows with null lang or text teach nothing."""
    rows = labelled.select("text", "lang").filter("lang is not null and text is not null")
    sizes = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().toLocalIterator()}
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, per_language / n))]) if sizes else F.create_map(F.lit(""), F.lit(0.0))
    sample = rows.filter(F.pmod(F.xxhash64("text"), F.lit(1_000_000)) < 1e6 * share[F.col("lang")])

    def count(batches):
        for batch in batches:
            held: dict[tuple[str, bytes], int] = {}
            texts, languages = raw_texts(batch.column("text")), batch.column("lang").to_pylist()
            for text, lang in zip(texts, languages):
                for word in text.split():
                    held[lang, word] = held.get((lang, word), 0) + 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in held], pa.string()), pa.array([k[1] for k in held], pa.binary()), pa.array(held.values(), pa.int64())], ["lang", "word", "n"])

    counted = sample.mapInArrow(count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts: dict[str, dict[bytes, int]] = {x: {} for x in sizes}
    for batch in counted.toArrow().to_batches(max_chunksize=10_000):
        for lang, word, n in zip(*(c.to_pylist() for c in batch.columns)):
            counts[lang][b" " + word] = n
    return fit(vocabulary(path), counts, sizes)


class Scorer:
    """Scores texts, remembering the log-probabilities of words by their hash."""

    def __init__(self, model: Model):
        self.model, self.known, self.logs = model, {}, [np.zeros((0, len(model.languages)))]

    def texts(self, texts: list[bytes]) -> np.ndarray:
        words = Words(texts, BLANK, None)
        distinct, where, index = np.unique(words.hashes, return_index=True, return_inverse=True)
        if len(self.known) > REMEMBERED:
            self.known, self.logs = {}, [self.logs[0][:0]]
        keys = distinct.tolist()
        new = [i for i, h in enumerate(keys) if h not in self.known]
        if new:
            base = sum(map(len, self.logs))
            self.known.update((keys[i], base + k) for k, i in enumerate(new))
            self.logs = [np.concatenate([*self.logs, self.model.log_words([b" " + words.word(i) for i in where[new].tolist()])])]
        rows = np.fromiter((self.known[h] for h in keys), np.int64, len(keys))[index]
        sums = np.zeros((len(words.hashes) + 1, len(self.model.languages)))
        np.cumsum(self.logs[0][rows], axis=0, out=sums[1:])
        return sums[words.first[1:]] - sums[words.first[:-1]]


def predicted(documents: DataFrame, model: Model) -> DataFrame:
    """The documents with ``lang_pred`` and ``score`` added (columns of these names are replaced)."""
    base = documents.drop("lang_pred", "score")
    own = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema)
    where = base.columns.index("text")

    def predict(batches):
        scorer = Scorer(model)
        for batch in batches:
            column = batch.column(where)
            letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
            names, scores = [], []
            for first, part in text_slices(column):
                if not model.languages:
                    names += [UNKNOWN] * len(part)
                    scores += [0.0] * len(part)
                    continue
                logs = scorer.texts(part) + model.prior
                best = logs.argmax(1)
                sure = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
                for i, ok in enumerate(letter[first : first + len(part)].tolist()):
                    names.append(model.languages[best[i]] if ok else UNKNOWN)
                    scores.append(float(sure[i]) if ok and math.isfinite(sure[i]) else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=pa.schema([*batch.schema, ("lang_pred", pa.string()), ("score", pa.float64())]))

    return base.mapInArrow(predict, f"{own}, lang_pred string, score double")


def held_out(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0


def query(spark, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").withColumn("held_out", F.coalesce(held_out(F.col("doc_id")), F.lit(True)))
    model = learn(documents.filter(~F.col("held_out")))
    return predicted(documents.select("doc_id", "held_out", "text"), model).select("doc_id", "held_out", "lang_pred", "score")
