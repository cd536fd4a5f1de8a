"""Mixing sources to target weights by Pfair scheduling.

Each source's documents, in an order drawn by hash, form blocks. With weight w, block j
(from 1) of a source is released at slot floor((j - 1) / w) and due at ceil(j / w);
earliest deadline first over the released blocks then keeps every source within one
block of its target at every slot.

Weights are taken exactly, as whole numbers over their sum, and the driver schedules all
blocks one by one, so the bound holds for the given weights at any number of blocks,
however small a weight. A ``period`` asks for weights rounded to whole parts of it instead.
When a source has no blocks left the others go on with their weights scaled up, from
the next slot: a *phase*. The driver holds eight bytes a block (a quarter of a byte a
document) and sends them to the tasks; its time grows with the blocks, and with the
sources times the phases, of which there are at most as many as sources.

Ranks within a source come from small hash bins: their counts are summed up per source
and rows are ranked inside a bin, so a source with a third of all rows is spread over
as many tasks as any other. Repeats of one doc_id fall in one bin; all else is uniform.

Defined results: every row is placed once, none is dropped; a null source is a source
of its own; null doc_ids rank by their text, if there is one; repeated rows take separate places in
arbitrary order among themselves; columns other than doc_id, text and source are
carried along unless they have the name of a result, which replaces them.
"""

from __future__ import annotations

import heapq
from array import array
from dataclasses import dataclass
from fractions import Fraction
from math import lcm

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corvine.llm.common import table

#: Documents in a block.
BLOCK = 32
#: Rows that a hash bin holds on average.
BIN_ROWS = 500
#: Bins whose counts one task adds up.
GROUPED = 4096
RESULTS = ("block", "phase", "release", "deadline", "slot", "position")


def whole_parts(weights: dict, period: int) -> dict:
    """Positive whole parts of ``period``, by largest remainder, in proportion to the weights."""
    total = sum(weights.values())
    exact = {s: w / total * period for s, w in weights.items()}
    parts = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(weights, key=lambda s: (parts[s] - exact[s], str(s)))
    while (short := period - sum(parts.values())) > 0:
        for s in order[:short]:
            parts[s] += 1
    while sum(parts.values()) > period:
        parts[max(parts, key=lambda s: (parts[s] - exact[s] if parts[s] > 1 else -period, str(s)))] -= 1
    return parts


def exact_parts(weights: dict) -> dict:
    """Whole numbers in exactly the proportion of the weights."""
    exact = {s: Fraction(w) for s, w in weights.items()}
    scale = lcm(*(x.denominator for x in exact.values()))
    return {s: x.numerator * (scale // x.denominator) for s, x in exact.items()}


@dataclass(frozen=True)
class Placed:
    """Where the blocks of one source go."""

    slots: np.ndarray
    #: The phases in which the source has blocks, the first of them in each, and the source's part and the sum of all parts.
    phases: np.ndarray
    firsts: np.ndarray
    parts: list[tuple[int, int]]

    def at(self, block: np.ndarray, starts: np.ndarray) -> dict[str, np.ndarray]:
        """phase, release, deadline and slot of the blocks with these numbers from 0."""
        which = np.searchsorted(self.firsts, block, "right") - 1
        release, deadline = [], []
        for k, i in zip(which.tolist(), (block - self.firsts[which]).tolist()):
            part, total = self.parts[k]
            release.append(i * total // part)
            deadline.append(-(-(i + 1) * total // part))
        phase = self.phases[which]
        start = starts[phase]
        return {"phase": phase, "release": start + np.array(release, np.int64), "deadline": start + np.array(deadline, np.int64), "slot": self.slots[block]}


def schedule(blocks: dict, weights: dict, period: int | None = None) -> tuple[dict, np.ndarray]:
    """Every source's places for ``blocks[s]`` blocks, and the slots at which the phases start.

    By earliest deadline among released blocks; of equal deadlines the source that ``blocks`` names first.
    """
    names = [s for s in blocks if blocks[s] > 0]
    left, slots = [blocks[s] for s in names], [array("q") for _ in names]
    phases, firsts, parts = ([[] for _ in names] for _ in range(3))
    exact = list(exact_parts({s: weights[s] for s in names}).values()) if names else []
    active, starts, slot = list(range(len(names))), [], 0
    while active:
        if period:
            rounded = whole_parts({names[k]: weights[names[k]] for k in active}, period)
            part = {k: rounded[names[k]] for k in active}
        else:
            part = {k: exact[k] for k in active}
        total, start, phase = sum(part.values()), slot, len(starts)
        starts.append(start)
        done = dict.fromkeys(active, 0)
        ready = [(-(-total // part[k]), k) for k in active]
        waiting: list = []
        heapq.heapify(ready)
        while True:
            while waiting and waiting[0][0] <= slot - start:
                k = heapq.heappop(waiting)[1]
                heapq.heappush(ready, (-(-(done[k] + 1) * total // part[k]), k))
            # Parts add up to the total, so a block is always ready.
            k = heapq.heappop(ready)[1]
            if not done[k]:
                phases[k].append(phase), firsts[k].append(len(slots[k])), parts[k].append((part[k], total))
            slots[k].append(slot)
            slot += 1
            done[k] += 1
            left[k] -= 1
            if not left[k]:
                break
            heapq.heappush(waiting, (done[k] * total // part[k], k))
        active.remove(k)
    whole = [np.array(x, np.int64) for x in slots]
    return {s: Placed(whole[k], np.array(phases[k], np.int64), np.array(firsts[k], np.int64), parts[k]) for k, s in enumerate(names)}, np.array(starts, np.int64)


def tempered(counts: dict, exponent: float = 0.7) -> dict:
    """Target weights in proportion to a source's size to a power below 1, which favours small sources."""
    return {s: n**exponent for s, n in counts.items()}


def mixed(documents: DataFrame, weights: dict | None = None, block: int = BLOCK, period: int | None = None) -> DataFrame:
    """The documents with block, phase, release, deadline, slot and position.

    ``position`` orders the mix; release and deadline are slots of the block's phase.
    ``weights`` maps every source to a positive number; by default ``tempered`` sizes.
    ``period`` rounds the weights to whole parts of that many slots; no more sources than that are taken then.
    """
    key = F.col("source")
    counts = {r["source"]: r["count"] for r in documents.groupBy("source").count().collect()}
    if period and len(counts) > period:
        raise ValueError(f"more than {period} sources")
    weights = tempered(counts) if weights is None else weights
    if absent := [s for s in counts if not weights.get(s, 0) > 0]:
        raise ValueError(f"no positive weight for {absent}")
    plan, starts = schedule({s: -(-n // block) for s, n in counts.items()}, weights, period)

    bins = max(1, -(-sum(counts.values()) // BIN_ROWS))
    kept = documents.drop(*RESULTS)
    drawn = kept.withColumn("__draw", F.xxhash64(F.coalesce(*[F.col(c).cast("string") for c in ("doc_id", "text") if c in kept.columns], F.lit(""))))
    drawn = drawn.withColumn("__bin", F.pmod(F.shiftrightunsigned("__draw", 20), F.lit(bins)))
    # Running sums in two levels, so that no task orders all bins of a source.
    sizes = drawn.groupBy(key.alias("__source"), F.col("__bin").alias("__bin2")).count().withColumn("__group", F.expr(f"__bin2 DIV {GROUPED}"))
    groups = sizes.groupBy("__source", "__group").agg(F.sum("count").alias("__n"))
    groups = groups.withColumn("__start", F.coalesce(F.sum("__n").over(W.partitionBy("__source").orderBy("__group").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).select(F.col("__source").alias("__source2"), F.col("__group").alias("__group2"), "__start")
    within = F.coalesce(F.sum("count").over(W.partitionBy("__source", "__group").orderBy("__bin2").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    before = (
        sizes.withColumn("__within", within)
        .join(groups, F.col("__source").eqNullSafe(F.col("__source2")) & (F.col("__group") == F.col("__group2")))
        .select("__source", "__bin2", (F.col("__start") + F.col("__within")).alias("__before"))
    )
    inside = drawn.withColumn("__in", F.row_number().over(W.partitionBy("source", "__bin").orderBy("__draw", "doc_id")) - 1)
    ranked = inside.join(before, key.eqNullSafe(F.col("__source")) & (F.col("__bin") == F.col("__bin2")))
    rank = F.col("__before") + F.col("__in")

    @F.pandas_udf("block long, phase long, release long, deadline long, slot long")
    def place(source: pd.Series, number: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"block": number.to_numpy(np.int64)})
        for name in ("phase", "release", "deadline", "slot"):
            out[name] = np.int64(0)
        for s, rows in out.groupby(source.to_numpy(), dropna=False).indices.items():
            s = None if s is None or s != s else s
            blocks, which = np.unique(out["block"].to_numpy()[rows], return_inverse=True)
            for name, values in plan[s].at(blocks, starts).items():
                out.loc[rows, name] = values[which]
        return out

    placed = ranked.withColumn("__rank", rank).withColumn("__at", place(key, F.floor(F.col("__rank") / block)))
    return placed.select(*[F.col(f"`{c}`") for c in kept.columns], "__at.*", (F.col("__at.slot") * block + F.pmod("__rank", F.lit(block))).alias("position"))


def query(spark, sf_dir: str) -> DataFrame:
    # A null doc_id is drawn by its text, so that many of them do not meet in one bin.
    drawn_by = F.when(F.col("doc_id").isNull(), F.xxhash64("text").cast("string")).alias("text")
    return mixed(table(spark, sf_dir, "documents").select("doc_id", "source", drawn_by)).select("doc_id", "source", *RESULTS)
