"""Mixing sources to target weights by balanced (cube-method) sampling.

Each source gets a target size by water-filling. A document of a source with target / size = c + p (c whole,
0 <= p < 1) is taken c times for certain and once more with inclusion probability p. Which documents get that
extra copy is decided by the cube method: the flight phase moves the vector of probabilities through the null
space of two constraints, the sum of sizes and the number of documents of the source, until all but at most two
probabilities are 0 or 1, so both totals stay exact; the landing phase settles those two.

At scale the flight runs in groups of bounded size of one source (a fast flight on three units at a time); the at
most two units that a group leaves open go on to the next level, whose groups are again of bounded size, until one
group per source is left, which lands. Levels shrink by the group size, so a few suffice for any input, and a
source with a third of all rows is only more groups.

All random choices come from hashes of doc_id and size under a seed: reruns agree, whatever the partitioning.

Cases: a null text has size 0; a document of size 0 is balanced in number and takes 0 words; a null source is the
last source of its own; repeated rows (one doc_id and size in a source; null ids of one size) are units of their own,
told apart by a number, so that any count of them is dealt out to many groups; a very long text is a unit like any
other; rows with a null doc_id take part; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, put, text_of, whole_groups, work_dir

EPS = 1e-9


def measure(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words of the whole text; null: 0)."""
    return docs.select("doc_id", "source", F.regexp_count(text_of(), F.lit(WORD)).cast("long").alias("size"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0) -> DataFrame:
    """source, source_size, n_docs, target.

    Sources by code point, null last, weigh as given, repeating; targets stop at most times the source's size and
    the excess is shared again by weight among the others until none is above. One small aggregate per round.
    """
    spark = sizes.sparkSession
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    # one row per source
    place = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1
    by = by.select("*", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), place.cast("int")).alias("weight"), (F.col("source_size") * float(most)).alias("most"))
    by = put(by.select("*", F.lit(False).alias("full")), work_dir(spark, "mix-sources"))
    while True:
        free = F.when(~F.col("full"), F.col("weight"))
        total, used, weight = by.agg(F.sum("source_size"), F.sum(F.when(F.col("full"), F.col("most"))), F.sum(free)).first()
        level = ((total or 0) - (used or 0)) / weight if weight else 0.0
        over = ~F.col("full") & (F.col("weight") * level > F.col("most"))
        if not weight or not by.where(over).limit(1).count():
            return by.select("source", "source_size", "n_docs", F.when(F.col("full"), F.col("most")).otherwise(F.col("weight") * level).alias("target"))
        by = put(by.withColumn("full", F.col("full") | over), work_dir(spark, "mix-sources"))


def flight(size: np.ndarray, p: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """Moves probabilities p through the null space of (size, 1); at most two stay fractional.

    rest: uniform numbers, one per unit, that choose the direction of each move. Units enter one by one: of three
    open ones, a move along the null vector brings one or more to 0 or 1 and keeps both totals.
    """
    p = p.copy()
    live: list[int] = []
    for i in np.flatnonzero((p > EPS) & (p < 1 - EPS)).tolist():
        live.append(i)
        while len(live) == 3:
            a, b, c = live
            sa, sb, sc = size[a], size[b], size[c]
            if sa == sb == sc:
                u = (1.0, -1.0, 0.0)
            else:
                u = (sb - sc, sc - sa, sa - sb)
            up = down = np.inf
            for k, x in zip(live, u, strict=True):
                if x > 0:
                    up, down = min(up, (1 - p[k]) / x), min(down, p[k] / x)
                elif x < 0:
                    up, down = min(up, p[k] / -x), min(down, (1 - p[k]) / -x)
            # each way as likely as keeps the expectation
            step = up if rest[i] * (up + down) < down else -down
            for k, x in zip(live, u, strict=True):
                v = p[k] + step * x
                p[k] = 0.0 if v < EPS else 1.0 if v > 1 - EPS else v
            live = [k for k in live if 0 < p[k] < 1]
    return p


def landing(size: np.ndarray, p: np.ndarray, was: np.ndarray, flips: int = 4) -> np.ndarray:
    """Settles at most two open units, then repairs the total.

    Of the outcomes, the one whose sizes (then number) come nearest to the expected. A long document may leave a
    gap; at most a few units that were open before the flight (was) are flipped, each time the one that brings the
    total nearest, while that helps; then as many pairs, one in and one out, which keeps the number.
    """
    p = p.copy()
    open_ = np.flatnonzero((p > EPS) & (p < 1 - EPS))
    want, number = float((size[open_] * p[open_]).sum()), float(p[open_].sum())
    best = min(range(2 ** len(open_)), key=lambda m: (abs(sum(size[k] for j, k in enumerate(open_) if m >> j & 1) - want), abs(bin(m).count("1") - number), m))
    for j, k in enumerate(open_):
        p[k] = best >> j & 1
    p = np.round(p)
    gap = float(size[open_] @ p[open_]) - want
    free = np.flatnonzero((was > EPS) & (was < 1 - EPS))
    for _ in range(flips if len(free) else 0):
        after = np.abs(gap + np.where(p[free] > 0, -size[free], size[free]))
        k = int(after.argmin())
        if after[k] >= abs(gap):
            break
        gap += -size[free[k]] if p[free[k]] > 0 else size[free[k]]
        p[free[k]] = 1 - p[free[k]]
    for _ in range(flips):
        inside, outside = free[p[free] > 0], free[p[free] == 0]
        if not len(inside) or not len(outside):
            break
        order = outside[np.argsort(size[outside], kind="stable")]
        want = size[inside] - gap  # of what comes in for each that goes out
        at = np.searchsorted(size[order], want)
        near = np.stack([order[np.clip(at - 1, 0, len(order) - 1)], order[np.clip(at, 0, len(order) - 1)]])
        left = np.abs(size[near] - want)
        row, k = np.unravel_index(left.argmin(), left.shape)
        if left[row, k] >= abs(gap):
            break
        gap += size[near[row, k]] - size[inside[k]]
        p[inside[k]], p[near[row, k]] = 0.0, 1.0
    return p


def _level(units: DataFrame, last: bool, group: int, level: int, seed: int) -> DataFrame:
    """One level: units (doc_id, source_no, size, whole, p, salt) in groups of one source; p comes out settled or, for two a group, open."""
    spread = F.greatest(F.lit(1), F.ceil(F.col("n_open") / group)).cast("long")
    keyed = units.select("doc_id", "source_no", "size", "whole", "p", "tie", F.col("source_no").alias("g0"), F.pmod(F.xxhash64("doc_id", "size", "tie", F.lit(seed + level)), spread).alias("g1"))
    keyed = keyed.withColumn("g", F.xxhash64("g0", "g1")).withColumn("u", F.xxhash64("doc_id", "size", "tie", F.lit(seed)).alias("u"))
    sorted_ = keyed.repartition("g").sortWithinPartitions("g", "g0", "g1", "u", "doc_id", "size", "tie")

    def move(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "g", 2 * group):
            g0, g1 = (table.column(x).to_numpy() for x in ("g0", "g1"))
            size, p = table.column("size").to_numpy().astype(float), table.column("p").to_numpy().copy()
            rest = (table.column("u").to_numpy().astype(np.uint64) >> np.uint64(11)).astype(float) / 2**53
            cuts = [0, *(np.flatnonzero((g0[1:] != g0[:-1]) | (g1[1:] != g1[:-1])) + 1).tolist(), len(g0)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a < b:
                    moved = flight(size[a:b], p[a:b], rest[a:b])
                    p[a:b] = landing(size[a:b], moved, p[a:b]) if last else moved
            yield from table.drop_columns(["p", "g", "g0", "g1", "u"]).append_column("p", pa.array(p, pa.float64())).combine_chunks().to_batches()

    return sorted_.mapInArrow(move, "doc_id long, source_no long, size long, whole long, tie long, p double")


def mix(docs: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, group: int = 2048, seed: int = 20_240) -> DataFrame:
    """Per row of docs: doc_id, size, source_size, target (of its source), taken (words the mix takes, copies counted), copies."""
    spark = docs.sparkSession
    sized = put(measure(docs), work_dir(spark, "mix-sizes"))
    by = put(targets(sized, weights, most).withColumn("source_no", F.xxhash64("source", F.col("source").isNull())), work_dir(spark, "mix-targets"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    # the source's row is one of few: the join moves no documents where Spark may broadcast it, else it splits hot sources
    joined = sized.join(by, sized["source"].eqNullSafe(by["source"])).select("doc_id", "source_no", "size", F.least(F.floor(ratio), F.lit(int(most))).cast("long").alias("whole"), ratio.alias("ratio"), "n_docs")
    # repeated rows are counted before the shuffle and told apart by a number, in two steps that keep the arrays short
    part = F.when(F.col("whole") < most, F.col("ratio") - F.col("whole")).otherwise(0.0)
    counted = joined.groupBy("doc_id", "source_no", "size", "whole", part.alias("p"), F.col("n_docs").alias("n_open")).agg(F.count("*").alias("rows"))
    step = 1 << 12
    units = counted.withColumn("from", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / step)))).withColumn("tie", F.explode(F.sequence(F.col("from") * step, F.least((F.col("from") + 1) * step, "rows") - 1)))
    units = units.select("doc_id", "source_no", "size", "whole", "p", "n_open", "tie")
    done: list[DataFrame] = []
    level = 0
    while True:
        last = not units.where(F.col("n_open") > group).limit(1).count()
        at = put(_level(units, last, group, level, seed), work_dir(spark, f"mix-level{level}"))
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        if last:
            done.append(at)
            break
        done.append(at.where(~open_))
        left = at.where(open_)
        counts = left.groupBy("source_no").agg(F.count("*").alias("n_open"))
        units = left.join(counts, "source_no").select("doc_id", "source_no", "size", "whole", "p", "n_open", "tie")
        level += 1
    settled = done[0]
    for x in done[1:]:
        settled = settled.unionByName(x)
    settled = settled.withColumn("copies", F.col("whole") + F.round("p").cast("long"))
    return settled.join(by.select("source_no", "source_size", "target"), "source_no").select(
        "doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")
