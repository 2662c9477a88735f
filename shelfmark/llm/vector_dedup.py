"""Near-duplicate embeddings by a forest of random-projection trees with spill, one tree per label.

Within each label (and vector length: only vectors of one length have a cosine), a tree splits recursively at the
median of a projection; vectors near the threshold go both ways (spill), so that a close pair rarely comes apart: a
pair at cosine 0.98 differs by 0.2 at most, by about 0.025 along a random direction of 64, and the spill of 0.03 either
way is 1.2 times that whatever the length. Of some random directions, and these turned towards the rows' main axes, the
one counts that sends the fewest rows both ways. A leaf is a cell of about CELL units, all of whose pairs are compared:
a few splits in all, so that a vector is shipped about 1.2 times per doubling beyond CELL units of its label, and up
to that number the result is exact. Trees are fitted on a bounded sample (SAMPLE vectors at most) and every vector goes
down; cells that hold far more units are split on by random projections at medians over all their units, round by
round, so that cells stay bounded however many vectors there are. Products in single precision find which pairs may
link, near the bound double precision on the given vectors decides, and links are united to components.

Equal vectors of a label are one unit with a weight. A cell of more than two times its size (a large group of near
copies can't be split by any hyperplane) is dealt out as pairs of blocks, each a task of bounded memory, without a cap.
A pair that shares several cells counts in the one with the smallest number. Tasks return counts and a spanning
forest of their links, never pairs; vectors are written once, and results join by hashes of the vectors.

Cases: vectors that are null, zero or hold null, NaN or infinite components, and rows with a null
label, link with nothing; a null vec_id gives a null component; repeated rows with one vec_id are copies linked with
each other; an id with two vectors has two rows; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, give_back, put, release, whole_groups, work_dir
from .components import connected
from .vectors import matrix, sampled, unit, usable

SAMPLE = 20_000
#: Units that a cell should hold, less where vectors are long; half of the units of a block; the blocks of a cell that is split on.
CELL, CELL_FLOATS, MANY_BLOCKS = 16_384, 1 << 20, 4
#: Spill as a multiple of what a pair at the bound differs by along a random direction.
SPILL = 1.2
#: Directions that a node chooses from; rows and columns of a tile of products.
DIRECTIONS, TILE = 8, (1024, 2048)
#: Projections by which a large leaf splits at a time, and the part of a leaf that a split must not exceed.
SPLITS, LEAST_SPLIT = 3, 0.85


@dataclass
class Forest:
    """Trees as arrays: left < 0 marks a leaf, whose number is -left - 1. roots: kind -> node; a kind is a label and a length."""

    directions: list[np.ndarray] = field(default_factory=list)
    thresholds: list[float] = field(default_factory=list)
    children: list[tuple[int, int]] = field(default_factory=list)
    roots: dict[int, int] = field(default_factory=dict)
    leaves: int = 0

    def grow(self, rows: np.ndarray, rng: np.random.Generator, spill: float, leaf: int) -> int:
        node = len(self.children)
        self.children.append((0, 0))
        self.directions.append(np.zeros(rows.shape[1]))
        self.thresholds.append(0.0)
        if len(rows) > leaf:
            d = rng.standard_normal((rows.shape[1], DIRECTIONS))
            for _ in range(3):  # half of them turn towards the main axes
                d[:, ::2] = rows.T @ (rows @ d[:, ::2] - (rows @ d[:, ::2]).mean(0))
                d /= np.sqrt((d * d).sum(0))
            p = rows @ d
            t = np.median(p, axis=0)
            best = int(np.argmin((np.abs(p - t) <= spill).sum(0)))
            p, t = p[:, best], float(t[best])
            left, right = rows[p <= t + spill], rows[p >= t - spill]
            if max(len(left), len(right)) < LEAST_SPLIT * len(rows):
                self.directions[node], self.thresholds[node] = d[:, best].copy(), t
                self.children[node] = (self.grow(left, rng, spill, leaf), self.grow(right, rng, spill, leaf))
                return node
        self.leaves += 1
        self.children[node] = (-self.leaves, -self.leaves)
        return node

    def leaves_of(self, rows: np.ndarray, kind: int, spill: float) -> list[list[int]]:
        """For each row the numbers of its leaves, ascending; a kind that the sample lacks is one leaf."""
        root = self.roots.get(kind)
        if root is None:
            return [[kind | (1 << 62) if kind >= 0 else kind] for _ in rows]
        out: list[list[int]] = [[] for _ in rows]
        todo = [(root, np.arange(len(rows)))]
        while todo:
            node, at = todo.pop()
            left, right = self.children[node]
            if left < 0:
                for i in at.tolist():
                    out[i].append(-left - 1)
                continue
            p = rows[at] @ self.directions[node]
            for child, go in ((left, at[p <= self.thresholds[node] + spill]), (right, at[p >= self.thresholds[node] - spill])):
                if len(go):
                    todo.append((child, go))
        return [sorted(x) for x in out]


def spill_of(least: float, length: int) -> float:
    """How far beyond a threshold vectors go both ways; from half of the largest distance of a pair on, no pair comes apart."""
    far = float(np.sqrt(max(0.0, 2 - 2 * least)))
    return min(far / 2, SPILL * far / float(np.sqrt(length)))


def cell_of(length: int) -> int:
    return max(1024, min(CELL, CELL_FLOATS // max(1, length))) if CELL > 1024 else CELL


def fit_forest(kinds: dict[int, np.ndarray], share: float, least: float, seed: int) -> Forest:
    """Trees on sampled unit vectors by kind; share: the part of all vectors that the sample is."""
    forest = Forest()
    rng = np.random.default_rng(seed)
    for kind in sorted(kinds):
        length = kinds[kind].shape[1]
        forest.roots[kind] = forest.grow(kinds[kind], rng, spill_of(least, length), max(8, round(cell_of(length) * share)))
    return forest


def split_on(placed: DataFrame, most: int, least: float, seed: int) -> DataFrame:
    """placed (unit, v, leaves and more) with leaves of at most `most` units, but for those that no projection splits."""
    spark = placed.sparkSession
    vector = placed.schema["v"].dataType.simpleString()
    counts = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.count("*").alias("n"))
    big = put(counts.where(F.col("n") > most), work_dir(spark, "forest-big"))
    if not big.limit(1).count():
        return placed
    todo = put(placed.select("unit", "v", F.explode("leaves").alias("leaf")).join(big, "leaf"), work_dir(spark, "forest-todo"))
    done = placed.select("unit", F.explode("leaves").alias("leaf")).join(big, "leaf", "left_anti").select("unit", "leaf")
    level = 0

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            leaf = batch.column("leaf").to_numpy()
            for one in np.unique(leaf):
                part = batch.take(pa.array(np.flatnonzero(leaf == one)))
                x = unit(matrix(part.column("v")))
                d = np.random.default_rng([seed, level, int(one) & (2**63 - 1)]).standard_normal((SPLITS, x.shape[1]))
                p = x @ (d / np.sqrt((d * d).sum(1))[:, None]).T
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("unit", "leaf", "n", "v")), *(pa.array(p[:, i].copy()) for i in range(SPLITS))], ["unit", "leaf", "n", "v", *(f"p{i}" for i in range(SPLITS))])
        give_back()

    while True:
        schema = f"unit long, leaf long, n long, v {vector}, " + ", ".join(f"p{i} double" for i in range(SPLITS))
        at = put(todo.mapInArrow(project, schema), work_dir(spark, "forest-projected"))
        middle = at.groupBy("leaf").agg(*[F.percentile_approx(f"p{i}", 0.5).alias(f"t{i}") for i in range(SPLITS)])
        rows = at.join(middle, "leaf").withColumn("code", F.lit(0))
        spill = F.least(F.lit(spill_of(least, 1)), SPILL * (2 - 2 * least) ** 0.5 / F.sqrt(F.size("v")))
        for i in range(SPLITS):
            p, t = F.col(f"p{i}"), F.col(f"t{i}")
            ways = F.when(p < t - spill, F.array(F.lit(0))).when(p > t + spill, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
            rows = rows.withColumn("way", F.explode(ways)).withColumn("code", F.col("code") * 2 + F.col("way")).drop("way")
        rows = put(rows.select("unit", "v", "n", F.xxhash64("leaf", "code").alias("leaf")), work_dir(spark, "forest-split"))
        sizes = rows.groupBy("leaf").agg(F.count("*").alias("m"), F.max("n").alias("parent"))
        on = put(sizes.where((F.col("m") > most) & (F.col("m") < LEAST_SPLIT * F.col("parent"))).select("leaf", F.col("m").alias("n")), work_dir(spark, "forest-on"))
        done = done.unionByName(rows.join(on, "leaf", "left_anti").select("unit", "leaf"))
        drop(todo, at)
        if not on.limit(1).count():
            break
        todo = put(rows.drop("n").join(on, "leaf"), work_dir(spark, "forest-todo"))
        level += 1
    leaves = done.groupBy("unit").agg(F.sort_array(F.collect_set("leaf")).alias("leaves"))
    return put(placed.drop("leaves").join(leaves, "unit"), work_dir(spark, "forest-leaves"))


def shared_earlier(lists: list[np.ndarray], leaf: int) -> np.ndarray | None:
    """Rows of 0 and 1 over the leaves before this one that units are in too; None: there are none."""
    earlier = {n: i for i, n in enumerate(sorted({n for xs in lists for n in xs if n < leaf}))}
    if not earlier:
        return None
    member = np.zeros((len(lists), len(earlier)), np.float32)
    for i, xs in enumerate(lists):
        for n in xs:
            if n < leaf:
                member[i, earlier[n]] = 1
    return member


def compare(rows: np.ndarray, weight: np.ndarray, member: np.ndarray | None, one: np.ndarray, two: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the units of one and those of two (the same, or none in common) whose smallest common leaf this is: weighted counts, and for each unit the smallest that it reaches."""
    single = rows.astype(np.float32)
    doubt = (rows.shape[1] + 8) * 2.4e-7
    counts, reach = np.zeros(len(rows), np.int64), np.arange(len(rows))
    same = len(one) == len(two) and bool((one == two).all())
    for a in range(0, len(one), TILE[0]):
        x = one[a : a + TILE[0]]
        for b in range(a if same else 0, len(two), TILE[1]):
            y = two[b : b + TILE[1]]
            near = single[x] @ single[y].T
            may = near >= least - doubt
            if same:
                may &= x[:, None] < y[None, :]
            i = np.flatnonzero(may.any(1))
            if not len(i):
                continue
            j = np.flatnonzero(may[i].any(0))
            links = may[np.ix_(i, j)]
            close = np.argwhere(links & (near[np.ix_(i, j)] <= least + doubt))
            i, j = x[i], y[j]
            for at in range(0, len(close), 1 << 16):
                p, q = close[at : at + (1 << 16)].T
                links[p, q] = np.einsum("ij,ij->i", rows[i[p]], rows[j[q]]) >= least
            if member is not None:
                links &= member[i] @ member[j].T == 0
            counts[i] += links @ weight[j]
            counts[j] += weight[i] @ links
            u, v = np.nonzero(links)
            u, v = i[u], j[v]
            while len(u):
                apart = reach[u] != reach[v]
                u, v = u[apart], v[apart]
                np.minimum.at(reach, np.maximum(reach[u], reach[v]), np.minimum(reach[u], reach[v]))
                while (reach[reach] != reach).any():
                    reach = reach[reach]
    return counts, reach


def near_duplicates(vectors: DataFrame, least: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", seed: int = 11) -> DataFrame:
    """Per row: vec_id, n_links, component_id, kept."""
    spark = vectors.sparkSession
    # a unit's number, and a second hash by which rows find it again; equal vectors of a label are one unit
    numbers = [F.xxhash64(F.lit(n), "label", "v").alias(c) for n, c in ((1, "unit"), (2, "check"))]
    rows = usable(vectors, id_col, vector_col, F.col(label_col).cast("long").alias("label")).where("label is not null")
    kind = F.xxhash64("label", F.size("v")).alias("kind")
    total = rows.select(numbers[0]).agg(F.approx_count_distinct("unit")).first()[0]
    some = rows.where(sampled(numbers[0], total, SAMPLE, seed)).groupBy("label", "v").agg(F.count("*").alias("n")).select(kind, numbers[0], "v").orderBy("unit").toArrow()
    kinds = some.column("kind").to_numpy()
    fitted = {int(k): unit(matrix(some.column("v").take(pa.array(np.flatnonzero(kinds == k))))) for k in np.unique(kinds)}
    length = max((x.shape[1] for x in fitted.values()), default=1)
    forest = spark.sparkContext.broadcast(fit_forest(fitted, min(1.0, SAMPLE / max(1, total)), least, seed))
    block = 2 * cell_of(length)

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = batch.column("kind").to_numpy()
            for k in np.unique(kinds).tolist():
                part = batch.take(pa.array(np.flatnonzero(kinds == k)))
                x = unit(matrix(part.column("v")))
                leaves = forest.value.leaves_of(x, k, spill_of(least, x.shape[1]))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in ("unit", "check", "first", "weight", "v")), pa.array(leaves, pa.list_(pa.int64()))], ["unit", "check", "first", "weight", "v", "leaves"])
        give_back()

    vector = rows.schema["v"].dataType.simpleString()
    units = rows.groupBy("label", "v").agg(F.min("vec_id").alias("first"), F.count("*").alias("weight")).select(*numbers, kind, "first", "weight", "v")
    placed = put(units.mapInArrow(descend, f"unit long, check long, first long, weight long, v {vector}, leaves array<long>"), work_dir(spark, "forest-leaves"))
    release(spark, 0)
    placed = split_on(placed, MANY_BLOCKS * block, least, seed)
    sizes = placed.select(F.explode("leaves").alias("leaf")).groupBy("leaf").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    # few: each holds over a block of units
    large = sizes.where("blocks > 1")
    member = placed.select("unit", "weight", "v", F.when(F.size("leaves") > 1, F.col("leaves")).alias("leaves"), F.explode("leaves").alias("leaf"))
    blocks = member.join(F.broadcast(large), "leaf", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.pmod(F.xxhash64("unit", "leaf"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = blocks.select("unit", "weight", "v", "leaves", "leaf", "block", other.alias("other"))
    dealt = dealt.select("unit", "weight", "v", "leaves", "leaf", "block", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"))
    dealt = dealt.withColumn("task", F.xxhash64("leaf", "x", "y")).repartition("task").sortWithinPartitions("task", "leaf", "x", "y", "unit")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task", block):
            keys = np.stack([table.column(c).to_numpy() for c in ("leaf", "x", "y")], 1)
            ids, weight, at = (table.column(c).to_numpy() for c in ("unit", "weight", "block"))
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                leaf, x, y = keys[a].tolist()
                member = shared_earlier([xs or () for xs in table.column("leaves").slice(a, b - a).to_pylist()], leaf)
                v = unit(matrix(table.column("v").slice(a, b - a)))  # of one leaf, so of one length
                n, reach = compare(v, weight[a:b], member, *(np.flatnonzero(at[a:b] == k) for k in (x, y)), least)
                on = n > 0
                yield pa.RecordBatch.from_arrays([pa.array(ids[a:b][on]), pa.array(ids[a:b][reach[on]]), pa.array(n[on])], ["a", "b", "n"])

    found = put(dealt.mapInArrow(work, "a long, b long, n long"), work_dir(spark, "forest-links"))
    linked = found.groupBy("a").agg(F.sum("n").alias("n")).withColumnRenamed("a", "unit")
    first = placed.select("unit", "first")
    at = connected(found.select("a", "b")).withColumnRenamed("id", "unit")
    # components by unit number, named by their smallest vec_id
    least_id = at.join(first, "unit").groupBy("component").agg(F.min("first").alias("named"))
    at = at.join(least_id, "component").select("unit", "named")
    by_unit = placed.select("unit", "check", "first", "weight").join(linked, "unit", "left").join(at, "unit", "left").select("unit", "check", F.coalesce("named", "first").alias("component"), (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links"))
    part = put(by_unit, work_dir(spark, "forest-result"))
    drop(placed, found)
    out = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).cast("long").alias("label"), F.col(vector_col).alias("v")).select("vec_id", *numbers)
    out = out.join(part, ["unit", "check"], "left").select("vec_id", F.when(F.col("vec_id").isNotNull(), F.coalesce("n_links", F.lit(0))).otherwise(0).cast("long").alias("n_links"), F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id")).alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
