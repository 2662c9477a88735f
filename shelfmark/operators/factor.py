"""Matrix factors: UV decomposition by coordinate sweeps as joins and aggregates, and PCA."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.registry import query
from ..plans.stages import materialize
from ..sources.tables import ratings, table
from .cf import _U, PRIME, STEP, narrowed, normalized, pack, scrambled, unpack, utility

_INIT = "sqrt((SELECT avg(rating) FROM u) / {d})"


#: Half the width of the factors of random starts, as a part of the fixed start's.
SPREAD = 0.5


def start(u: DataFrame, d: int, column: str, runs: int = 1, ones: bool = False) -> DataFrame:
    """run, id, f: d latent values. Run 0 starts from sqrt(mean / d) everywhere (ones: from 1); further runs move each value at random, by a hash of run, id and place."""
    mean = u.agg(F.avg("rating").alias("m"))
    value = F.lit(1.0) if ones else F.sqrt(F.col("m") / d)
    rows = u.select(F.col(column).alias("id")).distinct().join(F.broadcast(mean)).select(F.explode(F.sequence(F.lit(0), F.lit(runs - 1))).alias("run"), "id", value.alias("value"))
    move = [F.when(F.col("run") > 0, (scrambled(F.col("run"), F.col("id"), F.lit(s)) / PRIME * 2 - 1) * SPREAD).otherwise(0.0) + 1.0 for s in range(d)]
    return rows.select("run", "id", F.array(*[F.col("value") * m for m in move]).alias("f"))


def _both(cells: DataFrame, mine: DataFrame, other: DataFrame) -> DataFrame:
    """Cells with the factors a and b of each run. All runs of an id travel as one map, and the join by id comes last: an aggregate by run and id has its rows in place."""

    def packed(t: DataFrame, key: str, name: str) -> DataFrame:
        return t.groupBy(F.col("id").alias(key)).agg(F.map_from_entries(F.collect_list(F.struct("run", "f"))).alias(name))

    met = cells.join(packed(other, "other", "of"), "other").join(packed(mine, "id", "mine"), "id")
    runs = met.select("id", "other", "rating", "of", F.explode("mine").alias("run", "a"))
    return runs.select("run", "id", "other", "rating", "a", F.try_element_at("of", F.col("run")).alias("b")).where("b is not null")


def _dot() -> Column:
    return F.aggregate(F.zip_with("a", "b", lambda p, q: p * q), F.lit(0.0), lambda t, v: t + v)


def update(cells: DataFrame, mine: DataFrame, other: DataFrame, s: int) -> DataFrame:
    """Least squares for latent value s (from 0) of every row and run: cells (id, other, rating)."""
    x = _both(cells, mine, other)
    rest = F.col("rating") - _dot() + F.element_at("a", s + 1) * F.element_at("b", s + 1)
    new = x.groupBy("run", "id").agg(F.sum(rest * F.element_at("b", s + 1)).alias("num"), F.sum(F.element_at("b", s + 1) * F.element_at("b", s + 1)).alias("den"))
    value = F.coalesce(F.try_divide(F.col("num"), F.col("den")), F.lit(0.0))
    return mine.join(new, ["run", "id"]).select("run", "id", F.transform("f", lambda v, i: F.when(i == s, value).otherwise(v)).alias("f"))


def views(u: DataFrame) -> tuple[DataFrame, DataFrame]:
    rows = u.select(F.col("item_id").alias("id"), F.col("user_id").alias("other"), "rating")
    return rows, rows.select(F.col("other").alias("id"), F.col("id").alias("other"), "rating")


#: Far beyond what the rule takes; every sweep of the loop gains least_gain at least.
MOST_SWEEPS = 1000
#: Cells of a block, and the least that are worth a task; bytes of factors sent in a batch.
BLOCK_CELLS, FEW_CELLS, SEND_BYTES = 1 << 20, 1 << 14, 1 << 24

BLOCKS = "block int, cells binary, links binary, factors binary"
STATE = "block int, errors array<double>, links binary, factors binary"


def started(ids: np.ndarray, value: float, d: int, runs: int) -> np.ndarray:
    """What start() gives: ids x runs x d."""
    out = np.full((len(ids), runs, d), value)
    for run in range(1, runs):
        for s in range(d):
            h = np.ones(len(ids), np.int64)
            for x in (run, ids, s):
                h = np.fmod(np.fmod(np.fmod(h + x, PRIME) * STEP, PRIME) * STEP, PRIME)
            out[:, run, s] = value * ((h / PRIME * 2 - 1) * SPREAD + 1.0)
    return out


def _dealt(cuts: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = np.searchsorted(cuts, batch.column("id").to_numpy(), side="right").astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(block), *batch.columns], ["block", *batch.schema.names])

    return run


def _built(others: np.ndarray, value: float, d: int, runs: int):
    """The block of a task's cells. cells: ratings by id, each with the place of its other id among the block's; links: ids, and which of them each block of the other side needs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        ids, other = (np.concatenate([b.column(c).to_numpy() for b in held]) for c in ("id", "other"))
        null = np.concatenate([b.column("rating").is_null().to_numpy(zero_copy_only=False) for b in held])
        rating = np.concatenate([pc.fill_null(b.column("rating"), 0.0).to_numpy() for b in held])
        order = np.lexsort((other, ids))
        ids, other, rating, null = ids[order], other[order], rating[order], null[order]
        ids, row, lengths = np.unique(ids, return_inverse=True, return_counts=True)
        known, place = np.unique(other, return_inverse=True)
        need = np.unique(np.searchsorted(others, other, side="right") * len(ids) + row)
        blocks, counts = np.unique(need // len(ids), return_counts=True)
        cells = pack([narrowed(lengths), narrowed(place), narrowed(rating), null if null.any() else null[:0]])
        links = pack([narrowed(np.diff(ids, prepend=0)), blocks, counts, narrowed(np.diff(need % len(ids), prepend=0))])
        block = held[0].column("block")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), *(pa.array([x], pa.binary()) for x in (cells, links, started(ids, value, d, runs).tobytes()))], [c.split()[0] for c in BLOCKS.split(", ")])

    return run


def _read(factors: bytes, d: int, runs: int, keep: list[int]) -> np.ndarray:
    return np.frombuffer(factors).reshape(-1, runs, d)[:, keep]


PARCELS = "block int, kind int, source int, data binary"


def _sent(d: int, runs: int, keep: list[int]):
    """From states, to each block of the other side the factors that it needs, in order of ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for batch in batches:
            for source, links, factors in zip(batch.column("block").to_pylist(), batch.column("links"), batch.column("factors"), strict=True):
                _, blocks, counts, at = unpack(links.as_py())
                at, f = np.cumsum(at.astype(np.int64)), _read(factors.as_py(), d, runs, keep)
                ends = np.cumsum(counts)
                for block, a, b in zip(blocks.tolist(), (ends - counts).tolist(), ends.tolist(), strict=True):
                    out.append((block, 3, source, f[at[a:b]].tobytes()))
                    size += len(out[-1][3])
                    if size >= SEND_BYTES:
                        yield parcels(out)
                        out, size = [], 0
        if out:
            yield parcels(out)

    def parcels(out: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == 3 else pa.int32()) for k, c in enumerate(zip(*out, strict=True))], [c.split()[0] for c in PARCELS.split(", ")])

    return run


def _solved(cells: bytes, mine: np.ndarray, other: np.ndarray, change: bool) -> tuple[list[float], np.ndarray]:
    """Least squares for one latent value after the other of each id and run, other side fixed (change), and the squared errors of runs then. A cell without a rating counts for the squares alone."""
    lengths, place, rating, null = unpack(cells)
    lengths, place, rating = lengths.astype(np.int64), place.astype(np.int64), rating.astype(np.float64)
    begin, on = np.cumsum(lengths) - lengths, ~null if len(null) else None
    mine, errors = mine.copy(), []
    for run in range(mine.shape[1]):
        b = [np.ascontiguousarray(other[:, run, s])[place] for s in range(mine.shape[2])]
        rated = b if on is None else [x * on for x in b]
        for s in range(len(b)) if change else ():
            num = np.add.reduceat(rating * rated[s], begin)
            for t in range(len(b)):
                if t != s:
                    num -= np.add.reduceat(rated[s] * b[t], begin) * mine[:, run, t]
            den = np.add.reduceat(b[s] * b[s], begin)
            mine[:, run, s] = np.divide(num, den, out=np.zeros_like(num), where=den != 0)
        gap = rating.copy()
        for s, x in enumerate(rated):
            gap -= np.repeat(mine[:, run, s], lengths) * x
        errors.append(float(gap @ gap))
    return errors, mine


def _stepped(d: int, runs: int, keep: list[int], change: bool):
    """From cells (kind 0), links (1), factors (2) and what the other side sent (3), sorted by block, kind and source, each block's new state."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, got = None, []
        for batch in batches:
            for block, kind, data in zip(batch.column("block").to_pylist(), batch.column("kind").to_pylist(), batch.column("data"), strict=True):
                if block != last and got:
                    yield state(last, got)
                    got = []
                last = block
                got.append((kind, data.as_py()))
        if got:
            yield state(last, got)

    def state(block: int, got: list[tuple[int, bytes]]) -> pa.RecordBatch:
        (_, cells), (_, links), (_, factors), *sent = got
        other = np.concatenate([np.frombuffer(x).reshape(-1, len(keep), d) for _, x in sent])
        errors, new = _solved(cells, _read(factors, d, runs, keep), other, change)
        return pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([errors], pa.list_(pa.float64())), pa.array([links], pa.binary()), pa.array([new.tobytes()], pa.binary())], [c.split()[0] for c in STATE.split(", ")])

    return run


def _unrolled(d: int, runs: int, run_: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for links, factors in zip(batch.column("links"), batch.column("factors"), strict=True):
                ids, f = np.cumsum(unpack(links.as_py())[0].astype(np.int64)), _read(factors.as_py(), d, runs, [run_])
                for a in range(0, len(ids), 65_536):
                    part = f[a : a + 65_536].reshape(-1)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 65_536]), pa.ListArray.from_arrays(np.arange(0, len(part) + 1, d, dtype=np.int32), pa.array(part))], ["id", "f"])

    return run


class Side:
    """One side's cells in blocks of neighbouring ids, each of bounded size but for an id of more ratings: a task solves a block with what the other side's blocks send it."""

    def __init__(self, cells: DataFrame, cuts: np.ndarray, others: np.ndarray, value: float, d: int, runs: int) -> None:
        self.count, self.d = len(cuts) + 1, d
        dealt = cells.mapInArrow(_dealt(cuts), "block int, id long, other long, rating double").repartitionById(self.count, F.col("block"))
        self.blocks = materialize(dealt.mapInArrow(_built(others, value, d, runs), BLOCKS), "uv-blocks")

    def step(self, own: DataFrame, other: DataFrame, own_runs: tuple[int, list[int]], other_runs: tuple[int, list[int]], change: bool = True) -> DataFrame:
        """The state after this side is solved. own_runs, other_runs: how many runs the states have, and places of those that go on."""
        none = F.lit(0).alias("source")
        parts = [table.select("block", F.lit(kind).alias("kind"), none, F.col(c).alias("data")) for kind, (table, c) in enumerate(((self.blocks, "cells"), (own, "links"), (own, "factors")))]
        sent = other.select("block", "links", "factors").mapInArrow(_sent(self.d, *other_runs), PARCELS)
        met = parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(sent).repartitionById(self.count, F.col("block")).sortWithinPartitions("block", "kind", "source")
        return materialize(met.mapInArrow(_stepped(self.d, *own_runs, change), STATE), "uv-state")


def _errors(state: DataFrame, runs: list[int], n: int) -> dict[int, float]:
    """The error over rated cells of each run, of the state after a step."""
    rows = sorted((r["block"], r["errors"]) for r in state.select("block", "errors").collect())
    total = np.sum([e for _, e in rows], 0)
    return {r: float(np.sqrt(x / n)) if n else float("nan") for r, x in zip(runs, total, strict=True)}


def fit(u: DataFrame, d: int = 2, sweeps: int | None = None, least_gain: float = 0.005, restarts: int = 0) -> tuple[DataFrame, DataFrame, float]:
    """Full sweeps until the error falls by less than least_gain, or as many as given; factors are stage tables after each half of a sweep.

    restarts: so many further runs from random starts, swept in the same jobs; the run with the least error is returned
    (ties: the first). A run that has met the rule is left as it is.

    A half of a sweep fixes one side, so all latent values of an id follow from sums over its cells: one exchange takes
    the fixed side's factors to the blocks that need them, each once, and the error comes with the second half.
    """
    cells = materialize(u.select(F.col("item_id").cast("long").alias("item_id"), F.col("user_id").cast("long").alias("user_id"), F.col("rating").cast("double").alias("rating")), "uv-cells")
    mean = cells.agg(F.avg("rating")).first()[0]
    cells = cells.where("item_id is not null and user_id is not null")
    size, n = cells.agg(F.count("*"), F.count("rating")).first()
    if not size:
        none = u.sparkSession.createDataFrame([], "id long, f array<double>")
        return none, none, 0.0
    count = math.ceil(size / max(FEW_CELLS, min(BLOCK_CELLS, size // u.sparkSession.sparkContext.defaultParallelism)))
    at = [k / count for k in range(1, count)]
    found = cells.agg(*(F.percentile_approx(c, at, 100 * count) for c in ("item_id", "user_id"))).first() if at else ([], [])
    cuts = [np.unique(np.array(x, np.int64)) for x in found]
    value = float("nan") if mean is None or mean < 0 else math.sqrt(mean / d)
    rows, columns = (Side(x, cuts[k], cuts[1 - k], value, d, 1 + restarts) for k, x in enumerate(views(cells)))
    a, b = (side.blocks for side in (rows, columns))
    runs = list(range(1 + restarts))
    now = (len(runs), list(runs))
    error = _errors(columns.step(b, a, now, now, change=False), runs, n)
    best, left = (float("inf"), 0, 0, 0, a, b), set(runs)
    for _ in range(MOST_SWEEPS if sweeps is None else sweeps):
        a = rows.step(a, b, now, now)
        b = columns.step(b, a, now, (len(runs), list(range(len(runs)))))
        new = _errors(b, runs, n)
        if not np.isfinite(list(new.values())).all():
            raise ValueError(f"the error of the factors is {new}")
        ended = {r for r in runs if error[r] - new[r] < least_gain}
        best = min([best, *((new[r], r, len(runs), runs.index(r), a, b) for r in sorted(ended))], key=lambda x: x[:2])
        left, error = set(runs) - ended, new
        if not left:
            break
        now = (len(runs), [k for k, r in enumerate(runs) if r in left])
        runs = sorted(left)
    else:
        if sweeps is None:
            raise RuntimeError(f"no end after {MOST_SWEEPS} sweeps: the error is {error}")
        best = min([best, *((error[r], r, now[0], k, a, b) for k, r in zip(now[1], runs, strict=True))], key=lambda x: x[:2])
    least, _, held, k, a, b = best
    return *(x.select("links", "factors").mapInArrow(_unrolled(d, held, k), "id long, f array<double>") for x in (a, b)), least


@query("uv_init", f"WITH {_U} SELECT DISTINCT 'item' AS side, item_id AS id, round({_INIT.format(d=2)}, 6) AS f1, round({_INIT.format(d=2)}, 6) AS f2 FROM u UNION ALL SELECT DISTINCT 'user', user_id, round({_INIT.format(d=2)}, 6), round({_INIT.format(d=2)}, 6) FROM u")
def uv_init(spark, sf):
    u = utility(ratings(spark, sf))
    parts = [start(u, 2, c).select(F.lit(n).alias("side"), "id", F.round(F.element_at("f", 1), 6).alias("f1"), F.round(F.element_at("f", 2), 6).alias("f2")) for n, c in (("item", "item_id"), ("user", "user_id"))]
    return parts[0].unionByName(parts[1])


_SWEEP = f"""{_U}, c AS (SELECT sqrt(avg(rating)) AS c FROM u),
a AS (SELECT item_id, sum(rating * c) / sum(c * c) AS f FROM u, c GROUP BY 1), b AS (SELECT user_id, sum(rating * f) / sum(f * f) AS f FROM u JOIN a USING (item_id) GROUP BY 1)"""


def one_sweep(u: DataFrame, cells: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """cells: other values of u's cells to fit. An item's factor that is 0 but for the last bits of a sum is 0, so that no user's factor is divided by it."""
    rows, columns = views(u if cells is None else cells)
    a = update(rows, start(u, 1, "item_id"), start(u, 1, "user_id"), 0)
    a = a.select("run", "id", F.transform("f", lambda v: F.when(F.abs(v) < 1e-9, 0.0).otherwise(v)).alias("f"))
    return a, update(columns, start(u, 1, "user_id"), a, 0)


@query("uv_one_sweep", f"WITH {_SWEEP} SELECT 'item' AS side, item_id AS id, round(f, 5) AS f FROM a UNION ALL SELECT 'user', user_id, round(f, 5) FROM b")
def uv_one_sweep(spark, sf):
    a, b = one_sweep(utility(ratings(spark, sf)))
    parts = [x.select(F.lit(n).alias("side"), "id", F.round(F.element_at("f", 1), 5).alias("f")) for n, x in (("item", a), ("user", b))]
    return parts[0].unionByName(parts[1])


def centred(u: DataFrame) -> DataFrame:
    """Ratings less the item's mean, then less the user's mean of what is left; with item_mean and user_mean."""
    mean = F.avg("rating").over(Window.partitionBy("user_id"))
    return normalized(u).select("item_id", "user_id", (F.col("rating") - mean).alias("rating"), "item_mean", mean.alias("user_mean"))


_CENTRED = f"""{_U}, c AS (SELECT sqrt(avg(rating)) AS c FROM u), ci AS (SELECT *, avg(rating) OVER (PARTITION BY item_id) AS item_mean FROM u),
cu AS (SELECT item_id, user_id, item_mean, avg(rating - item_mean) OVER (PARTITION BY user_id) AS user_mean, rating - item_mean - avg(rating - item_mean) OVER (PARTITION BY user_id) AS rating FROM ci),
a AS (SELECT item_id, CASE WHEN abs(f) < 1e-9 THEN 0 ELSE f END AS f FROM (SELECT item_id, sum(rating * c) / sum(c * c) AS f FROM cu, c GROUP BY 1)), b AS (SELECT user_id, coalesce(sum(rating * f) / nullif(sum(f * f), 0), 0) AS f FROM cu JOIN a USING (item_id) GROUP BY 1)"""


@query("uv_reconstruct", f"WITH {_CENTRED} SELECT item_id, user_id, round(least(9, greatest(0, a.f * b.f + user_mean + item_mean)) + 1e-9, 4) AS pred FROM cu JOIN a USING (item_id) JOIN b USING (user_id)")
def uv_reconstruct(spark, sf):
    """Products of the factors of centred ratings at rated cells, with both means added back, clipped to 0..9."""
    u = utility(ratings(spark, sf))
    c = centred(u)
    a, b = one_sweep(u, c)
    x = c.join(a.select(F.col("id").alias("item_id"), F.element_at("f", 1).alias("x")), "item_id").join(b.select(F.col("id").alias("user_id"), F.element_at("f", 1).alias("y")), "user_id")
    pred = F.col("x") * F.col("y") + F.col("user_mean") + F.col("item_mean")
    return x.select("item_id", "user_id", F.round(F.least(F.lit(9.0), F.greatest(F.lit(0.0), pred)) + 1e-9, 4).alias("pred"))


@query("uv_fit")
def uv_fit(spark, sf):
    """The best of the fixed start and four random ones."""
    a, b, error = fit(utility(ratings(spark, sf)), restarts=4)
    both = a.select(F.lit("item").alias("side"), "id", "f").unionByName(b.select(F.lit("user").alias("side"), "id", "f"))
    return both.select("side", "id", F.element_at("f", 1).alias("f1"), F.element_at("f", 2).alias("f2"), F.lit(error).alias("rmse"))


_ENTRY = "e AS (SELECT vec_id, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS i FROM embeddings)"


def covariance(spark: SparkSession, sf: str) -> DataFrame:
    """i <= j, cov (sample) of vector components; partial sums per task, d * (d + 1) / 2 groups at the end."""
    v = table(spark, sf, "embeddings").select(F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    pair = v.select("v", F.posexplode("v").alias("i", "x")).select("i", "x", F.posexplode(F.slice("v", F.col("i") + 1, F.size("v") - F.col("i"))).alias("k", "y"))
    return pair.groupBy((F.col("i") + 1).cast("long").alias("i"), (F.col("i") + F.col("k") + 1).cast("long").alias("j")).agg(F.covar_samp("x", "y").alias("cov"))


@query("pca_covariance", f"WITH {_ENTRY} SELECT a.i, b.i AS j, round(covar_samp(a.x, b.x), 6) + 0 AS cov FROM e a JOIN e b ON a.vec_id = b.vec_id AND a.i <= b.i GROUP BY 1, 2")
def pca_covariance(spark, sf):
    return covariance(spark, sf).select("i", "j", (F.round("cov", 6) + 0.0).alias("cov"))


@query("pca_project")
def pca_project(spark, sf, least: float = 0.015):
    """Raw vectors on the components whose eigenvalue reaches least; the d x d eigenproblem is solved on the driver."""
    c = covariance(spark, sf).toPandas()
    d = int(c["j"].max()) if len(c) else 0
    m = np.zeros((d, d))
    m[c["i"] - 1, c["j"] - 1] = m[c["j"] - 1, c["i"] - 1] = c["cov"]
    value, vector = np.linalg.eigh(m)
    keep = vector[:, value >= least].T[::-1]
    dots = [F.aggregate(F.zip_with("embedding", F.array(*[F.lit(float(w)) for w in row]), lambda x, w: x * w), F.lit(0.0), lambda t, x: t + x) for row in keep]
    return table(spark, sf, "embeddings").select("vec_id", F.array(*dots).alias("projected"))
