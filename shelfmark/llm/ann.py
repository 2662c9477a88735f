"""Approximate nearest neighbours by balanced posting lists.

Equal vectors are one unit that carries its k + 1 smallest ids: more of a unit can't be among the k nearest of any
query, so a large group of copies is one posted row, and equal queries are asked once. Centroids are the means of a
balanced tree of 2-means splits of a bounded sample (SAMPLE vectors at most, CENTROIDS lists at most); every unit is
posted to its nearest centroid and, near a boundary, to further ones whose distance is within a ratio of the nearest
(REPLICAS at most). A query searches an in-memory graph of the centroids best first and selects the lists whose
distance is within a ratio of the nearest found, going on until these hold enough units for k others. Lists and the
queries of a list are dealt out in blocks of bounded size. Blocks return their k + 1 nearest in double precision on
the given vectors, from which the k nearest overall are taken. Vectors of one length have an index of their own:
others have no cosine with them.

Cases: vectors that are null, zero or hold null, NaN or infinite components, and rows with a null vec_id, take no
part; ties go to the smaller vec_id; of rows repeated under one vec_id the one with the smallest vector counts; with
fewer than k candidates all are returned; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, give_back, put, whole_groups, work_dir
from .vectors import matrix, sampled, unit, usable

#: Rows of the sample that fits the centroids, lists at most, and vectors that a list should hold.
SAMPLE, CENTROIDS, LIST_SIZE = 100_000, 1 << 14, 128
REPLICAS, REPLICA_RATIO, PROBE_RATIO = 4, 1.10, 1.20
DEGREE, LEAST_CANDIDATES, BLOCK = 16, 256, 4096


def balanced_centroids(rows: np.ndarray, count: int, seed: int) -> np.ndarray:
    """Unit means of count balanced cells: each cell splits at the median between two means, a few 2-means rounds."""
    rng = np.random.default_rng(seed)
    out, todo = [], [(rows, max(1, count))]
    while todo:
        x, n = todo.pop()
        if n == 1 or len(x) < 2:
            m = x.mean(0)
            out.append(m / (np.sqrt(m @ m) or 1.0))
            continue
        a, b = x[rng.choice(len(x), 2, replace=False)]
        for _ in range(4):
            p = x @ (a - b)
            order = np.argsort(p, kind="stable")
            cut = len(x) * (n // 2) // n or 1
            b, a = x[order[:cut]].mean(0), x[order[cut:]].mean(0)
        todo += [(x[order[:cut]], n // 2), (x[order[cut:]], n - n // 2)]
    return np.array(out)


def neighbour_graph(centroids: np.ndarray, degree: int = DEGREE) -> np.ndarray:
    """For each centroid its nearest others and one hash-like far link, which keeps the graph in one piece."""
    n = len(centroids)
    near = np.concatenate([np.argsort(-(centroids[a : a + 512] @ centroids.T), axis=1, kind="stable")[:, 1 : degree + 1] for a in range(0, n, 512)])
    return np.concatenate([near, ((np.arange(n) + 1) % n)[:, None]], 1)


def probe(query: np.ndarray, centroids: np.ndarray, graph: np.ndarray, sizes: np.ndarray, ratio: float, least: int) -> list[int]:
    """Lists to search: best first through the graph, all within ratio of the nearest distance, until these hold least vectors."""
    dist = lambda i: float(np.sqrt(max(0.0, 2 - 2 * (centroids[i] @ query))))
    start = int(np.linspace(0, len(centroids) - 1, 8).astype(int)[np.argmax(centroids[np.linspace(0, len(centroids) - 1, 8).astype(int)] @ query)])
    heap, seen = [(dist(start), start)], {start}
    taken: list[tuple[float, int]] = []
    best, held = heap[0][0], 0
    while heap:
        d, i = heapq.heappop(heap)
        if d > ratio * best and held >= least:
            break
        best = min(best, d)
        taken.append((d, i))
        held += int(sizes[i])
        new = [j for j in graph[i].tolist() if j not in seen]
        seen.update(new)
        if new:
            for j, x in zip(new, np.sqrt(np.maximum(0.0, 2 - 2 * (centroids[new] @ query))).tolist(), strict=True):
                heapq.heappush(heap, (x, j))
    taken.sort()
    out, held = [], 0
    for d, i in taken:
        if d > ratio * best and held >= least:
            break
        out.append(i)
        held += int(sizes[i])
    return out


def _nearest(q_ids: np.ndarray, q: np.ndarray, ids: list[list[int]], rows: np.ndarray, k: int) -> tuple[list, list, list]:
    """Per query the k nearest ids of the rows (each with its ids, ascending): products find who may be, sums in one fixed order give the scores."""
    rn, qn = np.sqrt((rows * rows).sum(1)), np.sqrt((q * q).sum(1))
    rough = (q @ rows.T) / qn[:, None] / rn[None, :]
    out: tuple[list, list, list] = ([], [], [])
    cut = np.partition(rough, max(0, rough.shape[1] - k), axis=1)[:, max(0, rough.shape[1] - k)]
    for i in range(len(q)):
        at = np.flatnonzero(rough[i] >= cut[i] - 1e-9)
        score = (q[i] * rows[at]).sum(1) / (qn[i] * rn[at])
        best = sorted((-s, n) for s, j in zip(score.tolist(), at.tolist(), strict=True) for n in ids[j])[:k]
        out[0].extend([int(q_ids[i])] * len(best))
        out[1].extend(n for _, n in best)
        out[2].extend(-s for s, _ in best)
    return out


def search(vectors: DataFrame, k: int = 5, is_query: Column | None = None, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 5) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest by cosine found for each query row, never itself.

    is_query: which rows are queries, a condition on vec_id; by default those whose id 50 divides.
    """
    spark = vectors.sparkSession
    is_query = is_query if is_query is not None else F.col("vec_id") % 50 == 0
    one = usable(vectors, id_col, vector_col).groupBy("vec_id").agg(F.min("v").alias("v"))
    rows = put(one.select("vec_id", "v", F.size("v").alias("dim")), work_dir(spark, "ann-rows"))
    lengths = [r["dim"] for r in rows.select("dim").distinct().orderBy("dim").collect()]
    parts = [_near(rows.where(F.col("dim") == n).drop("dim"), k, is_query, seed) for n in lengths or [0]]
    near = parts[0]
    for x in parts[1:]:
        near = near.unionByName(x)
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank.cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _near(rows: DataFrame, k: int, is_query: Column, seed: int) -> DataFrame:
    """query_id, vec_id, score: k or more nearest, all rows (vec_id, v) of one length."""
    spark = rows.sparkSession
    place = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    units = rows.withColumn("place", place).where(F.col("place") <= k + 1).groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    units = put(units.select(F.element_at("ids", 1).alias("unit"), "ids", "v"), work_dir(spark, "ann-units"))
    asked = rows.where(is_query)
    asks = put(asked.groupBy("v").agg(F.min("vec_id").alias("q")), work_dir(spark, "ann-queries"))

    total = units.count()
    some = units.where(sampled(F.col("unit"), total, SAMPLE, seed)).orderBy("unit").select("v").toArrow()
    x = unit(matrix(some.column("v"))) if len(some) else np.ones((1, 1))
    centroids = balanced_centroids(x, max(1, min(CENTROIDS, total // LIST_SIZE, len(x) // 4)), seed)
    made = spark.sparkContext.broadcast(centroids)
    kind = rows.schema["v"].dataType.simpleString()

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = made.value
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                part = batch.slice(a, 512)
                d = np.sqrt(np.maximum(0, 2 - 2 * (unit(matrix(part.column("v"))) @ c.T)))
                near = np.argpartition(d, min(REPLICAS, d.shape[1]) - 1, axis=1)[:, :REPLICAS]
                dn = np.take_along_axis(d, near, 1)
                on = dn <= dn.min(1)[:, None] * REPLICA_RATIO
                i, j = np.nonzero(on)
                yield pa.RecordBatch.from_arrays([pa.array(near[i, j].astype(np.int32)), *(part.column(n).take(pa.array(i)) for n in ("unit", "ids", "v"))], ["list", "unit", "ids", "v"])
        give_back()

    posted = put(units.mapInArrow(post, f"list int, unit long, ids array<long>, v {kind}"), work_dir(spark, "ann-lists"))
    # at most CENTROIDS counts
    sizes = np.zeros(len(centroids), np.int64)
    for r in posted.groupBy("list").count().collect():
        sizes[r["list"]] = r["count"]
    index = spark.sparkContext.broadcast((centroids, neighbour_graph(centroids), sizes))
    least = max(LEAST_CANDIDATES, REPLICAS * (k + 1))

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [probe(q, *index.value, PROBE_RATIO, least) for q in unit(matrix(batch.column("v")))]
                i = np.repeat(np.arange(len(found)), [len(f) for f in found])
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).astype(np.int32)), *(batch.column(n).take(pa.array(i)) for n in ("q", "v"))], ["list", "q", "v"])

    chosen = put(asks.mapInArrow(select, f"list int, q long, v {kind}"), work_dir(spark, "ann-chosen"))
    wanted = {r["list"]: r["count"] for r in chosen.groupBy("list").count().collect()}
    # one row a list: blocks of its vectors, and of the queries that ask it
    cut = spark.createDataFrame([(i, int(-(-int(sizes[i]) // BLOCK)) or 1, -(-n // BLOCK)) for i, n in sorted(wanted.items())], "list int, blocks int, turns int")
    base = posted.join(F.broadcast(cut), "list").select("list", F.pmod(F.xxhash64("unit"), "blocks").cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("turns") - 1)).alias("turn"), F.lit(False).alias("asks"), F.col("unit").alias("id"), "ids", "v")
    ask = chosen.join(F.broadcast(cut), "list").select("list", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("q"), "turns").cast("int").alias("turn"), F.lit(True).alias("asks"), F.col("q").alias("id"), F.array().cast("array<long>").alias("ids"), "v")
    dealt = base.unionByName(ask).withColumn("task", F.xxhash64("list", "block", "turn")).repartition("task").sortWithinPartitions("task", "list", "block", "turn", F.desc("asks"), "id")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "task", BLOCK):
            keys = np.stack([table.column(c).to_numpy() for c in ("list", "block", "turn")], 1)
            asks, ids, v = table.column("asks").to_numpy(), table.column("id").to_numpy(), matrix(table.column("v"))
            several = table.column("ids").to_pylist()
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), len(keys)]
            for a, b in zip(cuts, cuts[1:], strict=False):
                m = a + int(asks[a:b].sum())
                for at in range(a, m if m < b else a, 256):
                    q, i, s = _nearest(ids[at : min(m, at + 256)], v[at : min(m, at + 256)], several[m:b], v[m:b], k + 1)
                    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(i, pa.int64()), pa.array(s, pa.float64())], ["q", "vec_id", "score"])

    near = dealt.mapInArrow(work, "q long, vec_id long, score double").groupBy("q", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    top = put(near.withColumn("rank", rank).where(F.col("rank") <= k + 1).select("q", "vec_id", "score"), work_dir(spark, "ann-top"))
    drop(units, posted, chosen)
    ids = asked.join(asks, "v").select(F.col("vec_id").alias("query_id"), "q")
    return ids.join(top, "q").where("query_id <> vec_id").select("query_id", "vec_id", "score")
