"""Removes long byte strings that occur more than once, by suffix arrays.

A byte goes if a string of `length` bytes (400) that covers it also starts anywhere else, in the same document or
another; matches never cross documents, and strings are judged on the input. The work is exact and distributed:

1. Every string of `length` bytes has one anchor: the smallest of its grams (gram_of(length) bytes, 128 for 400) in a
   fixed pseudo-random order (ties: the last). Equal strings have equal anchors at the same place, so all copies of a string meet under the
   hash of their anchor gram. Consecutive strings with one anchor form a segment.
2. Segments under a gram that occurs once hold no repeat. Equal segments that occur more than once are repeats as a
   whole; they are counted by digest, never gathered.
   Copies of whole segments are found there and never enter an array; what follows is for the rest, of which the
   arrays decide every string.
3. Different segments under one gram are cut into blocks of 16 bytes counted from the anchor. Blocks become symbols
   in their order, and one suffix array over many segments at once (linear grouping construction) with its common
   prefixes shows which runs of blocks recur; at the runs' borders the bytes themselves are compared.
4. A gram with more than MOST_ROWS different segments (a short passage with different surroundings in very many
   documents) goes to no single task. Its segments are halved by the places of their strings before the anchor: all
   strings of a half hold more bytes around the anchor than the gram, and meet under the hash of those. Halves that
   are still too many are halved again, LEVELS times; what is left then shares all but a few bytes of a string in
   more than MOST_ROWS surroundings, and the digests of its strings are counted.

With least_words, a removed run must hold that many words or it stays: a filter on what the runs are, for corpora
whose short common phrases are to be kept.

Cases: null and empty texts have no strings; texts shorter than length lose nothing; a very long text is scanned in pieces that overlap by a string; repeated rows are copies of
each other and lose what any copy loses; rows with a null doc_id take part; an empty table gives an empty result;
columns of the input are kept as told by the caller.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, put, text_chunks, text_of, whole_groups, work_dir
from .shingles import _VALUE, _power, mix
from .suffix_array import common_prefixes, concatenated, suffix_array

LENGTH, BLOCK, MOST_ROWS, LEVELS = 400, 16, 1024, 4
#: Bytes of text, of one or more documents, that the anchor scan takes at a time; fits the 24 bits of a place.
SCAN = 500_000
_U = np.uint64
_PLACE = _U((1 << 24) - 1)


def gram_of(length: int) -> int:
    """Bytes of the grams among which the strings of length bytes have their anchor: long enough to be rare, short enough for few segments."""
    return length * 8 // 25


def anchors(raw: np.ndarray, ends: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Segments of texts that stand one after another in raw: gram hash, anchor, first and last start of a string with that anchor."""
    n, gram = len(raw), gram_of(length)
    empty = np.zeros(0, np.int64)
    if n < length:
        return empty.astype(np.uint64), empty, empty, empty
    power, inverse = _power(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUE[raw] * power[:n], out=total[1:])
    grams = mix((total[gram:] - total[:-gram]) * inverse[: n - gram + 1])
    del total
    m = len(grams)
    key = (grams & ~_PLACE) | (_PLACE - np.arange(m, dtype=np.uint64))
    w = length - gram + 1
    padded = np.full(-(-m // w) * w, ~_U(0))
    padded[:m] = key
    rows = padded.reshape(-1, w)
    before = np.minimum.accumulate(rows, axis=1).ravel()
    after = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = np.arange(n - length + 1)
    least = np.minimum(after[starts], before[starts + w - 1])
    at = (_PLACE - (least & _PLACE)).astype(np.int64)
    doc = np.searchsorted(ends, starts, side="right")
    inside = starts + length <= ends[np.minimum(doc, len(ends) - 1)]
    starts, at, doc = starts[inside], at[inside], doc[inside]
    if not len(starts):
        return empty.astype(np.uint64), empty, empty, empty
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])]))
    last = np.append(new[1:], len(starts)) - 1
    return grams[at[new]], at[new], starts[new], starts[last]


def _segments(texts: list[bytes], length: int) -> Iterator[tuple[int, int, int, int, int, int, int]]:
    """(text number, gram, digest high, digest low, anchor, first start, last start); places within the text."""
    units: list[tuple[int, int, bytes]] = []
    for i, x in enumerate(texts):
        step = SCAN - length + 1
        units += [(i, a, x[a : a + SCAN]) for a in range(0, max(1, len(x) - length + 1), step)] if len(x) >= length else []
    at = 0
    while at < len(units):
        stop, size = at, 0
        while stop < len(units) and (stop == at or size + len(units[stop][2]) <= SCAN):
            size += len(units[stop][2])
            stop += 1
        part = units[at:stop]
        joined = b"".join(x for _, _, x in part)
        ends = np.cumsum([len(x) for _, _, x in part])
        gram, anchor, low, high = anchors(np.frombuffer(joined, np.uint8), ends, length)
        owner = np.searchsorted(ends, low, side="right")
        shift = (ends - [len(x) for _, _, x in part])[owner] - np.array([a for _, a, _ in part])[owner] if len(low) else low
        text = np.array([i for i, _, _ in part])[owner] if len(low) else low
        view = memoryview(joined)
        for t, g, p, a, b, s in zip(text.tolist(), gram.view(np.int64).tolist(), anchor.tolist(), low.tolist(), high.tolist(), np.asarray(shift).tolist(), strict=True):
            d = xxhash.xxh3_128_digest(view[a : b + length], seed=p - a)
            yield t, g, int.from_bytes(d[:8], "big", signed=True), int.from_bytes(d[8:], "big", signed=True), p - s, a - s, b - s
        at = stop


def repeats(rows: list[bytes], before: list[int], length: int = LENGTH) -> list[list[tuple[int, int]]]:
    """For each segment the ranges of string starts (relative to its first, both ends included) that recur elsewhere in rows.

    rows: bytes of the segments; before: bytes in front of the anchor. Equal rows count as repeats of each other.
    """
    whole = length // BLOCK - 1  # blocks that every string holds, whatever its place between blocks
    offset = [b % BLOCK for b in before]
    blocks = [(len(r) - o) // BLOCK for r, o in zip(rows, offset, strict=True)]
    raw = np.frombuffer(b"".join(r[o : o + n * BLOCK] for r, o, n in zip(rows, offset, blocks, strict=True)), np.uint8).reshape(-1, BLOCK)
    two = np.ascontiguousarray(raw).view(">u8").astype(np.uint64)
    order = np.lexsort((two[:, 1], two[:, 0]))
    ordered = two[order]
    symbol = np.empty(len(two), np.int64)
    symbol[order] = np.cumsum(np.concatenate([[0], (ordered[1:] != ordered[:-1]).any(1)])) if len(two) else symbol
    cuts = np.cumsum([0, *blocks])
    text, first = concatenated([symbol[a:b].tolist() for a, b in zip(cuts, cuts[1:], strict=False)])
    sa = suffix_array(text)
    shared = np.array(common_prefixes(text, sa)) >= whole
    sa_ = np.array(sa)
    run = np.cumsum(~shared)
    many = shared | np.append(shared[1:], False)
    at = sa_[many]
    cluster = run[many]
    row = np.searchsorted(first, at, side="right") - 1
    u = (at - np.array(first)[row]) * BLOCK + np.array(offset)[row]  # where the blocks begin, within the row
    last = np.array([len(r) - length for r in rows])[row]  # last string start of the row
    padded = np.frombuffer(b"".join(b"\0" * BLOCK + r + b"\0" * BLOCK for r in rows), np.uint8)
    base = np.cumsum([0, *(len(r) + 2 * BLOCK for r in rows)])[:-1][row] + BLOCK + u
    span = whole * BLOCK
    around = np.concatenate([padded[(base[:, None] + np.arange(-BLOCK + 1, 0))], padded[np.minimum(base[:, None] + span + np.arange(BLOCK), len(padded) - 1)]], 1) if len(at) else np.zeros((0, 2 * BLOCK - 1), np.uint8)
    hits: list[np.ndarray] = []
    for f in range(BLOCK):
        ok = np.flatnonzero((u - f >= 0) & (u - f <= last))
        if not len(ok):
            continue
        edge = np.ascontiguousarray(around[ok, BLOCK - 1 - f : 2 * BLOCK - 1 - f]).view(np.uint64)
        c = cluster[ok]
        o = np.lexsort((edge[:, 1], edge[:, 0], c))
        same = (c[o][1:] == c[o][:-1]) & (edge[o][1:] == edge[o][:-1]).all(1)
        dup = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        hit = ok[o[dup]]
        hits.append(np.stack([row[hit], u[hit] - f], 1))
    out: list[list[tuple[int, int]]] = [[] for _ in rows]
    found = np.unique(np.concatenate(hits), axis=0) if hits else np.zeros((0, 2), np.int64)
    if len(found):
        cut = np.flatnonzero(np.concatenate([[True], (found[1:, 0] != found[:-1, 0]) | (found[1:, 1] != found[:-1, 1] + 1)]))
        for a, b in zip(cut, [*cut[1:], len(found)], strict=True):
            out[int(found[a, 0])].append((int(found[a, 1]), int(found[b - 1, 1])))
    return out


def halves(raw: bytes, before: int, low: int, high: int, length: int) -> Iterator[tuple[int, int, int, int, bytes]]:
    """Two parts of a segment, by how many bytes (from low, under high) its strings have before the anchor: key, before, low, high, bytes.

    The key is a hash of the bytes that all strings of a part hold, at whatever segment: equal strings have equal keys.
    """
    middle = (low + high) // 2
    for a, b in ((low, middle), (middle, high)):
        first, last = max(0, before - b + 1), min(len(raw) - length, before - a)
        if a < b and first <= last:
            shared = raw[before - a : before - b + 1 + length]
            yield xxhash.xxh3_64_intdigest(shared, seed=a) - (1 << 63), before - first, a, b, raw[first : last + length]


_SPANS = "array<struct<a:int,b:int>>"


def repeated_spans(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """key (doc_id, or a stand-in for null), digest (xxhash64 of the text), spans: ranges of string starts that recur, unordered."""
    spark = docs.sparkSession
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("digest"), text_of().alias("text"))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text", SCAN):
            found = list(_segments([x.encode() for x in texts], length))
            cols = list(zip(*found, strict=True)) if found else [()] * 7
            at = pa.array(cols[0], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("key").take(at), part.column("digest").take(at), *(pa.array(c, pa.int64()) for c in cols[1:4]), *(pa.array(c, pa.int32()) for c in cols[4:])], ["key", "digest", "gram", "h1", "h2", "anchor", "low", "high"])

    segments = put(keyed.mapInArrow(scan, "key long, digest long, gram long, h1 long, h2 long, anchor int, low int, high int"), work_dir(spark, "suffix-segments"))
    grams = put(segments.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"), work_dir(spark, "suffix-grams"))
    near = put(segments.join(grams, "gram"), work_dir(spark, "suffix-near"))
    drop(segments, grams)
    distinct = put(near.groupBy("gram", "h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("key", "digest", "anchor", "low", "high")).alias("one")), work_dir(spark, "suffix-distinct"))
    whole = distinct.where("n > 1").select("gram", "h1", "h2", F.array(F.struct((F.col("one.low") - F.col("one.anchor")).alias("a"), (F.col("one.high") - F.col("one.anchor")).alias("b"))).cast(_SPANS).alias("spans"))

    kinds = put(distinct.groupBy("gram").agg(F.count("*").alias("rows")).where("rows > 1"), work_dir(spark, "suffix-kinds"))
    wanted = distinct.join(kinds, "gram").select("gram", "h1", "h2", "rows", "one.*").groupBy("key", "digest").agg(F.collect_list(F.struct("gram", "h1", "h2", "rows", "anchor", "low", "high")).alias("cut"))
    once = keyed.join(wanted, ["key", "digest"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            rows = []
            for x, segs in zip(texts, part.column("cut").to_pylist(), strict=True):
                b = x.encode()
                rows += [(s["gram"], s["h1"], s["h2"], s["rows"], s["anchor"] - s["low"], b[s["low"] : s["high"] + length]) for s in segs]
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), pa.array(cols[4], pa.int32()), pa.array(cols[5], pa.binary())], ["gram", "h1", "h2", "rows", "before", "raw"])

    different = once.mapInArrow(cut, "gram long, h1 long, h2 long, rows long, before int, raw binary").dropDuplicates(["gram", "h1", "h2"])
    different = put(different, work_dir(spark, "suffix-different"))
    parts = ["key", "gram", "h1", "h2", "before", "raw"]
    few = different.where(F.col("rows") <= MOST_ROWS).withColumn("key", F.col("gram")).select(parts)
    hot = different.where(F.col("rows") > MOST_ROWS).select("gram", "h1", "h2", "before", "raw", F.lit(0).alias("lo"), F.lit(length - gram_of(length) + 1).alias("hi"))

    def halve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 512):
                rows = [(k, r["gram"], r["h1"], r["h2"], b, lo, hi, raw) for r in batch.slice(a, 512).to_pylist() for k, b, lo, hi, raw in halves(r["raw"], r["before"], r["lo"], r["hi"], length)]
                cols = list(zip(*rows, strict=True)) if rows else [()] * 8
                yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols[:4]), *(pa.array(c, pa.int32()) for c in cols[4:7]), pa.array(cols[7], pa.binary())], ["key", "gram", "h1", "h2", "before", "lo", "hi", "raw"])

    made = [different]
    for _ in range(LEVELS):
        if not hot.limit(1).count():
            break
        half = put(hot.mapInArrow(halve, "key long, gram long, h1 long, h2 long, before int, lo int, hi int, raw binary"), work_dir(spark, "suffix-halves"))
        n = put(half.groupBy("key").agg(F.count("*").alias("rows")).where("rows > 1"), work_dir(spark, "suffix-halves-kinds"))
        made += [half, n]
        few = few.unionByName(half.join(n.where(F.col("rows") <= MOST_ROWS), "key").select(parts))
        hot = half.join(n.where(F.col("rows") > MOST_ROWS), "key").drop("key", "rows")
    few = few.withColumn("size", F.length("raw")).repartition("key").sortWithinPartitions("key", "gram", "h1", "h2")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in whole_groups(batches, "key", MOST_ROWS, "size", 1_500_000):
            before = table.column("before").to_pylist()
            found = repeats(table.column("raw").to_pylist(), before, length)
            on = [i for i, f in enumerate(found) if f]
            spans = [[{"a": a - before[i], "b": b - before[i]} for a, b in found[i]] for i in on]
            at = pa.array(on, pa.int64())
            yield from pa.table([*(table.column(c).take(at) for c in ("gram", "h1", "h2")), pa.array(spans, pa.list_(pa.struct([("a", pa.int32()), ("b", pa.int32())])))], ["gram", "h1", "h2", "spans"]).combine_chunks().to_batches()

    partial = few.mapInArrow(sort, f"gram long, h1 long, h2 long, spans {_SPANS}")

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                view = memoryview(r["raw"])
                digests = [xxhash.xxh3_128_digest(view[a : a + length]) for a in range(len(view) - length + 1)]
                n = len(digests)
                yield pa.RecordBatch.from_arrays([*(pa.array([r[c]] * n, pa.int64()) for c in ("gram", "h1", "h2")), pa.array(np.arange(n, dtype=np.int32) - r["before"]), pa.array(digests, pa.binary())], ["gram", "h1", "h2", "p", "string"])

    every = hot.repartition("gram", "h1", "h2").mapInArrow(strings, "gram long, h1 long, h2 long, p int, string binary")
    twice = every.groupBy("string").agg(F.count("*").alias("n")).where("n > 1").select("string")
    counted = every.join(twice, "string").groupBy("gram", "h1", "h2").agg(F.collect_list(F.struct(F.col("p").alias("a"), F.col("p").alias("b"))).cast(_SPANS).alias("spans"))

    spans = put(whole.unionByName(partial).unionByName(counted), work_dir(spark, "suffix-spans"))
    placed = near.join(spans, ["gram", "h1", "h2"]).select("key", "digest", F.explode(F.transform("spans", lambda s: F.struct((s["a"] + F.col("anchor")).alias("a"), (s["b"] + F.col("anchor")).alias("b")))).alias("s"))
    result = put(placed.groupBy("key", "digest").agg(F.collect_set("s").alias("spans")), work_dir(spark, "suffix-result"))
    drop(near, distinct, kinds, spans, *made)
    return result


def merged(starts: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal byte ranges [a, b) that strings with these starts cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(starts):
        b += length
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, keep: list[str], length: int = LENGTH, least_words: int = 0) -> DataFrame:
    """Columns keep of docs, n_bytes, n_removed, n_spans, kept_sha256, kept (the remaining bytes as text, without characters that a cut went through).

    least_words: maximal runs of fewer words than that stay.
    """
    if length % BLOCK or gram_of(length) < 2 * BLOCK:
        raise ValueError(f"length must be a multiple of {BLOCK} and 112 at least")
    spans = repeated_spans(docs, length)
    fields = [*docs.select(*keep).schema.fields]
    rows = docs.select(*(F.col(c).alias(f"__{i}") for i, c in enumerate(keep)), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("key"), F.xxhash64("text").alias("digest"), text_of().alias("text"))
    joined = rows.join(spans, ["key", "digest"], "left").drop("key", "digest")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            size, removed, n, sha, kept = [], [], [], [], []
            for x, s in zip(texts, part.column("spans").to_pylist(), strict=True):
                b = x.encode()
                gone = merged([(r["a"], r["b"]) for r in s], length) if s else []
                gone = [(p, q) for p, q in gone if len(b[p:q].split()) >= least_words]
                left = b"".join(b[p:q] for p, q in zip([0, *(e for _, e in gone)], [*(a for a, _ in gone), len(b)], strict=True)) if gone else b
                size.append(len(b))
                removed.append(len(b) - len(left))
                n.append(len(gone))
                sha.append(hashlib.sha256(left).hexdigest())
                kept.append(left.decode("utf-8", "ignore") if gone else x)
            yield pa.RecordBatch.from_arrays(
                [*(part.column(f"__{i}") for i in range(len(fields))), *(pa.array(c, pa.int64()) for c in (size, removed, n)), pa.array(sha, pa.string()), pa.array(kept, pa.string())],
                [*(f.name for f in fields), "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept string"])
    return joined.mapInArrow(run, schema)
