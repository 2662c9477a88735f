"""N-gram Jaccard join: a grouped prefix join over word shingles.

Two documents link when the Jaccard similarity of their shingle sets is at least percent / 100. Every set is put in
one global order (frequent shingles last); linked sets must share a shingle within their prefixes, of
n - ceil(n * percent / 100) + 1 shingles. Documents with the same set are one from the start. Distinct sets with the
same prefix and size form one group. Only groups stand in the lists of prefix shingles and only pairs of groups are
filtered, by size, place, bitmap and count; the pairs that pass are expanded to their members, which are verified on
the whole sets.

Frequent shingles: each task reports those in a thousandth of the documents that it counts together; the table that is broadcast keeps at
most FREQUENT of them, by count. It only sets the order, so the result doesn't depend on it.

Pairs are verified in two rounds. First each set is compared with one of its group, and each group with one other:
of the groups of its size band, the one that shares most of its own prefix with others, in as many lists as possible;
that unites large groups of copies without listing their pairs. Then the pairs of groups whose members lie in
different components are filtered and expanded to the members of different components. No link between components is
lost. A list of more than LIST_BLOCK groups is joined block by block, and a set that many others are compared with is
dealt out to several tasks, so that no task gets a hot list or a hot document whole.

Cases: a document without words (or null text) has an empty set and links with nothing; one with fewer than k words
has its whole sequence as one shingle; a very long text is one row of its task like any other; rows with a null doc_id
get a null component; a doc_id that comes twice is one node that has the links of both texts; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop, forget_memos, put, text_chunks, work_dir
from .components import connected
from .shingles import mix, shingle_sets

#: Most frequent shingles that are broadcast (12 bytes each).
FREQUENT = 1 << 18
#: Shingles of a task's documents that are counted together (8 bytes each).
COUNTED = 3_000_000
#: Characters that are shingled at a time; each takes about 100 bytes of a worker meanwhile.
SHINGLED = 500_000
#: Bits of the broadcast filter of named documents (1 MB).
NAMED_BITS = 1 << 23
#: Groups of a list that one task joins with as many others, and pairs for which one task holds a document's set.
LIST_BLOCK, PAIRS_BLOCK = 128, 128
#: Longs of a prefix's bitmap, of which each holds 63 bits.
WORDS = 4


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits of a set, as two signed longs."""
    a = mix(s + np.uint64(0x1234567)).sum(dtype=np.uint64)
    b = np.bitwise_xor.reduce(mix(s ^ np.uint64(0xABCDEF0123456789))) if len(s) else np.uint64(0)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


def _need(n: Column | int, percent: int):
    """Least size of the smaller of two linked sets, of which the larger has n: ceil(n * percent / 100)."""
    return (n * percent + 99) // 100 if isinstance(n, int) else F.floor((n * percent + 99) / 100)


def frequent_shingles(docs: DataFrame, k: int) -> DataFrame:
    """shingle, n: a lower bound of the number of documents, for shingles that are frequent in some task."""

    def often(sets: list[np.ndarray]) -> pa.RecordBatch:
        values, n = np.unique(np.concatenate(sets), return_counts=True)
        on = n >= max(3, len(sets) // 1000)
        return pa.RecordBatch.from_arrays([pa.array(values[on].view(np.int64)), pa.array(n[on])], ["shingle", "n"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget_memos()
        held: list[np.ndarray] = []
        size = 0
        for _, texts in text_chunks(batches, "text", SHINGLED):
            for s in shingle_sets([x.encode() for x in texts], k):
                held.append(s)
                size += len(s)
            if size > COUNTED:
                yield often(held)
                held, size = [], 0
        if held:
            yield often(held)

    return docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n"))


def _prefixes(docs: DataFrame, k: int, percent: int, often: DataFrame) -> DataFrame:
    """doc_id, n, s1, s2 (signature of the set), p1, p2 (of prefix and size), prefix."""
    spark = docs.sparkSession
    rows = often.orderBy(F.desc("n"), "shingle").limit(FREQUENT).toPandas()
    values = rows["shingle"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    table = spark.sparkContext.broadcast((values[order], rows["n"].to_numpy(np.int64)[order]))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count = table.value
        for part, texts in text_chunks(batches, "text", SHINGLED):
            out: list[tuple] = []
            for s in shingle_sets([x.encode() for x in texts], k):
                n = len(s)
                length = n - _need(n, percent) + 1 if n else 0
                prefix = s[:0]
                if n:
                    at = np.minimum(np.searchsorted(known, s), max(0, len(known) - 1))
                    hit = known[at] == s if len(known) else np.zeros(n, bool)
                    rare = s[~hit]
                    if len(rare) < length:
                        late = np.flatnonzero(hit)
                        late = late[np.lexsort((s[late], count[at[late]]))]
                        rare = np.concatenate([rare, s[late]])
                    prefix = rare[:length]
                out.append((n, *_signature(s), *_signature(prefix + np.uint64(n)), prefix.view(np.int64)))
            n, s1, s2, p1, p2, prefix = zip(*out, strict=True) if out else ([],) * 6
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(n, pa.int64()), *(pa.array(x, pa.int64()) for x in (s1, s2, p1, p2)), pa.array(prefix, pa.list_(pa.int64()))],
                ["doc_id", "n", "s1", "s2", "p1", "p2", "prefix"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(cut, "doc_id long, n long, s1 long, s2 long, p1 long, p2 long, prefix array<long>")


def _sizes_fit(percent: int) -> Column:
    return F.least("x_n", "y_n") * 100 >= F.greatest("x_n", "y_n") * percent


def _places_fit(percent: int) -> Column:
    """Position filter: sets of sizes x_n and y_n whose first common shingle is at x_pos and y_pos (from 0) may still link."""
    return F.least(F.col("x_n") - F.col("x_pos"), F.col("y_n") - F.col("y_pos")) * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent


def _enough(percent: int, c: Column | None = None) -> Column:
    """Count filter: with c common prefix shingles, sets of sizes x_n and y_n may still link.

    Of the two prefixes one ends first in the global order. Its shingles that the other set holds are all in the
    other's prefix too, so that the sets share at most c and what lies behind the prefix, ceil(n * percent / 100) - 1.
    """
    behind = F.greatest(_need(F.col("x_n"), percent), _need(F.col("y_n"), percent)) - 1
    return ((F.col("c") if c is None else c) + behind) * (100 + percent) >= (F.col("x_n") + F.col("y_n")) * percent


def _named(df: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of df that ids may name (both by doc_id), before what they hold is shuffled; an exact join must follow.

    A filter of NAMED_BITS bits is broadcast: at most 1 MB, whatever the number of ids; more ids make it let more through.
    """
    at = F.pmod(F.xxhash64("doc_id"), F.lit(NAMED_BITS))
    key, place = F.floor(at / 32768).alias("bucket"), F.pmod(at, F.lit(32768)).cast("int")
    maps = ids.groupBy(key).agg(F.bitmap_construct_agg(place.cast("long")).alias("bits"))
    out = df.withColumns({"bucket": key, "place": place}).join(F.broadcast(maps), "bucket")
    return out.where("(shiftright(cast(conv(hex(substring(bits, cast(place div 8 as int) + 1, 1)), 16, 10) as int), place % 8) & 1) = 1").select(df.columns)


def _verified(pairs: DataFrame, docs: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (a, b) that link, judged on the whole sets."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text", SHINGLED):
            sets = pa.array([s.view(np.int64) for s in shingle_sets([x.encode() for x in texts], k)], pa.list_(pa.int64()))
            yield part.set_column(part.schema.get_field_index("text"), "shingles", sets)

    # each document is shingled once; one that many pairs name as b goes to several tasks
    texts = docs.select(F.col("doc_id").cast("long"), "text")
    fan = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_BLOCK).cast("int").alias("fan"))
    firsts = pairs.join(fan, "b").select(F.col("a").alias("doc_id"), "b", F.pmod(F.xxhash64("a"), F.col("fan")).cast("int").alias("salt"))
    left = _named(texts, firsts).mapInArrow(cut, "doc_id long, shingles array<long>").join(firsts, "doc_id").select(F.col("doc_id").alias("a"), "b", "salt", F.col("shingles").alias("x"))
    seconds = fan.withColumnRenamed("b", "doc_id")
    right = _named(texts, seconds).mapInArrow(cut, "doc_id long, shingles array<long>").join(seconds, "doc_id")
    right = right.select(F.col("doc_id").alias("b"), F.explode(F.sequence(F.lit(0), F.col("fan") - 1)).alias("salt"), F.col("shingles").alias("y"))
    common = F.size(F.array_intersect("x", "y"))
    return left.join(right, ["b", "salt"]).where(common * 100 >= (F.size("x") + F.size("y") - common) * percent).select("a", "b").distinct()


def _bits(shingle: Column) -> list[Column]:
    """One bit of 63 * WORDS for a shingle, as WORDS longs."""
    at = F.pmod(F.xxhash64(shingle), F.lit(63 * WORDS)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), at % 63)
    return [F.when(F.floor(at / 63) == w, bit).otherwise(F.lit(0).cast("long")) for w in range(WORDS)]


def _bits_fit(percent: int) -> Column:
    """Bitmap filter: a bit that only one prefix sets stands for a shingle that the other lacks, which bounds the common ones."""
    only = [sum((F.bit_count(F.col(f"{s}_b{w}").bitwiseAND(F.bitwise_not(f"{t}_b{w}"))) for w in range(WORDS)), F.lit(0)) for s, t in ("xy", "yx")]
    return _enough(percent, F.least(F.col("x_open") - only[0], F.col("y_open") - only[1]))


def _joined(lists: DataFrame) -> DataFrame:
    """Pairs of entries of one list, columns x_... and y_..., each pair once; lists of more than LIST_BLOCK entries block by block."""
    # counts are a table of their own, so that Spark may split a hot list when it is joined with its count
    counts = lists.groupBy("shingle").agg(F.ceil(F.count("*") / LIST_BLOCK).cast("int").alias("blocks"))
    counts = put(counts, work_dir(lists.sparkSession, "join-blocks"))
    dealt = lists.join(counts, "shingle").withColumn("block", F.pmod(F.xxhash64("g"), F.col("blocks")).cast("int"))
    sides = {}
    for s, first, last, own, other in (("x", F.col("block"), F.col("blocks") - 1, "bx", "by"), ("y", F.lit(0), F.col("block"), "by", "bx")):
        rows = dealt.withColumn(other, F.explode(F.sequence(first, last)))
        sides[s] = rows.select("shingle", F.col("block").alias(own), other, *(F.col(c).alias(f"{s}_{c}") for c in lists.columns if c != "shingle"))
    return sides["x"].join(sides["y"], ["shingle", "bx", "by"]).where("bx < by or x_g < y_g")


def jaccard_join(docs: DataFrame, k: int = 5, percent: int = 80) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id (smallest doc_id reachable by links)."""
    spark = docs.sparkSession
    often = put(frequent_shingles(docs, k), work_dir(spark, "join-frequent"))
    sets = put(_prefixes(docs, k, percent, often), work_dir(spark, "join-prefixes"))

    known = sets.where("n > 0 and doc_id is not null")
    # distinct sets, each under its smallest doc_id; g: the group of those with the same prefix and size
    group = F.xxhash64("p1", "p2", "n").alias("g")
    units = put(known.groupBy("s1", "s2", "n").agg(F.min("doc_id").alias("unit"), F.first(group).alias("g")), work_dir(spark, "join-units"))
    # a doc_id with several sets is one node
    several = known.groupBy("doc_id").agg(F.min(F.xxhash64("s1", "s2")).alias("low"), F.max(F.xxhash64("s1", "s2")).alias("high")).where("low <> high").select("doc_id")
    same = known.join(several, "doc_id").join(units, ["s1", "s2", "n"]).select(F.col("doc_id").alias("a"), F.col("unit").alias("b"))
    heads = put(units.groupBy("g").agg(F.min("unit").alias("head"), F.first("n").alias("n"), F.count("*").alias("units")), work_dir(spark, "join-heads"))
    prefixes = known.select(F.col("doc_id").alias("head"), group, "prefix").join(heads, ["g", "head"]).dropDuplicates(["g"])
    prefixes = put(prefixes, work_dir(spark, "join-heads-prefixes"))
    post = put(prefixes.select("g", "head", "n", F.posexplode("prefix").alias("pos", "shingle")), work_dir(spark, "join-postings"))
    shared = put(post.groupBy("shingle").agg(F.count("*").alias("groups")).where("groups > 1").select("shingle"), work_dir(spark, "join-shared"))
    lists = put(post.join(shared, "shingle"), work_dir(spark, "join-lists"))
    drop(post, shared)

    band = F.floor(F.log("n") / float(-np.log(percent / 100))).alias("band")
    # the group of a band that shares the most of its prefix is the one that its copies were made from, or near it
    known_part = lists.groupBy("g").agg((F.count("*") / F.max("n")).alias("part"))
    banded = put(lists.select("*", band).join(known_part, "g"), work_dir(spark, "join-banded"))
    lead = put(banded.groupBy("shingle", "band").agg(F.max(F.struct("part", (-F.col("head")).alias("head"), "n", F.col("g").alias("b"))).alias("lead")), work_dir(spark, "join-leads"))
    star = banded.join(lead, ["shingle", "band"]).where("g <> lead.b").select("g", "head", F.col("n").alias("x_n"), (-F.col("lead.head")).alias("b"), F.col("lead.n").alias("y_n"))
    some = star.groupBy("g", "head", "b", "x_n", "y_n").agg(F.count("*").alias("c")).where(_enough(percent))
    best = some.groupBy("g", "head").agg(F.max(F.struct("c", (-F.col("b")).alias("b"))).alias("best"))
    within = units.join(heads.where("units > 1").select("g", "head"), "g").select(F.col("unit").alias("a"), F.col("head").alias("b"))
    first = best.select(F.col("head").alias("a"), (-F.col("best.b")).alias("b")).unionByName(within).where("a <> b").distinct()
    first = put(first, work_dir(spark, "join-first"))
    drop(banded, lead)
    links = put(_verified(first, docs, k, percent).unionByName(same), work_dir(spark, "join-links1"))

    at = connected(links).withColumnRenamed("id", "unit")
    members = put(units.select("g", "unit").join(at, "unit", "left").withColumn("component", F.coalesce("component", "unit")), work_dir(spark, "join-members"))
    spread = members.groupBy("g").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    placed = put(lists.join(spread, "g"), work_dir(spark, "join-placed"))
    split = placed.groupBy("shingle").agg(F.min("low").alias("least"), F.max("high").alias("most")).where("least < most").select("shingle")
    split = put(split, work_dir(spark, "join-split"))
    open_ = put(placed.join(split, "shingle"), work_dir(spark, "join-open"))
    drop(lists, placed, split)
    whole = Window.partitionBy("g")
    marked = open_.select("shingle", "g", "pos", "n", "low", "high", F.count("*").over(whole).alias("open"), *(F.bit_or(x).over(whole).alias(f"b{w}") for w, x in enumerate(_bits(F.col("shingle")))))
    marked = put(marked, work_dir(spark, "join-marked"))
    fit = _sizes_fit(percent) & _places_fit(percent) & _bits_fit(percent)
    pairs = _joined(marked).where("least(x_low, y_low) < greatest(x_high, y_high)").where(fit)
    pairs = put(pairs.select("x_g", "y_g", "x_n", "y_n").distinct(), work_dir(spark, "join-pairs"))
    # the exact count of common prefix shingles; what passes is expanded to members, in different components
    by = {s: prefixes.select(F.col("g").alias(f"{s}_g"), F.col("prefix").alias(s)) for s in "xy"}
    counted = pairs.join(by["x"], "x_g").join(by["y"], "y_g").withColumn("c", F.size(F.array_intersect("x", "y"))).where(_enough(percent)).select("x_g", "y_g")
    inside = spread.where("low < high").select(F.col("g").alias("x_g"), F.col("g").alias("y_g"))
    side = {s: members.select(F.col("g").alias(f"{s}_g"), F.col("unit").alias(s), F.col("component").alias(f"{s}_c")) for s in "xy"}
    expanded = counted.unionByName(inside).join(side["x"], "x_g").join(side["y"], "y_g").where("x_c <> y_c").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    seen = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    rest = put(expanded.join(seen, ["a", "b"], "left_anti"), work_dir(spark, "join-rest"))
    more = put(_verified(rest, docs, k, percent), work_dir(spark, "join-links2"))
    final = put(connected(links.unionByName(more)), work_dir(spark, "join-final"))
    drop(often, heads, prefixes, first, links, members, open_, marked, pairs, rest, more)

    by_unit = units.join(final.withColumnRenamed("id", "unit"), "unit", "left").select("s1", "s2", "n", F.coalesce("component", "unit").alias("component_id"))
    out = sets.select("doc_id", "s1", "s2", "n").join(by_unit, ["s1", "s2", "n"], "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))
