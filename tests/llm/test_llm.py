"""The operators against brute force, the library or an exact round trip, and their odd inputs."""

import hashlib
import itertools
import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from shelfmark.llm import ann, chat, langid, lattice, mixing, ngram_join, pieces, suffix_array, suffix_dedup, token_counts, toxicity, vector_dedup
from shelfmark.llm.components import connected

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, digest string, key int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with internal ones."""
    return spark.createDataFrame([(i, t, l, s, len(t or ""), "x", 1) for i, t, l, s in rows], DOCS)


@pytest.fixture(scope="module")
def real(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    long = " ".join(f"word{i % 700}" for i in range(30_000))
    return docs(spark, [(1, None, None, None), (2, "", "en", "a"), (3, "same text here for all of us", "en", "a"), (3, "same text here for all of us", "en", "a"), (4, long, "en", None), (5, "  \n\t ", "de", "b"), (None, "no id", "fr", "b")])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


def random_texts(seed, n=3000):
    rng = random.Random(seed)
    return ["".join(rng.choice(" ab\n.▁é  tion中\U0001F600") for _ in range(rng.randint(0, 30))) for _ in range(n)] + ["x" * 5000, " " * 70]


def test_token_counts_are_the_librarys(spark, real, odd, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    texts = random_texts(1)
    assert token_counts.PieceCounter(MODEL).counts(texts) == [len(x) for x in sp.encode(texts)]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(real, MODEL).collect()}
    assert got == {r.doc_id: len(sp.encode(r.text or "")) for r in real.select("doc_id", "text").collect()}
    assert sorted((r.doc_id or 0, r.n_bytes) for r in token_counts.count_tokens(odd, MODEL).collect())[:3] == [(0, 5), (1, 0), (2, 0)]
    assert token_counts.count_tokens(empty, MODEL).count() == 0


def test_token_cache_encodes_misses_only(spark, tmp_path):
    path = f"file://{tmp_path}/cache"
    first = docs(spark, [(1, "a b", None, None), (2, "a b", None, None)])
    token_counts.count_tokens(first, MODEL, path).collect()
    assert spark.read.parquet(path).count() == 1
    got = token_counts.count_tokens(docs(spark, [(3, "a b", None, None), (4, "c", None, None)]), MODEL, path).collect()
    assert spark.read.parquet(path).count() == 2 and len(got) == 2
    token_counts.count_tokens(first, public_tokenizers.path("byte_bpe_50k.json"), path).collect()
    assert spark.read.parquet(path).count() == 3  # another tokenizer, another count


def test_mix_meets_its_targets(spark, real, odd, empty):
    got = mixing.mix(real).toPandas()
    assert got.equals(mixing.mix(real.repartition(7)).toPandas().sort_values(list(got.columns)).reindex(got.index)) or sorted(map(tuple, got.to_numpy())) == sorted(map(tuple, mixing.mix(real.repartition(7)).toPandas().to_numpy()))
    assert (got["taken"] <= 3 * got["size"]).all()
    words = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in real.select("doc_id", "text").collect()}
    assert all(words[i] == s for i, s in zip(got["doc_id"], got["size"]))
    by = got.merge(real.select("doc_id", "source").toPandas(), on="doc_id").groupby("source")
    assert (abs(by["taken"].sum() - by["target"].first()) <= by["size"].max()).all()
    assert abs(by["target"].first().sum() - got["size"].sum()) < 1e-6 * got["size"].sum()
    assert mixing.mix(odd).count() == 7 and mixing.mix(empty).count() == 0


def test_mix_against_water_filling(spark, odd):
    def filled(sizes):
        names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
        weight = {s: i % 3 + 1 for i, s in enumerate(names)}
        target, free, left = {}, set(names), sum(sizes.values())
        while free:
            level = left / sum(weight[s] for s in free)
            over = {s for s in free if weight[s] * level > 3 * sizes[s]}
            if not over:
                return target | {s: weight[s] * level for s in free}
            target |= {s: 3 * sizes[s] for s in over}
            left -= sum(3 * sizes[s] for s in over)
            free -= over
        return target

    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rng = random.Random(9)
    uneven = docs(spark, [(i if i % 5 else None, "w " * rng.choice([0, 3, 3, 50, 400]), None, rng.choice(["a", "b", "b", "b", "é", "Z", None])) for i in range(900)])
    for df, most in ((big, 20), (uneven, 20), (odd, 10**6)):
        sizes, by = {}, {}
        for r in df.select("doc_id", "source", "text").collect():
            n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
            sizes[r.source] = sizes.get(r.source, 0) + n
        want = filled(sizes)
        got = mixing.mix(df).collect()
        assert len(got) == df.count() and all(r.taken <= 3 * r.size for r in got)
        for r in got:
            key = next(s for s in sizes if sizes[s] == r.source_size and abs(want[s] - r.target) < 1e-6 * max(1, r.target))
            by[key] = by.get(key, 0) + r.taken
        assert all(abs(by[s] - want[s]) <= most for s in sizes)
        again = mixing.mix(df.repartition(5)).collect()
        plain = lambda rows: sorted((r.doc_id is None, r.doc_id or 0, r.size, r.target, r.taken) for r in rows)
        assert plain(got) == plain(again)


def test_flight_keeps_both_totals():
    rng = np.random.default_rng(0)
    size, p = rng.integers(0, 500, 300).astype(float), np.full(300, 0.37)
    q = mixing.flight(size, p, rng.random(300))
    assert ((q > 0) & (q < 1)).sum() <= 2
    assert abs(q.sum() - p.sum()) < 1e-6 and abs(size @ q - size @ p) < 1e-4


def test_languages_are_found(spark, real, odd, empty):
    got = langid.identify(real, MODEL).join(real.select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got["lang"] == got["lang_pred"]).mean() > 0.95
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.identify(odd, MODEL).collect()}
    assert out[1] == out[2] == out[5] == ("und", 0.0)
    assert langid.identify(empty, MODEL).count() == 0


def test_forward_sums_all_segmentations():
    v = pieces.vocabulary(MODEL)
    logp = np.log(np.random.default_rng(1).dirichlet(np.ones(v.size), 2).T + 1e-9)

    def brute(w):
        total = np.zeros(2)
        fits = [(i, r) for i, r in enumerate(v.raw) if r and np.isfinite(v.score[i]) and r in w]
        alone = {r for _, r in fits}

        def walk(at, p):
            nonlocal total
            if at == len(w):
                total = total + np.exp(p)
                return
            for i, r in fits:
                if w.startswith(r, at):
                    walk(at + len(r), p + logp[i])
            b = w[at]
            char = w[at : at + (1 if b < 128 or b == 255 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4)]
            if char not in alone:
                walk(at + len(char), p + sum(logp[v.byte_ids[x]] for x in char))

        walk(0, np.zeros(2))
        return np.log(total)

    words = [pieces.marked(x) for x in ("tion", "中a", "▁x", "", "a  b")]
    want = np.array([brute(w) for w in words])
    assert np.abs(lattice.forward(words, v.trie, logp, v.byte_ids) - want).max() < 1e-9
    assert np.abs(lattice._forward(words, v.trie, logp, v.byte_ids, False) - want).max() < 1e-9


def test_pieces_round_trip(spark, odd, empty):
    v = pieces.vocabulary(MODEL)
    texts = random_texts(2)
    ids = pieces.Encoder(v).encode(texts)
    assert [pieces.decode_ids(x.tolist(), v.raw) for x in ids] == texts
    got = pieces.decode(pieces.encode(odd, MODEL, ["doc_id", "text"]), MODEL, ["doc_id", "text"]).collect()
    assert len(got) == 7 and all(r.decoded == (r.text or "") for r in got)
    assert pieces.encode(empty, MODEL, ["doc_id"]).count() == 0


def test_viterbi_is_the_best_path():
    v = pieces.vocabulary(MODEL)
    word = pieces.marked("nations")
    raw = {r: v.score[i] for i, r in enumerate(v.raw) if r and np.isfinite(v.score[i])}
    best = -np.inf
    for k in range(len(word)):
        for cuts in itertools.combinations(range(1, len(word)), k):
            parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]
            if all(p in raw for p in parts):
                best = max(best, sum(raw[p] for p in parts))
    ids = np.frombuffer(lattice.viterbi([word], v.trie, v.score, v.unknown, v.byte_ids)[0], np.int32)
    assert abs(v.score[ids].sum() - best) < 1e-9


def test_chat_reads_back(spark):
    hard = "\\### Assistant: </turn> ok <turn:user>\n\\l\\b"
    rows = [(1, 0, "user", hard), (1, 1, "assistant", hard), (1, 2, "assistant", None), (2, 0, "system", "s"), (3, 1, "assistant", "b"), (3, 0, None, "a"), (3, 2, "user", "z")]
    turns = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, example int")
    examples = chat.format_examples(turns)
    assert {(r.conv_id, r.n) for r in examples.groupBy("conv_id").agg(F.count("*").alias("n")).collect()} == {(1, 2), (2, 1), (3, 2)}
    for r in chat.read_back(examples).collect():
        own = sorted(x for x in rows if x[0] == r.conv_id)
        assert r.n_turns == len(own)
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2] or ''}\n{x[3] or ''}\n" for x in own).encode()).hexdigest()
        loss = "".join(x[3] or "" for x in own if x[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert chat.read_back(chat.format_examples(turns.limit(0))).count() == 0


def _vectors(spark):
    rng = np.random.default_rng(4)
    base = rng.standard_normal((30, 16))
    rows = [(i, (base[i % 30] + (0.03 * rng.standard_normal(16) if i >= 30 else 0)).tolist(), i % 3) for i in range(90)]
    rows += [(100, rows[0][1], 0), (101, rows[0][1], 0), (102, None, 0), (103, [0.0] * 16, 0), (104, [float("nan")] * 16, 1), (105, rows[0][1], None), (106, [1.0], 1), (107, [None] * 16, 1)]
    return rows, spark.createDataFrame([(*r, "c") for r in rows], "vec_id long, embedding array<double>, label int, unit string")


def _unit(rows):
    ok = [(i, np.array(v), l) for i, v, l in rows if v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)]
    return [(i, v / np.sqrt(v @ v), l) for i, v, l in ok]


def test_vector_links_against_all_pairs(spark):
    rows, df = _vectors(spark)
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.near_duplicates(df).collect()}
    links = {i: set() for i, _, _ in rows}
    for (a, x, l), (b, y, m) in itertools.combinations([r for r in _unit(rows) if r[2] is not None], 2):
        if l == m and x @ y >= 0.98:
            links[a].add(b), links[b].add(a)
    for i in links:
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j), todo.append(j)
        assert got[i] == (len(links[i]), min(seen), min(seen) == i)
    assert vector_dedup.near_duplicates(df.limit(0)).count() == 0


def test_search_recall(spark):
    e = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows = [(r.vec_id, np.array(r.embedding, float)) for r in e.collect()]
    u = {i: v / np.sqrt(v @ v) for i, v in rows}
    got = ann.search(e).toPandas()
    hit = total = 0
    for q in (i for i in u if i % 50 == 0):
        best = sorted((i for i in u if i != q), key=lambda i: (-(u[q] @ u[i]), i))[:5]
        mine = got[got.query_id == q].sort_values("rank")
        assert (mine["score"].diff().dropna() <= 0).all() and len(mine) == 5
        hit += len(set(best) & set(mine.vec_id))
        total += 5
    assert hit / total >= 0.9
    rows, df = _vectors(spark)
    few = ann.search(df.where("vec_id in (0, 100, 101, 102, 103)")).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(few)] == [(0, 1, 100), (0, 2, 101), (100, 1, 0), (100, 2, 101)]
    assert ann.search(df.limit(0)).count() == 0


def _clustered(seed, n, d=32, near=0.02):
    """Unit vectors around centres, with near pairs; far more than a leaf or a list holds."""
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((60, d))
    x = centres[rng.integers(0, 60, n)] + 0.7 * rng.standard_normal((n, d))
    x[n // 2 : n // 2 + n // 10] = x[: n // 10] * (1 + near * rng.standard_normal((n // 10, d)))
    return x / np.sqrt((x * x).sum(1))[:, None]


@pytest.mark.parametrize("sample", [20_000, 600])
def test_forest_recall_on_many_vectors(spark, monkeypatch, sample):
    """With a small sample the leaves are too large and split on over all their vectors."""
    monkeypatch.setattr(vector_dedup, "SAMPLE", sample)
    x = _clustered(3, 20_000)
    label = np.arange(len(x)) % 2
    label[len(x) // 2 : len(x) // 2 + len(x) // 10] = label[: len(x) // 10]
    df = spark.createDataFrame([(i, v, int(l)) for i, (v, l) in enumerate(zip(x.tolist(), label.tolist()))], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(df).collect()}
    want = np.zeros(len(x), int)
    for l in (0, 1):
        at = np.flatnonzero(label == l)
        for a in range(0, len(at), 1000):
            want[at[a : a + 1000]] = ((x[at[a : a + 1000]] @ x[at].T) >= 0.98).sum(1) - 1
    assert want.sum() > 2000 and all(got[i] <= want[i] for i in range(len(x)))
    assert sum(got.values()) >= 0.95 * want.sum()


@pytest.mark.parametrize("sample, cell, many, most", [(20_000, 16_384, 4, 1), (20_000, 1024, 4, 4), (600, 300, 1, 12)])
def test_vectors_are_shipped_to_few_cells(spark, monkeypatch, sample, cell, many, most):
    """Whole cells, small ones, and ones that are split on and dealt out in blocks: the links, and how often a vector is shipped."""
    for name, value in (("SAMPLE", sample), ("CELL", cell), ("MANY_BLOCKS", many)):
        monkeypatch.setattr(vector_dedup, name, value)
    placed = []
    split_on = vector_dedup.split_on
    monkeypatch.setattr(vector_dedup, "split_on", lambda *a: placed.append(r := split_on(*a)) or placed.append(r.agg(F.avg(F.size("leaves"))).first()[0]) or r)
    x = _clustered(8, 12_000, 64)
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>, label int")
    got = {r.vec_id: r.n_links for r in vector_dedup.near_duplicates(df).collect()}
    want = np.concatenate([((x[a : a + 1000] @ x.T) >= 0.98).sum(1) - 1 for a in range(0, len(x), 1000)])
    assert all(got[i] <= want[i] for i in range(len(x)))
    assert sum(got.values()) >= (0.95 if cell < len(x) else 1) * want.sum() > 1000
    assert placed[-1] <= most


def test_search_recall_on_many_vectors(spark):
    x = _clustered(4, 20_000)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>")
    got = {}
    for r in ann.search(df).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    q = np.arange(0, len(x), 50)
    near = x[q] @ x.T
    near[np.arange(len(q)), q] = -2
    best = np.argpartition(-near, 5, axis=1)[:, :5]
    assert all(len(got[i]) == 5 for i in q.tolist())
    assert np.mean([len(got[i] & set(b)) / 5 for i, b in zip(q.tolist(), best.tolist())]) >= 0.9


def test_vectors_of_other_lengths_and_repeated_ids(spark):
    rows = [(1, [1.0, 0.01], 0), (2, [1.0, 0.0], 0), (3, [1.0, 0.0, 0.0], 0), (4, [0.0, 1.0, 0.0], 0), (5, [0.0, 1.0, 0.05], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert {r.vec_id: (r.n_links, r.component_id) for r in vector_dedup.near_duplicates(df).collect()} == {1: (1, 1), 2: (1, 1), 3: (0, 3), 4: (1, 4), 5: (1, 4)}
    got = {(r.query_id, r.rank): r.vec_id for r in ann.search(df, is_query=F.col("vec_id") <= 3).collect()}
    assert got == {(1, 1): 2, (2, 1): 1, (3, 1): 4, (3, 2): 5}
    rng = np.random.default_rng(6)
    other = rng.standard_normal((398, 16)).tolist()
    rows = [(7, other[0])] * 3000 + [(1000 + i, v) for i, v in enumerate(other)]
    found = ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), is_query=F.col("vec_id") == 1000).collect()
    assert [r.rank for r in sorted(found, key=lambda r: r.rank)] == [1, 2, 3, 4, 5] and min(found, key=lambda r: r.rank).vec_id == 7
    # a group of copies fills no list, and each copy finds the smallest other ids
    copies = [(i, other[1]) for i in range(0, 600)] + [(5000 + i, v) for i, v in enumerate(other)]
    found = ann.search(spark.createDataFrame(copies, "vec_id long, embedding array<double>"), is_query=F.col("vec_id").isin(0, 3, 500, 5002)).collect()
    mine = {q: [r.vec_id for r in sorted(found, key=lambda r: r.rank) if r.query_id == q] for q in (0, 3, 500)}
    assert mine == {0: [1, 2, 3, 4, 5], 3: [0, 1, 2, 4, 5], 500: [0, 1, 2, 3, 4]} and sum(r.query_id == 5002 for r in found) == 5


def test_suffix_array_against_sorting():
    rng = random.Random(5)
    for _ in range(500):
        k, n = rng.choice([1, 2, 3, 10, 1000]), rng.randint(0, 60)
        t = [rng.randint(1, k) for _ in range(n)]
        t = (t[:5] * 20)[:60] if rng.random() < 0.2 else t
        a = suffix_array.suffix_array(t)
        assert a == sorted(range(len(t)), key=lambda i: t[i:])
        for x, h in enumerate(suffix_array.common_prefixes(t, a)):
            p, q = (t[a[x - 1] :], t[a[x] :]) if x else ([], [])
            assert h == next((m for m in range(min(len(p), len(q))) if p[m] != q[m]), min(len(p), len(q)))


@pytest.mark.parametrize("most, levels", [(1024, 4), (2, 4), (2, 1), (2, 0)])
def test_repeats_against_all_strings(spark, most, levels, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "MOST_ROWS", most)
    monkeypatch.setattr(suffix_dedup, "LEVELS", levels)
    rng = random.Random(6)

    def prose(n):
        return "".join(rng.choice("abcdefghij é\n") for _ in range(n))

    shared = [prose(450), prose(399), prose(900)]
    texts = [None, "", prose(300), "ab" * 600] + [prose(rng.randint(0, 500)) + rng.choice(shared) + prose(rng.randint(0, 500)) for _ in range(20)]
    texts += [texts[6], texts[6][:700] + "!" + texts[6][700:], prose(100) + shared[0][:420] + prose(50) + shared[0][30:]]
    df = docs(spark, [(i if i != 2 else None, t, None, None) for i, t in enumerate(texts)])
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for b in raw:
        for p in range(len(b) - 399):
            seen[b[p : p + 400]] = seen.get(b[p : p + 400], 0) + 1
    for r in suffix_dedup.remove_repeats(df, ["doc_id"]).collect():
        b = raw[r.doc_id if r.doc_id is not None else 2]
        gone = suffix_dedup.merged([(p, p) for p in range(len(b) - 399) if seen[b[p : p + 400]] > 1], 400)
        left = b"".join(b[x:y] for x, y in zip([0, *(e for _, e in gone)], [*(a for a, _ in gone), len(b)]))
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(b), len(b) - len(left), len(gone), hashlib.sha256(left).hexdigest())
    assert suffix_dedup.remove_repeats(df.limit(0), ["doc_id"]).count() == 0


@pytest.mark.parametrize("length", [112, 192, 256])
def test_passages_of_other_lengths_against_all_strings(spark, length):
    rng = random.Random(length)

    def prose(n):
        return " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 7))) for _ in range(n))

    shared = [prose(k) for k in (25, 40, 51, 60, 120)]
    texts = [prose(rng.randint(0, 60)) + " " + shared[i % 5] + " " + prose(rng.randint(0, 60)) for i in range(40)]
    raw = [t.encode() for t in texts]
    seen = {}
    for b in raw:
        for p in range(len(b) - length + 1):
            seen[b[p : p + length]] = seen.get(b[p : p + length], 0) + 1
    for r in suffix_dedup.remove_repeats(docs(spark, [(i, t, None, None) for i, t in enumerate(texts)]), ["doc_id"], length, 45).collect():
        b = raw[r.doc_id]
        gone = suffix_dedup.merged([(p, p) for p in range(len(b) - length + 1) if seen[b[p : p + length]] > 1], length)
        gone = [(x, y) for x, y in gone if len(b[x:y].split()) >= 45]
        assert (r.n_removed, r.n_spans) == (sum(y - x for x, y in gone), len(gone))
        assert r.n_spans == (r.doc_id % 5 >= 2)
        assert all(w in r.kept for w in (b[: gone[0][0]].decode(), b[gone[0][1] :].decode())) if gone else r.kept == texts[r.doc_id]


def test_toxicity(spark, real, odd, empty):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    model = toxicity.fit(big, labels, F.lit(True))
    kernel = toxicity.Kernel(model.landmarks)
    score = lambda t: float(model.scores(kernel, [t])[0])
    assert score("the worthless idiot") > score("the thing and that") + 0.2
    assert abs(score("an i-d-i-o-t pathetic") - score("an idiot pathetic")) < 0.4
    none = labels.limit(0)
    assert toxicity.toxicity(odd, none).count() == 7 and toxicity.toxicity(empty, none).count() == 0


def test_toxicity_on_held_out_documents_with_plain_and_gapped_insults(spark):
    rng = random.Random(11)
    syllables = ["tion", "er", "an", "the", "in", "ou", "re", "st", "ble", "ha", "ly", "en"]
    insults = ["idiot", "moron", "pathetic", "worthless", "scum"]

    def sentence():
        return " ".join("".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 14))) + "."

    def gapped(w):
        return rng.choice([w[:2] + "*" + w[2:], "-".join(w), w[:3] + "." + w[3:], w.upper(), w.replace("i", "1").replace("o", "0")])

    rows, labels, kind = [], [], {}
    for i in range(1500):
        text = [sentence() for _ in range(rng.randint(1, 12))]
        toxic = rng.random() < 0.25
        if toxic:
            w = rng.choice(insults)
            kind[i] = rng.random() < 0.5
            at = rng.randrange(len(text))
            words = text[at].split()
            words.insert(rng.randrange(len(words)), gapped(w) if kind[i] else w)
            text[at] = " ".join(words)
        rows.append((i, " ".join(text), "en", "s"))
        labels.append((i, 1, int(toxic)))
    out = toxicity.toxicity(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).where("held_out").collect()
    clean = np.array([r.score for r in out if r.doc_id not in kind])
    for gaps in (False, True):
        bad = np.array([r.score for r in out if kind.get(r.doc_id) is gaps])
        auc = np.mean([(b > clean).mean() + (b == clean).mean() / 2 for b in bad])
        assert len(bad) > 20 and auc >= (0.9 if gaps else 0.97)


def test_string_kernel_against_all_subsequences():
    word, other = "idiot", "id-io.t"
    k = toxicity.Kernel([word])

    def phi(codes, places):
        out = {}
        for i, j, m in itertools.combinations(range(len(codes)), 3):
            s = places[m] - places[i] + 1
            if s <= toxicity.SPAN:
                out[codes[i], codes[j], codes[m]] = out.get((codes[i], codes[j], codes[m]), 0) + toxicity.LAMBDA**s
        return out

    a, b = (phi(*toxicity.letters(w)[0]) for w in (word, other))
    want = sum(v * b.get(u, 0) for u, v in a.items()) / (sum(v * v for v in a.values()) * sum(v * v for v in b.values())) ** 0.5
    assert abs(float(k.values([other])[0][0]) - want**toxicity.POWER) < 1e-5


def _brute_components(rows, k, percent):
    sets = {}
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.setdefault(i, set()).update({tuple(w[j : j + k]) for j in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def test_join_against_all_pairs(spark, odd, empty):
    rng = random.Random(7)
    base = [[f"w{rng.randint(0, 400)}" for _ in range(rng.randint(3, 120))] for _ in range(12)]
    rows = [(0, None), (1, ""), (2, "One TWO three"), (3, "one two three")]
    for i in range(4, 160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(len(w))] = f"n{rng.randint(0, 9999)}"
        rows.append((i, " ".join(w) + (" the same common line that stands in every one of these documents" if i % 2 else "")))
    for k, percent in ((4, 85), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_join(docs(spark, [(i, t, None, None) for i, t in rows]), k, percent).collect()}
        assert got == _brute_components(rows, k, percent)
    out = ngram_join.jaccard_join(odd, 4, 85).collect()
    assert len(out) == 7 and {r.component_id for r in out if r.doc_id is None} == {None}
    assert ngram_join.jaccard_join(empty, 4, 85).count() == 0


@pytest.mark.parametrize("block, k, percent", [(128, 3, 50), (2, 4, 85)])
def test_join_of_groups_hot_lists_and_repeated_ids(spark, monkeypatch, block, k, percent):
    monkeypatch.setattr(ngram_join, "LIST_BLOCK", block)
    monkeypatch.setattr(ngram_join, "PAIRS_BLOCK", block)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    # many sets of one size that share rare beginnings, some of which link and some don't
    rows = [(i, " ".join(base[:40] + [f"x{rng.randint(0, 3)}_{j}" for j in range(rng.choice([2, 6, 20]))])) for i in range(60)]
    rows += [(i, " ".join(base + [f"y{i}"])) for i in range(60, 90)]
    a, b = "some text of ten words that stands here all alone", "another one of nine words which is not alike"
    rows += [(105, a), (105, b), (103, b), (109, a), (110, a + " x y z u v w"), (105, a + " x y z u v w")]
    out = ngram_join.jaccard_join(docs(spark, [(i, t, None, None) for i, t in rows]), k, percent).collect()
    assert len(out) == len(rows)
    got, want = {}, _brute_components([(1000 + j, t) for j, (_, t) in enumerate(rows)], k, percent)
    for r in out:
        got.setdefault(r.doc_id, set()).add(r.component_id)
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for j, (i, _) in enumerate(rows):
        p, q = sorted((find(i), find(rows[want[1000 + j][1] - 1000][0])))
        parent[q] = p
    assert got == {i: {find(i)} for i in parent}


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(60)] + [(100, 101), (101, 102), (7, 7)]
    got = {r.id: r.component for r in connected(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, 100: 100, 101: 100, 102: 100}


def test_pipeline_stages(spark, real):
    import corpus_pipeline as p

    docs_ = real
    for name, stage in p.STAGES:
        before, docs_ = docs_, p.put(stage(spark, docs_, SF), p.work_dir(spark, "test"))
        ids = {r.doc_id for r in docs_.select("doc_id").collect()}
        assert ids <= {r.doc_id for r in before.select("doc_id").collect()}
        if name != p.STAGES[-1][0]:
            assert docs_.columns == p.COLUMNS
        if name == "n-gram Jaccard join":
            want = _brute_components([(r.doc_id, r.text) for r in before.collect()], 5, 80)
            assert ids == {i for i, (_, c) in want.items() if i == c}
    v = pieces.vocabulary(MODEL)
    texts = {r.doc_id: r.text for r in before.collect()}
    assert all(pieces.decode_ids(r.ids, v.raw) == texts[r.doc_id] for r in docs_.collect())


def test_too_many_languages_are_refused(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    with pytest.raises(ValueError, match="languages"):
        langid.identify(docs(spark, [(i, "abc", f"l{i}", None) for i in range(1, 8)]), MODEL)


def test_null_ids_and_very_long_texts(spark, odd):
    long = " ".join(f"word{i}" for i in range(200_000))
    df = docs(spark, [(None, "a b c", "en", "s"), (None, "a b c", "en", "s"), (1, long, "en", "s"), (2, long, "de", None)])
    labels = spark.createDataFrame([(1, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    assert sorted(r.n_bytes for r in token_counts.count_tokens(df, MODEL).collect()) == [5, 5, len(long), len(long)]
    assert [r.size for r in pieces.encode(df, MODEL, ["doc_id"]).select(F.size("ids").alias("size")).where("size < 9").collect()] != []
    assert {r.held_out for r in langid.identify(df, MODEL).where("doc_id is null").collect()} == {True}
    assert {r.held_out for r in toxicity.toxicity(df, labels).where("doc_id is null").collect()} == {True}
    kept = {r.doc_id: (r.n_removed, r.n_bytes) for r in suffix_dedup.remove_repeats(df, ["doc_id"]).where("doc_id is not null").collect()}
    assert kept == {1: (len(long), len(long)), 2: (len(long), len(long))}
    turns = spark.createDataFrame([(None, 0, "user", "x" * 100_000), (None, 1, "assistant", "y")], "conv_id long, turn long, role string, text string")
    assert [(r.conv_id, r.n_turns, r.loss_chars) for r in chat.read_back(chat.format_examples(turns)).collect()] == [(None, 2, 1)]


def test_queries_read_whole_tables(spark):
    from shelfmark.llm.queries import QUERIES

    ids = {name: sorted(r[0] for r in spark.read.parquet(f"{SF}/{name}.parquet").select(key).distinct().collect()) for name, key in (("documents", "doc_id"), ("embeddings", "vec_id"), ("conversations", "conv_id"))}
    whole = {f"op{n}": ("documents", "doc_id") for n in (1, 2, 3, 4, 7, 8, 10)} | {"op5": ("conversations", "conv_id"), "op6": ("embeddings", "vec_id")}
    for name, query in QUERIES.items():
        op = name.split("_")[0]
        if op == "op9":
            want, key = [i for i in ids["embeddings"] if i % 50 == 0], "query_id"
        else:
            table, key = whole[op]
            want = sorted({-7, *ids[table]}) if op == "op5" else ids[table]
        assert sorted({r[0] for r in query(spark, SF).select(key).collect()}) == want
