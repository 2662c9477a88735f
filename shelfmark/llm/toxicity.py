"""Toxicity by a subsequence string kernel, Nystroem landmarks and a support vector machine.

Sentences are compared by a convolution kernel over their tokens: the sum over all pairs of tokens of k(a, b) ** POWER,
divided by the square roots of both sentences' numbers of tokens. k counts the gapped subsequences of three letters
that two tokens share, each by LAMBDA to the power of the lengths that it spans, over spans of at most SPAN places, and
is normalised; sums, products and scalings of kernels are kernels. So an insult with characters put in (i-d-i.o-t,
id*iot) stays near the plain one. Letters are folded (case, and common stand-ins such as 1 for i); other characters only
widen the gaps. A run of single characters (i d i o t) is a token too, and a token of more than WINDOW letters is taken
in overlapping windows. Values of k under FLOOR (0.04 after the power) are taken as 0, which lets most tokens be
passed over by one cheaper sum.

Landmarks are sentences of one token, tokens and beginnings of tokens from a bounded sample of labelled documents, by
how far their documents' labels are from the sample's share of either label (the G statistic, at least 2 ln of the
number of tokens: chance alone brings about one of them so far). The Nystroem map of a sentence's
kernel values with them feeds a linear SVM (squared hinge). Labels are those of documents, so training goes over
sentences in turns: all sentences of documents that aren't toxic are negative, and of each toxic document the one
sentence that the last turn finds most toxic is positive (the first turn takes all of them). A document's value is that
of its most toxic sentence; a logistic curve turns it into a score. Every whole text is scored; a stretch of over
SENTENCE tokens without an end of sentence is cut. Workers remember tokens.

Cases: null and empty texts have no tokens and get the score of similarity 0; without toxic labels to learn from the
score is the smoothed share of toxic labels; a doc_id that is labelled twice counts as toxic if one label is; rows with
a null doc_id never teach and count as held out; repeated rows give a row each; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import learns, put, text_chunks, work_dir

LAMBDA, SPAN, WINDOW = 0.8, 8, 20
LANDMARKS, CANDIDATES, FLOOR, POWER, LEAST_DOCS = 48, 4000, 0.45, 4, 3
#: Labelled documents that teach at most, unless the caller says otherwise.
SAMPLE = 12_000
#: Tokens of a sentence at most, and turns of training.
SENTENCE, TURNS = 40, 5
#: Lengths of beginnings that may be landmarks.
STEMS = range(4, 9)
MEMO_TOKENS, MEMO_ROWS, MEMO_LENGTH = 400_000, 60_000, 64

_STAND_INS = str.maketrans("013457@$!|", "oieastasii")
_EDGES = "!|.,;:?\"'()[]{}*#&%$@"
_SPACED = re.compile(r"(?<!\S)(?:\S\s+){3,}\S(?!\S)")
_ENDS = re.compile(r"(?<=[.?!])\s+|\n+")
_ALPHABET = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyzäöüßéèêëàâçîïôûùñáíóú")}
_CODES = len(_ALPHABET) + 1  # one code for all other letters
_DECAY = np.array([0.0, 0.0, 0.0, *(LAMBDA**s for s in range(3, SPAN + 1))])


def tokens(text: str) -> set[str]:
    """Distinct lower-case tokens: runs without white space, and runs of single characters put together."""
    text = text.lower()
    out = set(text.split())
    for m in _SPACED.finditer(text):
        out.add("".join(m.group().split()))
    return out


def sentences(text: str) -> list[list[str]]:
    """Lower-case tokens by sentence; a sentence ends at . ? or ! before white space, at a new line, or after SENTENCE tokens."""
    text = text.lower()
    spaced = _SPACED.search(text) is not None
    out = []
    for part in _ENDS.split(text):
        words = part.split()
        if spaced:
            words += ["".join(m.group().split()) for m in _SPACED.finditer(part)]
        out += [words[a : a + SENTENCE] for a in range(0, len(words), SENTENCE)]
    return out


def letters(token: str) -> list[tuple[list[int], list[int]]]:
    """Windows of a token as letter codes and their places; stand-ins are letters only beside real ones."""
    if any(c.isalpha() for c in token):
        token = token.strip(_EDGES).translate(_STAND_INS)
    codes, places = [], []
    for i, c in enumerate(token):
        code = _ALPHABET.get(c)
        if code is not None or c.isalpha():
            codes.append(_CODES - 1 if code is None else code)
            places.append(i)
    if len(codes) <= WINDOW:
        return [(codes, places)] if len(codes) >= 3 else []
    return [(codes[a : a + WINDOW], places[a : a + WINDOW]) for a in range(0, len(codes) - WINDOW // 2, WINDOW // 2)]


def triples(codes: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Three-letter subsequences of tokens of one length: numbers and weights, a row per token."""
    n = codes.shape[1]
    index = [(i, j, k) for i in range(n) for j in range(i + 1, min(n, i + SPAN)) for k in range(j + 1, min(n, i + SPAN))]
    i, j, k = np.array(index).T
    number = (codes[:, i].astype(np.int64) * _CODES + codes[:, j]) * _CODES + codes[:, k]
    span = places[:, k] - places[:, i] + 1
    return number, np.where(span <= SPAN, _DECAY[np.minimum(span, SPAN)], 0.0)


def norms(number: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Square roots of the kernel of each token with itself; a subsequence that comes twice adds up first."""
    order = np.argsort(number, axis=1)
    v, w = np.take_along_axis(number, order, 1), np.take_along_axis(weight, order, 1)
    rows = np.arange(len(v))[:, None] * np.int64(_CODES**3) + v
    flat, at = np.unique(rows.ravel(), return_inverse=True)
    sums = np.bincount(at, w.ravel())
    return np.sqrt(np.maximum(np.bincount((flat // _CODES**3).astype(np.int64), sums**2, len(v)), 1e-12))


class Kernel:
    """Kernel values of tokens against landmarks."""

    def __init__(self, landmarks: list[str]) -> None:
        self.landmarks = landmarks
        self.table = np.zeros((_CODES**3, max(1, len(landmarks))), np.float32)
        for m, t in enumerate(landmarks):
            codes, places = letters(t)[0]
            number, weight = triples(np.array([codes]), np.array([places]))
            np.add.at(self.table[:, m], number[0], weight[0] / norms(number, weight)[0])
        self.largest = self.table.max(1)
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.weighed: tuple[np.ndarray, list[float]] | None = None

    def values(self, words: list[str]) -> list[np.ndarray | None]:
        """For each token its values, those under FLOOR as 0; None where all are."""
        out: list[np.ndarray | None] = [None] * len(words)
        by: dict[int, list[tuple[int, list[int], list[int]]]] = {}
        for w, token in enumerate(words):
            for codes, places in letters(token):
                by.setdefault(len(codes), []).append((w, codes, places))
        for group in by.values():
            for a in range(0, len(group), 4096):
                part = group[a : a + 4096]
                number, weight = triples(np.array([c for _, c, _ in part]), np.array([p for _, _, p in part]))
                bound = (weight * self.largest[number]).sum(1) / np.sqrt(np.maximum((weight**2).sum(1), 1e-12))
                on = np.flatnonzero(bound >= FLOOR)
                for b in range(0, len(on), 256):
                    some = on[b : b + 256]
                    value = np.einsum("bt,btm->bm", weight[some].astype(np.float32), self.table[number[some]]) / norms(number[some], weight[some])[:, None].astype(np.float32)
                    value = np.where(value < FLOOR, 0, value**POWER)
                    for i in np.flatnonzero(value.any(1)).tolist():
                        w = part[some[i]][0]
                        out[w] = value[i] if out[w] is None else np.maximum(out[w], value[i])
        return out

    def learn(self, words: set[str]) -> list[str]:
        """Makes sure that all words have a place, and returns those that are new: too many are forgotten first."""
        if len(self.place) > MEMO_TOKENS or len(self.rows) > MEMO_ROWS:
            self.clear()
        new = [w for w in words if w not in self.place]
        for w, v in zip(new, self.values(new), strict=True):
            self.place[w] = -1 if v is None else len(self.rows)
            if v is not None:
                self.rows.append(v)
        return new

    def forget(self, words: list[str]) -> None:
        for w in words:
            if len(w) > MEMO_LENGTH:
                del self.place[w]

    def sentence_rows(self, texts: list[str]) -> list[np.ndarray]:
        """For each text the kernel values of its sentences with the landmarks, a row each; sentences without any are one row of zeros."""
        split = [sentences(x) if x else [] for x in texts]
        new = self.learn({w for s in split for words in s for w in words})
        out = []
        for s in split:
            rows = [np.zeros(len(self.landmarks), np.float32)]
            for words in s:
                hits = [p for p in map(self.place.__getitem__, words) if p >= 0]
                if hits:
                    rows.append(np.sum([self.rows[p] for p in hits], axis=0) / np.float32(len(words) ** 0.5))
            out.append(np.unique(np.array(rows, np.float32), axis=0))
        self.forget(new)
        return out

    def most(self, texts: list[str], w: np.ndarray) -> np.ndarray:
        """For each text the largest value of its sentences under weights w of the landmarks; 0 without a token."""
        split = [sentences(x) if x else [] for x in texts]
        new = self.learn({t for s in split for words in s for t in words})
        if self.weighed is None or self.weighed[0] is not w or len(self.weighed[1]) != len(self.rows):
            done = self.weighed[1] if self.weighed is not None and self.weighed[0] is w and len(self.weighed[1]) <= len(self.rows) else []
            self.weighed = (w, done + [float(r @ w) for r in self.rows[len(done) :]])
        value = self.weighed[1]
        out = np.zeros(len(texts))
        for i, s in enumerate(split):
            best = None
            for words in s:
                hits = [value[p] for p in map(self.place.__getitem__, words) if p >= 0]
                v = sum(hits) / len(words) ** 0.5
                best = v if best is None or v > best else best
            out[i] = best or 0.0
        self.forget(new)
        return out


def choose_landmarks(rows: list[tuple[str, float]], most: int = LANDMARKS) -> list[str]:
    """Tokens in the order of their statistic (ties: by token); near-equal ones once."""
    chosen: list[str] = []
    kernel: Kernel | None = None
    for token, _ in sorted(rows, key=lambda r: (-r[1], r[0])):
        if len(chosen) == most:
            break
        if len(letters(token)) != 1:
            continue
        if kernel is not None:
            v = kernel.values([token])[0]
            if v is not None and v.max() > FLOOR**POWER:
                continue
        chosen.append(token)
        kernel = Kernel(chosen)
    return chosen


class Model:
    """Nystroem map, SVM and score curve. w: weights of the kernel values with the landmarks."""

    def __init__(self, landmarks: list[str], rows: np.ndarray, owner: np.ndarray, y: np.ndarray) -> None:
        """rows: sentences; owner: each one's document; y: 1 for toxic documents."""
        self.landmarks = landmarks
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.curve = (0.0, float(np.log(share / (1 - share))))
        self.w, self.b = np.zeros(max(1, len(landmarks))), 0.0
        if not landmarks or y.min() == y.max():
            return
        kernel = Kernel(landmarks)
        own = np.array([v if v is not None else np.zeros(len(landmarks)) for v in kernel.values(landmarks)], float)
        value, vector = np.linalg.eigh((own + own.T) / 2)
        ok = value > 1e-6
        root = (vector[:, ok] / np.sqrt(value[ok])) @ vector[:, ok].T
        toxic = y[owner] > 0
        on = np.ones(len(rows), bool)
        for _ in range(TURNS):
            self.w, self.b = _svm(rows, root, np.where(toxic, 1.0, -1.0), on)
            f = rows @ self.w.astype(np.float32)
            best = np.lexsort((np.arange(len(f)), f, owner))
            last = best[np.append(owner[best][1:] != owner[best][:-1], True)]  # of each document its most toxic sentence
            new = ~toxic
            new[last] = True
            if (new == on).all():
                break
            on = new
        top = np.full(len(y), -np.inf)
        np.maximum.at(top, owner, rows @ self.w.astype(np.float32))
        self.curve = _logistic(top + self.b, y)

    def scores(self, kernel: Kernel, texts: list[str]) -> np.ndarray:
        a, c = self.curve
        return 1 / (1 + np.exp(-np.clip(a * (kernel.most(texts, self.w) + self.b) + c, -40, 40)))


def _svm(x: np.ndarray, root: np.ndarray, y: np.ndarray, on: np.ndarray, cost: float = 1.0, rounds: int = 30, block: int = 16_384) -> tuple[np.ndarray, float]:
    """L2-regularised squared-hinge SVM on rows `on` of x @ root, by Newton steps; classes weigh alike, the intercept isn't penalised.

    Sums go over blocks of rows, so that nothing but x itself is held in full.
    """
    weight = cost * np.where(y > 0, 0.5 / max(1, (on & (y > 0)).sum()), 0.5 / max(1, (on & (y < 0)).sum())) * on.sum()
    m = x.shape[1]
    lift = np.zeros((m + 1, root.shape[1] + 1))
    lift[:m, :-1], lift[m, -1] = root, 1.0
    ridge = np.diag([*np.ones(root.shape[1]), 1e-9])
    w = np.zeros(root.shape[1] + 1)
    for _ in range(rounds):
        full = lift @ w
        miss = 1 - y * (x @ full[:m].astype(np.float32) + full[m])
        at = np.flatnonzero((miss > 0) & on)
        square, pull = np.zeros((m + 1, m + 1)), np.zeros(m + 1)
        for i in range(0, len(at), block):
            some = at[i : i + block]
            rows = np.concatenate([x[some].astype(float), np.ones((len(some), 1))], 1)
            square += (rows * weight[some, None]).T @ rows
            pull += rows.T @ (weight[some] * y[some] * miss[some])
        grad = ridge @ w - 2 * lift.T @ pull
        step = np.linalg.solve(ridge + 2 * lift.T @ square @ lift + 1e-9 * np.eye(len(w)), grad)
        w = w - step
        if np.abs(step).max() < 1e-6:
            break
    return root @ w[:-1], float(w[-1])


def _logistic(f: np.ndarray, y: np.ndarray, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of the score curve, with smoothed labels; classes weigh alike, a small penalty keeps the slope finite."""
    n1, n0 = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a = np.stack([f, np.ones(len(f))], 1)
    alike = np.where(y > 0, 0.5 / max(1, n1), 0.5 / max(1, n0)) * len(y)
    w = np.array([1.0, 0.0])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve((a * (alike * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2), a.T @ (alike * (p - t)) + 1e-3 * w)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-6:
            break
    return float(w[0]), float(w[1])


_kernels: dict[tuple[str, ...], Kernel] = {}


def _kernel(landmarks: list[str]) -> Kernel:
    """The kernel of these landmarks in this process, with the tokens that earlier tasks left in its memo."""
    name = tuple(landmarks)
    if name not in _kernels:
        _kernels.clear()
        _kernels[name] = Kernel(landmarks)
    return _kernels[name]


def fit(docs: DataFrame, labels: DataFrame, teaches: Column, sample: int = SAMPLE) -> Model:
    """A model of labels.toxic from rows where teaches (a condition on doc_id) holds; at most about sample of them, the same ones each time."""
    spark = docs.sparkSession
    known = labels.where(F.col("toxic").isNotNull() & teaches).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").cast("int").alias("toxic"))
    share = min(1.0, sample / max(1, known.count()))
    some = known.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1 << 30)) < int(share * (1 << 30)))
    # about `sample` rows of 12 bytes, whatever the input
    taught = docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(some), "doc_id")
    taught = put(taught.select(F.xxhash64("doc_id", "text").alias("key"), "toxic", "text"), work_dir(spark, "toxicity-sample"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in text_chunks(batches, "text"):
            seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
            for x, toxic in zip(texts, part.column("toxic").to_pylist(), strict=True):
                words = {w for w in (t.strip(_EDGES) for t in tokens(x)) if 3 <= len(w) <= MEMO_LENGTH}
                seen[toxic == 1].update(words | {w[:n] for w in words for n in STEMS if len(w) > n})
            for toxic, c in seen.items():
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.string()), pa.array([toxic] * len(c), pa.int32()), pa.array(list(c.values()), pa.int64())], ["token", "toxic", "n"])

    counts = {r["toxic"]: r["count"] for r in taught.groupBy("toxic").count().collect()}
    n1, n0 = counts.get(1, 0), sum(n for t, n in counts.items() if t != 1)
    by = taught.mapInArrow(split, "token string, toxic int, n long").groupBy("token").agg(F.sum(F.when(F.col("toxic") == 1, F.col("n")).otherwise(0)).alias("t"), F.sum("n").alias("n")).where(F.col("n") >= LEAST_DOCS)
    by = put(by, work_dir(spark, "toxicity-tokens"))
    least_g = 2 * float(np.log(max(2, by.count())))
    # G of the table (token there or not) x (toxic or not), the larger the further from independence, either way
    t, c = F.col("t"), F.col("n") - F.col("t")
    share1, share0 = max(1, n1) / max(1, n1 + n0), max(1, n0) / max(1, n1 + n0)
    cells = [(t, F.col("n") * share1), (c, F.col("n") * share0), (n1 - t, (n1 + n0 - F.col("n")) * share1), (n0 - c, (n1 + n0 - F.col("n")) * share0)]
    g = sum((F.when((o > 0) & (e > 0), 2 * o * F.log(o / e)).otherwise(0.0) for o, e in cells), F.lit(0.0))
    top = by.select("token", F.round(g, 6).alias("g")).where(F.col("g") >= least_g).orderBy(F.desc("g"), "token").limit(CANDIDATES).collect()
    chosen = choose_landmarks([(r["token"], r["g"]) for r in top])

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kernel = _kernel(chosen)
        for part, texts in text_chunks(batches, "text"):
            rows = kernel.sentence_rows(texts)
            at = pa.array(np.repeat(np.arange(len(rows)), [len(r) for r in rows]))
            flat = np.concatenate(rows) if rows else np.zeros((0, len(chosen)), np.float32)
            x = pa.FixedSizeListArray.from_arrays(pa.array(flat.ravel()), max(1, len(chosen))).cast(pa.list_(pa.float32())) if len(chosen) else pa.array([[]] * len(flat), pa.list_(pa.float32()))
            yield pa.RecordBatch.from_arrays([part.column("key").take(at), part.column("toxic").take(at), x], ["key", "toxic", "x"])

    got = taught.mapInArrow(features, "key long, toxic int, x array<float>").toArrow()
    if not len(got) or not chosen:
        return Model([], np.zeros((0, 1)), np.zeros(0, int), np.repeat([1.0, 0.0], [n1, n0]) if n1 + n0 else np.zeros(1))
    x = got.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(got), -1)
    key, toxic = got.column("key").to_numpy(), (got.column("toxic").to_numpy() == 1).astype(float)
    mark = np.zeros(len(x))
    for j, r in enumerate(np.random.default_rng(1).random(x.shape[1])):
        mark += x[:, j] * r
    order = np.lexsort((mark, toxic, key))  # one order, however the rows came
    _, first, owner = np.unique(np.stack([key[order], toxic[order].astype(np.int64)], 1), axis=0, return_index=True, return_inverse=True)
    return Model(chosen, x[order], owner.ravel(), toxic[order][first])


def toxicity(docs: DataFrame, labels: DataFrame, held: tuple[int, int] = (4, 2), threshold: float = 0.3, sample: int = SAMPLE) -> DataFrame:
    """Per row of docs: doc_id, held_out, score, predicted.

    held: documents whose crc32 of doc_id as text, modulo the first number, is the second don't teach.
    """
    model = fit(docs, labels, learns(F.col("doc_id"), *held), sample)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        kernel = _kernel(m.landmarks)
        for part, texts in text_chunks(batches, "text"):
            score = m.scores(kernel, texts)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", (~learns(F.col("doc_id"), *held)).alias("held_out"), "text").mapInArrow(run, f"doc_id {kind}, held_out boolean, score double, predicted int")
