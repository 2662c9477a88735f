"""Language identification with segmentation-marginalised unigrams.

Each language has probabilities of the pieces of a fixed public vocabulary, from counts over all teaching texts (each
word cut by the vocabulary's own best segmentation), smoothed towards the pieces' counts over all languages. A text's
log-likelihood under a language sums, word by word, the log of the total probability of all segmentations of the
word: a forward pass over the lattice of its pieces, characters without a piece by their bytes. Texts are lower-cased.
The prediction is the likeliest language, its score the posterior probability under equal priors.

The counts gathered are languages x pieces at most, whatever the input; so is the broadcast model.

More than LANGUAGES learned languages are refused by an error, as the model would outgrow the driver.

Cases: a null text, or one without a letter, is und with score 0, as is every text where nothing was learned; rows
with a null doc_id or null lang never teach, and the former count as held out; a very long text is scored whole; ties go
to the first language by code point; repeated rows give a row each and teach twice; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import learns, put, remembered, text_chunks, work_dir
from .lattice import forward
from .pieces import Vocabulary, encoder_of, forget, marked, parts, vocabulary

UNKNOWN = "und"
#: Pseudo-counts of the smoothing distribution, and the share of it that is uniform.
ALPHA, UNIFORM = 2000.0, 0.01
#: Languages that a model may have; 8 bytes for each and each piece.
LANGUAGES = 1000
MEMO_WORDS, MEMO_LENGTH = 400_000, 64


def count_pieces(docs: DataFrame, model_path: str, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """lang, piece, n over all rows of docs."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = shared.value
        encoder = encoder_of(model_path, v)
        totals: dict[str, np.ndarray] = {}
        for part, texts in text_chunks(batches, "text"):
            words: dict[str, Counter] = {}
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                if text:
                    words.setdefault(lang, Counter()).update(parts(text.lower()))
            for lang, c in words.items():
                memo = encoder.learn(set(c))
                cut = [memo[w] for w in c]
                ids = np.frombuffer(b"".join(cut), np.int32)
                n = np.repeat(np.fromiter(c.values(), np.float64, len(c)), [len(x) // 4 for x in cut])
                totals[lang] = totals.get(lang, 0) + np.bincount(ids, n, v.size)
                for w in c:
                    if len(w) > MEMO_LENGTH:
                        del memo[w]
        for lang, t in totals.items():
            on = np.flatnonzero(t)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(on), pa.string()), pa.array(on.astype(np.int32)), pa.array(t[on].astype(np.int64))], ["lang", "piece", "n"])

    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, piece int, n long").groupBy("lang", "piece").agg(F.sum("n").alias("n"))


def fit(docs: DataFrame, model_path: str, lang_col: str = "lang", text_col: str = "text") -> tuple[list[str], np.ndarray]:
    """Languages by code point and log probabilities, pieces x languages."""
    v = vocabulary(model_path)
    by = put(count_pieces(docs, model_path, lang_col, text_col), work_dir(docs.sparkSession, "language-pieces"))
    if by.select("lang").distinct().limit(LANGUAGES + 1).count() > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} languages to learn")
    found = by.orderBy("lang", "piece").toArrow()
    names = found.column("lang").to_pylist()
    langs = sorted(set(names))
    counts = np.zeros((v.size, len(langs)))
    if langs:
        counts[found.column("piece").to_numpy(), [langs.index(x) for x in names]] = found.column("n").to_numpy()
    usable = np.array([bool(r) for r in v.raw])
    all_ = counts.sum(1) + 1e-9
    base = ((1 - UNIFORM) * all_ / all_.sum() + UNIFORM / usable.sum())[:, None] * usable[:, None]
    p = (counts + ALPHA * base) / (counts.sum(0) + ALPHA)
    return langs, np.log(np.maximum(p, 1e-300))


class Scorer:
    """Log-likelihoods of texts; remembers words."""

    def __init__(self, v: Vocabulary, logp: np.ndarray) -> None:
        self.v, self.logp = v, logp
        self.clear()

    def clear(self) -> None:
        self.place: dict[str, int] = {}
        self.rows = np.zeros((1024, self.logp.shape[1]))

    def likelihoods(self, texts: list[str]) -> np.ndarray:
        counts = [Counter(parts(x.lower())) if x else Counter() for x in texts]
        words = set().union(*counts)
        if len(self.place) > MEMO_WORDS:
            self.clear()
        new = [w for w in words if w not in self.place]
        at = len(self.place)
        need = at + len(new)
        if need > len(self.rows):
            self.rows = np.concatenate([self.rows, np.zeros((max(need - len(self.rows), len(self.rows)), self.logp.shape[1]))])
        for a in range(0, len(new), 10_000):
            some = new[a : a + 10_000]
            self.rows[at + a : at + a + len(some)] = forward([marked(w) for w in some], self.v.trie, self.logp, self.v.byte_ids)
        self.place.update(zip(new, range(at, need), strict=True))
        out = np.zeros((len(texts), self.logp.shape[1]))
        for i, c in enumerate(counts):
            if c:
                out[i] = np.fromiter(c.values(), np.float64, len(c)) @ self.rows[np.fromiter(map(self.place.__getitem__, c), np.int64, len(c))]
        if any(len(w) > MEMO_LENGTH for w in new):
            self.clear()
        return out


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


_scorers: dict[int, Scorer] = remembered()


def identify(docs: DataFrame, model_path: str, held_out: Column | None = None, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Columns keep of docs (doc_id by default), held_out, lang_pred, score.

    held_out: rows that don't teach; by default those where crc32 of doc_id as text, modulo 5, is 0. Their language,
    source and id are never inputs of a prediction.
    """
    keep = keep or [id_col]
    held = held_out if held_out is not None else ~learns(F.col(id_col), 5, 0)
    langs, logp = fit(docs.where(~held), model_path, lang_col, text_col)
    fields = [*docs.select(*keep).schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary(model_path), langs, logp))
    token = hash(logp.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, names, p = shared.value
        if token not in _scorers:
            _scorers.clear()
            forget()
            _scorers[token] = Scorer(v, p)
        for part, texts in text_chunks(batches, "__text"):
            texts = [x if names and has_letter(x) else "" for x in texts]
            like = _scorers[token].likelihoods(texts) if names else np.zeros((len(texts), 1))
            like -= like.max(1)[:, None]
            post = np.exp(like)
            best = post.argmax(1)
            top = 1 / post.sum(1)
            pred = [names[b] if x else UNKNOWN for x, b in zip(texts, best.tolist(), strict=True)]
            score = np.where([bool(x) for x in texts], top, 0.0)
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), part.column("__held"), pa.array(pred, pa.string()), pa.array(score)], [*(f.name for f in fields), "held_out", "lang_pred", "score"])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), "held_out boolean, lang_pred string, score double"])
    return docs.select(*keep, held.alias("__held"), F.col(text_col).alias("__text")).mapInArrow(run, schema)


