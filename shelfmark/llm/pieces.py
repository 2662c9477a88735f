"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

The vocabulary is a public sentencepiece file. Where its own scores are merge ranks (a BPE file), the log score of a
piece follows from its rank r by Zipf's rule, -log(r + 1) less a constant; a unigram file's scores are taken as they
are. A space becomes the marker, one more marker stands before the text, and a character without a piece is written
as the pieces of its UTF-8 bytes, at sentencepiece's penalty of 10 below the lowest score. decode() undoes all of it,
for any text: a marker character that stands in a text goes by its bytes.

No piece of such a vocabulary goes on past the end of a word, so the best segmentation of a text is that of its
words; a worker remembers words. With another vocabulary the whole text is one lattice.

Cases: null and empty texts have no pieces and decode to the empty text; a very long text is encoded whole, its words
are remembered for no longer than it; rows with a null doc_id are rows like any other; of equally good segmentations
the same one is found each time; repeated rows give a row each; an empty
table gives an empty result; columns of the input are kept as told by the caller.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import remembered, text_chunks, text_of
from .lattice import DoubleArray, as_bytes, viterbi

PENALTY = 10.0
MEMO_WORDS, MEMO_LENGTH = 300_000, 64


def parts(text: str) -> list[str]:
    """Words, each without the one space that its marker stands for; further spaces stay in front of the word."""
    if "  " not in text and text[:1] != " " and text[-1:] != " ":
        return text.split(" ")
    first, *rest = re.findall(r"^ *[^ ]*| +[^ ]*", text) or [""]
    return [first, *(x[1:] for x in rest)]


def marked(part: str) -> bytes:
    return b"\xff" + part.encode().replace(b" ", b"\xff")


class Vocabulary:
    """Pieces, log scores and trie of a sentencepiece file."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.size = size
        self.byte_ids = np.full(256, -1, np.int32)
        self.raw: list[bytes] = [b""] * size
        normal = []
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                b = int(piece[3:5], 16)
                self.byte_ids[b], self.raw[i] = i, bytes([b])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                self.raw[i] = as_bytes(piece)
                normal.append(i)
        given = np.array([model.get_score(i) for i in range(size)])
        ranks = given[normal]
        self.score = np.full(size, -np.inf)
        if len(normal) and (ranks[ranks > -1e6] == np.round(ranks[ranks > -1e6])).all():
            self.score[normal] = -np.log(np.arange(1, len(normal) + 1)) - np.log(np.sum(1 / np.arange(1, len(normal) + 1)))
        else:
            self.score[normal] = given[normal]
        self.unknown = float(self.score[normal].min()) - PENALTY
        self.by_word = not any(b"\xff" in self.raw[i].lstrip(b"\xff") for i in normal)
        self.trie = DoubleArray.build([(self.raw[i], i) for i in normal])
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary has no byte pieces")


_loaded: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file; a process loads it once."""
    if path not in _loaded:
        _loaded[path] = Vocabulary(path)
    return _loaded[path]


class Encoder:
    """Encodes texts word by word and remembers words."""

    def __init__(self, v: Vocabulary) -> None:
        self.v = v
        self.memo: dict[str, bytes] = {}

    def words(self, words: list[str]) -> list[bytes]:
        return viterbi([marked(w) for w in words], self.v.trie, self.v.score, self.v.unknown, self.v.byte_ids)

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Makes sure that all words are in the memo, and returns it."""
        if len(self.memo) > MEMO_WORDS:
            self.memo = {}
        new = [w for w in words if w not in self.memo]
        for a in range(0, len(new), 20_000):
            self.memo.update(zip(new[a : a + 20_000], self.words(new[a : a + 20_000]), strict=True))
        return self.memo

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        split = [(parts(x) if self.v.by_word else [x]) if x else [] for x in texts]
        words = set().union(*split)
        memo = self.learn(words)
        out = [np.frombuffer(b"".join(map(memo.__getitem__, p)), np.int32) for p in split]
        for w in words:
            if len(w) > MEMO_LENGTH:
                del memo[w]
        return out


_encoders: dict[str, Encoder] = remembered()


def encoder_of(name: str, v: Vocabulary) -> Encoder:
    """The encoder of a vocabulary in this process, with the words that earlier tasks left in its memo."""
    if name not in _encoders:
        _encoders[name] = Encoder(v)
    return _encoders[name]


def forget() -> None:
    """Drops this process's encoders and their memos, for a stage that needs the memory for others."""
    _encoders.clear()


def decode_ids(ids: list[int], raw: list[bytes]) -> str:
    """The text of ids: bytes of the pieces, markers as spaces, without the marker that stands before every text."""
    joined = b"".join([raw[i] for i in ids]).replace(b"\xff", b" ")
    return joined[1:].decode("utf-8", "replace") if joined[:1] == b" " else joined.decode("utf-8", "replace")


def encode(docs: DataFrame, model_path: str, keep: list[str], text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Columns keep of docs and out_col, array<int>."""
    fields = [*docs.select(*keep).schema.fields]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(model_path, shared.value)
        for part, texts in text_chunks(batches, "__text"):
            ids = encoder.encode(texts)
            ends = np.cumsum([0, *(len(x) for x in ids)])
            column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), column], [*(f.name for f in fields), out_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out_col}` array<int>"])
    return docs.select(*keep, text_of(text_col).alias("__text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, keep: list[str], ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Columns keep of encoded and out_col, the decoded text; null ids give the empty text."""
    fields = [*encoded.select(*keep).schema.fields]
    shared = encoded.sparkSession.sparkContext.broadcast(vocabulary(model_path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        raw = shared.value.raw
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = [decode_ids(x or [], raw) for x in part.column("__ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(part.column(f.name) for f in fields), pa.array(texts, pa.string())], [*(f.name for f in fields), out_col])

    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out_col}` string"])
    return encoded.select(*keep, F.col(ids_col).alias("__ids")).mapInArrow(run, schema)


