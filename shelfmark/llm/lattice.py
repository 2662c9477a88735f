"""Segmentation lattices of words over a piece vocabulary: a double-array trie, Viterbi and forward passes in numpy.

Many words go through together: the trie is walked from all their positions at once, and the passes go by place
within the word. A word is bytes; the white-space marker is the byte 0xFF, which UTF-8 never holds, so a marker
character that stands in a text is never taken for a space.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

MARK = "▁"
MARK_BYTE = 0xFF


def as_bytes(piece: str) -> bytes:
    return b"\xff".join(x.encode() for x in piece.split(MARK))


@dataclass
class DoubleArray:
    """States are places in the arrays: from s over byte b to t = base[s] + b, valid where check[t] == s. value: piece id or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, pieces: list[tuple[bytes, int]]) -> DoubleArray:
        tree: list[dict[int, int]] = [{}]
        ends: list[int] = [-1]
        for key, value in pieces:
            at = 0
            for b in key:
                nxt = tree[at].get(b)
                if nxt is None:
                    nxt = tree[at][b] = len(tree)
                    tree.append({})
                    ends.append(-1)
                at = nxt
            ends[at] = value
        used = np.zeros(2 * len(tree) + 8192, bool)
        used[0] = True
        place = {0: 0}
        first_free = 1
        begin: dict[int, int] = {}
        for node in sorted(range(len(tree)), key=lambda n: -len(tree[n])):  # the widest nodes first: they are hardest to fit
            kids = sorted(tree[node])
            if not kids:
                continue
            offsets = np.array(kids)
            # nodes of one width search on from where the last one of it was put; single children fill the gaps
            at = max(1, first_free - kids[0]) if len(kids) == 1 else begin.get(len(kids), 1)
            while True:
                if at + 4096 + 256 > len(used):
                    used = np.concatenate([used, np.zeros(len(used), bool)])
                fits = np.flatnonzero(~used[np.arange(at, at + 4096)[:, None] + offsets[None, :]].any(1))
                if len(fits):
                    break
                at += 4096
            b = at + int(fits[0])
            begin[len(kids)] = b
            tree[node]["b"] = b  # type: ignore[index]
            used[b + offsets] = True
            while used[first_free]:
                first_free += 1
        # parents before children, now that every node has its base
        base, check, value = (np.full(len(used), -1, np.int32) for _ in range(3))
        value[0] = ends[0]
        todo = [0]
        while todo:
            node = todo.pop()
            kids = tree[node]
            b = kids.pop("b", None)  # type: ignore[call-overload]
            if b is None:
                continue
            s = place[node]
            base[s] = b
            for byte, kid in kids.items():
                t = b + byte
                check[t], value[t], place[kid] = s, ends[kid], t
                todo.append(kid)
        keep = int(np.flatnonzero(used).max()) + 257
        return cls(np.ascontiguousarray(base[:keep]), np.ascontiguousarray(check[:keep]), np.ascontiguousarray(value[:keep]))


@dataclass
class Edges:
    """Edges of all words' lattices, by place of their end within the word, then end, then start. piece < 0: one character without a piece."""

    raw: np.ndarray  # the words' bytes, one after another
    first: np.ndarray  # of each word
    start: np.ndarray  # node numbers: byte i of word w has node first[w] + i + w, so that a word's end is a node of its own
    end: np.ndarray
    piece: np.ndarray
    level: np.ndarray  # where the edges of each place begin
    byte: np.ndarray  # the byte at which an edge starts
    length: np.ndarray


def lattice(words: list[bytes], trie: DoubleArray) -> Edges:
    raw = np.frombuffer(b"".join(words) or b"\0", np.uint8)
    n = np.array([len(w) for w in words], np.int64)
    first = np.cumsum(n) - n
    word = np.repeat(np.arange(len(words)), n)
    limit = np.repeat(first + n, n)
    lead = (raw & 0xC0) != 0x80  # where a character begins
    if not len(word):
        lead = lead[:0]
    at = np.flatnonzero(lead)
    state = np.zeros(len(at), np.int32)
    begin = at
    depth = 0
    starts, ends, pieces = [], [], []
    while len(at):
        t = trie.base[state] + raw[begin + depth]
        ok = (trie.base[state] >= 0) & (trie.check[t] == state)
        begin, state = begin[ok], t[ok]
        depth += 1
        v = trie.value[state]
        hit = v >= 0
        starts.append(begin[hit])
        ends.append(begin[hit] + depth)
        pieces.append(v[hit])
        more = begin + depth < limit[begin]
        begin, state = begin[more], state[more]
        at = begin
    # characters that no piece covers alone
    chars = np.flatnonzero(lead)
    stop = np.append(chars[1:], len(word))[: len(chars)]
    covered = np.zeros(len(word) + 1, bool)
    for s, e in zip(starts[:4], ends[:4], strict=False):
        whole = (e == len(word)) | lead[np.minimum(e, len(word) - 1)]
        one = whole & (stop[np.searchsorted(chars, s)] == e)
        covered[s[one]] = True
    bare = ~covered[chars]
    start = np.concatenate([*starts, chars[bare]]) if starts else np.zeros(0, np.int64)
    end = np.concatenate([*ends, stop[bare]]) if starts else start
    piece = np.concatenate([*pieces, np.full(int(bare.sum()), -1)]) if starts else start
    w = word[start] if len(start) else start
    place = end - first[w] if len(start) else start
    order = np.lexsort((start, end, place))
    start, end, piece, w, place = (x[order] for x in (start, end, piece, w, place))
    level = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]])) if len(place) else np.zeros(0, np.int64)
    return Edges(raw, first + np.arange(len(words)), start + w, end + w, piece, np.append(level, len(place)), start, end - start)


def viterbi(words: list[bytes], trie: DoubleArray, score: np.ndarray, unknown: float, byte_ids: np.ndarray) -> list[bytes]:
    """Ids (int32, as bytes) of each word's best segmentation; ties go to the longer last piece. Bare characters become their bytes' pieces."""
    e = lattice(words, trie)
    total = len(e.raw) + len(words) + 1
    best = np.full(total, -np.inf)
    back = np.full(total, -1, np.int64)
    best[e.first] = 0.0
    gain = np.where(e.piece >= 0, score[np.maximum(e.piece, 0)], unknown)
    for a, b in zip(e.level, e.level[1:], strict=False):
        value = best[e.start[a:b]] + gain[a:b]
        end = e.end[a:b]
        run = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        top = np.maximum.reduceat(value, run)
        is_top = value == np.repeat(top, np.diff(np.append(run, b - a)))
        pick = np.flatnonzero(is_top)
        pick = pick[np.concatenate([[True], end[pick][1:] != end[pick][:-1]])]
        best[end[run]] = top
        back[end[pick]] = pick + a
    # walk back from all ends together
    n = np.array([len(w) for w in words])
    node = e.first + n
    who = np.arange(len(words))
    steps = []
    live = node > e.first
    node, who = node[live], who[live]
    while len(node):
        edge = back[node]
        steps.append((who, edge))
        node = e.start[edge]
        live = node > e.first[who]
        node, who = node[live], who[live]
    if not steps:
        return [b""] * len(words)
    owner = np.concatenate([w for w, _ in steps[::-1]])
    edge = np.concatenate([x for _, x in steps[::-1]])
    order = np.argsort(owner, kind="stable")
    owner, edge = owner[order], edge[order]
    reps = np.where(e.piece[edge] >= 0, 1, e.length[edge])
    flat = np.repeat(edge, reps)
    inner = np.arange(len(flat)) - np.repeat(np.cumsum(reps) - reps, reps)
    ids = np.where(e.piece[flat] >= 0, e.piece[flat], byte_ids[e.raw[np.minimum(e.byte[flat] + inner, len(e.raw) - 1)]]).astype(np.int32)
    counts = np.bincount(np.repeat(owner, reps), minlength=len(words))
    cuts = np.append(0, np.cumsum(counts)) * 4
    data = ids.tobytes()
    return [data[a:b] for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False)]


#: Bytes of a word up to which the forward pass runs on scaled probabilities; longer words take logarithms.
LINEAR = 64


def forward(words: list[bytes], trie: DoubleArray, logp: np.ndarray, byte_ids: np.ndarray) -> np.ndarray:
    """log of the summed probability of all segmentations: a row per word, a column per model. logp: pieces x models."""
    out = np.zeros((len(words), logp.shape[1]))
    short = [i for i, w in enumerate(words) if len(w) <= LINEAR]
    long = [i for i, w in enumerate(words) if len(w) > LINEAR]
    for rows, scaled in ((short, True), (long, False)):
        if rows:
            out[rows] = _forward([words[i] for i in rows], trie, logp, byte_ids, scaled)
    return out


def _forward(words: list[bytes], trie: DoubleArray, logp: np.ndarray, byte_ids: np.ndarray, scaled: bool) -> np.ndarray:
    e = lattice(words, trie)
    gain = logp[np.maximum(e.piece, 0)]
    bare = np.flatnonzero(e.piece < 0)
    if len(bare):
        reps = e.length[bare]
        at = np.repeat(e.byte[bare], reps) + np.arange(int(reps.sum())) - np.repeat(np.cumsum(reps) - reps, reps)
        gain[bare] = np.add.reduceat(logp[byte_ids[e.raw[at]]], np.cumsum(reps) - reps, axis=0)
    per_byte = 2.0
    alpha = np.full((len(e.raw) + len(words) + 1, logp.shape[1]), 0.0 if scaled else -np.inf)
    alpha[e.first] = 1.0 if scaled else 0.0
    if scaled:
        gain = np.exp(gain + per_byte * e.length[:, None])
    for a, b in zip(e.level, e.level[1:], strict=False):
        end = e.end[a:b]
        run = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        if scaled:
            alpha[end[run]] = np.add.reduceat(alpha[e.start[a:b]] * gain[a:b], run, axis=0)
        else:
            value = alpha[e.start[a:b]] + gain[a:b]
            top = np.maximum.reduceat(value, run, axis=0)
            value = np.exp(value - np.repeat(top, np.diff(np.append(run, b - a)), axis=0))
            alpha[end[run]] = top + np.log(np.add.reduceat(value, run, axis=0))
    n = np.array([len(w) for w in words])
    last = alpha[e.first + n]
    return np.log(np.maximum(last, 1e-300)) - per_byte * n[:, None] if scaled else last
