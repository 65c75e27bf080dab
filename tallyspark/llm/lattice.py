"""Subword lattices over an existing vocabulary, for words of equal length at once.

Pieces are byte strings with a plain space for the word mark. All substrings of all words of one
length are hashed from prefix sums and looked up in the sorted keys of the pieces; then one step
of a recursion over places is an array operation over words. ``best`` keeps maxima and
backpointers (Viterbi), ``marginal`` sums all segmentations in log space, and
``expected_counts`` runs forward and backward.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np

from tallyspark.llm.textvec import _BASE, _INVERSE, _PAD, _powers

MARK = "▁"
#: Bytes of words that are worked on together.
GROUP = 1 << 16
#: The library's discount of an unknown character against the least score.
UNKNOWN_PENALTY = 10.0
#: Fewer words than these, longer than that, are taken arc by arc: steps over places are too many for too little.
FEW, LONG = 8, 128


class Vocabulary:
    """Pieces of a SentencePiece model file: text (bytes), id and score; and the ids of byte pieces."""

    def __init__(self, model_file: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        with open(model_file, "rb") as f:
            proto.ParseFromString(f.read())
        kinds = pb.ModelProto.SentencePiece
        self.size = len(proto.pieces)
        self.byte_ids = np.full(256, -1, np.int64)
        self.ids, self.texts, scores = [], [], []
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                self.byte_ids[int(p.piece[3:5], 16)] = i
            elif p.type in (kinds.NORMAL, kinds.USER_DEFINED):
                self.ids.append(i)
                self.texts.append(p.piece.replace(MARK, " ").encode())
                scores.append(p.score)
        self.ids = np.array(self.ids, np.int64)
        self.scores = np.array(scores, np.float64)
        self.dummy_prefix = proto.normalizer_spec.add_dummy_prefix

    def zipf(self) -> np.ndarray:
        """Log probabilities from the order of the scores: the piece of rank r has a weight of 1 / r.

        The scores of merge vocabularies are ranks, not log probabilities; this is Zipf's law for them.
        """
        rank = np.empty(len(self.scores))
        rank[np.lexsort((self.ids, -self.scores))] = np.arange(1, len(self.scores) + 1)
        weight = 1 / rank
        return np.log(weight / weight.sum()).astype(np.float32).astype(np.float64)


@lru_cache(maxsize=2)
def vocabulary(model_file: str) -> Vocabulary:
    return Vocabulary(model_file)


class Lattice:
    """Pieces with log weights. With ``bytes_too`` each byte is an arc too, of index ``len(texts) + byte``."""

    def __init__(self, texts: list[bytes], weights: np.ndarray, bytes_too: bool = False):
        self.n, self.bytes_too = len(texts), bytes_too
        self.lengths = np.array([len(t) for t in texts], np.int64)
        flat = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.cumsum(self.lengths)
        starts = ends - self.lengths
        keys = np.empty(self.n, np.uint64)
        for n in np.unique(self.lengths):
            own = np.flatnonzero(self.lengths == n)
            keys[own] = _keys(flat[starts[own, None] + np.arange(n)], int(n))[:, 0]
        self.order = np.argsort(keys, kind="stable")
        self.keys = keys[self.order]
        if (np.diff(self.keys) == 0).any():
            raise ValueError("two pieces have one key")
        self.longest = int(self.lengths.max())
        self.by_length = np.bincount(self.lengths, minlength=self.longest + 1) > 0
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[self.keys >> np.uint64(44)] = True
        #: Whether some piece has the two bytes beside each other; elsewhere texts fall apart.
        self.joins = np.zeros((256, 256), bool)
        inner = np.ones(len(flat), bool)
        inner[starts] = False
        second = np.flatnonzero(inner)
        self.joins[flat[second - 1], flat[second]] = True
        self.set_weights(weights)

    def set_weights(self, weights: np.ndarray):
        """Log weights of the pieces (and bytes). The two last entries are an unknown character's and none."""
        unknown = float(weights.min()) - UNKNOWN_PENALTY
        self.weights = np.concatenate([weights, [unknown, -np.inf]])
        self.unknown = len(weights)

    def spans(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, end, row) of the parts that no piece crosses; together they are the whole texts."""
        if not len(data):
            return (np.zeros(0, np.int64),) * 3
        cut = np.ones(len(data), bool)
        cut[1:] = ~self.joins[data[:-1], data[1:]] & ((data[1:] & 0xC0) != 0x80)
        cut[offsets[:-1][offsets[:-1] < offsets[1:]]] = True
        starts = np.flatnonzero(cut)
        return starts, np.append(starts[1:], len(data)), np.searchsorted(offsets, starts, "right") - 1

    def _probe(self, keys: np.ndarray) -> np.ndarray:
        """Index of the piece of each key, -1 if there is none."""
        flat = keys.ravel()
        out = np.full(len(flat), -1, np.int32)
        hit = np.flatnonzero(self.maybe[flat >> np.uint64(44)])
        wanted = flat[hit]
        at = np.minimum(np.searchsorted(self.keys, wanted), self.n - 1)
        same = self.keys[at] == wanted
        out[hit[same]] = self.order[at[same]]
        return out.reshape(keys.shape)

    def _arcs(self, words: np.ndarray) -> dict[int, np.ndarray]:
        """By arc length: (words x starts) piece indexes, -1 for none."""
        length = words.shape[1]
        arcs = {n: self._probe(_keys(words, n)) for n in range(1, min(length, self.longest) + 1) if self.by_length[n]}
        if self.bytes_too:
            arcs.setdefault(1, np.full(words.shape, -1, np.int32))
        else:
            lead = words[:, :]
            size = np.select([lead >= 0xF0, lead >= 0xE0, lead >= 0xC2], [4, 3, 2], 1)
            size = np.minimum(size, length - np.arange(length))
            for n in range(1, min(4, length) + 1):
                arc = arcs.setdefault(n, np.full((len(words), length - n + 1), -1, np.int32))
                arc[(size[:, : length - n + 1] == n) & (arc < 0)] = self.unknown
        return arcs

    def groups(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
        """(indexes of the spans, words x length bytes) of spans of one length."""
        sizes = ends - starts
        order = np.argsort(sizes, kind="stable")
        for n in np.unique(sizes):
            own = order[np.searchsorted(sizes[order], n, "left") : np.searchsorted(sizes[order], n, "right")]
            step = max(1, GROUP // max(1, int(n)))
            for at in range(0, len(own), step):
                part = own[at : at + step]
                yield part, data[starts[part, None] + np.arange(n)]

    def best(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words x length piece indexes at the places where pieces begin, else -1; total log weights).

        In a tie the longer last piece is taken; sums of weights of 24 bits are exact. An unknown character has the index ``unknown`` at each of its bytes.
        """
        n, length = words.shape
        arcs = self._arcs(words)
        if n < FEW and length > LONG and not self.bytes_too:
            found = [self._best_one(arcs, words, k) for k in range(n)]
            return np.stack([f[0] for f in found]), np.array([f[1] for f in found])
        scores = np.full((length + 1, n), -np.inf)
        scores[0] = 0
        piece = np.full((length + 1, n), -1, np.int32)
        size = np.zeros((length + 1, n), np.int32)
        for j in range(1, length + 1):
            top = scores[j]
            for k in range(min(j, self.longest), 0, -1):
                if k not in arcs:
                    continue
                index = arcs[k][:, j - k]
                score = self.weights[index] + scores[j - k]
                better = score > top
                top = np.where(better, score, top)
                piece[j] = np.where(better, index, piece[j])
                size[j] = np.where(better, k, size[j])
            scores[j] = top
        out = np.full((n, length), -1, np.int32)
        row, at = np.arange(n), np.full(n, length)
        while len(row):
            index, back = piece[at, row], size[at, row]
            at = at - back
            out[row, at] = index
            unknown = np.flatnonzero(index == self.unknown)
            for t in range(1, 4):
                more = unknown[back[unknown] > t]
                out[row[more], at[more] + t] = self.unknown
            left = at > 0
            row, at = row[left], at[left]
        return out, scores[length]

    def _in_order(self, arcs: dict[int, np.ndarray], words: np.ndarray, row: int) -> tuple[list, list, list, list]:
        """(end, length, index, weight) of the arcs of one word, by end and then the longer first."""
        ends, sizes, indexes = [], [], []
        for k, index in arcs.items():
            own = np.flatnonzero(index[row] >= 0)
            ends.append(own + k)
            sizes.append(np.full(len(own), k))
            indexes.append(index[row][own].astype(np.int64))
        if self.bytes_too:
            ends.append(np.arange(1, words.shape[1] + 1))
            sizes.append(np.ones(words.shape[1], np.int64))
            indexes.append(self.n + words[row].astype(np.int64))
        ends, sizes, indexes = map(np.concatenate, (ends, sizes, indexes))
        order = np.lexsort((-sizes, ends))
        return ends[order].tolist(), sizes[order].tolist(), indexes[order].tolist(), self.weights[indexes[order]].tolist()

    def _best_one(self, arcs, words: np.ndarray, row: int) -> tuple[np.ndarray, float]:
        length = words.shape[1]
        scores, piece, size = [-math.inf] * (length + 1), [-1] * (length + 1), [0] * (length + 1)
        scores[0] = 0.0
        for end, k, index, weight in zip(*self._in_order(arcs, words, row), strict=True):
            score = weight + scores[end - k]
            if score > scores[end]:
                scores[end], piece[end], size[end] = score, index, k
        out, at = np.full(length, -1, np.int32), length
        while at:
            index, back = piece[at], size[at]
            at -= back
            out[at] = index
            if index == self.unknown:
                out[at : at + back] = index
        return out, scores[length]

    def _marginal_one(self, arcs, words: np.ndarray, row: int) -> float:
        length = words.shape[1]
        alpha, top, total, now = [0.0] * (length + 1), -math.inf, 0.0, 0
        for end, k, _, weight in zip(*self._in_order(arcs, words, row), strict=True):
            if end != now:
                if now:
                    alpha[now] = top + math.log(total)
                top, total, now = -math.inf, 0.0, end
            score = weight + alpha[end - k]
            if score <= top:
                total += math.exp(score - top)
            else:
                total, top = total * math.exp(top - score) + 1.0, score
        return top + math.log(total)

    def _forward(self, words: np.ndarray, arcs: dict[int, np.ndarray]) -> np.ndarray:
        n, length = words.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        for j in range(1, length + 1):
            parts = [self.weights[arcs[k][:, j - k]] + alpha[j - k] for k in arcs if k <= j]
            if self.bytes_too:
                parts.append(self.weights[self.n + words[:, j - 1].astype(np.int64)] + alpha[j - 1])
            alpha[j] = _log_sum(parts)
        return alpha

    def marginal(self, words: np.ndarray) -> np.ndarray:
        """Log of the summed weights of all segmentations of each word."""
        arcs = self._arcs(words)
        if self.bytes_too and len(words) < FEW and words.shape[1] > LONG:
            return np.array([self._marginal_one(arcs, words, k) for k in range(len(words))])
        return self._forward(words, arcs)[-1]

    def expected_counts(self, words: np.ndarray, counts: np.ndarray, out: np.ndarray) -> float:
        """Adds to ``out`` how often each arc is expected in words that occur ``counts`` times; the log likelihood is returned."""
        n, length = words.shape
        arcs = self._arcs(words)
        alpha = self._forward(words, arcs)
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0
        total = alpha[length]
        for i in range(length - 1, -1, -1):
            parts = []
            for k, index in arcs.items():
                if i + k <= length:
                    score = self.weights[index[:, i]] + beta[i + k]
                    parts.append(score)
                    share = np.exp(alpha[i] + score - total) * counts
                    out += np.bincount(np.where(index[:, i] >= 0, index[:, i], len(out)), weights=share, minlength=len(out) + 1)[: len(out)]
            if self.bytes_too:
                index = self.n + words[:, i].astype(np.int64)
                score = self.weights[index] + beta[i + 1]
                parts.append(score)
                out += np.bincount(index, weights=np.exp(alpha[i] + score - total) * counts, minlength=len(out))
            beta[i] = _log_sum(parts)
        return float((total * counts).sum())


def _log_sum(parts: list[np.ndarray]) -> np.ndarray:
    stacked = np.stack(parts)
    top = stacked.max(axis=0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(stacked - safe).sum(axis=0))


def _keys(words: np.ndarray, n: int) -> np.ndarray:
    """Keys of all substrings of ``n`` bytes, by their start."""
    length = words.shape[1]
    sums = np.zeros((len(words), length + 1), np.uint64)
    np.cumsum((words.astype(np.uint64) + np.uint64(1)) * _powers(length), axis=1, out=sums[:, 1:])
    raw = (sums[:, n:] - sums[:, : length - n + 1]) * _powers(length - n + 1, _INVERSE)
    raw ^= np.uint64(n * int(_PAD) % 2**64)
    raw *= _BASE
    return raw ^ (raw >> np.uint64(29))
