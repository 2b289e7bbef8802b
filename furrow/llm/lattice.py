"""A word's probability as the sum over all its segmentations into pieces."""

from __future__ import annotations

import numpy as np

from furrow.llm.bpe import _BYTE, _NORMAL, SPACE, Vocabulary

_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Cells (word, start, length) of a lattice that are held at once.
CELLS = 1 << 21


def _powers(n: int) -> np.ndarray:
    return np.r_[np.uint64(1), np.cumprod(np.full(n, _BASE, np.uint64))]


def _name(text: str) -> int:
    h = 0
    for ch in text:
        h = (h * int(_BASE) + ord(ch) + 1) & 0xFFFFFFFFFFFFFFFF
    return h


class Lattice:
    """Forward and backward sums over the segmentations of words.

    A word is a first piece (one that begins with the space mark), inner
    pieces, and a stop; first pieces have one distribution, inner pieces, the
    bytes of characters outside the vocabulary and the stop another. So the
    probabilities of all strings add up to one.
    """

    def __init__(self, vocab: Vocabulary):
        ids = [i for i in range(len(vocab.pieces)) if vocab.kinds[i] == _NORMAL]
        ids = [i for i in ids if len(vocab.pieces[i].strip(SPACE)) > 0 or vocab.pieces[i] == SPACE]
        ids = [i for i in ids if not vocab.pieces[i].startswith(SPACE * 2)]
        names = np.asarray([_name(vocab.pieces[i]) for i in ids], np.uint64)
        order = np.argsort(names)
        self.names, self.ids = names[order], np.asarray(ids, np.int64)[order]
        self.longest = max(len(vocab.pieces[i]) for i in ids)
        self.first = np.asarray([p.startswith(SPACE) for p in vocab.pieces])
        self.size = len(vocab.pieces) + 1          # the stop comes last
        self.byte = np.zeros(256, np.int64)
        for i in np.flatnonzero(vocab.kinds == _BYTE):
            self.byte[int(vocab.pieces[i][1:-1], 16)] = i
        self.inner = np.zeros(self.size, bool)
        self.inner[self.ids] = ~self.first[self.ids]
        self.inner[self.byte] = True
        self.inner[-1] = True
        self.start = np.zeros(self.size, bool)
        self.start[self.ids] = self.first[self.ids]
        self.rank = np.r_[np.argsort(np.argsort(-vocab.scores, kind="stable"), kind="stable"), 0]

    def from_scores(self) -> np.ndarray:
        """Log probabilities from the vocabulary's own scores: they rank the
        pieces, and a piece weighs the inverse of its rank."""
        return self.normalised(1.0 / (2.0 + self.rank))

    def normalised(self, weight: np.ndarray) -> np.ndarray:
        out = np.full(self.size, -np.inf)
        for part in (self.start, self.inner):
            out[part] = np.log(weight[part] / weight[part].sum())
        return out

    def _chunks(self, words: list[str]):
        """Words of one length at a time, as many as fit into CELLS."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(lens, kind="stable")
        at = 0
        while at < len(order):
            n = int(lens[order[at]])
            same = int(np.searchsorted(lens[order], n, "right")) - at
            take = max(1, min(same, CELLS // ((n + 1) * self.longest)))
            yield order[at:at + take], n + 1
            at += take

    def _arcs(self, words: list[str], n: int) -> tuple[np.ndarray, np.ndarray]:
        """codes (word, place), and piece id of each (length, word, start), or -1."""
        codes = np.frombuffer("".join(SPACE + w for w in words).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, n)
        h = np.zeros((len(words), n + 1), np.uint64)
        for j in range(n):
            h[:, j + 1] = h[:, j] * _BASE + codes[:, j].astype(np.uint64) + np.uint64(1)
        power = _powers(self.longest)
        arcs = np.full((self.longest, len(words), n), -1, np.int64)
        for size in range(1, min(self.longest, n) + 1):
            name = h[:, size:] - h[:, :n + 1 - size] * power[size]
            at = np.minimum(np.searchsorted(self.names, name), len(self.names) - 1)
            got = np.where(self.names[at] == name, self.ids[at], -1)
            # pieces with the space mark only open a word
            head = got[:, 0].copy()
            got[self.first[got] & (got >= 0)] = -1
            got[:, 0] = np.where((head >= 0) & self.first[head], head, -1)
            arcs[size - 1, :, :n + 1 - size] = got
        return codes, arcs

    def _weights(self, codes, arcs, logp) -> tuple[np.ndarray, list]:
        """Log weight of every arc; characters without a piece spell bytes."""
        lp = np.where(arcs >= 0, logp[arcs], -np.inf)
        bare = np.argwhere((arcs[0] < 0) & (np.arange(codes.shape[1]) > 0)[None, :])
        spelt = []
        for w, i in bare:
            ids = self.byte[np.frombuffer(chr(codes[w, i]).encode("utf-8", "surrogatepass"), np.uint8)]
            lp[0, w, i] = logp[ids].sum()
            spelt.append((w, i, ids))
        return lp, spelt

    def _forward(self, lp: np.ndarray) -> np.ndarray:
        size, words, n = lp.shape
        alpha = np.full((words, n + 1), -np.inf)
        alpha[:, 0] = 0.0
        for j in range(1, n + 1):
            k = np.arange(1, min(size, j) + 1)
            alpha[:, j] = _logsum(alpha[:, j - k].T + lp[k - 1, :, j - k])
        return alpha

    def _backward(self, lp: np.ndarray) -> np.ndarray:
        size, words, n = lp.shape
        beta = np.full((words, n + 1), -np.inf)
        beta[:, n] = 0.0
        for i in range(n - 1, -1, -1):
            k = np.arange(1, min(size, n - i) + 1)
            beta[:, i] = _logsum(beta[:, i + k].T + lp[k - 1, :, i])
        return beta

    def score(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Log10 probability of each word."""
        out = np.empty(len(words))
        for rows, n in self._chunks(words):
            codes, arcs = self._arcs([words[i] for i in rows], n)
            lp, _ = self._weights(codes, arcs, logp)
            out[rows] = self._forward(lp)[:, n] + logp[-1]
        return out / np.log(10)

    def expected(self, words: list[str], logp: np.ndarray) -> np.ndarray:
        """Expected number of uses of every piece, byte and stop."""
        out = np.zeros(self.size)
        for rows, n in self._chunks(words):
            codes, arcs = self._arcs([words[i] for i in rows], n)
            lp, spelt = self._weights(codes, arcs, logp)
            alpha, beta = self._forward(lp), self._backward(lp)
            total = alpha[:, n]
            for size in range(1, min(self.longest, n) + 1):
                use = np.exp(alpha[:, :n + 1 - size] + lp[size - 1, :, :n + 1 - size] + beta[:, size:] - total[:, None])
                got = arcs[size - 1, :, :n + 1 - size]
                out += np.bincount(got[got >= 0], weights=use[got >= 0], minlength=self.size)
                if size == 1:
                    for w, i, ids in spelt:
                        np.add.at(out, ids, use[w, i])
            out[-1] += len(rows)
        return out


def _logsum(x: np.ndarray) -> np.ndarray:
    """Log of the sum of exponentials over the first axis."""
    top = x.max(0)
    safe = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(x - safe).sum(0))
