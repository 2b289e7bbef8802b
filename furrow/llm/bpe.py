"""Vectorised byte-pair merges of a SentencePiece BPE vocabulary.

A text is cut into words that no piece can span; the distinct words of a batch
are merged together. Every round finds, for each word that can still merge,
the adjacent pair of the best rank (one segmented minimum over a flat symbol
array), merges its occurrences from the left, and compacts the array; words
without a pair leave it. Only numpy arrays are touched in a round, never
single words.

Merging all occurrences of a pair in one round gives the library's result
unless the new piece can at once merge further at a better rank. The few
pieces for which the vocabulary has such a merge are found beforehand; of
those only the leftmost occurrence merges in a round.
"""

from __future__ import annotations

import re
from collections import defaultdict
from dataclasses import dataclass
from itertools import islice

import numpy as np

SPACE = "▁"
_NORMAL, _UNKNOWN, _CONTROL, _BYTE = 1, 2, 3, 6
_NONE = np.int64(1) << 40


def _varint(b: bytes, i: int) -> tuple[int, int]:
    r = s = 0
    while True:
        x = b[i]
        i += 1
        r |= (x & 127) << s
        s += 7
        if x < 128:
            return r, i


def _fields(b: bytes):
    """(number, value) of each field of a protocol-buffer message."""
    i = 0
    while i < len(b):
        k, i = _varint(b, i)
        kind = k & 7
        if kind == 0:
            v, i = _varint(b, i)
        elif kind == 2:
            n, i = _varint(b, i)
            v, i = b[i:i + n], i + n
        else:
            n = 4 if kind == 5 else 8
            v, i = b[i:i + n], i + n
        yield k >> 3, v


@dataclass
class Vocabulary:
    """Pieces, scores and kinds by id, as the model file lists them."""

    pieces: list[str]
    scores: np.ndarray
    kinds: np.ndarray
    eos: int

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """Read a ``.model`` file. Models that normalise texts beyond a space
        put in front, or whose pieces hold other kinds, are refused."""
        with open(path, "rb") as f:
            data = f.read()
        pieces, scores, kinds, norm, trainer = [], [], [], {}, {}
        for k, v in _fields(data):
            if k == 1:
                got = dict(_fields(v))
                pieces.append(got[1].decode())
                scores.append(np.frombuffer(got[2], "<f4")[0] if 2 in got else 0.0)
                kinds.append(got.get(3, _NORMAL))
            elif k == 2:
                trainer = dict(_fields(v))
            elif k == 3:
                norm = dict(_fields(v))
        if trainer.get(3) != 2 or not trainer.get(35) or set(kinds) - {_NORMAL, _UNKNOWN, _CONTROL, _BYTE}:
            raise ValueError("a BPE model with byte fallback and plain pieces is needed")
        if norm.get(2) or norm.get(3, 1) != 1 or norm.get(4, 1) != 0 or norm.get(5, 1) != 1:
            raise ValueError("the model normalises texts; only identity with a space in front is built")
        vocab = cls(pieces, np.asarray(scores, np.float32), np.asarray(kinds, np.int8), pieces.index("</s>"))
        if any(SPACE in p.lstrip(SPACE) for p, k in zip(pieces, kinds) if k == _NORMAL):
            raise ValueError("pieces that span words are not built")
        return vocab


class Merger:
    """Merge tables of a vocabulary, and the rounds over flat arrays.

    Symbols are piece ids; characters that are no piece get the number of
    their code point above all ids and turn into byte pieces at the end.
    """

    #: So many distinct words are known from batch to batch, and merge once;
    #: beyond it all are forgotten, so memory stays bounded.
    KEPT = 150_000

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        normal = np.flatnonzero(vocab.kinds == _NORMAL)
        ids = {vocab.pieces[i]: int(i) for i in normal}
        # rank: place among the distinct scores, best first
        levels = np.unique(-vocab.scores[normal])
        rank = {p: int(np.searchsorted(levels, -vocab.scores[i])) for p, i in ids.items()}
        self.base = len(vocab.pieces)
        left, right, made, ranks, better = [], [], [], [], set()
        for p, i in ids.items():
            for cut in range(1, len(p)):
                a, b = ids.get(p[:cut]), ids.get(p[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    made.append(i)
                    ranks.append(rank[p])
                    # p may follow at once on making a or b, at no worse a rank
                    better.update(x for x, s in ((a, p[:cut]), (b, p[cut:])) if len(s) > 1 and rank[s] >= rank[p])
        keys = np.asarray(left, np.int64) * self.base + np.asarray(right, np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.made = np.asarray(made, np.int64)[order]
        self.ranks = np.asarray(ranks, np.int64)[order]
        self.single = np.zeros(self.base, bool)
        self.single[list(better)] = True
        self.char = np.full(0x110000, -1, np.int64)
        for p, i in ids.items():
            if len(p) == 1:
                self.char[ord(p)] = i
        self.byte = np.zeros(256, np.int64)
        for i in np.flatnonzero(vocab.kinds == _BYTE):
            self.byte[int(vocab.pieces[i][1:-1], 16)] = i
        # characters that only stand alone always end a word
        inner = {c for p in ids if len(p) > 1 for c in p}
        self.cut = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+" if "\n" not in inner else f"{SPACE}*[^{SPACE}]+|{SPACE}+")
        self.forget()

    def split(self, text: str) -> list[str]:
        """The words of a text (with the space in front) that merge apart."""
        return self.cut.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def symbols(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat symbols before any merge, and each symbol's word."""
        lens = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        sym = self.char[codes]
        return np.where(sym < 0, codes + self.base, sym), np.repeat(np.arange(len(words)), lens)

    def _lookup(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and made piece of each pair; rank _NONE where none merges."""
        key = np.where((a < self.base) & (b < self.base), a * self.base + b, -1)
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], _NONE), np.where(hit, self.made[at], 0)

    def merge(self, sym: np.ndarray, word: np.ndarray, n_words: int) -> tuple[np.ndarray, np.ndarray]:
        """All merges; the final flat symbols and their words, in order."""
        done_sym, done_word = [], []
        last = word[1:] != word[:-1]
        rank = np.full(len(sym), _NONE)
        made = np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._lookup(sym[:-1], sym[1:])
            rank[:-1][last] = _NONE
        while len(sym):
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            sizes = np.diff(np.r_[starts, len(word)])
            best = np.minimum.reduceat(rank, starts)
            alive = best < _NONE
            if not alive.all():
                keep = np.repeat(alive, sizes)
                done_sym.append(sym[~keep])
                done_word.append(word[~keep])
                sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
                best, sizes = best[alive], sizes[alive]
                if not len(sym):
                    break
            hits = np.flatnonzero(rank == np.repeat(best, sizes))
            # of occurrences that overlap (a run of one symbol), or that could
            # be made different pieces of one rank, the leftmost go first
            w, m = word[hits], made[hits]
            first = np.r_[True, w[1:] != w[:-1]]
            lead = np.repeat(m[first], np.diff(np.r_[np.flatnonzero(first), len(hits)]))
            gap = np.r_[True, (hits[1:] != hits[:-1] + 1) | first[1:]]
            run = np.flatnonzero(gap)
            odd = (np.arange(len(hits)) - np.repeat(run, np.diff(np.r_[run, len(hits)]))) % 2 == 1
            hits = hits[(~odd & ~self.single[m] & (m == lead) & ~self.single[lead]) | first]
            sym[hits] = made[hits]
            stay = np.ones(len(sym), bool)
            stay[hits + 1] = False
            moved = hits - np.arange(len(hits))
            sym, word, rank, made = sym[stay], word[stay], rank[stay], made[stay]
            # only pairs beside a merge change
            beside = np.zeros(len(sym), bool)
            beside[moved] = True
            beside[np.maximum(moved - 1, 0)] = True
            touched = np.flatnonzero(beside)
            touched_next = np.minimum(touched + 1, len(sym) - 1)
            r, m = self._lookup(sym[touched], sym[touched_next])
            r[(touched_next == touched) | (word[touched_next] != word[touched])] = _NONE
            rank[touched], made[touched] = r, m
        if not done_sym:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sym, word = np.concatenate(done_sym), np.concatenate(done_word)
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _bytes(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Turn characters without a piece into byte pieces."""
        odd = sym >= self.base
        if not odd.any():
            return sym, word
        raw = [chr(c).encode("utf-8", "surrogatepass") for c in (sym[odd] - self.base)]
        size = np.ones(len(sym), np.int64)
        size[odd] = [len(x) for x in raw]
        out = np.repeat(sym, size)
        out[np.repeat(odd, size)] = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        return out, np.repeat(word, size)

    def _learn(self) -> None:
        """Merge the words that ``known`` got since the last call."""
        fresh = list(islice(self.known, len(self.sizes), None))
        if not fresh:
            return
        sym, word = self.symbols(fresh)
        sym, word = self._bytes(*self.merge(sym, word, len(fresh)))
        self.flat = np.r_[self.flat, sym.astype(np.int32)]
        self.sizes = np.r_[self.sizes, np.bincount(word, minlength=len(fresh))]
        self.offs = np.r_[0, np.cumsum(self.sizes)]

    def forget(self) -> None:
        """Start with no known words. Codes number words as they come."""
        self.known: defaultdict[str, int] = defaultdict()
        self.known.default_factory = self.known.__len__
        self.flat, self.sizes, self.offs = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(1, np.int64)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of some texts and the number of ids of each."""
        if len(self.known) > self.KEPT:
            self.forget()
        codes, counts = [], []
        for t in texts:
            ws = self.split(t)
            counts.append(len(ws))
            codes.extend(map(self.known.__getitem__, ws))
        self._learn()
        at = np.asarray(codes, np.int64)
        n = self.sizes[at]
        begin = np.r_[0, np.cumsum(n)]
        where = np.repeat(self.offs[at] - begin[:-1], n) + np.arange(begin[-1])
        return self.flat[where], np.diff(begin[np.r_[0, np.cumsum(counts, dtype=np.int64)]])

    def count_words(self, words: list[str]) -> np.ndarray:
        """How many pieces each of some distinct words has; no ids are made."""
        sym, word = self.symbols(words)
        sym, word = self.merge(sym, word, len(words))
        code = np.where(sym >= self.base, sym - self.base, 0)
        size = 1 + (code > 0x7F).astype(np.int64) + (code > 0x7FF) + (code > 0xFFFF)
        return np.bincount(word, weights=size, minlength=len(words)).astype(np.int64)


class Decoder:
    """Ids back to text: piece bytes gathered from one flat table."""

    def __init__(self, vocab: Vocabulary):
        raw = []
        for p, k in zip(vocab.pieces, vocab.kinds):
            if k == _BYTE:
                raw.append(bytes([int(p[1:-1], 16)]))
            elif k == _CONTROL:
                raw.append(b"")
            elif k == _UNKNOWN:
                raw.append(" ⁇ ".encode())
            else:
                raw.append(p.replace(SPACE, " ").encode())
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.at = np.r_[0, np.cumsum(self.size)[:-1]]
        self.table = np.frombuffer(b"".join(raw), np.uint8)
        self.kinds = vocab.kinds

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> list[str]:
        n = self.size[ids]
        flat = self.table[np.repeat(self.at[ids] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())].tobytes()
        ends = np.r_[0, np.cumsum(n)][np.r_[0, np.cumsum(counts)]]
        first = np.r_[0, np.cumsum(counts)[:-1]]
        out = []
        for i, (a, b) in enumerate(zip(ends[:-1], ends[1:])):
            text = flat[a:b].decode("utf-8", "replace")
            # the space that encoding put in front goes
            if counts[i] and text[:1] == " " and self.kinds[ids[first[i]]] == _NORMAL:
                text = text[1:]
            out.append(text)
        return out
