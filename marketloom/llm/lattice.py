"""Operator 1, documents scored by a subword lattice under fixed vocabulary scores.

Every word is spelt by pieces of an existing vocabulary: a first piece that carries the word mark, then further pieces.
A forward recursion in log space over the letters sums all segmentations, so a word's probability is marginal over
them; a document's is the product over its words. The pieces and their weights are the vocabulary's and stay as they are;
expected uses of the pieces in given words, by a forward and a backward pass, make a second set of weights beside them.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from marketloom.llm.common import LOWER

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"


def read_pieces(path: str = VOCABULARY) -> list[tuple[bytes, bool, float]]:
    """(bytes, does it start a word, log weight) of the vocabulary's pieces in lower case, and of all single bytes.

    A merge vocabulary scores a piece by its negated rank; its weight is then one over the rank (Zipf's law).
    """
    import sentencepiece

    reader = sentencepiece.SentencePieceProcessor(model_file=path)
    scores = np.array([reader.get_score(i) for i in range(reader.get_piece_size())])
    ranked = scores.min() < -1000
    out: dict[tuple[bytes, bool], float] = {}
    for i, s in enumerate(scores.tolist()):
        if reader.is_control(i) or reader.is_unknown(i) or reader.is_byte(i) or reader.is_unused(i):
            continue
        piece = reader.id_to_piece(i)
        start, letters = piece.startswith(MARK), piece.removeprefix(MARK)
        raw = letters.encode().translate(LOWER)
        if MARK in letters or any(b in b" \t\n\r\x0b\x0c" for b in raw):
            continue
        # pieces that differ by A-Z alone are one piece with their weights added
        weight = -np.log(2.0 - s) if ranked else s
        key = (raw, start)
        out[key] = np.logaddexp(out.get(key, -np.inf), weight)
    floor = min(out.values(), default=0.0) - 2
    for b in range(256):
        out.setdefault((bytes([b]), False), floor)
    out.setdefault((b"", True), floor)
    return [(raw, start, w) for (raw, start), w in sorted(out.items())]


class Lattice:
    """Pieces in a trie over byte classes; words are taken in batches of one length."""

    def __init__(self, pieces: list[tuple[bytes, bool, float]]):
        self.pieces = pieces
        self.width = max(len(p[0]) for p in pieces)
        used = sorted({b for p in pieces for b in p[0]})
        self.classes = np.zeros(256, np.int64)
        self.classes[used] = np.arange(1, len(used) + 1)
        follow: dict[tuple[int, int], int] = {}
        count = 1
        ends: dict[int, list[int]] = {}
        for i, (raw, start, _) in enumerate(pieces):
            state = 0
            for b in raw:
                key = (state, int(self.classes[b]))
                if key not in follow:
                    follow[key] = count
                    count += 1
                state = follow[key]
            ends.setdefault(state, [-1, -1])[start] = i
        self.next = np.full((count + 1, len(used) + 1), count, np.int32)  # the last state is dead
        for (state, c), to in follow.items():
            self.next[state, c] = to
        self.inner, self.first = np.full(count + 1, -1, np.int32), np.full(count + 1, -1, np.int32)
        for state, (inner, first) in ends.items():
            self.inner[state], self.first[state] = inner, first

    def weights(self, counts: np.ndarray, words: float) -> np.ndarray:
        """Log weights: of pieces that start a word among themselves, of others among themselves and the word's end."""
        start = np.array([p[1] for p in self.pieces])
        out = np.empty(len(counts) + 1)
        out[:-1][start] = np.log(counts[start] / counts[start].sum())
        rest = counts[~start].sum() + words
        out[:-1][~start] = np.log(counts[~start] / rest)
        out[-1] = np.log(words / rest)
        return out

    def first_weights(self) -> np.ndarray:
        """From the vocabulary's scores alone; half of the weight behind a word's first piece ends the word."""
        w = np.exp([p[2] for p in self.pieces])
        return self.weights(w, float(w[[not p[1] for p in self.pieces]].sum()))

    def _edges(self, letters: np.ndarray) -> Iterable[tuple[int, int, np.ndarray, np.ndarray]]:
        """(from, to, rows, piece of each row) for all pieces that fit; from 0 the pieces that start a word."""
        n, size = letters.shape
        coded = self.classes[letters]
        empty = self.first[0]
        if empty >= 0:  # the word mark alone: then an inner piece follows from place 0
            yield -1, 0, np.arange(n), np.full(n, empty)
        for i in range(size):
            rows, state = np.arange(n), np.zeros(n, np.int32)
            for j in range(i, min(size, i + self.width)):
                state = self.next[state, coded[rows, j]]
                alive = state != len(self.next) - 1
                rows, state = rows[alive], state[alive]
                if not len(rows):
                    break
                for start in (True, False) if i == 0 else (False,):
                    piece = (self.first if start else self.inner)[state]
                    fits = piece >= 0
                    if fits.any():
                        yield (-1 if start else i), j + 1, rows[fits], piece[fits]

    def forward(self, letters: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Natural log probability of each word (rows of bytes of one length)."""
        alpha = self._alpha(letters, weights, self._edges(letters))
        return alpha[-1] + weights[-1]

    def expected(self, letters: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Expected uses of each piece in the words."""
        n, size = letters.shape
        edges = list(self._edges(letters))
        alpha = self._alpha(letters, weights, edges)
        total = alpha[-1] + weights[-1]
        beta = np.full((size + 2, n), -np.inf)
        beta[size + 1] = weights[-1]
        out = np.zeros(len(weights) - 1)
        for a, b, rows, piece in sorted(edges, key=lambda e: (-e[0], -e[1])):
            step = weights[piece] + beta[b + 1, rows]
            beta[a + 1, rows] = np.logaddexp(beta[a + 1, rows], step)
            out += np.bincount(piece, np.exp(alpha[a + 1, rows] + step - total[rows]), minlength=len(out))
        return out

    def _alpha(self, letters: np.ndarray, weights: np.ndarray, edges: Iterable[tuple]) -> np.ndarray:
        n, size = letters.shape
        # row 0 is before the word mark, row k + 1 after k letters
        alpha = np.full((size + 2, n), -np.inf)
        alpha[0] = 0
        for a, b, rows, piece in edges:
            alpha[b + 1, rows] = np.logaddexp(alpha[b + 1, rows], alpha[a + 1, rows] + weights[piece])
        return alpha


LIMIT = 64
BATCH = 20_000


def batches_by_length(words: list[bytes]) -> Iterable[tuple[np.ndarray, np.ndarray]]:
    """(places, letters) of words of one length; a word beyond LIMIT bytes stands alone, one row at a time."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    for n in np.unique(sizes).tolist():
        at = np.flatnonzero(sizes == n)
        most = BATCH if n <= LIMIT else max(1, BATCH * LIMIT // n)
        for k in range(0, len(at), most):
            part = at[k : k + most]
            yield part, np.frombuffer(b"".join(words[i] for i in part), np.uint8).reshape(len(part), n)
