"""Linear classifiers over selected features of words, shared by the text classifiers.

Every word has a few hashed features. Those whose presence in texts depends
most on the label (chi-squared) are selected, and a logistic regression is
fitted on them by Newton steps. Most words have no selected feature, so
scoring is one look-up per distinct word.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable
from itertools import batched

import numpy as np

#: Places of hashed features.
SPACE = 1 << 20
#: Selected features of a model at most, and the least chi-squared of one.
SELECTED, LEAST = 400, 12.0
#: A selected feature is in so many texts at least, and as many are without it.
RARELY = 3
#: Entries of a worker's memory of words; beyond it the memory starts anew.
MEMORY = 300_000
#: Longer words count by their pieces.
LONGEST = 64
_APART = re.compile(rb"[^0-9A-Za-z\x80-\xff]+")
PUNCTUATION = b".,!?|#$%&*\"'()<>:;=-_[]{}"

Features = Callable[[bytes], np.ndarray]


def words_of(text: bytes) -> list[bytes]:
    """The words of a text; in place of a very long one its pieces between other marks, of ``LONGEST`` bytes at most."""
    words = text.split()
    if max(map(len, words), default=0) <= LONGEST:
        return words
    out = []
    for word in words:
        if len(word) <= LONGEST:
            out.append(word)
        else:
            out += [piece[i : i + LONGEST] for piece in _APART.split(word) for i in range(0, len(piece), LONGEST)]
    return out


def _hashed(*parts: tuple[bytes, bytes]) -> np.ndarray:
    return np.array([zlib.crc32(kind + part) % SPACE for kind, part in parts], np.int32)


def meaning_features(word: bytes) -> np.ndarray:
    """What a word says: its letters without case and punctuation, and its beginnings."""
    plain = word.lower().strip(PUNCTUATION)
    return _hashed((b"w", plain), (b"4", plain[:4]), (b"5", plain[:5]), (b"6", plain[:6]), (b"7", plain[:7]), (b"9", plain[:9]))


def shape_features(word: bytes) -> np.ndarray:
    """How a word looks: its marks, case, digits and length, next to its letters."""
    plain = word.strip(PUNCTUATION)
    marks = bytes(sorted(set(word) & set(PUNCTUATION)))
    case = b"U" if plain.isupper() else b"l" if plain.islower() else b"t" if plain.istitle() else b"x"
    digit = b"1" if any(48 <= c < 58 for c in word) else b"0"
    return _hashed((b"m", marks), (b"c", case + marks), (b"n", b"%d" % min(len(plain) // 3, 9)), (b"w", plain.lower()), (b"d", digit), (b"u", case))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _occurring(words: list[bytes], share: bool) -> dict[bytes, int]:
    """The words that count and how often: all if shares are asked for, else each distinct one once."""
    return Counter(words) if share else dict.fromkeys(words, 1)


def _scaled(counts: np.ndarray, sizes: np.ndarray, share: bool) -> np.ndarray:
    """A feature's value from the number of words that have it: their share, or a logarithm."""
    return np.sqrt(counts / np.maximum(sizes, 1)[:, None]) if share else np.log1p(counts)


class WordTable:
    """Texts as distinct words with features, for selecting and fitting."""

    def __init__(self, texts: list[bytes], features: Features, share: bool):
        self.share, self.n = share, len(texts)
        self.sizes = np.zeros(self.n, np.int64)
        place: dict[bytes, int] = {}
        lists = []  # per text, its words' places and how often they count
        for i, text in enumerate(texts):
            words = _occurring(words_of(text), share)
            self.sizes[i] = sum(words.values())
            lists.append((np.fromiter((place.setdefault(w, len(place)) for w in words), np.int32, len(words)), np.fromiter(words.values(), np.float32, len(words))))
        table = np.concatenate([np.array([features(w) for w in some], np.int32) for some in batched(place, 4096)]) if place else np.zeros((0, 1), np.int32)
        del place
        present = np.zeros(SPACE, np.int32)
        for words, _ in lists:
            present[np.unique(table[words].ravel())] += 1
        ends = np.zeros(self.n + 1, np.int64)
        feature, counts = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
        for i, (words, times) in enumerate(lists):
            found, where = np.unique(table[words].ravel(), return_inverse=True)
            often = present[found] >= RARELY
            feature.append(found[often])
            counts.append(np.bincount(where.ravel(), np.repeat(times, table.shape[1]), len(found)).astype(np.float32)[often])
            ends[i + 1] = ends[i] + int(often.sum())
        del lists, table
        self.feature, self.counts = np.concatenate(feature), np.concatenate(counts)
        self.text = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ends))

    def select(self, y: np.ndarray, rows: np.ndarray, most: int = SELECTED) -> np.ndarray:
        """The features whose presence depends most on ``y`` among ``rows`` (both masks by text)."""
        n, n1 = float(rows.sum()), float(y[rows].sum())
        present = np.bincount(self.feature[rows[self.text]], minlength=SPACE)
        some = np.flatnonzero((present >= RARELY) & (present <= n - RARELY))
        a = np.bincount(self.feature[(rows & (y == 1))[self.text]], minlength=SPACE)[some].astype(float)
        b = present[some] - a
        c, d = n1 - a, n - n1 - b
        chi = n * (np.abs(a * d - b * c) - n / 2).clip(0) ** 2 / np.maximum((a + b) * (c + d) * (a + c) * (b + d), 1e-9)
        best = np.argsort(-chi, kind="stable")[:most]
        return np.sort(some[best[chi[best] >= LEAST]])

    def matrix(self, selected: np.ndarray) -> np.ndarray:
        counts = np.zeros((self.n, len(selected)))
        place = np.full(SPACE, -1, np.int16)
        place[selected] = np.arange(len(selected))
        at = place[self.feature]
        hit = at >= 0
        counts[self.text[hit], at[hit]] = self.counts[hit]
        return _scaled(counts, self.sizes, self.share)


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, steps: int = 25) -> np.ndarray:
    """Weights, the intercept last, of a logistic regression with squared penalty, by damped Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    w = np.zeros(x.shape[1])
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-6

    def loss(w: np.ndarray) -> float:
        z = np.clip(x @ w, -40, 40)
        return float((weight * (np.log1p(np.exp(-np.abs(z))) + np.maximum(z, 0) - y * z)).sum() + (ridge * w * w).sum() / 2)

    now = loss(w)
    for _ in range(steps):
        p = sigmoid(x @ w)
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(h, x.T @ (weight * (p - y)) + ridge * w)
        scale = 1.0
        while scale > 1e-3 and loss(w - scale * step) > now:
            scale /= 2
        w, before = w - scale * step, now
        now = loss(w)
        if before - now < 1e-6 * max(1.0, abs(now)):
            break
    return w


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept that turn scores into log odds, with smoothed targets."""
    n1, n0 = y.sum(), (1 - y).sum()
    target = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = logistic(z[:, None], target, np.ones(len(z)), penalty=1e-3)
    return float(a), float(b)


class WordScorer:
    """Values of selected features for texts; a word's features are looked up once per worker."""

    def __init__(self, selected: np.ndarray, features: Features, share: bool):
        self.selected, self.features, self.share = selected, features, share
        self.known: dict[bytes, int] = {}
        self.hits: list[np.ndarray] = [np.zeros(0, np.int64)]  # at 0: words without a selected feature

    def _learn(self, new: list[bytes]) -> None:
        table = np.array([self.features(w) for w in new])
        at = np.minimum(np.searchsorted(self.selected, table), len(self.selected) - 1)
        found = self.selected[at] == table
        any_ = found.any(1)
        for word, some, row, mask in zip(new, any_.tolist(), at, found, strict=True):
            if some:
                self.known[word] = len(self.hits)
                self.hits.append(row[mask])
            else:
                self.known[word] = 0

    def values(self, split: list[list[bytes]]) -> np.ndarray:
        sets = [_occurring(x, self.share) for x in split]
        sizes = np.array([len(x) for x in (split if self.share else sets)], np.int64)
        counts = np.zeros((len(sets), len(self.selected)))
        if len(self.selected):
            new = set().union(*sets).difference(self.known)
            if len(self.known) + len(new) > MEMORY:
                self.known.clear()
                del self.hits[1:]
                new = set().union(*sets)
            if new:
                self._learn(list(new))
            look = self.known.__getitem__
            for i, words in enumerate(sets):
                hit = [(k, n) for k, n in zip(map(look, words), words.values(), strict=True) if k]
                if hit:
                    rows = [self.hits[k] for k, _ in hit]
                    times = np.repeat([n for _, n in hit], [len(r) for r in rows])
                    counts[i] = np.bincount(np.concatenate(rows), times, len(self.selected))
        return _scaled(counts, sizes, self.share)


def folds(ids: np.ndarray, n: int) -> np.ndarray:
    """A fold for each id, the same on every run."""
    return np.array([zlib.crc32(b"fold:%d" % i) % n for i in ids.tolist()], np.int64)
