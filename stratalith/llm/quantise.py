"""Additive quantisation of unit vectors, and the coarse cells that hold them (numpy only)."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


def kmeans(x: np.ndarray, k: int, rng: np.random.Generator, steps: int = 12) -> np.ndarray:
    """Lloyd's centres; a centre that loses all its points takes the farthest one."""
    k = max(1, min(k, len(x)))
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(steps):
        near, dist = assign(x, centres)
        order = near.argsort(kind="stable")
        counts = np.bincount(near, minlength=k)
        filled = np.flatnonzero(counts)
        sums = np.zeros_like(centres)
        sums[filled] = np.add.reduceat(x[order], np.r_[0, np.cumsum(counts[filled])[:-1]], axis=0)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], centres).astype(np.float32)
        empty = np.flatnonzero(counts == 0)
        if len(empty):
            centres[empty] = x[np.argsort(-dist)[: len(empty)]]
    return centres


def assign(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = (centres**2).sum(1)[None, :] - 2 * x @ centres.T
    near = d.argmin(1)
    return near, d[np.arange(len(x)), near] + (x**2).sum(1)


BEAM_CELLS = 32  # words of the first level whose cells are looked at
CELL_FLOATS = 8_000_000  # distances to cells held at once


@dataclass(frozen=True)
class Cells:
    """Coarse cells in two levels: the centre of cell i * len(second) + j is first[i] + second[j],
    so that n cells need 2 sqrt(n) words and a bounded sample can fit them."""

    first: np.ndarray
    second: np.ndarray

    def __len__(self) -> int:
        return len(self.first) * len(self.second)

    def nearest(self, x: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first."""
        k = len(self.second)
        b = min(len(self.first), max(BEAM_CELLS, -(-n // k)))  # all cells where all are asked for
        n = min(n, b * k)
        norms = (self.first**2).sum(1)[:, None] + (self.second**2).sum(1)[None, :] + 2 * self.first @ self.second.T
        out = []
        step = max(1, CELL_FLOATS // (b * k))
        for i in range(0, len(x), step):
            part = x[i : i + step]
            one, two = part @ self.first.T, part @ self.second.T
            best = np.argpartition((self.first**2).sum(1) - 2 * one, b - 1, axis=1)[:, :b]
            d = norms[best] - 2 * np.take_along_axis(one, best, 1)[:, :, None] - 2 * two[:, None, :]
            cell = (best[:, :, None] * k + np.arange(k)).reshape(len(part), -1)
            d = d.reshape(len(part), -1)
            near = np.argpartition(d, n - 1, axis=1)[:, :n]
            near = np.take_along_axis(near, np.take_along_axis(d, near, 1).argsort(1, kind="stable"), 1)
            out.append(np.take_along_axis(cell, near, 1))
        return np.concatenate(out).astype(np.int64) if out else np.empty((0, n), np.int64)


def fit_cells(x: np.ndarray, cells: int, rng: np.random.Generator, rounds: int = 5) -> Cells:
    """Residual k-means, then least squares for one level given the other in turn. Centres start
    from random rows, so a dense region gets cells in proportion to its rows."""
    side = max(1, int(np.ceil(np.sqrt(cells))))
    first = kmeans(x, side, rng)
    second = kmeans(x - first[assign(x, first)[0]], side, rng)
    for _ in range(rounds):
        cell = Cells(first, second).nearest(x, 1)[:, 0]
        i, j = cell // len(second), cell % len(second)
        first = _means(x - second[j], i, first)
        second = _means(x - first[i], j, second)
    return Cells(first, second)


def _means(x: np.ndarray, group: np.ndarray, old: np.ndarray) -> np.ndarray:
    sums = np.zeros_like(old, np.float64)
    np.add.at(sums, group, x)
    counts = np.bincount(group, minlength=len(old))
    return np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], old).astype(np.float32)


@dataclass(frozen=True)
class Quantiser:
    """``books`` codebooks of full-dimensional words (books x words x dim); a vector is the sum
    of one word of each. ``cells`` are the coarse centres of the inverted lists."""

    words: np.ndarray
    cells: Cells
    beam: int = 8

    def encode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(codes, squared norms of the reconstructions) by beam search over the codebooks."""
        n, (books, size, _) = len(x), self.words.shape
        norms = (self.words**2).sum(2)
        residual = x[:, None, :]
        codes = np.zeros((n, 1, 0), np.uint8)
        error = (x**2).sum(1)[:, None]
        for m in range(books):
            # every kept path tries every word: |r - w|^2 = |r|^2 - 2 r.w + |w|^2
            cost = error[:, :, None] - 2 * residual @ self.words[m].T + norms[m]
            flat = cost.reshape(n, -1)
            keep = min(self.beam, flat.shape[1])
            best = np.argpartition(flat, keep - 1, axis=1)[:, :keep]
            path, word = best // size, (best % size).astype(np.uint8)
            rows = np.arange(n)[:, None]
            codes = np.concatenate([codes[rows, path], word[:, :, None]], axis=2)
            residual = residual[rows, path] - self.words[m][word]
            error = flat[rows, best]
        first = error.argmin(1)
        codes = codes[np.arange(n), first]
        return codes, (self.decode(codes) ** 2).sum(1)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(self.words[m][codes[:, m]] for m in range(self.words.shape[0]))

    def distances(self, q: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """|x|^2 - 2 q.x for all pairs from lookup tables and stored norms; no vector is rebuilt."""
        books, size, dim = self.words.shape
        tables = self.words.reshape(-1, dim) @ (-2 * q.T)
        # whole rows of a table are taken, one per member: all queries' values lie side by side
        d = np.take(tables, codes[:, 0], axis=0)
        row = np.empty_like(d)
        for m in range(1, books):
            d += np.take(tables, codes[:, m] + np.int64(m * size), axis=0, out=row, mode="clip")
        d += norms[:, None]
        return d.T


def fit(x: np.ndarray, cells: int, books: int = 8, words: int = 128, rounds: int = 1, seed: int = 7) -> Quantiser:
    """Residual k-means gives the first codebooks; then beam encoding and a joint least-squares
    solution for all words alternate."""
    rng = np.random.default_rng(seed)
    x = x.astype(np.float32)
    coarse = fit_cells(x, cells, rng)
    words = max(1, min(words, len(x)))
    table = np.zeros((books, words, x.shape[1]), np.float32)
    residual = x.copy()
    for m in range(books):
        centres = kmeans(residual, words, rng, 8)
        table[m, : len(centres)] = centres
        residual = residual - centres[assign(residual, centres)[0]]
    for _ in range(rounds):
        old = Quantiser(table, coarse)
        codes = np.concatenate([old.encode(x[i : i + 2_000])[0] for i in range(0, len(x), 2_000)])
        flat = codes.astype(np.int64) + np.arange(books) * words
        total = books * words
        used = np.zeros((len(x), total), np.float32)
        used[np.arange(len(x))[:, None], flat] = 1.0
        gram = (used.T @ used).astype(np.float64)
        right = (used.T @ x).astype(np.float64)
        gram[np.diag_indices_from(gram)] += 1e-2
        # words nobody uses keep their place near their ridge prior, the word itself
        right += 1e-2 * table.reshape(-1, x.shape[1])
        table = np.linalg.solve(gram, right).reshape(table.shape).astype(np.float32)
    return Quantiser(table, coarse)
