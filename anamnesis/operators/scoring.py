"""Joint log-likelihoods of Arrow batches, class block by class block.

A model reaches the executors as blocks of classes of a bounded size. A batch goes through all blocks; each
row carries its best classes, the sum of all likelihoods and the likelihood of its own class from block
to block. Rows are not shuffled, and a worker holds one block at a time.

The sum is kept as a number and a power of two and is added up class by class in label order, so how the
classes are cut into blocks changes no bit of any answer.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows x classes that are scored at once, and rows at most.
CHUNK_CELLS, CHUNK_ROWS = 2_000_000, 1024
_LN2 = float(np.log(2.0))
_NONE = -(1 << 40)


def _power_and_rest(scores: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """exp(s) as rest x 2^power; nothing for classes that are out of the question."""
    there = np.isfinite(scores)
    safe = np.where(there, scores, 0.0)
    power = np.floor(safe / _LN2)
    rest = np.where(there, np.exp(safe - power * _LN2), 0.0)
    return np.where(there, power, _NONE).astype(np.int64), rest


def _shift(values: np.ndarray, by: np.ndarray) -> np.ndarray:
    return np.ldexp(values, np.clip(by, -2000, 2000).astype(np.int32))


class _Rows:
    """The rows of a batch that one model scores, and what they carry from block to block."""

    def __init__(self, words: pa.Array, numbers: pa.Array, own: pa.Array, top: int | None) -> None:
        self.size, self.top = len(own), top
        self.lengths = pc.list_value_length(words).fill_null(0).to_numpy().astype(np.int64)
        self.words = words.flatten()
        self.values = numbers.flatten().to_numpy(zero_copy_only=False).reshape(self.size, -1)
        self.own = own
        self.labels: list[str | None] = []
        self.score = np.empty((self.size, 0))
        self.place = np.empty((self.size, 0), np.int64)
        self.total, self.power = np.zeros(self.size), np.full(self.size, _NONE, np.int64)
        self.own_score = np.full(self.size, np.nan)

    def add(self, block: dict) -> None:
        """Score one block of classes and merge it in."""
        first, classes = len(self.labels), len(block["labels"])
        self.labels += block["labels"]
        codes = pc.index_in(self.words, value_set=block["words"]).fill_null(-1).to_numpy(zero_copy_only=False)
        row = np.repeat(np.arange(self.size), self.lengths)[codes >= 0]
        codes = codes[codes >= 0]
        known = np.bincount(row, minlength=self.size)
        starts = np.cumsum(known) - known
        at_own = pc.index_in(self.own, value_set=pa.array(block["labels"], pa.string())).fill_null(-1).to_numpy(zero_copy_only=False)
        kept = classes if self.top is None else min(self.top, classes)
        score, place = np.empty((self.size, kept)), np.empty((self.size, kept), np.int64)
        step = max(1, min(CHUNK_ROWS, CHUNK_CELLS // max(1, classes)))
        for a in range(0, self.size, step):
            b = min(self.size, a + step)
            scores = self._scores(block, codes, starts[a:b], known[a:b], self.values[a:b])
            power, rest = _power_and_rest(scores)
            highest = np.maximum(self.power[a:b], power.max(axis=1))
            terms = np.concatenate([_shift(self.total[a:b], self.power[a:b] - highest)[:, None], _shift(rest, power - highest[:, None])], axis=1)
            self.total[a:b], self.power[a:b] = np.add.accumulate(terms, axis=1)[:, -1], highest
            picked = top_columns(scores, kept) if self.top is not None else np.broadcast_to(np.arange(classes), scores.shape)
            score[a:b], place[a:b] = np.take_along_axis(scores, picked, axis=1), first + picked
            hit = np.flatnonzero(at_own[a:b] >= 0)
            self.own_score[a + hit] = scores[hit, at_own[a:b][hit]]
        self.score, self.place = np.concatenate([self.score, score], axis=1), np.concatenate([self.place, place], axis=1)
        if self.top is not None and first:
            # Earlier classes stand first, so equal scores keep the order of labels.
            picked = np.argsort(-self.score, axis=1, kind="stable")[:, : self.top]
            self.score, self.place = np.take_along_axis(self.score, picked, axis=1), np.take_along_axis(self.place, picked, axis=1)

    @staticmethod
    def _scores(block: dict, codes: np.ndarray, starts: np.ndarray, known: np.ndarray, values: np.ndarray) -> np.ndarray:
        """Rows x classes; the tokens of a row are added one after the other."""
        scores = np.repeat(block["base"][None, :], len(known), axis=0)
        order = np.argsort(-known, kind="stable")
        for k in range(int(known.max(initial=0))):
            rows = order[: np.searchsorted(-known[order], -k, "left")]
            scores[rows] += block["matrix"][codes[starts[rows] + k]]
        for j in range(values.shape[1]):
            x, mean, var = values[:, j, None], block["mean"][j], block["var"][j]
            scores += np.where(np.isnan(x), 0.0, -0.5 * np.log(2 * np.pi * var) - (x - mean) ** 2 / (2 * var))
        return scores

    def _share(self, scores: np.ndarray) -> np.ndarray:
        power, rest = _power_and_rest(scores)
        wide = (slice(None),) + (None,) * (scores.ndim - 1)
        return _shift(rest, power - self.power[wide]) / self.total[wide]

    def tops(self) -> tuple[pa.Array, pa.Array]:
        """Per row: the best classes with their probabilities, and that of its own class."""
        names = pa.array(self.labels, pa.string()).take(pa.array(self.place.ravel()))
        items = pa.StructArray.from_arrays([names, pa.array(self._share(self.score).ravel())], names=["label", "p"])
        own = self._share(np.where(np.isnan(self.own_score), -np.inf, self.own_score))
        return _lists(items, self.size, self.place.shape[1]), pa.array(own, mask=np.isnan(self.own_score))

    def logs(self) -> pa.Array:
        """Per row: all classes in label order with the logarithms of their probabilities."""
        names = pa.array(self.labels, pa.string()).take(pa.array(self.place.ravel()))
        whole = np.log(self.total) + self.power * _LN2
        items = pa.StructArray.from_arrays([names, pa.array((self.score - whole[:, None]).ravel())], names=["label", "log_p"])
        return _lists(items, self.size, self.place.shape[1])


def _lists(items: pa.Array, size: int, each: int) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(size + 1, dtype=np.int32) * each), items)


def top_columns(scores: np.ndarray, top: int) -> np.ndarray:
    """Columns of the ``top`` largest scores per row, ties by column."""
    if top >= scores.shape[1]:
        return np.argsort(-scores, axis=1, kind="stable")
    part = np.sort(np.argpartition(-scores, top - 1, axis=1)[:, :top], axis=1)
    held = np.take_along_axis(scores, part, axis=1)
    out = np.take_along_axis(part, np.argsort(-held, axis=1, kind="stable"), axis=1)
    # A tie across the cut: sort those rows in full.
    tied = np.flatnonzero((scores >= held.min(axis=1, keepdims=True)).sum(axis=1) > top)
    if len(tied):
        out[tied] = np.argsort(-scores[tied], axis=1, kind="stable")[:, :top]
    return out


def score_batch(blocks: Sequence, which: pa.Array, words: pa.Array, numbers: pa.Array, own: pa.Array, top: int | None) -> pa.Array:
    """One Arrow batch through all blocks, each row by the model its key names.

    ``blocks`` are broadcasts of {key: block}. With a ``top`` the result is (top, own), without one the list of all classes.
    """
    parts, places = {}, []
    names = pc.unique(which).to_pylist()
    for name in names:
        at = pc.indices_nonzero(pc.equal(which, name))
        whole = len(names) == 1
        parts[name] = _Rows(*(x if whole else x.take(at) for x in (words, numbers, own)), top)
        places.append(at.to_numpy())
    for shared in blocks:
        held = shared.value
        for name, rows in parts.items():
            if name in held:
                rows.add(held[name])
        if len(blocks) > 1:
            # The worker keeps the file of a block, not the block.
            del held, shared._value
    for name, rows in parts.items():
        if not rows.labels:
            raise ValueError(f"no model has the key {name!r} of a row")
    if top is None:
        out = [rows.logs() for rows in parts.values()]
    else:
        out = [pa.StructArray.from_arrays(rows.tops(), names=["top", "own"]) for rows in parts.values()]
    if len(out) == 1:
        return out[0]
    back = np.argsort(np.concatenate(places), kind="stable")
    return pa.concat_arrays(out).take(pa.array(back))
