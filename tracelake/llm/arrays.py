"""Texts as numpy arrays, in chunks that bound a task's memory."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np

CHUNK = 400_000


def chunks(texts: Iterable[str | None], limit: int = CHUNK) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of consecutive rows that have about limit characters together; null counts as empty."""
    first, held, n = 0, [], 0
    for i, t in enumerate(texts):
        if held and n + len(t or "") > limit:
            yield first, held
            first, held, n = i, [], 0
        held.append(t if isinstance(t, str) else "")
        n += len(held[-1])
    if held:
        yield first, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All texts, each followed by a newline, as code points; and where each begins, with the end added."""
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    return points, np.concatenate(([0], np.cumsum([len(t) + 1 for t in texts])))


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def random64(n: int, seed: int) -> np.ndarray:
    """n fixed odd 64-bit numbers."""
    return mix64(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed)) | np.uint64(1)


def word_table() -> np.ndarray:
    """Whether each code point below 0x3000 belongs to a word of letters and digits; the last entry is for the rest."""
    return np.array([chr(i).isalnum() for i in range(0x3000)] + [True])


_POWERS = random64(64, 9)


def word_hashes(points: np.ndarray, at: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text of every word of letters and digits."""
    inside = table[np.minimum(points, len(table) - 1)]
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside, [False])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    since = np.arange(len(points)) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(points)]))))
    value = np.where(inside, (points.astype(np.uint64) + np.uint64(1)) * _POWERS[since & 63], np.uint64(0))
    return mix64(np.add.reduceat(value, starts) + (ends - starts).astype(np.uint64)), np.searchsorted(at, starts, "right") - 1
