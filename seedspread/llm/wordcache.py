"""Scores of words, computed in bulk for the words of a batch that are new and kept for the next batches of a worker."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa

#: Bytes of words (``ENTRY`` more for each) beyond which a cache drops the half of them that was met least recently.
CACHE_BYTES, ENTRY = 16_000_000, 150
#: Characters of text that are looked up at once.
CHUNK_CHARS = 1_000_000

_live: dict = {}


def live[T](key: tuple, make: Callable[[], T]) -> T:
    """The one large state that a worker process keeps between tasks: another ``key`` drops it before ``make`` is called."""
    if key not in _live:
        release()
        _live[key] = make()
    return _live[key]


def release() -> None:
    """Drops the worker's state and gives its memory back: for states that are made anew quickly, so that a worker that waits for
    tasks of a later stage holds nothing."""
    _live.clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library keeps freed memory otherwise
    if trim:
        trim(0)


def releasing[**P, T](run: Callable[P, Iterator[T]]) -> Callable[P, Iterator[T]]:
    """``run``, with the worker's state released at the end of each task."""

    def wrapped(*args: P.args, **kwargs: P.kwargs) -> Iterator[T]:
        try:
            yield from run(*args, **kwargs)
        finally:
            release()

    return wrapped


class WordCache:
    """``score``: from a list of distinct words to a float32 matrix with a row for each."""

    def __init__(self, score: Callable[[list[str]], np.ndarray], width: int):
        self.score, self.width = score, width
        self.place: dict[str, int] = {}
        self.rows = np.zeros((0, width), np.float32)
        self.met = np.zeros(0, np.int64)
        self.now = self.held = 0

    def learn(self, words: set[str]) -> None:
        """Makes ``words`` known."""
        self.now += 1
        if self.held > CACHE_BYTES:
            self.forget()
        new = [w for w in words if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.place), len(self.place) + len(new)), strict=True))
            self.rows = np.concatenate([self.rows, self.score(new)])
            self.met = np.append(self.met, np.zeros(len(new), np.int64))
            self.held += sum(map(len, new)) + ENTRY * len(new)
        self.met[np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))] = self.now

    def forget(self) -> None:
        keep = self.met > np.median(self.met)
        words = [w for w, k in zip(self.place, keep.tolist(), strict=True) if k]
        self.place, self.rows, self.met = dict(zip(words, range(len(words)), strict=True)), self.rows[keep], self.met[keep]
        self.held = sum(map(len, words)) + ENTRY * len(words)

    def texts(self, texts: list[str | None]):
        """Yields the matrix of the words of each text (white space apart), in order."""
        at = 0
        while at < len(texts):
            held, size = [], 0
            while at < len(texts) and size < CHUNK_CHARS:
                size += len(texts[at] or "")
                held.append((texts[at] or "").split())
                at += 1
            self.learn(set().union(*held))
            get = self.place.__getitem__
            for words in held:
                yield self.rows[np.fromiter(map(get, words), np.int64, len(words))]
