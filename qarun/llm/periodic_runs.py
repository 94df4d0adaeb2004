"""Periodic runs of words, found by common extensions of Lyndon roots."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from itertools import compress
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from qarun.llm.shingles import mixed
from qarun.llm.suffix_tree import SuffixTree

# Words that a run has at least; a run also holds its period twice.
SHORTEST = 12
# Any run is covered by word sequences of this length that come twice in it: a run of length
# m >= max(12, 2q) has m - q >= 6, so each sequence of 6 in its first m - q words comes
# again q words on, and both copies together cover the run.
COVER = 6


class Run(NamedTuple):
    start: int
    length: int
    period: int


def _covered(symbols: np.ndarray) -> np.ndarray:
    """Marks the words that lie in a sequence of ``COVER`` words found twice."""
    n = len(symbols)
    if n < SHORTEST:
        return np.zeros(n, bool)
    spread = mixed(symbols.astype(np.uint64) + np.uint64(1))
    key = np.zeros(n - COVER + 1, np.uint64)
    for i in range(COVER):
        key = key * np.uint64(0x9E3779B97F4A7C15) + spread[i : n - COVER + 1 + i]
    order = np.argsort(key, kind="stable")
    key = key[order]
    same = key[1:] == key[:-1]
    twice = order[np.r_[same, False] | np.r_[False, same]]
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, twice, 1)
    np.add.at(steps, twice + COVER, -1)
    return np.cumsum(steps[:-1]) > 0


def _stretches(symbols: np.ndarray) -> list[tuple[int, int]]:
    """Stretches outside of which no run has a word.

    A run lies whole in a stretch of words covered by sequences that repeat in that very
    stretch, so stretches are cut again until nothing changes.
    """
    done, open_ = [], [(0, len(symbols))]
    while open_:
        low, high = open_.pop()
        marks = _covered(symbols[low:high])
        if len(marks) and marks.all():
            done.append((low, high))
            continue
        edges = np.flatnonzero(np.diff(np.r_[False, marks, False]))
        for a, b in zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True):
            if b - a >= SHORTEST:
                open_.append((low + a, low + b))
    return sorted(done)


def _next_smaller(rank: list[int]) -> np.ndarray:
    """For each suffix the next one to the right with a smaller rank; the last has the smallest."""
    after = [0] * len(rank)
    stack: list[int] = []
    for at, value in enumerate(rank):
        while stack and rank[stack[-1]] > value:
            after[stack.pop()] = at
        stack.append(at)
    return np.array(after[:-1], np.int64)


def _runs_within(symbols: list[int]) -> np.ndarray:
    """All runs of a sequence as rows ``start, length, period``.

    In one of the two orders of the alphabet the longest Lyndon word at some place of a run is
    a root of it. So each place gives two candidates, each the longest Lyndon word there,
    which ends before the next smaller suffix. The extension of a root to the right is a common
    prefix of two suffixes, and to the left one of the reversed sequence.
    """
    n = len(symbols)
    forward, backward = SuffixTree(symbols), SuffixTree(symbols[::-1])
    at = np.tile(np.arange(n), 2)
    after = np.r_[_next_smaller(forward.rank), _next_smaller(forward.reversed_rank())]
    period = after - at
    fits = (at + period <= n) & (period <= n // 2)
    at, after, period = at[fits], after[fits], period[fits]
    right = forward.extension(at, after)
    left = backward.extension(n - at, n - after)
    length = period + left + right
    found = length >= np.maximum(SHORTEST, 2 * period)
    runs = np.stack([(at - left)[found], length[found], period[found]], axis=1)
    return np.unique(runs, axis=0)


def numbered(words: list) -> np.ndarray:
    """The words as numbers from 1, equal for equal words."""
    numbers: dict = {}
    return np.array([numbers.setdefault(word, len(numbers) + 1) for word in words], np.int64)


def runs_of(words: list) -> list[Run]:
    """Every run of a word sequence, by start, then period."""
    symbols = numbered(words)
    found = []
    for low, high in _stretches(symbols):
        own = np.unique(symbols[low:high], return_inverse=True)[1] + 1
        found += [Run(low + s, m, q) for s, m, q in _runs_within(own.tolist()).tolist()]
    return sorted(found, key=lambda run: (run.start, run.period))


def kept_words(words: list, runs: list[Run]) -> list:
    """The words that no run contains after its first period."""
    if not runs:
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        steps[start + period] += 1
        steps[start + length] -= 1
    return list(compress(words, np.cumsum(steps[:-1]) == 0))


RESULT = T.StructType(
    [
        T.StructField("n_words", T.LongType()),
        T.StructField(
            "runs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType()),
                        T.StructField("length", T.LongType()),
                        T.StructField("period", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("collapsed", T.StringType()),
    ]
)
_RUNS_ARROW = pa.list_(
    pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
)

Change = Callable[[object, list[bytes]], list[bytes]]


def periodic_runs(
    docs: DataFrame, id: str = "doc_id", text: str = "text", change: Change | None = None
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_words, runs, collapsed``.

    A run is a stretch of at least ``SHORTEST`` words with smallest period q that holds the
    period at least twice and that no neighbouring word extends keeping it. Words are what
    ``[\\x20\\x09-\\x0D]`` separates. ``runs`` has ``start, length, period`` of each, by start, then
    period; ``collapsed`` has the words that no run contains after its first period,
    joined by one space.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``. Long texts are
    read whole; a text that is one run of a million words takes some 0.6 GB in its task.
    Repeated rows and ids give a row each, a null id stays null, an empty table gives no rows,
    and other columns are not read. ``change(id, words)`` may alter the words before the search.

    Texts are worked on where they are read, one after another, without a shuffle. Suffix trees
    are built for the stretches in which words are covered by repeats of six words, as
    no run has a word outside of them.
    """
    rows = docs.select(F.col(id).alias("doc_id"), F.col(text).cast("binary").alias("text"))
    schema = T.StructType([rows.schema["doc_id"], *RESULT.fields])

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for low in range(0, batch.num_rows, 256):
                sizes, runs, left = [], [], []
                some = ids.slice(low, 256)
                for key, value in zip(some.to_pylist(), texts.slice(low, 256), strict=True):
                    words = (value.as_py() or b"").split()
                    if change is not None:
                        words = change(key, words)
                    own = runs_of(words)
                    sizes.append(len(words))
                    runs.append([run._asdict() for run in own])
                    left.append(b" ".join(kept_words(words, own)).decode())
                yield pa.RecordBatch.from_arrays(
                    [some, pa.array(sizes, pa.int64()), pa.array(runs, _RUNS_ARROW), pa.array(left, pa.string())],
                    names=schema.names,
                )

    return rows.mapInArrow(found, schema)


def looped(key: object, words: list) -> list:
    """The words of a document, of which one in ten, by the checksum of its id, ends in a loop.

    With h the crc32 of the decimal id and h divisible by 10, each word from place
    a = g % n on, g = h // 10, is one of the p = 1 + (n - a) // (3 + g % 8) words there.
    """
    n = len(words)
    h = zlib.crc32(b"" if key is None else str(key).encode())
    if key is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    loop = words[a : a + p]
    return words[:a] + [loop[i % p] for i in range(n - a)]


def run_digests(found: DataFrame) -> DataFrame:
    """The longest run, and digests of all runs and of the collapsed text, per row of ``found``."""
    top = F.get(F.array_sort("runs", _longest_first), 0)
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    listed = F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise(""))
    return found.withColumn("top", top).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "top.start",
        "top.length",
        "top.period",
        F.expr("1000 * top.length div top.period").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def _longest_first(a, b):
    def key(r):
        return F.struct(-r["length"], r["start"], r["period"])

    return F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0)

