"""Periodic runs of words: Crochemore's partition refinement over whole texts.

Positions whose next l words are equal form a class of level l. Two neighbours in a class that are l
apart start a square of period l, and squares that start one after another make a run. From level l
to l + 1 a class falls apart by the classes of its members' right neighbours, and of the parts of a
class all but the largest do so at the next level: a position is moved each time its class halves.

Runs of exponent 4 and more are asked for, so the first levels (BULK of them) go over many texts at
once and leave only the stretches that can hold one: all their positions have an equal one within a
quarter of the stretch. Few of a text's positions are in one; those go through the refinement.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WORD, small_batches

WORDS = re.compile(WORD)
#: Levels taken over many texts at once, and the words of these texts.
BULK, MANY = 6, 200_000

Run = tuple[int, int, int]  # start, length, period


def _least(period: int, length: int, exponent: int) -> int:
    return max(length, exponent * period)


def refine(cls: list[int], level: int, top: int) -> Iterator[tuple[int, list[int]]]:
    """(period, ascending starts of its squares) for each period from ``level`` to ``top``, by the classes of a text's positions at ``level``.

    Only squares with a primitive root are met. Positions behind the last class have no factor of that length.
    """
    n = len(cls)
    cls = list(cls)
    size, head, last = defaultdict(int), {}, {}
    after, before = [-1] * n, [-1] * n
    gaps: dict[int, list[int]] = defaultdict(list)  # where neighbours came to be so far apart
    members: dict[int, list[int]] = defaultdict(list)
    for i, c in enumerate(cls):
        if (j := last.get(c, -1)) >= 0:
            after[j], before[i] = i, j
            if i - j <= top:
                gaps[i - j].append(j)
        else:
            head[c] = i
        last[c] = i
        size[c] += 1
        members[c].append(i)
    new = max(cls, default=-1) + 1
    small = [*members.values(), [n]]  # n stands for the end, before which no factor of the next length starts
    while True:
        if found := gaps.pop(level, None):
            starts = sorted({p for p in found if after[p] == p + level})
            if starts:
                yield level, starts
        level += 1
        if level > top or not small:
            return
        parts: dict[int, list[tuple[int, list[int]]]] = defaultdict(list)
        for splitter in small:
            here: dict[int, list[int]] = {}
            for j in splitter:
                i = j - 1
                if i < 0 or size[c := cls[i]] == 1:
                    continue
                p, q = before[i], after[i]
                if p >= 0:
                    after[p] = q
                else:
                    head[c] = q
                if q >= 0:
                    before[q] = p
                    if p >= 0 and level <= q - p <= top:
                        gaps[q - p].append(p)
                moved = here.get(c)
                if moved is None:
                    moved = here[c] = []
                    parts[c].append((new, moved))
                    p = -1
                    new += 1
                else:
                    p = moved[-1]
                    after[p] = i
                    if level <= i - p <= top:
                        gaps[i - p].append(p)
                before[i], after[i] = p, -1
                moved.append(i)
            for c, moved in here.items():
                size[c] -= len(moved)
        small = []
        for c, made in parts.items():
            rest = size[c]
            largest = max(made, key=lambda x: len(x[1]))
            for k, moved in made:
                size[k], head[k] = len(moved), moved[0]
                for i in moved:
                    cls[i] = k
                if k != largest[0] or rest >= len(moved):
                    small.append(moved)
            if 0 < rest < len(largest[1]):
                i, left = head[c], []
                while i >= 0:
                    left.append(i)
                    i = after[i]
                small.append(left)


def _runs(starts: np.ndarray, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of at least ``least`` words, by their squares' ascending starts."""
    edge = np.flatnonzero(np.diff(starts) != 1) + 1
    first, last = starts[np.r_[0, edge]], starts[np.r_[edge, len(starts)] - 1]
    length = last - first + 2 * period
    return first[length >= least], length[length >= least]


def find_runs(texts: list[list[str]], min_length: int = 6, min_exponent: int = 4) -> list[list[Run]]:
    """The runs of each text, a list of words, by start, then period.

    A run is a stretch with smallest period q, at least max(min_length, min_exponent * q) long,
    that can't be extended with this period. min_exponent is at least 3, as a shorter stretch might
    have positions without an equal one inside.
    """
    if min_exponent < 3:
        raise ValueError("min_exponent must be 3 or more")
    number: dict[str, int] = {}
    cls = np.array([number.setdefault(w, len(number)) for t in texts for w in t], np.int64)
    begin = np.cumsum([0, *map(len, texts)])
    pos, stretch = np.arange(len(cls)), np.repeat(np.arange(len(texts)), np.diff(begin))
    found: list[tuple[np.ndarray, np.ndarray, int]] = []
    for level in range(1, BULK + 1):
        if not len(pos):
            break
        order = np.lexsort((cls, stretch))
        same = (np.diff(stretch[order]) == 0) & (np.diff(cls[order]) == 0)
        gap = np.where(same, np.diff(pos[order]), len(begin) + begin[-1])
        squares = np.sort(pos[order[:-1][gap == level]])
        if len(squares):
            found.append((*_runs(squares, level, _least(level, min_length, min_exponent)), level))
        # who has an equal within what a run of its stretch can have as period, and so has its right neighbour
        near = np.full(len(pos), len(begin) + begin[-1])
        near[order[:-1]] = gap
        near[order[1:]] = np.minimum(near[order[1:]], gap)
        here = np.bincount(stretch)
        keep = near <= (here[stretch] + level - 1) // min_exponent
        on = np.flatnonzero(keep[:-1] & keep[1:] & (np.diff(stretch) == 0) & (np.diff(pos) == 1))
        value = np.empty(len(pos), np.int64)
        value[order] = np.cumsum(np.r_[0, ~same])
        pos, stretch, cls = pos[on], stretch[on], value[on] * len(value) + value[on + 1]
        stretch = np.cumsum(np.r_[0, (np.diff(pos) != 1) | (np.diff(stretch) != 0)])[: len(pos)]
        long = (np.bincount(stretch)[stretch] if len(pos) else stretch) + level >= _least(level + 1, min_length, min_exponent)
        pos, cls = pos[long], cls[long]
        stretch = np.unique(stretch[long], return_inverse=True)[1]
    edges = np.flatnonzero(np.diff(stretch)) + 1 if len(pos) else []
    for at, c in zip(np.split(pos, edges), np.split(cls, edges), strict=True):
        for period, starts in refine(c.tolist(), BULK + 1, (len(at) + BULK) // min_exponent):
            found.append((*_runs(at[0] + np.array(starts), period, _least(period, min_length, min_exponent)), period))
    out: list[list[Run]] = [[] for _ in texts]
    for first, length, period in found:
        text = np.searchsorted(begin, first, "right") - 1
        for t, s, n in zip(text.tolist(), (first - begin[text]).tolist(), length.tolist(), strict=True):
            out[t].append((s, n, period))
    return [sorted(runs, key=lambda r: (r[0], r[2])) for runs in out]


def collapsed(words: list[str], runs: list[Run]) -> list[str]:
    """words without those that any run holds after its first period."""
    if not runs:
        return words
    open_ = np.zeros(len(words) + 1, np.int64)
    for start, length, period in runs:
        open_[start + period] += 1
        open_[start + length] -= 1
    return [words[i] for i in np.flatnonzero(np.cumsum(open_[:-1]) == 0).tolist()]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4, words_of: Callable[[object, list[str]], list[str]] | None = None) -> DataFrame:
    """(id_col, n_words long, runs array<struct<start, length, period>>, collapsed string) of every row's whole text.

    Words are runs of anything but blanks and 0x09-0x0D; ``words_of`` may turn a row's id and words
    into others. runs are those of find_runs, numbered by words; collapsed is the text, words joined
    by a blank, of each run only the first period. Null and empty texts have no words, no runs and an
    empty text. Rows that repeat are treated alike; an empty table gives no rows; other columns are
    ignored.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    names = ["start", "length", "period"]

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, list[list[str]]]]:
        for batch in batches:
            ids, texts, at, held = batch.column(0), [], 0, 0
            for i, t in enumerate(batch.column(1)):
                words = WORDS.findall(t.as_py() or "")
                texts.append(words_of(ids[i].as_py(), words) if words_of else words)
                held += len(words)
                if held >= MANY:
                    yield ids.slice(at, len(texts)), texts
                    texts, at, held = [], i + 1, 0
            yield ids.slice(at, len(texts)), texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in parts(batches):
            runs = find_runs(texts, min_length, min_exponent)
            flat = np.array([r for rs in runs for r in rs], np.int64).reshape(-1, 3)
            ends = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
            listed = pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(c) for c in flat.T], names))
            short = pa.array([" ".join(collapsed(*x)) for x in zip(texts, runs, strict=True)], pa.string())
            yield pa.RecordBatch.from_arrays([ids, pa.array(list(map(len, texts)), pa.int64()), listed, short], names=[id_col, "n_words", "runs", "collapsed"])

    kinds = ", ".join(f"{n}: bigint" for n in names)
    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {kind}, n_words long, runs array<struct<{kinds}>>, collapsed string")
