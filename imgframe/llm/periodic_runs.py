"""Periodic runs of words in texts, by partition refinement.

Two places of a text are in one class at level l if the same l words begin there. Classes of level l + 1 come from those
of level l by what follows: a place goes where the class of the place after it goes. Crochemore's refinement moves
places only for classes that were split off as the smaller parts (all but the largest) one level before, so that a
place moves O(log n) times. Where two neighbours of a class at level l are l places apart, a square begins, and its
half is primitive, as neighbours have nothing of their class between them. Squares at consecutive places with one l
make up a run of period l.

The first levels are refined for many texts at once, by sorting what is not alone in its class; texts in which classes
of several are left go on one by one, by moves between linked lists.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import steps

#: Levels that are refined for many texts at once.
SORTED_LEVELS = 6
#: Bytes of text that are refined at once; a longer text is a step of its own.
STEP_BYTES = 2 << 20


class Refinement:
    """The classes of one text's places at a level, as linked lists in order of place, and the gaps between neighbours."""

    def __init__(self, n: int, level: int, classes: list[list[int]]):
        """``classes`` are those of several places at ``level``, each in order; all other places are alone in theirs."""
        self.n, self.level, self.most = n, level, n // 2
        self.of = [-1 - i for i in range(n + 1)]  # a class of its own has a negative number
        self.before, self.after = [-1] * (n + 1), [-1] * (n + 1)
        self.first, self.last, self.size = [], [], []
        self.gaps: dict[int, list[int]] = defaultdict(list)
        for members in classes:
            c = self._new()
            for i in members:
                self._append(i, c)
        followers = defaultdict(list)
        for i in sorted(i for members in classes for i in members):
            followers[self.of[i + 1]].append(i + 1)
        self.small = list(followers.values())

    def _new(self) -> int:
        self.first.append(-1)
        self.last.append(-1)
        self.size.append(0)
        return len(self.size) - 1

    def _neighbours(self, i: int, j: int) -> None:
        if j - i <= self.most:
            self.gaps[j - i].append(i)

    def _append(self, i: int, c: int) -> None:
        last = self.last[c]
        self.of[i], self.before[i], self.after[i] = c, last, -1
        if last < 0:
            self.first[c] = i
        else:
            self.after[last] = i
            self._neighbours(last, i)
        self.last[c] = i
        self.size[c] += 1

    def _remove(self, i: int) -> None:
        c, p, q = self.of[i], self.before[i], self.after[i]
        if p < 0:
            self.first[c] = q
        else:
            self.after[p] = q
        if q < 0:
            self.last[c] = p
        else:
            self.before[q] = p
            if p >= 0:
                self._neighbours(p, q)
        self.size[c] -= 1

    def _members(self, c: int) -> list[int]:
        out, i = [], self.first[c]
        while i >= 0:
            out.append(i)
            i = self.after[i]
        return out

    def refine(self) -> None:
        """From one level to the next."""
        self.level += 1
        end = self.n - self.level + 1  # the first place with too few words after it
        if self.of[end] >= 0:
            self._remove(end)
            self.of[end] = -1 - end
        parts: dict[int, list[int]] = {}
        for members in self.small:
            moved: dict[int, list[int]] = {}
            for j in members:
                c = self.of[j - 1] if 0 < j <= end else -1
                if c >= 0:
                    moved.setdefault(c, []).append(j - 1)
            for c, places in moved.items():
                split = parts.setdefault(c, [])
                if self.size[c] == len(places):
                    continue  # nothing stays: the class keeps its number
                new = self._new()
                for i in places:
                    self._remove(i)
                    self._append(i, new)
                split.append(new)
        self.small = []
        for c, split in parts.items():
            if split:
                several = [c, *split]
                largest = max(several, key=self.size.__getitem__)
                self.small += [self._members(x) for x in several if x != largest]

    def squares(self) -> Iterator[tuple[int, list[int]]]:
        """(half, first places in order) of the squares with primitive halves above the present level."""
        while self.gaps and self.level < self.most:
            self.refine()
            for level in [g for g in self.gaps if g < self.level] if self.level % 1024 == 0 else ():
                del self.gaps[level]
            found = self.gaps.pop(self.level, None)
            if found:
                after, level = self.after, self.level
                places = sorted({i for i in found if after[i] - i == level and self.of[i] >= 0})
                if places:
                    yield self.level, places
            if not self.small and self.gaps:
                self._skip(min(self.gaps) if len(self.gaps) < 64 else self.level + 1)

    def _skip(self, level: int) -> None:
        """To just under ``level``, when no class splits on the way: only places at the end go."""
        while self.level + 1 < level:
            self.level += 1
            end = self.n - self.level + 1
            if self.of[end] >= 0:
                self._remove(end)
                self.of[end] = -1 - end


def _merged(texts: np.ndarray, starts: np.ndarray, level: int) -> Iterator[tuple[int, int, int, int]]:
    """(text, start, length, period) of runs from sorted first places of squares whose halves have ``level`` words."""
    if len(starts):
        edge = np.flatnonzero(np.concatenate([[True], (starts[1:] != starts[:-1] + 1) | (texts[1:] != texts[:-1])]))
        last = np.append(edge[1:], len(starts)) - 1
        yield from zip(texts[edge].tolist(), starts[edge].tolist(), (starts[last] - starts[edge] + 2 * level).tolist(), [level] * len(edge), strict=True)


def runs_of(codes: np.ndarray, ends: np.ndarray, least: int = 12) -> list[list[tuple[int, int, int]]]:
    """For each of several texts, its runs (start, length, period) of at least ``least`` words, in order of start and period.

    ``codes`` are the words of all texts, one text after the other, as small whole numbers; ``ends`` is where each ends.
    """
    n, begins = len(codes), np.concatenate([[0], ends[:-1]]).astype(np.int64)
    text = np.repeat(np.arange(len(ends)), ends - begins)
    out: list[list[tuple[int, int, int]]] = [[] for _ in ends]
    _, own = np.unique(text * (int(codes.max(initial=0)) + 1) + codes, return_inverse=True)
    place = np.argsort(own, kind="stable")
    cls = own[place]
    for level in range(1, SORTED_LEVELS + 1):
        if level > 1:  # by the word that the level adds
            fits = place + level - 1 < ends[text[place]]
            place, cls = place[fits], cls[fits]
            order = np.lexsort((own[place + level - 1], cls))  # keeps the order of places
            added = own[place + level - 1][order]
            place, cls = place[order], cls[order]
            cls = np.cumsum(np.concatenate([[0], (cls[1:] != cls[:-1]) | (added[1:] != added[:-1])])[: len(cls)])
        same = np.concatenate([[False], cls[1:] == cls[:-1], [False]])[: len(cls) + 1]
        several = same[:-1] | same[1:]  # a place alone in its class stays alone
        place, cls = place[several], cls[several]
        square = place[:-1][(place[1:] - place[:-1] == level) & (cls[1:] == cls[:-1])]
        square.sort()
        for t, start, length, period in _merged(text[square], square, level):
            if length >= least:
                out[t].append((start - int(begins[t]), length, period))
    edge = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]])[: len(cls)])
    left: dict[int, list[list[int]]] = defaultdict(list)
    for members in np.split(place, edge[1:]) if len(place) else ():
        t = int(text[members[0]])
        left[t].append((members - begins[t]).tolist())
    for t, classes in left.items():
        for level, places in Refinement(int(ends[t] - begins[t]), SORTED_LEVELS, classes).squares():
            starts = np.array(places)
            out[t] += [(start, length, period) for _, start, length, period in _merged(np.zeros(len(starts), np.int64), starts, level) if length >= least]
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def periodic_runs(docs: DataFrame, least: int = 12) -> DataFrame:
    """For each row of ``docs``: doc_id, n_words, runs (array of structs start, length, period), collapsed (text).

    Words are runs without ASCII white space. A run is a stretch of at least ``least`` words, and at least two of its
    smallest period, that neither neighbour extends; runs are in order of start and period. ``collapsed`` are the words
    that no run repeats, those of its first period being kept, joined by a space.

    Defined cases: a null or blank text has no words, no runs and an empty collapsed text; rows without doc_id or with
    the same doc_id are worked on each; other columns are ignored; no rows in, no rows out. A text is one task's work,
    and needs memory in proportion to its words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "text", STEP_BYTES):
            words = [t.split() for t in batch.column("text").cast(pa.binary()).fill_null(b"").to_pylist()]
            ends = np.cumsum([len(w) for w in words])
            codes = pa.array([w for own in words for w in own], pa.binary()).dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
            found = runs_of(codes, ends, least)
            collapsed = []
            for own, runs in zip(words, found, strict=True):
                if runs:
                    change = np.zeros(len(own) + 1, np.int64)
                    for start, length, period in runs:
                        change[start + period] += 1
                        change[start + length] -= 1
                    own = [own[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0).tolist()]
                collapsed.append(b" ".join(own))
            structs = [[{"start": s, "length": m, "period": p} for s, m, p in runs] for runs in found]
            kind = pa.list_(pa.struct([(c, pa.int64()) for c in ("start", "length", "period")]))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(w) for w in words], pa.int64()), pa.array(structs, kind), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "runs", "collapsed"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string")


def repeated_tail(text: Column, number: Column) -> Column:
    """``text`` with what follows its word number ``a`` replaced by repetitions of ``p`` words from there, for one ``number`` in ten.

    With g = number div 10: a = g mod n, p = 1 + (n - a) div (3 + g mod 8), for a text of n > 0 words; others stay as
    they are.
    """
    words, g = F.regexp_extract_all(text, F.lit(r"([^\x20\x09-\x0D]+)")), F.floor(number / 10)

    def repeated(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = F.pmod(g, n)
        p = 1 + F.floor((n - a) / (3 + F.pmod(g, F.lit(8))))
        return F.concat_ws(" ", F.transform(w, lambda x, i: F.when(i < a, x).otherwise(F.get(w, (a + F.pmod(i - a, p)).cast("int")))))

    one = F.get(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeated(w))), 0)  # the words are bound once
    return F.when(number % 10 == 0, F.coalesce(one, text)).otherwise(text)
