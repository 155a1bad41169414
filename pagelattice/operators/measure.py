"""Baseline detection and article separation measures of a page, from the ticks of its baselines.

A line is an array of ticks (a row a point, about ``tick`` pixels apart, see ``functions.geometry.ticks``).  A tick scores 1 if
the nearest tick of the other line is within the tolerance (city-block distance), 0 beyond three times it, and linearly less in
between; a line scores the mean of its ticks.  All of a page's scores come from one matrix of distances a line.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from .clustering import greedy_sum

Line = np.ndarray


@dataclass(frozen=True)
class Tolerances:
    """Every whole number of pixels from least to most; with a negative least, one for each truth line from its distance to its neighbours."""

    least: int = 10
    most: int = 30
    share: float = 0.25
    tick: int = 5

    def of(self, truth: Sequence[Line]) -> np.ndarray:
        """A row a tolerance, a column a truth line."""
        if self.least < 0:
            return neighbour_tolerances(truth, self.tick, share=self.share)[None]
        return np.repeat(np.arange(self.least, self.most + 1, dtype=float)[:, None], len(truth), axis=1)


def score(distance: np.ndarray, tolerance: np.ndarray) -> np.ndarray:
    room = np.where(tolerance > 0, tolerance, 1.0)
    return np.where(distance <= tolerance, 1.0, np.clip((3 * tolerance - distance) / (2 * room), 0.0, 1.0) * (tolerance > 0))


def nearest(line: Line, others: Sequence[Line]) -> np.ndarray:
    """Distance of every tick of a line (rows) from the nearest tick of each other line (columns)."""
    every = np.concatenate(others)
    starts = np.cumsum([0, *map(len, others[:-1])])
    apart = np.abs(line[:, :1] - every[None, :, 0]) + np.abs(line[:, 1:] - every[None, :, 1])
    return np.minimum.reduceat(apart, starts, axis=1).astype(float)


def pair_scores(counted: Sequence[Line], others: Sequence[Line], tolerance: np.ndarray) -> np.ndarray:
    """Mean scores by tolerance, counted line and other line; tolerance has a column for each of the others."""
    return np.stack([score(nearest(line, others)[None], tolerance[:, None, :]).mean(axis=1) for line in counted], axis=1)


def best_scores(counted: Sequence[Line], others: Sequence[Line], tolerance: np.ndarray) -> np.ndarray:
    """Mean scores of the counted lines' ticks against the nearest of all others, by tolerance and line; tolerance has a column for each counted line."""
    if not others:
        return np.zeros((len(tolerance), len(counted)))
    return np.stack([score(nearest(line, others).min(axis=1)[None], tolerance[:, k : k + 1]).mean(axis=1) for k, line in enumerate(counted)], axis=1)


def aligned(scores: np.ndarray) -> np.ndarray:
    """Each row's score in the greedy one-to-one alignment: the best pair first, of equals the first in order; rows left over have 0."""
    out, rows, columns = np.zeros(len(scores)), set(range(scores.shape[0])), set(range(scores.shape[1]))
    for at in np.argsort(-scores, axis=None, kind="stable").tolist():
        r, c = divmod(at, scores.shape[1])
        if r in rows and c in columns:
            out[r] = scores[r, c]
            rows.discard(r)
            columns.discard(c)
            if not rows or not columns:
                break
    return out


def line_precision(truth: Sequence[Line], reco: Sequence[Line], tolerances: Tolerances) -> np.ndarray:
    """By tolerance and recognised line."""
    return np.stack([aligned(s) for s in pair_scores(reco, truth, tolerances.of(truth))])


def line_recall(truth: Sequence[Line], reco: Sequence[Line], tolerances: Tolerances) -> np.ndarray:
    """By tolerance and truth line."""
    return best_scores(truth, reco, tolerances.of(truth))


def detection(truth: Sequence[Line], reco: Sequence[Line], tolerances: Tolerances) -> tuple[float, float] | None:
    """Recall and precision, means over lines and tolerances; None without truth lines, 0 without recognised ones."""
    if not truth:
        return None
    if not reco:
        return 0.0, 0.0
    return float(line_recall(truth, reco, tolerances).mean()), float(line_precision(truth, reco, tolerances).mean())


def f_measure(recall: float, precision: float) -> float:
    return 2 * recall * precision / (recall + precision) if recall + precision else 0.0


def page_measure(truth: dict[object, list[Line]], reco: dict[object, list[Line]], tolerances: Tolerances = Tolerances()) -> list[tuple[float, float, float] | None]:  # noqa: B008
    """(recall, precision, F) of all lines, of lines with an article, and of the articles; lines by article, those of none under None.

    Articles: recall and precision of every truth article with every recognised one, weighted by the article's share
    of its side's lines, and summed over the greedy one-to-one alignment.
    """
    flat = lambda side, named: [line for article, lines in side.items() if article is not None or not named for line in lines]
    found = [detection(flat(truth, named), flat(reco, named), tolerances) for named in (False, True)]
    if None in found:
        return [None if x is None else (*x, f_measure(*x)) for x in (found[0], None)] + [None]
    out: list[tuple[float, float, float] | None] = [(*x, f_measure(*x)) for x in found]
    ours, theirs = ([lines for article, lines in side.items() if article is not None] for side in (truth, reco))
    if not theirs:
        return [*out, (0.0, 0.0, 0.0)]
    pairs = np.array([[detection(a, b, tolerances) for b in theirs] for a in ours])
    weight = [np.array([len(lines) for lines in side], float) for side in (ours, theirs)]
    recall, precision = greedy_sum(pairs[..., 0] * (weight[0] / weight[0].sum())[:, None]), greedy_sum(pairs[..., 1] * (weight[1] / weight[1].sum())[None])
    return [*out, (recall, precision, f_measure(recall, precision))]


def aligned_many(scores: np.ndarray) -> np.ndarray:
    """``aligned`` of every matrix of a stack at once."""
    left, out = scores.copy(), np.zeros(scores.shape[:2])
    each = np.arange(len(scores))
    for _ in range(min(scores.shape[1:])):
        r, c = np.divmod(left.reshape(len(left), -1).argmax(axis=1), scores.shape[2])
        out[each, r] = left[each, r, c]
        left[each, r] = -1
        left[each, :, c] = -1
    return out


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """City-block distances of points (rows of x and y) from others."""
    out = np.abs(a[0][:, None] - b[0])
    out += np.abs(a[1][:, None] - b[1])
    return out


@lru_cache
def _score_table(least: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Scores by distance, up to the first at which all are 0, and tolerance, as whole numbers; and what these count as 1.

    Sums of them are exact, so means that are equal are so in every bit, and of equals the first is taken.
    """
    distance, tolerance = np.arange(3 * most + 2)[:, None], np.arange(least, most + 1)
    full = np.where(tolerance > 0, 2 * tolerance, 1)
    return np.where(distance <= tolerance, full, np.clip(3 * tolerance - distance, 0, None) * (tolerance > 0)).astype(np.int32), full


class PageScores:
    """Scores of a page's ticks by a table of distances: lines of whole numbers, and tolerances that are the same for all lines.

    ``pairs`` has the pair scores by recognised line, truth line and tolerance; ``best`` the scores of truth lines against the
    nearest of several groups of recognised lines.
    """

    def __init__(self, truth: Sequence[Line], reco: Sequence[Line], tolerances: Tolerances):
        ours, theirs = (np.concatenate(lines).T for lines in (truth, reco))
        low = np.minimum(ours.min(axis=1), theirs.min(axis=1))[:, None]
        span = int((np.maximum(ours.max(axis=1), theirs.max(axis=1)) - low[:, 0]).sum())
        small = np.int16 if span < 1 << 15 else np.int64
        ours, theirs = (np.ascontiguousarray(side - low).astype(small) for side in (ours, theirs))
        self.table, self.full = _score_table(tolerances.least, tolerances.most)
        self.size = [np.array([len(line) for line in lines]) for lines in (truth, reco)]
        self.start = [np.cumsum(size) - size for size in self.size]
        far = len(self.table) - 1
        # by recognised line, of every truth tick; then by truth line, of every recognised tick
        self.near = np.minimum(np.minimum.reduceat(_apart(theirs, ours), self.start[1], axis=0), far)
        back = np.minimum(np.minimum.reduceat(_apart(ours, theirs), self.start[0], axis=0), far)
        self.pairs = np.add.reduceat(self.table[back.T], self.start[1], axis=0) / (self.full * self.size[1][:, None, None])

    def best(self, groups: Sequence[Sequence[int]]) -> np.ndarray:
        """By truth line, group and tolerance."""
        nearest = np.stack([self.near[g].min(axis=0) for g in groups], axis=1)
        return np.add.reduceat(self.table[nearest], self.start[0], axis=0) / (self.full * self.size[0][:, None, None])


def _whole(lines: Sequence[Line]) -> bool:
    return all(line.dtype.kind in "iu" for line in lines)


class _Alignments:
    """Matrices of scores by recognised line, truth line and tolerance, aligned together by their shape when all are known."""

    def __init__(self):
        self.stacks: dict[tuple[int, ...], list[np.ndarray]] = {}
        self.done: dict[tuple[int, ...], np.ndarray] = {}

    def add(self, scores: np.ndarray) -> tuple[tuple[int, ...], int]:
        own = self.stacks.setdefault(scores.shape, [])
        own.append(scores)
        return scores.shape, len(own) - 1

    def get(self, at: tuple[tuple[int, ...], int]) -> np.ndarray:
        """By tolerance and recognised line."""
        shape, k = at
        if shape not in self.done:
            stack = np.stack(self.stacks[shape]).transpose(0, 3, 1, 2)
            self.done[shape] = aligned_many(stack.reshape(-1, *shape[:2])).reshape(len(stack), shape[2], shape[0])
        return self.done[shape][k]


def page_line_scores(pages: Sequence[tuple[Sequence[Line], Sequence[Line]]], tolerances: Tolerances = Tolerances()) -> list[tuple[np.ndarray, np.ndarray]]:  # noqa: B008
    """``line_recall`` and ``line_precision`` of many pages, none of which lacks a side."""
    if tolerances.least < 0 or not all(_whole(side) for page in pages for side in page):
        return [(line_recall(*page, tolerances), line_precision(*page, tolerances)) for page in pages]
    alignments, found = _Alignments(), []
    for truth, reco in pages:
        scores = PageScores(truth, reco, tolerances)
        found.append((scores.best([range(len(reco))])[:, 0].T, alignments.add(scores.pairs)))
    return [(recall, alignments.get(at)) for recall, at in found]


def page_measures(pages: Sequence[tuple[dict[object, list[Line]], dict[object, list[Line]]]], tolerances: Tolerances = Tolerances()) -> list[list[tuple[float, float, float] | None]]:  # noqa: B008
    """``page_measure`` of many pages; each page's distances are worked out once, for all its measures."""
    out: list[list | None] = []
    alignments, todo = _Alignments(), []
    for truth, reco in pages:
        lines = [[line for own in side.values() for line in own] for side in (truth, reco)]
        if tolerances.least < 0 or not all(lines) or not all(map(_whole, lines)):
            out.append(page_measure(truth, reco, tolerances))
            continue
        out.append(None)
        scores = PageScores(*lines, tolerances)
        spots = []  # of each article, its lines
        for side in (truth, reco):
            ends = np.cumsum([len(own) for own in side.values()]).tolist()
            spots.append({article: list(range(end - len(own), end)) for (article, own), end in zip(side.items(), ends, strict=True)})
        named = [[k for article, own in side.items() if article is not None for k in own] for side in spots]
        ours, theirs = ([own for article, own in side.items() if article is not None] for side in spots)
        groups = [list(range(len(lines[1]))), *([named[1]] if named[1] else []), *theirs]
        best = scores.best(groups)
        pick = lambda a, b, p=scores.pairs: alignments.add(p if len(a) == p.shape[1] and len(b) == p.shape[0] else p[np.ix_(b, a)])
        detections = [(best[:, 0].mean(), pick(range(len(lines[0])), groups[0]))]
        if named[0] and named[1]:
            detections.append((best[named[0], 1].mean(), pick(*named)))
        pairs = [[(best[a, 2 + k].mean(), pick(a, b)) for k, b in enumerate(theirs)] for a in ours] if theirs else []
        todo.append((len(out) - 1, detections, bool(named[0]), pairs, [np.array([len(own) for own in side], float) for side in (ours, theirs)]))
    for at, detections, has_named, pairs, (ours, theirs) in todo:
        value = lambda x: (float(x[0]), float(alignments.get(x[1]).mean()))
        whole = value(detections[0])
        whole = (*whole, f_measure(*whole))
        if not has_named:
            out[at] = [whole, None, None]
        elif not pairs:
            out[at] = [whole, (0.0, 0.0, 0.0), (0.0, 0.0, 0.0)]
        else:
            named_ = value(detections[1])
            grid = np.array([[value(x) for x in row] for row in pairs])
            recall, precision = greedy_sum(grid[..., 0] * (ours / ours.sum())[:, None]), greedy_sum(grid[..., 1] * (theirs / theirs.sum())[None])
            out[at] = [whole, (*named_, f_measure(*named_)), (recall, precision, f_measure(recall, precision))]
    return out


def _places(count: np.ndarray) -> np.ndarray:
    """0, 1, .. within each of several stretches that lie end to end."""
    return np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)


def _groups(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for each combination of the keys, in their order, and the first place of each."""
    order = np.lexsort(keys[::-1])
    new = np.append(True, np.logical_or.reduce([np.diff(k[order]) != 0 for k in keys]))[: len(order)]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new) - 1
    return out, order[new]


class Curves:
    """Lines of whole ticks end to end, for the distances of their ticks from other lines.

    A line that goes on to the right and rises or falls by no more than that has its nearest tick, in city-block distance, just
    before or behind a point's x, as what a tick farther off gains in y it loses in x.  Other lines are searched tick by tick.
    """

    def __init__(self, ticks: np.ndarray, count: np.ndarray):
        self.count, self.start = count, np.cumsum(count) - count
        self.low, self.high = (f.reduceat(ticks, self.start, axis=0) for f in (np.minimum, np.maximum))
        small = np.int32 if max(np.abs(self.low).max(initial=0), np.abs(self.high).max(initial=0), len(ticks) << 3) < 1 << 29 else np.int64
        self.x, self.y = (np.ascontiguousarray(v, small) for v in ticks.T)
        last = np.zeros(len(self.x), bool)
        last[self.start + count - 1] = True
        step, rise = np.diff(self.x, append=0), np.diff(self.y, append=0)
        self.level = np.logical_and.reduceat(last | ((step > 0) & (np.abs(rise) <= step)), self.start) & (count > 1)
        # of each x of a level line the tick at or before it, at the end the one before the last
        held = np.flatnonzero(np.repeat(self.level, count) & ~last)
        width = step[held] + last[held + 1]
        self.before = np.repeat(held.astype(small), width)
        wide = np.where(self.level, self.high[:, 0] - self.low[:, 0] + 1, 0)
        self.table = (np.cumsum(wide) - wide - self.low[:, 0]).astype(small)  # where x = 0 would be
        self.ends = self.low[:, 0].astype(small), self.high[:, 0].astype(small)

    def near(self, a: np.ndarray, b: np.ndarray, far: int) -> np.ndarray:
        """Whether pairs of lines are less than far apart by their boxes."""
        gap = np.maximum(0, np.maximum(self.low[a] - self.high[b], self.low[b] - self.high[a])).sum(axis=1)
        return gap < far

    def distances(self, a: np.ndarray, b: np.ndarray, far: int) -> np.ndarray:
        """Of pairs of lines: the distance of each tick of a from b, at most far; pair by pair."""
        size = self.count[a]
        level = self.level[b]
        if level.all():
            return self._level_distances(a, b, size, far)
        out, of, ends = np.empty(int(size.sum()), np.int64), np.repeat(level, size), np.cumsum(size)
        line = lambda k: np.stack([v[self.start[k] : self.start[k] + self.count[k]] for v in (self.x, self.y)], axis=1)
        for k in np.flatnonzero(~level).tolist():
            out[ends[k] - size[k] : ends[k]] = np.minimum(nearest(line(a[k]), [line(b[k])])[:, 0], far)
        out[of] = self._level_distances(a[level], b[level], size[level], far)
        return out

    def _level_distances(self, a: np.ndarray, b: np.ndarray, size: np.ndarray, far: int) -> np.ndarray:
        tick = np.repeat(self.start[a], size) + _places(size)
        x, y = self.x[tick], self.y[tick]
        at = np.clip(x, np.repeat(self.ends[0][b], size), np.repeat(self.ends[1][b], size))
        at += np.repeat(self.table[b], size)
        at = self.before[at]
        least = np.abs(x - self.x[at])
        least += np.abs(y - self.y[at])
        at += 1
        x -= self.x[at]
        y -= self.y[at]
        other = np.abs(x, out=x)
        other += np.abs(y, out=y)
        return np.minimum(np.minimum(least, other, out=least), far, out=least)


def _met(a: np.ndarray, b: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of the members of a with those of b that have the same number, below parts; members are sorted by it."""
    size, first = np.bincount(b, minlength=parts), np.searchsorted(b, np.arange(parts))
    left = np.repeat(np.arange(len(a)), size[a])
    return left, np.repeat(first[a], size[a]) + _places(size[a])


def _aligned_sums(scores: np.ndarray, task: np.ndarray, row: np.ndarray, column: np.ndarray, tasks: int) -> np.ndarray:
    """Sum of ``aligned`` over the rows of each task and over tolerances, from the entries that aren't 0 by row and then column.

    If the rows' best columns differ, the greedy alignment gives each row its best; only the other matrices are aligned step by step.
    """
    out = np.zeros(tasks)
    if not len(task):
        return out
    head = np.flatnonzero(np.append(True, (np.diff(row) != 0) | (np.diff(task) != 0)))
    of = np.cumsum(np.bincount(head, minlength=len(task))) - 1
    best = np.maximum.reduceat(scores, head, axis=0)
    first = np.minimum.reduceat(np.where(scores == best[of], column[:, None], np.iinfo(np.int64).max), head, axis=0)
    r, level = np.nonzero(best > 0)
    cell, _ = _groups(task[head][r], level, first[r, level])
    twice = np.bincount(cell)[cell] > 1
    torn = np.zeros((tasks, scores.shape[1]), bool)
    torn[task[head][r[twice]], level[twice]] = True
    np.add.at(out, task[head], np.where(torn[task[head]], 0, best).sum(axis=1))
    which, level = np.nonzero(torn)
    if not len(which):
        return out
    # dense matrices of the torn ones, by their shape
    keep = torn.any(axis=1)[task]
    scores, task, row, column = scores[keep], task[keep], row[keep], column[keep]
    places = []
    for key in (row, column):
        number, at = _groups(task, key)
        begin = np.searchsorted(task[at], np.arange(tasks))
        places.append(number - begin[task])
    rows, columns = (np.zeros(tasks, np.int64) for _ in range(2))
    for many, place in zip((rows, columns), places, strict=True):
        np.maximum.at(many, task, place + 1)
    shape = rows * (columns.max() + 1) + columns
    begin, end = np.searchsorted(task, which, "left"), np.searchsorted(task, which, "right")
    for s in np.unique(shape[which]).tolist():
        own = np.flatnonzero(shape[which] == s)
        size = end[own] - begin[own]
        entry, matrix = np.repeat(begin[own], size) + _places(size), np.repeat(np.arange(len(own)), size)
        dense = np.zeros((len(own), *divmod(s, int(columns.max()) + 1)))
        dense[matrix, places[0][entry], places[1][entry]] = scores[entry, level[own][matrix]]
        np.add.at(out, which[own], aligned_many(dense).sum(axis=1))
    return out


def _greedy_sums(values: np.ndarray) -> np.ndarray:
    """``greedy_sum`` of every matrix of a stack; no entry is below 0."""
    return aligned_many(values).sum(axis=1)


def many_page_measures(points: np.ndarray, counts: np.ndarray, page: np.ndarray, side: np.ndarray, article: np.ndarray, pages: int, tolerances: Tolerances = Tolerances()) -> np.ndarray:  # noqa: B008
    """``page_measure`` of many pages at once, a row of nine numbers a page, NaN for None.

    Lines of whole ticks lie end to end (points, and how many each has), by page, side (0 is the truth) and their order; an
    article below 0 is none.  Tolerances are the same for all lines.
    """
    owner, head = _groups(page, side, article)  # lines of an article lie together, articles by their first line
    first = np.full(len(head), len(page))
    np.minimum.at(first, owner, np.arange(len(page)))
    order = np.lexsort((np.arange(len(page)), first[owner]))
    start = np.cumsum(counts) - counts
    counts_ = counts[order]
    points = points[np.repeat(start[order], counts_) + _places(counts_)]
    counts, page, side, article = counts_, page[order], side[order], article[order]
    block = np.cumsum(np.append(True, np.diff(first[owner][order]) != 0)) - 1  # the article of a side of a page, in order
    curves = Curves(points, counts)
    table, full = _score_table(tolerances.least, tolerances.most)
    far, levels = len(table) - 1, len(full)
    truth, reco = np.flatnonzero(side == 0), np.flatnonzero(side == 1)

    # pairs by recognised line and truth line
    b, a = _met(page[reco], page[truth], pages)
    a, b = truth[a], reco[b]
    close = curves.near(a, b, far)
    a, b = a[close], b[close]
    named = (article[a] >= 0) & (article[b] >= 0)

    def summed(spot: np.ndarray, distance: np.ndarray, many: int) -> np.ndarray:
        """Exact sums of the scores of ticks by spot and tolerance."""
        counted = np.bincount(spot * (far + 1) + distance, minlength=many * (far + 1)).reshape(many, far + 1)
        return counted.astype(float) @ table.astype(float)

    # recall: of truth lines, against the nearest of all, of the named, and of each article of the other side
    distance = curves.distances(a, b, far)
    size = counts[a]
    recalls = []
    for group, use in ((page[b], np.ones(len(a), bool)), (page[b], named), (block[b], named)):
        spot, at = _groups(a[use], group[use])
        if not len(at):
            recalls.append((np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)))
            continue
        line = a[use][at]
        begin = np.cumsum(counts[line]) - counts[line]
        least = np.full(int(counts[line].sum()), far, distance.dtype)
        np.minimum.at(least, np.repeat(begin[spot], size[use]) + _places(size[use]), distance if use.all() else distance[np.repeat(use, size)])
        found = summed(np.repeat(np.arange(len(line)), counts[line]), least, len(line)) / (full * counts[line][:, None])
        recalls.append((line, group[use][at], found.mean(axis=1)))

    # precision: of recognised lines, aligned with truth lines
    distance = curves.distances(b, a, far)
    size = counts[b]
    scores = summed(np.repeat(np.arange(len(b)), size), distance, len(b)) / (full * size[:, None])
    ours, theirs = (np.unique(block[(side == k) & (article >= 0)]) for k in (0, 1))  # named articles
    lines_of = np.bincount(block, minlength=int(block.max(initial=-1)) + 1)
    page_of = np.zeros(len(lines_of), np.int64)
    page_of[block] = page
    # every truth article with every recognised one of its page
    i, j = _met(page_of[ours], page_of[theirs], pages)
    i, j = ours[i], theirs[j]
    grid = i * (len(lines_of) + 1) + j
    some, values = scores.any(axis=1), []
    for task, use, many in ((page[a], some, pages), (page[a], named & some, pages), (np.searchsorted(grid, block[a] * (len(lines_of) + 1) + block[b]), named & some, len(grid))):
        own = np.flatnonzero(use)
        own = own[np.lexsort((a[own], b[own], task[own]))]
        values.append(_aligned_sums(scores[own], task[own], b[own], a[own], many))

    sides = [np.bincount(page[side == k], minlength=pages) for k in (0, 1)]
    sides_named = [np.bincount(page[(side == k) & (article >= 0)], minlength=pages) for k in (0, 1)]
    out = np.full((pages, 9), np.nan)

    def put(at: np.ndarray, k: int, recall: np.ndarray, precision: np.ndarray) -> None:
        both = recall + precision
        out[at, 3 * k], out[at, 3 * k + 1], out[at, 3 * k + 2] = recall, precision, np.where(both > 0, 2 * recall * precision / np.where(both > 0, both, 1), 0)

    share = lambda top, bottom: np.where(bottom > 0, top / np.maximum(bottom, 1), 0.0)
    for k, (ours_n, theirs_n) in enumerate((sides, sides_named)):
        has = ours_n > 0
        line, _, value = recalls[k]
        keep = np.ones(len(line), bool) if k == 0 else article[line] >= 0
        recall = share(np.bincount(page[line[keep]], value[keep], minlength=pages), ours_n)
        precision = share(values[k], theirs_n * levels)
        put(np.flatnonzero(has), k, recall[has], precision[has])
    # articles: the grid of each page, by its shape
    line, other, value = recalls[2]
    spot = np.searchsorted(grid, block[line] * (len(lines_of) + 1) + other)
    recall = share(np.bincount(spot, value, minlength=len(grid)), lines_of[i])
    precision = share(values[2], lines_of[j] * levels)
    where = page_of[i]
    recall = recall * (lines_of[i] / np.maximum(sides_named[0][where], 1))
    precision = precision * (lines_of[j] / np.maximum(sides_named[1][where], 1))
    named_truth = np.flatnonzero(sides_named[0] > 0)
    put(named_truth, 2, np.zeros(len(named_truth)), np.zeros(len(named_truth)))
    ours_of, theirs_of = (np.bincount(page_of[x], minlength=pages) for x in (ours, theirs))
    begin = np.searchsorted(where, np.arange(pages))
    shape = ours_of * (int(theirs_of.max(initial=0)) + 1) + theirs_of
    for s in np.unique(shape[(ours_of > 0) & (theirs_of > 0)]).tolist():
        own = np.flatnonzero(shape == s)
        r, c = divmod(s, int(theirs_of.max(initial=0)) + 1)
        at = begin[own][:, None] + np.arange(r * c)
        put(own, 2, *(_greedy_sums(v[at].reshape(-1, r, c)) for v in (recall, precision)))
    return out


def regression(line: Line) -> tuple[float, float]:
    """Angle in [0, 2 pi) of the least-squares line (y up), pointing the way the line runs, and its intercept.

    Three points or more within less than two pixels stand upright (their intercept is the mean of x, or infinite in one column), and two in one column do.
    """
    if len(line) < 2:
        return 0.0, 0.0
    x, y = line[:, 0].astype(float), -line[:, 1].astype(float)
    if np.ptp(x) < (2 if len(line) > 2 else 1):
        return np.pi / 2, float(x.mean()) if np.ptp(x) else np.inf
    if (line == np.floor(line)).all():  # whole ticks: by whole sums, so that what lies level has the angle 0 in every bit
        slope = (len(x) * (x * y).sum() - x.sum() * y.sum()) / (len(x) * (x * x).sum() - x.sum() ** 2)
    else:
        slope = ((x - x.mean()) * (y - y.mean())).sum() / ((x - x.mean()) ** 2).sum()
    angle, dx, dy = np.arctan(slope), line[-1, 0] - line[0, 0], line[-1, 1] - line[0, 1]
    flat = -np.pi / 4 < angle <= np.pi / 4
    if (dx < 0) if flat else (dy < 0 if angle <= -np.pi / 4 else dy > 0):
        angle += np.pi
    return float(angle % (2 * np.pi)), float(y.mean() - slope * x.mean())


def _across(u: np.ndarray, v: np.ndarray, a: np.ndarray, b: np.ndarray, reach: float) -> np.ndarray:
    """Of points (u, v) the least distance in v from points (a, b) that are at most reach away in u, infinite without one."""
    order = np.argsort(a, kind="stable")
    a, b = a[order], b[order]
    first, last = np.searchsorted(a, u - reach - 1e-9, "left"), np.searchsorted(a, u + reach + 1e-9, "right")
    out = np.full(len(u), np.inf)
    for step in range(int((last - first).max(initial=0))):
        at = np.minimum(first + step, len(a) - 1)
        near = (first + step < last) & (np.abs(u - a[at]) <= reach + 1e-9)
        out = np.where(near, np.minimum(out, np.abs(v - b[at])), out)
    return out


def neighbour_distances(lines: Sequence[Line], tick: int = 5, most: float = 250.0) -> np.ndarray:
    """Distance of each line across its direction to the ticks of others that lie beside one of its own (within 2 ticks along it).

    A line that lies wholly before or behind, or whose box is farther off than the distance found so far, doesn't count;
    ticks and lines are taken in order, as that depends on it.
    """
    out = np.full(len(lines), float(most))
    if len(lines) < 2:
        return out
    low = np.array([line.min(axis=0) for line in lines], float)
    high = np.array([line.max(axis=0) for line in lines], float) + 1
    for k, line in enumerate(lines):
        angle, _ = regression(line)
        cos, sin = np.cos(angle), np.sin(angle)
        turned = [(p[:, 0] * cos - p[:, 1] * sin, p[:, 0] * sin + p[:, 1] * cos) for p in lines]  # along the line, and across it
        u, v = turned[k]
        box = (np.maximum(0, low[None] - line[:, None]) + np.maximum(0, line[:, None] - high[None])).sum(axis=2)
        off = np.full(box.shape, np.inf)
        for m, (a, b) in enumerate(turned):
            between = [u[e] - a[f] for e in (0, -1) for f in (0, -1)]
            if m != k and not (max(between) < 0 or min(between) > 0) and (box[:, m] <= out[k]).any():
                off[:, m] = _across(u, v, a, b, 2 * tick)
        now = out[k]
        for at in np.flatnonzero(off.ravel() < now).tolist():
            if off.flat[at] < now and box.flat[at] <= now:
                now = off.flat[at]
        out[k] = now
    return out


def many_regressions(points: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Angles and intercepts of ``regression`` of many lines of whole ticks that lie end to end; the sums are whole numbers."""
    starts = np.cumsum(counts) - counts
    x, y = points[:, 0], -points[:, 1]
    sums = lambda v: np.add.reduceat(v, starts)
    sx, sy = sums(x), sums(y)
    over, under = counts * sums(x * y) - sx * sy, counts * sums(x * x) - sx * sx
    wide = np.maximum.reduceat(x, starts) - np.minimum.reduceat(x, starts)
    slope = over / np.where(under, under, 1)
    angle = np.arctan(slope)
    dx, dy = (points[starts + counts - 1] - points[starts]).T
    flat = (-np.pi / 4 < angle) & (angle <= np.pi / 4)
    back = np.where(flat, dx < 0, np.where(angle <= -np.pi / 4, dy < 0, dy > 0))
    upright = wide < np.where(counts > 2, 2, 1)
    angle = np.where(upright, np.pi / 2, (angle + np.pi * back) % (2 * np.pi))
    off = np.where(upright, np.where(wide > 0, sx / counts, np.inf), (sy - slope * sx) / counts)
    return np.where(counts < 2, 0.0, angle), np.where(counts < 2, 0.0, off)


def many_neighbour_distances(points: np.ndarray, counts: np.ndarray, pages: np.ndarray, tick: int = 5, most: float | Sequence[float] = 250.0) -> np.ndarray:
    """``neighbour_distances`` of many pages at once: whole ticks of all lines end to end, how many each line has, and each line's page, by page.

    With several values of most, a row for each.  A line meets the others from the nearest on, by their boxes, as long as these are
    nearer across it than what it has found.  The order of ticks and lines matters only where a tick beside the other line's box is
    nearer than all that face it; such lines meet all others, in order.
    """
    n, reach = len(counts), 2 * tick
    starts, ends = np.cumsum(counts) - counts, np.cumsum(counts)
    first = np.searchsorted(pages, pages, "left")
    many = np.searchsorted(pages, pages, "right") - first
    k = np.repeat(np.arange(n), many)  # pairs of a line and another one
    m = np.arange(len(k)) - np.repeat(np.cumsum(many) - many - first, many)
    k, m = k[k != m], m[k != m]
    tops = np.atleast_1d(np.asarray(most, float))
    safe = np.full(n, tops.max())
    result = lambda: np.minimum(safe, tops[:, None]) if np.ndim(most) else safe
    if not len(k):
        return result()
    angle, _ = many_regressions(points, counts)
    cos, sin = np.cos(angle), np.sin(angle)
    px, py = points.T.astype(float)
    turned = lambda at, c, s: (px[at] * c - py[at] * s, px[at] * s + py[at] * c)
    between = [turned(e[k], cos[k], sin[k])[0] - turned(f[m], cos[k], sin[k])[0] for e in (starts, ends - 1) for f in (starts, ends - 1)]
    beside = ~((np.maximum.reduce(between) < 0) | (np.minimum.reduce(between) > 0))
    k, m = k[beside], m[beside]
    low, high = np.minimum.reduceat(points, starts), np.maximum.reduceat(points, starts)
    # the least distance across the line from the other one's box
    across = px * np.repeat(sin, counts) + py * np.repeat(cos, counts)
    own_low, own_high = np.minimum.reduceat(across, starts), np.maximum.reduceat(across, starts)
    sides = [np.where(flip[k], high[m, c], low[m, c]) * f[k] for flips in ((sin < 0, cos < 0), (sin >= 0, cos >= 0)) for c, (flip, f) in enumerate(zip(flips, (sin, cos), strict=True))]
    bound = np.maximum(0, np.maximum(sides[0] + sides[1] - own_high[k], own_low[k] - sides[2] - sides[3])) - 1e-6

    def ticks_of(line: np.ndarray) -> np.ndarray:
        """The place of every tick of a pair's line."""
        return np.repeat(starts[line], counts[line]) + _places(counts[line])

    def offs(k: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of pairs, the distance of every tick of the line across it from the ticks of the other that lie beside it, and from the other's box."""
        own, other, size, size_ = ticks_of(k), ticks_of(m), counts[k], counts[m]
        (u, v), (a, b) = (turned(at, np.repeat(cos[k], many), np.repeat(sin[k], many)) for at, many in ((own, size), (other, size_)))
        begin = np.cumsum(size_) - size_
        rising = np.append(np.diff(a) >= 0, True)
        rising[begin[1:] - 1] = True
        if not rising.all():
            order = np.lexsort((a, np.repeat(np.arange(len(k)), size_)))
            a, b = a[order], b[order]
        # the first tick that isn't more than reach behind, guessed by even steps and put right
        start, stop = np.repeat(begin, size), np.repeat(begin + size_, size)
        wide = a[begin + size_ - 1] - a[begin]
        ahead = np.repeat((size_ - 1) / np.where(wide > 0, wide, 1), size)
        least = u - (reach + 1e-3)
        at = np.clip(start + ((least - a[start]) * ahead).astype(np.int64), start, stop)
        top = len(a) - 1
        while (late := (at > start) & (a[np.maximum(at - 1, 0)] >= least)).any():
            at -= late
        while (early := (at < stop) & (a[np.minimum(at, top)] < least)).any():
            at += early
        off = np.full(len(u), np.inf)
        while True:
            spot = np.minimum(at, top)
            gap = a[spot] - u
            near = (at < stop) & (gap <= reach + 1e-3)
            if not near.any():
                break
            np.minimum(off, np.where(near & (np.abs(gap) <= reach + 1e-9), np.abs(v - b[spot]), np.inf), out=off)
            at += near
        box = np.zeros(len(u), np.int64)
        for c in range(2):
            here = points[own, c]
            box += np.maximum(0, np.maximum(np.repeat(low[m, c], size) - here, here - np.repeat(high[m, c] + 1, size)))
        return off, box

    order = np.lexsort((bound, k))
    rank = np.empty(len(k), np.int64)
    rank[order] = _places(np.bincount(k, minlength=n))
    beyond = []  # ticks beside the other's box: the line, the distance, and that from the box
    step = 0
    while step <= rank.max(initial=-1):
        now = np.flatnonzero((rank >= step) & (rank < max(2, 2 * step)) & (bound < safe[k]))
        step = max(2, 2 * step)
        if not len(now):
            continue
        off, box = offs(k[now], m[now])
        begin = np.cumsum(counts[k[now]]) - counts[k[now]]
        np.minimum.at(safe, k[now], np.minimum.reduceat(np.where(box <= off, off, np.inf), begin))
        line = np.repeat(k[now], counts[k[now]])
        some = (box > off) & (off < safe[line])
        beyond.append((line[some], off[some], box[some]))
    out = np.minimum(safe, tops[:, None])
    if beyond:
        line, off, box = (np.concatenate(v) for v in zip(*beyond, strict=True))
        late = [np.unique(line[(off < now[line]) & (box <= top)]) for now, top in zip(out, tops, strict=True)]
        every = np.unique(np.concatenate(late))
        pairs = np.flatnonzero(np.isin(k, every))
        if len(pairs):
            off, box = offs(k[pairs], m[pairs])
            size = counts[k[pairs]]
            for found, top, lines in zip(out, tops, late, strict=True):
                for one in lines.tolist():
                    own = np.flatnonzero(np.repeat(k[pairs] == one, size))
                    part = own.reshape(-1, counts[one]).T.ravel()  # tick by tick, the other lines in order
                    now, o_, x_ = float(top), off[part], box[part]
                    good = np.flatnonzero(o_ < now)
                    for o, x in zip(o_[good].tolist(), x_[good].tolist(), strict=True):
                        if o < now and x <= now:
                            now = o
                    found[one] = now
    return out if np.ndim(most) else out[0]


def many_neighbour_tolerances(found: np.ndarray, pages: np.ndarray, most: float = 250.0, share: float = 0.25) -> np.ndarray:
    """``neighbour_tolerances`` of many pages from their lines' distances; pages are numbered from 0."""
    some = (found > 0) & (found < most)
    number = np.bincount(pages, some)
    mean = np.where(number > 0, np.bincount(pages, np.where(some, found, 0)) / np.maximum(number, 1), most)[pages]
    return share * np.minimum(np.where(some, found, mean), mean)


def neighbour_tolerances(lines: Sequence[Line], tick: int = 5, most: float = 250.0, share: float = 0.25) -> np.ndarray:
    """A share of each line's distance to its neighbours; lines without one, and those above it, take the mean."""
    found = neighbour_distances(lines, tick, most)
    found[found >= most] = 0
    mean = found[found > 0].mean() if (found > 0).any() else most
    return share * np.minimum(np.where(found > 0, found, mean), mean)
