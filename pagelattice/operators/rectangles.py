"""Rectangles of articles: grown from baselines without touching other articles, stretched to white space, merged from top to bottom, outlined.

Boxes are (x, y, width, height) as long as they grow, since a box may shrink to nothing; a baseline is a list of points.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from .polygons import Point, convex_hull, rectilinear_rings

Box = tuple[int, int, int, int]


@dataclass
class TextLine:
    article: object
    name: object
    baseline: list[Point]
    outline: list[Point] | None = None  # its surrounding polygon


@dataclass(eq=False)
class Rectangle:
    box: Box
    lines: list[TextLine] = field(default_factory=list)


def around(points: Sequence[Point]) -> Box:
    """The box of points, its last pixel counted."""
    xs, ys = zip(*points, strict=True)
    return min(xs), min(ys), max(xs) - min(xs) + 1, max(ys) - min(ys) + 1


def overlap(a: Box, b: Box) -> Box:
    """What two boxes share; a negative side is the gap between them."""
    x, y = max(a[0], b[0]), max(a[1], b[1])
    return x, y, min(a[0] + a[2], b[0] + b[2]) - x, min(a[1] + a[3], b[1] + b[3]) - y


def meet(a: Box, b: Box) -> bool:
    return min(overlap(a, b)[2:]) > 0


def union(a: Box, b: Box) -> Box:
    x, y = min(a[0], b[0]), min(a[1], b[1])
    return x, y, max(a[0] + a[2], b[0] + b[2]) - x, max(a[1] + a[3], b[1] + b[3]) - y


def crosses(box: Box, line: Sequence[Point]) -> bool:
    """Whether a segment of the line has a point in the box and doesn't lie wholly on one side of it (or on that side's edge)."""
    x0, y0, x1, y1 = box[0], box[1], box[0] + box[2], box[1] + box[3]
    for (ax, ay), (bx, by) in zip(line, line[1:], strict=False):
        if max(ax, bx) <= x0 or min(ax, bx) >= x1 or max(ay, by) <= y0 or min(ay, by) >= y1:
            continue
        enter, leave = 0.0, 1.0  # the part of the segment between the box's sides
        for start, step, low, high in ((ax, bx - ax, x0, x1), (ay, by - ay, y0, y1)):
            if step:
                near, far = sorted(((low - start) / step, (high - start) / step))
                enter, leave = max(enter, near), min(leave, far)
        if enter <= leave:
            return True
    return False


def aligned(a: Sequence[Point], b: Sequence[Point], margin: int = 20) -> bool:
    """Whether one line's x range lies in the other's with a margin on its outer end, or either ends near the other's end."""
    (a0, a1), (b0, b1) = ((min(p[0] for p in line), max(p[0] for p in line)) for line in (a, b))
    within = lambda l0, l1, r0, r1: r0 - margin <= l0 <= r1 and r0 <= l1 <= r1 + margin
    return within(a0, a1, b0, b1) or within(b0, b1, a0, a1) or abs(a0 - b0) < margin or abs(a1 - b1) < margin


def below(box: Box, others: Sequence[Box], steps: int = 20) -> Box:
    """The box with its top moved down, by at most so many pixels a rectangle, until it meets none of the others."""
    for other in others:
        for _ in range(steps):
            if not meet(other, box):
                break
            box = (box[0], box[1] + 1, box[2], box[3] - 1)
    return box


def from_baselines(lines: Sequence[TextLine], use_outlines: bool = True, ink: np.ndarray | None = None) -> dict[object, list[Rectangle]]:
    """Rectangles of each article: from its topmost line on, lines below join as long as the grown box keeps off all rectangles and all other articles' baselines.

    With an image (1 is ink) each is stretched upwards to white space.
    """
    own_box = lambda line: around(line.outline if use_outlines and line.outline else line.baseline)
    by_article: dict[object, list[TextLine]] = {}
    for line in lines:
        by_article.setdefault(line.article, []).append(line)
    placed: dict[object, list[Rectangle]] = {}
    for article, members in by_article.items():
        foreign = [line.baseline for other, more in by_article.items() if other != article for line in more]
        todo = sorted(members, key=lambda line: min(p[1] for p in line.baseline))
        used: set[object] = set()
        for k, line in enumerate(todo):
            if line.name in used:
                continue
            used.add(line.name)
            box = below(own_box(line), [r.box for other, rs in placed.items() if other != article for r in rs])
            now = Rectangle(box, [line])
            for m, other in enumerate(todo[k + 1 :], k + 1):
                if other.name in used or not _column(now, line, other, [x for x in todo[m + 1 :] if x.name not in used], m + 1 == len(todo)):
                    continue
                grown = union(now.box, own_box(other))
                if any(meet(r.box, grown) for rs in placed.values() for r in rs):
                    continue
                grown = _clear(grown, foreign)
                if grown is not None:
                    now.box = grown
                    now.lines.append(other)
                    used.add(other.name)
            if len(now.lines) == 1 and not line.outline:  # a strip above the baseline
                now.box = (now.box[0], now.box[1] - 10, now.box[2], 10)
            if ink is not None:
                now.box = stretched(ink, now.box, max(1, len(ink) // 1000), len(ink) // 10)
            placed.setdefault(article, []).append(now)
    return placed


def _column(now: Rectangle, first: TextLine, other: TextLine, later: Sequence[TextLine], is_last: bool) -> bool:
    """Whether a line stands below a rectangle, or a later free line stands below both."""
    x, y, w, _ = now.box
    if aligned([(x, y), (x + w, y)], other.baseline):
        return True
    if is_last:
        return False
    return not later or any(aligned(first.baseline, z.baseline) and aligned(other.baseline, z.baseline, 50) for z in later)


def _clear(box: Box, foreign: Sequence[Sequence[Point]]) -> Box | None:
    """The box if no other article's baseline crosses it, or with its top a pixel lower where that is enough; else None."""
    for line in foreign:
        if crosses(box, line):
            box = (box[0], box[1] + 1, box[2], box[3] - 1)
            if crosses(box, line):
                return None
    return box


def is_white(ink: np.ndarray, box: Box, threshold: float = 0.05) -> bool:
    """Whether less than the share of the box's pixels is ink; a side of 0 is one pixel."""
    x, y, w, h = box
    return bool(ink[y : y + h + 1, x : x + w + 1].sum() / ((h + 1) * (w + 1)) < threshold)


def stretched(ink: np.ndarray, box: Box, height: int = 1, limit: int = 250, threshold: float = 0.04) -> Box:
    """The box grown upwards, to the first strip over its middle three fifths that is white or at the top; as it is if there is none within the limit."""
    x, y, w, h = box
    top = y - height
    if top < 0 or top + height > ink.shape[1]:
        return box
    for grown in range(1, limit + 1):
        if top == 0 or is_white(ink, (x + w // 5, top, 3 * w // 5, height), threshold):
            return x, top, w, h + grown
        top -= 1
    return box


def merged(placed: dict[object, list[Rectangle]], width: int = 20, distance: int = 50) -> dict[object, list[list[Box]]]:
    """Groups of an article's boxes that overlap or lie closely above one another, with what they share or the gap between them.

    A box inside an earlier one is left out; a gap counts only if no other rectangle lies in it.
    """
    every = [r for rs in placed.values() for r in rs]
    out: dict[object, list[list[Box]]] = {}
    for article, own in placed.items():
        inside: set[int] = set()
        groups: list[list[tuple[Rectangle | None, Box]]] = []
        for k, r in enumerate(own):
            if id(r) in inside:
                continue
            group = next((g for g in groups if any(m is r for m, _ in g)), None)
            if group is None:
                group = [(r, r.box)]
            else:
                groups.remove(group)
            for other in own[k + 1 :]:
                if id(other) in inside:
                    continue
                if contains(r.box, other.box):
                    inside.add(id(other))
                    continue
                shared = overlap(r.box, other.box)
                if shared[2] > width and shared[3] > 0:
                    group += [(other, other.box), (None, shared)]
                elif shared[2] > width and -distance < shared[3] < 0:
                    gap = (shared[0], shared[1] + shared[3], shared[2], -shared[3])
                    if not any(meet(gap, z.box) for z in every if z is not r):
                        group += [(other, other.box), (None, gap)]
            groups.append(group)
        out[article] = [[box for _, box in g] for g in groups]
    return out


def contains(a: Box, b: Box) -> bool:
    """Whether all corners of b lie strictly inside a or on a's corners."""
    x0, y0, x1, y1 = a[0], a[1], a[0] + a[2], a[1] + a[3]
    corners = [(x, y) for x in (b[0], b[0] + b[2]) for y in (b[1], b[1] + b[3])]
    return all((x0 < x < x1 and y0 < y < y1) or (x in (x0, x1) and y in (y0, y1)) for x, y in corners)


def outlines(groups: dict[object, list[list[Box]]], hull: bool = False) -> dict[object, list[list[Point]]]:
    """Surrounding polygons of each group: rectilinear rings around its boxes, or its convex hull."""
    out: dict[object, list[list[Point]]] = {}
    for article, own in groups.items():
        for boxes in own:
            sides = [(x, y, x + w, y + h) for x, y, w, h in boxes]
            if hull:
                out.setdefault(article, []).append(convex_hull([(x, y) for s in sides for x in (s[0], s[2]) for y in (s[1], s[3])]))
            else:
                out.setdefault(article, []).extend(rectilinear_rings(sides))
    return out
