"""Operators on rasters (two-dimensional numpy arrays), for binary files decoded in Arrow batches."""

from __future__ import annotations

import numpy as np


def otsu(image: np.ndarray) -> int:
    """The grey value that parts dark from light with the largest variance between them."""
    counts = np.bincount(image.ravel().astype(np.uint8), minlength=256).astype(float)
    below, mass = np.cumsum(counts), np.cumsum(counts * np.arange(256))
    above = below[-1] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[-1] - mass) / above) ** 2
    return int(np.nanargmax(np.where((below > 0) & (above > 0), spread, -1)))


def binarize(image: np.ndarray) -> np.ndarray:
    """1 for dark pixels by Otsu's threshold."""
    return (image <= otsu(image)).astype(np.uint8)


def adaptive(image: np.ndarray, block: int = 11, offset: float = 16) -> np.ndarray:
    """1 where a pixel is darker than its neighbourhood's mean by the offset."""
    pad = np.pad(image.astype(float), block // 2, mode="edge")
    s = np.pad(pad.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    mean = (s[block:, block:] - s[:-block, block:] - s[block:, :-block] + s[:-block, :-block]) / block**2
    return (image < mean - offset).astype(np.uint8)


def _shifted(mask: np.ndarray, kernel: tuple[int, int], fill: int) -> list[np.ndarray]:
    kh, kw = kernel
    pad = np.pad(mask, ((kh // 2, kh - 1 - kh // 2), (kw // 2, kw - 1 - kw // 2)), constant_values=fill)
    return [pad[i : i + mask.shape[0], j : j + mask.shape[1]] for i in range(kh) for j in range(kw)]


def erode(mask: np.ndarray, kernel=(3, 3)) -> np.ndarray:
    return np.minimum.reduce(_shifted(mask, kernel, 1))


def dilate(mask: np.ndarray, kernel=(3, 3)) -> np.ndarray:
    return np.maximum.reduce(_shifted(mask, kernel, 0))


def morphology(mask: np.ndarray, how: str, kernel=(3, 3)) -> np.ndarray:
    """erode, dilate, open, close, gradient, tophat or blackhat."""
    opened = lambda: dilate(erode(mask, kernel), kernel)
    closed = lambda: erode(dilate(mask, kernel), kernel)
    return {"erode": lambda: erode(mask, kernel), "dilate": lambda: dilate(mask, kernel), "open": opened, "close": closed, "gradient": lambda: dilate(mask, kernel) - erode(mask, kernel), "tophat": lambda: mask - opened(), "blackhat": lambda: closed() - mask}[how]()


def connected(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Boxes (x0, y0, x1, y1, pixels) of the 8-connected components, joined run by run."""
    root: list[int] = []
    box: list[list[int]] = []

    def find(k):
        while root[k] != k:
            root[k] = root[root[k]]
            k = root[k]
        return k

    before: list[tuple[int, int, int]] = []
    for y, row in enumerate(np.pad(mask.astype(np.int8), ((0, 0), (1, 1)))):
        step = np.diff(row)
        runs = []
        for a, b in zip(np.flatnonzero(step == 1).tolist(), (np.flatnonzero(step == -1) - 1).tolist(), strict=True):
            k = len(root)
            root.append(k)
            box.append([a, y, b, y, b - a + 1])
            for p, q, m in before:
                if p <= b + 1 and q >= a - 1:
                    m, own = find(m), find(k)
                    if m != own:
                        low, high = min(m, own), max(m, own)
                        root[high] = low
                        box[low] = [min(box[low][0], box[high][0]), min(box[low][1], box[high][1]), max(box[low][2], box[high][2]), max(box[low][3], box[high][3]), box[low][4] + box[high][4]]
            runs.append((a, b, k))
        before = runs
    return sorted(tuple(box[k]) for k in range(len(root)) if root[k] == k)


def keep_large(mask: np.ndarray, least: int) -> list[tuple[int, int, int, int, int]]:
    return [b for b in connected(mask) if b[4] >= least]


def distances(mask: np.ndarray) -> np.ndarray:
    """City-block distance of each set pixel from the nearest unset one; outside counts as unset."""
    d = np.where(np.pad(mask, 1) > 0, np.iinfo(np.int32).max // 2, 0).astype(np.int64)
    for _ in range(2):
        for y in range(1, d.shape[0]):
            d[y] = np.minimum(d[y], d[y - 1] + 1)
        for x in range(1, d.shape[1]):
            d[:, x] = np.minimum(d[:, x], d[:, x - 1] + 1)
        d = d[::-1, ::-1]
    return d[1:-1, 1:-1]


def separators(mask: np.ndarray, least: int = 100, wide: float = 0.015, high: float = 0.02) -> dict[str, list[tuple[int, int, int, int, int]]]:
    """Horizontal and vertical separators: openings with long thin kernels, without small components."""
    h, w = mask.shape
    flat_ = morphology(mask, "open", (1, max(3, int(w * wide))))
    upright = morphology(mask, "open", (max(3, int(h * high)), 1))
    return {"horizontal": keep_large(np.clip(flat_.astype(int) - upright, 0, 1), least), "vertical": keep_large(upright, least)}


def polygon_mask(shape: tuple[int, int], ring: list[tuple[float, float]]) -> np.ndarray:
    """1 on pixels whose centre is inside a polygon."""
    y, x = np.mgrid[: shape[0], : shape[1]]
    odd = np.zeros(shape, bool)
    for (x0, y0), (x1, y1) in zip(ring, ring[1:] + ring[:1], strict=True):
        with np.errstate(divide="ignore", invalid="ignore"):
            odd ^= ((y0 > y) != (y1 > y)) & (x < (x1 - x0) * (y - y0) / (y1 - y0) + x0)
    return odd.astype(np.uint8)


def xy_cut(mask: np.ndarray, depth: int = 4, share: float = 0.02, least: int = 3) -> list[tuple[int, int, int, int]]:
    """Boxes by cutting along blank rows, then blank columns, and so on."""

    def step(x0: int, y0: int, x1: int, y1: int, axis: int, level: int, stuck: bool) -> list[tuple[int, int, int, int]]:
        part = mask[y0:y1, x0:x1]
        if not part.any():
            return []
        if level == 0:
            return [(x0, y0, x1, y1)]
        ink = np.pad((part.mean(axis=1 - axis) > share).astype(np.int8), 1)
        starts, ends = np.flatnonzero(np.diff(ink) == 1), np.flatnonzero(np.diff(ink) == -1)
        runs: list[list[int]] = []
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            if runs and a - runs[-1][1] < least:
                runs[-1][1] = b
            else:
                runs.append([a, b])
        if len(runs) <= 1 and stuck:
            return [(x0, y0, x1, y1)]
        boxes = [(x0, y0 + a, x1, y0 + b) if axis == 0 else (x0 + a, y0, x0 + b, y1) for a, b in runs]
        return [r for b in boxes for r in step(*b, 1 - axis, level - 1, len(runs) <= 1)]

    return step(0, 0, mask.shape[1], mask.shape[0], 0, depth, False)


def rotation(mask: np.ndarray, angles=tuple(range(-5, 6))) -> int:
    """The angle in degrees whose sheared row profile changes most between rows."""
    y, x = np.nonzero(mask)

    def score(angle: int) -> float:
        rows = np.round(y - x * np.tan(np.radians(angle))).astype(int)
        return float((np.diff(np.bincount(rows - rows.min())) ** 2).sum()) if len(rows) else 0.0

    return max(angles, key=lambda a: (score(a), -abs(a)))


#: The five-pixel Gaussian kernel.
BLUR = np.array([1, 4, 6, 4, 1]) / 16


def blurred(image: np.ndarray) -> np.ndarray:
    """Both axes under the kernel, reflected at the border without its pixel."""
    out = image.astype(float)
    for axis in (0, 1):
        width = [(2, 2) if k == axis else (0, 0) for k in (0, 1)]
        pad = np.pad(out, width, mode="reflect" if out.shape[axis] > 2 else "edge")
        out = sum(w * np.take(pad, range(k, k + out.shape[axis]), axis) for k, w in enumerate(BLUR))
    return np.round(out).astype(np.uint8)


def straight_distances(mask: np.ndarray) -> np.ndarray:
    """Straight-line distance of each set pixel from the nearest unset one of the image, rounded down; 255 at most, also without an unset one."""
    far = 255
    up = np.where(mask > 0, far, 0).astype(np.int64)
    for rows in (range(1, len(up)), range(len(up) - 2, -1, -1)):
        step = 1 if rows.step > 0 else -1
        for y in rows:
            up[y] = np.minimum(up[y], up[y - step] + 1)
    best = up**2
    pad = np.pad(up**2, ((0, 0), (far, far)), constant_values=far**2)
    for dx in range(1, far):
        if dx * dx >= best.max(initial=0):
            break
        best = np.minimum(best, dx * dx + np.minimum(pad[:, far - dx : far - dx + mask.shape[1]], pad[:, far + dx : far + dx + mask.shape[1]]))
    return np.minimum(far, np.floor(np.sqrt(best))).astype(np.uint8)


def stroke_image(image: np.ndarray) -> np.ndarray:
    """How deep each dark pixel lies in its stroke, 0 on light ones."""
    light = blurred(255 - image)
    return straight_distances((light > otsu(light)).astype(np.uint8))


def strokes(depth: np.ndarray, box: tuple[int, int, int, int]) -> tuple[float, int]:
    """Of a line's box (x0, y0, x1, y1, both ends in it): the median of its components' greatest depths, and the largest component's height.

    Components of less than 3 or more than 500 pixels on a side, or 8 times as long as wide, don't count; 0 without any.
    """
    x0, y0, x1, y1 = box
    part = depth[y0 : y1 + 1, x0 : x1 + 1]
    found = []
    for a, b, c, d, _ in connected(part > 0):
        w, h = c - a + 1, d - b + 1
        if min(w, h) >= 3 and max(w, h) <= min(500, 8 * min(w, h)):
            found.append((int(part[b : d + 1, a : c + 1].max()), h))
    return (float(np.median([m for m, _ in found])), max(h for _, h in found)) if found else (0.0, 0)


def _upright_box(ring: list[tuple[float, float]]) -> tuple[int, int, int, int] | None:
    """(x0, y0, x1, y1) of a ring that is a box of whole numbers with sides along the axes."""
    if len(ring) != 4 or not all(isinstance(v, int) for p in ring for v in p):
        return None
    (ax, ay), (bx, by), (cx, cy), (dx, dy) = ring
    if not ((ay == by and bx == cx and cy == dy and dx == ax) or (ax == bx and by == cy and cx == dx and dy == ay)):
        return None
    return min(ax, cx), min(ay, cy), max(ax, cx), max(ay, cy)


def _set(out: np.ndarray, x0: int, y0: int, x1: int, y1: int) -> None:
    """Sets the pixels of a box, both ends in it, as far as they are in the image."""
    if x1 >= 0 and y1 >= 0:
        out[max(0, y0) : y1 + 1, max(0, x0) : x1 + 1] = True


def _draw_segment(out: np.ndarray, ax: float, ay: float, bx: float, by: float, half: float) -> None:
    if (ax == bx or ay == by) and all(isinstance(v, int) for v in (ax, ay, bx, by)):
        # along an axis: a bar, and round caps column by column
        x0, x1, y0, y1, reach = min(ax, bx), max(ax, bx), min(ay, by), max(ay, by), int(half)
        for beyond in range(reach + 1):
            side = max(k for k in range(reach + 1) if beyond * beyond + k * k <= half * half)
            if ay == by:
                _set(out, x0 - beyond, y0 - side, x1 + beyond, y0 + side)
            else:
                _set(out, x0 - side, y0 - beyond, x0 + side, y1 + beyond)
        return
    x0, x1 = max(0, int(min(ax, bx) - half)), min(out.shape[1], int(max(ax, bx) + half) + 2)
    y0, y1 = max(0, int(min(ay, by) - half)), min(out.shape[0], int(max(ay, by) + half) + 2)
    if x0 >= x1 or y0 >= y1:
        return
    y, x = np.mgrid[y0:y1, x0:x1]
    dx, dy = bx - ax, by - ay
    along = np.clip(((x - ax) * dx + (y - ay) * dy) / ((dx * dx + dy * dy) or 1), 0, 1)
    out[y0:y1, x0:x1] |= (x - ax - along * dx) ** 2 + (y - ay - along * dy) ** 2 <= half * half


def drawn(shape: tuple[int, int], lines: list[list[tuple[float, float]]], closed: bool = True, fill: bool = False, width: float = 7) -> np.ndarray:
    """255 on the pixels within half the width of a line (of a pixel at least), and inside it if it is closed and filled."""
    out, half = np.zeros(shape, bool), max(width, 1) / 2
    for line in lines:
        box = _upright_box(line) if closed and fill else None
        if box and half < 1:  # its inside and its outline
            _set(out, *box)
            continue
        if closed and fill:
            out |= polygon_mask(shape, line) > 0
        ring = [*line, line[0]] if closed else line
        for (ax, ay), (bx, by) in zip(ring, ring[1:], strict=False):
            _draw_segment(out, ax, ay, bx, by, half)
    return out.astype(np.uint8) * 255


def ground_truth(shape: tuple[int, int], channels: dict[str, list[list[tuple[float, float]]]], outline: bool = False) -> dict[str, np.ndarray]:
    """A binary image a channel, made disjoint (the first channel keeps what it has), and what no channel has as other."""
    out, taken = {}, np.zeros(shape, bool)
    for name, rings in channels.items():
        image = drawn(shape, rings, fill=not outline, width=7 if outline else 1) > 0
        out[name] = (image & ~taken).astype(np.uint8) * 255
        taken |= image
    return out | {"other": (~taken).astype(np.uint8) * 255}


def banded(shape: tuple[int, int], groups: list[list[tuple[int, int, int, int]]]) -> tuple[np.ndarray, np.ndarray]:
    """Images of boxes (x0, y0, x1, y1, both ends in it), one a group, as the rows that differ (images, rows, columns) and how often each comes."""
    cuts = {0, shape[0]}
    for boxes in groups:
        for _, y0, _, y1 in boxes:
            cuts |= {min(max(y0, 0), shape[0]), min(max(y1 + 1, 0), shape[0])}
    ordered = sorted(cuts)
    place = {y: k for k, y in enumerate(ordered)}
    out = np.zeros((len(groups), len(ordered) - 1, shape[1]), bool)
    for image, boxes in zip(out, groups, strict=True):
        for x0, y0, x1, y1 in boxes:
            if x1 >= 0 and y1 >= 0:
                image[place[min(max(y0, 0), shape[0])] : place[min(y1 + 1, shape[0])], max(x0, 0) : x1 + 1] = True
    return out, np.diff(ordered)


# -- many images at once: a stack is (images, rows, columns), each image in its upper left corner and 0 beyond its own size ----------
def outside(shape: tuple[int, ...], heights: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Whether a pixel of a stack lies beyond its image."""
    return (np.arange(shape[1])[None, :, None] >= heights[:, None, None]) | (np.arange(shape[2])[None, None] >= widths[:, None, None])


def histograms(stack: np.ndarray, heights: np.ndarray, widths: np.ndarray, few: int = 8) -> np.ndarray:
    """How often each image has each of 256 values; images of few values are counted a value at a time."""
    out, value = np.zeros((len(stack), 256), np.int64), int(stack.min(initial=255))
    for _ in range(few):
        out[:, value] = np.count_nonzero(stack == value, axis=(1, 2))
        if value == 255 or out.sum() == stack.size:
            break
        value = int(np.where(stack > value, stack, 255).min(initial=255))
    if out.sum() < stack.size:
        out = np.stack([np.bincount(image.ravel(), minlength=256) for image in stack])
    out[:, 0] -= stack.shape[1] * stack.shape[2] - heights * widths
    return out


def many_otsu(counts: np.ndarray) -> np.ndarray:
    """``otsu`` of every histogram."""
    below, mass = np.cumsum(counts.astype(float), axis=1), np.cumsum(counts.astype(float) * np.arange(256), axis=1)
    above = below[:, -1:] - below
    with np.errstate(divide="ignore", invalid="ignore"):
        spread = below * above * (mass / below - (mass[:, -1:] - mass) / above) ** 2
    return np.where((below > 0) & (above > 0), spread, -1).argmax(axis=1)


def many_binarized(stack: np.ndarray, heights: np.ndarray, widths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``binarize`` of every image, and the thresholds."""
    found = many_otsu(histograms(stack, heights, widths))
    mask = (stack <= found[:, None, None]).view(np.uint8)
    mask[outside(stack.shape, heights, widths)] = 0
    return mask, found


def _windows(stack: np.ndarray, length: int, axis: int, least: bool) -> np.ndarray:
    """The least or greatest of the pixels that a kernel of a length covers along an axis; beyond the stack are 1 or 0."""
    pad = [(0, 0)] * 3
    pad[axis] = (length // 2, length - 1 - length // 2)
    out, pick, done = np.moveaxis(np.pad(stack, pad, constant_values=int(least)), axis, 0), np.minimum if least else np.maximum, 1
    while 2 * done <= length:
        out, done = pick(out[:-done], out[done:]), 2 * done
    if done < length:
        out = pick(out[: len(out) - length + done], out[length - done :])
    return np.moveaxis(out, 0, axis)


def many_morphed(stack: np.ndarray, how: str, kernel: tuple[int, int], heights: np.ndarray, widths: np.ndarray) -> np.ndarray:
    """Every mask opened or closed as by ``morphology``."""
    beyond = outside(stack.shape, heights, widths)
    for least in (True, False) if how == "open" else (False, True):
        stack = stack.copy()
        stack[beyond] = least
        stack = _windows(_windows(stack, kernel[0], 1, least), kernel[1], 2, least)
    stack = np.ascontiguousarray(stack)
    stack[beyond] = 0
    return stack


def runs(stack: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Image, row, first and last column of every run of set pixels, in this order, and the first run of its 8-connected component."""
    images, height, width = stack.shape
    pad = np.zeros((images, height, width + 2), bool)
    pad[:, :, 1:-1] = stack > 0
    turns = np.flatnonzero(pad[:, :, 1:] != pad[:, :, :-1])
    line, first = np.divmod(turns[::2], width + 1)
    last = turns[1::2] % (width + 1) - 1
    image, row = np.divmod(line, height) if height else (line, line)
    # runs of the row above that touch: their ends aren't before this one's start, their starts not behind its end
    level, wide = image * (height + 1) + row, width + 4
    low = np.searchsorted(level * wide + last, (level - 1) * wide + first - 1, "left")
    many = np.maximum(np.searchsorted(level * wide + first, (level - 1) * wide + last + 1, "right") - low, 0)
    u = np.repeat(np.arange(len(line)), many)
    v = np.arange(len(u)) - np.repeat(np.cumsum(many) - many - low, many)
    root = np.arange(len(line))
    while len(u):
        a, b = root[u], root[v]
        apart = a != b
        if not apart.any():
            break
        u, v, a, b = u[apart], v[apart], a[apart], b[apart]
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (up := root[root]).tolist() != root.tolist():
            root = up
    return image, row, first, last, root


def many_distances(stack: np.ndarray) -> np.ndarray:
    """``distances`` of every mask."""
    d = np.where(np.pad(stack.transpose(1, 2, 0), ((1, 1), (1, 1), (0, 0))) > 0, np.int32(np.iinfo(np.int32).max // 2), np.int32(0))
    for _ in range(2):
        for y in range(1, d.shape[0]):
            d[y] = np.minimum(d[y], d[y - 1] + 1)
        for x in range(1, d.shape[1]):
            d[:, x] = np.minimum(d[:, x], d[:, x - 1] + 1)
        d = d[::-1, ::-1]
    return d[1:-1, 1:-1].transpose(2, 0, 1)


def _running(stack: np.ndarray, axis: int) -> np.ndarray:
    """Set pixels before each place along an axis, which comes first."""
    moved = np.ascontiguousarray(np.moveaxis(stack, axis, 0))
    out = np.zeros((len(moved) + 1, *moved.shape[1:]), np.int16 if len(moved) < 1 << 15 else np.int32)
    for k in range(len(moved)):  # many times as fast as cumsum across long rows
        np.add(out[k], moved[k], out=out[k + 1])
    return out


def many_xy_cuts(stack: np.ndarray, heights: np.ndarray, widths: np.ndarray, depth: int = 4, share: float = 0.02, least: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """``xy_cut`` of every mask, a level of all at a time: the boxes (x0, y0, x1, y1) in its order, and the image of each."""
    image = np.arange(len(stack))
    box = np.stack([np.zeros_like(image), np.zeros_like(image), widths, heights], axis=1)
    done, stuck = np.zeros(len(image), bool), np.zeros(len(image), bool)
    before = [_running(stack, 2), _running(stack, 1)]  # pixels left of a column by image and row, above a row by image and column
    for level in range(depth, -1, -1):
        axis = (depth - level) % 2
        start, stop, near, far = (box[:, k] for k in ((1, 3, 0, 2) if axis == 0 else (0, 2, 1, 3)))
        length = np.where(done, 0, stop - start)
        of = np.repeat(np.arange(len(box)), length)
        at = np.arange(len(of)) - np.repeat(np.cumsum(length) - length - start, length)
        count = before[axis][far[of], image[of], at].astype(np.int64) - before[axis][near[of], image[of], at]
        has = np.bincount(of, count, minlength=len(box)) > 0
        if level == 0:
            keep = done | has
            return box[keep], image[keep]
        ink = count / (far - near)[of] > share
        new = np.append(True, of[1:] != of[:-1]) if len(of) else np.zeros(0, bool)
        first = np.flatnonzero(ink & (new | ~np.append(False, ink[:-1])))
        last = np.flatnonzero(ink & np.append(new[1:] | ~ink[1:], True)) if len(of) else first
        # runs that lie closely behind the last one join it
        join = np.append(False, (of[first[1:]] == of[first[:-1]]) & (at[first[1:]] - at[last[:-1]] - 1 < least)) if len(first) else np.zeros(0, bool)
        heads = np.flatnonzero(~join)
        first, last = first[heads], last[np.append(heads[1:], len(join)) - 1] if len(heads) else last[heads]
        parts = np.bincount(of[first], minlength=len(box))
        parts[~has] = 0
        single = parts <= 1
        whole = done | (has & single & stuck)
        good = ~whole[of[first]] & has[of[first]]
        first, last = first[good], last[good]
        times = np.where(whole, 1, parts)
        source = np.repeat(np.arange(len(box)), times)
        box, image, done, stuck = box[source], image[source], whole[source], single[source]
        box[~done, 1 - axis], box[~done, 3 - axis] = at[first], at[last] + 1
    return box, image


def many_rotations(stack: np.ndarray, angles=tuple(range(-5, 6))) -> tuple[np.ndarray, np.ndarray]:
    """``rotation`` of every mask, and how far each angle moves each column's pixels (angles, columns)."""
    x = np.arange(stack.shape[2])
    moves = x * np.tan(np.radians(np.array(angles)))[:, None]
    shifts = np.round(-moves).astype(int)
    if (np.abs(moves % 1 - 0.5) < 1e-6).any():  # a row's rounding may depend on the row
        return np.array([rotation(m, angles) for m in stack], int), shifts
    before, height = _running(stack, 2), stack.shape[1]
    scores = np.zeros((len(angles), len(stack)), np.int64)
    for k, shift in enumerate(shifts):
        bounds = np.append(np.flatnonzero(np.diff(shift, prepend=shift[0] + 1)), len(x))
        low = shift.min()
        rows = np.zeros((len(stack), height + int(np.ptp(shift)) + 2), np.int64)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            at = int(shift[a] - low) + 1
            rows[:, at : at + height] += before[b] - before[a]
        each, inked = np.arange(len(rows)), rows > 0
        ends = rows[each, inked.argmax(axis=1)], rows[each, rows.shape[1] - 1 - inked[:, ::-1].argmax(axis=1)]
        scores[k] = (np.diff(rows, axis=1) ** 2).sum(axis=1) - ends[0] ** 2 - ends[1] ** 2
    order = np.array(sorted(range(len(angles)), key=lambda k: abs(angles[k])))
    return np.array(angles)[order[scores[order].argmax(axis=0)]], shifts


def sheared(mask: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """The mask with each column's pixels moved down by its shift, from the first row with ink to the last."""
    if not shift.any():
        inked = np.flatnonzero(mask.any(axis=1))
        return mask[inked[0] : inked[-1] + 1] if len(inked) else mask[:0]
    bounds = np.append(np.flatnonzero(np.diff(shift, prepend=shift[0] + 1)), len(shift))
    low = shift.min()
    out = np.zeros((len(mask) + int(np.ptp(shift)), mask.shape[1]), np.uint8)
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        at = int(shift[a] - low)
        out[at : at + len(mask), a:b] = mask[:, a:b]
    inked = np.flatnonzero(out.any(axis=1))
    return out[inked[0] : inked[-1] + 1] if len(inked) else out[:0]


def stacked(images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The images as a stack, and their heights and widths."""
    heights, widths = (np.array([im.shape[k] for im in images]) for k in (0, 1))
    out = np.zeros((len(images), heights.max(initial=0), widths.max(initial=0)), np.uint8)
    for own, image in zip(out, images, strict=True):
        own[: image.shape[0], : image.shape[1]] = image
    return out, heights, widths


def many_stroke_images(images: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``stroke_image`` of every image as a stack, and their heights and widths; the blur is done in whole numbers."""
    heights, widths = (np.array([im.shape[k] for im in images]) for k in (0, 1))
    light = np.zeros((len(images), heights.max(initial=0) + 4, widths.max(initial=0) + 4), np.uint16)
    for own, image in zip(light, images, strict=True):
        own[2 : len(image) + 2, 2 : image.shape[1] + 2] = 255 - image
        for n, side in ((image.shape[1], own.T), (image.shape[0], own)):  # the columns' borders, then the rows'
            for to, reflected, edge in ((0, 4, 2), (1, 3, 2), (n + 2, n, n + 1), (n + 3, n - 1, n + 1)):
                side[to] = side[reflected if n > 2 else edge]
    for axis in (1, 2):
        a, b, c, d, e = (light[:, k : k + light.shape[1] - 4] if axis == 1 else light[:, :, k : k + light.shape[2] - 4] for k in range(5))
        light = a + e + 4 * (b + d) + 6 * c
    light = ((light + 127 + ((light >> 8) & 1)) >> 8).astype(np.uint8)  # halves to the even number
    beyond = outside(light.shape, heights, widths)
    light[beyond] = 0
    mask = light > many_otsu(histograms(light, heights, widths, few=0))[:, None, None]
    return many_straight_distances(mask, beyond), heights, widths


def many_straight_distances(stack: np.ndarray, beyond: np.ndarray) -> np.ndarray:
    """``straight_distances`` of every mask; what is beyond its image isn't an unset pixel."""
    far = 255
    up = np.where((stack | beyond).transpose(1, 0, 2) > 0, np.int16(far), np.int16(0))  # a row of all images at a time
    for rows in (range(1, len(up)), range(len(up) - 2, -1, -1)):
        step = 1 if rows.step > 0 else -1
        for y in rows:
            np.minimum(up[y], up[y - step] + np.int16(1), out=up[y])
    beyond, wide = beyond.transpose(1, 0, 2), up.shape[2]
    small = np.where(beyond, 0, up).max(initial=0) < 180  # then 16 bits hold all that may be least
    before = np.minimum(up, 180).astype(np.uint16) ** 2 if small else up.astype(np.int32) ** 2
    best = np.where(beyond, before.dtype.type(0), before)
    before = np.pad(before, ((0, 0), (0, 0), (far, far)), constant_values=180**2 if small else far**2)
    for dx in range(1, far):
        if dx * dx >= best.max(initial=0):
            break
        sides = np.minimum(before[..., far - dx : far - dx + wide], before[..., far + dx : far + dx + wide])
        best = np.minimum(best, sides + best.dtype.type(dx * dx))
    root = np.minimum(far, np.floor(np.sqrt(np.arange(int(best.max(initial=0)) + 1)))).astype(np.uint8)
    return np.ascontiguousarray(root[best].transpose(1, 0, 2))


def many_strokes(parts: list[np.ndarray]) -> list[tuple[float, int]]:
    """``strokes`` of every line, given the depths in its box."""
    stack, _, _ = stacked(parts)
    image, row, first, last, root = runs(stack)
    order = np.argsort(root, kind="stable")
    heads = np.flatnonzero(np.diff(root[order], prepend=-1))
    out: list[tuple[float, int]] = [(0.0, 0)] * len(parts)
    if not len(heads):
        return out
    image, x0, y0 = image[order][heads], np.minimum.reduceat(first[order], heads), np.minimum.reduceat(row[order], heads)
    w, h = np.maximum.reduceat(last[order], heads) - x0 + 1, np.maximum.reduceat(row[order], heads) - y0 + 1
    counts = (np.minimum(w, h) >= 3) & (np.maximum(w, h) <= np.minimum(500, 8 * np.minimum(w, h)))
    image, x0, y0, w, h = (v[counts] for v in (image, x0, y0, w, h))
    if not len(image):
        return out
    size = w * h
    of = np.repeat(np.arange(len(size)), size)
    down, along = np.divmod(np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size), w[of])
    most = np.maximum.reduceat(stack[image[of], y0[of] + down, x0[of] + along], np.cumsum(size) - size).astype(int)
    order = np.lexsort((most, image))
    image, most, h = image[order], most[order], h[order]
    heads = np.flatnonzero(np.diff(image, prepend=-1))
    n = np.diff(np.append(heads, len(image)))
    middle = (most[heads + (n - 1) // 2] + most[heads + n // 2]) / 2
    for k, depth, tall in zip(image[heads].tolist(), middle.tolist(), np.maximum.reduceat(h, heads).tolist(), strict=True):
        out[k] = (depth, tall)
    return out


def by_size(items: list, function, pixels: int = 1 << 20, image=lambda item: item) -> list:
    """The function's results for images, or for items that hold one, in their order; it gets lists of those of like heights whose stack has about so many pixels."""
    order = sorted(range(len(items)), key=lambda k: image(items[k]).shape)
    out, k = [None] * len(items), 0
    while k < len(order):
        n, wide = k, 0
        while n < len(order) and (n == k or (n - k + 1) * image(items[order[n]]).shape[0] * max(wide, image(items[order[n]]).shape[1]) <= pixels):
            wide, n = max(wide, image(items[order[n]]).shape[1]), n + 1
        for at, found in zip(order[k:n], function([items[m] for m in order[k:n]]), strict=True):
            out[at] = found
        k = n
    return out
